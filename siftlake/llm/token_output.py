"""Token-ID output: Parquet list columns whose encodings, row groups and pages are set, with page indexes.

`write_tokens` encodes documents and writes one row per document in ascending doc_id order over range partitions:
  doc_id, part, start_in_part, n_tokens, ids (list of int32).
ids are dictionary-encoded (a vocabulary fits one dictionary page); the other columns are delta-encoded, so they can be
read alone for a few bytes per document. Row groups and pages are kept small and carry column and offset indexes, so a
reader that wants a range of doc_id opens only the pages that hold it.

Defined cases: null or empty text gives only the end id; a null doc_id sorts first; repeated ids keep a row each; an
empty table gives no rows; extra columns are ignored. A text is encoded as a whole whatever its length. Strings of the
tokenizer's special tokens in a text become these tokens, as the library has it.
"""

from __future__ import annotations

import json
import os
import re
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Scratch, public_tokenizer, remembers, serve, shuffle_partitions, text_bytes

SCHEMA = "doc_id long, part int, start_in_part long, n_tokens long, ids array<int>"


#: How a tokenizer file must cut texts for chunks to be encoded one by one: white space is one space, upper case is lower
#: case, and runs of letters, single digits and runs of other characters are pieces of their own.
CHUNKED = {
    "normalizer": {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]},
    "pre_tokenizer": {
        "type": "Sequence",
        "pretokenizers": [
            {"type": "Split", "pattern": {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"}, "behavior": "Removed", "invert": True},
            {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
        ],
    },
}


class ChunkEncoder(dict):
    """Numbers of the chunks between white space, and the token ids of each; forgets everything when it has grown large.

    The tokenizer cuts at white space and wherever the class of characters changes before it looks at its vocabulary,
    and it lower-cases. So a text's ids are those of its chunks in a row, and letters followed by punctuation have the
    ids of the two. Texts are therefore lower-cased, and a full stop or comma that ends a chunk is set apart as a marked
    chunk of its own, which holds wherever the character before it is a letter or a digit; the few texts where it is not
    are cut at white space only. Plain Latin letters go straight to the library's model; everything else goes through
    the whole library pipeline. Texts with the string of a special token are given to the library as a whole, and so are
    all texts if the tokenizer's file does not cut as CHUNKED says.
    """

    LIMIT = 400_000
    PLAIN = re.compile(r"([a-zß-öø-ÿ]+)([.,!?;:*%$&#|]*)")
    MARK = b"\xff"  # in no UTF-8 text
    END = b"\n"  # no chunk has a line end; the end id stands under it

    def __init__(self, path: str):
        super().__init__()
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.tokenize = self.model.tokenize
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        self.chunked = all(spec.get(k) == v for k, v in CHUNKED.items()) and spec["model"].get("type") == "BPE"
        self.special = [t["content"].lower().encode() for t in spec.get("added_tokens", ())]
        head = os.path.commonprefix(self.special).decode("utf-8", "ignore")
        self.head = head.encode() if head == head.upper() else b""  # stands in a text in any case of letters
        self.end_id: int | None = None
        visible = [*range(33, 127), *range(161, 173), *range(174, 256)]
        hidden = [b for b in range(256) if b not in set(visible)]
        self.shown = {**{b: chr(b) for b in visible}, **{b: chr(256 + i) for i, b in enumerate(hidden)}}
        self.tails: dict[str, list[int]] = {"": []}
        self.reset()

    def reset(self) -> None:
        self.clear()
        self.first, self.count, self.flat, self.kind = array("q"), array("i"), array("i"), bytearray()

    def piece(self, text: str) -> list[int]:
        return [t.id for t in self.model.tokenize(text.encode().decode("latin-1").translate(self.shown))]

    def __missing__(self, chunk: bytes) -> int:
        if chunk.isalpha():  # ASCII letters, in lower case by now: the model's own characters
            ids = [t.id for t in self.tokenize(chunk.decode())]
            self[chunk] = at = len(self.first)
            self.first.append(len(self.flat))
            self.count.append(len(ids))
            self.kind.append(0)
            self.flat.extend(ids)
            return at
        marked = chunk[:1] == self.MARK and len(chunk) > 1
        text = (chunk[1:] if marked else chunk).decode("utf-8", "replace")
        m = self.PLAIN.fullmatch(text)
        if m:
            tail = self.tails.get(m[2])
            if tail is None:
                tail = self.piece(m[2])
                if len(self.tails) < 10_000:
                    self.tails[m[2]] = tail
            ids = self.piece(m[1]) + tail
        else:
            ids = self.tokenizer.encode(text, add_special_tokens=False).ids
        return self.put(chunk, ids, 1 if marked else 0 if text.lower()[-1:].isalnum() else 2)

    def put(self, chunk: bytes, ids: list[int], kind: int) -> int:
        self[chunk] = at = len(self.first)
        self.first.append(len(self.flat))
        self.count.append(len(ids))
        self.kind.append(kind)  # 1: marked, 2: ends in something else than a letter or digit
        self.flat.extend(ids)
        return at

    def chunks(self, text: bytes, plain: bool) -> list[bytes]:
        text = text.lower()
        if not plain:
            for end in (b". ", b", ", b".\n", b",\n"):
                text = text.replace(end, b" \xff" + end)
        return text.split()

    def has_special(self, text: bytes) -> bool:
        if not self.special or self.head not in text:
            return False
        low = text.lower()
        return any(s in low for s in self.special)

    def whole(self, texts: list[bytes], end_id: int) -> list[np.ndarray]:
        """Ids of each text from the library alone, with the end id."""
        found = self.tokenizer.encode_batch([t.decode("utf-8", "replace") for t in texts], add_special_tokens=False)
        return [np.array([*x.ids, end_id], np.int32) for x in found]

    def encode(self, texts: list[bytes], end_id: int) -> tuple[np.ndarray, np.ndarray]:
        """Flat ids of all texts, each followed by the end id, and how many each text has."""
        special = [i for i, t in enumerate(texts) if not self.chunked or self.has_special(t)]
        if not special:
            return self.by_chunks(texts, end_id)
        rest = sorted(set(range(len(texts))).difference(special))
        flat, sizes = self.by_chunks([texts[i] for i in rest], end_id)
        parts = dict(zip(rest, np.split(flat, np.cumsum(sizes)[:-1]))) | dict(zip(special, self.whole([texts[i] for i in special], end_id)))
        return np.concatenate([parts[i] for i in range(len(texts))]), np.array([len(parts[i]) for i in range(len(texts))], np.int64)

    def by_chunks(self, texts: list[bytes], end_id: int, plain: bool = False) -> tuple[np.ndarray, np.ndarray]:
        if not texts:
            return np.empty(0, np.int32), np.empty(0, np.int64)
        if len(self) >= self.LIMIT or self.end_id != end_id:
            self.reset()
            self.end_id = end_id
        if self.END not in self:
            self.put(self.END, [end_id], 0)
        every: list[bytes] = []
        bounds = []
        for text in texts:
            if self.MARK in text:  # not UTF-8; read as such bytes are decoded
                text = text.decode("utf-8", "replace").encode()
            every += self.chunks(text, plain)
            every.append(self.END)
            bounds.append(len(every))
        rows = np.fromiter(map(self.__getitem__, every), np.int64, len(every))
        last = np.array(bounds)
        kind = np.frombuffer(bytes(self.kind), np.uint8)[rows]
        wrong = np.flatnonzero((kind[1:] == 1) & (kind[:-1] != 0)) + 1
        n = np.array(self.count, np.int64)[rows]
        ends = np.cumsum(n)
        flat = np.array(self.flat, np.int32)[np.repeat(np.array(self.first)[rows] - (ends - n), n) + np.arange(ends[-1])]
        sizes = np.diff(ends[last - 1], prepend=0)
        if plain or not len(wrong):
            return flat, sizes
        parts = np.split(flat, np.cumsum(sizes)[:-1])
        for i in np.unique(np.searchsorted(last, wrong, side="right")).tolist():
            parts[i], size = self.by_chunks([texts[i]], end_id, plain=True)
            sizes[i] = size[0]
        return np.concatenate(parts), sizes


_ENCODERS: dict[str, ChunkEncoder] = {}
remembers("tokens", _ENCODERS.clear)


def encoder_of(path: str) -> ChunkEncoder:
    """The encoder of this Python worker; what it remembers serves all tasks that the worker runs."""
    serve("tokens")
    if path not in _ENCODERS:
        _ENCODERS[path] = ChunkEncoder(path)
    return _ENCODERS[path]


def _slices(batch: pa.RecordBatch, budget: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Parts of a batch with about a bounded number of text bytes."""
    sizes = np.array([len(x) for x in batch.column(1).to_pylist()], np.int64)
    part = np.cumsum(sizes) // budget
    cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), batch.num_rows]
    for a, b in zip(cuts, cuts[1:]):
        if b > a:
            yield batch.slice(a, b - a)


def encode_sorted(docs: DataFrame, tokenizer_path: str, end_id: int, partitions: int) -> DataFrame:
    """Rows of SCHEMA in range partitions of doc_id, ascending within each."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        encoder, part, start = encoder_of(tokenizer_path), TaskContext.get().partitionId(), 0
        for whole in batches:
            for batch in _slices(whole):
                ids, counts = encoder.encode(batch.column(1).to_pylist(), end_id)
                ends = np.cumsum(counts)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0),
                        pa.array(np.full(len(counts), part, np.int32)),
                        pa.array(start + ends - counts),
                        pa.array(counts),
                        pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]).astype(np.int32)), pa.array(ids)),
                    ],
                    ["doc_id", "part", "start_in_part", "n_tokens", "ids"],
                )
                start += int(ends[-1]) if len(ends) else 0

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_bytes().alias("text"))
    return rows.repartitionByRange(partitions, "doc_id").sortWithinPartitions("doc_id").mapInArrow(encode, SCHEMA)


def write_tokens(
    docs: DataFrame,
    path: str,
    *,
    tokenizer: str = "word_bpe_49k.json",
    end_id: int = 1,
    partitions: int | None = None,
    row_group_bytes: int = 32 << 20,
    page_bytes: int = 256 << 10,
    page_rows: int = 2_000,
    codec: str = "zstd",
) -> None:
    """Encodes documents and writes the token files to a folder that all executors share."""
    spark = docs.sparkSession
    found = encode_sorted(docs, public_tokenizer(tokenizer), end_id, partitions or shuffle_partitions(spark))
    options = {
        "compression": codec,
        "parquet.writer.version": "v2",
        "parquet.block.size": row_group_bytes,
        "parquet.page.size": page_bytes,
        "parquet.page.row.count.limit": page_rows,
        "parquet.dictionary.page.size": 1 << 20,
        "parquet.enable.dictionary": "false",
        "parquet.enable.dictionary#ids.list.element": "true",
    }
    found.write.mode("overwrite").options(**{k: str(v) for k, v in options.items()}).parquet(path)


def read_tokens(spark: SparkSession, path: str, *, columns: tuple[str, ...] = ("doc_id", "start", "n_tokens", "ids")) -> DataFrame:
    """Documents of token files with `start`, the number of ids before each; only the asked columns are read.

    The offsets of the parts come from one row per part, so no task sees more than that.
    """
    rows = spark.read.schema(SCHEMA).parquet(path)
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = rows.groupBy("part").agg(F.sum("n_tokens").alias("part_tokens"))
    offsets = parts.select("part", F.coalesce(F.sum("part_tokens").over(before), F.lit(0)).alias("part_start"))
    placed = rows.join(offsets, "part").withColumn("start", F.col("part_start") + F.col("start_in_part"))
    return placed.select(*columns)


def digest_tokens(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 as read back from token files."""

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(3)
            flat, at = lists.values.to_numpy(zero_copy_only=False).astype("<u4"), lists.offsets.to_numpy()
            crc = [zlib.crc32(flat[a:b].tobytes()) for a, b in zip(at, at[1:])]
            sizes = pa.array(np.diff(at).astype(np.int64))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), batch.column(2), sizes, pa.array(crc, pa.int64())],
                ["doc_id", "part", "start_in_part", "n_tokens", "ids_crc32"],
            )

    rows = spark.read.schema(SCHEMA).parquet(path)
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = rows.groupBy("part").agg(F.sum("n_tokens").alias("part_tokens"))
    offsets = parts.select("part", F.coalesce(F.sum("part_tokens").over(before), F.lit(0)).alias("part_start"))
    read = rows.select("doc_id", "part", "start_in_part", "ids").mapInArrow(
        digest, "doc_id long, part int, start_in_part long, n_tokens long, ids_crc32 long"
    )
    return read.join(offsets, "part").select(
        "doc_id", (F.col("part_start") + F.col("start_in_part")).alias("start"), "n_tokens", "ids_crc32"
    )


def tokens_of(docs: DataFrame) -> DataFrame:
    """The whole operator: writes the files to the shared scratch folder and returns their digest."""
    scratch = Scratch(docs.sparkSession, "tokens")
    write_tokens(docs, scratch.path("files"))
    return digest_tokens(docs.sparkSession, scratch.path("files"))
