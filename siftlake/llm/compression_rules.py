"""Quality rules by compression bands: zstandard ratios of whole documents and of fixed chunks.

Text that compresses far too well repeats itself; text that hardly compresses is noise (encoded binaries, keys, random
letters). How well ordinary prose compresses depends on its length, so each length class has its own limits, and the
share of fixed-size chunks outside the chunk limits catches long texts that are bad only in part.

Besides the bands, each row has the counts of `BASE`: words, code points in words, symbols, repeated lines, words in
repeated windows.

Defined cases: null or empty text has no words, all counts 0, and fails the base rules; texts under the smallest class
get no verdict from the bands; ties and repeated rows are judged one by one; an empty table gives no rows; extra
columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WordHash, hash_words, in_slices, text_bytes, window_hashes, worker_words

#: Length classes by bytes (below), with the lowest and highest ratio of compressed to plain bytes.
BANDS = (
    (64, 0.0, 9.9),
    (128, 0.50, 1.40),
    (256, 0.42, 1.10),
    (512, 0.38, 0.97),
    (1024, 0.34, 0.88),
    (2048, 0.30, 0.80),
    (4096, 0.27, 0.74),
    (8192, 0.25, 0.70),
    (16384, 0.23, 0.67),
    (float("inf"), 0.20, 0.64),
)
SYMBOLS = tuple(bytes([c]) for c in b"#*$%&|<>")
SPACES = tuple(bytes([c]) for c in b" \t\n\r\x0b\x0c")
SCHEMA = (
    "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
    "n_bytes long, ratio double, n_chunks long, n_chunks_out long, lowest double, highest double"
)


@dataclass(frozen=True)
class Limits:
    bands: tuple = BANDS
    level: int = 3
    chunk_bytes: int = 1024
    least_chunk: int = 512  # a shorter tail is no chunk of its own
    chunk_low: float = 0.30
    chunk_high: float = 0.85
    chunk_share: float = 0.25
    window: int = 8


def repeated_words(words: list[bytes], cache: WordHash, width: int) -> int:
    """Words inside windows of `width` words that occur twice or more in the text."""
    if len(words) <= width:
        return 0
    h = window_hashes(hash_words(words, cache), width)
    order = np.sort(h)
    twice = order[1:][order[1:] == order[:-1]]
    if not len(twice):
        return 0
    found = np.flatnonzero(np.isin(h, twice))
    edge = np.zeros(len(words) + 1, np.int64)
    np.add.at(edge, found, 1)
    np.add.at(edge, found + width, -1)
    return int(np.count_nonzero(np.cumsum(edge)[:-1]))


def measure(docs: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """Rows of SCHEMA: counts and compression ratios of each document."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        squeeze, cache = zstandard.ZstdCompressor(level=limits.level).compress, worker_words()
        names = [x.split()[0] for x in SCHEMA.split(", ")]
        for batch in in_slices(batches):
            out: list[tuple] = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                words = text.split()
                n = len(text)
                points = n - sum(map(text.count, SPACES)) - int(np.count_nonzero((np.frombuffer(text, np.uint8) & 0xC0) == 0x80))
                lines = [x for x in text.split(b"\n") if x.strip()]
                ratio = len(squeeze(text)) / n if n else 1.0
                size = limits.chunk_bytes
                chunks = [text[i : i + size] for i in range(0, n, size) if n - i >= limits.least_chunk] if n > size else []
                parts = [len(squeeze(c)) / len(c) for c in chunks]
                low, high = next((lo, hi) for most, lo, hi in limits.bands if n < most)
                outside = sum(not limits.chunk_low <= r <= limits.chunk_high for r in parts)
                symbols = sum(map(text.count, SYMBOLS))
                repeats = repeated_words(words, cache, limits.window)
                out.append((doc_id, len(words), points, symbols, len(lines) - len(set(lines)), repeats, n, ratio, len(parts), outside, low, high))
            if out:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, pa.float64() if k in ("ratio", "lowest", "highest") else pa.int64()) for k, c in zip(names, zip(*out))], names
                )

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_bytes().alias("text")).mapInArrow(rows, SCHEMA)


def judge(measured: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """Adds base_failed, reason (the first that fails, or null) and kept."""
    base = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    reason = (
        F.when(F.col("ratio") < F.col("lowest"), "repetitive")
        .when(F.col("ratio") > F.col("highest"), "incompressible")
        .when(F.col("n_chunks_out") > limits.chunk_share * F.col("n_chunks"), "uneven")
    )
    out = measured.withColumn("base_failed", base).withColumn("reason", F.when(base, "base").otherwise(reason))
    return out.withColumn("kept", F.col("reason").isNull())


def compression_rules(docs: DataFrame, limits: Limits = Limits()) -> DataFrame:
    return judge(measure(docs, limits), limits)
