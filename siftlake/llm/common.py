"""Pieces shared by the corpus operators: scratch tables, words, hashes."""

from __future__ import annotations

import atexit
import gc
import os
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words are runs of anything but ASCII white space; bytes.split() splits at exactly these six bytes.
WORD_RE = r"[^\x20\x09-\x0D]+"


def scratch_root(spark: SparkSession) -> str:
    """The shared folder of spark.checkpoint.dir. Where that is unset, a folder of this machine if it is all there is
    (local mode, as in tests), else an error: executors elsewhere would not see it."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        found = spark.sparkContext._jsc.sc().getCheckpointDir()
        root = found.get() if found.isDefined() else None
    if not root:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="siftlake-")
        spark.sparkContext.setCheckpointDir(root)
    return root.rstrip("/")


class Scratch:
    """Tables written to the shared folder, so that lost executors do not lose them. Dropped one by one or at exit."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{scratch_root(spark)}/{name}-{uuid.uuid4().hex}"
        atexit.register(self.drop)

    def path(self, table: str) -> str:
        return f"{self.root}/{table}"

    def save(self, df: DataFrame, table: str, *, sweep: bool = False, **options: str) -> DataFrame:
        """Writes a table and reads it back. sweep: lets Spark delete the shuffle files of steps that are done, which
        it does only once the driver has collected their plans as garbage."""
        path, schema = self.path(table), df.schema
        df.write.mode("overwrite").options(**options).parquet(path)
        if sweep:
            del df
            gc.collect()
            self.spark.sparkContext._jvm.System.gc()
        return self.spark.read.schema(schema).parquet(path)

    def drop(self, table: str = "") -> None:
        """Removes a table, or everything."""
        try:
            context = self.spark.sparkContext
            if context._jsc is None:
                return
            path = context._jvm.org.apache.hadoop.fs.Path(self.path(table) if table else self.root)
            path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True)
        except Exception:  # noqa: BLE001 - the session may be gone when the interpreter ends
            return


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_bytes(column: str = "text") -> Column:
    """UTF-8 bytes of a text column; null becomes empty."""
    return F.coalesce(F.col(column).cast("binary"), F.lit(b""))


def free_name(name: str, taken: list[str]) -> str:
    """The name, with underscores before it until no column has it, in any case."""
    used = {c.lower() for c in taken}
    while name.lower() in used:
        name = f"_{name}"
    return name


def in_slices(batches: Iterator[pa.RecordBatch], rows: int = 1_000) -> Iterator[pa.RecordBatch]:
    """The batches in parts of some rows, without copies, so that what is made of a part stays small."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


class WordHash(dict):
    """64-bit hashes of words, remembered; forgets everything when it has grown too large."""

    LIMIT = 300_000

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.LIMIT:
            self.clear()
        self[word] = value = xxhash.xxh3_64_intdigest(word)
        return value


_WORDS = WordHash()
_REMEMBERED: dict[str, Callable[[], None]] = {"words": _WORDS.clear}
_SERVED = [""]


def remembers(kind: str, forget: Callable[[], None]) -> None:
    """Names something that Python workers remember from task to task, and how to forget it."""
    _REMEMBERED[kind] = forget


def serve(kind: str) -> None:
    """Called by tasks: a worker that turns to another operator forgets what only the former one needs, so the memories
    of a pipeline's stages do not add up."""
    if _SERVED[0] != kind:
        _SERVED[0] = kind
        for other, forget in _REMEMBERED.items():
            if other != kind:
                forget()


def worker_words() -> WordHash:
    """The hashes that this Python worker remembers from task to task."""
    serve("words")
    return _WORDS


def hash_words(words: list[bytes], cache: WordHash) -> np.ndarray:
    return np.fromiter(map(cache.__getitem__, words), np.uint64, len(words))


_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mix64(x: np.ndarray) -> np.ndarray:
    """Finaliser with full avalanche, of the public SplitMix64 generator."""
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


_BASE = 0x9E3779B97F4A7C15
_POWERS: list[np.ndarray] = []


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2^64, remembered."""
    if not _POWERS or len(_POWERS[0]) < n:
        steps = np.ones((2, max(n, 1024)), np.uint64)
        steps[0, 1:], steps[1, 1:] = _BASE, pow(_BASE, -1, 1 << 64)
        _POWERS[:] = np.multiply.accumulate(steps, axis=1)
    return _POWERS[0][:n], _POWERS[1][:n]


def window_hashes(h: np.ndarray, width: int) -> np.ndarray:
    """Hash of each run of `width` word hashes, a polynomial in the base; empty when there are fewer. All runs come from
    one running sum: the base is odd, so it has an inverse."""
    n = len(h) - width + 1
    if n <= 0 or width < 1:
        return np.empty(0, np.uint64)
    up, down = _powers(len(h))
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(h * down)])
    return mix64((sums[width:] - sums[:n]) * up[width - 1 :])


def crc_fold(doc_id: Column, modulus: int) -> Column:
    """crc32 of the id written as text, modulo a number; null ids count as empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % modulus


def public_tokenizer(name: str) -> str:
    import public_tokenizers

    return os.fspath(public_tokenizers.path(name))
