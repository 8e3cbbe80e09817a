"""Near-duplicate documents by HyperMinHash.

Each document is the set of its word shingles. A sketch has `bands` groups of four buckets: a band hashes all shingles,
two bits choose the bucket, and the bucket's register keeps the least of the other 62 bits in short, as the number of
its leading zeros (6 bits) and the 10 mantissa bits after them. Four registers of 16 bits are one 64-bit band key, so
the compressed registers themselves are what is banded. The number of bands is set so that a pair at the threshold
shares no key with a chance of 1e-7.

1. Documents with equal sets become one class, whose representative is its smallest doc_id.
2. In each bucket (band, key) every class is paired with the smallest one there, the hub. Pairs whose estimated Jaccard
   index, corrected for chance collisions of short registers, is more than six standard errors under the threshold go.
   Each class checks its best hub on the full sets.
3. Linked classes form components (alternating large-star and small-star steps).
4. Buckets that still hold several components have candidates nobody checked. Their classes are joined by prefix
   filtering, which is exact: with one order of all shingles, two sets that reach the threshold share a shingle early in
   both. The order puts shingles found in one component only first, then rare ones, so copies with many edits of their
   own have no shared shingle early enough, and a group of thousands of near copies yields few pairs. Classes of one
   component are never paired. Verified links are added and the components taken again.

No step emits all pairs of a group; per key there is one row per class, and copies cost one row each.

Defined cases: null text, or text without words, has an empty set and is linked with nothing; fewer words than a
shingle make one shingle of all words; a very long text is one row's work; of pairs with equal estimates the smaller hub
is checked; a null doc_id is linked with nothing and kept; rows that repeat a doc_id are one
document and stay or go together; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, WordHash, hash_words, in_slices, mix64, text_bytes, window_hashes, worker_words

BUCKETS = 4
MANTISSA = 10
EMPTY = 0xFFFF
#: The constant of the collision estimate in the HyperMinHash paper (Yu and Weber).
COLLISION = 0.169919487159739093975315012348630288992889
_TOP = np.uint64(1 << 62)


def bands_for(threshold: float, miss: float = 1e-7) -> int:
    return math.ceil(math.log(miss) / math.log(1 - threshold**BUCKETS))


def shingles(text: bytes, size: int, cache: WordHash) -> np.ndarray:
    """Distinct shingle hashes, sorted. bytes.lower() changes A-Z only."""
    h = hash_words(text.lower().split(), cache)
    return np.unique(window_hashes(h, min(size, len(h)))) if len(h) else np.empty(0, np.uint64)


def least_by_bucket(found: np.ndarray, factors: np.ndarray, chunk: int = 8192) -> np.ndarray:
    """For each band and bucket the least 62-bit hash; 2^62 or more where the bucket is empty."""
    out = np.full((len(factors), BUCKETS), np.iinfo(np.uint64).max, np.uint64)
    for a in range(0, len(found), chunk):
        y = factors[:, None] * found[None, a : a + chunk]
        y ^= y >> np.uint64(29)
        y *= np.uint64(0xBF58476D1CE4E5B9)
        y ^= y >> np.uint64(32)
        for k in range(BUCKETS):
            # Hashes of bucket k fall below 2^62, all others come out above.
            np.minimum(out[:, k], (y - np.uint64(k << 62)).min(axis=1), out=out[:, k])
    return out


def registers(least: np.ndarray) -> np.ndarray:
    """Leading zeros and mantissa bits of the least hashes, four to a 64-bit key."""
    value, power = np.frexp(np.minimum(least, _TOP).astype(np.float64))
    zeros = np.clip(62 - power, 0, 62)
    bits = np.clip((value * 2 - 1) * (1 << MANTISSA), 0, (1 << MANTISSA) - 1).astype(np.int64)
    short = np.where(least >= _TOP, EMPTY, zeros.astype(np.int64) << MANTISSA | bits).astype("<u2")
    return np.ascontiguousarray(short).view("<i8").reshape(least.shape[:-1])


def factors_of(bands: int) -> np.ndarray:
    return mix64(np.arange(1, bands + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)


def sketches(docs: DataFrame, size: int, bands: int) -> DataFrame:
    """doc_id, n (size of the set), a 128-bit fingerprint of the set, and the band keys (none for empty sets)."""
    names = ["doc_id", "n", "fa", "fb", "keys"]

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache, factors = worker_words(), factors_of(bands)
        for batch in in_slices(batches):
            sets = [shingles(t, size, cache) for t in batch.column(1).to_pylist()]
            n = np.array(list(map(len, sets)), np.int64)
            fa = np.array([s.sum(dtype=np.uint64) for s in sets], np.uint64).view(np.int64)
            fb = np.array([mix64(s ^ _TOP).sum(dtype=np.uint64) for s in sets], np.uint64).view(np.int64)
            full = [least_by_bucket(s, factors) for s in sets if len(s)]
            keys = registers(np.stack(full)).reshape(-1) if full else np.empty(0, np.int64)
            ends = np.concatenate([[0], np.cumsum(np.where(n > 0, bands, 0))]).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n), pa.array(fa), pa.array(fb), pa.ListArray.from_arrays(pa.array(ends), pa.array(keys))], names
            )

    chosen = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_bytes().alias("text"))
    return chosen.mapInArrow(rows, "doc_id long, n long, fa long, fb long, keys array<long>")


def estimate(a: Column, b: Column, n: Column, m: Column) -> tuple[Column, Column]:
    """Jaccard estimate from two arrays of band keys, and how many registers it rests on."""

    def lanes(x: Column, y: Column) -> Column:
        total = F.lit(0)
        for k in range(BUCKETS):
            p, q = (F.shiftrightunsigned(v, 16 * k).bitwiseAND(F.lit(EMPTY)) for v in (x, y))
            total = total + F.when((p == EMPTY) & (q == EMPTY), 0).otherwise(1000 + (p == q).cast("int"))
        return total

    packed = F.aggregate(F.zip_with(a, b, lanes), F.lit(0), lambda s, v: s + v)
    count, same = F.floor(packed / 1000).cast("double"), (packed % 1000).cast("double")
    ratio = n / m
    chance = count * COLLISION * 2.0**-MANTISSA * 4 * ratio / ((1 + ratio) * (1 + ratio))
    return (same - chance) / count, count


def components(edges: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """(id, component): the smallest id of its component for each id in edges (a, b)."""

    def pulled(e: DataFrame) -> DataFrame:
        return e.groupBy("u").agg(F.min("v").alias("m"))

    def state(e: DataFrame) -> tuple:
        return tuple(e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first())

    e = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct()
    e, before, turn = scratch.save(e, f"{name}0"), None, 0
    while (now := state(e)) != before:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = both.join(pulled(both), "u").where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.least("u", "m").alias("v")).distinct()
        met = large.join(pulled(large), "u")
        small = met.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(met.select("u", F.col("m").alias("v")))
        turn, before = turn + 1, now
        e = scratch.save(small.where("u <> v").distinct(), f"{name}{turn}")
        scratch.drop(f"{name}{turn - 1}")
    roots = e.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct()
    return e.select(F.col("u").alias("id"), F.col("v").alias("component")).unionByName(roots)


class NearDuplicates:
    """One run over one table; `num` / `den` is the least Jaccard index of a link."""

    def __init__(self, docs: DataFrame, *, size: int = 5, num: int = 80, den: int = 100):
        self.docs, self.size, self.num, self.den = docs, size, num, den
        self.bands = bands_for(num / den)
        self.scratch = Scratch(docs.sparkSession, "near")

    def verified(self, pairs: DataFrame, sets: DataFrame) -> DataFrame:
        """The pairs (a, b) whose full sets reach the threshold."""
        num, den = self.num, self.den

        def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in in_slices(batches):
                keep = []
                for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist()):
                    p, q = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                    both = len(np.intersect1d(p, q, assume_unique=True))
                    keep.append(den * both >= num * (len(p) + len(q) - both))
                yield pa.RecordBatch.from_arrays(batch.columns[:2], ["a", "b"]).filter(pa.array(keep, pa.bool_()))

        x, y = sets.select(F.col("id").alias("a"), F.col("data").alias("x")), sets.select(F.col("id").alias("b"), F.col("data").alias("y"))
        return pairs.select("a", "b").join(x, "a").join(y, "b").select("a", "b", "x", "y").mapInArrow(rows, "a long, b long")

    def full_sets(self, ids: DataFrame) -> DataFrame:
        """id and the packed shingle set of the given classes."""
        size = self.size

        def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            cache = worker_words()
            for batch in in_slices(batches):
                data = [shingles(t, size, cache).tobytes() for t in batch.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(data, pa.binary())], ["id", "data"])

        docs = self.docs.select(F.col("doc_id").cast("long").alias("id"), text_bytes().alias("text"))
        rows_of = docs.join(ids.select("id"), "id", "left_semi").mapInArrow(rows, "id long, data binary")
        return rows_of.dropDuplicates(["id"])

    def late_pairs(self, mixed: DataFrame, sets: DataFrame) -> DataFrame:
        """Pairs of classes (id, component, n) of different components that prefix filtering leaves."""

        def explode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in in_slices(batches):
                parts = [np.frombuffer(x, np.int64) for x in batch.column(1).to_pylist()]
                ends = np.concatenate([[0], np.cumsum(list(map(len, parts)))]).astype(np.int32)
                flat = np.concatenate(parts) if parts else np.empty(0, np.int64)
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))], ["id", "tokens"])

        num, den = self.num, self.den
        tokens = sets.join(mixed.select("id"), "id", "left_semi").mapInArrow(explode, "id long, tokens array<long>")
        tokens = tokens.join(mixed, "id").select("id", "component", "n", F.explode("tokens").alias("token"))
        seen = tokens.groupBy("token").agg(F.count(F.lit(1)).alias("df"), F.min("component").alias("lo"), F.max("component").alias("hi"))
        shared = tokens.join(seen.where("lo < hi").select("token", "df"), "token")
        # An array per class, sorted by (df, token): positions follow those of the shingles found in one component only.
        by_id = shared.groupBy("id", "component", "n").agg(F.array_sort(F.collect_list(F.struct("df", "token"))).alias("t"))
        by_id = by_id.withColumn("alone", F.col("n") - F.size("t"))
        reach = F.col("n") - F.ceil(F.col("n") * num / den) + 1 - F.col("alone")
        by_id = by_id.withColumn("t", F.slice("t", F.lit(1), F.greatest(reach, F.lit(0)).cast("int")))
        prefix = by_id.select("id", "component", "n", "alone", F.posexplode("t").alias("i", "t"))
        prefix = prefix.select("id", "component", "n", (F.col("alone") + F.col("i") + 1).alias("pos"), F.col("t.token").alias("token"))
        prefix = self.scratch.save(prefix, "prefix")
        # Of a pair, the smaller set has a shared shingle earlier still: its partner is no smaller, so more must be equal.
        # Sets whose own shingles fill that much have none to offer, and a template's common shingles meet nothing.
        short = F.col("pos") <= F.col("n") - F.ceil(F.col("n") * 2 * num / (num + den)) + 1
        x = prefix.select("token", *[F.col(c).alias(f"{c}_a") for c in ("id", "component", "n", "pos")])
        y = prefix.where(short).select("token", *[F.col(c).alias(f"{c}_b") for c in ("id", "component", "n", "pos")])
        need = F.ceil((F.col("n_a") + F.col("n_b")) * num / (num + den))
        larger = (F.col("n_a") > F.col("n_b")) | (F.col("n_a") == F.col("n_b")) & (F.col("id_a") < F.col("id_b"))
        sizes = larger & (den * F.col("n_b") >= num * F.col("n_a"))
        early = (F.col("pos_a") <= F.col("n_a") - need + 1) & (F.col("pos_b") <= F.col("n_b") - need + 1)
        met = x.join(y, (x["token"] == y["token"]) & (F.col("component_a") != F.col("component_b")) & sizes & early)
        return met.select(F.col("id_a").alias("a"), F.col("id_b").alias("b")).distinct()

    def run(self) -> DataFrame:
        """doc_id, n_shingles, component_id (smallest doc_id reachable) and kept, for every row."""
        s, t = self.scratch, self.num / self.den
        docs = s.save(sketches(self.docs, self.size, self.bands), "docs")
        real = docs.where("n > 0 and doc_id is not null")
        classes = s.save(real.groupBy("n", "fa", "fb").agg(F.min("doc_id").alias("id"), F.first("keys").alias("keys")), "classes")
        keyed = classes.select("id", F.posexplode("keys").alias("band", "key"))
        groups = keyed.groupBy("band", "key").agg(F.min("id").alias("hub"), F.count(F.lit(1)).alias("k")).where("k > 1")
        met = s.save(keyed.join(groups.select("band", "key", "hub"), ["band", "key"]), "met")
        sets = s.save(self.full_sets(met.select("id").distinct()), "sets")

        pairs = met.where("id <> hub").select("id", "hub").distinct()
        sketch = lambda x, n, k: classes.select(F.col("id").alias(x), F.col("n").alias(n), F.col("keys").alias(k))
        met_pairs = pairs.join(sketch("id", "n", "ka"), "id").join(sketch("hub", "m", "kb"), "hub")
        guess, count = estimate(F.col("ka"), F.col("kb"), F.col("n"), F.col("m"))
        met_pairs = met_pairs.select("id", "hub", guess.alias("guess"), count.alias("count"))
        likely = met_pairs.where(F.col("guess") >= t - 6 * F.sqrt(t * (1 - t) / F.col("count")))
        best = likely.groupBy("id").agg(F.max(F.struct("guess", (-F.col("hub")).alias("h"))).alias("best"))
        links = s.save(self.verified(best.select(F.col("id").alias("a"), (-F.col("best.h")).alias("b")), sets), "links")
        parts = components(links, s, "parts")

        labelled = met.join(parts, "id", "left").withColumn("component", F.coalesce("component", "id"))
        buckets = labelled.groupBy("band", "key").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo < hi")
        mixed = labelled.join(buckets.select("band", "key"), ["band", "key"], "left_semi").select("id", "component").distinct()
        mixed = s.save(mixed.join(classes.select("id", "n"), "id"), "mixed")
        late = self.verified(self.late_pairs(mixed, sets), sets)
        links = s.save(links.unionByName(late), "all_links")
        for table in ("sets", "met", "prefix"):
            s.drop(table)
        parts = components(links, s, "whole")
        ends = classes.select("n", "fa", "fb", "id").join(parts, "id", "left").select("n", "fa", "fb", F.coalesce("component", "id").alias("component"))
        out = docs.select("doc_id", "n", "fa", "fb").join(ends, ["n", "fa", "fb"], "left")
        found = F.when(F.col("n") > 0, F.col("component")).otherwise(F.col("doc_id"))
        component = F.when(F.col("doc_id").isNotNull(), found)
        return out.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))


def near_duplicates(docs: DataFrame, *, size: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    return NearDuplicates(docs, size=size, num=num, den=den).run()


def keep_one(docs: DataFrame, *, size: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """The documents without all but the smallest doc_id of each group of near duplicates; columns as given."""
    gone = near_duplicates(docs, size=size, num=num, den=den).where("not kept").select("doc_id").distinct()
    return docs.join(gone, docs["doc_id"].cast("long") == gone["doc_id"], "left_anti")
