"""Fingerprints of artefacts and an exact index of vectors: cells around pivots, cut into rings and blocks of bounded size.

Vectors of one direction are one class, so copies cost nothing. Pivots are fitted on a bounded sample; every class is
indexed by its nearest pivot and its distance to it (a ring; thin rings that follow one another are one band). A query
first meets a few bands around itself, which bounds how far its partners can be; the triangle inequality then names the
rings that can hold a nearer one, and only blocks of their bands are met. No ring that could matter is left out, so the
result is that of all pairs."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..functions.batches import sliced
from ..sources.shared import SharedTables

#: Rings per unit of distance; unit vectors lie at most 2 apart.
RINGS = 64
#: Cosines are compared when rounded to six digits; what may round up to the bound is let in.
SLACK = 2e-6
#: Queries that meet a block at once; what that takes is a strip of cosines.
STRIP = 128
FOUND = pa.schema([("query", pa.int64()), ("rep", pa.int64()), ("cosine", pa.float64())])
PRINTABLE = np.array([32 <= b < 127 or b in (9, 10, 13) for b in range(256)])


def fingerprints(artefacts: DataFrame, id_col: str, data: str) -> DataFrame:
    """All columns but the data, with vector (square roots of the shares of the 256 bytes, of length one), entropy in bits
    a byte, printable and random (entropy over 7.5). Of whole contents; null and empty ones have no fingerprint."""
    kept = [c for c in artefacts.columns if c != data]

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            counts = np.zeros((batch.num_rows, 256))
            for i, value in enumerate(batch.column(data)):
                counts[i] = np.bincount(np.frombuffer(value.as_buffer(), np.uint8), minlength=256)
            share = counts / counts.sum(1, keepdims=True)
            bits = -(share * np.log2(np.where(share > 0, share, 1.0))).sum(1)
            vector = pa.ListArray.from_arrays(pa.array(np.arange(len(counts) + 1) * 256, pa.int32()), pa.array(np.sqrt(share).ravel()))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), vector, pa.array(bits), pa.array(share @ PRINTABLE)], [*kept, "vector", "entropy", "printable"])

    some = artefacts.where(F.octet_length(data) > 0).withColumn(data, F.col(data).cast("binary"))
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in artefacts.schema if f.name != data), "vector array<double>, entropy double, printable double"])
    return some.mapInArrow(measure, schema).withColumn("random", F.col("entropy") > 7.5)


def _units(df: DataFrame, id_col: str, vector: str) -> DataFrame:
    """id, unit. Rows without an id, and vectors that are null, zero or not finite, take no part."""

    def scale(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            x = _matrix(batch.column("v"))
            with np.errstate(over="ignore", invalid="ignore"):
                norm = np.sqrt((x * x).sum(1))
            use = (norm > 0) & np.isfinite(norm)
            unit = x[use] / norm[use][:, None]
            yield pa.RecordBatch.from_arrays([batch.column("id").filter(pa.array(use)), pa.FixedSizeListArray.from_arrays(pa.array(unit.ravel()), x.shape[1]).cast(pa.list_(pa.float64()))], ["id", "unit"])

    rows = df.select(F.col(id_col).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("v"))
    return rows.where("id is not null and size(v) > 0").mapInArrow(scale, "id long, unit array<double>")


def _matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return flat.flatten().to_numpy(zero_copy_only=False).reshape(len(flat), -1)


def fit_pivots(sample: np.ndarray, n: int, rounds: int = 8) -> np.ndarray:
    """Means of groups of the sample (k-means from evenly spread rows); any points would do for right results."""
    pivots = sample[np.linspace(0, len(sample) - 1, min(n, len(sample))).astype(int)]
    for _ in range(rounds):
        own = distances(sample, pivots).argmin(1)
        sums = np.zeros_like(pivots)
        np.add.at(sums, own, sample)
        size = np.bincount(own, minlength=len(pivots))[:, None]
        pivots = np.where(size > 0, sums / np.maximum(size, 1), pivots)
    return pivots


def distances(x: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(0.0, (x * x).sum(1)[:, None] + (pivots * pivots).sum(1)[None, :] - 2 * x @ pivots.T))


def first_rings(counts: np.ndarray, least: int) -> np.ndarray:
    """For each (pivot, ring) how many rings to either side hold `least` vectors of the pivot together."""
    n, total = counts.shape[1], np.cumsum(np.pad(counts, ((0, 0), (1, 0))), axis=1)
    wide = np.full(counts.shape, n)
    at = np.arange(n)
    for w in range(n - 1, -1, -1):
        inside = total[:, np.minimum(n, at + w + 1)] - total[:, np.maximum(0, at - w)]
        wide[inside >= least] = w
    return wide


def bands(counts: np.ndarray, block: int) -> np.ndarray:
    """Where bands begin, in the row of all rings of all pivots: rings of a pivot that follow one another are one band until
    it holds a block."""
    starts = []
    for p, row in enumerate(counts):
        held = block
        for r, n in enumerate(row):
            if held >= block or r == 0:
                starts.append(p * len(row) + r)
                held = 0
            held += n
    return np.array(starts)


def reachable(d: np.ndarray, radius: np.ndarray) -> np.ndarray:
    """(query, pivot, ring): whether a vector of the ring can lie within the radius of the query. d: distances of queries
    to pivots."""
    low = np.arange(2 * RINGS + 2) / RINGS
    bound = np.maximum(d[:, :, None] - (low + 1 / RINGS), low - d[:, :, None])
    # a vector of a cell is nearer to that pivot than to the query's own
    bound = np.maximum(bound, (d - d.min(1, keepdims=True))[:, :, None] / 2)
    return bound <= radius[:, None, None] + 1e-9


def _pairs(left: pa.Table, right: pa.Table, k: int) -> pa.Table:
    """The k best of a block for each query of a block."""
    if not left.num_rows or not right.num_rows:
        return FOUND.empty_table()
    query, rep, y = left.column("id").to_numpy(), right.column("rep").to_numpy(), _matrix(right.column("unit"))
    found = []
    for i in range(0, left.num_rows, STRIP):
        cosine = _matrix(left.column("unit").slice(i, STRIP)) @ y.T
        np.round(cosine, 6, out=cosine)
        few = min(k, cosine.shape[1])
        # only what is as near as the k-th is put in order, ties included
        least = np.partition(cosine, cosine.shape[1] - few, axis=1)[:, cosine.shape[1] - few]
        row, at = np.nonzero(cosine >= least[:, None])
        near = cosine[row, at]
        order = np.lexsort((rep[at], -near, row))
        row, at, near = row[order], at[order], near[order]
        begin = np.searchsorted(row, np.arange(len(cosine)))
        best = np.arange(len(row)) - begin[row] < few
        found.append(pa.table([query[i + row[best]], rep[at[best]], near[best]], schema=FOUND))
    return pa.concat_tables(found)


def _meet(routed: DataFrame, index: DataFrame, parts: int, k: int) -> DataFrame:
    """query, rep, cosine, place: the k best of the blocks that each query is sent to."""
    keys = ["band", "block"]
    sent = routed.withColumn("part", F.pmod(F.xxhash64("id"), F.lit(parts)))
    wanted = sent.select(*keys, F.col("part").alias("of")).distinct()
    asked = index.join(wanted, keys).select(*(F.col(c).alias(f"{c}_") for c in keys), "of", "rep", "unit")
    both = sent.groupBy(*keys, "part").cogroup(asked.groupBy("band_", "block_", "of"))
    found = both.applyInArrow(lambda left, right: _pairs(left, right, k), "query long, rep long, cosine double")
    place = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("cosine"), "rep"))
    return found.withColumn("place", place).where(F.col("place") <= k)


def nearest(vectors: DataFrame, queries: DataFrame, *, k: int, block: int = 2048, pivots: int = 64, sample: int = 4096, id_col: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """The k vectors of highest cosine to each query, ties by smaller id, itself excepted: (query_id, vec_id, cosine, rank).
    Ids are unique, vectors of equal length; see _units for those that take no part. At most `sample` vectors come to the
    driver, and one count for each (pivot, ring)."""
    spark, more = vectors.sparkSession, k + 1
    save = lambda df, name: SharedTables(spark, name).save(df)
    members, asking = save(_units(vectors, id_col, vector), "units"), _units(queries, id_col, vector)
    reps = save(members.groupBy("unit").agg(F.min("id").alias("rep")), "classes")
    # a cell holds a block at least, on average
    pivots = min(pivots, 1 + reps.count() // block)
    picked = reps.orderBy(F.xxhash64("rep"), "rep").limit(sample).select("unit").toArrow()
    if not picked.num_rows:
        return asking.select(F.col("id").alias("query_id"), F.col("id").alias("vec_id"), F.lit(0.0).alias("cosine"), F.lit(0).cast("long").alias("rank")).where(F.lit(False))
    centres = fit_pivots(_matrix(picked.column("unit")), pivots)

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            d = distances(_matrix(batch.column("unit")), centres)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(d.argmin(1), pa.int32()), pa.array((d.min(1) * RINGS).astype(np.int32))], ["rep", "unit", "pivot", "ring"])

    placed = save(reps.select("rep", "unit").mapInArrow(near, "rep long, unit array<double>, pivot int, ring int"), "cells")
    counts = np.zeros((len(centres), 2 * RINGS + 2), np.int64)
    for row in placed.groupBy("pivot", "ring").agg(F.count(F.lit(1)).alias("n")).collect():  # pivots times rings at most
        counts[row["pivot"], row["ring"]] = row["n"]
    starts, wide = bands(counts, block), first_rings(counts, more)
    blocks = -(-np.add.reduceat(counts.ravel(), starts) // block)
    band = np.searchsorted(starts, np.arange(counts.size), side="right") - 1
    plan = [(int(p), int(r), int(g), int(blocks[g])) for p, r in np.argwhere(counts) for g in [band[p * counts.shape[1] + r]]]
    plan = spark.createDataFrame(plan, "pivot int, ring int, band int, blocks int")
    index = placed.join(F.broadcast(plan), ["pivot", "ring"])  # pivots times rings at most
    index = index.select("band", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int").alias("block"), "rep", "unit")

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in (whole.slice(i, 64) for i in range(0, whole.num_rows, 64)):
                d = distances(_matrix(batch.column("unit")), centres)
                bound = batch.column("bound").to_numpy(zero_copy_only=False).astype(float)
                own, home = d.argmin(1), (d.min(1) * RINGS).astype(int)
                off = np.abs(np.arange(counts.shape[1])[None, :] - home[:, None])
                first = np.zeros((len(d), *counts.shape), bool)
                first[np.arange(len(d)), own] = off <= wide[own, home][:, None]
                # without a bound: one block of each band around the query (-2), or all of all bands (null)
                open_ = np.where(np.isnan(bound), 2.0, np.sqrt(np.maximum(0.0, 2 - 2 * np.where(np.isnan(bound), 1, bound) + SLACK)))
                to = np.where((bound == -2)[:, None, None], first, reachable(d, open_)) & (counts > 0)
                at, to_band = np.nonzero(np.logical_or.reduceat(to.reshape(len(d), -1), starts, axis=1))
                many = np.where(bound[at] == -2, 1, blocks[to_band])
                row = np.repeat(np.arange(len(at)), many)
                number = np.arange(len(row)) - np.repeat(np.cumsum(many) - many, many)
                for i in range(0, len(row), 2048):
                    r = row[i : i + 2048]
                    rows = batch.select(["id", "unit"]).take(pa.array(at[r]))
                    yield pa.RecordBatch.from_arrays([*rows.columns, pa.array(to_band[r], pa.int32()), pa.array(number[i : i + 2048], pa.int32())], ["id", "unit", "band", "block"])

    schema = "id long, unit array<double>, band int, block int"
    asked = save(asking.groupBy("unit").agg(F.min("id").alias("id")), "queries")
    parts = max(1, -(-asked.count() // block))
    early = _meet(asked.withColumn("bound", F.lit(-2.0)).select("id", "unit", "bound").mapInArrow(route, schema), index, parts, more)
    bounds = early.where(F.col("place") == more).select(F.col("query").alias("id"), F.col("cosine").alias("bound"))
    bounded = save(asked.join(bounds, "id", "left").select("id", "unit", "bound"), "bounds")
    met = _meet(bounded.mapInArrow(route, schema), index, parts, more)

    # the k + 1 smallest ids of a class are all of it that can be among k partners
    w = Window.partitionBy("unit").orderBy("id")
    few = members.withColumn("i", F.row_number().over(w)).where(F.col("i") <= more).join(reps, "unit").select("rep", F.col("id").alias("vec_id"))
    order = Window.partitionBy("query").orderBy(F.desc("cosine"), "vec_id")
    best = met.join(few, "rep").withColumn("i", F.row_number().over(order)).where(F.col("i") <= more).select("query", "vec_id", "cosine")
    who = asking.join(asked.withColumnRenamed("id", "query"), "unit").select(F.col("id").alias("query_id"), "query")
    each = who.join(best, "query").where("query_id <> vec_id")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("cosine"), "vec_id")).cast("long")
    return each.select("query_id", "vec_id", "cosine", rank.alias("rank")).where(F.col("rank") <= k)


def similar(prints: DataFrame, queries: DataFrame, *, k: int, id_col: str, family: str) -> DataFrame:
    """query_id, vec_id, cosine, rank, entropy_gap, label: the k most similar artefacts of each query by fingerprint, with
    what that is worth: equal families and near entropies make it strong, two random contents weak."""
    found = nearest(prints, queries, k=k, id_col=id_col, vector="vector")
    facts = lambda key, tag: prints.select(F.col(id_col).alias(key), F.col("entropy").alias(f"entropy_{tag}"), F.col("random").alias(f"random_{tag}"), F.col(family).alias(f"family_{tag}"))
    both = found.join(facts("query_id", "a"), "query_id").join(facts("vec_id", "b"), "vec_id")
    gap = F.round(F.abs(F.col("entropy_a") - F.col("entropy_b")), 6)
    label = S.dna_label(F.col("cosine"), gap, F.col("family_a").eqNullSafe(F.col("family_b")), F.col("random_a") & F.col("random_b"))
    return both.select("query_id", "vec_id", "cosine", "rank", gap.alias("entropy_gap"), label.alias("label"))


def structural_hint(a: Column, b: Column) -> Column:
    """What in the structure of two fragments (structs with objects, members, ts_first, ts_last) says that the second goes
    on where the first ends, or null: 'objects', 'members' or 'times'."""
    gap = F.array_min(b["objects"]) - F.array_max(a["objects"])
    same_day = F.substring(a["ts_last"], 1, 10) == F.substring(b["ts_first"], 1, 10)
    return (
        F.when((gap > 0) & (gap <= 3), "objects")
        .when(F.arrays_overlap(a["members"], b["members"]), "members")
        .when((a["ts_last"] <= b["ts_first"]) & same_day, "times")
    )
