"""Hard-negative mining: for each anchor its best rows of the same label, and for each of those the best rows of other labels
whose score lies in a band below it.

Scores are inner products of integer vectors. An orthogonal rotation, the principal axes of all vectors, moves most of a
product into its first components: leading components are multiplied first, the rest is bounded by the product of the
residual norms plus a slack for rounding, and pairs that can't reach what an anchor has already are discarded early. The
survivors are verified with integer products, so results are exact whatever the rotation.

Vectors are met in blocks: chunks of all rows against blocks of anchors, joined on a group number that each chunk has
once and each block in every group; a task multiplies one chunk by one block at a time and keeps a few rows per anchor.
Anchors meet one another first: the k-th best score among them is a bound that nearly all other rows stay below, so a
chunk returns few rows. Labels are never a key, so a hot label is no hot task; no row of the table goes to the driver but
the sums of products of components, one number for each pair of dimensions.

Defined cases: rows with a null vec_id, label or vector, or a component that is null or not finite, take no part; vectors
of different lengths are filled up with zeros; an empty vector has score 0 with every row; ties go to the smaller vec_id;
rows that repeat a vec_id count one by one as positives and negatives, "other" means another vec_id, and as an anchor the
least of them by label and vector is taken; scores beyond 64 bits become the nearest 64-bit number; an empty table gives
no rows; extra columns are ignored, whatever their names; an anchor without positives, and a positive without negatives,
give no row.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import Scratch, mix64, shuffle_partitions

CHUNK = "part int, ids binary, labels binary, vectors binary, width int"
BLOCK = "ids binary, labels binary, vectors binary, width int, low binary, high binary"
FOUND = "anchor_id long, slot int, vec_id long, score long"
#: Scaled components up to this size have products that fit into 64-bit integers for any width up to 2^14.
NARROW = 1 << 24


@dataclass(frozen=True)
class Mining:
    """positives and negatives: how many; band: least and most percentage of the positive's score that a negative may
    have; chunk_rows by block_rows: the largest matrix a task holds."""

    positives: int = 5
    negatives: int = 10
    band: tuple[int, int] = (30, 90)
    scale: int = 256
    chunk_rows: int = 4096
    block_rows: int = 1024
    stages: tuple[float, ...] = (0.25, 0.5, 1.0)
    dense: float = 0.02  # share of pairs left below which the rest goes straight to verification


def scaled(vectors: list | pa.ListArray, scale: int) -> tuple[np.ndarray, np.ndarray]:
    """Integer vectors, filled up with zeros, as floats that hold integers; and which rows take part."""
    lengths = np.diff(vectors.offsets.to_numpy())
    flat = vectors.flatten()
    width = int(lengths.max(initial=0))
    values = np.asarray(flat.cast(pa.float64()).fill_null(np.nan).to_numpy(zero_copy_only=False), float)
    rows = np.repeat(np.arange(len(lengths)), lengths)
    ok = np.ones(len(lengths), bool)
    ok[rows[~np.isfinite(values)]] = False
    out = np.zeros((len(lengths), width))
    starts = np.repeat(np.cumsum(lengths) - lengths, lengths)
    with np.errstate(invalid="ignore", over="ignore"):
        out[rows, np.arange(len(values)) - starts] = np.floor(scale * values)
    return out[ok], ok


def prepared(rows: DataFrame, label: Column) -> DataFrame:
    """vec_id, label, embedding of the rows that may take part. label: the label that counts."""
    picked = rows.select(F.col("vec_id").cast("long").alias("vec_id"), label.cast("long").alias("label"), F.col("embedding").cast("array<double>").alias("embedding"))
    return picked.where("vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL")


def chunks(rows: DataFrame, config: Mining, groups: int) -> DataFrame:
    """Rows of CHUNK: up to chunk_rows integer vectors in one row; `part` spreads chunks over the groups."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, config.chunk_rows):
                piece = batch.slice(at, config.chunk_rows)
                x, ok = scaled(piece.column("embedding"), config.scale)
                if not len(x):
                    continue
                ids = piece.column("vec_id").to_numpy(zero_copy_only=False)[ok]
                labels = piece.column("label").to_numpy(zero_copy_only=False)[ok]
                part = int(mix64(ids[:1].astype(np.uint64))[0]) % groups
                fields = (part, ids.astype("<i8").tobytes(), labels.astype("<i8").tobytes(), stored(x), x.shape[1])
                kinds = (pa.int32(), pa.binary(), pa.binary(), pa.binary(), pa.int32())
                yield pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(fields, kinds)], [f.split()[0] for f in CHUNK.split(", ")])

    return rows.select("vec_id", "label", "embedding").mapInArrow(pack, CHUNK)


def stored(x: np.ndarray) -> bytes:
    """32-bit integers where they hold every component, else doubles."""
    return x.astype("<i4" if np.abs(x).max(initial=0) < 1 << 31 else "<f8").tobytes()


def loaded(data: bytes, rows: int, width: int) -> np.ndarray:
    kind = "<i4" if len(data) == 4 * rows * width else "<f8"
    return np.frombuffer(data, kind).reshape(rows, width).astype(float)


def widened(x: np.ndarray, width: int) -> np.ndarray:
    return x if x.shape[1] == width else np.concatenate([x, np.zeros((len(x), width - x.shape[1]))], 1)


def principal_axes(packed: DataFrame) -> np.ndarray:
    """The principal axes of all vectors, leading ones first, as columns. Sums of products of components come from every
    chunk; the driver gets one number for each pair of dimensions."""

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((0, 0))
        for batch in batches:
            for n, data, width in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                x = loaded(data, n, width)
                if width > len(total):
                    total = np.pad(total, (0, width - len(total)))
                with np.errstate(over="ignore"):
                    total[:width, :width] += np.nan_to_num(x.T @ x)
        i, j = np.triu_indices(len(total))
        yield pa.RecordBatch.from_arrays([pa.array(i), pa.array(j), pa.array(total[i, j])], ["i", "j", "v"])

    rows = packed.select((F.length("ids") / 8).cast("long").alias("n"), "vectors", "width").mapInArrow(sums, "i long, j long, v double")
    found = rows.groupBy("i", "j").agg(F.sum("v").alias("v")).toPandas()
    width = int(found["j"].max()) + 1 if len(found) else 0
    if not width:
        return np.zeros((0, 0))
    moment = np.zeros((width, width))
    moment[found["i"], found["j"]] = moment[found["j"], found["i"]] = found["v"]
    if not np.isfinite(moment).all():
        return np.eye(width)
    return np.linalg.eigh(moment)[1][:, ::-1].copy()


def blocks(anchors: DataFrame, config: Mining, count: int) -> DataFrame:
    """Rows of BLOCK: about block_rows anchors in one. anchors: vec_id, label, embedding, low and high
    (arrays of long: the scores that are looked for, by slot), with embeddings not yet scaled."""
    n_blocks = -(-count // config.block_rows) or 1
    held = F.sort_array(F.collect_list(F.struct("vec_id", "label", "embedding", "low", "high"))).alias("rows")
    grouped = anchors.groupBy(F.pmod(F.xxhash64("vec_id"), F.lit(n_blocks)).alias("block")).agg(held)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows in batch.column("rows"):
                part = rows.values.flatten()
                ids, labels, vectors, low, high = part
                x, _ = scaled(vectors, config.scale)
                numbers = lambda a: a.to_numpy(zero_copy_only=False).astype("<i8").tobytes()
                fields = (numbers(ids), numbers(labels), stored(x), x.shape[1], numbers(low.flatten()), numbers(high.flatten()))
                kinds = (pa.binary(), pa.binary(), pa.binary(), pa.int32(), pa.binary(), pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(fields, kinds)], [f.split()[0] for f in BLOCK.split(", ")])

    return grouped.select("rows").mapInArrow(pack, BLOCK)


class Meeting:
    """Chunks against blocks of anchors: the best rows of each anchor and slot, by integer score."""

    def __init__(self, axes: np.ndarray, same: bool, top: int, config: Mining):
        self.axes, self.same, self.top, self.config = axes, same, top, config

    def rotated(self, x: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
        """Rotated rows, and the norms of what each stage leaves out."""
        y = x @ self.axes
        tail = np.sqrt(np.maximum(np.cumsum((y * y)[:, ::-1], 1)[:, ::-1], 0))
        tail = np.concatenate([tail, np.zeros((len(y), 1))], 1)
        return y, [tail[:, k] for k in self.cuts]

    @property
    def cuts(self) -> list[int]:
        width = len(self.axes)
        return sorted({min(width, max(1, round(width * s))) if width else 0 for s in self.config.stages})

    def exact(self, a: np.ndarray, x: np.ndarray) -> np.ndarray:
        """Integer products of paired rows."""
        width = max(a.shape[1], 1)
        if max(np.abs(a).max(initial=0), np.abs(x).max(initial=0)) < NARROW and width <= 1 << 14:
            return np.einsum("ij,ij->i", a.astype(np.int64), x.astype(np.int64))
        whole = [sum(int(p) * int(q) for p, q in zip(r, s)) for r, s in zip(a.tolist(), x.tolist())]
        return np.array([min(max(v, -(1 << 63)), (1 << 63) - 1) for v in whole], np.int64)

    def best(self, chunk: tuple, block: tuple) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Places of anchors, slots, places of rows, scores. chunk: ids, labels, vectors, rotated rows, residual norms;
        block: the same with low and high (anchors by slots)."""
        ids, labels, x, y, rest = chunk
        a_ids, a_labels, a, b, a_rest, low, high = block
        fits = (a_labels[:, None] == labels[None, :]) if self.same else (a_labels[:, None] != labels[None, :])
        if self.same:
            fits &= a_ids[:, None] != ids[None, :]
        fits &= ((low <= high).any(1))[:, None]
        open_low, open_high = np.where(low == LEAST, -np.inf, low), np.where(high == MOST, np.inf, high)
        lowest, highest = open_low.min(1), open_high.max(1)
        # rounding of the rotation and of the sums, a generous multiple of what it can be
        norm, a_norm = np.linalg.norm(x, axis=1), np.linalg.norm(a, axis=1)
        slack = (64.0 * (len(self.axes) + 1) ** 1.5 * 2.0**-52) * (a_norm[:, None] * norm[None, :]) + 1e-6
        score, done = np.zeros(fits.shape), 0
        for k, left, a_left in zip(self.cuts, rest, a_rest):
            score += b[:, done:k] @ y[:, done:k].T
            done = k
            reach = a_left[:, None] * left[None, :] + slack
            fits &= (score + reach >= lowest[:, None]) & (score - reach <= highest[:, None])
            if np.count_nonzero(fits) <= self.config.dense * fits.size:
                break
        else:
            fits = self.leaders(fits, score, slack, open_low, open_high)
        i, j = np.nonzero(fits)
        values = np.concatenate([self.exact(a[i[s : s + 65536]], x[j[s : s + 65536]]) for s in range(0, len(i), 65536)] or [np.empty(0, np.int64)])
        out = []
        for slot in range(low.shape[1]):
            inside = (values >= low[i, slot]) & (values <= high[i, slot])
            p, q, v = i[inside], j[inside], values[inside]
            order = np.lexsort((ids[q], -v.astype(float), p)) if len(v) and np.abs(v.astype(float)).max() < 2.0**53 else np.array(sorted(range(len(v)), key=lambda t: (p[t], -int(v[t]), ids[q[t]])), int)
            p, q, v = p[order], q[order], v[order]
            first = np.searchsorted(p, p)
            keep = np.arange(len(p)) - first < self.top
            out.append((p[keep], np.full(int(keep.sum()), slot), q[keep], v[keep]))
        return tuple(np.concatenate(c) for c in zip(*out))

    def leaders(self, fits: np.ndarray, score: np.ndarray, slack: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """Of the pairs that fit, those that can be among the best of a slot, when whole products are known but for their
        slack."""
        out = np.zeros_like(fits)
        for slot in range(low.shape[1]):
            near = fits & (score + slack >= low[:, slot, None]) & (score - slack <= high[:, slot, None])
            if fits.shape[1] > self.top:
                sure = np.where(near & (score - slack >= low[:, slot, None]) & (score + slack <= high[:, slot, None]), score - slack, -np.inf)
                least = np.partition(sure, -self.top, axis=1)[:, -self.top]
                near &= score + slack >= least[:, None]
            out |= near
        return out

    def work(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, chunk = None, ()
        for batch in batches:
            for row in batch.to_pylist():
                if seen != (row["ids"], row["vectors"]):
                    seen, chunk = (row["ids"], row["vectors"]), self.opened(row, "")
                block = self.opened(row, "a_")
                low, high = (np.frombuffer(row[k], "<i8").reshape(len(block[0]), -1) for k in ("low", "high"))
                if not low.shape[1]:
                    continue
                i, slot, j, score = self.best(chunk, (*block, low, high))
                if len(i):
                    columns = (block[0][i], slot.astype(np.int32), chunk[0][j], score)
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], [f.split()[0] for f in FOUND.split(", ")])

    def opened(self, row: dict, prefix: str) -> tuple:
        ids, labels = (np.frombuffer(row[prefix + k], "<i8") for k in ("ids", "labels"))
        x = widened(loaded(row[f"{prefix}vectors"], len(ids), row[f"{prefix}width"]), len(self.axes))
        return ids, labels, x, *self.rotated(x)


def meet(packed: DataFrame, anchors: DataFrame, axes: np.ndarray, same: bool, config: Mining, groups: int) -> DataFrame:
    """Rows of FOUND: what each chunk has to offer to each anchor and slot. One row of the join is one product of
    matrices. Both sides are shuffled: blocks are small as they are stored, but not with a copy in every group, so the
    driver must not gather them for a broadcast."""
    top = config.positives if same else config.negatives
    named = anchors.select(*(F.col(c).alias(f"a_{c}") for c in ("ids", "labels", "vectors", "width")), "low", "high")
    each = named.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))))
    return packed.join(each.hint("merge"), "part").drop("part").mapInArrow(Meeting(axes, same, top, config).work, FOUND)


def ranked(found: DataFrame, top: int) -> DataFrame:
    """The best of each anchor and slot over all chunks."""
    order = Window.partitionBy("anchor_id", "slot").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)


LEAST = -(1 << 63)
MOST = (1 << 63) - 1


def mine(spark: SparkSession, rows: DataFrame, label: Column, is_anchor: Column, config: Mining = Mining()) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score."""
    scratch, groups = Scratch(spark, "negatives"), shuffle_partitions(spark)
    ready = prepared(rows, label)
    packed = scratch.save(chunks(ready, config, groups), "chunks")
    axes = principal_axes(packed)

    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    least = F.min(F.struct("label", "embedding")).alias("m")
    own = scratch.save(ready.where(is_anchor & finite).groupBy("vec_id").agg(least).select("vec_id", "m.label", "m.embedding"), "anchors")
    count = own.count()
    few = scratch.save(chunks(own, replace(config, chunk_rows=config.block_rows), groups), "anchor-chunks")

    def seeded(bounds: DataFrame, same: bool) -> DataFrame:
        """Anchors whose low bounds are raised to the k-th best score among the anchors themselves."""
        top = config.positives if same else config.negatives
        known = ranked(meet(few, blocks(bounds, config, count), axes, same, config, groups), top).where(F.col("rank") == top)
        raised = known.groupBy("anchor_id").agg(F.map_from_entries(F.collect_list(F.struct("slot", "score"))).alias("least"))
        joined = bounds.join(raised.hint("merge"), bounds["vec_id"] == raised["anchor_id"], "left")
        low = F.transform("low", lambda x, i: F.greatest(x, F.coalesce(F.element_at(F.col("least"), i), F.lit(LEAST))))
        return joined.select("vec_id", "label", "embedding", F.when(F.col("least").isNull(), F.col("low")).otherwise(low).alias("low"), "high")

    free = own.withColumns({"low": F.array(F.lit(LEAST)), "high": F.array(F.lit(MOST))})
    wanted = scratch.save(blocks(scratch.save(seeded(free, True), "seeded-positives"), config, count), "positive-blocks")
    best = ranked(meet(packed, wanted, axes, True, config, groups), config.positives)
    positives = scratch.save(best.select("anchor_id", (F.col("rank") - 1).alias("slot"), F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score")), "positives")

    # lower end: the least integer not under it; upper end: the largest not over it
    share, over = (F.lit(b).cast("decimal(3,0)") * F.col("positive_score").cast("decimal(20,0)") for b in config.band)
    low, high = F.ceil(share / 100).cast("long"), F.floor(over / 100).cast("long")
    slots = positives.groupBy("anchor_id").agg(F.sort_array(F.collect_list(F.struct("slot", low.alias("low"), high.alias("high")))).alias("s"))
    banded = own.join(slots.hint("merge"), own["vec_id"] == slots["anchor_id"]).select("vec_id", "label", "embedding", F.col("s.low").alias("low"), F.col("s.high").alias("high"))
    # slots are filled up, so a block's bounds are one matrix; a band from most to least holds nothing
    filled = lambda c, v: F.concat(F.col(c), F.array_repeat(F.lit(v), F.lit(config.positives) - F.size(c)))
    banded = scratch.save(banded.withColumns({"low": filled("low", MOST), "high": filled("high", LEAST)}), "bands")
    wanted = scratch.save(blocks(scratch.save(seeded(banded, False), "seeded-bands"), config, count), "negative-blocks")
    worst = ranked(meet(packed, wanted, axes, False, config, groups), config.negatives)
    out = worst.join(positives.hint("merge"), ["anchor_id", "slot"])
    return out.select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), F.col("vec_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))


def shifted_labels() -> Column:
    """Every seventh row gets the next label."""
    return F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))


SQL = """
WITH q AS MATERIALIZED (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS MATERIALIZED (
  SELECT a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS same, list_inner_product(a.v, b.v)::BIGINT AS score FROM q a JOIN q b ON a.vec_id <> b.vec_id WHERE a.vec_id % 100 = 0
), p AS (
  SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5
)
SELECT p.anchor_id, positive_id, row_number() OVER w::INT AS rank, s.vec_id AS negative_id, positive_score, s.score AS negative_score
FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT s.same AND 30 * positive_score <= 100 * s.score AND 100 * s.score <= 90 * positive_score
WINDOW w AS (PARTITION BY p.anchor_id, positive_id ORDER BY s.score DESC, s.vec_id)
QUALIFY row_number() OVER w <= 10
"""
