"""Relational operators: duplicates, islands, intervals, votes, matching, differences, ranking."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.shared import SharedTables

#: Rows of a task that sorts them.
TASK_ROWS = 1 << 18


def first_of_equal(df: DataFrame, key: Column, order: Sequence[str], id_col: str, into: str = "duplicate_of") -> DataFrame:
    """Marks each row with the id of the first row of equal key, null on that one. The first rows come from a map-side
    aggregate joined back, so a key with very many rows is never sorted in one task."""
    keyed = df.withColumn("_key", key)
    firsts = keyed.groupBy("_key").agg(F.min(F.struct(*order, id_col)).alias("_first"))
    out = keyed.join(firsts, keyed["_key"].eqNullSafe(firsts["_key"]), "left").drop(firsts["_key"])
    first = F.col(f"_first.{id_col}")
    return out.withColumn(into, F.when(first != F.col(id_col), first)).drop("_key", "_first")


def single_owner(parts: DataFrame, part_id: str, hash_col: str) -> DataFrame:
    """Wholes all of whose parts are first owned by one and the same other whole: (part_id, owner)."""
    owners = parts.groupBy(hash_col).agg(F.min(part_id).alias("owner"))
    whole = parts.join(owners, hash_col).groupBy(part_id).agg(F.min("owner").alias("owner"), F.max("owner").alias("_last"))
    return whole.where((F.col("owner") == F.col("_last")) & (F.col("owner") != F.col(part_id))).drop("_last")


def islands(df: DataFrame, partition: Sequence[str], order: Sequence[str], breaks: Column, into: str = "island") -> DataFrame:
    """Numbers runs of rows; `breaks` may use lag() over the same window through the column functions given."""
    w = Window.partitionBy(*partition).orderBy(*order)
    flagged = df.withColumn("_break", F.coalesce(breaks, F.lit(True)).cast("int"))
    return flagged.withColumn(into, F.sum("_break").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_break")


def fill_gaps(segments: DataFrame, partition: Sequence[str], start: str, end: str) -> DataFrame:
    """Gaps between segments: partition, gap_start, gap_end. Overlaps are merged by a running end."""
    w = Window.partitionBy(*partition).orderBy(start, end).rowsBetween(Window.unboundedPreceding, -1)
    reached = segments.withColumn("gap_start", F.max(end).over(w)).withColumn("gap_end", F.col(start))
    return reached.where(F.col("gap_end") > F.col("gap_start")).select(*partition, "gap_start", "gap_end")


def merge_intervals(segments: DataFrame, partition: Sequence[str], start: str, end: str) -> DataFrame:
    """Disjoint union of closed-open intervals."""
    w = Window.partitionBy(*partition).orderBy(start, end)
    reach = F.max(end).over(w.rowsBetween(Window.unboundedPreceding, -1))
    marked = segments.withColumn("_new", (reach.isNull() | (F.col(start) > reach)).cast("int"))
    runs = marked.withColumn("_run", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return runs.groupBy(*partition, "_run").agg(F.min(start).alias("start"), F.max(end).alias("end")).drop("_run")


def covered_length(segments: DataFrame, partition: Sequence[str], start: str, end: str) -> DataFrame:
    """partition, n_runs, covered: how many disjoint intervals the segments make and how long these are together. What each
    segment adds beyond the reach of those before it is summed, so no run is a group of its own."""
    w = Window.partitionBy(*partition).orderBy(start, end)
    reach = F.max(end).over(w.rowsBetween(Window.unboundedPreceding, -1))
    rows = in_parts(segments.select(*partition, start, end), partition).withColumn("_reach", reach)
    new = F.coalesce(F.col(start) > F.col("_reach"), F.lit(True)).cast("long")
    more = F.greatest(F.col(end) - F.greatest(start, "_reach"), F.lit(0))
    return rows.groupBy(*partition).agg(F.sum(new).alias("n_runs"), F.sum(more).alias("covered"))


def in_parts(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The rows dealt by keys over as many tasks as they need, so that a task's share does not grow with the input."""
    return df.repartition(1 + df.count() // TASK_ROWS, *keys)


def split_intervals(segments: DataFrame, cuts: DataFrame, key: str) -> DataFrame:
    """Segments (key, start, end) cut at the bounds of `cuts` (key, cut_start, cut_end): key, start, end, inside."""
    points = cuts.select(key, F.explode(F.array("cut_start", "cut_end")).alias("p")).distinct()
    inner = segments.join(points, key).where((F.col("p") > F.col("start")) & (F.col("p") < F.col("end")))
    edges = segments.select(key, "start", "end", F.col("start").alias("p")).unionByName(inner.select(key, "start", "end", "p"))
    w = Window.partitionBy(key, "start", "end").orderBy("p")
    pieces = edges.withColumn("q", F.coalesce(F.lead("p").over(w), F.col("end"))).select(key, F.col("p").alias("start"), F.col("q").alias("end"))
    hit = pieces.join(cuts, key).where((F.col("cut_start") < F.col("end")) & (F.col("cut_end") > F.col("start"))).select(key, "start", "end").distinct()
    return pieces.join(hit.withColumn("inside", F.lit(True)), [key, "start", "end"], "left").withColumn("inside", F.coalesce("inside", F.lit(False)))


def majority(votes: DataFrame, key: str, choice: str) -> DataFrame:
    """The choice with most votes per key, the smaller of equals: key, choice, votes, share."""
    counted = votes.groupBy(key, choice).agg(F.count(F.lit(1)).alias("votes"))
    best = counted.groupBy(key).agg(F.max(F.struct("votes", (-F.col(choice)).alias("c"))).alias("best"), F.sum("votes").alias("total"))
    return best.select(key, (-F.col("best.c")).alias(choice), F.col("best.votes").alias("votes"), (F.col("best.votes") / F.col("total")).alias("share"))


def latest_by(df: DataFrame, key: str, order: Sequence[str]) -> DataFrame:
    """The row of each key with the greatest order columns, by a map-side aggregate."""
    rest = [c for c in df.columns if c not in {key, *order}]
    best = df.groupBy(key).agg(F.max(F.struct(*order, *rest)).alias("_best"))
    return best.select(key, "_best.*")


def top_k(df: DataFrame, partition: Sequence[str], order: Sequence[Column], k: int, into: str = "rank") -> DataFrame:
    """The k first rows of each group."""
    return df.withColumn(into, F.row_number().over(Window.partitionBy(*partition).orderBy(*order))).where(F.col(into) <= k)


def snapshot_diff(old: DataFrame, new: DataFrame, key: str, content: str) -> DataFrame:
    """key and change: deleted, new, modified or unchanged."""
    a = old.select(key, F.col(content).alias("old_content"))
    b = new.select(F.col(key).alias("_key"), F.col(content).alias("new_content"))
    both = a.join(b, a[key] == b["_key"], "full_outer")
    change = (
        F.when(F.col("_key").isNull(), "deleted")
        .when(F.col(key).isNull(), "new")
        .when(F.col("old_content").eqNullSafe(F.col("new_content")), "unchanged")
        .otherwise("modified")
    )
    return both.select(F.coalesce(key, "_key").alias(key), "old_content", "new_content", change.alias("change"))


def match_renames(diff: DataFrame, key: str) -> DataFrame:
    """Deleted rows paired one to one with new rows of the same content, in key order: old_key, new_key, content."""
    gone = diff.where("change = 'deleted'").select(F.col(key).alias("old_key"), F.col("old_content").alias("content"))
    made = diff.where("change = 'new'").select(F.col(key).alias("new_key"), F.col("new_content").alias("content"))
    gone = gone.withColumn("n", F.row_number().over(Window.partitionBy("content").orderBy("old_key")))
    made = made.withColumn("n", F.row_number().over(Window.partitionBy("content").orderBy("new_key")))
    return gone.join(made, ["content", "n"]).select("old_key", "new_key", "content")


def band_pairs(df: DataFrame, key: str, at: str, id_col: str, reach: int) -> DataFrame:
    """Pairs of one key whose integer `at` differs by at most reach: (key, a, b, gap), a before b. Buckets of the reach
    keep the join an equi join; each row meets its own and the next bucket only."""
    base = df.select(key, F.col(at).alias("t"), F.col(id_col).alias("i")).withColumn("bucket", F.floor(F.col("t") / reach))
    left = base.select(key, F.col("t").alias("ta"), F.col("i").alias("a"), F.explode(F.array(F.col("bucket"), F.col("bucket") + 1)).alias("bucket"))
    right = base.select(key, F.col("t").alias("tb"), F.col("i").alias("b"), "bucket")
    met = left.join(right, [key, "bucket"])
    ahead = (F.col("tb") > F.col("ta")) | ((F.col("tb") == F.col("ta")) & (F.col("b") > F.col("a")))
    return met.where(ahead & (F.col("tb") - F.col("ta") <= reach)).select(key, "a", "b", (F.col("tb") - F.col("ta")).alias("gap"))


def resolve_slots(claims: DataFrame, slot: str, order: Sequence[Column]) -> DataFrame:
    """One claim per slot, the first by order."""
    return top_k(claims, [slot], order, 1, "_rank").drop("_rank")


def components(edges: DataFrame) -> DataFrame:
    """(id, component) of an undirected graph (a, b): the smallest id of its component for each id, by alternating
    large-star and small-star steps until no link changes.

    Each step is written to the session's shared folder and read back, so neither lineage nor size estimates grow."""
    scratch = SharedTables(edges.sparkSession, "components")

    def pulled(e: DataFrame) -> DataFrame:
        return e.groupBy("u").agg(F.min("v").alias("m"))

    def state(e: DataFrame) -> tuple:
        return tuple(e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first())

    e = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct()
    e, before = scratch.save(e), None
    while (now := state(e)) != before:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = both.join(pulled(both), "u").where("v > u").select(F.col("v").alias("u"), F.least("u", "m").alias("v")).distinct()
        met = large.join(pulled(large), "u")
        small = met.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(met.select("u", F.col("m").alias("v")))
        before, e = now, scratch.save(small.where("u <> v").distinct())
    roots = e.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct()
    return e.select(F.col("u").alias("id"), F.col("v").alias("component")).unionByName(roots)


def degree(edges: DataFrame) -> DataFrame:
    """id, degree in the multigraph, distinct neighbours and centrality among all ids of the edges."""
    ends = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    by = ends.groupBy("a").agg(F.count(F.lit(1)).alias("degree"), F.count_distinct("b").alias("neighbours"))
    n = by.agg(F.count(F.lit(1)).alias("n"))
    centrality = F.when(F.col("n") > 1, F.col("neighbours") / (F.col("n") - 1)).otherwise(0.0)
    return by.crossJoin(F.broadcast(n)).select(F.col("a").alias("id"), "degree", "neighbours", centrality.alias("centrality"))  # n is one row


def reliability(scored: DataFrame, p: str, y: str, bins: int = 10, least: int = 30) -> DataFrame:
    """A row per bin: n, mean score, rate of positives, low (fewer than five rows); none under `least` samples."""
    binned = scored.withColumn("bin", F.least(F.lit(bins - 1), F.floor(F.col(p) * bins)).cast("int"))
    out = binned.groupBy("bin").agg(F.count(F.lit(1)).alias("n"), F.avg(p).alias("mean_score"), F.avg(y).alias("rate"))
    out = out.withColumn("total", F.sum("n").over(Window.partitionBy()))  # of one row per bin
    return out.where(F.col("total") >= least).withColumn("low", F.col("n") < 5).drop("total")


def auc(scored: DataFrame, p: str, y: str) -> DataFrame:
    """Mann-Whitney with half credit for ties, from counts per distinct score; no global sort of rows."""
    by = scored.groupBy(p).agg(F.sum(y).alias("pos"), F.count(F.lit(1)).alias("n")).withColumn("neg", F.col("n") - F.col("pos"))
    below = F.coalesce(F.sum("neg").over(Window.orderBy(p).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    won = by.withColumn("won", F.col("pos") * (below + 0.5 * F.col("neg")))
    return won.agg((F.sum("won") / (F.sum("pos") * F.sum("neg"))).alias("auc"))
