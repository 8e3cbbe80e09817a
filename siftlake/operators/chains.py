"""Chaining of fragments: candidate pairs are made, scored and chosen one to one in joins over all groups."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..sources.shared import SharedTables

def to_heads(links: DataFrame, group: str) -> DataFrame:
    """group, node, head, steps: the first node of the path that each node (group, node, up) is on, and how far away it is.
    Paths do not meet and close no circle. Reach doubles from round to round, so a path of n nodes takes log2(n) rounds."""
    tables = SharedTables(links.sparkSession, "heads")
    at = tables.save(links.select(group, "node", F.col("up").alias("head"), F.lit(1).cast("long").alias("steps"), F.lit(True).alias("moved")))
    while at.where("moved").head(1):
        a, b = at.alias("a"), at.alias("b")
        met = a.join(b, (F.col(f"a.{group}") == F.col(f"b.{group}")) & (F.col("a.head") == F.col("b.node")), "left")
        at = met.select(f"a.{group}", "a.node", F.coalesce("b.head", "a.head").alias("head"), (F.col("a.steps") + F.coalesce("b.steps", F.lit(0))).alias("steps"), F.col("b.node").isNotNull().alias("moved"))
        at = tables.save(at)
    return at


def greedy_chains(edges: DataFrame, group: str, threshold: float) -> DataFrame:
    """One-to-one successor choice within each group (group, src, dst, confidence; no nulls): edges by falling confidence,
    then src and dst; an edge is taken if it reaches the threshold, neither end is used on that side and it closes no
    circle. Returns the taken edges with the head of their chain and the position in it.

    The same choice, made in rounds over all groups at once: an edge is taken that is the best open one of both its ends,
    so no better one can come between, and that no better ones can close to a circle before its turn, since it is also
    better than all open edges at the far end of the chain it leads to, or at the far end of the chain it comes from. The
    best open edge of a group always is such an edge. Edges of used ends, and those from a chain's end to its own head,
    are no longer open. Each round is a few joins and a table in the shared folder; groups of any size take part."""
    tables = SharedTables(edges.sparkSession, "open-edges")
    order = F.struct((-F.col("confidence")).alias("c"), "src", "dst")
    keys = [group, "src", "dst"]
    whole = edges.where(F.col("confidence") >= threshold).groupBy(*keys).agg(F.max("confidence").alias("confidence"))
    open_ = tables.save(whole.where("src <> dst"))
    state, chained = SharedTables(edges.sparkSession, "taken-edges"), SharedTables(edges.sparkSession, "chains")
    taken = state.save(open_.where("false"))
    # ends of chains of two or more nodes: group, head, tail
    chains = chained.save(open_.where("false").select(group, F.col("src").alias("head"), F.col("dst").alias("tail")))
    while open_.head(1):
        ranked = open_.withColumn("o", order)
        out, into = ranked.groupBy(group, "src").agg(F.min("o").alias("out")), ranked.groupBy(group, "dst").agg(F.min("o").alias("into"))
        best = ranked.join(out, [group, "src"]).join(into, [group, "dst"]).where("o = out and o = into").select(*keys, "confidence")
        # from the chain that ends with src, whose head is `up`, to the one that begins with dst, whose end is `far`
        best = best.join(chains.select(group, F.col("tail").alias("src"), F.col("head").alias("up")), [group, "src"], "left")
        best = best.join(chains.select(group, F.col("head").alias("dst"), F.col("tail").alias("far")), [group, "dst"], "left")
        best = best.select(*keys, "confidence", F.coalesce("up", "src").alias("up"), F.coalesce("far", "dst").alias("far"), order.alias("o"))
        best = best.join(out.select(group, F.col("src").alias("far"), F.col("out").alias("rival_out")), [group, "far"], "left")
        best = best.join(into.select(group, F.col("dst").alias("up"), F.col("into").alias("rival_in")), [group, "up"], "left")
        best = best.where("rival_out is null or rival_in is null or o < rival_out or o < rival_in")
        best = SharedTables(edges.sparkSession, "best-edges").save(best.select(*keys, "confidence", "up"))
        ends = to_heads(best.select(group, F.col("dst").alias("node"), "up"), group)
        taken = state.save(taken.unionByName(best.select(*keys, "confidence")))
        # a path of chains is one chain: from the head of its first to the tail of its last
        further = best.select(group, F.col("up").alias("node"))
        last = ends.join(further, [group, "node"], "left_anti").select(group, F.col("node").alias("c"), F.col("head").alias("first"))
        last = last.join(chains.select(group, F.col("head").alias("c"), "tail"), [group, "c"], "left")
        merged = last.select(group, F.col("first").alias("head"), F.coalesce("tail", "c").alias("tail"))
        touched = best.select(group, F.col("up").alias("head")).unionByName(best.select(group, F.col("dst").alias("head"))).distinct()
        chains = chained.save(chains.join(touched, [group, "head"], "left_anti").unionByName(merged))
        left = open_.join(best.select(group, "src"), [group, "src"], "left_anti").join(best.select(group, "dst"), [group, "dst"], "left_anti")
        own = chains.select(group, F.col("tail").alias("src"), F.col("head").alias("dst"))
        open_ = tables.save(left.join(own, keys, "left_anti"))
    ends = to_heads(taken.select(group, F.col("dst").alias("node"), F.col("src").alias("up")), group)
    placed = taken.join(ends.select(group, F.col("node").alias("dst"), "head", "steps"), [group, "dst"])
    return placed.select(*keys, "confidence", (F.col("steps") - 1).cast("int").alias("position"), "head")


def restart_successors(frags: DataFrame, group: str) -> DataFrame:
    """Pairs of scan fragments (fragment, first_rst, last_rst) where the second begins with the restart number that
    follows the first: an equi join on the number, not all pairs."""
    a = frags.select(group, F.col("fragment").alias("src"), F.pmod(F.col("last_rst") + 1, F.lit(8)).alias("rst"))
    b = frags.select(group, F.col("fragment").alias("dst"), F.col("first_rst").alias("rst"))
    return a.join(b, [group, "rst"]).where("src <> dst")


def log_pairs(frags: DataFrame, group: str, hours: int = 24) -> DataFrame:
    """Pairs of log fragments (fragment, first_stamp, last_stamp, interval) whose time does not run backwards and whose
    gap is at most some hours; met by hour buckets."""
    first, last = (F.unix_timestamp(F.to_timestamp(c)) for c in ("first_stamp", "last_stamp"))
    base = frags.select(group, "fragment", "head_line", "tail_line", "interval", first.alias("t0"), last.alias("t1"))
    width = hours * 3600
    a = base.select(group, F.col("fragment").alias("src"), F.col("t1").alias("end"), F.col("tail_line"), "interval", F.explode(F.array(F.floor(F.col("t1") / width), F.floor(F.col("t1") / width) + 1)).alias("bucket"))
    b = base.select(group, F.col("fragment").alias("dst"), F.col("t0").alias("begin"), F.col("head_line"), F.floor(F.col("t0") / width).alias("bucket"))
    met = a.join(b, [group, "bucket"]).where((F.col("src") != F.col("dst")) & (F.col("begin") >= F.col("end")) & (F.col("begin") - F.col("end") <= width))
    return met.withColumn("gap", F.col("begin") - F.col("end")).drop("bucket")


def log_confidence(gap: Column, interval: Column, tail_line: Column, head_line: Column) -> Column:
    """Time continuity and the rejoining of a split line, through the edge model."""
    time = F.exp(-gap / (8.0 * interval + 1.0))
    split = ~F.endswith(tail_line, F.lit("\n"))
    whole = F.rlike(F.concat(tail_line, head_line), F.lit(S.TIMESTAMP_RE + r"[^\n]*$"))
    boundary = F.when(split & whole, 1.0).when(split, 0.3).when(F.rlike(head_line, F.lit("^" + S.TIMESTAMP_RE)), 0.7).otherwise(0.1)
    parts = S.edge_contributions({"type_compat": F.lit(1.0), "boundary_smooth": boundary, "time_consistent": time, "struct_order": boundary})
    return S.edge_confidence(parts)


def ordered_logs(pieces: DataFrame, group: str, threshold: float = 0.0) -> DataFrame:
    """The pieces (group, fragment, text) of logs in chains, by time and by the lines that were cut; as greedy_chains."""
    text = F.rtrim("text", F.lit("\0"))
    lines = F.split(text, "\n", -1)
    stamps = F.regexp_extract_all(text, F.lit(f"({S.TIMESTAMP_RE})"), F.lit(1))
    last = F.when(F.element_at(lines, -1) == "", F.concat(F.element_at(lines, F.greatest(-F.size(lines), F.lit(-2))), F.lit("\n"))).otherwise(F.element_at(lines, -1))
    span = F.unix_timestamp(F.to_timestamp(F.element_at(stamps, -1))) - F.unix_timestamp(F.to_timestamp(F.element_at(stamps, 1)))
    interval = (span / F.greatest(F.size(stamps) - 1, F.lit(1))).cast("double")
    rows = pieces.where(F.size(stamps) > 0).select(group, "fragment", F.element_at(stamps, 1).alias("first_stamp"), F.element_at(stamps, -1).alias("last_stamp"), F.element_at(lines, 1).alias("head_line"), last.alias("tail_line"), interval.alias("interval"))
    pairs = log_pairs(rows, group)
    score = log_confidence(F.col("gap"), F.col("interval"), F.col("tail_line"), F.col("head_line"))
    return greedy_chains(pairs.select(group, "src", "dst", score.alias("confidence")), group, threshold)


def claims(stages: Sequence[tuple[str, DataFrame]], key: str) -> DataFrame:
    """What each stage keeps when earlier stages claim first: (key, stage)."""
    out = None
    for name, found in stages:
        rows = found.select(key).distinct().withColumn("stage", F.lit(name))
        out = rows if out is None else out.unionByName(rows.join(out.select(key), key, "left_anti"))
    return out
