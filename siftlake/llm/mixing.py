"""Mixing sources to target weights by entropy balancing, in DataFrame operations only.

Each document i has a size (words) and a rate r_i, the expected number of copies. Among all rates between 0 and `cap`
that give each source its target number of words, entropy balancing takes the one closest to one copy of everything, in
the relative entropy sum (r_i log r_i - r_i + 1). With one token constraint per source, sum size_i r_i = target_s, the
convex dual has one variable per source, and the rates are exponentially tilted by size:

    r_i = min(cap, exp(tilt_s * size_i))

A source that must shrink gives up its long documents first, a source that must grow repeats its long documents first;
no other rates reach the target and stay closer to one copy each. Newton's steps on the dual need, by source, the sums
of size * rate and of size^2 * rate over all documents. Documents of one source and size have one rate, so they are
counted together once; every step is a sum over that table, and a step that leaves the interval in which the solution
is known to lie, or gains too little, is replaced by halving the interval. Steps go on until all sources meet their
targets. Sums are taken in whole 2^-30 parts of a copy, so they do not depend on the order of rows.

Rates are rounded into copies by sequential Poisson sampling: a document gets floor(r) copies; with f = r - floor(r) and
a fixed random number u of the document, the documents of a source with the least u / f get one more, as long as their
words together stay within what is missing. Where the order is cut is found by sums over 4,096 ranges of u / f, then
over 4,096 parts of the range that holds the cut, and so on; no source's documents are ever sorted or met in one task.
What is left is filled by the largest document that still fits, `fill_rounds` times. A document's copies follow from its
own row and a few numbers of its source, so `mix` joins one row per source and nothing else.

Defined cases: null text has size 0; documents of size 0 are kept once where their source has words, and otherwise
dropped; null source is a source of its own, ordered last; a source without words has target 0; an empty table gives no
rows; rows equal in doc_id and text get equal copies, and none of them is repeated if all together do not fit, so
there are no other ties in the order by hash; a very long text is one row with a large size; extra columns stay out of the result of `mix_plan` and are kept by `mix`.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD_RE, Scratch

ONE = 1 << 30  # parts of a copy
CELL_BITS, LEVELS = 12, 4
WHOLE = 1 << (CELL_BITS * LEVELS)


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD_RE)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights: tuple[float, ...], share: float, cap: float) -> DataFrame:
    """A row per source: source, source_size, weight, target. One row per source meets in a task, no documents."""
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    cycle = F.array(*[F.lit(float(w)) for w in weights])
    rank = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    per = per.withColumn("weight", F.element_at(cycle, (rank % len(weights) + 1).cast("int")))
    per = per.withColumn("most", cap * F.col("source_size"))
    # By rising most/weight, a source is full when an equal share of what the full ones before it leave would fill it.
    order = Window.orderBy(F.col("most") / F.col("weight"), F.col("source").asc_nulls_last())
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    rest = order.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    every = Window.partitionBy()
    budget = share * F.sum("source_size").over(every)
    left = budget - F.coalesce(F.sum("most").over(before), F.lit(0.0))
    per = per.withColumn("full", F.col("most") * F.sum("weight").over(rest) <= F.col("weight") * left)
    per = per.withColumn("budget", budget)
    level = (F.col("budget") - F.coalesce(F.sum(F.when(F.col("full"), F.col("most"))).over(every), F.lit(0.0))) / F.sum(
        F.when(~F.col("full"), F.col("weight"))
    ).over(every)
    return per.select("source", "source_size", "weight", F.when(F.col("full"), F.col("most")).otherwise(F.col("weight") * level).alias("target"))


def document_sizes(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").alias("source"), word_count(F.col("text")).alias("size"))


def with_source(df: DataFrame, per: DataFrame, *names: str, how: str = "inner") -> DataFrame:
    """df with columns of its source's row; null sources match."""
    p = per.select(F.col("source").alias("_s"), *names)
    return df.join(p, df["source"].eqNullSafe(p["_s"]), how).drop("_s")


def rate_of(tilt: Column, size: Column, cap: float) -> Column:
    """Copies of a document, in whole parts of 1 / ONE; tilt is null where all documents of a source get `cap`."""
    free = F.floor(F.exp(F.least(tilt * size, F.lit(math.log(cap) + 1))) * ONE)
    return F.when(tilt.isNull(), F.lit(int(cap * ONE))).otherwise(F.least(free, F.lit(int(cap * ONE)))).cast("long")


def dual_tilts(targets: DataFrame, hist: DataFrame, scratch: Scratch, cap: float, tolerance: float = 1e-7) -> DataFrame:
    """Adds `tilt`, the dual variable, to the rows of targets. hist: source, size, n, the documents of one source and size."""
    solvable = (F.col("source_size") > 0) & (F.col("target") > 0)
    inner = solvable & (F.col("target") < cap * F.col("source_size") * (1 - 1e-9))
    big = hist.groupBy("source").agg(F.max("size").cast("double").alias("big"))
    at = with_source(targets, big, "big", how="left").withColumn("x", F.lit(0.0)).withColumn("open", inner)
    at = at.withColumns({"low": F.lit(-math.inf), "high": F.lit(math.inf), "miss": F.lit(math.inf)})
    at, turn = scratch.save(at, "tilt0"), 0
    while not at.where("open").isEmpty():
        met = with_source(hist, at.where("open"), "big", "x")
        rate = rate_of(F.col("x") / F.col("big"), F.col("size"), cap)
        words = F.col("n").cast("decimal(19,0)") * F.col("size").cast("decimal(19,0)")
        slope = F.when(rate < int(cap * ONE), F.floor(F.col("size") / F.col("big") * 1024) * rate / 1024).otherwise(0)
        sums = met.groupBy("source").agg(
            F.sum((words * rate.cast("decimal(12,0)")).cast("decimal(38,0)")).alias("taken"),
            F.sum((words * F.floor(slope).cast("decimal(12,0)")).cast("decimal(38,0)")).alias("slope"),
        )
        sums = sums.select("source", (F.col("taken").cast("double") / ONE).alias("taken"), (F.col("slope").cast("double") / ONE).alias("slope"))
        at = with_source(at, sums, "taken", "slope", how="left")
        gap = F.col("taken") - F.col("target")
        at = at.withColumn("low", F.when(gap < 0, F.col("x")).otherwise(F.col("low"))).withColumn("high", F.when(gap > 0, F.col("x")).otherwise(F.col("high")))
        newton = F.col("x") - gap / F.col("slope")
        bounded = (F.col("low") > -math.inf) & (F.col("high") < math.inf)
        inside = (F.col("slope") > 0) & (newton > F.col("low")) & (newton < F.col("high"))
        middle = F.when(bounded, (F.col("low") + F.col("high")) / 2).when(gap > 0, 2 * F.col("x") - 1).otherwise(2 * F.col("x") + 1)
        slow = bounded & (F.abs(gap) > F.col("miss") / 2)
        done = (F.abs(gap) <= tolerance * F.col("target")) | (bounded & (F.col("high") - F.col("low") <= 1e-13 * F.greatest(F.abs("x"), F.lit(1.0))))
        # Where halving has nothing left to halve, the lower end is taken: it stays within the target.
        settled = F.when(F.abs(gap) <= tolerance * F.col("target"), F.col("x")).otherwise(F.col("low"))
        moved = F.when(inside & ~slow, newton).otherwise(middle)
        at = at.withColumn("next", F.when(~F.col("open"), F.col("x")).when(done, settled).otherwise(moved)).withColumn("still", F.col("open") & ~done)
        at = at.withColumn("miss", F.abs(gap)).drop("x", "open", "taken", "slope").withColumnsRenamed({"next": "x", "still": "open"})
        turn += 1
        at = scratch.save(at, f"tilt{turn}")
        scratch.drop(f"tilt{turn - 1}")
    tilt = F.when(inner, F.col("x") / F.col("big"))  # null: at the cap, or nothing to take
    return at.select("source", "source_size", "weight", "target", solvable.alias("solvable"), tilt.alias("tilt"))


def random_of(doc_id: Column, text: Column, seed: int) -> Column:
    """A number between 0 and 1 that a document always gets."""
    return (F.shiftrightunsigned(F.xxhash64(doc_id, text, F.lit(seed)), 12) + 0.5) / float(1 << 52)


def with_order(df: DataFrame, plan: DataFrame, cap: float) -> DataFrame:
    """source, size and u, with the rate, whole copies, and the place in the source's order (null: no further copy)."""
    met = with_source(df, plan, "source_size", "target", "solvable", "tilt")
    met = met.withColumn("parts", F.when(F.col("solvable"), rate_of(F.col("tilt"), F.col("size"), cap)).otherwise(F.lit(0)))
    met = met.withColumn("base", F.floor(F.col("parts") / ONE)).withColumn("left", F.col("parts") - F.col("base") * ONE)
    ahead = F.col("u") * ONE / F.col("left")
    order = F.when((F.col("left") > 0) & (F.col("size") > 0), F.floor(ahead / (1 + ahead) * WHOLE).cast("long"))
    return met.withColumn("order", order)


def cut_orders(placed: DataFrame, plan: DataFrame, scratch: Scratch) -> DataFrame:
    """Adds to plan `cut`, under which the order of a document must lie for one more copy, and `free`, the words still missing."""
    whole = placed.groupBy("source").agg(F.sum(F.col("base") * F.col("size")).alias("whole"))
    at = with_source(plan, whole, "whole", how="left")
    at = at.withColumn("free", F.greatest(F.col("target") - F.coalesce("whole", F.lit(0)), F.lit(0.0))).drop("whole").withColumn("cut", F.lit(0).cast("long"))
    at = scratch.save(at, "cut0")
    for level in range(LEVELS):
        wide = 1 << (CELL_BITS * (LEVELS - level - 1))
        within = with_source(placed.where("order is not null").select("source", "size", "order"), at, "cut")
        within = within.where((F.col("order") >= F.col("cut")) & (F.col("order") < F.col("cut") + wide * (1 << CELL_BITS)))
        cells = within.groupBy("source", F.floor((F.col("order") - F.col("cut")) / wide).cast("int").alias("cell")).agg(F.sum("size").alias("words"))
        by_source = cells.groupBy("source").agg(F.array_sort(F.collect_list(F.struct("cell", "words"))).alias("cells"))  # 4,096 at most
        at = with_source(at, by_source, "cells", how="left")
        start = F.struct(F.lit(0).alias("cell"), F.lit(0).cast("long").alias("words"), F.lit(False).alias("over"))

        def step(s: Column, c: Column) -> Column:
            over = s["over"] | (s["words"] + c["words"] > F.col("free"))
            return F.struct(
                F.when(over & ~s["over"], c["cell"]).when(over, s["cell"]).otherwise(c["cell"] + 1).alias("cell"),
                F.when(over, s["words"]).otherwise(s["words"] + c["words"]).alias("words"),
                over.alias("over"),
            )

        at = at.withColumn("found", F.aggregate(F.coalesce("cells", F.expr("cast(array() as array<struct<cell: int, words: bigint>>)")), start, step))
        at = at.withColumn("cut", F.col("cut") + F.col("found.cell").cast("long") * wide).withColumn("free", F.col("free") - F.col("found.words"))
        at = scratch.save(at.drop("cells", "found"), f"cut{level + 1}")
    return at


def filled(placed: DataFrame, at: DataFrame, scratch: Scratch, rounds: int, cap: float) -> DataFrame:
    """Adds to plan `picks`, the orders of documents beyond the cut that get one more copy."""
    at = at.withColumn("picks", F.array().cast("array<long>"))
    for i in range(rounds):
        open_ = with_source(placed.where((F.col("order").isNotNull()) & (F.col("base") + 1 <= cap)).select("source", "size", "order"), at, "cut", "free", "picks")
        fits = open_.where((F.col("order") >= F.col("cut")) & (F.col("size") <= F.col("free")) & ~F.array_contains("picks", F.col("order")))
        pick = fits.groupBy("source").agg(F.max(F.struct("size", "order")).alias("pick"))
        pick = scratch.save(pick.select("source", "pick.order"), f"pick{i}")
        # Rows equal in doc_id and text, or in order by chance, are taken together or not at all.
        same = with_source(placed.select("source", "size", F.col("order").alias("o")), pick, "order").where(F.col("o") == F.col("order"))
        same = same.groupBy("source").agg(F.first("order").alias("order"), F.sum("size").alias("words"))
        at = with_source(at, same, "order", "words", how="left")
        fit = F.coalesce(F.col("words") <= F.col("free"), F.lit(False))
        at = at.withColumn("picks", F.when(fit, F.concat("picks", F.array("order"))).otherwise(F.col("picks")))
        at = scratch.save(at.withColumn("free", F.when(fit, F.col("free") - F.col("words")).otherwise(F.col("free"))).drop("order", "words"), f"filled{i}")
    return at


class Mixture:
    """The plan of a mix over one table: a row per source, from which each document's copies follow."""

    def __init__(
        self,
        docs: DataFrame,
        *,
        weights: tuple[float, ...] = (3.0, 1.0, 2.0),
        share: float = 1.5,
        cap: float = 2.0,
        fill_rounds: int = 3,
        seed: int = 17,
    ):
        self.docs, self.cap, self.seed = docs, cap, seed
        self.scratch = Scratch(docs.sparkSession, "mix")
        u = random_of(F.col("doc_id").cast("long"), F.col("text"), seed).alias("u")
        self.sizes = self.scratch.save(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").alias("source"), word_count(F.col("text")).alias("size"), u), "sizes")
        hist = self.scratch.save(self.sizes.where("size > 0").groupBy("source", "size").agg(F.count(F.lit(1)).alias("n")), "hist")
        targets = self.scratch.save(source_targets(self.sizes, weights, share, cap), "targets")
        self.plan = self.scratch.save(dual_tilts(targets, hist, self.scratch, cap), "plan")
        placed = with_order(self.sizes, self.plan, cap)
        self.plan = filled(placed, cut_orders(placed, self.plan, self.scratch), self.scratch, fill_rounds, cap)

    def copies(self, sized: DataFrame) -> DataFrame:
        """sized (source, size, u and more) with source_size, target, rate and copies."""
        placed = with_source(with_order(sized, self.plan, self.cap), self.plan, "cut", "picks")
        more = F.coalesce((F.col("order") < F.col("cut")) | F.array_contains("picks", F.col("order")), F.lit(False)).cast("long")
        return placed.withColumn("rate", F.col("parts") / float(ONE)).withColumn("copies", (F.col("base") + more).cast("long"))


def mix_plan(docs: DataFrame, **options) -> DataFrame:
    """doc_id, source, size, source_size, target, rate, copies: one row per row of docs."""
    m = Mixture(docs, **options)
    return m.copies(m.sizes).select("doc_id", "source", "size", "source_size", "target", "rate", "copies")


def mix(docs: DataFrame, **options) -> DataFrame:
    """The documents themselves, each row as often as its copies say; columns as given."""
    m = Mixture(docs, **options)
    u = random_of(F.col("doc_id").cast("long"), F.col("text"), m.seed).alias("u")
    whole = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"), F.col("source").alias("source"), word_count(F.col("text")).alias("size"), u)
    repeated = m.copies(whole).where("copies > 0").select("row", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))).alias("copy"))
    return repeated.select("row.*")


def taken_words(docs: DataFrame) -> DataFrame:
    """Digest of the mix: doc_id, size, source_size, target, taken, and the copies and rate behind them."""
    plan = mix_plan(docs)
    return plan.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"), "copies", "rate")


def targets_of(docs: DataFrame) -> DataFrame:
    """source, source_size and target, to a thousandth of a word, of the default mix."""
    per = source_targets(document_sizes(docs), (3.0, 1.0, 2.0), 1.5, 2.0)
    return per.select("source", F.col("source_size").cast("long").alias("source_size"), F.round("target", 3).alias("target"))


#: Sources and their targets in DuckDB. What the rounding takes has no counterpart there: its order is a hash of Spark's.
TARGETS_SQL = r"""
WITH d AS (SELECT source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS size FROM documents),
s AS (SELECT source, sum(size)::DOUBLE AS source_size FROM d GROUP BY source),
w AS (SELECT *, 2 * source_size AS most, CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 3.0 WHEN 1 THEN 1.0 ELSE 2.0 END::DOUBLE AS weight FROM s),
b AS (SELECT *, 1.5 * sum(source_size) OVER () AS budget,
  coalesce(sum(most) OVER (ORDER BY most / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before,
  sum(weight) OVER (ORDER BY most / weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS rest FROM w),
f AS (SELECT *, most * rest <= weight * (budget - before) AS is_full FROM b)
SELECT source, source_size::BIGINT AS source_size, round(CASE WHEN is_full THEN most ELSE
  weight * (budget - coalesce(sum(most) FILTER (WHERE is_full) OVER (), 0)) / sum(weight) FILTER (WHERE NOT is_full) OVER () END, 3) AS target
FROM f
"""
