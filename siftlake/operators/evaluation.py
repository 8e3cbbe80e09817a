"""Results against a known truth, runs of scenarios, labelled samples, and the catalogue of protected folders."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def recovery_metrics(placed: DataFrame, owners: DataFrame, noise: DataFrame, joins: DataFrame, truth_joins: DataFrame) -> DataFrame:
    """One row: what share of the truth's clusters (cluster, name, logical; cluster null where overwritten) was placed
    (cluster, name, logical) rightly, of all and of those that survive, precision and recall of joins (file, logical,
    correct) against the truth's (name, logical), and the share of other clusters (cluster) that were placed."""
    right = placed.join(owners.where("cluster is not null"), ["cluster", "name", "logical"], "left_semi").agg(F.count_distinct("name", "logical").alias("correct"))
    total = owners.agg(F.count(F.lit(1)).alias("total"), F.count("cluster").alias("surviving"))
    wrong = noise.join(placed.select("cluster").distinct().withColumn("hit", F.lit(1)), "cluster", "left").agg(F.count(F.lit(1)).alias("noise"), F.count("hit").alias("false"))
    found = joins.where("correct").select("name", "logical").distinct()
    linked = joins.agg(F.count(F.lit(1)).alias("made"), F.count_if("correct").alias("good"))
    recalled = truth_joins.select("name", "logical").distinct().join(found.withColumn("hit", F.lit(1)), ["name", "logical"], "left").agg(F.count(F.lit(1)).alias("asked"), F.count("hit").alias("met"))
    one = right.join(F.broadcast(total)).join(F.broadcast(wrong)).join(F.broadcast(linked)).join(F.broadcast(recalled))  # five tables of one row
    share = lambda a, b, digits=1: F.when(F.col(b) > 0, F.round(100 * F.col(a) / F.col(b), digits))
    return one.select(
        share("correct", "total").alias("recovered"), share("correct", "surviving").alias("recovered_of_surviving"), share("good", "made").alias("link_precision"), share("met", "asked").alias("link_recall"),
        share("false", "noise", 2).alias("false_positives"), F.when(F.col("surviving") > 0, F.round(100 * (F.col("surviving") - F.col("correct")) / F.col("surviving"), 1)).alias("false_negatives"),
    )


def truth_joins(owners: DataFrame) -> DataFrame:
    """name, logical: places at which a file goes on elsewhere on the image, both sides surviving."""
    nxt = owners.select("name", (F.col("logical") - 1).alias("logical"), F.col("cluster").alias("next"))
    return owners.join(nxt, ["name", "logical"]).where("next <> cluster + 1").select("name", "logical")


def file_records(files: DataFrame, truth: DataFrame) -> DataFrame:
    """A labelled record per recovered file (file, owner, integrity, class, sha256, type) with the true file (owner,
    sha256, type): whether the class said valid, whether the bytes are exact and the type is right."""
    t = truth.select("owner", F.col("sha256").alias("_sha"), F.col("type").alias("_type"))
    met = files.join(t, "owner", "left")
    return met.select("file", "owner", "integrity", (F.col("class") == "validated").alias("predicted_valid"), F.coalesce(F.col("sha256") == F.col("_sha"), F.lit(False)).alias("exact"), F.coalesce(F.col("type") == F.col("_type"), F.lit(False)).alias("type_ok"))


def mean_metrics(runs: DataFrame, metrics: Sequence[str]) -> DataFrame:
    """metric, mean and n over the runs that have it, a row per metric."""
    long = runs.select(F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("value")) for m in metrics])).alias("x")).select("x.metric", "x.value")
    return long.groupBy("metric").agg(F.round(F.avg("value"), 1).alias("mean"), F.count("value").alias("n"))


def sample_union(sets: Sequence[DataFrame], key: str, order: Sequence[str]) -> DataFrame:
    """Labelled samples of several sources; of samples with one key, such as an image's hash, the latest by `order` of the
    first source that has it."""
    out = None
    for i, rows in enumerate(sets):
        marked = rows.withColumn("_source", F.lit(-i))
        out = marked if out is None else out.unionByName(marked)
    rest = [c for c in out.columns if c not in {key, "_source", *order}]
    best = out.groupBy(key).agg(F.max(F.struct("_source", *order, *rest)).alias("_best"))
    return best.select(key, *[F.col(f"_best.{c}").alias(c) for c in (*order, *rest)])


def folder_overview(incidents: DataFrame, sources: DataFrame) -> DataFrame:
    """Per protected folder (source): incidents, and how many files they name as deleted, modified and corrupted, 0
    without any. incidents: source, deleted, modified, corrupted (arrays of paths)."""
    sums = incidents.groupBy("source").agg(F.count(F.lit(1)).alias("incidents"), *[F.sum(F.size(c)).alias(c) for c in ("deleted", "modified", "corrupted")])
    return sources.select("source").distinct().join(sums, "source", "left").fillna(0, ["incidents", "deleted", "modified", "corrupted"])


def latest_snapshots(snapshots: DataFrame, source: str, order: Sequence[str]) -> DataFrame:
    """The newest complete snapshot of each source."""
    rest = [c for c in snapshots.columns if c not in {source, *order}]
    best = snapshots.where("complete").groupBy(source).agg(F.max(F.struct(*order, *rest)).alias("b"))
    return best.select(source, "b.*")


def recycle_counts(items: DataFrame, scan: str) -> DataFrame:
    """Items of each scan of recycle bins, how many still have their data, and the bytes of these."""
    return items.groupBy(scan).agg(F.count(F.lit(1)).alias("items"), F.count_if("has_data").alias("recoverable"), F.sum(F.when(F.col("has_data"), F.col("size")).otherwise(0)).alias("bytes"))


def level_counts(items: DataFrame, column: str, levels: Sequence[str]) -> DataFrame:
    """How many items have each level, levels without any included, in the order given."""
    names = items.sparkSession.createDataFrame([(i, x) for i, x in enumerate(levels)], "place int, level string")
    counts = items.groupBy(F.col(column).alias("level")).agg(F.count(F.lit(1)).alias("n"))
    return names.join(counts, "level", "left").select("level", F.coalesce("n", F.lit(0)).alias("n"), "place").orderBy("place").drop("place")


def default_pick(files: DataFrame) -> DataFrame:
    """The file that a first view shows: with gaps before others, then the most fragments, then priority, a report of one."""
    return files.orderBy(F.desc(F.col("gaps") > 0), F.desc("fragments"), F.desc("priority"), "file").limit(1)


def weight_total(weights: Column) -> Column:
    """Sum of a map of weights."""
    return F.aggregate(F.map_values(weights), F.lit(0.0), lambda s, w: s + w)


def decisions(recommendations: DataFrame, log: DataFrame) -> DataFrame:
    """State of each recommendation (id) by the log of decisions (id, at, decision): pending without one, else what the
    last one says."""
    last = log.groupBy("id").agg(F.max(F.struct("at", "decision")).alias("l"))
    rank = F.when(F.col("state") == "pending", 0).when(F.col("state") == "failed", 1).when(F.col("state") == "executed", 2).otherwise(3)
    out = recommendations.join(last, "id", "left").withColumn("state", F.coalesce("l.decision", F.lit("pending"))).drop("l")
    return out.withColumn("rank", rank)


def download_gate(files: DataFrame, exports: DataFrame) -> DataFrame:
    """Whether a file (file, security, sha256) may be handed out: blocked if malware was found, changed if the export
    (file, sha256) no longer has the bytes, absent if there is none."""
    e = exports.select("file", F.col("sha256").alias("_sha"))
    state = F.when(F.col("security") == "MALWARE_DETECTED", "blocked").when(F.col("_sha").isNull(), "absent").when(F.col("_sha") != F.col("sha256"), "changed").otherwise("ok")
    return files.join(e, "file", "left").select("file", state.alias("state"))
