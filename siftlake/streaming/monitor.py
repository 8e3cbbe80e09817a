"""Streaming: windows over events, a monitor of changing folders that reports each loss once, an append-only audit."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions import scalars as S
from ..operators.relational import snapshot_diff
from ..sources.images import read_folder


def event_stream(spark: SparkSession, path: str) -> DataFrame:
    """Files of events as a stream; the event time becomes a timestamp, as watermarks need."""
    schema = spark.read.parquet(path).schema
    return spark.readStream.schema(schema).parquet(path).withColumn("ts", F.col("ts").cast("timestamp"))


def windowed_counts(events: DataFrame, *, width: str = "1 hour", slide: str | None = None, late: str = "1 day") -> DataFrame:
    """Counts and sums per event type in tumbling or sliding windows; events later than the watermark are left out."""
    w = F.window("ts", width, slide) if slide else F.window("ts", width)
    counted = events.withWatermark("ts", late).groupBy(w.alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))
    return counted.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), "event_type", "n", "total")


def sessions(events: DataFrame, *, gap: str = "30 minutes", late: str = "1 day") -> DataFrame:
    w = F.session_window("ts", gap)
    out = events.withWatermark("ts", late).groupBy("user_id", w.alias("w")).agg(F.count(F.lit(1)).alias("n"))
    return out.select("user_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


class FolderMonitor:
    """Compares a folder with a baseline manifest at each trigger. Tables in `state` (a shared folder) hold what was
    reported, so a loss is reported once; a new baseline starts afresh."""

    def __init__(self, spark: SparkSession, folder: str, state: str):
        self.spark, self.folder, self.state = spark, folder, state.rstrip("/")

    def set_baseline(self) -> None:
        read_folder(self.spark, self.folder).write.mode("overwrite").parquet(f"{self.state}/baseline")
        self.spark.createDataFrame([], "rel_path string, change string").write.mode("overwrite").parquet(f"{self.state}/reported/batch=-1")

    def scan(self, batch: int = 0) -> DataFrame:
        """Changes that no other batch has reported; they count as reported from now on. A batch that runs again, after a
        failure, finds and writes what it found before."""
        old = self.spark.read.parquet(f"{self.state}/baseline")
        diff = snapshot_diff(old, read_folder(self.spark, self.folder), "rel_path", "sha256").where("change <> 'unchanged'")
        told = self.spark.read.parquet(f"{self.state}/reported").where(F.col("batch") != batch).select("rel_path", "change")
        fresh = diff.join(told, ["rel_path", "change"], "left_anti").select("rel_path", "change")
        path = f"{self.state}/reported/batch={batch}"
        fresh.write.mode("overwrite").parquet(path)
        return self.spark.read.schema(fresh.schema).parquet(path)

    def incident(self, found: DataFrame, corrupted: DataFrame | None = None) -> DataFrame:
        """One row with counts and severity if something was lost or three files changed. corrupted: rel_path of changed
        files that no longer pass their validator; these are lost too."""
        n = found.agg(*[F.count_if(F.col("change") == c).alias(c) for c in ("deleted", "new", "modified")])
        bad = corrupted.join(found.where("change = 'modified'"), "rel_path", "left_semi").agg(F.count(F.lit(1)).alias("corrupted")) if corrupted is not None else found.sparkSession.range(1).select(F.lit(0).alias("corrupted"))
        n = n.crossJoin(F.broadcast(bad))  # one row each
        lost = F.col("deleted") + F.col("corrupted")
        rows = n.where((lost > 0) | (F.col("modified") >= 3))
        return rows.withColumn("severity", S.incident_severity(lost, F.col("deleted"), F.col("corrupted"), F.col("modified")))

    def start(self, ticks: DataFrame, checkpoint: str, every: str = "5 seconds", once: bool = False) -> StreamingQuery:
        """Scans at each micro-batch of a stream of ticks; a burst of ticks in one batch gives one scan."""

        def act(batch: DataFrame, number: int) -> None:
            if not batch.isEmpty():
                self.incident(self.scan(number)).write.mode("overwrite").parquet(f"{self.state}/incidents/batch={number}")

        writer = ticks.writeStream.foreachBatch(act).option("checkpointLocation", checkpoint)
        return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime=every)).start()


def append_audit(rows: DataFrame, path: str) -> None:
    rows.write.mode("append").parquet(path)


def audit_after(spark: SparkSession, path: str, after: int) -> DataFrame:
    """Log rows newer than a cursor."""
    return spark.read.parquet(path).where(F.col("id") > after).orderBy("id")
