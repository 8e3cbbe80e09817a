"""The folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Uses spark.checkpoint.dir; sets a folder of this machine only where neither it nor a checkpoint folder is set and
    the session runs on this machine alone (tests). Elsewhere executors would not see such a folder."""
    if spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext._jsc.sc().getCheckpointDir().isDefined():
        return
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    spark.sparkContext.setCheckpointDir("file://" + tempfile.mkdtemp(prefix="siftlake-"))


class SharedTables:
    """Tables of a loop, written to the shared folder and read back; the one before is removed when the next is there."""

    def __init__(self, spark: SparkSession, name: str):
        ensure_checkpoint_dir(spark)
        root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext._jsc.sc().getCheckpointDir().get()
        self.spark, self.root, self.turn = spark, f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}", 0

    def save(self, df: DataFrame) -> DataFrame:
        schema, self.turn = df.schema, self.turn + 1
        df.write.parquet(f"{self.root}/{self.turn}")
        context = self.spark.sparkContext
        old = context._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{self.turn - 1}")
        old.getFileSystem(context._jsc.hadoopConfiguration()).delete(old, True)
        return self.spark.read.schema(schema).parquet(f"{self.root}/{self.turn}")
