"""Sources: raw storage images as clusters, folders of files, index records of deleted items."""

from __future__ import annotations

import os
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..functions import fixed
from ..functions import scalars as S

IMAGE_SCHEMA = "cluster bigint, data binary"
SKIPPED_FOLDERS = (".git", "node_modules", "__pycache__", ".venv")


class ImageRange(InputPartition):
    def __init__(self, first: int, last: int):
        self.first, self.last = first, last


class ImageReader(DataSourceReader):
    """Reads byte ranges of one image, each partition its own; the last cluster is filled up with zeros."""

    def __init__(self, options: dict[str, str]):
        self.path = options["path"].removeprefix("file://")
        self.size = int(options.get("clustersize", fixed.CLUSTER))
        self.per = int(options.get("clustersperpartition", 4096))

    def partitions(self) -> list[ImageRange]:
        n = -(-os.path.getsize(self.path) // self.size)
        return [ImageRange(a, min(n, a + self.per)) for a in range(0, n, self.per)] or [ImageRange(0, 0)]

    def read(self, part: ImageRange) -> Iterator[tuple[int, bytes]]:
        with open(self.path, "rb") as image:
            image.seek(part.first * self.size)
            for cluster in range(part.first, part.last):
                yield cluster, image.read(self.size).ljust(self.size, b"\0")


class ImageSource(DataSource):
    """spark.read.format("rawimage").load(path): a row per cluster of a raw image that all executors can open."""

    @classmethod
    def name(cls) -> str:
        return "rawimage"

    def schema(self) -> str:
        return IMAGE_SCHEMA

    def reader(self, schema) -> ImageReader:  # noqa: ANN001
        return ImageReader(dict(self.options))


def read_image(spark: SparkSession, path: str, cluster: int = fixed.CLUSTER) -> DataFrame:
    """(cluster, data) of an image of any size."""
    spark.dataSource.register(ImageSource)
    return spark.read.format("rawimage").option("clusterSize", cluster).load(path)


def image_of(files: DataFrame, content: str = "content", cluster: int = fixed.CLUSTER) -> DataFrame:
    """(path, cluster, data) of images that Spark's binaryFile source has read, for stores only Spark can open."""
    n = F.ceil(F.octet_length(content) / cluster)
    rows = files.where(F.octet_length(content) > 0).select("path", content, F.explode(F.sequence(F.lit(0).cast("long"), n - 1)).alias("cluster"))
    data = F.rpad(F.substring(content, (F.col("cluster") * cluster + 1).cast("int"), F.lit(cluster)), F.lit(cluster), F.lit(b"\0"))
    return rows.select("path", "cluster", data.alias("data"))


def read_range(clusters: DataFrame, offset: int, length: int, cluster: int = fixed.CLUSTER) -> Column | DataFrame:
    """One row with the bytes [offset, offset + length) of an image; only the clusters that hold them are kept."""
    first, last = offset // cluster, (offset + max(length, 1) - 1) // cluster
    part = clusters.where(F.col("cluster").between(first, last))
    whole = part.agg(F.array_sort(F.collect_list(F.struct("cluster", "data"))).alias("c"))
    hexes = F.array_join(F.transform("c", lambda x: F.hex(x["data"])), "")
    return whole.select(F.unhex(F.substring(hexes, 2 * (offset - first * cluster) + 1, 2 * length)).alias("data"))


def read_folder(spark: SparkSession, path: str) -> DataFrame:
    """(rel_path, size, mtime, sha256) of every file below a folder, hidden and tool folders left out; whole files are
    hashed."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    root = path if "://" in path else "file:" + os.path.abspath(path)
    rel = F.regexp_replace(F.regexp_replace("path", "^file:/*", "/"), "^" + root.replace("file:", "").rstrip("/") + "/", "")
    out = files.select(rel.alias("rel_path"), F.col("length").alias("size"), F.col("modificationTime").alias("mtime"), F.sha2("content", 256).alias("sha256"))
    hidden = "|".join([r"(^|/)\.[^/]*", *[rf"(^|/){x}(/|$)" for x in SKIPPED_FOLDERS]])
    return out.where(~F.rlike("rel_path", F.lit(hidden)))


def parse_deletion_records(files: DataFrame, content: str = "content") -> DataFrame:
    """Index records of deleted items (versions 1 and 2): original_path, deleted_at, size, or an error."""
    data = F.col(content)
    version = S.little_endian(data, 0, 8)
    v1 = F.decode(F.substring(data, F.lit(25), F.octet_length(content)), "UTF-16LE")
    v2 = F.decode(F.substring(data, F.lit(29), F.octet_length(content)), "UTF-16LE")
    path = F.regexp_replace(F.when(version == 1, v1).when(version == 2, v2), "\x00.*$", "")
    ok = (F.octet_length(content) >= 24) & version.isin(1, 2)
    return files.select(
        "path",
        F.when(ok, path).alias("original_path"),
        F.when(ok, S.filetime(S.little_endian(data, 16, 8))).alias("deleted_at"),
        F.when(ok, S.little_endian(data, 8, 8)).alias("size"),
        F.when(~ok, "not an index record").alias("error"),
    )


def deleted_items(files: DataFrame) -> DataFrame:
    """Index records ($I...) joined to their data ($R...) by the rest of the name; latest first."""
    name = F.element_at(F.split("path", "/"), -1)
    named = files.withColumn("name", name).withColumn("folder", F.regexp_replace("path", "/[^/]*$", ""))
    index = parse_deletion_records(named.where(F.startswith("name", F.lit("$I")))).withColumn("key", F.regexp_replace("path", r"\$I([^/]*)$", r"\$R$1"))
    data = named.where(F.startswith("name", F.lit("$R"))).select(F.col("path").alias("key"), F.col("length").alias("data_size"))
    out = index.join(data, "key", "left").withColumn("has_data", F.col("data_size").isNotNull())
    return out.drop("key").orderBy(F.desc("deleted_at"), "path")
