"""Streams and their batch forms agree; a monitor reports each loss once."""

from pyspark.sql import functions as F

from siftlake.sources import images
from siftlake.streaming import monitor as M

EVENTS = "/root/testdata/sf0.001/events.parquet"


def test_windows_in_stream_equal_batch(spark, tmp_path):
    source = tmp_path / "events"
    spark.read.parquet(EVENTS).write.parquet(str(source))
    stream = M.windowed_counts(M.event_stream(spark, str(source)), late="3650 days")
    query = stream.writeStream.format("memory").queryName("w").outputMode("complete").trigger(availableNow=True).start()
    query.awaitTermination(120)
    got = {(r["start"], r["event_type"]): r["n"] for r in spark.table("w").collect()}
    batch = spark.read.parquet(EVENTS).withColumn("ts", F.col("ts").cast("timestamp"))
    want = {(r["start"], r["event_type"]): r["n"] for r in M.windowed_counts(batch).collect()}
    assert got == want and got


def test_monitor_reports_once(spark, tmp_path):
    folder, state = tmp_path / "watched", tmp_path / "state"
    (folder / "sub").mkdir(parents=True)
    for name in ("a.txt", "b.txt", "sub/c.txt"):
        (folder / name).write_text(name * 10)
    (folder / ".hidden").write_text("x")
    m = M.FolderMonitor(spark, str(folder), str(state))
    m.set_baseline()
    assert m.scan(0).count() == 0
    (folder / "a.txt").unlink()
    (folder / "b.txt").write_text("other")
    found = {r["rel_path"]: r["change"] for r in m.scan(1).collect()}
    assert found == {"a.txt": "deleted", "b.txt": "modified"}
    again = m.scan(1)  # the batch runs once more
    assert {r["rel_path"]: r["change"] for r in again.collect()} == found
    bad = spark.createDataFrame([("b.txt",), ("never.txt",)], "rel_path string")
    assert [(r["deleted"], r["modified"], r["corrupted"], r["severity"]) for r in m.incident(again, bad).collect()] == [(1, 1, 1, "HIGH")]
    assert m.scan(2).count() == 0
    (folder / "sub/c.txt").unlink()
    ticks = tmp_path / "ticks"
    spark.range(3).write.parquet(str(ticks))
    query = m.start(spark.readStream.schema("id long").parquet(str(ticks)), str(tmp_path / "cp"), once=True)
    query.awaitTermination(120)
    incidents = spark.read.parquet(f"{state}/incidents").collect()
    assert [(r["deleted"], r["severity"]) for r in incidents] == [(1, "MEDIUM")]


def test_deletion_records(spark, tmp_path):
    import struct

    name = "C:\\work\\plan.docx"
    v2 = struct.pack("<QQQI", 2, 1234, 133_500_000_000_000_000, len(name) + 1) + (name + "\0").encode("utf-16-le")
    (tmp_path / "$IABC.docx").write_bytes(v2)
    (tmp_path / "$RABC.docx").write_bytes(b"data")
    (tmp_path / "$IBAD.txt").write_bytes(b"no")
    rows = {r["path"][-10:]: r for r in images.deleted_items(spark.read.format("binaryFile").load(str(tmp_path))).collect()}
    good, bad = rows["$IABC.docx"], rows["/$IBAD.txt"]
    assert (good["original_path"], good["size"], good["has_data"]) == (name, 1234, True)
    assert good["deleted_at"].year == 2024 and bad["error"] and bad["original_path"] is None
