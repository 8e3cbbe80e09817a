"""Operators that SQL cannot express, against plain Python on small fixtures."""

import random
import re

from pyspark.sql import functions as F

from siftlake.operators import cross, fragment_index, placement, security, similarity
from siftlake.plans import placement as queries
from siftlake.plans.registry import Tables


def in_turn(rows, least=0.5):
    used, won = set(), set()
    for h in sorted({r[0] for r in rows}):
        mine = sorted((not same, -score, tail) for x, tail, score, same in rows if x == h and (score >= least or same) and tail not in used)
        if mine:
            used.add(mine[0][2])
            won.add((h, mine[0][2]))
    return won


def test_tails_go_to_headers_in_turn(spark):
    rng = random.Random(4)
    for _ in range(3):
        rows = [(h, t, rng.choice([0.3, 0.5, 0.75, 1.0]), False) for h in range(30) for t in rng.sample(range(100, 125), 6)]
        rows += [(h, h + 1000, 1.0, True) for h in range(0, 30, 9)]
        got = placement.match_in_turn(spark.createDataFrame(rows, "header long, tail long, score double, same boolean"))
        assert {(r["header"], r["tail"]) for r in got.collect()} == in_turn(rows)
    assert placement.match_in_turn(spark.createDataFrame([], "header long, tail long, score double, same boolean")).count() == 0


def test_tails_of_the_query(spark):
    scores = [(r["header"], r["tail"], r["score"], r["same"]) for r in queries._scores(Tables(spark, "/root/testdata/sf0.001")).collect()]
    got = {(r["header"], r["tail"]) for r in placement.match_in_turn(queries._scores(Tables(spark, "/root/testdata/sf0.001"))).collect()}
    assert got == in_turn(scores) and len(got) > 50


def test_nearest_equals_all_pairs(spark):
    rng = random.Random(2)
    targets = [(i, rng.randrange(3), rng.randrange(100)) for i in range(40)] + [(99, 7, 5)]
    pool = [(100 + i, rng.randrange(3), rng.randrange(100)) for i in range(30)]
    a, b = spark.createDataFrame(targets, "target int, g int, size long"), spark.createDataFrame(pool, "item int, g int, size long")
    got = {r["target"]: (r["item"], r["off"]) for r in placement.nearest(a, b, ["g"], "size", "item").collect()}
    for t, g, s in targets:
        low, high = [(s - z, i) for i, h, z in pool if h == g and z <= s], [(z - s, i) for i, h, z in pool if h == g and z >= s]
        best = min([(d, min(i for e, i in side if e == d)) for side in (low, high) if side for d in [min(side)[0]]], default=(None, None))
        assert got[t] == (best[1], best[0])


def test_database_values_in_other_files(spark):
    bases = [("db1", "Rows Ann Lee AB-12 x Bob Ray"), ("db2", "none here")]
    texts = [("t1", "met Ann Lee, and AB-12 too"), ("t2", "only Ann Lee"), ("t3", "XAnn LeeX and AB-123 and Bob Ray"), ("t4", None), ("db1", "Ann Lee AB-12")]
    frames = spark.createDataFrame(bases, "file string, text string"), spark.createDataFrame(texts, "file string, text string")
    got = {(r["a"], r["b"]): (r["hits"], r["confidence"]) for r in cross.database_links(*frames).collect()}
    want = {}
    for a, x in bases:
        values = set(re.findall(r"\b[A-Z][a-z]+ [A-Z][a-z]+\b|\b[A-Z]{2,}-\d{2,}\b", x))
        for b, y in texts:
            n = sum(v in (y or "") for v in values if len(v) >= 5)
            if a != b and n >= 2:
                want[a, b] = (min(n, 5), round(min(0.7, 0.35 + 0.08 * min(n, 5)), 6))
    assert got == want and want


def test_embedded_executables(spark):
    pe = b"MZ" + bytes(58) + (0x80).to_bytes(4, "little") + bytes(0x80 - 64) + b"PE\0\0" + bytes(20)
    elf = b"\x7fELF\x02\x01\x01" + bytes(9)
    rows = [(1, pe), (2, b"junk MZ " + pe + b" MZ"), (3, elf + b"xx" + elf), (4, b""), (5, b"MZ" + bytes(10)), (6, b"\x7fELF\x09\x01\x01"), (7, pe * 12)]
    frame = spark.createDataFrame([(k, bytearray(d)) for k, d in rows], "file long, data binary")
    got = {}
    for r in security.embedded_executables(frame, "file", "data").orderBy("file", "offset").collect():
        got.setdefault(r["file"], []).append((r["format"], r["offset"]))
    assert got[1] == [("PE", 0)] and got[2] == [("PE", 8)] and got[3] == [("ELF", 0), ("ELF", len(elf) + 2)]
    assert set(got) == {1, 2, 3, 7} and len(got[7]) == 8
    hits = frame.select("file", F.explode(security.rule_hits(F.col("data"), security.RULES + security.signature_rules("TEST-MARK"))).alias("r")).select("file", "r.rule").collect()
    assert {(1, "pe_executable"), (3, "elf_executable")} <= {tuple(x) for x in hits}


def test_vectors_without_rows_and_by_batches(spark):
    none = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert similarity.pca_map(none, "vec_id", "embedding").count() == 0 and fragment_index.nearest(none, none, k=3).count() == 0
    rng = random.Random(6)
    rows = [(i, [rng.uniform(-1, 1) for _ in range(8)]) for i in range(300)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>").coalesce(1)
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 37)
    try:
        got = {(r["query_id"], r["rank"]): r["vec_id"] for r in fragment_index.nearest(frame, frame.where("vec_id < 20"), k=5, block=7).collect()}
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)

    def cosine(a, b):
        return round(sum(x * y for x, y in zip(a, b)) / (sum(x * x for x in a) * sum(y * y for y in b)) ** 0.5, 6)

    for q, v in rows[:20]:
        want = sorted(((-cosine(v, w), i) for i, w in rows if i != q))[:5]
        assert [got[q, k + 1] for k in range(5)] == [i for _, i in want]
