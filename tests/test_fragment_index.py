"""The index of vectors gives what all pairs give; fingerprints and hints against plain Python."""

import math

import numpy as np
from pyspark.sql import functions as F

from siftlake.operators import fragment_index as I


def _all_pairs(vectors, queries, k):
    usable = {i: np.array(v, float) / np.linalg.norm(v) for i, v in vectors if v is not None and np.isfinite(v).all() and any(v)}
    out = set()
    for q in queries:
        if q in usable:
            scored = sorted((-round(float(usable[q] @ usable[i]), 6), i) for i in usable if i != q)
            out |= {(q, i, rank) for rank, (_, i) in enumerate(scored[:k], 1)}
    return out


def test_index_equals_all_pairs(spark):
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(6, 8)) * 3
    rows = [(i, (centres[i % 6] + rng.normal(size=8) * (0.05 if i % 2 else 1)).tolist()) for i in range(600)]
    rows += [(1000 + i, rows[7][1]) for i in range(200)]  # a group of copies
    rows += [(2000, [0.0] * 8), (2001, None), (2002, [math.nan] + [1.0] * 7)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    found = I.nearest(frame, frame.where("vec_id % 20 = 0"), k=5, block=16, pivots=5, sample=64)
    got = {(r["query_id"], r["vec_id"], r["rank"]) for r in found.collect()}
    assert got == _all_pairs(rows, [i for i, _ in rows if i % 20 == 0], 5)


def test_few_vectors_and_none(spark):
    frame = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0]), (3, [2.0, 0.0])], "vec_id long, embedding array<double>")
    got = sorted((r["query_id"], r["vec_id"], r["cosine"], r["rank"]) for r in I.nearest(frame, frame, k=5).collect())
    assert got == [(1, 2, 0.0, 2), (1, 3, 1.0, 1), (2, 1, 0.0, 1), (2, 3, 0.0, 2), (3, 1, 1.0, 1), (3, 2, 0.0, 2)]
    assert I.nearest(frame.where("vec_id > 9"), frame, k=5).count() == 0
    assert I.nearest(frame, frame.where("vec_id > 9"), k=5).count() == 0


def test_rings_that_cannot_matter_are_left_out():
    rng = np.random.default_rng(1)
    x = np.concatenate([rng.normal(size=(50, 4)) * 0.01 + c for c in np.eye(4)])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    pivots = I.fit_pivots(x, 4)
    d = I.distances(x, pivots)
    to = I.reachable(d, np.full(len(x), 0.05))
    assert (to.any(2).sum(1) == 1).all()
    inside = np.linalg.norm(x[:, None] - x[None], axis=2) <= 0.05
    ring, own = (d.min(1) * I.RINGS).astype(int), d.argmin(1)
    assert all(to[q, own[i], ring[i]] for q, i in zip(*np.nonzero(inside)))


def test_fingerprints(spark):
    rows = [(1, bytearray(b"aab\n"), "x"), (2, bytearray(range(256)), None), (3, bytearray(), "x"), (4, None, "x")]
    prints = I.fingerprints(spark.createDataFrame(rows, "id long, data binary, family string"), "id", "data")
    got = {r["id"]: r for r in prints.collect()}
    assert set(got) == {1, 2} and got[2]["random"] and not got[1]["random"]
    assert got[1]["entropy"] == 1.5 and got[2]["entropy"] == 8 and got[1]["printable"] == 1 and got[2]["printable"] == 98 / 256
    assert math.isclose(got[1]["vector"][97] ** 2, 0.5) and math.isclose(sum(x * x for x in got[2]["vector"]), 1)


def test_labels_use_entropy_and_family(spark):
    text, noise = b"abcd" * 50, bytes(range(256)) * 4
    rows = [(0, text, "t"), (1, text[::-1], "t"), (2, text + b"abcd", "u"), (3, noise, "n"), (4, noise[::-1], "n")]
    prints = I.fingerprints(spark.createDataFrame([(i, bytearray(d), f) for i, d, f in rows], "id long, data binary, family string"), "id", "data")
    got = {(r["query_id"], r["vec_id"]): r["label"] for r in I.similar(prints, prints, k=4, id_col="id", family="family").collect()}
    assert got[0, 1] == "STRONG" and got[0, 2] == "POSSIBLE" and got[3, 4] == "WEAK" and got[0, 3] == "NONE"


def test_structural_hints(spark):
    schema = "objects array<int>, members array<string>, ts_first string, ts_last string"
    cases = [
        (([3, 4], None, None, None), ([6, 9], None, None, None), "objects"),
        (([3, 4], None, None, None), ([8], None, None, None), None),
        ((None, ["a", "b"], None, None), (None, ["b"], None, None), "members"),
        ((None, None, "2024-01-01 08:00:00", "2024-01-01 09:00:00"), (None, [], "2024-01-01 09:00:00", "2024-01-01 10:00:00"), "times"),
        ((None, None, None, "2024-01-01 09:00:00"), (None, None, "2024-01-02 09:00:00", None), None),
    ]
    frame = spark.createDataFrame([(i, a, b) for i, (a, b, _) in enumerate(cases)], f"i int, a struct<{schema.replace(' array', ':array').replace(' string', ':string')}>, b struct<{schema.replace(' array', ':array').replace(' string', ':string')}>")
    got = {r["i"]: r["h"] for r in frame.select("i", I.structural_hint(F.col("a"), F.col("b")).alias("h")).collect()}
    assert [got[i] for i in range(len(cases))] == [h for *_, h in cases]
