"""Hard negatives against all pairs in plain Python."""

import math
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from siftlake.llm import hard_negatives as hn


def brute(rows):
    ready = []
    for vec_id, vector, label in rows:
        if vec_id is None or label is None or vector is None or any(x is None or not math.isfinite(x) for x in vector):
            continue
        vector = np.float32(vector).astype(float).tolist()
        q = [math.floor(256 * x) for x in vector]
        ready.append((vec_id, (label + 1) % 10 if vec_id % 7 == 0 else label, q, vector))
    anchors = {}
    for i, label, q, vector in ready:
        if i % 100 == 0:
            anchors[i] = min(anchors.get(i, (label, vector, q)), (label, vector, q))
    clip = lambda v: min(max(v, -(1 << 63)), (1 << 63) - 1)
    out = []
    for a, (label, _, q) in anchors.items():
        scored = [(clip(sum(x * y for x, y in zip(q, p))), i, other) for i, other, p, _ in ready]
        best = sorted((-s, i) for s, i, other in scored if other == label and i != a)[:5]
        for ps, p in best:
            ps = -ps
            fit = sorted((-s, i) for s, i, other in scored if other != label and 30 * ps <= 100 * s <= 90 * ps)[:10]
            out += [(a, p, k, i, ps, -s) for k, (s, i) in enumerate(fit, 1)]
    return sorted(out)


def run(spark, rows, config=hn.Mining()):
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    frame = frame.select("*", F.lit(1).alias("part"), F.lit("x").alias("score"), F.lit("y").alias("low"), F.lit(3).alias("slot"))
    got = hn.mine(spark, frame, hn.shifted_labels(), F.col("vec_id") % 100 == 0, config)
    return sorted(tuple(r) for r in got.collect())


def vectors(n, width, seed, spread=1.0):
    rng = np.random.default_rng(seed)
    means = rng.normal(size=(10, width)) * spread
    out = []
    for i in range(n):
        label = int(rng.integers(10))
        v = means[label] + rng.normal(size=width)
        out.append((i, np.float32(v / np.linalg.norm(v)).tolist(), label))
    return out


def test_equals_all_pairs(spark):
    rows = vectors(900, 16, 1)
    rows += [(2000 + i, rows[5][1], 3) for i in range(40)] + [(3000, [0.0] * 16, 1), (3100, None, 1), (3200, [math.nan] + [0.1] * 15, 1), (3300, [None] + [0.1] * 15, 2)]
    rows += [(3400, [math.inf] * 16, 1), (3401, [0.5] * 5, 1), (3402, [], 2), (3500, [0.5] * 20, None), (None, [0.5] * 16, 2), (3600, [0.25] * 16, 9), (3600, [0.25] * 16, 9), (3600, [0.125] * 16, 4), (-100, [0.3] * 16, 2)]
    random.Random(1).shuffle(rows)
    want = brute(rows)
    assert len(want) > 100
    for config in (hn.Mining(), hn.Mining(chunk_rows=37, block_rows=3), hn.Mining(stages=(1.0,), dense=0.0), hn.Mining(dense=1.0)):
        assert run(spark, rows, config) == want


def test_hot_label_ties_and_few_rows(spark):
    rows = [(i, [1.0, 0.0], 1) for i in range(1, 400)] + [(i, [0.5, 0.1 * (i % 3)], 2) for i in range(400, 700)] + [(0, [1.0, 0.0], 1), (800, [-1.0, 0.5], 1), (900, [1.0, 1.0], 5)]
    assert run(spark, rows) == brute(rows)
    assert run(spark, rows[-1:]) == [] and run(spark, rows[:3]) == []
    huge = [(i, [3e38 if i % 2 else 1e30, -2.0], i % 3) for i in range(0, 300, 10)] + [(i, [9e30, 1e20], i % 3) for i in range(1, 300, 7)]
    assert run(spark, huge) == brute(huge)


def test_empty_table(spark):
    assert run(spark, []) == []


@pytest.mark.parametrize("spread", [0.1, 3.0])
def test_bounds_never_lose_a_pair(spread):
    """Whatever the rotation, each stage keeps all pairs that verification would keep."""
    rows = vectors(700, 24, 4, spread)
    x = np.floor(256 * np.array([v for _, v, _ in rows]))
    labels, ids = np.array([label for *_, label in rows]), np.arange(len(rows))
    rng = np.random.default_rng(2)
    for axes in (np.eye(24), np.linalg.qr(rng.normal(size=(24, 24)))[0], np.linalg.eigh(x.T @ x)[1][:, ::-1]):
        for same, top in ((True, 5), (False, 10)):
            meeting = hn.Meeting(axes, same, top, hn.Mining())
            y, rest = meeting.rotated(x)
            low = np.full((20, 1), 2000) if not same else np.full((20, 1), hn.LEAST)
            high = np.full((20, 1), 30_000) if not same else np.full((20, 1), hn.MOST)
            p, slot, q, v = meeting.best((ids, labels, x, y, rest), (ids[:20], labels[:20], x[:20], y[:20], [r[:20] for r in rest], low, high))
            for a in range(20):
                score = (x @ x[a]).astype(int)
                fit = (labels == labels[a]) & (ids != a) if same else labels != labels[a]
                want = sorted((-score[i], i) for i in ids[fit & (score >= low[a, 0]) & (score <= high[a, 0])])[:top]
                assert [(-s, j) for s, j in zip(v[p == a], q[p == a])] == [(s, i) for s, i in want]


def test_scaling_fills_up_short_vectors():
    x, ok = hn.scaled(pa.array([[0.5, -0.001], [], [1.0, None], [2.0]], pa.list_(pa.float64())), 256)
    assert ok.tolist() == [True, True, False, True] and x.tolist() == [[128.0, -1.0], [0.0, 0.0], [512.0, 0.0]]


def test_blocks_of_every_group_are_not_gathered(spark):
    """a block has a copy in every group, so the join must not be a broadcast, however small the blocks are stored."""
    rows = spark.createDataFrame([(i, i % 3, [float(i % 7), float(i % 5)]) for i in range(300)], "vec_id long, label int, embedding array<float>")
    config = hn.Mining()
    ready = hn.prepared(rows, F.col("label"))
    packed = hn.chunks(ready, config, 4)
    anchors = ready.withColumns({"low": F.array(F.lit(hn.LEAST)), "high": F.array(F.lit(hn.MOST))})
    met = hn.meet(packed, hn.blocks(anchors, config, 300), hn.principal_axes(packed), True, config, 4)
    assert met.count() > 0
    assert "Broadcast" not in met._jdf.queryExecution().executedPlan().toString()
