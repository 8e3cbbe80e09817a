"""Entropy balancing against a plain bisection of the dual, and the mix it gives."""

import math
import random

import pytest
from pyspark.sql import functions as F

from siftlake.llm import mixing

SCHEMA = "doc_id long, text string, source string, _mix_id int, u int, `row` string, size string, copies int"


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(21)
    out = []
    for i in range(300):
        source = rng.choice(["b", "b", "b", "b", "b", "a", "c", "d", None])
        words = " ".join(f"w{rng.randrange(99)}" for _ in range(rng.choice([0, 1, 5, 20, 60, 400])))
        out.append((i if i % 7 else None, words if i % 11 else None, source, 1, 2, "r", "s", 3))
    out.append((1000, "long " * 3000, "a", 1, 2, "r", "s", 3))
    out += [(1001, "same text of six words here", "c", 1, 2, "r", "s", 3)] * 4
    out += [(1002, "", "empty", 1, 2, "r", "s", 3)]
    return out


def water_level(sizes, weights, share, cap):
    want, full = {}, set()
    while True:
        left = share * sum(sizes.values()) - sum(cap * sizes[s] for s in full)
        total = sum(weights[s] for s in sizes if s not in full)
        want = {s: cap * sizes[s] if s in full else left * weights[s] / total for s in sizes}
        over = {s for s in sizes if s not in full and want[s] > cap * sizes[s]}
        if not over:
            return want
        full |= over


def rates(sizes, target, cap):
    """exp(l * size), at most cap, with l found by bisection."""
    at = lambda l: [min(cap, math.exp(min(l * s, 50))) for s in sizes]
    low, high = -100.0, 100.0
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if sum(r * s for r, s in zip(at(mid), sizes)) < target else (low, mid)
    return at(low)


def test_rates_solve_the_dual_and_copies_meet_targets(spark, rows):
    docs = spark.createDataFrame(rows, SCHEMA)
    got = mixing.mix_plan(docs).collect()
    assert len(got) == len(rows)
    sizes = {}
    for r in got:
        sizes[r["source"]] = sizes.get(r["source"], 0) + r["size"]
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    want = water_level(sizes, {s: (3, 1, 2)[i % 3] for i, s in enumerate(order)}, 1.5, 2.0)
    shrunk = 0
    for s in order:
        own = [r for r in got if r["source"] == s]
        assert all(abs(r["target"] - want[s]) < 1e-6 and r["source_size"] == sizes[s] and 0 <= r["copies"] <= 2 for r in own)
        if sizes[s]:
            filled = want[s] > 2 * sizes[s] * (1 - 1e-9)
            best = [2.0] * len(own) if filled else rates([r["size"] for r in own], want[s], 2.0)
            assert all(abs(r["rate"] - x) < 1e-3 for r, x in zip(own, best))
            assert all(math.floor(r["rate"]) <= r["copies"] <= math.floor(r["rate"]) + 1 for r in own)
            shrunk += want[s] < sizes[s] and len({round(r["rate"], 6) for r in own}) > 2
        taken = sum(r["copies"] * r["size"] for r in own)
        assert taken <= want[s] * (1 + 1e-6) and want[s] - taken <= max(r["size"] for r in own)
    assert shrunk  # rates differ within a source
    again = mixing.mix_plan(docs.orderBy(F.rand(3))).collect()
    assert sorted(map(str, got)) == sorted(map(str, again))
    same = {r["copies"] for r in got if r["doc_id"] == 1001}
    assert len(same) == 1
    mixed = mixing.mix(docs)
    assert mixed.columns == docs.columns and mixed.count() == sum(r["copies"] for r in got)
    words = {r["source"]: r["n"] for r in mixed.groupBy("source").agg(F.sum(F.size(F.filter(F.split("text", r"[ ]+"), lambda x: x != ""))).alias("n")).collect()}
    for s in order:
        assert words.get(s) in (sum(r["copies"] * r["size"] for r in got if r["source"] == s), None)


def test_no_rows(spark, rows):
    docs = spark.createDataFrame(rows, SCHEMA).where("false")
    assert mixing.mix_plan(docs).count() == 0 and mixing.mix(docs).count() == 0 and mixing.targets_of(docs).count() == 0
