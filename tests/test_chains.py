"""Chains chosen in rounds against the choice of one edge after another."""

import random

from siftlake.operators import chains


def in_turn(edges, threshold):
    """Edges by falling confidence, then src and dst; with the head of their chain and the place in it."""
    nxt, taken, out = {}, set(), set()
    for c, s, d in sorted(edges, key=lambda e: (-e[0], e[1], e[2])):
        end = d
        while end in nxt:
            end = nxt[end]
        if c >= threshold and s != d and s not in nxt and d not in taken and end != s:
            nxt[s] = d
            taken.add(d)
    for head in set(nxt) - taken:
        at, k = head, 0
        while at in nxt:
            out.add((at, nxt[at], k, head))
            at, k = nxt[at], k + 1
    return out


def test_rounds_choose_what_turns_choose(spark):
    rng = random.Random(14)
    groups = {"ring": [(0.5, "a", "b"), (0.9, "b", "a"), (0.95, "b", "c"), (0.99, "z", "c")], "pair": [(0.4, "a", "b"), (0.4, "b", "a"), (0.4, "a", "a")], "low": [(0.1, "a", "b")]}
    groups["path"] = [(i / 200, f"n{i:03d}", f"n{i + 1:03d}") for i in range(60, 100)]
    groups["wheel"] = [(0.5 + (i * 7 % 11) / 100, f"w{i}", f"w{(i + 1) % 12}") for i in range(12)]
    for g in range(12):
        names = [f"f{i:02d}" for i in range(rng.randrange(3, 26))]
        groups[f"g{g}"] = [(rng.choice([0.2, 0.3, rng.random()]), rng.choice(names), rng.choice(names)) for _ in range(rng.randrange(5, 120))]
    rows = [(g, s, d, c) for g, edges in groups.items() for c, s, d in edges]
    found = chains.greedy_chains(spark.createDataFrame(rows, "grp string, src string, dst string, confidence double"), "grp", 0.25).collect()
    for g, edges in groups.items():
        best = {}
        for c, s, d in edges:
            best[s, d] = max(c, best.get((s, d), c))
        want = in_turn([(c, s, d) for (s, d), c in best.items()], 0.25)
        assert {(r["src"], r["dst"], r["position"], r["head"]) for r in found if r["grp"] == g} == want, g


def test_no_edges(spark):
    assert chains.greedy_chains(spark.createDataFrame([], "grp string, src string, dst string, confidence double"), "grp", 0.0).count() == 0
