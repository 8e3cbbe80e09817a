"""Passages: large and null ids, short texts, rows that share an id or are repeated."""

import random

import numpy as np

from siftlake.llm import passage_dedup


def brute(rows):
    key = lambda i: -(1 << 63) if i is None else i
    first = {}
    for i, t in rows:
        w = (t or "").split()
        for j in range(len(w) - 12):
            p = tuple(w[j : j + 13])
            first[p] = min(first.get(p, key(i)), key(i))
    out = []
    for i, t in rows:
        w = (t or "").split()
        gone = [False] * len(w)
        for j in range(len(w) - 12):
            if first[tuple(w[j : j + 13])] < key(i):
                gone[j : j + 13] = [True] * 13
        out.append((str(i), len(w), sum(gone), " ".join(x for x, g in zip(w, gone) if not g)))
    return sorted(out)


def test_large_null_and_repeated_ids(spark):
    rng = random.Random(11)
    text = lambda n: " ".join(f"w{rng.randrange(10**6)}" for _ in range(n))
    same, other, third = text(20), text(40), text(25)
    rows = [(-(1 << 62) - 5, same), (5, same), (1 << 62, same), ((1 << 62) + 7, same), ((1 << 63) - 1, other), (-(1 << 63), other)]
    rows += [(None, third), (None, other + " " + third), (3, third), (7, third), (7, text(5) + " " + third), (7, third), (8, "a b c"), (9, "a b c"), (10, None), (11, " \t "), (12, "a  b\nc " * 4)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((str(r["doc_id"]), r["n_words"], r["n_removed"], r["kept_text"]) for r in passage_dedup.drop_repeats(docs, block_bytes=300, shard_bytes=200).collect())
    assert got == brute(rows)


def test_changes_and_shards():
    a, b = np.array([1, 1, 2, 2], np.uint64), np.array([0, 5, 5, 5], np.uint64)
    assert passage_dedup._changes(a, b).tolist() == [0, 1, 2]
    table = passage_dedup._by_shard(4, 1 << 20, np.array([1 << 20, 2 << 20, 2 << 20], np.uint64))
    assert table.column("shard").to_pylist() == [1, 2] and table.column("block").to_pylist() == [4, 4]
