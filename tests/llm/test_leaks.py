"""Leaks against a plain table of edit distances; word ends; clashing names."""

import random
import re

from siftlake.llm import decontamination, quality_gam


def least_distance(item, text):
    """Least edit distance of the item to any part of the text."""
    row = [0] * (len(text) + 1)
    for i, x in enumerate(item, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(text, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return min(row)


def plain(text):
    words = " ".join(re.findall(r"[a-z0-9]+", (text or "").lower()))
    return f" {words} " if words else ""


def test_leaks_equal_brute_force(spark):
    rng = random.Random(12)
    word = lambda: rng.choice(["ab", "abc", "bca", "cab", "aa", "c", "bb", "a1"])
    items = [(i, " ".join(word() for _ in range(rng.choice([1, 2, 6, 12, 20])))) for i in range(12)] + [(50, None), (51, "?!"), (0, "ab abc")]
    rows = []
    for i in range(60):
        part = list(rng.choice(items[:12])[1])
        for _ in range(rng.randrange(4)):
            k = rng.randrange(len(part))
            part[k : k + 1] = rng.choice([[], ["c"], [part[k], "b"]]) or ["a"]
        rows.append((i, " ".join(word() for _ in range(rng.randrange(12))) + ", " + "".join(part) + ". " + " ".join(word() for _ in range(rng.randrange(9))), "x", "y"))
    rows += [(70, None, "x", "y"), (71, "", "x", "y"), (None, rows[0][1], "x", "y")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, _text string, _leaks string")
    got = {r["doc_id"]: sorted((x["item_id"], x["distance"]) for x in r["leaks"]) for r in decontamination.find_leaks(docs, spark.createDataFrame(items, "item_id long, text string"), shard_bytes=90).collect()}
    for doc_id, text, *_ in rows:
        want = []
        for item_id, item in items:
            p = plain(item)
            if p and (d := least_distance(p, plain(text))) <= int((len(p) - 2) * decontamination.ERROR_RATE) and text:
                want.append((item_id, d))
        assert got[doc_id] == sorted(want), (doc_id, text)


def test_short_items_are_whole_words_and_names_may_clash(spark):
    docs = spark.createDataFrame([(1, "alpha beta gamma", 1, 2), (2, "this is a test", 1, 2)], "doc_id long, text string, _text int, _leaks int")
    items = spark.createDataFrame([(1, "a")], "item_id long, text string")
    kept = decontamination.drop_leaks(docs, items)
    assert kept.columns == docs.columns and [r["doc_id"] for r in kept.collect()] == [1]
    model = quality_gam.fit(*(lambda x: (x, x[:, 0]))(__import__("numpy").eye(2, len(quality_gam.FEATURES))))
    assert quality_gam.score(docs, model, keep=("text", "_text", "_leaks")).count() == 2
