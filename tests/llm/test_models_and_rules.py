"""Scores and counts against plain Python; repeated rows; clashing names."""

import math
import random

import numpy as np
import zstandard
from pyspark.sql import functions as F

from siftlake.llm import common, compression_rules, line_dedup, mixing, quality_gam, toxicity

VOCAB = [f"{a}{b}" for a in ("stone", "river", "cloud", "green", "éclair") for b in ("", "s", "ing", "ed,", "#")]


def prose(rng, n):
    return " ".join(rng.choice(VOCAB) for _ in range(n))


def test_toxicity_scores_equal_plain_python(spark):
    rng = random.Random(3)
    rows = [(i, prose(rng, rng.choice([1, 3, 6, 40, 900])) + (" foulword muck" if i % 2 else "")) for i in range(60)] + [(60, None), (61, ""), (62, " \n "), (None, "x"), (1, "repeated row"), (1, "repeated row")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("score", F.lit("clash"))
    labels = spark.createDataFrame([(i, i % 2) for i in range(60)] + [(60, None), (77, 1)], "doc_id long, toxic int")
    model = toxicity.train(docs, labels, use=F.col("doc_id") % 3 != 0)

    def word(w):
        flat, n = toxicity.subwords([w])
        assert n[0] == len(flat)
        return model.pull[flat].sum() / (len(flat) + toxicity.PAD)

    def plain(text):
        z = [word(w) for w in (text or "").encode().lower().split()]
        k = min(model.width, len(z))
        best = max((sum(z[i : i + k]) / k for i in range(len(z) - k + 1)), default=0.0) if z else 0.0
        return 1 / (1 + math.exp(-(best + model.bias)))

    got = toxicity.score(docs, model).collect()
    assert len(got) == len(rows)
    by_id = {}
    for r in got:
        by_id.setdefault(r["doc_id"], []).append(r["score"])
    for i, t in rows:
        assert any(abs(s - plain(t)) < 1e-9 for s in by_id[i])
    assert by_id[1].count(max(by_id[1], key=by_id[1].count)) >= 2  # equal rows, equal scores
    held = [(by_id[i][0] >= 0.5) == bool(i % 2) for i in range(60) if i % 3 == 0 and i != 1]
    assert sum(held) / len(held) > 0.8


def test_long_texts_train(spark):
    rng = random.Random(1)
    words = {y: [f"{'dark' if y else 'light'}{chr(97 + k)}" for k in range(20)] for y in (0, 1)}
    rows = [(i, " ".join(rng.choice(words[i % 2]) for _ in range(600))) for i in range(80)]
    docs, labels = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([(i, i % 2) for i in range(80)], "doc_id long, toxic int")
    model = toxicity.train(docs, labels, use=F.col("doc_id") < 40)
    got = {r["doc_id"]: r["score"] for r in toxicity.score(docs, model).collect()}
    assert all((got[i] > 0.7) == bool(i % 2) for i in range(40, 80))


def test_one_insult_in_a_long_text_is_found():
    """All passages of a labelled text train: 120 texts of 3,000 words, half of them with one insult somewhere."""
    rng = random.Random(4)
    vocab = [*VOCAB, *(f"w{i}" for i in range(400))]

    def texts():
        for i in range(120):
            words = [rng.choice(vocab) for _ in range(3_000)]
            if i % 2:
                words[rng.randrange(3_000)] = rng.choice(["foulword", "muckhead", "slimebag"])
            yield " ".join(words).encode()

    labels = np.arange(120) % 2
    model = toxicity.fit(toxicity.Corpus.of([toxicity.numbered(t) for t in texts()], 6), labels)
    for scores in (model.score(list(texts())), model.score(list(texts()))):
        assert ((scores >= 0.7) == (labels == 1)).mean() > 0.97


def test_subwords_do_not_depend_on_neighbours():
    words = [w.encode() for w in ["a", "abc", "(abc)", "überlang", "你好", "***", "x" * 50]]
    flat, n = toxicity.subwords(words)
    parts = np.split(flat, np.cumsum(n)[:-1])
    for w, part in zip(words, parts):
        alone, _ = toxicity.subwords([w])
        assert alone.tolist() == part.tolist()
    assert parts[1].tolist() == parts[2].tolist() and toxicity.subwords([])[0].tolist() == []
    shared = set(toxicity.subwords([b"terrible"])[0]) & set(toxicity.subwords([b"terribble"])[0])
    assert len(shared) >= 4


def plain_gam(model, x):
    z = model.base
    for edges, table, v in zip(model.edges, model.tables, x):
        z += table[sum(e <= v for e in edges)]
    for a, b, table in model.pairs:
        z += table[sum(e <= x[a] for e in model.coarse[a])][sum(e <= x[b] for e in model.coarse[b])]
    return 1 / (1 + math.exp(-z))


def test_quality_scores_equal_plain_python(spark):
    rng = random.Random(8)
    rows = [(i, prose(rng, 40 if i % 2 else 5) + "!" * (i % 5)) for i in range(120)] + [(200, None), (201, ""), (5, "again"), (5, "again")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("_text", F.lit(1)).withColumn("features", F.lit(2))
    labels = spark.createDataFrame([(i, i % 2) for i in range(120)] + [(200, None)], "doc_id long, quality int")
    model = quality_gam.train(docs, labels, use=F.col("doc_id") % 4 != 2)
    got = sorted(((str(r["doc_id"]), r["score"]) for r in quality_gam.score(docs, model).collect()))
    want = sorted((str(i), plain_gam(model, quality_gam.features((t or "").encode()))) for i, t in rows)
    assert [a for a, _ in got] == [a for a, _ in want] and all(abs(x - y) < 1e-9 for (_, x), (_, y) in zip(got, want))


def test_compression_verdicts_equal_plain_python(spark):
    rng = random.Random(5)
    noise = lambda n: "".join(chr(rng.randrange(33, 127)) for _ in range(n))
    rows = [(i, rng.choice([prose(rng, 300), noise(2500), "na na " * 300, prose(rng, 30), prose(rng, 150) + noise(1500), "a#b$c <|> %", ""])) for i in range(80)] + [(None, "x"), (3, None), (90, "é" * 70 + " *" * 30)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("ratio", F.lit("clash"))
    limits, squeeze = compression_rules.Limits(), zstandard.ZstdCompressor(level=3).compress
    want = []
    for i, t in rows:
        data = (t or "").encode()
        words, n = data.split(), len(data)
        ratio = len(squeeze(data)) / n if n else 1.0
        chunks = [data[a : a + 1024] for a in range(0, n, 1024) if n - a >= 512] if n > 1024 else []
        out = sum(not 0.30 <= len(squeeze(c)) / len(c) <= 0.85 for c in chunks)
        low, high = next((lo, hi) for most, lo, hi in limits.bands if n < most)
        seen, hit = {}, set()
        for j in range(len(words) - 7):
            seen.setdefault(tuple(words[j : j + 8]), []).append(j)
        for at in seen.values():
            if len(at) > 1:
                hit |= {j + k for j in at for k in range(8)}
        base = len(words) < 20 or 100 * len(hit) > 30 * len(words)
        kept = not base and low <= ratio <= high and out <= 0.25 * len(chunks)
        symbols = sum((t or "").count(c) for c in "#*$%&|<>")
        want.append((str(i), len(words), sum(len(w.decode()) for w in words), symbols, len(hit), len(chunks), out, base, kept))
    got = [(str(r["doc_id"]), r["n_words"], r["word_chars"], r["n_symbols"], r["n_repeat_words"], r["n_chunks"], r["n_chunks_out"], r["base_failed"], r["kept"]) for r in compression_rules.compression_rules(docs).collect()]
    assert sorted(got) == sorted(want) and {w[-1] for w in want} == {True, False}


def test_repeated_rows_lose_the_same_lines(spark):
    rows = [(1, "alpha beta\nsome line"), (1, "alpha beta\nsome line"), (2, "alpha betz\nother"), (1, "alpha beta\nthird")]
    got = [(r["doc_id"], r["n_equal"], r["n_near"], r["kept_text"]) for r in line_dedup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()]
    assert got.count((1, 0, 0, "alpha beta\nsome line")) in (0, 2) and (2, 0, 1, "other") in got


def test_window_hashes_are_the_polynomial():
    h = np.random.default_rng(4).integers(0, 1 << 63, 300).astype(np.uint64)
    for width in (1, 5, 13, 300, 301):
        want = [sum(int(x) * common._BASE ** (width - 1 - k) for k, x in enumerate(h[i : i + width])) % (1 << 64) for i in range(max(0, len(h) - width + 1))]
        assert common.window_hashes(h, width).tolist() == common.mix64(np.array(want, np.uint64)).tolist()


def test_a_cluster_needs_a_shared_folder(spark):
    assert common.free_name("_a", ["x", "_A"]) == "__a" and common.scratch_root(spark)
    assert mixing.targets_of(spark.createDataFrame([(1, "a b", "s")], "doc_id long, text string, source string")).first()["target"] == 3.0


def test_workers_forget_what_other_operators_remember():
    words = common.worker_words()
    assert words[b"a"] and b"a" in words
    toxicity.known_words(5)[b"x"] = 1.0
    assert not words and toxicity.known_words(5) == {b"x": 1.0}
    common.worker_words()
    assert toxicity.known_words(5) == {}


def test_quality_of_empty_tables_and_very_long_texts(spark):
    model = quality_gam.fit(np.zeros((0, len(quality_gam.FEATURES))), np.zeros(0))
    docs = spark.createDataFrame([(1, "word " * 500_000), (2, None), (2, None)], "doc_id long, text string").withColumn("score", F.lit("clash"))
    got = quality_gam.score(docs, model).collect()
    assert len(got) == 3 and {r["score"] for r in got} == {0.5}
    assert quality_gam.score(docs.where("false"), model).count() == 0
