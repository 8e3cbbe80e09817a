"""Corpus operators against brute force, on small rows with nulls, empty and long texts, ties, repeats and clashing columns."""

import math
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from siftlake.llm import compression_rules, decontamination, html_text, line_dedup, minhash, passage_dedup, quality_gam, token_output, toxicity

VOCAB = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon".split()


def prose(rng, n):
    return " ".join(rng.choice(VOCAB) + str(rng.randrange(40)) for _ in range(n))


@pytest.fixture(scope="session")
def texts():
    rng = random.Random(3)
    base, shared = prose(rng, 220), prose(rng, 60)
    rows = [(1, base), (2, base), (3, None), (4, ""), (5, "   \n\t "), (6, "Two words"), (7, "two WORDS"), (None, base)]
    for i in range(8, 40):
        words = base.split()
        for _ in range(rng.randrange(0, 9)):
            words[rng.randrange(len(words))] = f"new{rng.randrange(999)}"
        rows.append((i, " ".join(words)))
    for i in range(40, 60):
        rows.append((i, prose(rng, rng.randrange(1, 90)) + " " + (shared if i % 3 == 0 else "") + "\n" + prose(rng, 15)))
    rows.append((60, prose(rng, 30_000)))
    rows.append((61, rows[-1][1]))
    return rows


@pytest.fixture(scope="session")
def docs(spark, texts):
    frame = spark.createDataFrame(texts, "doc_id long, text string")
    return frame.select("doc_id", "text", F.lit("en").alias("lang"), F.concat(F.lit("src"), F.col("doc_id") % 3).alias("source"), F.length("text").cast("long").alias("n_chars"), F.lit(1).alias("n"), F.lit("x").alias("keys"), F.lit(2).alias("size"))


@pytest.fixture(scope="session")
def empty(docs):
    return docs.where("false")


def shingle_set(text, k):
    w = (text or "").encode().lower().split()
    return frozenset(tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))) if w else frozenset()


@pytest.mark.parametrize("k,num", [(3, 85), (5, 80)])
def test_minhash_equals_brute_force(docs, texts, empty, k, num):
    ids = [i for i, _ in texts if i is not None]
    sets = {i: shingle_set(t, k) for i, t in texts if i is not None}
    label = {i: i for i in ids}
    for _ in ids:
        for a in ids:
            for b in ids:
                if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= num * len(sets[a] | sets[b]):
                    label[a] = label[b] = min(label[a], label[b])
        if all(label[label[i]] == label[i] for i in ids):
            break
    rows = minhash.near_duplicates(docs, size=k, num=num).collect()
    assert len(rows) == len(texts)
    for r in rows:
        if r["doc_id"] is None:
            assert r["component_id"] is None and r["kept"]
        else:
            assert (r["n_shingles"], r["component_id"], r["kept"]) == (len(sets[r["doc_id"]]), label[r["doc_id"]], label[r["doc_id"]] == r["doc_id"])
    assert minhash.near_duplicates(empty).count() == 0
    kept = minhash.keep_one(docs, size=k, num=num)
    assert kept.columns == docs.columns and kept.count() == sum(r["kept"] for r in rows)


def test_band_keys_and_estimate(spark):
    rng = np.random.default_rng(0)
    a = rng.integers(0, 1 << 63, 600).astype(np.uint64)
    b = np.concatenate([a[:500], rng.integers(0, 1 << 63, 100).astype(np.uint64)])
    factors = minhash.factors_of(60)
    keys = [minhash.registers(minhash.least_by_bucket(np.unique(x), factors)[None]).reshape(-1).tolist() for x in (a, b)]
    guess, count = minhash.estimate(F.col("a"), F.col("b"), F.lit(600), F.lit(600))
    row = spark.createDataFrame([keys], "a array<long>, b array<long>").select(guess.alias("g"), count.alias("c")).first()
    assert row["c"] == 240 and abs(row["g"] - 500 / 700) < 0.1
    assert minhash.registers(np.full((1, 1, 4), 1 << 63, np.uint64)).tolist() == [[-1]]


def test_passages_equal_brute_force(docs, texts, empty):
    smallest = -(1 << 63)
    first = {}
    rows = sorted((smallest if i is None else i, t or "") for i, t in texts)
    for i, t in rows:
        w = t.split()
        for j in range(len(w) - 12):
            first.setdefault(tuple(w[j : j + 13]), i)
    want = {}
    for i, t in rows:
        w = t.split()
        gone = [False] * len(w)
        for j in range(len(w) - 12):
            if first[tuple(w[j : j + 13])] < i:
                gone[j : j + 13] = [True] * 13
        want[None if i == smallest else i] = (len(w), sum(gone), " ".join(x for x, g in zip(w, gone) if not g))
    got = {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept_text"]) for r in passage_dedup.drop_repeats(docs, block_bytes=20_000).collect()}
    assert got == want
    assert passage_dedup.drop_repeats(empty).count() == 0


def test_packed_numbers_survive():
    a, b = np.array([0, 5, 1 << 63], np.uint64), np.array([1, 2, 3], np.uint32)
    x, y = passage_dedup.unpack(passage_dedup.pack(a, b), np.uint64, np.uint32)
    assert x.tolist() == a.tolist() and y.tolist() == b.tolist()


def edit_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def test_lines_equal_brute_force(spark):
    rng = random.Random(5)
    lines = [prose(rng, 6) for _ in range(8)]
    variants = []
    for x in lines:
        for _ in range(6):
            y, j = list(x), rng.randrange(len(x))
            rng.choice([lambda: y.insert(j, "q"), lambda: y.pop(j), lambda: y.__setitem__(j, "ß")])()
            variants.append("".join(y))
            if rng.random() < 0.4:
                variants.append("".join(y)[: rng.randrange(20, len(y))])
    pool = lines + variants + ["short", "shor", "sort", "a", "b", "ab", "é", "", "  ", "\t"]
    rows = [(i, "\n".join(rng.choice(pool) for _ in range(rng.randrange(0, 7)))) for i in range(60)] + [(90, None), (91, ""), (None, lines[0])]
    first, near, want = {}, {}, {}
    order = sorted(rows, key=lambda r: -1 if r[0] is None else r[0])
    for i, t in order:
        for no, x in enumerate(t.split("\n") if t is not None else []):
            if x.strip(" \t\r\v\f"):
                first.setdefault(x, (-1 if i is None else i, no))
    for x, p in first.items():
        near[x] = any(q < p and abs(len(x) - len(y)) <= 1 and edit_distance(x, y) <= 1 for y, q in first.items())
    for i, t in order:
        kept, eq, nr = [], 0, 0
        parts = t.split("\n") if t is not None else []
        for no, x in enumerate(parts):
            if x in first and first[x] != (-1 if i is None else i, no):
                eq += 1
            elif near.get(x):
                nr += 1
            else:
                kept.append(x)
        want[i] = (len(parts), eq, nr, "\n".join(kept))
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("place", F.lit(1)).withColumn("line", F.lit("x"))
    got = {r["doc_id"]: (r["n_lines"], r["n_equal"], r["n_near"], r["kept_text"]) for r in line_dedup.dedup_lines(docs).collect()}
    assert got == want
    assert sum(w[2] for w in want.values()) > 10
    assert line_dedup.dedup_lines(docs.where("false")).count() == 0


def test_leaks_within_budget_only(spark, docs, empty):
    rng = random.Random(8)
    items = [(i, " ".join(rng.choice(VOCAB) for _ in range(30))) for i in range(5)] + [(5, None), (6, " ,. "), (7, "q")]
    rows = []
    for i in range(5):
        text = decontamination.normalise(items[i][1]).strip()
        budget = int(len(text) * decontamination.ERROR_RATE)
        for k, errors in enumerate((0, budget, 3 * budget)):
            y = list(text)
            for p in rng.sample(range(len(y)), errors):
                y[p] = "#" if k < 2 else "0"
            rows.append((10 * i + k, prose(rng, 50) + " -- " + "".join(y).upper() + "! " + prose(rng, 20), errors <= budget))
    frame = spark.createDataFrame([(a, b) for a, b, _ in rows] + [(900, None), (901, "")], "doc_id long, text string").withColumn("leaks", F.lit(1)).withColumn("item_id", F.lit(2))
    bench = spark.createDataFrame(items, "item_id long, text string").where("item_id <> 7")
    got = {r["doc_id"]: r for r in decontamination.leak_report(frame, bench, shard_bytes=400).collect()}
    for doc_id, _, leaked in rows:
        assert got[doc_id]["contaminated"] == leaked and (doc_id // 10 in got[doc_id]["item_ids"]) == leaked
    assert not got[900]["contaminated"] and not got[901]["contaminated"]
    kept = decontamination.drop_leaks(frame, bench)
    assert kept.columns == frame.columns and kept.count() == sum(not x for *_, x in rows) + 2
    assert decontamination.leak_report(frame, bench.where("false")).where("contaminated").count() == 0
    assert decontamination.leak_report(empty, bench).count() == 0


def test_bit_parallel_distance():
    rng = random.Random(1)
    for _ in range(200):
        item = "".join(rng.choice("abc ") for _ in range(rng.randrange(1, 40)))
        window = "".join(rng.choice("abc ") for _ in range(rng.randrange(0, 60)))
        best = min(edit_distance(item, window[a:b]) for a in range(len(window) + 1) for b in range(a, len(window) + 1))
        assert decontamination.Item(0, item, 0.1).distance(window) == best


def test_rules_count_like_plain_python(docs, texts, empty):
    got = {r["doc_id"]: r for r in compression_rules.compression_rules(docs).collect()}
    for i, t in texts:
        if i is None:
            continue
        w = (t or "").encode().split()
        lines = [x for x in (t or "").split("\n") if x.strip()]
        seen, hit = {}, set()
        for j in range(len(w) - 7):
            seen.setdefault(tuple(w[j : j + 8]), []).append(j)
        for at in seen.values():
            if len(at) > 1:
                hit |= {j + k for j in at for k in range(8)}
        r = got[i]
        assert (r["n_words"], r["word_chars"], r["n_dup_lines"], r["n_repeat_words"]) == (len(w), sum(len(x.decode()) for x in w), len(lines) - len(set(lines)), len(hit))
        assert r["base_failed"] == (len(w) < 20 or 100 * len(hit) > 30 * len(w)) and not (r["base_failed"] and r["kept"])
    assert compression_rules.compression_rules(empty).count() == 0


def test_bands_reject_noise_and_repetition(spark):
    rng = random.Random(4)
    noise = " ".join("".join(chr(rng.randrange(33, 127)) for _ in range(12)) for _ in range(400))
    same = " ".join(f"w{i % 3}" for i in range(30)) + " " + "na " * 800
    rows = [(1, noise), (2, same), (3, " ".join(prose(rng, 8) + "." for _ in range(40)))]
    got = {r["doc_id"]: r for r in compression_rules.compression_rules(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert not got[1]["kept"] and not got[2]["kept"] and got[2]["ratio"] < 0.1


def test_tokens_round_trip(spark, docs, texts, empty, tmp_path):
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(token_output.public_tokenizer("word_bpe_49k.json"))
    path = f"file://{tmp_path}/tokens"
    token_output.write_tokens(docs, path, partitions=3)
    at, want = 0, []
    for i, t in sorted(texts, key=lambda r: (-1 if r[0] is None else r[0])):
        ids = [*whole.encode(t or "", add_special_tokens=False).ids, 1]
        want.append((i, at, ids))
        at += len(ids)
    got = sorted(((r["doc_id"], r["start"], r["ids"]) for r in token_output.read_tokens(spark, path).collect()), key=lambda r: -1 if r[0] is None else r[0])
    assert got == want
    crc = {r["doc_id"]: (r["start"], r["n_tokens"], r["ids_crc32"]) for r in token_output.digest_tokens(spark, path).collect()}
    assert crc == {i: (s, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())) for i, s, ids in want}
    meta = token_output.read_tokens(spark, path, columns=("doc_id", "n_tokens"))
    scan = meta._jdf.queryExecution().executedPlan().toString()
    assert "ids" not in scan.split("ReadSchema")[-1]
    assert token_output.tokens_of(empty).count() == 0


def test_encoder_equals_library_on_odd_text():
    from tokenizers import Tokenizer

    path = token_output.public_tokenizer("word_bpe_49k.json")
    whole, encoder, rng = Tokenizer.from_file(path), token_output.ChunkEncoder(path), random.Random(2)
    letters = "aAbÉéß .,\n'!*\t ñİſΣς1²-_\x01<|>s t你好́"
    texts = ["".join(rng.choice(letters) for _ in range(rng.randrange(60))) for _ in range(800)] + ["don't, it's. we'll ,x ,, .. ***, a. b.", ""]
    flat, sizes = encoder.encode([t.encode() for t in texts], 1)
    parts = np.split(flat, np.cumsum(sizes)[:-1])
    for t, ids in zip(texts, parts):
        assert ids.tolist() == [*whole.encode(t, add_special_tokens=False).ids, 1], t


def test_gam_learns_an_interaction():
    rng = np.random.default_rng(0)
    x = np.concatenate([rng.uniform(-1, 1, (4000, 3)), np.zeros((4000, 2))], 1)
    y = ((x[:, 0] * x[:, 1] > 0) & (x[:, 2] > -0.5)).astype(float)
    model = quality_gam.fit(x[:3000], y[:3000], pair_rounds=120)
    p = model.score(x[3000:])
    assert ((p > 0.5) == (y[3000:] > 0.5)).mean() > 0.93
    assert quality_gam.fit(x, np.ones(len(x))).score(x[:2])[0] > 0.99 and quality_gam.fit(x[:0], y[:0]).score(x[:1])[0] == 0.5
    assert quality_gam.features(b"") == [0.0] * len(quality_gam.FEATURES) and all(map(math.isfinite, quality_gam.features(b"a")))


@pytest.mark.parametrize("name", ["op2_toxicity", "op9_quality"])
def test_classifiers_hold_out(spark, name):
    from siftlake.llm import queries

    sf = "/root/testdata/sf0.1"
    label = "toxic" if name == "op2_toxicity" else "quality"
    rows = queries.QUERIES[name](spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").where("held_out").select("predicted", label).collect()
    right = sum(r["predicted"] == r[label] for r in rows)
    assert len(rows) > 500 and right / len(rows) > 0.97


def test_toxicity_edges(spark):
    model = toxicity.fit(toxicity.Corpus.of([], 6), np.empty(0, int))
    docs = spark.createDataFrame([(1, None), (2, "")], "doc_id long, text string")
    assert all(0 <= r["score"] < 0.5 for r in toxicity.score(docs, model).collect())


PAGE = """<html><head><title>T</title><script>var a="<p>no</p>";</script></head><body><nav><a href=x>Home</a></nav>
<div class="sidebar">Side, bar, text that is long enough to count as a paragraph of its own, surely.</div>
<article><h1>Head &amp; more</h1><p>First part, with commas, and length enough to count here.<br>Next<p>Second&nbsp;part <b>bold, still</b> open
</article><div id="comments"><p>Reader says, well, that this is a comment of some length.</p></div><footer>&copy; us</footer></body></html>"""


def test_html_main_text(spark):
    assert html_text.main_text(PAGE) == "Head & more First part, with commas, and length enough to count here. Next Second part bold, still open"
    assert html_text.main_text("plain  text\nonly") == "plain text only"
    assert html_text.main_text(None) == html_text.main_text("") == html_text.main_text("<div></div>") == ""
    assert html_text.main_text("a < b & c <i>d") == "a < b & c d"
    rows = [(1, "u", PAGE), (2, None, None), (3, "v", "<p>" + "long, text " * 50_000)]
    got = {r["page_id"]: r for r in html_text.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got[2]["n_chars"] == 0 and got[3]["n_chars"] == len(" ".join(("long, text " * 50_000).split()))
    assert html_text.extract(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_common_shingles_of_a_template_meet_nothing(spark):
    """Pages of one template, each with words of its own that keep it just under the threshold."""
    rng = random.Random(9)
    common = [f"common{i}" for i in range(60)]
    rows = []
    for i in range(400):
        words = list(common)
        for k in range(6):
            words.insert(10 * k + 5 + rng.randrange(3), f"own{i}x{k}")
        rows.append((i, " ".join(words)))
    run = minhash.NearDuplicates(spark.createDataFrame(rows, "doc_id long, text string"), size=1, num=85, den=100)
    sets = run.full_sets(spark.range(400).select("id"))
    mixed = spark.createDataFrame([(i, i, 66) for i in range(400)], "id long, component long, n long")
    assert run.late_pairs(mixed, sets).count() == 0
    assert run.run().where("kept").count() == 400


def test_prefix_filter_loses_no_pair(spark):
    rng = random.Random(10)
    pool = [f"w{i}" for i in range(60)]
    rows = [(i, " ".join(rng.sample(pool, rng.randrange(35, 60)))) for i in range(120)]
    run = minhash.NearDuplicates(spark.createDataFrame(rows, "doc_id long, text string"), size=1, num=70, den=100)
    sets = {i: set(t.split()) for i, t in rows}
    want = {(a, b) for a in sets for b in sets if a < b and 100 * len(sets[a] & sets[b]) >= 70 * len(sets[a] | sets[b])}
    mixed = spark.createDataFrame([(i, i, len(s)) for i, s in sets.items()], "id long, component long, n long")
    full = run.full_sets(spark.range(120).select("id"))
    got = {tuple(sorted(r)) for r in run.verified(run.late_pairs(mixed, full), full).collect()}
    assert got == want and len(want) > 50


def test_a_document_of_very_many_lines(spark):
    """A third of the lines of one document repeat, a third are near an earlier one: rows grow with its lines only."""
    rng, n = random.Random(12), 20_000
    first = [f"{rng.getrandbits(160):040x}" for _ in range(n)]
    near = [x[: (k := rng.randrange(40))] + "~" + x[k + 1 :] for x in first]
    docs = spark.createDataFrame([(1, "\n".join(first + near + first)), (2, "\n".join(first[:1000]))], "doc_id long, text string")
    got = {r["doc_id"]: r for r in line_dedup.dedup_lines(docs).collect()}
    assert (got[1]["n_lines"], got[1]["n_equal"], got[1]["n_near"]) == (3 * n, n, n) and got[1]["kept_text"] == "\n".join(first)
    assert got[2]["n_equal"] == 1000 and got[2]["kept_text"] == ""
