"""Fill-in-middle against a brute-force version that cuts texts into lists of units."""

import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from siftlake.llm import fill_in_middle as fim

UNITS = {"chars": r"(?s:.)", "words": r"[^\x20\x09-\x0D]*[\x20\x09-\x0D]+|[^\x20\x09-\x0D]+", "lines": r"[^\n]*\n|[^\n]+"}


def brute(doc_id, text, units):
    text = text or ""
    parts = re.findall(UNITS[units], text)
    assert "".join(parts) == text
    h = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[8 * i : 8 * i + 8], 16) for i in range(4))
    n = len(parts)
    if not text or any(s in text for s in ("<P>", "<S>", "<M>")) or h3 % 100 >= 90:
        return n, "plain", None, None, text
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    p, m, s = "".join(parts[:a]), "".join(parts[a:b]), "".join(parts[b:])
    form = "spm" if h4 % 100 < 20 else "psm"
    return n, form, len(p), len(m), f"<S>{s}<P>{p}<M>{m}" if form == "spm" else f"<P>{p}<S>{s}<M>{m}"


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(11)
    bits = ["a", "é", "𝒳", " ", "\n", "\t", "\x00", "\r", "<", "<P", "S>", "word", " ", "\xa0", "é", "<s>"]
    made = [(i, "".join(rng.choice(bits) for _ in range(rng.randrange(25)))) for i in range(400)]
    made += [(400, "a<P>b"), (401, "<M>"), (402, "<<S>"), (403, None), (404, ""), (None, "no id here"), (405, "x " * 400_000), (406, "same"), (406, "same")]
    return made


@pytest.mark.parametrize("units", sorted(UNITS))
def test_equals_brute_force(spark, rows, units):
    docs = spark.createDataFrame(rows, "doc_id long, text string").select("*", F.lit(1).alias("output"), F.lit("x").alias("form"), F.lit("y").alias("h1"), F.lit(None).cast("string").alias("restored"))
    config = fim.FillInMiddle(units=units)
    got = fim.restore(fim.transform(docs, config), config).collect()
    pick = lambda r: (str(r[0]), r[1], r[2], str(r[3]), str(r[4]), r[5], r[6])
    want = sorted(pick((i, *brute(i, t, units), t or "")) for i, t in rows)
    assert sorted(pick((r["doc_id"], r["n"], r["form"], r["prefix_chars"], r["middle_chars"], r["output"], r["restored"])) for r in got) == want
    assert {r["form"] for r in got} == {"plain", "psm", "spm"}
    for r in got:
        if r["form"] != "plain":
            t, cuts = r["restored"], (r["prefix_chars"], r["prefix_chars"] + r["middle_chars"])
            spaces = "\n" if units == "lines" else fim.SPACES
            assert r["cuts_in_words"] == sum(0 < c < len(t) and t[c - 1] not in spaces and t[c] not in spaces for c in cuts)
    assert fim.digests(docs.where("false"), config).count() == 0


def test_sentinels_must_be_told_apart():
    for bad in (dict(prefix=""), dict(prefix="<S>"), dict(prefix="<S>x"), dict(prefix="aba"), dict(prefix="><"), dict(units="bytes")):
        with pytest.raises(ValueError):
            fim.FillInMiddle(**bad)
    config = fim.FillInMiddle(prefix="[pre]", suffix="[suf]", middle="[mid]")
    assert config.rebuild(config.join("psm", "[", "[mi", "d]"), "psm") == "[[mid]" and config.scan("x[mid]") is None
    with pytest.raises(ValueError):
        config.rebuild("no marks", "psm")
