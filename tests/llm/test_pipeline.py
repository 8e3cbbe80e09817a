"""The whole pipeline against plain Python on the smallest tables, and the contract of its stages."""

import numpy as np
from pyspark.sql import functions as F

import corpus_pipeline
from siftlake.llm import decontamination, mixing, quality_gam, token_output
from siftlake.llm.common import crc_fold, read_table

SF = "/root/testdata/sf0.001"


def test_pipeline_equals_plain_python(spark):
    from tokenizers import Tokenizer

    docs = read_table(spark, SF, "documents")
    model = quality_gam.train(docs, read_table(spark, SF, "labels"), use=crc_fold(F.col("doc_id"), 4) != 2)
    rows = {r["doc_id"]: r["text"] for r in docs.collect()}
    scores = model.score(np.array([quality_gam.features((t or "").encode()) for t in rows.values()]))
    good = {i: t for (i, t), s in zip(rows.items(), scores) if s >= corpus_pipeline.LEAST_QUALITY}

    def shingles(text):
        w = (text or "").encode().lower().split()
        return frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()

    sets, label = {i: shingles(t) for i, t in good.items()}, {i: i for i in good}
    links = [(a, b) for a in sets for b in sets if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    for _ in good:
        if all(label[a] == label[b] for a, b in links):
            break
        for a, b in links:
            label[a] = label[b] = min(label[a], label[b])
    single = {i: t for i, t in good.items() if label[i] == i}

    items = [decontamination.Item(r["item_id"], decontamination.normalise(r["text"]), decontamination.ERROR_RATE) for r in read_table(spark, SF, "benchmark").collect() if decontamination.normalise(r["text"] or "")]
    clean = {i: t for i, t in single.items() if not any(x.distance(decontamination.normalise(t or "")) <= x.budget for x in items)}

    frame = docs.where(F.col("doc_id").isin(list(clean)))
    copies = {r["doc_id"]: r["copies"] for r in mixing.mix_plan(frame).collect()}
    whole = Tokenizer.from_file(token_output.public_tokenizer("word_bpe_49k.json"))
    want, at = [], 0
    for i in sorted(clean):
        ids = [*whole.encode(clean[i] or "", add_special_tokens=False).ids, 1]
        for _ in range(copies[i]):
            want.append((i, at, ids))
            at += len(ids)
    got = sorted((r["doc_id"], r["start"], r["ids"]) for r in corpus_pipeline.run(spark, SF).collect())
    assert got == want
    assert len(rows) > len(good) > len(single) >= len(clean) > 0


def test_stages_keep_columns_and_take_clashing_ones(spark):
    docs = read_table(spark, SF, "documents").withColumns({c: F.lit(1) for c in ("score", "leaks", "n", "keys", "size", "bucket", "component_id")})
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, SF).columns == docs.columns
