"""Queries that score, rank, aggregate and report."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import fixed
from ..functions import scalars as S
from ..operators import relational as R
from .registry import Tables, query

KEYWORDS = ("license", "the", "password", "que")
#: Language stands for the content class of an artefact.
CLASSES = {"en": "Document", "de": "Database", "fr": "Image", "es": "Log"}


def _case(column: str, table: dict[str, float], rest: float) -> str:
    return f"CASE {column} " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in table.items()) + f" ELSE {rest} END"


_CLASS_WEIGHTS = {k: fixed.TYPE_WEIGHTS[v] for k, v in CLASSES.items()}
_HITS = " + ".join(f"contains(lower(text), '{k}')::INT" for k in KEYWORDS)
_P = fixed.PRIORITY_WEIGHTS
_PRIORITY_SQL = f"""WITH l AS (SELECT doc_id, max(quality) AS quality, max(toxic) AS toxic FROM labels GROUP BY doc_id),
f AS (SELECT d.doc_id, d.lang, d.source, n_chars, CASE WHEN l.quality IS NULL THEN NULL WHEN l.quality = 1 THEN 100.0 ELSE 20.0 END AS recon, least(100, n_chars / 50.0) AS integ, coalesce(l.toxic, 0) AS toxic,
least(50.0, 25.0 * ({_HITS})) + 20.0 * {_case('d.lang', _CLASS_WEIGHTS, fixed.TYPE_WEIGHTS['Other'])} + CASE WHEN max(d.doc_id) OVER () - d.doc_id <= 100 THEN 15.0 ELSE 0 END + least(15.0, 5.0 * (n_chars % 4)) AS rel FROM documents d LEFT JOIN l ON d.doc_id = l.doc_id),
s AS (SELECT *, {_P['integrity']} * integ + {_P['reconstruction']} * coalesce(recon, 50) + {_P['relationship']} * 60 + {_P['relevance']} * rel AS p FROM f)
SELECT doc_id, round(rel, 6) AS relevance, round(p, 6) AS priority, CASE WHEN toxic = 1 AND p < 72 THEN 'INFORMATIONAL' WHEN p >= 88 THEN 'CRITICAL' WHEN p >= 72 THEN 'HIGH' WHEN p >= 52 THEN 'MEDIUM' WHEN p >= 35 THEN 'LOW' ELSE 'INFORMATIONAL' END AS band FROM s"""


def _class_weight(lang: Column) -> Column:
    pairs = [x for k, v in _CLASS_WEIGHTS.items() for x in (F.lit(k), F.lit(v))]
    return F.coalesce(F.element_at(F.create_map(*pairs), lang), F.lit(fixed.TYPE_WEIGHTS["Other"]))


def prioritised(t: Tables) -> DataFrame:
    labels = t.labels.groupBy("doc_id").agg(F.max("quality").alias("quality"), F.max("toxic").alias("toxic"))
    newest = t.documents.agg(F.max("doc_id").alias("newest"))
    docs = t.documents.join(labels, "doc_id", "left").join(F.broadcast(newest))  # newest is one row
    recent = F.col("newest") - F.col("doc_id") <= 100
    points = S.relevance(S.keyword_hits(F.col("text"), KEYWORDS), _class_weight(F.col("lang")), recent, F.col("n_chars") % 4)
    docs = docs.withColumn("rel", points).withColumn("recon", F.when(F.col("quality") == 1, 100.0).when(F.col("quality") == 0, 20.0))
    integrity = F.least(F.lit(100.0), F.col("n_chars") / 50.0)
    scored = docs.withColumn("p", S.priority(integrity, F.col("recon"), F.lit(60.0), F.col("rel")))
    band = S.priority_band(F.col("p"), F.coalesce("toxic", F.lit(0)) == 1)
    return scored.select("doc_id", F.round("rel", 6).alias("relevance"), F.round("p", 6).alias("priority"), band.alias("band"))


@query(_PRIORITY_SQL)
def q_priority(t: Tables) -> DataFrame:
    """Which artefacts should be reviewed first."""
    return prioritised(t).orderBy(F.desc("priority"), "doc_id")


@query("SELECT doc_id, lang, source, n_chars FROM documents WHERE lang IN ('en', 'de') AND n_chars >= 200 AND (contains(lower(text), 'license') OR contains(lower(source), '1')) ORDER BY n_chars DESC NULLS FIRST, doc_id")
def q_filter_list(t: Tables) -> DataFrame:
    docs = t.documents.where(F.col("lang").isin("en", "de") & (F.col("n_chars") >= 200))
    hit = F.contains(F.lower("text"), F.lit("license")) | F.contains(F.lower("source"), F.lit("1"))
    return docs.where(hit).select("doc_id", "lang", "source", "n_chars").orderBy(F.desc_nulls_first("n_chars"), "doc_id")


@query("SELECT p_partkey, p_name, p_retailprice, (SELECT count(*) FROM part WHERE p_name ILIKE '%a%') AS total FROM part WHERE p_name ILIKE '%a%' ORDER BY p_retailprice DESC NULLS FIRST, p_partkey LIMIT 25 OFFSET 50")
def q_page(t: Tables) -> DataFrame:
    """One page of a list, with the size of the whole list."""
    found = t.part.where(F.col("p_name").ilike("%a%"))
    page = found.select("p_partkey", "p_name", "p_retailprice").orderBy(F.desc_nulls_first("p_retailprice"), "p_partkey").offset(50).limit(25)
    return page.join(F.broadcast(found.agg(F.count(F.lit(1)).alias("total"))))  # one row


@query("SELECT lang, source, count(*) AS n, sum(n_chars)::BIGINT AS chars, grouping(lang)::INT AS all_langs, grouping(source)::INT AS all_sources FROM documents GROUP BY ROLLUP (lang, source)")
def q_families(t: Tables) -> DataFrame:
    out = t.documents.rollup("lang", "source").agg(F.count(F.lit(1)).alias("n"), F.sum("n_chars").alias("chars"), F.grouping("lang").cast("int").alias("all_langs"), F.grouping("source").cast("int").alias("all_sources"))
    return out


@query("SELECT b AS bucket, coalesce(n, 0)::BIGINT AS n FROM (SELECT unnest(range(0, 5)) AS b) LEFT JOIN (SELECT least(4, n_chars // 2000) AS k, count(*) AS n FROM documents GROUP BY 1) ON b = k")
def q_buckets(t: Tables) -> DataFrame:
    """Counts by size class with empty classes kept, the last one open."""
    classes = t.spark.range(5).select(F.col("id").alias("bucket"))
    counts = t.documents.groupBy(F.least(F.lit(4), F.floor(F.col("n_chars") / 2000)).alias("bucket")).agg(F.count(F.lit(1)).alias("n"))
    return classes.join(counts, "bucket", "left").select("bucket", F.coalesce("n", F.lit(0)).alias("n"))


@query("SELECT least(9, floor(l_discount * 100))::BIGINT AS bin, count(*) AS n, round(avg(l_extendedprice), 4) AS mean_price, count_if(l_tax = 0) AS untaxed FROM lineitem GROUP BY 1")
def q_histogram(t: Tables) -> DataFrame:
    """Ten bins, the last closed, with means and counts of zero."""
    bins = F.least(F.lit(9), F.floor(F.col("l_discount") * 100))
    return t.lineitem.groupBy(bins.cast("long").alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("l_extendedprice"), 4).alias("mean_price"), F.count_if(F.col("l_tax") == 0).alias("untaxed"))


@query("SELECT l_returnflag, l_linestatus, round(exp(avg(ln(greatest(l_discount, 0.000001)))) * greatest(0.5, 1 - 0.1 * max(l_linenumber % 4)), 6) AS score, count(*) AS n FROM lineitem GROUP BY 1, 2")
def q_geomean(t: Tables) -> DataFrame:
    score = S.relationship_score(F.col("l_discount"), F.col("l_linenumber") % 4)
    return t.lineitem.groupBy("l_returnflag", "l_linestatus").agg(F.round(score, 6).alias("score"), F.count(F.lit(1)).alias("n"))


_SCORED = "SELECT quality AS y, least(1.0, n_chars / 8000.0) AS p FROM documents JOIN labels USING (doc_id)"


def _scored(t: Tables) -> DataFrame:
    return t.documents.join(t.labels, "doc_id").select(F.col("quality").alias("y"), F.least(F.lit(1.0), F.col("n_chars") / 8000.0).alias("p"))


@query(f"SELECT least(9, floor(p * 10))::INT AS bin, count(*) AS n, round(avg(p), 6) AS mean_score, round(avg(y), 6) AS rate, count(*) < 5 AS low FROM ({_SCORED}) GROUP BY 1")
def q_reliability(t: Tables) -> DataFrame:
    return R.reliability(_scored(t), "p", "y").select("bin", "n", F.round("mean_score", 6).alias("mean_score"), F.round("rate", 6).alias("rate"), "low")


@query(f"""WITH s AS ({_SCORED}), b AS (SELECT least(9, floor(p * 10)) AS bin, count(*) AS n, avg(p) AS p, avg(y) AS y FROM s GROUP BY 1)
SELECT round(avg((p - y) * (p - y)), 6) AS brier, (SELECT round(sum(n * abs(p - y)) / sum(n), 6) FROM b) AS ece, count_if(p >= 0.5 AND y = 1) AS tp, count_if(p >= 0.5 AND y = 0) AS fp, count_if(p < 0.5 AND y = 1) AS fn, count_if(p < 0.5 AND y = 0) AS tn,
round(count_if(p >= 0.5 AND y = 1) / count_if(p >= 0.5), 6) AS precision, round(count_if(p >= 0.5 AND y = 1) / count_if(y = 1), 6) AS recall FROM s""")
def q_confusion(t: Tables) -> DataFrame:
    s = _scored(t)
    yes, true = F.col("p") >= 0.5, F.col("y") == 1
    ece = R.reliability(s, "p", "y", least=0).agg(F.round(F.sum(F.col("n") * F.abs(F.col("mean_score") - F.col("rate"))) / F.sum("n"), 6).alias("ece"))
    out = s.agg(
        F.round(F.avg((F.col("p") - F.col("y")) ** 2), 6).alias("brier"), F.count_if(yes & true).alias("tp"), F.count_if(yes & ~true).alias("fp"), F.count_if(~yes & true).alias("fn"),
        F.count_if(~yes & ~true).alias("tn"), F.round(F.count_if(yes & true) / F.count_if(yes), 6).alias("precision"), F.round(F.count_if(yes & true) / F.count_if(true), 6).alias("recall"),
    )
    return out.join(F.broadcast(ece))  # one row each


@query(f"WITH s AS ({_SCORED}), r AS (SELECT y, avg(k) OVER (PARTITION BY p) AS r FROM (SELECT *, row_number() OVER (ORDER BY p) AS k FROM s)) SELECT round((sum(r) FILTER (y = 1) - count_if(y = 1) * (count_if(y = 1) + 1) / 2) / (count_if(y = 1) * count_if(y = 0)), 6) AS auc FROM r")
def q_auc(t: Tables) -> DataFrame:
    return R.auc(_scored(t), "p", "y").select(F.round("auc", 6).alias("auc"))


@query("""WITH m AS (SELECT p_brand, median(p_retailprice) AS med FROM part GROUP BY 1), d AS (SELECT p_brand, med, median(abs(p_retailprice - med)) AS mad FROM part JOIN m USING (p_brand) GROUP BY 1, 2)
SELECT p_partkey, round((p_retailprice - med) / (1.4826 * mad), 6) AS z FROM part JOIN d USING (p_brand) WHERE mad > 0 AND abs(p_retailprice - med) / (1.4826 * mad) > 1.2""")
def q_robust_z(t: Tables) -> DataFrame:
    """Outliers by distance from the median in units of the median absolute deviation."""
    med = t.part.groupBy("p_brand").agg(F.median("p_retailprice").alias("med"))
    with_med = t.part.join(med, "p_brand")
    mad = with_med.groupBy("p_brand").agg(F.median(F.abs(F.col("p_retailprice") - F.col("med"))).alias("mad"))
    z = (F.col("p_retailprice") - F.col("med")) / (1.4826 * F.col("mad"))
    return with_med.join(mad.where("mad > 0"), "p_brand").select("p_partkey", F.round(z, 6).alias("z"), F.abs(z).alias("az")).where("az > 1.2").drop("az")


_FACTS = """SELECT o_orderkey, o_orderkey % 5 <> 0 AS header, CASE o_orderkey % 3 WHEN 0 THEN 'pass' WHEN 1 THEN 'fail' END AS terminator, CASE o_orderkey % 4 WHEN 0 THEN 'pass' WHEN 1 THEN 'partial' WHEN 2 THEN 'fail' END AS parser,
CASE WHEN o_orderkey % 6 = 0 THEN NULL ELSE (o_orderkey % 100) / 100.0 END AS ratio, CASE WHEN o_orderkey % 10 = 0 THEN NULL ELSE (o_custkey % 101)::DOUBLE END AS recon, o_orderkey % 6 AS missing, o_custkey % 7 AS corrupt, o_orderkey % 2 AS conflicts, o_custkey % 8 = 0 AS orphan, (o_custkey % 100)::DOUBLE AS rel FROM orders"""
_INTEG = """greatest(0, least(100, CASE WHEN header THEN 10 ELSE 0 END + CASE terminator WHEN 'pass' THEN 8 WHEN 'fail' THEN 0 ELSE 4 END + CASE parser WHEN 'pass' THEN 25 WHEN 'partial' THEN 12 WHEN 'fail' THEN 0 ELSE 8 END
+ coalesce(15 * ratio, 5) + coalesce(0.3 * recon, 15) + 12 * greatest(0, 1 - 0.25 * missing) - least(20, 4 * corrupt) - least(10, 5 * conflicts) - CASE WHEN orphan THEN 10 ELSE 0 END))"""


def _facts(t: Tables) -> DataFrame:
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    return t.orders.select(
        "o_orderkey", (k % 5 != 0).alias("header"), F.when(k % 3 == 0, "pass").when(k % 3 == 1, "fail").alias("terminator"),
        F.when(k % 4 == 0, "pass").when(k % 4 == 1, "partial").when(k % 4 == 2, "fail").alias("parser"), F.when(k % 6 != 0, (k % 100) / 100.0).alias("ratio"),
        F.when(k % 10 != 0, (c % 101).cast("double")).alias("recon"), (k % 6).alias("missing"), (c % 7).alias("corrupt"), (k % 2).alias("conflicts"), (c % 8 == 0).alias("orphan"), (c % 100).cast("double").alias("rel"),
    )


def _integrity() -> Column:
    c = F.col
    return S.integrity_score(c("header"), c("terminator"), c("parser"), c("ratio"), c("recon"), c("missing"), c("corrupt"), c("conflicts"), c("orphan"))


@query(f"SELECT o_orderkey, round({_INTEG}, 6) AS integrity FROM ({_FACTS})")
def q_integrity(t: Tables) -> DataFrame:
    return _facts(t).select("o_orderkey", F.round(_integrity(), 6).alias("integrity"))


@query(f"""WITH s AS (SELECT *, {_INTEG} AS integ FROM ({_FACTS})), r AS (SELECT CASE WHEN o_orderkey % 17 = 0 THEN 'UNCERTAIN' WHEN o_orderkey % 29 = 0 THEN 'MOSTLY_RECOVERED' WHEN orphan THEN CASE WHEN recon < 20 OR integ < 30 THEN 'UNRECOVERABLE' ELSE 'FRAGMENT_ONLY' END
WHEN recon IS NULL THEN 'UNCERTAIN' WHEN recon >= 99.5 AND parser = 'pass' AND missing = 0 THEN 'FULLY_RECOVERED' WHEN rel < 60 THEN 'UNCERTAIN' WHEN recon < 20 THEN 'UNRECOVERABLE' WHEN recon >= 85 AND integ >= 70 THEN 'MOSTLY_RECOVERED' WHEN recon >= 40 THEN 'PARTIALLY_RECOVERED'
WHEN ratio > 0.9 THEN 'PARTIALLY_RECOVERED' ELSE 'FRAGMENT_ONLY' END AS status, integ FROM s) SELECT status, count(*) AS n, round(avg(integ), 6) AS mean_integrity FROM r GROUP BY status""")
def q_status(t: Tables) -> DataFrame:
    c, k = F.col, F.col("o_orderkey")
    facts = _facts(t).withColumn("integ", _integrity())
    clean = (c("parser") == "pass") & (c("missing") == 0)
    hint = F.when(k % 29 == 0, "MOSTLY_RECOVERED")
    status = S.recovery_status(hint, k % 17 != 0, c("orphan"), c("recon"), c("integ"), c("rel"), clean, c("ratio") > 0.9)
    return facts.groupBy(status.alias("status")).agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("integ"), 6).alias("mean_integrity"))


@query(f"SELECT CASE WHEN terminator = 'pass' AND parser = 'pass' THEN 'validated' WHEN terminator = 'fail' AND (parser = 'fail' OR parser IS NULL) THEN 'failed' ELSE 'partial' END AS export_class, count(*) AS n FROM ({_FACTS}) GROUP BY 1")
def q_export_class(t: Tables) -> DataFrame:
    cls = S.export_class(F.col("terminator"), F.col("parser"), F.lit(None).cast("string"))
    return _facts(t).groupBy(cls.alias("export_class")).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT p_brand, p_partkey, p_retailprice, rank FROM (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY p_retailprice DESC, p_partkey) AS rank FROM part) WHERE rank <= 3")
def q_topk(t: Tables) -> DataFrame:
    return R.top_k(t.part.select("p_brand", "p_partkey", "p_retailprice"), ["p_brand"], [F.desc("p_retailprice"), F.col("p_partkey")], 3)


@query("SELECT o_orderkey // 64 AS cell, max(code) AS state, min(o_orderkey) FILTER (code = m) AS owner FROM (SELECT *, max(code) OVER (PARTITION BY o_orderkey // 64) AS m FROM (SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 2 WHEN 'P' THEN 1 ELSE 0 END AS code FROM orders)) GROUP BY 1")
def q_heatmap(t: Tables) -> DataFrame:
    """Blocks of cells, the worst state of each wins, with the first cell in that state."""
    code = F.when(F.col("o_orderstatus") == "F", 2).when(F.col("o_orderstatus") == "P", 1).otherwise(0)
    cells = t.orders.select(F.floor(F.col("o_orderkey") / 64).alias("cell"), code.alias("code"), "o_orderkey")
    worst = cells.groupBy("cell").agg(F.max(F.struct("code", (-F.col("o_orderkey")).alias("k"))).alias("w"))
    return worst.select("cell", F.col("w.code").alias("state"), (-F.col("w.k")).alias("owner"))


@query("SELECT time_bucket(INTERVAL '1 hour', ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def q_windows(t: Tables) -> DataFrame:
    w = F.window(F.col("ts").cast("timestamp"), "1 hour")
    out = t.events.groupBy(w.alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("total"))
    return out.select(F.col("w.start").cast("timestamp_ntz").alias("start"), "event_type", "n", "total")


@query("""SELECT user_id, min(ts) AS start, count(*) AS n FROM (SELECT *, sum(b) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS s FROM (
SELECT *, coalesce(ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) >= INTERVAL '30 minutes', true)::INT AS b FROM events)) GROUP BY user_id, s""")
def q_sessions(t: Tables) -> DataFrame:
    w = F.session_window(F.col("ts").cast("timestamp"), "30 minutes")
    out = t.events.groupBy("user_id", w.alias("w")).agg(F.count(F.lit(1)).alias("n"))
    return out.select("user_id", F.col("w.start").cast("timestamp_ntz").alias("start"), "n")


@query("SELECT o_custkey, sha256(string_agg(o_orderkey || ':' || o_orderstatus, chr(10) ORDER BY o_orderkey || ':' || o_orderstatus)) AS digest, count(*) AS n FROM orders GROUP BY 1")
def q_manifest(t: Tables) -> DataFrame:
    """Digest of a manifest: a hash over its lines in sorted order."""
    line = F.concat_ws(":", F.col("o_orderkey").cast("string"), "o_orderstatus")
    lines = F.array_join(F.array_sort(F.collect_list(line)), "\n")
    return t.orders.groupBy("o_custkey").agg(F.sha2(lines.cast("binary"), 256).alias("digest"), F.count(F.lit(1)).alias("n"))


@query("""SELECT rule, n FROM (SELECT 'short_text' AS rule, count(*) AS n FROM documents WHERE n_chars < 100 UNION ALL SELECT 'duplicate_text', count(*) - count(DISTINCT text) FROM documents UNION ALL SELECT 'unlabelled', count(*) FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id)
UNION ALL SELECT 'toxic', count(*) FROM labels WHERE toxic = 1 UNION ALL SELECT 'no_language', count(*) FROM documents WHERE lang IS NULL) WHERE n > 0""")
def q_findings(t: Tables) -> DataFrame:
    """Rules that count something, only those that found any."""
    d = t.documents
    counts = [
        ("short_text", d.where("n_chars < 100").agg(F.count(F.lit(1)).alias("n"))),
        ("duplicate_text", d.groupBy("text").agg(F.count(F.lit(1)).alias("k")).agg(F.coalesce(F.sum(F.col("k") - 1), F.lit(0)).alias("n"))),
        ("unlabelled", d.join(t.labels, "doc_id", "left_anti").agg(F.count(F.lit(1)).alias("n"))),
        ("toxic", t.labels.where("toxic = 1").agg(F.count(F.lit(1)).alias("n"))),
        ("no_language", d.where("lang is null").agg(F.count(F.lit(1)).alias("n"))),
    ]
    out = None
    for rule, n in counts:
        row = n.select(F.lit(rule).alias("rule"), F.col("n").cast("long").alias("n"))
        out = row if out is None else out.unionByName(row)
    return out.where("n > 0")


@query("""WITH f AS (SELECT doc_id, '{"doc_id":' || doc_id || ',"lang":"' || lang || '","size":{"chars":' || n_chars || '}}' AS j FROM documents WHERE lang IS NOT NULL)
SELECT doc_id, json_extract_string(j, '$.lang') AS lang, json_extract(j, '$.size.chars')::BIGINT AS chars, j AS report FROM f""")
def q_report(t: Tables) -> DataFrame:
    """One JSON report per artefact, and two values read back from it."""
    body = F.struct("doc_id", "lang", F.struct(F.col("n_chars").alias("chars")).alias("size"))
    rows = t.documents.where("lang is not null").select("doc_id", F.to_json(body).alias("report"))
    return rows.select("doc_id", F.get_json_object("report", "$.lang").alias("lang"), F.get_json_object("report", "$.size.chars").cast("long").alias("chars"), "report")


@query("""WITH e AS (SELECT 'nation' AS kind, n_nationkey::BIGINT AS id, 'region' AS to_kind, n_regionkey::BIGINT AS to_id FROM nation UNION ALL SELECT 'customer', c_custkey, 'nation', c_nationkey FROM customer UNION ALL SELECT 'supplier', s_suppkey, 'nation', s_nationkey FROM supplier)
SELECT kind, id, min(n) AS first_role, count(*) AS links FROM (SELECT kind, id, 'source' AS n FROM e UNION ALL SELECT to_kind, to_id, 'target' FROM e) GROUP BY 1, 2""")
def q_graph(t: Tables) -> DataFrame:
    """Nodes of a graph made from several kinds of edges, with their number of links."""
    edge = lambda df, kind, key, to, to_key: df.select(F.lit(kind).alias("kind"), F.col(key).cast("long").alias("id"), F.lit(to).alias("to_kind"), F.col(to_key).cast("long").alias("to_id"))
    e = edge(t.nation, "nation", "n_nationkey", "region", "n_regionkey")
    e = e.unionByName(edge(t.customer, "customer", "c_custkey", "nation", "c_nationkey")).unionByName(edge(t.supplier, "supplier", "s_suppkey", "nation", "s_nationkey"))
    ends = e.select("kind", "id", F.lit("source").alias("n")).unionByName(e.select(F.col("to_kind").alias("kind"), F.col("to_id").alias("id"), F.lit("target").alias("n")))
    return ends.groupBy("kind", "id").agg(F.min("n").alias("first_role"), F.count(F.lit(1)).alias("links"))


@query("""WITH p AS (SELECT l_orderkey AS cand, l_linenumber AS slot, l_suppkey % 10 AS file FROM lineitem), v AS (SELECT cand, file, count(*) AS n FROM p GROUP BY 1, 2),
m AS (SELECT cand, file FROM (SELECT *, row_number() OVER (PARTITION BY cand ORDER BY n DESC, file) AS rn FROM v) WHERE rn = 1)
SELECT count(*) AS placed, count_if(p.file = m.file) AS correct, round(count_if(p.file = m.file) / count(*), 6) AS precision, (SELECT count(*) FROM (SELECT DISTINCT p.file, p.slot FROM p JOIN m USING (cand) WHERE p.file = m.file)) AS distinct_hit FROM p JOIN m USING (cand)""")
def q_evaluation(t: Tables) -> DataFrame:
    """Placement precision against the truth: each candidate takes the file of most of its parts."""
    p = t.lineitem.select(F.col("l_orderkey").alias("cand"), F.col("l_linenumber").alias("slot"), (F.col("l_suppkey") % 10).alias("file"))
    m = R.majority(p, "cand", "file").select("cand", F.col("file").alias("winner"))
    met = p.join(m, "cand").withColumn("ok", F.col("file") == F.col("winner"))
    hits = met.where("ok").select("file", "slot").distinct().agg(F.count(F.lit(1)).alias("distinct_hit"))
    out = met.agg(F.count(F.lit(1)).alias("placed"), F.count_if("ok").alias("correct"), F.round(F.count_if("ok") / F.count(F.lit(1)), 6).alias("precision"))
    return out.join(F.broadcast(hits))  # one row each


@query("SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS at FROM embeddings QUALIFY (row_number() OVER (ORDER BY vec_id) - 1) % greatest(1, (SELECT count(*) FROM embeddings) // 100) = 0")
def q_even_sample(t: Tables) -> DataFrame:
    """Every n-th row of the map, about a hundred points; a sampling operator."""
    n = t.embeddings.agg(F.greatest(F.lit(1), F.floor(F.count(F.lit(1)) / 100)).alias("step"))
    at = F.row_number().over(Window.orderBy("vec_id")) - 1
    rows = t.embeddings.select("vec_id", at.cast("long").alias("at")).join(F.broadcast(n))  # one row
    return rows.where(F.col("at") % F.col("step") == 0).select("vec_id", "at")


@query("SELECT conv_id, string_agg(role, '>' ORDER BY turn, text) AS path, count(*) AS turns, max(turn) - min(turn) + 1 = count(*) AS gapless FROM conversations GROUP BY 1")
def q_chains(t: Tables) -> DataFrame:
    """Ordered chains of turns, and whether any is missing."""
    path = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", "text", "role"))), lambda x: x["role"]), ">")
    return t.conversations.groupBy("conv_id").agg(path.alias("path"), F.count(F.lit(1)).alias("turns"), (F.max("turn") - F.min("turn") + 1 == F.count(F.lit(1))).alias("gapless"))
