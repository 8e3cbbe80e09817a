"""Queries over file records. Documents and orders stand for recovered files; what a parser would have found is derived
from their keys and sizes, alike here and in the SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import records as R
from .registry import Tables, query

_TYPES = {"en": "pdf", "de": "docx", "fr": "jpeg", "es": "sqlite"}
_TYPE_SQL = "CASE lang WHEN 'en' THEN 'pdf' WHEN 'de' THEN 'docx' WHEN 'fr' THEN 'jpeg' WHEN 'es' THEN 'sqlite' ELSE 'log' END"
_FILES = f"""SELECT doc_id, {_TYPE_SQL} AS type, doc_id % 5 <> 0 AS header, doc_id % 7 = 0 AS orphan, doc_id % 11 = 0 AS single, n_chars, n_chars % 100 AS rows_total,
CASE WHEN doc_id % 4 <> 1 THEN least(n_chars % 100, n_chars % 90) END AS rows_found, CASE WHEN doc_id % 3 <> 0 THEN n_chars * 2 END AS expected, doc_id % 3 = 0 AND doc_id % 4 = 0 AS bounded,
['pass', 'partial', 'fail'][doc_id % 3 + 1] AS parser, CASE WHEN doc_id % 6 <> 0 THEN 'Name.' || ['pdf', 'DOCX', 'jpg', 'db', 'x'][doc_id % 5 + 1] END AS entry, doc_id % 4 AS missing, doc_id % 3 AS conflicts, (doc_id // 2) % 5 AS alternatives FROM documents"""


def _pick(values, i):
    return F.element_at(F.array(*map(F.lit, values)), (i + 1).cast("int"))


def _files(t: Tables) -> DataFrame:
    i, n = F.col("doc_id"), F.col("n_chars")
    kind = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in _TYPES.items() for x in kv]), F.col("lang")), F.lit("log"))
    return t.documents.select(
        "doc_id", kind.alias("type"), (i % 5 != 0).alias("header"), (i % 7 == 0).alias("orphan"), (i % 11 == 0).alias("single"), "n_chars", (n % 100).alias("rows_total"),
        F.when(i % 4 != 1, F.least(n % 100, n % 90)).alias("rows_found"), F.when(i % 3 != 0, n * 2).alias("expected"), ((i % 3 == 0) & (i % 4 == 0)).alias("bounded"),
        _pick(("pass", "partial", "fail"), i % 3).alias("parser"), F.when(i % 6 != 0, F.concat(F.lit("Name."), _pick(("pdf", "DOCX", "jpg", "db", "x"), i % 5))).alias("entry"),
        (i % 4).alias("missing"), (i % 3).alias("conflicts"), (F.floor(i / 2) % 5).alias("alternatives"),
    )


@query(f"""WITH f AS ({_FILES}) SELECT doc_id,
round(CASE WHEN single THEN 100 WHEN type = 'jpeg' AND rows_total > 0 AND rows_found IS NOT NULL THEN 100.0 * rows_found / rows_total WHEN expected > 0 THEN 100.0 * least(n_chars, expected) / expected WHEN bounded THEN 100 END, 6) AS reconstruction,
least(100.0, CASE WHEN header THEN 45 ELSE 25 END + CASE parser WHEN 'pass' THEN 40 WHEN 'partial' THEN 25 ELSE 5 END + CASE WHEN entry IS NULL THEN 7 WHEN list_contains(CASE type WHEN 'jpeg' THEN ['jpg', 'jpeg'] WHEN 'sqlite' THEN ['db', 'sqlite'] ELSE [type] END, lower(split_part(entry, '.', 2))) THEN 15 ELSE 0 END) AS content,
CASE WHEN type = 'pdf' AND alternatives > 1 THEN 'internal_references' WHEN single THEN 'not_applicable' ELSE 'fragment_relationships' END AS links,
CASE WHEN type = 'pdf' AND alternatives > 1 THEN round(100 * alternatives / 4.0, 1) WHEN single THEN NULL ELSE 50.0 END AS links_value,
CASE WHEN missing = 0 AND NOT orphan THEN 'NO' WHEN alternatives > 2 THEN 'YES' WHEN conflicts > 0 THEN 'UNCERTAIN' ELSE 'NO' END AS further FROM f""")
def q_file_scores(t: Tables) -> DataFrame:
    """Reconstruction, content confidence, the links figure and the outlook of each file."""
    c = F.col
    links = R.links_metric(c("type"), F.when(c("alternatives") > 1, c("alternatives") / 4.0), c("single"), F.lit(50.0))
    recon = R.reconstruction(c("single"), c("type"), c("rows_total"), c("rows_found"), c("expected"), c("n_chars"), c("bounded"))
    further = R.assessment(c("missing"), c("orphan"), F.greatest(c("alternatives") - 2, F.lit(0)), c("conflicts"))
    scored = _files(t).select("doc_id", F.round(recon, 6).alias("reconstruction"), R.content_confidence(c("type"), c("header"), c("parser"), c("entry")).alias("content"), links.alias("l"), further.alias("further"))
    return scored.select("doc_id", "reconstruction", "content", F.col("l.kind").alias("links"), F.col("l.value").alias("links_value"), "further")


_LINES = "SELECT l_orderkey, list(CASE WHEN l_returnflag = 'R' THEN 'bad' ELSE 'ok' END) AS states, list(struct_pack(status := CASE l_returnflag WHEN 'R' THEN 'missing' WHEN 'A' THEN 'corrupted' ELSE 'ok' END, reason := CASE WHEN l_linenumber = 2 THEN 'object header not at xref offset' END)) AS objects, list(l_discount + 0.5) AS links FROM lineitem GROUP BY l_orderkey"


def _orders(t: Tables) -> DataFrame:
    """Orders as files of six types, their lines as members, objects, pages and links."""
    flag = F.col("l_returnflag")
    status = F.when(flag == "R", "missing").when(flag == "A", "corrupted").otherwise("ok")
    reason = F.when(F.col("l_linenumber") == 2, "object header not at xref offset")
    lines = t.lineitem.groupBy("l_orderkey").agg(
        F.collect_list(F.when(flag == "R", "bad").otherwise("ok")).alias("states"), F.collect_list(F.struct(status.alias("status"), reason.alias("reason"))).alias("objects"),
        F.collect_list(F.col("l_discount") + 0.5).alias("links"), F.collect_list(_pick(("jpeg", "pdf", "compressed", "text", "sqlite", "xml", "log"), F.col("l_suppkey") % 7)).alias("families"),
    )
    kind = _pick(("zip", "pdf", "sqlite", "jpeg", "docx", "log"), F.col("o_orderkey") % 6)
    return t.orders.join(lines, F.col("o_orderkey") == F.col("l_orderkey")).withColumn("type", kind)


@query(f"""WITH l AS ({_LINES}), f AS (SELECT *, ['zip', 'pdf', 'sqlite', 'jpeg', 'docx', 'log'][o_orderkey % 6 + 1] AS type, (o_totalprice::BIGINT) % 60 AS rows_total, o_custkey % 50 AS restarts FROM orders JOIN l ON o_orderkey = l_orderkey)
SELECT o_orderkey, round(CASE WHEN type IN ('zip', 'docx', 'sqlite') THEN len(list_filter(states, lambda s: s = 'ok')) / len(states)
WHEN type = 'pdf' THEN len(list_filter(objects, lambda o: o.status IN ('ok', 'corrupted') AND o.reason IS NULL)) / len(objects)
WHEN type = 'jpeg' AND rows_total > 0 THEN least(1.0, greatest(restarts - 1, 0) / greatest(rows_total - 1, 1)) END, 6) AS ratio,
round(CASE WHEN o_orderkey % 10 = 0 THEN 100 ELSE 100 * exp(list_sum(list_transform(links, lambda c: ln(greatest(c, 0.000001)))) / len(links)) * greatest(0.5, 1 - 0.1 * (o_custkey % 8)) END, 6) AS relationship FROM f""")
def q_verified_share(t: Tables) -> DataFrame:
    """The verified share of each file by its type, and the confidence of its links."""
    price = F.rint("o_totalprice").cast("long")
    ratio = R.checksum_ratio(F.col("type"), F.col("states"), F.col("objects"), F.col("states"), F.col("o_custkey") % 50, F.lit(1), price % 60)
    link = R.relationship_confidence(F.col("o_orderkey") % 10 == 0, F.col("links"), F.lit(False), F.lit(0), F.col("o_custkey") % 8)
    return _orders(t).select("o_orderkey", F.round(ratio, 6).alias("ratio"), F.round(link, 6).alias("relationship"))


@query("""WITH f AS (SELECT l_orderkey, ['zip', 'pdf', 'sqlite', 'jpeg', 'docx', 'log'][l_orderkey % 6 + 1] AS type, ['jpeg', 'pdf', 'compressed', 'text', 'sqlite', 'xml', 'log'][l_suppkey % 7 + 1] AS family FROM lineitem),
s AS (SELECT l_orderkey, type, avg(CASE WHEN list_contains(CASE type WHEN 'docx' THEN ['compressed', 'xml'] WHEN 'zip' THEN ['compressed'] WHEN 'log' THEN ['log', 'text'] ELSE [type] END, family) THEN 1.0 ELSE 0 END) AS share FROM f GROUP BY ALL),
d AS (SELECT l_orderkey, CASE WHEN type = 'log' THEN 70 * share ELSE CASE WHEN l_orderkey % 2 = 0 AND l_orderkey % 5 <> 0 THEN 60 ELSE 0 END + 40 * share END AS detection FROM s)
SELECT l_orderkey AS file, 'detection' AS measure, round(detection, 6) AS value FROM d UNION ALL SELECT l_orderkey, 'links', round(l_orderkey % 90, 6) FROM d""")
def q_confidence_profile(t: Tables) -> DataFrame:
    """The measures of each file, a row each."""
    sure = R.detection(F.col("type"), F.col("o_orderkey") % 2 == 0, F.col("o_orderkey") % 5 == 0, F.col("families"))
    rows = _orders(t).select(F.col("o_orderkey").alias("file"), F.explode(R.profile(detection=sure, links=F.col("o_orderkey") % 90)).alias("m"))
    return rows.select("file", "m.measure", F.round("m.value", 6).alias("value"))


@query("""WITH c AS (SELECT l_orderkey, l_linenumber::BIGINT * 1000000000 + l_partkey AS k, 'check ' || l_linenumber AS name, ['pass', 'fail', 'partial', 'na'][(l_partkey + l_linenumber) % 4 + 1] AS status, 'seen at ' || l_partkey || '; more' AS detail, CASE WHEN l_linenumber = 4 THEN 'advisory' ELSE 'structural' END AS category FROM lineitem),
n AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey, status IN ('fail', 'partial') ORDER BY k) AS rn FROM c WHERE category <> 'advisory')
SELECT o.l_orderkey AS file, concat_ws('; ', (SELECT string_agg(name || ': ' || split_part(detail, ';', 1), '; ' ORDER BY k) FROM n WHERE n.l_orderkey = o.l_orderkey AND status IN ('fail', 'partial') AND rn <= 3),
(SELECT CASE WHEN count_if(status = 'pass') > 0 THEN count_if(status = 'pass') || '/' || count(*) || ' checks pass' END FROM n WHERE n.l_orderkey = o.l_orderkey)) AS digest FROM (SELECT DISTINCT l_orderkey FROM lineitem) o""")
def q_checks_digest(t: Tables) -> DataFrame:
    """Lines stand for the checks of an order."""
    n = F.col("l_linenumber")
    item = F.struct((n.cast("long") * 1000000000 + F.col("l_partkey")).alias("k"), F.concat(F.lit("check "), n.cast("string")).alias("name"), _pick(("pass", "fail", "partial", "na"), (F.col("l_partkey") + n) % 4).alias("status"), F.concat(F.lit("seen at "), F.col("l_partkey").cast("string"), F.lit("; more")).alias("detail"), F.when(n == 4, "advisory").otherwise("structural").alias("category"))
    checks = t.lineitem.groupBy(F.col("l_orderkey").alias("file")).agg(F.array_sort(F.collect_list(item)).alias("checks"))
    return checks.select("file", R.checks_digest(F.col("checks")).alias("digest"))


@query(r"""SELECT p_partkey, coalesce(nullif(regexp_replace(regexp_replace(regexp_replace(p_name || CASE WHEN p_partkey % 3 = 0 THEN '.v1.pdf' ELSE '' END, '\.[^.]*$', ''), '[^A-Za-z0-9._-]+', '_', 'g'), '^[._]+|[._]+$', '', 'g'), ''), 'recovered') || '__rec' || CASE WHEN p_size > 9999 THEN p_size::VARCHAR ELSE lpad(p_size::VARCHAR, 4, '0') END || '.bin' AS name FROM part""")
def q_final_names(t: Tables) -> DataFrame:
    name = F.concat(F.lit("/some/folder/"), F.col("p_name"), F.when(F.col("p_partkey") % 3 == 0, ".v1.pdf").otherwise(""))
    return t.part.select("p_partkey", R.final_name(name, F.col("p_size"), F.lit("bin")).alias("name"))


_TIME = "strftime(o_orderdate, '%Y-%m-%d %H:%M:%S')"


@query(f"""SELECT o_orderkey, CASE WHEN o_orderkey % 4 = 3 THEN try_cast(CASE WHEN o_custkey % 3 = 0 THEN '2020-02-30 10:00:00' ELSE '2021-03-04 05:06:07' END AS TIMESTAMP) ELSE o_orderdate END AS modified FROM (SELECT *, {_TIME} AS s FROM orders)""")
def q_modified(t: Tables) -> DataFrame:
    """Times of four origins; the last of them may be no time at all."""
    s, k = F.date_format("o_orderdate", "yyyy-MM-dd HH:mm:ss"), F.col("o_orderkey") % 4
    stamp = F.when(F.col("o_custkey") % 3 == 0, "2020-02-30 10:00:00").otherwise("2021-03-04T05:06:07")
    found = R.modified_time(F.when(k == 0, s), F.when(k == 1, F.date_format("o_orderdate", "yyyy:MM:dd HH:mm:ss")), F.when(k == 2, F.replace(s, F.lit(" "), F.lit("T"))), stamp)
    return t.orders.select("o_orderkey", found.cast("timestamp_ntz").alias("modified"))


@query(f"""SELECT doc_id, length(s)::BIGINT AS n, sha256(s) AS digest FROM (SELECT doc_id, left(CASE type WHEN 'jpeg' THEN source || ' ' || lang WHEN 'pdf' THEN text || chr(10) || source WHEN 'sqlite' THEN source || chr(10) || text ELSE text END, 20000) AS s FROM (SELECT *, {_TYPE_SQL} AS type FROM documents WHERE text IS NOT NULL))""")
def q_search_text(t: Tables) -> DataFrame:
    docs = t.documents.where("text is not null").withColumn("type", F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in _TYPES.items() for x in kv]), F.col("lang")), F.lit("log")))
    text, source = F.col("text"), F.col("source")
    found = R.search_text(F.col("type"), F.array(text, source), text, F.array(source, text), F.create_map(F.lit("Make"), source, F.lit("Model"), F.col("lang")))
    return docs.select("doc_id", found.alias("s")).select("doc_id", F.length("s").cast("long").alias("n"), F.sha2(F.col("s").cast("binary"), 256).alias("digest"))


@query("""WITH e AS (SELECT l_partkey AS a, l_suppkey + 1000000 AS b, l_shipdate, CASE l_returnflag WHEN 'R' THEN 'content_similarity' WHEN 'A' THEN 'temporal' ELSE 'container' END AS type FROM lineitem),
u AS (SELECT a AS file, b AS other FROM e WHERE type <> 'container' UNION ALL SELECT b, a FROM e WHERE type <> 'container') SELECT file, count(DISTINCT other) AS related FROM u GROUP BY file""")
def q_related_files(t: Tables) -> DataFrame:
    kind = F.when(F.col("l_returnflag") == "R", "content_similarity").when(F.col("l_returnflag") == "A", "temporal").otherwise("container")
    return R.related_files(t.lineitem.select(F.col("l_partkey").alias("a"), (F.col("l_suppkey") + 1000000).alias("b"), kind.alias("type")))


@query(f"""WITH f AS ({_FILES}), d AS (SELECT sum(missing * 512) AS unrecoverable, coalesce(sum(CASE WHEN ok THEN expected END), 0) AS declared, coalesce(sum(CASE WHEN ok THEN least(expected, n_chars) END), 0) AS located FROM (SELECT *, coalesce(expected, 0) > 0 AND NOT orphan AND NOT single AS ok FROM f))
SELECT unrecoverable::BIGINT AS unrecoverable, declared::BIGINT AS declared, located::BIGINT AS located, CASE WHEN declared > 0 THEN round(100 * located / declared, 1) END AS coverage FROM d""")
def q_case_summary(t: Tables) -> DataFrame:
    files = _files(t).select((F.col("missing") * 512).alias("missing"), "expected", F.col("n_chars").alias("recovered"), "orphan", "single")
    return R.case_summary(files)


@query(f"""WITH f AS ({_FILES}), n AS (SELECT ['pdf', 'jpeg', 'sqlite', 'text'][l_linenumber % 4 + 1] AS family, count(*) AS n FROM lineitem WHERE l_returnflag = 'N' GROUP BY 1)
SELECT doc_id, CASE WHEN missing > 0 THEN coalesce(n, 0) ELSE 0 END AS remaining FROM f LEFT JOIN n ON family = type""")
def q_remaining(t: Tables) -> DataFrame:
    """Free fragments of each file's family; lines that were not returned stand for free fragments."""
    free = t.lineitem.where("l_returnflag = 'N'").select(_pick(("pdf", "jpeg", "sqlite", "text"), F.col("l_linenumber") % 4).alias("family"))
    return R.remaining_compatible(_files(t).select("doc_id", F.col("type").alias("family"), "missing"), free).select("doc_id", "remaining")


@query("SELECT CASE l_linenumber % 3 WHEN 0 THEN 'metadata' WHEN 1 THEN 'continuation' ELSE 'structural' END AS type, count_if(l_returnflag <> 'R') AS accepted, round(100 * avg(CASE WHEN l_returnflag <> 'R' THEN l_discount END), 1) AS mean, count_if(l_returnflag = 'R') AS alternatives FROM lineitem GROUP BY 1")
def q_link_report(t: Tables) -> DataFrame:
    edges = t.lineitem.select(_pick(("metadata", "continuation", "structural"), F.col("l_linenumber") % 3).alias("type"), (F.col("l_returnflag") != "R").alias("chosen"), F.col("l_discount").alias("confidence"))
    return R.link_report(edges)


@query("""WITH f AS (SELECT l_orderkey AS file, list(DISTINCT 'F' || l_partkey) AS fragments FROM lineitem GROUP BY 1), r AS (SELECT o_orderkey AS file, o_orderstatus AS status, o_orderpriority AS band, CASE WHEN o_custkey % 4 <> 0 THEN o_totalprice / 3000 END AS integrity, fragments FROM orders JOIN f ON file = o_orderkey)
SELECT file, status, band, integrity, len(fragments)::BIGINT AS n_fragments FROM r WHERE status IN ('F', 'P') AND coalesce(integrity, 0) >= 20 AND (contains(lower('order-' || file), '7') OR list_contains(list_transform(fragments, lambda x: lower(x)), '7') OR contains(lower(band), '7'))""")
def q_list_files(t: Tables) -> DataFrame:
    """The file list with types, least scores and a query."""
    parts = t.lineitem.groupBy("l_orderkey").agg(F.collect_set(F.concat(F.lit("F"), F.col("l_partkey").cast("string"))).alias("fragments"))
    files = t.orders.join(parts, F.col("o_orderkey") == F.col("l_orderkey")).select(
        F.col("o_orderkey").alias("file"), F.col("o_orderstatus").alias("status"), F.col("o_orderpriority").alias("band"), F.when(F.col("o_custkey") % 4 != 0, F.col("o_totalprice") / 3000).alias("integrity"),
        F.concat(F.lit("Order-"), F.col("o_orderkey").cast("string")).alias("name"), F.col("o_orderpriority").alias("search_text"), "fragments",
    )
    found = R.list_files(files, statuses=("F", "P"), integrity=20, query=" 7 ")
    return R.slim(found, ("file", "status", "band", "integrity"), ("fragments",)).withColumn("n_fragments", F.col("n_fragments").cast("long"))


_AUDIT = "SELECT event_id AS id, CASE event_id % 5 WHEN 0 THEN 'ingest' WHEN 1 THEN 'scan' ELSE event_type END AS stage, CASE WHEN user_id % 7 = 0 THEN 'R007: ' ELSE 'R' || user_id || ' ' END || event_type AS message FROM events"


@query(f"""WITH a AS ({_AUDIT}), i AS (SELECT * FROM a WHERE stage IN ('ingest', 'scan', 'identify') ORDER BY id LIMIT 4)
SELECT * FROM (SELECT * FROM a WHERE starts_with(message, 'R007:') OR starts_with(message, 'R007 ') UNION SELECT * FROM i) ORDER BY id LIMIT 40""")
def q_file_audit(t: Tables) -> DataFrame:
    """The log page of one file; events stand for the log."""
    i = F.col("event_id")
    stage = F.when(i % 5 == 0, "ingest").when(i % 5 == 1, "scan").otherwise(F.col("event_type"))
    who = F.when(F.col("user_id") % 7 == 0, "R007: ").otherwise(F.concat(F.lit("R"), F.col("user_id").cast("string"), F.lit(" ")))
    return R.file_audit(t.events.select(i.alias("id"), stage.alias("stage"), F.concat(who, F.col("event_type")).alias("message")), "R007")
