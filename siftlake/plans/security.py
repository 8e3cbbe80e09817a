"""Queries of the security analysis. Documents stand for artefacts; a short head by doc_id plays the executable, the
script, the active PDF or the appended archive, as the texts themselves hold none."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators import security as X
from .registry import Tables, query

HEADS = (
    "%PDF-1.7 /OpenAction /JS ",
    "%PDF-1.4 /AA ",
    "x powershell -ENC y DownloadString( ",
    "#! cmd.exe /c ",
    "PK\x03\x04 word/vbaProject.bin ",
    "text %PDF-1.3 ",
    "MZ This program cannot be run in DOS mode %PDF- ",
    "data PK\x01\x02 and PK\x05\x06 ",
    "%PDF-1.5 /EmbeddedFile ",
    "",
    "AutoOpen ",
)


def _sql_text(chars: str) -> str:
    """The characters as an SQL expression, those that do not print by number."""
    return " || ".join(f"'{c}'" if " " <= c <= "~" and c != "'" else f"chr({ord(c)})" for c in chars) or "''"


_HEADS_SQL = "CASE doc_id % 11 " + " ".join(f"WHEN {i} THEN {_sql_text(h)}" for i, h in enumerate(HEADS)) + " END"
_ARTEFACTS = f"SELECT doc_id, source, {_HEADS_SQL} || coalesce(text, '') AS x FROM documents"


def _artefacts(t: Tables) -> DataFrame:
    head = F.element_at(F.array(*[F.lit(h) for h in HEADS]), (F.col("doc_id") % 11 + 1).cast("int"))
    return t.documents.select("doc_id", "source", F.concat(head, F.coalesce("text", F.lit(""))).cast("binary").alias("data"))


def _at(chars: str, nocase: bool) -> str:
    """Byte offset of the first occurrence, -1 if there is none."""
    x, mark = ("lower(x)", _sql_text(chars.lower())) if nocase else ("x", _sql_text(chars))
    return f"CASE WHEN instr({x}, {mark}) > 0 THEN octet_length(encode(left(x, instr({x}, {mark}) - 1))) ELSE -1 END"


def rule_sql(rule: X.Rule, key: str = "doc_id") -> str:
    """SQL for one rule over a table a (key, x)."""
    found = ", ".join(f"{_at(c, n)} AS {name}" for name, c, n in rule.strings)
    holds = " OR ".join("(" + " AND ".join(f"{name} >= 0" for name in every) + ")" for every in rule.any_of)
    every = "[" + ", ".join(name for name, _, _ in rule.strings) + "]"
    offsets = f"array_to_string(list_sort(list_filter({every}, lambda v: v >= 0))[1:5], ' ')"
    return f"SELECT {key}, '{rule.name}' AS rule, '{rule.severity}' AS severity, {offsets} AS offsets FROM (SELECT {key}, {found} FROM a) WHERE {holds}"


_RULES_SQL = " UNION ALL ".join(map(rule_sql, X.RULES))


@query(f"WITH a AS ({_ARTEFACTS}) {_RULES_SQL}")
def q_rule_scan(t: Tables) -> DataFrame:
    """Every rule that holds for an artefact, with the first offsets of its strings."""
    hits = _artefacts(t).select("doc_id", F.explode(X.rule_hits(F.col("data"))).alias("r"))
    return hits.select("doc_id", "r.rule", "r.severity", F.array_join(F.col("r.offsets").cast("array<string>"), " ").alias("offsets"))


_MAGIC_SQL = "CASE " + " ".join(f"WHEN starts_with(hex(encode(x)), '{m}') THEN '{label}'" for m, label in X.MAGIC) + " END"


@query(f"""WITH a AS ({_ARTEFACTS}), b AS (SELECT doc_id, octet_length(encode(x)) AS n, regexp_extract_all(hex(encode(x)), '..') AS h FROM a),
w AS (SELECT doc_id, w, h[w * 4096 + 1:(w + 1) * 4096] AS part FROM (SELECT *, unnest(range((n + 4095) // 4096)) AS w FROM b)),
c AS (SELECT doc_id, w, byte, count(*) AS n FROM (SELECT doc_id, w, unnest(part) AS byte FROM w) GROUP BY ALL),
e AS (SELECT doc_id, w, log2(sum(n)) - sum(n * log2(n)) / sum(n) AS entropy FROM c GROUP BY ALL),
m AS (SELECT doc_id, count(*) AS windows, round(max(entropy), 6) AS highest, max(CASE WHEN w = 0 THEN entropy END) AS first FROM e GROUP BY doc_id)
SELECT a.doc_id, coalesce({_MAGIC_SQL}, CASE WHEN first > 5 THEN 'unknown binary' ELSE 'unknown / text-like data' END) AS identified, coalesce(windows, 0)::BIGINT AS windows, coalesce(highest, 0) AS highest FROM a LEFT JOIN m USING (doc_id)""")
def q_static_profile(t: Tables) -> DataFrame:
    """What the first bytes say, and the highest entropy of any window; without a known beginning, the first window decides."""
    files = _artefacts(t)
    by_window = X.entropy_windows(files, "doc_id", "data")
    summed = by_window.groupBy("doc_id").agg(F.count(F.lit(1)).alias("windows"), F.round(F.max("entropy"), 6).alias("highest"), F.max(F.when(F.col("window") == 0, F.col("entropy"))).alias("first"))
    unknown = F.when(F.col("first") > 5, "unknown binary").otherwise("unknown / text-like data")
    met = files.select("doc_id", X.magic_label(F.col("data")).alias("label")).join(summed, "doc_id", "left")
    return met.select("doc_id", F.coalesce("label", unknown).alias("identified"), F.coalesce("windows", F.lit(0)).alias("windows"), F.coalesce("highest", F.lit(0.0)).alias("highest"))


_POLY_SQL = f"""SELECT doc_id, 'pdf_inside' AS kind, octet_length(encode(left(x, instr(x, '%PDF-') - 1)))::INT AS place FROM a WHERE instr(x, '%PDF-') > 1 AND octet_length(encode(left(x, instr(x, '%PDF-') - 1))) + 5 <= 1024
UNION ALL SELECT doc_id, 'archive_appended', octet_length(encode(left(x, instr(x, {_sql_text('PK' + chr(5) + chr(6))}) - 1)))::INT FROM a WHERE contains(x, {_sql_text('PK' + chr(5) + chr(6))}) AND contains(x, {_sql_text('PK' + chr(1) + chr(2))}) AND NOT starts_with(x, {_sql_text('PK' + chr(3) + chr(4))}) AND octet_length(encode(substring(x, instr(x, {_sql_text('PK' + chr(5) + chr(6))})))) <= 65557
UNION ALL SELECT doc_id, 'executable_with_document', 0 FROM a WHERE starts_with(x, 'MZ') AND (contains(x, '%PDF-') OR contains(x, {_sql_text('PK' + chr(5) + chr(6))}))"""


@query(f"WITH a AS ({_ARTEFACTS}) {_POLY_SQL}")
def q_polyglots(t: Tables) -> DataFrame:
    """Artefacts whose bytes hold a second format."""
    found = _artefacts(t).select("doc_id", F.explode(X.polyglots(F.col("data"))).alias("p"))
    return found.select("doc_id", "p.kind", F.col("p.offset").alias("place"))


_ENGINE_SQL = "CASE WHEN doc_id % 13 = 0 THEN NULL WHEN doc_id % 97 = 5 THEN 'MALWARE_DETECTED' WHEN doc_id % 29 = 3 THEN 'SCAN_FAILED' ELSE 'CLEAN' END"


def _engine(doc_id: Column) -> Column:
    return F.when(doc_id % 13 == 0, None).when(doc_id % 97 == 5, "MALWARE_DETECTED").when(doc_id % 29 == 3, "SCAN_FAILED").otherwise("CLEAN")


def _verdicts(t: Tables) -> DataFrame:
    data = F.col("data")
    return _artefacts(t).select("doc_id", X.verdict(_engine(F.col("doc_id")), X.rule_hits(data), F.size(X.polyglots(data))).alias("status"))


_VERDICT_SQL = f"""a AS ({_ARTEFACTS}), r AS ({_RULES_SQL}), p AS ({_POLY_SQL}),
v AS (SELECT doc_id, CASE WHEN e = 'MALWARE_DETECTED' THEN e WHEN doc_id IN (SELECT doc_id FROM r) OR doc_id IN (SELECT doc_id FROM p) THEN 'SUSPICIOUS' WHEN e = 'SCAN_FAILED' THEN e WHEN e IS NULL THEN 'NOT_SCANNED' ELSE 'CLEAN' END AS status
FROM (SELECT doc_id, {_ENGINE_SQL} AS e FROM documents))"""


@query(f"WITH {_VERDICT_SQL} SELECT doc_id, status FROM v")
def q_verdict(t: Tables) -> DataFrame:
    return _verdicts(t)


@query(f"""WITH {_VERDICT_SQL}, o AS (SELECT doc_id, CASE WHEN toxic = 1 THEN 'SUSPICIOUS' ELSE 'CLEAN' END AS status FROM labels)
SELECT doc_id, o.status AS before, v.status AS after, CASE WHEN o.status IS NULL THEN 'new' WHEN v.status IS NULL THEN 'gone' WHEN list_position(k, v.status) > list_position(k, o.status) THEN 'raised' WHEN list_position(k, v.status) < list_position(k, o.status) THEN 'lowered' ELSE 'same' END AS change
FROM o FULL JOIN v USING (doc_id), (SELECT ['CLEAN', 'NOT_SCANNED', 'SCAN_FAILED', 'SUSPICIOUS', 'MALWARE_DETECTED'] AS k)""")
def q_rescan(t: Tables) -> DataFrame:
    """Verdicts against those of an earlier scan, which the labels stand for."""
    before = t.labels.select("doc_id", F.when(F.col("toxic") == 1, "SUSPICIOUS").otherwise("CLEAN").alias("status"))
    return X.rescan(before, _verdicts(t), "doc_id")


@query(f"""WITH a AS ({_ARTEFACTS}), r AS ({_RULES_SQL}), p AS ({_POLY_SQL}) SELECT doc_id, 'engine' AS origin, 'test engine' AS text FROM documents WHERE doc_id % 97 = 5 AND doc_id % 13 <> 0
UNION ALL SELECT doc_id, 'rule', rule FROM r UNION ALL SELECT doc_id, 'static', kind FROM p""")
def q_guardian(t: Tables) -> DataFrame:
    """All detections of every artefact in one list."""
    data, none = F.col("data"), F.array().cast("array<string>")
    names = F.when(_engine(F.col("doc_id")) == "MALWARE_DETECTED", F.array(F.lit("test engine"))).otherwise(none)
    found = _artefacts(t).select("doc_id", F.explode(X.guardian(_engine(F.col("doc_id")), names, X.rule_hits(data), X.polyglots(data))).alias("d"))
    return found.select("doc_id", F.col("d.source").alias("origin"), "d.text")


@query("""WITH m AS (SELECT l_orderkey AS archive, p_name || CASE l_linenumber WHEN 1 THEN '.EXE' WHEN 2 THEN '.xml' WHEN 3 THEN '.zip' WHEN 4 THEN '/vbaProject.bin' WHEN 5 THEN '.js' ELSE '.txt' END AS name, l_quantity::INT AS flags FROM lineitem JOIN part ON p_partkey = l_partkey)
SELECT archive, count(*) AS members, count_if(regexp_matches(lower(name), '\\.(exe|js)$')) AS risky, count_if(ends_with(name, '.zip')) AS nested, count_if(flags % 2 = 1) AS encrypted, bool_or(ends_with(name, 'vbaProject.bin')) AS macro FROM m GROUP BY archive""")
def q_archives(t: Tables) -> DataFrame:
    """Orders stand for archives, their lines for members."""
    kind = F.element_at(F.array(*[F.lit(x) for x in (".EXE", ".xml", ".zip", "/vbaProject.bin", ".js", ".txt", ".txt")]), F.col("l_linenumber"))
    members = t.lineitem.join(t.part, F.col("p_partkey") == F.col("l_partkey")).select(F.col("l_orderkey").alias("archive"), F.concat("p_name", kind).alias("name"), F.col("l_quantity").cast("int").alias("flags"))
    return X.archive_profile(members, "archive", "name", "flags")
