"""Queries over bytes and text: entropy, histograms, classes of blocks, markers, rules, identifiers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import relational as R
from ..operators import security
from .registry import Tables, query
from .security import rule_sql

BLOCK = 512


def byte_counts(df: DataFrame, key: str, data: Column) -> DataFrame:
    """(key, byte as hex, n): exploded once, counted with map-side sums."""
    return df.select(key, F.explode(S.byte_array(data)).alias("b")).groupBy(key, "b").agg(F.count(F.lit(1)).alias("n"))


def entropies(df: DataFrame, key: str, data: Column) -> DataFrame:
    """(key, n_bytes, entropy) in bits per byte: log2 N - sum(n log2 n) / N."""
    by = byte_counts(df, key, data).groupBy(key).agg(F.sum("n").alias("n_bytes"), F.sum(F.col("n") * F.log2("n")).alias("s"))
    return by.select(key, "n_bytes", F.round(F.log2("n_bytes") - F.col("s") / F.col("n_bytes"), 6).alias("entropy"))


BYTES_SQL = "SELECT doc_id, unnest(regexp_extract_all(hex(encode(text)), '..')) AS b FROM documents"


@query(f"""WITH c AS (SELECT doc_id, b, count(*) AS n FROM ({BYTES_SQL}) GROUP BY 1, 2)
SELECT doc_id, sum(n)::BIGINT AS n_bytes, round(log2(sum(n)) - sum(n * log2(n)) / sum(n), 6) AS entropy FROM c GROUP BY doc_id""")
def q_entropy(t: Tables) -> DataFrame:
    return entropies(t.documents, "doc_id", F.col("text").cast("binary"))


@query(r"""SELECT doc_id, round(length(regexp_replace(text, '[^\x20-\x7e\t\n\r]', '', 'g')) / octet_length(encode(text)), 6) AS printable
FROM documents WHERE length(text) > 0""")
def q_printable(t: Tables) -> DataFrame:
    ratio = S.printable_ratio(F.col("text").cast("binary"))
    return t.documents.where(F.length("text") > 0).select("doc_id", F.round(ratio, 6).alias("printable"))


@query(f"""WITH c AS (SELECT doc_id, ('0x' || b)::INT // 8 AS bin, count(*) AS n FROM ({BYTES_SQL}) GROUP BY 1, 2)
SELECT doc_id, bin::INT AS bin, n, round(n / sqrt(sum(n * n) OVER (PARTITION BY doc_id)), 6) AS share FROM c""")
def q_hist_bins(t: Tables) -> DataFrame:
    by = byte_counts(t.documents, "doc_id", F.col("text").cast("binary"))
    bins = by.groupBy("doc_id", F.shiftright(F.conv("b", 16, 10).cast("int"), 3).alias("bin")).agg(F.sum("n").alias("n"))
    norm = bins.groupBy("doc_id").agg(F.sqrt(F.sum(F.col("n") * F.col("n"))).alias("norm"))
    return bins.join(norm, "doc_id").select("doc_id", "bin", "n", F.round(F.col("n") / F.col("norm"), 6).alias("share"))


@query("SELECT doc_id, sha256(text) AS sha256, '0x' || lpad(printf('%X', doc_id * 4096), 8, '0') AS at FROM documents WHERE text IS NOT NULL")
def q_hash_offset(t: Tables) -> DataFrame:
    docs = t.documents.where("text is not null")
    return docs.select("doc_id", F.sha2(F.col("text").cast("binary"), 256).alias("sha256"), S.hex_offset(F.col("doc_id") * 4096).alias("at"))


def text_blocks(df: DataFrame, size: int = BLOCK) -> DataFrame:
    """(doc_id, block, part): runs of `size` characters."""
    starts = F.sequence(F.lit(0), F.greatest(F.ceil(F.length("text") / size) - 1, F.lit(0)))
    blocks = df.where(F.length("text") > 0).select("doc_id", "text", F.explode(starts).alias("block"))
    return blocks.select("doc_id", F.col("block").cast("long").alias("block"), F.substring("text", (F.col("block") * size + 1).cast("int"), F.lit(size)).alias("part"))


BLOCKS_SQL = f"""SELECT doc_id, block, substring(text, block * {BLOCK} + 1, {BLOCK}) AS part FROM (
SELECT doc_id, text, unnest(range(0, (length(text) + {BLOCK - 1}) // {BLOCK})) AS block FROM documents WHERE length(text) > 0)"""


def block_class(part: Column) -> Column:
    share = F.length(F.regexp_replace(part, S.ASCII_PRINTABLE, "")) / F.length(part)
    return (
        F.when(share < 0.92, "binary")
        .when(F.contains(part, F.lit("%PDF-")) | F.contains(part, F.lit("endobj")), "pdf_text")
        .when(F.regexp_count(part, F.lit(S.TIMESTAMP_RE)) >= 3, "log_text")
        .when((F.length(part) - F.length(F.replace(part, F.lit("<"), F.lit(""))) > 20) & F.contains(part, F.lit("</")), "xml_text")
        .otherwise("text")
    )


@query(f"""WITH b AS ({BLOCKS_SQL} UNION ALL SELECT page_id, block, substring(html, block * {BLOCK} + 1, {BLOCK}) FROM (
  SELECT page_id, html, unnest(range(0, (length(html) + {BLOCK - 1}) // {BLOCK})) AS block FROM pages WHERE length(html) > 0)),
c AS (SELECT CASE WHEN length(regexp_replace(part, '[^\\x20-\\x7e\\t\\n\\r]', '', 'g')) / length(part) < 0.92 THEN 'binary'
  WHEN contains(part, '%PDF-') OR contains(part, 'endobj') THEN 'pdf_text'
  WHEN len(regexp_extract_all(part, '20\\d\\d-\\d\\d-\\d\\d[T ]\\d\\d:\\d\\d:\\d\\d')) >= 3 THEN 'log_text'
  WHEN length(part) - length(replace(part, '<', '')) > 20 AND contains(part, '</') THEN 'xml_text' ELSE 'text' END AS class FROM b)
SELECT class, CASE class WHEN 'pdf_text' THEN 'pdf' WHEN 'log_text' THEN 'log' WHEN 'xml_text' THEN 'xml' ELSE class END AS family, count(*) AS n FROM c GROUP BY 1, 2""")
def q_block_class(t: Tables) -> DataFrame:
    from ..functions.fixed import FAMILY

    pages = t.pages.select(F.col("page_id").alias("doc_id"), F.col("html").alias("text"))
    parts = text_blocks(t.documents).unionByName(text_blocks(pages)).select(block_class(F.col("part")).alias("class"))
    family = F.element_at(F.create_map(*[F.lit(x) for kv in FAMILY.items() for x in kv]), F.col("class"))
    return parts.groupBy("class").agg(F.count(F.lit(1)).alias("n")).select("class", family.alias("family"), "n")


@query("""SELECT doc_id, CASE WHEN first <> doc_id THEN first END AS duplicate_of FROM (
SELECT doc_id, min(doc_id) OVER (PARTITION BY text) AS first FROM documents)""")
def q_dups(t: Tables) -> DataFrame:
    return R.first_of_equal(t.documents.select("doc_id", "text"), F.sha2(F.col("text").cast("binary"), 256), [], "doc_id").select("doc_id", "duplicate_of")


@query(f"""WITH b AS ({BLOCKS_SQL}), o AS (SELECT part, min(doc_id) AS owner FROM b GROUP BY part)
SELECT doc_id, min(owner) AS owner FROM b JOIN o USING (part) GROUP BY doc_id HAVING min(owner) = max(owner) AND min(owner) <> doc_id""")
def q_block_dups(t: Tables) -> DataFrame:
    parts = text_blocks(t.documents).select("doc_id", F.sha2(F.col("part").cast("binary"), 256).alias("h"))
    return R.single_owner(parts, "doc_id", "h")


IDENTIFIERS = {
    "email": S.EMAIL_RE,
    "ipv4": S.IPV4_RE,
    "url": S.URL_RE,
    "uuid": r"[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}",
    "numbered": r"[A-Z]{2,5}-\d{2,6}",
}


def identifiers(docs: DataFrame) -> DataFrame:
    """(doc_id, kind, value), distinct."""

    def found_of(kind: str, pattern: str) -> Column:
        values = F.regexp_extract_all("text", F.lit(f"({pattern})"), F.lit(1))
        return F.transform(values, lambda v: F.struct(F.lit(kind).alias("kind"), v.alias("value")))

    found = [found_of(k, p) for k, p in IDENTIFIERS.items()]
    return docs.select("doc_id", F.explode(F.concat(*found)).alias("x")).select("doc_id", "x.kind", "x.value").distinct()


#: Holders of one identifier that meet in one task; more are split.
HOLDERS_SLICE = 1024


def shared_identifiers(ids: DataFrame) -> DataFrame:
    """(doc_id, first, shared, confidence) of all pairs of documents with a common (kind, value), first < doc_id.

    Values of one holder link nothing and are left out. Documents with equal sets of the rest are one class, which its
    smallest doc_id stands for; shared values are counted between classes and the members put back in."""
    held = ids.groupBy("kind", "value").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    sets = ids.join(held, ["kind", "value"]).groupBy("doc_id").agg(F.array_sort(F.collect_set(F.struct("kind", "value"))).alias("set"))
    hashed = sets.select("doc_id", F.sha2(F.to_json("set"), 256).alias("h"))
    members = hashed.join(hashed.groupBy("h").agg(F.min("doc_id").alias("class")), "h").select("doc_id", "class")
    terms = sets.join(members.where("doc_id = class"), "doc_id").select("class", F.explode("set").alias("x")).select("class", "x.kind", "x.value")
    parts = terms.groupBy("kind", "value").agg(F.ceil(F.count(F.lit(1)) / HOLDERS_SLICE).cast("int").alias("parts"))
    sized = terms.join(parts, ["kind", "value"])
    left = sized.select("kind", "value", F.col("class").alias("ca"), F.pmod(F.xxhash64("class"), "parts").cast("int").alias("part"))
    right = sized.select("kind", "value", F.col("class").alias("cb"), F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
    met = left.join(right, ["kind", "value", "part"]).where("ca <= cb").groupBy("ca", "cb").agg(F.count(F.lit(1)).alias("shared"))
    a, b = (members.select(F.col("class").alias(c), F.col("doc_id").alias(d)) for c, d in (("ca", "da"), ("cb", "db")))
    pairs = met.join(a, "ca").join(b, "cb").where("ca <> cb or da < db")
    found = pairs.select(F.greatest("da", "db").alias("doc_id"), F.least("da", "db").alias("first"), "shared")
    return found.withColumn("confidence", F.round(F.least(F.lit(0.8), 0.45 + 0.1 * F.col("shared")), 6))


_IDS_SQL = " UNION ".join(f"SELECT doc_id, '{k}' AS kind, unnest(regexp_extract_all(text, '{p.replace(chr(39), chr(39) * 2)}')) AS value FROM documents" for k, p in IDENTIFIERS.items())


@query(_IDS_SQL)
def q_identifiers(t: Tables) -> DataFrame:
    return identifiers(t.documents)


@query(f"""WITH i AS ({_IDS_SQL}) SELECT x.doc_id, y.doc_id AS first, count(*)::BIGINT AS shared, round(least(0.8, 0.45 + 0.1 * count(*)), 6) AS confidence
FROM i x JOIN i y ON x.kind = y.kind AND x.value = y.value AND y.doc_id < x.doc_id GROUP BY 1, 2""")
def q_shared_identifiers(t: Tables) -> DataFrame:
    """Each two artefacts that share identifiers, the later one as doc_id, with the full number of them."""
    return shared_identifiers(identifiers(t.documents))


_LOGS = "SELECT o_custkey, string_agg('x ' || CASE WHEN o_orderkey % 2 = 0 THEN strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S') ELSE strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') END || ' done', chr(10) ORDER BY o_orderkey) AS text FROM orders GROUP BY o_custkey"


@query(rf"""SELECT o_custkey, len(ts)::BIGINT AS n, ts[1] AS first, ts[-1] AS last FROM (SELECT o_custkey, regexp_extract_all(text, '{S.TIMESTAMP_RE}') AS ts FROM ({_LOGS})) WHERE len(ts) > 0""")
def q_timestamps(t: Tables) -> DataFrame:
    """First and last stamp of each log; a customer's orders stand for its lines."""
    form = F.when(F.col("o_orderkey") % 2 == 0, F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss")).otherwise(F.date_format("o_orderdate", "yyyy-MM-dd HH:mm:ss"))
    line = F.struct("o_orderkey", F.concat(F.lit("x "), form, F.lit(" done")).alias("line"))
    logs = t.orders.groupBy("o_custkey").agg(F.array_join(F.transform(F.array_sort(F.collect_list(line)), lambda x: x["line"]), "\n").alias("text"))
    found = logs.select("o_custkey", F.regexp_extract_all("text", F.lit(f"({S.TIMESTAMP_RE})"), F.lit(1)).alias("ts")).where(F.size("ts") > 0)
    return found.select("o_custkey", F.size("ts").cast("long").alias("n"), F.element_at("ts", 1).alias("first"), F.element_at("ts", -1).alias("last"))


#: Rules of a user's own, beside the built-in ones.
OWN_RULES = (
    security.Rule("credential", "notice", (("p", "password=", True), ("k", "api_key", True), ("s", "secret", True)), (("p",), ("k",), ("s",))),
    security.Rule("script_markup", "notice", (("open", "<script", True), ("track", "track(", False)), (("open", "track"),)),
)
_TEXTS = "a AS (SELECT 'document' AS kind, doc_id AS id, text AS x FROM documents WHERE text IS NOT NULL UNION ALL SELECT 'page', page_id, html FROM pages WHERE html IS NOT NULL)"


@query(f"WITH {_TEXTS} " + " UNION ALL ".join(rule_sql(r, "kind, id") for r in (*security.RULES, *OWN_RULES)))
def q_rules(t: Tables) -> DataFrame:
    """Built-in and own rules over all documents and pages, with the first offsets of their strings."""
    docs = t.documents.where("text is not null").select(F.lit("document").alias("kind"), F.col("doc_id").alias("id"), F.col("text").cast("binary").alias("x"))
    pages = t.pages.where("html is not null").select(F.lit("page").alias("kind"), F.col("page_id").alias("id"), F.col("html").cast("binary").alias("x"))
    hits = docs.unionByName(pages).select("kind", "id", F.explode(security.rule_hits(F.col("x"), (*security.RULES, *OWN_RULES))).alias("r"))
    return hits.select("kind", "id", "r.rule", "r.severity", F.array_join(F.col("r.offsets").cast("array<string>"), " ").alias("offsets"))


_HEX_LINE = r"""trim(regexp_replace(h[2 * off + 1:least(2 * off + 32, 2 * stop)], '(..)', '\1 ', 'g')) AS line,
array_to_string(list_transform(regexp_extract_all(h[2 * off + 1:least(2 * off + 32, 2 * stop)], '..'), lambda b: CASE WHEN b BETWEEN '20' AND '7E' THEN chr(('0x' || b)::INT) ELSE '.' END), '') AS ascii"""


@query(f"""SELECT doc_id, off::BIGINT AS off, {_HEX_LINE} FROM (
SELECT doc_id, h, stop, unnest(range(start, stop, 16)) AS off FROM (SELECT *, greatest(0, least(100, n - 1)) AS start, least(n, greatest(0, least(100, n - 1)) + 512) AS stop FROM (
SELECT doc_id, upper(hex(encode(text))) AS h, octet_length(encode(text))::BIGINT AS n FROM documents WHERE length(text) > 0)))""")
def q_hex_view(t: Tables) -> DataFrame:
    """The view of an artefact: 512 bytes from byte 100 on, a window that the viewer chooses."""
    return hex_view(t.documents.select("doc_id", F.col("text").cast("binary").alias("v")), "doc_id", "v", 100, 512)


def hex_view(df: DataFrame, key: str, data: str, offset: int = 0, length: int | None = None) -> DataFrame:
    """(key, off, line, ascii): lines of sixteen bytes from an offset on, which is held within the data, over `length` bytes or
    to the end. Cut from the bytes, so a line costs the same wherever it stands."""
    size = F.octet_length(data)
    start = F.greatest(F.lit(0), F.least(F.lit(offset), size - 1))
    left = size - start if length is None else F.least(F.lit(length), size - start)
    views = df.where(size > 0).select(key, F.col(data).alias("_data"), start.alias("_start"), left.alias("_left")).where("_left > 0")
    offs = F.sequence(F.lit(0), F.col("_left") - 1, F.lit(16))

    def line(i: Column) -> Column:
        part = F.substring(F.col("_data"), F.col("_start") + i + 1, F.least(F.lit(16), F.col("_left") - i))
        shown = F.regexp_replace(S.as_latin1(part), "[^ -~]", ".")
        return F.struct((F.col("_start") + i).cast("long").alias("off"), F.trim(F.regexp_replace(F.hex(part), "(..)", "$1 ")).alias("line"), shown.alias("ascii"))

    return views.select(key, F.explode(F.transform(offs, line)).alias("l")).select(key, "l.off", "l.line", "l.ascii")


@query(f"""SELECT doc_id, off::BIGINT AS off, {_HEX_LINE} FROM (
SELECT doc_id, upper(hex(encode(text))) AS h, octet_length(encode(text))::BIGINT AS stop, unnest(range(0, octet_length(encode(text))::BIGINT, 16)) AS off FROM documents WHERE length(text) > 0)""")
def q_hex_dump(t: Tables) -> DataFrame:
    """Lines of sixteen bytes over the whole of each text."""
    return hex_view(t.documents.select("doc_id", F.col("text").cast("binary").alias("v")), "doc_id", "v")
