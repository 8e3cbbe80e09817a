"""Queries over the contents of files."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import content as X
from ..operators import security
from .registry import Tables, query
from .security import _ARTEFACTS, _artefacts, rule_sql


@query(r"""SELECT o_orderkey, CASE o_orderkey % 5 WHEN 0 THEN 'pdf' WHEN 1 THEN 'sqlite' WHEN 2 THEN 'zip' WHEN 3 THEN 'png' END AS kind, CASE o_orderkey % 5 WHEN 0 THEN '1.' || (o_custkey % 8) WHEN 1 THEN ['UTF-8', 'UTF-16le', 'UTF-16be'][o_custkey % 3 + 1] WHEN 2 THEN 'word/' || o_custkey || '.xml' END AS detail,
CASE o_orderkey % 5 WHEN 1 THEN CASE WHEN o_custkey % 2 = 0 THEN 4096 ELSE 65536 END WHEN 3 THEN o_custkey END::BIGINT AS size, CASE o_orderkey % 5 WHEN 1 THEN o_custkey WHEN 3 THEN o_orderkey END::BIGINT AS count FROM orders""")
def q_header_facts(t: Tables) -> DataFrame:
    """Facts of headers that are made from the keys of orders."""
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    number = lambda x, n: F.lpad(F.hex(x), 2 * n, "0")
    name = F.concat(F.lit("word/"), c.cast("string"), F.lit(".xml"))
    pdf = F.hex(F.concat(F.lit("%PDF-1."), (c % 8).cast("string"), F.lit("\nrest")).cast("binary"))
    sqlite = F.concat(F.lit("53514C69746520666F726D6174203300"), F.when(c % 2 == 0, "1000").otherwise("0001"), F.lit("00" * 10), number(c, 4), F.lit("00" * 24), number(c % 3 + 1, 4), F.lit("00" * 40))
    archive = F.concat(F.lit("504B0304" + "00" * 22), number(F.length(name), 1), F.lit("000000"), F.hex(name.cast("binary")))
    png = F.concat(F.lit("89504E470D0A1A0A0000000D49484452"), number(c, 4), number(k, 4), F.lit("0806"))
    digits = F.when(k % 5 == 0, pdf).when(k % 5 == 1, sqlite).when(k % 5 == 2, archive).when(k % 5 == 3, png).otherwise("00FF00")
    found = t.orders.select("o_orderkey", X.header_facts(F.unhex(digits)).alias("h"))
    return found.select("o_orderkey", "h.kind", "h.detail", "h.size", "h.count")


@query(r"""SELECT doc_id, sha256(coalesce(string_agg(w, chr(10) ORDER BY i), '')) AS pdf, sha256(coalesce(string_agg(w || ' <' || i || '>', chr(10) ORDER BY i), '')) AS docx FROM (
SELECT doc_id, unnest(ws) AS w, unnest(range(len(ws))) AS i FROM (SELECT doc_id, regexp_extract_all(text, '[A-Za-z]+') AS ws FROM documents WHERE text IS NOT NULL) WHERE len(ws) > 0) GROUP BY doc_id""")
def q_document_text(t: Tables) -> DataFrame:
    """The text of PDF contents and XML parts that are made from the words of documents."""
    words = t.documents.where("text is not null").select("doc_id", F.regexp_extract_all("text", F.lit("([A-Za-z]+)"), F.lit(1)).alias("ws")).where(F.size("ws") > 0)
    pdf = F.array_join(F.transform("ws", lambda w: F.concat(F.lit("BT ("), w, F.lit(") Tj ET"))), "\n")
    xml = F.array_join(F.transform("ws", lambda w, i: F.concat(F.lit('<w:p><w:r><w:t xml:space="preserve">'), w, F.lit("</w:t></w:r><w:r><w:t> &lt;"), i.cast("string"), F.lit("&gt;</w:t></w:r></w:p>"))), "")
    sha = lambda c: F.sha2(c.cast("binary"), 256)
    return words.select("doc_id", sha(X.pdf_text(pdf.cast("binary"))).alias("pdf"), sha(X.docx_text(xml)).alias("docx"))


_CLAIMED = "SELECT doc_id FROM labels"


@query(f"WITH a AS ({_ARTEFACTS}), r AS ({' UNION ALL '.join(map(rule_sql, security.RULES))}) SELECT doc_id AS fragment, string_agg(rule, ' ' ORDER BY rule) AS rules FROM r WHERE doc_id NOT IN ({_CLAIMED}) GROUP BY doc_id")
def q_sweep(t: Tables) -> DataFrame:
    """Artefacts that no label claims but a rule flags."""
    rows = _artefacts(t).withColumnRenamed("doc_id", "fragment")
    hits = rows.select("fragment", F.explode(security.rule_hits(F.col("data"))).alias("r")).select("fragment", "r.rule", "r.severity")
    found = X.sweep(rows.select("fragment"), t.labels.select(F.col("doc_id").alias("fragment")), hits)
    return found.select("fragment", F.array_join("rules", " ").alias("rules"))


@query("""WITH f AS (SELECT o_orderkey AS file, least(50.0, 25.0 * (contains(lower(o_orderpriority), 'low')::INT + contains(lower(o_orderpriority), 'high')::INT + contains(lower(o_orderpriority), '5')::INT)) + 20.0 * (o_custkey % 3) / 2.0 + CASE WHEN o_custkey % 2 = 0 THEN 15.0 ELSE 0 END + least(15.0, 5.0 * (o_orderkey % 5)) AS relevance,
o_custkey % 101 AS integ, CASE WHEN o_orderkey % 4 <> 0 THEN o_orderkey % 101 END AS recon, o_orderkey % 100 AS rel FROM orders), p AS (SELECT *, 0.1 * integ + 0.1 * coalesce(recon, 50) + 0.2 * rel + 0.6 * relevance AS priority FROM f)
SELECT file, round(relevance, 6) AS relevance, round(priority, 6) AS priority, CASE WHEN file % 9 = 0 AND priority < 72 THEN 'INFORMATIONAL' WHEN priority >= 88 THEN 'CRITICAL' WHEN priority >= 72 THEN 'HIGH' WHEN priority >= 52 THEN 'MEDIUM' WHEN priority >= 35 THEN 'LOW' ELSE 'INFORMATIONAL' END AS band FROM p""")
def q_rerank(t: Tables) -> DataFrame:
    """Orders ranked anew by other keywords and weights."""
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    files = t.orders.select(
        k.alias("file"), F.col("o_orderpriority").alias("text"), ((c % 3) / 2.0).alias("type_weight"), (c % 2 == 0).alias("recent"), (k % 5).alias("related"), (c % 101).alias("integrity"),
        F.when(k % 4 != 0, k % 101).alias("reconstruction"), (k % 100).alias("relationship"), (k % 9 == 0).alias("unrecoverable"),
    )
    found = X.reranked(files, ("low", "HIGH", "5"), {"integrity": 1, "reconstruction": 1, "relationship": 2, "relevance": 6})
    return found.select("file", F.round("relevance", 6).alias("relevance"), F.round("priority", 6).alias("priority"), "band")


@query("""WITH b AS (SELECT page_id, ('0x' || unnest(regexp_extract_all(hex(encode(html)), '..')))::INT AS byte FROM pages), c AS (SELECT page_id, byte, count(*) AS n FROM b GROUP BY ALL), s AS (SELECT *, n / sum(n) OVER (PARTITION BY page_id) AS p, sum(n) OVER (PARTITION BY page_id) AS size FROM c),
g AS (SELECT page_id, byte // 8 AS bin, sum(n) AS n FROM s GROUP BY ALL), k AS (SELECT page_id, size, unnest(range(32)) AS bin FROM (SELECT DISTINCT page_id, size FROM s)),
h AS (SELECT k.page_id, string_agg(((2000 * coalesce(n, 0) + size) // (2 * size))::INT, ' ' ORDER BY k.bin) AS bins FROM k LEFT JOIN g ON g.page_id = k.page_id AND g.bin = k.bin GROUP BY k.page_id)
SELECT page_id, max(size)::BIGINT AS size, round(sum(CASE WHEN byte BETWEEN 32 AND 126 OR byte IN (9, 10, 13) THEN n ELSE 0 END) / max(size), 6) AS printable, round(sum(-p * log2(p)), 6) AS entropy, any_value(bins) AS bins FROM s JOIN h USING (page_id) GROUP BY page_id""")
def q_cards(t: Tables) -> DataFrame:
    """The card of each page: size, printable share, entropy and 32 bins in thousandths."""
    bytes_ = t.pages.select("page_id", F.explode(S.byte_array(F.col("html").cast("binary"))).alias("digits"))
    counts = bytes_.groupBy("page_id", "digits").agg(F.count(F.lit(1)).alias("n")).select("page_id", F.conv("digits", 16, 10).cast("int").alias("byte"), "n")
    found = X.card(counts, "page_id")
    # whole numbers, so halves go up whatever the order of sums
    thousandths = F.transform("counts", lambda x: F.floor((2000 * x + F.col("size")) / (2 * F.col("size"))).cast("string"))
    return found.select("page_id", "size", "printable", "entropy", F.array_join(thousandths, " ").alias("bins"))


@query("SELECT l_orderkey, l_linenumber, l_partkey, count_if(l_quantity * 100 >= 2048 AND l_discount >= 0.079 AND l_returnflag <> 'N') AS stubs FROM lineitem GROUP BY ALL")
def q_stubs(t: Tables) -> DataFrame:
    """Signature stubs among lines that stand for files: size, entropy and whether a structure was found."""
    stub = X.signature_stub(F.lit("pdf"), F.col("l_quantity") * 100, F.col("l_discount") * 100, F.col("l_returnflag") == "N")
    return t.lineitem.groupBy("l_orderkey", "l_linenumber", "l_partkey").agg(F.count_if(stub).alias("stubs"))
