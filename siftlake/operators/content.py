"""What a file says about itself: header facts, the text inside documents, signature stubs, fragment cards, re-ranking."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import fixed
from ..functions import scalars as S


def header_facts(data: Column) -> Column:
    """struct(kind, detail, size, count) of the first bytes: the version of a PDF; page size, page count and encoding of a
    database; the first member of an archive; the dimensions of a PNG."""
    text = S.as_latin1(F.substring(data, 1, 1024))
    made = lambda kind, detail=None, size=None, count=None: F.struct(
        F.lit(kind).alias("kind"), (F.lit(None) if detail is None else detail).cast("string").alias("detail"), (F.lit(None) if size is None else size).cast("long").alias("size"), (F.lit(None) if count is None else count).cast("long").alias("count")
    )
    page = S.big_endian(data, 16, 2)
    encoding = F.element_at(F.array(F.lit("UTF-8"), F.lit("UTF-16le"), F.lit("UTF-16be")), F.greatest(F.lit(1), F.least(F.lit(3), S.big_endian(data, 56, 4))).cast("int"))
    name = F.decode(F.substring(data, 31, F.greatest(S.little_endian(data, 26, 2), F.lit(0)).cast("int")), "UTF-8")
    sig = S.signature(data)
    return (
        F.when(sig == "pdf", made("pdf", F.regexp_extract(text, r"^%PDF-(\d\.\d)", 1)))
        .when(sig == "sqlite", made("sqlite", encoding, F.when(page == 1, 65536).otherwise(page), S.big_endian(data, 28, 4)))
        .when(sig == "zip", made("zip", name))
        .when(sig == "png", made("png", None, S.big_endian(data, 16, 4), S.big_endian(data, 20, 4)))
        .when(sig.isNotNull(), F.struct(sig.alias("kind"), F.lit(None).cast("string").alias("detail"), F.lit(None).cast("long").alias("size"), F.lit(None).cast("long").alias("count")))
    )


def pdf_text(data: Column) -> Column:
    """The strings that a page's uncompressed content shows, a line each, with escaped brackets and backslashes resolved."""
    shown = F.regexp_extract_all(S.as_latin1(data), F.lit(r"\(((?:\\.|[^\\()])*)\)\s*Tj"), F.lit(1))
    return F.regexp_replace(F.array_join(shown, "\n"), r"\\([()\\])", "$1")


def docx_text(xml: Column) -> Column:
    """The runs of text of a document's XML part, paragraphs as lines."""
    lines = F.split(F.regexp_replace(xml, r"</w:p>", "\n"), "\n")
    line = lambda x: F.array_join(F.regexp_extract_all(x, F.lit(r"<w:t(?:\s[^>]*)?>([^<]*)</w:t>"), F.lit(1)), "")
    plain = F.array_join(F.filter(F.transform(lines, line), lambda x: x != ""), "\n")
    for entity, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&apos;", "'"), ("&amp;", "&")):
        plain = F.replace(plain, F.lit(entity), F.lit(char))
    return plain


def signature_stub(kind: Column, size: Column, entropy: Column, has_structure: Column) -> Column:
    """A signature with noise behind it: bytes of near the highest entropy and nothing that its type must have."""
    return kind.isNotNull() & (size >= 2048) & (entropy >= 7.9) & ~has_structure


def sweep(fragments: DataFrame, claimed: DataFrame, hits: DataFrame) -> DataFrame:
    """Fragments (fragment, ...) that no file claims but a rule flags (fragment, rule, severity): kept as evidence of their
    own, with the rules that flag them."""
    flagged = hits.where(F.col("severity").isin("suspicious", "test")).groupBy("fragment").agg(F.array_sort(F.collect_set("rule")).alias("rules"))
    return fragments.join(claimed.select("fragment").distinct(), "fragment", "left_anti").join(flagged, "fragment")


def reranked(files: DataFrame, keywords: tuple[str, ...], weights: Mapping[str, float], bands: Mapping[str, float] = fixed.PRIORITY_BANDS) -> DataFrame:
    """Files (file, text, type_weight, recent, related, integrity, reconstruction, relationship, unrecoverable) ranked anew
    by other criteria: file, relevance, priority, band. Twenty keywords at most, a limit of the form they come from."""
    points = S.relevance(S.keyword_hits(F.col("text"), keywords[:20]), F.col("type_weight"), F.col("recent"), F.col("related"))
    rows = files.withColumn("relevance", points)
    rows = rows.withColumn("priority", S.priority(F.col("integrity"), F.col("reconstruction"), F.col("relationship"), F.col("relevance"), weights))
    return rows.select("file", "relevance", "priority", S.priority_band(F.col("priority"), F.col("unrecoverable"), bands).alias("band"))


def card(counts: DataFrame, key: str) -> DataFrame:
    """A fragment's card from its byte counts (key, byte 0..255, n): size, a histogram of 32 bins as shares and as counts,
    printable share and entropy. Bins meet before the fragments do; shares are one division of whole numbers."""
    total = F.sum("n").over(Window.partitionBy(key))
    rows = counts.withColumn("total", total)  # of 256 rows per key at most
    p = F.col("n") / F.col("total")
    printable = F.col("byte").between(32, 126) | F.col("byte").isin(9, 10, 13)
    bins = rows.groupBy(key, F.floor(F.col("byte") / 8).cast("int").alias("bin")).agg(F.sum("n").alias("count"), F.sum(F.when(printable, F.col("n")).otherwise(0)).alias("printable"), F.sum(-p * F.log2(p)).alias("entropy"), F.first("total").alias("size"))
    filled = bins.groupBy(key).agg(F.first("size").alias("size"), F.round(F.sum("printable") / F.first("size"), 6).alias("printable"), F.round(F.sum("entropy"), 6).alias("entropy"), F.map_from_entries(F.collect_list(F.struct("bin", "count"))).alias("m"))
    every = F.transform(F.sequence(F.lit(0), F.lit(31)), lambda i: F.coalesce(F.try_element_at("m", i), F.lit(0)))
    filled = filled.withColumn("counts", every)
    return filled.select(key, "size", "printable", "entropy", F.transform("counts", lambda x: F.round(x / F.col("size"), 6)).alias("bins"), "counts")
