"""Line dedup by a deletion-neighbourhood join, in DataFrame operations only.

A line is dropped if an earlier line, by (doc_id, line number), equals it or lies within one edit (insertion, deletion
or replacement of a character) of it; the bound is one edit for lines of every length. Two texts within one edit share a
variant: one of them with at most one character deleted. Variants are emitted as hashed keys and joined; lines that
share a variant are verified by edit distance, and the earlier stays.

Exact steps keep the join small. Equal lines become one row with their earliest place before anything else. For two
lines within one edit, with b the length of the shorter, the edit lies in one part of any partition of b, and the rest
is equal: what stands before that part counted from the left, what stands after it counted from the right. So a line is
first cut into halves, and goes on only with a half outside of which some other line is equal; that half is cut into
about as many parts as each has characters, and again only parts outside of which some line is equal go on. Variants are
emitted for such parts alone, keyed together with the hash of all that surrounds them: their number and length grow with
the square root of the line, and lines without a partner emit none. Within a variant, lines are compared with its
earliest line first; only lines which that one does not remove, few by far, are compared with the other earlier ones.

Defined cases: null text has no lines; lines without a word are kept, never compared, and stay where they are; a null
doc_id sorts first; rows that repeat a doc_id are ordered by a hash of their text; rows equal in doc_id and text are one
row for the order, so all of them keep or lose the same lines; a very long text is one row's work, which grows with
its length; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, shuffle_partitions

BLANKS = " \t\r\x0b\x0c"


def _digest(*parts: Column) -> Column:
    """128 bits of the parts, as a struct of two 64-bit hashes."""
    return F.struct(F.xxhash64(*parts).alias("a"), F.xxhash64(F.lit(1), *parts, F.lit(7)).alias("b"))


def lines_of(docs: DataFrame) -> DataFrame:
    """place (doc_id, row, number) and the line: a row per line with a word."""
    row = F.xxhash64("text")
    chosen = docs.select(F.col("doc_id").cast("long").alias("doc_id"), row.alias("row"), F.posexplode(F.split("text", "\n", -1)).alias("no", "line"))
    chosen = chosen.where(F.octet_length(F.ltrim("line", F.lit(BLANKS))) > 0)
    return chosen.select(F.struct("doc_id", "row", "no").alias("place"), "line")


def _split(docs: DataFrame) -> DataFrame:
    """doc_id, _row and lines. The lines are an array before any join, so that no later step splits a text again."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.split("text", "\n", -1).alias("lines"), F.xxhash64("text").alias("_row"))


def half_of(b: Column) -> Column:
    """Characters of a line that stay outside its half, where the shorter line has b."""
    return F.floor(b / 2).cast("int")


def halves(line: Column) -> Column:
    """Keys of what lies outside a half, of which two lines within one edit share one: by the head or the tail that is
    equal, for this line as the shorter (0, 1) and as the longer (2, 3)."""
    n = F.length(line)

    def keys(b: Column) -> list[Column]:
        m = half_of(b)
        return [F.xxhash64(b, F.lit("head"), F.substring(line, F.lit(1), m)), F.xxhash64(b, F.lit("tail"), F.right(line, m))]

    return F.array(*keys(n), *keys(n - 1))


def candidates(places: DataFrame) -> DataFrame:
    """id, place and the open halves (kind, half) of lines that share the outside of a half with another line."""
    keys = places.select("id", F.posexplode("halves").alias("kind", "half"))
    shared = keys.groupBy("half").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("half")
    open_ = keys.join(shared, "half").groupBy("id").agg(F.collect_list(F.struct("kind", "half")).alias("open"))
    return places.select("id", "place").join(open_, "id")


def texts_at(docs: DataFrame, places: DataFrame) -> DataFrame:
    """id, place, open and line of the given places; one pass over the documents. Lines are picked from a document's
    array by their number, so a row per picked line leaves and no copy of the array."""
    wanted = places.groupBy("place.doc_id", "place.row").agg(F.collect_list(F.struct("place", "id", "open")).alias("wanted"))
    wanted = wanted.select(F.col("doc_id").alias("_d"), F.col("row").alias("_r"), "wanted")
    base = _split(docs)
    met = base.join(wanted, base["doc_id"].eqNullSafe(wanted["_d"]) & (base["_row"] == wanted["_r"]))
    picked = F.transform("wanted", lambda w: F.struct(w["id"].alias("id"), w["place"].alias("place"), w["open"].alias("open"), F.element_at("lines", w["place"]["no"] + 1).alias("line")))
    return met.select(F.inline(picked)).dropDuplicates(["id"])


def parts_of(able: DataFrame) -> DataFrame:
    """id, place, outside and part: each open half cut into parts, with the hash of the rest of the line."""
    n = F.length("line")
    half = able.select("id", "place", "line", F.explode("open").alias("o"))
    half = half.withColumn("b", F.when(F.col("o.kind") < 2, n).otherwise(n - 1)).withColumn("m", half_of(F.col("b")))
    inner = F.when(F.col("o.kind") % 2 == 0, F.substring("line", F.col("m") + 1, n)).otherwise(F.left("line", n - F.col("m")))
    half = half.select("id", "place", F.col("o.half").alias("half"), inner.alias("x"), (F.col("b") - F.col("m")).alias("size"))
    k = F.greatest(F.ceil(F.sqrt("size")), F.lit(1)).cast("int")
    begin, end = (F.floor((F.col("i") + j) * F.col("size") / F.col("k")).cast("int") for j in (0, 1))
    cut = half.withColumn("k", k).withColumn("i", F.explode(F.sequence(F.lit(0), F.col("k") - 1)))
    after = F.col("size") - end
    outside = F.xxhash64("half", "i", F.left("x", begin), F.right("x", after))
    return cut.select("id", "place", outside.alias("outside"), F.substring("x", begin + 1, F.length("x") - after - begin).alias("part"))


def near_pairs(able: DataFrame, scratch: Scratch) -> DataFrame:
    """(late, early) ids of lines within one edit, at least one for each line that has an earlier partner."""
    parts = scratch.save(parts_of(able), "parts")
    shared = parts.groupBy("outside").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("outside")
    n = F.length("part")
    without = lambda i: F.concat(F.left("part", i), F.substring("part", i + 2, n))
    every = F.when(n > 0, F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.xxhash64("outside", without(i)))).otherwise(F.array().cast("array<long>"))
    variants = F.array_distinct(F.concat(F.array(F.xxhash64("outside", "part")), every))
    emitted = scratch.save(parts.join(shared, "outside").select("id", "place", F.explode(variants).alias("variant")), "emitted")
    scratch.drop("parts")
    groups = emitted.groupBy("variant").agg(F.min(F.struct("place", "id")).alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1")
    met = emitted.join(groups, "variant").select("variant", "id", "place", F.col("first.id").alias("early"))
    met = scratch.save(met, "met", sweep=True)
    scratch.drop("emitted")
    text = able.select("id", "line")

    def verified(pairs: DataFrame) -> DataFrame:
        a, b = text.select(F.col("id").alias("late"), F.col("line").alias("x")), text.select(F.col("id").alias("early"), F.col("line").alias("y"))
        found = pairs.join(a, "late").join(b, "early")
        return found.where(F.levenshtein("x", "y", 1) >= 0).select("late", "early")

    first = met.where(F.col("id") != F.col("early")).select(F.col("id").alias("late"), "early").distinct()
    hit = scratch.save(verified(first), "hit")
    # A line that the earliest of a variant does not remove may still be near another line there.
    open_ = met.join(hit.select(F.col("late").alias("id")).distinct(), "id", "left_anti").where(F.col("id") != F.col("early"))
    late = open_.select("variant", F.col("id").alias("late"), F.col("place").alias("late_place"))
    early = met.select("variant", F.col("id").alias("early"), F.col("place").alias("early_place"))
    rest = late.join(early, "variant").where(F.col("early_place") < F.col("late_place")).select("late", "early").distinct()
    return hit.unionByName(verified(rest.join(first, ["late", "early"], "left_anti")))


def judge_lines(docs: DataFrame) -> DataFrame:
    """place, and why the line goes: 'equal' or 'near'. Kept lines have no row.

    Tables between the steps hold ids, places and hashes; texts travel only for lines that have a candidate."""
    scratch = Scratch(docs.sparkSession, "lines")
    ids = lines_of(docs).select(_digest(F.col("line")).alias("id"), "place", halves(F.col("line")).alias("halves"))
    places = scratch.save(ids.groupBy("id").agg(F.min("place").alias("place"), F.first("halves").alias("halves")), "places", sweep=True)
    wanted = scratch.save(candidates(places), "wanted", sweep=True)
    able = texts_at(docs, wanted).repartition(shuffle_partitions(docs.sparkSession), "id")  # every line is cut up next, so they are spread
    able = scratch.save(able, "able", sweep=True)
    near = scratch.save(near_pairs(able, scratch).select(F.col("late").alias("id")).distinct(), "near")
    for table in ("able", "met", "wanted"):
        scratch.drop(table)
    fate = places.select("id", F.col("place").alias("first")).join(near.withColumn("near", F.lit(True)), "id", "left")
    placed = ids.select("id", "place").join(fate, "id")
    why = F.when(F.col("place") != F.col("first"), "equal").when(F.col("near"), "near")
    gone = placed.select("place", why.alias("why")).where(F.col("why").isNotNull())
    return scratch.save(gone, "gone", sweep=True)


def dedup_lines(docs: DataFrame) -> DataFrame:
    """doc_id, n_lines, n_equal, n_near and kept_text: the text without the dropped lines; a row per row of docs."""
    gone = judge_lines(docs)
    by_doc = gone.groupBy("place.doc_id", "place.row").agg(
        F.sort_array(F.collect_set("place.no")).alias("gone"), F.sum((F.col("why") == "equal").cast("long")).alias("eq"), F.sum((F.col("why") == "near").cast("long")).alias("nr")
    )
    by_doc = by_doc.select(F.col("doc_id").alias("_d"), F.col("row").alias("_r"), "gone", "eq", "nr")
    base = _split(docs)
    joined = base.join(by_doc, base["doc_id"].eqNullSafe(by_doc["_d"]) & (base["_row"] == by_doc["_r"]), "left")
    # what stands between one dropped line and the next, so each line is moved once
    n = F.size("gone")
    begin = lambda j: F.when(j > 0, F.get("gone", j - 1) + 1).otherwise(0)
    end = lambda j: F.when(j < n, F.get("gone", j)).otherwise(F.size("lines"))
    between = F.transform(F.sequence(F.lit(0), n), lambda j: F.slice("lines", begin(j) + 1, end(j) - begin(j)))
    kept = F.array_join(F.when(F.col("gone").isNull(), F.col("lines")).otherwise(F.flatten(between)), "\n")
    return joined.select(
        "doc_id",
        F.coalesce(F.when(F.col("lines").isNotNull(), F.size("lines")), F.lit(0)).cast("long").alias("n_lines"),
        F.coalesce("eq", F.lit(0)).cast("long").alias("n_equal"),
        F.coalesce("nr", F.lit(0)).cast("long").alias("n_near"),
        F.coalesce(kept, F.lit("")).alias("kept_text"),
    )


def digest_lines(docs: DataFrame) -> DataFrame:
    """dedup_lines with the kept text as its sha256."""
    return dedup_lines(docs).select("doc_id", "n_lines", "n_equal", "n_near", F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256"))


#: The same in DuckDB: candidates by the two halves, which lose no pair within one edit. Its own distance counts bytes, of
#: which a character has four at most, so the edit is looked for character by character: equal up to it, equal after it.
SQL = """
WITH l AS (
  SELECT doc_id, text, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS no FROM documents
), w AS (
  SELECT * FROM l WHERE length(trim(translate(line, chr(9) || chr(13) || chr(11) || chr(12), '    '))) > 0
), d AS (
  SELECT line, min(struct_pack(doc_id := doc_id, no := no)) AS place, length(line) AS n FROM w GROUP BY line
), k AS (
  SELECT line, place, n, b, unnest(['h' || b || substring(line, 1, b // 2), 't' || b || CASE WHEN b // 2 = 0 THEN '' ELSE right(line, b // 2) END]) AS half
  FROM (SELECT line, place, n, unnest([n, n - 1]) AS b FROM d)
), near AS (
  SELECT DISTINCT x.line FROM k x JOIN k y ON x.half = y.half AND y.place < x.place AND abs(x.n - y.n) <= 1
  WHERE levenshtein(x.line, y.line) <= 4 AND len(list_filter(range(greatest(x.n, y.n)), lambda i: left(x.line, i) = left(y.line, i)
    AND substring(x.line, x.n - (greatest(x.n, y.n) - 1 - i) + 1) = substring(y.line, y.n - (greatest(x.n, y.n) - 1 - i) + 1))) > 0
), f AS (
  SELECT w.doc_id, w.no, w.line, struct_pack(doc_id := w.doc_id, no := w.no) <> d.place AS eq, near.line IS NOT NULL AS nr
  FROM w JOIN d ON w.line = d.line LEFT JOIN near ON near.line = w.line
), g AS (
  SELECT l.doc_id, count(*) AS n_lines, coalesce(sum(f.eq::INT), 0) AS n_equal, coalesce(sum((NOT f.eq AND f.nr)::INT), 0) AS n_near,
    coalesce(string_agg(l.line, chr(10) ORDER BY l.no) FILTER (WHERE NOT coalesce(f.eq OR f.nr, false)), '') AS kept
  FROM l LEFT JOIN f ON l.doc_id = f.doc_id AND l.no = f.no GROUP BY l.doc_id
)
SELECT d.doc_id, coalesce(n_lines, 0)::BIGINT AS n_lines, coalesce(n_equal, 0)::BIGINT AS n_equal, coalesce(n_near, 0)::BIGINT AS n_near, sha256(coalesce(kept, '')) AS kept_sha256
FROM documents d LEFT JOIN g ON d.doc_id = g.doc_id
"""
