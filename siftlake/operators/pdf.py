"""The verdict on PDF files: nine weighted checks from the objects and references that a file's bytes hold."""

from __future__ import annotations

import itertools

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..sources.shared import SharedTables
from . import carving

# What each check counts.
WEIGHTS = {"header": 10, "eof": 5, "startxref": 5, "xref_offsets": 15, "trailer": 10, "page_tree": 15, "references": 15, "streams": 10, "render": 15}
# End of fixed values.


def walk(edges: DataFrame, roots: DataFrame, most: int | None = None) -> DataFrame:
    """(group, node, depth) of all nodes that roots (group, node) reach over edges (group, parent, child), each at its
    least depth, however deep, or down to `most` levels where a view asks for that; circles end where they close. A level is one join with the nodes found last."""
    tables, done = SharedTables(edges.sparkSession, "walk"), SharedTables(edges.sparkSession, "walked")
    level = roots.select("group", "node", F.lit(0).alias("depth")).distinct()
    found = done.save(level)
    for depth in itertools.count(1) if most is None else range(1, most + 1):
        reached = found.where(F.col("depth") == depth - 1).select("group", F.col("node").alias("parent")).join(edges, ["group", "parent"])
        fresh = tables.save(reached.select("group", F.col("child").alias("node")).distinct().join(found.select("group", "node"), ["group", "node"], "left_anti").withColumn("depth", F.lit(depth)))
        if fresh.isEmpty():
            break
        found = done.save(found.unionByName(fresh))
    return found


def _share(ok: Column, total: Column) -> Column:
    return F.when(total > 0, ok / total)


def checks(files: DataFrame) -> DataFrame:
    """file, check, score (0 to 1, null where it does not apply) of each PDF (file, data). Pages are not rendered."""
    files = files.select("file", "data")
    text = S.as_latin1(F.col("data"))
    objects = carving.pdf_objects(files, "file", "data")
    bodies = objects.join(files, "file").select("file", "number", "start", "whole", S.as_latin1(F.substring(F.col("data"), (F.col("start") + 1).cast("int"), (F.col("end") - F.col("start")).cast("int"))).alias("body"))
    kept = SharedTables(files.sparkSession, "bodies")
    bodies = kept.save(bodies)
    whole = bodies.where("whole")

    pointer = F.regexp_extract(text, r"(?s).*startxref\s+(\d+)", 1)
    target = F.substring(text, F.expr("cast(nullif(pointer, '') as int) + 1"), F.lit(24))
    facts = files.withColumn("pointer", pointer).select(
        "file",
        F.when(F.startswith(text, F.lit("%PDF-")), 1.0).when(F.contains(F.substring(text, 1, 1024), F.lit("%PDF-")), 0.5).otherwise(0.0).alias("header"),
        F.contains(F.right(text, F.lit(1024)), F.lit("%%EOF")).cast("double").alias("eof"),
        F.coalesce(F.rlike(target, F.lit(r"^(xref\s|\d+ \d+ obj)")).cast("double"), F.lit(0.0)).alias("startxref"),
        F.expr(r"cast(nullif(regexp_extract(decode(data, 'ISO-8859-1'), '(?s)trailer\\s*<<.*?/Root\\s+(\\d+) \\d+ R', 1), '') as bigint)").alias("root"),
        F.coalesce(F.expr(r"cast(nullif(regexp_extract(decode(data, 'ISO-8859-1'), '(?s)trailer\\s*<<.*?/Size\\s+(\\d+)', 1), '') as bigint)"), F.lit(0)).alias("entries"),
    )
    starts = bodies.select("file", "number", F.col("start").alias("offset"), F.lit(1).alias("hit")).distinct()
    xref = carving.pdf_xref(files, "file", "data").join(starts, ["file", "number", "offset"], "left").groupBy("file").agg(_share(F.count("hit"), F.count(F.lit(1))).alias("xref_offsets"))

    ids = whole.select("file", F.col("number").alias("to")).distinct().withColumn("there", F.lit(1))
    refs = whole.select("file", F.explode(F.regexp_extract_all("body", F.lit(r"(\d+) \d+ R\b"), F.lit(1))).alias("to")).select("file", F.col("to").cast("long").alias("to"))
    references = refs.join(ids, ["file", "to"], "left").groupBy("file").agg(_share(F.count("there"), F.count(F.lit(1))).alias("references"))

    declared = F.expr(r"cast(nullif(regexp_extract(body, '/Length\\s+(\\d+)(?!\\s+\\d+\\s+R)', 1), '') as int)")
    held = F.length(F.regexp_extract("body", r"(?s)\bstream\r?\n(.*?)\r?\n?endstream", 1))
    with_stream = bodies.where(F.rlike("body", F.lit(r"\bstream\r?\n"))).select("file", (F.coalesce(declared == held, F.lit(True)) & F.contains("body", F.lit("endstream")) & F.col("whole")).alias("ok"))
    streams = with_stream.groupBy("file").agg(_share(F.count_if("ok"), F.count(F.lit(1))).alias("streams"))

    catalogs = whole.where(F.rlike("body", F.lit(r"/Type\s*/Catalog\b"))).groupBy("file").agg(F.min("number").alias("catalog"))
    roots = facts.join(catalogs, "file", "left").select("file", F.coalesce("root", "catalog").alias("node")).where("node is not null")
    kids = whole.where(F.rlike("body", F.lit(r"/Type\s*/(Catalog|Pages)\b")))
    listed = F.concat(F.regexp_extract_all(F.regexp_extract("body", r"(?s)/Kids\s*\[(.*?)\]", 1), F.lit(r"(\d+) \d+ R"), F.lit(1)), F.regexp_extract_all("body", F.lit(r"/Pages\s+(\d+) \d+ R"), F.lit(1)))
    edges = kids.select(F.col("file").alias("group"), F.col("number").alias("parent"), F.explode(listed).alias("child")).select("group", "parent", F.col("child").cast("long").alias("child"))
    reached = walk(edges, roots.select(F.col("file").alias("group"), "node")).select(F.col("group").alias("file"), F.col("node").alias("number"))
    pages = whole.where(F.rlike("body", F.lit(r"/Type\s*/Page\b"))).select("file", "number").distinct().join(reached, ["file", "number"]).groupBy("file").agg(F.count(F.lit(1)).alias("pages"))
    counts = whole.where(F.rlike("body", F.lit(r"/Type\s*/Pages\b"))).groupBy("file").agg(F.max(F.expr(r"cast(nullif(regexp_extract(body, '/Count\\s+(\\d+)', 1), '') as bigint)")).alias("declared"))
    intact = bodies.groupBy("file").agg(F.count_if("whole").alias("intact"))

    met = facts.join(ids.select("file", F.col("to").alias("root"), F.col("there").alias("rooted")), ["file", "root"], "left")
    for part in (xref, references, streams, pages, counts, intact):
        met = met.join(part, "file", "left")
    pages_ = F.coalesce("pages", F.lit(0))
    scored = {
        "header": F.col("header"), "eof": F.col("eof"), "startxref": F.col("startxref"), "xref_offsets": F.coalesce("xref_offsets", F.lit(0.0)),
        "trailer": F.when(F.col("rooted").isNotNull() & (F.col("entries") > 0), 1.0).when(F.col("root").isNotNull(), 0.5).otherwise(0.0),
        "page_tree": F.when(pages_ == 0, 0.0).otherwise(F.least(F.lit(1.0), pages_ / F.greatest(F.coalesce("declared", F.lit(0)), F.lit(1)))),
        "references": F.col("references"), "streams": F.col("streams"), "render": F.lit(None),
    }
    rows = met.select("file", F.struct(pages_.alias("pages"), F.coalesce("declared", F.lit(0)).alias("declared"), F.coalesce("intact", F.lit(0)).alias("intact")).alias("facts"), F.explode(F.array(*[F.struct(F.lit(k).alias("check"), v.cast("double").alias("score")) for k, v in scored.items()])).alias("c"))
    return rows.select("file", "facts", "c.check", "c.score")


def state(score: Column) -> Column:
    return F.when(score.isNull(), "na").when(score >= 1, "pass").when(score <= 0, "fail").otherwise("partial")


def verdict(found: DataFrame) -> DataFrame:
    """file, integrity (weighted share of the checks that apply, percent), status and the checks that do not pass. found:
    file, check, score, facts (pages, declared, intact)."""
    weights = F.create_map(*[x for k, w in WEIGHTS.items() for x in (F.lit(k), F.lit(w))])
    rows = found.withColumn("weight", F.element_at(weights, F.col("check"))).withColumn("state", state(F.col("score")))
    of = lambda name: F.max(F.when(F.col("check") == name, F.col("score")))
    out = rows.groupBy("file").agg(
        F.sum(F.col("weight") * F.col("score")).alias("points"), F.sum(F.when(F.col("score").isNotNull(), F.col("weight"))).alias("of"), F.count_if(F.col("state").isin("fail", "partial")).alias("failing"),
        F.array_sort(F.collect_list(F.when(F.col("state").isin("fail", "partial"), F.concat("check", F.lit(": "), "state")))).alias("problems"), F.max("facts").alias("facts"),
        of("header").alias("header"), of("trailer").alias("trailer"), of("page_tree").alias("page_tree"), of("references").alias("references"),
    )
    pages, declared = F.col("facts.pages"), F.greatest(F.col("facts.declared"), F.col("facts.pages"))
    every = (declared > 0) & (pages == declared)
    structural = (F.col("header") == 1) & (F.col("trailer") == 1) & (F.col("page_tree") == 1)
    status = (
        F.when((F.col("failing") == 0) & every, "FULLY_RECOVERED")
        .when(structural & every & (F.coalesce("references", F.lit(0.0)) >= 0.9), "MOSTLY_RECOVERED")
        .when(pages > 0, "PARTIALLY_RECOVERED")
        .when(F.col("facts.intact") > 0, "FRAGMENT_ONLY")
        .otherwise("UNRECOVERABLE")
    )
    return out.select("file", F.round(F.coalesce(100 * F.col("points") / F.col("of"), F.lit(0.0)), 1).alias("integrity"), status.alias("status"), "problems")
