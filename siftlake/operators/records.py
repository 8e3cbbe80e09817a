"""File records: how complete, how sure, what is missing, and the names and texts by which they are found."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Which families and extensions go with a type, and which types begin with a signature.
FAMILIES = {"jpeg": ("jpeg",), "pdf": ("pdf",), "sqlite": ("sqlite",), "docx": ("compressed", "xml"), "xlsx": ("compressed", "xml"), "zip": ("compressed",), "log": ("log", "text"), "txt": ("text", "log")}
EXTENSIONS = {"jpeg": ("jpg", "jpeg"), "pdf": ("pdf",), "docx": ("docx",), "sqlite": ("db", "sqlite"), "log": ("log",), "txt": ("txt",), "zip": ("zip",), "xlsx": ("xlsx",)}
SIGNED = ("jpeg", "png", "gif", "pdf", "zip", "docx", "xlsx", "pptx", "sqlite", "mp4")
# End of fixed values.


def _goes_with(kind: Column, value: Column, table: dict[str, tuple[str, ...]]) -> Column:
    """Whether a value is among those of a type; false for types the table does not have."""
    pairs = [x for k, v in table.items() for x in (F.lit(k), F.array(*map(F.lit, v)))]
    return F.coalesce(F.array_contains(F.element_at(F.create_map(*pairs), kind), value), F.lit(False))


def reconstruction(single: Column, kind: Column, rows_total: Column, rows_found: Column, expected: Column, recovered: Column, bounded: Column) -> Column:
    """Located share of what the structure declares, in percent; null where nothing declares it."""
    return (
        F.when(single, 100.0)
        .when((kind == "jpeg") & (rows_total > 0) & rows_found.isNotNull(), 100.0 * rows_found / rows_total)
        .when(expected > 0, 100.0 * F.least(recovered, expected) / expected)
        .when(bounded, 100.0)
    )


def checksum_ratio(kind: Column, members: Column, objects: Column, pages: Column, restarts: Column, breaks: Column, rows_total: Column) -> Column:
    """Verified share. members, pages: array of statuses; objects: array of (status, reason)."""
    share = lambda items, test: F.when(F.size(items) > 0, F.size(F.filter(items, test)) / F.size(items))
    expected = F.greatest(rows_total - 1, F.lit(1))
    there = lambda o: o["status"].isin("ok", "corrupted") & ~o["reason"].eqNullSafe(F.lit("object header not at xref offset"))
    return (
        F.when(kind.isin("docx", "zip", "xlsx"), share(members, lambda s: s == "ok"))
        .when(kind == "pdf", share(objects, there))
        .when(kind == "sqlite", share(pages, lambda s: s == "ok"))
        .when((kind == "jpeg") & restarts.isNotNull() & (rows_total > 0), F.least(F.lit(1.0), F.greatest(restarts - F.coalesce(breaks, F.lit(0)), F.lit(0)) / expected))
    )


def content_confidence(kind: Column, header: Column, parser: Column, entry_name: Column) -> Column:
    """0 to 100: signature, parser, and whether the name a directory gives agrees with the type."""
    agrees = _goes_with(kind, F.lower(F.substring_index(entry_name, ".", -1)), EXTENSIONS)
    score = (
        F.when(header, 45.0).otherwise(25.0)
        + F.when(parser == "pass", 40.0).when(parser == "partial", 25.0).otherwise(5.0)
        + F.when(entry_name.isNull(), 7.0).when(agrees, 15.0).otherwise(0.0)
    )
    return F.least(F.lit(100.0), score)


def links_metric(kind: Column, references: Column, single: Column, relationship: Column) -> Column:
    """What the figure for links means, and the figure: struct(kind, value)."""
    made = lambda name, value: F.struct(F.lit(name).alias("kind"), value.cast("double").alias("value"))
    return (
        F.when((kind == "pdf") & references.isNotNull(), made("internal_references", F.round(100 * references, 1)))
        .when(single, made("not_applicable", F.lit(None)))
        .otherwise(made("fragment_relationships", relationship))
    )


def relationship_confidence(single: Column, links: Column, orphan: Column, missing: Column, conflicts: Column) -> Column:
    """Percent. links: array of the accepted links' confidences; their geometric mean, or a fixed value without any."""
    mean = F.exp(F.aggregate(links, F.lit(0.0), lambda s, c: s + F.ln(F.greatest(c, F.lit(1e-6)))) / F.size(links))
    base = F.when(F.size(links) > 0, mean).when(orphan, 0.3).when(missing > 0, 0.9).otherwise(0.97)
    return F.when(single, 100.0).otherwise(100 * base * F.greatest(F.lit(0.5), 1 - 0.1 * conflicts))


def assessment(missing: Column, orphan: Column, alternatives: Column, compatible: Column) -> Column:
    """Whether more can be recovered: NO, YES or UNCERTAIN."""
    return F.when((missing == 0) & ~orphan, "NO").when(alternatives > 0, "YES").when(compatible > 0, "UNCERTAIN").otherwise("NO")


def checks_digest(checks: Column) -> Column:
    """The checks that decided: up to three that failed with the head of their detail, and how many pass."""
    counted = F.filter(checks, lambda x: ~x["category"].eqNullSafe(F.lit("advisory")))
    bad = F.transform(F.slice(F.filter(counted, lambda x: x["status"].isin("fail", "partial")), 1, 3), lambda x: F.concat(x["name"], F.lit(": "), F.substring_index(x["detail"], ";", 1)))
    good = F.size(F.filter(counted, lambda x: x["status"] == "pass"))
    passed = F.when(good > 0, F.concat(good.cast("string"), F.lit("/"), F.size(counted).cast("string"), F.lit(" checks pass")))
    return F.concat_ws("; ", bad, passed)


def detection(kind: Column, header: Column, orphan: Column, families: Column) -> Column:
    """How sure the type is: signature and share of fragments of a fitting family; without a signature 70 at most."""
    share = F.when(F.size(families) > 0, F.size(F.filter(families, lambda x: _goes_with(kind, x, FAMILIES))) / F.size(families)).otherwise(0.0)
    return F.when(kind.isin(*SIGNED), F.when(header & ~orphan, 60.0).otherwise(0.0) + 40 * share).otherwise(70 * share)


def profile(**measures: Column) -> Column:
    """The measures of an artefact by name: array of (measure, value), in the order given."""
    return F.array(*[F.struct(F.lit(k).alias("measure"), v.cast("double").alias("value")) for k, v in measures.items()])


def safe_stem(name: Column) -> Column:
    """The name without folders and extension, in characters that every file system takes."""
    base = F.substring_index(F.substring_index(name, "/", -1), "\\", -1)
    stem = F.when(F.contains(base, F.lit(".")), F.regexp_replace(base, r"\.[^.]*$", "")).otherwise(base)
    clean = F.regexp_replace(F.regexp_replace(stem, "[^A-Za-z0-9._-]+", "_"), "^[._]+|[._]+$", "")
    return F.when(clean == "", "recovered").otherwise(clean)


def final_name(name: Column, number: Column, extension: Column) -> Column:
    return F.concat(safe_stem(name), F.lit("__rec"), F.lpad(number.cast("string"), 4, "0"), F.lit("."), extension)


def modified_time(entry: Column, exif: Column, core: Column, last_stamp: Column) -> Column:
    """The first time there is: of the directory, of the camera (its date has colons), of the document, of the last line."""
    camera = F.regexp_replace(exif, r"^(\d{4}):(\d\d):(\d\d) ", "$1-$2-$3 ")
    return F.coalesce(*[F.try_to_timestamp(F.replace(x, F.lit("T"), F.lit(" "))) for x in (entry, camera, core, last_stamp)])


def search_text(kind: Column, pages: Column, text: Column, rows: Column, exif: Column, most: int = 20_000) -> Column:
    """What a file is searched by, the display column of a report: its first `most` characters."""
    whole = (
        F.when(kind == "pdf", F.array_join(pages, "\n"))
        .when(kind.isin("docx", "log", "txt"), text)
        .when(kind == "sqlite", F.array_join(rows, "\n"))
        .when(kind == "jpeg", F.array_join(F.map_values(exif), " "))
    )
    return F.substring(F.coalesce(whole, F.lit("")), 1, most)


def related_files(edges: DataFrame, kinds: tuple[str, ...] = ("content_similarity", "temporal")) -> DataFrame:
    """file and how many different files it is linked with by links of these kinds."""
    some = edges.where(F.col("type").isin(*kinds))
    ends = some.select(F.col("a").alias("file"), F.col("b").alias("other")).unionByName(some.select(F.col("b").alias("file"), F.col("a").alias("other")))
    return ends.groupBy("file").agg(F.count_distinct("other").alias("related"))


def case_summary(files: DataFrame) -> DataFrame:
    """One row: bytes lost, bytes declared and located over files whose structure declares a size, coverage in percent.
    files: missing, expected, recovered, orphan, single."""
    declared = (F.coalesce("expected", F.lit(0)) > 0) & ~F.col("orphan") & ~F.col("single")
    sums = files.agg(
        F.sum("missing").alias("unrecoverable"),
        F.coalesce(F.sum(F.when(declared, F.col("expected"))), F.lit(0)).alias("declared"),
        F.coalesce(F.sum(F.when(declared, F.least("expected", "recovered"))), F.lit(0)).alias("located"),
    )
    return sums.withColumn("coverage", F.when(F.col("declared") > 0, F.round(100 * F.col("located") / F.col("declared"), 1)))


def remaining_compatible(files: DataFrame, free: DataFrame) -> DataFrame:
    """files (file, family, missing) with the number of free fragments (family) of their family, 0 if nothing is missing.
    Fragments are counted by family before they meet the files."""
    counts = free.groupBy("family").agg(F.count(F.lit(1)).alias("_n"))
    n = F.when(F.col("missing") > 0, F.coalesce("_n", F.lit(0))).otherwise(0)
    return files.join(counts, "family", "left").withColumn("remaining", n.cast("long")).drop("_n")


def link_report(edges: DataFrame) -> DataFrame:
    """Accepted links by type: how many, their mean confidence, and how many alternatives were not taken."""
    return edges.groupBy("type").agg(
        F.count_if("chosen").alias("accepted"), F.round(100 * F.avg(F.when(F.col("chosen"), F.col("confidence"))), 1).alias("mean"), F.count_if(~F.col("chosen")).alias("alternatives")
    )


def slim(files: DataFrame, columns: tuple[str, ...], lists: tuple[str, ...]) -> DataFrame:
    """The columns of a list view; of lists only how long they are."""
    return files.select(*columns, *[F.when(F.col(c).isNull(), 0).otherwise(F.size(c)).alias(f"n_{c}") for c in lists])


def list_files(files: DataFrame, *, types=(), statuses=(), bands=(), integrity: float = 0, relationship: float = 0, reconstruction: float = 0, query: str = "") -> DataFrame:
    """The filter of the file list; a condition that is empty or 0 does not apply, an unknown score counts 0. The query
    is looked for in the name and the search text, and must equal a fragment's id as a whole."""
    out = files
    for column, chosen in (("type", types), ("status", statuses), ("band", bands)):
        if chosen:
            out = out.where(F.col(column).isin(*chosen))
    for column, least in (("integrity", integrity), ("relationship", relationship), ("reconstruction", reconstruction)):
        if least > 0:
            out = out.where(F.coalesce(F.col(column), F.lit(0.0)) >= least)
    if query.strip():
        low = query.strip().lower()
        mine = F.exists("fragments", lambda f: F.lower(f) == low)
        out = out.where(F.contains(F.lower("name"), F.lit(low)) | mine | F.contains(F.lower("search_text"), F.lit(low)))
    return out


def file_audit(audit: DataFrame, file: str, most: int = 40) -> DataFrame:
    """The log of a file: its own lines, and the first four lines of the case's intake before them; a page of 40."""
    own = F.startswith("message", F.lit(f"{file}:")) | F.startswith("message", F.lit(f"{file} "))
    intake = audit.where(F.col("stage").isin("ingest", "scan", "identify")).orderBy("id").limit(4)
    return audit.where(own).unionByName(intake).dropDuplicates(["id"]).orderBy("id").limit(most)
