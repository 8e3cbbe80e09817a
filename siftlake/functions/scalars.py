"""Byte, text and scoring expressions; all of them stay inside Catalyst."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import fixed

ASCII_PRINTABLE = r"[^\x20-\x7e\t\n\r]"
TIMESTAMP_RE = r"20\d\d-\d\d-\d\d[T ]\d\d:\d\d:\d\d"
IPV4_RE = r"(?:\d{1,3}\.){3}\d{1,3}"
URL_RE = r"https?://[^\s\"'<>)]+"
EMAIL_RE = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}"


def as_latin1(data: Column) -> Column:
    """Bytes as text with one character per byte, so that positions in the text are byte offsets."""
    return F.decode(data, "ISO-8859-1")


def byte_array(data: Column) -> Column:
    """The bytes of a binary as an array of two-digit hex strings."""
    return F.regexp_extract_all(F.hex(data), F.lit("(..)"), F.lit(1))


def printable_ratio(data: Column) -> Column:
    """Share of bytes 32..126, tab, line feed and carriage return; 0 for no bytes."""
    left = F.regexp_replace(as_latin1(data), ASCII_PRINTABLE, "")
    return F.when(F.octet_length(data) > 0, F.length(left) / F.octet_length(data)).otherwise(0.0)


def hex_offset(n: Column) -> Column:
    return F.concat(F.lit("0x"), F.lpad(F.hex(n), 8, "0"))


def clamp(x: Column, low: float, high: float) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), x))


def sigmoid(z: Column) -> Column:
    return 1.0 / (1.0 + F.exp(-clamp(z, -40.0, 40.0)))


def ladder(x: Column, steps: Sequence[tuple[float, str]], rest: str) -> Column:
    """The label of the first step that x reaches, steps falling."""
    out = None
    for least, label in steps:
        out = F.when(x >= least, label) if out is None else out.when(x >= least, label)
    return out.otherwise(rest)


def relation_label(confidence: Column) -> Column:
    return ladder(confidence, fixed.RELATION_LABELS, "Uncertain")


def signature(data: Column) -> Column:
    """Name of the magic number that data begins with, or null."""
    out = None
    for name, magic in fixed.SIGNATURES.items():
        test = F.startswith(data, F.unhex(F.lit(magic)))
        out = F.when(test, name) if out is None else out.when(test, name)
    return out.when(F.hex(F.substring(data, 5, 4)) == fixed.MP4_MARK, "mp4")


def little_endian(data: Column, offset: int, size: int) -> Column:
    """Unsigned little-endian number at a byte offset."""
    digits = F.concat(*[F.hex(F.substring(data, offset + size - i, 1)) for i in range(size)])
    return F.conv(digits, 16, 10).cast("long")


def big_endian(data: Column, offset: int, size: int) -> Column:
    return F.conv(F.hex(F.substring(data, offset + 1, size)), 16, 10).cast("long")


def filetime(ticks: Column) -> Column:
    """Timestamp of a count of 100 ns since 1601."""
    return F.timestamp_micros((F.floor(ticks / 10) - 11644473600000000).cast("long"))


def edge_contributions(features: Mapping[str, Column]) -> Column:
    """Struct array (name, value) of weight times standardised feature; a missing feature counts 0.5."""
    parts = []
    for name, weight in fixed.EDGE_WEIGHTS.items():
        x = F.coalesce(features.get(name, F.lit(None).cast("double")), F.lit(0.5))
        z = (x - fixed.EDGE_MEAN[name]) / fixed.EDGE_STD[name]
        parts.append(F.struct(F.lit(name).alias("name"), (weight * z).alias("value")))
    return F.array(*parts)


def edge_confidence(contributions: Column) -> Column:
    total = F.aggregate(contributions, F.lit(0.0), lambda s, c: s + c["value"])
    return sigmoid(total + fixed.EDGE_BIAS)


def top_contributions(contributions: Column, n: int = 5) -> Column:
    by_size = F.array_sort(contributions, lambda a, b: F.when(F.abs(a["value"]) > F.abs(b["value"]), -1).when(F.abs(a["value"]) < F.abs(b["value"]), 1).otherwise(0))
    return F.slice(by_size, 1, n)


def keyword_hits(text: Column, keywords: Sequence[str]) -> Column:
    """How many of the keywords occur, case ignored."""
    low = F.lower(text)
    hits = [F.contains(low, F.lit(k.lower())).cast("int") for k in keywords if k.strip()]
    return sum(hits[1:], hits[0]) if hits else F.lit(0)


def relevance(hits: Column, type_weight: Column, recent: Column, related: Column) -> Column:
    """Points for keywords (50 at most), type (20), recency (15) and related artefacts (15)."""
    return F.least(F.lit(50.0), 25.0 * hits) + 20.0 * type_weight + F.when(recent, 15.0).otherwise(0.0) + F.least(F.lit(15.0), 5.0 * related)


def priority(integrity: Column, reconstruction: Column, relationship: Column, relevance_: Column, weights: Mapping[str, float] = fixed.PRIORITY_WEIGHTS) -> Column:
    """Weighted mean; an unknown reconstruction counts 50."""
    total = sum(weights.values()) or 1.0
    parts = {"integrity": integrity, "reconstruction": F.coalesce(reconstruction, F.lit(50.0)), "relationship": relationship, "relevance": relevance_}
    return sum((parts[k] * (w / total) for k, w in weights.items()), F.lit(0.0))


def priority_band(score: Column, unrecoverable: Column, bands: Mapping[str, float] = fixed.PRIORITY_BANDS) -> Column:
    band = ladder(score, sorted(((v, k) for k, v in bands.items()), reverse=True), "INFORMATIONAL")
    return F.when(unrecoverable & band.isin("LOW", "MEDIUM"), "INFORMATIONAL").otherwise(band)


def integrity_score(header: Column, terminator: Column, parser: Column, checksum_ratio: Column, reconstruction: Column, missing: Column, corrupt: Column, conflicts: Column, orphan: Column) -> Column:
    """0..100 from itemised factors. terminator and parser: 'pass', 'partial', 'fail' or null where undefined."""
    score = (
        F.when(header, 10.0).otherwise(0.0)
        + F.when(terminator == "pass", 8.0).when(terminator.isNull(), 4.0).otherwise(0.0)
        + F.when(parser == "pass", 25.0).when(parser == "partial", 12.0).when(parser == "fail", 0.0).otherwise(8.0)
        + F.coalesce(15.0 * checksum_ratio, F.lit(5.0))
        + F.coalesce(0.3 * reconstruction, F.lit(15.0))
        + 12.0 * F.greatest(F.lit(0.0), 1.0 - 0.25 * missing)
        - F.least(F.lit(20.0), 4.0 * corrupt)
        - F.least(F.lit(10.0), 5.0 * conflicts)
        - F.when(orphan, 10.0).otherwise(0.0)
    )
    return clamp(score, 0.0, 100.0)


def recovery_status(hint: Column, structured: Column, orphan: Column, reconstruction: Column, integrity: Column, relationship: Column, clean: Column, text_verified: Column) -> Column:
    """The first rule that holds decides."""
    return (
        F.when(~structured, "UNCERTAIN")
        .when(hint.isNotNull(), hint)
        .when(orphan, F.when((reconstruction < 20) | (integrity < 30), "UNRECOVERABLE").otherwise("FRAGMENT_ONLY"))
        .when(reconstruction.isNull(), "UNCERTAIN")
        .when((reconstruction >= 99.5) & clean, "FULLY_RECOVERED")
        .when(relationship < 60, "UNCERTAIN")
        .when(reconstruction < 20, "UNRECOVERABLE")
        .when((reconstruction >= 85) & (integrity >= 70), "MOSTLY_RECOVERED")
        .when(reconstruction >= 40, "PARTIALLY_RECOVERED")
        .when(text_verified, "PARTIALLY_RECOVERED")
        .otherwise("FRAGMENT_ONLY")
    )


def export_class(structural: Column, parser: Column, checksum: Column) -> Column:
    return (
        F.when((structural == "pass") & (parser == "pass") & (checksum.isNull() | (checksum == "pass")), "validated")
        .when((structural == "fail") & ((parser == "fail") | parser.isNull()), "failed")
        .otherwise("partial")
    )


def relationship_score(confidences: Column, conflicts: Column) -> Column:
    """Geometric mean of accepted links (an aggregate), lowered by conflicts."""
    return F.exp(F.avg(F.ln(F.greatest(confidences, F.lit(1e-6))))) * F.greatest(F.lit(0.5), 1.0 - 0.1 * F.max(conflicts))


def incident_severity(lost: Column, deleted: Column, corrupted: Column, modified: Column) -> Column:
    return F.when((lost >= 5) | ((deleted > 0) & (corrupted > 0)), "HIGH").when((lost >= 1) | (modified >= 5), "MEDIUM").otherwise("LOW")


def dna_label(cosine: Column, entropy_gap: Column, same_family: Column, both_random: Column) -> Column:
    strong = F.when((cosine >= 0.97) & (entropy_gap <= 0.2) & same_family, "STRONG").when((cosine >= 0.92) & (entropy_gap <= 0.5), "POSSIBLE").when(cosine >= 0.8, "WEAK").otherwise("NONE")
    return F.when(both_random & strong.isin("STRONG", "POSSIBLE"), "WEAK").otherwise(strong)
