"""Operators against plain Python over all pairs, whole graphs and whole texts."""

import re
from difflib import SequenceMatcher

from siftlake.operators import relational, services
from siftlake.plans import bytes_and_text


def test_related_names_are_all_pairs(spark):
    names = ["aaa report", "zzz report final", "zzz report finals", "zzz report final", "holiday01", "holiday02", "ab", "ac", "ab", "x", "", "", "red bolt", "bolt red", "red rod", "reed bolts", "", "boltred"]
    rows = [(i * 7 % 31, n, "one" if i % 5 else "two") for i, n in enumerate(names * 2)]
    rows = [(i, n, g) for i, (_, n, g) in enumerate(sorted(rows))]
    want = set()
    for a, x, g in rows:
        for b, y, h in rows:
            if a < b and g == h:
                r = SequenceMatcher(None, x, y).ratio()
                common = set(re.findall("[a-z0-9]{3,}", x)) & set(re.findall("[a-z0-9]{3,}", y))
                if common and r >= 0.45 or r >= 0.75:
                    want.add((a, b, round(r, 6)))
    files = spark.createDataFrame(rows, "id long, name string, block string")
    got = [(r["a"], r["b"], r["ratio"]) for r in services.related_names(files, "id", "name", "block").collect()]
    assert len(got) == len(set(got)) and set(got) == want


def test_shared_identifiers_are_all_pairs(spark):
    sets = {1: "x", 2: "y", 3: "z", 4: "xyz", 5: "xyz", 6: "xyq", 7: "w", 8: "xq", 9: "v", 10: "xyz"}
    ids = spark.createDataFrame([(d, "email", v) for d, s in sets.items() for v in s], "doc_id long, kind string, value string")
    want = {(b, a): len(set(x) & set(y)) for a, x in sets.items() for b, y in sets.items() if a < b and set(x) & set(y)}
    rows = bytes_and_text.shared_identifiers(ids).collect()
    assert len(rows) == len(want) and {(r["doc_id"], r["first"]): r["shared"] for r in rows} == want
    assert next(r["confidence"] for r in rows if (r["doc_id"], r["first"]) == (5, 4)) == 0.75


def test_outlook_levels_and_candidates(spark):
    gaps = [(1, 1, 1000, "a"), (2, 1, 950, "a"), (3, 1, 100, "a"), (4, 1, 1000, "b"), (5, 1, 5, "c"), (6, 1, 1000, "hot")]
    free = [("a", 11, 1000, True), ("a", 12, 900, True), ("a", 13, 990, False), ("a", 14, 9000, False), ("b", 21, 1090, False), ("b", 22, 5, False)]
    free += [("hot", 100 + i, 700 + i % 2, i % 3 == 0) for i in range(60)]
    rows = services.outlook(spark.createDataFrame(gaps, "file long, gap long, length long, family string"), spark.createDataFrame(free, "family string, candidate long, size long, structural boolean")).collect()

    def rank(length, size, structural):
        return 3 if structural and size <= length else 2 if abs(size - length) <= 0.1 * length else 1

    for r in rows:
        _, _, length, family = gaps[r["file"] - 1]
        best = sorted((-rank(length, s, k), abs(s - length), c) for f, c, s, k in free if f == family)[:8]
        assert r["candidates"] == [c for _, _, c in best]
        assert r["level"] == ("UNKNOWN", "LOW", "MEDIUM", "HIGH")[-best[0][0] if best else 0]
    assert sorted(r["level"] for r in rows) == ["HIGH", "HIGH", "HIGH", "LOW", "MEDIUM", "UNKNOWN"]


def test_outlook_query_has_all_levels(spark):
    from siftlake import plans

    levels = {r["level"] for r in plans.QUERIES["q_outlook"](spark, "/root/testdata/sf0.001").select("level").collect()}
    assert levels == {"HIGH", "MEDIUM", "LOW", "UNKNOWN"}


def test_hex_view_shows_any_bytes(spark):
    texts = {1: b"a", 2: bytes(range(256)) * 5, 3: "é".encode() * 40, 4: b""}
    df = spark.createDataFrame([(k, bytearray(v)) for k, v in texts.items()], "id long, data binary")
    for offset, length in ((0, None), (70, 33), (1000, 512), (-3, 16)):
        want = set()
        for k, v in texts.items():
            start = max(0, min(offset, len(v) - 1))
            part = v[start : start + length] if length else v[start:]
            shown = lambda x: "".join(chr(c) if 32 <= c < 127 else "." for c in x)
            want |= {(k, start + i, part[i : i + 16].hex(" ").upper(), shown(part[i : i + 16])) for i in range(0, len(part), 16)}
        rows = bytes_and_text.hex_view(df, "id", "data", offset, length).collect()
        assert len(rows) == len(want) and {tuple(r) for r in rows} == want


def test_hex_dump_reaches_the_end(spark):
    from siftlake import plans

    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").selectExpr("sum(ceil(octet_length(cast(text as binary)) / 16)) as n").first()
    assert plans.QUERIES["q_hex_dump"](spark, "/root/testdata/sf0.001").count() == docs["n"]


def union_find(edges):
    up = {}

    def root(x):
        while up.setdefault(x, x) != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    for a, b in edges:
        a, b = sorted((root(a), root(b)))
        up[b] = a
    return {x: root(x) for x in list(up)}


def test_components_of_all_rows(spark):
    from siftlake import plans

    groups = {}
    rows = spark.read.parquet("/root/testdata/sf0.001/lineitem.parquet").select("l_suppkey", "l_quantity", "l_linenumber", "l_partkey").collect()
    for r in rows:
        groups.setdefault(r[:3], set()).add(r[3])
    want = union_find([(min(g), x) for g in groups.values() for x in g if x != min(g)])
    found = plans.QUERIES["q_components_all"](spark, "/root/testdata/sf0.001").collect()
    assert len(found) == len(want) and {r["id"]: r["component"] for r in found} == want


def test_components_of_long_paths(spark):
    path = [0, *range(200, 0, -1)]
    edges = [*zip(path, path[1:]), (500, 501), (502, 501), (600, 600)]
    found = relational.components(spark.createDataFrame(edges, "a long, b long")).collect()
    assert {r["id"]: r["component"] for r in found} == union_find(edges[:-1]) and len(found) == 204


def test_input_types_of_long_inputs(spark):
    stamp, zipped = b"2024-05-06 07:08:09", b"PK\x03\x04" + b"\x00" * 70_000
    inputs = {
        "log": b"a line\n" * 10_000 + stamp,
        "text": b"a line\n" * 10_000,
        "docx": zipped + b"word/document.xml" + b"\x00" * 60_000,
        "zip": zipped + b"word/document.xml" + b"\x00" * 70_000,
        "xlsx": b"PK\x03\x04xl/" + b"\x00" * 70_000,
    }
    short = {"docx": b"PK\x03\x04 word/document.xml", "zip": b"PK\x03\x04", "log": stamp, "empty": b""}
    rows = [(k, bytearray(v)) for x in (inputs, short) for k, v in x.items()]
    df = spark.createDataFrame(rows, "want string, data binary")
    assert [r["want"] for r in df.collect()] == [r["kind"] for r in df.select(services.input_type(df["data"]).alias("kind")).collect()]
