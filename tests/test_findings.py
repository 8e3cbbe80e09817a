"""Made tables on which queries, or their SQL, were wrong or failed."""

import hashlib
import random

import duckdb
import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from siftlake import plans
from siftlake.functions import parsers
from siftlake.functions.batches import framed, sliced
from siftlake.functions.fixed import CLUSTER
from siftlake.operators import carving as C
from siftlake.operators import cross, placement, reconstruct, services
from siftlake.plans import placement as placed_queries
from siftlake.plans.registry import Tables
from siftlake.sources import layout


def agree(spark, folder, name, **tables):
    """Rows of a query on the tables (Arrow frames by name), which must be those of its SQL."""
    con = duckdb.connect()
    for table, frame in tables.items():
        frame.write.parquet(f"{folder}/{table}.parquet")
        con.execute(f"create view {table} as select * from read_parquet('{folder}/{table}.parquet/*.parquet')")
    got = plans.QUERIES[name](spark, str(folder))
    want = con.execute(f"select {', '.join(got.columns)} from ({plans.ORACLE_SQL[name]})").fetchall()
    rows = [tuple(r) for r in got.collect()]
    assert sorted(rows, key=repr) == sorted(want, key=repr)
    return rows


def test_cards_round_shares_once(spark, tmp_path):
    """0.0124996 of a page is 12 thousandths, not 13; a half goes up."""
    pages = [(1, "a" * 12_500 + "!" * 987_500), (2, "a" * 124_996 + "!" * 9_875_004), (3, "a" * 25 + "!" * 1975), (4, "")]
    rows = agree(spark, tmp_path, "q_cards", pages=spark.createDataFrame(pages, "page_id long, html string"))
    assert {r[0]: r[4].split()[12] for r in rows} == {1: "13", 2: "12", 3: "13"}


def test_parts_of_a_file_share_no_place(spark, tmp_path):
    """part 100005 on line 1 stands before part 5 on line 2, which had the same place."""
    lines = [(1, 100_005, 1, 1, 0.05, "N"), (1, 5, 1, 2, 0.07, "N"), (1, 250_000, 2, 1, 0.02, "R"), (1, 9, 1, 3, 0.01, "N")]
    frame = spark.createDataFrame(lines, "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_discount double, l_returnflag string")
    rows = agree(spark, tmp_path, "q_twin_joins", lineitem=frame)
    assert [(r[2], r[3]) for r in sorted(rows, key=lambda r: r[1])] == [("F100005", "F250000"), ("F250000", "F5"), ("F5", "F9")]


def text_of(doc_id, rest):
    """A text whose PDF leaves `rest` bytes for its last cluster."""
    return next(t for n in range(40_000) if len(layout.pdf_bytes(doc_id, t := "x" * n)) % CLUSTER == rest)


def test_equal_ends_of_two_files_are_copies(spark, tmp_path):
    """two reports of an image leave the same few bytes for their last clusters, and no piece is stored twice."""
    docs = [(i, text_of(i, 5), "en", "x", 1) for i in (7, 8)]
    rows = agree(spark, tmp_path, "q_image_duplicates", documents=spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long"))
    assert len(rows) == 1


def test_pieces_without_a_table_between_them(spark):
    """the begin of a table in one fragment and an end as far into its cluster in another, that make no table."""
    filler = b"%PDF-1.4\n" + b"1 0 obj\n<< >>\nendobj\n"
    head = (filler + b"% " + b"y" * CLUSTER)[: CLUSTER - 40] + b"\nxref\n0 9\n0000000000 65535 f \n0000000012"
    end = b"no rows at all\ntrailer\n<< /Size 9 >>\nstartxref\n%d\n%%%%EOF\n" % (head.index(b"xref\n0") + 2 * CLUSTER)
    rows = [("a", "a", 0, 1, bytearray(head.ljust(CLUSTER, b"0"))), ("b", "a", 5, 1, bytearray(end))]
    data = spark.createDataFrame(rows, "fragment string, image string, first long, n_clusters long, data binary")
    tails, entries = reconstruct.pdf_tails(data)
    assert tails.count() == 0 and entries.count() == 0


@pytest.mark.parametrize("rest", [1, 3, 5])
def test_an_end_mark_cut_between_clusters(spark, rest):
    """of the end mark of a PDF only the last bytes lie in the last cluster, which looks like plain text."""
    data = layout.pdf_bytes(3, text_of(3, rest))
    frame = spark.createDataFrame([("one", "3", "report 3.pdf", False, bytearray(data))], "image string, file string, name string, deleted boolean, data binary")
    clusters, _ = layout.lay_out(frame)
    found = reconstruct.recovered_files(clusters).collect()
    assert [(r["name"], r["missing"], r["sha256"]) for r in found] == [("report 3.pdf", 0, hashlib.sha256(data).hexdigest())]


def test_a_cluster_of_table_rows_is_pdf(spark):
    """a long table fills a cluster with rows alone, which is no plain text."""
    rows = "".join(f"{i:010d} 00000 n \n" for i in range(300)).encode()[7 : 7 + CLUSTER]
    prose = (b"0000000001 00000 n is what a row looks like. " * 100)[:CLUSTER]
    frame = spark.createDataFrame([(1, bytearray(rows)), (2, bytearray(prose))], "cluster long, data binary")
    assert {r["cluster"]: r["family"] for r in C.classify(frame).collect()} == {1: "pdf", 2: "text"}


def test_nearest_takes_one_pass_a_group(spark):
    """no frame goes from each row to the end of its group; targets below, above, on and between items."""
    pool = spark.createDataFrame([(1, "t", 10), (2, "t", 20), (3, "t", 20), (4, "u", 5)], "item int, g string, size long")
    targets = spark.createDataFrame([(1, "t", 3), (2, "t", 20), (3, "t", 14), (4, "t", 16), (5, "t", 99), (6, "v", 1)], "target int, g string, size long")
    found = placement.nearest(targets, pool, ["g"], "size", "item")
    assert {r["target"]: (r["item"], r["off"]) for r in found.collect()} == {1: (1, 7), 2: (2, 0), 3: (1, 4), 4: (2, 4), 5: (2, 79), 6: (None, None)}
    assert "unboundedfollowing" not in found._jdf.queryExecution().optimizedPlan().toString().lower()


def test_runs_of_a_long_text_take_one_pass(spark):
    """grams of a text of 300,000 characters, which took minutes; characters of several bytes and lines' ends."""
    frame = spark.createDataFrame([("ab\ncd\U0001f600e",), ("abc",), ("xyz" * 100_000,)], "t string")
    got = [r[0] for r in frame.select(cross._grams(F.col("t"))).collect()]
    assert {"ab\ncd", "b\ncd\U0001f600", "\ncd\U0001f600e"} <= set(got[0]) and got[1] == [] and set(got[2]) == {"xyzxy", "yzxyz", "zxyzx"}
    assert "substring" not in frame.select(cross._grams(F.col("t")))._jdf.queryExecution().optimizedPlan().toString()


def test_copies_of_indexes_are_classes(spark, tmp_path):
    """thirty copies of four orders, of which q_index_scores gives every pair; the classes that q_tail_pairs
    works with hold them all, and tails go to headers as in turn."""
    rng = random.Random(5)
    kinds = [[(rng.randrange(20) + 900, n) for n in range(1, 1 + k)] for k in (1, 2, 3, 4)]
    lines = [(60 * i + 2 * j, 3 * rng.randrange(2) + (i % 2), n, float(p)) for i in range(30) for j, kind in enumerate(kinds) for p, n in kind]
    frame = spark.createDataFrame(lines, "l_orderkey long, l_partkey long, l_linenumber int, l_extendedprice double")
    rows = agree(spark, tmp_path, "q_index_scores", lineitem=frame)
    plain = {(r["header"], r["tail"]): (round(r["score"], 6), r["same"]) for r in placed_queries._scores(Tables(spark, str(tmp_path))).collect()}
    assert {(r[0], r[1]): (r[2], r[3]) for r in rows} == plain and len(rows) == len(plain)
    pairs, _, _ = placement.index_class_scores(*placed_queries._sides(Tables(spark, str(tmp_path))))
    pairs = pairs.collect()
    assert len(pairs) < len(plain) / 4
    first = {(r["side"], r["fragment"]): r["first"] for r in plans.QUERIES["q_index_classes"](spark, str(tmp_path)).collect()}
    of = {}
    for (side, fragment), one in first.items():
        of.setdefault((side, one), []).append(fragment)
    whole = {(h, t): (round(r["score"], 6), False) for r in pairs for h in of["header", r["header"]] for t in of["tail", r["tail"]] if h != t}
    assert whole | {x: y for x, y in plain.items() if y[1]} == plain
    used, turns = set(), set()
    for h in sorted({h for h, _ in plain}):
        mine = sorted((not same, -score, t) for (x, t), (score, same) in plain.items() if x == h and (score >= 0.5 or same) and t not in used)
        if mine:
            used.add(mine[0][2])
            turns.add((h, mine[0][2]))
    assert {(r["header"], r["tail"]) for r in plans.QUERIES["q_tail_pairs"](spark, str(tmp_path)).collect()} == turns and len(turns) > 50


def test_files_of_an_image_are_made_for_sizes_and_bytes_only(spark):
    """Truth, directories and pieces came from files that were made again for each of them."""
    frame = spark.createDataFrame([(i, "x" * 900 * i) for i in range(1, 9)], "doc_id long, text string")
    clusters, truth = layout.lay_out(layout.pdf_files(frame))
    plan = lambda df: df._jdf.queryExecution().optimizedPlan().toString()
    assert "MapInArrow" not in plan(truth) and plan(clusters).count("pdf_bytes") + plan(clusters).count("work(") == 1
    names = {(r["image"], r["file"], r["name"]) for r in layout.pdf_names(frame).collect()}
    assert names == {(r["image"], r["file"], r["name"]) for r in layout.pdf_files(frame).collect()}


def test_python_objects_are_made_of_bounded_slices():
    """all rows of all databases of a batch were Python objects at once."""
    lists = [[{"id": i, "name": f"row {i}"} for i in range(n)] for n in (5000, 1, 0, 3000, 40)] * 20
    batch = pa.RecordBatch.from_arrays([pa.array(range(100)), pa.array(lists)], ["k", "rows"])
    parts = list(sliced([batch], most=100_000))
    assert pa.Table.from_batches(parts).to_pylist() == batch.to_pylist() and all(p.nbytes <= 100_000 or p.num_rows == 1 for p in parts)
    frames = list(framed([pd.DataFrame({"k": range(10)}), pd.DataFrame({"k": []})], rows=4))
    assert [list(f["k"]) for f in frames] == [[0, 1, 2, 3], [4, 5, 6, 7], [8, 9]]


def test_rows_of_a_large_database_come_in_parts(spark):
    """more rows than one part holds, in order, and an empty file."""
    from siftlake.sources.synth import database_bytes

    data = database_bytes([("a", i, f"n{i}", 1.0) for i in range(40_000)])
    frame = spark.createDataFrame([("x", bytearray(data)), ("y", bytearray())], "file string, data binary").coalesce(1)
    got = C.database_rows(frame, "file", "data").where("page > 1").select("rowid").collect()
    assert [r[0] for r in got] == list(range(40_000))


def test_equal_names_are_classes(spark, tmp_path):
    """F8: twenty copies of seven parts gave each pair four hundred times; expanded by their classes they are all pairs."""
    names = ["blue steel bolt", "steel bolt, blue", "bolt blue steel x", "tin nut", "nut of tin", "blue steel bolt", None]
    parts = [(10 * i + j, n, "B1" if j != 5 else "B2") for i in range(20) for j, n in enumerate(names)]
    frame = spark.createDataFrame(parts, "p_partkey long, p_name string, p_brand string")
    frame.write.parquet(f"{tmp_path}/x/part.parquet")
    members = {}
    for file, first in agree(spark, tmp_path, "q_name_classes", part=frame):
        members.setdefault(first, []).append(file)
    rows = plans.QUERIES["q_name_relations"](spark, f"{tmp_path}/x").collect()
    whole = sorted((a, b, r["ratio"], r["confidence"]) for r in rows for a in members[r["a"]] for b in members[r["b"]] if a < b)
    plain = sorted(tuple(r) for r in services.related_names(frame, "p_partkey", "p_name", "p_brand").collect())
    assert whole == plain and len(rows) < len(plain) / 50


def test_database_values_are_counted_once_a_class(spark, monkeypatch):
    import re

    from siftlake.operators import cross

    monkeypatch.setattr(cross, "mentions", None)  # no runs of characters of all texts
    bases = [(f"db{i}", "Rows: Ann Lee AB-12 x Bob Ray" + " | CD-77 Eve Moe" * (i % 2)) for i in range(4)] + [("other", "Ann Le AB-12")]
    texts = [(f"t{i}", ["met Ann Lee, AAB-123 too", "Ann Lee Bob Ray Bob Ray", "CD-77 Eve Moeses", "", None, "XAnn LeeX"][i % 6]) for i in range(60)] + [("db1", "Ann Lee AB-12")]
    frames = spark.createDataFrame(bases, "file string, text string"), spark.createDataFrame(texts, "file string, text string")
    got = sorted((r["a"], r["b"], r["hits"]) for r in cross.database_links(*frames).collect())
    values = {a: set(re.findall(r"\b[A-Z][a-z]+ [A-Z][a-z]+\b|\b[A-Z]{2,}-\d{2,}\b", x)) for a, x in bases}
    every = [(a, b, sum(v in (y or "") for v in values[a])) for a in values for b, y in texts if a != b]
    assert got == sorted((a, b, min(n, 5)) for a, b, n in every if n >= 2) and len(got) > 100


def test_storage_links_meet_in_zones(spark, monkeypatch):
    """a pair of files that meets often is moved about once a zone, not once a meeting; zones are crossed."""
    rng = random.Random(4)
    rows = [(rng.randrange(6), s, s + rng.choice([1, 500, 30_000])) for s in (rng.randrange(-100_000, 2_000_000) for _ in range(800))] + [(9, 5, 5)] * 3
    monkeypatch.setattr(cross, "ZONE", 100)
    found = cross.storage_links(spark.createDataFrame(rows, "file long, start long, end long"))
    got = {(r["a"], r["b"]): r["gap"] for r in found.collect()}
    want = {}
    for f, s, e in rows:
        for g, t, _ in rows:
            if f != g and s <= t <= e + 8192:
                key = (min(f, g), max(f, g))
                want[key] = min(want.get(key, 8192), max(0, t - e))
    assert got == want and len(got) > 10
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan
    assert cross.storage_links(spark.createDataFrame([], "file long, start long, end long")).count() == 0


def test_a_block_is_met_in_strips():
    """a block against a block, with ties at the k-th place; whole matrices of cosines were sorted before."""
    import tracemalloc

    import numpy as np

    from siftlake.operators import fragment_index as I

    rng = np.random.default_rng(3)

    def table(n, name):
        x = rng.integers(0, 3, size=(n, 16)) + 0.0
        x[:, 0] += 1
        x /= np.linalg.norm(x, axis=1, keepdims=True)
        return pa.table([rng.permutation(n), pa.array(x.tolist(), pa.list_(pa.float64()))], ["id" if name == "id" else "rep", "unit"]), x

    (left, a), (right, b) = table(600, "id"), table(1500, "rep")
    tracemalloc.start()
    got = I._pairs(left, right, 13).to_pylist()
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    cosine, rep, want = np.round(a @ b.T, 6), right.column("rep").to_numpy(), set()
    for i, query in enumerate(left.column("id").to_pylist()):
        for j in np.lexsort((rep, -cosine[i]))[:13]:
            want.add((query, int(rep[j]), round(float(cosine[i, j]), 5)))
    assert {(r["query"], r["rep"], round(r["cosine"], 5)) for r in got} == want and len(got) == len(want) == 600 * 13
    assert peak < a.shape[0] * b.shape[0] * 8
    assert I._pairs(left, right.slice(0, 5), 13).num_rows == 600 * 5


def test_covered_lengths_and_runs(spark):
    """runs are no groups of their own, and the share of a task does not grow with the input."""
    from siftlake.operators import relational

    rng = random.Random(7)
    rows = [(rng.randrange(5), s, s + rng.randrange(0, 9)) for s in (rng.randrange(300) for _ in range(200))]
    frame = spark.createDataFrame(rows, "k int, s long, e long")
    found = relational.covered_length(frame, ["k"], "s", "e")
    runs = relational.merge_intervals(frame, ["k"], "s", "e").groupBy("k").agg(F.count(F.lit(1)).alias("n_runs"), F.sum(F.col("end") - F.col("start")).alias("covered"))
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, runs.collect()))
    segments = [(f, 10 * i, 10 * i + (10 if rng.random() < 0.9 else 8), rng.choice([1, 1, 1, None]), None if rng.random() < 0.1 else 1000 + 10 * i + rng.choice([0, 0, 0, 5])) for f in range(6) for i in range(80)]
    got = placement.coalesce_segments(spark.createDataFrame(segments, "file int, start long, end long, fragment int, source long"), "file")
    want = []
    for r in segments:
        p = want[-1] if want else None
        if p and p[0] == r[0] and p[2] == r[1] and p[3] == r[3] and None not in (last[4], r[4]) and r[4] - last[4] == r[1] - last[1]:
            p[2] = r[2]
        else:
            want.append(list(r))
        last = r
    assert sorted(map(repr, map(list, got.collect()))) == sorted(map(repr, want)) and len(want) < len(segments)
    for made in (found, got):
        assert "_run" not in made._jdf.queryExecution().optimizedPlan().toString().replace("n_runs", "")
    assert relational.in_parts(spark.range(3 * relational.TASK_ROWS), ["id"]).rdd.getNumPartitions() == 4


def test_covered_lengths_equal_their_sql(spark, tmp_path):
    """keys and bounds that are null, and segments within others."""
    rows = [(1, 5, 3.0), (1, 5, 30.0), (1, 6, 1.0), (1, 8, 9.0), (1, 20, 2.0), (2, 4, 10.0), (2, 5, 2.0), (None, 3, 1.0)]
    agree(spark, tmp_path, "q_coverage", lineitem=spark.createDataFrame(rows, "l_suppkey long, l_partkey long, l_quantity double"))


def test_outlook_deals_lengths_and_candidates(spark, monkeypatch):
    """a family's lengths meet its candidates in several tasks; one task had all of them before."""
    rng = random.Random(11)
    gaps = [(i, i, rng.randrange(1, 400), rng.choice("abz")) for i in range(150)]
    free = [(rng.choice("ab"), rng.randrange(60), rng.randrange(1, 50) * 10, rng.random() < 0.3) for _ in range(300)]
    monkeypatch.setattr(services, "LENGTHS", 10)
    frames = spark.createDataFrame(gaps, "file long, gap long, length long, family string"), spark.createDataFrame(free, "family string, candidate long, size long, structural boolean")
    found = services.outlook(*frames)
    for r in found.collect():
        _, _, length, family = gaps[r["file"]]
        kinds = {}
        for _, c, size, s in {x for x in free if x[0] == family}:
            kinds.setdefault((size, s), []).append(c)
        ranked = sorted((-(3 if s and size <= length else 2 if abs(size - length) <= 0.1 * length else 1), abs(size - length), c) for (size, s), cs in kinds.items() for c in sorted(cs)[:8])[:8]
        assert r["candidates"] == [c for *_, c in ranked] and r["level"] == {3: "HIGH", 2: "MEDIUM", 1: "LOW"}.get(-ranked[0][0] if ranked else 0, "UNKNOWN")
    assert "part#" in found._jdf.queryExecution().optimizedPlan().toString()


def test_a_header_read_into_other_bytes_has_a_name(spark):
    """a local header ends a cluster, and the next one on the image begins with bytes that are no text."""
    head = b"PK\x03\x04" + bytes(22) + (9).to_bytes(2, "little") + bytes(2) + b"doc1"
    rows = [("a", 0, bytearray(head.rjust(CLUSTER, b"x"))), ("a", 1, bytearray(b"\xff\xfe\x80\xd0 ".ljust(CLUSTER, b"y")))]
    found = reconstruct.cut_headers(spark.createDataFrame(rows, "image string, cluster long, data binary")).collect()
    assert {(r["cluster"], r["pos"]) for r in found} == {(0, CLUSTER - len(head)), (1, -len(head))} and all(r["name"].startswith("doc1") for r in found)


@pytest.mark.parametrize("name", ["q_image_families", "q_image_directory", "q_image_files", "q_image_placement"])
def test_lists_of_pages_are_no_directory(spark, tmp_path, name):
    """The list of pages of a long report goes on in its second cluster, where eight letters to a page
    look like entries of a directory; that of the longest fills clusters."""
    docs = [(211, "x" * 125_000), (422, "y" * 300_000), (212, "one"), (213, "two words"), (420, "z" * 9_000)]
    second = layout.pdf_bytes(211, docs[0][1])[CLUSTER : 2 * CLUSTER]
    assert second[:256:32] == second[:1] * 8
    agree(spark, tmp_path, name, documents=spark.createDataFrame(docs, "doc_id long, text string"))


def test_meetings_are_not_moved(spark, monkeypatch):
    """pairs with several common objects are counted once, in bounded sets or over all meetings; nothing that
    pairs make is dealt out where all sets are bounded."""
    rng = random.Random(8)
    draw = lambda side, k: [(i, rng.randrange(3), rng.choice((5, 6, 7, 1 << 60, None))) for i in range(k) for _ in range(rng.randrange(9))] + [(99, n, 5) for n in range(3)]
    a, b = spark.createDataFrame(draw("a", 30), "header long, number int, pos long"), spark.createDataFrame(draw("b", 30), "tail long, number int, offset long")
    heads, tails = {}, {}
    for rows, sets in ((a, heads), (b, tails)):
        for item, *x in rows.collect():
            sets.setdefault(item, set()).add(tuple(x))
    common = lambda h, t: sum(None not in x for x in heads[h] & tails[t])
    want = {(h, t): (common(h, t) / len(heads[h]), False) for h in heads for t in tails if h != t and common(h, t)} | {(h, h): (1.0, True) for h in heads if h in tails}
    for most in (64, 2):
        monkeypatch.setattr(placement, "MOST", most)
        got = placement.all_index_scores(a, b).collect()
        assert {(r["header"], r["tail"]): (r["score"], r["same"]) for r in got} == want and len(got) == len(want)
    monkeypatch.setattr(placement, "MOST", 64)
    plan = placement._meetings(a.where("pos < 100"), b.where("offset < 100").withColumnRenamed("offset", "pos"))._jdf.queryExecution().optimizedPlan().toString()
    assert "Aggregate" not in plan


def test_objects_and_held_clusters_are_found_as_before(spark):
    """object numbers come from their word, not from all runs of digits; clusters that hold anything
    are found in Spark, in one pass."""
    rng = random.Random(4)
    bits = [b"1", b"12", b"1234567", b"12345678", b" ", b"  ", b" obj", b"obj", b"objx", b"\n", b"x"]
    for _ in range(2000):
        data = b"".join(rng.choice(bits) for _ in range(rng.randrange(60)))
        assert parsers.object_numbers(data) == [(m.start(1), int(m.group(1))) for m in parsers.OBJECT.finditer(data)]
    rows = [bytes(CLUSTER), b"\0" * 9 + b"x" + bytes(CLUSTER - 10), bytes(100), b"y" * CLUSTER, bytes(CLUSTER - 1) + b"z"]
    frame = spark.createDataFrame([("a", i, bytearray(d)) for i, d in enumerate(rows)], "image string, cluster long, data binary")
    want = {(r["cluster"], r["hash"]) for r in C.classify(frame).where("not zero").collect()}
    held = C.held_clusters(frame)
    assert {(r["cluster"], r["hash"]) for r in held.collect()} == want and len(want) == 3
    assert "Python" not in held._jdf.queryExecution().executedPlan().toString() and "MapIn" not in held._jdf.queryExecution().executedPlan().toString()
