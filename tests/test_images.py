"""The raw-image path against the truth of a generated image."""

import numpy as np
from pyspark.sql import functions as F

from siftlake.functions import parsers as P
from siftlake.functions.fixed import CLUSTER
from siftlake.operators import carving as C
from siftlake.operators import directories, reconstruct
from siftlake.sources import images, layout, synth


def test_scalar_parsers():
    assert P.entropy(b"") == 0.0 and P.entropy(b"aaaa") == 0.0 and P.entropy(bytes(range(256))) == 8.0
    assert P.printable(b"ab\n\x00") == 0.75
    data = synth.zip_bytes(np.random.default_rng(1), 2)
    assert [m["state"] for m in P.zip_members(data)] == ["ok"] * 3
    at = P.zip_members(data)[1]["offset"] + 60
    assert [m["state"] for m in P.zip_members(data[:at] + b"\xa5" + data[at + 1 :])] == ["ok", "bad", "ok"]
    pdf = synth.pdf_bytes(2)
    assert {(o["number"], o["start"]) for o in P.pdf_objects(pdf) if o["whole"]} == set(P.pdf_xref(pdf))
    assert [o["reason"] for o in P.pdf_objects(pdf[:400])][-1] == "cut"


def test_directory_recovers_deleted_name(spark):
    data = synth.fat_directory_bytes([("annual report.pdf", 9, 100, True), ("x y z.txt", 12, 5, False), ("exactly 13 ch.txt", 70000, 6, True)])
    broken = bytearray(data)
    broken[13] ^= 0x55  # the checksum in the long-name parts no longer fits
    bare = bytes([0xE5]) + b"OTES   TXT" + bytes([0x20]) + bytes(14) + (5).to_bytes(2, "little") + (77).to_bytes(4, "little")
    frame = spark.createDataFrame([(1, bytearray(data)), (2, broken), (3, bytearray(bare.ljust(64, b"\0"))), (4, bytearray(b"junk")), (5, bytearray())], "cluster long, data binary")
    got = {(r["cluster"], r["entry"]): r for r in directories.entries(frame, "cluster", "data").collect()}
    rows = [got[k] for k in sorted(got)]
    a, b, c = rows[:3]
    assert (a["name"], a["deleted"], a["first_letter"], a["image_cluster"], a["name_confidence"]) == ("annual report.pdf", True, "A", 7, 0.95)
    assert (b["name"], b["name_confidence"], b["size"], b["first_letter"]) == ("x y z.txt", 0.98, 5, None)
    assert (c["name"], c["first_cluster"], c["first_letter"], c["modified"]) == ("exactly 13 ch.txt", 70000, "E", "2025-01-01T12:00:00")
    assert rows[3]["name"] == "annual report.pdf" and rows[3]["name_confidence"] in (0.8, 0.95)
    assert (rows[-1]["cluster"], rows[-1]["name"], rows[-1]["name_confidence"], rows[-1]["size"], rows[-1]["modified"]) == (3, "_OTES.TXT", 0.6, 77, None)


def test_checksum_of_a_short_name():
    total = 0
    for code in b"README  TXT":
        total = ((total & 1) << 7) + (total >> 1) + code & 0xFF
    assert P.lfn_checksum(b"README  TXT") == total


def test_sqlite_rows_are_all_read():
    db = synth.sqlite_bytes(300)
    rows = [r for i in range(1, len(db) // CLUSTER) for r in P.table_rows(db[i * CLUSTER : (i + 1) * CLUSTER])]
    assert sorted(r for r, _, _ in rows) == list(range(1, 301)) and all(w for *_, w in rows)
    assert {r: v for r, v, _ in rows}[7][1].startswith("item number 7")


def test_sqlite_overflow_pages_and_long_blobs(spark, tmp_path):
    import sqlite3

    path = tmp_path / "x.db"
    db = sqlite3.connect(path)
    db.execute("pragma page_size = 1024")
    db.execute("create table t (id integer primary key, a text, b blob, c real, d integer)")
    want = {i: ("long " * (i * 37), bytes(range(256)) * (i % 9), i / 7, [None, 0, 1, -5, 300, 70000, 2**40, -(2**62)][i % 8]) for i in range(1, 60)}
    db.executemany("insert into t values (?, ?, ?, ?, ?)", [(i, *v) for i, v in want.items()])
    db.commit()
    db.close()
    frame = spark.createDataFrame([(1, bytearray(path.read_bytes())), (2, bytearray(b"no database"))], "file long, data binary")
    rows = [r for r in C.database_rows(frame, "file", "data").collect() if len(r["values"]) == 5 and r["values"][1] is not None and r["rowid"] in want and r["page"] > 1]
    assert len(rows) == len(want) and all(r["whole"] for r in rows)
    for r in rows:
        a, b, c, d = want[r["rowid"]]
        assert r["values"][:3] == [None, a, b.hex()] and float(r["values"][3]) == c  # whole numbers are stored as integers
        assert r["values"][4] == (None if d is None else str(d))
    cut = path.read_bytes()
    pages = spark.createDataFrame([(n, bytearray(cut[n * 1024 : (n + 1) * 1024])) for n in range(1, len(cut) // 1024)], "cluster long, data binary")
    alone = C.sqlite_rows(pages, "cluster", "data").where("not whole").collect()
    assert alone and all(r["values"][1] in (None, want[r["rowid"]][0]) and r["values"][2] in (None, want[r["rowid"]][1].hex()) for r in alone if r["rowid"] in want and len(r["values"]) == 5)


def test_image_classes_match_truth(spark, tmp_path):
    image, truth = synth.build_image()
    path = tmp_path / "disk.img"
    path.write_bytes(image + b"tail")  # the last cluster is short
    clusters = images.read_image(spark, str(path))
    assert clusters.count() == len(image) // CLUSTER + 1
    assert bytes(clusters.orderBy(F.desc("cluster")).first()["data"]) == b"tail".ljust(CLUSTER, b"\0")
    got = {r["cluster"]: r["family"] for r in C.classify(clusters).select("cluster", "family").collect()}
    families = {"jpeg": {"jpeg"}, "pdf": {"pdf"}, "zip": {"compressed"}, "sqlite": {"sqlite"}, "log": {"log"}}
    for name, kind, _, places in truth.files:
        seen = [got[c] for c in places if c is not None]
        assert sum(f in families[kind] for f in seen) / len(seen) >= 0.9, (name, seen)
    assert got[1] == "fat_dir"


def test_fragments_do_not_mix_families_and_copies_are_found(spark):
    image, truth = synth.build_image()
    clusters = C.with_image(synth.image_frame(spark, image))
    classified = C.classify(clusters)
    frags = C.duplicate_fragments(C.fragments(classified)).cache()
    owner = {c: name for name, _, _, places in truth.files for c in places if c is not None}
    for r in frags.collect():
        names = {owner.get(c) for c in range(r["first"], r["first"] + r["n_clusters"])} - {None}
        assert len(names) <= 1
    assert frags.where("duplicate_of is not null").count() >= 1
    named = {r["name"] for r in C.name_fragments(frags, C.directory_entries(classified, clusters)).collect()}
    assert {"annual report.pdf", "inventory.db", "holiday photo.jpg"} <= named


def test_placement_votes_are_right(spark):
    image, truth = synth.build_image()
    places = next(p for n, _, _, p in truth.files if n == "annual report.pdf")
    clusters = C.with_image(synth.image_frame(spark, image))
    classified = C.classify(clusters).cache()
    frags = C.fragments(classified).cache()
    tails, entries = reconstruct.pdf_tails(reconstruct.fragment_bytes(frags.where("family = 'pdf'"), clusters))
    rows = reconstruct.placed_by_index(frags, classified, "pdf_objects", "number", tails, entries).collect()
    assert {(r["logical"], r["cluster"]) for r in rows} == set(enumerate(places))


def test_range_read_and_validators(spark):
    image, _ = synth.build_image()
    clusters = synth.image_frame(spark, image)
    assert bytes(images.read_range(clusters, 4000, 300).first()["data"]) == image[4000:4300]
    rng = np.random.default_rng(7)
    pdf, archive, photo = synth.pdf_bytes(3), synth.zip_bytes(rng, 3), synth.jpeg_bytes(rng, 9000)
    files = [("ok.pdf", "pdf", pdf), ("cut.pdf", "pdf", pdf[:-150]), ("ok.zip", "zip", archive), ("bad.zip", "zip", archive[:900] + bytes(40) + archive[940:]), ("ok.jpg", "jpeg", photo), ("cut.jpg", "jpeg", photo[:-2]), ("ok.db", "sqlite", synth.sqlite_bytes(50)), ("a.log", "log", synth.log_bytes(20)), ("b.bin", "blob", b"\0\1")]
    frame = spark.createDataFrame([(n, k, bytearray(d)) for n, k, d in files], "file string, kind string, data binary")
    got = {(r["file"], r["category"]): r["status"] for r in C.summarise_checks(C.validate(frame, "file", "kind", "data"), "file").collect()}
    assert got["ok.pdf", "parser"] == "pass" and got["cut.pdf", "structural"] == "partial"
    assert got["ok.zip", "checksum"] == "pass" and got["bad.zip", "checksum"] == "fail"
    assert got["cut.jpg", "structural"] == "partial" and got["b.bin", "structural"] == "not_available"
    assert got["ok.db", "parser"] == got["a.log", "structural"] == "pass"


def test_layout_places_every_cluster_once(spark):
    """Several images at once: no two clusters at one place, the bytes of each where the truth says, directories first."""
    sizes = [("a", f"f{i}", i * 3000 % 90_000 + (i % 4 > 0)) for i in range(40)] + [("b", "only", 4096), ("c", "none", 0), ("d", "long", 700_000)]
    data = {(i, f): bytes((k * 7 + n * 13) % 251 + 1 for k in range(n)) for i, f, n in sizes}
    files = spark.createDataFrame([(i, f, f"{f} name.bin", False, bytearray(data[i, f])) for i, f, _ in sizes], "image string, file string, name string, deleted boolean, data binary")
    clusters, truth = layout.lay_out(files, damaged=F.col("image") == "a")
    found = {}
    for r in clusters.collect():
        assert (r["image"], r["cluster"]) not in found and len(r["data"]) == CLUSTER
        found[r["image"], r["cluster"]] = bytes(r["data"])
    rows = truth.collect()
    assert {(r["image"], r["file"], r["logical"]) for r in rows} == {(i, f, k) for i, f, n in sizes for k in range(-(-n // CLUSTER))}
    for r in rows:
        part = data[r["image"], r["file"]][r["logical"] * CLUSTER : (r["logical"] + 1) * CLUSTER].ljust(CLUSTER, b"\0")
        assert found[r["image"], r["cluster"]] == (bytes(CLUSTER) if r["lost"] else part)
    assert any(r["lost"] for r in rows) and not any(r["lost"] for r in rows if r["image"] != "a")
    for image in "abd":
        assert sorted(c for i, c in found if i == image) == list(range(max(c for i, c in found if i == image) + 1))
    listed = C.directory_entries(C.classify(clusters), clusters).where("image = 'a'").collect()
    first = {r["file"]: r["cluster"] for r in rows if r["image"] == "a" and r["logical"] == 0 and not r["copy"]}
    assert {r["name"].split()[0]: r["image_cluster"] for r in listed} == first


def test_logs_of_several_images(spark):
    from siftlake import plans

    rows = plans.QUERIES["q_image_logs"](spark, "/root/testdata/sf0.001").collect()
    assert len(rows) == 30 and all(r["missing"] == 0 and r["sha256"] for r in rows)
