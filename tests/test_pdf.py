"""The verdict on whole and damaged PDF files."""

import re

from siftlake.operators import pdf
from siftlake.sources import synth


def test_verdicts(spark):
    whole = synth.pdf_bytes(4)
    entries = [m.start() for m in re.finditer(rb"\d{10} 00000 n", whole)]
    shifted = bytearray(whole)
    for at in entries[3:6]:
        shifted[at : at + 10] = b"%010d" % (int(whole[at : at + 10]) + 37)
    cut = whole[:-150]
    short = whole.replace(b"endstream", b"  endstream", 1)
    treeless = whole.replace(b"/Kids", b"/Kide")
    files = [("whole", whole), ("cut", cut), ("shifted", bytes(shifted)), ("stream", short), ("treeless", treeless), ("noise", b"\x00\x01" * 50), ("empty", b"")]
    frame = spark.createDataFrame([(k, bytearray(v)) for k, v in files], "file string, data binary")
    found = pdf.checks(frame)
    got = {r["file"]: r for r in pdf.verdict(found).collect()}
    score = {(r["file"], r["check"]): r["score"] for r in found.collect()}
    assert (got["whole"]["status"], got["whole"]["integrity"], got["whole"]["problems"]) == ("FULLY_RECOVERED", 100.0, [])
    assert got["cut"]["status"] == "PARTIALLY_RECOVERED" and {"eof: fail", "startxref: fail"} <= set(got["cut"]["problems"])
    assert got["shifted"]["status"] == "MOSTLY_RECOVERED" and abs(score["shifted", "xref_offsets"] - (len(entries) - 3) / len(entries)) < 1e-9
    assert score["stream", "streams"] == 0.75 and got["stream"]["integrity"] < 100
    assert score["treeless", "page_tree"] == 0 and got["treeless"]["status"] == "FRAGMENT_ONLY"
    assert got["noise"]["status"] == got["empty"]["status"] == "UNRECOVERABLE" and score["whole", "render"] is None


def test_walk_has_no_depth_limit(spark):
    edges = [(1, i, i + 1) for i in range(34)] + [(1, 34, 0)]
    found = pdf.walk(spark.createDataFrame(edges, "group long, parent long, child long"), spark.createDataFrame([(1, 0)], "group long, node long"))
    assert {(r["node"], r["depth"]) for r in found.collect()} == {(i, i) for i in range(35)}
