"""Reply trees and chat formatting against plain Python."""

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from siftlake.llm import chat_format
from siftlake.llm.common import Scratch

TEMPLATE = chat_format.Template()
BITS = ["[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "[ROLE]", "[/ROLE]", "</s>", "\\", "\\\\", " ", "\n", "ok", "é", "[", "<", "s>", "/INST]"]


def odd(rng, n=9):
    return "".join(rng.choice(BITS) for _ in range(rng.randrange(n)))


def test_turns_read_back_exactly():
    rng = random.Random(12)
    for _ in range(3000):
        turns = [(rng.choice(["user", "assistant", "system", "tool", "", odd(rng)]), odd(rng)) for _ in range(rng.randrange(6))]
        made = [TEMPLATE.turn(*t) for t in turns]
        text = "".join(t for t, _ in made)
        back = list(TEMPLATE.turns(text))
        assert [(r, t) for r, t, _, _ in back] == turns
        assert all((at >= 0) == (r == "assistant") for (_, at), (r, _) in zip(made, turns))
    with pytest.raises(ValueError):
        _ = chat_format.Template(close="[INST]x").control
    with pytest.raises(ValueError):
        _ = chat_format.Template(close="\\s").control


def digest(turns):
    whole = "".join(f"{r}\n{t}\n" for r, t in turns)
    loss = "".join(t for r, t in turns if r == "assistant")
    chars = sum(len(TEMPLATE.turn(r, t)[0]) for r, t in turns)
    return len(turns), hashlib.sha256(whole.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest(), chars


def test_lists_of_turns(spark):
    rng = random.Random(3)
    rows = [(c, t, rng.choice(["user", "assistant", "system", "tool", None]), rng.choice([odd(rng), None, ""])) for c in range(40) for t in range(rng.randrange(1, 12))]
    rows += [(50, t, "assistant", f"long {t}") for t in range(300)] + [(51, 0, "user", "same")] * 3 + [(51, None, "user", "first")]
    rows += [(None, 0, "user", "no id"), (None, 1, "assistant", "x"), (52, 0, "assistant", "w " * 300_000), (52, 1, "assistant", "end")]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").select("*", F.lit(1).alias("branch"), F.lit("x").alias("id"), F.lit(2).alias("above"))
    want = {}
    key = lambda r: (-1 if r[1] is None else r[1], r[2] or "", r[3] or "")
    for c in {r[0] for r in rows}:
        want[c] = digest([(r[2] or "", r[3] or "") for r in sorted((r for r in rows if r[0] == c), key=key)])
    want[-1] = digest([("user", chat_format.TRAP_TEXT), ("assistant", chat_format.TRAP_TEXT)])
    got = {r["conv_id"]: tuple(r)[1:] for r in chat_format.digests(spark, turns).collect()}
    assert got == want
    assert [r["conv_id"] for r in chat_format.digests(spark, turns.where("false")).collect()] == [-1]
    cut = chat_format.format_branches(chat_format.turn_branches(spark, turns), part_chars=50)
    assert cut.where("part > 5").count() > 0 and cut.agg(F.max(F.size("loss_spans"))).first()[0] >= 1
    assert {r["conv_id"]: tuple(r)[2:] for r in chat_format.read_back(cut).collect()} == {c: w for c, w in want.items() if c != -1}


def best_paths(rows, best):
    """All root-to-leaf paths by walking, the best of each conversation first."""
    out = {}
    for conv in {r[0] for r in rows}:
        known = {}
        for _, i, parent, role, text, score in sorted((r for r in rows if r[0] == conv and r[1] is not None), key=lambda r: (r[1], r[2] is not None, r[2] or 0, r[3], r[4]), reverse=True):
            known[i] = (parent, role, text, score or 0.0)
        parents = {p for p, *_ in known.values() if p in known}
        paths = []
        for leaf in known.keys() - parents:
            walk, at = [], leaf
            while at in known and at not in walk:
                walk.append(at)
                at = known[at][0]
            if at not in walk:
                paths.append((-sum(known[x][3] for x in walk), -len(walk), leaf, walk[::-1]))
        for rank, (*_, walk) in enumerate(sorted(paths)[:best], 1):
            out[conv, rank] = [known[x][1:3] for x in walk]
    return out


def test_best_branches_of_trees(spark):
    rng = random.Random(8)
    rows = []
    for c in range(25):
        for i in range(rng.randrange(1, 40)):
            parent = rng.choice([None, 999, i - 1, i - 1, i - 1, rng.randrange(i + 1)]) if i else None
            rows.append((c, i, None if parent is not None and parent < 0 else parent, rng.choice(["user", "assistant"]), f"m{i}", rng.choice([None, 0.25, 0.5, 1.0, -1.0])))
    rows += [(30, 1, 2, "user", "a", 9.0), (30, 2, 1, "user", "b", 9.0), (30, 3, 2, "user", "below a circle", 9.0), (30, 4, None, "user", "free", 0.0), (30, 5, 5, "user", "self", 3.0)]
    rows += [(31, 1, None, "user", "twice", 1.0), (31, 1, None, "user", "twice", 1.0), (31, 2, 1, "assistant", "x", 1.0), (31, None, 1, "assistant", "no id", 5.0)]
    rows += [(None, i, i - 1 if i else None, "user", f"n{i}", 0.0) for i in range(70)]
    frame = spark.createDataFrame(rows, "conv_id long, id long, parent long, role string, text string, score double").withColumn("branch", F.lit(7))
    for best in (1, 3):
        got = {}
        for r in chat_format.best_branches(spark, frame, best).orderBy(F.desc("above")).collect():
            got.setdefault((r["conv_id"], r["branch"]), []).append((r["role"], r["text"]))
        assert got == best_paths(rows, best)
    assert chat_format.best_branches(spark, frame.where("false")).count() == 0


def test_rounds_grow_with_the_logarithm_of_depth(spark):
    links = spark.range(1000).selectExpr("1L as conv_id", "id", "if(id > 0, id - 1, null) as parent", "0.0D as score")
    scratch = Scratch(spark, "chat-test")
    assert chat_format.chosen_paths(scratch, links).agg(F.count("*"), F.max("above")).first()[:] == (1000, 999)
    path = spark._jvm.org.apache.hadoop.fs.Path(scratch.root)
    assert len(path.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(path)) == 10
