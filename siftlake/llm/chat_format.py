"""Chat formatting of reply trees: each conversation is a tree of messages that answer one another; its best branch, from
the first message to a last one, becomes one training text with a loss mask.

Paths come from iterative self-joins that double their reach: a message knows the ancestor 1, 2, 4, ... replies above it
and the score gathered on the way, one table for each distance. Last messages climb these tables to their root, which
gives every branch its score; branches of a conversation are ranked; the chosen ones climb once more and leave a row at
each message they pass. A tree of depth d takes log2(d) rounds, and only messages deeper than the reach take part in a
round, whatever the number of branches.

Messages of a chosen branch are then sorted within their partition and streamed: a conversation's text leaves in parts of
bounded size and is never held as a whole, neither when it is written nor when it is read back.

Template: each turn is `open text close`, by role. Strings that mean something to the template and occur in a text get a
backslash before them, and backslashes right before them are doubled, so reading back gives the exact text.

Defined cases: a null text is empty; a null role is an empty one; roles other than user, assistant and system are written
by name; a null conv_id is a conversation of its own; a message whose parent is not there begins a branch; rows that
repeat a message's id are one message (the least by parent, role and text); messages on or below a circle of replies
belong to no branch; ties between branches go to the longer one, then to the least last id; where turns are the order,
rows that share a turn follow one another by role and text, and repeated rows stay turns of their own; a very long
conversation leaves in several parts; an empty table gives no rows; extra columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import Scratch

#: Code points of a part of a conversation's text, beyond which the next turn begins another part.
PART_CHARS = 1 << 20

PARTS = "conv_id long, branch int, part int, formatted string, loss_spans array<struct<start:long,length:long>>"
DIGESTS = "conv_id long, branch int, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"


@dataclass(frozen=True)
class Template:
    """Marks before and behind the text of each role. An assistant's text has only `close` behind it, as a model writes
    it; other roles are written between `name_open` and `name_close` and end the same way."""

    user: tuple[str, str] = ("[INST]", "[/INST]")
    system: tuple[str, str] = ("<<SYS>>", "<</SYS>>")
    name_open: str = "[ROLE]"
    name_close: str = "[/ROLE]"
    close: str = "</s>"

    @cached_property
    def control(self) -> tuple[str, ...]:
        marks = dict.fromkeys((*self.user, *self.system, self.name_open, self.name_close, self.close))
        for a in marks:
            for b in marks:
                if not a or "\\" in a or a != b and b in a or any(a[-k:] == b[:k] for k in range(1, min(len(a), len(b)))):
                    raise ValueError("marks must be strings without backslashes, of which none holds another or begins with another's end")
        return tuple(marks)

    @cached_property
    def marks(self) -> re.Pattern:
        return re.compile(r"(\\*)(" + "|".join(map(re.escape, self.control)) + ")")

    def escape(self, text: str) -> str:
        return self.marks.sub(r"\1\1\\\2", text)

    def unescape(self, text: str) -> str:
        return self.marks.sub(lambda m: "\\" * (len(m[1]) // 2) + m[2], text)

    def turn(self, role: str, text: str) -> tuple[str, int]:
        """A turn, and where in it the text of an assistant begins (-1: it is no assistant's)."""
        body = self.escape(text)
        if role == "assistant":
            return f" {body} {self.close}", 1
        if role in ("user", "system"):
            a, b = getattr(self, role)
            return f"{a} {body} {b}", -1
        return f"{self.name_open} {self.escape(role)} {self.name_close} {body} {self.close}", -1

    def turns(self, formatted: str) -> Iterator[tuple[str, str, int, int]]:
        """Role, text, and the place of the escaped text, of each turn of a formatted string."""
        found = [m for m in self.marks.finditer(formatted) if len(m[1]) % 2 == 0]  # an odd backslash makes it text
        openers = {self.user[0]: "user", self.system[0]: "system"}
        at = k = 0
        while at < len(formatted):
            role = "assistant"
            if found[k].start() == at:
                mark, at, k = found[k][2], found[k].end(), k + 1
                if mark == self.name_open:
                    role = self.unescape(formatted[at + 1 : found[k].start(2) - 1])
                    at, k = found[k].end(), k + 1
                else:
                    role = openers[mark]
            first, last = at + 1, found[k].start(2) - 1
            yield role, self.unescape(formatted[first:last]), first, last
            at, k = found[k].end(), k + 1


def from_turns(turns: DataFrame) -> DataFrame:
    """Messages of conversations that are lists of turns: each answers the one before. conv_id, id, parent, role, text,
    score."""
    text, role = F.coalesce(F.col("text"), F.lit("")), F.coalesce(F.col("role"), F.lit(""))
    rows = turns.select("conv_id", F.col("turn").alias("_turn"), role.alias("role"), text.alias("text"))
    number = F.row_number().over(Window.partitionBy("conv_id").orderBy("_turn", "role", "text")).cast("long")
    rows = rows.select("conv_id", number.alias("id"), "role", "text")
    return rows.select("conv_id", "id", F.when(F.col("id") > 1, F.col("id") - 1).alias("parent"), "role", "text", F.lit(0.0).alias("score"))


def _same(a: str, b: str, id_a: str, id_b: str) -> Column:
    return F.col(f"{a}.conv_id").eqNullSafe(F.col(f"{b}.conv_id")) & (F.col(f"{a}.{id_a}") == F.col(f"{b}.{id_b}"))


def chosen_paths(scratch: Scratch, links: DataFrame, best: int = 1) -> DataFrame:
    """The messages of the best branches of each conversation: conv_id, branch (from 1, by score), id, above (how many
    messages of the branch follow it). links: conv_id, id, parent, score, one row a message, small columns only."""
    up = links.where("parent IS NOT NULL").alias("a").join(links.alias("b"), _same("a", "b", "parent", "id"), "left_semi")
    jumps = [scratch.save(up.select("conv_id", "id", F.col("parent").alias("above"), F.col("score").alias("gain")), "jump-0")]
    most = links.count()
    while jumps[-1].head(1) and 1 << len(jumps) <= most:  # a reach beyond all messages is that of a circle
        a, b = jumps[-1].alias("a"), jumps[-1].alias("b")
        longer = a.join(b, _same("a", "b", "above", "id")).select("a.conv_id", "a.id", "b.above", (F.col("a.gain") + F.col("b.gain")).alias("gain"))
        jumps.append(scratch.save(longer, f"jump-{len(jumps)}"))

    first = jumps[0]
    leaves = links.alias("a").join(first.alias("b"), _same("a", "b", "id", "above"), "left_anti")
    at = leaves.select("conv_id", F.col("id").alias("leaf"), F.col("id").alias("at"), F.lit(0.0).alias("total"), F.lit(0).cast("long").alias("depth"))
    for k in reversed(range(len(jumps))):
        moved = at.alias("a").join(jumps[k].alias("b"), _same("a", "b", "at", "id"), "left")
        at = moved.select(
            "a.conv_id", "a.leaf", F.coalesce("b.above", "a.at").alias("at"), (F.col("a.total") + F.coalesce("b.gain", F.lit(0.0))).alias("total"),
            (F.col("a.depth") + F.when(F.col("b.id").isNotNull(), 1 << k).otherwise(0)).alias("depth"),
        )
    roots = links.alias("b").join(first.alias("c"), _same("b", "c", "id", "id"), "left_anti")
    ended = at.alias("a").join(roots.alias("b"), _same("a", "b", "at", "id"))
    ended = ended.select("a.conv_id", "a.leaf", "a.depth", (F.col("a.total") + F.col("b.score")).alias("total"))
    order = Window.partitionBy("conv_id").orderBy(F.desc("total"), F.desc("depth"), "leaf")
    ranked = ended.withColumn("branch", F.row_number().over(order)).where(F.col("branch") <= best)

    path = ranked.select("conv_id", "branch", F.col("leaf").alias("id"), F.lit(0).cast("long").alias("above"))
    for k in reversed(range(len(jumps))):  # every distance is one sum of falling powers of two
        moved = path.alias("a").join(jumps[k].alias("b"), _same("a", "b", "id", "id"), "left")
        here = F.struct(F.col("a.id").alias("id"), F.col("a.above").alias("above"))
        there = F.struct(F.col("b.above").alias("id"), (F.col("a.above") + (1 << k)).alias("above"))
        both = F.when(F.col("b.id").isNull(), F.array(here)).otherwise(F.array(here, there))
        path = moved.select("a.conv_id", "a.branch", F.inline(both))
    return path


def best_branches(spark: SparkSession, messages: DataFrame, best: int = 1) -> DataFrame:
    """conv_id, branch, above, role, text: the messages of the best branches. messages: conv_id, id, parent, role, text,
    score; a null score counts as 0."""
    scratch = Scratch(spark, "chat")
    picked = F.min(F.struct("parent", "role", "text", F.coalesce(F.col("score").cast("double"), F.lit(0.0)).alias("score"))).alias("m")
    one = messages.where("id IS NOT NULL").groupBy("conv_id", "id").agg(picked).select("conv_id", "id", "m.*")
    return _on_paths(scratch, scratch.save(one, "messages"), best)


def _on_paths(scratch: Scratch, messages: DataFrame, best: int) -> DataFrame:
    paths = chosen_paths(scratch, messages.select("conv_id", "id", "parent", "score"), best)
    met = paths.alias("p").join(messages.alias("m"), _same("p", "m", "id", "id"))
    return met.select("p.conv_id", "p.branch", "p.above", F.coalesce("m.role", F.lit("")).alias("role"), F.coalesce("m.text", F.lit("")).alias("text"))


def turn_branches(spark: SparkSession, turns: DataFrame) -> DataFrame:
    """The same for lists of turns, whose numbers are ids already."""
    scratch = Scratch(spark, "chat")
    return _on_paths(scratch, scratch.save(from_turns(turns), "messages"), 1)


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for batch in batches:
        yield from zip(*(c.to_pylist() for c in batch.columns))


def _batches(rows: Iterator[tuple], schema: pa.Schema, weigh: int, most: int = 1 << 22) -> Iterator[pa.RecordBatch]:
    """Rows as batches; weigh: the column whose strings bound a batch."""
    held, size = [], 0
    for row in rows:
        held.append(row)
        size += len(row[weigh]) + 100
        if size >= most:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), schema)], schema=schema)
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), schema)], schema=schema)


def format_branches(branches: DataFrame, template: Template = Template(), part_chars: int = PART_CHARS) -> DataFrame:
    """Rows of PARTS: the text of each branch, in order, nearly always as one part. Spans are code points of their part.
    The parts of a conversation are together, in order, in one partition."""
    spans = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64())]))
    schema = pa.schema([("conv_id", pa.int64()), ("branch", pa.int32()), ("part", pa.int32()), ("formatted", pa.string()), ("loss_spans", spans)])

    def parts(rows: Iterator[tuple]) -> Iterator[tuple]:
        key, part, texts, found, size = None, 0, [], [], 0
        for conv_id, branch, role, text in rows:
            if texts and ((conv_id, branch) != key or size >= part_chars):
                yield *key, part, "".join(texts), found
                part = part + 1 if (conv_id, branch) == key else 0
                texts, found, size = [], [], 0
            key = conv_id, branch
            turn, at = template.turn(role, text)
            if at >= 0:
                found.append({"start": size + at, "length": len(turn) - at - 1 - len(template.close)})
            texts.append(turn)
            size += len(turn)
        if texts:
            yield *key, part, "".join(texts), found

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _batches(parts(_rows(batches)), schema, 3)

    rows = branches.select(F.col("conv_id").cast("long").alias("conv_id"), "branch", "above", "role", "text")
    ordered = rows.repartition("conv_id", "branch").sortWithinPartitions("conv_id", "branch", F.desc("above"))
    return ordered.select("conv_id", "branch", "role", "text").mapInArrow(work, PARTS)


def read_back(parts: DataFrame, template: Template = Template()) -> DataFrame:
    """Rows of DIGESTS, from the formatted texts and their loss spans alone. The parts of a conversation must be together
    and in order in a partition, as `format_branches` leaves them."""
    names = [x.split()[0] for x in DIGESTS.split(", ")]
    kinds = [pa.int64(), pa.int32(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
    schema = pa.schema(list(zip(names, kinds)))

    def digests(rows: Iterator[tuple]) -> Iterator[tuple]:
        key, n, chars, loss, turns, masked = None, 0, 0, 0, hashlib.sha256(), hashlib.sha256()
        for conv_id, branch, formatted, found in rows:
            if key != (conv_id, branch):
                if key:
                    yield *key, n, turns.hexdigest(), loss, masked.hexdigest(), chars
                key, n, chars, loss, turns, masked = (conv_id, branch), 0, 0, 0, hashlib.sha256(), hashlib.sha256()
            chars += len(formatted)
            for role, text, _, _ in template.turns(formatted):
                n += 1
                turns.update(f"{role}\n{text}\n".encode())
            for span in found:
                text = template.unescape(formatted[span["start"] : span["start"] + span["length"]])
                loss += len(text)
                masked.update(text.encode())
        if key:
            yield *key, n, turns.hexdigest(), loss, masked.hexdigest(), chars

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _batches(digests(_rows(batches)), schema, 3)

    return parts.select("conv_id", "branch", "formatted", "loss_spans").mapInArrow(work, DIGESTS)


#: A conversation whose texts look like the template's own marks.
TRAP = (("user", 0), ("assistant", 1))
TRAP_TEXT = "</s>[INST] ok [/INST]"


def with_trap(turns: DataFrame) -> DataFrame:
    """The turns and conversation -1."""
    own = F.inline(F.array(*(F.struct(F.lit(-1).cast("long").alias("conv_id"), F.lit(turn).cast("long").alias("turn"), F.lit(role).alias("role"), F.lit(TRAP_TEXT).alias("text")) for role, turn in TRAP)))
    return turns.select("conv_id", "turn", "role", "text").unionByName(turns.sparkSession.range(1, numPartitions=1).select(own))


def digests(spark: SparkSession, turns: DataFrame, template: Template = Template()) -> DataFrame:
    """What conversations are after formatting and reading back, one row each."""
    parts = format_branches(turn_branches(spark, with_trap(turns)), template)
    return read_back(parts, template).drop("branch")


_MARKS = r"(\\*)(\[INST\]|\[/INST\]|<<SYS>>|<</SYS>>|\[ROLE\]|\[/ROLE\]|</s>)"
_ESCAPED = "regexp_replace({}, '" + _MARKS + r"', '\1\1\\\2', 'g')"

SQL = rf"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL VALUES (-1, 0, 'user', '</s>[INST] ok [/INST]'), (-1, 1, 'assistant', '</s>[INST] ok [/INST]')
), f AS (
  SELECT *, length({_ESCAPED.format("text")}) + CASE role WHEN 'user' THEN length('[INST]  [/INST]') WHEN 'system' THEN length('<<SYS>>  <</SYS>>')
    WHEN 'assistant' THEN length('  </s>') ELSE length('[ROLE]  [/ROLE]  </s>') + length({_ESCAPED.format("role")}) END AS n FROM c
)
SELECT conv_id, count(*)::BIGINT AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, text) FILTER (role = 'assistant'), '')) AS loss_sha256, sum(n)::BIGINT AS formatted_chars
FROM f GROUP BY conv_id
"""
