"""Benchmark decontamination by pigeonhole edit matching.

Documents and test items are normalised (lower case, runs of anything but letters and digits as one space) and get a
space at either end, so that an item is looked for as whole words: its ends must meet ends of words, or that costs an
error. A document leaks an item if some part of it is within the item's error budget in edit distance: `error_rate` of
the item's length, none for short items.
Budget e cuts an item into e + 1 pieces; e errors spoil at most e of them, so every leak holds one piece unchanged at
about its place. One automaton finds all pieces of all items in one pass over a whole text; around each hit, Myers'
bit-parallel algorithm gives the least distance of the item to any part of the text there.

Items are taken in shards of at most `shard_bytes` of text, so what is sent to the executors is bounded; documents pass
through the shards one after another. Nothing else is limited: every hit is followed up.

Defined cases: null or empty text leaks nothing; items without a letter or digit, or null, match nothing; equal items
are all reported; repeated rows get equal results; there are no ties, as every match counts; a very long text is one
row's work; an empty table on either side gives no leaks; extra columns are
ignored by `find_leaks` and kept by `drop_leaks`.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import free_name, in_slices, serve

ERROR_RATE = 0.08
GRAM = 5
_GAPS = re.compile(r"[\W_]+")
#: What normalise() does to each Latin-1 character; such texts take one pass.
_LATIN = bytes(ord(c) if (c := chr(i).lower()).isalnum() else 32 for i in range(256))


def normalise(text: str) -> str:
    """Words in lower case between single spaces, one before the first and one behind the last; empty without a word."""
    words = _words(text)
    return f" {words} " if words else ""


def _words(text: str) -> str:
    try:
        return b" ".join(text.encode("latin-1").translate(_LATIN).split()).decode("latin-1")
    except UnicodeEncodeError:
        return _GAPS.sub(" ", text.lower()).strip()


def pieces(item: str, budget: int) -> list[tuple[int, str]]:
    """budget + 1 pieces of nearly equal length, with their places."""
    n, k = len(item), budget + 1
    cuts = [i * n // k for i in range(k + 1)]
    return [(a, item[a:b]) for a, b in zip(cuts, cuts[1:]) if b > a]


class Item:
    """One test item, ready to be searched for."""

    def __init__(self, item_id: int, text: str, error_rate: float):
        self.item_id, self.text, self.size = item_id, text, len(text)
        self.budget = int((len(text) - 2) * error_rate)
        self.masks: dict[str, int] = defaultdict(int)
        for i, c in enumerate(text):
            self.masks[c] |= 1 << i
        self.masks = dict(self.masks)
        grams = [text[i : i + GRAM] for i in range(self.size - GRAM + 1)]
        self.grams = frozenset(grams)
        #: An error changes GRAM grams at most; what is left of the item's distinct grams must occur in the text.
        self.least = len(self.grams) - GRAM * self.budget

    def plausible(self, window: str) -> bool:
        if self.least <= 0:
            return True
        return len(self.grams.intersection([window[i : i + GRAM] for i in range(len(window) - GRAM + 1)])) >= self.least

    def distance(self, window: str) -> int:
        """Least edit distance of the item to a part of the window (Myers 1999, one big word)."""
        if self.text in window:
            return 0
        full, top = (1 << self.size) - 1, 1 << (self.size - 1)
        plus, minus, score, best = full, 0, self.size, self.size
        for c in window:
            same = self.masks.get(c, 0)
            across = same | minus
            down = (((same & plus) + plus) ^ plus) | same
            up = minus | (full & ~(down | plus))
            low = plus & down
            if up & top:
                score += 1
            elif low & top:
                score -= 1
                if score < best:
                    best = score
            up, low = (up << 1) & full, (low << 1) & full
            plus, minus = low | (full & ~(across | up)), up & across
        return best


def build(items: list[tuple[int, str]], error_rate: float):
    """The automaton over the pieces of all items, and the items."""
    import ahocorasick

    found, places = [Item(i, t, error_rate) for i, t in items], defaultdict(list)
    for k, item in enumerate(found):
        for at, piece in pieces(item.text, item.budget):
            places[piece].append((k, at))
    automaton = ahocorasick.Automaton()
    for piece, where in places.items():
        automaton.add_word(piece, (len(piece), where))
    automaton.make_automaton()
    return automaton, found


def leaks(text: str, automaton, items: list[Item]) -> list[tuple[int, int]]:
    """(item_id, distance) of each item that the normalised text leaks."""
    starts: dict[int, set[int]] = defaultdict(set)
    for end, (size, where) in automaton.iter(text):
        for k, at in where:
            starts[k].add(end + 1 - size - at)
    out = []
    for k, at in starts.items():
        item = items[k]
        best, spans = None, []
        for s in sorted(at):  # hits on nearby diagonals share a window
            a, b = max(0, s - item.budget), min(len(text), s + item.size + item.budget)
            if spans and s - spans[-1][2] <= item.budget:
                spans[-1][1], spans[-1][2] = b, s
            else:
                spans.append([a, b, s])
        for a, b, _ in spans:
            window = text[a:b]
            if item.plausible(window):
                d = item.distance(window)
                if d <= item.budget and (best is None or d < best):
                    best = d
                    if not d:
                        break
        if best is not None:
            out.append((item.item_id, best))
    return out


def shards(items: DataFrame, shard_bytes: int) -> Iterator[list[tuple[int, str]]]:
    """Normalised items in lists of bounded size."""
    part, size = [], 0
    for row in items.select(F.col("item_id").cast("long"), "text").where("text is not null").toLocalIterator():
        text = normalise(row[1])
        if text:
            if part and size + len(text) > shard_bytes:
                yield part
                part, size = [], 0
            part.append((row[0], text))
            size += len(text)
    if part:
        yield part


def find_leaks(docs: DataFrame, items: DataFrame, *, error_rate: float = ERROR_RATE, shard_bytes: int = 4 << 20, keep: tuple[str, ...] = (), into: str = "leaks") -> DataFrame:
    """doc_id, the kept columns, and `into`, an array of (item_id, distance): a row per row of docs."""
    kinds, text = dict(docs.dtypes), free_name("_text", [*docs.columns, into])
    leak = pa.list_(pa.struct([("item_id", pa.int64()), ("distance", pa.int32())]))
    schema = ", ".join(
        [f"doc_id {kinds['doc_id']}", *(f"`{c}` {kinds[c]}" for c in keep), f"`{text}` string", f"`{into}` array<struct<item_id: long, distance: int>>"]
    )
    names = ["doc_id", *keep, text, into]

    def searched(part: list[tuple[int, str]]):
        def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            serve("leaks")
            automaton, ready = build(part, error_rate)
            for batch in in_slices(batches):
                n = batch.num_columns
                found = []
                for whole, before in zip(batch.column(n - 2).to_pylist(), batch.column(n - 1).to_pylist()):
                    now = leaks(normalise(whole), automaton, ready) if whole else []
                    found.append(sorted([*((x["item_id"], x["distance"]) for x in before), *now]))
                found = [[{"item_id": i, "distance": d} for i, d in x] for x in found]
                yield pa.RecordBatch.from_arrays([*batch.columns[: n - 1], pa.array(found, leak)], names)

        return rows

    none = F.expr("cast(array() as array<struct<item_id: bigint, distance: int>>)").alias(into)
    out = docs.select("doc_id", *keep, F.col("text").cast("string").alias(text), none)
    for part in shards(items, shard_bytes):
        out = out.mapInArrow(searched(part), schema)
    return out.drop(text)


def leak_report(docs: DataFrame, items: DataFrame, **options) -> DataFrame:
    """doc_id, contaminated, n_items, item_ids and the least distance (null if clean) of every document."""
    found = find_leaks(docs, items, **options)
    return found.select(
        "doc_id",
        (F.size("leaks") > 0).alias("contaminated"),
        F.size("leaks").cast("long").alias("n_items"),
        F.col("leaks.item_id").alias("item_ids"),
        F.array_min("leaks.distance").alias("least_distance"),
    )


def drop_leaks(docs: DataFrame, items: DataFrame, **options) -> DataFrame:
    """The documents that leak nothing, with their columns."""
    rest, found = tuple(c for c in docs.columns if c != "doc_id"), free_name("_leaks", docs.columns)
    return find_leaks(docs, items, keep=rest, into=found, **options).where(F.size(found) == 0).select(*docs.columns)
