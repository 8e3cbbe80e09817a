"""Substring dedup by repeated-phrase automata.

A passage is a window of `width` words. A word is removed if it lies in a window whose words also start somewhere in a
document with a smaller doc_id. Windows are judged on the input, so the order of work does not matter.

Documents are dealt into blocks of about `block_bytes` by hash of doc_id. Then, each time over all blocks:

1. Anchors. Each window names one of its `gram`-word phrases, the one whose hash is least (the leftmost of equals), so
   equal windows name equal phrases, and neighbouring windows mostly the same one. Each block sends its distinct
   anchors once; an anchor recurs if it comes from two blocks or from two documents of one.
2. Confirmed passages. Each block sends the distinct windows that have a recurring anchor, as 128 bits of their words,
   with their smallest doc_id in the block; joined by window, that gives the smallest doc_id of all, which goes back to
   the blocks where it removes something. Anchors are 64 bits: a false one only sends a window in vain. Windows decide,
   and two different ones among 10^13 have equal 128 bits with a chance of 10^-13.
3. Occurrences. Each block compiles its shard of the phrase automaton (Aho-Corasick over words) from the anchors of its
   confirmed passages and streams its documents through it; the windows around each hit that are confirmed for a
   smaller doc_id are removed.

What a block sends is packed by key into shards, one for each `shard_bytes` of text, each distinct key once, so a phrase
that stands in a third of all documents costs one entry per block, and no task sees more than its share of keys, however
large the input. Nothing is collected, and the blocks' exchange is made once and read three times. Texts too short for
a window are answered at once and go to no block.

Defined cases: null text has no words; a text with fewer than `width` words loses none; a null doc_id counts as the
smallest long; rows with equal doc_id do not remove anything from each other, whatever their texts; blocks are dealt by
doc_id and text, so rows that share a doc_id only do not meet in one task; a text of any length is one block's work as a
whole; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WORD_RE, WordHash, hash_words, mix64, text_bytes, window_hashes, worker_words

WIDTH, GRAM = 13, 5
NULL_ID = -(1 << 63)
_PACKED = "shard int, block int, data binary"
_FLAG = np.uint64(1)
_SECOND = np.uint64(0xD1B54A32D192ED03)


def pack(*columns: np.ndarray) -> bytes:
    """Columns of 8- or 4-byte numbers byte plane by byte plane, which compresses where high bytes repeat."""
    return b"".join(np.ascontiguousarray(np.ascontiguousarray(c).view(np.uint8).reshape(-1, c.dtype.itemsize).T).tobytes() for c in columns)


def unpack(data: bytes, *kinds: type) -> list[np.ndarray]:
    sizes = [np.dtype(k).itemsize for k in kinds]
    n, out, at = len(data) // sum(sizes), [], 0
    raw = np.frombuffer(data, np.uint8)
    for kind, size in zip(kinds, sizes):
        plane = raw[at : at + n * size].reshape(size, n)
        out.append(np.ascontiguousarray(plane.T).reshape(-1).view(kind))
        at += n * size
    return out


class Block:
    """The words of a block's documents in a row, in an order that does not depend on how the rows arrived."""

    def __init__(self, table: pa.Table, width: int, cache: WordHash):
        ids = table.column("doc_id").to_pylist()
        texts = table.column("text").to_pylist()
        order = sorted(range(len(ids)), key=lambda i: (ids[i] is not None, ids[i] or 0, texts[i]))
        self.names = [ids[i] for i in order]
        self.ids = np.array([NULL_ID if i is None else i for i in self.names], np.int64)
        self.words = [texts[i].split() for i in order]
        self.sizes = np.array(list(map(len, self.words)), np.int64)
        self.ends = np.cumsum(self.sizes)
        parts = [hash_words(w, cache) for w in self.words]
        self.hashes = np.concatenate(parts) if parts else np.empty(0, np.uint64)
        self.width = width
        self._phrases: np.ndarray | None = None

    def docs_at(self, positions: np.ndarray) -> np.ndarray:
        """Number of the document that holds each word."""
        return np.searchsorted(self.ends, positions, side="right")

    def starts(self) -> np.ndarray:
        """Where a window lies within one document."""
        n = np.maximum(self.sizes - self.width + 1, 0)
        return np.repeat(self.ends - self.sizes - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))

    def windows(self, starts: np.ndarray, gram: int) -> tuple[np.ndarray, np.ndarray]:
        """128 bits of the window at each start: a hash of its words, and one of phrases that cover it."""
        if not len(starts):
            return np.empty(0, np.uint64), np.empty(0, np.uint64)
        g, rest = self.phrases(gram), np.zeros(len(starts), np.uint64)
        for i in [*range(0, self.width - gram, gram), self.width - gram]:
            rest = rest * _SECOND + g[starts + i]
        return window_hashes(self.hashes, self.width)[starts], mix64(rest)

    def phrases(self, gram: int) -> np.ndarray:
        if self._phrases is None:
            self._phrases = window_hashes(self.hashes, gram)
        return self._phrases

    def anchors(self, starts: np.ndarray, gram: int) -> tuple[np.ndarray, np.ndarray]:
        """Each window's anchor: where it begins, and its hash with the lowest bit cleared."""
        if not len(starts):
            return starts, np.empty(0, np.uint64)
        g = self.phrases(gram)
        low = np.uint64((1 << 24) - 1)
        key = (g & ~low) | (np.arange(len(g), dtype=np.uint64) & low)
        reach = self.width - gram + 1
        least = key[: len(key) - reach + 1].copy()
        for i in range(1, reach):
            np.minimum(least, key[i : len(key) - reach + 1 + i], out=least)
        at = starts + ((least[starts].astype(np.int64) - starts) & int(low))
        return at, g[at] & ~_FLAG


def _by_shard(block: int, shards: int, keys: np.ndarray, *columns: np.ndarray) -> pa.Table:
    """Packed rows of _PACKED; keys are in rising order within each."""
    shard = (keys >> np.uint64(20)) % np.uint64(shards)
    order = np.lexsort((keys, shard))
    named, first = np.unique(shard[order], return_index=True)
    cut = [*first.tolist(), len(order)]
    rows = [(s, [c[order[a:b]] for c in (keys, *columns)]) for s, a, b in zip(named.tolist(), cut, cut[1:])]
    return pa.table({"shard": pa.array([s for s, _ in rows], pa.int32()), "block": pa.array([block] * len(rows), pa.int32()), "data": pa.array([pack(*c) for _, c in rows], pa.binary())})


def _joined(table: pa.Table, *kinds: type) -> list[np.ndarray]:
    """The packed rows of a group as columns, the block of each entry last."""
    parts = [unpack(d, *kinds) for d in table.column("data").to_pylist()]
    blocks = [np.full(len(p[0]), b, np.int32) for b, p in zip(table.column("block").to_pylist(), parts)]
    if not parts:
        return [np.empty(0, k) for k in (*kinds, np.int32)]
    return [np.concatenate(c) for c in (*zip(*parts), blocks)]


def _to_blocks(blocks: np.ndarray, *columns: np.ndarray) -> pa.Table:
    """Packed rows by block."""
    order = np.argsort(blocks, kind="stable")
    names, first = np.unique(blocks[order], return_index=True)
    cut = [*first.tolist(), len(order)]
    data = [pack(*[c[order[a:b]] for c in columns]) for a, b in zip(cut, cut[1:])]
    return pa.table({"block": pa.array(names, pa.int32()), "data": pa.array(data, pa.binary())})


def spelled(hashes: np.ndarray) -> tuple[str, int]:
    """The words as a string, each as the same number of letters. Each place of a word has 64 letters of its own, so a
    phrase is only found where a word begins, and no node of an automaton has more than 64 children."""
    _, number = np.unique(hashes, return_inverse=True)
    digits = max(1, -(-int(number.max(initial=0)).bit_length() // 6))
    place = np.arange(digits)
    codes = 0x100 + 64 * place + (number[:, None] >> (6 * place) & 63)
    return codes.astype("<u4").tobytes().decode("utf-32-le"), digits


def covered(n: int, starts: np.ndarray, width: int) -> np.ndarray:
    """Which of n words lie in a window that begins at one of the starts."""
    edge = np.zeros(n + width + 1, np.int32)
    np.add.at(edge, starts, 1)
    np.add.at(edge, starts + width, -1)
    return np.cumsum(edge)[:n] > 0


def drop_repeats(docs: DataFrame, *, width: int = WIDTH, gram: int = GRAM, block_bytes: int = 8 << 20, shard_bytes: int = 4 << 20) -> DataFrame:
    """doc_id, n_words, n_removed and kept_text, the kept words joined by one space: a row per row of docs."""
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks, shards = max(8, -(-total // block_bytes)), max(16, -(-total // shard_bytes))
    given = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    short = F.coalesce(F.octet_length("text"), F.lit(0)) < 2 * width - 1
    few = F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(f"({WORD_RE})"))
    brief = given.where(short).select("doc_id", F.size(few).cast("long").alias("n_words"), F.lit(0).cast("long").alias("n_removed"), F.array_join(few, " ").alias("kept_text"))
    rows = given.where(~short).select(F.pmod(F.xxhash64("doc_id", "text"), F.lit(blocks)).cast("int").alias("block"), "doc_id", text_bytes().alias("text"))

    def send_anchors(key: tuple, table: pa.Table) -> pa.Table:
        b = Block(table, width, worker_words())
        at, anchor = b.anchors(b.starts(), gram)
        at, first = np.unique(at, return_index=True)
        anchor, doc = anchor[first], b.ids[b.docs_at(at)] if len(at) else np.empty(0, np.int64)
        order = np.lexsort((doc, anchor))
        anchor, doc = anchor[order], doc[order]
        new = _changes(anchor)
        last = np.append(new[1:], len(anchor)) - 1
        several = (doc[new] != doc[last]).astype(np.uint64) if len(new) else np.empty(0, np.uint64)
        return _by_shard(key[0].as_py(), shards, anchor[new] | several)

    def recurring(table: pa.Table) -> pa.Table:
        key, block = _joined(table, np.uint64)
        order = np.argsort(key >> _FLAG, kind="stable")
        key, block = key[order], block[order]
        _, group, count = np.unique(key >> _FLAG, return_inverse=True, return_counts=True)
        several = np.bincount(group, (key & _FLAG).astype(float), len(count)) > 0
        hit = (several | (count > 1))[group]
        return _to_blocks(block[hit], key[hit] & ~_FLAG)

    def send_windows(key: tuple, table: pa.Table, known: pa.Table) -> pa.Table:
        b = Block(table, width, worker_words())
        again = np.sort(np.concatenate([unpack(d, np.uint64)[0] for d in known.column("data").to_pylist()] or [np.empty(0, np.uint64)]))
        starts = b.starts()
        _, anchor = b.anchors(starts, gram)
        starts = starts[_within(anchor, again)]
        window, rest = b.windows(starts, gram)
        doc = b.ids[b.docs_at(starts)] if len(starts) else np.empty(0, np.int64)
        order = _by_window(window, rest)
        window, rest, doc, starts = window[order], rest[order], doc[order], starts[order]
        new = _changes(window, rest)
        least, most = (f.reduceat(doc, new) if len(new) else doc for f in (np.minimum, np.maximum))
        return _by_shard(key[0].as_py(), shards, window[new], rest[new], least, starts[new].astype(np.uint32), (least != most).astype(np.uint8))

    def confirm(table: pa.Table) -> pa.Table:
        window, rest, doc, start, several, block = _joined(table, np.uint64, np.uint64, np.int64, np.uint32, np.uint8)
        order = _by_window(window, rest)
        window, rest, doc, start, several, block = (c[order] for c in (window, rest, doc, start, several, block))
        new = _changes(window, rest)
        least = np.repeat(np.minimum.reduceat(doc, new) if len(new) else doc, np.diff(np.append(new, len(window))))
        hit = (least < doc) | (several == 1)
        return _to_blocks(block[hit], window[hit], rest[hit], least[hit], start[hit])

    def remove(key: tuple, table: pa.Table, known: pa.Table) -> pa.Table:
        import ahocorasick

        b = Block(table, width, worker_words())
        parts = [unpack(d, np.uint64, np.uint64, np.int64, np.uint32) for d in known.column("data").to_pylist()]
        gone = np.zeros(len(b.hashes), bool)
        if parts:
            window, rest, least, start = (np.concatenate(c) for c in zip(*parts))
            order = _by_window(window, rest)
            window, rest, least = window[order], rest[order], least[order]
            at, _ = b.anchors(start.astype(np.int64), gram)
            at = np.unique(at)
            letters, digits = spelled(b.hashes)
            automaton = ahocorasick.Automaton(ahocorasick.STORE_LENGTH)
            for i in (at * digits).tolist():
                automaton.add_word(letters[i : i + gram * digits])
            automaton.make_automaton()
            # A phrase that runs over the end of a document is no window's anchor and falls out below.
            hits = np.fromiter((end for end, _ in automaton.iter(letters)), np.int64)
            hits = (hits + 1) // digits - gram
            around = np.zeros(len(b.hashes), bool)
            reach = width - gram
            for back in range(reach + 1):
                place = hits - back
                around[place[place >= 0]] = True
            starts = b.starts()
            starts = starts[around[starts]]
            found, other = b.windows(starts, gram)
            slot = np.minimum(np.searchsorted(window, found), len(window) - 1)
            while len(next_ := np.flatnonzero((window[slot] == found) & (rest[slot] < other) & (slot + 1 < len(window)))):
                slot[next_] += 1  # two confirmed windows of equal first halves, in the order of the second
            hit = (window[slot] == found) & (rest[slot] == other) & (least[slot] < b.ids[b.docs_at(starts)])
            gone = covered(len(b.hashes), starts[hit], width)
        kept, removed = [], []
        for words, a, z in zip(b.words, (b.ends - b.sizes).tolist(), b.ends.tolist()):
            out = gone[a:z]
            n = int(out.sum())
            removed.append(n)
            kept.append(b" ".join([w for w, o in zip(words, out.tolist()) if not o]) if n else b" ".join(words))
        return pa.table({"doc_id": pa.array(b.names, pa.int64()), "n_words": pa.array(b.sizes), "n_removed": pa.array(removed, pa.int64()), "kept": pa.array(kept, pa.binary())})

    by_block = rows.groupBy("block")
    anchors = by_block.applyInArrow(send_anchors, _PACKED).groupBy("shard").applyInArrow(recurring, "block int, data binary")
    windows = by_block.cogroup(anchors.groupBy("block")).applyInArrow(send_windows, _PACKED)
    passages = windows.groupBy("shard").applyInArrow(confirm, "block int, data binary")
    kept = by_block.cogroup(passages.groupBy("block")).applyInArrow(remove, "doc_id long, n_words long, n_removed long, kept binary")
    return kept.select("doc_id", "n_words", "n_removed", F.col("kept").cast("string").alias("kept_text")).unionByName(brief)


def _changes(*columns: np.ndarray) -> np.ndarray:
    """Where a row of sorted columns differs from the one before; the first row does."""
    if not len(columns[0]):
        return np.empty(0, np.int64)
    other = np.any([np.diff(c) != 0 for c in columns], axis=0)
    return np.flatnonzero(np.concatenate([[True], other]))


def _by_window(window: np.ndarray, rest: np.ndarray) -> np.ndarray:
    """The order by the 128 bits; nearly always that by the first half."""
    order = np.argsort(window, kind="stable")
    w, r = window[order], rest[order]
    return np.lexsort((rest, window)) if np.any((w[1:] == w[:-1]) & (r[1:] != r[:-1])) else order


def _within(keys: np.ndarray, known: np.ndarray) -> np.ndarray:
    """Which keys are among the known, which are sorted."""
    if not len(known):
        return np.zeros(len(keys), bool)
    return known[np.minimum(np.searchsorted(known, keys), len(known) - 1)] == keys


def digest_repeats(docs: DataFrame) -> DataFrame:
    """drop_repeats with the kept text as its sha256."""
    return drop_repeats(docs).select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256"))
