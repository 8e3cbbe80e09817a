"""Fill-in-middle transformation: a text is cut into prefix, middle and suffix, which are put in another order between
sentinels, so that a left-to-right model learns to fill gaps.

One Aho-Corasick automaton finds, in a single scan, the ASCII characters that change the class of a text (white space;
line feeds where lines are the units) and the sentinels. Between two such events nothing changes, so the units of a gap
follow from its length alone: as many as it has code points (`chars`), one (`words`, a word with the white space after
it), none (`lines`, a unit ends behind each line feed). The sorted events so are an index from the number of a unit to
its place, and tell whether a cut falls inside a word; texts are never cut into lists of units.

The two cuts and the form come from the sha256 of seed and doc_id, so reruns agree and no row depends on another.

Defined cases: null or empty text is plain, with n = 0; a text that holds a sentinel is plain, as it could not be read
back; a null doc_id is hashed as an empty string; rows that repeat give the same output each; there are no ties; very
long texts are one row's work, as events they take 8 bytes each; an empty table gives no rows; extra columns are
ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import in_slices

SPACES = " \t\n\v\f\r"
CLASS_CHANGES = {"chars": SPACES, "words": SPACES, "lines": "\n"}
SCHEMA = "doc_id long, n long, form string, prefix_chars long, middle_chars long, cuts_in_words int, output string"
PLAIN, PSM, SPM = "plain", "psm", "spm"


@dataclass(frozen=True)
class FillInMiddle:
    """What is cut and how: units, share of texts (of 100) that are cut, share of those in suffix-prefix-middle order."""

    units: str = "chars"
    rate: int = 90
    spm: int = 20
    seed: str = "1"
    prefix: str = "<P>"
    suffix: str = "<S>"
    middle: str = "<M>"

    def __post_init__(self):
        if self.units not in CLASS_CHANGES:
            raise ValueError(f"units are one of {', '.join(CLASS_CHANGES)}")
        marks = self.sentinels
        if len(set(marks)) < 3 or not all(marks) or any(_meet(a, b) for a, b in product(marks, marks)):
            raise ValueError("sentinels must be three strings of which none holds another or begins with another's end")

    @property
    def sentinels(self) -> tuple[str, str, str]:
        return self.prefix, self.suffix, self.middle

    @cached_property
    def events(self):
        """The automaton: class changes have value 0, sentinels their length."""
        import ahocorasick

        found = ahocorasick.Automaton()
        for c in CLASS_CHANGES[self.units]:
            found.add_word(c, 0)
        for mark in self.sentinels:
            found.add_word(mark, len(mark))
        found.make_automaton()
        return found

    def scan(self, text: str) -> UnitIndex | None:
        """The index of a text, or None if it holds a sentinel."""
        at = []
        for end, length in self.events.iter(text):
            if length:
                return None
            at.append(end)
        return UnitIndex(self.units, len(text), np.array(at, np.int64))

    def join(self, form: str, prefix: str, middle: str, suffix: str) -> str:
        p, s, m = self.sentinels
        return f"{p}{prefix}{s}{suffix}{m}{middle}" if form == PSM else f"{s}{suffix}{p}{prefix}{m}{middle}"

    def rebuild(self, output: str, form: str) -> str:
        """The text that an output was made from."""
        if form == PLAIN:
            return output
        first, second = (self.prefix, self.suffix) if form == PSM else (self.suffix, self.prefix)
        found = [(end + 1 - length, end + 1) for end, length in self.events.iter(output) if length]
        if [output[a:b] for a, b in found] != [first, second, self.middle] or found[0][0]:
            raise ValueError("this is no output of the form that it names")
        (_, a), (b, c), (d, e) = found
        one, two, middle = output[a:b], output[c:d], output[e:]
        return one + middle + two if form == PSM else two + middle + one


def _meet(a: str, b: str) -> bool:
    """Whether b is inside a (another string), or an end of a, short of all of it, begins b."""
    return a != b and b in a or any(a[-k:] == b[:k] for k in range(1, min(len(a), len(b))))


class UnitIndex:
    """From units to code points, by the events of a text."""

    def __init__(self, units: str, length: int, events: np.ndarray):
        self.units, self.length, self.events = units, length, events
        if units == "chars":
            self.n = length
        else:
            gaps = np.diff(np.append(events, length)) - 1  # code points between an event and the next, or the end
            starts = events[gaps > 0] + 1 if units == "words" else events[events < length - 1] + 1
            self.starts = np.concatenate([np.zeros(min(length, 1), np.int64), starts])
            self.n = len(self.starts)

    def place(self, unit: int) -> int:
        """Code points before a unit; the whole length for the number behind the last one."""
        return unit if self.units == "chars" else int(self.starts[unit]) if unit < self.n else self.length

    def in_word(self, place: int) -> bool:
        """Whether a cut there has a word's characters on both sides."""
        if not 0 < place < self.length:
            return False
        k = int(np.searchsorted(self.events, place - 1))
        return not (k < len(self.events) and self.events[k] <= place)


def draws(config: FillInMiddle, doc_id: Column) -> list[Column]:
    """The first four groups of 8 hexadecimal digits of the sha256 of seed, colon and id."""
    digest = F.sha2(F.concat(F.lit(f"{config.seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))).cast("binary"), 256)
    return [F.conv(F.substring(digest, 1 + 8 * i, 8), 16, 10).cast("long") for i in range(4)]


def transform(docs: DataFrame, config: FillInMiddle = FillInMiddle()) -> DataFrame:
    """Rows of SCHEMA. n: units; prefix_chars and middle_chars: code points, null if plain; cuts_in_words: how many of
    the two cuts split a word."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [x.split()[0] for x in SCHEMA.split(", ")]
        kinds = {"form": pa.string(), "output": pa.string(), "cuts_in_words": pa.int32()}
        for batch in in_slices(batches):
            out = [_cut(config, *row) for row in zip(*(c.to_pylist() for c in batch.columns))]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, kinds.get(k, pa.int64())) for k, c in zip(names, zip(*out))], names)

    h = draws(config, F.col("doc_id"))
    chosen = docs.select(F.col("doc_id").cast("long").alias("doc_id"), *(x.alias(f"h{i}") for i, x in enumerate(h, 1)), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    return chosen.mapInArrow(rows, SCHEMA)


def _cut(config: FillInMiddle, doc_id: int | None, h1: int, h2: int, h3: int, h4: int, text: str) -> tuple:
    index = config.scan(text)
    if index is None:  # a sentinel: only the units are counted, those of a text without sentinels' meaning
        ends = np.array([end for end, length in config.events.iter(text) if not length], np.int64)
        return doc_id, UnitIndex(config.units, len(text), ends).n, PLAIN, None, None, None, text
    if not text or h3 % 100 >= config.rate:
        return doc_id, index.n, PLAIN, None, None, None, text
    a, b = sorted((index.place(h1 % (index.n + 1)), index.place(h2 % (index.n + 1))))
    form = SPM if h4 % 100 < config.spm else PSM
    return doc_id, index.n, form, a, b - a, index.in_word(a) + index.in_word(b), config.join(form, text[:a], text[a:b], text[b:])


def restore(outputs: DataFrame, config: FillInMiddle = FillInMiddle()) -> DataFrame:
    """Adds `restored`, the text rebuilt from `output` and `form` alone."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in in_slices(batches):
            out, form = batch.column("output").to_pylist(), batch.column("form").to_pylist()
            texts = pa.array(map(config.rebuild, out, form), pa.string())
            yield pa.RecordBatch.from_arrays([*batch.columns, texts], [*batch.schema.names, "restored"])

    return outputs.mapInArrow(rows, f"{SCHEMA}, restored string")


def digests(docs: DataFrame, config: FillInMiddle = FillInMiddle()) -> DataFrame:
    """What the outputs and the texts rebuilt from them are, by hash."""
    sha = lambda c: F.sha2(F.col(c).cast("binary"), 256)
    both = restore(transform(docs, config), config)
    return both.select("doc_id", "n", "form", "prefix_chars", "middle_chars", "cuts_in_words", sha("output").alias("output_sha256"), sha("restored").alias("restored_sha256"))


#: cuts_in_words by the characters on both sides of each cut, as the first 13 ASCII control characters and the space do.
SQL = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, sha256('1:' || coalesce(doc_id::VARCHAR, '')) AS h FROM documents),
n AS (SELECT doc_id, t, length(t) AS n, [('0x' || h[8 * i + 1:8 * i + 8])::BIGINT FOR i IN range(4)] AS h FROM d),
c AS (
  SELECT doc_id, t, n, CASE WHEN n = 0 OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h[3] % 100 >= 90 THEN 'plain'
    WHEN h[4] % 100 < 20 THEN 'spm' ELSE 'psm' END AS form, least(h[1] % (n + 1), h[2] % (n + 1)) AS a, greatest(h[1] % (n + 1), h[2] % (n + 1)) AS b FROM n
), p AS (
  SELECT *, substr(t, 1, a) AS pre, substr(t, a + 1, b - a) AS mid, substr(t, b + 1) AS suf,
    list_sum([(x > 0 AND x < n AND regexp_full_match(substr(t, x, 2), '[^\x20\x09-\x0D]{2}'))::INT FOR x IN [a, b]])::INT AS cuts FROM c
)
SELECT doc_id, n::BIGINT AS n, form, CASE WHEN form <> 'plain' THEN a END AS prefix_chars, CASE WHEN form <> 'plain' THEN b - a END AS middle_chars,
  CASE WHEN form <> 'plain' THEN cuts END AS cuts_in_words,
  sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || pre || '<S>' || suf || '<M>' || mid ELSE '<S>' || suf || '<P>' || pre || '<M>' || mid END) AS output_sha256,
  sha256(t) AS restored_sha256
FROM p
"""
