"""Quality classifier: a generalised additive model with pairwise interactions.

Each feature of a document is cut into bins. Cyclic boosting visits the features in turn and adds, for each, a shallow
tree on that feature's bins alone (two levels, shrunk), so the sum of its trees is a lookup table; afterwards the pairs
of features that explain most of what is left get tables of their own the same way. Scoring adds one table cell per
feature and per pair.

Fitting uses at most `max_rows` labelled rows (a bound on the sample, default 20,000, taken by hash of doc_id); only
their features go to the driver. Features come from the whole text and nothing else.

Defined cases: null and empty text have all-zero features and get a score like any other; labels without a document or
with a null label are not used; if the labels have one class or none, the score is that share everywhere (0.5 without
labels); repeated rows get equal scores, and scores that tie stay tied, as no order of rows is used; a very long text is
one row's work; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import combinations
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import free_name, in_slices, serve, text_bytes

FEATURES = (
    "log_words", "word_length", "distinct_share", "repeat_share", "symbol_share", "upper_share", "bang_share", "bar_share",
    "digit_share", "stop_share", "dup_line_share", "words_per_line", "worst_symbols", "worst_upper", "worst_repeats",
)
SEGMENT = 512  # bytes
SEGMENT_WORDS = 64

_CLASS = np.zeros((6, 256), np.float32)  # symbols, upper case, bangs, bars, digits, stops
for _row, _chars in enumerate((b"#*$%&|<>{}[]\\^~_=+@", bytes(range(65, 91)), b"!?", b"|", b"0123456789", b".,;:")):
    _CLASS[_row, list(_chars)] = 1


def features(text: bytes) -> list[float]:
    """FEATURES of one text."""
    words = text.split()
    n, size = len(words), len(text)
    if not n:
        return [0.0] * len(FEATURES)
    raw = np.frombuffer(text, np.uint8)
    share = [float(_CLASS[k][raw].sum()) / size for k in range(6)]
    starts = np.arange(0, max(1, size - SEGMENT // 2), SEGMENT)
    span = np.diff(np.append(starts, size))
    worst = [float((np.add.reduceat(_CLASS[k][raw], starts) / span).max()) for k in (0, 1)]
    same = np.fromiter(map(eq, words[1:], words), np.float32, n - 1)
    at = np.arange(0, max(1, n - 1 - SEGMENT_WORDS // 2), SEGMENT_WORDS)
    worst_same = float((np.add.reduceat(same, at) / np.diff(np.append(at, n - 1))).max()) if n > 1 else 0.0
    lines = [x for x in text.split(b"\n") if x.strip()]
    return [
        float(np.log1p(n)), sum(map(len, words)) / n, len(set(words)) / n, float(same.mean()) if n > 1 else 0.0, *share,
        1 - len(set(lines)) / len(lines), n / len(lines), *worst, worst_same,
    ]


@dataclass
class Gam:
    """Edges of bins per feature, a table per feature, tables per pair on coarser bins, and the base log-odds."""

    edges: list[np.ndarray]
    coarse: list[np.ndarray]
    base: float
    tables: list[np.ndarray] = field(default_factory=list)
    pairs: list[tuple[int, int, np.ndarray]] = field(default_factory=list)

    def score(self, x: np.ndarray) -> np.ndarray:
        z = np.full(len(x), self.base)
        for j, table in enumerate(self.tables):
            z += table[np.searchsorted(self.edges[j], x[:, j], side="right")]
        for a, b, table in self.pairs:
            z += table[np.searchsorted(self.coarse[a], x[:, a], side="right"), np.searchsorted(self.coarse[b], x[:, b], side="right")]
        return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def _split(g: np.ndarray, h: np.ndarray, ridge: float, least: float) -> int:
    """Bins below the returned index go left; 0 if no split helps."""
    gl, hl = np.cumsum(g)[:-1], np.cumsum(h)[:-1]
    gr, hr = g.sum() - gl, h.sum() - hl
    gain = gl**2 / (hl + ridge) + gr**2 / (hr + ridge)
    gain[(hl < least) | (hr < least)] = -1
    if not len(gain) or gain.max() <= g.sum() ** 2 / (h.sum() + ridge) + 1e-9:
        return 0
    return int(gain.argmax()) + 1


def _tree(g: np.ndarray, h: np.ndarray, ridge: float, least: float, levels: int = 2) -> np.ndarray:
    """Leaf values by bin of a tree on one feature."""
    k = _split(g, h, ridge, least) if levels and len(g) > 1 else 0
    if not k:
        return np.full(len(g), g.sum() / (h.sum() + ridge))
    return np.concatenate([_tree(g[:k], h[:k], ridge, least, levels - 1), _tree(g[k:], h[k:], ridge, least, levels - 1)])


def _tree2(g: np.ndarray, h: np.ndarray, ridge: float, least: float) -> np.ndarray:
    """Leaf values of a tree that splits a grid on the one axis, then each side on the other."""
    best, out = -np.inf, np.full(g.shape, g.sum() / (h.sum() + ridge))
    for axis in (0, 1):
        ga, ha = (g, h) if axis == 0 else (g.T, h.T)
        k = _split(ga.sum(1), ha.sum(1), ridge, least)
        if not k:
            continue
        values, gain = np.empty(ga.shape), 0.0
        for part in (slice(0, k), slice(k, None)):
            gs, hs = ga[part].sum(0), ha[part].sum(0)
            leaf = _tree(gs, hs, ridge, least, 1)
            values[part] = leaf
            gain += float((leaf * gs).sum())
        if gain > best:
            best, out = gain, values if axis == 0 else values.T
    return out


def fit(x: np.ndarray, y: np.ndarray, *, bins: int = 48, coarse: int = 10, rounds: int = 150, pair_rounds: int = 60, n_pairs: int = 6, rate: float = 0.1, ridge: float = 2.0, least: float = 3.0) -> Gam:
    """Cyclic boosting of shallow trees, features first, then the strongest pairs."""
    if not len(y) or y.min() == y.max():
        mean = float(y.mean()) if len(y) else 0.5
        return Gam([], [], float(np.log(max(mean, 1e-6) / max(1 - mean, 1e-6))))
    cut = lambda j, n: np.unique(np.quantile(x[:, j], np.linspace(0, 1, n + 1)[1:-1]))
    d = x.shape[1]
    model = Gam([cut(j, bins) for j in range(d)], [cut(j, coarse) for j in range(d)], float(np.log(y.mean() / (1 - y.mean()))))
    at = [np.searchsorted(model.edges[j], x[:, j], side="right") for j in range(d)]
    model.tables = [np.zeros(len(model.edges[j]) + 1) for j in range(d)]
    z = np.full(len(y), model.base)

    def slopes() -> tuple[np.ndarray, np.ndarray]:
        p = 1 / (1 + np.exp(-z))
        return y - p, p * (1 - p)

    for _ in range(rounds):
        for j in range(d):
            g, h = slopes()
            k = len(model.tables[j])
            step = rate * _tree(np.bincount(at[j], g, k), np.bincount(at[j], h, k), ridge, least)
            model.tables[j] += step
            z += step[at[j]]
    low = [np.searchsorted(model.coarse[j], x[:, j], side="right") for j in range(d)]
    wide = [len(model.coarse[j]) + 1 for j in range(d)]
    grid = lambda a, b, v: np.bincount(low[a] * wide[b] + low[b], v, wide[a] * wide[b]).reshape(wide[a], wide[b])
    g, h = slopes()
    gains = []
    for a, b in combinations(range(d), 2):
        ga, ha = grid(a, b, g), grid(a, b, h)
        gains.append((float((_tree2(ga, ha, ridge, least) * ga).sum()), a, b))
    for _, a, b in sorted(gains, key=lambda t: (-t[0], t[1], t[2]))[:n_pairs]:
        model.pairs.append((a, b, np.zeros((wide[a], wide[b]))))
    for _ in range(pair_rounds):
        for a, b, table in model.pairs:
            g, h = slopes()
            step = rate * _tree2(grid(a, b, g), grid(a, b, h), ridge, least)
            table += step
            z += step[low[a], low[b]]
    return model


def with_features(docs: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, the kept columns and an array of FEATURES."""
    kinds = dict(docs.dtypes)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        serve("quality")
        for batch in in_slices(batches):
            found = [features(t) for t in batch.column(batch.num_columns - 1).to_pylist()]
            kept = [batch.column(i) for i in range(batch.num_columns - 1)]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(found, pa.list_(pa.float64()))], ["doc_id", *keep, "features"])

    schema = ", ".join(["doc_id long", *(f"`{c}` {kinds[c]}" for c in keep), "features array<double>"])
    text = free_name("_text", docs.columns)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), *keep, text_bytes().alias(text)).mapInArrow(rows, schema)


def train(docs: DataFrame, labels: DataFrame, *, label: str = "quality", use: Column, max_rows: int = 20_000, **options) -> Gam:
    """Fits on at most max_rows of the labelled rows that `use` (a condition on doc_id) admits."""
    chosen = (
        labels.where(use & F.col("doc_id").isNotNull() & F.col(label).isNotNull())
        .select("doc_id", F.col(label).cast("int").alias("label"))
        .orderBy(F.xxhash64("doc_id"), "doc_id", "label")
        .limit(max_rows)
    )
    chosen = chosen.select(F.col("doc_id").cast("long").alias("doc_id"), "label")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(chosen), "doc_id")  # of max_rows rows at most
    table = with_features(rows, ("label",)).toPandas()
    table = table.sort_values(["doc_id", "label"], kind="stable")
    x = np.array(table["features"].tolist(), float).reshape(-1, len(FEATURES))
    return fit(x, table["label"].to_numpy(float), **options)


def score(docs: DataFrame, model: Gam, keep: tuple[str, ...] = (), into: str = "score") -> DataFrame:
    """The kept columns (doc_id first) and the score of every row of docs, in the column `into`."""
    kinds = dict(docs.dtypes)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        serve("quality")
        for batch in in_slices(batches):
            if batch.num_rows:
                x = np.array([features(t or b"") for t in batch.column(batch.num_columns - 1).to_pylist()], float)
                kept = [batch.column(i) for i in range(batch.num_columns - 1)]
                yield pa.RecordBatch.from_arrays([*kept, pa.array(model.score(x))], ["doc_id", *keep, into])

    schema = ", ".join([f"doc_id {kinds['doc_id']}", *(f"`{c}` {kinds[c]}" for c in keep), f"`{into}` double"])
    return docs.select("doc_id", *keep, text_bytes().alias(free_name("_text", docs.columns))).mapInArrow(rows, schema)
