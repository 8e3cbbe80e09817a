"""Toxicity: subword-bag embeddings averaged into a linear softmax, trained jointly in numpy.

A word's vector is the mean of the vectors of its character n-grams and of the whole word, all hashed into one table;
a passage's vector is the mean over its words; a linear softmax on it gives the probability of each class. The table
and the softmax are trained together by Adagrad. Misspellings and unseen endings share most n-grams with known words.

A text is scored passage by passage (every run of `width` words) and takes the highest probability, so that an insult in
a long text is not averaged away. Labels belong to whole texts, so training starts from whole texts, each as the set of
its words, in which a rare word counts as much as a frequent one, and goes on with the worst passage of each toxic text
against passages of harmless ones.

Fitting uses at most `max_rows` labelled texts per class (a bound on the sample, default 2,000, by hash of doc_id), and
of each all its words and passages, whatever its length: texts come to the driver as numbers of words, 4 bytes a word.
Scoring covers every word of every text. A text's score is the maximum over its passages, so it rises with the number of
passages; the threshold holds for the whole text, whatever its length.

Defined cases: null and empty text have one passage without words and get the score of the bias alone; labels without a
document or null labels are not used; without both classes the score is the share of toxic labels (0 without labels);
repeated rows get equal scores; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import in_slices, mix64, remembers, serve, text_bytes

EDGE = b".,;:!?\"'()[]{}<>*#$%&|-_~"
BUCKETS = 1 << 18
GRAMS = (4, 5, 6)
PAD = 8  # empty subwords that every word has besides its own, so that a short word's few n-grams do not weigh more
LIMIT = 500_000
_STEP = np.uint64(0x9E3779B97F4A7C15)


def subwords(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the words one after another, and how many each has: the word itself and its character n-grams of the
    lengths in GRAMS, with marks for its begin and end."""
    if len(words) > 20_000:  # in parts, which bounds the arrays below
        parts = [subwords(words[i : i + 20_000]) for i in range(0, len(words), 20_000)]
        return np.concatenate([f for f, _ in parts]), np.concatenate([n for _, n in parts])
    texts = [(w.strip(EDGE) or w).decode("utf-8", "replace") for w in words]
    sizes = np.array(list(map(len, texts)), np.int64) + 2
    if not len(sizes):
        return np.empty(0, np.int64), sizes
    chars = np.frombuffer(("<" + "><".join(texts) + ">").encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
    owner = np.repeat(np.arange(len(sizes)), sizes)
    first = np.cumsum(sizes) - sizes
    place = (np.arange(len(chars)) - first[owner]).astype(np.uint64)
    found = [mix64(np.add.reduceat(mix64(chars * _STEP + place), first))]
    owners = [np.arange(len(sizes))]
    mixed, rolled = mix64(chars + np.uint64(1)), None
    for n in range(1, max(GRAMS) + 1):
        rolled = mixed.copy() if rolled is None else rolled[:-1] * _STEP + mixed[n - 1 :]
        if n in GRAMS:
            inside = owner[: len(rolled)] == owner[n - 1 :]
            found.append(mix64(rolled[inside] + np.uint64(n)))
            owners.append(owner[: len(rolled)][inside])
        if len(rolled) <= 1:
            break
    owners = np.concatenate(owners)
    order = np.argsort(owners, kind="stable")
    return (np.concatenate(found)[order] % np.uint64(BUCKETS)).astype(np.int64), np.bincount(owners, minlength=len(sizes))


_KNOWN: dict[int, dict[bytes, float]] = {}
remembers("toxicity", _KNOWN.clear)


def known_words(model: int) -> dict[bytes, float]:
    """The words whose value this Python worker remembers from task to task, of the model used last."""
    serve("toxicity")
    if model not in _KNOWN:
        _KNOWN.clear()
        _KNOWN[model] = {}
    return _KNOWN[model]


@dataclass
class SubwordSoftmax:
    """`pull` is each bucket's vector times the difference of the two softmax rows; all that scoring needs."""

    pull: np.ndarray
    bias: float
    width: int

    def name(self) -> int:
        return xxhash.xxh3_64_intdigest(self.pull.tobytes() + np.array([self.bias, self.width]).tobytes())

    def values(self, words: list[bytes], known: dict[bytes, float]) -> np.ndarray:
        """Log-odds that each word adds to its passage; remembers words, and forgets everything when there are too many."""
        if len(known) >= LIMIT:
            known.clear()
        new = list(set(words).difference(known))
        if new:
            flat, n = subwords(new)
            z = np.bincount(np.repeat(np.arange(len(n)), n), self.pull[flat], len(n)) / (n + PAD)
            known.update(zip(new, z.tolist()))
        return np.fromiter(map(known.__getitem__, words), np.float64, len(words))

    def passages(self, words: list[bytes], sizes: np.ndarray, known: dict[bytes, float]) -> tuple[np.ndarray, np.ndarray]:
        """Log-odds of every passage of texts given as their words one after another, and how many passages each has."""
        z, k = self.values(words, known), self.width
        n = np.where(sizes >= k, sizes - k + 1, np.minimum(sizes, 1))
        first = np.cumsum(sizes) - sizes
        starts = np.repeat(first - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
        run = np.zeros(len(z))  # added up place by place: equal texts have equal sums wherever they stand
        for i in range(k):
            run[: len(z) - i] += z[i:]
        run = run / k
        for i in np.flatnonzero((sizes > 0) & (sizes < k)).tolist():
            run[first[i]] = sum(z[first[i] : first[i] + sizes[i]].tolist()) / sizes[i]
        return run[starts] + self.bias, n

    def score(self, texts: list[bytes], known: dict[bytes, float] | None = None) -> np.ndarray:
        words: list[bytes] = []
        sizes = []
        for text in texts:
            own = text.lower().split()
            sizes.append(len(own))
            words += own
        z, n = self.passages(words, np.array(sizes, np.int64), {} if known is None else known)
        worst = np.full(len(texts), self.bias)
        has = np.flatnonzero(n)
        if len(has):
            worst[has] = np.maximum.reduceat(z, (np.cumsum(n) - n)[has])
        return 1 / (1 + np.exp(-np.clip(worst, -40, 40)))


class Corpus:
    """Texts as numbers of words in one vocabulary, one text after another; the distinct words of each; and its passages,
    runs of `width` words."""

    def __init__(self, vocabulary: list[bytes], words: np.ndarray, sizes: np.ndarray, distinct: np.ndarray, n_distinct: np.ndarray, width: int):
        self.words, self.distinct, self.n_distinct, self.width = words, distinct, n_distinct, width
        self.distinct_at = np.cumsum(n_distinct) - n_distinct
        self.grams, self.n_grams = subwords(vocabulary)
        self.gram_at = np.cumsum(self.n_grams) - self.n_grams
        n_passages = -(-sizes // width)
        self.text_of = np.repeat(np.arange(len(sizes), dtype=np.int32), n_passages)
        inside = np.arange(len(self.text_of)) - np.repeat(np.cumsum(n_passages) - n_passages, n_passages)
        self.n_words = np.minimum(width, np.repeat(sizes, n_passages) - inside * width).astype(np.int32)
        self.word_at = np.cumsum(self.n_words, dtype=np.int64) - self.n_words
        self.passage_of = np.repeat(np.arange(len(self.text_of), dtype=np.int32), self.n_words)

    @staticmethod
    def of(texts: list[tuple[list[bytes], np.ndarray]], width: int) -> Corpus:
        """From each text's distinct words and its words as places in that list."""
        number: dict[bytes, int] = {}
        own = [np.fromiter((number.setdefault(w, len(number)) for w in vocabulary), np.int32, len(vocabulary)) for vocabulary, _ in texts]
        joined = lambda parts: np.concatenate(parts) if parts else np.empty(0, np.int32)
        count = lambda parts: np.array(list(map(len, parts)), np.int64)
        words = joined([v[w] for v, (_, w) in zip(own, texts)])
        return Corpus(list(number), words, count([w for _, w in texts]), joined(own), count(own), width)

    @staticmethod
    def ranges(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
        ends = np.cumsum(counts)
        return np.repeat(starts - (ends - counts), counts) + np.arange(ends[-1] if len(ends) else 0)


def numbered(text: bytes) -> tuple[list[bytes], np.ndarray]:
    """The distinct words of a text, and its words as places in that list."""
    number: dict[bytes, int] = {}
    places = np.fromiter((number.setdefault(w, len(number)) for w in text.lower().split()), np.int32)
    return list(number), places


class _Net:
    """The table of vectors and the softmax, with Adagrad's sums."""

    def __init__(self, bags: Corpus, trainable: np.ndarray, dims: int, rate: float, rng: np.random.Generator):
        self.bags, self.trainable, self.rate = bags, trainable, rate
        self.table = np.where(trainable[:, None], rng.uniform(-0.1, 0.1, (BUCKETS, dims)), 0.0)  # rare buckets stay at zero
        self.soft, self.bias = rng.uniform(-0.5, 0.5, (2, dims)), np.zeros(2)
        self.sums = [np.full(self.table.shape, 1e-4), np.full(self.soft.shape, 1e-4), np.full(2, 1e-4)]

    def forward(self, owner: np.ndarray, words: np.ndarray, n_rows: int):
        """Softmax of rows given as words with the number of their row."""
        b = self.bags
        used, where = np.unique(words, return_inverse=True)
        flat = b.grams[b.ranges(b.gram_at[used], b.n_grams[used])]
        n = b.n_grams[used]
        vectors = np.add.reduceat(self.table[flat], np.cumsum(n) - n) / (n + PAD)[:, None]
        size = np.maximum(np.bincount(owner, minlength=n_rows), 1)
        hidden = np.stack([np.bincount(owner, v, n_rows) for v in vectors[where].T], 1) / size[:, None]
        z = hidden @ self.soft.T + self.bias
        p = np.exp(z - z.max(1, keepdims=True))
        return p / p.sum(1, keepdims=True), (flat, n, where, size, hidden)

    def step(self, owner: np.ndarray, words: np.ndarray, label: np.ndarray, weight: np.ndarray) -> None:
        p, (flat, n, where, size, hidden) = self.forward(owner, words, len(label))
        d = (p - np.eye(2)[label]) * (weight / weight.sum())[:, None]
        back = (d @ self.soft / size[:, None])[owner]
        by_word = np.stack([np.bincount(where, v, len(n)) for v in back.T], 1) / (n + PAD)[:, None]
        owners, keep = np.repeat(np.arange(len(n)), n), self.trainable[flat]
        hit, at = np.unique(flat[keep], return_inverse=True)
        g = np.stack([np.bincount(at, v, len(hit)) for v in by_word[owners[keep]].T], 1)
        self.sums[0][hit] += g**2
        self.table[hit] -= self.rate * g / np.sqrt(self.sums[0][hit])
        for value, grad, total in ((self.soft, d.T @ hidden, self.sums[1]), (self.bias, d.sum(0), self.sums[2])):
            total += grad**2
            value -= self.rate * grad / np.sqrt(total)


def fit(
    b: Corpus,
    toxic: np.ndarray,
    *,
    dims: int = 8,
    text_epochs: int = 4,
    epochs: int = 12,
    first_epochs: int = 3,
    text_steps: int = 48,
    steps: int = 100,
    rate: float = 0.3,
    min_texts: int = 10,
    harmless: int = 8,
    decay: float = 0.85,
    seed: int = 5,
) -> SubwordSoftmax:
    """toxic: each text's label.

    First whole texts are the bags, by their distinct words, which finds the words that toxic texts share. Then the bags
    are passages: the worst one of each toxic text against passages of harmless texts, `harmless` random ones for each and
    as many again of those that score highest.
    """
    width, text_of = b.width, b.text_of
    y = toxic[text_of].astype(np.int8) if len(text_of) else np.empty(0, np.int8)
    if not len(y) or y.min() == y.max():
        share = float(y.mean()) if len(y) else 0.0
        return SubwordSoftmax(np.zeros(BUCKETS), float(np.log(max(share, 1e-6) / max(1 - share, 1e-6))), width)
    rng = np.random.default_rng(seed)
    texts_with = np.zeros((2, BUCKETS), np.int64)  # by label
    for label in (0, 1):
        for part in np.array_split(np.flatnonzero(toxic == label), max(1, len(toxic) // 100)):
            w = b.distinct[b.ranges(b.distinct_at[part], b.n_distinct[part])]
            owner = np.repeat(np.arange(len(part)), b.n_distinct[part])
            grams = np.unique(np.repeat(owner, b.n_grams[w]) * BUCKETS + b.grams[b.ranges(b.gram_at[w], b.n_grams[w])])
            texts_with[label] += np.bincount(grams % BUCKETS, minlength=BUCKETS)
    least = max(2, min(min_texts, int(toxic.sum()) // 10))  # few labels, fewer texts to share a subword
    net = _Net(b, texts_with.sum(0) >= least, dims, rate, rng)
    n_texts = np.maximum(np.bincount(toxic.astype(int), minlength=2), 1)[:, None]
    shares, pooled = texts_with / n_texts, (texts_with.sum(0) + 0.5) / (n_texts.sum() + 1.0)
    contrast = (shares[1] - shares[0]) / np.sqrt(pooled * (1 - pooled) * (1 / n_texts).sum())
    telling = np.add.reduceat(contrast[b.grams], b.gram_at) / (b.n_grams + PAD)  # of each word, in standard errors

    def rows_of(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return np.repeat(np.arange(len(rows)), b.n_words[rows]), b.words[b.ranges(b.word_at[rows], b.n_words[rows])]

    def scores() -> np.ndarray:
        """Log-odds of every passage; linear in the words, so each word is looked up once."""
        pull = net.table @ (net.soft[1] - net.soft[0])
        by_word = np.add.reduceat(pull[b.grams], b.gram_at) / (b.n_grams + PAD)
        return np.bincount(b.passage_of, by_word[b.words], len(y)) / np.maximum(b.n_words, 1)

    share = 0.5 / np.maximum(np.bincount(toxic.astype(int), minlength=2), 1)
    for _ in range(text_epochs):
        for texts in np.array_split(rng.permutation(len(toxic)), max(1, min(len(toxic) // 8, text_steps))):
            owner = np.repeat(np.arange(len(texts)), b.n_distinct[texts])
            words = b.distinct[b.ranges(b.distinct_at[texts], b.n_distinct[texts])]
            net.step(owner, words, toxic[texts].astype(int), share[toxic[texts].astype(int)])
    bad, good = np.flatnonzero(y == 1), np.flatnonzero(y == 0)
    for turn in range(epochs):
        net.table *= decay
        # at first the passage with the word that tells toxic texts apart best, then the one that the net finds worst
        z = np.maximum.reduceat(telling[b.words], b.word_at) if turn < first_epochs else scores()
        p = pd.Series(z[bad])
        worst = bad[p.groupby(text_of[bad]).idxmax().to_numpy()]
        many = min(len(good), harmless * len(worst))
        hard = good[np.argsort(-z[good], kind="stable")[:many]]
        rows = np.concatenate([worst, hard, rng.choice(good, many, replace=False)])
        for part in np.array_split(rng.permutation(rows), max(1, min(len(rows) // 16, steps))):
            net.step(*rows_of(part), y[part].astype(int), np.where(y[part] == 1, 4.0, 1.0))
    return SubwordSoftmax(net.table @ (net.soft[1] - net.soft[0]), float(net.bias[1] - net.bias[0]), width)


def train(docs: DataFrame, labels: DataFrame, *, label: str = "toxic", use: Column, max_rows: int = 2_000, width: int = 6, **options) -> SubwordSoftmax:
    """Fits on at most max_rows texts per class of the labelled rows that `use` (a condition on doc_id) admits."""
    known = labels.where(use & F.col("doc_id").isNotNull() & F.col(label).isNotNull()).select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias("label"))
    part = lambda v: known.where(F.col("label") == v).orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rows)
    chosen = part(0).unionByName(part(1))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_bytes().alias("text")).join(F.broadcast(chosen), "doc_id")  # 2 * max_rows at most

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in in_slices(batches):
            ids, texts, ys = (c.to_pylist() for c in batch.columns)
            out = [(i, y, *numbered(t)) for i, t, y in zip(ids, texts, ys)]
            if out:
                ids, ys, words, places = zip(*out)
                columns = [pa.array(ids, pa.int64()), pa.array(ys, pa.int32()), pa.array(words, pa.list_(pa.binary())), pa.array([p.tobytes() for p in places], pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "label", "words", "places"])

    table = rows.select("doc_id", "text", "label").mapInArrow(cut, "doc_id long, label int, words array<binary>, places binary").toArrow().to_pylist()
    table = sorted((r for r in table if r["words"]), key=lambda r: (r["doc_id"], r["label"], r["words"], r["places"]))  # texts without words train nothing
    corpus = Corpus.of([(r["words"], np.frombuffer(r["places"], np.int32)) for r in table], width)
    return fit(corpus, np.array([r["label"] for r in table], np.int64), **options)


def score(docs: DataFrame, model: SubwordSoftmax) -> DataFrame:
    """doc_id and score of every row of docs."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = known_words(model.name())
        for batch in in_slices(batches, 2_000):
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(model.score(batch.column(1).to_pylist(), known))], ["doc_id", "score"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_bytes().alias("text")).mapInArrow(rows, "doc_id long, score double")
