"""Text quality by a generalised additive model with pairwise interactions.

A text is measured whole: shares of kinds of characters, lengths and repetition of words.
Each measure is binned. The model is a table of log-odds for each measure's bins and for the
bins of a few pairs of measures, learned by cyclic boosting: in turn, each measure's table
gets a small step of a shallow tree fitted to what is left unexplained; then the pairs that
explain most of the rest get theirs. A score is a sum of table entries, so every text is
scored by look-ups and additions.

Measures are taken where the texts are read. The fit sees those of a bounded number of
labelled documents.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from itertools import combinations
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .sampling import smallest
from .workers import Batches, bounded
from .workspace import Workspace

#: The model is fitted on at most so many labelled documents: those with the smallest hashes of their ids.
SAMPLE = 20_000
#: Bins of a measure in its own table, and in a pair's.
BINS, PAIR_BINS = 32, 12
#: Rounds over all measures, leaves of a tree, and the share of a tree that is added.
ROUNDS, LEAVES, RATE = 120, 4, 0.15
#: Pairs that are learned, and their rounds.
PAIRS, PAIR_ROUNDS = 8, 60
#: Weight of a leaf's pull towards zero, and the least weight of a leaf.
PULL, LEAST = 1.0, 1.0
LIKELY = 0.7
#: Characters of a text that are cut into words at once.
CUT = 1 << 18

#: Kinds of bytes in UTF-8, by their characters.
KINDS = {
    "upper": b"ABCDEFGHIJKLMNOPQRSTUVWXYZ",
    "lower": b"abcdefghijklmnopqrstuvwxyz",
    "digit": b"0123456789",
    "stop": b".",
    "comma": b",;:",
    "shout": b"!?",
    "quote": b"\"'`",
    "bracket": b"()[]{}<>",
    "bar": b"|",
    "mark": b"#$%&*@^~+=_\\/",
    "dash": b"-",
    "line": b"\n",
    "blank": b" \t\r",
    "control": bytes([*range(9), 11, 12, *range(14, 32), 127]),
    "other": bytes(range(128, 256)),
}
_KIND = np.zeros((256, len(KINDS)))
for _k, _bytes in enumerate(KINDS.values()):
    _KIND[list(_bytes), _k] = 1
NAMES = [*KINDS, "size", "words", "word_length", "long_words", "short_words", "repeated_next", "distinct", "top_word", "capital_words", "marked_words", "next_distinct"]


def _pieces(text: str) -> Iterator[str]:
    """The text in pieces of about ``CUT`` characters that end between words; a longer word is a piece."""
    at = 0
    while at < len(text):
        to = at + CUT
        while to < len(text) and not text[to].isspace():
            to += 1
        yield text[at:to]
        at = to


def measures(text: str) -> np.ndarray:
    """The measures of a whole text, in the order of ``NAMES``; zeros for an empty one."""
    counts = np.zeros(256, dtype=np.int64)
    n = letters = long = short = repeated = capital = marked = 0
    seen: Counter[int] = Counter()
    following: set[int] = set()
    last = None
    for piece in _pieces(text):
        counts += np.bincount(np.frombuffer(piece.encode("utf-8", "surrogatepass"), dtype=np.uint8), minlength=256)
        words = piece.split()
        if not words:
            continue
        hashes = list(map(hash, words))  # seeded for each worker; only which are equal counts
        lengths = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
        n += len(words)
        letters += int(lengths.sum())
        long += int((lengths > 15).sum())
        short += int((lengths < 4).sum())
        repeated += sum(map(eq, hashes, hashes[1:])) + (hashes[0] == last)
        capital += sum(map(str.isupper, words))
        marked += len(words) - sum(w.isalnum() for w in words)
        seen.update(hashes)
        before = hashes[:-1] if last is None else [last, *hashes[:-1]]
        following.update(map(hash, zip(before, hashes[1:] if last is None else hashes, strict=True)))
        last = hashes[-1]
    size = int(counts.sum())
    if not size:
        return np.zeros(len(NAMES))
    return np.concatenate([counts @ _KIND / size, [np.log1p(size), np.log1p(n), letters / max(1, n), long / max(1, n), short / max(1, n), repeated / max(1, n), len(seen) / max(1, n), max(seen.values(), default=0) / max(1, n), capital / max(1, n), marked / max(1, n), len(following) / max(1, n)]])


def _measured(batches: Batches) -> Iterator[pa.RecordBatch]:
    """(key, y, text) to (key, y, x)."""
    for batch in batches:
        rows = [measures(t or "") for t in batch.column(2).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(rows, pa.list_(pa.float64()))], ["key", "y", "x"])


def _leaf(grad: np.ndarray, weight: np.ndarray) -> np.ndarray:
    return grad / (weight + PULL)


def _gain(grad: np.ndarray, weight: np.ndarray) -> np.ndarray:
    return grad * grad / (weight + PULL)


def tree(grad: np.ndarray, weight: np.ndarray, leaves: int = LEAVES) -> np.ndarray:
    """A step for each bin: cuts where they help most, until there are ``leaves`` runs of bins."""
    sum_g, sum_w = np.concatenate([[0], np.cumsum(grad)]), np.concatenate([[0], np.cumsum(weight)])
    cuts = [0, len(grad)]
    while len(cuts) <= leaves:
        best, at = 1e-9, None
        for lo, hi in zip(cuts, cuts[1:]):
            if hi - lo < 2:
                continue
            mid = np.arange(lo + 1, hi)
            left_g, left_w, all_g, all_w = sum_g[mid] - sum_g[lo], sum_w[mid] - sum_w[lo], sum_g[hi] - sum_g[lo], sum_w[hi] - sum_w[lo]
            better = _gain(left_g, left_w) + _gain(all_g - left_g, all_w - left_w) - _gain(all_g, all_w)
            better[(left_w < LEAST) | (all_w - left_w < LEAST)] = 0
            if better.max() > best:
                best, at = better.max(), int(mid[better.argmax()])
        if at is None:
            break
        cuts = sorted([*cuts, at])
    out = np.zeros(len(grad))
    for lo, hi in zip(cuts, cuts[1:]):
        out[lo:hi] = _leaf(sum_g[hi] - sum_g[lo], sum_w[hi] - sum_w[lo])
    return out


def pair_tree(grad: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, float]:
    """A step for each cell of a pair: one cut of the first measure, one of the second on either side; and its gain."""
    best, out = 0.0, np.zeros_like(grad)
    total = float(_gain(grad.sum(), weight.sum()))
    for mid in range(1, len(grad)):
        step, gain = np.zeros_like(grad), -total
        for rows in (slice(0, mid), slice(mid, len(grad))):
            side = tree(grad[rows].sum(axis=0), weight[rows].sum(axis=0), 2)
            step[rows] = side
            for value in np.unique(side):
                on = side == value
                gain += float(_gain(grad[rows, on].sum(), weight[rows, on].sum()))
        if gain > best:
            best, out = gain, step
    return out, best


class Additive:
    """Tables of log-odds: one a measure, one a pair of measures."""

    def __init__(self, x: np.ndarray, y: np.ndarray):
        self.edges = [self._edges(v, BINS) for v in x.T]
        self.pair_edges = [self._edges(v, PAIR_BINS) for v in x.T]
        self.base = float(np.log((y.sum() + 1) / (len(y) - y.sum() + 1)))
        self.tables = [np.zeros(len(e) + 1) for e in self.edges]
        self.pairs: list[tuple[int, int]] = []
        self.pair_tables: list[np.ndarray] = []
        if not len(y):
            return
        bins, coarse = self._bins(x, self.edges), self._bins(x, self.pair_edges)
        odds = np.full(len(y), self.base)
        for _ in range(ROUNDS):
            for f, table in enumerate(self.tables):
                step = RATE * tree(*self._left(odds, y, bins[f], len(table)))
                table += step
                odds += step[bins[f]]
        cells = {(a, b): coarse[a] * (len(self.pair_edges[b]) + 1) + coarse[b] for a, b in combinations(range(x.shape[1]), 2)}
        shape = lambda p: (len(self.pair_edges[p[0]]) + 1, len(self.pair_edges[p[1]]) + 1)
        fitted = lambda p: pair_tree(*(s.reshape(shape(p)) for s in self._left(odds, y, cells[p], int(np.prod(shape(p))))))
        self.pairs = sorted(cells, key=lambda p: (-fitted(p)[1], p))[:PAIRS]
        self.pair_tables = [np.zeros(shape(p)) for p in self.pairs]
        for _ in range(PAIR_ROUNDS):
            for p, table in zip(self.pairs, self.pair_tables, strict=True):
                step = RATE * fitted(p)[0]
                table += step
                odds += step.ravel()[cells[p]]

    @staticmethod
    def _edges(values: np.ndarray, bins: int) -> np.ndarray:
        """Borders of about equally full bins, between different values."""
        if not len(values):
            return np.zeros(0)
        marks = np.unique(np.quantile(values, np.arange(1, bins) / bins, method="lower"))
        return marks[marks > values.min()]

    @staticmethod
    def _bins(x: np.ndarray, edges: list[np.ndarray]) -> list[np.ndarray]:
        return [np.searchsorted(e, v, side="right") for e, v in zip(edges, x.T, strict=True)]

    @staticmethod
    def _left(odds: np.ndarray, y: np.ndarray, cell: np.ndarray, cells: int) -> tuple[np.ndarray, np.ndarray]:
        """What the scores leave unexplained in each cell, and the weight there."""
        p = 1 / (1 + np.exp(-odds))
        return np.bincount(cell, y - p, cells), np.bincount(cell, p * (1 - p), cells)

    def scores(self, x: np.ndarray) -> np.ndarray:
        odds = np.full(len(x), self.base)
        for table, own in zip(self.tables, self._bins(x, self.edges), strict=True):
            odds += table[own]
        coarse = self._bins(x, self.pair_edges)
        for (a, b), table in zip(self.pairs, self.pair_tables, strict=True):
            odds += table[coarse[a], coarse[b]]
        return 1 / (1 + np.exp(-odds))


def held_out(key: Column) -> Column:
    """Whether a document is kept from learning: crc32 of its id as text, modulo 4, is 2. A null id is not."""
    return F.coalesce(F.crc32(key.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> Additive:
    """The model from labelled documents that aren't held out, at most ``SAMPLE`` of them.

    A document of several labels has their mean, and of several texts the one of the
    smallest measures. Null ids and labels teach nothing.
    """
    ws = Workspace(docs.sparkSession, "quality")
    known = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull() & ~held_out(F.col(id_col))).groupBy(F.col(id_col).cast("long").alias("key")).agg(F.avg(F.col(label_col).cast("double")).alias("y"))
    some = ws.put(smallest(known, "key", SAMPLE), "labels")
    texts = docs.select(F.col(id_col).cast("long").alias("key"), F.col(text_col).cast("string").alias("text")).join(F.broadcast(some), "key")  # SAMPLE rows of two numbers
    rows = texts.select("key", "y", "text").mapInArrow(bounded(_measured), "key bigint, y double, x array<double>").groupBy("key").agg(F.min("y").alias("y"), F.min("x").alias("x")).orderBy("key").collect()  # SAMPLE rows of measures
    return Additive(np.array([r["x"] for r in rows]).reshape(len(rows), len(NAMES)), np.array([r["y"] for r in rows]))


def _scored(model: Additive):
    def run(batches: Batches) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.array([measures(t or "") for t in batch.column(2).to_pylist()]).reshape(len(batch), len(NAMES))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(model.scores(x))], ["doc_id", "held_out", "score"])

    return bounded(run)


def score_quality(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> DataFrame:
    """One row per document: doc_id, held_out, score (0 to 1), predicted (1 if score >= 0.7).

    A null text is scored as the empty one. Without labels every score is one half; with
    labels of one kind it is their smoothed share. Ids may be null or repeat; each row is
    scored by its text alone. A very long text is cut into words piece by piece, so memory
    follows its distinct words. Extra columns are ignored; an empty table gives an empty result.
    """
    model = fit(docs, labels, id_col, text_col, label_col)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), held_out(F.col(id_col)).alias("held_out"), F.col(text_col).cast("string").alias("text"))
    out = rows.mapInArrow(_scored(model), "doc_id bigint, held_out boolean, score double")
    return out.withColumn("predicted", (F.col("score") >= LIKELY).cast("int"))
