"""Hard negatives by exact inner products, with most pairs discarded early.

Vectors become integers. The second moments of all of them are summed, and their
eigenvectors are an orthogonal rotation after which the leading components hold most of an
inner product. An anchor and a row are compared component group by component group: what the
remaining ones can add is bounded by the product of both residual norms, plus slack for
rounding. A pair whose product can't lie in a band that is asked for, or can't reach the best
that the band already holds, is discarded; the survivors' products are computed in integers.

Anchors and rows are dealt to blocks, and one task compares a block of each. Positives are
looked for in the blocks of the anchor's own label, negatives in all.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .integers import integer_vector, matrix
from .workers import Batches, bounded
from .workspace import Workspace

POSITIVES, NEGATIVES = 5, 5
#: A negative's score is at least this share of the positive's, in hundredths.
LEAST_PERCENT = 80
#: Rows and anchors of a block, and those that are compared at once within it.
BLOCK, STEP_ROWS, STEP_ANCHORS = 8192, 1024, 256
#: Groups of labels; a group of several blocks is split further.
MOST_GROUPS = 4096
#: Where a partial product is extended: shares of the components.
STAGES = (1 / 8, 1 / 4, 1 / 2, 1.0)
#: Alive pairs of a stage above this share are extended together, below it one by one.
DENSE = 0.25
#: The score of a free place; products are smaller than 2**52.
NONE = -(1 << 62)
#: Pairs whose integer products are computed at once.
VERIFY = 1 << 14


def rotation(moments: np.ndarray) -> np.ndarray:
    """An orthogonal matrix whose columns are the principal directions, the strongest first."""
    _, directions = np.linalg.eigh(moments)
    return directions[:, ::-1]


@dataclass
class Side:
    """Vectors of one side of a comparison: their ids, labels and integers, rotated, and what is left of their norms at each stage."""

    ids: np.ndarray
    labels: np.ndarray
    whole: np.ndarray
    turned: np.ndarray
    rest: np.ndarray
    norm: np.ndarray

    @staticmethod
    def of(ids: np.ndarray, labels: np.ndarray, whole: np.ndarray, turn: np.ndarray | None) -> Side:
        turned = whole @ turn if turn is not None and turn.shape[0] == whole.shape[1] else whole.astype(float)
        squares = np.concatenate([np.cumsum((turned**2)[:, ::-1], axis=1)[:, ::-1], np.zeros((len(whole), 1))], axis=1)
        rest = np.sqrt(squares)
        return Side(ids, labels, whole, turned, rest, rest[:, 0])

    def part(self, at: slice) -> Side:
        return Side(*(x[at] for x in (self.ids, self.labels, self.whole, self.turned, self.rest, self.norm)))


class Best:
    """The best ids of each slot so far: rows of (score, id), best first; ties to the smaller id."""

    def __init__(self, slots: int, k: int):
        self.k = k
        self.score = np.full((slots, k), NONE)
        self.id = np.full((slots, k), np.iinfo(np.int64).max)

    def least(self) -> np.ndarray:
        """What a score must reach at least; -inf where a slot has room."""
        last = self.score[:, -1]
        return np.where(last == NONE, -np.inf, last.astype(float))

    def add(self, slot: np.ndarray, ids: np.ndarray, scores: np.ndarray) -> None:
        if not len(slot):
            return
        own = np.unique(slot)
        s = np.concatenate([slot, np.repeat(own, self.k)])
        i, v = np.concatenate([ids, self.id[own].ravel()]), np.concatenate([scores, self.score[own].ravel()])
        order = np.lexsort((i, -v, s))
        s, i, v = s[order], i[order], v[order]
        place = np.arange(len(s)) - np.searchsorted(s, s)
        keep = place < self.k
        self.id[s[keep], place[keep]], self.score[s[keep], place[keep]] = i[keep], v[keep]


def _alive(anchors: Side, rows: Side, allowed: np.ndarray, low: np.ndarray, high: np.ndarray, best: Best, slots: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (anchor, row) whose product may lie between an anchor's ``low`` and ``high`` in some slot and reach its best so far."""
    width = anchors.whole.shape[1]
    cuts = [0, *sorted({max(1, round(width * s)) for s in STAGES})] if width else [0]
    unit = 64 * (width + 1) * np.finfo(float).eps
    floor = np.maximum(low, best.least()[slots])
    row = column = partial = None  # of the alive pairs, once they are few
    whole = np.zeros(allowed.shape)
    alive = allowed
    for stage, (lo, hi) in enumerate(zip(cuts, cuts[1:])):
        if row is None:
            whole += anchors.turned[:, lo:hi] @ rows.turned[:, lo:hi].T
            slack = unit * np.outer(anchors.norm, rows.norm) + 1e-6
            off = np.outer(anchors.rest[:, hi], rows.rest[:, hi]) + slack
            if stage == 0:  # the k-th largest lower bound of what surely lies in a slot is reached
                for p in range(low.shape[1]):
                    sure = np.where(allowed & (whole + off <= high[:, p, None]), whole - off, -np.inf)
                    if sure.shape[1] >= best.k:
                        floor[:, p] = np.maximum(floor[:, p], -np.partition(-sure, best.k - 1, axis=1)[:, best.k - 1])
            alive = alive & np.logical_or.reduce([(whole + off >= floor[:, p, None]) & (whole - off <= high[:, p, None]) for p in range(low.shape[1])])
            if alive.mean() < DENSE:
                row, column = np.nonzero(alive)
                partial = whole[row, column]
        else:
            kept = []
            for at in range(0, len(row), VERIFY):
                r, c = row[at : at + VERIFY], column[at : at + VERIFY]
                partial[at : at + VERIFY] += np.einsum("ij,ij->i", anchors.turned[r, lo:hi], rows.turned[c, lo:hi])
                some = partial[at : at + VERIFY]
                off = anchors.rest[r, hi] * rows.rest[c, hi] + unit * anchors.norm[r] * rows.norm[c] + 1e-6
                kept.append(np.logical_or.reduce([(some + off >= floor[r, p]) & (some - off <= high[r, p]) for p in range(low.shape[1])]))
            keep = np.concatenate(kept) if kept else np.zeros(0, dtype=bool)
            row, column, partial = row[keep], column[keep], partial[keep]
    return np.nonzero(alive) if row is None else (row, column)


def search(anchors: Side, rows: Side, low: np.ndarray, high: np.ndarray, k: int, same_label: bool) -> Best:
    """For each anchor and slot (columns of ``low`` and ``high``) the k best of the rows whose integer product lies between both.

    A row with the anchor's id is no candidate, and rows are those of the same label or those of others.
    Slots are numbered anchor by anchor.
    """
    slots = np.arange(low.size).reshape(low.shape)
    best = Best(low.size, k)
    for i in range(0, len(anchors.ids), STEP_ANCHORS):
        some = slice(i, i + STEP_ANCHORS)
        own = anchors.part(some)
        for j in range(0, len(rows.ids), STEP_ROWS):
            other = rows.part(slice(j, j + STEP_ROWS))
            allowed = (own.ids[:, None] != other.ids[None, :]) & ((own.labels[:, None] == other.labels[None, :]) == same_label)
            a, b = _alive(own, other, allowed, low[some], high[some], best, slots[some])
            for at in range(0, len(a), VERIFY):
                r, c = a[at : at + VERIFY], b[at : at + VERIFY]
                score = (own.whole[r] * other.whole[c]).sum(axis=1)
                for p in range(low.shape[1]):
                    hit = (score >= low[i + r, p]) & (score <= high[i + r, p])
                    best.add(slots[i + r[hit], p], other.ids[c[hit]], score[hit])
    return best


def _moments(width: int):
    """(vector) to the sums of products of any two components, of one task's rows: cell, total."""

    def run(batches: Batches) -> Iterator[pa.RecordBatch]:
        total = np.zeros((width, width))
        for batch in batches:
            rows = matrix(batch.column(0)).astype(float)
            total += rows.T @ rows if len(rows) else 0
        cell = np.flatnonzero(np.triu(np.ones((width, width))))
        yield pa.RecordBatch.from_arrays([pa.array(cell), pa.array(total.ravel()[cell])], ["cell", "total"])

    return bounded(run)


def principal(vectors: DataFrame, width: int) -> np.ndarray:
    """The rotation for all ``vectors`` (one column, of one width)."""
    sums = vectors.mapInArrow(_moments(width), "cell bigint, total double").groupBy("cell").agg(F.sum("total").alias("total"))
    moments = np.zeros(width * width)
    for cell, total in sums.collect():  # one for each two components
        moments[cell] = total
    moments = moments.reshape(width, width)
    return rotation(moments + np.triu(moments, 1).T)


def _by_width(left: pa.Table, right: pa.Table) -> Iterator[tuple[pa.Table, pa.Table]]:
    """Both sides' rows of each width that both have."""
    widths = lambda t: pc.list_value_length(t["vector"]).to_numpy()
    a, b = widths(left), widths(right)
    for w in np.intersect1d(a, b).tolist():
        yield left.take(pa.array(np.flatnonzero(a == w))), right.take(pa.array(np.flatnonzero(b == w)))


def _side(t: pa.Table, turn: np.ndarray | None, labels: dict) -> Side:
    codes = np.array([labels.setdefault(x, len(labels)) for x in t["label"].to_pylist()], dtype=np.int64)
    return Side.of(t["id"].to_numpy(), codes, matrix(t["vector"]), turn)


def _positives(turn: np.ndarray | None, k: int):
    """The best rows of each anchor's own label in one pair of blocks."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        out = []
        for anchors, rows in _by_width(left, right):
            labels: dict = {}
            a, b = _side(anchors, turn, labels), _side(rows, turn, labels)
            none = np.full((len(a.ids), 1), np.inf)
            best = search(a, b, -none, none, k, same_label=True)
            at, place = np.nonzero(best.score > NONE)
            out.append(pa.table({"id": a.ids[at], "other": best.id[at, place], "score": best.score[at, place]}))
        return pa.concat_tables(out) if out else pa.table({"id": pa.array([], pa.int64()), "other": pa.array([], pa.int64()), "score": pa.array([], pa.int64())})

    return run


def _negatives(turn: np.ndarray | None, k: int, slots: int, percent: int):
    """The best rows of other labels in each of an anchor's bands, in one pair of blocks."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        out = []
        for anchors, rows in _by_width(left, right):
            labels: dict = {}
            a, b = _side(anchors, turn, labels), _side(rows, turn, labels)
            # A slot that the anchor has no positive for holds nothing.
            low, high, positive = np.full((len(a.ids), slots), np.inf), np.full((len(a.ids), slots), -np.inf), np.zeros((len(a.ids), slots), dtype=np.int64)
            for i, found in enumerate(anchors["positives"].to_pylist()):
                for p, x in enumerate(found):
                    low[i, p], high[i, p], positive[i, p] = -(-percent * x["score"] // 100), x["score"], x["other"]
            best = search(a, b, low, high, k, same_label=False)
            at, place = np.nonzero(best.score > NONE)
            out.append(pa.table({"anchor_id": a.ids[at // slots], "positive_id": positive.ravel()[at], "negative_id": best.id[at, place], "positive_score": high.ravel()[at].astype(np.int64), "negative_score": best.score[at, place]}))
        return pa.concat_tables(out) if out else pa.table({c: pa.array([], pa.int64()) for c in ("anchor_id", "positive_id", "negative_id", "positive_score", "negative_score")})

    return run


def _dealt(df: DataFrame, own: str, other: str) -> DataFrame:
    """``df`` with a row for each of the other side's blocks; ``own`` and ``other`` hold the numbers of blocks."""
    return df.withColumn(own, F.pmod(F.xxhash64("id"), F.col(own)).cast("int")).withColumn(other, F.explode(F.sequence(F.lit(0), F.col(other) - 1)))


def _blocks(n: Column) -> Column:
    return F.greatest(F.lit(1), F.ceil(n / BLOCK)).cast("int")


def mine(vectors: DataFrame, anchors: Column, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", positives: int = POSITIVES, negatives: int = NEGATIVES, percent: int = LEAST_PERCENT) -> DataFrame:
    """For each anchor and positive the hardest negatives: anchor_id, positive_id, rank (from 1), negative_id, positive_score, negative_score.

    ``anchors`` is a condition on the table's rows. Positives are the anchor's first other rows of its label; negatives the
    first rows of other labels whose score is at most the positive's and at least ``percent`` hundredths of it.
    Scores are inner products of the integers, higher first, ties to the smaller id; a band
    of a negative positive's score is empty. Rows take no part without an id, a label or a vector,
    with a null or non-finite component, or with integers of a squared norm of 2**52 or
    more. Rows are compared with rows of their own length; only the most frequent length is
    rotated, others are compared in their own order of components. Of rows that share an id
    the one with the smallest label, then vector, takes part. Extra columns are ignored; an
    empty table, or one without anchors, gives an empty result.
    """
    ws = Workspace(vectors.sparkSession, "negatives")
    usable = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).alias("label"), integer_vector(F.col(vector_col)).alias("vector"), F.coalesce(anchors, F.lit(False)).alias("anchor"))
    rows = ws.put(usable.where("id IS NOT NULL AND label IS NOT NULL AND vector IS NOT NULL"), "rows")
    n, ids = rows.agg(F.count("*"), F.count_distinct("id")).first()
    if ids < n:
        rows = ws.put(rows.groupBy("id").agg(F.min(F.struct("label", "vector", "anchor")).alias("row")).select("id", "row.*"), "one-an-id")
    groups = min(MOST_GROUPS, max(1, math.ceil(n / BLOCK)))
    usual = rows.groupBy(F.size("vector").alias("width")).count().orderBy(F.desc("count"), "width").limit(1).collect()
    width = usual[0]["width"] if usual else 0
    turn = principal(rows.where(F.size("vector") == width).select("vector"), width) if width else None

    grouped = rows.withColumn("group", F.pmod(F.xxhash64("label"), F.lit(groups)).cast("int"))
    # At most MOST_GROUPS rows.
    plan = F.broadcast(grouped.groupBy("group").agg(_blocks(F.count("*")).alias("rb"), _blocks(F.count_if("anchor")).alias("ab"), F.count_if("anchor").alias("asked")).where("asked > 0").drop("asked"))
    asked = ws.put(grouped.where("anchor").select("group", "id", "label", "vector"), "asked")
    keys = ["group", "rb", "ab"]
    near = _dealt(asked.join(plan, "group"), "ab", "rb").select(*keys, "id", "label", "vector").groupBy(*keys).cogroup(_dealt(grouped.join(plan, "group"), "rb", "ab").select(*keys, "id", "label", "vector").groupBy(*keys))
    first = near.applyInArrow(_positives(turn, positives), "id bigint, other bigint, score bigint")
    order = Window.partitionBy("id").orderBy(F.desc("score"), "other")
    chosen = first.withColumn("place", F.row_number().over(order)).where(F.col("place") <= positives).groupBy("id").agg(F.sort_array(F.collect_list(F.struct("place", "other", "score"))).alias("positives"))  # POSITIVES at most
    armed = ws.put(asked.drop("group").join(chosen, "id"), "anchors")

    row_blocks, anchor_blocks = math.ceil(max(1, ids) / BLOCK), math.ceil(max(1, armed.count()) / BLOCK)
    numbered = lambda d: d.withColumn("rb", F.lit(row_blocks)).withColumn("ab", F.lit(anchor_blocks))
    pairs = _dealt(numbered(armed), "ab", "rb").groupBy("rb", "ab").cogroup(_dealt(numbered(rows.select("id", "label", "vector")), "rb", "ab").groupBy("rb", "ab"))
    found = pairs.applyInArrow(_negatives(turn, negatives, positives, percent), "anchor_id bigint, positive_id bigint, negative_id bigint, positive_score bigint, negative_score bigint")
    order = Window.partitionBy("anchor_id", "positive_id").orderBy(F.desc("negative_score"), "negative_id")
    ranked = found.withColumn("rank", F.row_number().over(order).cast("int")).where(F.col("rank") <= negatives)
    return ranked.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
