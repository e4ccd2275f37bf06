"""Approximate nearest neighbours by learned partitions.

On a bounded sample of the vectors a neighbour graph is built and cut into balanced
parts; a small softmax classifier learns from it to tell, for any vector, how likely
each part holds its neighbours. Where that gives parts that are too large, each is
sampled, cut and learned again, so the index is a tree of at most two routers and its
leaves hold some ``ROWS_A_PART`` rows. Every row is indexed under its most probable leaf.
A query goes to its several most probable leaves and is compared with all of their rows
exactly. How many leaves a query needs is measured: a bounded number of queries is
compared with the whole table, and their true neighbours' leaves are looked up.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .sampling import hash_limit, smallest
from .workers import bounded
from .workspace import Workspace

#: A router is fitted on at most so many vectors: those with the smallest hashes of their ids.
SAMPLE, GRAPH_DEGREE = 4096, 16
#: Rows that a leaf should hold, and the least and largest number of parts of one router.
ROWS_A_PART, LEAST_PARTS, MOST_PARTS = 2000, 8, 128
#: Parts of the first router whose leaves a vector is ranked over.
BEAM = 32
#: A part's excess over the mean in the graph cut.
SLACK = 1.1
#: The recall to reach, measured on so many queries against the whole table.
TARGET_RECALL, TRIALS = 0.95, 64
#: Rows and queries that a task compares at once; larger parts are split into blocks.
BLOCK = 8192
EPOCHS, RATE, SEED = 150, 0.05, 11


def _neighbours(data: np.ndarray, k: int) -> np.ndarray:
    out = np.zeros((len(data), k), dtype=np.int64)
    for at in range(0, len(data), 512):
        near = data[at : at + 512] @ data.T
        near[np.arange(len(near)), np.arange(at, at + len(near))] = -np.inf
        out[at : at + 512] = np.argpartition(-near, k - 1, axis=1)[:, :k]
    return out


def balanced_parts(graph: np.ndarray, parts: int, start: np.ndarray, rounds: int = 20) -> np.ndarray:
    """A cut of the neighbour graph: nodes move to the part of most neighbours while it has room."""
    n, room = len(graph), math.ceil(len(graph) / parts * SLACK)
    heads, tails = np.concatenate([np.repeat(np.arange(n), graph.shape[1]), graph.ravel()]), np.concatenate([graph.ravel(), np.repeat(np.arange(n), graph.shape[1])])
    part = start.copy()
    for _ in range(rounds):
        votes = np.bincount(heads * parts + part[tails], minlength=n * parts).reshape(n, parts)
        want = votes.argmax(axis=1)
        gain = votes[np.arange(n), want] - votes[np.arange(n), part]
        size, moves = np.bincount(part, minlength=parts), 0
        for i in np.argsort(-gain, kind="stable"):
            if gain[i] <= 0:
                break
            if size[want[i]] < room:
                size[part[i]] -= 1
                size[want[i]] += 1
                part[i] = want[i]
                moves += 1
        if not moves:
            break
    return part


def _softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


class Router:
    """Softmax weights over parts, fitted on vectors."""

    def __init__(self, data: np.ndarray, parts: int):
        rng = np.random.default_rng(SEED)
        unit = data / np.linalg.norm(data, axis=1, keepdims=True)
        degree = min(GRAPH_DEGREE, len(data) - 1)
        graph = _neighbours(unit, degree)
        order = np.argsort(unit @ rng.normal(size=unit.shape[1]), kind="stable")
        begin = np.zeros(len(data), dtype=np.int64)
        begin[order] = np.arange(len(data)) * parts // len(data)
        part = balanced_parts(graph, parts, begin)
        # Soft labels: where a vector and its neighbours lie.
        goal = np.bincount(np.repeat(np.arange(len(data)), degree) * parts + part[graph].ravel(), minlength=len(data) * parts).reshape(-1, parts).astype(float)
        goal[np.arange(len(data)), part] += 1
        goal /= goal.sum(axis=1, keepdims=True)
        self.weights, self.bias = np.zeros((unit.shape[1], parts)), np.zeros(parts)
        m, v = [0.0, 0.0], [0.0, 0.0]
        for t in range(1, EPOCHS + 1):  # Adam
            miss = (_softmax(unit @ self.weights + self.bias) - goal) / len(data)
            for i, g in enumerate((unit.T @ miss, miss.sum(axis=0))):
                m[i], v[i] = 0.9 * m[i] + 0.1 * g, 0.999 * v[i] + 0.001 * g * g
                step = RATE * (m[i] / (1 - 0.9**t)) / (np.sqrt(v[i] / (1 - 0.999**t)) + 1e-9)
                if i == 0:
                    self.weights -= step
                else:
                    self.bias -= step

    def log_odds(self, vectors: np.ndarray) -> np.ndarray:
        """Log-probabilities of the parts."""
        norm = np.linalg.norm(vectors, axis=1, keepdims=True)
        x = (vectors / np.where(norm > 0, norm, 1)) @ self.weights + self.bias
        x -= x.max(axis=1, keepdims=True)
        return x - np.log(np.exp(x).sum(axis=1, keepdims=True))


class Tree:
    """A router, and the routers of its parts where they are cut again. Leaf numbers are part * fan + part of the part."""

    def __init__(self, width: int, root: Router | None, below: dict[int, Router]):
        self.width, self.root, self.below, self.fan = width, root, below, MOST_PARTS

    def ranked(self, vectors: np.ndarray, most: int) -> np.ndarray:
        """The ``most`` leaves of each vector, the most probable first; -1 beyond the last."""
        out = [np.zeros((0, most), dtype=np.int64)]
        for at in range(0, len(vectors), 1024):
            out.append(self._ranked(vectors[at : at + 1024], most))
        return np.concatenate(out)

    def _ranked(self, vectors: np.ndarray, most: int) -> np.ndarray:
        if self.root is None:
            leaves, odds = np.zeros((len(vectors), 1), dtype=np.int64), np.zeros((len(vectors), 1))
        else:
            first = self.root.log_odds(vectors)
            parts = np.argsort(-first, axis=1, kind="stable")
            leaves, odds = parts * self.fan, np.take_along_axis(first, parts, axis=1)
            if self.below:
                parts, odds = parts[:, :BEAM], odds[:, :BEAM]
                fine = np.full((*parts.shape, self.fan), -np.inf)
                for p in np.unique(parts).tolist():
                    row, place = np.nonzero(parts == p)
                    if (router := self.below.get(p)) is None:
                        fine[row, place, 0] = odds[row, place]
                    else:
                        own = router.log_odds(vectors[row])
                        fine[row, place, : own.shape[1]] = own + odds[row, place][:, None]
                leaves = (parts[:, :, None] * self.fan + np.arange(self.fan)).reshape(len(vectors), -1)
                odds = fine.reshape(len(vectors), -1)
        order = np.argsort(-odds, axis=1, kind="stable")[:, :most]
        found = np.where(np.isfinite(np.take_along_axis(odds, order, axis=1)), np.take_along_axis(leaves, order, axis=1), -1)
        return found if found.shape[1] == most else np.pad(found, ((0, 0), (0, most - found.shape[1])), constant_values=-1)


def _matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1) if len(column) else np.zeros((0, 1))


def _assign(tree: Tree, probes: int):
    """(id, vector) to (id, vector, part), once for each of the most probable leaves; vectors of another width than the tree's have a part of their own."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            widths = np.diff(batch.column(1).offsets.to_numpy())
            parts = np.full((len(batch), probes), -1, dtype=np.int64)
            parts[:, 0] = -1 - widths
            if (own := np.flatnonzero(widths == tree.width)).size:
                parts[own] = tree.ranked(_matrix(batch.column(1).take(pa.array(own))), probes)
            row, place = np.nonzero(parts != -1)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(row)), batch.column(1).take(pa.array(row)), pa.array(parts[row, place].astype(np.int32))], ["id", "vector", "part"])

    return bounded(run)


def _train(wanted: dict[int, int]):
    """A router of each group of (part, h, id, vector) that wants several parts, fitted on the vectors with the smallest hashes, one of each id."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        part = int(rows["part"].iloc[0])
        some = rows.sort_values(["h", "id"]).drop_duplicates("id").head(SAMPLE)
        if wanted[part] == 1 or len(some) < 2 * wanted[part]:
            return pd.DataFrame({"part": [], "weights": [], "bias": []})
        router = Router(np.stack(some["vector"].to_numpy()), wanted[part])
        return pd.DataFrame({"part": [part], "weights": [router.weights.tobytes()], "bias": [router.bias.tobytes()]})

    return run


def _trials(queries: list[tuple[int, list[float]]], width: int, k: int):
    """(id, vector, part) to the k nearest rows of each trial query in a batch: query, id, part, score."""
    ids, data = np.array([q for q, _ in queries]), np.array([v for _, v in queries])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = batch.filter(pa.array(np.diff(batch.column(1).offsets.to_numpy()) == width))
            own, part = rows.column(0).to_numpy(), rows.column(2).to_numpy()
            out = [(i, at, scores) for i, at, scores in best(ids, data, own, _matrix(rows.column(1)), k)] if len(rows) else []
            at = np.concatenate([x[1] for x in out]) if out else np.zeros(0, dtype=np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat([x[0] for x in out], [len(x[1]) for x in out]).astype(np.int32)), pa.array(own[at]), pa.array(part[at]), pa.array(np.concatenate([x[2] for x in out]) if out else np.zeros(0))], ["query", "id", "part", "score"])

    return bounded(run)


def grow(rows: DataFrame, width: int, count: int, distinct: int, ws: Workspace) -> Tree:
    """The tree for ``count`` vectors (id, vector) of one width."""
    sampled = rows if distinct == count else rows.where(F.xxhash64("id") <= F.lit(hash_limit(distinct, SAMPLE))).groupBy("id").agg(F.min("vector").alias("vector"))
    sample = smallest(sampled, "id", SAMPLE).select("vector").toArrow()  # an id once: copies would take the places of its true neighbours
    if len(sample) < 32:
        return Tree(width, None, {})
    leaves = max(LEAST_PARTS, math.ceil(count / ROWS_A_PART))
    parts = leaves if leaves <= MOST_PARTS else min(MOST_PARTS, math.ceil(math.sqrt(leaves)))
    root = Router(_matrix(sample["vector"].combine_chunks()), parts)
    if leaves <= MOST_PARTS:
        return Tree(width, root, {})
    first = ws.put(rows.mapInArrow(_assign(Tree(width, root, {}), 1), "id bigint, vector array<double>, part int").withColumn("part", F.floor(F.col("part") / MOST_PARTS).cast("int")), "first")
    counts = {r["part"]: r["count"] for r in first.groupBy("part").count().collect()}
    limit = F.create_map(*(F.lit(x) for p, n in counts.items() for x in (p, hash_limit(n, SAMPLE))))
    some = first.withColumn("h", F.xxhash64("id")).where(F.col("h") <= limit[F.col("part")])
    wanted = {p: min(MOST_PARTS, math.ceil(n / ROWS_A_PART)) for p, n in counts.items()}
    below = {}
    for r in some.groupBy("part").applyInPandas(_train(wanted), "part int, weights binary, bias binary").collect():  # at most MOST_PARTS routers of bounded size
        router = Router.__new__(Router)
        router.bias = np.frombuffer(r["bias"])
        router.weights = np.frombuffer(r["weights"]).reshape(width, len(router.bias))
        below[r["part"]] = router
    return Tree(width, root, below)


def needed_leaves(tree: Tree, indexed: DataFrame, asked: DataFrame, k: int) -> int:
    """The fewest leaves that reach the target recall for trial queries (id, vector), by comparing them with all rows."""
    queries = [(r["id"], r["vector"]) for r in smallest(asked, "id", TRIALS).collect()]
    if not queries or tree.root is None:
        return 1
    near = indexed.mapInArrow(_trials(queries, tree.width, k), "query int, id bigint, part int, score double")
    order = Window.partitionBy("query").orderBy(F.desc("score"), "id")
    true = near.groupBy("query", "id").agg(F.max_by("part", "score").alias("part"), F.max("score").alias("score")).withColumn("n", F.row_number().over(order)).where(F.col("n") <= k).select("query", "part").toPandas()
    most = len(tree.root.bias) * (MOST_PARTS if tree.below else 1)
    ranked = tree.ranked(np.array([v for _, v in queries]), min(most, BEAM * MOST_PARTS))
    place = [np.flatnonzero(ranked[q] == p) for q, p in zip(true["query"], true["part"], strict=True)]
    need = np.sort([p[0] if len(p) else ranked.shape[1] for p in place])
    return int(min(ranked.shape[1], 1 + need[min(len(need) - 1, math.ceil(TARGET_RECALL * len(need)) - 1)])) if len(need) else 1


def first_of_each(ids: np.ndarray, scores: np.ndarray, k: int) -> np.ndarray:
    """Places of the best row of each of the k best ids, in order; ties to the smaller id."""
    order = np.lexsort((ids, -scores))
    _, first = np.unique(ids[order], return_index=True)
    return order[np.sort(first)[:k]]


def best(query_ids: np.ndarray, queries: np.ndarray, ids: np.ndarray, rows: np.ndarray, k: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For each query the best rows of the k best other ids by inner product, ties to the smaller id."""
    order = np.argsort(ids, kind="stable")
    starts = np.flatnonzero(np.diff(ids[order], prepend=ids[order[:1]] - 1))
    repeated = len(starts) < len(ids)
    for at in range(0, len(queries), 256):
        near = queries[at : at + 256] @ rows.T
        near[query_ids[at : at + 256, None] == ids[None, :]] = -np.inf
        tops = np.maximum.reduceat(near[:, order], starts, axis=1) if repeated else near  # one score an id, however many rows it has
        border = -np.partition(-tops, min(k, tops.shape[1]) - 1, axis=1)[:, min(k, tops.shape[1]) - 1]
        for i, (scores, least) in enumerate(zip(near, border)):
            some = np.flatnonzero((scores >= least - 1e-9 * max(1.0, abs(least))) & (scores > -np.inf)) if least > -np.inf else np.flatnonzero(scores > -np.inf)
            exact = (rows[some] * queries[at + i]).sum(axis=1)  # the same rounding wherever the row lies
            first = first_of_each(ids[some], exact, k) if repeated else np.lexsort((ids[some], -exact))[:k]
            yield at + i, some[first], exact[first]


def _compare(k: int):
    """The k best rows of each query in one pair of blocks, over those of the block's parts that the query visits."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        queries, rows = left.combine_chunks(), right.combine_chunks()
        found: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {}
        if len(queries) and len(rows):
            query_ids, ids = queries["id"].to_numpy(), rows["id"].to_numpy()
            query_part, part = queries["part"].to_numpy(), rows["part"].to_numpy()
            of = lambda t, at: _matrix(t["vector"].take(pa.array(at)).combine_chunks())  # noqa: E731  vectors of one part have one width
            for p in np.unique(part).tolist():
                asked, own = np.flatnonzero(query_part == p), np.flatnonzero(part == p)
                if len(asked):
                    for i, at, scores in best(query_ids[asked], of(queries, asked), ids[own], of(rows, own), k):
                        found.setdefault(int(query_ids[asked[i]]), []).append((ids[own[at]], scores))
        out_q, out_v, out_s = [], [], []
        for q, parts in found.items():
            v, s = (np.concatenate(x) for x in zip(*parts, strict=True))
            first = first_of_each(v, s, k)
            out_q.append(np.full(len(first), q))
            out_v.append(v[first])
            out_s.append(s[first])
        join = lambda x, kind: np.concatenate(x).astype(kind) if x else np.zeros(0, dtype=kind)
        return pa.table({"query_id": join(out_q, np.int64), "vec_id": join(out_v, np.int64), "score": join(out_s, np.float64)})

    return run


def bundles(rows_in: dict[int, int], queries_in: dict[int, int]) -> list[tuple[int, int, int, int]]:
    """(part, bundle, row blocks, query blocks): small parts share a bundle of at most ``BLOCK`` rows, large ones are split."""
    out: list[list[int]] = []
    bundle, held = -1, BLOCK
    asked: dict[int, int] = {}
    for part in sorted(rows_in):
        n = rows_in[part]
        if held + n > BLOCK:
            bundle, held = bundle + 1, 0
        held += n
        asked[bundle] = asked.get(bundle, 0) + queries_in.get(part, 0)
        out.append([part, bundle, max(1, math.ceil(n / BLOCK))])
    return [(part, bundle, blocks, max(1, math.ceil(asked[bundle] / BLOCK))) for part, bundle, blocks in out]


def _found(indexed: DataFrame, routed: DataFrame, k: int) -> DataFrame:
    """(query_id, vec_id, score) of the queries (id, vector, part) among the rows (id, vector, part) of their parts."""
    # A count of each part; pairs of row and query blocks are one task's each.
    count_of = lambda d: {r["part"]: r["count"] for r in d.groupBy("part").count().collect()}
    plan = bundles(count_of(indexed), count_of(routed))
    placed = lambda: F.broadcast(indexed.sparkSession.createDataFrame(plan, "part int, bundle int, rb int, qb int"))  # noqa: E731  a row a part, MOST_PARTS ** 2 at most and one a width
    split = lambda d, own, other: d.join(placed(), "part").withColumn(own, F.pmod(F.xxhash64("id"), F.col(own)).cast("int")).withColumn(other, F.explode(F.sequence(F.lit(0), F.col(other) - 1))).select("bundle", "rb", "qb", "id", "vector", "part")
    pairs = split(routed, "qb", "rb").groupBy("bundle", "rb", "qb").cogroup(split(indexed, "rb", "qb").groupBy("bundle", "rb", "qb"))
    found = pairs.applyInArrow(_compare(k), "query_id bigint, vec_id bigint, score double")
    return found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))  # rows may share an id


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 20, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """The k nearest found rows of each query: query_id, rank (from 1), vec_id, score.

    Nearness is the inner product in double precision of the vectors as they are; ties
    go to the smaller id; a query's own id is no candidate. A vector that is null,
    zero, or holds a null or non-finite component, and a row without an id, takes no
    part. A query's candidates are the vectors of its own length; the most frequent
    length is searched by learned partitions, all others are compared whole. Of rows
    with one id the vectors compete and the best stays. With fewer than 32 vectors all
    are compared. A query whose leaves hold fewer than k candidates is compared with all
    rows. Extra columns are ignored; an empty table gives an empty result.
    """
    ws = Workspace(vectors.sparkSession, "ann")
    usable = lambda d: d.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("vector")).where("id IS NOT NULL AND vector IS NOT NULL AND size(vector) > 0").where(F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("vector", lambda x: x != 0))
    rows, asked = ws.put(usable(vectors), "rows"), usable(queries)
    sizes = rows.groupBy(F.size("vector").alias("d")).agg(F.count("*").alias("count"), F.count_distinct("id").alias("ids")).orderBy(F.desc("count"), "d").limit(1).collect()
    width, count, distinct = (sizes[0]["d"], sizes[0]["count"], sizes[0]["ids"]) if sizes else (0, 0, 0)
    of_width = lambda d: d.where(F.size("vector") == width)
    tree = grow(of_width(rows), width, count, distinct, ws)
    schema = "id bigint, vector array<double>, part int"
    indexed = ws.put(rows.mapInArrow(_assign(tree, 1), schema), "indexed")
    probes = needed_leaves(tree, indexed, of_width(asked), k)
    found = ws.put(_found(indexed, ws.put(asked.mapInArrow(_assign(tree, probes), schema), "routed"), k), "found")
    got = found.groupBy("query_id").agg(F.count("*").alias("n"))
    short = ws.put(of_width(asked).join(got, F.col("id") == F.col("query_id"), "left").where(F.coalesce("n", F.lit(0)) < min(k, max(0, distinct - 1))).select("id", "vector"), "short")
    if not short.isEmpty():
        parts = [r["part"] for r in indexed.where("part >= 0").select("part").distinct().collect()]
        everywhere = short.withColumn("part", F.explode(F.array(*(F.lit(p).cast("int") for p in parts))))
        found = found.unionByName(_found(indexed.where("part >= 0"), everywhere, k)).groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
