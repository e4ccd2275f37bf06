"""Near-duplicate groups by a chosen-path set similarity join.

A document's set holds the distinct word shingles of its whole text. Documents with
equal sets are one vertex. Each of ``TREES`` independent trees sends a vertex to the
node named by one minwise token. A node of at most ``NODE_LIMIT`` vertices is compared
exhaustively; a larger one branches each vertex by ``BRANCH`` further minwise tokens,
chosen by the node's path, and so on down to ``MAX_DEPTH``, after which it is compared
block by block. A link of similarity s stays together in a tree with probability s at
the root and 1 - (1 - s)**BRANCH at each further level, so ten trees miss one of 0.8
in about 1e-6 of cases at most. Comparisons go by size and by 128 minwise bytes, which
a true link fails in under 1e-8 of cases. What passes joins documents into clusters;
in a cluster every pair that passes is decided on the full sets.

Before that, each vertex is compared with one leader of each of its nodes. So a large
group of copies is linked in a linear number of comparisons, and only nodes in which
more than one component is left go on. No step writes all pairs of a group: nodes and
clusters give at most one row for each of their members.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .components import connected_components, join_hot
from .wordhash import U64, row_words, shingle_set
from .workers import bounded, release
from .workspace import Workspace

TREES, COORDINATES = 10, 128
NODE_LIMIT, BRANCH, MAX_DEPTH = 2048, 2, 3
#: Shingles that a task compares with as many others at once; larger clusters are split into blocks.
BLOCK_ITEMS = 1 << 21
#: Standard deviations by which a link's agreement may fall short of its mean.
SLACK = 6.4

_A = np.random.default_rng(7).integers(1, 2**63, size=COORDINATES, dtype=np.uint64) | U64(1)


def minwise(items: np.ndarray) -> np.ndarray:
    """For each coordinate, the least value of a linear hash over the set."""
    best = (items[:4096, None] * _A).min(axis=0)
    for at in range(4096, len(items), 4096):
        np.minimum(best, (items[at : at + 4096, None] * _A).min(axis=0), out=best)
    return best


def set_key(items: np.ndarray) -> bytes:
    return xxhash.xxh3_128_digest(items.tobytes())


def _features(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, sizes, roots, sigs = [], [], [], []
            for words in row_words(batch.column(1)):
                items = shingle_set(words, k)
                sizes.append(len(items))
                if len(items):
                    tokens = minwise(items)
                    keys.append(set_key(items))
                    roots.append(tokens[:TREES].view(np.int64))
                    sigs.append(((tokens * U64(0xC4CEB9FE1A85EC53)) >> U64(56)).astype(np.uint8).tobytes())
                else:
                    keys.append(None)
                    roots.append(None)
                    sigs.append(None)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(keys, pa.binary()), pa.array(sizes, pa.int64()), pa.array(roots, pa.list_(pa.int64())), pa.array(sigs, pa.binary())], ["id", "key", "n", "roots", "sig"])

    return bounded(run)


def _wanted_sets(k: int, bits: int, filters: dict[int, bytes]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        have = np.zeros(bits, dtype=bool)
        for bucket, bitmap in filters.items():
            have[bucket * 32768 : (bucket + 1) * 32768] = np.unpackbits(np.frombuffer(bitmap, np.uint8), bitorder="little")[:32768]
        for batch in batches:
            wanted = batch.filter(pa.array(have[batch.column(0).to_numpy(zero_copy_only=False)]))
            keys, sets = [], []
            for words in row_words(wanted.column(1)):
                items = shingle_set(words, k)
                if len(items):
                    keys.append(set_key(items))
                    sets.append(items.view(np.int64))
                if sum(map(len, sets[-64:])) > 1 << 20 or len(sets) >= 1024:
                    yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), pa.array(sets, pa.list_(pa.int64()))], ["key", "items"])
                    keys, sets = [], []
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), pa.array(sets, pa.list_(pa.int64()))], ["key", "items"])

    return bounded(run)


def _id_hash(bits: int):
    return F.pmod(F.coalesce(F.xxhash64("id"), F.lit(0)), F.lit(bits))


def full_sets(docs: DataFrame, vertices: DataFrame, keys: DataFrame, k: int, ws: Workspace) -> DataFrame:
    """(key, items) of the vertices among ``keys``, and perhaps of some others.

    ``docs`` has id and text; ``vertices`` has key and id, a document with that set.
    A bitmap of bounded size (at most 2**27 bits, whatever the input) spares the others'
    sets the shuffle; beyond its capacity it only spares less.
    """
    spot = ws.put(vertices.select("key", "id").join(keys, "key", "left_semi"), "wanted")
    bits = 1 << min(27, max(17, math.ceil(math.log2(16 * spot.count() + 1))))
    spot = spot.select(_id_hash(bits).alias("h")).select((F.col("h") / 32768).cast("int").alias("bucket"), (F.col("h") % 32768).alias("at"))
    filters = {r[0]: bytes(r[1]) for r in spot.groupBy("bucket").agg(F.expr("bitmap_construct_agg(at)")).collect()}
    return ws.put(docs.select(_id_hash(bits).alias("h"), "text").mapInArrow(_wanted_sets(k, bits, filters), "key binary, items array<bigint>"), "sets").dropDuplicates(["key"])


def confirm(docs: DataFrame, vertices: DataFrame, pairs: DataFrame, k: int, percent: int, ws: Workspace) -> DataFrame:
    """Those of the pairs (a, b of vertex keys) whose full sets reach the similarity."""
    pairs = ws.put(pairs.select("a", "b"), "pairs")
    ends = pairs.select(F.col("a").alias("key")).unionByName(pairs.select(F.col("b").alias("key"))).distinct()
    sets = full_sets(docs, vertices, ends, k, ws)
    found = pairs.join(sets.select(F.col("key").alias("a"), F.col("items").alias("xs")), "a").join(sets.select(F.col("key").alias("b"), F.col("items").alias("ys")), "b")
    common = F.size(F.array_intersect("xs", "ys"))
    return ws.put(found.withColumn("common", common).where(100 * F.col("common") >= percent * (F.size("xs") + F.size("ys") - F.col("common"))).select("a", "b"), "links")


def _min_agreement(percent: int) -> int:
    p = percent / 100
    return max(1, math.floor(COORDINATES * p - SLACK * math.sqrt(COORDINATES * p * (1 - p))))


def _sig_pairs(least: int):
    """Agreement of the two signatures of each row; rows below ``least`` go."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y = (np.frombuffer(b"".join(batch.column(i).to_pylist()), np.uint8).reshape(-1, COORDINATES) for i in (2, 3))
            agree = (x == y).sum(axis=1)
            keep = np.flatnonzero(agree >= least)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(keep)), batch.column(1).take(pa.array(keep)), pa.array(agree[keep], pa.int32())], ["a", "b", "agree"])

    return run


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """The rows of each value of the first column; rows of one value follow each other."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        nodes = batch.column(0).to_numpy(zero_copy_only=False)
        cuts = [0, *(np.flatnonzero(nodes[1:] != nodes[:-1]) + 1).tolist(), len(nodes)]
        for lo, hi in zip(cuts, cuts[1:]):
            if lo < hi:
                if held and held[-1].column(0)[-1].as_py() != nodes[lo]:
                    yield pa.Table.from_batches(held)
                    held = []
                held.append(batch.slice(lo, hi - lo))
    if held:
        yield pa.Table.from_batches(held)


class _Members:
    """Sizes, signatures, sides and components of a node's members; a link merges components."""

    def __init__(self, rows: pa.Table, least: int, percent: int):
        self.keys = rows["key"].to_pylist()
        self.sig = np.frombuffer(b"".join(rows["sig"].to_pylist()), np.uint8).reshape(-1, COORDINATES)
        self.size, self.side = rows["n"].to_numpy(), rows["side"].to_numpy()
        number: dict[bytes, int] = {}
        self.comp = np.array([number.setdefault(c, len(number)) for c in rows["comp"].to_pylist()])
        self.across, self.least, self.percent = self.side.min() != self.side.max(), least, percent

    def near(self, i: int) -> np.ndarray:
        """Later members of other components that size and signature allow to be linked with ``i``; with two sides, only across them."""
        may = self.comp[i + 1 :] != self.comp[i]
        if self.across:
            may &= self.side[i + 1 :] != self.side[i]
        may &= (100 * np.minimum(self.size[i + 1 :], self.size[i]) >= self.percent * np.maximum(self.size[i + 1 :], self.size[i]))
        at = i + 1 + np.flatnonzero(may)
        return at[(self.sig[at] == self.sig[i]).sum(axis=1) >= self.least] if len(at) else at

    def merge(self, i: int, others: np.ndarray) -> list[int]:
        """Merge the components of ``others`` into that of ``i``; one member of each."""
        comps, first = np.unique(self.comp[others], return_index=True)
        self.comp[np.isin(self.comp, comps)] = self.comp[i]
        return others[first].tolist()


def _link_rows(members: _Members, decide) -> pa.RecordBatch:
    a, b = [], []
    if members.comp.max(initial=0) > 0:
        for i in range(len(members.keys) - 1):
            near = members.near(i)
            if len(near):
                near = decide(i, near)
            if len(near):
                for j in members.merge(i, near):
                    a.append(members.keys[i])
                    b.append(members.keys[j])
    return pa.RecordBatch.from_arrays([pa.array(a, pa.binary()), pa.array(b, pa.binary())], ["a", "b"])


def _node_pairs(least: int, percent: int):
    """Links of each node's (node, key, n, sig, comp, side) that may be true, one for each two components that they join."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _groups(batches):
            yield _link_rows(_Members(rows, least, percent), lambda i, near: near)
        release()

    return run


def _cluster_links(least: int, percent: int):
    """True links of each cluster block's (node, key, n, sig, comp, side, items), one for each two components that they join."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _groups(batches):
            members = _Members(rows, least, percent)
            lists = rows["items"].combine_chunks()
            lists = lists.chunk(0) if isinstance(lists, pa.ChunkedArray) else lists
            _, place = np.unique(lists.flatten().to_numpy(), return_inverse=True)
            ends = np.cumsum(members.size)
            starts = ends - members.size
            mark = np.zeros(int(place.max(initial=0)) + 1, dtype=np.int32)

            def decide(i: int, near: np.ndarray) -> np.ndarray:
                own = place[starts[i] : ends[i]]
                mark[own] = 1
                size = members.size[near]
                first = np.cumsum(size) - size
                spots = place[np.repeat(starts[near] - first, size) + np.arange(int(size.sum()))]
                common = np.add.reduceat(mark[spots], first)
                mark[own] = 0
                return near[100 * common >= percent * (size + members.size[i] - common)]

            yield _link_rows(members, decide)
        release()

    return run


def _blocks(rows: DataFrame, blocks: Column) -> DataFrame:
    """Rows of a node that is split into ``blocks``: once for each pair of blocks that they are in, with their own as ``side``."""
    side = F.when(blocks > 1, F.pmod(F.xxhash64("key"), blocks)).otherwise(0).cast("int")
    rows = rows.withColumn("side", side).withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1)))
    return rows.withColumn("node", F.when(blocks > 1, F.xxhash64("node", F.least("side", "other"), F.greatest("side", "other"))).otherwise(F.col("node")))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle_words: int = 5, percent: int = 80) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id, kept.

    Words are maximal runs of bytes other than 0x20 and 0x09-0x0D after lower-casing
    A-Z. Two documents are linked if 100 * |common| >= percent * |union| of their sets;
    component_id is the smallest id reachable over links. A null or blank text has the
    empty set, is linked with nothing and is kept. Rows with equal ids are returned
    each; the smallest id ignores null ids, and rows without an id are never kept
    unless nothing else is in their component (then component_id is null and kept
    false). Extra columns are ignored. An empty table gives an empty result.
    """
    ws = Workspace(docs.sparkSession, "near")
    docs = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    feats = ws.put(docs.mapInArrow(_features(shingle_words), "id bigint, key binary, n bigint, roots array<bigint>, sig binary"), "features")
    full = feats.where("n > 0")
    ids = full.groupBy("key").agg(F.min("id").alias("id"))
    vertices = ws.put(full.dropDuplicates(["key"]).drop("id").join(ids, "key"), "vertices")
    least = _min_agreement(percent)
    fits = lambda x, y: 100 * F.least(x, y) >= percent * F.greatest(x, y)

    # The trees' first level, and one leader a node.
    members = vertices.select("key", F.posexplode("roots").alias("tree", "token")).select(F.xxhash64("tree", "token").alias("node"), "key")
    nodes = members.groupBy("node").agg(F.count("*").alias("members"), F.min(F.struct(F.xxhash64("key", "node").alias("h"), "key"))["key"].alias("leader")).where("members > 1")
    nodes = ws.put(members.join(nodes, "node"), "nodes")
    sigs = vertices.select("key", "n", "sig")
    named = lambda x: sigs.select(F.col("key").alias(x), F.col("n").alias(f"n{x}"), F.col("sig").alias(f"s{x}"))
    star = nodes.where("key != leader").select(F.col("key").alias("a"), F.col("leader").alias("b")).distinct()
    star = star.join(named("a"), "a").join(named("b"), "b").where(fits(F.col("na"), F.col("nb"))).select("a", "b", "sa", "sb").mapInArrow(_sig_pairs(least), "a binary, b binary, agree int")
    star = star.groupBy("a").agg(F.max(F.struct("agree", "b"))["b"].alias("b"))
    links = confirm(docs, vertices, star, shingle_words, percent, ws)
    labels = connected_components(links, ws)

    # Nodes with several components: compare small ones, branch large ones.
    found = None
    level = nodes.select("node", "key").join(labels, "key", "left").withColumn("comp", F.coalesce("comp", "key"))
    for depth in range(MAX_DEPTH + 1):
        if depth:
            start, step = F.pmod(F.xxhash64("node", F.lit(depth)), F.lit(COORDINATES - TREES)), 5  # 5 and 118 have no common factor
            spots = F.transform(F.sequence(F.lit(0), F.lit(BRANCH - 1)), lambda j: (TREES + 1 + F.pmod(start + step * j, F.lit(COORDINATES - TREES))).cast("int"))
            branches = large.join(sigs.select("key", "sig"), "key").select("node", "key", "comp", "sig", F.explode(spots).alias("at")).select(F.xxhash64("node", "at", F.expr("substring(sig, at, 1)")).alias("node"), "key", "comp")
            level = branches = ws.put(branches, f"branches{depth}")  # read twice below: BRANCH rows for each member, made once
        several = level.groupBy("node").agg(F.count("*").alias("members"), F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo < hi").select("node", "members")
        level = ws.put(level.join(several, "node"), f"level{depth}")
        if depth:
            ws.drop(branches)
        last = depth == MAX_DEPTH
        small = level if last else level.where(F.col("members") <= NODE_LIMIT)
        small = _blocks(small, F.ceil(F.col("members") / NODE_LIMIT).cast("int"))
        small = small.join(sigs, "key").select("node", "key", "n", "sig", "comp", "side").repartition("node").sortWithinPartitions("node")
        pairs = small.mapInArrow(_node_pairs(least, percent), "a binary, b binary")
        found = pairs if found is None else found.unionByName(pairs)
        large = level.where(F.col("members") > NODE_LIMIT)
        if last or large.isEmpty():
            break
    found = ws.put(found, "found")

    # Clusters of documents that passing comparisons hold together, each decided on the full sets.
    clusters = connected_components(links.unionByName(found), ws).withColumnRenamed("comp", "cluster").join(labels, "key", "left").withColumn("comp", F.coalesce("comp", "key"))
    several = clusters.groupBy("cluster").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo < hi").select("cluster")
    clusters = ws.put(clusters.join(several, "cluster"), "clusters")
    if not clusters.isEmpty():
        sets = full_sets(docs, vertices, clusters.select("key"), shingle_words, ws)
        held = clusters.join(sigs, "key").withColumn("node", F.xxhash64("cluster"))
        blocks = held.groupBy("cluster").agg(F.ceil(F.sum("n") / BLOCK_ITEMS).cast("int").alias("blocks"))
        held = _blocks(held.join(blocks, "cluster"), F.col("blocks")).join(sets, "key").select("node", "key", "n", "sig", "comp", "side", "items")
        links = links.unionByName(ws.put(held.repartition("node").sortWithinPartitions("node").mapInArrow(_cluster_links(least, percent), "a binary, b binary"), "links"))
        labels = connected_components(links, ws)

    named_comp = vertices.select("key", "id").join(labels, "key", "left").withColumn("comp", F.coalesce("comp", "key"))
    smallest = named_comp.groupBy("comp").agg(F.min("id").alias("component_id"))
    classes = ws.put(named_comp.join(smallest, "comp").select("key", "component_id"), "classes")
    out = join_hot(feats.select("id", "key", "n"), classes, "key", feats.count())
    component = F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("id"))
    return out.select(F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), component.alias("component_id"), F.coalesce(F.col("id") == component, F.lit(False)).alias("kept"))
