"""Connected components of a link table, and a join that survives hot keys."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .workspace import Workspace

#: A key with more rows than this share of the table, and than this count, is hot.
HOT_SHARE, HOT_ROWS = 1 / 64, 10_000
#: Links that one task may hold.
ONE_TASK = 250_000


def _merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links (a, b) to (key, comp) of all their ends, by union and find."""
    links = pa.Table.from_batches(batches) if (batches := list(batches)) else None
    if links is None or not len(links):
        return
    ends = pa.chunked_array([*links["a"].chunks, *links["b"].chunks]).combine_chunks()
    named = ends.dictionary_encode()
    order = pc.sort_indices(named.dictionary)
    rank = np.empty(len(order), dtype=np.int64)
    rank[order.to_numpy()] = np.arange(len(order))
    at = rank[named.indices.to_numpy(zero_copy_only=False)].tolist()
    root = list(range(len(order)))  # the smallest key of a component is its root

    def top(x: int) -> int:
        while root[x] != x:
            root[x] = x = root[root[x]]
        return x

    for x, y in zip(at[: len(links)], at[len(links) :], strict=True):
        x, y = top(x), top(y)
        root[max(x, y)] = min(x, y)
    keys = named.dictionary.take(order)
    yield pa.RecordBatch.from_arrays([keys, keys.take(pa.array([top(x) for x in range(len(root))]))], ["key", "comp"])


def connected_components(links: DataFrame, ws: Workspace) -> DataFrame:
    """(key, comp) for every end of a link: comp is the smallest key of its component.

    ``links`` has columns a and b of one orderable type; repeated links, self-links
    and an empty table are fine. Large-star and small-star steps alternate until the
    link table no longer changes or one task can hold it and finishes by union and find;
    nothing but one count and one checksum reaches the driver.
    """
    pair = lambda x, y: (F.least(x, y).alias("a"), F.greatest(x, y).alias("b"))
    edges = stored = ws.put(links.where("a != b").select(*pair(F.col("a"), F.col("b"))).distinct(), "edges")
    mark = None
    while (now := tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())) != mark and now[0]:
        mark = now
        if now[0] <= ONE_TASK:
            kind = edges.schema["a"].dataType.simpleString()
            return ws.put(edges.coalesce(1).mapInArrow(_merged, f"key {kind}, comp {kind}"), "components")
        both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.greatest("v", "m").alias("u"), F.least("v", "m").alias("v")).where("u != v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where("v != m").select(F.col("v").alias("a"), F.col("m").alias("b")).unionByName(least.select(F.col("u").alias("a"), F.col("m").alias("b")))
        newer = ws.put(small.select(*pair(F.col("a"), F.col("b"))).distinct(), "edges")
        ws.drop(stored)
        edges = stored = newer
    return edges.select(F.col("b").alias("key"), F.col("a").alias("comp")).unionByName(edges.select(F.col("a").alias("key"), F.col("a").alias("comp")).distinct())


def join_hot(left: DataFrame, right: DataFrame, key: str, rows: int) -> DataFrame:
    """Left join of a written table of ``rows`` rows to ``right``, which has each key once.

    Keys that hold more than 1/64 of the rows number at most 64, so their rows of
    ``right`` are broadcast and the others are joined by sort-merge.
    """
    limit = max(HOT_ROWS, int(rows * HOT_SHARE))
    hot = [r[0] for r in left.groupBy(key).count().where(F.col("count") > limit).select(key).collect()] if rows > limit else []
    if not hot:
        return left.join(right, key, "left")
    is_hot = F.coalesce(F.col(key).isin(hot), F.lit(False))
    return left.where(~is_hot).join(right.where(~is_hot), key, "left").unionByName(left.where(is_hot).join(F.broadcast(right.where(is_hot)), key, "left"))
