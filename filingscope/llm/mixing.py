"""Mixing sources to target weights by drawing fixed-length blocks of words.

Each source's documents, in a fixed order, form one stream of words that is packed into
blocks. The number of blocks that each source gives in all follows from its target. They
fall to the output shards by multinomial counts, drawn for a source over the shards rather
than for a shard over the sources: the totals are met exactly and no step holds a table of
shards and sources, but shards differ in size. A source's k-th draw takes, in pass k div n over its n
blocks, the block that a pseudorandom permutation of that pass sends k mod n to. The
drawn slots are then joined to the blocks by index.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from .components import join_hot
from .wordhash import IS_SPACE, segments, string_buffers, word_bounds
from .workers import bounded
from .workspace import Workspace, whole_row

#: Words in a block; smaller sources have shorter ones, so that each has about 256.
BLOCK_WORDS, LEAST_BLOCKS = 2048, 256
MAX_REPEATS, MAX_SHARDS, SHARD_BLOCKS, ROUNDS = 3, 4096, 1024, 24
#: Rows of one window partition when positions in a stream are summed up.
CHUNK_ROWS = 20_000
#: The plan of the sources is broadcast if there are no more of them; they are numbered in ranges of so many.
BROADCAST_SOURCES = RANGE_SOURCES = 100_000


def _sizes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        data, offsets = string_buffers(batch.column(2))
        sizes = np.zeros(len(batch), dtype=np.int64)
        for group in segments(data, offsets):
            *_, counts = word_bounds(data, group)
            np.add.at(sizes, [row for row, _, _ in group], counts)
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(sizes), batch.column(3)], ["doc_id", "source", "size", "mark"])


def level(sources: DataFrame, budget: float) -> float | None:
    """What a weight of 1 gets of ``budget`` if no source (weight, cap) gets more than its cap; None if all get theirs.

    Each round shares out what the capped sources leave; the level rises until no
    further one is over its cap. Only sums reach the driver.
    """
    share, capped = 0.0, -1
    while True:
        over = F.col("cap") < share * F.col("weight")
        now = sources.agg(F.count_if(over).alias("n"), F.coalesce(F.sum(F.when(over, F.col("cap"))), F.lit(0.0)).alias("gone"), F.coalesce(F.sum(F.when(~over, F.col("weight"))), F.lit(0.0)).alias("weight")).first()
        if now["n"] == capped:
            return share
        if not now["weight"]:
            return None
        share, capped = max(share, (budget - now["gone"]) / now["weight"]), now["n"]


def numbered(sources: DataFrame, rows: int, ws: Workspace) -> DataFrame:
    """``sources`` with ``no`` from 0, by code point and null last: ranges are numbered by themselves, each from its first number."""
    order = (F.col("source").isNull(), F.col("source"))
    ranges = max(1, math.ceil(rows / RANGE_SOURCES))
    cut = ws.put(sources.repartitionByRange(ranges, *order).withColumn("range", F.spark_partition_id()), "ranges")
    before = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    base = cut.groupBy("range").count().withColumn("base", F.coalesce(F.sum("count").over(before), F.lit(0))).drop("count")
    within = Window.partitionBy("range").orderBy(*order)
    return cut.join(F.broadcast(base), "range").withColumn("no", F.col("base") + F.row_number().over(within) - 1).drop("range", "base")  # a row a range


def _draws(shards: int, seed: int):
    """(no, owed) to (shard, no, first draw, draws): a source's owed blocks fall to the shards by a multinomial, so its total is met exactly."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for no, owed in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                counts = np.random.default_rng([seed, no]).multinomial(owed, np.full(shards, 1 / shards))
                shard = np.flatnonzero(counts)
                draws = counts[shard]
                yield pa.RecordBatch.from_arrays([pa.array(shard.astype(np.int32)), pa.array(np.full(len(shard), no)), pa.array(np.cumsum(draws) - draws), pa.array(draws)], ["shard", "no", "first", "draws"])

    return run


def permuted(at: Column, size: Column, *key: Column) -> Column:
    """The place of ``at`` in a pseudorandom permutation of 0..size-1: a swap-or-not network keyed by ``key``."""

    def step(x: Column, r: Column) -> Column:
        other = F.pmod(F.xxhash64(*key, r) - x, size)
        return F.when(F.xxhash64(*key, r, F.greatest(x, other)) % 2 == 0, other).otherwise(x)

    return F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), at.cast("long"), step)


class Mix:
    """The plan of one mix: sources, documents with their place in a stream, drawn slots."""

    def __init__(self, docs: DataFrame, weights: dict[str | None, float] | None = None, budget_share: float = 1.0, block_words: int = BLOCK_WORDS, seed: int = 20240601, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source"):
        """Without ``weights``, sources by code point, null last, weigh 1, 2, 3 and so on again."""
        spark = docs.sparkSession
        self.ws = ws = Workspace(spark, "mix")
        cols = [F.col(id_col).cast("long").alias("doc_id"), F.col(source_col).cast("string").alias("source"), F.col(text_col).cast("string").alias("text")]
        self.sizes = ws.put(docs.select(*cols, F.xxhash64(F.col(text_col).cast("string")).alias("mark")).mapInArrow(bounded(_sizes), "doc_id bigint, source string, size bigint, mark bigint"), "sizes")
        found = ws.put(self.sizes.groupBy("source").agg(F.sum("size").alias("size"), F.count("*").alias("n")), "sources")
        n, self.rows, words = found.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum("size"), F.lit(0))).first()
        own = F.col("no") % 3 + 1.0
        if weights is not None:
            given = [F.lit(x) for k, v in weights.items() if k is not None for x in (k, float(v))]
            own = F.coalesce(F.try_element_at(F.create_map(*given), F.col("source")) if given else F.lit(None), F.when(F.col("source").isNull(), float(weights.get(None, 0))), F.lit(0.0))
        weighed = ws.put(numbered(found, n, ws).withColumn("weight", own).withColumn("cap", MAX_REPEATS * F.col("size").cast("double")), "weights")
        share = level(weighed, budget_share * words) if n else 0.0
        target = F.col("cap") if share is None else F.least(F.col("cap"), share * F.col("weight"))
        sized = weighed.withColumn("target", target).withColumn("words", F.greatest(F.lit(1), F.least(F.lit(block_words), F.ceil(F.col("size") / LEAST_BLOCKS))).cast("long"))
        sized = sized.withColumn("blocks", F.ceil(F.col("size") / F.col("words")).cast("long"))
        owed = F.when(F.col("size") > 0, F.least(MAX_REPEATS * F.col("blocks"), F.rint(F.col("target") * F.col("blocks") / F.col("size")).cast("long"))).otherwise(0)
        plan = ws.put(sized.select("no", "source", F.col("size").alias("source_size"), "target", "words", "blocks", owed.cast("long").alias("owed")), "plan")
        total = plan.agg(F.coalesce(F.sum("owed"), F.lit(0))).first()[0]
        #: A row a source; broadcast if a count has shown that they are few.
        self.few = n <= BROADCAST_SOURCES
        self.sources = F.broadcast(plan) if self.few else plan
        shards = max(1, math.ceil(total / max(SHARD_BLOCKS, math.ceil(total / MAX_SHARDS))))
        draws = plan.where("owed > 0").select("no", "owed").mapInArrow(_draws(shards, seed), "shard int, no bigint, first bigint, draws bigint")
        drawn = draws.select("shard", "no", F.explode(F.expr("sequence(first, first + draws - 1)")).alias("k")).join(self.sources.select("no", "blocks"), "no")
        #: Every slot of the mix: shard, no (the source's), k (its draw), block.
        self.slots = drawn.select("shard", "no", "k", permuted(F.col("k") % F.col("blocks"), F.col("blocks"), F.lit(seed), F.col("no"), F.floor(F.col("k") / F.col("blocks"))).alias("block"))

    def of_source(self, rows: DataFrame) -> DataFrame:
        """``rows`` with the plan's columns of their source; a source that holds many rows is split off where the plan isn't broadcast."""
        key = lambda d: d.withColumn("_key", F.concat(F.col("source").isNull().cast("string"), F.coalesce("source", F.lit(""))))
        plan = key(self.sources)
        if self.few:
            return key(rows).drop("source").join(F.broadcast(plan), "_key").drop("_key")
        return join_hot(self.ws.put(key(rows).drop("source"), "keyed"), plan, "_key", self.rows).drop("_key")

    def placed(self) -> DataFrame:
        """Documents with ``start``, their first word's place in the source's stream."""
        chunks = max(1, math.ceil(self.rows / CHUNK_ROWS))
        rows = self.of_source(self.sizes).withColumn("chunk", F.pmod(F.xxhash64("doc_id", "size", "mark"), F.lit(chunks)))
        before = Window.partitionBy("no").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
        totals = rows.groupBy("no", "chunk").agg(F.sum("size").alias("words_in")).withColumn("base", F.coalesce(F.sum("words_in").over(before), F.lit(0))).drop("words_in")
        inside = Window.partitionBy("no", "chunk").orderBy("doc_id", "size", "mark").rowsBetween(Window.unboundedPreceding, -1)
        rows = rows.withColumn("within", F.coalesce(F.sum("size").over(inside), F.lit(0)))
        return rows.join(totals, ["no", "chunk"]).withColumn("start", F.col("base") + F.col("within")).drop("base", "within", "chunk")

    def pieces(self) -> DataFrame:
        """One row for each block that a document reaches into and the times the block is drawn (0 too)."""
        times = self.slots.groupBy("no", "block").agg(F.count("*").alias("times"))
        span = F.sequence(F.floor(F.col("start") / F.col("words")), F.floor((F.col("start") + F.col("size") - 1) / F.col("words")))
        parts = self.placed().where("size > 0").withColumn("block", F.explode(span))
        low, high = F.greatest(F.col("start"), F.col("block") * F.col("words")), F.least(F.col("start") + F.col("size"), (F.col("block") + 1) * F.col("words"))
        return parts.withColumn("first", low - F.col("start")).withColumn("n", high - low).join(times, ["no", "block"], "left").withColumn("times", F.coalesce("times", F.lit(0)))

    def documents(self) -> DataFrame:
        """One row per document: doc_id, source, size, source_size, target, taken.

        ``size`` counts words (null: 0). ``taken`` counts the words that the mix takes,
        repeats counted. Rows with equal ids count each; a null source is a source. A
        table without words has targets and ``taken`` of 0.
        """
        keys = ["doc_id", "source", "size", "source_size", "target"]
        taken = self.pieces().groupBy("no", "start", "mark", *keys).agg(F.sum(F.col("n") * F.col("times")).alias("taken")).select(*keys, "taken")
        bare = self.of_source(self.sizes.where("size = 0")).select(*keys, F.lit(0).cast("long").alias("taken"))
        return taken.unionByName(bare)

    def fragments(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", chars_col: str | None = None) -> DataFrame:
        """The mix as rows of ``docs``: each run of a document's taken words is a row, once for each time it is taken.

        All columns stay, whatever their names; the text is the run's, with its white space,
        and ``chars_col`` its length. Rows equal in id, source and text pool what is taken of
        them. Ids and sources may be null; a null or wordless text has no run, and an empty
        table gives an empty one.
        """
        cuts = self.pieces().where("times > 0").groupBy("doc_id", "source", "mark").agg(F.sort_array(F.collect_list(F.struct("start", "first", "n", "times"))).alias("cuts"))
        # The user's columns travel as one, so no name of theirs meets one of ours.
        keyed = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(source_col).cast("string").alias("source"), F.xxhash64(F.col(text_col).cast("string")).alias("mark"), whole_row(docs))
        once = keyed.dropDuplicates(["doc_id", "source", "mark"])
        same = F.col("d.doc_id").eqNullSafe(F.col("c.doc_id")) & F.col("d.source").eqNullSafe(F.col("c.source")) & (F.col("d.mark") == F.col("c.mark"))
        joined = once.alias("d").join(cuts.alias("c"), same).select("cuts", F.col("row").getField(text_col).cast("string").alias("text"), "row")
        runs = joined.mapInArrow(bounded(_cut), T.StructType().add("text", "string").add(joined.schema["row"]))
        own = F.col("text").cast(docs.schema[text_col].dataType)
        out = runs.select(F.col("row").withField(text_col, own).alias("row"), F.length("text").alias("chars"))
        return (out.select(F.col("row").withField(chars_col, F.col("chars").cast(docs.schema[chars_col].dataType)).alias("row")) if chars_col else out).select("row.*")


def _runs(cuts: list[dict]) -> Iterator[tuple[int, int]]:
    """(first word, end word) of each run, for each time it is taken."""
    by_copy: dict[int, list[dict]] = {}
    for c in cuts:
        by_copy.setdefault(c["start"], []).append(c)
    for own in by_copy.values():
        for r in range(max(c["times"] for c in own)):
            first = end = None
            for c in (c for c in own if c["times"] > r):
                if c["first"] != end:
                    if end is not None:
                        yield first, end
                    first = c["first"]
                end = c["first"] + c["n"]
            if end is not None:
                yield first, end


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(cuts, text, row) to (text, row): one for each run of words that is taken."""
    for batch in batches:
        at, texts, held = [], [], 0
        made = lambda: pa.RecordBatch.from_arrays([pa.array(texts, pa.string()), batch.column(2).take(pa.array(at, pa.int64()))], ["text", "row"])  # noqa: B023, E731
        for i, own in enumerate(batch.column(0).to_pylist()):
            raw = batch.column(1)[i].as_py().encode()
            solid = np.concatenate([[False], ~IS_SPACE[np.frombuffer(raw, np.uint8)], [False]])
            edges = np.flatnonzero(solid[1:] != solid[:-1])
            starts, ends = edges[::2], edges[1::2]
            for first, end in _runs(own):
                at.append(i)
                texts.append(raw[starts[first] : ends[end - 1]].decode())
                held += len(texts[-1])
                if held > 1 << 24:
                    yield made()
                    at, texts, held = [], [], 0
        yield made()
