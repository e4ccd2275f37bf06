"""Best-fit packing of token sequences, by hierarchical rounds.

A document longer than a sequence is cut into full ones and a rest. The pieces that fill
no sequence are dealt over groups, sixteen at least and each of bounded size, and each
group packs its own by best fit, longest first. Bins that are nearly full, or that no
piece of an underfull bin could complete, are final. The underfull ones are the items of the
next round: groups merge in a tree, and each packs the bins that it is left with by best
fit again, as they are or, if that takes fewer bins, taken apart into their pieces; until
one group is left or no bin can take another.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tokens import word_ids
from .workers import bounded, release
from .workspace import Workspace

LENGTH, END_ID = 2048, 0
#: Groups that pack by themselves at first, at least; items that a group packs at once; groups that merge into one.
LEAST_GROUPS, GROUP_ITEMS, FAN_IN = 16, 200_000, 4
#: A bin is nearly full if at most this share of it is free.
SLACK = 1 / 1024
#: Words whose ids a worker remembers; packing is one stage among others that share its memory.
TABLE_WORDS = 300_000
#: Pieces that a task holds before it writes them.
FLUSH_PIECES = 20_000


def best_fit(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bin and offset of each item, and the bins' fills. Longest first; ties by position."""
    order = np.argsort(-lengths, kind="stable").tolist()
    bins, offsets = np.zeros(len(lengths), dtype=np.int64), np.zeros(len(lengths), dtype=np.int64)
    fills: list[int] = []
    by_gap: list[list[int]] = [[] for _ in range(capacity + 1)]
    gaps = 0  # bit g: some bin has a gap of g
    for i, n in zip(order, lengths[order].tolist()):
        if fit := gaps >> n:
            gap = n + (fit & -fit).bit_length() - 1
            own = by_gap[gap]
            b = own.pop()
            if not own:
                gaps ^= 1 << gap
        else:
            b, gap = len(fills), capacity
            fills.append(0)
        bins[i], offsets[i] = b, fills[b]
        fills[b] += n
        if gap := gap - n:
            by_gap[gap].append(b)
            gaps |= 1 << gap
    return bins, offsets, np.array(fills, dtype=np.int64)


def _pieces(tokenizer_file: str, capacity: int, end_id: int):
    """(doc_id, text) to pieces; ``item`` numbers them over all tasks."""
    names = ["doc_id", "piece", "start", "length", "ids_crc32", "item"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = TaskContext.get().partitionId() << 36
        docs, pieces, lengths, sums = [], [], [], []

        def flush() -> pa.RecordBatch:
            nonlocal made
            piece = np.array(pieces, dtype=np.int32)
            out = [pa.array(docs, pa.int64()), pa.array(piece), pa.array(piece.astype(np.int64) * capacity), pa.array(lengths, pa.int64()), pa.array(sums, pa.int64()), pa.array(np.arange(made, made + len(piece)))]
            made += len(piece)
            for x in (docs, pieces, lengths, sums):
                x.clear()
            return pa.RecordBatch.from_arrays(out, names)

        table = word_ids(tokenizer_file, TABLE_WORDS)
        for batch in batches:
            for doc, ids in zip(batch.column(0).to_pylist(), table.rows(batch.column(1), end_id), strict=True):
                raw = ids.astype("<u4").tobytes()
                for k in range(math.ceil(len(ids) / capacity)):
                    part = raw[4 * k * capacity : 4 * (k + 1) * capacity]
                    docs.append(doc)
                    pieces.append(k)
                    lengths.append(len(part) // 4)
                    sums.append(zlib.crc32(part))
                if len(docs) >= FLUSH_PIECES:
                    yield flush()
        yield flush()

    return bounded(run, keeps="words")


def merged(bins: np.ndarray, places: np.ndarray, sizes: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Best fit of underfull bins, given by their items' bins, places in them and sizes: bin and offset of each item, and the fills.

    Bins go in whole, or as their items where that takes fewer; each item may be a bin of its own.
    """
    own, at = np.unique(bins, return_inverse=True)
    first = np.full(len(own), capacity)
    np.minimum.at(first, at, places)  # a bin that was cut in two goes on as two
    held = np.bincount(at, sizes, len(own)).astype(np.int64)
    whole = best_fit(held, capacity)
    apart = best_fit(sizes, capacity) if len(own) < len(sizes) else whole
    if len(apart[2]) < len(whole[2]):
        return apart
    return whole[0][at], whole[1][at] + places - first[at], whole[2]


def _fit(capacity: int):
    """Best fit of each group's items: the rows with bin, offset and the bin's fill. Rows of one group follow each other.

    A bin is named by the item at its start. A group of more than ``GROUP_ITEMS`` is
    packed in parts.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def flush() -> Iterator[pa.RecordBatch]:
            rows = pa.Table.from_batches(held)
            held.clear()
            items = rows["item"].to_numpy()
            bins, offsets, fills = merged(rows["bin"].to_numpy(), rows["offset"].to_numpy(), rows["size"].to_numpy(), capacity)
            names = np.zeros(len(fills), dtype=np.int64)
            names[bins[offsets == 0]] = items[offsets == 0]
            for name, values in (("bin", names[bins]), ("offset", offsets), ("fill", fills[bins])):
                rows = rows.set_column(rows.schema.get_field_index(name), name, pa.array(values))
            yield from rows.combine_chunks().to_batches()

        for batch in batches:
            groups = batch.column("group").to_numpy(zero_copy_only=False)
            cuts = [0, *(np.flatnonzero(np.diff(groups)) + 1).tolist(), len(groups)]
            for lo, hi in zip(cuts, cuts[1:]):
                if lo == hi:
                    continue
                if held and (held[-1].column("group")[-1].as_py() != groups[lo] or sum(map(len, held)) >= GROUP_ITEMS):
                    yield from flush()
                held.append(batch.slice(lo, hi - lo))
        if held:
            yield from flush()
        release()

    return run


def _round(items: DataFrame, groups: int, capacity: int) -> DataFrame:
    """``items`` (item, size, group, bin, offset, fill) packed: each group by itself."""
    return items.repartition(groups, "group").sortWithinPartitions("group", "bin", "offset").mapInArrow(_fit(capacity), items.schema)


def pack_documents(docs: DataFrame, tokenizer_file: str, capacity: int = LENGTH, end_id: int = END_ID, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    A null text is empty and still has its closing id. Ids may be null or repeat; each
    row is packed. Extra columns are ignored; an empty table gives an empty result.
    """
    ws = Workspace(docs.sparkSession, "pack")
    columns = ["doc_id", "piece", "start", "length", "ids_crc32"]
    schema = "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint, item bigint"
    pieces = ws.put(docs.select(F.col(id_col).cast("long"), F.col(text_col).cast("string")).mapInArrow(_pieces(tokenizer_file, capacity, end_id), schema), "pieces")
    short = pieces.where(F.col("length") < capacity)
    groups = max(LEAST_GROUPS, math.ceil(short.count() / GROUP_ITEMS))
    zero = F.lit(0).cast("long")
    items = short.select("item", F.col("length").alias("size"), F.pmod(F.xxhash64("item"), F.lit(groups)).cast("int").alias("group"), F.col("item").alias("bin"), zero.alias("offset"), zero.alias("fill"))
    packed = ws.put(_round(items, groups, capacity), "packed")
    done = []  # items of final bins: those of each round
    while groups > 1:
        free = capacity - F.col("fill")
        least = packed.where(free > capacity * SLACK).agg(F.min("size")).first()[0]
        underfull = (free > capacity * SLACK) & (free >= F.lit(least))
        open_ = packed.where(underfull) if least is not None else packed.limit(0)
        fewer = max(math.ceil(groups / FAN_IN), math.ceil(open_.count() / GROUP_ITEMS))
        if least is None or fewer >= groups:
            break  # as many groups would pack the same bins again
        groups = fewer
        done.append(packed.where(~underfull))
        packed = ws.put(_round(open_.withColumn("group", F.pmod("group", F.lit(groups)).cast("int")), groups, capacity), "merged")
    for more in done:
        packed = packed.unionByName(more)
    named = [*columns, F.col("bin").alias("sequence_id"), "offset"]
    out = short.join(packed.select("item", "bin", "offset"), "item").select(*named)
    full = pieces.where(F.col("length") == capacity).withColumn("bin", F.col("item")).withColumn("offset", zero)
    return out.unionByName(full.select(*named))
