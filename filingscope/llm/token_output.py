"""Training-order materialisation of token sequences as fixed-stride binary shards.

Every text becomes ids cut into sequences. A sequence's number, by its place in the
input, is sent to a global slot by a keyed Feistel permutation with cycle-walking, so
the training order is a pseudorandom permutation that any task computes for itself.
Shards hold consecutive slots; each sequence takes one fixed stride, so slot s is found
at (s mod slots a shard) * stride without an index and reading resumes at any slot. A
shard file is written aside and renamed, so a task that runs again rewrites nothing.
"""

from __future__ import annotations

import json
import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tokens import word_ids
from .wordhash import U64, fmix
from .workers import bounded
from .workspace import Workspace

SEQUENCE, END_ID, PAD_ID, SHARD_SLOTS, KEY, ROUNDS = 512, 0, 0, 8192, 0x5EED, 6
#: Tasks that write; with more shards, each writes a range of them.
MOST_TASKS = 65_536


def feistel(at: np.ndarray, size: int, key: int = KEY) -> np.ndarray:
    """Places of ``at`` (below ``size``) in a keyed permutation of 0..size-1.

    A balanced Feistel network permutes the least even number of bits that hold
    ``size`` values; what lands beyond is sent on until it lands within.
    """
    half = max(1, math.ceil(max(1, (size - 1).bit_length()) / 2))
    mask, shift = U64((1 << half) - 1), U64(half)
    keys = [int(k) for k in np.random.default_rng(key).integers(0, 2**63, size=ROUNDS, dtype=np.int64)]

    def once(x: np.ndarray) -> np.ndarray:
        left, right = x >> shift, x & mask
        for k in keys:
            left, right = right, left ^ (fmix(right + U64(k)) & mask)
        return (left << shift) | right

    out = once(at.astype(np.uint64))
    while (far := np.flatnonzero(out >= size)).size:
        out[far] = once(out[far])
    return out.astype(np.int64)


def _counts(tokenizer_file: str, length: int):
    """Rows, sequences and a checksum of the ids of each input partition."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, rows, sequences, mark = word_ids(tokenizer_file), 0, 0, 0
        for batch in batches:
            mark = zlib.crc32(repr(batch.column(0).to_pylist()).encode(), mark)
            ids = table.counts(batch.column(1)) + 1
            rows += len(ids)
            sequences += int((-(-ids // length)).sum())
        yield pa.RecordBatch.from_arrays([pa.array([x], pa.int64()) for x in (TaskContext.get().partitionId(), rows, sequences, mark)], ["task", "rows", "sequences", "mark"])

    return bounded(run, keeps="words")


def _sequences(tokenizer_file: str, length: int, end_id: int, kind: str, plan: dict[int, tuple[int, int]], total: int, shard_slots: int, key: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, task, mark = word_ids(tokenizer_file), TaskContext.get().partitionId(), 0
        number, expected = plan.get(task, (0, 0))
        docs, pieces, records, lengths = [], [], [], []

        def flush() -> pa.RecordBatch:
            nonlocal number
            slots = feistel(np.arange(number, number + len(docs)), total, key)
            number += len(docs)
            out = pa.RecordBatch.from_arrays([pa.array(docs, pa.int64()), pa.array(pieces, pa.int32()), pa.array(slots), pa.array((slots // shard_slots).astype(np.int32)), pa.array(lengths, pa.int32()), pa.array(records, pa.binary())], ["doc_id", "piece", "slot", "shard", "length", "ids"])
            for x in (docs, pieces, records, lengths):
                x.clear()
            return out

        for batch in batches:
            mark = zlib.crc32(repr(batch.column(0).to_pylist()).encode(), mark)
            for doc, ids in zip(batch.column(0).to_pylist(), table.rows(batch.column(1), end_id), strict=True):
                raw, width = ids.astype(kind).tobytes(), np.dtype(kind).itemsize
                for k in range(math.ceil(len(ids) / length)):
                    part = raw[k * length * width : (k + 1) * length * width]
                    docs.append(doc)
                    pieces.append(k)
                    records.append(part)
                    lengths.append(len(part) // width)
                if len(docs) >= 8192:
                    yield flush()
        if docs:
            yield flush()
        if mark != expected:
            raise RuntimeError("the input's partitions changed between two reads; write the input to a table first")

    return bounded(run, keeps="words")


def _write(folder: str, stride: int, length: int, pad: bytes, shard_slots: int, total: int):
    """Writes each shard from its rows, which come in the order of their slots."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = fs.FileSystem.from_uri(folder)
        shard, out, path, upto = None, None, "", 0

        def close() -> None:
            out.close()
            store.move(f"{path}.{TaskContext.get().taskAttemptId()}", path)

        for batch in batches:
            shards, lengths, records = batch.column(3).to_pylist(), batch.column(4).to_pylist(), batch.column(5).to_pylist()
            sums = []
            for own, n, ids in zip(shards, lengths, records, strict=True):
                if own != shard:
                    if out is not None:
                        close()
                    shard, path = own, f"{root}/shard-{own:08d}.bin"
                    out = store.open_output_stream(f"{path}.{TaskContext.get().taskAttemptId()}")
                out.write(ids + pad * (length - n))
                sums.append(zlib.crc32(ids))
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], pa.array(sums, pa.int64())], ["doc_id", "piece", "slot", "shard", "length", "ids_crc32"])
        if out is not None:
            close()

    return run


def materialise(docs: DataFrame, tokenizer_file: str, folder: str | None = None, length: int = SEQUENCE, end_id: int = END_ID, pad_id: int = PAD_ID, shard_slots: int = SHARD_SLOTS, key: int = KEY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Write all sequences to shards and return one row for each: doc_id, piece, slot, shard, length, ids_crc32, position.

    ``docs`` must give the same rows in the same partitions each time it is read, as a
    table does; this is checked. Sequences of ``length`` ids (the last of a text may be
    shorter and is padded in the file) are numbered in input order. ``position`` is the
    byte at which the sequence lies in its shard; ``ids_crc32`` is that of its stored,
    unpadded ids (little-endian, 2 bytes each, or 4 if the vocabulary needs it). A null
    text is empty and has its closing id. Ids may be null or repeat; extra columns are
    ignored; an empty table writes a manifest and no shard. ``folder`` must be one that
    all executors reach (by default below the shared folder).
    """
    from tokenizers import Tokenizer

    spark = docs.sparkSession
    folder = folder or Workspace(spark, "shards").path
    kind = "<u2" if max(Tokenizer.from_file(tokenizer_file).get_vocab_size(), end_id + 1, pad_id + 1) <= 1 << 16 else "<u4"
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    tasks = sorted(tuple(r) for r in rows.mapInArrow(_counts(tokenizer_file, length), "task bigint, rows bigint, sequences bigint, mark bigint").collect())
    plan, total = {}, 0
    for task, _, sequences, mark in tasks:  # one entry for each input partition
        plan[task] = (total, mark)
        total += sequences
    stride = length * np.dtype(kind).itemsize
    store, root = fs.FileSystem.from_uri(folder)
    store.create_dir(root, recursive=True)
    with store.open_output_stream(f"{root}/manifest.json") as out:
        out.write(json.dumps({"sequences": total, "length": length, "dtype": kind, "stride": stride, "slots_a_shard": shard_slots, "shards": math.ceil(total / shard_slots), "pad_id": pad_id, "key": key}).encode())
    numbered = rows.mapInArrow(_sequences(tokenizer_file, length, end_id, kind, plan, max(total, 1), shard_slots, key), "doc_id bigint, piece int, slot bigint, shard int, length int, ids binary")
    shards = max(1, math.ceil(total / shard_slots))
    pad = np.array([pad_id], dtype=kind).tobytes()
    tasks_out = min(shards, MOST_TASKS)
    ranged = numbered.repartitionById(tasks_out, (F.col("shard").cast("long") * tasks_out / shards).cast("int")).sortWithinPartitions("slot")  # ranges of slots, without sampling the input
    written = ranged.mapInArrow(_write(folder, stride, length, pad, shard_slots, total), "doc_id bigint, piece int, slot bigint, shard int, length int, ids_crc32 bigint")
    # The shards are written here and once; what is returned is the index that came with them.
    return Workspace(spark, "slots").put(written.withColumn("position", F.col("slot") % shard_slots * stride), "index")


def read_slots(folder: str, first: int, count: int) -> np.ndarray:
    """The ids of ``count`` sequences from slot ``first`` on, one row each, padded."""
    store, root = fs.FileSystem.from_uri(folder)
    with store.open_input_stream(f"{root}/manifest.json") as f:
        plan = json.loads(f.read())
    out = []
    while count > 0 and first < plan["sequences"]:
        shard, at = divmod(first, plan["slots_a_shard"])
        n = min(count, plan["slots_a_shard"] - at, plan["sequences"] - first)
        with store.open_input_file(f"{root}/shard-{shard:08d}.bin") as f:
            f.seek(at * plan["stride"])
            out.append(np.frombuffer(f.read(n * plan["stride"]), dtype=plan["dtype"]).reshape(n, plan["length"]))
        first, count = first + n, count - n
    return np.concatenate(out) if out else np.zeros((0, plan["length"]), dtype=plan["dtype"])
