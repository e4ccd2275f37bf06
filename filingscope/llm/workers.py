"""Memory of the Python workers: batches cut by bytes, and freed memory given back."""

from __future__ import annotations

import ctypes
import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import SparkSession

#: Bytes of a batch that a function takes at once, unless one row has more.
SLICE_BYTES = 4 << 20

Batches = Iterator[pa.RecordBatch]

#: What this worker remembers between tasks, by name. A task that doesn't use it clears it, so no stage pays for another's.
KEPT: dict[str, dict] = {}


def release() -> None:
    """Give freed memory back to the system; workers live on between stages."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def forget(keeps: str | None) -> None:
    """Clear what this worker remembers under other names."""
    for name, kept in KEPT.items():
        if name != keeps:
            kept.clear()


def sliced(batches: Batches, most: int = SLICE_BYTES) -> Batches:
    """The batches in parts of about ``most`` bytes."""
    for batch in batches:
        rows = max(1, int(len(batch) * most / max(1, batch.nbytes)))
        for at in range(0, len(batch), rows):
            yield batch.slice(at, rows)


def small_batches(spark: SparkSession | None) -> None:
    """Batches of ``SLICE_BYTES`` at most on the JVM's side too, unless the session has them smaller."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark and not 0 < int(re.sub(r"\D", "", spark.conf.get(name))) <= SLICE_BYTES:
        spark.conf.set(name, str(SLICE_BYTES))


def bounded(run: Callable[[Batches], Batches], most: int = SLICE_BYTES, keeps: str | None = None) -> Callable[[Batches], Batches]:
    """``run`` over sliced batches; what a task has freed leaves the worker at its end, and what it doesn't keep at its begin."""
    small_batches(SparkSession.getActiveSession())

    def worker(batches: Batches) -> Batches:
        forget(keeps)
        try:
            yield from run(sliced(batches, most))
        finally:
            release()

    return worker
