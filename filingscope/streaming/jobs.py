"""Streaming ingest and counts; checkpoints make each resumable."""

from __future__ import annotations

from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.ingest import newest, upsert


def ingest(spark: SparkSession, source: str, schema: str, target: str, checkpoint: str, keys: list[str], version: str, files_a_batch: int = 100) -> Any:
    """Take all new JSON files into a table of latest rows, and stop.

    A batch writes its own latest rows, as one delta, before the checkpoint moves on; if
    it runs again, it writes the same rows, so nothing is lost or doubled. ``compact``
    merges deltas, so a row is rewritten once in a while and not with each batch.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        upsert(batch.limit(0), batch, keys, version).write.mode("overwrite").parquet(f"{target}/delta={batch_id:010d}")

    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_a_batch).json(source)
    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def _generations(spark: SparkSession, target: str) -> tuple[str | None, list[str]]:
    """The newest complete base, and the complete deltas after it, in order."""
    jvm, conf = spark._jvm, spark._jsparkSession.sessionState().newHadoopConf()  # noqa: SLF001
    root = jvm.org.apache.hadoop.fs.Path(target)
    store = root.getFileSystem(conf)
    if not store.exists(root):
        return None, []
    paths = [f.getPath() for f in store.listStatus(root)]
    done = sorted((p.getName(), p.toString()) for p in paths if "=" in p.getName() and store.exists(jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS")))
    bases = [x for x in done if x[0].startswith("base=")]
    after = bases[-1][0].removeprefix("base=") if bases else ""
    return (bases[-1][1] if bases else None), [path for name, path in done if name.startswith("delta=") and name.removeprefix("delta=") > after]


def read_ingested(spark: SparkSession, target: str, keys: list[str], version: str) -> DataFrame:
    """The latest row of each key over the base and the deltas after it; of equal versions the later batch's."""
    base, deltas = _generations(spark, target)
    parts = [*([base] if base else []), *deltas]
    if not parts:
        raise FileNotFoundError(f"nothing was ingested to {target}")
    rows = [spark.read.parquet(path).withColumn("_part", F.lit(i)) for i, path in enumerate(parts)]
    both = rows[0]
    for more in rows[1:]:
        both = both.unionByName(more)
    return newest(both, keys, F.desc(version), F.desc("_part")).drop("_part")


def compact(spark: SparkSession, target: str, keys: list[str], version: str) -> None:
    """Merge the base and its deltas into a new base, and delete the deltas once it is written."""
    base, deltas = _generations(spark, target)
    if not deltas:
        return
    last = deltas[-1].rsplit("delta=", 1)[1]
    read_ingested(spark, target, keys, version).write.mode("overwrite").parquet(f"{target}/base={last}")
    jvm, conf = spark._jvm, spark._jsparkSession.sessionState().newHadoopConf()  # noqa: SLF001
    for old in deltas:
        path = jvm.org.apache.hadoop.fs.Path(old)
        path.getFileSystem(conf).delete(path, True)


def rate_counts(events: DataFrame, actor: str = "user_id", seconds: int = 60, late: str = "5 minutes") -> DataFrame:
    """Counts of each actor in tumbling windows; works on a stream and on a table alike."""
    events = events.withColumn("ts", F.col("ts").cast("timestamp"))
    marked = events.withWatermark("ts", late) if events.isStreaming else events
    return marked.groupBy(F.window("ts", f"{seconds} seconds"), F.col(actor).alias("actor")).agg(F.count("*").alias("n")).select(F.col("window.start").alias("window_start"), "actor", "n")


def daily_budget(writes: DataFrame, late: str = "1 day") -> DataFrame:
    """Writes and bytes by day."""
    writes = writes.withColumn("ts", F.col("ts").cast("timestamp"))
    marked = writes.withWatermark("ts", late) if writes.isStreaming else writes
    return marked.groupBy(F.window("ts", "1 day")["start"].alias("day")).agg(F.count("*").alias("writes"), F.sum("bytes").alias("bytes"))
