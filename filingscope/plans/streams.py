"""Queries that run as streams over landed batches, with a restart in between."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import render
from ..operators.shared import new_folder
from ..streaming import state
from .corpus import table
from .registry import query


def _streamed(spark: SparkSession, rows: DataFrame, parts: list[str], work: Callable[[DataFrame], DataFrame], mode: str = "append") -> DataFrame:
    """What ``work`` gives for ``rows`` that land part by part: the stream ends after each, and a new one goes on from its checkpoint."""
    state.use_rocksdb(spark)
    landed, out, checkpoint = (new_folder(spark, x) for x in ("landed", "out", "checkpoint"))
    for part in parts:
        rows.where(part).write.mode("append").parquet(landed)
        stream = work(spark.readStream.schema(rows.schema).parquet(landed))
        write = lambda batch, n: batch.write.mode("overwrite").parquet(f"{out}/{n}")
        stream.writeStream.foreachBatch(write).outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{out}/*")


OUTCOMES = ("doc_id % 4 AS shard", "b AS batch", "doc_id AS filing_id", "CASE WHEN (doc_id + b) % 11 = 0 THEN 'permanent' WHEN (n_chars + b) % 5 = 0 THEN 'resolved' ELSE 'failed' END AS outcome")
OUTCOME_SQL = f"outcomes AS (SELECT {', '.join(OUTCOMES)} FROM documents, (SELECT unnest([0, 1, 2, 3]) AS b) WHERE (doc_id + n_chars * b) % 3 < 2)"


@query(f"""WITH RECURSIVE {OUTCOME_SQL}, each AS (SELECT filing_id, batch, count(*) FILTER (outcome = 'failed') AS f, bool_or(outcome <> 'failed') AS cleared, bool_or(outcome = 'permanent') AS permanent FROM outcomes GROUP BY ALL),
st AS (SELECT DISTINCT filing_id, shard, -1 AS batch, 0 AS attempts, false AS unavailable FROM outcomes
UNION ALL SELECT st.filing_id, shard, st.batch + 1, CASE WHEN n >= 3 THEN 0 ELSE n END, unavailable OR n >= 3 OR coalesce(permanent, false) FROM (SELECT st.*, CASE WHEN coalesce(cleared, false) THEN 0 ELSE attempts END + coalesce(f, 0) AS n, permanent FROM st LEFT JOIN each ON each.filing_id = st.filing_id AND each.batch = st.batch + 1) AS st WHERE st.batch < 3)
SELECT filing_id, shard, CAST(attempts AS BIGINT) AS attempts, unavailable FROM st WHERE batch = 3""")
def failure_tracking(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Attempts and given-up filings after four batches of outcomes."""
    rows = table(spark, sf_dir, "documents").withColumn("b", F.explode(F.array(*map(F.lit, range(4))))).where("(doc_id + n_chars * b) % 3 < 2").selectExpr(*OUTCOMES).selectExpr("CAST(shard AS BIGINT) AS shard", "CAST(batch AS BIGINT) AS batch", "filing_id", "outcome")
    found = _streamed(spark, rows, ["batch = 0", "batch IN (1, 2)", "batch = 3"], state.track_failures, "update")
    last = F.max_by(F.struct("attempts", "unavailable"), "batch").alias("last")
    return found.groupBy("filing_id", "shard").agg(last).select("filing_id", "shard", "last.*")


SNAPSHOTS = ("user_id % 10 AS source", "ts", "CASE WHEN event_type = 'error' OR event_id % 4 = 0 THEN 'degraded' ELSE 'ok' END AS status", "CAST(event_id AS STRING) AS payload")
WEEKS = ["ts < '2024-01-09'", "ts >= '2024-01-09' AND ts < '2024-01-20'", "ts >= '2024-01-20'"]


@query(f"""WITH s AS (SELECT {', '.join(SNAPSHOTS)} FROM events), k AS (SELECT *, max(CASE WHEN status = 'ok' THEN (epoch_us(ts) // 1000) END) OVER w AS last_, arg_max(payload, CASE WHEN status = 'ok' THEN (epoch_us(ts) // 1000) END) FILTER (status = 'ok') OVER w AS good FROM s WINDOW w AS (PARTITION BY source ORDER BY ts, payload ROWS UNBOUNDED PRECEDING))
SELECT source, CASE WHEN status = 'ok' THEN 'fresh' WHEN (epoch_us(ts) // 1000) - last_ <= 300000 THEN 'last-known-good' ELSE 'unavailable' END AS answer, (epoch_us(ts) // 1000) AS at, CASE WHEN (epoch_us(ts) // 1000) - last_ <= 300000 THEN good END AS payload FROM k
UNION ALL SELECT source, 'expired', (epoch_us(ts) // 1000) + 300000, payload FROM (SELECT *, lead((epoch_us(ts) // 1000)) OVER (PARTITION BY source ORDER BY ts, payload) AS next_ FROM s WHERE status = 'ok') WHERE next_ - (epoch_us(ts) // 1000) > 300000""")
def known_good_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each snapshot of a source's health is answered with, and when its last good one expired before the next."""
    rows = table(spark, sf_dir, "events").selectExpr(*SNAPSHOTS)
    found = _streamed(spark, rows, WEEKS, lambda s: state.known_good_answers(s, late="1 hour"))
    # What is left at the end may expire by the watermark or not; it has no next good one.
    last = found.where("answer = 'fresh'").groupBy("source").agg((F.max("at") + 300_000).alias("end"))
    return found.join(F.broadcast(last), "source").where("answer != 'expired' OR at < end").drop("end")  # ten rows


@query("""WITH RECURSIVE e AS (SELECT user_id, event_id, ts, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events),
r AS (SELECT user_id, event_id, n, true AS admitted, [ts] AS log FROM e WHERE n = 1
UNION ALL SELECT user_id, event_id, n, len(kept) < 2, CASE WHEN len(kept) < 2 THEN kept || [ts] ELSE kept END FROM (SELECT e.user_id, e.event_id, e.n, e.ts, [x FOR x IN r.log IF x > e.ts - INTERVAL 6 HOURS] AS kept FROM r JOIN e ON e.user_id = r.user_id AND e.n = r.n + 1))
SELECT user_id AS actor, event_id AS id, admitted FROM r""")
def sliding_rate_limit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests that are admitted at two in any six hours of their actor's."""
    rows = table(spark, sf_dir, "events").select(F.col("user_id").alias("actor"), F.col("event_id").alias("id"), "ts")
    return _streamed(spark, rows, WEEKS, lambda s: state.admitted(s, most=2, seconds=6 * 3600))


REPLIES = ("CAST(doc_id AS STRING) AS stream_id", "'Filed ' || source || chr(10) || '[Storm Report — p. ' || CAST(doc_id % 9 + 1 AS STRING) || ']' || chr(10) || ', and [other] text.' AS reply")


@query("SELECT CAST(doc_id AS STRING) AS stream_id, 'Filed ' || source || ' [Storm Report — p. ' || (doc_id % 9 + 1) || '](https://x.org/a' || doc_id % 3 || '.pdf#page=' || (doc_id % 9 + 1) || '), and [other] text.' AS reply FROM documents WHERE source IS NOT NULL")
def relinked_streams(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Replies whose pieces of seven characters land out of order, repaired as they go out; each has rows of its own to cite."""
    rows = table(spark, sf_dir, "documents").where("source IS NOT NULL").selectExpr(*REPLIES, "doc_id")
    last = F.floor((F.length("reply") - 1) / 7)
    pieces = rows.select("stream_id", F.posexplode(F.transform(F.sequence(F.lit(0), last), lambda i: F.substr("reply", i.cast("int") * 7 + 1, F.lit(7)))).alias("seq", "delta"), last.alias("last"))
    deltas = pieces.select("stream_id", F.col("seq").cast("long").alias("seq"), "delta", (F.col("seq") == F.col("last")).alias("final"))
    cited = rows.select("stream_id", F.lit("Storm Report").alias("title"), F.concat(F.lit("https://x.org/a"), (F.col("doc_id") % 3).cast("string"), F.lit(".pdf")).alias("url"), F.lit(1).alias("page_number"), F.lit(None).cast("string").alias("kind"))
    out = _streamed(spark, deltas, ["seq % 3 = 1", "seq % 3 = 2", "seq % 3 = 0"], lambda s: state.relinked(s, cited))
    return out.groupBy("stream_id").agg(render.joined("seq", F.col("text"), "").alias("reply"))
