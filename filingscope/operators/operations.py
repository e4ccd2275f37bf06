"""Health, coverage, freshness, feedback, admission and offline evaluation."""

from __future__ import annotations

import time

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import scoring, text
from .shared import once

REASONS = ("incorrect", "missing", "unclear", "citation", "other")
REPORT_ROWS = 100


def coverage(shards: DataFrame, public_records: int) -> DataFrame:
    """One row from shard states (indexed, failed, unavailable; null indexed for a missing shard)."""
    sums = shards.agg(F.sum(scoring.lenient_number(F.col("indexed"))).cast("long").alias("indexed"), F.sum(scoring.array_length(F.col("failed"))).cast("long").alias("retry_pending"), F.sum(scoring.array_length(F.col("unavailable"))).cast("long").alias("unavailable"), F.every(F.col("indexed").isNotNull()).alias("available"))
    whole, done = F.lit(public_records), F.col("indexed") + F.col("unavailable")
    return sums.select("available", "indexed", "retry_pending", "unavailable", F.when(F.col("available"), F.greatest(F.lit(0), whole - done)).cast("long").alias("unaccounted"), F.when(F.col("available"), scoring.percent(F.col("indexed"), whole)).alias("searchable_percent"), F.when(F.col("available"), scoring.percent(done, whole)).alias("accounted_percent"), (F.col("available") & (whole > 0) & (F.col("retry_pending") == 0) & (done >= whole)).alias("complete"))


def health(parts: DataFrame, as_of: str) -> DataFrame:
    """(status, issues) from named parts (part, updated_at): each must be there and fresh; the term index may be ten days old."""
    hours = F.when(F.col("part") == "term-index", 240).otherwise(36)
    age = (F.unix_millis(F.to_timestamp(F.lit(as_of))) - F.unix_millis(F.try_to_timestamp("updated_at"))) / 3_600_000
    issue = F.when(F.col("updated_at").isNull(), F.concat("part", F.lit("-unavailable"))).when(F.coalesce(age <= hours, F.lit(False)), None).otherwise(F.concat("part", F.lit("-stale")))
    return parts.agg(F.array_sort(F.collect_list(issue)).alias("issues")).select(F.when(F.size("issues") > 0, "degraded").otherwise("ok").alias("status"), F.array_join("issues", ", ").alias("issues"))


def monitor(responses: DataFrame) -> DataFrame:
    """(id, status, issues) of health responses (id, http_code, payload): live issues override a cached ok."""
    schema = "status string, healthSource string, liveIssues array<string>, issues array<string>"
    clean = lambda a: F.filter(F.transform(F.coalesce(a, F.array().cast("array<string>")), lambda x: F.trim(F.translate(x, "\r\n", "  "))), lambda x: F.length(x) > 0)
    p = responses.select("id", "http_code", F.from_json("payload", schema).alias("p")).select("id", "http_code", F.coalesce(F.nullif("p.status", F.lit("")), F.lit("unknown")).alias("status"), F.col("p.healthSource").alias("source"), clean(F.col("p.liveIssues")).alias("live"), clean(F.col("p.issues")).alias("listed"))
    issues, cached = F.when(F.size("live") > 0, F.col("live")).otherwise(F.col("listed")), F.col("source").eqNullSafe("last-known-good") | (F.size("live") > 0)
    p = p.withColumn("issues", F.when(cached & (F.size(issues) == 0), F.array(F.lit("last-known-good-health"))).otherwise(issues)).withColumn("status", F.when(cached, "degraded").otherwise(F.col("status")))
    p = p.withColumn("status", F.when((F.col("http_code") != "200") & F.col("status").isin("unknown", "ok"), "unreachable").otherwise(F.col("status")))
    p = p.withColumn("issues", F.when((F.col("status") != "ok") & (F.size("issues") == 0), F.array(F.concat(F.lit("HTTP "), "http_code"))).otherwise(F.col("issues")))
    return p.select("id", "status", F.coalesce(F.nullif(F.array_join("issues", ", "), F.lit("")), F.lit("none")).alias("issues"))


def valid_requests(turns: DataFrame, most_message: int = 5000, most_history: int = 10) -> DataFrame:
    """(conv_id, valid): the last turn is a message of 1 to 5000 characters, the turns before it a valid history."""
    last = Window.partitionBy("conv_id").orderBy(F.desc("turn"))
    marked = turns.withColumn("n", F.row_number().over(last))
    fine = F.when(F.col("n") == 1, F.length(F.trim("content")).between(1, most_message)).otherwise(F.col("role").isin("user", "model") & (F.length("content") <= most_message))
    return marked.groupBy("conv_id").agg((F.every(F.coalesce(fine, F.lit(False))) & (F.count("*") <= most_history + 1)).alias("valid"))


def valid_feedback(rows: DataFrame) -> DataFrame:
    """Feedback that is accepted: 'down' needs reason, question and excerpt; 'up' keeps none of them."""
    norm = lambda c, most: F.when(F.length(F.trim(c)).between(1, most), F.trim(c))
    reason = F.when(F.col("reason").isin(*REASONS), F.col("reason"))
    cut = rows.select("request_id", "updated_at", "reported_at", "rating", reason.alias("reason"), norm("comment", 1000).alias("comment"), norm("question", 1500).alias("question"), norm("answer_excerpt", 2500).alias("answer_excerpt"))
    down = F.col("rating") == "down"
    ok = F.when(down, F.col("reason").isNotNull() & F.col("question").isNotNull() & F.col("answer_excerpt").isNotNull()).otherwise(F.col("rating") == "up")
    return cut.where(ok).select("request_id", "updated_at", "reported_at", "rating", *(F.when(down, F.col(c)).alias(c) for c in ("reason", "comment", "question", "answer_excerpt")))


def feedback_report(rows: DataFrame) -> DataFrame:
    """The first hundred unreported rows by time."""
    return rows.where("reported_at IS NULL").orderBy("updated_at", "request_id").limit(REPORT_ROWS)


def acknowledge(rows: DataFrame, ids: DataFrame, at: str) -> DataFrame:
    """Unreported rows among ``ids`` get the time; the others stay."""
    marked = ids.select("request_id", F.lit(True).alias("acked")).distinct()
    return rows.join(marked, "request_id", "left").withColumn("reported_at", F.when(F.col("reported_at").isNull() & F.col("acked"), F.lit(at)).otherwise(F.col("reported_at"))).drop("acked")


def feedback_upsert(events: DataFrame) -> DataFrame:
    """The latest row of each request; a new one is unreported again."""
    latest = Window.partitionBy("request_id").orderBy(F.desc("updated_at"), F.desc("rating"))
    return events.withColumn("_n", F.row_number().over(latest)).where("_n = 1").drop("_n").withColumn("reported_at", F.lit(None).cast("string"))


def feedback_questions(turns: DataFrame) -> DataFrame:
    """Each model turn with the nearest user turn before it."""
    before = Window.partitionBy("conv_id").orderBy("turn").rowsBetween(Window.unboundedPreceding, -1)
    asked = F.last(F.when(F.col("role") == "user", F.col("content")), ignorenulls=True).over(before)
    return turns.withColumn("question", asked).where("role = 'model'").select("conv_id", "turn", "question")


def recent_cases(turns: DataFrame, most: int = 6) -> DataFrame:
    """(conv_id, pos, case_number): cases that the latest model turn with any cites, in order."""
    cited = F.array_distinct(F.filter(text.matches(F.col("content"), r"\b([A-Z][A-Z0-9]{1,12}(?:-[A-Z0-9]{1,6}){0,3})\b", 1), lambda c: c.rlike(r"\d") & c.rlike(text.CASE_NUMBER)))
    model = turns.where("role = 'model'").withColumn("cases", F.slice(cited, 1, most)).where("size(cases) > 0")
    return model.groupBy("conv_id").agg(F.max_by("cases", "turn").alias("cases")).select("conv_id", F.posexplode("cases").alias("pos", "case_number"))


def rate_limits(events: DataFrame, actor: str = "user_id", per_actor: int = 30, overall: int = 300, seconds: int = 60) -> DataFrame:
    """(window_start, actor, n, over_actor, over_all): counts of each actor in tumbling windows against both limits."""
    mine = events.groupBy(F.window("ts", f"{seconds} seconds")["start"].alias("window_start"), F.col(actor).alias("actor")).agg(F.count("*").alias("n"))
    whole = mine.groupBy("window_start").agg(F.sum("n").alias("all"))
    return mine.join(whole, "window_start").select("window_start", "actor", "n", (F.col("n") > per_actor).alias("over_actor"), (F.col("all") > overall).alias("over_all"))


def admission(requests: DataFrame) -> DataFrame:
    """(id, verdict): the first failing check of actor limit, challenge and overall limit."""
    return requests.select("id", F.when(F.col("over_actor"), "actor-limit").when(~F.col("challenge_passed"), "challenge-failed").when(F.col("over_all"), "overall-limit").otherwise("admitted").alias("verdict"))


def rate_actor(client_id: Column, ip: Column) -> Column:
    """What requests are counted by: the client if it is known, else its address."""
    return F.when(F.length(client_id) > 0, F.concat(F.lit("client:"), client_id)).otherwise(F.concat(F.lit("ip:"), F.coalesce(ip, F.lit("unknown"))))


def limited_body(body: Column, schema: str, most_bytes: int = 64 * 1024) -> Column:
    """Struct (too_large, value) of a request body in JSON; the value is null if it is too large or no JSON."""
    large = F.coalesce(F.octet_length(body) > most_bytes, F.lit(False))
    return F.struct(large.alias("too_large"), F.when(~large, F.from_json(body, schema)).alias("value"))


def challenge_passed(answer: Column, secret: str | None, action: str, hostname: str | None = None) -> Column:
    """Whether the challenge service's answer (JSON, null if there was none) lets a request in; always without a secret."""
    a = F.from_json(answer, "success boolean, action string, hostname string")
    ok = a["success"] & (a["action"] == action) & (F.lit(hostname is None) | (a["hostname"] == F.lit(hostname)))
    return F.coalesce(ok, F.lit(False)) | F.lit(not secret)


def cached_news(log: DataFrame, as_of: str, minutes: int = 30) -> DataFrame:
    """The last fetched news (ts, status, payload), if they are young enough to serve."""
    return last_known_good(log, as_of, minutes * 60)


def store_bytes(pages: Column, page_size: Column) -> Column:
    """Bytes that a database holds, by its pages."""
    return pages.cast("long") * page_size.cast("long")


def bearer_matches(header: Column, secret: str) -> Column:
    """Whether an authorization header carries the secret, compared by digests; false without a secret."""
    given = F.when(F.startswith(header, F.lit("Bearer ")), F.substring(header, F.lit(8), F.length(header))).otherwise("")
    return F.coalesce((F.sha2(given, 256) == F.sha2(F.lit(secret), 256)) & F.lit(bool(secret)), F.lit(False))


def allows_cached_health(url: Column) -> Column:
    """Whether a health request may be answered from the last good state: not with live=1."""
    return F.coalesce(F.try_parse_url(url, F.lit("QUERY"), F.lit("live")), F.lit("")) != "1"


def health_response(parts: DataFrame, shards: DataFrame, public_records: int, as_of: str) -> DataFrame:
    """One row (status, issues, coverage): freshness of the parts, and full-text coverage of the shards with its own issue."""
    have = coverage(shards, public_records).select(F.struct("*").alias("coverage"))
    both = health(parts, as_of).crossJoin(have)  # one row each
    issues = F.concat_ws(", ", F.nullif("issues", F.lit("")), F.when(~F.col("coverage.available"), "coverage-unavailable"))
    return both.select(F.when(F.length(issues) > 0, "degraded").otherwise("ok").alias("status"), issues.alias("issues"), "coverage")


class StageLog:
    """What the stages of a job took and made: each is written once, and its rows are counted on the way."""

    def __init__(self, spark: SparkSession):
        self.spark, self.held = spark, []

    def stage(self, df: DataFrame, name: str, **details: str) -> DataFrame:
        """``df`` as a written table, logged under ``name``; a stage that fails is logged with its error."""
        seen, began = Observation(), time.monotonic()
        try:
            out = once(df.observe(seen, F.count(F.lit(1)).alias("rows")), name)
            rows, error = seen.get["rows"], None
        except Exception as e:
            rows, error = None, type(e).__name__
            raise
        finally:
            self.held.append((len(self.held), name, rows, error, time.monotonic() - began, details))
        return out

    def table(self) -> DataFrame:
        """(pos, stage, rows, error, seconds, details)."""
        return self.spark.createDataFrame(self.held, "pos int, stage string, rows long, error string, seconds double, details map<string,string>")


def last_known_good(log: DataFrame, as_of: str, ttl_seconds: int = 300) -> DataFrame:
    """The payload of the last ok snapshot, if it is young enough."""
    ok = log.where("status = 'ok'").agg(F.max("ts").alias("ts"), F.max_by("payload", "ts").alias("payload"))
    return ok.where(F.unix_millis(F.to_timestamp(F.lit(as_of))) - F.unix_millis(F.col("ts").cast("timestamp")) <= ttl_seconds * 1000)


def evaluation_summary(results: DataFrame, as_of: str) -> DataFrame:
    """One row over per-question results (evidence_rows, distinct_filings, oracle_overlap, years_covered, ages)."""
    ages = results.select(F.explode_outer("ages").alias("age")).agg(F.median("age").alias("median_age"))
    means = results.agg(F.count("*").alias("questions"), F.count_if(F.col("evidence_rows") > 0).alias("answered"), F.round(F.avg("evidence_rows"), 2).alias("mean_evidence_rows"), F.round(F.avg("distinct_filings"), 2).alias("mean_distinct_filings"), F.round(F.avg("oracle_overlap"), 3).alias("mean_oracle_overlap"), F.concat_ws("/", F.count_if("years_covered").cast("string"), F.count("years_covered").cast("string")).alias("year_coverage"))
    return means.crossJoin(ages)  # one row each
