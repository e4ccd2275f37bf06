"""Ranking arithmetic as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .hashing import FILTER_HASHES
from .text import document_year

# Weights of the ranking.
K1, B, WEIGHT_SCALE = 1.2, 0.75, 100
YEAR_MATCH, RECENCY, RECENCY_YEARS = 0.9, 0.6, 12
MOST_SHARE, LEAST_CAP = 0.15, 32


def idf(df: Column, cases: Column) -> Column:
    """Smoothed, never below zero; zero without documents."""
    return F.when((df <= 0) | (cases <= 0), F.lit(0.0)).otherwise(F.greatest(F.lit(0.0), F.ln((cases + 1) / (df + 1))))


def log_tf(n: Column) -> Column:
    return F.when(n > 0, 1 + F.ln(n)).otherwise(F.lit(0.0))


def bm25(n: Column, size: Column, mean: Column) -> Column:
    """A term's BM25 part from its document count, normalised by the case's size."""
    ratio = F.when(mean > 0, size / mean).otherwise(F.lit(1.0))
    return F.when(n <= 0, F.lit(0.0)).otherwise(n * (K1 + 1) / (n + K1 * (1 - B + B * ratio)))


def stored_weight(weight: Column) -> Column:
    """A whole number of hundredths, at least 1; halves go to the even one."""
    return F.greatest(F.lit(1), F.rint(WEIGHT_SCALE * weight).cast("int"))


def frequency_cap(cases: Column) -> Column:
    return F.greatest(F.lit(LEAST_CAP), F.floor(MOST_SHARE * cases).cast("int"))


def document_score(hits: Column, received: Column, years: Column, as_of: str) -> Column:
    """Term hits, plus a bonus for a year that the question names (or the next one) and for recency."""
    year = document_year(received)
    named = F.exists(years, lambda y: (year == y) | (year == y + 1))
    fresh = F.least(F.lit(1.0), F.greatest(F.lit(0.0), 1 - (F.year(F.to_date(F.lit(as_of))) - year) / RECENCY_YEARS))
    return F.when(year.isNull(), hits.cast("double")).otherwise(hits + F.when(named, F.lit(YEAR_MATCH)).otherwise(F.lit(0.0)) + RECENCY * fresh)


def fill_ratio(bits: Column, size: int) -> Column:
    return F.bitmap_count(bits) / (8 * size)


def adjusted_hits(hits: Column, terms: Column, fill: Column) -> Column:
    """Hits less those that a filter of this fill gives by chance."""
    return F.greatest(F.lit(0.0), hits - terms * F.pow(F.least(F.lit(1.0), F.greatest(F.lit(0.0), fill)), F.lit(FILTER_HASHES)))


def read_budget(rank: Column) -> Column:
    return F.when(rank == 0, 5).when(rank == 1, 3).otherwise(2)


def is_fresh(stamp: Column, as_of: str, hours: int = 36) -> Column:
    """Whether a time is at most ``hours`` before ``as_of``; false for null or no time."""
    age = F.unix_millis(F.to_timestamp(F.lit(as_of))) - F.unix_millis(F.try_to_timestamp(stamp))
    return F.coalesce(age <= hours * 3_600_000, F.lit(False))


def lenient_number(value: Column) -> Column:
    """A number, or 0 for what is none or not finite."""
    n = value.try_cast("double")
    return F.when(n.isNull() | F.isnan(n) | (F.abs(n) == float("inf")), F.lit(0.0)).otherwise(n)


def array_length(value: Column) -> Column:
    return F.coalesce(F.size(value), F.lit(0))


def percent(part: Column, whole: Column) -> Column:
    return F.when(whole > 0, F.least(F.lit(100.0), F.round(part * 100 / whole, 2)))


def shard_bounds(total: int, shard: int, shards: int, capacity: int = 250_000) -> tuple[int, int]:
    """First and end record of a shard; the last one takes all that is left."""
    width = capacity // shards
    return min(width * shard, total), min(total if shard == shards - 1 else width * (shard + 1), total)


def shard_range(total: Column, shard: Column, shards: Column, capacity: int = 250_000) -> tuple[Column, Column]:
    """The same of columns."""
    width = F.floor(F.lit(capacity) / shards)
    return F.least(width * shard, total), F.when(shard == shards - 1, total).otherwise(F.least(width * (shard + 1), total))


def retry_wait(attempt: Column, retry_after: Column, jitter: Column) -> Column:
    """Seconds to wait: the server's wish (text) up to 60, else a doubling delay up to 30 plus ``jitter``."""
    wish = F.trim(retry_after).try_cast("double")
    return F.when(wish.isNotNull(), F.least(F.lit(60.0), F.greatest(F.lit(0.0), wish))).otherwise(F.least(F.lit(30.0), F.pow(F.lit(2.0), attempt)) + jitter)


def retry_delay(attempt: int, retry_after: str | None = None, jitter: float = 0.0) -> float:
    """Seconds to wait: the server's wish up to 60, else a doubling delay up to 30 plus ``jitter``."""
    try:
        return min(60.0, max(0.0, float(retry_after)))
    except (TypeError, ValueError):
        return min(30.0, 2.0**attempt) + jitter
