"""Bounded samples: the rows with the smallest hashes of their ids."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Rows that the hash threshold lets through, as a multiple of the sample; it keeps the rest from being sorted or moved.
MARGIN = 4


def hash_limit(rows: int, wanted: int) -> int:
    """A bound on 64-bit hashes that about ``MARGIN * wanted`` of ``rows`` rows stay under."""
    return 2**63 - 1 if rows <= MARGIN * wanted else int(-(2**63) + 2**64 * (MARGIN * wanted / rows))


def smallest(df: DataFrame, key: str, wanted: int) -> DataFrame:
    """The ``wanted`` rows of ``df`` with the smallest hashes of ``key``; ties by the key."""
    h: Column = F.xxhash64(key)
    return df.where(h <= F.lit(hash_limit(df.count(), wanted))).orderBy(h, key).limit(wanted)
