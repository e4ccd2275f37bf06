"""Term index: BM25-weighted postings and Bloom filters of filings and cases.

Filings have filing_id, case_number, title, received_date and text.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import hashing, scoring, text
from .shared import once, small

#: Texts whose filters are set at once.
FILTER_ROWS = 256
#: Stems that tasks know as a constant.
ASKED_STEMS = 10_000
#: Filters of a block of slices, and slices that are made at once.
SLICE_ROWS, SLICES_AT_ONCE = 4096, 512


def case_terms(filings: DataFrame) -> DataFrame:
    """(case_number, stem, n): in how many of a case's filings a stem occurs. Filings are reduced to distinct stems before the shuffle."""
    return filings.select("case_number", F.explode(text.stems(F.col("text"))).alias("stem")).groupBy("case_number", "stem").agg(F.count("*").alias("n"))


def asked_terms(filings: DataFrame, asked: DataFrame) -> DataFrame:
    """The same for the stems that are asked for; all others of a case make one row of a null stem.

    Up to ``ASKED_STEMS`` stems go to the tasks as a constant and nothing else leaves a text; more are joined.
    """
    wanted = [r[0] for r in asked.select("stem").distinct().limit(ASKED_STEMS + 1).collect()]
    each = filings.select("case_number", text.stems(F.col("text")).alias("stems"))
    if len(wanted) <= ASKED_STEMS:
        own = F.array_intersect("stems", F.array(*map(F.lit, wanted)).cast("array<string>"))
        rest = F.array_repeat(F.lit(None).cast("string"), F.when(F.size("stems") > F.size(own), 1).otherwise(0))
        return each.select("case_number", F.explode(F.concat(own, rest)).alias("stem")).groupBy("case_number", "stem").agg(F.count("*").alias("n"))
    known = asked.select("stem").distinct().withColumn("asked", F.lit(True))
    words = each.select("case_number", F.explode("stems").alias("stem")).join(known, "stem", "left").select("case_number", F.when(F.col("asked"), F.col("stem")).alias("stem"))
    return words.groupBy("case_number", "stem").agg(F.count("*").alias("n"))


def case_sizes(filings: DataFrame) -> DataFrame:
    """(case_number, filings): all of them, those without a term too."""
    return filings.groupBy("case_number").agg(F.count("*").alias("filings"))


def index_totals(terms: DataFrame, sizes: DataFrame) -> DataFrame:
    """One row: cases with terms, their mean size, and the document-frequency cap."""
    with_terms = sizes.join(terms.select("case_number").distinct(), "case_number", "left_semi")
    return with_terms.agg(F.count("*").alias("cases"), F.avg("filings").alias("mean")).withColumn("cap", scoring.frequency_cap(F.col("cases")))


def document_frequency(terms: DataFrame) -> DataFrame:
    return terms.groupBy("stem").agg(F.count("*").alias("df"))


def postings(filings: DataFrame, asked: DataFrame | None = None) -> DataFrame:
    """(stem, case_number, df, weight, cases). A stem above the cap keeps one row with its df and no case.

    Stems above the cap, the commonest ones, leave before anything is joined by stem. With ``asked`` (stem), an
    index is made of those stems alone, with the same numbers.
    """
    terms, sizes = once(case_terms(filings) if asked is None else asked_terms(filings, asked), "case-terms"), case_sizes(filings)  # the texts are read once
    totals = index_totals(terms, sizes)
    terms = terms.where("stem IS NOT NULL")
    known = once(document_frequency(terms).crossJoin(F.broadcast(totals)), "frequencies")  # one row
    capped = F.col("df") > F.col("cap")
    listed = terms.join(small(known.where(capped).select("stem"), 100_000), "stem", "left_anti")
    weighed = listed.join(sizes, "case_number").join(known.where(~capped), "stem")
    weight = scoring.stored_weight(scoring.bm25(F.col("n"), F.col("filings"), F.col("mean")))
    kept = weighed.select("stem", "case_number", "df", weight.alias("weight"), "cases")
    over = known.where(capped).select("stem", F.lit(None).cast("string").alias("case_number"), "df", F.lit(None).cast("int").alias("weight"), "cases")
    return kept.unionByName(over)


def has_bits(bits: Column, data: Column) -> Column:
    """Whether all bit positions are set in a binary filter."""
    return F.forall(bits, lambda b: F.getbit(F.conv(F.hex(F.substring(data, F.floor(b / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int"), b % 8) == 1)


def may_contain(term: Column, data: Column, size: int = hashing.FILTER_BYTES) -> Column:
    """Bloom membership; an empty filter holds nothing."""
    return (F.octet_length(data) > 0) & has_bits(hashing.filter_bits(F.lower(term), size), data)


def _filters(size: int):
    """(text, keys) to (keys, bits): each text's filter. A batch's distinct words are hashed once, all at a time."""
    word = re.compile(text.TOKEN)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, len(whole), FILTER_ROWS):
                batch = whole.slice(at, FILTER_ROWS)
                words = [list(set(word.findall(t or ""))) for t in batch.column(0).to_pylist()]
                known, place = np.unique(np.array([w for own in words for w in own], dtype="S40"), return_inverse=True)
                spots = hashing.filter_positions(known, size)[place]
                rows = np.repeat(np.arange(len(words)), [len(own) for own in words])
                held = np.zeros((len(words), 8 * size), dtype=bool)
                held[rows[:, None], spots] = True
                bits = pa.array([x.tobytes() for x in np.packbits(held, axis=1, bitorder="little")], pa.binary())
                yield pa.RecordBatch.from_arrays([*batch.columns[1:], bits], [*batch.schema.names[1:], "bits"])

    return run


def term_filters(filings: DataFrame, size: int = hashing.FILTER_BYTES, *keys: str) -> DataFrame:
    """(keys, bits): the Bloom filter of each row's tokens, by default with its filing_id; no shuffle.

    A null text has no tokens, so no bit is set.
    """
    keys = keys or ("filing_id",)
    rows = filings.select(F.lower("text").alias("_text"), *keys)
    return rows.mapInArrow(_filters(size), rows.drop("_text").schema.add("bits", "binary"))


def merged_filters(filters: DataFrame, size: int, *keys: str) -> DataFrame:
    """(keys, bits): the union of each group's filters, combined before the shuffle."""
    return filters.groupBy(*keys).agg(F.expr("bitmap_or_agg(bits)").alias("all")).select(*keys, F.substring("all", 1, size).alias("bits"))


def _slices(size: int, wanted: np.ndarray):
    """(keys, bits) to blocks: a row (block, bit, slice) for each wanted bit that a filter of the block sets, and one with the block's keys."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = TaskContext.get().partitionId() << 33
        for whole in batches:
            for at in range(0, len(whole), SLICE_ROWS):
                batch = whole.slice(at, SLICE_ROWS)
                data = np.frombuffer(b"".join(x.ljust(size, b"\0") for x in batch.column(batch.num_columns - 1).to_pylist()), np.uint8).reshape(len(batch), size)
                keys = pa.StructArray.from_arrays(batch.columns[:-1], batch.schema.names[:-1])
                listed = pa.ListArray.from_arrays(pa.array([0, len(batch)], pa.int32()), keys)
                yield pa.RecordBatch.from_arrays([pa.array([block]), pa.array([-1], pa.int32()), pa.array([None], pa.binary()), listed], ["block", "bit", "slice", "keys"])
                for lo in range(0, len(wanted), SLICES_AT_ONCE):
                    bits = wanted[lo : lo + SLICES_AT_ONCE]
                    set_ = ((data[:, bits >> 3] >> (bits & 7).astype(np.uint8)) & 1).T
                    some = set_.any(axis=1)
                    slices = pa.array([x.tobytes() for x in np.packbits(set_[some], axis=1, bitorder="little")], pa.binary())
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(slices), block)), pa.array(bits[some].astype(np.int32)), slices, pa.nulls(len(slices), listed.type)], ["block", "bit", "slice", "keys"])
                block += 1

    return run


def bit_slices(filters: DataFrame, size: int, *keys: str, bits: np.ndarray | None = None) -> DataFrame:
    """The filters (keys, bits) turned by bit: (block, bit, slice, keys).

    A block is up to ``SLICE_ROWS`` filters of one task; a slice is a bitmap of the block's filters that
    set a bit. The row of bit -1 has the block's keys in order. ``bits`` are the
    positions to turn, by default all; that table is an index which any terms can be asked of.
    Nothing is shuffled.
    """
    rows = filters.where(F.octet_length("bits") > 0).select(*keys, "bits")
    kind = T.StructType([rows.schema[k] for k in keys])
    schema = T.StructType().add("block", "long").add("bit", "integer").add("slice", "binary").add("keys", T.ArrayType(kind))
    return once(rows.mapInArrow(_slices(size, np.arange(8 * size) if bits is None else bits), schema), "slices")


@F.pandas_udf(T.ArrayType(T.IntegerType()))
def _set_places(bitmap: pd.Series) -> pd.Series:
    return bitmap.map(lambda x: np.flatnonzero(np.unpackbits(np.frombuffer(x, np.uint8), bitorder="little")).astype(np.int32))


def _spots(terms: DataFrame, size: int) -> DataFrame:
    """(term, need, bit): each term's positions and their number."""
    spots = F.array_distinct(hashing.filter_bits(F.lower("term"), size))
    return terms.select("term").distinct().withColumn("spots", spots).select("term", F.size("spots").alias("need"), F.explode("spots").alias("bit"))


def members_of(slices: DataFrame, terms: DataFrame, size: int, asked: DataFrame | None = None) -> DataFrame:
    """(keys, term): the filters of a bit-sliced index that may hold a term; each pair once.

    A term is the AND of the slices of its positions, so what is shuffled is a slice for each block and
    asked position, however full the filters are.
    """
    asked = small(_spots(terms, size), 100_000) if asked is None else asked
    both = slices.where("bit >= 0").select("block", "bit", "slice").join(asked, "bit").groupBy("block", "term", "need").agg(F.expr("bitmap_and_agg(slice)").alias("all"), F.count("*").alias("n"))
    held = both.where("n = need").select("block", "term", F.explode(_set_places(F.substring("all", 1, SLICE_ROWS // 8))).alias("at"))
    named = slices.where("bit = -1").select("block", F.posexplode("keys").alias("at", "key"))
    return held.join(named, ["block", "at"]).select("key.*", "term")


def members(filters: DataFrame, terms: DataFrame, size: int, *keys: str) -> DataFrame:
    """(keys, term) of filters (keys, bits) that are asked once: only the positions that terms ask for are turned.

    What the driver learns is which those are: a bitmap of a filter's size.
    """
    asked = _spots(terms, size)
    n, bitmap = asked.agg(F.count("*"), F.expr("bitmap_construct_agg(bit)")).first()
    wanted = np.flatnonzero(np.unpackbits(np.frombuffer(bytes(bitmap[:size]), np.uint8), bitorder="little"))
    return members_of(bit_slices(filters, size, *keys, bits=wanted), terms, size, F.broadcast(asked) if n <= 100_000 else asked)


@F.pandas_udf(T.ArrayType(T.IntegerType()))
def held_places(bits: pd.Series, spots: pd.Series) -> pd.Series:
    """Places, from 0, of the terms that a filter may hold; ``spots`` has the positions of all terms in a row."""

    def held(own: bytes, asked: np.ndarray) -> np.ndarray:
        is_set = np.unpackbits(np.frombuffer(own, np.uint8), bitorder="little")
        return np.flatnonzero(is_set[np.asarray(asked).reshape(-1, hashing.FILTER_HASHES)].all(axis=1)).astype(np.int32) if len(own) else np.zeros(0, dtype=np.int32)

    return pd.Series([held(b or b"", s) for b, s in zip(bits, spots, strict=True)])


def router_entries(filings: DataFrame) -> DataFrame:
    """(case_number, band, bits, filings, content_filings, latest, set_bits, part): folded filters of four bands a case.

    A folded filter is the filter of a smaller size, because that size divides the larger.
    """
    banded = filings.where("text IS NOT NULL").withColumn("band", F.pmod("filing_id", F.lit(hashing.ROUTER_BANDS)).cast("int"))
    each = term_filters(banded, hashing.ROUTER_BYTES, "case_number", "band")
    bands = once(merged_filters(each, hashing.ROUTER_BYTES, "case_number", "band"), "bands")  # the texts are read once
    stats = filings.groupBy("case_number").agg(F.count_distinct("filing_id").alias("filings"), F.count_distinct(F.when(F.col("text").isNotNull(), F.col("filing_id"))).alias("content_filings"), F.max("received_date").alias("latest")).where("content_filings > 0")
    full = bands.groupBy("case_number").agg(F.sum(F.bitmap_count("bits")).alias("set_bits"))
    return bands.join(stats, "case_number").join(full, "case_number").withColumn("part", hashing.router_part(F.col("case_number")))


def router_totals(entries: DataFrame, filings: DataFrame) -> DataFrame:
    """One row of what a router holds: cases, content_cases, associations of filings with cases, those with content, parts and filter_bytes."""
    pairs = filings.where("case_number IS NOT NULL").groupBy("case_number").agg(F.count_distinct("filing_id").alias("n"), F.count_distinct(F.when(F.col("text").isNotNull(), F.col("filing_id"))).alias("content"))
    all_ = pairs.agg(F.count("*").alias("cases"), F.count_if(F.col("content") > 0).alias("content_cases"), F.sum("n").alias("associations"), F.sum("content").alias("content_associations"))
    held = entries.agg(F.count_distinct("part").alias("parts"), F.sum(F.octet_length("bits")).alias("filter_bytes"))
    return all_.crossJoin(F.broadcast(held))  # one row each


def summed_counts(shards: DataFrame, *columns: str) -> DataFrame:
    """One row: the sums of all shards' counts; a shard that is missing or has no number counts nothing."""
    return shards.agg(*(F.coalesce(F.sum(scoring.lenient_number(F.col(c))), F.lit(0)).cast("long").alias(c) for c in columns))
