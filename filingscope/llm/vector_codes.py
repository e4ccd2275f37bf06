"""Compression of vectors to codes of 16 bytes, with the nearest entries found by VA-file filtering.

Vectors become integers and are cut into parts; each part is coded by the index of its
codebook's nearest entry. The entries of a part position are what is searched: each of
their coordinates is quantised to a few bits, a cell. A part looks up, for each coordinate
and cell, how near and how far an entry of that cell can be; sums of these are a lower and
an upper bound of its distance to each entry. Only entries whose lower bound doesn't exceed
the smallest upper one are compared exactly, in integers.

A codebook has 64 entries of a vector's width in all, so it fits every closure and the
driver however large the table is. A round reads all rows once; a task sends one sum for
each coordinate of an entry.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import join_hot
from .integers import integer_vector, matrix
from .workers import Batches, bounded
from .workspace import Workspace

PARTS, ENTRIES, ROUNDS = 16, 64, 2
#: Bits of a cell.
CELL_BITS = 3
#: Rows that are compared with the entries at once.
STEP = 4096


def part_bounds(width: int, parts: int = PARTS) -> list[tuple[int, int]]:
    """Where the consecutive parts of a vector begin and end; equal ones if ``parts`` divides the width."""
    return [(j * width // parts, (j + 1) * width // parts) for j in range(parts)]


class Cells:
    """The entries of one part position with their coordinates' cells.

    Cells hold about equally many entries. ``low`` and ``high`` are the least and the
    largest coordinate in a cell, so bounds are integers and exact.
    """

    def __init__(self, entries: np.ndarray, bits: int = CELL_BITS):
        self.entries = entries
        count, width = entries.shape
        cells = 1 << bits
        self.cell = np.zeros((width, count), dtype=np.int64)
        self.low, self.high = np.zeros((width, cells), dtype=np.int64), np.zeros((width, cells), dtype=np.int64)
        for d, values in enumerate(entries.T):
            marks = np.sort(values)[np.arange(1, cells) * count // cells]
            self.cell[d] = np.searchsorted(marks, values, side="right")
            for c in np.unique(self.cell[d]):
                own = values[self.cell[d] == c]
                self.low[d, c], self.high[d, c] = own.min(), own.max()

    def bounds(self, parts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Lower and upper bounds of the squared distances of each part to each entry."""
        lower = np.zeros((len(parts), len(self.entries)), dtype=np.int64)
        upper = np.zeros_like(lower)
        for d in range(self.entries.shape[1]):
            x = parts[:, d, None]
            below, above = self.low[d] - x, x - self.high[d]
            near, far = np.maximum(np.maximum(below, above), 0), np.maximum(np.abs(below), np.abs(above))
            lower += (near * near)[:, self.cell[d]]
            upper += (far * far)[:, self.cell[d]]
        return lower, upper

    def nearest(self, parts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Index of and squared distance to each part's nearest entry; ties to the lower index."""
        lower, upper = self.bounds(parts)
        row, entry = np.nonzero(lower <= upper.min(axis=1, keepdims=True))
        off = parts[row] - self.entries[entry]
        exact = np.full(lower.shape, np.iinfo(np.int64).max)
        exact[row, entry] = (off * off).sum(axis=1)
        index = exact.argmin(axis=1)
        return index, exact[np.arange(len(parts)), index]


class Coder:
    """A codebook of ENTRIES rows as wide as the vectors: entry e of part j is row e at that part's place."""

    def __init__(self, codebook: np.ndarray, parts: int = PARTS):
        self.codebook, self.places = codebook, part_bounds(codebook.shape[1], parts)
        self.cells = [Cells(codebook[:, lo:hi]) for lo, hi in self.places]

    def codes(self, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Entry indexes (rows x parts) and the squared distances summed over parts."""
        index, error = np.zeros((len(vectors), len(self.places)), dtype=np.int64), np.zeros(len(vectors), dtype=np.int64)
        for at in range(0, len(vectors), STEP):
            some = slice(at, at + STEP)
            for j, (lo, hi) in enumerate(self.places):
                index[some, j], off = self.cells[j].nearest(vectors[some, lo:hi])
                error[some] += off
        return index, error

    def sha256(self) -> str:
        """Of all entries' components, by part, entry and position within the part."""
        return hashlib.sha256(",".join(str(x) for lo, hi in self.places for x in self.codebook[:, lo:hi].ravel().tolist()).encode()).hexdigest()


def _sums(coder: Coder):
    """(vector) to the sum and number of the parts at each coordinate of each entry: entry, place, total, n."""

    def run(batches: Batches) -> Iterator[pa.RecordBatch]:
        total, n = np.zeros_like(coder.codebook), np.zeros((len(coder.codebook), len(coder.places)), dtype=np.int64)
        for batch in batches:
            vectors = matrix(batch.column(0))
            index, _ = coder.codes(vectors) if len(vectors) else (np.zeros((0, len(coder.places)), dtype=np.int64), None)
            for j, (lo, hi) in enumerate(coder.places):
                np.add.at(total[:, lo:hi], index[:, j], vectors[:, lo:hi])
                n[:, j] += np.bincount(index[:, j], minlength=len(n))
        each = np.concatenate([np.repeat(n[:, j, None], hi - lo, axis=1) for j, (lo, hi) in enumerate(coder.places)], axis=1)
        entry, place = np.nonzero(each)
        yield pa.RecordBatch.from_arrays([pa.array(entry.astype(np.int32)), pa.array(place.astype(np.int32)), pa.array(total[entry, place]), pa.array(each[entry, place])], ["entry", "place", "total", "n"])

    return bounded(run)


def _coded(coder: Coder):
    """(vec_id, label, vector) to (vec_id, label, code, error)."""

    def run(batches: Batches) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            index, error = coder.codes(matrix(batch.column(2))) if len(batch) else (np.zeros((0, PARTS)), np.zeros(0, dtype=np.int64))
            text = index.astype(np.uint8).tobytes().hex()
            step = 2 * len(coder.places)
            codes = [text[at : at + step] for at in range(0, len(text), step)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(codes, pa.string()), pa.array(error)], ["vec_id", "label", "code", "error"])

    return bounded(run)


def trained(vectors: DataFrame, first: DataFrame, rounds: int = ROUNDS) -> Coder:
    """The coder after ``rounds`` rounds over all ``vectors``; ``first`` has the initial entries, in order. Both have one column, vector."""
    coder = Coder(np.array([r[0] for r in first.collect()], dtype=np.int64))  # ENTRIES rows
    for _ in range(rounds):
        sums = vectors.mapInArrow(_sums(coder), "entry int, place int, total bigint, n bigint").groupBy("entry", "place").agg(F.sum("total").alias("total"), F.sum("n").alias("n"))
        book = coder.codebook.copy()  # unused entries stay
        for entry, place, total, n in sums.collect():  # ENTRIES numbers for each coordinate of a vector
            book[entry, place] = total // n
        coder = Coder(book)
    return coder


def compress(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """One row per kept vector: vec_id, code, error, label_error, codebooks_sha256.

    Dropped are rows whose vector is null, holds a null or non-finite component, or has
    integers of a squared norm of 2**52 or more. The most frequent length is coded (of equally
    frequent ones the smaller); a row of another length is kept with a null code and a null
    error, which label_error leaves out (null if no error of the label is known). A length
    that 16 doesn't divide is cut as evenly as it can be. Ids may be null, then they
    come last, or repeat: every row is coded, and rows of one id are ordered by their
    integers. Fewer than 64 rows give as many entries. Null labels count as equal. Extra
    columns are ignored; an empty table gives an empty result.
    """
    ws = Workspace(vectors.sparkSession, "codes")
    usable = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.coalesce(F.concat(F.lit("="), F.col(label_col).cast("string")), F.lit("")).alias("label"), integer_vector(F.col(vector_col)).alias("vector"))
    kept = ws.put(usable.where("vector IS NOT NULL"), "integers")
    usual = kept.groupBy(F.size("vector").alias("width")).count().orderBy(F.desc("count"), "width").limit(1).collect()
    width, of_width = (usual[0]["width"] if usual else 0), F.size("vector") == (usual[0]["width"] if usual else 0)
    rows = kept.where(of_width)
    coder = trained(rows.select("vector"), rows.orderBy(F.col("vec_id").asc_nulls_last(), "vector").limit(ENTRIES).select("vector")) if usual else Coder(np.zeros((0, width), dtype=np.int64))
    other = kept.where(~of_width).select("vec_id", "label", F.lit(None).cast("string").alias("code"), F.lit(None).cast("long").alias("error"))
    coded = ws.put(rows.mapInArrow(_coded(coder), "vec_id bigint, label string, code string, error bigint").unionByName(other), "coded")
    by_label = ws.put(coded.groupBy("label").agg(F.sum("error").alias("label_error")), "labels")
    out = join_hot(coded, by_label, "label", coded.count())
    return out.select("vec_id", "code", "error", "label_error", F.lit(coder.sha256()).alias("codebooks_sha256"))
