"""Words of whole UTF-8 texts as 64-bit hashes, over Arrow buffers without Python strings.

A word is a maximal run of bytes other than 0x20 and 0x09-0x0D. Texts are handled in
segments of bounded size that end at white space, so memory does not follow the
longest text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SEGMENT_BYTES = 1 << 18
U64 = np.uint64

IS_SPACE = np.zeros(256, dtype=bool)
IS_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
#: A-Z to a-z, all else unchanged.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

_BYTE = np.random.default_rng(20240229).integers(1, 2**63, size=256, dtype=np.uint64) | U64(1)
_BASE = U64(0x9E3779B97F4A7C55)


def fmix(h: np.ndarray) -> np.ndarray:
    """A bijective mix of 64-bit values."""
    h = (h ^ (h >> U64(33))) * U64(0xFF51AFD7ED558CCD)
    h = (h ^ (h >> U64(33))) * U64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> U64(33))


_powers = np.multiply.accumulate(np.concatenate([np.ones(1, dtype=np.uint64), np.full(4095, _BASE, dtype=np.uint64)]))


def _power_table(size: int) -> np.ndarray:
    global _powers
    while len(_powers) < size:
        _powers = np.concatenate([_powers, _powers * (_powers[-1] * _BASE)])
    return _powers


def string_buffers(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and row offsets of a string column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column, "") if column.null_count else column
    wide = pa.types.is_large_string(column.type)
    _, ends, data = column.buffers()
    offsets = np.frombuffer(ends, dtype=np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1] if ends and len(column) else np.zeros(len(column) + 1, dtype=np.int64)
    return np.frombuffer(data, dtype=np.uint8) if data else np.zeros(0, dtype=np.uint8), offsets.astype(np.int64)


def segments(data: np.ndarray, offsets: np.ndarray, limit: int = SEGMENT_BYTES) -> Iterator[list[tuple[int, int, int]]]:
    """Groups of (row, first byte, end byte) with about ``limit`` bytes in all; long rows are cut at white space."""
    group: list[tuple[int, int, int]] = []
    held = 0
    for row in range(len(offsets) - 1):
        at, end = int(offsets[row]), int(offsets[row + 1])
        while True:
            cut = end
            if end - at > limit:
                window = at + limit
                while window < end:  # one word may be longer than the limit
                    spaces = np.flatnonzero(IS_SPACE[data[window : window + limit]])
                    if len(spaces):
                        cut = window + int(spaces[0])
                        break
                    window += limit
            group.append((row, at, cut))
            held += cut - at
            if held >= limit:
                yield group
                group, held = [], 0
            at = cut
            if at >= end:
                break
    if group:
        yield group


def word_bounds(data: np.ndarray, group: list[tuple[int, int, int]]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The group's bytes (contiguous), word starts and ends in them, and words per segment."""
    first, last = group[0][1], group[-1][2]
    part = data[first:last]
    edges = np.array([s for _, s, _ in group], dtype=np.int64) - first
    solid = ~IS_SPACE[part]
    opens = solid.copy()
    opens[1:] &= ~solid[:-1]
    inner = edges[(edges > 0) & (edges < len(part))]
    opens[inner] = solid[inner]  # a text's first byte opens a word whatever stands before
    closes = solid.copy()
    closes[:-1] &= ~solid[1:]
    closes[inner - 1] = solid[inner - 1]
    starts, ends = np.flatnonzero(opens), np.flatnonzero(closes) + 1
    counts = np.diff(np.concatenate([np.searchsorted(starts, edges), [len(starts)]]))
    return part, starts, ends, counts


def span_hashes(part: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A hash of the bytes of each span; spans are in order and don't overlap."""
    if not len(starts):
        return np.zeros(0, dtype=np.uint64)
    size = ends - starts
    total = np.cumsum(size)
    place = np.arange(total[-1]) - np.repeat(total - size, size)
    values = _BYTE[part[np.repeat(starts, size) + place]] * _power_table(int(size.max()))[place]
    return fmix(np.add.reduceat(values, total - size) + size.astype(np.uint64))


def row_words(column: pa.Array | pa.ChunkedArray, lower: bool = True) -> Iterator[np.ndarray]:
    """The word hashes of each row in order; with ``lower``, A-Z count as a-z."""
    data, offsets = string_buffers(column)
    current, parts = 0, []
    for group in segments(data, offsets):
        part, starts, ends, counts = word_bounds(data, group)
        hashes = span_hashes(LOWER[part] if lower else part, starts, ends)
        at = 0
        for (row, _, _), n in zip(group, counts.tolist(), strict=True):
            while current < row:
                yield np.concatenate(parts) if len(parts) != 1 else parts[0]
                current, parts = current + 1, []
            parts.append(hashes[at : at + n])
            at += n
    if len(offsets) > 1:
        yield np.concatenate(parts) if len(parts) != 1 else parts[0]


_MIX = (U64(0x9E3779B97F4A7C15), U64(0xC2B2AE3D27D4EB4F), U64(0x165667B19E3779F9), U64(0xD6E8FEB86659FD93), U64(0xA0761D6478BD642F))


def shingle_set(words: np.ndarray, k: int) -> np.ndarray:
    """Sorted distinct hashes of the k-word shingles; fewer words count as one shingle, none as the empty set."""
    n = len(words)
    if n == 0:
        return words
    span, length = (1, n) if n < k else (n - k + 1, k)
    out = np.full(span, length, dtype=np.uint64)
    for j in range(length):
        out = out * _MIX[0] + words[j : j + span] * _MIX[1 + j % 4]
        out ^= out >> U64(29)
    return np.unique(fmix(out))
