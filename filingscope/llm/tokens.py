"""Token ids of whole texts, by a table of the words seen so far.

The tokenizers meant here drop white space and never join across it, so a text's ids
are those of its words in a row. Words are hashed over the Arrow buffer; only words
that a worker has not met go to the tokenizer, in batches.
"""

from __future__ import annotations

import os
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa

from .wordhash import U64, segments, span_hashes, string_buffers, word_bounds
from .workers import KEPT

#: Words that a worker remembers, and ids of theirs; beyond either the table starts anew.
TABLE_WORDS, TABLE_IDS = 3_000_000, 1 << 24
#: Words that go to the tokenizer at once: each comes back as an object that is many times its size.
ENCODE_WORDS = 4096

_IS_LETTER, _IS_UPPER, _IS_LOWER, _IS_MARK = (np.zeros(256, dtype=bool) for _ in range(4))
_IS_UPPER[65:91] = _IS_LOWER[97:123] = True
_IS_LETTER |= _IS_UPPER | _IS_LOWER
_IS_MARK[list(b".,;:!?")] = True


class WordIds:
    """Ids by word hash: an open-addressing table beside a pool of ids."""

    def __init__(self, tokenizer_file: str):
        self.most = TABLE_WORDS
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(tokenizer_file)
        self.encode = tokenizer.encode_batch_fast
        self.kind = np.uint16 if tokenizer.get_vocab_size() <= 1 << 16 else np.uint32
        comma = self.encode([","], add_special_tokens=False)[0].ids
        self.comma = comma[0] if len(comma) == 1 else -1
        self._clear()

    def _clear(self) -> None:
        self.words, self.used = 0, 0
        self.keys, self.first, self.size = np.zeros(1 << 16, dtype=np.uint64), np.zeros(1 << 16, dtype=np.uint32), np.zeros(1 << 16, dtype=np.uint32)
        self.pool = np.zeros(1 << 18, dtype=self.kind)
        self._slots(1 << 18)

    def _slots(self, n: int) -> None:
        self.slots, self.shift = np.full(n, -1, dtype=np.int32), U64(64 - n.bit_length() + 1)
        self._place(np.arange(self.words, dtype=np.int32))

    def _place(self, entries: np.ndarray) -> None:
        at, mask = (self.keys[entries] >> self.shift).astype(np.int64), len(self.slots) - 1
        while len(entries):
            free = self.slots[at] < 0
            self.slots[at[free]] = entries[free]  # of several, the last stays
            out = self.slots[at] != entries
            at, entries = (at[out] + 1) & mask, entries[out]

    def find(self, hashes: np.ndarray) -> np.ndarray:
        """Entry of each hash, -1 if unknown."""
        found, open_ = np.full(len(hashes), -1, dtype=np.int32), np.arange(len(hashes))
        at, mask = (hashes >> self.shift).astype(np.int64), len(self.slots) - 1
        while len(open_):
            entry = self.slots[at]
            hit = (entry >= 0) & (self.keys[entry] == hashes[open_])
            found[open_[hit]] = entry[hit]
            on = (entry >= 0) & ~hit
            open_, at = open_[on], (at[on] + 1) & mask
        return found

    def _each(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the words in a row, and how many each has."""
        ids = [e.ids for e in self.encode(words, add_special_tokens=False)]
        sizes = np.fromiter(map(len, ids), dtype=np.uint32, count=len(ids))
        return np.fromiter(chain.from_iterable(ids), dtype=self.kind, count=int(sizes.sum())), sizes

    def _joined(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The same for words without a comma, as one text with commas between them; one by one if the commas' ids don't tell the words apart."""
        ids = np.array(self.encode([" , ".join(words)], add_special_tokens=False)[0].ids, dtype=self.kind)
        cuts = np.flatnonzero(ids == self.comma)
        if len(cuts) != len(words) - 1:
            return self._each(words)
        ends = np.append(cuts, len(ids))
        return np.delete(ids, cuts), np.diff(ends - np.arange(len(ends)), prepend=0).astype(np.uint32)

    def add(self, hashes: np.ndarray, words: list[str]) -> None:
        apart = np.array(["," in w for w in words])
        order, parts, counts = [], [], []
        for rows, encoded in ((np.flatnonzero(~apart), self._joined), (np.flatnonzero(apart), self._each)):
            for at in range(0, len(rows), ENCODE_WORDS):
                ids, sizes = encoded([words[i] for i in rows[at : at + ENCODE_WORDS].tolist()])
                parts.append(ids)
                counts.append(sizes)
            order.append(rows)
        hashes = hashes[np.concatenate(order)]
        n, sizes, flat = self.words + len(words), np.concatenate(counts), np.concatenate(parts)
        grow = lambda a, size: np.concatenate([a, np.zeros(max(len(a), size - len(a)), dtype=a.dtype)]) if size > len(a) else a
        self.keys, self.first, self.size, self.pool = grow(self.keys, n), grow(self.first, n), grow(self.size, n), grow(self.pool, self.used + len(flat))
        new = slice(self.words, n)
        self.keys[new], self.size[new] = hashes, sizes
        self.first[new] = self.used + np.cumsum(sizes, dtype=np.int64) - sizes
        self.pool[self.used : self.used + len(flat)] = flat
        entries = np.arange(self.words, n, dtype=np.int32)
        self.words, self.used = n, self.used + len(flat)
        if 2 * n > len(self.slots):
            self._slots(1 << (2 * n).bit_length())
        else:
            self._place(entries)

    def units(self, data: np.ndarray, group: list[tuple[int, int, int]], counts_only: bool = False) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the group's texts in a row (none if only counts are wanted), and ids per segment."""
        part, starts, ends, counts = word_bounds(data, group)
        if not len(starts):
            return np.zeros(0, dtype=self.kind), np.zeros(len(group), dtype=np.int64)
        # Closing marks after an ASCII letter are a unit of their own; a capital before a small letter counts as small. Neither changes an id.
        solid = np.where(_IS_MARK[part], -1, np.arange(len(part)))
        core = np.maximum.accumulate(solid)[ends - 1]
        split = (core >= starts) & (core < ends - 1)
        split[split] = _IS_LETTER[part[core[split]]]
        of = np.repeat(np.arange(len(group)), counts)
        if split.any():
            cut = core[split] + 1
            order = np.argsort(np.concatenate([starts, cut]), kind="stable")
            starts, ends = np.concatenate([starts, cut])[order], np.concatenate([np.where(split, core + 1, ends), ends[split]])[order]
            of = np.concatenate([of, of[split]])[order]
        second = part[np.minimum(starts + 1, len(part) - 1)]
        fold = starts[_IS_UPPER[part[starts]] & ((ends - starts == 1) | _IS_LOWER[second])]
        part = part.copy()
        part[fold] += 32
        hashes = span_hashes(part, starts, ends)
        entry = self.find(hashes)
        if (miss := np.flatnonzero(entry < 0)).size:
            if self.words > self.most or self.used > TABLE_IDS:
                self._clear()
                miss = np.arange(len(hashes))
            new, at = np.unique(hashes[miss], return_index=True)
            raw = part.tobytes()
            self.add(new, [raw[starts[i] : ends[i]].decode() for i in miss[at].tolist()])
            entry[miss] = self.find(hashes[miss])
        size = self.size[entry].astype(np.int64)
        each = np.bincount(of, weights=size, minlength=len(group)).astype(np.int64)
        if counts_only:
            return np.zeros(0, dtype=self.kind), each
        total = np.cumsum(size)
        return self.pool[np.repeat(self.first[entry].astype(np.int64) - total + size, size) + np.arange(total[-1])], each

    def counts(self, column: pa.Array) -> np.ndarray:
        """Ids of each row, without the closing one."""
        data, offsets = string_buffers(column)
        out = np.zeros(max(0, len(offsets) - 1), dtype=np.int64)
        for group in segments(data, offsets):
            np.add.at(out, [row for row, _, _ in group], self.units(data, group, counts_only=True)[1])
        return out

    def rows(self, column: pa.Array, end_id: int) -> Iterator[np.ndarray]:
        """Each row's ids with ``end_id`` after them, in order; null counts as empty."""
        data, offsets = string_buffers(column)
        current, parts, end = 0, [], np.array([end_id], dtype=np.uint32)
        for group in segments(data, offsets):
            ids, counts = self.units(data, group)
            at = 0
            for (row, _, _), n in zip(group, counts.tolist(), strict=True):
                while current < row:
                    yield np.concatenate([*parts, end])
                    current, parts = current + 1, []
                parts.append(ids[at : at + n])
                at += n
        if len(offsets) > 1:
            yield np.concatenate([*parts, end])


_tables: dict[str, WordIds] = KEPT.setdefault("words", {})


def word_ids(tokenizer_file: str, most_words: int = TABLE_WORDS) -> WordIds:
    """This worker's table for a tokenizer file."""
    if tokenizer_file not in _tables:
        _tables[tokenizer_file] = WordIds(tokenizer_file)
    _tables[tokenizer_file].most = most_words
    return _tables[tokenizer_file]
