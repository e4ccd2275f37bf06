"""The fielded search's pass over the chunks: what questions ask is known to every task, and only the best of it leaves one."""

from __future__ import annotations

import re
import uuid
from collections import Counter, defaultdict
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import cached_property
from hashlib import md5

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions import text
from .shared import BATCH_BYTES

#: Sums that are made at once, words of chunks that are, and words that a task remembers.
SUMS, WORDS, KNOWN = 4 << 20, 200_000, 400_000
#: The scorer of the last task, by a name of what it was told: it remembers words for the next one.
_KEPT: dict[str, _Scorer] = {}

Batches = Iterator[pa.RecordBatch]


def edits(length: int, share: float) -> int:
    """How many edits a word of a length may be away."""
    return round(length * share)


def distance(a: str, b: str, most: int) -> int:
    """Edits between two words, or a number above ``most``."""
    if abs(len(a) - len(b)) > most:
        return most + 1
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(last + (x != y), row[j] + 1, row[j - 1] + 1)
        if min(row) > most:
            return most + 1
    return row[-1]


def df_key(term: Column, field: Column, seed: int) -> Column:
    """56 bits for a term, and the number of a field below 16."""
    return F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), term).cast("binary")), 1, 14), 16, 10).cast("long") * 16 + field


def _df_keys(terms: list[str], fields: int, seed: int) -> np.ndarray:
    """A row for each term, a column for each field."""
    own = [int.from_bytes(md5(f"{seed}:{t}".encode()).digest()[:7], "big") for t in terms]
    return np.array(own, np.int64)[:, None] * 16 + np.arange(fields)


@dataclass
class Frequencies:
    """Chunks with a field's term by ``df_key``, sorted: of all terms that ``least`` chunks have, and maybe of others. The rest are in fewer chunks."""

    keys: np.ndarray
    df: np.ndarray
    least: int
    seed: int

    def of(self, keys: np.ndarray) -> np.ndarray:
        """df of keys, 0 where it isn't known."""
        if not len(self.keys):
            return np.zeros(keys.shape, np.int64)
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        return np.where(self.keys[at] == keys, self.df[at], 0).astype(np.int64)


@dataclass
class Asked:
    """Questions (question_id, terms, numbers), and how their words are weighed."""

    questions: list[tuple]
    fields: dict[str, tuple[float, int, int]]  # boost, chunks with words, their words
    weights: tuple[float, float, float]  # of prefixes and near spellings, and the share of edits
    saturation: tuple[float, float]  # k1, b

    @cached_property
    def ids(self) -> list:
        return list(dict.fromkeys(q for q, _, _ in self.questions))

    @cached_property
    def terms(self) -> dict[str, int]:
        return {t: i for i, t in enumerate(sorted({t for _, own, _ in self.questions for t in own or ()}))}

    @cached_property
    def askers(self) -> tuple[np.ndarray, np.ndarray]:
        """Of each term, where its questions begin and how many they are; and the questions."""
        place = {q: i for i, q in enumerate(self.ids)}
        pairs = sorted({(self.terms[t], place[q]) for q, own, _ in self.questions for t in own or ()})
        starts = np.searchsorted(np.array([t for t, _ in pairs], np.int64), np.arange(len(self.terms) + 1))
        return starts, np.array([q for _, q in pairs], np.int64)

    @cached_property
    def numbers(self) -> tuple[np.ndarray, dict[str, list[int]]]:
        """Which questions name no number, and those that name one."""
        place, free, naming = {q: i for i, q in enumerate(self.ids)}, np.zeros(len(self.ids), bool), defaultdict(list)
        for q, _, own in self.questions:
            free[place[q]] |= own is not None and not own
            for n in own or ():
                naming[n].append(place[q])
        return free, dict(naming)

    def allowed(self, case: str | None) -> np.ndarray:
        """Questions that a case's chunks may answer."""
        free, naming = self.numbers
        out, case = free.copy(), case or ""
        for part in {case[i : i + n] for n in {len(x) for x in naming} for i in range(len(case) - n + 1)}:
            out[naming.get(part, [])] = True
        return out

    @cached_property
    def _spellings(self) -> tuple:
        """Lengths of asked words; those of one edit without each letter, and by its place; those of more by their length, and their pieces, one of which stays as it is."""
        bare, placed, pieces, single = defaultdict(list), defaultdict(lambda: defaultdict(list)), defaultdict(lambda: defaultdict(list)), {}
        for t in self.terms:
            d = edits(len(t), self.weights[2])
            if d == 1:
                single[t] = t
                for i in range(len(t)):
                    without = t[:i] + t[i + 1 :]
                    bare[without].append(t)
                    placed[i][without].append(t)
            elif d:
                cuts = [len(t) * i // (d + 1) for i in range(d + 2)]
                for lo, hi in zip(cuts, cuts[1:]):
                    pieces[len(t), d][lo, hi - lo, t[lo:hi]].append(t)
        spots = [(n, d, sorted({(lo, m, at) for lo, m, _ in own for at in range(max(0, lo - d), lo + d + 1)}), dict(own)) for (n, d), own in pieces.items()]
        sizes = {len(t) + e for t in single for e in (-1, 0, 1)}
        return sorted({len(t) for t in self.terms}), sizes, single, dict(bare), [dict(placed[i]) for i in range(1 + max(placed, default=-1))], spots

    def like(self, word: str) -> dict[int, float]:
        """Asked words that a word equals (1), that open it, or that are near by edits, with their weights."""
        lengths, sizes, single, bare, placed, spots = self._spellings
        opening, near, _ = self.weights
        out, size, close, terms = {}, len(word), {}, self.terms
        for n in lengths:
            if n > size:
                break
            if (t := terms.get(word[:n])) is not None:
                out[t] = 1.0 if n == size else opening * n / size
        if size in sizes:
            for i in range(size):
                without = word[:i] + word[i + 1 :]
                if without in single:
                    close[without] = 1
                if i < len(placed) and without in placed[i]:
                    close.update(dict.fromkeys(placed[i][without], 1))
            if word in bare:
                close.update(dict.fromkeys(bare[word], 1))
        for n, d, each, own in spots:
            if -d <= n - size <= d:
                for t in {t for lo, m, at in each for t in own.get((lo, m, word[at : at + m]), ())}:
                    if (e := distance(t, word, d)) <= d:
                        close[t] = e
        for t, e in close.items():
            out.setdefault(terms[t], near * len(t) / (len(t) + e))
        return out


class _Words(dict):
    """Numbers of the words that a task has met, -1 for those like no asked one; ``starts``, ``asked`` and ``weights`` have what each is like, ``low`` and ``high`` its df by fields."""

    def __init__(self, told: Asked, known: Frequencies):
        self.told, self.known = told, known
        self.forget()

    def forget(self) -> None:
        self.clear()
        self.starts, self.asked, self.weights = np.zeros(1, np.int64), np.zeros(0, np.int64), np.zeros(0)
        self.low = self.high = np.zeros((0, len(self.told.fields)))
        self.n, self.new = 0, []

    def __missing__(self, word: str) -> int:
        like, at = self.told.like(word), -1
        if like:
            at, self.n = self.n, self.n + 1
            self.new.append((word, like))
        self[word] = at
        return at

    def settle(self) -> None:
        """Enter the new words."""
        if not self.new:
            return
        sizes = np.cumsum([len(like) for _, like in self.new])
        self.starts = np.concatenate([self.starts, self.starts[-1] + sizes])
        self.asked = np.concatenate([self.asked, np.array([t for _, like in self.new for t in like], np.int64)])
        self.weights = np.concatenate([self.weights, np.array([w for _, like in self.new for w in like.values()])])
        df = self.known.of(_df_keys([word for word, _ in self.new], len(self.told.fields), self.known.seed))
        self.low = np.concatenate([self.low, np.where(df == 0, 1, df)])
        self.high = np.concatenate([self.high, np.where(df == 0, max(1, self.known.least - 1), df)])
        self.new = []


def _spread(starts: np.ndarray, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Members of groups that lie together: of each of ``which``, its place there, and the members' places."""
    sizes = starts[which + 1] - starts[which]
    rows = np.repeat(np.arange(len(which)), sizes)
    return rows, np.arange(len(rows)) - np.repeat(np.cumsum(sizes) - sizes, sizes) + starts[which][rows]


class _Scorer:
    """Scores of some chunks for all questions at a time."""

    def __init__(self, told: Asked, known: Frequencies):
        self.told, self.words, self.exact = told, _Words(told, known), known.least <= 2
        starts, asking = told.askers
        self.at_once = max(1, SUMS // max(1, len(told.terms), len(told.ids), len(asking)))
        self.boost, self.docs, self.all = (np.array(x, float) for x in zip(*told.fields.values()))

    def __call__(self, chunks: list[list[list[str]]]) -> tuple[np.ndarray, np.ndarray]:
        """Of chunks (the words of each field), the least and the most that a question may find in each."""
        if len(self.words) > KNOWN:
            self.words.forget()
        codes, tf, runs = [], [], []
        for c, fields in enumerate(chunks):
            for f, own in enumerate(fields):
                counts = Counter(own)
                codes.extend(map(self.words.__getitem__, counts))
                tf.extend(counts.values())
                runs.append((len(own), len(counts), f, c))
        self.words.settle()
        codes, tf = np.array(codes, np.int64), np.array(tf, float)
        size, field, chunk = (np.repeat([r[k] for r in runs], [r[1] for r in runs])[codes >= 0] for k in (0, 2, 3))
        codes, tf = codes[codes >= 0], tf[codes >= 0]
        most = self._sums(self.words.low[codes, field], codes, tf, size, field, chunk, len(chunks))
        return (most if self.exact else self._sums(self.words.high[codes, field], codes, tf, size, field, chunk, len(chunks))), most

    def _sums(self, df: np.ndarray, codes: np.ndarray, tf: np.ndarray, size: np.ndarray, field: np.ndarray, chunk: np.ndarray, chunks: int) -> np.ndarray:
        k1, b = self.told.saturation
        each = self.boost[field] * np.log(1 + (self.docs[field] - df + 0.5) / (df + 0.5)) * tf * (k1 + 1) / (tf + k1 * (1 - b + b * size * self.docs[field] / self.all[field]))
        rows, pairs = _spread(self.words.starts, codes)
        n = len(self.told.terms)
        parts = np.bincount(chunk[rows] * n + self.words.asked[pairs], each[rows] * self.words.weights[pairs], chunks * n)
        held = np.flatnonzero(parts)
        starts, asking = self.told.askers
        rows, pairs = _spread(starts, held % n)
        m = len(self.told.ids)
        return np.bincount((held // n)[rows] * m + asking[pairs], parts[held][rows], chunks * m).reshape(chunks, m)


def best_chunks(told: Broadcast, known: Broadcast, schema: pa.Schema, decimals: int, most: int, floors: dict | None = None) -> Callable[[Batches], Batches]:
    """(id, case_number, lower-case text of each field) to ``schema`` (question_id, id, base): each task's ``most`` best chunks of each question.

    Where a word's df isn't known, base is the least that it may be. With ``floors``, instead, the chunks
    that may have as much for some question as its floor, each once, with nulls for the others.
    """
    word, name = re.compile(text.TOKEN), uuid.uuid4().hex

    def given(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind) for k, kind in zip((0, 2, 1), schema.types)], schema=schema)

    def run(batches: Batches) -> Batches:
        asked = told.value
        if name not in _KEPT:
            _KEPT.clear()
            _KEPT[name] = _Scorer(asked, known.value)
        score, m = _KEPT[name], len(asked.ids)
        floor = np.full(m, -1.0) if floors is None else np.array([floors.get(q, 0.0) for q in asked.ids])
        kept: list[tuple] = []

        def best(rows: list[tuple]) -> list[tuple]:
            rows.sort(key=lambda r: (r[0], -r[1], r[2] is not None, r[2]))
            out, count = [], Counter()
            for r in rows:
                count[r[0]] += 1
                if count[r[0]] <= most:
                    out.append(r)
                if count[r[0]] == most:
                    floor[r[0]] = r[1]
            return out

        for rows, at, fields in _parts(batches, word, score.at_once):
            least, highest = score(fields)
            found = highest > 0
            for c, case in enumerate(rows.column("case_number").slice(at, len(fields)).to_pylist()):
                found[c] &= asked.allowed(case)
            base = np.round(least if floors is None else highest, decimals)
            c, q = np.nonzero(found & (base >= floor))
            ids = {i: rows.column("id")[at + i].as_py() for i in np.unique(c).tolist()}
            if floors is not None:
                yield given([(None, None, i) for i in ids.values()])
                continue
            kept += zip(q.tolist(), base[c, q].tolist(), map(ids.__getitem__, c.tolist()))
            if len(kept) > 4 * m * most:
                kept = best(kept)
        if kept:
            yield given([(asked.ids[q], base, i) for q, base, i in best(kept)])

    return run


def _parts(batches: Batches, word: re.Pattern, most: int) -> Iterator[tuple[pa.RecordBatch, int, list]]:
    """(batch, place, words by chunk and field): up to ``most`` chunks from a place on, and fewer where they are long."""
    for whole in batches:
        step = max(1, int(len(whole) * BATCH_BYTES / max(1, whole.nbytes)))
        for first in range(0, len(whole), step):
            batch = whole.slice(first, step)
            held, n, at = [], 0, 0
            for i, texts in enumerate(zip(*(c.to_pylist() for c in batch.columns[2:]))):
                held.append([word.findall(t) for t in texts])
                n += sum(map(len, held[-1]))
                if len(held) >= most or n >= WORDS:
                    yield batch, at, held
                    held, n, at = [], 0, i + 1
            if held:
                yield batch, at, held
