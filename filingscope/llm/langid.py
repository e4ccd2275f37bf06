"""Language of whole texts by Viterbi over per-word scores.

A word is a maximal run of letters of one script. Its score under a language is the sum
over its letters of the log-probability of the letter with its neighbours (hashed
trigrams, word edges included). The word's script narrows the languages to those that
use it. A Viterbi pass with a penalty for each switch labels the words; a document's
language is the one with the most letters.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .sampling import hash_limit
from .workers import bounded

#: Hash values of a trigram, the smoothing count, nats a switch costs, and nats a word can speak for a language at most.
TRIGRAMS, SMOOTHING, SWITCH, MOST_A_WORD = 1 << 16, 0.5, 8.0, 20.0
#: The model is fitted on at most this many labelled documents of a language.
DOCS_A_LANGUAGE = 400
#: A script belongs to a language if it has this share of the letters that the model was fitted on.
SCRIPT_SHARE = 0.01
#: Characters that are scored at once.
CHUNK_CHARS = 1 << 17
#: Words that the Viterbi pass takes at once, whole texts together.
GROUP_WORDS = 1 << 19
#: Bytes of texts that a task predicts at once; the Viterbi pass takes as many steps as the longest of them has words.
SLICE = 8 << 20

# First and last code point of the scripts' main ranges.
SCRIPTS = (
    (0x0041, 0x024F), (0x0370, 0x03FF), (0x0400, 0x052F), (0x0530, 0x058F), (0x0590, 0x05FF), (0x0600, 0x077F), (0x0900, 0x097F), (0x0980, 0x09FF), (0x0A00, 0x0A7F), (0x0B80, 0x0BFF),
    (0x0C00, 0x0C7F), (0x0D00, 0x0D7F), (0x0E00, 0x0E7F), (0x0E80, 0x0EFF), (0x10A0, 0x10FF), (0x1100, 0x11FF), (0x1200, 0x137F), (0x1780, 0x17FF), (0x1E00, 0x1EFF), (0x1F00, 0x1FFF),
    (0x3040, 0x309F), (0x30A0, 0x30FF), (0x3400, 0x9FFF), (0xAC00, 0xD7AF),
)

_tables: list[np.ndarray] = []


def _script_of() -> np.ndarray:
    """Script number (from 1) of each letter; 0 for what is no letter."""
    if not _tables:
        table = np.zeros(0x110000, dtype=np.uint8)
        for c in range(0x110000):
            if chr(c).isalpha():
                table[c] = len(SCRIPTS) + 1
        for i, (lo, hi) in enumerate(SCRIPTS):
            part = table[lo : hi + 1]
            part[part > 0] = 1 if lo == 0x1E00 else 2 if lo == 0x1F00 else i + 1
        _tables.append(table)
    return _tables[0]


def _chars(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of the lower-cased texts, each closed by a line feed, and the texts' ends."""
    lowered = [unicodedata.normalize("NFC", t).lower() if t else "" for t in texts]
    points = np.frombuffer(("\n".join(lowered) + "\n").encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    return points, np.cumsum([len(t) + 1 for t in lowered])


def words_of(points: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Words' starts and ends, scripts, and of each of their letters the place and the trigram's hash."""
    script = _script_of()[points]
    before, after = np.concatenate([[0], script[:-1]]), np.concatenate([script[1:], [0]])
    letter = script > 0
    starts, ends = np.flatnonzero(letter & (before != script)), np.flatnonzero(letter & (after != script)) + 1
    at = np.flatnonzero(letter)
    same_left, same_right = before[at] == script[at], after[at] == script[at]
    left = np.where(same_left, points[at - 1], 0).astype(np.uint64)  # at 0, the place before is the closing line feed
    right = np.where(same_right, points[np.minimum(at + 1, len(points) - 1)], 0).astype(np.uint64)
    h = (left * np.uint64(0x9E3779B97F4A7C15)) ^ (points[at] * np.uint64(0xC2B2AE3D27D4EB4F)) ^ (right * np.uint64(0x165667B19E3779F9))
    return starts, ends, script[starts], at, ((h * np.uint64(0xD6E8FEB86659FD93)) >> np.uint64(48)).astype(np.int64)


class Model:
    """Trigram log-probabilities (trigram x language) and the languages of each script."""

    def __init__(self, languages: list[str], counts: np.ndarray, scripts: np.ndarray):
        self.languages = languages
        totals = counts.sum(axis=0)
        self.score = (np.log(counts + SMOOTHING) - np.log(totals + SMOOTHING * TRIGRAMS)).astype(np.float32)
        self.uses = scripts >= SCRIPT_SHARE * np.maximum(scripts.sum(axis=0), 1)
        self.uses[~self.uses.any(axis=1)] = True  # a script that no language uses decides nothing

    def word_scores(self, starts: np.ndarray, ends: np.ndarray, scripts: np.ndarray, grams: np.ndarray) -> np.ndarray:
        if not len(starts):
            return np.zeros((0, len(self.languages)), dtype=np.float32)
        size = ends - starts
        sums = np.add.reduceat(self.score[grams], np.cumsum(size) - size, axis=0)
        sums = np.maximum(sums - sums.max(axis=1, keepdims=True), -MOST_A_WORD)
        sums[~self.uses[scripts]] = -10 * MOST_A_WORD
        return sums


def viterbi(scores: np.ndarray, counts: np.ndarray, penalty: float = SWITCH) -> np.ndarray:
    """Best language of each word; ``counts`` words of ``scores`` belong to each text.

    The texts go side by side, longest first, one word of each at a time: the words are
    laid out by their place in the text, so each step works on neighbouring memory.
    """
    order = np.argsort(-counts, kind="stable")
    lengths = counts[order]
    steps = int(counts.max(initial=0))
    active = len(counts) - np.searchsorted(lengths[::-1], np.arange(steps), side="right")  # texts longer than t words
    offset = np.cumsum(active) - active
    rank = np.repeat(np.arange(len(counts)), lengths)
    t = np.arange(len(scores)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    word = np.empty(len(scores), dtype=np.int64)
    word[offset[t] + rank] = np.repeat((np.cumsum(counts) - counts)[order], lengths) + t
    laid = np.ascontiguousarray(scores[word].T)
    kind = np.min_scalar_type(max(1, scores.shape[1] - 1))
    came, stay = np.zeros(len(scores), dtype=kind), np.zeros(laid.shape, dtype=bool)
    best = np.zeros((laid.shape[0], len(counts)), dtype=np.float32)
    for at, n in zip(offset.tolist(), active.tolist(), strict=True):
        now = best[:, :n]
        came[at : at + n] = now.argmax(axis=0)
        now -= now.max(axis=0)
        np.greater_equal(now, -penalty, out=stay[:, at : at + n])
        np.maximum(now, -penalty, out=now)
        now += laid[:, at : at + n]
    labels = np.zeros(len(scores), dtype=kind)
    state = best.argmax(axis=0)
    for at, n in zip(offset[::-1].tolist(), active[::-1].tolist(), strict=True):
        now = state[:n]
        labels[at : at + n] = now
        state[:n] = np.where(stay[now, np.arange(at, at + n)], now, came[at : at + n])
    out = np.empty_like(labels)
    out[word] = labels
    return out


def _chunks(texts: list[str | None]) -> Iterator[tuple[int, int]]:
    lo, held = 0, 0
    for i, t in enumerate(texts):
        held += len(t or "") + 1
        if held >= CHUNK_CHARS:
            yield lo, i + 1
            lo, held = i + 1, 0
    if lo < len(texts):
        yield lo, len(texts)


def _labelled(model: Model, texts: list[str | None]) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]:
    """First and end text of a group, and of each of its words the text, the letters and the label."""
    first, held, counts, letters, scores = 0, 0, [], [], []
    for lo, hi in _chunks(texts):
        points, ends_of = _chars(texts[lo:hi])
        starts, ends, scripts, _, grams = words_of(points)
        counts.append(np.diff(np.searchsorted(starts, ends_of), prepend=0))
        letters.append(ends - starts)
        scores.append(model.word_scores(starts, ends, scripts, grams))
        held += len(starts)
        if held >= GROUP_WORDS or hi == len(texts):
            n = np.concatenate(counts)
            yield first, hi, np.repeat(np.arange(hi - first), n), np.concatenate(letters), viterbi(np.concatenate(scores), n)
            first, held, counts, letters, scores = hi, 0, [], [], []


def _predict(model: Model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k = len(model.languages)
        names = [*model.languages, "und"]
        for batch in batches:
            texts = batch.column(0).to_pylist()
            pred, score = np.full(len(texts), k), np.zeros(len(texts))
            for lo, hi, of, letters, labels in _labelled(model, texts):
                share = np.bincount(of * k + labels, weights=letters, minlength=(hi - lo) * k).reshape(hi - lo, k)
                total = share.sum(axis=1)
                pred[lo:hi] = np.where(total > 0, share.argmax(axis=1), k)
                score[lo:hi] = share.max(axis=1) / np.maximum(total, 1)
            out = [pa.array([names[i] for i in pred], pa.string()), pa.array(score)]
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], *out], [*batch.schema.names[1:], "lang_pred", "score"])

    return bounded(run, SLICE)


def spans(model: Model, text: str | None) -> list[tuple[int, int, str]]:
    """(start, end, language) of the runs of words with one label, in code points of the text."""
    if not text or len(unicodedata.normalize("NFC", text).lower()) != len(text):
        text = unicodedata.normalize("NFC", text or "").lower()
    points, _ = _chars([text])
    starts, ends, scripts, _, grams = words_of(points)
    labels = viterbi(model.word_scores(starts, ends, scripts, grams), np.array([len(starts)]))
    cuts = np.flatnonzero(np.diff(labels.astype(np.int64), prepend=-1)) if len(labels) else []
    lasts = [*(np.array(cuts[1:]) - 1), len(labels) - 1] if len(cuts) else []
    return [(int(starts[i]), int(ends[j]), model.languages[labels[i]]) for i, j in zip(cuts, lasts, strict=True)]


def _count(languages: list[str]):
    """Trigram and script counts of labelled texts (text, lang): one row for each value that occurs in a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place = {x: i for i, x in enumerate(languages)}
        width = TRIGRAMS + len(SCRIPTS) + 2
        counts = np.zeros((len(languages), width), dtype=np.int64)
        for batch in batches:
            for text, lang in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                points, _ = _chars([text])
                starts, ends, scripts, _, grams = words_of(points)
                own = counts[place[lang]]
                own[:TRIGRAMS] += np.bincount(grams, minlength=TRIGRAMS)
                own[TRIGRAMS:] += np.bincount(scripts, weights=ends - starts, minlength=width - TRIGRAMS).astype(np.int64)
        lang, value = np.nonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(lang.astype(np.int32)), pa.array(value.astype(np.int32)), pa.array(counts[lang, value])], ["lang", "value", "n"])

    return bounded(run)


def fit(labelled: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", docs_a_language: int = DOCS_A_LANGUAGE) -> Model | None:
    """A model of the languages that occur in ``labelled``, or None without any.

    Fitted on at most ``docs_a_language`` documents of each: those with the smallest
    hashes of their ids. Rows without a label, id or text are passed over.
    """
    rows = labelled.select(F.col(id_col).alias("id"), F.col(lang_col).cast("string").alias("lang"), F.col(text_col).cast("string").alias("text")).where("id IS NOT NULL AND lang IS NOT NULL AND text IS NOT NULL")
    counts_by = {r["lang"]: r["count"] for r in rows.groupBy("lang").count().collect()}
    languages = sorted(counts_by)
    if not languages:
        return None
    # A bound on the hash lets through a few times as many of each language; those are ranked.
    bound = F.create_map(*(F.lit(x) for lang, n in counts_by.items() for x in (lang, hash_limit(n, docs_a_language))))
    order = Window.partitionBy("lang").orderBy(F.xxhash64("id"), "id")
    few = rows.select("id", "lang").where(F.xxhash64("id") <= bound[F.col("lang")])
    chosen = few.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= docs_a_language).select("id", "lang")
    # At most docs_a_language rows of each language, so the broadcast is bounded.
    some = rows.join(F.broadcast(chosen), ["id", "lang"], "left_semi").select("text", "lang")
    found = some.mapInArrow(_count(languages), "lang int, value int, n bigint").groupBy("lang", "value").agg(F.sum("n").alias("n")).toPandas()
    counts = np.zeros((TRIGRAMS + len(SCRIPTS) + 2, len(languages)))
    counts[found["value"], found["lang"]] = found["n"]
    return Model(languages, counts[:TRIGRAMS], counts[TRIGRAMS:])


def predict(docs: DataFrame, model: Model | None, text_col: str = "text", *keep: Column) -> DataFrame:
    """``keep`` and lang_pred, score of each row: the language with the most letters and its share of them.

    ``und`` with score 0 if the text is null or has no letter, or without a model. Ties
    go to the language that is first by code point. Rows are returned as they come,
    repeated ones too; an empty table gives an empty result.
    """
    model = model or Model(["und"], np.ones((TRIGRAMS, 1)), np.ones((len(SCRIPTS) + 2, 1)))
    rows = docs.select(F.col(text_col).cast("string").alias("_text"), *keep)
    schema = rows.drop("_text").schema.add("lang_pred", "string").add("score", "double")
    return rows.mapInArrow(_predict(model), schema)


def held_out(id_col: str = "doc_id") -> Column:
    """Whether a document is kept from training: crc32 of its id as text leaves 2 when divided by 4. False without an id."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 4 == 2, F.lit(False))


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """One row per document: doc_id, held_out, lang_pred, score. Learns from labelled documents that aren't held out.

    A null text, one without a letter, and every text where no document teaches a language is ``und`` with score 0. A null id is not held
    out; a null lang teaches nothing. Repeated rows are each returned; ties go to the language
    that is first by code point; extra columns are ignored; an empty table gives an empty
    result. A very long text is scored word by word at once, which takes some forty bytes a character.
    """
    model = fit(docs.where(~held_out(id_col)), id_col, text_col, lang_col)
    return predict(docs, model, text_col, F.col(id_col).alias("doc_id"), held_out(id_col).alias("held_out"))
