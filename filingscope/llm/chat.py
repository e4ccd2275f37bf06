"""Quotation linking: reply-ordered conversations without quotes.

A line that opens with '>' marks is quoted, to the level of their number. Lines of one
level in a row form a passage. Passages of all levels are normalised (marks and
attribution lines away, lower case, letters and digits only) and hashed: the whole, its
paragraphs, lines and sentences, and every run of BLOCK_WORDS words. The messages' own
text is hashed alike, but for its runs of words, which don't overlap, so that any longer
piece of a text holds one. A passage comes from the latest earlier message of its
conversation that has its longest found piece. A message replies to the latest message
that a passage of its lowest found level comes from, or else to the message before it.
Replies make each conversation a tree, and its messages are ordered by that tree: each
is followed by its replies, by turn, with all that replies to them.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .workers import bounded
from .workspace import Workspace

#: Shorter pieces of a passage, in normalised characters, aren't linked; a whole passage may be shorter.
LEAST_CHARS = 12
#: Words of a run that is hashed, so a piece of 2 * BLOCK_WORDS - 1 words is found wherever it is cut.
BLOCK_WORDS = 5
_FENCE = re.compile(r"^\s{0,3}(?:```|~~~)")
_MARKS = re.compile(r"^\s{0,3}(?:>\s?)+")
_ATTRIBUTION = re.compile(r"^(?:On\b.{0,200}\bwrote|Le\b.{0,200}\ba écrit|Am\b.{0,200}\bschrieb.{0,80}|El\b.{0,200}\bescribió|.{1,120}\b(?:wrote|said|writes))\s*:\s*$", re.I)
_JUNK = re.compile(r"[\W_]+")
_PARAGRAPH = re.compile(r"\n\s*\n")
_SENTENCE = re.compile(r"""(?<=[.!?…])["'”’»)\]]*\s+|(?<=[。！？])""")


def quote_level(line: str) -> tuple[int, str]:
    """Number of quote marks that open the line, and the rest."""
    marks = _MARKS.match(line)
    return (marks.group().count(">"), line[marks.end() :]) if marks else (0, line)


def normal(text: str) -> str:
    return _JUNK.sub(" ", text.lower()).strip()


def segments(text: str) -> list[tuple[int, list[str], str]]:
    """The text's lines in runs of one quote level: (level, lines as they are, passage), level 0 for the message's own.

    A passage is the run's lines without marks, blank and attribution lines; it may be
    empty. An attribution line right before a quote is of level -1. Lines between code
    fences are the message's own, whatever they open with.
    """
    out: list[tuple[int, list[str], str]] = []
    fenced, lines = False, text.split("\n")
    levels = []
    for line in lines:
        depth = 0 if fenced else quote_level(line)[0]
        fenced ^= depth == 0 and bool(_FENCE.match(line))
        levels.append(depth)
    for i, line in enumerate(lines):
        depth = levels[i]
        if not depth and _ATTRIBUTION.match(line.strip()) and any(levels[i + 1 : i + 3]):
            depth = -1
        if out and out[-1][0] == depth:
            out[-1][1].append(line)
        else:
            out.append((depth, [line], ""))
    rest = lambda x: quote_level(x)[1]
    return [(d, own, "\n".join(rest(x) for x in own if rest(x).strip() and not _ATTRIBUTION.match(rest(x).strip())) if d > 0 else "") for d, own, _ in out]


def split_quotes(text: str | None) -> tuple[str, list[tuple[int, str]]]:
    """The text without quotes and attribution lines, and its quoted (level, passage) in order."""
    parts = segments(text or "")
    passages = [(d, p) for d, _, p in parts if d > 0 and p]
    return without(text or "", {_hash(_key(p)) for _, p in passages}), passages


def without(text: str, found: set[int]) -> str:
    """The text without the passages of these hashes, and the attribution and blank quoted lines beside them; all else stays."""
    parts = segments(text)
    gone = [d > 0 and bool(p) and _hash(_key(p)) in found for d, _, p in parts]
    if not any(gone):
        return text
    for order in (range(len(parts) - 1, -1, -1), range(len(parts))):
        for i in order:
            beside = i + 1 if order.step < 0 else i - 1
            if 0 <= beside < len(parts) and gone[beside] and not gone[i]:
                if order.step < 0 and parts[i][0] == -1:
                    gone[i] = True
                elif parts[i][0] > 0 and not parts[i][2]:
                    gone[i] = True
                elif order.step < 0 and parts[i][0] == 0 and not "".join(parts[i][1]).strip() and i and parts[i - 1][0] == -1:
                    gone[i] = True  # the blank line between an attribution and its quote
    left = [line for (_, own, _), out in zip(parts, gone, strict=True) if not out for line in own]
    return re.sub(r"\n{3,}", "\n\n", "\n".join(left)).strip("\n")


def _key(text: str) -> str:
    """What is compared of a piece: its letters and digits, or all but the spaces if it has none."""
    return _JUNK.sub("", text.lower()) or "".join(text.split())


def _hash(key: str) -> int:
    return xxhash.xxh3_64_intdigest(key) - (1 << 63)


def pieces(text: str, step: int) -> dict[int, int]:
    """Hash and normalised length of a text, its paragraphs, lines, sentences and runs of words, one run from every ``step``-th word."""
    parts = _PARAGRAPH.split(text)
    lines = text.split("\n")
    found = {text, *parts, *lines, *(x for y in (*parts, *lines) for x in _SENTENCE.split(y))}
    words = normal(text).split()
    found.update(" ".join(words[i : i + BLOCK_WORDS]) for i in range(0, len(words) - BLOCK_WORDS + 1, step))
    return {_hash(k): len(normal(x)) for x in found if (k := _key(x))}


def wanted(passages: list[tuple[int, str]]) -> list[tuple[int, int, int, int]]:
    """Distinct (level, hash of the passage, hash of a piece, length of the piece)."""
    out = set()
    for level, passage in passages:
        if not (whole := _key(passage)):
            continue
        name = _hash(whole)
        out |= {(level, name, h, n) for h, n in pieces(passage, 1).items() if h == name or n >= LEAST_CHARS}
    return sorted(out)


def _parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kind = pa.list_(pa.struct([("level", pa.int32()), ("passage", pa.int64()), ("h", pa.int64()), ("n", pa.int32())]))
    for batch in batches:
        own, levels, quoted = [], [], []
        for text in batch.column(3).to_pylist():
            rest, passages = split_quotes(text)
            own.append(rest if passages else None)
            levels.append(max((d for d, _ in passages), default=0))
            quoted.append([dict(zip(("level", "passage", "h", "n"), x, strict=True)) for x in wanted(passages)])
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(own, pa.string()), pa.array(levels, pa.int32()), pa.array(quoted, kind)], ["conv_id", "turn", "role", "text", "own", "quote_levels", "quoted"])


def _unquoted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(..., text, found) to (..., text): without its found passages."""
    for batch in batches:
        *kept, text, found = batch.columns
        texts = [without(t, set(f)) if f else t for t, f in zip(text.to_pylist(), found.to_pylist(), strict=True)]
        yield pa.RecordBatch.from_arrays([*kept, pa.array(texts, pa.string())], batch.schema.names[:-1])


def _offer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(conv_id, turn, text) to the hashes of the text's pieces."""
    for batch in batches:
        offered = [list(pieces(text, BLOCK_WORDS)) for text in batch.column(2).to_pylist()]
        yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(offered, pa.list_(pa.int64()))], ["conv_id", "turn", "offered"])


def tree_order(turns: list[int], origins: list[int | None]) -> list[tuple[int | None, int, int]]:
    """(reply_to, thread, place) of a conversation's ascending turns; origins are earlier turns, or null for the turn before.

    ``place`` numbers the reply tree's turns so that each is followed by its replies'
    subtrees, by turn. The first reply goes on in its thread, others open their own.
    """
    at = {t: i for i, t in enumerate(turns)}
    above = [i - 1 if o is None else at[o] for i, o in enumerate(origins)]
    size = [1] * len(turns)
    for i in range(len(turns) - 1, 0, -1):
        size[above[i]] += size[i]
    place, free, thread = [0] * len(turns), [1] * len(turns), list(turns)
    for i in range(1, len(turns)):
        up = above[i]
        place[i] = free[up]
        free[up] += size[i]
        free[i] = place[i] + 1
        if place[i] == place[up] + 1:
            thread[i] = thread[up]
    return [(turns[above[i]] if i else None, thread[i], place[i]) for i in range(len(turns))]


def _threads(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (conv_id, turn, origin, rows), conversations together and turns ascending, with the first position of their rows in the order of the reply tree."""
    conv, turns, origins, sizes = None, [], [], []

    def done() -> pa.RecordBatch:
        rows = tree_order(turns, origins)
        columns = [pa.array([x[i] for x in rows], pa.int64()) for i in range(2)]
        place = np.array([x[2] for x in rows])
        held = np.zeros(len(rows), dtype=np.int64)
        held[place] = sizes
        first = (np.cumsum(held) - held)[place]
        return pa.RecordBatch.from_arrays([pa.array([conv] * len(turns), pa.int64()), pa.array(turns, pa.int64()), columns[0], pa.array([o is not None for o in origins], pa.bool_()), columns[1], pa.array(first)], ["conv_id", "turn", "reply_to", "linked", "thread", "first"])

    for batch in batches:
        out = []
        for c, t, o, n in zip(*(x.to_pylist() for x in batch.columns), strict=True):
            if c != conv and turns:
                out.append(done())
                turns, origins, sizes = [], [], []
            conv = c
            turns.append(t)
            origins.append(o)
            sizes.append(n)
        if out:
            yield pa.Table.from_batches(out).combine_chunks().to_batches()[0]
    if turns:
        yield done()


def link_quotes(messages: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """One row per message: conv_id, turn, role, text, quote_levels, linked, reply_to, thread, position.

    ``text`` has no passage that was found, nor the attribution before one; passages of
    unknown origin stay as they are, and so do lines between code fences. Where a passage
    goes, runs of blank lines become one and blank lines at the ends go. ``quote_levels`` is the
    deepest level; ``linked`` tells whether a passage was found; ``reply_to`` and ``thread`` are turns, reply_to null for
    a conversation's first. ``position`` counts from 0 within the conversation, in the
    order of its reply tree: a message is followed by its replies, by turn, each with
    its own replies. A message's first reply is of its thread, any other opens one. A
    null text is empty. Rows without a conversation or turn stand alone: no reply, thread
    their turn, position 0. Rows that repeat a turn share its place in the tree and take
    positions that follow one another, ordered by text. A very long message's runs of words are
    held at once, as text, where it quotes or is quoted: some ten times its length. Extra columns are ignored; an
    empty table gives an empty result.
    """
    ws = Workspace(messages.sparkSession, "chat")
    rows = messages.select(F.col(conv_col).cast("long").alias("conv_id"), F.col(turn_col).cast("long").alias("turn"), F.col(role_col).cast("string").alias("role"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    parsed = ws.put(rows.mapInArrow(bounded(_parse), "conv_id bigint, turn bigint, role string, text string, own string, quote_levels int, quoted array<struct<level:int,passage:bigint,h:bigint,n:int>>"), "parsed")
    placed = parsed.where("conv_id IS NOT NULL AND turn IS NOT NULL")
    turns = placed.select("conv_id", "turn", F.lit(None).cast("long").alias("origin"), F.lit(1).alias("rows"))
    quoting = placed.where("size(quoted) > 0")
    texts = parsed.select("conv_id", "turn", "role", "quote_levels", "text")
    if not quoting.isEmpty():
        found = ws.put(_found(placed, quoting), "found")
        # The latest origin at the lowest level, and all passages that were found: some of one message's.
        of_turn = ws.put(found.groupBy("conv_id", "turn").agg((-F.min(F.struct("level", (-F.col("origin")).alias("back")))["back"]).alias("origin"), F.collect_set("passage").alias("found")), "origins")
        turns = turns.unionByName(of_turn.select("conv_id", "turn", "origin", F.lit(0).alias("rows")))
        texts = texts.join(of_turn.drop("origin"), ["conv_id", "turn"], "left").mapInArrow(bounded(_unquoted), texts.schema)
    turns = turns.groupBy("conv_id", "turn").agg(F.max("origin").alias("origin"), F.sum("rows").alias("rows"))
    # Only numbers of a conversation's turns meet in one task, one row a turn.
    threads = turns.repartition("conv_id").sortWithinPartitions("conv_id", "turn").mapInArrow(_threads, "conv_id bigint, turn bigint, reply_to bigint, linked boolean, thread bigint, first bigint")
    out = texts.join(ws.put(threads, "threads"), ["conv_id", "turn"], "left").withColumn("thread", F.coalesce("thread", "turn")).withColumn("linked", F.coalesce("linked", F.lit(False)))
    alone = F.col("conv_id").isNull() | F.col("turn").isNull()
    within = Window.partitionBy("conv_id", "turn").orderBy("text", "role")  # rows that repeat a turn
    named = ["conv_id", "turn", "role", "text", "quote_levels", "linked", "reply_to", "thread", "position"]
    return out.where(~alone).withColumn("position", F.col("first") + F.row_number().over(within) - 1).select(*named).unionByName(out.where(alone).withColumn("position", F.lit(0).cast("long")).select(*named))


def _found(placed: DataFrame, quoting: DataFrame) -> DataFrame:
    """(conv_id, turn, level, passage, origin) of the passages that are found."""
    # A conversation's hashes are spread by hash, and each quoted piece takes the last offer before it: no pairs are made.
    asked = quoting.select("conv_id", "turn", F.inline("quoted"))
    offered = placed.join(quoting.select("conv_id").distinct(), "conv_id", "left_semi").select("conv_id", "turn", F.coalesce("own", "text").alias("text")).mapInArrow(bounded(_offer), "conv_id bigint, turn bigint, offered array<bigint>")
    both = asked.unionByName(offered.select("conv_id", "turn", F.explode("offered").alias("h")), allowMissingColumns=True)
    before = Window.partitionBy("conv_id", "h").orderBy("turn").rangeBetween(Window.unboundedPreceding, -1)
    found = both.withColumn("origin", F.max(F.when(F.col("level").isNull(), F.col("turn"))).over(before)).where("level IS NOT NULL AND origin IS NOT NULL")
    return found.groupBy("conv_id", "turn", "level", "passage").agg(F.max(F.struct("n", "origin"))["origin"].alias("origin"))
