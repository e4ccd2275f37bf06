"""Text changes that depend on earlier matches, as Arrow-batched pandas functions."""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Widths of chunks, of a bare citation and of what a stream holds back.
CHUNK, OVERLAP, BOUNDARY, HOLD = 1800, 250, 0.6, 320
LEAST_INNER, MOST_INNER = 4, 300
#: Letters of chunks that a task holds before it hands them on.
SLICE_BYTES = 4 << 20
# How a citation names its page, a Markdown link, and the paths of verified targets.
_PAGED = re.compile(r"\s*[—–-]\s*p(?:age)?\.?\s*(\d+)\s*$", re.I)
_LINK = re.compile(r"\[[^\]]+\]\([^)]+\)")
_CASE_PATH, _DETAIL_PATH, _DOWNLOAD_PATH = "/public/search/casenumber/", "/public/search/details/", "/apis/api/filing/download"

_END = re.compile(r"\n|\.(?= )")
_EDGE = re.compile(r"[\[\]\n]")


def chunk_text(text: str | None, size: int = CHUNK, overlap: int = OVERLAP) -> list[str]:
    """Overlapping pieces that end at a line's or sentence's end if one lies late enough."""
    text = text or ""
    if len(text) <= size:
        return [text] if text else []
    ends = [m.end() for m in _END.finditer(text)]
    spans = [(0, 0)]
    while spans[-1][1] < len(text):
        at = max(spans[-1][1] - overlap, spans[-1][0] + 1) if len(spans) > 1 else 0
        stop = min(at + size, len(text))
        if stop < len(text):
            last = bisect_right(ends, stop + 1)
            if last and ends[last - 1] > at + int(size * BOUNDARY) + 1:
                stop = ends[last - 1]
        spans.append((at, stop))
    return [piece for at, stop in spans[1:] if (piece := text[at:stop].strip())]


def chunk_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(keys, text) to (keys, at, text): a row for each chunk. Pages are read one by one, and at most ``SLICE_BYTES`` of chunks, or one page's, are held."""

    def made(batch: pa.RecordBatch, rows: list[int], at: list[int], pieces: list[str]) -> pa.RecordBatch:
        keys = [c.take(pa.array(rows, pa.int64())) for c in batch.columns[:-1]]
        return pa.RecordBatch.from_arrays([*keys, pa.array(at, pa.int32()), pa.array(pieces, pa.string())], [*batch.schema.names[:-1], "at", "text"])

    for batch in batches:
        rows, at, pieces, size = [], [], [], 0
        for row, page in enumerate(batch.column(batch.num_columns - 1)):
            own = chunk_text(page.as_py())
            rows += [row] * len(own)
            at += range(len(own))
            pieces += own
            size += sum(map(len, own))
            if size > SLICE_BYTES:
                yield made(batch, rows, at, pieces)
                rows, at, pieces, size = [], [], [], 0
        yield made(batch, rows, at, pieces)
    pa.default_memory_pool().release_unused()


def _title(title: str) -> str:
    clean = " ".join(re.sub(r"[\[\]\r\n]+", " ", title).split())
    return clean if len(clean) <= 120 else clean[:117].rstrip() + "..."


def _citation(row: dict, page: int | None = None) -> str:
    title, url = _title(row["title"] or ""), row["url"] or ""
    if row.get("kind") == "metadata":
        return f"[{title} — filing record]({url})"
    page = page if page is not None else row["page_number"]
    return f"[{title} — p. {page}]({url.split('#')[0]}#page={max(1, page)})"


def _bare(text: str) -> Iterator[tuple[int, int]]:
    """Begin and end of the innermost bracket pairs on one line that no target follows."""
    opened = None
    for edge in _EDGE.finditer(text):
        if edge.group() == "]" and opened is not None and not text[edge.end() :].lstrip().startswith("("):
            yield opened, edge.end()
        opened = edge.start() if edge.group() == "[" else None


class Citations:
    """The citable rows of an answer by title; of equal titles the last counts."""

    def __init__(self, rows: list[dict]):
        self.rows = rows
        self.by_title = {_title(r["title"] or "").lower(): r for r in rows}

    def of(self, inner: str) -> str | None:
        """The citation that the text of a bracket names, with the page that it names."""
        if not LEAST_INNER <= len(inner) <= MOST_INNER:
            return None
        paged = _PAGED.search(inner)
        row = self.by_title.get((inner[: paged.start()] if paged else inner).strip().lower())
        return row and _citation(row, int(paged.group(1)) if paged else None)

    def relinked(self, text: str) -> str:
        out, at = [], 0
        for begin, end in _bare(text):
            if found := self.of(text[begin + 1 : end - 1]):
                out += [text[at:begin], found]
                at = end
        return "".join([*out, text[at:]])


def relink_text(reply: str, rows: list[dict]) -> str:
    """Bare bracketed citations of known titles get their links."""
    return Citations(rows).relinked(reply)


def _plain_rows(rows) -> list[dict]:
    return [x if isinstance(x, dict) else x.asDict() for x in (rows if rows is not None else [])]


@F.pandas_udf(T.StringType())
def relink(reply: pd.Series, rows: pd.Series) -> pd.Series:
    """``rows``: array of (title, url, page_number, kind)."""
    return pd.Series([None if r is None else relink_text(r, _plain_rows(own)) for r, own in zip(reply, rows, strict=True)])


def source_labels_text(reply: str, rows: list[dict], word: str = "Source") -> str:
    """'Source n' labels, bracketed (with a target or not) or plain, become the n-th row's citation, in one pass."""
    page = r"(?:\s*,?\s*p(?:age)?\.?\s*\d+)?"
    label = re.compile(rf"\[\s*{word}\s+(\d+){page}\s*\](?:\([^\n)]+\))?|\b{word}\s+(\d+){page}\b", re.I)

    def cited(match: re.Match) -> str:
        n = int(match.group(1) or match.group(2))
        return _citation(rows[n - 1]) if 1 <= n <= len(rows) else match.group()

    return label.sub(cited, reply)


@F.pandas_udf(T.StringType())
def source_labels(reply: pd.Series, rows: pd.Series) -> pd.Series:
    """``rows``: array of (title, url, page_number, kind), in the order of the labels' numbers."""
    return pd.Series([None if r is None else source_labels_text(r, _plain_rows(own)) for r, own in zip(reply, rows, strict=True)])


Part = tuple[str, bool]


def _parts(text: str) -> list[Part]:
    """The text cut into (piece, whether it is a Markdown link)."""
    out, at = [], 0
    for link in _LINK.finditer(text):
        out += [(text[at : link.start()], False), (link.group(), True)]
        at = link.end()
    return [*out, (text[at:], False)]


def outside_links(text: str, change: Callable[[str], str]) -> str:
    """``change`` applied to what isn't a Markdown link."""
    return "".join(piece if linked else change(piece) for piece, linked in _parts(text))


@F.pandas_udf(T.StringType())
def retarget(text: pd.Series, targets: pd.Series) -> pd.Series:
    """Links lead to what ``targets`` (a map of URLs) says of theirs; labels stay."""

    def moved(piece: str, own: dict) -> str:
        label, _, url = piece.partition("](")
        return f"{label}]({own.get(url[:-1], url[:-1])})"

    changed = lambda t, own: "".join(moved(p, own) if linked else p for p, linked in _parts(t))
    return pd.Series([None if t is None else changed(t, dict(own if own is not None else {})) for t, own in zip(text, targets, strict=True)])


def mentions(links: list[tuple[str, str]], titles: list[tuple[str, str]]) -> list[tuple[str, str]]:
    """(pattern, url) of what names a verified target, in the order in which they are looked for.

    ``links`` are (label, url) of the records: case pages are named by their number in
    all spellings, filings by their docket, attachments by name and docket. ``titles``
    are (title, url) of other pages. Cases come first, then filings, pages, attachments.
    """
    ranked: list[tuple[int, str, str]] = []
    for label, url in links:
        where, (docket, _, name) = url.lower(), label.partition(" - ")
        word = rf"\b{re.escape(docket.strip())}\b"
        if _CASE_PATH in where:
            in_url, in_label = re.search(r"/casenumber/(\d{3,5})/?$", where), re.match(r"([A-Z]{1,8})\s?(\d{3,5})\b", label, re.I)
            if not (in_url or in_label):
                continue
            digits = in_url.group(1) if in_url else in_label.group(2)
            prefix = in_label.group(1).upper() if in_label else "FC"
            formal = rf"\bFormal\s+Case\s+(?:No\.?|Number)?\s*{digits}"
            ranked += [(0, p, url) for p in (rf"{formal}\s*\({prefix} ?{digits}\)", rf"{formal}\b", rf"\b{prefix} {digits}\b", rf"\b{prefix}{digits}\b")]
        elif _DETAIL_PATH in where and docket.strip():
            ranked.append((1, word, url))
        elif _DOWNLOAD_PATH in where:
            ranked += [(3, p, url) for p, has in ((re.escape(name.strip()), name.strip()), (word, docket.strip())) if has]
    ranked += [(2, re.escape(title.strip()), url) for title, url in titles if title.strip() and url]
    return [(p, url) for _, p, url in sorted(ranked, key=lambda x: x[0])]


def inline_sources(text: str, specs: list[tuple[str, str]]) -> str:
    """Every mention (pattern, url) outside links becomes a link; earlier patterns go first, in any case of letters."""
    parts = _parts(text)
    for pattern, url in specs:
        named, cut = re.compile(pattern, re.I), []
        for piece, linked in parts:
            at = 0
            for m in () if linked else named.finditer(piece):
                if m.group():
                    cut += [(piece[at : m.start()], False), (f"[{m.group()}]({url})", True)]
                    at = m.end()
            cut.append((piece[at:], linked))
        parts = cut
    return "".join(piece for piece, _ in parts)


@F.pandas_udf(T.StringType())
def link_mentions(text: pd.Series, links: pd.Series, titles: pd.Series) -> pd.Series:
    """Replies with links where they name a verified target; ``links`` and ``titles`` are arrays of (label, url)."""
    pairs = lambda rows: [(x["label"], x["url"]) for x in _plain_rows(rows)]
    return pd.Series([None if t is None else inline_sources(t, mentions(pairs(a), pairs(b))) for t, a, b in zip(text, links, titles, strict=True)])


class Relinker:
    """Repair on a stream: an automaton over characters, whose output doesn't depend on how the text is cut.

    It holds back blanks, since a line break before a repaired citation becomes a space,
    and an open bracket up to ``hold`` characters. The state is (mode, held text, whether
    anything has gone out), so it can live in a streaming store between batches.
    """

    TEXT, OPEN, CLOSED, JOINED = range(4)  # in prose; in a bracket; at its end; after a repaired citation

    def __init__(self, rows: list[dict], held: str = "", sent: bool = False, mode: int = TEXT, hold: int = HOLD):
        self.known, self.held, self.sent, self.mode, self.hold = Citations(rows), held, sent, mode, hold

    def push(self, delta: str, final: bool = False) -> str:
        self.out: list[str] = []
        for c in delta:
            self._take(c)
        if final:
            if self.mode == self.CLOSED:
                self._decide(False)
            self._send(self.held)
            self.held, self.mode = "", self.TEXT
        return "".join(self.out)

    def _send(self, text: str) -> None:
        self.out.append(text)
        self.sent = self.sent or not (text == "" or text.isspace())

    def _take(self, c: str) -> None:
        if self.mode == self.CLOSED:
            self._decide(c == "(")
        if self.mode == self.OPEN:
            self.held += c
            if c == "]":
                self.mode = self.CLOSED
            elif len(self.held) > self.hold:
                self._send(self.held)
                self.held, self.mode = "", self.TEXT
        elif c in " \t\n":
            self.held += c
        else:
            broken = "\n" in self.held
            if c == "[" and broken:
                self.held += c  # the line break goes where the bracket goes
            else:
                dropped = broken and self.mode == self.JOINED and c in "),.;:"
                self._send(("" if dropped else self.held) + ("" if c == "[" else c))
                self.held = c if c == "[" else ""
            self.mode = self.OPEN if c == "[" else self.TEXT

    def _decide(self, linked: bool) -> None:
        """Send the bracket that is held, repaired if it is a bare citation."""
        at = self.held.index("[")
        blanks, span = self.held[:at], self.held[at:]
        shown = span if linked else self.known.relinked(span)
        if shown == span:
            self._send(blanks + span)
            self.mode = self.TEXT
        else:
            self._send((" " if blanks and self.sent else blanks) + shown)
            self.mode = self.JOINED
        self.held = ""
