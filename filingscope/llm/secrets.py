"""Secrets in whole texts, in DataFrame operations only.

Three fixed patterns give the base findings. Beside them, long tokens are scored by two
character Markov models, of random strings and of ordinary identifiers, both trained
from labelled samples; a token whose log-likelihood ratio speaks for chance is a
finding too, unless a base finding overlaps it.
"""

from __future__ import annotations

import json
import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .sampling import smallest

# The base patterns and the least length of what counts, in the order of their kinds.
BASE = (
    ("assign", r"""(?:[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""),
    ("access", r"(AKIA[A-Z0-9]{16,})"),
    ("hex", r"([0-9a-f]{24,})"),
)
LEAST_VALUE = {"assign": 6, "access": 20, "hex": 24}

#: Characters that the models know, and the least length of a token that they score.
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
TOKEN_CHARS = 20
#: A token's log-likelihood ratio must reach this, in nats in all and per character pair.
LEAST_RATIO, LEAST_RATIO_A_PAIR = 12.0, 0.5
SMOOTHING = 0.5
#: Values that are run through at once, and a place beyond any text.
BLOCK, FAR = 64, 2**31 - 1


def bound(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is found once, however often the body names it."""
    return F.get(F.transform(F.array(value), lambda x: body(x)), F.lit(0))


def running(values: Column, zero: Column, step: Callable[[Column, Column], Column]) -> Column:
    """Running results of an associative ``step`` over an array, each with its own value.

    Appending to an array copies it, so blocks of ``BLOCK`` values are run through by
    themselves, each from the result of the blocks before it.
    """
    kind = "array<int>"
    none = F.array().cast(kind)

    def through(block: Column, start: Column, inclusive: bool = True) -> Column:
        def add(state: Column, x: Column) -> Column:
            now = step(state["at"], x)
            return F.struct(now.alias("at"), F.concat(state["out"], F.array(now if inclusive else state["at"])).alias("out"))

        return F.aggregate(block, F.struct(start.alias("at"), none.alias("out")), add)["out"]

    def over(blocks: Column) -> Column:
        starts = through(F.transform(blocks, lambda b: F.aggregate(b, zero, step)), zero, inclusive=False)
        return F.flatten(F.zip_with(blocks, starts, lambda b, s: through(b, s)))

    def cut(own: Column) -> Column:
        last = F.ceil(F.size(own) / BLOCK).cast("int") - 1
        blocks = F.transform(F.sequence(F.lit(0), last), lambda i: F.slice(own, i * BLOCK + 1, F.lit(BLOCK)))
        return F.when(F.size(own) > 0, bound(blocks, over)).otherwise(none)

    return bound(values, cut)


def _matches(rows: DataFrame, found: list[tuple[str, str, int]]) -> DataFrame:
    """``rows`` (with ``t``) and, for each (name, pattern, group), all matches, their groups and what stands between them.

    Each pattern is searched once; only texts with a match are cut up by it.
    """
    text = F.col("t")
    rows = rows.select("*", *(F.regexp_extract_all(text, F.lit(p), F.lit(0)).alias(f"{name}_all") for name, p, _ in found))
    some = lambda name, c: F.when(F.size(f"{name}_all") > 0, c)
    values = [some(name, F.regexp_extract_all(text, F.lit(p), F.lit(group))).alias(f"{name}_values") if group else F.col(f"{name}_all").alias(f"{name}_values") for name, p, group in found]
    return rows.select("*", *values, *(some(name, F.split(text, p, -1)).alias(f"{name}_gaps") for name, p, _ in found))


def _spans(name: str) -> Column:
    """Array of (start, end, value) of the matches, in code points; value is the group's text."""
    whole = F.col(f"{name}_all")
    ends = running(F.zip_with(F.slice(f"{name}_gaps", F.lit(1), F.size(whole)), whole, lambda g, m: F.length(g) + F.length(m)), F.lit(0), lambda x, y: x + y)
    spans = F.transform(F.arrays_zip(whole.alias("match"), F.col(f"{name}_values").alias("value"), ends.alias("end")), lambda x: F.struct((x["end"] - F.length(x["match"])).alias("start"), x["end"].alias("end"), x["value"].alias("value")))
    return F.when(F.size(whole) > 0, spans).otherwise(F.array().cast("array<struct<start:int,end:int,value:string>>"))


def apart(spans: Column, others: Column) -> Column:
    """Those of ``spans`` (start, order, end, kind) that overlap none of ``others`` (the same fields), in order of start.

    Both are put in one order: a span is apart if no other one that begins before it
    ends after its start, and none that begins after it begins before its end.
    """
    mark = lambda x, own: F.struct(x["start"].alias("start"), F.lit(own).alias("own"), x["end"].alias("end"), x.alias("span"))

    def free(both: Column) -> Column:
        before = running(F.transform(both, lambda x: F.when(x["own"], 0).otherwise(x["end"])), F.lit(0), lambda x, y: F.greatest(x, y))
        after = F.reverse(running(F.transform(F.reverse(both), lambda x: F.when(x["own"], FAR).otherwise(x["start"])), F.lit(FAR), lambda x, y: F.least(x, y)))
        kept = F.filter(F.arrays_zip(both.alias("x"), before.alias("b"), after.alias("a")), lambda z: z["x"]["own"] & (z["b"] <= z["x"]["start"]) & (z["a"] >= z["x"]["end"]))
        return F.transform(kept, lambda z: z["x"]["span"])

    return bound(F.array_sort(F.concat(F.transform(others, lambda x: mark(x, False)), F.transform(spans, lambda x: mark(x, True)))), free)


def base_spans() -> dict[str, Column]:
    """The base findings by kind, from the columns of ``_matches``. Matches that are too short are consumed first and dropped then."""
    long_enough = lambda least: lambda s: F.length(s["value"]) >= least
    return {kind: F.filter(_spans(kind), long_enough(LEAST_VALUE[kind])) for kind, _ in BASE}


def random_samples(spark: SparkSession, count: int = 4096) -> DataFrame:
    """Labelled samples of random strings: base64, lower-case hex, upper-case and mixed letters with digits."""
    bits = F.sha2(F.col("id").cast("string"), 256)
    b64 = F.base64(F.unhex(bits))
    return spark.range(count).select(F.explode(F.array(b64, F.substring(bits, 1, 40), F.upper(F.regexp_replace(b64, "[^A-Za-z0-9]", "")), F.regexp_replace(b64, "[^A-Za-z0-9]", ""))).alias("token"), F.lit(True).alias("random"))


def ordinary_samples(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", most_docs: int = 500) -> DataFrame:
    """Labelled samples of ordinary identifiers: the words and joined words of at most ``most_docs`` documents, without base findings."""
    some = smallest(docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("t")), "id", most_docs)
    text = F.col("t")
    for _, pattern in BASE:
        text = F.regexp_replace(text, pattern, " ")
    words = some.select(F.regexp_extract_all(text, F.lit("[A-Za-z]{3,}"), F.lit(0)).alias("w"))
    joined = lambda a, b: F.array(a, F.concat(a, F.lit("_"), b), F.concat(a, F.initcap(b)), F.concat(a, F.lit("/"), b), F.concat(a, F.lit("-"), b))
    tokens = F.transform("w", lambda a, i: F.get(joined(a, F.coalesce(F.get("w", i + 1), F.lit(""))), i % 5))
    return words.select(F.explode(tokens).alias("token"), F.lit(False).alias("random"))


def train(samples: DataFrame) -> list[float]:
    """Log-likelihood ratios of all character pairs from samples (token, random), row by row of ALPHABET.

    What reaches the driver is one count for each pair and label.
    """
    at = F.sequence(F.lit(1), F.length("token") - 1)
    pairs = samples.where("length(token) > 1").select("random", F.explode(F.transform(at, lambda i: F.substring("token", i, F.lit(2)))).alias("pair")).groupBy("random", "pair").count()
    count = {(r["random"], r["pair"]): r["count"] for r in pairs.where(F.col("pair").rlike("^[A-Za-z0-9+/_=-]{2}$")).collect()}
    ratios = []
    for a in ALPHABET:
        total = {label: sum(count.get((label, a + b), 0) for b in ALPHABET) + SMOOTHING * len(ALPHABET) for label in (True, False)}
        ratios += [math.log((count.get((True, a + b), 0) + SMOOTHING) / total[True]) - math.log((count.get((False, a + b), 0) + SMOOTHING) / total[False]) for b in ALPHABET]
    return ratios


def log_ratio(token: Column, ratios: list[float]) -> Column:
    """The token's log-likelihood ratio, random over ordinary."""
    table = F.from_json(F.lit(json.dumps([round(x, 6) for x in ratios])), "array<double>")
    place = F.transform(F.split(token, ""), lambda c: F.instr(F.lit(ALPHABET), c) - 1)
    pair = lambda spots: F.zip_with(F.slice(spots, F.lit(1), F.size(spots) - 1), F.slice(spots, F.lit(2), F.size(spots) - 1), lambda a, b: F.get(table, a * len(ALPHABET) + b))
    return F.aggregate(pair(place), F.lit(0.0), lambda s, x: s + x)


def find_secrets(docs: DataFrame, samples: DataFrame | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_markov.

    ``spans`` lists all findings as kind:start:end by start and then kind, in code
    points with the end exclusive; ``base_sha256`` is the hash of the list without the
    Markov findings. A null text is empty and has none. Ids may be null or repeat;
    extra columns are ignored; an empty table gives an empty result. ``samples`` has
    (token, random) and by default takes ordinary words from ``docs`` itself.
    """
    samples = samples if samples is not None else random_samples(docs.sparkSession).unionByName(ordinary_samples(docs, id_col, text_col))
    ratios = train(samples)
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    out = docs.select(F.col(id_col).alias("doc_id"), text.alias("t"))
    out = _matches(out, [*((kind, pattern, int(kind == "assign")) for kind, pattern in BASE), ("token", "[A-Za-z0-9+/_=-]{%d,}" % TOKEN_CHARS, 0)])
    base = base_spans()
    out = out.select("doc_id", *(spans.alias(kind) for kind, spans in base.items()), _spans("token").alias("tokens"))
    of_kind = lambda order, kind: lambda s: F.struct(s["start"].alias("start"), F.lit(order).alias("order"), s["end"].alias("end"), F.lit(kind).alias("kind"))
    named = [F.transform(kind, of_kind(i, kind)) for i, kind in enumerate(base)]
    out = out.withColumn("base", F.array_sort(F.concat(*named)))
    scored = F.transform("tokens", lambda s: F.struct(s["start"].alias("start"), F.lit(len(base)).alias("order"), s["end"].alias("end"), F.lit("markov").alias("kind"), log_ratio(s["value"], ratios).alias("ratio")))
    likely = F.filter(scored, lambda s: (s["ratio"] >= LEAST_RATIO) & (s["ratio"] >= LEAST_RATIO_A_PAIR * (s["end"] - s["start"] - 1)))
    kind = "array<struct<start:int,order:int,end:int,kind:string>>"
    out = out.withColumn("likely", F.transform(likely, lambda s: F.struct(s["start"].alias("start"), s["order"].alias("order"), s["end"].alias("end"), s["kind"].alias("kind"))).cast(kind))
    out = out.withColumn("markov", F.when((F.size("likely") > 0) & (F.size("base") > 0), apart(F.col("likely"), F.col("base").cast(kind))).otherwise(F.col("likely")))
    listed = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    counts = [F.size(kind).cast("long").alias(f"n_{kind}") for kind in base]
    every = F.when(F.size("markov") > 0, F.array_sort(F.concat("base", "markov"))).otherwise(F.col("base"))
    return out.select("doc_id", *counts, F.sha2(listed(F.col("base")).cast("binary"), 256).alias("base_sha256"), listed(every).alias("spans"), F.size("markov").cast("long").alias("n_markov"))
