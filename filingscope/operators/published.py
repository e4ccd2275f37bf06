"""An index as it is published: JSON guards, postings of all formats, and routing that refuses partial answers.

A manifest has ``payload`` (JSON), shards have ``shard`` and ``payload``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import hashing, scoring
from .routing import CANDIDATES, DECIMALS, question_stems
from .shared import once, small

# Versions and key prefixes of what is published.
INDEX_VERSION, ROUTER_VERSION, INDEX_PREFIX, ROUTER_PREFIX = 1, 2, "term-index/", "case-router/"
MANIFEST = "version int, generation string, updatedAt string, complete boolean, shardCount int, cases long, shardKeyPrefix string, activeSlot string, postingFormat string"
ROUTER = "version int, generation string, updatedAt string, complete boolean, shardCount int, filterBytes int, filterBands int, partKeys array<string>"
SHARD = "version int, generation string, shardCount int, postingFormat string, part int, parts int, terms map<string,array<string>>"
# The bounds of a published shard, of a manifest and of a router index.
MOST_BYTES, MANIFEST_BYTES, ROUTER_BYTES = 8 << 20, 64 << 10, 256 << 10
#: Bytes of a shard besides its terms, at most.
HEAD_BYTES = 512


def is_term_manifest(payload: Column) -> Column:
    """Whether a JSON text is a complete manifest of the term index, of 64 KiB at most."""
    m = F.from_json(payload, MANIFEST)
    ok = (m["version"] == INDEX_VERSION) & m["generation"].isNotNull() & m["updatedAt"].isNotNull() & m["complete"] & (m["shardCount"] > 0) & (m["cases"] > 0) & m["shardKeyPrefix"].startswith(INDEX_PREFIX) & (F.octet_length(payload) <= MANIFEST_BYTES)
    return F.coalesce(ok, F.lit(False))


def is_router_index(payload: Column) -> Column:
    """Whether a JSON text is a complete index of the case router, of 256 KiB at most: as many part keys as shards, each in its folder."""
    m = F.from_json(payload, ROUTER)
    ok = (m["version"] == ROUTER_VERSION) & m["generation"].isNotNull() & m["updatedAt"].isNotNull() & m["complete"] & m["filterBytes"].isNotNull() & (m["filterBands"] > 0)
    ok = ok & (F.size(m["partKeys"]) == m["shardCount"]) & F.forall(m["partKeys"], lambda k: F.coalesce(k.startswith(ROUTER_PREFIX), F.lit(False)))
    return F.coalesce(ok & (F.octet_length(payload) <= ROUTER_BYTES), F.lit(False))


def filter_bytes(value: Column) -> Column:
    """A stored filter as binary, from base64 or from a JSON array of bytes."""
    listed = F.from_json(value, "array<int>")
    return F.when(F.startswith(F.trim(value), F.lit("[")), F.unhex(F.array_join(F.transform(listed, lambda b: F.lpad(F.hex(b), 2, "0")), ""))).otherwise(F.unbase64(value))


def posting_entries(entry: Column, posting_format: Column) -> Column:
    """Array of (case_number, weight) of a posting list, whose first item is the document frequency.

    The formats: names alone weigh 1, counts weigh by their logarithm, stored weights
    are hundredths. An item whose number can't be read is passed over.
    """
    body = F.slice(entry, F.lit(2), F.greatest(F.size(entry) - 1, F.lit(0)))
    counted = posting_format == "case-tf"
    starts = F.filter(F.sequence(F.lit(0), F.size(body)), lambda i: (i % 2 == 0) & (i + 1 < F.size(body)))
    pairs = F.transform(starts, lambda i: F.struct(F.get(body, i).alias("case_number"), F.get(body, i + 1).try_cast("double").alias("weight")))
    weighed = F.transform(F.filter(pairs, lambda p: p["weight"].isNotNull() & ~F.isnan(p["weight"])), lambda p: F.struct(p["case_number"].alias("case_number"), F.when(counted, scoring.log_tf(p["weight"])).otherwise(p["weight"] / scoring.WEIGHT_SCALE).alias("weight")))
    named = F.transform(body, lambda c: F.struct(c.alias("case_number"), F.lit(1.0).alias("weight")))
    return F.when(counted | (posting_format == "case-bm25"), weighed).otherwise(named)


def shard_payloads(postings: DataFrame, generation: str, shards: int = hashing.TERM_SHARDS, most_bytes: int = MOST_BYTES) -> DataFrame:
    """(shard, part, payload): postings (stem, case_number, df, weight) as JSON shards with stored weights; a capped stem has its frequency alone.

    No payload has more than ``most_bytes``. Running sums of the encoded sizes cut a long posting list into pieces and a
    large shard into parts, the same ones each time; a list that is cut has its frequency in each part. No more
    than a part's rows are gathered at once.
    """
    quoted = lambda c: F.regexp_replace(F.to_json(F.array(c)), r"^\[|\]$", "")  # noqa: E731  the escaped text in quotes
    head = most_bytes - HEAD_BYTES
    piece, room = head // 4, head - head // 4
    item = F.coalesce(F.concat(quoted(F.col("case_number")), F.lit(","), F.col("weight").cast("string")), F.lit(""))
    rows = postings.select("stem", "df", "case_number", item.alias("item"), (F.octet_length(quoted(F.col("stem"))) + 24).alias("fixed"))
    own = Window.partitionBy("stem").orderBy("case_number").rowsBetween(Window.unboundedPreceding, -1)
    cut = rows.withColumn("piece", F.floor(F.coalesce(F.sum(F.octet_length("item") + 1).over(own), F.lit(0)) / F.greatest(F.lit(1), F.lit(piece // 2) - F.col("fixed"))))
    pieces = cut.groupBy("stem", "df", "piece").agg(F.sort_array(F.collect_list(F.struct("case_number", "item"))).alias("items"), (F.max("fixed") + F.sum(F.octet_length("item") + 1)).alias("size"))  # bytes of a piece at most
    pieces = pieces.select("stem", "df", "piece", "size", F.array_join(F.transform("items", lambda x: x["item"]), ",").alias("body"), hashing.term_shard(F.col("stem"), shards).alias("shard"))
    before = Window.partitionBy("shard").orderBy("stem", "piece").rowsBetween(Window.unboundedPreceding, -1)
    placed = pieces.withColumn("part", F.floor(F.coalesce(F.sum("size").over(before), F.lit(0)) / room).cast("int")).withColumn("parts", F.max("part").over(Window.partitionBy("shard")) + 1)
    lists = placed.groupBy("shard", "part", "parts", "stem", "df").agg(F.sort_array(F.collect_list(F.struct("piece", "body"))).alias("bodies"))
    body = F.array_join(F.transform("bodies", lambda x: x["body"]), ",")
    entry = F.concat(quoted(F.col("stem")), F.lit(":["), F.concat_ws(",", F.col("df").cast("string"), F.nullif(body, F.lit(""))), F.lit("]"))
    held = lists.groupBy("shard", "part", "parts").agg(F.array_join(F.array_sort(F.collect_list(entry)), ",").alias("terms"))
    text = F.concat(F.lit(f'{{"version":{INDEX_VERSION},"generation":"{generation}","shardCount":{shards},"postingFormat":"case-bm25","part":'), F.col("part").cast("string"), F.lit(',"parts":'), F.col("parts").cast("string"), F.lit(',"terms":{'), "terms", F.lit("}}"))
    return held.select("shard", "part", F.when(F.octet_length(text) <= most_bytes, text).otherwise(F.raise_error(F.lit(f"a shard of more than {most_bytes} bytes"))).alias("payload"))


def manifest_payload(cases: DataFrame, generation: str, updated_at: str, slot: str = "a", shards: int = hashing.TERM_SHARDS) -> DataFrame:
    """(payload): the manifest of a complete index of ``cases`` (case_number)."""
    n = cases.agg(F.count_distinct("case_number").alias("cases"))
    fields = F.struct(F.lit(INDEX_VERSION).alias("version"), F.lit(generation).alias("generation"), F.lit(updated_at).alias("updatedAt"), F.lit(True).alias("complete"), F.lit(shards).alias("shardCount"), F.col("cases"), F.lit(f"term-index/v1/slots/{slot}/").alias("shardKeyPrefix"), F.lit(slot).alias("activeSlot"), F.lit("case-bm25").alias("postingFormat"))
    return n.select(F.to_json(fields).alias("payload"))


def _current(manifest: DataFrame, shards: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The manifest's row, and the shards (shard, s) that are the manifest's, with all of their parts."""
    m = manifest.where(is_term_manifest(F.col("payload"))).limit(1).select(F.from_json("payload", MANIFEST).alias("m"))
    read = shards.select("shard", F.from_json("payload", SHARD).alias("s"))
    own = (F.col("s.version") == INDEX_VERSION) & (F.col("s.generation") == F.col("m.generation")) & (F.col("s.shardCount") == F.col("m.shardCount")) & F.col("s.terms").isNotNull()
    good = read.crossJoin(F.broadcast(m)).where(own).select("shard", "s", F.coalesce("s.part", F.lit(0)).alias("part"), F.coalesce("s.parts", F.lit(1)).alias("parts"))  # one row
    good = once(good, "read-shards")  # a payload is parsed once
    whole = good.groupBy("shard").agg((F.count_distinct("part") == F.max("parts")).alias("all")).where("all").select("shard")
    return m, good.join(small(whole), "shard", "left_semi").select("shard", "s")


def route_published(questions: DataFrame, manifest: DataFrame, shards: DataFrame, most: int = CANDIDATES) -> DataFrame:
    """(question_id, available, rank, case_number, score, hits): the best cases of each question by the published postings.

    A question whose stems need a shard that is missing, unreadable or of another
    generation is not available, since a partial set isn't a search of the whole corpus;
    so are all without a valid manifest, and those without terms. Such a question, and
    one that no case answers, has one row without a rank.
    """
    m, read = _current(manifest, shards)
    stems = question_stems(questions).crossJoin(F.broadcast(m)).select("question_id", "stem", hashing.fnv1a(F.col("stem")).alias("h"), F.col("m.shardCount").alias("n"), F.col("m.cases").alias("cases"), F.col("m.postingFormat").alias("format"))  # one row
    stems = small(stems.withColumn("shard", (F.col("h") % F.col("n")).cast("int")).drop("h", "n"))
    good = read.select("shard", "s.terms").join(small(stems.select("shard").distinct()), "shard", "left_semi")
    whole = stems.join(good.select("shard", F.lit(True).alias("there")).distinct(), "shard", "left").groupBy("question_id").agg(F.every(F.coalesce("there", F.lit(False))).alias("available"))
    entries = good.select("shard", F.explode("terms").alias("stem", "entry")).join(stems, ["shard", "stem"])
    listed = entries.select("question_id", scoring.idf(F.get("entry", F.lit(0)).try_cast("double"), F.col("cases")).alias("idf"), F.inline(posting_entries(F.col("entry"), F.coalesce("format", F.lit("case"))))).where("idf > 0")
    scored = listed.groupBy("question_id", "case_number").agg(F.round(F.sum(F.col("idf") * F.col("weight")), DECIMALS).alias("score"), F.count("*").alias("hits"))
    order = Window.partitionBy("question_id").orderBy(F.desc("score"), F.desc("hits"), "case_number")
    best = scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= most).withColumn("rank", F.col("rank").cast("long"))
    asked = questions.select("question_id").join(whole, "question_id", "left").withColumn("available", F.coalesce("available", F.lit(False)))
    out = asked.join(best, "question_id", "left")
    kept = lambda c: F.when(F.col("available"), F.col(c)).alias(c)
    return out.select("question_id", "available", *map(kept, ("rank", "case_number", "score", "hits"))).where("available OR rank IS NULL").distinct()


def verify_terms(terms: DataFrame, manifest: DataFrame, shards: DataFrame) -> DataFrame:
    """(term, shard, status, frequency, format, cases): what the published index holds of each term.

    'ok' with the first five cases (none above the frequency cap), 'miss' if the shard
    has no entry, 'fail' if it is not there or of another generation.
    """
    m, read = _current(manifest, shards)
    asked = terms.crossJoin(F.broadcast(m)).select("term", (hashing.fnv1a(F.col("term")) % F.col("m.shardCount")).cast("int").alias("shard"), F.col("m.postingFormat").alias("own"))  # one row
    found = asked.join(read.select("shard", "s"), "shard", "left")
    entry = F.try_element_at("s.terms", F.col("term"))
    kind = F.coalesce("s.postingFormat", "own", F.lit("case"))
    held = F.size(entry) > 0
    cases = F.transform(posting_entries(entry, kind), lambda p: p["case_number"])
    # A term's list may be cut over parts, in the order of its cases.
    merged = found.groupBy("term", "shard").agg(F.max(F.col("s").isNotNull()).alias("there"), F.max(F.coalesce(held, F.lit(False))).alias("held"), F.max(F.when(held, F.get(entry, F.lit(0)).try_cast("long"))).alias("frequency"), F.max(F.when(held, kind)).alias("format"), F.sort_array(F.collect_list(F.when(held, F.struct(F.coalesce("s.part", F.lit(0)).alias("part"), F.slice(cases, 1, 5).alias("cases"))))).alias("lists"))
    status = F.when(~F.col("there"), "fail").when(~F.col("held"), "miss").otherwise("ok")
    return merged.select("term", "shard", status.alias("status"), "frequency", "format", F.when(F.col("held"), F.slice(F.flatten(F.transform("lists", lambda x: x["cases"])), 1, 5)).alias("cases"))
