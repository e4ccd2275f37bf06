"""Hashes that must agree with published indexes, as Column expressions in 64-bit arithmetic."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

# FNV-1a's offset and prime, the second hash's seed, filter sizes, shard counts.
FNV_OFFSET, FNV_PRIME, SECOND_SEED = 0x811C9DC5, 0x01000193, 0x9E3779B9
FILTER_BYTES, FILTER_HASHES, ROUTER_BYTES, ROUTER_BANDS, TERM_SHARDS, ROUTER_PARTS = 2048, 5, 256, 4, 4096, 16
WORD = (1 << 32) - 1


def _codes(term: Column) -> Column:
    return F.transform(F.filter(F.split(term, ""), lambda c: c != ""), lambda c: F.ascii(c).cast("long"))


def _low(x: Column) -> Column:
    return x.bitwiseAND(F.lit(WORD))


def fnv1a(term: Column) -> Column:
    return F.aggregate(_codes(term), F.lit(FNV_OFFSET).cast("long"), lambda h, c: _low(h.bitwiseXOR(c) * FNV_PRIME))


def second_hash(term: Column) -> Column:
    """A shift-and-add hash, made odd."""
    step = lambda h, c: h.bitwiseXOR(_low(c + SECOND_SEED + F.shiftleft(h, 6) + F.shiftright(h, 2)))
    return F.aggregate(_codes(term), F.lit(SECOND_SEED).cast("long"), step).bitwiseOR(F.lit(1).cast("long"))


def term_shard(term: Column, shards: int = TERM_SHARDS) -> Column:
    return (fnv1a(term) % shards).cast("int")


def filter_bits(term: Column, size: int = FILTER_BYTES) -> Column:
    """The term's bit positions in a filter of ``size`` bytes; they may coincide."""
    first, second = fnv1a(term), second_hash(term)
    return F.transform(F.sequence(F.lit(0), F.lit(FILTER_HASHES - 1)), lambda i: (_low(first + _low(i * second) + i * i) % (8 * size)).cast("int"))


def filter_positions(words: np.ndarray, size: int = FILTER_BYTES) -> np.ndarray:
    """The same positions for an array of ASCII words (dtype S), one row of them for each word: letters of all words go side by side."""
    letters = words.view(np.uint8).reshape(len(words), words.dtype.itemsize).astype(np.uint64)
    lengths, low = np.char.str_len(words), np.uint64(WORD)
    first, second = np.full(len(words), FNV_OFFSET, dtype=np.uint64), np.full(len(words), SECOND_SEED, dtype=np.uint64)
    for i in range(int(lengths.max(initial=0))):
        on, c = lengths > i, letters[:, i]
        first = np.where(on, ((first ^ c) * np.uint64(FNV_PRIME)) & low, first)
        second = np.where(on, second ^ ((c + np.uint64(SECOND_SEED) + (second << np.uint64(6)) + (second >> np.uint64(2))) & low), second)
    i = np.arange(FILTER_HASHES, dtype=np.uint64)
    return (((first[:, None] + ((i * (second | np.uint64(1))[:, None]) & low) + i * i) & low) % np.uint64(8 * size)).astype(np.int64)


def route_seed(terms: Column) -> Column:
    return F.aggregate(_codes(F.array_join(terms, "|")), F.lit(0).cast("long"), lambda h, c: _low(h * 31 + c))


def router_part(case_number: Column, parts: int = ROUTER_PARTS) -> Column:
    return (F.crc32(case_number) % parts).cast("int")


def shard_key(slot: str, shard: Column, shards: int = TERM_SHARDS) -> Column:
    return F.concat(F.lit(f"term-index/v1/slots/{slot}/shard-"), F.lpad(shard.cast("string"), len(str(shards - 1)), "0"), F.lit(".json.gz"))


def sql_blob(data: Column) -> Column:
    return F.concat(F.lit("X'"), F.lower(F.hex(data)), F.lit("'"))


def hmac_sha256(secret: str, payload: Column) -> Column:
    """HMAC-SHA256 as binary, from sha2 over the padded keys."""
    import hashlib

    key = secret.encode()
    key = (hashlib.sha256(key).digest() if len(key) > 64 else key).ljust(64, b"\0")
    pad = lambda x: F.lit(bytearray(b ^ x for b in key))
    inner = F.unhex(F.sha2(F.concat(pad(0x36), payload.cast("binary")), 256))
    return F.unhex(F.sha2(F.concat(pad(0x5C), inner), 256))


def signature(secret: str, payload: Column) -> Column:
    """URL-safe base64 of the HMAC without padding."""
    return F.rtrim(F.translate(F.base64(hmac_sha256(secret, payload)), "+/", "-_"), F.lit("="))


def issue_token(secret: str, request_id: Column, issued_ms: Column) -> Column:
    payload = F.concat_ws(".", issued_ms.cast("string"), request_id)
    return F.concat_ws(".", payload, signature(secret, payload))


def verified_request(secret: str, token: Column, now_ms: int | Column, ttl_ms: int = 7 * 86_400_000, skew_ms: int = 300_000) -> Column:
    """The request id of a valid token, else null."""
    parts = F.split(token, r"\.")
    issued, request = F.get(parts, F.lit(0)).try_cast("long"), F.get(parts, F.lit(1))
    ok = (F.size(parts) == 3) & (issued <= now_ms + skew_ms) & (F.lit(now_ms) - issued <= ttl_ms) & request.rlike("(?i)^[a-f0-9-]{36}$")
    return F.when(ok & (signature(secret, F.concat_ws(".", issued.cast("string"), request)) == F.get(parts, F.lit(2))), request)
