"""Keyed digests as column expressions: HMAC-SHA256, cohorts of addresses, and signed ballots."""

from __future__ import annotations

import hashlib

from pyspark.sql import Column
from pyspark.sql import functions as F

BLOCK = 64
#: Bytes of an address that a cohort keeps, and of a digest that names it.
V4_BYTES, V6_BYTES, COHORT_BYTES = 3, 6, 8
#: What in a browser's name tells its class; the first that is found counts.
CLASSES = (("firefox", "firefox"), ("edg/", "edge"), ("chrome", "chrome"), ("safari", "safari"), ("curl", "tool"), ("wget", "tool"), ("python", "tool"), ("bot", "bot"))
NO_CLASS, OTHER_CLASS = "none", "other"
#: The format of a ballot.
VERSION, TAG_BYTES, BODY_BYTES, VOTER_BYTES, PROBE, BOUND = 1, 16, 27, 16, 1, 2
CATEGORIES = ("beautiful", "fascinating")


def pads(key: bytes) -> tuple[bytes, bytes]:
    """The inner and the outer pad of a key."""
    key = (hashlib.sha256(key).digest() if len(key) > BLOCK else key).ljust(BLOCK, b"\0")
    return bytes(b ^ 0x36 for b in key), bytes(b ^ 0x5C for b in key)


def hmac_sha256(key: bytes, message: Column) -> Column:
    """The keyed digest of a binary column, 32 bytes; computed in the JVM, null stays null."""
    inner, outer = (F.lit(p) for p in pads(key))
    digest = lambda data: F.unhex(F.sha2(data, 256))
    return digest(F.concat(outer, digest(F.concat(inner, message))))


# -- cohorts ------------------------------------------------------------------------------------------------------


def _v4(address: Column) -> Column:
    """The four bytes of a dotted address, else null."""
    parts = F.split(address, r"\.")
    fits = (F.size(parts) == 4) & F.forall(parts, lambda p: p.rlike(r"^(0|[1-9][0-9]{0,2})$") & (F.coalesce(p.try_cast("int"), F.lit(999)) < 256))
    return F.when(fits, F.unhex(F.array_join(F.transform(parts, lambda p: F.lpad(F.hex(p.cast("int").cast("long")), 2, "0")), "")))


def _v6(address: Column) -> Column:
    """The sixteen bytes of an address with colons, ``::`` and a dotted end included, else null."""
    tail = F.regexp_extract(address, r":([0-9.]+\.[0-9.]+)$", 1)
    dotted = F.hex(_v4(tail))
    plain = F.when(tail == "", address).otherwise(F.concat(F.regexp_replace(address, r"[0-9.]+$", ""), F.substring(dotted, 1, 4), F.lit(":"), F.substring(dotted, 5, 4)))
    sides = F.split(plain, "::")
    groups = lambda side: F.when(F.coalesce(side, F.lit("")) == "", F.array().cast("array<string>")).otherwise(F.split(side, ":"))
    left, right = groups(F.get(sides, F.lit(0))), groups(F.get(sides, F.lit(1)))
    missing = 8 - F.size(left) - F.size(right)
    ok = (F.size(sides) <= 2) & ((F.size(sides) == 2) & (missing >= 1) | (F.size(sides) == 1) & (missing == 0))
    whole = F.concat(left, F.array_repeat(F.lit("0"), F.greatest(missing, F.lit(0))), right)
    fits = ok & F.forall(whole, lambda g: g.rlike("^[0-9A-Fa-f]{1,4}$"))
    return F.when(F.contains(address, F.lit(":")) & fits, F.unhex(F.array_join(F.transform(whole, lambda g: F.lpad(g, 4, "0")), "")))


def network(address: Column) -> Column:
    """The address with everything behind its network zeroed: /24 of four bytes, /48 of sixteen; null for no address."""
    v4, v6 = _v4(address), _v6(address)
    cut = lambda raw, keep, size: F.concat(F.substring(raw, 1, keep), F.lit(bytes(size - keep)))
    return F.coalesce(cut(v4, V4_BYTES, 4), cut(v6, V6_BYTES, 16))


def agent_class(agent: Column) -> Column:
    low, told = F.lower(agent), F.lit(OTHER_CLASS)
    for needle, name in reversed(CLASSES):
        told = F.when(F.contains(low, F.lit(needle)), name).otherwise(told)
    return F.when(agent.isNull(), NO_CLASS).otherwise(told)


def cohort(key: bytes, address: Column, agent: Column) -> Column:
    """Eight bytes that people of one network with one kind of browser share, and that don't give the address away."""
    return F.substring(hmac_sha256(key, F.concat(network(address), F.lit(b"|"), agent_class(agent).cast("binary"))), 1, COHORT_BYTES)


# -- ballots ------------------------------------------------------------------------------------------------------


def _whole(number: Column, size: int) -> Column:
    """A whole number as so many bytes, the highest first."""
    return F.unhex(F.right(F.lpad(F.hex(number.cast("long")), 16, "0"), F.lit(2 * size)))


def ballot_body(category: Column, left: Column, right: Column, voter: Column, probe: Column, issued_ms: Column, nonce: Column) -> Column:
    """The bytes of a ballot; ``voter`` is sixteen bytes or null, ``nonce`` a long of which all 64 bits count."""
    place = F.lit(None).cast("int")
    for i, name in enumerate(CATEGORIES):
        place = F.when(category == name, i).otherwise(place)
    flags = F.when(probe, PROBE).otherwise(0) + F.when(voter.isNotNull(), BOUND).otherwise(0)
    head = F.concat(F.lit(bytes([VERSION])), _whole(place, 1), _whole(flags, 1))
    return F.concat(head, _whole(left, 4), _whole(right, 4), _whole(issued_ms, 8), _whole(nonce, 8), F.coalesce(voter, F.lit(b"")))


def signed(key: bytes, body: Column) -> Column:
    """Body and the first bytes of its digest, in the letters that addresses may hold."""
    raw = F.concat(body, F.substring(hmac_sha256(key, body), 1, TAG_BYTES))
    return F.rtrim(F.translate(F.base64(raw), "+/=\r\n", "-_ "))


def opened(key: bytes, token: Column) -> Column:
    """(category, left, right, voter, probe, issued_ms, nonce) of a token that the key signed; null for any other."""
    fits = token.rlike("^[A-Za-z0-9_-]+$") & (F.length(token) % 4 != 1)
    padded = F.concat(F.translate(token, "-_", "+/"), F.substring(F.lit("==="), 1, (4 - F.length(token) % 4) % 4))
    raw = F.try_to_binary(F.when(fits, padded), F.lit("base64"))
    size = F.length(raw) - TAG_BYTES
    body, tag = F.substring(raw, F.lit(1), size), F.substring(raw, size + 1, F.lit(TAG_BYTES))
    number = lambda at, n: F.conv(F.hex(F.substring(body, at, n)), 16, -10).cast("long")
    signed_4 = lambda at: F.when(number(at, 4) >= 2**31, number(at, 4) - 2**32).otherwise(number(at, 4)).cast("int")
    flags = number(3, 1)
    bound = flags.bitwiseAND(F.lit(BOUND).cast("long")) != 0
    sound = (size >= BODY_BYTES) & (F.substring(hmac_sha256(key, body), 1, TAG_BYTES) == tag) & (number(1, 1) == VERSION) & (number(2, 1) < len(CATEGORIES))
    sound = sound & (~bound | (size == BODY_BYTES + VOTER_BYTES))
    category = F.get(F.array(*map(F.lit, CATEGORIES)), number(2, 1).cast("int"))
    fields = F.struct(
        category.alias("category"), signed_4(4).alias("left"), signed_4(8).alias("right"), F.when(bound, F.substring(body, BODY_BYTES + 1, VOTER_BYTES)).alias("voter"),
        (flags.bitwiseAND(F.lit(PROBE).cast("long")) != 0).alias("probe"), number(12, 8).alias("issued_ms"), number(20, 8).alias("nonce"),
    )
    return F.when(sound, fields)


def fresh(issued_ms: Column, now_ms: Column, life_ms: int) -> Column:
    """A ballot of the last ``life_ms``; clocks may differ by a minute."""
    age = now_ms - issued_ms
    return (age >= -60_000) & (age <= life_ms)
