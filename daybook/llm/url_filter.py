"""URL filter: a few written rules, and a list of blocked keys held exactly by a Bloom filter cascade.

Cascade.  Level 0 is a Bloom filter of the listed keys.  The unlisted keys of the corpus that pass it by mistake are few
and known, since the universe of keys is: level 1 encodes them, level 2 the listed keys that pass level 1 by mistake, and
so on until a level makes no mistake.  A key's verdict is the parity of the first level that it fails, exact for every
key of the universe, so pages are judged where they lie by a structure of some bits a listed key, without a join.

Keys are dealt by hash to about sqrt(keys) shards of about sqrt(keys) keys, and each shard's cascade is built in one
task: a job whatever the number of levels.  The keys travel as 128-bit digests.

Keys of a url are the host, every domain above it (``a.b.c``, ``b.c``, ``c``), and the address (host and path).

Defined cases: a null url or one without ``://`` has an empty host and path, no key and no rule, and is allowed; rows
that repeat are judged each; of rules that fit the longest wins, of equally long ones the first; an empty list blocks
nothing; an empty table gives an empty result; columns of any other name pass through.
"""

from __future__ import annotations

import math
import pickle
import uuid
from collections.abc import Iterable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common

#: (verdict, host, path): a rule fits its host and all below it where the path begins with the rule's.
RULES = (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"))
#: Words whose domains are listed, when a label holds one between hyphens.
LISTED_WORDS = ("ads", "adult", "bets", "casino", "gambling", "pills", "poker", "porn", "spam", "viagra", "warez", "xxx")
#: A cascade of more bytes isn't broadcast.
BROADCAST_BYTES = 64 << 20
#: Mistakes that a level after the first may make.
RATE = 0.5

_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


# -- urls -------------------------------------------------------------------------------------------------------


def parts_of(url: Column) -> tuple[Column, Column]:
    """Host in lower case (A-Z only) and path."""
    pattern = r"(?s)^.*?://([^/?#]*)([^?#]*)"
    host, path = (F.coalesce(F.regexp_extract(url, pattern, i), F.lit("")) for i in (1, 2))
    return F.translate(host, _UPPER, _UPPER.lower()), path


def rule_of(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The longest rule that fits, as ``host/path``, and its verdict; both null where none fits."""
    rule = verdict = F.lit(None).cast("string")
    for how, h, p in sorted(rules, key=lambda r: len(r[1] + r[2]), reverse=True)[::-1]:
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        rule, verdict = F.when(fits, h + p).otherwise(rule), F.when(fits, how).otherwise(verdict)
    return rule, verdict


def keys_of(host: Column, path: Column) -> Column:
    """The domains of a host, itself first, and the address; none where the host is empty."""
    labels = F.split(host, r"\.")
    above = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    return F.when(host == "", F.array().cast("array<string>")).otherwise(F.concat(above, F.array(F.concat(host, F.when(path == "", "/").otherwise(path)))))


def listed_domains(urls: DataFrame, words: Iterable[str] = LISTED_WORDS) -> DataFrame:
    """(key) every domain in the table whose first label holds one of the words between hyphens."""
    host, _ = parts_of(F.col("url"))
    held = r"(?:^|-)(?:" + "|".join(sorted(words)) + r")(?:-|$)"
    domains = urls.select(host.alias("host")).distinct().select(F.explode(keys_of(F.col("host"), F.lit(""))).alias("key"))
    return domains.where(~F.contains("key", F.lit("/")) & F.substring_index("key", ".", 1).rlike(held)).distinct()


def _own(name: str) -> str:
    """A column name that no table has."""
    return f"_{name}_{uuid.uuid4().hex[:8]}"


# -- the cascade ------------------------------------------------------------------------------------------------


def digest(key: Column) -> tuple[Column, Column]:
    """Two 64-bit hashes of a key, computed in the JVM."""
    return F.xxhash64(F.lit(1), key), F.xxhash64(F.lit(2), key, F.length(key))


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Bloom:
    """A Bloom filter of digests; every level draws its own places."""

    def __init__(self, level: int, bits: int, hashes: int):
        self.level, self.bits, self.hashes = level, bits, hashes
        self.held = np.zeros(-(-bits // 8), np.uint8)

    @classmethod
    def of(cls, level: int, digests: np.ndarray, rate: float) -> Bloom:
        hashes = max(1, round(-math.log2(rate)))
        out = cls(level, max(8, math.ceil(len(digests) * hashes / math.log(2))), hashes)
        for places in out._places(digests):
            np.bitwise_or.at(out.held, places >> 3, np.uint8(1) << (places & 7).astype(np.uint8))
        return out

    def _places(self, digests: np.ndarray):
        salt = _mixed(np.array([self.level + 1], np.uint64) * np.uint64(0x9E3779B97F4A7C15))[0]
        start, step = _mixed(digests[:, 0] ^ salt), digests[:, 1] * np.uint64(2) + np.uint64(1)
        for i in range(self.hashes):
            yield (_mixed(start + np.uint64(i) * step) % np.uint64(self.bits)).astype(np.int64)

    def holds(self, digests: np.ndarray) -> np.ndarray:
        found = np.ones(len(digests), bool)
        for places in self._places(digests):
            found &= (self.held[places >> 3] >> (places & 7).astype(np.uint8)) & 1 == 1
        return found


def cascade(listed: np.ndarray, others: np.ndarray) -> list[Bloom]:
    """The levels that tell ``listed`` digests from all ``others``; both without repeats, of two columns of uint64."""
    # the first level lets about as many others through as are listed; less would cost more bits than it saves later
    rate = min(RATE, max(len(listed) / max(1, len(others)) * math.sqrt(0.5), 1e-9))
    levels, within, against = [], listed, others
    while len(within):
        if len(levels) > 200:
            raise RuntimeError("two keys of one digest, one listed and one not")
        levels.append(Bloom.of(len(levels), within, rate))
        within, against, rate = against[levels[-1].holds(against)], within, RATE
    return levels


def listed_in(levels: list[Bloom], digests: np.ndarray) -> np.ndarray:
    """Whether each digest of the universe is listed: the parity of the first level that it fails."""
    out = np.full(len(digests), len(levels) % 2 == 1)
    left = np.arange(len(digests))
    for i, level in enumerate(levels):
        passed = level.holds(digests[left])
        out[left[~passed]] = i % 2 == 1
        left = left[passed]
    return out


def _pairs(a, b) -> np.ndarray:
    """Digests as an array of two columns, from Arrow columns of longs."""
    return np.column_stack([x.to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64) for x in (a, b)])


def _build(keys: pa.Table) -> pa.Table:
    """The cascade of one shard's keys."""
    digests, listed = _pairs(keys["h1"], keys["h2"]), keys["listed"].to_numpy().astype(bool)
    levels = cascade(digests[listed], digests[~listed])
    return pa.table({"shard": keys["shard"].slice(0, 1).cast(pa.int32()), "levels": pa.array([pickle.dumps(levels)])})


def shard_of(h1: Column, shards: int) -> Column:
    return F.pmod(h1, F.lit(shards)).cast("int")


class UrlCascade:
    """The cascades of all shards as a work table (shard, levels)."""

    def __init__(self, table: DataFrame, shards: int, size: int):
        self.table, self.shards, self.size = table, shards, size

    @classmethod
    def of(cls, universe: DataFrame, listed: DataFrame) -> UrlCascade:
        """Of two tables with a column ``key``; listed keys may be missing from the universe, both may repeat.

        Keys are combined before they are shuffled; the second shuffle deals digests, each once.
        """
        flagged = lambda df, flag: df.select(*[d.alias(n) for d, n in zip(digest(F.col("key")), ("h1", "h2"), strict=True)], F.lit(flag).alias("listed"))
        keys = flagged(universe, False).unionByName(flagged(listed, True)).groupBy("h1", "h2").agg(F.max("listed").alias("listed"))
        keys = common.materialise(keys, "keys")
        shards = max(1, math.isqrt(keys.count()))
        dealt = keys.withColumn("shard", shard_of(F.col("h1"), shards)).groupBy("shard").applyInArrow(_build, "shard int, levels binary")
        table = common.materialise(dealt, "cascade")
        common.discard(keys)
        return cls(table, shards, table.agg(F.sum(F.length("levels"))).first()[0] or 0)

    def drop(self) -> None:
        common.discard(self.table)

    def flag(self, rows: DataFrame, keys: str, out: str, limit: int = BROADCAST_BYTES) -> DataFrame:
        """``rows`` with ``out``: whether any key of the column of lists ``keys`` is listed.

        Up to ``limit`` bytes of cascade go to every executor and rows stay where they are.  A larger one stays dealt:
        the distinct keys of the rows go to its shards, each task reading those of its own, and the rows' keys meet the
        listed ones among them.
        """
        return self._broadcast(rows, keys, out) if self.size <= limit else self._dealt(rows, keys, out)

    def _broadcast(self, rows: DataFrame, keys: str, out: str) -> DataFrame:
        held = rows.sparkSession.sparkContext.broadcast({r["shard"]: bytes(r["levels"]) for r in self.table.collect()})
        shards, names, first, second = self.shards, rows.columns, _own("h1"), _own("h2")
        schema = T.StructType(list(rows.schema.fields)).add(out, "boolean")
        asked = rows.withColumns({first: F.transform(keys, lambda k: digest(k)[0]), second: F.transform(keys, lambda k: digest(k)[1])})

        def run(batches):
            levels = {}
            for batch in batches:
                h1, h2 = batch.column(first), batch.column(second)
                digests = _pairs(h1.flatten(), h2.flatten())
                found = np.zeros(len(digests), bool)
                own = (digests[:, 0].view(np.int64) % shards).astype(np.int64)
                order = np.argsort(own, kind="stable")
                for part in np.split(order, np.flatnonzero(np.diff(own[order])) + 1) if len(order) else ():
                    shard = int(own[part[0]])
                    if shard not in levels:
                        levels[shard] = pickle.loads(held.value.get(shard) or pickle.dumps([]))
                    found[part] = listed_in(levels[shard], digests[part])
                ends = h1.offsets.to_numpy() - h1.offsets[0].as_py()
                upto = np.append(0, np.cumsum(found))
                yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array(upto[ends[1:]] > upto[ends[:-1]])], [*names, out])

        return asked.mapInArrow(run, schema)

    def _dealt(self, rows: DataFrame, keys: str, out: str) -> DataFrame:
        shards = self.shards
        asked = rows.select(F.explode(keys).alias("k")).select(*[d.alias(n) for d, n in zip(digest(F.col("k")), ("h1", "h2"), strict=True)]).distinct()
        asked = asked.withColumn("shard", shard_of(F.col("h1"), shards))

        def run(left: pa.Table, right: pa.Table) -> pa.Table:
            levels = pickle.loads(right["levels"][0].as_py()) if right.num_rows else []
            found = listed_in(levels, _pairs(left["h1"], left["h2"])) if left.num_rows else np.zeros(0, bool)
            return left.select(["h1", "h2"]).filter(pa.array(found))

        hits = common.materialise(asked.groupBy("shard").cogroup(self.table.groupBy("shard")).applyInArrow(run, "h1 long, h2 long"), "hits")
        # the lists of keys that hold a hit, each once: rows meet them by the digest of the list
        mine, key, hit = _own("keys"), _own("key"), _own("hit")
        lists = rows.select(F.col(keys).alias(mine)).distinct().withColumn(key, F.explode(mine))
        h1, h2 = digest(F.col(key))
        met = lists.join(hits, (h1 == F.col("h1")) & (h2 == F.col("h2")), "left_semi").select(mine, F.lit(True).alias(hit)).distinct()
        return rows.join(met, F.col(keys) == F.col(mine), "left").withColumn(out, F.coalesce(hit, F.lit(False))).drop(mine, hit)


# -- verdicts ---------------------------------------------------------------------------------------------------


def judge(pages: DataFrame, listed: DataFrame | None = None, *, rules=RULES, words=LISTED_WORDS, limit: int = BROADCAST_BYTES) -> DataFrame:
    """``pages`` with host, path, rule, listed and verdict.

    ``listed`` has the blocked keys in a column ``key`` (domains, or addresses as host and path); without it those of
    ``listed_domains`` are taken.  The rules' verdict comes before the list's.
    """
    host, path = parts_of(F.col("url"))
    urls = pages.select("url")
    universe = urls.select(F.explode(keys_of(host, path)).alias("key"))
    held = UrlCascade.of(universe, listed_domains(urls, words) if listed is None else listed)
    keys, own = _own("keys"), ("host", "path", "rule", "listed", "verdict")
    split = pages.drop(*own).withColumns({"host": host, "path": path}).withColumn(keys, keys_of(F.col("host"), F.col("path")))
    flagged = held.flag(split, keys, "listed", limit).drop(keys)
    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    method = F.when(F.col("listed"), "block").otherwise("allow")
    return flagged.withColumn("rule", rule).withColumn("verdict", F.coalesce(verdict, method))


def verdicts(pages: DataFrame) -> DataFrame:
    """(page_id, host, path, rule, verdict, listed) of every page."""
    return judge(pages.select("page_id", "url")).select("page_id", "host", "path", "rule", "verdict", "listed")
