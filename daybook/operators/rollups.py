"""Roll-ups of words and links that follow their entries: signed deltas instead of counting anew.

A change comes as the rows that go and the rows that come (an update is both).  Sums and counts take signed deltas; a
key vanishes with its last entry.  A minimum or maximum only needs the rows behind it when the row that held it goes,
so first and last are recomputed for the keys whose extreme was retracted and for no other; the scheme follows from a
count of the rows with the safer one.  Labels are recomputed, from counts per anchor that take signed deltas
themselves, for the keys that changed.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.keyed import Keyed
from ..sources.work import kept
from . import catalogue


def signed(old: DataFrame, new: DataFrame) -> DataFrame:
    """Rows that go with ``sign`` -1 and rows that come with 1."""
    return new.withColumn("sign", F.lit(1)).unionByName(old.withColumn("sign", F.lit(-1)))


def changed(table: DataFrame, upserts: DataFrame, removed: DataFrame, key: str) -> DataFrame:
    """The rows of a table that a change takes away: those removed and those replaced."""
    gone = removed.select(key).union(upserts.select(key)).distinct()
    return table.join(gone.hint("shuffle_hash"), key, "left_semi")  # the rows themselves are not sorted


# -- words ------------------------------------------------------------------------------------------------------


def word_deltas(old: DataFrame, new: DataFrame) -> DataFrame:
    """(word, total, entries): signed, words that come out even left out; of two bags (date_id, word, n)."""
    sums = signed(old, new).groupBy("word").agg(F.sum(F.col("n") * F.col("sign")).alias("total"), F.sum("sign").alias("entries"))
    return sums.where("total <> 0 or entries <> 0")


def _summed(rows: DataFrame, deltas: DataFrame) -> DataFrame:
    both = rows.select("word", "total", "entries").unionByName(deltas.select("word", "total", "entries"))
    return both.groupBy("word").agg(F.sum("total").alias("total"), F.sum("entries").alias("entries")).where("entries > 0")


@dataclass(frozen=True)
class WordRollup:
    """(word, total, entries)"""

    words: Keyed

    @classmethod
    def build(cls, bag: DataFrame, parts: int = 32) -> WordRollup:
        return cls.of(catalogue.words(bag), parts)

    @classmethod
    def of(cls, words: DataFrame, parts: int = 32) -> WordRollup:
        return cls(Keyed.of(words, "word", parts))

    def change(self, old: DataFrame, new: DataFrame) -> WordRollup:
        """After the bags ``old`` went and ``new`` came."""
        return self._after(word_deltas(old, new))

    def moved(self, old: DataFrame, new: DataFrame) -> WordRollup:
        """After entries went and came, of whose words ``old`` and ``new`` are the sums (word, total, entries)."""
        sums = signed(old, new).groupBy("word").agg(F.sum(F.col("total") * F.col("sign")).alias("total"), F.sum(F.col("entries") * F.col("sign")).alias("entries"))
        return self._after(sums.where("total <> 0 or entries <> 0"))

    def _after(self, deltas: DataFrame) -> WordRollup:
        return WordRollup(self.words.change(kept(deltas), _summed))

    def rows(self) -> DataFrame:
        return self.words.rows()


# -- links ------------------------------------------------------------------------------------------------------

LINK = ("page_id", "key", "scheme", "host", "anchor", "n")


def link_deltas(old: DataFrame, new: DataFrame) -> DataFrame:
    """A row a key: signed sums, and the extremes of the rows that come and of those that go."""
    comes, goes = F.col("sign") > 0, F.col("sign") < 0
    return signed(old.select(*LINK), new.select(*LINK)).groupBy("key").agg(
        F.min("host").alias("new_host"), F.sum(F.col("n") * F.col("sign")).alias("d_refs"), F.sum("sign").alias("d_entries"),
        F.min(F.when(comes, F.col("page_id"))).alias("new_first"), F.max(F.when(comes, F.col("page_id"))).alias("new_last"),
        F.min(F.when(goes, F.col("page_id"))).alias("gone_first"), F.max(F.when(goes, F.col("page_id"))).alias("gone_last"), F.sum(F.when(F.col("scheme") == "https", F.col("sign")).otherwise(0)).alias("d_secure"),
    )


def labels(anchors: DataFrame) -> DataFrame:
    """(key, label): the most frequent anchor, shorter ones first."""
    return anchors.groupBy("key").agg(F.min_by("anchor", F.struct(-F.col("c"), F.char_length("anchor"), "anchor")).alias("label"))


def retracted(both: DataFrame) -> DataFrame:
    """(key) of the keys that lost the row of an extreme and go on."""
    lost = (F.col("gone_first") <= F.col("first_id")) | (F.col("gone_last") >= F.col("last_id"))
    return both.where(lost & (F.coalesce("entries", F.lit(0)) + F.col("d_entries") > 0)).select("key")


def _anchor_counts(links: DataFrame) -> DataFrame:
    return links.where("anchor <> ''").groupBy("key", "anchor").agg(F.count("*").alias("c"))


@dataclass(frozen=True)
class LinkRollup:
    """(key, scheme, host, refs, entries, first_id, last_id, label), with the links and anchors behind it, all dealt by key."""

    links: Keyed
    anchors: Keyed
    resources: Keyed

    @classmethod
    def build(cls, links: DataFrame, parts: int = 32) -> LinkRollup:
        links = kept(links.select(*LINK))
        secure = links.groupBy("key").agg(F.count_if(F.col("scheme") == "https").alias("secure"))
        return cls(Keyed.of(links, "key", parts), Keyed.of(_anchor_counts(links), "key", parts), Keyed.of(catalogue.resources(links).join(secure, "key"), "key", parts))

    def change(self, old: DataFrame, new: DataFrame) -> LinkRollup:
        """After the links ``old`` went and ``new`` came; a page has one row a key."""
        old, new = kept(old.select(*LINK)), kept(new.select(*LINK))
        deltas = kept(link_deltas(old, new))
        parts = self.links.touched(deltas)
        links = self.links.change(signed(old, new), lambda rows, c: rows.join(c.where("sign < 0"), ["page_id", "key"], "left_anti").unionByName(c.where("sign > 0").select(*LINK)))
        counts = signed(old, new).where("anchor <> ''").groupBy("key", "anchor").agg(F.sum("sign").alias("c"))
        anchors = self.anchors.change(counts, lambda rows, c: rows.unionByName(c).groupBy("key", "anchor").agg(F.sum("c").alias("c")).where("c > 0"))

        def combine(rows: DataFrame, deltas: DataFrame) -> DataFrame:
            both = rows.join(deltas, "key", "full")
            dirty = kept(retracted(both))
            anew = links.rows(parts).join(dirty, "key", "left_semi").groupBy("key").agg(F.min("page_id").alias("x_first"), F.max("page_id").alias("x_last"))
            named = labels(anchors.rows(parts).join(deltas.select("key"), "key", "left_semi")).withColumnRenamed("label", "x_label")
            met = both.join(anew, "key", "left").join(named, "key", "left")
            alone = F.col("d_entries").isNull()
            zero = F.lit(0)
            secure = F.coalesce("secure", zero) + F.coalesce("d_secure", zero)
            return met.select(
                "key", F.when(secure > 0, "https").otherwise("http").alias("scheme"), secure.alias("secure"), F.coalesce("host", "new_host").alias("host"),
                (F.coalesce("refs", zero) + F.coalesce("d_refs", zero)).alias("refs"), (F.coalesce("entries", zero) + F.coalesce("d_entries", zero)).alias("entries"),
                F.coalesce("x_first", F.least("first_id", "new_first")).alias("first_id"), F.coalesce("x_last", F.greatest("last_id", "new_last")).alias("last_id"),
                F.when(alone, F.col("label")).otherwise(F.col("x_label")).alias("label"),
            ).where("entries > 0")

        return LinkRollup(links, anchors, self.resources.change(deltas, combine))

    def rows(self) -> DataFrame:
        return self.resources.rows().drop("secure")
