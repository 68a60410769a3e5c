"""A stored inverted index with positions, kept up with its documents.

Layout, in one folder:

* ``segments/<name>``: postings (token, date_id, place, n, positions, length), one row for each token of a column of a
  document, partitioned by ``bucket``, a hash of the token's first two characters, so that a token or a prefix of two
  characters and more is in one bucket.  Inside a bucket, rows are dealt by document into ``splits`` files and sorted by
  token: a query reads the row groups of its tokens, in as many tasks as there are files.  Positions are written with
  Parquet's delta coding.  Each document also has a row with the empty token and the document's length.
* ``dead/<name>``: documents that a change removed or replaced; they hide postings of all earlier segments.
* ``state``: a row for each change (segments alive, documents, tokens), written last.  The row of the highest number counts.

A change writes one small segment; ``merge`` makes one segment of all.  One writer at a time.  Folders of changes that
never got a row in ``state`` are not read, so a job that is lost leaves no trace in results.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass, replace
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.batches import of_arrow
from ..functions.text import index_tokens
from ..sources import work
from . import search as S

BUCKETS = 32
#: Documents in a file of a bucket.
DOCUMENTS_A_SPLIT = 250_000
POSTINGS = "token string, date_id long, place int, n int, positions array<int>, length int"
STATE = "number long, columns array<string>, segments array<string>, dead array<string>, documents long, tokens long"
#: Changes after which ``change`` merges the segments.
MOST_SEGMENTS = 8


def _postings(names: list[str]):
    def run(batches):
        for batch in (p for b in batches for p in of_arrow(b, names)):
            token, key, place, n, length = [], [], [], [], []
            positions: list[int] = []
            texts = [batch.column(c).to_pylist() for c in names]
            for i, date_id in enumerate(batch.column("date_id").to_pylist()):
                found = [index_tokens(t[i] or "") for t in texts]
                before = len(token)
                token.append("")
                place.append(-1)
                n.append(0)
                for c, tokens in enumerate(found):
                    at: dict[str, list[int]] = {}
                    for k, t in enumerate(tokens):
                        if t in at:
                            at[t].append(k)
                        else:
                            at[t] = [k]
                    token += at
                    place += [c] * len(at)
                    for p in at.values():
                        n.append(len(p))
                        positions += p
                rows = len(token) - before
                key += [date_id] * rows
                length += [sum(map(len, found))] * rows
            counts = pa.array(n, pa.int32())
            offsets = pa.array(np.concatenate(([0], np.cumsum(counts.to_numpy(), dtype=np.int64))), pa.int32())
            lists = pa.ListArray.from_arrays(offsets, pa.array(positions, pa.int32()))
            yield pa.RecordBatch.from_arrays(
                [pa.array(token, pa.string()), pa.array(key, pa.int64()), pa.array(place, pa.int32()), counts, lists, pa.array(length, pa.int32())], ["token", "date_id", "place", "n", "positions", "length"]
            )

    return run


def _back(k: int):
    return lambda position: position - k


def bucket_of(token: Column) -> Column:
    return F.pmod(F.xxhash64(F.substring(token, 1, 2)), F.lit(BUCKETS)).cast("int")


def _write(postings: DataFrame, path: str, splits: int) -> None:
    slot = F.pmod(F.xxhash64("date_id"), F.lit(splits))
    dealt = postings.withColumn("bucket", bucket_of(F.col("token"))).withColumn("slot", slot).repartition(max(8, min(BUCKETS * splits, 20_000)), "bucket", "slot")
    writer = dealt.sortWithinPartitions("bucket", "token", "date_id").drop("slot").write.partitionBy("bucket")
    # without a dictionary, whole numbers of the second format are delta coded
    for name in ("positions.list.element", "date_id"):
        writer = writer.option(f"parquet.enable.dictionary#{name}", "false")
    writer.option("parquet.writer.version", "v2").option("compression", "zstd").parquet(path)


@dataclass(frozen=True)
class SearchIndex:
    """A state of the index; changes return the next one."""

    spark: SparkSession
    root: str
    number: int
    columns: tuple[str, ...]
    segments: tuple[str, ...]  # whole paths
    dead: tuple[str, ...]  # of the same place as the segment that came with them; "" where none
    documents: int
    tokens: int

    # -- states -------------------------------------------------------------------------------------------------

    @classmethod
    def build(cls, entries: DataFrame, columns: tuple[str, ...], root: str | None = None) -> SearchIndex:
        """Index the columns of all entries; ids are unique."""
        spark = entries.sparkSession
        new = cls(spark, root or work.fresh(spark, "search"), -1, tuple(columns), (), (), 0, 0)
        return new.change(entries)

    @classmethod
    def open(cls, spark: SparkSession, root: str) -> SearchIndex:
        row = spark.read.schema(STATE).json(f"{root}/state").orderBy(F.desc("number")).first()
        return cls(spark, root, row.number, tuple(row.columns), tuple(row.segments), tuple(row.dead), row.documents, row.tokens)

    def _commit(self, segments: tuple[str, ...], dead: tuple[str, ...]) -> SearchIndex:
        new = replace(self, number=self.number + 1, segments=segments, dead=dead)
        total = new.document_rows().agg(F.count("*").alias("n"), F.coalesce(F.sum("length"), F.lit(0)).alias("t")).first()
        new = replace(new, documents=total["n"], tokens=total["t"])
        state = self.spark.createDataFrame([(new.number, list(new.columns), list(segments), list(dead), new.documents, new.tokens)], STATE)
        state.coalesce(1).write.mode("append").json(f"{self.root}/state")
        return new

    def change(self, upserts: DataFrame | None = None, removed: DataFrame | None = None) -> SearchIndex:
        """Take out the ids of ``removed`` (date_id) and put entries in, in place of those of the same id."""
        if len(self.segments) >= MOST_SEGMENTS:
            return self.merge().change(upserts, removed)
        segment, gone = f"{self.root}/segments/{uuid.uuid4().hex}", ""
        columns = list(self.columns)
        upserts = upserts if upserts is not None else self.spark.createDataFrame([], "date_id long, " + ", ".join(f"`{c}` string" for c in columns))
        rows = upserts.select(F.col("date_id").cast("long").alias("date_id"), *[F.col(f"`{c}`").cast("string").alias(c) for c in columns])
        splits = 1 + upserts.count() // DOCUMENTS_A_SPLIT
        _write(rows.mapInArrow(_postings(columns), POSTINGS), segment, splits)
        if self.segments:
            own = self._read(segment).where((F.col("bucket") == self._bucket("")) & (F.col("token") == "")).select("date_id")
            all_gone = own if removed is None else own.union(removed.select(F.col("date_id").cast("long")))
            gone = f"{self.root}/dead/{uuid.uuid4().hex}"
            all_gone.distinct().write.parquet(gone)
        return self._commit((*self.segments, segment), (*self.dead, gone))

    def fork(self, root: str | None = None) -> SearchIndex:
        """The same documents under another folder: changes of one don't touch the other."""
        return replace(self, root=root or work.fresh(self.spark, "search"))

    def merge(self) -> SearchIndex:
        """One segment of all, without what is dead; the old folders go."""
        segment = f"{self.root}/segments/{uuid.uuid4().hex}"
        _write(self.postings().drop("bucket"), segment, 1 + self.documents // DOCUMENTS_A_SPLIT)
        merged = self._commit((segment,), ("",))
        for old in (*self.segments, *self.dead):
            if old.startswith(f"{self.root}/"):
                work.remove(self.spark, old)
        return merged

    # -- reading ------------------------------------------------------------------------------------------------

    def _read(self, path: str) -> DataFrame:
        return self.spark.read.schema(POSTINGS + ", bucket int").parquet(path)

    def _bucket(self, start: str) -> int:
        return _bucket_number(self.spark, start)

    def postings(self, tokens: tuple[str, ...] | None = None, prefixes: tuple[str, ...] = ()) -> DataFrame:
        """Live postings of the tokens and of all tokens with these prefixes; of every token without any.

        Buckets and tokens are literals, so the scan prunes buckets and pushes the tokens down to row groups.
        """
        keep = None
        if tokens is not None:
            tests = [(F.col("bucket") == self._bucket(t)) & (F.col("token") == t) for t in tokens]
            for p in prefixes:
                wide = F.col("token").startswith(p)
                tests.append((F.col("bucket") == self._bucket(p)) & wide if len(p) > 1 else wide)
            keep = reduce(lambda a, b: a | b, tests) if tests else F.lit(False)
        parts = []
        for i, name in enumerate(self.segments):
            rows = self._read(name)
            rows = rows if keep is None else rows.where(keep)
            later = [d for d in self.dead[i + 1 :] if d]
            if later:
                gone = self.spark.read.schema("date_id long").parquet(*later)
                rows = rows.join(gone.distinct(), "date_id", "left_anti").select(rows.columns)
            parts.append(rows)
        return reduce(DataFrame.union, parts)

    def document_rows(self) -> DataFrame:
        """(date_id, length) of the live documents."""
        return self.postings(("",)).select("date_id", "length")

    def counted(self, phrases: list[S.Phrase], columns: list[str]) -> DataFrame:
        """(date_id, length, n_<phrase>_<column>): how often each phrase stands in each column, of documents with any of its tokens.

        One aggregation by document.  A phrase of several tokens is met where the token lists, moved back by their
        place in the phrase, intersect.
        """
        whole = {t for p in phrases for k, t in enumerate(p.tokens) if not (p.prefix and k == len(p.tokens) - 1)}
        starts = {p.tokens[-1] for p in phrases if p.prefix}
        found = self.postings(tuple(sorted(whole)), tuple(sorted(starts)))
        sums, finals = [], []
        for i, p in enumerate(phrases):
            last = len(p.tokens) - 1
            is_token = [F.col("token").startswith(t) if p.prefix and k == last else F.col("token") == t for k, t in enumerate(p.tokens)]
            for c in columns:
                here, out = F.col("place") == self.columns.index(c), f"n_{i}_{c}"
                if not last:
                    sums.append(F.sum(F.when(is_token[0] & here, F.col("n")).otherwise(0)).alias(out))
                    finals.append(F.col(out).cast("long").alias(out))
                    continue
                lists = []
                for k, met in enumerate(is_token):
                    moved = F.when(met & here, F.transform("positions", _back(k)))
                    sums.append(F.flatten(F.collect_list(moved)).alias(f"at_{i}_{k}_{c}"))
                    lists.append(F.col(f"at_{i}_{k}_{c}"))
                finals.append(F.size(reduce(F.array_intersect, lists)).cast("long").alias(out))
        slim = found.where(F.col("token") != "").groupBy("date_id").agg(F.first("length").alias("length"), *sums)
        return slim.select("date_id", F.col("length").cast("long").alias("length"), *finals)

    def search(self, query: str, weights: dict[str, float]) -> DataFrame:
        """What ``search.search`` returns, from the index: no text is read."""
        groups = S.parse(query)
        if not groups:
            return S.nothing(self.spark, list(weights))
        phrases = S.phrases_of(groups)
        rows, mean = F.lit(self.documents), F.lit(self.tokens / self.documents if self.documents else 0.0)
        if set(weights) == set(self.columns):
            return S.ranked(self.counted(phrases, list(weights)), groups, weights, rows, mean)
        # the length of a document counts the columns searched
        places = [self.columns.index(c) for c in weights]
        all_postings = self.postings().where(F.col("place").isin(*places))
        lengths = all_postings.groupBy("date_id").agg(F.sum("n").alias("own"))
        total = lengths.agg(F.coalesce(F.sum("own"), F.lit(0))).first()[0]
        counted = self.counted(phrases, list(weights)).join(lengths, "date_id", "left").withColumn("length", F.coalesce("own", F.lit(0)).cast("long")).drop("own")
        return S.ranked(counted, groups, weights, rows, F.lit(total / self.documents if self.documents else 0.0))


_numbers: dict[str, int] = {}


def _bucket_number(spark: SparkSession, start: str) -> int:
    """The bucket of a token, as the writer computed it."""
    start = start[:2]
    if start not in _numbers:
        _numbers[start] = spark.range(1).select(bucket_of(F.lit(start))).first()[0]
    return _numbers[start]
