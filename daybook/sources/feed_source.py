"""Polled feeds as a data source: ``spark.read`` or ``spark.readStream.format("polled_feed")``.

A feed is a folder of polled bodies, one file a poll, named by a growing number (``17.json``, or as Spark's text writer
leaves them, ``poll=17/part-0``).  Bodies repeat what earlier ones said; the source gives each item when a poll says it
first or says it anew: an item is left out where the last good poll before had the very same one.  A poll that failed,
whose body isn't JSON or not of the feed's shape, gives nothing and leaves what was read before as it is.

What a poll gives follows from the files alone, so offsets are poll numbers, and a batch that is run again after a
restart gives the same rows.  Each poll is a partition; a body is read whole by one task, as are the bodies between it
and the last good one.

Options: ``path``; ``items``, the field that holds the list of items (empty: the body is the list).
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from dataclasses import dataclass

from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

NAME = "polled_feed"
SCHEMA = "poll long, place int, item string"
_NUMBER = re.compile(r"(?:^|/)poll=(\d+)/[^/_.][^/]*$|(?:^|/)(\d+)\.[^/]*$")


@dataclass
class Polls(InputPartition):
    """A poll, and those before it, newest first, from which the last good one is taken."""

    number: int
    files: list[str]
    before: list[list[str]]


def polls_of(path: str) -> dict[int, list[str]]:
    """The files of each poll under a folder."""
    system, root = fs.FileSystem.from_uri(path if "://" in path else f"file://{path}")
    found: dict[int, list[str]] = {}
    for info in system.get_file_info(fs.FileSelector(root, recursive=True, allow_not_found=True)):
        m = _NUMBER.search(info.path)
        if info.is_file and m:
            found.setdefault(int(m[1] or m[2]), []).append(info.path)
    return {n: sorted(files) for n, files in sorted(found.items())}


def items_of(path: str, files: list[str], field: str) -> list[str] | None:
    """The items of a poll as JSON with sorted keys; None where the poll failed."""
    system, _ = fs.FileSystem.from_uri(path if "://" in path else f"file://{path}")
    text = b""
    for name in files:
        with system.open_input_stream(name) as f:
            text += f.read()
    try:
        body = json.loads(text)
        body = body[field] if field else body
    except (ValueError, KeyError, TypeError):
        return None
    return [json.dumps(x, sort_keys=True, ensure_ascii=False) for x in body] if isinstance(body, list) else None


class _Reading:
    def __init__(self, options: dict):
        self.path, self.field = options["path"], options.get("items", "")

    def planned(self, after: int, upto: int | None = None) -> list[Polls]:
        every = polls_of(self.path)
        numbers = [n for n in every if n > after and (upto is None or n <= upto)]
        return [Polls(n, every[n], [every[k] for k in sorted(every, reverse=True) if k < n]) for n in numbers]

    def read(self, partition: Polls | None) -> Iterator[tuple]:
        if partition is None:  # no poll yet
            return
        items = items_of(self.path, partition.files, self.field)
        if items is None:
            return
        known = next(filter(lambda x: x is not None, (items_of(self.path, b, self.field) for b in partition.before)), None)
        held = set(known or ())
        for place, item in enumerate(items):
            if item not in held:
                held.add(item)
                yield partition.number, place, item


class FeedReader(_Reading, DataSourceReader):
    def partitions(self) -> list[Polls]:
        return self.planned(-1)


class FeedStreamReader(_Reading, DataSourceStreamReader):
    def initialOffset(self) -> dict:
        return {"poll": -1}

    def latestOffset(self) -> dict:
        return {"poll": max(polls_of(self.path), default=-1)}

    def partitions(self, start: dict, end: dict) -> list[Polls]:
        return self.planned(start["poll"], end["poll"])

    def commit(self, end: dict) -> None:
        """Nothing is given up: later polls need the last good one."""


class FeedSource(DataSource):
    """Registered with ``spark.dataSource.register(FeedSource)``."""

    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return FeedReader(self.options)

    def streamReader(self, schema) -> DataSourceStreamReader:
        return FeedStreamReader(self.options)


def readings(items: DataFrame) -> DataFrame:
    """(poll, at, kp) of the items of a feed of readings; two spellings of time are understood, others give no row."""
    x = F.from_json("item", "time_tag string, kp double")
    at = F.coalesce(F.try_to_timestamp(x["time_tag"], F.lit("yyyy-MM-dd HH:mm:ss[.SSS]")), F.try_to_timestamp(x["time_tag"], F.lit("yyyy-MM-dd'T'HH:mm:ss")))
    return items.select("poll", at.alias("at"), x["kp"].alias("kp")).where("at is not null and kp is not null")


def polled(rows: DataFrame, poll: str, path: str) -> None:
    """Write rows as the polls of a feed: a body a value of ``poll``, a list of the other columns as objects.

    A body is one value, as one answer of a server is.
    """
    item = F.struct(*[c for c in rows.columns if c != poll])
    bodies = rows.groupBy(poll).agg(F.to_json(F.sort_array(F.collect_list(item))).alias("value"))
    bodies.withColumnRenamed(poll, "poll").repartition("poll").write.partitionBy("poll").text(path)
