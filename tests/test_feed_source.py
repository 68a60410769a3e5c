"""The polled feed as a source: batch, stream with restarts, failed polls."""

import json

import pytest

from daybook.sources import feed_source as S


@pytest.fixture
def feed(spark, tmp_path):
    spark.dataSource.register(S.FeedSource)
    folder = tmp_path / "feed"
    folder.mkdir()
    return folder


def reading(hour, kp):
    return {"time_tag": f"2024-01-01 {hour:02d}:00:00", "kp": kp}


def body(*hours, **changed):
    return json.dumps([reading(h, changed.get(f"h{h}", h / 10)) for h in hours])


def told(rows):
    return sorted((r.poll, r.at.hour, r.kp) for r in S.readings(rows).collect())


def test_batch_gives_each_item_once(spark, feed):
    (feed / "1.json").write_text(body(1, 2, 3))
    (feed / "2.json").write_text("<html>down</html>")
    (feed / "10.json").write_text(body(2, 3, 4))
    (feed / "11.json").write_text(body(3, 4, 4, h3=9.0))
    (feed / "12.json").write_text(json.dumps({"error": 1}))
    (feed / "13.json").write_text(body(4, 5))
    (feed / "notes.txt").write_text("no poll")
    rows = spark.read.format("polled_feed").load(str(feed))
    assert told(rows) == [(1, 1, 0.1), (1, 2, 0.2), (1, 3, 0.3), (10, 4, 0.4), (11, 3, 9.0), (13, 5, 0.5)]
    assert rows.rdd.getNumPartitions() == 6


def test_items_of_a_field(spark, feed):
    (feed / "1.json").write_text(json.dumps({"results": [{"b": 1, "a": "é"}]}))
    (feed / "2.json").write_text(json.dumps({"results": [{"a": "é", "b": 1}, {"a": None}]}))
    rows = spark.read.format("polled_feed").option("items", "results").load(f"file://{feed}")
    assert [tuple(r) for r in rows.orderBy("poll").collect()] == [(1, 0, '{"a": "é", "b": 1}'), (2, 1, '{"a": null}')]


def test_empty_folder(spark, feed):
    assert spark.read.format("polled_feed").load(str(feed)).count() == 0


def test_stream_restarts_where_it_stopped(spark, feed, tmp_path):
    def run():
        stream = spark.readStream.format("polled_feed").load(str(feed))
        query = stream.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "check")).trigger(availableNow=True).start()
        query.awaitTermination(60)
        assert query.exception() is None
        return told(spark.read.schema(S.SCHEMA).parquet(str(tmp_path / "out")))

    (feed / "1.json").write_text(body(1, 2))
    assert run() == [(1, 1, 0.1), (1, 2, 0.2)]
    (feed / "2.json").write_text("")
    (feed / "3.json").write_text(body(1, 2, 3))
    assert run() == [(1, 1, 0.1), (1, 2, 0.2), (3, 3, 0.3)]
    assert run() == [(1, 1, 0.1), (1, 2, 0.2), (3, 3, 0.3)]
    # the last batch is run again, as after a crash before its commit
    for name in ("commits/1", "commits/.1.crc"):
        (tmp_path / "check" / name).unlink(missing_ok=True)
    assert run() == [(1, 1, 0.1), (1, 2, 0.2), (3, 3, 0.3)]


def test_written_by_spark(spark, feed, tmp_path):
    rows = spark.createDataFrame([(1, "x", 1.0), (1, "y", 2.0), (2, "y", 2.0), (2, "z", None)], "day long, id string, v double")
    S.polled(rows, "day", f"file://{tmp_path}/polls")
    got = spark.read.format("polled_feed").load(f"file://{tmp_path}/polls")
    assert sorted((r.poll, json.loads(r.item)["id"]) for r in got.collect()) == [(1, "x"), (1, "y"), (2, "z")]
