"""Archives: round trip, revisits, members by offset."""

import gzip
import hashlib
import io
import json

import pytest

from daybook.llm import files, warc


@pytest.fixture(scope="module")
def pages(spark):
    big, mid, edge = "ü" * 700, "y" * 999, "z" * 1000
    rows = [(1, "u1", big), (5, "u2", big), (3, "u3\r\nx", big), (7, None, mid), (8, "u", mid), (9, "u", None), (10, "u", ""), (2, "u", edge), (None, "u", edge), (11, "u", edge), (11, "v", edge), (12, "w", "q\r\n\r\nWARC/1.1\r\n" * 90)]
    return spark.createDataFrame([(*r, 1) for r in rows], "page_id long, url string, html string, digest int")


def test_round_trip_and_revisits(pages):
    got = sorted((x.page_id or 0, x.payload_bytes, x.payload_digest, x.record_type, x.refers_to or 0) for x in warc.round_trip(pages, archive_bytes=3000).collect())
    want = []
    last = {"ü" * 700: 5, "z" * 1000: 11}
    for x in pages.collect():
        body = (x.html or "").encode()
        target = last.get(x.html)
        again = target is not None and (x.page_id or 0) < target
        want.append((x.page_id or 0, len(body), hashlib.sha1(body).hexdigest(), "revisit" if again else "response", target if again else 0))
    assert got == sorted(want)


def test_members_stand_alone_and_the_index_finds_them(pages, tmp_path):
    folder = f"file://{tmp_path}"
    raw = warc.write_archives(pages, f"{folder}/raw")
    for row in warc.normalise(raw, f"{folder}/records").collect():
        data = files.read_all(row.archive)
        whole = b"".join(gzip.decompress(data[e["offset"] : e["offset"] + e["length"]]) for e in map(json.loads, files.read_all(f"{row.archive}.idx").splitlines()))
        assert whole == gzip.decompress(files.read_all(row.source)) == gzip.decompress(data)
        assert len(data) > len(files.read_all(row.source)) or row.n_records == 1


def planned_row(page_id, payload=b"x", refers_to=None):
    return {"page_id": page_id, "url": "u", "payload": payload, "digest": hashlib.sha1(payload).hexdigest(), "refers_to": refers_to, "refers_url": None if refers_to is None else "w"}


def test_broken_stream_is_an_error():
    with pytest.raises(ValueError, match="left after"):
        list(warc.split_records(iter([warc.record("<urn:uuid:1>", planned_row(1))[:-1]])))


@pytest.mark.parametrize("short", [1, 4, 8, 9, 200, None])
def test_truncated_streams_are_errors(short):
    records = b"".join(warc.record(warc.record_id("a", i), planned_row(i, bytes([i]) * 5000)) for i in range(40))
    whole = gzip.compress(records)
    assert b"".join(warc.inflated(io.BytesIO(whole))) == records
    assert b"".join(warc.inflated(io.BytesIO(whole + whole))) == records * 2
    with pytest.raises(ValueError, match="ends before"):
        list(warc.inflated(io.BytesIO(whole[:-short] if short else b"")))


def test_inflating_is_bounded():
    pieces = [len(x) for x in warc.inflated(io.BytesIO(gzip.compress(bytes(50 << 20))))]
    assert sum(pieces) == 50 << 20 and max(pieces) <= warc.READ_BYTES


def test_required_fields_and_unique_ids(pages, tmp_path):
    raw = warc.write_archives(pages, f"file://{tmp_path}/raw")
    heads = []
    for row in raw.collect():
        heads += [warc.fields(x[: x.index(b"\r\n\r\n")]) for x in warc.split_records(iter([gzip.decompress(files.read_all(row.archive))]))]
    assert len({h["warc-record-id"] for h in heads}) == len(heads) == pages.count()
    assert all(h[k] for h in heads for k in ("warc-type", "warc-record-id", "warc-date", "content-length"))
    assert {h["warc-refers-to-target-uri"] for h in heads if h["warc-type"] == "revisit"} == {"u2", "u"}


def test_empty_table(spark):
    assert warc.round_trip(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_removing_twice_is_no_error(tmp_path):
    """A task that runs again finds its file gone."""
    uri = f"file://{tmp_path}/x"
    files.write_all(uri, b"1")
    files.remove(uri)
    files.remove(uri)
    assert not (tmp_path / "x").exists()
