"""WARC archives: a monolithic gzip writer, its normaliser with a sidecar offset index, and a reader by that index.

``write_archives`` puts a record per page into archives that are one gzip stream each, as crawlers that pipe
through gzip leave them.  ``normalise`` inflates such a stream once, in bounded pieces, rewrites every record as a gzip
member of its own and writes the index ``<archive>.idx`` (a JSON line per record: offset, length, type, id).  A stream
that ends early, or whose checksum is wrong, is an error.  ``read_archives`` seeks to each member by the index.

Of records with equal payloads of ``min_revisit_bytes`` or more, the one with the largest page id is a response
and the others revisit it; no payload is stored for a revisit.  Payloads that are smaller aren't shuffled by
digest; larger ones are, once the list of repeated digests is too long to be broadcast.  Digests of very many pages
are broadcast in any case.

Record ids are made of the archive's name and the record's place in it, so they are unique whatever the page ids; the
page's id and that of the page it refers to are fields of their own (``X-Page-ID``, ``X-Refers-To-Page``).

Defined results: a null payload is empty; a null id never is the largest, so among equal payloads whose ids are
all null every record is a response; rows that share the largest id are all responses; each row gives a record; an
empty table gives an empty result; extra columns are ignored.  Line breaks in addresses are percent-encoded.
"""

from __future__ import annotations

import base64
import hashlib
import json
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common, files

VERSION = b"WARC/1.1\r\n"
ARCHIVE_BYTES = 64 << 20
READ_BYTES = 1 << 20
MIN_REVISIT_BYTES = 1000
#: ``WARC-Date`` of pages, which come without one.
DATE = "2000-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
RECORD = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url string"


def planned(pages: DataFrame, min_bytes: int = MIN_REVISIT_BYTES) -> DataFrame:
    """(page_id, url, payload, digest, refers_to, refers_url); both are null for responses."""
    payload = F.coalesce(F.col("html").cast("string"), F.lit("")).cast("binary")
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), payload.alias("payload"))
    rows = rows.withColumn("digest", F.sha1("payload"))
    large, small = rows.where(F.octet_length("payload") >= min_bytes), rows.where(F.octet_length("payload") < min_bytes)
    same = large.groupBy("digest").agg(F.max("page_id").alias("_last"), F.count("*").alias("_n")).where("_n > 1 and _last is not null")
    same = common.materialise(same, "equal")
    urls = large.select(F.col("digest").alias("_d"), "page_id", "url").join(same, (F.col("_d") == F.col("digest")) & (F.col("page_id") == F.col("_last")))
    urls = urls.groupBy("digest").agg(F.max("_last").alias("_last"), F.max("_n").alias("_n"), F.min("url").alias("_url"))
    joined = common.join_split(large, common.materialise(urls, "equal"), "digest", "_n", "left")
    later = F.col("page_id").isNull() | (F.col("page_id") < F.col("_last"))
    joined = joined.withColumn("refers_to", F.when(later, F.col("_last"))).withColumn("refers_url", F.when(later, F.coalesce("_url", F.lit("")))).drop("_last", "_url")
    return joined.unionByName(small.withColumns({"refers_to": F.lit(None).cast("long"), "refers_url": F.lit(None).cast("string")}))


def _page(number: str) -> int | None:
    return int(number) if number else None


def _address(url: str | None) -> str:
    return (url or "").replace("\r", "%0D").replace("\n", "%0A")


def record_id(archive: str, number: int) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{archive}#{number}')}>"


def record(identity: str, row: dict, date: str = DATE) -> bytes:
    """A response or revisit record of a planned row, with the two line ends that close it."""
    coded, revisit = base64.b32encode(bytes.fromhex(row["digest"])).decode(), row["refers_to"] is not None
    head = {
        "WARC-Type": "revisit" if revisit else "response",
        "WARC-Record-ID": identity,
        "WARC-Date": date,
        "WARC-Target-URI": _address(row["url"]),
        "WARC-Payload-Digest": f"sha1:{coded}",
        "X-Page-ID": "" if row["page_id"] is None else str(row["page_id"]),
        "X-Payload-Length": str(len(row["payload"])),
        "Content-Type": "application/http; msgtype=response",
    }
    if revisit:
        head |= {"WARC-Profile": PROFILE, "WARC-Refers-To-Target-URI": _address(row["refers_url"]), "WARC-Refers-To-Date": date, "X-Refers-To-Page": str(row["refers_to"])}
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n" + (b"" if revisit else row["payload"])
    head["Content-Length"] = str(len(block))
    return VERSION + "".join(f"{k}: {v}\r\n" for k, v in head.items()).encode() + b"\r\n" + block + b"\r\n\r\n"


def fields(head: bytes) -> dict[str, str]:
    """The named fields of a record's header."""
    pairs = (line.partition(":") for line in head.decode("utf-8", "replace").split("\r\n")[1:])
    return {k.strip().lower(): v.strip() for k, _, v in pairs if k}


def split_records(chunks: Iterator[bytes]) -> Iterator[bytes]:
    """Whole records from the pieces of an inflated stream; never holds more than a record and a piece."""
    held, need = bytearray(), 0
    for chunk in chunks:
        held += chunk
        while True:
            if not need:
                end = held.find(b"\r\n\r\n")
                if end < 0:
                    break
                need = end + 4 + int(fields(bytes(held[:end]))["content-length"]) + 4
            if len(held) < need:
                break
            yield bytes(held[:need])
            del held[:need]
            need = 0
    if held:
        raise ValueError(f"{len(held)} bytes are left after the last whole record")


def inflated(source) -> Iterator[bytes]:
    """The content of a gzip file of any number of members, in pieces of at most ``READ_BYTES``."""
    inflate = zlib.decompressobj(31)
    while data := source.read(READ_BYTES):
        while data:
            if inflate.eof:
                inflate = zlib.decompressobj(31)
            if piece := inflate.decompress(data, READ_BYTES):
                yield piece
            data = inflate.unused_data if inflate.eof else inflate.unconsumed_tail
    while piece := inflate.decompress(b"", READ_BYTES):
        yield piece
    if not inflate.eof:
        raise ValueError("the gzip stream ends before its checksum")


def _write(folder: str, archive_bytes: int, date: str):
    def run(batches):
        out, squeeze, uri, size, n = None, None, "", 0, 0

        def closed() -> pa.RecordBatch:
            out.write(squeeze.flush())
            out.close()
            return pa.RecordBatch.from_pydict({"archive": [uri], "n_records": [n]}, schema=pa.schema([("archive", pa.string()), ("n_records", pa.int64())]))

        for batch in batches:
            for row in batch.to_pylist():
                if out is None:
                    uri = files.fresh(folder, ".warc.gz")
                    out, squeeze, size, n = files.open_output(uri), zlib.compressobj(6, zlib.DEFLATED, 31), 0, 0
                data = record(record_id(uri, n), row, date)
                out.write(squeeze.compress(data))
                size, n = size + len(data), n + 1
                if size >= archive_bytes:
                    yield closed()
                    out = None
        if out is not None:
            yield closed()

    return run


def write_archives(pages: DataFrame, folder: str, *, min_revisit_bytes: int = MIN_REVISIT_BYTES, archive_bytes: int = ARCHIVE_BYTES, date: str = DATE) -> DataFrame:
    """Write monolithic archives into ``folder``; (archive, n_records) per file."""
    with common.only_last(pages.sparkSession), common.batches_of(pages.sparkSession):
        rows = planned(pages, min_revisit_bytes)
        return common.materialise(rows.mapInArrow(_write(folder, archive_bytes, date), "archive string, n_records long"), "archives")


def normalise_file(source: str, target: str) -> int:
    """Rewrite one archive with a gzip member per record, and its index beside it; the number of records."""
    lines, at = [], 0
    with files.open_input(source) as src, files.open_output(target) as out:
        for data in split_records(inflated(src)):
            squeeze = zlib.compressobj(6, zlib.DEFLATED, 31)
            member = squeeze.compress(data) + squeeze.flush()
            out.write(member)
            head = fields(data[: data.index(b"\r\n\r\n")])
            lines.append(json.dumps({"offset": at, "length": len(member), "type": head["warc-type"], "id": head["warc-record-id"]}))
            at += len(member)
    files.write_all(f"{target}.idx", "".join(f"{x}\n" for x in lines).encode())
    return len(lines)


def _normalise(folder: str):
    def run(batches):
        for batch in batches:
            for source, expected in zip(batch.column("archive").to_pylist(), batch.column("n_records").to_pylist(), strict=True):
                target = files.fresh(folder, ".warc.gz")
                n = normalise_file(source, target)
                if expected is not None and n != expected:
                    raise ValueError(f"{source} holds {n} records, not {expected}")
                yield pa.RecordBatch.from_pydict({"source": [source], "archive": [target], "n_records": [n]})

    return run


def _spread(archives: DataFrame) -> DataFrame:
    """Each row stands for a file; a task takes one, or several one behind the other."""
    return archives.repartition(files.file_tasks(archives.count()))


def normalise(archives: DataFrame, folder: str) -> DataFrame:
    """(source, archive, n_records): every archive rewritten into ``folder`` with its sidecar index."""
    done = _spread(archives).mapInArrow(_normalise(folder), "source string, archive string, n_records long")
    return common.materialise(done, "normalised")


def read_record(data: bytes) -> tuple:
    """The row of an inflated record; payload length and digest of responses are taken from the payload itself."""
    end = data.index(b"\r\n\r\n")
    head = fields(data[:end])
    block = data[end + 4 : end + 4 + int(head["content-length"])]
    payload = block[block.index(b"\r\n\r\n") + 4 :]
    stated = base64.b32decode(head["warc-payload-digest"].partition(":")[2]).hex()
    if head["warc-type"] == "revisit":
        size, digest, refers = int(head["x-payload-length"]), stated, _page(head["x-refers-to-page"])
    else:
        size, digest, refers = len(payload), hashlib.sha1(payload).hexdigest(), None
        if digest != stated:
            raise ValueError(f"{head['warc-record-id']}: the payload is not the one that was written")
    return _page(head["x-page-id"]), size, digest, head["warc-type"], refers, head["warc-target-uri"]


def _read(batches):
    names = [x.split()[0] for x in RECORD.split(", ")]
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string()]
    for batch in batches:
        for archive in batch.column("archive").to_pylist():
            rows = []
            with files.open_input(archive) as src:
                for line in files.read_all(f"{archive}.idx").splitlines():
                    entry = json.loads(line)
                    rows.append(read_record(zlib.decompress(src.read_at(entry["length"], entry["offset"]), 31)))
            columns = list(zip(*rows, strict=True)) or [()] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)


def read_archives(archives: DataFrame) -> DataFrame:
    """A row per record of normalised archives, each read by its offset."""
    return _spread(archives).mapInArrow(_read, RECORD)


def round_trip(pages: DataFrame, folder: str | None = None, **options) -> DataFrame:
    """Write, normalise and read back; the archives stay in ``folder``, the monolithic ones go."""
    folder = folder or common.work_path(pages.sparkSession, "warc")
    raw = write_archives(pages, f"{folder}/raw", **options)
    done = normalise(raw, f"{folder}/records")
    done.select("source").foreach(lambda row: files.remove(row["source"]))
    return read_archives(done)
