"""Suffix-array dedup: remove every byte inside a passage that also starts in a document with a smaller id.

The unit is a window of ``length`` (50) bytes; windows are suffixes cut to that length.  The method is a
common-prefix-aware distributed merge sort of suffixes:

* *Chunks.*  Documents are packed into chunks of a few MB, written once as a bucketed table.  A chunk is the unit
  that runs are made of, so a lost executor's run is rebuilt exactly as it was.
* *Anchors.*  The 16-byte string with the smallest hash, the first of them if it repeats, anchors a window.
  Neighbouring windows with the same anchor in the same place make a *stretch*; equal windows have equal anchors, so a
  stretch whose anchor occurs in one document only can't repeat.  Each chunk sends every distinct anchor once,
  whatever its number of copies, and gets back whether it is shared and whether it is crowded.
* *Crowded anchors* stand in very many different stretches (a common phrase).  Their stretches are cut into their
  windows, each of which is anchored by a hash of itself, so the bytes around the phrase spread it over all ranges.
* *Runs.*  A shared stretch is the suffix that starts at its anchor, followed by the bytes before the anchor,
  backwards.  Each chunk sorts them by (anchor, suffix, bytes before), merges equal ones to their smallest id,
  front-codes and exchanges them by anchor range; anchors are hashes, so ranges are even whatever the text.
* *Merge.*  A loser tree merges the runs of a range by known prefix lengths; equal stretches fall together.  The
  windows of an anchor's different stretches are settled by the same order: two stretches share the window that starts
  o bytes before the anchor where their suffixes share length - o bytes and the bytes before them o bytes, and both
  lengths are those of neighbours in sorted order, so a window's class is a pair of places in the two orders.
  Every run gets the smallest id of each of its windows back.
* *Removal.*  Each chunk drops the bytes of windows that start in a smaller id and hashes the rest.

No text is gathered by passage or by document: what a task of the merge reads is a range of anchors, and copies
within a chunk count once.  Chunks and ranges grow with the fourth root of the input beyond 64 GB (to 4 times their
size), since every chunk sends a message to nearly every range.

Defined results: null text is empty; matches never cross documents; rows with equal ids never remove from each
other; a null id counts as larger than all others; an empty table gives an empty result; extra columns are ignored;
with ``texts``, a character that loses a byte goes as a whole.  ``length`` may be 16 to 130.
"""

from __future__ import annotations

import hashlib
import uuid

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common
from .suffix_runs import decode, front_code, merge

LENGTH = 50
GRAM = 16
CHUNK_BYTES = 4 << 20
RANGE_BYTES = 32 << 20
BLOCK = 1 << 18
NO_ID = (1 << 63) - 1
#: Occurrences, and bits of the sketch of different stretches, that make an anchor crowded.
CROWD, CROWD_BITS = 32_768, 3
#: Different stretches that are settled together.
SETTLE = 20_000
_STEP = np.uint64(0x9E3779B97F4A7C15)
_MIX = np.uint64(0xD6E8FEB86659FD93)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * _MIX
    return x ^ (x >> np.uint64(29))


def _gram_hashes(b: np.ndarray) -> np.ndarray:
    """64-bit hashes of all 16-byte strings along the last axis."""
    two = b[..., :-1].astype(np.uint16) | (b[..., 1:].astype(np.uint16) << np.uint16(8))
    four = two[..., :-2].astype(np.uint32) | (two[..., 2:].astype(np.uint32) << np.uint32(16))
    eight = four[..., :-4].astype(np.uint64) | (four[..., 4:].astype(np.uint64) << np.uint64(32))
    return _mixed(_mixed(eight[..., :-8] * _STEP) + eight[..., 8:])


def _window_minima(low: np.ndarray, length: int) -> np.ndarray:
    """The smallest of each window's gram hashes."""
    have, want = 1, length - GRAM + 1
    while have * 2 <= want:
        low = np.minimum(low[:-have], low[have:])
        have *= 2
    return np.minimum(low[: -(want - have)], low[want - have :]) if want > have else low


def stretches(data: bytes, ends: np.ndarray, length: int = LENGTH) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(start, number of windows, hash of the anchor, document) of every stretch in texts laid end to end."""
    buf = np.frombuffer(data, np.uint8)
    starts_of = np.concatenate([[0], ends[:-1]])
    out = []
    for lo in range(0, len(buf) - length + 1, BLOCK):
        hi = min(lo + BLOCK, len(buf) - length + 1)  # windows lo..hi-1
        grams = _gram_hashes(buf[lo : hi + length - 1])
        low = _window_minima(grams, length)
        first, last = np.searchsorted(ends, lo, "right"), np.searchsorted(ends, hi - 1, "right")
        fits = np.ones(hi - lo, bool)  # windows that stay inside one document
        edge = np.zeros(hi - lo, bool)
        for e in ends[first : last + 2].tolist():
            fits[max(0, e - length + 1 - lo) : max(0, e - lo)] = False
        heads = starts_of[first : last + 1]
        edge[heads[(heads >= lo) & (heads < hi)] - lo] = True
        edge[0] = True
        edge[1:] |= (low[1:] != low[:-1]) | (fits[1:] != fits[:-1]) | (grams[: hi - lo - 1] == low[:-1])
        at = np.flatnonzero(edge)
        n = np.diff(np.append(at, hi - lo))
        ok = fits[at]
        at, n = at[ok], n[ok]
        out.append((at + lo, n, low[at]))
    if not out:
        none = np.empty(0, np.int64)
        return none, none, np.empty(0, np.uint64), none
    start, n, low = (np.concatenate(x) for x in zip(*out, strict=True))
    return start, n, _mixed(low * _STEP), np.searchsorted(ends, start, "right")


def anchor_places(data: bytes, start: np.ndarray, n: np.ndarray, length: int) -> np.ndarray:
    """Where the anchors of stretches stand: at the smallest gram hash of their last window, the first if it repeats."""
    buf, want = np.frombuffer(data, np.uint8), length - GRAM + 1
    place = np.empty(len(start), np.int64)
    for at in range(0, len(start), 1 << 14):
        last = (start + n - 1)[at : at + (1 << 14)]
        lo, hi = int(last.min()), int(last.max()) + length
        if hi - lo <= BLOCK * 2:
            grams = _gram_hashes(buf[lo:hi])[(last - lo)[:, None] + np.arange(want)]
        else:  # far apart
            grams = _gram_hashes(buf[last[:, None] + np.arange(length)])
        place[at : at + len(last)] = last + grams.argmin(axis=1)
    return place


def _ends_hash(data: bytes, start: np.ndarray, n: np.ndarray, length: int) -> np.ndarray:
    """A hash of the first and last bytes of stretches; equal for equal ones."""
    buf = np.frombuffer(data, np.uint8)
    stop = start + n + length - 1
    x = n.astype(np.uint64)
    for at in (start, start + 4, stop - 8, stop - 4):
        four = np.zeros(len(start), np.uint64)
        for k in range(4):
            four = (four << np.uint64(8)) | buf[at + k].astype(np.uint64)
        x = _mixed(x * _STEP + four)
    return x


def _chunks(size_limit: int):
    def run(batches):
        held, size = [], 0
        for batch in batches:
            kind = batch.schema.field("carry").type
            for i, t, c in zip(*(batch.column(k).to_pylist() for k in ("doc_id", "text", "carry")), strict=True):
                raw = (t or "").encode()
                held.append((i, raw, c))
                size += len(raw)
                if size >= size_limit or len(held) >= size_limit // 64:
                    yield _chunk(held, kind)
                    held, size = [], 0
        if held:
            yield _chunk(held, kind)

    return run


def _chunk(rows: list[tuple], kind: pa.DataType) -> pa.RecordBatch:
    ids, texts, carry = zip(*rows, strict=True)
    columns = [pa.array([ids], pa.list_(pa.int64())), pa.array([[len(x) for x in texts]], pa.list_(pa.int64())), pa.array([b"".join(texts)], pa.binary()), pa.array([carry], pa.list_(kind))]
    return pa.RecordBatch.from_arrays(columns, ["ids", "sizes", "data", "carry"])


class _Chunk:
    """A chunk row with its stretches."""

    def __init__(self, row: dict, length: int):
        self.number, self.data, self.length = row["chunk"], row["data"], length
        self.ids = np.array([NO_ID if i is None else i for i in row["ids"]], np.int64)
        self.sizes = np.array(row["sizes"], np.int64)
        self.ends = np.cumsum(self.sizes)
        self.start, self.n, self.anchor, self.doc = stretches(self.data, self.ends, length)

    def anchors(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Distinct anchors ascending; whether each occurs in two documents; how often, at most 255; and the anchor
        number of each stretch."""
        order = np.argsort(self.anchor, kind="stable")
        key = self.anchor[order]
        head = np.ones(len(key), bool)
        head[1:] = key[1:] != key[:-1]
        at = np.flatnonzero(head)
        docs = self.ids[self.doc[order]]
        several = np.minimum.reduceat(docs, at) != np.maximum.reduceat(docs, at) if len(at) else np.empty(0, bool)
        number = np.empty(len(key), np.int64)
        number[order] = np.cumsum(head) - 1
        often = np.minimum(np.diff(np.append(at, len(key))), 255).astype(np.uint8)
        return key[at], several, often, number

    def sketch(self, number: np.ndarray, anchors: int) -> np.ndarray:
        """Four bits an anchor, one of which each different stretch sets."""
        bit = np.uint8(1) << (_ends_hash(self.data, self.start, self.n, self.length) >> np.uint64(62)).astype(np.uint8)
        out = np.zeros(anchors, np.uint8)
        np.bitwise_or.at(out, number, bit)
        return out


def _range_of(anchors: np.ndarray, ranges: int) -> np.ndarray:
    return ((anchors >> np.uint64(32)) * np.uint64(ranges) >> np.uint64(32)).astype(np.int64)


def _cuts(anchors: np.ndarray, ranges: int) -> list[tuple[int, int, int]]:
    """(range, from, to) of ascending anchors."""
    r = _range_of(anchors, ranges)
    at = np.flatnonzero(np.append(True, r[1:] != r[:-1])) if len(r) else np.empty(0, np.int64)
    return [(int(r[a]), int(a), int(b)) for a, b in zip(at, np.append(at[1:], len(r)), strict=True)]


def _rows(batches):
    for batch in batches:
        yield from batch.to_pylist()


def _batch(rows: list[tuple], names: list[str], types: list) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) or [()] * len(names)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names)


def _short(keys: np.ndarray) -> bytes:
    """The first six bytes of hashes; anchors that are equal in these are treated as one in the first exchange only."""
    return keys.astype(">u8").view(np.uint8).reshape(-1, 8)[:, :6].tobytes()


def _nibbles(x: np.ndarray) -> bytes:
    even = np.append(x, np.zeros(len(x) % 2, np.uint8))
    return (even[::2] << np.uint8(4) | even[1::2]).tobytes()


def _send_anchors(length: int, ranges: int):
    def run(batches):
        squeeze = zstandard.ZstdCompressor(level=1)
        names = ["range", "chunk", "anchors", "several", "often", "sketch"]
        for row in _rows(batches):
            c = _Chunk(row, length)
            key, several, often, number = c.anchors()
            sketch = c.sketch(number, len(key))
            out = [
                (r, row["chunk"], _short(key[a:b]), np.packbits(several[a:b]).tobytes(), squeeze.compress(often[a:b].tobytes()), _nibbles(sketch[a:b]))
                for r, a, b in _cuts(key, ranges)
            ]
            yield _batch(out, names, [pa.int32(), pa.int64()] + [pa.binary()] * 4)

    return run


def _shared_anchors(group: pa.Table) -> pa.Table:
    """Of one range: for each chunk, which of its anchors occur in two documents, and which are crowded."""
    expand = zstandard.ZstdDecompressor()
    sets = [np.frombuffer(x, np.uint8).reshape(-1, 6) for x in group.column("anchors").to_pylist()]
    sizes = [len(x) for x in sets]
    several = np.concatenate([np.unpackbits(np.frombuffer(x, np.uint8), count=n) for x, n in zip(group.column("several").to_pylist(), sizes, strict=True)])
    often = np.frombuffer(b"".join(expand.decompress(x) for x in group.column("often").to_pylist()), np.uint8)
    pairs = (np.frombuffer(x, np.uint8) for x in group.column("sketch").to_pylist())
    sketch = np.concatenate([np.stack([x >> 4, x & 15], axis=1).ravel()[:n] for x, n in zip(pairs, sizes, strict=True)])
    key = np.zeros((sum(sizes), 8), np.uint8)
    key[:, 2:] = np.concatenate(sets)
    key = key.view(">u8").ravel().astype(np.uint64)
    order = np.argsort(key, kind="stable")
    at = np.flatnonzero(np.append(True, key[order][1:] != key[order][:-1]))
    runs = np.diff(np.append(at, len(key)))
    total = np.add.reduceat(often[order].astype(np.int64), at)
    different = np.bitwise_count(np.bitwise_or.reduceat(sketch[order], at))
    shared = (runs > 1) | (np.maximum.reduceat(several[order], at) > 0)
    found = np.empty((2, len(key)), bool)
    found[0, order] = np.repeat(shared, runs)
    found[1, order] = np.repeat((total > CROWD) & (different >= CROWD_BITS), runs)
    bits, at = [], 0
    for n in sizes:
        bits.append(np.packbits(found[:, at : at + n]).tobytes())
        at += n
    return pa.table({"chunk": group.column("chunk"), "range": group.column("range"), "bits": pa.array(bits, pa.binary())})


def _whole_hash(data: bytes, start: np.ndarray, length: int) -> np.ndarray:
    """A hash of every byte of the windows at ``start``."""
    buf, x = np.frombuffer(data, np.uint8), np.full(len(start), length, np.uint64)
    for k in range(0, length, 7):
        word = np.zeros(len(start), np.uint64)
        for j in range(k, min(k + 7, length)):
            word = (word << np.uint64(8)) | buf[start + j].astype(np.uint64)
        x = _mixed(x * _STEP + word)
    return x


def _planes(x: np.ndarray) -> bytes:
    """Whole numbers below 2**31 by their first bytes, second bytes and so on, which pack better."""
    return x.astype("<i4").view(np.uint8).reshape(-1, 4).T.tobytes()


def _from_planes(x: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(x, np.uint8).reshape(4, -1).T).view("<i4").ravel().astype(np.int64)


def _send_runs(length: int, ranges: int):
    def run(batches):
        squeeze = zstandard.ZstdCompressor(level=1)
        for row in _rows(batches):
            c = _Chunk(row, length)
            key, _, _, number = c.anchors()
            found = np.zeros((2, len(key)), bool)
            by_range = {x["range"]: x["bits"] for x in row["found"] or []}
            for r, a, b in _cuts(key, ranges):
                if r in by_range:
                    found[:, a:b] = np.unpackbits(np.frombuffer(by_range[r], np.uint8), count=2 * (b - a)).reshape(2, b - a)
            shared, crowded = found[0][number], found[1][number]
            left, cut = np.flatnonzero(shared & ~crowded), np.flatnonzero(shared & crowded)
            which = np.repeat(cut, c.n[cut])
            single = c.start[which] + np.arange(len(which)) - np.repeat(np.cumsum(c.n[cut]) - c.n[cut], c.n[cut])
            start = np.concatenate([c.start[left], single])
            n = np.concatenate([c.n[left], np.ones(len(single), np.int64)])
            doc = np.concatenate([c.doc[left], c.doc[which]])
            place = np.concatenate([anchor_places(c.data, c.start[left], c.n[left], length), single])
            anchor = np.concatenate([c.anchor[left], _whole_hash(c.data, single, length)])
            prefix, data = anchor.astype(">u8").tobytes(), c.data
            least: dict[tuple[bytes, int], int] = {}
            spots = zip(start.tolist(), place.tolist(), (start + n + length - 1).tolist(), strict=True)
            # (anchor, suffix from the anchor, bytes before it backwards) and the number of those
            strings = [(prefix[8 * i : 8 * i + 8] + data[p:b] + data[a:p][::-1], p - a) for i, (a, p, b) in enumerate(spots)]
            for s, d in zip(strings, c.ids[doc].tolist(), strict=True):
                if d < least.get(s, NO_ID + 1):
                    least[s] = d
            items = sorted(least)
            at = {s: i for i, s in enumerate(items)}
            occ = _planes(np.array([at[s] for s in strings], np.int64))
            names = ["range", "chunk", "lcps", "sizes", "before", "tails", "docs"]
            kinds = [pa.int32(), pa.int64()] + [pa.binary()] * 5
            out = [(-1, row["chunk"], squeeze.compress(occ), squeeze.compress(_planes(np.diff(start, prepend=0))), None, squeeze.compress(n.astype(np.uint8).tobytes()), None)]
            for r, a, b in _cuts(np.frombuffer(b"".join(s[:8] for s, _ in items), ">u8").astype(np.uint64), ranges):
                lcps, sizes, tails = front_code([s for s, _ in items[a:b]])
                before = bytes(k for _, k in items[a:b])
                owners = np.array([least[s] for s in items[a:b]], np.int64)
                out.append((r, row["chunk"], lcps, sizes, before, squeeze.compress(tails), squeeze.compress(owners.tobytes())))
            yield _batch(out, names, kinds)

    return run


def settled(groups: np.ndarray, strings: list[bytes], before: np.ndarray, lcp: np.ndarray, least: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """(number of windows of each stretch, smallest id of each window) of stretches in sorted order.

    ``strings`` start at the anchor and end with the ``before`` bytes that stand before it, backwards; ``lcp`` is what
    each has in common with the one above it, ``groups`` numbers their anchors in order.
    """
    e = len(strings)
    n = np.array([len(s) for s in strings], np.int64) - length + 1
    # what neighbours share in the order of the suffixes; nothing across anchors
    right = lcp.copy()
    right[1:][groups[1:] != groups[:-1]] = -1
    right[0] = -1
    # and in the order of the bytes before the anchor, backwards
    deep = max(1, int(before.max()))
    backward = np.frombuffer(b"".join(s[len(s) - b :].ljust(deep, b"\0") for s, b in zip(strings, before.tolist(), strict=True)), np.uint8).reshape(e, deep)
    keyed = np.concatenate([groups.astype(">u4").view(np.uint8).reshape(e, 4), backward], axis=1)
    order = np.argsort(np.ascontiguousarray(keyed).view(f"S{deep + 4}").ravel(), kind="stable")
    differ = backward[order][1:] != backward[order][:-1]
    left = np.full(e, -1, np.int64)
    left[1:] = np.where(differ.any(axis=1), differ.argmax(axis=1), deep)
    left[1:][groups[order][1:] != groups[order][:-1]] = -1
    # stretches of one class at a depth lie together; those too short for the depth are never looked up in it
    offset = np.arange(length - GRAM + 1)  # bytes of the window before the anchor
    right_class = np.cumsum(right[None, :] < (length - offset)[:, None], axis=1)
    left_class = np.empty_like(right_class)
    left_class[:, order] = np.cumsum(left[None, :] < offset[:, None], axis=1)
    which = np.repeat(np.arange(e), n)
    o = before[which] - (np.arange(len(which)) - np.repeat(np.cumsum(n) - n, n))
    key = (o * (e + 1) + right_class[o, which]) * (e + 1) + left_class[o, which]
    sort = np.argsort(key, kind="stable")
    at = np.flatnonzero(np.append(True, key[sort][1:] != key[sort][:-1]))
    low = np.minimum.reduceat(least[which][sort], at)
    out = np.empty(len(which), np.int64)
    out[sort] = np.repeat(low, np.diff(np.append(at, len(which))))
    return n, out


def _merge_runs(length: int):
    def run(table: pa.Table) -> pa.Table:
        squeeze, expand = zstandard.ZstdCompressor(level=1), zstandard.ZstdDecompressor()
        rows = table.select(["lcps", "sizes", "before", "tails", "docs"]).to_pylist()
        owners = [np.frombuffer(expand.decompress(x["docs"]), np.int64).tolist() for x in rows]
        streams = [decode(x["lcps"], x["sizes"], expand.decompress(x["tails"])) for x in rows]
        answers: list[list] = [[None] * len(o) for o in owners]
        place = [0] * len(rows)
        # different stretches of the current anchor: string, bytes before, common prefix, smallest id, [(run, place)]
        group: list[list] = []
        waiting: list[list] = []
        numbers: list[int] = []

        def close(group: list[list]) -> None:
            if len(group) == 1:
                for r, i in group[0][4]:
                    answers[r][i] = group[0][3]
                return
            number = numbers[-1] + 1 if numbers else 0
            waiting.extend(group)
            numbers.extend([number] * len(group))
            if len(waiting) >= SETTLE:
                settle()

        def settle() -> None:
            if not waiting:
                return
            strings, before, lcp, least, members = zip(*waiting, strict=True)
            n, found = settled(*(np.array(numbers, np.int64), list(strings)), *(np.array(x, np.int64) for x in (before, np.maximum(0, np.array(lcp) - 8), least)), length)
            at = 0
            for size, places in zip(n.tolist(), members, strict=True):
                part = found[at : at + size]
                at += size
                value = int(part[0]) if (part == part[0]).all() else part.tolist()
                for r, i in places:
                    answers[r][i] = value
            waiting.clear()
            numbers.clear()

        for lcp, s, r in merge(streams):
            i = place[r]
            place[r] = i + 1
            d, before = owners[r][i], rows[r]["before"][i]
            if lcp < 8 and group:
                close(group)
                group = []
            same = None
            if group and lcp == len(s) == len(group[-1][0]) + 8:  # equal to the string above, whatever the place of the anchor
                for x in reversed(group):
                    if x[1] == before:
                        same = x
                    if same or x[2] < len(s) or len(x[0]) + 8 != len(s):
                        break
            if same:
                same[3] = min(same[3], d)
                same[4].append((r, i))
            else:
                group.append([s[8:], before, lcp, d, [(r, i)]])
        if group:
            close(group)
        settle()
        counts, values = [], []
        for a in answers:
            counts.append(bytes(len(x) if isinstance(x, list) else 1 for x in a))
            flat = [y for x in a for y in (x if isinstance(x, list) else (x,))]
            values.append(squeeze.compress(np.array(flat, np.int64).tobytes()))
        return pa.table({"chunk": table.column("chunk"), "range": table.column("range"), "counts": pa.array(counts, pa.binary()), "least": pa.array(values, pa.binary())})

    return run


def covered(row: dict, length: int) -> np.ndarray:
    """Which bytes of the chunk are to go."""
    cover = np.zeros(len(row["data"]) + 1, np.int32)
    if row["answers"]:
        expand = zstandard.ZstdDecompressor()
        parts = sorted(row["answers"], key=lambda x: x["range"])
        counts = np.frombuffer(b"".join(x["counts"] for x in parts), np.uint8).astype(np.int64)
        least = np.concatenate([np.frombuffer(expand.decompress(x["least"]), np.int64) for x in parts])
        first = np.cumsum(counts) - counts
        item, start = _from_planes(expand.decompress(row["item"])), np.cumsum(_from_planes(expand.decompress(row["start"])))
        n = np.frombuffer(expand.decompress(row["n"]), np.uint8).astype(np.int64)
        doc = np.searchsorted(np.cumsum(row["sizes"]), start, "right")
        ids = np.array([NO_ID if i is None else i for i in row["ids"]], np.int64)[doc]
        which = np.repeat(np.arange(len(n)), n)
        step = np.arange(len(which)) - np.repeat(np.cumsum(n) - n, n)
        value = least[first[item][which] + np.where(counts[item][which] == 1, 0, step)]
        gone = value < ids[which]
        at = (start[which] + step)[gone]
        cover += np.bincount(at, minlength=len(cover)).astype(np.int32)
        cover -= np.bincount(at + length, minlength=len(cover)).astype(np.int32)
    return np.cumsum(cover[:-1]) > 0


def whole_characters(buf: np.ndarray, gone: np.ndarray) -> np.ndarray:
    """``gone`` with every byte of a UTF-8 character that loses one."""
    character = np.cumsum((buf & 0xC0) != 0x80) - 1
    cut = np.zeros(int(character[-1]) + 1 if len(buf) else 0, bool)
    cut[character[gone]] = True
    return cut[character]


def _remove(length: int, texts: bool):
    def run(batches):
        for batch in batches:
            kind = batch.schema.field("carry").type.value_type
            for row in batch.to_pylist():
                gone, out, at = covered(row, length), [], 0
                buf = np.frombuffer(row["data"], np.uint8)
                for i, size, c in zip(row["ids"], row["sizes"], row["carry"], strict=True):
                    g = gone[at : at + size]
                    if texts and g.any():
                        g = whole_characters(buf[at : at + size], g)
                    kept = buf[at : at + size][~g].tobytes() if g.any() else row["data"][at : at + size]
                    spans = int(g[:1].sum()) + int((g[1:] & ~g[:-1]).sum())
                    out.append((i, size, int(g.sum()), spans, kept if texts else hashlib.sha256(kept).hexdigest(), c))
                    at += size
                last = pa.binary() if texts else pa.string()
                yield _batch(out, ["doc_id", "n_bytes", "n_removed", "n_spans", "kept", "carry"], [pa.int64()] * 4 + [last, kind])

    return run


def remove_repeats(docs: DataFrame, *, length: int = LENGTH, texts: bool = False, carry: tuple[str, ...] = (), chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256), or with ``texts`` the bytes left as ``kept``.

    Columns named in ``carry`` travel with their row and come back as the struct ``carry``.
    """
    if not GRAM <= length <= 130:
        raise ValueError("length must be 16 to 130")
    spark = docs.sparkSession
    carried = F.struct(*[F.col(c) for c in carry]) if carry else F.struct(F.lit(0).alias("none"))
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), carried.alias("carry"))
    kept_kind = slim.schema["carry"].dataType.simpleString()
    name = f"daybook_chunks_{uuid.uuid4().hex}"
    try:
        total = slim.select(F.sum(F.octet_length("text"))).first()[0] or 0
        growth = min(4.0, max(1.0, (total / (64 << 30)) ** 0.25))
        chunks = slim.mapInArrow(_chunks(int(chunk_bytes * growth)), f"ids array<long>, sizes array<long>, data binary, carry array<{kept_kind}>")
        parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)
        with common.batches_of(spark, 8 << 20):
            chunks.withColumn("chunk", F.monotonically_increasing_id()).write.option("compression", "zstd").bucketBy(parts, "chunk").saveAsTable(name, format="parquet")
        chunks = spark.table(name)
        ranges = max(parts, 1 + int(total / (RANGE_BYTES * growth)))
        with common.batches_of(spark, rows=4):
            anchors = chunks.select("chunk", "ids", "sizes", "data").mapInArrow(
                _send_anchors(length, ranges), "range int, chunk long, anchors binary, several binary, often binary, sketch binary"
            )
            bits = anchors.groupBy("range").applyInArrow(_shared_anchors, "chunk long, range int, bits binary")
            found = bits.groupBy("chunk").agg(F.collect_list(F.struct("range", "bits")).alias("found"))
            runs = chunks.drop("carry").join(found, "chunk", "left").mapInArrow(
                _send_runs(length, ranges), "range int, chunk long, lcps binary, sizes binary, before binary, tails binary, docs binary"
            )
            runs = common.materialise(runs, "runs")
            answers = runs.where("range >= 0").groupBy("range").applyInArrow(_merge_runs(length), "chunk long, range int, counts binary, least binary")
            answers = answers.groupBy("chunk").agg(F.collect_list(F.struct("range", "counts", "least")).alias("answers"))
            places = runs.where("range < 0").select("chunk", F.col("lcps").alias("item"), F.col("sizes").alias("start"), F.col("tails").alias("n"))
            joined = chunks.join(places, "chunk", "left").join(answers, "chunk", "left")
            kind = "binary" if texts else "string"
            out = joined.mapInArrow(_remove(length, texts), f"doc_id long, n_bytes long, n_removed long, n_spans long, kept {kind}, carry {kept_kind}")
            out = common.materialise(out if carry else out.drop("carry"), "kept")
        common.discard(runs)
    finally:
        spark.sql(f"DROP TABLE IF EXISTS {name}")
    return out if texts else out.withColumnRenamed("kept", "kept_sha256")
