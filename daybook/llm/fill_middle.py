"""Fill-in-the-middle: documents cut at two units and put together again with the middle last.

Run-length class encoding.  A text is stored as its maximal runs of one character class (white space or not), each with
its end and the number of units that end up to there.  A cut after ``c`` units is found by binary search for the run
that holds the ``c``-th unit, and its place in the run follows from the counts: a run of words is one unit, which ends
where the run ends; in a run of single characters (``EACH``) unit ``k`` of the run ends ``k`` characters into it.
All texts of an Arrow batch share one table of runs, so a batch takes a handful of array operations whatever it holds.

Defined cases: a null text counts as empty; an empty text and a text that holds a marker stay plain; a null id draws
with the empty id; rows that repeat draw alike; rows keep all their columns, whatever these are called.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common

#: What stands before the prefix, the suffix and the middle.
MARKS = ("<P>", "<S>", "<M>")
COLUMNS = ("n", "form", "prefix_chars", "middle_chars", "output")
#: Share of documents that are cut, and share of those that put the suffix first, in percent.
CUT, SPM = 50, 80
SEED = 42

SPACE, WORD, EACH = 0, 1, 2
_CLASS = np.full(256, WORD, np.uint8)
_CLASS[[0x20, *range(0x09, 0x0E)]] = SPACE


@dataclass
class Runs:
    """The runs of several texts laid end to end: where each ends, and the units that end up to there."""

    first: np.ndarray  # text -> its first run, and one entry more
    kind: np.ndarray
    end: np.ndarray  # in bytes of the whole buffer
    units: np.ndarray  # cumulative over all texts

    @classmethod
    def of(cls, data: np.ndarray, offsets: np.ndarray, classes: np.ndarray = _CLASS) -> Runs:
        """Runs of the UTF-8 bytes ``data``, text ``i`` from ``offsets[i]`` to ``offsets[i + 1]``.

        White space is ASCII and every byte of another character counts as a word's, so bytes have the runs of characters.
        A unit is a word with the white space before it, a character of class ``EACH`` likewise, or white space at the end.
        """
        kinds = classes[data]
        breaks = np.flatnonzero(kinds[1:] != kinds[:-1]) + 1
        inner = offsets[(offsets > 0) & (offsets < len(data))]
        end = np.union1d(breaks, inner)
        end = np.append(end, len(data)) if len(data) else end[:0]
        kind = kinds[end - 1]
        start = np.append(0, end[:-1]) if len(end) else end
        own = np.where(kind == EACH, end - start, (kind == WORD).astype(np.int64))
        own[np.isin(end, offsets) & (kind == SPACE)] = 1
        return cls(np.searchsorted(start, offsets), kind, end, np.cumsum(own))

    def before(self, text: np.ndarray) -> np.ndarray:
        """Units of all texts before each of these."""
        return np.append(0, self.units)[self.first[text]]

    def counts(self) -> np.ndarray:
        """Units of each text."""
        return np.diff(np.append(0, self.units)[self.first])

    def places(self, text: np.ndarray, cuts: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """The byte after the first ``cuts`` units of each text."""
        wanted = self.before(text) + cuts
        run = np.searchsorted(self.units, wanted)  # the first run up to which so many units end
        run = np.minimum(run, max(len(self.end) - 1, 0))
        ahead = self.units[run] - wanted if len(self.end) else wanted
        inside = np.where(self.kind[run] == EACH, ahead, 0) if len(self.end) else ahead
        return np.where(cuts == 0, offsets[text], self.end[run] - inside if len(self.end) else 0)


def _buffers(texts) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a column of texts without copying them, and the offsets of each text in them."""
    raw = pc.fill_null(texts.cast(pa.large_binary()), b"")
    offsets = np.frombuffer(raw.buffers()[1], np.int64)[raw.offset : raw.offset + len(raw) + 1]
    data = np.frombuffer(raw.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
    return data, offsets - offsets[0]


def _characters(data: np.ndarray) -> int:
    return int(np.count_nonzero((data & 0xC0) != 0x80))


def _assembled(names: list[str], out: tuple, text: str, cut: str, draws: str, spm: int, marks: tuple):
    p, s, m = (x.encode() for x in marks)

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            data, offsets = _buffers(batch.column(text))
            runs = Runs.of(data, offsets)
            n, rows = runs.counts(), np.arange(batch.num_rows)
            h = batch.column(draws).flatten().to_numpy().reshape(-1, 3)
            one, two = h[:, 0] % (n + 1), h[:, 1] % (n + 1)
            begins, ends = (runs.places(rows, f(one, two), offsets) for f in (np.minimum, np.maximum))
            whole, made = memoryview(data), []
            for i, wanted in enumerate(batch.column(cut).to_pylist()):
                start, a, b, end = offsets[i], begins[i], ends[i], offsets[i + 1]
                if not wanted:
                    made.append(("plain", None, None, whole[start:end].tobytes()))
                    continue
                head, middle, tail = whole[start:a], whole[a:b], whole[b:end]
                first = h[i, 2] % 100 < spm
                parts = (s, tail, p, head, m, middle) if first else (p, head, s, tail, m, middle)
                made.append(("spm" if first else "psm", _characters(data[start:a]), _characters(data[a:b]), b"".join(parts)))
            forms, heads, middles, outputs = zip(*made, strict=True)
            own = [pa.array(n, pa.int64()), pa.array(forms), pa.array(heads, pa.int64()), pa.array(middles, pa.int64()), pa.array(outputs, pa.binary()).cast(pa.string())]
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in names] + own, names + list(out))

    return run


def transformed(docs: DataFrame, *, key: str = "doc_id", text: str = "text", seed: int = SEED, cut: int = CUT, spm: int = SPM, marks: tuple = MARKS, out: tuple = COLUMNS) -> DataFrame:
    """``docs`` with the units, the form, the lengths of prefix and middle, and the text in its new order.

    Draws come from a hash of seed and id, so they don't depend on how rows are dealt.  One pass, nothing is shuffled;
    columns of ``docs`` named as in ``out`` give way to the new ones.
    """
    names = [c for c in docs.columns if c not in out]
    own_cut, own_draws = (f"_{x}_{uuid.uuid4().hex[:8]}" for x in ("cut", "draws"))
    body = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(f"`{key}`").cast("string"), F.lit(""))).cast("binary"), 256)
    h = [F.conv(F.substring(digest, 1 + 8 * i, 8), 16, 10).cast("long") for i in range(4)]
    held = [F.contains(body, F.lit(m)) for m in marks]
    wanted = (body != "") & (h[2] % 100 < cut) & ~held[0] & ~held[1] & ~held[2]
    rows = docs.select(*[F.col(f"`{c}`") for c in names], wanted.alias(own_cut), F.array(h[0], h[1], h[3]).alias(own_draws))
    schema = T.StructType([docs.schema[c] for c in names])
    for name, kind in zip(out, ("long", "string", "long", "long", "string"), strict=True):
        schema = schema.add(name, kind)
    return rows.mapInArrow(_assembled(names, out, text, own_cut, own_draws, spm, marks), schema)


def restored(output: Column, form: Column, marks: tuple = MARKS) -> Column:
    """The text as it was, from a document in its new order; no marker can begin inside a part and end in a marker."""
    p, s, m = marks

    def parts(first: str, second: str) -> tuple[Column, Column, Column]:
        rest = F.substr(output, F.lit(len(first) + 1))
        a = F.substring_index(rest, second, 1)
        rest = F.substr(rest, F.char_length(a) + len(second) + 1)
        b = F.substring_index(rest, m, 1)
        return a, b, F.substr(rest, F.char_length(b) + len(m) + 1)

    (tail, head, middle), (head2, tail2, middle2) = parts(s, p), parts(p, s)
    return F.when(form == "spm", F.concat(head, middle, tail)).when(form == "psm", F.concat(head2, middle2, tail2)).otherwise(output)


def digests(docs: DataFrame) -> DataFrame:
    """(doc_id, n, form, prefix_chars, middle_chars, output_sha256, restored_sha256) of every document.

    Runs take several times the bytes of their texts, so batches are kept small; a longer text is a batch of its own.
    """
    made = transformed(docs.select("doc_id", "text")).drop("text")
    sha = lambda c: F.sha2(c.cast("binary"), 256)
    back = restored(F.col("output"), F.col("form"))
    told = made.select("doc_id", "n", "form", "prefix_chars", "middle_chars", sha(F.col("output")).alias("output_sha256"), sha(back).alias("restored_sha256"))
    with common.batches_of(docs.sparkSession, 4 << 20, rows=500):
        return common.materialise(told, "fill-middle")
