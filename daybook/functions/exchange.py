"""Word differences, lossless tokens, short codes of numbers, seeded draws, video ids."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import groupby
from operator import itemgetter

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StringType, StructField, StructType

from .batches import of_pandas
from .text import WORD

# -- tokens -------------------------------------------------------------------------------------------------------


def spans(text: Column) -> Column:
    """Words and what stands between them, in order; joined they are the text again."""
    gaps = F.split(text, WORD)
    found = F.regexp_extract_all(text, F.lit(WORD), F.lit(0))
    piece = lambda kind, t: F.struct(F.lit(kind).alias("kind"), t.alias("text"))
    both = F.zip_with(gaps, found, lambda g, w: F.array(piece("gap", g), piece("word", w)))
    return F.filter(F.flatten(both), lambda p: p["text"].isNotNull() & (p["text"] != ""))


def sentence_list(text: Column) -> Column:
    """Sentences between full stops that a space and a capital follow; abbreviations and initials end none."""
    held = F.regexp_replace(text, r"(?i)\b(dr|mr|mrs|ms|prof|st|vs|etc|e\.g|i\.e|approx|no|fig|\p{L})\.(?=\s)", "$1\u0001")
    ended = F.regexp_replace(held, r"([.!?][\"'”)]*)\s+(?=[\p{Lu}\p{N}\"'“(])", "$1\u0002")
    return F.filter(F.transform(F.split(ended, "\u0002"), lambda s: F.trim(F.replace(s, F.lit("\u0001"), F.lit(".")))), lambda s: s != "")


def credit_line(credits: Column) -> Column:
    """The texts of credits between semicolons; null without any."""
    texts = F.filter(F.transform(credits, lambda c: c["text"]), lambda t: t.isNotNull() & (t != ""))
    return F.when(F.size(texts) > 0, F.array_join(texts, "; "))


def keyword_line(keywords: Column) -> Column:
    return F.array_join(keywords, ", ")


# -- differences --------------------------------------------------------------------------------------------------

DIFF = ArrayType(StructType([StructField("kind", StringType()), StructField("text", StringType())]))

#: Words of one list that are compared at once, as bits of a number; whatever it is, the lengths are the same.
STRIP = 4096


def _common(a: list[int], b: list[int]) -> np.ndarray:
    """The length of the longest common subsequence of ``a`` and each head of ``b``, from none of it to all.

    The bit of a word of ``b`` is 0 where the length grows by it.  A word of ``a`` changes all bits by one sum, whose carry
    goes on to the next strip of ``b``.
    """
    grows, carries = [np.zeros(1, np.int64)], bytearray(len(a))
    for at in range(0, len(b), STRIP):
        strip = b[at : at + STRIP]
        width, places = len(strip), {}
        for j, w in enumerate(strip):
            places[w] = places.get(w, 0) | 1 << j
        bits = full = (1 << width) - 1
        for i, w in enumerate(a):
            met, carry = places.get(w, 0), carries[i]
            if met or carry:
                met &= bits
                total = bits + met + carry
                bits, carries[i] = (total & full) | (bits ^ met), total >> width
        kept = np.frombuffer(bits.to_bytes(-(-width // 8), "little"), np.uint8)
        grows.append(1 - np.unpackbits(kept, bitorder="little")[:width].astype(np.int64))
    return np.cumsum(np.concatenate(grows))


def _middle(a: list[int], b: list[int]) -> tuple[int, int]:
    """A place on a shortest edit path with half of ``a`` before it; both texts differ at both ends."""
    u = (len(a) + 1) // 2
    before, after = _common(a[:u], b), _common(a[u:][::-1], b[::-1])[::-1]
    return u, int(np.argmax(before + after))


#: Cells of a table that is filled instead of cutting once more, a bit each.
CELLS = 1 << 17


def _filled(a: list[str], b: list[str]) -> list[tuple[str, str]]:
    """A shortest script by the table of common lengths, for few words; a row has a bit for each word of ``a``, 0 where the length grows by it."""
    places = dict.fromkeys(b, 0)
    for i, w in enumerate(reversed(a)):
        if w in places:
            places[w] |= 1 << i
    bits = full = (1 << len(a)) - 1
    rows = [bits]
    for w in reversed(b):
        met = bits & places[w]
        bits = (bits + met) & full | (bits ^ met)
        rows.append(bits)
    out, i, j = [], 0, 0
    while i < len(a) or j < len(b):
        if i < len(a) and j < len(b) and a[i] == b[j]:
            out.append(("same", a[i]))
            i, j = i + 1, j + 1
        elif i < len(a) and rows[len(b) - j] >> (len(a) - 1 - i) & 1:
            out.append(("removed", a[i]))
            i += 1
        else:
            out.append(("added", b[j]))
            j += 1
    return out


def shortest_edit(a: list[str], b: list[str]) -> list[tuple[str, str]]:
    """(kind, word) of a shortest script from one list of words to the other, in memory that grows with their length.

    A place on a shortest path cuts both lists, and each half is solved by itself.
    """
    codes: dict[str, int] = {}
    x, y = ([codes.setdefault(w, len(codes)) for w in words] for words in (a, b))
    out: list[tuple[str, str]] = []
    todo = [(0, len(a), 0, len(b), 0)]
    while todo:
        i, j, p, q, same = todo.pop()
        if same:
            out += [("same", w) for w in a[i : i + same]]
            continue
        head = 0
        while i < j and p < q and x[i] == y[p]:
            i, p, head = i + 1, p + 1, head + 1
        tail = 0
        while i < j and p < q and x[j - 1] == y[q - 1]:
            j, q, tail = j - 1, q - 1, tail + 1
        out += [("same", w) for w in a[i - head : i]]
        if tail:
            todo.append((j, j, q, q, tail))
        if i == j or p == q:
            out += [("removed", w) for w in a[i:j]] + [("added", w) for w in b[p:q]]
            continue
        if (j - i) * (q - p) <= CELLS:
            out += _filled(a[i:j], b[p:q])
            continue
        u, v = _middle(x[i:j], y[p:q])
        todo += [(i + u, j, p + v, q, 0), (i, i + u, p, p + v, 0)]
    return out


def word_diff(old: str | None, new: str | None) -> list[dict]:
    """Runs of words that stay, go or come; what both texts begin or end with is never compared."""
    a, b = (old or "").split(), (new or "").split()
    head = 0
    while head < min(len(a), len(b)) and a[head] == b[head]:
        head += 1
    tail = 0
    while tail < min(len(a), len(b)) - head and a[-1 - tail] == b[-1 - tail]:
        tail += 1
    x, y = a[head : len(a) - tail], b[head : len(b) - tail]
    script = [("same", w) for w in a[:head]] + shortest_edit(x, y) + [("same", w) for w in a[len(a) - tail :]]
    return [{"kind": kind, "text": " ".join(w for _, w in run)} for kind, run in groupby(script, itemgetter(0))]


@F.pandas_udf(DIFF)
def diff_words(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    for old, new in batches:
        for at, to in of_pandas((old, new)):
            yield pd.Series([word_diff(a, b) for a, b in zip(old[at:to], new[at:to], strict=True)])


def changed_fields(old: DataFrame, new: DataFrame, fields: tuple[str, ...], key: str = "date_id") -> DataFrame:
    """(key, field, diff): of rows in both tables, the fields that differ, with their runs of words."""
    pairs = F.array(*[F.struct(F.lit(f).alias("field"), F.col(f"o.{f}").alias("old"), F.col(f"n.{f}").alias("new")) for f in fields])
    both = old.alias("o").join(new.alias("n"), F.col(f"o.{key}") == F.col(f"n.{key}")).select(F.col(f"n.{key}").alias(key), F.inline(pairs))
    return both.where(~F.col("old").eqNullSafe(F.col("new"))).select(key, "field", diff_words("old", "new").alias("diff"))


def count_words(diff: Column, kind: str) -> Column:
    """Words of a difference that are of one kind."""
    of_kind = F.filter(diff, lambda r: r["kind"] == kind)
    return F.aggregate(of_kind, F.lit(0), lambda s, r: s + F.size(F.split(r["text"], " ")))


# -- codes --------------------------------------------------------------------------------------------------------

# Fixed values of the code: its letters, the keys of its two uses, and the multiplier that mixes.
LETTERS = "0123456789bcdfghjkmnpqrstvwxyz-_"
KEYS = {"picture": 0x5F2A1C7D, "round": 0x27B9E3A5}
GOLDEN, HALF_BITS, TURNS, CODE_LENGTH = 0x9E3779B1, 14, 4, 6
_WORD = np.uint64(0xFFFFFFFF)


def _turn_keys(use: str) -> list[int]:
    """The key of each of the four turns."""
    return [((KEYS[use] * (turn + 1)) & 0xFFFFFFFF) ^ (turn << 19) for turn in range(TURNS)]


def _mix(half: np.ndarray, key: int) -> np.ndarray:
    x = ((half ^ np.uint64(key)) * np.uint64(GOLDEN)) & _WORD
    return (x ^ (x >> np.uint64(13))) & np.uint64((1 << HALF_BITS) - 1)


def encode_numbers(numbers: np.ndarray, use: str) -> list[str]:
    """Six letters for each number below 2**28: a balanced network of four turns over two halves of 14 bits."""
    x = np.asarray(numbers).astype(np.uint64)
    high, low = (x >> np.uint64(HALF_BITS)) & np.uint64((1 << HALF_BITS) - 1), x & np.uint64((1 << HALF_BITS) - 1)
    for key in _turn_keys(use):
        high, low = low, high ^ _mix(low, key)
    x = high << np.uint64(HALF_BITS) | low
    digits = [(x >> np.uint64(5 * k)) & np.uint64(31) for k in reversed(range(CODE_LENGTH))]
    letters = np.array(list(LETTERS))
    return ["".join(row) for row in np.stack([letters[d.astype(int)] for d in digits], axis=1)] if len(x) else []


def decode_code(code: str | None, use: str) -> int | None:
    """The number of a code; null for anything that is none."""
    if code is None or len(code) != CODE_LENGTH or any(c not in LETTERS for c in code):
        return None
    value = 0
    for c in code:
        value = value * 32 + LETTERS.index(c)
    if value >= 1 << (2 * HALF_BITS):
        return None
    high, low = (np.array([v], np.uint64) for v in divmod(value, 1 << HALF_BITS))
    for key in reversed(_turn_keys(use)):
        high, low = low ^ _mix(high, key), high
    return int(high[0]) << HALF_BITS | int(low[0])


def code_of(number: Column, use: str) -> Column:
    @F.pandas_udf(StringType())
    def run(x: pd.Series) -> pd.Series:
        return pd.Series(encode_numbers(x.to_numpy(), use), index=x.index, dtype=object)

    return run(number)


def number_of(code: Column, use: str) -> Column:
    @F.pandas_udf(LongType())
    def run(x: pd.Series) -> pd.Series:
        return pd.Series([decode_code(c, use) for c in x], index=x.index, dtype="Int64")

    return run(code)


def split_mix(seed: Column, draw: int) -> Column:
    """The n-th number of the published splitmix64 generator, as a long of the same bits; wraps like the original."""

    @F.pandas_udf(LongType())
    def run(x: pd.Series) -> pd.Series:
        z = x.to_numpy(np.int64).view(np.uint64) + np.uint64((0x9E3779B97F4A7C15 * (draw + 1)) & ((1 << 64) - 1))
        z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return pd.Series((z ^ (z >> np.uint64(31))).view(np.int64), index=x.index)

    return run(seed)


def fraction(value: Column) -> Column:
    """The first 53 bits as a number from 0 to 1."""
    return F.shiftrightunsigned(value, 11).cast("double") / float(1 << 53)


# -- media --------------------------------------------------------------------------------------------------------


def video_id(kind: Column, url: Column) -> Column:
    """The provider's id in an address of a video; null where there is none."""
    bare = F.regexp_extract(url, r"^([^?#&]*)", 1)
    tail = lambda mark: F.when(F.contains(bare, F.lit(mark)), F.substring_index(bare, mark, -1))
    tube = F.coalesce(tail("/embed/"), tail("youtu.be/"), tail("/v/"))
    clip = F.regexp_extract(url, r"[?&]clip_id=([^?&]*)", 1)
    vimeo = F.coalesce(tail("/video/"), F.nullif(clip, F.lit("")))
    found = F.when(kind == "youtube", tube).when(kind == "vimeo", vimeo)
    return F.nullif(F.regexp_replace(found, r"^/+|/+$", ""), F.lit(""))


def best_url(url: Column, hd_url: Column) -> Column:
    return F.coalesce(hd_url, url)


def thumb_source(kind: Column, url: Column, hd_url: Column) -> Column:
    """(source, value): the picture itself, a provider's id, or a frame of a film; null where nothing can be shown."""
    told = lambda name, value: F.when(value.isNotNull(), F.struct(F.lit(name).alias("source"), value.alias("value")))
    own = video_id(kind, url)
    return (
        F.when(kind.startswith("image"), told("direct", F.coalesce(url, hd_url)))
        .when(kind == "youtube", told("youtube", own))
        .when(kind == "vimeo", told("vimeo", own))
        .when(kind == "video_mp4", told("frame", url))
    )
