"""Words, text statistics and address keys as column expressions."""

from __future__ import annotations

import re
import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

#: A word: letters and numbers; apostrophes and hyphens join inside it, points and commas join numbers only.
WORD = r"(?:\p{N}+(?:[,.]\p{N}+)*|\p{L}+)(?:['’-]?(?:\p{N}+(?:[,.]\p{N}+)*|\p{L}+))*"
#: A token of the search index.
TOKEN = r"[\p{L}\p{N}\p{M}]+"
EPOCH = "1995-06-16"


def words(text: Column) -> Column:
    """Normalised words of a text, in order: lower case, straight apostrophes, at least one letter."""
    found = F.regexp_extract_all(text, F.lit(WORD), F.lit(0))
    return F.transform(F.filter(found, lambda w: w.rlike(r"\p{L}")), lambda w: F.lower(F.replace(w, F.lit("’"), F.lit("'"))))


#: Abbreviations whose point ends no sentence.
ABBREVIATIONS = ("dr", "mr", "mrs", "ms", "st", "prof", "vs", "etc", "no", "fig", "figs", "univ", "inc", "jr", "sr", "mt", "approx", "ca", "est", "al")
#: What stands before a point (and closing marks) that the end of the text, or space and no small letter, follows.
_END = r"(?U)(\S*?)[.!?][.!?\"')\]”]*(?=\s+[^\s\p{Ll}]|\z)"


def sentences(text: Column) -> Column:
    """Number of sentences: single letters and abbreviations end none, a text with a letter or number has one at least."""
    before = F.regexp_extract_all(text, F.lit(_END), F.lit(1))
    plain = lambda w: F.lower(F.regexp_replace(w, r"[^\p{L}\p{N}]", ""))
    ends = F.size(F.filter(before, lambda w: (F.char_length(w) != 1) & ~plain(w).isin(*ABBREVIATIONS))).cast("long")
    return F.when(text.isNull(), F.lit(0).cast("long")).when(ends > 0, ends).otherwise(text.rlike(r"[\p{L}\p{N}]").cast("long"))


def _bases() -> dict[str, str]:
    """Letters that decompose into one letter and marks, and that letter."""
    out = {}
    for c in map(chr, range(0xC0, 0x30000)):
        if unicodedata.decomposition(c)[:1] not in ("", "<"):
            rest = [x for x in unicodedata.normalize("NFD", c) if unicodedata.category(x)[0] != "M"]
            if len(rest) == 1:
                out[c] = rest[0]
    return out


#: The decomposition table of Unicode.
BASES = _bases()
#: The same for ``str.translate``; the text keeps its length.
UNMARKED = str.maketrans(BASES)


def fold(text: Column) -> Column:
    """Without diacritics: letters for their marked forms, and no marks."""
    return F.regexp_replace(F.translate(text, "".join(BASES), "".join(BASES.values())), r"\p{M}+", "")


def folded(text: str) -> str:
    """``fold`` for a Python string."""
    return "".join(c for c in text.translate(UNMARKED) if unicodedata.category(c)[0] != "M")


#: The index token for Python's own patterns: word characters but the underscore; folded texts hold no marks.
PLAIN_TOKEN = re.compile(r"[^\W_]+")


def index_tokens(text: str) -> list[str]:
    """``tokens`` for a Python string."""
    return [t.lower() for t in PLAIN_TOKEN.findall(text if text.isascii() else folded(text))]


def tokens(text: Column) -> Column:
    """Index tokens of a text, in order, without diacritics."""
    return F.transform(F.regexp_extract_all(fold(text), F.lit(TOKEN), F.lit(0)), lambda t: F.lower(t))


def collapse(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def summary(text: Column, n: int) -> Column:
    """At most ``n`` characters, cut at white space, with an ellipsis where something is cut."""
    head = F.regexp_replace(F.substring(text, 1, n + 1), r"\s+\S*$", "")
    return F.when(F.char_length(text) <= n, text).otherwise(F.concat(F.regexp_replace(head, r"[,.;:\s]+$", ""), F.lit("…")))


def escape_html(text: Column) -> Column:
    for raw, safe in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;")):
        text = F.replace(text, F.lit(raw), F.lit(safe))
    return text


def host(url: Column) -> Column:
    """Lower-case host without ``www.`` and closing dot."""
    return F.regexp_replace(F.lower(F.regexp_extract(url, r"^https?://([^/?#:]+)", 1)), r"^www\.|\.$", "")


def link_key(url: Column) -> Column:
    """Authority, path and query; scheme and fragment don't count, nor does a closing slash."""
    bare = F.regexp_replace(F.regexp_replace(url, r"^https?://", ""), r"#.*$", "")
    authority, rest = F.lower(F.regexp_extract(bare, r"^([^/?]*)", 1)), F.regexp_extract(bare, r"^[^/?]*(.*)$", 1)
    path, query = F.regexp_extract(rest, r"^([^?]*)", 1), F.regexp_extract(rest, r"(\?.*)$", 1)
    path = F.regexp_replace(path, r"/+$", "")
    return F.concat(authority, F.when(path == "", F.lit("/")).otherwise(path), query)


def date_of(date_id: Column) -> Column:
    return F.date_add(F.to_date(F.lit(EPOCH)), date_id.cast("int"))


def date_id_of(date: Column) -> Column:
    return F.datediff(date, F.to_date(F.lit(EPOCH)))


def ratio(above: Column, below: Column) -> Column:
    """0 where the denominator is."""
    return F.when(below == 0, F.lit(0.0)).otherwise(above / below)
