"""Archived pages as entries: bytes to text, markup to flat text with ranges, ranges to title, explanation, credits, media.

One Arrow function walks the markup of a page and returns its flat text, the ranges of its elements and its inline
tags.  Everything that is decided about a page (which container, which marker, where to stop) is column expressions
over those ranges.  A null page has null text; a page without a title or an explanation has null there.
"""

from __future__ import annotations

import codecs
import html as entities
import re
from collections.abc import Iterator
from html.parser import HTMLParser
from itertools import takewhile
from urllib.parse import urljoin

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from ..functions.batches import of_pandas
from ..functions.text import escape_html

# Kinds of tags, labels, phrases at which a text stops, and limits.
INLINE = ("a", "b", "i", "em", "strong", "sup", "sub")
SKIPPED = ("script", "style", "noscript", "iframe", "head")
BLOCKS = ("p", "div", "td", "tr", "table", "center", "li", "ul", "ol", "h1", "h2", "h3", "h4", "h5", "h6", "blockquote", "hr")
CONTAINERS = ("p", "td", "div", "center", "body")
EMPTY = ("area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr")
HEAD_ONLY = ("head", "title", "meta", "link", "base", "script", "style", "noscript")
ROLES = (
    "acknowledgement", "acknowledgment", "additional", "animation", "audio", "capture", "composition", "compositing", "copyright", "courtesy",
    "credit", "credits", "data", "design", "digital", "editing", "illustration", "image", "images", "licence", "license", "montage", "mosaic",
    "music", "narration", "photo", "photograph", "photography", "processing", "production", "science", "simulation", "sonification", "sound",
    "text", "translation", "video", "visualisation", "visualization", "writing",
)
LICENCES = ("creativecommons.org", "opensource.org")
CREDIT_WORDS = ("credit", "credits", "copyright", "courtesy")
BOILERPLATE = ("astronomy picture of the day", "astronomy picture of the day archive", "discover the cosmos!")
TEXT_STOPS = ("tomorrow's picture", "tomorrow’s picture", "authors & editors", "author:", "authors:", "we keep an archive file", "nasa official:", "a service of:", "< archive")
CREDIT_STOPS = ("explanation:", "tomorrow's picture", "tomorrow’s picture", "authors & editors", "nasa official:", "a service of:")
TEASER_STOPS = ("authors & editors", "author:", "nasa official:", "a service of:", "we keep an archive file", "<")
SNIFFED, LONGEST_TITLE, LONGEST_UNLABELLED, LONGEST_TEASER = 4096, 300, 300, 120



def _declared(head: bytes) -> str | None:
    """The name after the first ``charset`` with an equals sign and a name behind it."""
    rest, place = head.decode("latin-1").lower(), 0
    while (place := rest.find("charset", place)) >= 0:
        place += len("charset")
        value = rest[place:].lstrip()
        if value.startswith("="):
            value = value[1:].lstrip(" \t\r\n\"'")
            name = "".join(takewhile(lambda c: c.isascii() and (c.isalnum() or c in "-_:"), value))
            if name:
                return name
    return None


#: Labels that the web reads as windows-1252.
_WESTERN = ("ascii", "us-ascii", "iso-8859-1", "iso8859-1", "latin1", "l1", "cp1252", "windows-1252", "x-cp1252")
codecs.register_error("c1", lambda e: (chr(e.object[e.start]), e.start + 1))


def decoded(data: bytes) -> str:
    """A byte order mark decides, else a declared charset, else UTF-8 where valid, else windows-1252; never fails."""
    for mark, name in ((codecs.BOM_UTF8, "utf-8"), (codecs.BOM_UTF16_LE, "utf-16-le"), (codecs.BOM_UTF16_BE, "utf-16-be")):
        if data.startswith(mark):
            return data[len(mark) :].decode(name, "replace")
    name = _declared(data[:SNIFFED])
    if name and name not in _WESTERN:
        try:
            return data.decode(name, "replace")
        except (LookupError, ValueError):
            name = None
    if name is None:
        try:
            return data.decode("utf-8")
        except UnicodeDecodeError:
            pass
    return data.decode("cp1252", "c1")


def decode_html(content: Column) -> Column:
    @F.pandas_udf(StringType())
    def run(pages: pd.Series) -> pd.Series:
        return pages.map(lambda x: None if x is None else decoded(bytes(x)))

    return run(content)


def absolute(base: str, href: str | None) -> str | None:
    """The address that a link names, or None for fragments and for schemes other than http, https and mailto."""
    href = (href or "").strip()
    if not href or href.startswith("#"):
        return None
    try:
        whole = urljoin(base, href)
    except ValueError:
        return None
    return whole if whole.lower().startswith(("http:", "https:", "mailto:")) else None


class _Walk(HTMLParser):
    """Flat text of a page, and what lies where in it, in code points."""

    def __init__(self, base: str):
        super().__init__(convert_charrefs=True)
        self.base, self.at, self.text, self.open, self.title = base, 0, [], [], None
        self.tokens, self.ranges, self.media, self.hrefs, self.keywords, self.tweet = [], [], [], [], [], None

    def put(self, raw: str) -> None:
        words = re.sub(r"\s+", " ", raw)
        if words.startswith(" ") and (not self.text or self.text[-1].endswith(" ")):
            words = words[1:]
        if words:
            self.tokens.append(["text", self.at, self.at + len(words), words])
            self.text.append(words)
            self.at += len(words)

    def within(self, *tags: str) -> bool:
        return any(x[0] in tags for x in self.open)

    def handle_data(self, data: str) -> None:
        if self.open and self.open[-1][0] == "title":
            self.title = (self.title or "") + data
        elif not self.within(*SKIPPED):
            self.put(data)

    def handle_starttag(self, tag: str, attrs) -> None:
        a = dict(reversed(attrs))
        if tag not in HEAD_ONLY and self.within("head"):
            self.handle_endtag("head")
        if tag == "meta" and (a.get("name") or "").lower() == "keywords":
            self.keywords.append(a.get("content") or "")
        self.see_media(tag, a)
        if tag in BLOCKS:
            self.leave_paragraph(tag)
            self.put(" ")
        if tag == "br":
            self.tokens.append(["break", self.at, self.at, "<br>"])
            self.put(" ")
        if tag in EMPTY:
            return
        token = None
        if tag in INLINE and not self.within(*SKIPPED):
            href = absolute(self.base, a.get("href")) if tag == "a" else None
            if tag != "a" or href:
                token = ["open", self.at, self.at, f'<a href="{entities.escape(href)}">' if href else f"<{tag}>"]
                self.tokens.append(token)
            if href:
                self.hrefs.append(href)
                if self.tweet is None and "/status/" in href and any(x[0] == "blockquote" and "twitter-tweet" in x[3].split() for x in self.open):
                    self.tweet = href.split("?")[0]
        self.open.append((tag, self.at, token, a.get("class") or "" if tag == "blockquote" else a.get("href")))

    def see_media(self, tag: str, a: dict) -> None:
        """An object counts unless an embed is inside; a video may name its address in its first source."""
        src = absolute(self.base, a.get("src"))
        if tag == "source" and self.within("video") and self.media and self.media[-1]["src"] is None:
            self.media[-1]["src"] = src
        if tag == "param" and (a.get("name") or "").lower() in ("movie", "filename") and self.media and self.media[-1]["tag"] == "object":
            self.media[-1]["src"] = self.media[-1]["src"] or absolute(self.base, a.get("value"))
        if tag == "embed" and self.within("object") and self.media and self.media[-1]["tag"] == "object":
            self.media.pop()
        if tag in ("img", "iframe", "video", "embed", "object"):
            link = next((x[3] for x in reversed(self.open) if x[0] == "a" and x[3]), None)
            self.media.append({"tag": tag, "src": src, "link": absolute(self.base, link)})

    def leave_paragraph(self, tag: str) -> None:
        """A block ends an open paragraph; a cell ends the cell before it."""
        for i in range(len(self.open) - 1, -1, -1):
            inner = self.open[i][0]
            if inner == "p" or (inner == tag and tag in ("td", "tr", "li")):
                return self.close_from(i)
            if inner in ("td", "table", "body"):
                return None
        return None

    def handle_endtag(self, tag: str) -> None:
        for i in range(len(self.open) - 1, -1, -1):
            if self.open[i][0] == tag:
                self.close_from(i)
                break
        if tag in BLOCKS:
            self.put(" ")

    def close_from(self, i: int) -> None:
        while len(self.open) > i:
            tag, start, token, _ = self.open.pop()
            if token:
                token[2] = self.at
                self.tokens.append(["close", start, self.at, f"</{tag}>"])
            if tag in CONTAINERS or tag == "b":
                self.ranges.append({"tag": tag, "at": start, "to": self.at})

    def page(self, markup: str) -> dict:
        self.feed(markup)
        self.close()
        self.close_from(0)
        if not any(r["tag"] == "body" for r in self.ranges):  # a parser for the web adds the body itself
            self.ranges.append({"tag": "body", "at": 0, "to": self.at})
        tokens = [dict(zip(("kind", "at", "to", "text"), t, strict=True)) for t in self.tokens]
        ranges = sorted(self.ranges, key=lambda r: (r["at"], -r["to"]))
        return {"text": "".join(self.text), "page_title": self.title, "tokens": tokens, "ranges": ranges, "media": self.media, "hrefs": self.hrefs, "keywords": self.keywords, "tweet": self.tweet}


FLAT = """text string, page_title string, tokens array<struct<kind:string, at:int, to:int, text:string>>, ranges array<struct<tag:string, at:int, to:int>>,
    media array<struct<tag:string, src:string, link:string>>, hrefs array<string>, keywords array<string>, tweet string"""


def flatten(markup: Column, url: Column) -> Column:
    names = ["text", "page_title", "tokens", "ranges", "media", "hrefs", "keywords", "tweet"]

    @F.pandas_udf(FLAT)
    def run(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for markups, urls in batches:
            for at, to in of_pandas((markups,)):
                pages = [{} if m is None else _Walk(u or "").page(m) for m, u in zip(markups[at:to], urls[at:to], strict=True)]
                yield pd.DataFrame([[p.get(n) for n in names] for p in pages], columns=names)

    return run(markup, url)


# -- decisions, as column expressions over the flat page -------------------------------------------------------------


def _one_of(words) -> str:
    return "|".join(re.sub(r"([.!?()<&])", r"\\\1", w) for w in words)


_ROLE = rf"\b(?:{_one_of(ROLES)})(?:[\s&/,-]+(?:and\s+)?(?:{_one_of(ROLES)})\b){{0,4}}"
LABEL = rf"(?i){_ROLE}(?:\s*\([^)]*\))?(?:\s*:\s*|\s+[-–—]\s+)"
_ALL_ROLES = rf"(?i)^[^\p{{L}}\p{{N}}]*(?:(?:{_one_of(ROLES)}|and)(?:[^\p{{L}}\p{{N}}]+|$))+$"
_CREDIT_LABEL = rf"(?i)\b(?:{_one_of(CREDIT_WORDS)})\b"
_FROM, _PAST = "\u0001", "\u0002"


def collapsed(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def part(text: Column, at: Column, to: Column) -> Column:
    return F.substring(text, at + 1, F.greatest(to - at, F.lit(0)))


def sliced(tokens: Column, at: Column, to: Column) -> Column:
    """Well-formed markup of a range of the flat text: inline tags that reach into it, cut to it."""

    def kept(t: Column) -> Column:
        return (t["at"] < to) & F.when(t["kind"] == "break", t["at"] >= at).otherwise((t["to"] > at) & (t["at"] < t["to"]))

    def shown(t: Column) -> Column:
        cut = part(t["text"], F.greatest(at - t["at"], F.lit(0)), F.least(to, t["to"]) - t["at"])
        return F.when(t["kind"] == "text", escape_html(cut)).otherwise(t["text"])

    return F.trim(F.array_join(F.transform(F.filter(tokens, kept), shown), ""))


def written_title(markup: Column) -> Column:
    """The first title as it stands in the markup, with ``&amp;`` read and no other reference; null where it is empty."""
    raw = F.replace(F.regexp_extract(markup, "<title>([^<]*)</title>", 1), F.lit("&amp;"), F.lit("&"))
    return F.nullif(F.regexp_replace(F.regexp_replace(raw, r"[\t\n\f\r ]+", " "), r"^\p{Z}+|\p{Z}+\z", ""), F.lit(""))


def _upto(text: Column, stops) -> Column:
    """Length of a text up to the first of the phrases."""
    return F.char_length(F.regexp_extract(text, rf"(?is)^(.*?)(?:{_one_of(stops)}|\z)", 1))


def _holding(text: Column, ranges: Column, holds) -> Column:
    """Containers whose text passes, smallest first."""
    found = F.filter(ranges, lambda r: r["tag"].isin(*CONTAINERS) & holds(part(text, r["at"], r["to"])))
    return F.array_sort(F.transform(found, lambda r: F.struct((r["to"] - r["at"]).alias("size"), r["at"].alias("at"), r["to"].alias("to"))))


def _title(text: Column, ranges: Column, page_title: Column) -> Column:
    """Bold text of the preferred centred block, else of any, else the end of the page's title."""
    clean = lambda t: collapsed(F.regexp_replace(t, r"(?is)\s*\bcredits?\b.*$", ""))
    centres = F.filter(ranges, lambda r: r["tag"] == "center")
    first = F.when(F.size(centres) == 2, 1).otherwise(2)
    ordered = F.concat(F.slice(centres, first, 1), centres)
    bold = F.flatten(F.transform(ordered, lambda c: F.filter(ranges, lambda r: (r["tag"] == "b") & (r["at"] >= c["at"]) & (r["to"] <= c["to"]))))
    named = F.concat(F.transform(bold, lambda r: part(text, r["at"], r["to"])), F.array(F.substring_index(collapsed(page_title), " - ", -1)))

    def plausible(t: Column) -> Column:
        role = t.rlike(_ALL_ROLES)
        return (t != "") & (F.char_length(t) < LONGEST_TITLE) & ~F.lower(t).isin(*BOILERPLATE) & ~t.rlike(r"(?i)^tomorrow['’]s\s+picture\b") & ~role

    return F.get(F.filter(F.transform(named, clean), plausible), F.lit(0))


def _explanation(text: Column, ranges: Column) -> Column:
    """(at, to): from the marker to the first stop in the smallest container where something follows it."""

    def window(r: Column) -> Column:
        whole = part(text, r["at"], r["to"])
        at = F.char_length(F.regexp_extract(whole, r"(?is)^.*?\bexplanation\s*:\s*", 0))
        return F.struct((r["at"] + at).alias("at"), (r["at"] + at + _upto(F.substr(whole, at + 1), TEXT_STOPS)).alias("to"))

    windows = F.transform(_holding(text, ranges, lambda t: t.rlike(r"(?i)\bexplanation\s*:")), window)
    return F.get(F.filter(windows, lambda w: F.trim(part(text, w["at"], w["to"])) != ""), F.lit(0))


def _pieces(text: Column) -> Column:
    """The text cut before every label, the label's end marked; the first piece has no label."""
    return F.split(F.regexp_replace(text, LABEL, f"{_FROM}$0{_PAST}"), _FROM)


def _find_credits(found: DataFrame, text: Column, ranges: Column) -> DataFrame:
    """Adds ``__c``, an array of (role, at, to, label_at, label_to): labelled segments, else the short text after the title."""
    is_credit = lambda role: role.rlike(_CREDIT_LABEL)
    some_credit = lambda t: F.exists(F.regexp_extract_all(t, F.lit(LABEL), F.lit(0)), is_credit)
    title, n, d, w, pieces = F.col("title"), F.col("__n"), F.col("__d"), F.col("__w"), F.col("__pieces")
    found = found.withColumns({"__n": F.get(_holding(text, ranges, some_credit), F.lit(0)), "__d": F.get(_holding(text, ranges, lambda t: F.contains(t, title)), F.lit(0))})
    begin = F.when(n.isNotNull(), n["at"]).otherwise(d["at"] + F.position(title, part(text, d["at"], d["to"])) - 1 + F.char_length(title))
    found = found.withColumn("__w", F.struct(begin.alias("at"), F.coalesce(n["to"], d["to"]).alias("to")))
    found = found.withColumn("__pieces", _pieces(part(text, w["at"], w["to"])))

    def segment(piece: Column, i: Column) -> Column:
        marked = F.char_length(F.replace(F.array_join(F.slice(pieces, F.lit(1), i), ""), F.lit(_PAST), F.lit("")))
        label = F.when(F.contains(piece, F.lit(_PAST)), F.substring_index(piece, _PAST, 1)).otherwise("")
        role = F.regexp_replace(F.regexp_replace(F.trim(label), r"\s*[:–—-]+$", ""), r"\s*\([^)]*\)$", "")
        long = F.char_length(F.replace(piece, F.lit(_PAST), F.lit("")))
        return F.struct(F.trim(role).alias("role"), (w["at"] + marked).alias("start"), F.char_length(label).alias("label"), long.alias("long"))

    segments, since, stop = F.col("__segments"), F.col("__since"), F.col("__stop")
    found = found.withColumn("__segments", F.transform(pieces, segment))
    first = F.get(F.filter(segments, lambda x: is_credit(x["role"])), F.lit(0))
    found = found.withColumn("__since", F.when(n.isNotNull(), first["start"] + first["label"]).otherwise(w["at"]))
    found = found.withColumn("__stop", since + _upto(part(text, since, w["to"]), CREDIT_STOPS))

    def wanted(x: Column) -> Column:
        labelled = (x["start"] + x["label"] >= since) & (x["role"] != "")
        return F.when(n.isNotNull(), labelled).otherwise(stop - since <= LONGEST_UNLABELLED) & (x["start"] < stop)

    def cut(x: Column) -> Column:
        at, to = x["start"] + x["label"], F.least(x["start"] + x["long"], stop)
        raw = part(text, at, to)
        bare = F.when(x["role"] == "", F.regexp_extract(raw, rf"(?i)^\s*{_ROLE}\s+", 0)).otherwise("")
        lead = F.char_length(bare) + F.char_length(F.regexp_extract(F.substr(raw, F.char_length(bare) + 1), r"^[\s;,]*", 0))
        tail = F.char_length(F.regexp_extract(raw, r"[\s;,]*$", 0))
        role = F.when(x["role"] != "", x["role"]).when(bare != "", F.trim(bare)).otherwise("Credit")
        return F.struct(role.alias("role"), (at + lead).alias("at"), (to - tail).alias("to"), x["start"].alias("label_at"), at.alias("label_to"))

    kept = F.filter(F.transform(F.filter(segments, wanted), cut), lambda x: x["to"] > x["at"])
    none = F.array().cast("array<struct<role:string,at:int,to:int,label_at:int,label_to:int>>")
    return found.withColumn("__c", F.coalesce(kept, none)).drop("__n", "__d", "__w", "__pieces", "__segments", "__since", "__stop")


def media_kind(url: Column, embed: Column) -> Column:
    """Kind by the extension of the path, then by the host; others are embedded or unknown."""
    ext = F.lower(F.regexp_extract(F.regexp_extract(url, r"^([^?#]*)", 1), r"\.([^.]*)$", 1))
    hosts = F.when(F.lower(url).rlike(r"youtube\.com/|youtu\.be/"), "youtube").when(F.lower(url).contains("vimeo.com/"), "vimeo")
    files = F.when(ext.isin("jpg", "jpeg"), "jpg").when(ext.isin("png", "gif"), ext).when(ext.isin("mp4", "m4v"), "mp4")
    return F.coalesce(files, hosts, F.when(embed, "embed").otherwise("other"))


def _media(media: Column, hrefs: Column, tweet: Column) -> Column:
    """array of (kind, url, hd), the main one first; hd is the picture that an enclosing link names."""
    picture = lambda u: media_kind(u, F.lit(False)).isin("jpg", "png", "gif") & F.contains(u, F.lit("/image/"))
    fallback = F.get(F.filter(hrefs, picture), F.lit(0))

    def item(m: Column, i: Column) -> Column:
        hd = F.coalesce(F.when(picture(m["link"]), m["link"]), F.when(i == 0, fallback))
        kind = media_kind(m["src"], m["tag"].isin("iframe", "embed", "object"))
        return F.struct(kind.alias("kind"), m["src"].alias("url"), F.when((m["tag"] == "img") & (hd != m["src"]), hd).alias("hd"))

    found = F.filter(F.transform(media, item), lambda m: m["url"].startswith("http"))
    return F.when((F.size(found) == 0) & tweet.isNotNull(), F.array(F.struct(F.lit("embed").alias("kind"), tweet.alias("url"), F.lit(None).cast("string").alias("hd")))).otherwise(found)


def _find_teaser(found: DataFrame, text: Column, ranges: Column) -> DataFrame:
    t, rest, teaser = F.col("__t"), F.col("__rest"), F.col("teaser")
    found = found.withColumn("__t", F.get(_holding(text, ranges, lambda x: x.rlike(r"(?i)\btomorrow['’]s\s+picture\s*:")), F.lit(0)))
    found = found.withColumn("__rest", F.regexp_extract(part(text, t["at"], t["to"]), r"(?is)\btomorrow['’]s\s+picture\s*:\s*(.*)", 1))
    found = found.withColumn("teaser", collapsed(F.substring(rest, F.lit(1), _upto(rest, TEASER_STOPS))))
    return found.withColumn("teaser", F.when((teaser != "") & (F.char_length(teaser) <= LONGEST_TEASER), teaser)).drop("__t", "__rest")


def _find_keywords(found: DataFrame, contents: Column) -> DataFrame:
    words = F.col("keywords")
    found = found.withColumn("keywords", F.filter(F.transform(F.split(F.array_join(contents, ","), ","), collapsed), lambda w: w != ""))
    return found.withColumn("keywords", F.filter(words, lambda w, i: ~F.exists(F.slice(words, F.lit(1), i), lambda x: F.lower(x) == F.lower(w))))


def parse_pages(pages: DataFrame, markup: str = "html", url: str = "url") -> DataFrame:
    """Adds title, title_raw, explanation_text, explanation_html, credits, has_copyright, license_url, attributed, teaser, keywords and media.

    ``credits`` is an array of (role, text, html), ``media`` of (kind, url, hd).  Other columns pass through.
    Each step keeps what it found as a column, so nothing is evaluated twice; hold on to rows whose title or
    explanation is null to count what could not be read.
    """
    p = F.col("__p")
    text, ranges, tokens = p["text"], p["ranges"], p["tokens"]
    flat = pages.withColumn("__p", flatten(F.col(markup), F.col(url)))
    found = flat.withColumns({"title": _title(text, ranges, p["page_title"]), "__e": _explanation(text, ranges)})
    found = _find_keywords(_find_teaser(_find_credits(found, text, ranges), text, ranges), p["keywords"])
    e, c = F.col("__e"), F.col("__c")
    credit = lambda s: F.struct(s["role"].alias("role"), part(text, s["at"], s["to"]).alias("text"), sliced(tokens, s["at"], s["to"]).alias("html"))
    addresses = F.flatten(F.transform(c, lambda s: F.regexp_extract_all(sliced(tokens, s["label_at"], s["label_to"]), F.lit('href="([^"]*)"'), F.lit(1))))
    licence = F.filter(addresses, lambda x: F.coalesce(F.exists(F.array(*map(F.lit, LICENCES)), lambda h: F.endswith(F.concat(F.lit("."), F.lower(F.try_parse_url(x, F.lit("HOST")))), F.concat(F.lit("."), h))), F.lit(False)))
    out = {
        "title_raw": F.nullif(collapsed(p["page_title"]), F.lit("")),
        "explanation_text": F.trim(part(text, e["at"], e["to"])),
        "explanation_html": F.when(e.isNotNull(), sliced(tokens, e["at"], e["to"])),
        "credits": F.transform(c, credit),
        "has_copyright": F.exists(c, lambda s: F.contains(F.lower(s["role"]), F.lit("copyright"))),
        "license_url": F.get(licence, F.lit(0)),
        "attributed": F.exists(F.regexp_extract_all(text, F.lit(LABEL), F.lit(0)), lambda x: x.rlike(_CREDIT_LABEL)),
        "media": _media(p["media"], p["hrefs"], p["tweet"]),
    }
    return found.withColumns(out).drop("__p", "__e", "__c")
