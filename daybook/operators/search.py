"""Full-text search: query grammar, positional postings, boolean matching and column-weighted BM25."""

from __future__ import annotations

import heapq
import re
from collections import Counter
from dataclasses import dataclass, field
from functools import reduce

import pandas as pd
import regex
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import PLAIN_TOKEN, UNMARKED, index_tokens, tokens

MAX_TERMS, MAX_PREFIXES = 24, 4
K1, B = 1.2, 0.75


@dataclass(frozen=True)
class Phrase:
    """Adjacent tokens in one column; the last may be a prefix."""

    tokens: tuple[str, ...]
    prefix: bool = False


@dataclass
class Group:
    wanted: list[Phrase] = field(default_factory=list)
    unwanted: list[Phrase] = field(default_factory=list)


_ITEM = re.compile(r'(?P<no>-(?=\S))?(?:"(?P<quoted>[^"]*)"?(?P<star>\**)|(?P<bare>[^\s"]+))')
#: A token in a text of which marked letters were replaced; marks may stand in and around it.
_SPAN, _MARKS = regex.compile(r"\p{M}*[\p{L}\p{N}][\p{L}\p{N}\p{M}]*"), regex.compile(r"\p{M}+")


def parse(query: str) -> list[Group]:
    """OR of groups, each an AND of wanted phrases without any of the unwanted; a group that wants nothing vanishes."""
    groups, negate, terms, prefixes = [Group()], False, 0, 0
    items = list(_ITEM.finditer(query))
    for place, m in enumerate(items):
        bare = m["bare"]
        if bare in ("OR", "AND", "NOT") and not m["no"]:
            negate = bare == "NOT"
            if bare == "OR":
                groups.append(Group())
            continue
        raw = m["quoted"] if bare is None else bare
        found = tuple(index_tokens(raw))
        no, negate = bool(m["no"]) or negate, False
        prefix = bool(m["star"]) if bare is None else raw.endswith("*")
        if place == len(items) - 1 and bare is not None and not no:
            prefix = True
        if not found or terms >= MAX_TERMS:
            continue
        terms += 1
        if prefix and prefixes >= MAX_PREFIXES:
            prefix = False
        prefixes += prefix
        (groups[-1].unwanted if no else groups[-1].wanted).append(Phrase(found, prefix))
    return [g for g in groups if g.wanted]


def occurrences(line: Column, phrase: Phrase) -> Column:
    """How often the phrase stands in a line of tokens between spaces, overlaps included; one pass of one pattern."""
    parts = [t + ("[^ ]*" if phrase.prefix and i == len(phrase.tokens) - 1 else "") for i, t in enumerate(phrase.tokens)]
    return F.regexp_count(line, F.lit(f"(?<= ){parts[0]}(?={''.join(f' {x}' for x in parts[1:])} )")).cast("long")


def phrases_of(groups: list[Group]) -> list[Phrase]:
    return list(dict.fromkeys(p for g in groups for p in (*g.wanted, *g.unwanted)))


def nothing(spark: SparkSession, columns: list[str]) -> DataFrame:
    """The result of a query that wants nothing."""
    return spark.createDataFrame([], "date_id long, score double, " + ", ".join(f"hits_{c} boolean" for c in columns))


def ranked(counted: DataFrame, groups: list[Group], weights: dict[str, float], rows: Column | None = None, mean: Column | None = None) -> DataFrame:
    """Matches and scores from ``counted`` (date_id, length, n_<phrase>_<column>, in the order of ``phrases_of``).

    ``rows`` and ``mean`` are the number of documents and their mean length; without them ``counted`` has all documents.
    """
    phrases = phrases_of(groups)
    wanted = list(dict.fromkeys(p for g in groups for p in g.wanted))
    in_row = {p: sum((F.col(f"n_{i}_{c}") for c in weights), F.lit(0)) > 0 for i, p in enumerate(phrases)}
    place = {p: i for i, p in enumerate(phrases)}
    overall = counted.agg(F.count("*").alias("rows"), F.avg("length").alias("mean"), *[F.count_if(in_row[p]).alias(f"with_{place[p]}") for p in wanted])
    if rows is not None:
        overall = overall.withColumns({"rows": rows, "mean": mean})
    match = F.lit(False)
    for g in groups:
        yes = reduce(lambda a, b: a & b, [in_row[p] for p in g.wanted])
        match |= reduce(lambda a, b: a & ~b, [in_row[p] for p in g.unwanted], yes)
    met = counted.where(match).join(F.broadcast(overall))  # one row
    score = F.lit(0.0)
    for p in wanted:
        i = place[p]
        with_p = F.col(f"with_{i}")
        idf = F.log((F.col("rows") - with_p + 0.5) / (with_p + 0.5))
        idf = F.when(idf <= 0, F.lit(1e-6)).otherwise(idf)
        f = sum((F.col(f"n_{i}_{c}") * F.lit(float(w)) for c, w in weights.items()), F.lit(0.0))
        score = score - idf * f * (K1 + 1) / (f + K1 * (1 - B + B * F.col("length") / F.col("mean")))
    flags = [reduce(lambda a, b: a | b, [F.col(f"n_{place[p]}_{c}") > 0 for p in wanted]).alias(f"hits_{c}") for c in weights]
    return met.select("date_id", score.alias("score"), *flags)


def search(entries: DataFrame, query: str, weights: dict[str, float]) -> DataFrame:
    """(date_id, score and hits_<column>): rows that match, better ones with lower scores, from the texts themselves.

    One pass tokenises and counts phrases per row; rows are kept slim, and the two aggregates that BM25 needs (rows
    with each phrase, average length) are one row, which every slim row meets.  ``index.SearchIndex`` keeps the tokens.
    """
    groups = parse(query)
    if not groups:
        return nothing(entries.sparkSession, list(weights))
    phrases = phrases_of(groups)
    lines = [F.concat(F.lit(" "), F.array_join(tokens(F.coalesce(F.col(c), F.lit(""))), " "), F.lit(" ")).alias(c) for c in weights]
    cut = entries.select("date_id", F.inline(F.array(F.struct(*lines))))  # each line is made once, not in every use
    spaces = lambda c: F.char_length(c) - F.char_length(F.replace(c, F.lit(" "), F.lit("")))
    tokens_in = lambda c: F.when(F.col(c) == "  ", F.lit(0)).otherwise(spaces(F.col(c)) - 1)
    counted = cut.select(
        "date_id", sum((tokens_in(c) for c in weights), F.lit(0)).alias("length"),
        *[occurrences(F.col(c), p).alias(f"n_{i}_{c}") for i, p in enumerate(phrases) for c in weights],
    )
    return ranked(counted, groups, weights)


def spans(text: str) -> tuple[list[str], list[tuple[int, int]]]:
    """Index tokens of a text and where each stands in it, marks included."""
    plain = text if text.isascii() else text.translate(UNMARKED)
    if text.isascii() or not _MARKS.search(plain):
        found = list(PLAIN_TOKEN.finditer(plain))
        return [m[0].lower() for m in found], [m.span() for m in found]
    found = list(_SPAN.finditer(plain))
    return [_MARKS.sub("", m[0]).lower() for m in found], [m.span() for m in found]


def matches(tokens: list[str], phrases: list[Phrase]) -> list[tuple[int, int, int]]:
    """(start, end, phrase) of every place where a phrase stands, in tokens, by start."""
    first: dict[str, list[int]] = {}
    open_ended = []
    for i, p in enumerate(phrases):
        if p.prefix and len(p.tokens) == 1:
            open_ended.append(i)
        else:
            first.setdefault(p.tokens[0], []).append(i)
    out = []
    for at, token in enumerate(tokens):
        for i in first.get(token, ()):
            p, end = phrases[i], at + len(phrases[i].tokens)
            if tuple(tokens[at:end]) == p.tokens or p.prefix and end <= len(tokens) and tuple(tokens[at : end - 1]) == p.tokens[:-1] and tokens[end - 1].startswith(p.tokens[-1]):
                out.append((at, end, i))
        out += [(at, at + 1, i) for i in open_ended if token.startswith(phrases[i].tokens[0])]
    return out


def best_window(length: int, found: list[tuple[int, int, int]], n: int) -> int:
    """Where the window of ``n`` tokens begins that holds most different phrases whole; the first of several.

    The best window that comes first either begins the text or ends with a match, since one place to the left it would
    hold fewer phrases; so only as many windows as matches are tried, and they slide.  If none holds a whole phrase,
    the window begins with the first match.
    """
    best, begin, inside, held, ends, k = 0, 0, Counter(), [], sorted(found, key=lambda m: m[1]), 0
    for s in sorted({0, *(max(0, m[1] - n) for m in found)}):
        while k < len(ends) and ends[k][1] <= s + n:
            heapq.heappush(held, ends[k])
            inside[ends[k][2]] += 1
            k += 1
        while held and held[0][0] < s:
            gone = heapq.heappop(held)[2]
            inside[gone] -= 1
            if not inside[gone]:
                del inside[gone]
        if len(inside) > best:
            best, begin = len(inside), s
    return begin if best or not found else min(found[0][0], max(0, length - n))


def marked(text: str, at: list[tuple[int, int]], found: list[tuple[int, int, int]], start: int, end: int, before: str, after: str) -> str:
    """Tokens ``start`` to ``end`` of a text with phrases marked whole; phrases that overlap share their marks."""
    runs: list[list[int]] = []
    for a, b, _ in found:
        a, b = max(a, start), min(b, end)
        if a < b and runs and a < runs[-1][1]:
            runs[-1][1] = max(b, runs[-1][1])
        elif a < b:
            runs.append([a, b])
    out, upto = [], at[start][0]
    for a, b in runs:
        out += [text[upto : at[a][0]], before, text[at[a][0] : at[b - 1][1]], after]
        upto = at[b - 1][1]
    return "".join(out) + text[upto : at[end - 1][1]]


def wanted_phrases(query: str) -> list[Phrase]:
    return list(dict.fromkeys(p for g in parse(query) for p in g.wanted))


def highlight(text: Column, query: str, before: str = "<mark>", after: str = "</mark>") -> Column:
    """The whole text with every phrase that the query wants marked, with or without diacritics; null stays null."""
    phrases = wanted_phrases(query)
    if not phrases:
        return text

    @F.pandas_udf("string")
    def show(texts: pd.Series) -> pd.Series:
        return texts.map(one, na_action="ignore")

    def one(t: str) -> str:
        tokens, at = spans(t)
        if not at:
            return t
        return t[: at[0][0]] + marked(t, at, matches(tokens, phrases), 0, len(at), before, after) + t[at[-1][1] :]

    return show(text)


def snippet(text: str, phrases: list[Phrase], n: int, before: str, after: str, cut: str = "…") -> str | None:
    """The best window of a text around the phrases it holds, with ``cut`` where it goes on; None without tokens."""
    tokens, at = spans(text)
    if not at:
        return None
    found = matches(tokens, phrases)
    begin = best_window(len(at), found, n)
    shown = [m for m in found if begin <= m[0] and m[1] <= begin + n]
    if shown:  # what it holds in the middle
        first, last = shown[0][0], max(m[1] for m in shown)
        begin = max(0, min(first - (n - (last - first)) // 2, len(at) - n))
    end = min(begin + n, len(at))
    whole = [m for m in found if begin <= m[0] and m[1] <= end] or found
    return (cut if begin else "") + marked(text, at, whole, begin, end, before, after) + (cut if end < len(at) else "")


def snippets(entries: DataFrame, query: str, column: str, n: int = 16, *, before: str = "<mark>", after: str = "</mark>", found: DataFrame | None = None) -> DataFrame:
    """(date_id, snippet): of rows that match in the column, the ``n`` tokens (1 to 64) with most different phrases, marked.

    ``found`` is a search's result with ``hits_<column>``, as from the index; without it the texts are searched.
    """
    n, phrases = max(1, min(64, n)), wanted_phrases(query)
    if not phrases:
        return entries.select("date_id", F.lit(None).cast("string").alias("snippet")).limit(0)
    met = (search(entries, query, {column: 1.0}) if found is None else found).where(f"hits_{column}").select("date_id")
    show = F.pandas_udf(lambda texts: texts.map(lambda t: snippet(t, phrases, n, before, after), na_action="ignore"), "string")
    return entries.select("date_id", column).join(met, "date_id", "left_semi").select("date_id", show(F.col(column)).alias("snippet")).where("snippet is not null")
