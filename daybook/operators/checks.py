"""Warnings about entries, as column expressions, and the reports over them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SHORTEST_TEXT, LONGEST_TITLE, LONGEST_ROLE = 80, 200, 4
#: One white-space character, in patterns that Java and RE2 read alike.
SPACE = r"[\t-\r \x{85}\p{Z}]"
TAG = r"<[\t-\r ]*/?[a-zA-Z]"
TEASER = r"(?i)^tomorrow['’]s[\t-\r \x{85}\p{Z}]+picture\b"
ABSOLUTE = ("http://", "https://", "mailto:")


def _issue(field: str, warning: str, holds: Column) -> Column:
    return F.when(holds, F.struct(F.lit(field).alias("field"), F.lit(warning).alias("warning")))


def _text_issues(field: str, text: Column) -> list[Column]:
    """What can be wrong with any text; an empty one has no other fault."""
    some = text != ""
    return [
        _issue(field, "empty_field", ~some),
        _issue(field, "leading_whitespace", text.rlike(f"^{SPACE}")),
        _issue(field, "trailing_whitespace", text.rlike(rf"{SPACE}\z")),
        _issue(field, "multi_whitespace", text.rlike(f"{SPACE}{SPACE}")),
        _issue(field, "contains_html", text.rlike(TAG)),
    ]


def relative_link(html: Column) -> Column:
    """Whether any address is not absolute."""
    addresses = F.regexp_extract_all(html, F.lit('href="([^"]*)"'), F.lit(1))
    return F.exists(addresses, lambda a: ~(a.startswith(ABSOLUTE[0]) | a.startswith(ABSOLUTE[1]) | a.startswith(ABSOLUTE[2])))


def role_words(role: Column) -> Column:
    return F.size(F.filter(F.regexp_extract_all(role, F.lit(r"[\p{L}\p{N}]+"), F.lit(0)), lambda w: F.lower(w) != "and"))


def issues(title: Column, text: Column, html: Column, credits: Column, kind: Column, attributed: Column) -> Column:
    """The array of (field, warning) of an entry; nulls count as empty, unknown attribution as attributed.

    ``credits`` is an array of (role, text, html).
    """
    title, text, html = (F.coalesce(c, F.lit("")) for c in (title, text, html))
    own = [
        *_text_issues("title", title),
        _issue("title", "title_is_teaser_label", title.rlike(TEASER)),
        _issue("title", "title_multiline", title.rlike(r"\n[\s\S]")),
        _issue("title", "title_suspiciously_long", F.char_length(title) > LONGEST_TITLE),
        *_text_issues("explanation", text),
        _issue("explanation", "explanation_suspiciously_short", (text != "") & (F.char_length(text) < SHORTEST_TEXT)),
        _issue("explanation", "non_absolute_link", relative_link(html)),
        _issue("credit", "credit_missing", (F.coalesce(F.size(credits), F.lit(0)) <= 0) & F.coalesce(attributed, F.lit(True))),
    ]

    def of_credit(c: Column) -> Column:
        t, h = F.coalesce(c["text"], F.lit("")), F.coalesce(c["html"], F.lit(""))
        found = [*_text_issues("credit", t), _issue("credit", "non_absolute_link", relative_link(h))]
        return F.array(*found, _issue("credit", "credit_role_suspicious", role_words(F.coalesce(c["role"], F.lit(""))) > LONGEST_ROLE))

    of_kind = F.when(kind == "none", "no_media").when(kind == "other", "unknown_media_kind")
    last = F.when(of_kind.isNotNull(), F.struct(F.lit("media").alias("field"), of_kind.alias("warning")))
    nothing = F.array().cast("array<struct<field:string,warning:string>>")
    every = F.concat(F.array(*own), F.coalesce(F.flatten(F.transform(credits, of_credit)), nothing), F.array(last))
    return F.filter(every, lambda x: x.isNotNull())


def report(checked: DataFrame) -> DataFrame:
    """(warning, issues, entries) over rows with date_id and ``issues``."""
    found = checked.select("date_id", F.explode("issues").alias("i")).select("date_id", "i.warning")
    per = found.groupBy("warning", "date_id").agg(F.count("*").alias("n"))
    return per.groupBy("warning").agg(F.sum("n").alias("issues"), F.count("*").alias("entries"))


def status(entries: DataFrame, publishable: int, version: int) -> DataFrame:
    """One row: entries, coverage of the days that could have one, rows of older parsers, rows with thumbnail and print."""
    return entries.agg(
        F.count("*").alias("entries"), F.round(100 * F.count("*") / F.lit(max(1, publishable)), 6).alias("coverage_percent"),
        F.count_if(F.col("parser_version") < version).alias("stale"), F.count("thumb_path").alias("thumbs"), F.count("print").alias("hashed"),
    )
