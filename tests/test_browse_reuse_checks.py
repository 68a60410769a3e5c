"""Pages, pictures, checks, votes, space weather, codes, differences and the sky against small tables."""

import datetime as dt
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from daybook.functions import exchange, planets
from daybook.operators import browse, checks, reuse, search, voting
from daybook.sources import pages, space
from daybook.streaming import ledger


def test_kind_filter():
    assert browse.kind_filter("images, vimeo,image") == ["image_jpg", "image_png", "image_gif", "vimeo"]
    for bad in ("images,film", "", " , "):
        with pytest.raises(ValueError):
            browse.kind_filter(bad)


def test_next_target_and_timeline_trim(spark):
    day = lambda n: dt.date(2020, 1, n)
    days = spark.createDataFrame([(day(n),) for n in range(1, 6)], "day date")
    tried = [(day(n), dt.datetime(2021, 1, 9 - n), n == 2, n == 3) for n in range(1, 6)]
    attempts = spark.createDataFrame(tried, "day date, at timestamp, ok boolean, final boolean")
    assert browse.next_target(days, attempts.where("day <> date '2020-01-02' and day <> date '2020-01-04'")).collect() == [(day(4),)]
    assert browse.next_target(days, attempts).collect() == [(day(5),)]
    events = spark.createDataFrame([(dt.datetime(2020, 1, n),) for n in range(1, 29)], "at timestamp")
    kept = browse.trimmed_timeline(events, F.lit(dt.datetime(2020, 1, 10)))
    assert sorted(x.at.day for x in kept.collect()) == [7, 8, 9, *range(10, 20)]


def test_picture_groups_unite_addresses_and_prints(spark):
    base = 0x0F0F_1234_5678_9ABC
    rows = [(1, "A", "u", None), (2, "b", "u", base), (3, "c", "", base ^ 0b1011), (4, "d", "", base ^ (0x1FF << 20)), (5, "e", "", 1), (6, "f", "", 1), (7, "g", "w", None)]
    e = spark.createDataFrame(rows, "date_id long, title string, media_url string, print long")
    grouped = reuse.regrouped(e, reuse.picture_groups(e, checkpoint=lambda df: df.sparkSession.createDataFrame(df.collect(), df.schema)))
    assert {x.date_id: x.picture_group for x in grouped.collect()} == {1: 1, 2: 1, 3: 1, 4: None, 5: None, 6: None, 7: None}
    listed = reuse.pictures(grouped).collect()
    assert [(x.picture_group, x.shown, x.span_days, x.title, x.titles) for x in listed] == [(1, 3, 2, "A", 3)]
    assert reuse.filtered(reuse.pictures(grouped), grouped, query="C", min_shown=3, retitled=True).count() == 1
    assert reuse.filtered(reuse.pictures(grouped), grouped, retitled=False).count() == 0
    runs = {x.date_id: x.runs for x in reuse.group_dates(grouped, grouped.where("date_id in (2, 4)")).collect()}
    assert runs == {2: [1, 2, 3], 4: [4]}
    assert tuple(reuse.summary(grouped).first()) == (1, 3, 5, 1, 3)
    answers = spark.createDataFrame([(1, 2, 3), (2, 4, 4), (3, 1, 4)], "round int, right_id long, picked_id long")
    assert {x.round: x.correct for x in reuse.same_picture(grouped, answers).collect()} == {1: True, 2: True, 3: False}


def test_issues_of_an_entry(spark):
    credit = "array<struct<role:string,text:string,html:string>>"
    rows = [
        (1, "Fine", "x" * 90, "", [("Image", "me", "")], "image_jpg", True),
        (2, " Tomorrow's picture\nis  <b>", "short", '<a href="x">', [], "none", None),
        (3, "", None, None, [("a b c d and e", "", '<a href="/y">')], "other", False),
        (4, "t" * 201, "y  " + "z" * 80, "", None, "youtube", False),
    ]
    e = spark.createDataFrame(rows, f"date_id long, title string, text string, html string, credits {credit}, kind string, attributed boolean")
    got = e.select("date_id", checks.issues(*(F.col(c) for c in ("title", "text", "html", "credits", "kind", "attributed"))).alias("issues"))
    told = {x.date_id: sorted(f"{i.field}:{i.warning}" for i in x.issues) for x in got.collect()}
    assert told[1] == []
    assert told[2] == sorted(
        ["title:leading_whitespace", "title:multi_whitespace", "title:contains_html", "title:title_multiline", "explanation:explanation_suspiciously_short", "explanation:non_absolute_link", "credit:credit_missing", "media:no_media"]
    )
    assert told[3] == sorted(["title:empty_field", "explanation:empty_field", "credit:empty_field", "credit:non_absolute_link", "credit:credit_role_suspicious", "media:unknown_media_kind"])
    assert told[4] == sorted(["title:title_suspiciously_long", "explanation:multi_whitespace"])
    assert {x.warning: (x.issues, x.entries) for x in checks.report(got).collect()}["empty_field"] == (3, 1)


def test_votes_and_stored_scores(spark):
    at = dt.datetime(2024, 1, 1)
    voters = spark.createDataFrame([(1, "a", at, False, 1.0), (2, "b", dt.datetime(2025, 1, 1), True, 1.0)], "voter long, cohort string, expires_at timestamp, blocked boolean, weight double")
    casts = spark.createDataFrame([(v, dt.datetime(2024, 6, 1), "new", 3600) for v in (1, 2, 3)], "voter long, at timestamp, cohort string, life long")
    after = {x.voter: (x.cohort, x.blocked) for x in voting.recorded(voters, casts).collect()}
    assert after == {1: ("new", False), 2: ("b", True), 3: ("new", False)}
    assert {x.voter: x.cohort for x in voting.expired(voters, F.lit(dt.datetime(2024, 6, 1))).collect()} == {1: None, 2: "b"}
    changes = spark.createDataFrame([(1, True, None), (2, None, 0.5)], "voter long, blocked boolean, weight double")
    assert {x.voter: (x.blocked, x.weight) for x in voting.flagged(voters, changes).collect()} == {1: (True, 1.0), 2: (True, 0.5)}
    board = spark.createDataFrame([(1, 2.0, 1.5, 2.5, True), (2, 1.0, 0.6, 1.4, True)], "picture long, score double, lower double, upper double, settled boolean")
    assert [x.picture for x in voting.favourite(board).collect()] == [1]
    assert voting.favourite(board.withColumn("upper", F.lit(1.6))).count() == voting.favourite(board.limit(1)).count() == 0
    known = spark.createDataFrame([(7, 0.4, 100.0), (8, 0.1, -1.0)], "picture long, score double, ess double")
    assert {x.picture: (x.ess, x.stderr) for x in voting.anchors(known).collect()} == {7: (50.0, pytest.approx(1 / np.sqrt(12.5))), 8: (0.0, None)}


def test_drawn_pairs_are_of_one_band(spark):
    rows = [(i, i % 40 / 20, 0.5 + i % 3, i % 7) for i in range(200)]
    scores = spark.createDataFrame(rows, "picture long, score double, stderr double, comparisons long")
    avoid = spark.createDataFrame([(i,) for i in range(20)], "picture long")
    drawn = voting.drawn_pairs(scores, 60, 5, avoid).collect()
    assert len(drawn) > 40 and drawn == voting.drawn_pairs(scores, 60, 5, avoid).collect()
    by = {r[0]: r[1] for r in rows}
    assert all(x.left != x.right and min(x.left, x.right) >= 20 and by[x.left] // 0.25 == by[x.right] // 0.25 for x in drawn)


def test_alerts_from_text(spark):
    rows = [
        ("A", "2024-05-01 10:00:00", "Code: X\r\n WARNING: Geomagnetic K-index of 5 \r\nValid To: 2024 May 01 1200 UTC\r\nNow Valid Until: 2024 May 01 1500 UTC\r\nNOAA Scale: G1 - Minor"),
        ("B", "2024-05-01 11:00:00", "ALERT: Type II\r\nnothing else"),
        ("C", "2024-05-01 12:00:00", "NOTE: no notice"),
        ("D", "never", "ALERT: lost"),
        ("E", "2024-05-01 09:00:00", "ALERT:\nSUMMARY: Proton event\nNOAA Scale:"),
    ]
    found = space.alerts(spark.createDataFrame(rows, "product_id string, issue_datetime string, message string"))
    got = {x.id[0]: x for x in found.collect()}
    assert set(got) == {"A", "B", "E"} and got["A"].valid_until == dt.datetime(2024, 5, 1, 15) and got["A"].scale == "G1 - Minor"
    assert got["E"].notice == "summary" and got["E"].scale is None and got["B"].valid_until is None
    now = F.lit(dt.datetime(2024, 5, 1, 13, 30))
    assert {x.id[0]: (x.b, x.c) for x in found.select("id", space.band().alias("b"), space.current(now).alias("c")).collect()} == {"A": ("G", True), "B": (None, True), "E": (None, False)}
    told = space.weather_notices(found, now, "aurora", "space").collect()
    assert {(x.topic, x.title) for x in told} == {("aurora", "Warning: Geomagnetic K-index of 5"), ("space", "Alert: Type II")}
    assert space.weather_notices(found, now, None, "space").count() == 1
    assert tuple(space.summary(found, now).first()) == (2, "Type II")
    levels = spark.createDataFrame([([("G", 2), ("S", 2), ("R", None)],)], "levels array<struct<band:string,scale:int>>")
    assert levels.select(space.worst(F.col("levels"))["band"], space.quiet(F.col("levels"))).first() == ("S", False)


def test_differences_of_words():
    told = exchange.word_diff("the old red moon rose", "the new red moon rose late")
    assert [(r["kind"], r["text"]) for r in told] == [("same", "the"), ("removed", "old"), ("added", "new"), ("same", "red moon rose"), ("added", "late")]
    r = random.Random(1)
    for _ in range(200):
        a, b = ([r.choice("abcd") for _ in range(r.randint(0, 12))] for _ in range(2))
        steps = exchange.shortest_edit(a, b)
        assert [w for k, w in steps if k != "added"] == a and [w for k, w in steps if k != "removed"] == b
        best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                best[i + 1][j + 1] = best[i][j] + 1 if x == y else max(best[i][j + 1], best[i + 1][j])
        assert sum(k == "same" for k, _ in steps) == best[-1][-1]


def test_codes_and_draws(spark):
    codes = exchange.encode_numbers(np.arange(0, 1 << 28, 999_983), "picture")
    assert len(set(codes)) == len(codes) and [exchange.decode_code(c, "picture") for c in codes] == list(range(0, 1 << 28, 999_983))
    assert exchange.decode_code("a", "round") is exchange.decode_code("AAAAAA", "round") is exchange.decode_code("______", "round") is None
    mask, want, state = (1 << 64) - 1, [], 1234567
    for _ in range(4):
        state = (state + 0x9E3779B97F4A7C15) & mask
        z = ((state ^ (state >> 30)) * 0xBF58476D1CE4E5B9) & mask
        z = ((z ^ (z >> 27)) * 0x94D049BB133111EB) & mask
        want.append(z ^ (z >> 31))
    got = spark.range(1).select(*[exchange.split_mix(F.lit(1234567).cast("long"), k) for k in range(4)]).first()
    assert [x & mask for x in got] == want


def test_planets_and_showers(spark):
    start = spark.createDataFrame([(dt.datetime(2025, 1, 1),)], "at timestamp")
    found = {x.planet: x for x in planets.milestones(start).collect()}
    # published: opposition of Mars on 16 January 2025, greatest eastern elongation of Venus on 10 January
    assert abs((found["Mars"].at - dt.datetime(2025, 1, 16, 2)).total_seconds()) < 86400 and found["Mars"].milestone == "opposition"
    assert abs((found["Venus"].at - dt.datetime(2025, 1, 10, 5)).total_seconds()) < 86400 and found["Venus"].milestone == "greatest_eastern_elongation"
    peaks = {x.name: x for x in planets.shower_peaks(start).collect()}
    assert abs((peaks["Geminids"].at - dt.datetime(2025, 12, 14, 8)).total_seconds()) < 86400 and len(peaks) == 12
    seen = planets.planets(start).collect()
    assert sorted(x.place for x in seen) == list(range(1, 8)) and {x.visibility for x in seen} <= {"lost", "all_night", "evening", "morning"}


def test_a_key_is_new_again_after_its_life(spark):
    at = dt.datetime(2024, 1, 1)
    rows = [("k", at), ("k", at + dt.timedelta(minutes=40)), ("k", at + dt.timedelta(minutes=80)), ("k", at + dt.timedelta(days=4)), ("x", at)]
    got = ledger.once(spark.createDataFrame(rows, "key string, at timestamp"), "at", "key", "1 hour")
    assert sorted((x.key, x.at) for x in got.collect()) == [rows[0], rows[2], rows[3], rows[4]]


def test_declared_charsets():
    assert pages._declared(b"<META CHARSET = 'Windows-1251'>") == "windows-1251"
    assert pages._declared(b"the charset is told later: charset=utf-8;") == "utf-8" and pages._declared(b"charset=") is None


def test_snippets(spark):
    text = " ".join(f"w{i}" for i in range(40)) + " the Café, neb. " + " ".join(f"v{i}" for i in range(40))
    rows = spark.createDataFrame([(1, text), (2, "nothing here"), (3, "Cafe")], "date_id long, text string")
    got = {x.date_id: x.snippet for x in search.snippets(rows, '"cafe"', "text", 5).collect()}
    assert got == {1: "…w39 the <mark>Café</mark>, neb. v0…", 3: "<mark>Cafe</mark>"}
