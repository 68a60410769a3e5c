"""Roll-ups under change against counting anew."""

import random

import pytest

from daybook.operators import catalogue, rollups

LINK = "page_id long, key string, scheme string, host string, anchor string, n long"


def bag_of(r, ids):
    return [(i, w, r.randint(1, 3)) for i in ids for w in r.sample([f"w{k}" for k in range(40)], r.randint(0, 8))]


def links_of(r, ids):
    return [(i, f"{k}.org/", r.choice(["http", "https"]), f"{k}.org", r.choice(["", "a", "bb", "b", "long name"]), r.randint(1, 3)) for i in ids for k in r.sample("abcdefghijkl", r.randint(0, 5))]


def steps(rows_of, seed):
    """Rows of each id, then changes (rows that go, rows that come)."""
    r = random.Random(seed)
    now = {i: rows_of(r, [i]) for i in range(30)}
    yield [x for rows in now.values() for x in rows], None
    for step in range(4):
        gone = r.sample(sorted(now), 8) + [min(now), max(now)]
        new = {i: rows_of(r, [i]) for i in [*gone[:4], 100 + step, -5 + step]}
        old = [x for i in {*gone, *new} for x in now.get(i, [])]
        now = {i: v for i, v in now.items() if i not in gone} | new
        yield old, [x for rows in new.values() for x in rows]
    yield [x for rows in now.values() for x in rows], []


def test_words_follow_changes(spark):
    frame = lambda rows: spark.createDataFrame(rows, "date_id long, word string, n long")
    every = list(steps(bag_of, 1))
    state = rollups.WordRollup.build(frame(every[0][0]), 4)
    now = list(every[0][0])
    for old, new in every[1:]:
        state = state.change(frame(old), frame(new))
        now = [x for x in now if x not in old] + new
        assert sorted(state.rows().collect()) == sorted(catalogue.words(frame(now)).collect())
    assert state.rows().count() == 0


def test_links_follow_changes(spark):
    frame = lambda rows: spark.createDataFrame(rows, LINK)
    every = list(steps(links_of, 2))
    state = rollups.LinkRollup.build(frame(every[0][0]), 4)
    now = list(every[0][0])
    for old, new in every[1:]:
        state = state.change(frame(old), frame(new))
        now = [x for x in now if x not in old] + new
        want = catalogue.resources(frame(now))
        assert sorted(map(str, state.rows().select(*want.columns).collect())) == sorted(map(str, want.collect()))
        assert sorted(state.links.rows().select("page_id", "key").collect()) == sorted((x[0], x[1]) for x in now)
    assert state.rows().count() == 0 and state.anchors.rows().count() == 0


def test_only_touched_parts_are_written(spark):
    frame = lambda rows: spark.createDataFrame(rows, "date_id long, word string, n long")
    state = rollups.WordRollup.build(frame([(1, f"w{i}", 1) for i in range(200)]), 8)
    after = state.change(frame([(1, "w3", 1)]), frame([]))
    moved = [p for p in after.words.parts if after.words.parts[p] != state.words.parts[p]]
    assert len(moved) == 1 and after.rows().count() == 199 and state.rows().count() == 200
    assert after.change(frame([]), frame([])) is not None
    after.words.forget()
    assert after.rows().count() == 199


def test_extremes_are_recomputed_only_where_retracted(spark):
    frame = lambda rows: spark.createDataFrame(rows, LINK)
    row = lambda i, k, s="http": (i, k, s, k, "x", 1)
    base = frame([row(1, "a"), row(5, "a"), row(9, "a"), row(1, "b"), row(5, "b"), row(9, "b"), row(3, "c"), row(4, "c", "https"), row(5, "c")])
    deltas = rollups.link_deltas(frame([row(5, "a"), row(9, "b"), row(4, "c", "https")]), frame([row(7, "a")]))
    both = catalogue.resources(base).join(deltas, "key", "full")
    assert {r.key for r in rollups.retracted(both).collect()} == {"b"}


@pytest.mark.parametrize("gone", [True, False])
def test_rows_of_a_change(spark, gone):
    table = spark.createDataFrame([(i, "x") for i in range(5)], "page_id long, html string")
    removed = table.where("page_id = 1" if gone else "page_id < 0")
    assert {r.page_id for r in rollups.changed(table, table.where("page_id > 3"), removed, "page_id").collect()} == ({1, 4} if gone else {4})


def test_word_sums_need_no_bag(spark):
    texts = ["The planet, the MOON and the planet.", "", None, "moon"]
    frame = spark.createDataFrame(list(enumerate(texts)), "date_id long, text string")
    sums = catalogue.word_sums(frame)
    assert sorted(sums.collect()) == sorted(catalogue.words(catalogue.entry_words(frame)).collect())
    state = rollups.WordRollup.of(sums, 4).moved(catalogue.word_sums(frame.where("date_id = 0")), catalogue.word_sums(spark.createDataFrame([(9, "moon moon")], "date_id long, text string")))
    assert sorted(map(tuple, state.rows().collect())) == [("moon", 3, 2)]
