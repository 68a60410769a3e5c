"""Seeded deals on ranks against plain lists; hashes of many words."""

import random

import pytest

from daybook.functions import hashing
from daybook.operators import puzzles


def plain_chain(pool, deal, rounds, first=None, apart=180):
    take = lambda items: [items[i] for i in deal.ranks(len(items), 1)]
    chain = [first] if first in pool else take(pool)
    while chain and len(chain) <= rounds:
        fresh = [d for d in pool if d not in chain and abs(d - chain[-1]) >= apart] or [d for d in pool if d not in chain]
        drawn = take(fresh)
        if not drawn:
            break
        chain += drawn
    return chain


@pytest.mark.parametrize(("size", "span", "rounds", "first"), [(60, 3000, 6, None), (12, 400, 8, None), (5, 90, 9, None), (40, 900, 5, "one"), (40, 900, 3, -7), (1, 10, 3, None), (0, 1, 3, None)])
def test_chains_equal_plain_ones(spark, size, span, rounds, first):
    r = random.Random(size + rounds)
    pool = sorted(r.sample(range(span), size))
    first = pool[3] if first == "one" else first
    frame = spark.createDataFrame([(d,) for d in pool + pool[:2]], "date_id long").repartition(3)
    assert puzzles.chain(frame, puzzles.Deal.daily("order", 77), rounds, first) == plain_chain(pool, puzzles.Deal.daily("order", 77), rounds, first)


def test_places_outside():
    r = random.Random(2)
    for _ in range(500):
        size = r.randint(1, 30)
        low, high = sorted((r.randint(0, size), r.randint(0, size)))
        used = r.sample(range(size), r.randint(0, size))
        left = [i for i in range(size) if not low <= i < high and i not in used]
        assert [puzzles._nth_outside(n, low, high, used) for n in range(len(left))] == left


def test_deals(spark):
    pool = spark.createDataFrame([(d * 3,) for d in range(50)], "date_id long")
    ranks = puzzles.Deal.seeded(9).ranks(50, 8)
    assert len(set(ranks)) == 8 and puzzles.take(pool, puzzles.Deal.seeded(9), 8) == [3 * x for x in ranks]
    assert sorted(puzzles.Deal.seeded(1).ranks(4, 9)) == [0, 1, 2, 3] and puzzles.Deal.seeded(1).ranks(0, 3) == []
    shuffled = puzzles.Deal.daily("match", 3).shuffled(list(range(9)))
    assert sorted(shuffled) == list(range(9)) and shuffled != list(range(9))
    assert puzzles.Deal.daily("a", 1).next() != puzzles.Deal.daily("a", 2).next()


def test_many_hashes():
    r = random.Random(1)
    values = [bytes(r.randrange(256) for _ in range(r.choice([0, 1, 5, 40]))) for _ in range(300)]
    assert hashing.hash_many(values).tolist() == [hashing.hash64(v) for v in values]
    assert hashing.hash_many([]).tolist() == []
    assert hashing.word_hashes(1, ["nebula", "é"]) == [hashing.word_hash(1, "nebula"), hashing.word_hash(1, "é")]


def test_too_many_given_words(spark):
    rows = spark.range(puzzles.MOST_GIVEN + 1).selectExpr("cast(id as string) as word")
    with pytest.raises(ValueError, match="given away"):
        puzzles.given_set(rows)
    assert len(puzzles.given_set(rows.limit(7))) == 7
