"""Python workers take a batch in portions and hand each on before the next."""

import numpy as np
import pandas as pd
import pyarrow as pa

from daybook.functions import batches, exchange
from daybook.operators import index, puzzles
from daybook.sources import pages


def test_portions_cover_all_rows_in_order():
    for sizes in ([], [5], [0] * 600, [batches.SIZE * 3, 1, 1], [batches.SIZE // 2] * 5, [1] * 3 + [batches.SIZE + 1] + [1] * 3):
        found = list(batches.portions(np.array(sizes, np.int64)))
        assert [i for at, to in found for i in range(at, to)] == list(range(len(sizes)))
        assert all(to - at <= batches.ROWS and (to - at == 1 or sum(sizes[at:to]) <= batches.SIZE) for at, to in found)


class Taken:
    """Stands for a DataFrame; hands back the function of a map."""

    def select(self, *columns):
        return self

    def mapInPandas(self, run, schema):
        return run


def test_cloze_hands_on_portions(spark):
    run = puzzles.cloze(Taken(), frozenset(["the"]), 7)
    frame = pd.DataFrame({"date_id": range(600), "text": ["the open cluster", None, ""] * 200})
    out = list(run(iter([frame])))
    assert [len(x) for x in out] == [250, 250, 100]
    assert [i for x in out for i in x["date_id"]] == list(range(600)) and {n for x in out for n in x["hidden"]} == {0, 2}


def test_index_hands_on_portions():
    rows = pa.RecordBatch.from_pydict({"date_id": list(range(600)), "title": ["an open cluster", None, ""] * 200})
    out = list(index._postings(["title"])(iter([rows])))
    assert len(out) == 3 and max(len(set(x.column("date_id").to_pylist())) for x in out) == 250
    assert sum(x.num_rows for x in out) == 600 + 3 * 200


def test_pages_are_walked_in_portions(monkeypatch):
    monkeypatch.setattr(pages.F, "pandas_udf", lambda schema: lambda run: lambda *columns: run)
    run = pages.flatten(None, None)
    out = list(run(iter([(pd.Series(["<title>a</title>", None] * 300), pd.Series(["https://x.org/", None] * 300))])))
    assert [len(x) for x in out] == [250, 250, 100] and [t for x in out for t in x["page_title"]] == ["a", None] * 300


def test_differences_are_handed_on_in_portions():
    old, new = pd.Series(["a b c", None] * 300), pd.Series(["a c", "x"] * 300)
    out = list(exchange.diff_words.func(iter([(old, new)])))
    assert [len(x) for x in out] == [250, 250, 100]
    assert list(out[1])[:2] == [exchange.word_diff("a b c", "a c"), exchange.word_diff(None, "x")]
