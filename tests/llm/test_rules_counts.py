"""Quality statistics and verdicts, token counts, mixing."""

import numpy as np
import pytest

from daybook.llm import mixing as M
from daybook.llm import quality_rules as Q
from daybook.llm import token_counts as T
from tests.llm import plain

plain_statistics = plain.statistics


def test_statistics_equal_plain_ones(texts):
    for t in texts:
        assert Q.statistics_of(t) == plain_statistics(t)


def held_against_plain(frame):
    rows = [tuple(x) for x in frame.select("doc_id", "text", "lang", "source").collect()]
    want = {}
    for (i, t, g, s), (stats, base, d2) in zip(rows, plain.verdicts([r[1:] for r in rows]), strict=True):
        want.setdefault((i, g, s, stats, base), []).append((t, d2))
    limit, n = Q.chi_square(Q.TAIL), 0
    for x in Q.quality_rules(frame).collect():
        stats = (x.n_words, x.word_chars, x.n_symbols, x.n_dup_lines, x.n_lines, x.n_repeat_words)
        d2 = want[(x.doc_id, x.lang, x.source, stats, x.base_failed)][0][1]
        assert (x.distance is None) == (d2 is None)
        assert d2 is None or x.distance == pytest.approx(d2, rel=1e-6, abs=1e-6)
        assert x.kept == (not x.base_failed and (d2 is None or d2 <= limit))
        n += 1
    assert n == len(rows)


def test_verdicts_equal_a_slow_estimate(docs):
    held_against_plain(docs)


def test_verdicts_of_groups_of_all_sizes(spark):
    r = np.random.default_rng(6)
    rows = []
    for k, n in enumerate((1, 2, 3, 10, 40, 90)):
        for _ in range(n):
            words = [f"w{x}" + "$" * int(r.random() < 0.05 * k) for x in r.integers(0, 90 + 900 * k, int(r.integers(55, 160)))]
            rows.append((len(rows), " ".join(words) + "\nsame line\nsame line" * int(r.integers(0, 3)), ("en", "de", None)[k % 3], f"s{k}"))
    held_against_plain(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string"))


def test_limit_is_a_chi_square_quantile():
    assert Q.CHI2_MEDIAN == pytest.approx(3.356694, abs=1e-6) and Q.chi_square(0.05) == pytest.approx(9.487729, abs=1e-6)


def test_outliers_of_a_group_are_rejected(spark):
    r = np.random.default_rng(2)
    clean = [" ".join(f"w{x}" for x in r.integers(0, 9999, 120)) for _ in range(300)]
    junk = [" ".join(f"w{x}$$%%" for x in r.integers(0, 9999, 120)) for _ in range(20)]
    rows = [(i, t, "en", "a") for i, t in enumerate(clean + junk)]
    out = Q.quality_rules(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")).toPandas().sort_values("doc_id")
    assert out.kept[:300].all() and not out.kept[300:].any()


def test_token_counts_equal_the_library(docs, texts):
    own = T.Counter(T.model_path())
    odd = ["▁", " ▁ a", "\n", "\n ", " \n", "a\r\n\r\nb", "\t\tx", "<s>a</s>", "\x00", "   ", "a  ", "é", "😀😀"]
    plain = [t or "" for t in texts] + odd
    assert own.count(plain) == [len(x) for x in own.model.encode(plain)]
    got = {(x.doc_id, x.n_bytes, x.n_tokens, x.over_limit) for x in T.token_counts(docs, limit=100).collect()}
    want = set()
    for x in docs.collect():
        n = len(own.model.encode(x.text or ""))
        want.add((x.doc_id, len((x.text or "").encode()), n, n > 100))
    assert got == want


def test_empty_tables(empty):
    assert Q.quality_rules(empty).count() == T.token_counts(empty).count() == M.mix(empty).count() == 0


def test_row_keys_tell_nulls_apart(spark):
    from daybook.llm import common

    rows = [(1, None, "x"), (1, "x", None), (1, "x", "x"), (1, None, None)]
    frame = spark.createDataFrame(rows, "doc_id long, lang string, source string")
    assert frame.select(common.row_key(frame.columns).alias("k")).distinct().count() == 4


plain_targets = plain.targets


def test_mix_meets_its_targets(docs):
    out = M.mix(docs).toPandas()
    sizes = {None if k == "-" else k: v for k, v in out.assign(source=out.source.fillna("-")).groupby("source")["size"].sum().items()}
    want = plain_targets(sizes)
    largest = out["size"].max()
    for s, group in out.assign(source=out.source.fillna("-")).groupby("source"):
        key = None if s == "-" else s
        assert abs(group.target.iloc[0] - want[key]) < 1e-6
        assert abs(group.taken.sum() - want[key]) <= largest
        assert (group.taken <= 2 * group["size"]).all()
    again = M.mix(docs.repartition(5)).toPandas()
    keys = ["row_key", "taken", "size"]
    assert out[keys].sort_values(keys).reset_index(drop=True).equals(again[keys].sort_values(keys).reset_index(drop=True))
