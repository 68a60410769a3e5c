"""Ordinal grading on held-out rows; the pipeline on a small folder; the registered queries."""

import random
from collections import Counter

import numpy as np

import corpus_pipeline
from daybook.llm import bfd_packing as P
from daybook.llm import ordinal as O
from daybook.llm import quality_rules as Q
from daybook.llm import queries
from tests.llm import plain
from tests.llm.conftest import SCHEMA, rows_of, texts_of


def graded(n=3200, seed=9):
    r = random.Random(seed)
    words = [f"n{i}" for i in range(150)]
    docs, labels = [], []
    for i in range(n):
        text = [r.choice(words) for _ in range(r.randint(20, 80))]
        poor, toxic = r.random() < 0.2, r.random() < 0.2
        if poor:
            text = [f"{w}%%%" for w in text]
        if toxic:
            text[r.randrange(len(text))] = r.choice(["nasty", "vile"])
        docs.append((i, " ".join(text)))
        labels.append((i, int(not poor), int(toxic)))
    return docs, labels


def test_held_out_accuracy(spark):
    docs, labels = graded()
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    rated = O.ratings(spark.createDataFrame(labels[:3000] + [(None, 1, 1), (1, None, 0)], "doc_id long, quality int, toxic int"))
    model = O.fit(frame, rated)
    out = {x.doc_id: x for x in O.grade(frame, model).collect()}
    right = sum(out[i].kept == (q == 1 and t == 0) for i, q, t in labels[3000:])
    assert right >= 190
    assert (np.diff(model[1]) > 0).all()
    assert all(0 <= x.tail <= 1 and 0 <= x.expected_grade <= 2 for x in out.values())


def test_without_ratings_or_words(spark, docs, empty):
    assert O.fit(docs, O.ratings(spark.createDataFrame([], "doc_id long, quality int, toxic int"))) is None
    out = O.grade(docs, None).collect()
    assert len(out) == docs.count()
    wordless = {x.doc_id for x in docs.collect() if not (x.text or "").split()}
    assert all(x.kept == (x.doc_id not in wordless) for x in out)
    assert O.grade(empty, None).count() == 0


def test_gradient_and_optimum():
    r = np.random.default_rng(3)
    n, m = 60, 6
    present = r.random((n, m)) < 0.4
    rows, cols = np.nonzero(present)
    grade = np.clip((present @ r.normal(size=m) + r.normal(size=n)).round().astype(int) + 1, 0, 2)
    w, steps = r.normal(size=m), np.array([-0.4, 0.3])
    _, slope = O.loss_and_gradient(w, steps, rows, cols, grade, 2e-4)
    x = np.concatenate([w, steps])
    loss = lambda v: O.loss_and_gradient(v[:m], v[m:], rows, cols, grade, 2e-4)[0]
    for k in range(len(x)):
        e = np.zeros(len(x))
        e[k] = 1e-6
        assert abs((loss(x + e) - loss(x - e)) / 2e-6 - slope[k]) < 1e-6
    # a slow optimiser: plain descent with halved steps
    v, rate = np.concatenate([np.zeros(m), [0.0, 0.0]]), 1.0
    for _ in range(20_000):
        g = O.loss_and_gradient(v[:m], v[m:], rows, cols, grade, 2e-4)[1]
        while loss(v - rate * g) > loss(v):
            rate /= 2
            if rate < 1e-12:
                break
        v, rate = v - rate * g, min(4.0, rate * 1.1)
    weights, thresholds = O.fit_cumulative(rows, cols, grade, rounds=3000)
    own = np.concatenate([weights[:m], [thresholds[0], np.log(thresholds[1] - thresholds[0])]])
    assert abs(loss(own) - loss(v)) < 1e-4


def test_probabilities_sum_to_one():
    p = O.probabilities(np.array([-3.0, 0, 2]), np.array([-1.0, 0.5]))
    assert np.allclose(p.sum(1), 1) and (p > 0).all()


def write(spark, folder, frame):
    frame.write.parquet(f"{folder}/documents.parquet")


def test_pipeline_runs_over_odd_rows_and_keeps_columns(spark, tmp_path):
    frame = spark.createDataFrame(rows_of(texts_of(8)) + [(None, None, None, None, None, 1, "k", "r")], SCHEMA)
    write(spark, tmp_path, frame)
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        docs = stage(spark, docs, str(tmp_path))
        if i < len(corpus_pipeline.STAGES) - 1:
            assert docs.columns == frame.columns
            assert [f.dataType for f in docs.schema] == [f.dataType for f in frame.schema]
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == docs.count() > 0


STAGE = dict(corpus_pipeline.STAGES)
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars", "size", "_key", "range"]


def stage_rows(spark, name, rows, folder):
    frame = spark.createDataFrame(rows, SCHEMA).repartition(3)
    return [tuple(x) for x in STAGE[name](spark, frame, str(folder)).select(*COLUMNS).collect()]


def odd_rows():
    rows = rows_of(texts_of(21))
    clash = [(7, "first text under one id " * 12, "en", "a", 1, 1, "k", "r"), (7, "second one, nothing like it " * 12, "en", "a", 1, 1, "k", "r")]
    nulls = [(None, rows[3][1], None, "x", 1, 1, "k", "r"), (None, rows[3][1], "x", None, 1, 1, "k", "r"), (None, "lonely " + rows[9][1][::-1], "x", None, 1, 1, "k", "r")]
    return rows + clash + nulls + [rows[5]] * 3 + [(3, rows[3][1].replace("w", "W"), "en", "a", 1, 1, "k", "r")]


def test_quality_stage_equals_a_plain_one(spark, tmp_path):
    rows = odd_rows()
    limit = Q.chi_square(Q.TAIL)
    want = [r for r, (_, base, d2) in zip(rows, plain.verdicts([r[1:4] for r in rows]), strict=True) if not base and (d2 is None or d2 <= limit)]
    assert Counter(stage_rows(spark, "quality rules", rows, tmp_path)) == Counter(want)


def test_near_duplicate_stage_equals_a_plain_one(spark, tmp_path):
    rows = odd_rows()
    distinct = list(dict.fromkeys(rows))
    groups = {}
    for r, root in zip(distinct, plain.components([plain.shingle_set(r[1]) for r in distinct]), strict=True):
        groups.setdefault(root, []).append(r)
    want = Counter(r for r in rows if not plain.shingle_set(r[1]))  # no words: no one's duplicate
    got = Counter(stage_rows(spark, "near duplicates", rows, tmp_path))
    for root, members in groups.items():
        if root is not None:
            least = min(((m[0] is None, m[0] or 0) for m in members))
            kept = [m for m in members if got[m]]
            assert len(kept) == 1 and got[kept[0]] == 1 and (kept[0][0] is None, kept[0][0] or 0) == least
            want[kept[0]] += 1
    assert got == want


def test_passage_stage_equals_a_plain_one(spark, tmp_path):
    shared = "ü€ the same passage in all of them, with a \ufffd inside 😀 and more"
    rows = odd_rows() + [(500 + i, f"\ufffd{chr(233 + i)}{shared}{chr(8364 + i)}\ufffd end", "en", "a", 1, 1, "k", "r") for i in range(5)]
    ids = [(1 << 62 if r[0] is None else r[0], (r[1] or "").encode()) for r in rows]
    want = Counter()
    for r, (_, raw), gone in zip(rows, ids, plain.removed(ids), strict=True):
        text, at = "", 0
        for c in raw.decode():
            n = len(c.encode())
            text += "" if any(gone[at : at + n]) else c
            at += n
        want[(r[0], text, r[2], r[3], len(text), *r[5:])] += 1
    assert Counter(stage_rows(spark, "repeated passages", rows, tmp_path)) == want


def test_mix_stage_meets_its_targets_row_by_row(spark, tmp_path):
    rows = odd_rows()
    got, had = Counter(stage_rows(spark, "source mix", rows, tmp_path)), Counter(rows)
    assert all(n <= 2 * had[r] for r, n in got.items())
    words = lambda r: len((r[1] or "").encode().split())
    sizes, taken = Counter(), Counter()
    for r, n in had.items():
        sizes[r[3]] += n * words(r)
    for r, n in got.items():
        taken[r[3]] += n * words(r)
    for s, target in plain.targets(sizes).items():
        assert abs(taken[s] - target) <= max(words(r) for r in rows)


def test_packing_stage_holds_every_token(spark, tmp_path):
    rows = odd_rows()
    frame = spark.createDataFrame(rows, SCHEMA)
    own, got = P.encoder(P.vocabulary_path()), Counter()
    for x in STAGE["length buckets"](spark, frame, str(tmp_path)).collect():
        got[x.doc_id] += x.n_tokens
    want = Counter()
    for r in rows:
        if r[1]:
            want[r[0]] += len(own.encode_ordinary(r[1]))
    assert got == want


def test_pipeline_over_nothing(spark, tmp_path, empty):
    write(spark, tmp_path, empty)
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_a_query_for_each_operator():
    assert sorted(int(k[2:].split("_")[0]) for k in queries.queries()) == list(range(1, 11))
