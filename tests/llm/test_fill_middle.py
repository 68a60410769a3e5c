"""Fill-in-the-middle against a plain version."""

import hashlib
import random
import re

import numpy as np
from pyspark.sql import functions as F

from daybook.llm import fill_middle as M

UNIT = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")


def plain(key, text, seed=42):
    text = text or ""
    units = UNIT.findall(text)
    n = len(units)
    digest = hashlib.sha256(f"{seed}:{'' if key is None else key}".encode()).hexdigest()
    h = [int(digest[8 * i : 8 * i + 8], 16) for i in range(4)]
    if not text or any(m in text for m in M.MARKS) or h[2] % 100 >= 50:
        return n, "plain", None, None, text
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if h[3] % 100 < 80:
        return n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


def test_equal_to_plain_cuts(docs):
    kept = [c for c in docs.columns if c not in M.COLUMNS]
    out = M.transformed(docs)
    assert out.columns == [*kept, *M.COLUMNS]
    rows = out.withColumn("back", M.restored(F.col("output"), F.col("form"))).collect()
    assert len(rows) == docs.count()
    for r in rows:
        assert (r.n, r.form, r.prefix_chars, r.middle_chars, r.output) == plain(r.doc_id, r.text)
        assert r.back == (r.text or "")
    assert {r.form for r in rows} == {"plain", "spm", "psm"}
    assert sorted(map(str, out.select(*kept).collect())) == sorted(map(str, docs.select(*kept).collect()))


def test_odd_texts(spark):
    r = random.Random(3)
    pieces = ["a", " ", "\n", "\x0b", "é", "𝄞", "<", "P", ">", "S>", "<M", "<S", "  ", "一", " ", "\x00"]
    texts = ["".join(r.choice(pieces) for _ in range(r.randint(0, 12))) for _ in range(600)] + ["<P> held", "x<M>y", "x" * 3_000_000 + " y"]
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    for x in M.digests(frame).collect():
        n, form, head, middle, output = plain(x.doc_id, texts[x.doc_id])
        assert (x.n, x.form, x.prefix_chars, x.middle_chars) == (n, form, head, middle)
        assert x.output_sha256 == sha(output) and x.restored_sha256 == sha(texts[x.doc_id])


def test_empty_table(empty):
    assert M.digests(empty).count() == 0 and M.transformed(empty).columns[-1] == "output"


def test_runs_of_single_characters():
    """Characters of class EACH are units of their own: places come from arithmetic inside the run."""
    classes = np.where(np.arange(256) < 0x80, M._CLASS, M.EACH).astype(np.uint8)
    unit = re.compile(rb"[\x20\x09-\x0D]*(?:[\x80-\xff]|[^\x20\x09-\x0D\x80-\xff]+)|[\x20\x09-\x0D]+")
    r = random.Random(8)
    texts = ["".join(r.choice(["ab", "c", " ", "\n ", "é", "ß"]) for _ in range(r.randint(0, 14))).encode("latin-1") for _ in range(300)]
    data, offsets = np.frombuffer(b"".join(texts), np.uint8), np.cumsum([0, *map(len, texts)])
    runs = M.Runs.of(data, offsets, classes)
    assert runs.counts().tolist() == [len(unit.findall(t)) for t in texts]
    for i, t in enumerate(texts):
        units = unit.findall(t)
        for c in range(len(units) + 1):
            place = runs.places(np.array([i]), np.array([c]), offsets)[0] - offsets[i]
            assert place == len(b"".join(units[:c])), (t, c)


def test_another_seed_and_rate(spark):
    frame = spark.range(400).select(F.col("id").alias("doc_id"), F.lit("one two three four").alias("text"))
    forms = {r.form: r["count"] for r in M.transformed(frame, seed=7, cut=100, spm=0).groupBy("form").count().collect()}
    assert forms == {"psm": 400}
