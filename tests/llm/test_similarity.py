"""SimHash, near-duplicates and repeated passages against brute force."""

import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from daybook.llm import near_dedup as N
from daybook.llm import simhash as S
from daybook.llm import suffix_dedup as D
from tests.llm import plain


def test_next_edits(docs):
    rows = [(x.doc_id, x.text or "") for x in docs.select("doc_id", "text").collect()]
    got = S.next_edits(docs).toPandas()
    assert len(got) == len(rows)
    once = [k for k, n in Counter(i for i, _ in rows).items() if n == 1 and k is not None]
    by = dict(rows)
    found = got[got.doc_id.isin(once)].set_index("doc_id")
    for k in once:
        after = k + 1
        if after not in once:
            continue
        t, f = by[k], by[after]
        h = len(t) // 2
        assert found.edited_sha256[k] == hashlib.sha256((t[: len(t) - h] + f[:h]).encode()).hexdigest()
        assert found.near_next[k] == S.likeness(int(found.fingerprint[k], 16), int(found.fingerprint[after], 16))
    # the last row (null ids come last) is followed by the first
    end = got[got.doc_id.isna()].iloc[0]
    t, f = by[None], by[0]
    h = len(t) // 2
    assert end.edited_sha256 == hashlib.sha256((t[: len(t) - h] + f[:h]).encode()).hexdigest()


def test_likeness_follows_the_share_of_common_terms():
    words = [f"v{i}" for i in range(2000)]
    whole = S.fingerprint(S.term_hashes(" ".join(words), {}))
    other = S.fingerprint(S.term_hashes(" ".join(f"u{i}" for i in range(2000)), {}))
    close = S.fingerprint(S.term_hashes(" ".join(words[:1990] + ["q"] * 10), {}))
    assert S.likeness(whole, close) > 0.9 > 0.75 > S.likeness(whole, other)


def plain_fingerprint(text):
    words = text.encode().split()
    n = min(3, len(words))
    terms = Counter(tuple(words[i : i + n]) for i in range(len(words) - n + 1)) if n else {}
    votes = [0] * 64
    for term, count in terms.items():
        h = int(S.term_hashes(b" ".join(term).decode(), {})[0])
        for k in range(64):
            votes[k] += count.bit_length() * (1 if h >> k & 1 else -1)
    return sum(1 << k for k in range(64) if votes[k] > 0)


def test_fingerprints_equal_a_plain_vote(docs):
    rows = [(x.doc_id, x.text or "") for x in docs.select("doc_id", "text").collect()]
    short = [t for _, t in rows if len(t) < 3000]
    assert [S.fingerprint(S.term_hashes(t, {})) for t in short] == [plain_fingerprint(t) for t in short]
    got = S.fingerprinted(docs).collect()
    by = {}
    for i, t in rows:
        by.setdefault(i, []).append(t)
    prints = {S.fingerprint(S.term_hashes(t, {})) for _, t in rows}
    for x in got:
        own = int(x.fingerprint, 16)
        assert any(len(t) == x.n_chars and own == S.fingerprint(S.term_hashes(t, {})) for t in by[x.doc_id])
        assert x.n_near == sum(0 < (own ^ p).bit_count() <= S.RADIUS for p in prints)
        assert x.near_edited == 1 - (own ^ int(x.edited_fingerprint, 16)).bit_count() / 64
    once = {i: t[0] for i, t in by.items() if len(t) == 1 and i is not None}
    for x in got:
        if x.doc_id in once and x.doc_id + 1 in once:
            t, f = once[x.doc_id], once[x.doc_id + 1]
            h = len(t) // 2
            assert int(x.edited_fingerprint, 16) == S.fingerprint(S.term_hashes(t[: len(t) - h] + f[:h], {}))


@pytest.mark.parametrize(("radius", "blocks", "part"), [(0, 2, 4096), (3, 6, 4096), (2, 4, 4096), (3, 6, 7)])
def test_block_tables_find_all_near_fingerprints(spark, monkeypatch, radius, blocks, part):
    monkeypatch.setattr(S, "PART_CLASSES", part)
    r = random.Random(3)
    prints = [r.getrandbits(64) for _ in range(60)]
    for x in prints[:30]:
        for _ in range(3):
            y = x
            for b in r.sample(range(64), r.randint(0, 5)):
                y ^= 1 << b
            prints.append(y)
    for _ in range(80):  # a crowd around one of them
        prints.append(prints[0] ^ (1 << r.randrange(64)) ^ (1 << r.randrange(64)))
    distinct = sorted({S._signed(x) for x in prints})
    classes = spark.createDataFrame([(x,) for x in distinct], "class long")
    want = {(a, b, n) for i, a in enumerate(distinct) for b in distinct[i + 1 :] if (n := ((a ^ b) & (2**64 - 1)).bit_count()) <= radius}
    got = [tuple(x) for x in S.near_pairs(classes, radius=radius, blocks=blocks).collect()]
    assert len(got) == len(set(got)) and set(got) == want
    counts = Counter(x for a, b, _ in want for x in (a, b))
    assert {tuple(x) for x in S.near_counts(classes, radius=radius, blocks=blocks).collect()} == set(counts.items())


shingle_set = plain.shingle_set


def test_near_duplicates(docs):
    rows = [(x.doc_id, shingle_set(x.text)) for x in docs.select("doc_id", "text").collect()]
    ids = sorted({i for i, _ in rows if i is not None})
    parent = {i: i for i in ids}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    real = [(i, s) for i, s in rows if i is not None and s]
    for k, (i, a) in enumerate(real):
        for j, b in real[:k]:
            if 100 * len(a & b) >= 75 * len(a | b):
                parent[max(find(i), find(j))] = min(find(i), find(j))
    want = Counter((i, len(s), None if i is None else find(i)) for i, s in rows)
    got = N.near_duplicates(docs).collect()
    assert Counter((x.doc_id, x.n_shingles, x.component_id) for x in got) == want
    assert all(x.kept == (x.doc_id is None or x.component_id == x.doc_id) for x in got)


def test_large_family_of_near_copies(spark):
    r = random.Random(7)
    core = [f"c{i}" for i in range(120)]
    rows = []
    for i in range(150):
        words = list(core)
        for _ in range(r.randint(0, 9)):
            words[r.randrange(120)] = f"e{r.getrandbits(30)}"
        rows.append((i, " ".join(words)))
    got = {x.doc_id: x.component_id for x in N.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    sets = [shingle_set(t) for _, t in rows]
    label = list(range(150))
    for _ in range(150):
        before = list(label)
        for i in range(150):
            for j in range(i):
                if 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j]):
                    label[i] = label[j] = min(label[i], label[j])
        if before == label:
            break
    assert got == dict(enumerate(label))


def test_registers_merge():
    r = np.random.default_rng(4)
    a, b = (r.integers(0, 1 << 63, 400).astype(np.uint64) for _ in range(2))
    assert (np.maximum(N.sketch(a), N.sketch(b)) == N.sketch(np.union1d(a, b))).all()


def plain_removal(rows, length=50):
    out = []
    for (i, t), gone in zip(rows, plain.removed(rows, length), strict=True):
        kept = bytes(c for c, g in zip(t, gone, strict=True) if not g)
        out.append((i, len(t), sum(gone), sum(g and not (k and gone[k - 1]) for k, g in enumerate(gone)), hashlib.sha256(kept).hexdigest()))
    return Counter(out)


def holds(frame, length=50, **options):
    none = 1 << 62
    rows = [(none if x.doc_id is None else x.doc_id, (x.text or "").encode()) for x in frame.select("doc_id", "text").collect()]
    got = D.remove_repeats(frame, length=length, **options).collect()
    assert Counter((none if x.doc_id is None else x.doc_id, x.n_bytes, x.n_removed, x.n_spans, x.kept_sha256) for x in got) == plain_removal(rows, length)


def test_repeated_passages(docs):
    holds(docs)


def test_passages_that_overlap_in_part(spark, monkeypatch):
    """Texts of few letters and periodic texts: anchors repeat, stretches differ by where they begin and end."""
    r = random.Random(11)
    base = "".join(r.choice("ab") for _ in range(400))
    rows = []
    for i in range(120):
        a = r.randrange(300)
        cut = base[a : a + r.randint(40, 100)]
        rows.append((i, "".join(r.choice("ab") for _ in range(r.randint(0, 30))) + cut + "".join(r.choice("abc") for _ in range(r.randint(0, 30)))))
    rows += [(200 + i, ("xy" * 40)[i % 3 : 40 + 7 * i % 60]) for i in range(20)] + [(300 + i, "z" * (45 + i)) for i in range(12)]
    rows += [(400 + i, "\0" * (48 + i) + "q" * i + "\0" * 60) for i in range(8)]
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    holds(frame, chunk_bytes=1500)
    holds(frame, length=20)
    monkeypatch.setattr(D, "SETTLE", 7)
    holds(frame, chunk_bytes=1500)


def phrase_rows(n):
    r = random.Random(12)
    phrase, letters = "under the terms of this licence only ", "abcdefghijklmnopqrstuvwxyz "
    fill = lambda k: "".join(r.choice(letters) for _ in range(k))
    rows = [(i, fill(60) + phrase + fill(60)) for i in range(n)]
    return rows + [(n + i, rows[i][1][20:120] + fill(9)) for i in range(0, n, 50)]


def test_crowded_anchors_are_cut_into_windows(spark, monkeypatch):
    """One phrase in thousands of contexts; some of them occur twice."""
    monkeypatch.setattr(D, "CROWD", 50)
    holds(spark.createDataFrame(phrase_rows(3000), "doc_id long, text string").repartition(4), chunk_bytes=40_000)


def test_a_crowded_anchor_is_found(spark):
    rows = phrase_rows(1500)
    texts = [t.encode() for _, t in rows]
    c = D._Chunk({"chunk": 0, "data": b"".join(texts), "ids": [i for i, _ in rows], "sizes": [len(t) for t in texts]}, 50)
    key, several, often, number = c.anchors()
    at = int(np.bincount(number).argmax())
    assert several[at] and often[at] == 255 and int(c.sketch(number, len(key))[at]).bit_count() == 4


def test_characters_that_lose_a_byte_go_as_a_whole():
    text = "aé€😀b\ufffd"
    raw = np.frombuffer(text.encode(), np.uint8)
    for k in range(len(raw)):
        gone = np.zeros(len(raw), bool)
        gone[k] = True
        kept = raw[~D.whole_characters(raw, gone)].tobytes().decode()
        assert len(kept) == len(text) - 1 and kept in {text[:i] + text[i + 1 :] for i in range(len(text))}


def test_lengths_that_front_coding_cannot_hold_are_refused(empty):
    for length in (15, 131):
        with pytest.raises(ValueError, match="16 to 130"):
            D.remove_repeats(empty, length=length)


def test_empty_tables(empty):
    assert S.fingerprinted(empty).count() == N.near_duplicates(empty).count() == D.remove_repeats(empty).count() == 0
