"""Differences of words in linear space, read sets as bitmaps, keyed digests and ballots."""

import base64
import hashlib
import hmac
import ipaddress
import random
import tracemalloc

import pytest
from pyspark.sql import functions as F

from daybook.functions import exchange, mac
from daybook.operators import reads


def common(a, b):
    """Length of the longest common subsequence."""
    row = [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for j, y in enumerate(b):
            new.append(row[j] + 1 if x == y else max(row[j + 1], new[j]))
        row = new
    return row[-1]


def test_shortest_scripts_against_the_longest_common_subsequence(monkeypatch):
    r = random.Random(7)
    for trial in range(800):
        monkeypatch.setattr(exchange, "CELLS", 0 if trial % 2 else 4096)  # both ways to settle a piece
        letters = "ab" if r.random() < 0.4 else "abcdef"
        a, b = ([r.choice(letters) for _ in range(r.randint(0, 25))] for _ in range(2))
        script = exchange.shortest_edit(a, b)
        assert [w for k, w in script if k != "added"] == a and [w for k, w in script if k != "removed"] == b
        assert sum(k == "same" for k, _ in script) == common(a, b)


def test_long_texts_in_little_memory():
    r = random.Random(8)
    a = [f"w{r.randrange(3000)}" for _ in range(20000)]
    b = list(a)
    for _ in range(300):
        b[r.randrange(len(b))] = "new"
        del b[r.randrange(len(b))]
    one, other = [f"a{r.randrange(500)}" for _ in range(1400)], [f"a{r.randrange(500)}" for _ in range(4000)]
    tracemalloc.start()
    for x, y in ((a, b), (one, other)):
        script = exchange.shortest_edit(x, y)
        assert [w for k, w in script if k != "added"] == x and [w for k, w in script if k != "removed"] == y
    assert tracemalloc.get_traced_memory()[1] < 60e6
    tracemalloc.stop()


def test_strips_of_any_width(monkeypatch):
    r = random.Random(11)
    for width in (1, 7, 64, 4096):
        monkeypatch.setattr(exchange, "STRIP", width)
        for n, m in ((1, 90), (90, 1), (65, 130), (300, 200)):
            monkeypatch.setattr(exchange, "CELLS", r.choice((0, 4096)))
            a, b = ([f"w{r.randrange(40)}" for _ in range(size)] for size in (n, m))
            script = exchange.shortest_edit(a, b)
            assert [w for k, w in script if k != "added"] == a and [w for k, w in script if k != "removed"] == b
            assert sum(k == "same" for k, _ in script) == common(a, b)


def test_long_texts_are_compared_as_short_ones_are():
    r = random.Random(12)
    for size in (1499, 1500, 1501, 1700):
        a, b = ([f"{side}{i}" if i % 5 == 0 else f"w{r.randrange(200)}" for i in range(size)] for side in "ab")
        runs = exchange.word_diff(" ".join(a), " ".join(b))
        words = {k: [w for x in runs if x["kind"] != k for w in x["text"].split()] for k in ("added", "removed")}
        assert words == {"added": a, "removed": b} and all(x["kind"] != y["kind"] for x, y in zip(runs, runs[1:]))
        assert sum(len(x["text"].split()) for x in runs if x["kind"] == "same") == common(a, b)


def test_turns_of_any_length(spark, tmp_path):
    from daybook.plans import more  # here, as it adds to the registry that other tests go through

    kept = [f"w{i}" for i in range(2000)]
    turns = [(c, t, " ".join([f"{t}start", *kept[:n], f"{t}end"])) for c, n in ((1, 10), (2, 1498), (3, 1499), (4, 2000)) for t in (0, 1)]
    spark.createDataFrame(turns, "conv_id long, turn int, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    got = {tuple(x) for x in more.X25_turn_differences(spark, str(tmp_path)).collect()}
    assert got == {(c, 1, n, 2, 2) for c, n in ((1, 10), (2, 1498), (3, 1499), (4, 2000))}


def test_changed_fields(spark):
    schema = "date_id long, title string, text string, credit string"
    old = spark.createDataFrame([(1, "A", "one two three", None), (2, "B", "same", "x"), (3, "C", "gone", "")], schema)
    new = spark.createDataFrame([(1, "A", "one 2 three", "me"), (2, "B", "same", "x"), (4, "D", "new", "")], schema)
    got = {(r.date_id, r.field): [tuple(x) for x in r["diff"]] for r in exchange.changed_fields(old, new, ("title", "text", "credit")).collect()}
    assert got == {(1, "text"): [("same", "one"), ("removed", "two"), ("added", "2"), ("same", "three")], (1, "credit"): [("added", "me")]}


def test_read_sets(spark):
    r = random.Random(9)
    rows = [(k, r.choice([0, 1, 8, 9, 32767, 32768, 32769, 70000, r.randrange(100000)])) for k in "ab" for _ in range(60)]
    frame = lambda x: spark.createDataFrame(x, "reader string, date_id long")
    sets = reads.merged(reads.read_sets(frame(rows[:70])), reads.read_sets(frame(rows[40:])))
    ids = sorted({x for _, x in rows} | {2, 7, 10, 32766, 99999999})
    entries = spark.createDataFrame([(i, "t") for i in ids], "date_id long, title string")
    for k in ("a", "b", "nobody"):
        mine = {x for q, x in rows if q == k}
        assert {x.date_id for x in reads.unread(entries, sets, k).collect()} == set(ids) - mine
    for at in (0, 1, 7, 8, 9, 32767, 32768, 32769, 65536, 100000):
        got = {x.reader: x.n for x in reads.read_before(sets, at).collect()}
        assert got == {k: len({x for q, x in rows if q == k and x <= at}) for k in "ab"}


#: Published test vectors of the keyed digest (key, data, digest).
VECTORS = (
    ("0b" * 20, "4869205468657265", "b0344c61d8db38535ca8afceaf0bf12b881dc200c9833da726e9376c2e32cff7"),
    ("4a656665", "7768617420646f2079612077616e7420666f72206e6f7468696e673f", "5bdcc146bf60754e6a042426089575c75a003f089d2739839dec58b964ec3843"),
    ("aa" * 20, "dd" * 50, "773ea91e36800e46854db8ebd09181a72959098b3ef8c122d9635514ced565fe"),
    ("0102030405060708090a0b0c0d0e0f10111213141516171819", "cd" * 50, "82558a389a443c0ea4cc819899f2083a85f0faa3e578f8077a2e3ff46729665b"),
    ("aa" * 131, "54657374205573696e67204c6172676572205468616e20426c6f636b2d53697a65204b6579202d2048617368204b6579204669727374", "60e431591ee0b67f0d8a26aacbf5b77f8e0bc6213728c5140546040f0ee37f54"),
)


@pytest.mark.parametrize("vector", VECTORS)
def test_published_vectors(spark, vector):
    key, data, want = (bytes.fromhex(x) for x in vector)
    row = spark.createDataFrame([(bytearray(data),), (None,)], "m binary").select(mac.hmac_sha256(key, F.col("m")).alias("d")).collect()
    assert bytes(row[0].d) == want and row[1].d is None


def test_cohorts(spark):
    given = ["10.1.2.3", "10.1.2.250", "10.1.3.3", "2001:db8:1:2::5", "2001:db8:1:ffff::", "::1", "::", "::ffff:1.2.3.4", "1:2:3:4:5:6:7:8", "1::8:9", "fe80::1:2:3:4:5:6"]
    wrong = ["", "1.2.3", "1.2.3.256", "1.2.3.04", "1:2:3", "g::1", "1::2::3", ":::", "1:2:3:4:5:6:7:8:9", "::1.2.3", None]
    agents = [None, "Mozilla Firefox", "X Edg/1 Chrome", "chrome safari", "Safari", "curl/8", "Python", "a Bot", "?"]
    key = b"secret"
    rows = [(i, a, agents[i % len(agents)]) for i, a in enumerate(given + wrong)]
    got = {r.i: r for r in spark.createDataFrame(rows, "i int, a string, g string").select("i", mac.network(F.col("a")).alias("n"), mac.agent_class(F.col("g")).alias("c"), mac.cohort(key, F.col("a"), F.col("g")).alias("h")).collect()}
    for i, a, g in rows:
        if a not in given:
            assert got[i].n is None and got[i].h is None, a
            continue
        raw = ipaddress.ip_address(a).packed
        keep = 3 if len(raw) == 4 else 6
        network = raw[:keep] + bytes(len(raw) - keep)
        told = "none" if g is None else next((n for x, n in mac.CLASSES if x in g.lower()), "other")
        assert (bytes(got[i].n), got[i].c) == (network, told)
        assert bytes(got[i].h) == hmac.new(key, network + b"|" + told.encode(), hashlib.sha256).digest()[:8]


def test_ballots(spark):
    key = b"a key"
    rows = [("beautiful", 0, -3, None, False, 1_700_000_000_123, 2**63 - 1), ("fascinating", 11000, 2**31 - 1, bytearray(range(16)), True, 0, -5), ("beautiful", 1, 2, bytearray(16), True, 5, 7)]
    frame = spark.createDataFrame(rows, "category string, left int, right int, voter binary, probe boolean, issued_ms long, nonce long")
    names = frame.columns
    tokens = frame.select("*", mac.signed(key, mac.ballot_body(*map(F.col, names))).alias("token"))
    tokens = [(r.token, tuple(r)[:7]) for r in tokens.collect()]
    for token, row in tokens:
        raw = base64.urlsafe_b64decode(token + "=" * (-len(token) % 4))
        body, tag = raw[:-16], raw[-16:]
        assert hmac.new(key, body, hashlib.sha256).digest()[:16] == tag and len(body) == 27 + 16 * (row[3] is not None)
        assert body[3:7] == row[1].to_bytes(4, "big", signed=True) and body[11:19] == row[5].to_bytes(8, "big")
    flip = lambda t: t[:-1] + ("A" if t[-1] != "A" else "B")
    wrong = [flip(tokens[0][0])[:-1] + "x", "", "abc", "!!", tokens[0][0][:-4], tokens[1][0][4:], None, "A" * 60, tokens[0][0] + "A"]
    frame = spark.createDataFrame([(t,) for t, _ in tokens] + [(w,) for w in wrong], "t string")
    got = [r.o for r in frame.select(mac.opened(key, F.col("t")).alias("o")).collect()]
    for (_, row), o in zip(tokens, got, strict=False):
        assert tuple(o) == row
    assert got[len(tokens) :] == [None] * len(wrong)
    other = frame.select(mac.opened(b"another", F.col("t")).alias("o")).collect()
    assert all(r.o is None for r in other)
    ages = spark.createDataFrame([(a,) for a in (-60_001, -60_000, 0, 5000, 5001)], "age long").select(mac.fresh(F.lit(0).cast("long"), F.col("age"), 5000).alias("f"))
    assert [r.f for r in ages.collect()] == [False, True, True, True, False]


def test_read_sets_have_narrow_rows(spark):
    ids = [0, 1, 62, 63, 64, 127, 128, 500, 32767, 32768, 1 << 40]
    sets = reads.read_sets(spark.createDataFrame([(1, i) for i in ids] + [(2, 9000)], "reader long, date_id long"))
    assert sets.schema["bitmap"].dataType.simpleString() == "bigint"
    for at in ids:
        assert {x.reader: x.n for x in reads.read_before(sets, at).collect()} == {1: sum(i <= at for i in ids), 2: int(at >= 9000)}
    entries = spark.createDataFrame([(i,) for i in [*ids, 2, 65, 129]], "date_id long")
    assert sorted(x.date_id for x in reads.unread(entries, sets, 1).collect()) == [2, 65, 129]
