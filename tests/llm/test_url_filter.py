"""The URL filter against plain sets, and the cascade's bits against its size."""

import random

import numpy as np
import pytest

from daybook.llm import queries
from daybook.llm import url_filter as U

SCHEMA = "page_id long, url string, html string, listed int, _keys string"
ODD = [None, "", "no scheme", "://", "http://", "http:///path", "HTTP://Www.ADS.Example.NET", "http://net", "http://net/", "http://a.net?x=/en/", "x://y://z/q",
       "http://example.net/en/", "http://example.netx/en/", "http://b.example.net/en/1#t", "http://B.Example.Com/de/2?q", "http://example.com/DE/", "http://r.org/fr/",
       "http://user@x.net/", "http://x.net:80/", "http://İ.org/fr/x", "http://a..b.com/", "http://a.b.com./\n/c", "http://adult-x.example.com/fr/", "http://m.free-bets.org/en/",
       "http://badspam.com/", "http://x-spam.y.com/", "ftp://org/fr/ /é"]


def plain(url, listed):
    host = path = ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        at = min([rest.find(c) for c in "/?#" if c in rest] or [len(rest)])
        host, rest = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in rest[:at]), rest[at:]
        path = rest[: min([rest.find(c) for c in "?#" if c in rest] or [len(rest)])]
    fits = [(len(h + p), h + p, how) for how, h, p in U.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    if fits:
        return host, path, max(fits)[1], max(fits)[2]
    labels = host.split(".")
    keys = {".".join(labels[i:]) for i in range(len(labels))} | {host + (path or "/")} if host else set()
    return host, path, None, "block" if keys & listed else "allow"


def rows_of(urls):
    return [(i, u, "<p>", 7, "k") for i, u in enumerate(urls)]


def urls(n=900, seed=2):
    r = random.Random(seed)
    names = [f"h{i}" for i in range(80)] + ["ads-track", "spam-farm", "casino"]
    return ODD + [f"{r.choice(['http', 'https'])}://{r.choice(['', 'www.', 'm.a.'])}{r.choice(names)}.example.{r.choice(['net', 'com', 'org'])}/{r.choice(['en', 'de', 'fr'])}/{r.randrange(400)}{r.choice(['', '?u=1', '#t', '/'])}" for _ in range(n)] + ["http://hot.com/x"] * 200


@pytest.mark.parametrize("limit", [U.BROADCAST_BYTES, 0])
def test_equal_to_plain_sets(spark, limit):
    all_urls = urls()
    listed = {f"h{i}.example.{t}" for i in range(0, 80, 3) for t in ("com", "org")} | {"hot.com/x", "not.there", "h1.example.com/en/7", "b.com"}
    frame = spark.createDataFrame(rows_of(all_urls), SCHEMA).repartition(3)
    out = U.judge(frame, spark.createDataFrame([(k,) for k in [*listed, "not.there"]], "key string"), limit=limit)
    assert set(out.columns) == {"page_id", "url", "html", "_keys", "host", "path", "rule", "verdict", "listed"}
    got = out.collect()
    assert len(got) == len(all_urls)
    for x in got:
        assert (x.host, x.path, x.rule, x.verdict) == plain(x.url, listed), x.url
        assert x["_keys"] == "k"
    assert {x.verdict for x in got if x.rule is None} == {"allow", "block"}


def test_listed_words(spark):
    found = {r.key for r in U.listed_domains(spark.createDataFrame(rows_of(ODD), SCHEMA)).collect()}
    assert found == {"ads.example.net", "adult-x.example.com", "free-bets.org", "x-spam.y.com"}


def test_equal_to_sql(spark, tmp_path):
    import duckdb

    frame = spark.createDataFrame(rows_of(urls()), SCHEMA).select("page_id", "url", "html")
    frame.toPandas().to_parquet(tmp_path / "pages.parquet")
    con = duckdb.connect()
    con.sql(f"create view pages as select * from '{tmp_path}/pages.parquet'")
    want = con.sql(queries.oracle_sql()["op11_url_filter"]).df()
    got = queries.op11_url_filter(spark, str(tmp_path)).toPandas()[list(want.columns)]
    assert sorted(map(str, got.itertuples(index=False))) == sorted(map(str, want.itertuples(index=False)))


def test_empty(spark):
    none = spark.createDataFrame([], SCHEMA)
    keys = spark.createDataFrame([("a.com",)], "key string")
    assert U.judge(none).count() == 0 and U.judge(none, keys, limit=0).count() == 0
    some = spark.createDataFrame(rows_of(["http://a.com/", "http://b.a.com"]), SCHEMA)
    assert [r.verdict for r in U.judge(some, keys.limit(0)).collect()] == ["allow"] * 2
    assert [r.verdict for r in U.judge(some, keys).collect()] == ["block"] * 2


@pytest.mark.parametrize("shares", [(0, 500), (1, 0), (40, 40_000), (5_000, 5_000), (9_000, 30)])
def test_cascade_is_exact_and_small(shares):
    r = np.random.default_rng(sum(shares))
    keys = r.integers(0, 2**63, (sum(shares), 2)).astype(np.uint64)
    listed, others = keys[: shares[0]], keys[shares[0] :]
    levels = U.cascade(listed, others)
    assert U.listed_in(levels, listed).all() and not U.listed_in(levels, others).any()
    bits = sum(x.bits for x in levels)
    few, many = sorted(shares)
    assert bits <= 200 + 2.5 * shares[0] * (6 + np.log2(1 + many / max(1, few)))
