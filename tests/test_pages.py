"""Archived pages read as entries, each decision on a small page."""

import pytest
from pyspark.sql import functions as F

from daybook.sources import pages

BASE = "https://example.org/sky/2024.html"
FULL = """<html><head><title>Sky Page: 2024 - A Small Nebula</title><meta name="Keywords" content="nebula, dust ,Nebula,,star  birth">
<script>var explanation: 1;</script></head><body><center><h1>Astronomy Picture of the Day</h1><a href="image/2024/big.jpg"><img src="image/2024/small.jpg"></a></center>
<center><b> A Small   Nebula </b><br><b>Image Credit &amp; <a href="https://creativecommons.org/licenses/by/4.0/">Copyright</a>:</b> <a href="/people/ann">Ann &lt;Lee&gt;</a>; Processing: Bo</center>
<p><b> Explanation: </b> What <i>is <a href="mailto:x@y.org">this</a></i>? Dust &amp; gas.<p><center><b>Tomorrow's picture:</b> <a href="x.html">open space</a> <hr> <b>Authors &amp; editors:</b> N</center></body></html>"""


def read(spark, *markup):
    rows = spark.createDataFrame([(i, BASE, m, f"t{i}") for i, m in enumerate(markup)], "page_id long, url string, html string, extra string")
    return pages.parse_pages(rows).orderBy("page_id").collect()


def test_full_page(spark):
    (r,) = read(spark, FULL)
    assert (r.title, r.title_raw, r.extra) == ("A Small Nebula", "Sky Page: 2024 - A Small Nebula", "t0")
    assert r.explanation_text == "What is this? Dust & gas."
    assert r.explanation_html == 'What <i>is <a href="mailto:x@y.org">this</a></i>? Dust &amp; gas.'
    assert [(c.role, c.text, c.html) for c in r.credits] == [
        ("Image Credit & Copyright", "Ann <Lee>", '<a href="https://example.org/people/ann">Ann &lt;Lee&gt;</a>'),
        ("Processing", "Bo", "Bo"),
    ]
    assert (r.has_copyright, r.attributed, r.license_url) == (True, True, "https://creativecommons.org/licenses/by/4.0/")
    assert (r.teaser, r.keywords) == ("open space", ["nebula", "dust", "star birth"])
    assert [tuple(m) for m in r.media] == [("jpg", "https://example.org/sky/image/2024/small.jpg", "https://example.org/sky/image/2024/big.jpg")]


def test_odd_pages(spark):
    odd = ["", None, "<p>Explanation: a &lt; b <center>c</center>", "<title>x</title><b>Explanation:</b> one<br>two", "plain", "<p>Explanation: " + "long text " * 20_000]
    empty, null, one, two, plain, long = read(spark, *odd)
    assert (empty.title, empty.explanation_text, empty.credits, empty.media) == (None, None, [], [])
    assert null.title is None and null.explanation_text is None
    assert one.explanation_text == "a < b" and one.explanation_html == "a &lt; b"
    assert (two.title, two.explanation_text, two.explanation_html) == ("x", "one two", "one<br> two")
    assert plain.attributed is False and len(long.explanation_text) == 199_999
    assert read(spark, *[FULL] * 0) == [] and len({str(r[4:]) for r in read(spark, FULL, FULL)}) == 1


def test_unlabelled_credit_follows_the_title(spark):
    short, long = read(spark, "<center><b>Night Sky</b><br>Courtesy Jo Ray</center><p>Explanation: x", "<center><b>Night Sky</b><br>" + "word " * 80 + "</center><p>Explanation: x")
    assert [(c.role, c.text) for c in short.credits] == [("Courtesy", "Jo Ray")] and long.credits == []


def test_media(spark):
    markup = [
        '<iframe src="https://www.youtube.com/embed/abc"></iframe><img src="a.PNG?x=1">',
        '<video><source src="v.mp4"></video>',
        '<object><param name="movie" value="m.swf"><embed src="e.swf"></object>',
        '<object><param name="movie" value="m.swf"></object>',
        '<blockquote class="twitter-tweet"><a href="https://t.example/a/status/1?s=2">t</a></blockquote>',
    ]
    got = [[(m.kind, m.url.rsplit("/", 1)[1], m.hd) for m in r.media] for r in read(spark, *markup)]
    assert got == [[("youtube", "abc", None), ("png", "a.PNG?x=1", None)], [("mp4", "v.mp4", None)], [("embed", "e.swf", None)], [("embed", "m.swf", None)], [("embed", "1", None)]]


@pytest.mark.parametrize(
    ("data", "text"),
    [
        (b"\xef\xbb\xbfa\xc3\xa9", "aé"), ("aé".encode("utf-16"), "aé"), ("é".encode(), "é"), (b"\xe9\x93a\x81", "é“a\x81"), (b"<meta charset='koi8-r'>\xc1", "<meta charset='koi8-r'>а"),
        (b"<meta charset=latin1>\x93", "<meta charset=latin1>“"), (b"charset=utf-8 \xff", "charset=utf-8 �"), (b"charset=nonsense \xe9", "charset=nonsense é"), (b"", ""),
    ],
)
def test_decoding(data, text):
    assert pages.decoded(data) == text


def test_decoding_column(spark):
    rows = spark.createDataFrame([(bytearray(b"\xe9"),), (None,)], "content binary").select(pages.decode_html(F.col("content")).alias("t"))
    assert {r.t for r in rows.collect()} == {"é", None}
