import math

import pytest
from pyspark.sql import functions as F

from corpuscle.functions import dates, distributions, html, text


def one(spark, value, expr, kind="string"):
    return spark.createDataFrame([(value,)], f"v {kind}").select(expr.alias("r")).first()[0]


@pytest.mark.parametrize("value,want", [(None, 0), ("", 0), ("   ", 0), ("a b\tc\nd", 4), (" a　b\xa0c ", 3)])
def test_word_count(spark, value, want):
    assert one(spark, value, text.word_count("v")) == want


@pytest.mark.parametrize(
    "value,want",
    [
        ("Only seven words are in this one.", "too_short"),
        ("This one has a link https://x.example in the text here", "junk_fragment"),
        ("The GDP grew by two percent in the last year alone", "off_topic"),
        ("Nothing of the topic is in this sentence at all", "no_ai_relevance"),
        ("The models are many and none of them counts here", "no_ai_relevance"),  # plurals do not match
        ("The model is one of them and it counts here", ""),
        ("See https://x.example where GDP grew in the last year", "junk_fragment"),  # first reason wins
        ("éAI is no match for the word in this sentence", "no_ai_relevance"),
    ],
)
def test_cascade(spark, value, want):
    assert one(spark, value, text.filter_reason("v", text.word_count("v"))) == want


@pytest.mark.parametrize("value,bit,half", [("1", 1, 1), ("1.0", 1, 1), ("", 0, 0), ("None", 0, 0), ("nan", 0, 0), ("x", 0, 0), ("0.5", 0, 1), ("2", 2, 1), (None, 0, 0)])
def test_cells(spark, value, bit, half):
    assert one(spark, value, text.to_bit("v")) == bit
    assert one(spark, value, text.to_bit_half("v")) == half


def test_sentences_keep_the_text(spark):
    t = "One is here. Two is here!  Three?\nFour"
    s = one(spark, t, text.sentences("v"))
    assert s == ["One is here.", "Two is here!", "Three?", "Four"]
    assert "".join(s).replace(" ", "") == t.replace(" ", "").replace("\n", "")


@pytest.mark.parametrize("value,want", [(None, 0), ("", 0), ("unknown", 0), ("2022-11-29", 0), ("2022-11-30", 1), ("zzz", 1)])
def test_break_flag(spark, value, want):
    assert one(spark, value, dates.after_break("v")) == want


def test_dates(spark):
    assert one(spark, "20240317101112", dates.compact_day("v")) == "2024-03-17"
    assert one(spark, "https://a.example/2024/03/17/x", dates.path_day(F.col("v"))) == "2024-03-17"
    assert one(spark, "on 17 March 2024", dates.written_day(F.col("v"))) == "2024-03-17"
    assert one(spark, "on Mar 7, 2024", dates.written_day(F.col("v"))) == "2024-03-07"
    assert one(spark, "1700000000", dates.unix_day("v")) == "2023-11-14"


PAGE = """<html><head><title>A &amp; B</title><meta property="article:published_time" content="2024-05-06T07:08:09Z"></head>
<body><nav>Menu <a href="/a/?q=1#x">A</a></nav><div class="post-content"><p>Main <b>text</b></p><script>var x;</script></div><footer>Foot</footer>
<a href="http://b.example/p/">B</a><a href="mailto:x@y.example">M</a><a href="c">C</a></body></html>"""


def test_pages(spark):
    df = spark.createDataFrame([("https://www.a.example/d/e", PAGE)], "url string, html string")
    assert {r.link for r in html.links(df).collect()} == {"https://www.a.example/a", "https://b.example/p", "https://www.a.example/d/c"}
    r = df.select(html.main_text("html").alias("m"), html.page_date("html", "url").alias("d"), html.host("url").alias("h"), html.blocked(F.col("url"), ["example.com", "a.example"]).alias("b")).first()
    assert (r.m, r.d, r.h, r.b) == ("Main text", "2024-05-06", "a.example", True)
    assert one(spark, "<p>no date</p>", html.page_date("v")) == "unknown"


def test_main_element_is_the_first_of_its_kind():
    page = '<body><div class="sidebar contents">no</div><nav><article>menu</article></nav><div class="x"><article><p>One</p> <p>two  b</p><article>inner</article></article></div><article>teaser card</article><main>m</main></body>'
    assert html.extract(page) == "One two b inner"
    assert html.extract('<div class="a post-body">p</div><div class="body">q</div><p>r</p>') == "p"
    assert html.extract('<article></article><main>m</main>') == "" and html.extract("<p>a</p>b") == "a b" and html.extract(None) is None
    assert html.extract('<body>x<div data-purpose="transcript-body">said <b>so</b>\n twice</div></body>', (*html.TRANSCRIPT, *html.MAIN)) == "said so twice"


def test_transcript_text(spark):
    rows = [('<body>x<div class="talk-transcript">said  <b>so</b>\n</div></body>',), ("<main>y</main>",), (None,)]
    df = spark.createDataFrame(rows, "h string").coalesce(1)
    assert [r.t for r in df.select(html.transcript_text("h").alias("t")).collect()] == ["said so", "y", None]


def test_indexes(spark):
    xml = "<urlset><url><loc>https://a.example/post/1</loc></url><url><loc> https://a.example/about </loc></url></urlset>"
    assert one(spark, xml, html.sitemap("v", "/post/")) == ["https://a.example/post/1"]
    assert one(spark, '{"total": 7}', html.paged_total("v")) == 7 and one(spark, '{"total": {"value": 9}}', html.paged_total("v")) == 9
    assert one(spark, "http://x.example/abs/1234v2", html.preprint_id(F.col("v"))) == "http://x.example/abs/1234"


def test_exhibit(spark):
    page = '<table><tr><td>1</td><td>10-Q</td><td><a href="/a.htm">a</a></td></tr><tr><td>2</td><td>EX-99.1</td><td><a href="/b.htm">b</a></td></tr></table>'
    assert one(spark, page, html.exhibit("v")) == "/b.htm" and one(spark, "<tr></tr>", html.exhibit("v")) is None


def test_distributions():
    assert distributions.t_two_sided(2.228138852, 10) == pytest.approx(0.05, abs=1e-8)
    assert distributions.f_upper(3.49282848, 2, 20) == pytest.approx(0.05, abs=1e-7)
    assert distributions.t_quantile(0.975, 30) == pytest.approx(2.04227246, abs=1e-6)
    assert math.isclose(distributions.f_upper(4.0, 1, 12), distributions.t_two_sided(2.0, 12))
