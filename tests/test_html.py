import random
import time

import pytest
from plans import count
from pyspark.sql import functions as F

from gleaner.functions.html import joined, select_page, select_text
from gleaner.operators.profiles import profile_country, profiles_in_countries

WANTED = {"x": ("span", "country-name")}

PAGES = [
    ('<span class="country-name">A <b>b</b>&amp;c</span>', ["A b&c"]),
    ('<span class="country-name big">x</span>', []),
    ('<div class="country-name">x</div>', []),
    ("<SPAN CLASS=Country-Name>x<script>var y</script><br>z", ["x z"]),
    ('<span class="country&#45;name">q</span>', ["q"]),
    ("<p>a<p><span class=country-name>x<div>y</div>z</span>", ["x"]),
    ("<span class=country-name>o<span class=country-name>i</span>k</span>", ["oik", "i"]),
    ("<span class='country-name'/>t</span> after", ["t"]),
    ("<!-- <span class='country-name'>no</span> -->", []),
    ("<script>'<span class=\"country-name\">no</span>'</script>", []),
    ("<span class='country-name'> \n </span>", [""]),
    ("<span class='country-name'>a<img><hr>b", ["a b"]),
    ("</span></div><span class='country-name'>a</p>b</span>", ["ab"]),
    ("<![foo[ x><span class='country-name'>a</span>", ["a"]),
    ("<span class='country-name'>a<![CDATA[b<c]]></span>", ["ab<c"]),
    ("<span class='country-name'>a<![CDATA[b", ["ab"]),
    ("<span class='country-name'>a<!-- b <b>c</b>", ["a"]),
    ("<span class='country-name'>a<b title='x", ["a"]),
    ("<span class='country-name'>a</b", ["a"]),
    ("<span class='country-name", []),
    ("<span class='country-name'>a < b & c<", ["a < b & c<"]),
    ("<span class='country-name'>a<!bad x>b<?php y?>c</span>", ["abc"]),
    ("plain text", []),
    ("", []),
]


@pytest.mark.parametrize(("html", "texts"), PAGES)
def test_select_page(html, texts):
    assert select_page(html, WANTED) == {"x": texts}


@pytest.mark.parametrize(
    ("tag", "html", "texts"),
    [
        ("li", "<ul><li class=c>Ger<li>Other</ul>", ["Ger"]),
        # a block puts a space before its text and none after it
        ("li", "<ul><li class=c>a<ul><li>b</ul>c</ul>", ["a bc"]),
        ("dd", "<dl><dd class=c>a<dt>b</dl>", ["a"]),
        ("td", "<table><tr><td class=c>a<td>b<tr><td>d</table>", ["a"]),
        ("p", "<p class=c>a<p>b", ["a"]),
    ],
)
def test_implied_ends(tag, html, texts):
    assert select_page(html, {"x": (tag, "c")}) == {"x": texts}


def test_classes_with_named_references():
    assert select_page("<b class='a&lowbar;b'>x</b>", {"x": ("b", "a_b")}) == {"x": ["x"]}


def test_any_markup_is_survived():
    rng = random.Random(3)
    pieces = ["<", ">", "</", "<!", "<!--", "-->", "<![", "]]>", "<?", "&", "&#x", "'", '"', "=", " ", "p", "li",
              "<span class='country-name'>", "</span>", "<script>", "</script>", "<td>", "<p>", "<ul>", "<br/>", "\0"]
    for _ in range(3000):
        select_page("".join(rng.choices(pieces, k=rng.randint(1, 25))) + "country-name", WANTED)


@pytest.mark.parametrize(
    "noise",
    [
        "<i>" * 100_000 + "<div></b>" * 50_000,
        "<a b='" * 200_000,
        "<a " * 200_000,
        "</a " * 200_000,
        "<!-- " * 200_000,
        "<![x" * 200_000,
        "<?x " * 200_000,
        "<!x " * 200_000,
        "&#" * 200_000,
        "<" * 200_000,
        "<script>" + "</" * 200_000,
    ],
    ids=lambda noise: noise[:8] + "...",
)
def test_odd_pages_take_linear_time(noise):
    start = time.time()
    found = select_page("<p><table><tr><td><span class=country-name>x</span>" + noise, WANTED)
    assert found == {"x": ["x"]}
    assert time.time() - start < 20


def test_column_form(spark):
    df = spark.createDataFrame([(h,) for h, _ in PAGES] + [(None,)], "html string")
    rows = df.select(select_text(F.col("html"), "span", "country-name").alias("t")).collect()
    assert [r["t"] for r in rows] == [t for _, t in PAGES] + [None]


def test_joined(spark):
    lists = [["a", "b"], ["", "a"], ["a", "", "b"], [], None]
    df = spark.createDataFrame([(v,) for v in lists], "t array<string>")
    assert [r[0] for r in df.select(joined(F.col("t"))).collect()] == ["a b", "a", "a  b", "", ""]


NAME = '<span class="full-name">N</span>'
PROFILES = [
    ("https://www.linkedin.com/in/1", NAME + '<span class="country-name">Spain</span>', "spain"),
    ("https://www.linkedin.com/in/2", NAME + '<span class="locality">Lyon Area, France</span>', "france"),
    ("https://www.linkedin.com/in/3", NAME + '<span class="locality">Lyon,France</span>', "lyon,france"),
    ("https://www.linkedin.com/in/4", NAME, ""),
    ("https://www.linkedin.com/in/5", '<span class="country-name">Spain</span>', None),
    ("https://www.linkedin.com/in/6", '<span class="full-name"> </span>', None),
    ("http://es.LinkedIn.com/7", NAME + '<span class="country-name">Spain</span>', "spain"),
    ("http://viadeo.com/profile/1", '<abbr class="country-name">ITALY</abbr>', "italy"),
    ("http://viadeo.com/profile/2", '<span class="country-name">a</span><abbr class="country-name">b</abbr>', "a"),
    ("http://viadeo.com/profile/3", "", ""),
    ("http://viadeo.com/other/4", '<span class="country-name">a</span>', None),
    ("http://xing.com/profile/1", '<li class="country-name">A</li><li class="country-name">B</li>', "a b"),
    ("http://xing.com/profile/2", '<span class="country-name">a</span>', ""),
    ("http://xing.com/Profile/3", '<li class="country-name">a</li>', None),
    ("http://other.com/profile/1", '<li class="country-name">a</li>', None),
    ("mailto:x", NAME, None),
    ("http://xing.com/profile/null", None, None),
]


@pytest.fixture(scope="module")
def profiles(spark):
    return spark.createDataFrame([(u, h) for u, h, _ in PROFILES], "url string, html string")


def test_profile_country(profiles):
    got = {r["url"]: r["country"] for r in profile_country(profiles).collect()}
    assert got == {u: c for u, _, c in PROFILES if c is not None}


def test_profiles_in_countries(profiles):
    got = {r["url"] for r in profiles_in_countries(profiles, ["spain", "Italy", ""]).collect()}
    assert got == {u for u, _, c in PROFILES if c in ("spain", "")}


def test_pages_are_parsed_once_and_without_shuffle(profiles):
    df = profiles_in_countries(profiles, ["spain"])
    assert count(df, "ArrowEvalPython") == 1 and count(df, "Exchange") == 0


def test_order(profiles):
    urls = [r["url"] for r in profile_country(profiles, ordered=True).collect()]
    assert urls == sorted(urls)
