"""Compiled selectors and normalised HTML."""

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from gleaner.functions.css import compiled, css_page, css_texts
from gleaner.functions.html import select_page
from gleaner.functions.html_tree import normalised, normalised_html

PAGE = """<body><div id=Top class="a b"><p>one</p><ul><li>x<li class=b lang=fr>y<ul><li>z</ul></ul></div>
<div data-x="1 2"><p class="b">two<br>lines</p><span><p>three</p></span></div><p></body>"""


def texts(selector, page=PAGE):
    return css_page(page, {"s": compiled(selector)})["s"]


@pytest.mark.parametrize("selector,want", [
    ("p", ["one", "two lines", "three", ""]),
    ("div > p", ["one", "two lines"]),
    ("div p", ["one", "two lines", "three"]),
    ("#top p", ["one"]), ("#TOP > p", ["one"]),
    (".b", ["one x y z", "y z", "two lines"]),
    ("div.a.b > ul > li", ["x", "y z"]),
    ("li li", ["z"]), ("ul ul li", ["z"]),
    ("li[lang]", ["y z"]), ("li[lang=fr]", ["y z"]), ("li[lang='de']", []),
    ('[data-x="1 2"] > p', ["two lines"]), ("[data-x=1]", []), ("[data-x~=2] p", ["two lines", "three"]),
    ("*.b > ul li", ["x", "y z", "z"]), ("li.b > ul li", ["z"]),
    ("li[lang], div > p.b", ["y z", "two lines"]),
    ("p , li li", ["one", "z", "two lines", "three", ""]),
    ("div > span > p", ["three"]), ("div > span p", ["three"]), ("body div", ["one x y z", "two lines three"]),
])
def test_selectors(selector, want):
    assert texts(selector) == want


@pytest.mark.parametrize("selector", ["", "p >", "p:hover", "> p", "p,,q", "a[b", "p!", "[=x]"])
def test_selectors_that_are_not_understood(selector):
    with pytest.raises(ValueError):
        compiled(selector)


def test_several_selectors_in_one_pass():
    got = css_page(PAGE, {"a": compiled("p"), "b": compiled(".b"), "c": compiled("div p, p")})
    assert got["a"] == got["c"] == ["one", "two lines", "three", ""] and len(got["b"]) == 3


TOKENS = "<b> </b> <i> </i> <p> </p> <div class=k> </div> <ul> </ul> <li> <li class=k> <span> </span> <br> x y".split(" ")


@given(st.lists(st.sampled_from([t for t in TOKENS]), max_size=25).map(" ".join))
@settings(max_examples=150, deadline=None)
def test_class_selectors_agree_with_the_plain_ones(page):
    want = select_page(page, {"s": ("div", "k"), "t": ("li", "k")})
    assert css_page(page, {"s": compiled("div[class=k]"), "t": compiled("li[class='k']")}) == want


def brute(tree, chain):
    """Places of the elements of ``(tag, class, parent place)`` rows that a chain of (child?, tag, class) fits."""
    def fits(k, at):
        child, tag, cls = chain[k]
        if not (tag in ("*", tree[at][0]) and cls in (None, tree[at][1])):
            return False
        if k == 0:
            return True
        up = tree[at][2]
        while up is not None:
            if fits(k - 1, up):
                return True
            if child:
                return False
            up = tree[up][2]
        return False

    return [at for at in range(len(tree)) if fits(len(chain) - 1, at)]


@given(st.lists(st.tuples(st.sampled_from("abc"), st.sampled_from([None, "k"]), st.integers(0, 5)), min_size=1, max_size=12),
       st.lists(st.tuples(st.booleans(), st.sampled_from("abc*"), st.sampled_from([None, "k"])), min_size=1, max_size=4))
@settings(max_examples=200, deadline=None)
def test_chains_against_brute_force(rows, chain):
    tree, stack, page = [], [], ""
    names = {"a": "x-a", "b": "x-b", "c": "x-c", "*": "*"}
    for at, (tag, cls, up) in enumerate(rows):
        for _ in range(min(up, len(stack))):
            page += f"</{names[tree[stack.pop()][0]]}>"
        tree.append((tag, cls, stack[-1] if stack else None))
        stack.append(at)
        page += f"<{names[tag]}{' class=k' if cls else ''}>t{at} "
    selector = "".join((" > " if child else " ") * (k > 0) + names[tag] + ("." + cls if cls else "") for k, (child, tag, cls) in enumerate(chain))
    got = [t.split()[0] for t in css_page(page, {"s": compiled(selector)})["s"]]
    assert got == [f"t{at}" for at in brute(tree, chain)]


def test_columns_of_pages(spark):
    df = spark.createDataFrame([(1, PAGE), (2, None), (3, "")], "id int, html string")
    rows = {r.id: r.t for r in df.select("id", css_texts(F.col("html"), {"a": "div > p", "b": "#top"}).alias("t")).collect()}
    assert rows[1].a == ["one", "two lines"] and rows[3].a == [] and (rows[2] is None or rows[2].a is None)


# ---- normalised HTML -----------------------------------------------------------------

EMPTY = "<html><head></head><body>%s</body></html>"
GOLDEN = [
    ("", EMPTY % ""),
    ("x & y < z", EMPTY % "x &amp; y &lt; z"),
    ("<!DOCTYPE html><!--c--><HTML Lang=en><title>a&amp;b</title>  <p>x", '<!DOCTYPE html><!--c--><html lang="en"><head><title>a&amp;b</title></head><body><p>x</p></body></html>'),
    ("<p>a<p>b<div>c</p>d</div>", EMPTY % "<p>a</p><p>b</p><div>c<p></p>d</div>"),
    ("<ul><li>a<li>b<ul><li>c</ul></ul>", EMPTY % "<ul><li>a</li><li>b<ul><li>c</li></ul></li></ul>"),
    ("<table><td>a<td>b<tr><th>c<table><tr><td>d</table></table>", EMPTY % "<table><tbody><tr><td>a</td><td>b</td></tr><tr><th>c<table><tbody><tr><td>d</td></tr></tbody></table></th></tr></tbody></table>"),
    ("<table><thead><tr><th>h<tbody><tr><td>x</table>", EMPTY % "<table><thead><tr><th>h</th></tr></thead><tbody><tr><td>x</td></tr></tbody></table>"),
    ("<b>x<i>y</b>z</i>w", EMPTY % "<b>x<i>y</i></b><i>z</i>w"),
    ("<p><b>x<p>y</b>z", EMPTY % "<p><b>x</b></p><p><b>y</b>z</p>"),
    ("<a href=1>x<a href='2\"'>y</a>", EMPTY % '<a href="1">x</a><a href="2&quot;">y</a>'),
    ("<td>x</td><br></br><img src=a>", EMPTY % '<td>x</td><br><br><img src="a">'),
    ("<script>if (a<b && c) {}</script><style>p>q{}</style>t", "<html><head><script>if (a<b && c) {}</script><style>p>q{}</style></head><body>t</body></html>"),
    ("<dl><dt>a<dd>b<dt>c</dl><select><option>1<option>2</select>", EMPTY % "<dl><dt>a</dt><dd>b</dd><dt>c</dt></dl><select><option>1</option><option>2</option></select>"),
    ("a b", EMPTY % "a&nbsp;b"),
    ("<p a=1 a=2 b>", EMPTY % '<p a="1" b=""></p>'),
    ("<b>" * 5 + "<p>x<p>y", EMPTY % ("<b>" * 5 + "<p>x</p><p>y</p>" + "</b>" * 5)),
]


@pytest.mark.parametrize("page,want", GOLDEN)
def test_golden_pages(page, want):
    assert normalised(page) == want


SOUP = ("<b> </b> <i> </i> <p> </p> <table> </table> <tr> <td> </td> </tr> <th> <tbody> <li> <ul> </ul> <a_href=x> </a> <br> <div> </div> "
        "<h1> </h1> <span_class=q> </span> &amp; <!--c--> <font> </font> <option> <select> </select> <dt> <dd> <dl> </dl> text").split(" ")


@given(st.lists(st.sampled_from(SOUP), max_size=14).map(lambda t: "".join(t).replace("_", " ")))
@settings(max_examples=400, deadline=None)
def test_normalised_pages_stay_as_they_are(page):
    once = normalised(page)
    assert normalised(once) == once


def test_texts_of_elements_survive(spark):
    rows = spark.read.parquet("/root/testdata/sf0.001/pages.parquet").select("html").collect()
    for r in rows[:30]:
        page = normalised(r.html)
        assert normalised(page) == page
        for tag in ("div.ad", "nav li", "h1", "title"):
            assert texts(tag, page) == texts(tag, r.html)


def test_deep_pages_take_linear_time(spark):
    for page in ("<div>" * 20_000 + "x", "<b><p>" * 5_000, "<font a=1>" * 3_000 + "<p>x" * 300, "<table><tr><td>" * 3_000):
        assert normalised(page)
    df = spark.createDataFrame([(1, "<p>x"), (2, None)], "id int, html string")
    assert {r.id: r.h for r in df.select("id", normalised_html(F.col("html")).alias("h")).collect()} == {1: EMPTY % "<p>x</p>", 2: None}
