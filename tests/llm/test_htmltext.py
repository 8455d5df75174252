import random

import pytest

from rosterlake.llm import htmltext

CASES = [
    ("<p>One<p>Two <b>bold</b>, and\n more", "One\n\nTwo bold, and more"),
    ("<h1>T</h1>a<br>b<br><br>c<div>d</div>e", "T\n\na\nb\n\nc\nd\ne"),
    ("<ul><li>a<li>b<ol start=3><li>x<li>y</ol><li>c</ul>z", "- a\n- b\n  3. x\n  4. y\n- c\n\nz"),
    ("<table><tr><th>Name<th>N<tr><td>pear<td>12<tr><td>fig<td>3</table>", "Name  N\npear  12\nfig   3"),
    ("<table><td>a<table><td>in<td>ner</table><td>b</table>", "a        b\n\nin  ner"),
    ("a<script>x='</p>'</script><style>p{}</style><!-- no --><p hidden>no</p><p style='color:red;display: none'>no<b>no</b></p>b", "ab"),
    ("<head><title>t</title></head><body>x &amp; y &lt;z&gt; &eacute;", "x & y <z> é"),
    ("<pre>a  b\n  c</pre>d", "a  b\n  c\n\nd"),
    ("<dl><dt>k<dd>v<dt>k2<dd>v2</dl>", "k\n  v\nk2\n  v2"),
    ("<blockquote>q<p>r</blockquote>s", "  q\n\n  r\n\ns"),
    ("</div></b>x</p>y<i>z", "x\n\nyz"),
    ("<img alt='A cat'> <input value=no><button>Go</button>", "A cat Go"),
    ("<dialog>no</dialog><dialog open>yes</dialog>", "yes"),
    ("<select><option>a<option>b</select><noscript>no</noscript>t", "a t"),
    ("", ""), ("plain < text & more", "plain < text & more"), ("<", "<"), ("<p", ""),
    ("<table><tr><td>日本<td>x<tr><td>ab<td>y</table>", "日本  x\nab    y"),
]


FOREIGN = [
    ("E is <math><mi>m</mi><msup><mi>c</mi><mn>2</mn></msup><annotation>no</annotation></math>.", "E is mc2."),
    ("<math><semantics><mfrac><mn>1</mn><mn>2</mn></mfrac><annotation-xml><p>no</annotation-xml></semantics></math>", "1 2"),
    ("a<svg><title>no</title><desc>no</desc><defs><text>no</text></defs>no<g><text>May</text><text>10 <tspan>k</tspan></text></g></svg>b", "a May 10 k b"),
    ("<svg><text display=none>no</text><foreignObject><p>in</p></foreignObject><path d=x/></svg><p>out", "in\n\nout"),
    ("<svg><path d=x><p>out", "out"),
    ("Size <select><option>S<option selected>M<option>L</select> left", "Size M left"),
    ("<select><option selected>no<option selected label=Big>x</select><select hidden><option selected>no</select>", "Big"),
    ("<select multiple><option>a<option>b</select>", "a\nb"), ("<select size=2><optgroup label=G><option>a</optgroup></select>", "G\na"),
]


@pytest.mark.parametrize("html, text", FOREIGN)
def test_formulas_drawings_and_options(html, text):
    assert htmltext.visible_text(html) == text


@pytest.mark.parametrize("html, text", CASES)
def test_layout(html, text):
    assert htmltext.visible_text(html) == text


def test_depth_and_length_are_no_limit():
    assert htmltext.visible_text("<div>" * 50_000 + "x" + "</div>" * 50_000) == "x"
    assert len(htmltext.visible_text("<p>word " * 50_000).split()) == 50_000


def test_rows(spark):
    rows = [(1, None), (2, ""), (3, "<p>a"), (3, "<p>a"), (None, "b")]
    pages = spark.createDataFrame([(i, h, "t", 1) for i, h in rows], "page_id bigint, html string, text string, url int")
    got = sorted(((r.page_id or 0, r.text) for r in htmltext.page_texts(pages).collect()), key=str)
    assert got == sorted([(1, None), (2, ""), (3, "a"), (3, "a"), (0, "b")], key=str)
    assert htmltext.page_texts(pages.limit(0)).count() == 0


SPANS = [
    ("<table><tr><th>A<th colspan=2>B<th>C<tr><td>1<td>22<td>333<td>4444</table>", "A  B        C\n1  22  333  4444"),
    ("<table><tr><td rowspan=2>top<td>x<tr><td>y<tr><td>z<td>w</table>", "top  x\n     y\nz    w"),
    ("<table><tr><td>a<td rowspan=2>tall<td>b<tr><td>c<td>d</table>", "a  tall  b\nc        d"),
    ("<table><tr><td colspan=3>A long heading<tr><td>1<td>2<td>3</table>", "A long heading\n1  2  3"),
    ("<table><tr><td colspan=2>A long heading<td>end<tr><td>1<td>2<td>3</table>", "A long heading  end\n1  2            3"),
    ("<table><tr><td colspan=0>a<td rowspan=x>b<tr><td colspan=99999999999>c<tr><td>d<td>e</table>", "a  b\nc\nd  e"),
    ("<table><tr><td colspan=1000 rowspan=9>a<td>b<tr><td>c</table>", "a  b\n   c"),
]
SEEN = [
    ("<div style='visibility:hidden'>no<p style='visibility: visible'>yes<b>too</b></p>no</div>z", "yestoo\n\nz"),
    ("<div style='visibility:hidden'><div style='display:none'><i style='visibility:visible'>no</i></div><i style='visibility:visible'>a<b style='visibility:collapse'>no<u style='visibility:visible'>b</u></b></i></div>", "ab"),
    ("<div hidden><p style='visibility:visible'>no</div>x", "x"),
    ("<select><option disabled>no<option>first<option>no</select>", "first"), ("<select><option label=L>no</select>", "L"), ("<select></select>x", "x"),
    ("<div style='visibility:hidden'><select style='visibility:visible'><option>no</select></div>x", "x"),
]


@pytest.mark.parametrize("html, text", SPANS + SEEN)
def test_spans_and_visibility(html, text):
    assert htmltext.visible_text(html) == text


def plain_layout(rows):
    """Every column as wide as its widest cell, two blanks apart."""
    widths = [max((len(r[c]) for r in rows if c < len(r)), default=0) for c in range(max(map(len, rows)))]
    return "\n".join("  ".join(x + " " * (widths[c] - len(x)) for c, x in enumerate(r)).rstrip() for r in rows if any(r))


def test_random_tables_equal_brute_force():
    rnd = random.Random(4)
    for _ in range(200):
        rows = [["w" * rnd.choice([0, 1, 3, 9]) for _ in range(rnd.randrange(1, 6))] for _ in range(rnd.randrange(1, 7))]
        html = "<table>" + "".join("<tr>" + "".join(f"<td>{x}" for x in r) for r in rows) + "</table>"
        assert htmltext.visible_text(html) == plain_layout(rows)


@pytest.mark.parametrize("html", [
    "<table><tr><td>" + "wide " * 40_000 + "<td>x" + "<tr><td>a<td>b" * 5_000 + "</table>",
    "<table><tr><td>" + "<br>line" * 20_000 + "<td>x" * 5_000 + "<td>" + "<br>y" * 20_000 + "</table>",
    "<table>" + "<tr><td>" + "<td>" * 400 + "z" + "<tr>" + "<td>" + "m" * 100 + "</table>",
    "<table>" + "".join("<tr>" + "<td>" * i + "w" * 110 for i in range(300)) + "</table>",
])
def test_text_stays_in_proportion_to_the_page(html):
    text = htmltext.visible_text(html)
    assert len(text) <= 30 * len(html) + 3000
    for word in ("wide", "line", "w" * 110, "z"):
        assert text.count(word) == html.count(word) if f">{word}" in html or f"{word} " in html else True
