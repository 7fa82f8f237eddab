"""Main text of pages."""

import pytest

from lurewatch.llm.html import extract_text, main_text

LONG = "One sentence, with commas, and enough words to count as a paragraph of an article, it goes on."
SHELL = ('<html><head><title>T</title><script>var a="<p>no</p>";</script><style>p{{}}</style></head><body>'
         '<nav><ul><li><a href="/">Home</a></li></ul></nav><header>Site</header><div class="ad">Buy, buy, buy, now, now.</div>'
         '{}<div id="sidebar"><p>Side, side, side, side, a long text of the sidebar</p></div><form><p>Name, mail, phone</p></form>'
         '<section class="comments"><p>{} reader</p></section><footer>&copy; x</footer></body></html>')


@pytest.mark.parametrize("inner,text", [
    (f"<article><h1>A &amp; B</h1><p>{LONG}</p><p>Short.</p></article>", f"A & B {LONG} Short."),
    (f"<article><h1>H</h1><p><b>{LONG}<br><p>Next  one,\n two.</article>", f"H {LONG} Next one, two."),
    (f"<div class=post><p>{LONG}</p><ul><li>a<li>b <i>c</i>d</ul><!-- no --><p>{LONG}</p></div>", f"{LONG} a b cd {LONG}"),
    (f"<main><div><p>{LONG}</p></div><div><p>{LONG}</p><aside>x, y, z</aside></div></main>", f"{LONG} {LONG}"),
    ("<article><h1>Only a title</h1></article>", "Only a title"),
    (f"<article><table><tr><td>{LONG}<td>b</table><p>a < b &lt; c</p></article>", f"{LONG} b a < b < c"),
    (f"<article><div class='share'>Share, share</div><p>{LONG}</p><div class=\"cookie-notice\"><p>{LONG} c</p></div></article>", LONG),
])
def test_pages(inner, text):
    assert main_text(SHELL.format(inner, LONG)) == text


@pytest.mark.parametrize("inner,text", [
    (f"<div class='content has-sidebar'><p>{LONG}</p><p>Short.</p></div>", f"{LONG} Short."),
    (f"<div id=main class='no-sidebar'><p>{LONG}</p></div><div class=site-footer><p>{LONG} f</p></div>", LONG),
    (f"<section class=search-article><p>{LONG}</p></section><section class=search-article><p>{LONG} b</p></section>", f"{LONG} {LONG} b"),
    (f"<div class=page-widget><div class='comment-list'><p>{LONG} c</p></div><p>{LONG}</p></div>", LONG),
    (f"<article><h2 class=section-header>Head</h2><p>{LONG}</p><div class=related-posts><p>{LONG} r</p></div></article>", f"Head {LONG}"),
    (f"<div class=widget><p>{LONG}</p><p>{LONG}</p><p>{LONG}</p></div>", f"{LONG} {LONG} {LONG}"),
    (f"<article>Short</article><div class=content-widget><p>{LONG}</p></div>", "Short"),
])
def test_names_do_not_remove_the_article(inner, text):
    assert main_text(SHELL.format(inner, LONG)) == text


def test_small_sections_stay():
    one, two = "".join(f"<p>{LONG}</p>" for _ in range(3)), f"<p>{LONG}</p><p>{LONG}</p>"
    inner = (f"<h1>Title</h1><section>{one}</section><h2>Next</h2><div>A short block</div><div><a href=x>Only a link</a></div>"
             f"<section>{two}</section><ul><li>a<li>b</ul><p>End.</p><div>Imprint</div>")
    expected = f"Title {' '.join([LONG] * 3)} Next A short block {LONG} {LONG} a b End."
    assert main_text(SHELL.format(inner, LONG)) == expected


@pytest.mark.parametrize("html,text", [
    (None, ""), ("", ""), ("plain words", "plain words"), ("<p>cut <b", "cut"), (f"<div class=ad><p>{LONG}<article><p>{LONG} in</p>", f"{LONG} in"),
    ("<script>only", ""), ("<p>a</p></div></p>b", "a b"), ("<!-- open", ""), (f"<article><p>{LONG} tail <a href='x", f"{LONG} tail"),
    ("<<<>>>", "<<<>>>"), ("<article>" + "<div>" * 3000 + LONG, LONG),
])
def test_broken_pages(html, text):
    assert main_text(html) == text


def test_extract(spark):
    rows = [(1, "u", f"<article><p>{LONG}</p></article>", 1), (1, "u", f"<article><p>{LONG}</p></article>", 1),
            (None, None, None, 2), (3, "v", "", 3), (4, "w", "<article>" + f"<p>{LONG}</p>" * 3000, 4)]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string, n_chars int")
    found = extract_text(pages).toArrow().to_pylist()
    assert len(found) == 5 and [r["text"] for r in found if r["page_id"] == 1] == [LONG, LONG]
    assert {r["page_id"]: r["n_chars"] for r in found} == {1: len(LONG), None: 0, 3: 0, 4: 3000 * (len(LONG) + 1) - 1}
    assert extract_text(pages.limit(0)).count() == 0


PASSAGE = "One sentence, with commas, that is long enough to count as a paragraph of an article, and then some more of it."


@pytest.mark.parametrize("page, text", [
    (f"<form><div id=content><p>{PASSAGE}</p><p>{PASSAGE}</p></div></form>", f"{PASSAGE} {PASSAGE}"),
    (f"<body><form action=/x><input name=a><div><p>{PASSAGE}</p></div><select><option>no</select></form>", PASSAGE),
    (f"<body><div><p>{PASSAGE}</p><p>{PASSAGE}</p></div><form><p>Write to us, now, here, please do so</p></form>", f"{PASSAGE} {PASSAGE}"),
    (f"<html><head><title>T</title><p>{PASSAGE}</p>", PASSAGE),
    (f"<html><head><meta x=y><title>T</title><script>a<b</script>\n{PASSAGE} at the end", f"{PASSAGE} at the end"),
    (f"<html><head><title>T</title></head><body><p>{PASSAGE}</p>", PASSAGE),
    (f"<p>{PASSAGE} For <math><mi>x</mi><mo>=</mo><mn>2</mn></math> it holds.</p>", f"{PASSAGE} For x=2 it holds."),
    (f"<p>{PASSAGE} See <svg><title>icon</title><text>label</text></svg> there.</p>", f"{PASSAGE} See label there."),
])
def test_forms_heads_and_formulas(page, text):
    assert main_text(page) == text
