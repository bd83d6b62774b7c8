"""Wrappers: alignment, odd pages, and the text of every given page against a plain reading."""

import html
import re

import pytest

from lapsewatch.llm import wrappers
from lapsewatch.llm.wrappers import expression, extract, join, parse


def page(body):
    return f"<html><head><title>T &amp; t</title></head><body>{body}</body></html>"


def test_alignment_finds_options_repeats_and_slots():
    a = expression(parse(page("<nav><a>x</a></nav><h1>A</h1><p>one</p><p>two</p>")))
    b = expression(parse(page("<h1>B</h1><div class='ad'>buy</div><p>three</p><footer>f</footer>")))
    whole = join(a, b).pattern()
    assert "(<nav>)?" in whole and "(<p>#)+" in whole and "(<div.ad>#)?" in whole and "(<footer>#)?" in whole
    c = expression(parse(page("<h2>a</h2><p>b</p><h2>c</h2><p>d</p><h2>e</h2><p>f</p>")))
    assert "(<h2># <p>#)+" in c.pattern()


@pytest.mark.parametrize("body,text", [
    ("<article><h1>A</h1><p>b &amp;amp; <b>c</b>\n d<br>e<p>f</article><footer>x</footer>", "A\n\nb &amp; c d e\n\nf"),
    ("<header>h</header><main><p>a</p><aside>no</aside><ul><li>b<li>c</ul></main>", "a\n\nb\n\nc"),
    ("<div id='main-content'><p>text text text</p><div class='comments'><p>no</p></div></div>", "text text text"),
    ("<script>var t='</p><p>no';</script><style>p{}</style><p>a<!-- no <p> --> b</p>", "a b"),
    ("<form><p>no</p></form><p>1 &lt; 2 < 3</p><div class='cookie-notice'>no</div>", "1 < 2 < 3"),
    ("<p hidden>no</p><p title='a > b'>yes</p><div role='navigation'>no</div>", "yes"),
    ("<article><p>x", "x"), ("<script>never closed", ""), ("<!-- never closed <p>a</p>", ""), ("", ""),
])
def test_pages(body, text):
    assert extract(page(body) if body else body, None) == text


def test_deep_and_long():
    assert extract("<div>" * 5000 + "a" + "</div>" * 5000, None) == "a"
    assert extract("<article>" + "<p>a</p>" * 20000 + "</article>", None) == "\n\n".join("a" * 20000)
    assert extract("<a href=\"" * 2000 + "x", None) is not None


def plain(source):
    inner = re.search(r"<article>(.*?)(?:</article>|$)", source, re.S).group(1)
    parts = re.split(r"</?(?:p|h1)>", re.sub(r"</?b>", "", inner).replace("<br>", " "))
    return "\n\n".join(t for t in (" ".join(html.unescape(p).split()) for p in parts) if t)


def test_tables(spark):
    df = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    sources = {r.page_id: r.html for r in df.collect()}
    rows = wrappers.main_text(df, "page_id", "url", "html").collect()
    assert len(rows) == len(sources)
    assert all(r.text == plain(sources[r.page_id]) for r in rows)


def test_odd_rows(spark):
    rows = [(1, None, None, 1), (2, "x", "", 1), (3, "http://h/a", page("<p>a</p>"), 1),
            (3, "http://h/a", page("<p>a</p>"), 1), (4, "http://H/b", page("<article><p>b</p></article>"), 1)]
    df = spark.createDataFrame(rows, "page_id bigint, url string, html string, host int")
    found = sorted((r.page_id, r.text) for r in wrappers.main_text(df, "page_id", "url", "html").collect())
    assert found == [(1, ""), (2, ""), (3, "a"), (3, "a"), (4, "b")]
    assert wrappers.main_text(df.limit(0), "page_id", "url", "html").count() == 0


@pytest.mark.parametrize("body,text", [
    ("<p>x</p><div class='content no-sidebar'><p>a a a a a</p></div>", "a a a a a"),
    ("<div class='layout has-sidebar'><article><p>a</p></article></div>", "a"),
    ("<div class='main comments-open'><p>a</p></div><div class='sidebar-left'>no</div>", "a"),
    ("<article class='post comments-open'><p>a</p><div class='widget-text'>b</div></article>", "a\n\nb"),
    ("<div class='sidebar'><div id='overlay'><main><p>a</p></main></div></div>", "a"),
    ("<article><p>a</p></article><div class='related-posts'><article>no</article></div>", "a"),
    ("<article><p>a <math><mi>x</mi></math> <object>o</object> <canvas>c</canvas> <map>m</map></p></article>",
     "a x o c m"),
    ("<article><p>a</p><div class='ad-300x250'>no</div><div id='site-footer'>no</div><div class='comment-list'>no"
     "</div></article><div class='sponsored post'>no</div>", "a"),
    ("<p>no no</p>" + "<div>" * 60 + "<article><p>yes yes yes</p></article>", "yes yes yes"),
    ("<p>no no</p>" + "<div>" * 3000 + "<article><p>yes yes yes</p></article>", "yes yes yes"),
])
def test_whole_articles_stay(body, text):
    assert extract(page(body), None) == text


def test_deep_wrappers_are_joined_and_packed():
    deep = page("<div>" * 3000 + "<article><p>yes</p></article>")
    whole = join(expression(parse(deep)), expression(parse(deep)))
    again = wrappers.Part.unpack(wrappers.json.loads(wrappers.json.dumps(whole.pack())))
    assert again.pack() == whole.pack() and wrappers.main_path(again).endswith("/div/article")


def told(*bodies):
    """What the wrapper of these pages leaves of each."""
    whole = None
    for body in bodies:
        part = expression(parse(page(body)))
        whole = part if whole is None else join(whole, part)
    decided = wrappers.json.dumps(wrappers.decisions(whole))
    return [extract(page(body), decided) for body in bodies]


BOX = "<div class='box'>Follow us today on every channel we run</div>"


def test_template_text_goes_and_slots_stay():
    bodies = [f"<article><h1>Title {i}</h1><p>story {i} x{'x' * i}</p>{BOX}<p>end {i}</p></article>" for i in range(10)]
    assert told(*bodies) == [f"Title {i}\n\nstory {i} x{'x' * i}\n\nend {i}" for i in range(10)]
    # Three articles are too few to tell, however many copies of them there are.
    assert all("Follow us" in t for t in told(*bodies[:3] * 4))
    # An option with one text on all its pages is template text as well.
    some = [b if i % 2 else b.replace(BOX, "") for i, b in enumerate(bodies)]
    assert not any("Follow us" in t for t in told(*some))


def test_ends_of_repeated_groups_are_told_apart():
    bodies = [f"<article><h1>T {i}</h1><p>a {i}</p><p>{'b' * (i + 1)}</p><p>Read more on our site.</p></article>"
              for i in range(4)]
    assert told(*bodies) == [f"T {i}\n\na {i}\n\n{'b' * (i + 1)}" for i in range(4)]


def test_headings_stay_beside_slots():
    bodies = [f"<article><h1>T {i}</h1><h2>Summary</h2><p>a longer text {i}</p><section><h3>About us</h3><div>We write"
              f"</div></section></article>" for i in range(4)]
    assert told(*bodies) == [f"T {i}\n\nSummary\n\na longer text {i}" for i in range(4)]


def test_a_host_of_copies_keeps_its_text():
    body = "<article><h1>T</h1><p>the same on all pages</p></article>"
    assert told(*[body] * 5) == ["T\n\nthe same on all pages"] * 5


def test_slots_overrule_classes_when_they_hold_the_text():
    bodies = [f"<article><h1>T {i}</h1><div class='widget'><p>{'long text ' * 9}{i}</p></div></article>" for i in range(3)]
    assert told(*bodies) == [f"T {i}\n\n{'long text ' * 9}{i}" for i in range(3)]


@pytest.mark.parametrize("body,text", [
    ("<article><p>story</p><section class='discussion'><p>I disagree</p></section></article>", "story"),
    ("<article><p>story</p><section id='discussion'><p>results</p></section></article>", "story\n\nresults"),
    ("<article><p class='highlight widget'>of the article</p><p>story</p></article>", "of the article\n\nstory"),
    ("<article><p>story</p><p class='ad'>buy</p><p class='notice top'>no</p></article>", "story"),
])
def test_single_pages_by_class(body, text):
    assert extract(page(body), None) == text


def test_order_of_joining_is_free_for_template_text(spark):
    rows = [(i, f"http://h/{i}", page(f"<article><h1>T {i}</h1><p>p {i}</p>{BOX}</article>")) for i in range(60)]
    df = spark.createDataFrame(rows, "page_id bigint, url string, html string").repartition(20)
    found = {r.page_id: r.text for r in wrappers.main_text(df, "page_id", "url", "html").collect()}
    assert found == {i: f"T {i}\n\np {i}" for i in range(60)}
