"""Main text of written pages whose article is known."""

import random
import re
import time

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from tracery.llm import html_blocks

LONG = "A sentence of the article that is long enough to make the text surge, as real ones do, and then some more of it."


def page(article, around=True):
    before = '<nav><ul><li><a href="/a">Home</a></li><li><a href="/b">News</a></li></ul></nav><div class="ad">Buy this now, a very long advert with many words.</div>'
    after = '<aside>More to read</aside><section id="comments"><p>First comment, which is as long as a paragraph of the article itself.</p></section><footer>&copy; us</footer>'
    return f"<!DOCTYPE html><html><head><title>T</title><script>var x='<p>no</p>';</script></head><body>{before * around}{article}{after * around}</body></html>"


def test_marked_article():
    body = f"<article><h1>Title &amp; more</h1><p>{LONG}<p>Short.\n  two <b>bold</b>&nbsp;words<!-- no --></p><ul><li>one<li>two</ul><form>Name <input></form><script>x</script><div class='related'>See also</div></article>"
    assert html_blocks.main_text(page(body)) == f"Title & more\n{LONG}\nShort. two bold words\none\ntwo"


def test_unmarked_page():
    body = f"<div><h1>A heading of this page</h1><p>{LONG}</p><p>{LONG}</p><div><p>{LONG}</p></div></div><p><a href='#'>one</a> <a href='#'>two</a></p>"
    got = html_blocks.main_text(page(body))
    assert got.split("\n") == ["A heading of this page", LONG, LONG, LONG]


def test_article_tags_that_hold_less_than_the_rest():
    body = "".join(f"<p>{k} {LONG}</p>" for k in range(6))
    whole = "\n".join(f"{k} {LONG}" for k in range(6))
    teaser = "<article><h3>Another story</h3><p>A teaser of some words.</p></article>"
    assert html_blocks.main_text(page(f"<div>{body}</div><hr><hr><ul><li></ul>{'<aside>x</aside>' * 4}{teaser}")) == whole
    comments = "".join(f'<article class="comment" id="c{k}"><p>Reader {k}: {LONG} {LONG}</p></article>' for k in range(5))
    assert html_blocks.main_text(page(f"<div>{body}</div>{comments}")) == whole
    assert html_blocks.main_text(page(f"<article>{body}</article>{comments}")) == whole


def test_text_beside_the_article():
    first, second = f"<p>1 {LONG}</p>" * 3, f"<p>2 {LONG}</p>" * 2
    both = "\n".join([f"1 {LONG}"] * 3 + [f"2 {LONG}"] * 2)
    assert html_blocks.main_text(page(f"<article>{first}</article><div>{second}</div>")) == both
    assert html_blocks.main_text(page(f"<div>You are here</div><article>{first}</article><div>Share it</div>")) == both[: both.index("\n2")]


def test_names_of_the_only_article():
    for name in ("post category-social tag-search", "layout-with-sidebar", "widget"):
        assert html_blocks.main_text(page(f'<article class="{name}"><p>{LONG}</p></article>')) == LONG


def test_long_page_is_kept_whole():
    rng = random.Random(6)
    blocks = [" ".join(rng.choice(["word", "x&lt;y", "é"]) for _ in range(rng.choice([1, 3, 200]))) for _ in range(2000)]
    got = html_blocks.main_text(page("<article>" + "".join(f"<p>{b}</p>" for b in blocks) + "</article>"))
    assert got == "\n".join(b.replace("&lt;", "<") for b in blocks)


@settings(deadline=None)
@given(st.lists(st.sampled_from(["<p>", "</p>", "<div", " class=ad", ">", "<article>", "</article>", "<!--", "-->", "text of it", "&amp;", "<script>", "</script>", "\x00", "<", '"', "'", "<li>", "</ul>", "<br/>"]), max_size=40))
def test_any_markup(parts):
    text = html_blocks.main_text("".join(parts))
    assert all(line == " ".join(line.split()) and line for line in text.split("\n")) or text == ""


def test_broken_tags_take_linear_time():
    bad = [
        "<p class='" * 20_000, "<div " + "a='b\" " * 50_000, "<script>" * 20_000, "<p>" * 100_000, "<" * 200_000, "<!--" * 50_000, "<div>" * 50_000 + "</span>" * 40_000,
        "<div></b>" * 50_000, "<b>" * 60_000 + "<p>" * 60_000, "<li><table>" + "<div>" * 40_000 + "<li></li>" * 30_000, "<article>a" * 50_000, "<article>a</article>" * 25_000,
        "<p><span class=ad>x" * 25_000, "<td><div>" * 50_000, "<div class=sidebar>a" * 25_000, "<p ' > ' " * 30_000 + "'", "<p x='>' " * 30_000, "<p x=\"" + "<b y='" * 40_000,
    ]
    for page in bad:
        began = time.process_time()
        html_blocks.main_text(page)
        assert time.process_time() - began < 5 * max(1, len(page) / 500_000), page[:40]


def plain_stretches(weight, surge, ground):
    """The window scan as it is said: walk over all windows, one by one."""
    n, w = len(weight), html_blocks.WINDOW
    sums = [sum(weight[max(0, j - w + 1) : j + 1]) for j in range(n + w - 1)]
    out, j = [], 0
    while j < len(sums):
        if sums[j] <= ground:
            j += 1
            continue
        first = j
        while j < len(sums) and sums[j] > ground:
            j += 1
        if max(sums[first:j]) > surge:
            lines = [i for i in range(max(0, first - w + 1), min(n, j)) if weight[i]]
            out.append((lines[0], lines[-1]))
    return out


@settings(deadline=None, max_examples=300)
@given(st.lists(st.sampled_from([0, 0, 0, 3, 10, 25, 70, 200]), max_size=60), st.integers(0, 120), st.integers(0, 120))
def test_windows(weight, surge, ground):
    ground = min(surge, ground)
    assert html_blocks.stretches(np.array(weight, np.int64), surge, ground) == plain_stretches(weight, surge, ground)


def test_names_count_whole():
    """An article whose holders have names that only sound like something else is whole."""
    body, whole = f"<h1>Title</h1><p>{LONG}</p>", f"Title\n{LONG}"
    for holder in ("<div class='content with-sidebar'>", "<div class='layout no-menu'>", "<form id=aspnet>", "<fieldset>", "<header>", "<div class=widget>"):
        for inner in (f"<article>{body}</article>", f"<main>{body}</main>"):
            assert html_blocks.main_text(page(holder + inner)) == whole, holder
    assert html_blocks.main_text(page(f"<article><div class='article-header'><h1>Title</h1></div><p class='social'>{LONG}</p></article>")) == whole
    assert html_blocks.main_text(page(f"<article><h1>Title</h1><div id='search-history'><p>{LONG}</p></div></article>")) == whole
    assert html_blocks.main_text(page(f"<article><p>Let <math><mi>x</mi></math> be one. {LONG}</p></article>")) == f"Let x be one. {LONG}"
    assert html_blocks.main_text(page(f"<article><p>One <span class='ad'>Buy</span> line. {LONG}</p></article>")) == f"One line. {LONG}"
    for junk in ("site-header", "comment-list", "cookieBanner", "related_posts", "sidebar-left"):
        assert html_blocks.main_text(page(f"<article>{body}<div class='{junk}'><p>{LONG}</p></div></article>")) == whole, junk


def test_teaser_beside_the_story():
    story = "".join(f"<p>{k} {LONG}</p>" for k in range(3))
    assert html_blocks.main_text(page(f"<article>teaser one</article><div id='story'>{story}</div>")) == "\n".join(f"{k} {LONG}" for k in range(3))


def test_short_lines_of_an_article_stay():
    blocks = ["Les.", "A", LONG, "B", "C", "D", "Par.", "E", "F", LONG, "Z"]
    parted = "<aside>x</aside><nav>y</nav><form>z</form>".join(f"<p>{b}</p>" for b in blocks)
    assert html_blocks.main_text(page(f"<article>{parted}</article>")) == "\n".join(blocks)


def test_surge_and_dive_decide_without_marks(spark, sf):
    """The scan alone, without the weight that article and main add, finds the same text on most pages."""
    pages = [r.html for r in spark.read.parquet(f"{sf}/pages.parquet").collect()]
    bare = [re.sub(r"</?(?:article|main)\b[^>]*>", lambda m: "<div>" if m[0][1] != "/" else "</div>", p or "") for p in pages]
    same = sum(html_blocks.main_text(p) == html_blocks.main_text(b) for p, b in zip(pages, bare, strict=True))
    assert same >= 0.9 * len(pages)


def test_pages(spark, sf):
    pages = spark.read.parquet(f"{sf}/pages.parquet")
    got = html_blocks.extract(pages).collect()
    assert len(got) == pages.count() and all(r.n_chars == len(r.text) for r in got)
    raw = {r.page_id: r.html for r in pages.collect()}
    for r in got:
        assert "<" not in r.text or "&lt;" in raw[r.page_id]
        assert "track(" not in r.text


def test_cases(spark):
    rows = [(1, None, None), (2, "u", ""), (None, "v", f"<article>{LONG}</article>"), (3, "w", "   "), (4, "x", f"<p>{LONG}</p>"), (4, "x", f"<p>{LONG}</p>"), (5, "y", "<p>" + "long text " * 100_000 + "</p>")]
    pages = spark.createDataFrame([(*r, "t", 0) for r in rows], "page_id long, url string, html string, text string, n_chars int")
    got = html_blocks.extract(pages).collect()
    assert sorted(((r.page_id, r.text[:200], r.n_chars) for r in got), key=str) == sorted([(1, "", 0), (2, "", 0), (None, LONG, len(LONG)), (3, "", 0), (4, LONG, len(LONG)), (4, LONG, len(LONG)), (5, ("long text " * 20)[:200], 999_999)], key=str)
    assert html_blocks.extract(pages.limit(0)).count() == 0


def reader(k, dated=True):
    return f"<div class='c'><b>Reader {k}</b>{f'<span>2024-01-0{k}</span>' * dated}<p>I like this very much, thanks for writing it {k}. Really, thanks a lot.</p></div>"


def test_what_readers_wrote():
    dated, plain = "".join(reader(k) for k in range(5)), "".join(reader(k, False) for k in range(5))
    boxes = ["section class='responses'", "section id='disqus_thread'", "section class='reader-responses'", "div class='user-comments'", "ol class='commentlist'", "div class='thread'><h3>Comments</h3", "div class='x'><h2>12 Comments</h2"]
    for box in boxes:
        for comments in (dated, plain):
            below = f"<{box}>{comments}</{box.split()[0]}>"
            assert html_blocks.main_text(f"<body><article><h1>T</h1><p>{LONG}</p></article>{below}</body>") == f"T\n{LONG}", box
            assert html_blocks.main_text(f"<body><article><h1>T</h1><p>{LONG}</p>{below}</article></body>") == f"T\n{LONG}", box
    assert html_blocks.main_text(f"<body><div><h1>T</h1><p>{LONG}</p><p>{LONG}</p></div><div class='z'>{dated}</div></body>") == f"T\n{LONG}\n{LONG}"
    assert html_blocks.main_text(f"<body>{dated}</body>").count("thanks for writing") == 5  # nothing else is there
    section = f"<h2>Discussion</h2><p>{LONG}</p><section><h2>Comments on the method</h2><p>{LONG}</p></section>"
    assert html_blocks.main_text(f"<body><article><p>{LONG}</p>{section.replace('Comments on', 'Notes on')}</article></body>").count(LONG) == 3


def test_an_article_with_the_title_is_not_outweighed():
    beside = f"<div class='x'>{''.join(f'<p>{k} {LONG}</p>' for k in range(5))}</div>"
    assert html_blocks.main_text(f"<body><article><h1>T</h1><p>Short article of one sentence, but it is the article of this page all the same.</p></article>{beside}</body>").startswith("T\nShort article")


def test_linked_lines_of_an_article():
    body = f"<p>{LONG}</p><p>See <a href='/r'>the long report of the committee on roads</a>.</p><p>{LONG}</p>"
    assert html_blocks.main_text(f"<body>{body}</body>") == f"{LONG}\nSee the long report of the committee on roads.\n{LONG}"


def test_pictures_and_films_that_are_not_closed():
    for tag in ("<svg>", "<video src=x>", "<audio controls>", "<canvas id=a>", "<object data=x>", "<svg/>", "<svg><path d='1'/><text>no</text></svg>", "<VIDEO>no</video>", "<svg>" * 3):
        assert html_blocks.main_text(f"<body><p>{LONG}</p>{tag}<p>2 {LONG}</p></body>") == f"{LONG}\n2 {LONG}", tag


def test_long_attributes():
    for n in (9_000, 10_000, 300_000):
        assert html_blocks.main_text(f"<body><p>{LONG}</p><p title=\"{'x' * n}>leak\">2 {LONG}</p></body>") == f"{LONG}\n2 {LONG}"


def test_many_unclosed_pictures_take_linear_time():
    began = time.process_time()
    html_blocks.main_text("<svg>" * 20_000 + "<p title=\"" * 20_000 + LONG)
    assert time.process_time() - began < 20
