"""Main text of pages: planted structures and the given pages."""

import html as entities
import re
import time

from cellframe.llm import html

LONG = "A sentence that is long enough to count as the text of an article, with some more words after it."


def page(body):
    return f"<!DOCTYPE html><html><head><title>Other &amp; title</title><style>p{{margin:0}}</style><script>var a='</p>';</script></head><body>{body}</body></html>"


def test_boilerplate_goes_and_all_blocks_of_the_article_stay():
    body = f"""<header><h1>Site</h1><a href=/>home</a></header><nav><ul><li><a href=/a>{LONG}</a></li></ul></nav>
    <div class="cookie-notice">{LONG}</div><div id="sidebar"><p>{LONG}</p></div>
    <article><h1>Title &eacute; &lt;b&gt;</h1><p>{LONG}</p><p>Be.</p><div class="ad">{LONG}</div><p>a &nbsp; b<!-- {LONG} -->
      c</p><form><p>{LONG}</p></form><blockquote>{LONG}</blockquote><p>End</p></article>
    <section class="comments"><h2>Comments</h2><p>{LONG}</p></section><aside>{LONG}</aside><footer>&copy; {LONG}</footer>"""
    assert html.main_text(page(body)).split("\n") == ["Title é <b>", LONG, "Be.", "a b c", LONG, "End"]


def test_pages_without_an_article_element():
    body = f"<p>Short notice</p><div id=content><h2>Title</h2><p>{LONG}<p>Two<br>lines<p>{LONG}</div><div><a href=/>one</a> <a href=/>two</a></div>"
    assert html.main_text(page(body)).split("\n") == ["Title", LONG, "Two", "lines", LONG]


def test_short_and_broken_pages():
    assert html.main_text(None) == "" and html.main_text("") == "" and html.main_text("<p>") == ""
    assert html.main_text("just text") == "just text"
    assert html.main_text(f"<article><p>{LONG}<p>cut of") == LONG + "\ncut of"
    assert html.main_text(f"<article><p>a < b & c > d {LONG}</article><script>never closed <p>{LONG}") == f"a < b & c > d {LONG}"
    assert html.main_text("<p>" * 3000 + LONG) == LONG
    assert html.main_text('<a href="' * 2000) is not None


def test_names_that_only_hold_a_telling_word_stay():
    other = LONG.replace("sentence", "passage")
    for name in ("social-science", "related-work", "adSense-study", "searchlight", "ads2020-paper", "plain"):
        for around in ("article", "div"):
            for tag in ("p", "section"):
                assert html.main_text(page(f"<{around}><p>{LONG}</p><{tag} class='{name}'>{other}</{tag}><p>{LONG}</p></{around}>")).split("\n") == [LONG, other, LONG], (name, around, tag)
    for name in ("ad", "ad-slot top", "commentsList", "newsletter_signup", "sponsored-links"):
        assert html.main_text(page(f"<article><p>{LONG}</p><div class='{name}'>{other}</div><p>{LONG}</p></article>")).split("\n") == [LONG, LONG], name
    for name in ("cookie-notice", "site-header", "related-posts", "nav"):
        assert html.main_text(page(f"<div id='{name}'><p>{other}</p></div><div><p>{LONG}</p><p>{LONG}</p></div>")).split("\n") == [LONG, LONG], name
        assert other in html.main_text(page(f"<article><p>{LONG}</p><div class='{name}'>{other}</div><p>{LONG}</p></article>")), name
    assert html.main_text(page(f"<article><p>{LONG}</p><div role=navigation>{other}</div><p>{LONG}</p></article>")).split("\n") == [LONG, LONG]


def test_open_tags_take_no_quadratic_time():
    start = time.time()
    for piece in ("<a ", "<a", "</", "<!", '<a "', "<a '", '<a "x" ', "<script ", "<p <b ", "<!-- "):
        body = f"<article><p>{LONG}</p><p>{LONG}</p></article>" + piece * (1_000_000 // len(piece))
        assert html.main_text(page(body)[: -len("</body></html>")]).startswith(f"{LONG}\n{LONG}"), piece
        html.main_text(piece * (1_000_000 // len(piece)) + "'>")
        html.main_text(piece * (1_000_000 // len(piece)))
    assert time.time() - start < 30


def test_given_pages(spark):
    pages = spark.read.parquet("/root/testdata/sf0.1/pages.parquet")
    want = {}
    for r in pages.collect():
        inner = re.split(r"</article>|<footer", r.html.split("<article>", 1)[1])[0]
        blocks = re.sub(r"<[^>]*>", "", re.sub(r"</?(?:p|br|h1)>", "\n", inner)).split("\n")
        want[r.page_id] = "\n".join(filter(None, (" ".join(entities.unescape(b).split()) for b in blocks)))
    got = html.extract(pages).collect()
    assert {r.page_id: r.text for r in got} == want
    assert all(r.n_chars == len(r.text) for r in got)


def test_nulls_repeated_rows_and_extra_columns(spark):
    rows = [(1, "u", f"<article><p>{LONG}</p></article>", "x"), (1, "u", f"<article><p>{LONG}</p></article>", "x"), (None, None, None, None), (2, None, "", "y")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    got = sorted(map(tuple, html.extract(df).collect()), key=str)
    assert got == sorted([(1, "u", LONG, len(LONG))] * 2 + [(None, None, "", 0), (2, None, "", 0)], key=str)
    assert html.extract(df.limit(0)).collect() == []


def test_articles_that_begin_or_end_with_nested_containers_keep_them():
    table = "<table><tr><td>Year</td><td>Sum</td></tr><tr><td>2001</td><td>12</td></tr></table>"
    cells = ["Year", "Sum", "2001", "12"]
    short = "<section><p>One.</p><div><p>Two.</p></div></section>"
    outside = "<div><p>Short notice</p></div>"
    for around in ("article", "main", "div"):
        for first, last in (("", table), (table, ""), (short, ""), ("", short), (short, table)):
            want = [*(cells if first == table else ["One.", "Two."] if first else []), LONG, LONG, *(cells if last == table else ["One.", "Two."] if last else [])]
            body = f"{outside}<{around}>{first}<p>{LONG}</p><p>{LONG}</p>{last}</{around}>{outside}"
            assert html.main_text(page(body)).split("\n") == want, (around, first, last)
    nested = f"{outside}<article><div><p>Lead.</p></div><div><p>{LONG}</p></div><div><p>End.</p><p><a href=/x>Source</a></p></div></article>{outside}"
    assert html.main_text(page(nested)).split("\n") == ["Lead.", LONG, "End.", "Source"]
    bare = f"<p>{LONG}</p><table><tr><td>2001</td></tr></table><div><a href=/x>one</a> <a href=/y>two</a></div>"
    assert html.main_text(page(bare)).split("\n") == [LONG, "2001"]


def test_a_head_without_an_end_tag_ends_where_the_body_begins():
    head = "<html><head><meta charset=utf-8><title>A <p> title</title><script>var a='<p>';</script><link rel=x href=y>"
    for start in ("<body>", "<article>", "<div>", ""):
        assert html.main_text(f"{head}{start}<p>{LONG}</p><p>{LONG}") == f"{LONG}\n{LONG}"
    assert html.main_text(f"{head}{LONG}<p>More.") == f"{LONG}\nMore."
    assert html.main_text(f"<head><title>never closed<body><p>{LONG}</p>") == LONG
