"""Names of parts beside the article, and pages of many unclosed or nested tags."""

import time

import pytest

from bookspark.llm import pagetext
from bookspark.llm._shared import prepare

GONE = ["post-comments", "cookie-notice", "ad-banner", "site-header", "site-footer", "comments-list", "sidebar-left", "leftSidebar", "newsletter_box", "related-posts", "share-buttons", "AdContainer", "comments"]
STAYS = ["share-price", "related-work", "no-sidebar", "page-banner-wrap", "with-sidebar", "has-comments", "post-header", "entry-content", "commentary", "adventure", "x-1", "menuitem"]


@pytest.mark.parametrize("name", GONE)
@pytest.mark.parametrize("attribute", ["class", "id"])
def test_parts_beside_go_by_the_head_of_their_name(name, attribute):
    assert pagetext.text_of(f"<div {attribute}='{name}'>k</div><article>x</article><div {attribute}='a-b {name}'>c</div>") == ("x" if attribute == "class" else pagetext.text_of(f"<article>x</article><div id='a-b {name}'>c</div>"))


@pytest.mark.parametrize("name", STAYS)
def test_other_names_stay(name):
    assert pagetext.text_of(f"<div class='{name}'>k</div><article>x</article>") == "k x"


def test_what_holds_the_article_stays():
    assert pagetext.text_of("<div class='left-sidebar'><h1>T</h1> x</div>") == "T x"
    assert pagetext.text_of("<article>x</article><div class='post-comments'>c</div><div class='cookie-notice'>k</div>") == "x"
    assert pagetext.text_of("<div class='site-header'>S</div><p>t</p><div id='site-footer'>F</div>") == "t"


PAGES = {
    "unclosed inline": lambda n: "<i>" * n + "<h1></h1>" * n + "end",
    "stray ends": lambda n: "<div>" * n + "</span>" * n + "end",
    "fenced paragraph": lambda n: "<p><table>" + "<i>" * n + "<h2></h2>" * n + "end",
    "nested banners": lambda n: "<div class=banner>" * n + "<h1>end</h1>",
    "nested empty": lambda n: "<div>" * n + "</div>" * n + "end",
    "list items": lambda n: "<ul>" + "<li><b>" * n + "end",
}


@pytest.mark.parametrize("name", PAGES)
def test_a_megabyte_of_tags_takes_seconds(name):
    html = PAGES[name](1_000_000 // len(PAGES[name](1).replace("end", "")))
    began = time.process_time()
    assert pagetext.text_of(html) == "end"
    pagetext.subtrees(html)
    assert time.process_time() - began < 15


def test_pages_of_odd_rows(spark):
    rows = [(1, "http://a.x/1", None, "t"), (2, None, "", "t"), (None, "http://a.x/2", "<p>one", "t"), (3, "no url", "<p>one", None), (3, "no url", "<p>one", None), (4, "http://a.x/3", "<p>é &amp; b\n c", "t")]
    pages = prepare(spark).createDataFrame(rows, "page_id long, url string, html string, text string")
    got = sorted(((r["page_id"] or 0, r["text"]) for r in pagetext.extract(pages).collect()))
    assert got == [(0, "one"), (1, ""), (2, ""), (3, "one"), (3, "one"), (4, "é & b c")]
    assert pagetext.extract(pages.limit(0)).count() == 0


@pytest.mark.parametrize("small", [True, False])
def test_templates_by_host_and_by_page_are_the_same(spark, monkeypatch, small):
    if not small:
        monkeypatch.setattr(pagetext, "SMALL", 0)
    part = "<section>about us {h}</section>"
    rows = [(k, f"http://{h}.x/{k}", f"<p>text {k}</p>{part.format(h=h)}<p>end of {k % 2}</p>") for h in "abc" for k in range(6 if h != "c" else 3)]
    got = pagetext.extract(prepare(spark).createDataFrame(rows, "page_id long, url string, html string"), share=0.6)
    assert sorted((r["url"], r["text"]) for r in got.collect()) == sorted((u, f"text {k} end of {k % 2}" if u[7] != "c" else f"text {k} about us c end of {k % 2}") for k, u, _ in rows)
