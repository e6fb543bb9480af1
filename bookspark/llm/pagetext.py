"""Main text of web pages, with each site's template removed.

A page becomes a small element tree. Its subtrees are hashed, and Spark counts
on how many different pages of a host each one stands; what recurs on many of
them is the site's template and is deleted. Elements and class names that never hold
the article (menus, forms, comments and so on) go by rule, so that hosts with
few pages lose them too.
"""

from __future__ import annotations

import re
from html import unescape

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bookspark.llm._shared import SMALL, add_columns, cut, without

# Element names of HTML and names that sites give to parts beside the article.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template textarea title iframe xmp noembed noframes svg math canvas object audio video".split())
DROPPED = RAW | frozenset("head nav footer aside menu form button select option datalist dialog label fieldset".split())
BLOCK = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul br".split()
)
CLOSES_P = BLOCK - frozenset("br td th tr tbody thead tfoot html body".split())
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}, "tbody": {"tbody", "thead", "tr", "td", "th"}, "thead": {"tbody", "tr", "td", "th"}}
FENCES = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"table", "tr"}, "th": {"table", "tr"}, "option": {"select"}, "tbody": {"table"}, "thead": {"table"}}
BESIDE = frozenset(
    "ad ads adv advert adverts advertisement advertising adbox adslot banner breadcrumb breadcrumbs comment comments commentlist cookie cookies consent gdpr disqus footer masthead menu nav navbar navigation newsletter notice notification alert pager pagination popup modal overlay promo promotion recommended related reply replies respond share sharing sidebar signup skip social sponsor sponsored subscribe subscription toolbar topbar widget widgets".split()
)
ROLES = frozenset("navigation banner contentinfo complementary search dialog alertdialog alert menu menubar form".split())

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<(?P<raw>" + "|".join(sorted(RAW)) + r")\b(?:[^>=]|=\s*+(?:\"[^\"]*+\"|'[^']*+')?+)*+(?:>.*?(?:</(?P=raw)\s*>|\Z)|\Z)|<[!?][^>]*(?:>|\Z)|</(?P<end>[a-z][^\s/>]*)[^>]*(?:>|\Z)|<(?P<start>[a-z][^\s/>]*)(?P<attributes>(?:[^>=]|=\s*+(?:\"[^\"]*+\"|'[^']*+')?+)*+)(?:>|\Z)",
    re.I | re.S,
)
_ATTRIBUTE = re.compile(r"""([^\s"'<>/=]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>][^\s>]*)))?""")
_NAME = re.compile(r"[a-z]+")
_PART = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+")
# Last parts of a compound name that only say the place or kind of what its first part names; parts by which a name says what an element has; what a site's own header is called.
PLACES = frozenset("list left right top bottom area section container wrapper wrap box block inner outer bar panel posts articles stories links buttons icons items form".split())
HAVING = frozenset("no not non has with without".split())
SITE = frozenset("site global web top".split())


class Element:
    """articles, main and text are of the elements below: how many articles that are no comments, a main element or first heading, and any text."""

    __slots__ = ("tag", "attributes", "children", "hash", "articles", "main", "text")

    def __init__(self, tag: str, attributes: str = ""):
        self.tag, self.attributes, self.children, self.hash = tag, attributes, [], 0
        self.articles, self.main, self.text = 0, False, False


class _Path:
    """The open elements, and where those of each name stand."""

    def __init__(self, root: Element):
        self.elements, self.places = [root], {}

    def push(self, e: Element) -> None:
        self.places.setdefault(e.tag, []).append(len(self.elements))
        self.elements.append(e)

    def nearest(self, tags) -> int:
        return max((own[-1] for t in tags if (own := self.places.get(t))), default=0)

    def close(self, tags, fences) -> bool:
        """Close the nearest open element of these names, if none of the fences is nearer."""
        at = self.nearest(tags)
        if not at or self.nearest(fences) > at:
            return False
        for e in self.elements[at:]:
            self.places[e.tag].pop()
        del self.elements[at:]
        return True


def parse(html: str) -> Element:
    """The element tree of a page; unclosed and stray tags are mended as browsers do it in the main."""
    root = Element("#root")
    path = _Path(root)
    at = 0
    for m in _TOKEN.finditer(html):
        if m.start() > at:
            path.elements[-1].children.append(html[at : m.start()])
        at = m.end()
        if m["start"]:
            tag = m["start"].lower()
            if tag in CLOSES_P:
                path.close({"p"}, {"table", "td", "th", "article", "section", "div", "button", "li"})
            if tag in CLOSES:
                while path.close(CLOSES[tag], FENCES[tag]):
                    pass
            new = Element(tag, m["attributes"] or "")
            path.elements[-1].children.append(new)
            if tag not in VOID and not (m["attributes"] or "").endswith("/"):
                path.push(new)
        elif m["end"]:
            tag = m["end"].lower()
            path.close({tag}, {"article", "main", "body"} if tag not in ("article", "main", "body", "html") else set())
        elif m["raw"] is None:
            continue
    if at < len(html):
        path.elements[-1].children.append(html[at:])
    return root


def beside(e: Element, in_article: bool, articles: int = 0) -> bool:
    """The element never holds article text, by its name or what the site calls it; the page has so many articles."""
    if e.tag in DROPPED or e.tag == "header" and not in_article:
        return True
    if e.attributes and e.tag not in ("html", "body", "main"):
        for name, *values in _ATTRIBUTE.findall(e.attributes):
            given, name = "".join(values), name.lower()
            value = given.lower()
            if name == "role" and value in ROLES or name == "hidden" or name == "aria-hidden" and value == "true":
                return True
            if name in ("class", "id"):
                if e.tag == "article":
                    found = any(w in BESIDE for w in _NAME.findall(value) if w.startswith("comment"))
                else:
                    found = any(map(_names_beside, given.split()))
                if found and not _holds_article(e, articles):
                    return True
    return False


def _names_beside(name: str) -> bool:
    """A class name or id says that its element stands beside the article.

    Of a compound name the last part counts, or the first if the last is but a
    place; a name with a part of HAVING says what its element has.
    """
    if name.lower() in BESIDE:
        return True
    words = [w.lower() for w in _PART.findall(name)]
    if len(words) < 2 or not HAVING.isdisjoint(words):
        return False
    if words[-1] == "header":
        return words[0] in SITE
    return words[-1] in BESIDE or words[-1] in PLACES and words[0] in BESIDE


def _below(e: Element) -> list[Element]:
    """e and the elements below it, each before its own."""
    order, stack = [], [e]
    while stack:
        x = stack.pop()
        order.append(x)
        stack += [c for c in x.children if not isinstance(c, str)]
    return order


def _counted(root: Element) -> None:
    """Give every element its articles and main, from the leaves up."""
    for x in reversed(_below(root)):
        for c in x.children:
            if not isinstance(c, str):
                x.articles += c.articles + (c.tag == "article" and not beside(c, False))
                x.main = x.main or c.main or c.tag in ("main", "h1")


def _holds_article(e: Element, articles: int) -> bool:
    """All articles of the page, its main element or first heading are in e."""
    return e.tag != "article" and (e.main or 0 < articles == e.articles)


def trimmed(root: Element) -> list[Element]:
    """The elements that hold the page's text, all that is beside it taken out."""
    _counted(root)
    articles = root.articles
    stack = [(root, False)]
    while stack:
        x, inside = stack.pop()
        x.children = [c for c in x.children if isinstance(c, str) or not beside(c, inside, articles)]
        stack += [(c, inside or c.tag == "article") for c in x.children if not isinstance(c, str)]
    return [root]


def hashed(e: Element) -> None:
    """Give every element below e the hash of its subtree (names, order and text without extra white space), and whether there is text."""
    from xxhash import xxh64_intdigest

    for x in reversed(_below(e)):
        parts = [x.tag]
        for c in x.children:
            parts.append(" ".join(unescape(c).split()) if isinstance(c, str) else f"\x00{c.hash}")
            x.text = x.text or (bool(c.strip()) if isinstance(c, str) else c.text)
        x.hash = xxh64_intdigest("\x01".join(parts).encode("utf-8", "replace"), 0)


def subtrees(html: str) -> tuple[list[int], int]:
    """Hashes of the block subtrees with text beside or in the article, each once, and a hash of them all."""
    from xxhash import xxh64_intdigest

    seen: dict[int, None] = {}
    for top in trimmed(parse(html)):
        hashed(top)
        stack = [top]
        while stack:
            for c in stack.pop().children:
                if not isinstance(c, str):
                    stack.append(c)
                    if c.tag in BLOCK and c.tag not in ("body", "article", "main", "br", "hr") and c.text:
                        seen[c.hash] = None
    return list(seen), xxh64_intdigest(np.array(sorted(seen), np.uint64).tobytes(), 0)


def text_of(html: str, template: frozenset[int] = frozenset()) -> str:
    """The text of the article, without the subtrees of the template; one space between words and blocks."""
    out: list[str] = []
    for top in trimmed(parse(html)):
        if template:
            hashed(top)
        stack: list = [top]
        while stack:
            x = stack.pop()
            if isinstance(x, str):
                out.append(unescape(x))
            elif x is None:
                out.append(" ")
            elif not (template and x.hash in template and x is not top):
                gap = x.tag in BLOCK
                stack += [None] * gap + x.children[::-1] + [None] * gap
    return " ".join("".join(out).split())


def _signed(values) -> list[int]:
    return np.array(values, np.uint64).astype(np.int64).tolist()


def host_of(url):
    """The host of a URL column in lower case, without port; empty if there is none."""
    return F.coalesce(F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1)), F.lit(""))


def extract(pages: DataFrame, html: str = "html", url: str = "url", least_pages: int = 5, share: float = 0.5, many_pages: int = 200) -> DataFrame:
    """pages with text, the main text of each page.

    A subtree is template if it stands on at least `least_pages` different
    pages of its host and on at least `share` of them or on `many_pages`;
    pages with the same subtrees are one page here. Null or empty html gives an empty text;
    repeated rows stay. A column text is replaced.
    """
    kept = without(pages, ["text"])
    key = F.xxhash64(F.coalesce(F.col(f"`{html}`"), F.lit("")), host_of(F.col(f"`{url}`")))
    named = kept.withColumns({"__key": key, "__host": host_of(F.col(f"`{url}`"))})

    def make_hashes():
        def run(pages):
            rows = [subtrees(p.decode("utf-8", "replace")) if p else ([], 0) for p in pages]
            return [_signed(h) for h, _ in rows], _signed([w for _, w in rows])

        return run

    hashes = add_columns(named.select("__key", "__host", F.col(f"`{html}`").alias("__html")), "__html", "hashes array<long>, whole long", make_hashes).drop("__html")
    hashes = cut(hashes.where("size(hashes) > 0"))  # three plans ask for them: each page is read once
    # pages that are alike in all subtrees count once; a partial distinct comes before each shuffle
    counted = hashes.groupBy("__host", "whole").agg(F.first("hashes").alias("hashes"))
    sizes = counted.groupBy("__host").agg(F.count("*").alias("pages"))
    common = counted.select("__host", F.explode("hashes").alias("h")).groupBy("__host", "h").agg(F.count("*").alias("n")).where(F.col("n") >= least_pages)
    common = cut(common.join(sizes, "__host").where((F.col("n") >= share * F.col("pages")) | (F.col("n") >= many_pages)).select("__host", "h"))
    if common.limit(SMALL + 1).count() <= SMALL:
        # the templates of all hosts go to the pages, and no page is shuffled
        both = named.join(F.broadcast(common.groupBy("__host").agg(F.collect_set("h").alias("__template"))), "__host", "left")
    else:
        # by page and not by host, as a host may have a third of all pages
        mine = hashes.select("__key", "__host", F.explode("hashes").alias("h")).join(common, ["__host", "h"]).groupBy("__key").agg(F.collect_set("h").alias("__template"))
        both = named.join(mine, "__key", "left")

    def make_text():
        def run(rows):
            return ([text_of(r["html"].decode("utf-8", "replace"), frozenset(h % (1 << 64) for h in r["template"] or ())) if r["html"] else "" for r in rows],)

        return run

    source = F.struct(F.col(f"`{html}`").cast("binary").alias("html"), F.col("__template").alias("template"))
    out = add_columns(both, source, "text string", make_text, kind="struct<html: binary, template: array<long>>")
    return out.select(*[F.col(f"`{c}`") for c in kept.columns], "text")
