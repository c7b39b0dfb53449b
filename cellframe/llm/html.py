"""Main text of web pages by line-block distribution.

Markup is stripped first: comments, scripts, styles and other elements without text of their own go, and so do
elements that hold menus, headers, footers, sidebars, notices, adverts, forms and reader comments, told by their tag or
by a class, id or role that names nothing else (``cookie-notice``, not ``social-science``); inside an article only by one
that names an advert, comment or form. A tag that the page's end cuts off is no text. What is left are lines: one for each block, with character references
decoded and white space turned into single spaces. A line weighs as many characters as it has outside of links.

The weights are summed over blocks of BLOCK lines. The text surges at the first line whose block reaches the
threshold and dives after the last one; the threshold is SURGE characters, or half of the largest block on a page
with less. Lines between surge and dive are kept. So are their neighbours in the same container (the article or main
element around them, or else the section) and in those nested in it, which keeps headings, short closing lines and
tables; where that is the body itself, lines of nested ones that are mostly links go at the edge.

A head ends at its end tag, or where its end tag is left out, at the first text or element that can't be in it.

Nulls: null html has the empty text and no characters; a null page_id or url is kept. A page without text outside
of the stripped elements has the empty text. Repeated rows give repeated rows.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BLOCK, SURGE = 3, 86

#: Elements whose content is no text, and elements that are no part of the article.
SILENT = frozenset("script style noscript template svg math canvas iframe object textarea select option audio video map head title".split())
APART = frozenset("nav footer aside form button menu dialog".split())
INLINE = frozenset("a abbr b bdi bdo big cite code del dfn em font i ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr img input".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements of a head; any other ends it.
HEAD = frozenset("base link meta noscript script style template title".split())
SECTION = frozenset("article main section div td body".split())
#: Words of a class, id or role that tell what is no part of the article, those that may go with them in one name, and
#: those of a wrapper around all of the article.
APART_WORDS = frozenset(
    "ad ads advert advertisement adverts banner breadcrumb breadcrumbs comment comments cookie cookies consent copyright disclaimer disqus footer login "
    "masthead menu modal nav navbar navigation newsletter notice notices overlay pager pagination popup promo promoted related replies search share "
    "sharing sidebar signup social sponsor sponsored subscribe toolbar widget complementary contentinfo alert".split()
)
PLAIN_WORDS = frozenset(
    "a area articles bar block bottom box btn button buttons col column desktop fixed form global group header holder icon icons inner item items left link "
    "links list media message mobile module outer panel policy posts primary right row secondary section site slot sticky stories top unit wrap zone".split()
)
WRAPPER_WORDS = frozenset("article body container content entry has main no page post story with wrapper".split())
#: Of these words, those that hold inside an article too.
INNER_WORDS = frozenset(
    "ad ads advert advertisement adverts banner comment comments disqus login newsletter promo promoted replies signup sponsor sponsored subscribe".split())

TAG = re.compile(
    r"<!--.*?(?:-->|\Z)|<(?P<silent>script|style|noscript|template|svg|math|canvas|iframe|object|textarea|select|audio|video)\b(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+>.*?(?:</(?P=silent)\s*>|\Z)"
    r"|<title\b(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+>.*?(?:</title\s*>|(?=</head\b|<body\b)|\Z)"
    r"|<(?P<end>/?)(?P<name>[a-zA-Z][a-zA-Z0-9:-]*)(?P<rest>(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>|</?[a-zA-Z!?][^>]*>|<[!?][^>]*>",
    re.S | re.I,
)
NAMED = re.compile(r"""\b(class|id|role)\s*=\s*("[^"]*"|'[^']*'|[^\s>]+)""", re.I)
HIDDEN = re.compile(r"""\s(?:hidden(?:\s|=|$)|aria-hidden\s*=\s*["']?true|style\s*=\s*["'][^"']*display\s*:\s*none)""", re.I)
WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|[0-9]+")
OPEN = re.compile(r"<[a-zA-Z/!?]")


def names_apart(token: str, telling: frozenset[str]) -> bool:
    """Whether a name is made of telling words and plain ones alone."""
    words = {w.lower() for w in WORD.findall(token)}
    return bool(words & telling) and words <= APART_WORDS | PLAIN_WORDS


def is_apart(name: str, rest: str, in_article: bool) -> bool:
    """Whether an element is no part of the article."""
    if name in APART or name == "header" and not in_article:
        return True
    if not rest or name in ("html", "body", "main", "article"):
        return False
    if HIDDEN.search(rest):
        return True
    named = [(kind.lower(), token) for kind, value in NAMED.findall(rest) for token in value.strip("\"'").split()]
    if any(w.lower() in WRAPPER_WORDS for _, token in named for w in WORD.findall(token)):
        return False
    if any(kind == "role" and token.lower() in APART_WORDS for kind, token in named):
        return True
    telling = INNER_WORDS if in_article else APART_WORDS | {"header"}
    return any(names_apart(token, telling) for _, token in named)


def whole_tags(page: str) -> str:
    """The page up to a tag that never ends: no pattern has to look for its end from every ``<`` again."""
    cut = OPEN.search(page, page.rfind(">") + 1)
    return page[: cut.start()] if cut else page


def lines(page: str) -> tuple[list[tuple[str, int, int]], list[tuple[str, int]]]:
    """(text, characters in links, container) of every block outside of stripped elements; (name, parent) of every container."""
    out: list[tuple[str, int, int]] = []
    parts: list[str] = []
    linked = 0
    stack: list[tuple[str, bool, int]] = [("", False, 0)]  # name, apart, container
    containers = [("", 0)]
    links, articles, at = 0, 0, 0
    page = whole_tags(page)

    def close() -> None:
        nonlocal linked
        text = " ".join(html.unescape("".join(parts)).split()) if parts else ""
        if text:
            out.append((text, min(linked, len(text)), stack[-1][2]))
        parts.clear()
        linked = 0

    def pop(depth: int) -> None:
        nonlocal links, articles
        for name, _, _ in stack[depth:]:
            links -= name == "a"
            articles -= name == "article"
        del stack[depth:]

    for match in TAG.finditer(page):
        if stack[-1][0] == "head" and not page[at : match.start()].isspace() and match.start() > at:
            pop(len(stack) - 1)
        if match.start() > at and not stack[-1][1]:
            text = page[at : match.start()]
            parts.append(text)
            if links:
                linked += len(text)
        at = match.end()
        name = match.group("name")
        if name is None:
            continue
        name = name.lower()
        inline = name in INLINE
        if stack[-1][0] == "head" and not match.group("end") and name not in HEAD:
            pop(len(stack) - 1)
        if name == "head" and not match.group("end"):
            if all(open_ in ("", "html") for open_, _, _ in stack):  # elsewhere the tag means nothing
                close()
                stack.append((name, True, stack[-1][2]))
            continue
        if not inline:
            close()
        if match.group("end"):
            for depth in range(len(stack) - 1, 0, -1):
                if stack[depth][0] == name:
                    pop(depth)
                    break
                if inline and stack[depth][0] not in INLINE:
                    break
        elif name not in VOID:
            if not inline:  # a paragraph ends where the next block begins
                for depth in range(len(stack) - 1, 0, -1):
                    if stack[depth][0] == "p":
                        pop(depth)
                        break
                    if stack[depth][0] not in INLINE:
                        break
            if match.group("rest").endswith("/"):
                continue
            apart = stack[-1][1] or is_apart(name, match.group("rest"), articles > 0)
            if name in SECTION:
                containers.append((name, stack[-1][2]))
            stack.append((name, apart, len(containers) - 1 if name in SECTION else stack[-1][2]))
            links += name == "a"
            articles += name == "article"
    if stack[-1][0] == "head" and page[at:].strip():
        pop(len(stack) - 1)
    if at < len(page) and not stack[-1][1]:
        parts.append(page[at:])
    close()
    return out, containers


def homes(own: set[int], containers: list[tuple[str, int]]) -> set[int]:
    """The given containers and the articles around them.

    That is the next article, or else main element; or else, of a cell, what its table is in. A container around all
    of the given ones counts too, but for the body.
    """
    found, chains = set(), []
    for c in own:
        chain = [c]
        while chain[-1]:
            chain.append(containers[chain[-1]][1])
        names = [containers[x][0] for x in chain]
        for kind in ("article", "main"):
            if kind in names:
                found.add(chain[names.index(kind)])
                break
        else:
            found.add(next(x for x, name in zip(chain, names) if name != "td"))
        chains.append(chain)
    shared = next(x for x in chains[0] if all(x in chain for chain in chains))
    return found | own | ({shared} if containers[shared][0] not in ("", "body") else set())


def main_text(page: str | None) -> str:
    """The article's blocks, joined by a line break."""
    found, containers = lines(page or "")
    if not found:
        return ""
    weight = [len(text) - in_links for text, in_links, _ in found]
    block = [sum(weight[i : i + BLOCK]) for i in range(len(found))]
    threshold = min(SURGE, max(block) / 2)
    if threshold <= 0:
        return ""
    high = [i for i, (b, w) in enumerate(zip(block, weight)) if b >= threshold and w]
    surge, dive = high[0], high[-1]
    while dive + 1 < len(found) and weight[dive + 1] and dive + 1 < high[-1] + BLOCK:
        dive += 1
    heavy = max(range(surge, dive + 1), key=lambda i: (weight[i], -i))
    inside = homes({found[i][2] for i in range(surge, dive + 1) if weight[i] >= SURGE} | {found[heavy][2]}, containers)
    within, firm = [False] * len(containers), [False] * len(containers)
    for c, (_, parent) in enumerate(containers):  # a parent comes before its children
        within[c] = c in inside or c > 0 and within[parent]
        firm[c] = c in inside or c > 0 and firm[parent] and containers[parent][0] not in ("", "body")
    stays = [within[c] and (firm[c] or 2 * w > len(text)) for (text, _, c), w in zip(found, weight)]
    while not stays[surge]:
        surge += 1
    while not stays[dive]:
        dive -= 1
    at = surge
    while at and within[found[at - 1][2]]:
        at -= 1
        surge = at if stays[at] else surge
    at = dive
    while at + 1 < len(found) and within[found[at + 1][2]]:
        at += 1
        dive = at if stays[at] else dive
    return "\n".join(text for text, _, _ in found[surge : dive + 1])


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars (code points of the text) of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(x) for x in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array(list(map(len, texts)), pa.int64())], ["page_id", "url", "text", "n_chars"]
            )

    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html")
    return rows.mapInArrow(run, "page_id long, url string, text string, n_chars long")
