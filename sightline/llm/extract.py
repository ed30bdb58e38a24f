"""Main text of web pages from flat text blocks.

A page is cut into blocks at block-level tags. Each block has its word count and link density,
those of its neighbours, and what its ancestors say (a navigation tag, a class such as
``comments``, an article). A decision tree, trained on the small labelled table below by Gini
impurity, calls each block article or not; the page's text is its article blocks in order.

Pages are independent: one Arrow pass, no shuffle, and a worker holds one batch of pages. A page
is parsed in time linear in its length.

Edge cases: null or empty html, or a page without article blocks, gives an empty text. Tags left
open end with their parent or the page; closing tags without an open one are skipped; a comment,
script or tag that never ends runs to the end of the page. Repeated rows are extracted one by
one. Columns besides those named are ignored.
"""

from __future__ import annotations

import html as references
import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

#: Elements whose whole content is no text of the page.
SILENT = "script|style|noscript|template|textarea|title|iframe|svg|select|object|canvas|xmp"
TOKEN = re.compile(
    r"<!--(?:.*?-->|.*\Z)|<[!?][^>]*>|<svg(?=[\s/])(?:[^>\"'/]++|\"[^\"]*+\"|'[^']*+'|/(?!>))*+/>"
    rf"|<({SILENT})(?=[\s/>])(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+>(?:.*?</\1\s*>|.*\Z)"
    r"|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>"
    r"|<[/a-zA-Z][^>]*\Z",
    re.S | re.I,
)
#: One name with its value; a quote left open ends with the tag.
ATTRIBUTE = re.compile(r"([^\s/>=]+)(?:\s*=\s*(?:\"([^\"]*)(?:\"|\Z)|'([^']*)(?:'|\Z)|([^\s>]+)))?")
WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")

HEADINGS = frozenset(("h1", "h2", "h3", "h4", "h5", "h6"))
ITEMS = frozenset(("li", "dt", "dd", "td", "th"))
BLOCK = frozenset(
    "address article aside blockquote body button caption center dd details dialog dir div dl dt "
    "fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hr html label legend li "
    "main menu nav ol optgroup option p pre section summary table tbody td tfoot th thead tr ul".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: An opening tag of the key ends an open element of the value.
ENDS = {"li": {"li", "p"}, "dt": {"dt", "dd", "p"}, "dd": {"dt", "dd", "p"}, "tr": {"tr", "td", "th"}}
ENDS |= {"td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
ENDS |= {t: {"p"} for t in BLOCK - {"body", "html", "head", "li", "dt", "dd", "tr", "td", "th", "option", "button", "label"}}
CHROME_TAGS = frozenset("nav aside footer form menu dialog button fieldset".split())
CHROME_ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog menu menubar form".split())
ARTICLE_TAGS = frozenset("article main".split())
#: Words in a class or id that speak against an article, whole or as a beginning.
HINTS = frozenset(
    "ad ads adv adsense banner bar breadcrumb breadcrumbs bottombar byline cta disclaimer disqus feedback foot footer "
    "form gdpr head header hero legal login logo menu menus modal nav notice notices notification outbrain overlay "
    "pager pagination paywall popup privacy promo rail related reply respond responses search share sharing side "
    "sidebar sign signup skip social sponsor subscribe subscription taboola tags teaser toolbar top topbar "
    "widget widgets alert masthead toc".split()
)
HINT_STARTS = ("advert", "comment", "cookie", "consent", "copyright", "navig", "newsletter", "promot", "recommend", "replies", "sponsor", "discussion")
BODY_WORDS = frozenset("article content entry post story text body main".split())


@dataclass
class Block:
    text: str
    words: int
    linked: int
    heading: bool
    item: bool
    chrome: bool
    hint: bool
    hint_inside: bool
    article: bool


@dataclass
class _Open:
    tag: str
    chrome: bool
    hint: bool
    inside: bool
    article: bool
    silent: bool
    heading: bool = False
    item: bool = False


def _says(tag: str, attributes: str) -> tuple[bool, bool, bool]:
    """Whether an element's attributes make it chrome, hint at it, or hide it."""
    chrome = hint = hidden = False
    seen: set[str] = set()
    for name, *values in ATTRIBUTE.findall(attributes):
        name, value = name.lower(), next((v for v in values if v), "")
        if name in seen:  # the first of a name counts
            continue
        seen.add(name)
        if name == "hidden":
            hidden = True
        elif name == "aria-hidden":
            hidden |= value.strip().lower() == "true"
        elif name == "style":
            hidden |= "display:none" in value.replace(" ", "").lower()
        elif name == "role":
            chrome |= value.strip().lower() in CHROME_ROLES
        elif name in ("class", "id") and tag in ARTICLE_TAGS:
            hint |= tag == "article" and _names_no_article(value)
        elif name in ("class", "id") and tag not in ("html", "body"):
            hint |= any(map(_hints, WORD.findall(value)))
    return chrome, hint, hidden


def _hints(word: str) -> bool:
    return word.lower() in HINTS or word.lower().startswith(HINT_STARTS)


def _names_no_article(value: str) -> bool:
    """Whether an article's own class or id calls it something else, such as a comment.

    Only the first words of names say what it is: ``has-sidebar`` and ``tag-search`` tell of
    its layout or subject. A name that begins with a word for articles outweighs the others.
    """
    first = [words[0] for name in value.split() if (words := WORD.findall(name))]
    return any(map(_hints, first)) and not any(w.lower() in BODY_WORDS for w in first)


def blocks(page: str | None) -> list[Block]:
    """The text blocks of a page in order, in time linear in its length.

    Where elements of a tag, and block elements, lie on the stack is noted as they open, so no
    tag searches the stack, and each element is taken off it once.
    """
    out: list[Block] = []
    stack: list[_Open] = []
    places: dict[str, list[int]] = {}
    block_places: list[int] = []
    parts: list[str] = []
    links: list[str] = []
    depth_a = 0
    page = page or ""

    def flush() -> None:
        nonlocal parts, links
        text = " ".join("".join(parts).split())
        if text:
            top = stack[-1] if stack else _Open("", False, False, False, False, False)
            out.append(
                Block(
                    text,
                    text.count(" ") + 1,
                    len(" ".join(links).split()),
                    top.heading,
                    top.item,
                    top.chrome,
                    top.hint,
                    top.inside,
                    top.article,
                )
            )
        parts, links = [], []

    def drop(place: int) -> None:
        nonlocal depth_a
        while len(stack) > place:
            tag = stack.pop().tag
            places[tag].pop()
            if tag in BLOCK:
                block_places.pop()
            depth_a -= tag == "a"

    def close(place: int) -> None:
        flush()
        drop(place)

    at = 0
    for token in TOKEN.finditer(page):
        if token.start() > at and not (stack and stack[-1].silent):
            piece = references.unescape(page[at : token.start()])
            parts.append(piece)
            if depth_a:
                links.append(piece)
        at = token.end()
        tag = (token[3] or token[6] or "").lower()
        if not tag:
            continue
        if token[2] or token[5]:  # a closing tag
            place = places[tag][-1] if places.get(tag) else None
            if tag in BLOCK:
                if place is None:
                    flush()
                else:
                    close(place)
            elif place is not None:
                # inline elements end without ending the block, unless blocks are open in them
                if not (block_places and block_places[-1] > place):
                    drop(place)
            continue
        if tag in ("br", "wbr", "img", "input"):
            parts.append(" " if tag != "wbr" else "")
            continue
        if tag in BLOCK:
            ends = ENDS.get(tag, ())
            # past paragraphs only, as tags that others end are all blocks
            for i in reversed(block_places):
                if stack[i].tag in ends:
                    close(i)
                    break
                if stack[i].tag != "p":
                    break
            flush()
        if tag in VOID:
            continue
        above = stack[-1] if stack else _Open("", False, False, False, False, False)
        attributes = token[4] or token[7] or ""
        chrome, hint, hidden = _says(tag, attributes) if attributes else (False, False, False)
        article = tag in ARTICLE_TAGS
        stack.append(
            _Open(
                tag,
                above.chrome or chrome or tag in CHROME_TAGS or (tag == "header" and not above.article),
                above.hint or hint,
                hint or (above.inside and not article),
                above.article or article,
                above.silent or hidden,
                above.heading or tag in HEADINGS,
                above.item or tag in ITEMS,
            )
        )
        places.setdefault(tag, []).append(len(stack) - 1)
        if tag in BLOCK:
            block_places.append(len(stack) - 1)
        depth_a += tag == "a"
        if attributes.rstrip().endswith("/") and tag not in BLOCK:
            drop(len(stack) - 1)
    if at < len(page) and not (stack and stack[-1].silent):
        parts.append(references.unescape(page[at:]))
        if depth_a:
            links.append(parts[-1])
    flush()
    return out


FEATURES = (
    "words", "linked", "words_before", "linked_before", "words_after", "linked_after",
    "heading", "item", "chrome", "hint", "hint_inside", "article",
)


def features(found: list[Block]) -> np.ndarray:
    """One row per block; of the neighbours, word count and link density."""
    n = len(found)
    own = np.array([[b.words, b.linked / b.words] for b in found], float).reshape(n, 2)
    edge = np.zeros((1, 2))
    before, after = np.vstack([edge, own[:-1]])[:n], np.vstack([own[1:], edge])[:n]
    marks = np.array(
        [[b.heading, b.item, b.chrome, b.hint, b.hint_inside, b.article] for b in found], float
    ).reshape(n, 6)
    return np.hstack([own, before, after, marks])


#: The labelled table: pages in which ``[+n]`` stands for n words of an article and ``[-n]`` for
#: n words that are not of it.
LABELLED = (
    "<nav><ul><li><a>[-1]</a></li><li><a>[-1]</a></li><li><a>[-2]</a></li></ul></nav><div class=ad>[-8]</div>"
    "<article><h1>[+9]</h1><p>[+60]</p><p>[+3]</p><p>[+1]</p><p>[+25]</p></article><footer>[-14]</footer>",
    "<header><h1>[-3]</h1><p>[-12]</p></header><main><h2>[+6]</h2><p>[+90]</p><ul><li>[+7]</li><li>[+4]</li></ul>"
    "<p>[+2]</p><blockquote>[+18]</blockquote></main><aside><h3>[-2]</h3><p>[-45]</p><ul><li><a>[-5]</a></li></ul></aside>"
    "<form><label>[-2]</label><button>[-1]</button><p>[-30]</p></form><footer><p>[-40]</p><a>[-2]</a></footer>",
    "<div id=header>[-4]</div><div class=menu><a>[-1]</a><a>[-1]</a><a>[-1]</a></div><div class=content><h1>[+5]</h1>"
    "<p>[+35]</p><p>[+80]</p><p>[+6]</p></div><div class=sidebar><p>[-25]</p><a>[-4]</a></div>"
    "<div class=comments><h2>[-2]</h2><p>[-30]</p><p>[-55]</p><p>[-4]</p></div><div id=footer>[-10]</div>",
    "<div class=cookie-notice><p>[-22]</p><button>[-1]</button></div><article><h1>[+7]</h1><p>[+40]</p>"
    "<div class=advert>[-15]</div><p>[+50]</p><div class=related><a>[-8]</a><a>[-6]</a></div><p>[+10]</p>"
    "<section class=comments><p>[-42]</p><p>[-9]</p></section></article>",
    "<div><a>[-1]</a> <a>[-1]</a> <a>[-1]</a> <a>[-2]</a></div><div><h1>[+6]</h1><div>[+70]</div><div>[+45]</div>"
    "<div>[+20]</div><div>[+66]</div></div><div><a>[-3]</a> <a>[-2]</a> [-1]</div><div><a>[-5]</a></div>",
    "<table><tr><td><a>[-1]</a></td><td><a>[-1]</a></td></tr></table><p>[+48]</p><p>[+33]</p><p>[+55]</p><p>[-1] <a>[-3]</a> <a>[-2]</a></p>",
    "<article><h1>[+6]</h1><p>[+120]</p><p>[+90]</p><p>[+150]</p><p>[+4]</p><p>[+200]</p><p>[+12]</p></article>",
    "<h1>[+3]</h1><p>[+100]</p><p>[+80]</p><p>[+110]</p><p>[+75]</p><p>[+1]</p><p>[+2]</p><p>[+95]</p><p>[+30]</p>",
    "<div class=post><h2>[+5]</h2><p>[+130]</p><p>[+18]</p><p>[+7]</p><p>[+140]</p><p>[+85]</p></div>",
    "<body><p>[+15]</p></body>",
    "<div class=article-body><p>[+9]</p><p>[+210]</p><ul><li>[+160]</li><li>[+14]</li></ul><p>[+77]</p><p>[+22]</p></div>",
    "<div class=page-with-sidebar><article><h1>[+4]</h1><p>[+30]</p><p>[+5]</p><p>[+64] <a>[+3]</a> [+10]</p>"
    "<p>[+100]</p><p>[+90]</p><p>[+16]</p><h2>[+3]</h2><p>[+44]</p></article>"
    "<div class=sidebar><article><p>[-12]</p></article></div></div><div role=contentinfo>[-20]</div>",
    "<article><header><h1>[+8]</h1></header><p>[+20]</p><figure><figcaption>[+9]</figcaption></figure><p>[+2] <a>[+2]</a></p>"
    "<ol><li>[+12]</li><li><a>[+3]</a> [+4]</li></ol><table><tr><td>[+2]</td><td>[+3]</td></tr></table>"
    "<footer>[-6]</footer></article><div class=newsletter><p>[-24]</p></div><div class=popup>[-33]</div>",
    "<div class=notice>[-50]</div><nav>[-30]</nav><aside>[-90]</aside><article><p>[+1]</p></article>"
    "<div id=comments><div><p>[-80]</p></div></div><form><p>[-70]</p></form><footer>[-100]</footer>",
    "<main><nav><a>[-2]</a></nav><p>[+4]</p><p>[+300]</p><aside>[-20]</aside><p>[+15]</p><div class=share><a>[-1]</a> [-3]</div>"
    "<form>[-9]</form><div class='sponsor'><p>[-28]</p></div></main>",
    "<main class='has-sidebar no-header'><h1>[+6]</h1><p>[+70]</p><p>[+45]</p><p>[+3]</p></main><footer>[-12]</footer>",
    "<article class='post tag-search category-privacy share-open'><h1>[+7]</h1><p>[+55]</p><p>[+20]</p><p>[+80]</p></article>"
    "<article class='comment byuser'><p>[-35]</p><p>[-60]</p></article><article class=teaser><p>[-14]</p></article>",
)


@cache
def labelled_rows() -> tuple[np.ndarray, np.ndarray]:
    """Features and labels of the table's blocks."""
    rows, labels = [], []
    for page in LABELLED:
        filled = re.sub(r"\[([+-])(\d+)\]", lambda m: " ".join([{"+": "in", "-": "out"}[m[1]]] * int(m[2])), page)
        found = blocks(filled)
        rows.append(features(found))
        labels += [b.text.split()[0] == "in" for b in found]
    return np.vstack(rows), np.array(labels)


@dataclass
class Node:
    share: float
    feature: int = -1
    cut: float = 0.0
    below: Node | None = None
    above: Node | None = None


def grown(x: np.ndarray, y: np.ndarray, depth: int = 6, least: int = 2) -> Node:
    """A tree by Gini impurity; ties go to the first feature and the lowest cut."""
    node = Node(float(y.mean()) if len(y) else 0.0)
    if depth == 0 or len(y) < 2 * least or node.share in (0.0, 1.0):
        return node
    best = 2 * node.share * (1 - node.share) * len(y) - 1e-9
    for f in range(x.shape[1]):
        values = np.unique(x[:, f])
        for cut in (values[1:] + values[:-1]) / 2:
            low = x[:, f] <= cut
            if min(low.sum(), (~low).sum()) < least:
                continue
            impurity = sum(2 * len(p) * p.mean() * (1 - p.mean()) for p in (y[low], y[~low]))
            if impurity < best - 1e-9:
                best, node.feature, node.cut = impurity, f, float(cut)
    if node.feature >= 0:
        low = x[:, node.feature] <= node.cut
        node.below = grown(x[low], y[low], depth - 1, least)
        node.above = grown(x[~low], y[~low], depth - 1, least)
    return node


def classified(node: Node, x: np.ndarray) -> np.ndarray:
    """Whether each row is article."""
    if node.feature < 0:
        return np.full(len(x), node.share > 0.5)
    low = x[:, node.feature] <= node.cut
    out = np.empty(len(x), bool)
    out[low], out[~low] = classified(node.below, x[low]), classified(node.above, x[~low])
    return out


@cache
def tree() -> Node:
    return grown(*labelled_rows())


def main_texts(pages: list[str | None]) -> list[str]:
    """The article text of each page."""
    found = [blocks(p) for p in pages]
    sizes = [len(f) for f in found]
    if not sum(sizes):
        return [""] * len(pages)
    kept = np.split(classified(tree(), np.vstack([features(f) for f in found])), np.cumsum(sizes)[:-1])
    return ["\n".join(b.text for b, k in zip(f, own, strict=True) if k) for f, own in zip(found, kept, strict=True)]


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, 64):
            part = batch.slice(at, 64)
            texts = main_texts(part.column("html").to_pylist())
            yield pa.RecordBatch.from_arrays(
                [
                    part.column("page_id"),
                    part.column("url"),
                    pa.array(texts, pa.string()),
                    pa.array([len(t) for t in texts], pa.int64()),
                ],
                names=["page_id", "url", "text", "n_chars"],
            )


def extracted(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars) per row of ``pages``."""
    kept = pages.select("page_id", "url", "html")
    kind = dict(kept.dtypes)
    return kept.mapInArrow(
        _extract, f"page_id {kind['page_id']}, url {kind['url']}, text string, n_chars long"
    )
