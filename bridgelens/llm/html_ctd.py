"""Main-text extraction by composite text density.

The page is read into a DOM of nodes.  Scripts, styles, controls and hidden parts carry no text.  For every node the
composite density is its characters per tag, adjusted by its links:

    C / T * ln(C / LC * T / LT) / ln(ln(C / (C - LC) * LC + LCb / Cb * C + e))

with C characters, T tags, LC and LT those inside links, and b for the body; 0 counts as 1 in a
divisor.  A container's density sum adds the densities of its children.  The container with
the greatest sum is the article, or if an ``article`` or ``main`` holds it, the whole of that.  Composite density
grows with a node's size, so other parts of the page are compared by characters outside links per tag: a part
with half the least of the article's path to the body belongs to the text, and so does a heading before a part
beside it that does.

Menus, headers, footers, sidebars, notices, adverts, forms and comments are told by evidence, not by a name alone.
An element or a name that says so (``strong``) marks its part as noise, unless the part holds most of the page's
text outside links, and either an article, a main or a first heading of its own or nearly all such text: then it is a
wrapper around the article.  A name of which only a piece says so, among other words (``weak``), counts for a part that is
small and mostly links.  A form is a strong mark, too; controls inside a wrapper stay noise.

Reading is linear in the page: open elements are found by their tag's own stack, and unclosed quotes are followed
for a bounded part of the page.

Defined results: a null or empty page, or one without text, gives an empty text; a page that ends early gives what
it holds, without an unfinished tag; rows are independent, so ids may be null or repeated.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame

from bridgelens.llm.common import map_arrow, text_slices

#: a comment, a tag, another declaration, or what a page that ends early leaves; attributes may hold > in quotes
_TOKEN = re.compile(
    r"""<!--.*?(?:-->|\Z)|<(?P<end>/?)(?P<tag>[a-zA-Z][^\s/>]*+)(?P<attrs>(?:[^>"']++|"[^"]*+"|'[^']*+')*+)>"""
    r"""|<[!?/][^a-zA-Z>][^>]*+(?:>|\Z)|<[!?][^>]*+(?:>|\Z)|</?\Z|</>""",
    re.S,
)
#: a tag whose quotes do not close
_LOOSE = re.compile(r"<(?P<end>/?)(?P<tag>[a-zA-Z][^\s/>]*+)(?P<attrs>[^>]*+)(?P<closed>>|\Z)", re.S)
_NAMES = re.compile(r"""\b(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_HIDDEN = re.compile(r"""(?:^|\s)hidden(?:\s|=|$)|aria-hidden\s*=\s*["']?true|display\s*:\s*none""", re.I)
#: Quotes that do not close may be followed for so many times the page's length in all, and then for so many characters each.
PATIENCE, NEAR = 8, 2048

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style title textarea noscript template iframe".split())
#: elements that never hold the article's text
DEAD_TAGS = frozenset("script style title textarea noscript template iframe head button select option svg canvas object audio video".split())
#: elements that say they are beside the article
BESIDE_TAGS = frozenset("nav footer aside form dialog menu".split())
HEAD_TAGS = frozenset("base link meta title style script noscript template".split())
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
PARAGRAPHS = frozenset("p h1 h2 h3 h4 h5 h6 li dt dd pre blockquote figcaption caption".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: words in a class, id or role that mark a block beside the article
NOISE_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense banner breadcrumb breadcrumbs comment comments consent cookie cookies disqus footer gdpr login masthead menu modal nav navbar navigation newsletter notice notices overlay pager pagination popup promo promotion recommended related replies respond share sharing sidebar signup social sponsor sponsored subscribe toolbar widget widgets alert complementary contentinfo search".split()
)
#: words beside those that leave a name's meaning as it is
PLAIN_WORDS = frozenset(
    "area aside block body bottom box bar button buttons card center col column container content div fixed form group head holder icons id inner item items js left link links list main outer page panel part post posts primary right row section secondary site slot small sticky text thread title top unit wrap wrapper".split()
)
HEADERS = frozenset(("header", "site-header", "page-header", "siteheader", "pageheader", "topbar"))
#: an opening tag that ends an open element of the same list, up to the elements that hold lists
CLOSES = {"li": (("li",), ("ul", "ol", "menu")), "dt": (("dt", "dd"), ("dl",)), "dd": (("dt", "dd"), ("dl",)), "tr": (("tr", "td", "th"), ("table",)), "td": (("td", "th"), ("tr", "table")), "th": (("td", "th"), ("tr", "table")), "option": (("option",), ("select",))}
_BLOCK_CLOSES = (("p",), ("table", "td", "th", "button", "article", "section", "div", "li", "body", "blockquote"))
_END_WALLS = ("body", "html", "table")
#: Marks of a node.
NONE, WEAK, STRONG, DEAD = range(4)
#: A strongly marked part is a wrapper from this share of the page's text outside links on; with no heading of its own,
#: from the second share on.  A weakly marked one is noise up to the third share, if most of it is links.
MOST, NEARLY_ALL, SMALL = 0.5, 0.95, 0.2


def name_mark(attrs: str) -> int:
    """What an element's class, id and role say."""
    mark = NONE
    for m in _NAMES.finditer(attrs):
        for name in (m[1] or m[2] or m[3] or "").lower().split():
            if name in HEADERS:
                return STRONG
            parts = [x for x in re.split(r"[-_:]+", name) if x]
            if NOISE_WORDS.isdisjoint(parts):
                continue
            if all(x in NOISE_WORDS or x in PLAIN_WORDS or x.isdigit() for x in parts):
                return STRONG
            mark = WEAK
    return mark


class Page:
    """The DOM as parallel lists in page order (a parent comes before its children)."""

    def __init__(self, html: str) -> None:
        self.tag: list[str] = ["#page"]
        self.parent: list[int] = [-1]
        self.last: list[int] = [0]
        self.mark: list[int] = [NONE]
        #: nearest node, itself or above, that is not inline
        self.holder: list[int] = [0]
        #: (holder, text) of every block of text
        self.blocks: list[tuple[int, str]] = []
        #: characters directly in a node
        self.chars: list[int] = [0]
        self.dead: list[bool] = [False]
        self._open = [0]
        #: for each tag, where it is in the list of open elements
        self._where: dict[str, list[int]] = {}
        self._text: list[str] = []
        self._read(html)
        self._weigh()

    def _read(self, html: str) -> None:
        at, seen_html, patience, n = 0, False, PATIENCE * len(html), len(html)
        while True:
            start = html.find("<", at)
            if start < 0:
                self._add(html[at:])
                break
            m = _TOKEN.match(html, start) if patience > 0 else _TOKEN.match(html, start, min(n, start + NEAR))
            if m is not None and patience <= 0 and m.end() < n and m.end() == start + NEAR:
                m = None  # an end that is only the end of the part looked at
            if m is None:
                patience -= n - start
                m = _LOOSE.match(html, start)
            if m is None:  # no tag
                self._add(html[at : start + 1])
                at = start + 1
                continue
            if start > at:
                self._add(html[at:start])
            at = m.end()
            tag = (m["tag"] or "").lower()
            if not tag or ("closed" in m.re.groupindex and not m["closed"]):
                continue
            if m["end"]:
                self._end(tag)
                continue
            if tag == "html":
                if seen_html:
                    continue
                seen_html = True
            self._start(tag, m["attrs"])
            if tag in RAW:
                stop = re.compile(f"</{tag}(?=[\\s/>])[^>]*>?", re.I).search(html, at)
                self._end(tag)
                at = stop.end() if stop else n
        self._flush()
        while self._open:
            self._pop()

    def _add(self, text: str) -> None:
        node = self._open[-1]
        if text and not self.dead[node]:
            text = unescape(text) if "&" in text else text
            self._text.append(text)
            self.chars[node] += sum(map(len, text.split()))

    def _flush(self) -> None:
        if self._text:
            text = " ".join("".join(self._text).split())
            if text:
                self.blocks.append((self.holder[self._open[-1]], text))
            self._text = []

    def _pop(self) -> None:
        node = self._open.pop()
        self.last[node] = len(self.tag) - 1
        if node:
            self._where[self.tag[node]].pop()

    def _latest(self, tags: tuple[str, ...]) -> int:
        """The place of the innermost open element with one of the tags (0 if there is none)."""
        return max((self._where[t][-1] for t in tags if self._where.get(t)), default=0)

    def _pop_to(self, tags: tuple[str, ...], walls: tuple[str, ...]) -> None:
        k = self._latest(tags)
        if k and k >= self._latest(walls):
            while len(self._open) > k:
                self._pop()

    def _start(self, tag: str, attrs: str) -> None:
        if tag == "br":
            self._text.append(" ")
        inline = tag in INLINE
        if not inline:
            self._flush()
        if self.tag[self._open[-1]] == "head" and tag not in HEAD_TAGS:
            self._pop()
        if tag in CLOSES:
            self._pop_to(*CLOSES[tag])
        elif not inline:
            self._pop_to(*_BLOCK_CLOSES)
        up, node = self._open[-1], len(self.tag)
        mark = self._mark(tag, attrs)
        self.tag.append(tag)
        self.parent.append(up)
        self.last.append(node)
        self.mark.append(mark)
        self.dead.append(self.dead[up] or mark == DEAD)
        self.holder.append(self.holder[up] if inline else node)
        self.chars.append(0)
        if tag not in VOID:
            self._where.setdefault(tag, []).append(len(self._open))
            self._open.append(node)

    def _mark(self, tag: str, attrs: str) -> int:
        if tag in DEAD_TAGS or (attrs and _HIDDEN.search(attrs) and tag not in ("html", "body")):
            return DEAD
        if tag in BESIDE_TAGS:
            return STRONG
        if tag == "header":
            return NONE if self._latest(("article", "main")) else STRONG
        if not attrs or tag in ("html", "body", "main") or (tag in INLINE and tag != "span"):
            return NONE
        return name_mark(attrs)

    def _end(self, tag: str) -> None:
        if tag not in INLINE:
            self._flush()
        elif tag == "br":
            self._text.append(" ")
        self._pop_to((tag,), () if tag in _END_WALLS else _END_WALLS)

    def _weigh(self) -> None:
        """Decide which marked parts are noise: ``noise`` of every node, from the parts' text and links."""
        n = len(self.tag)
        chars, linked = self.chars[:], [0] * n
        heads = [0] * n  # first headings, articles and mains inside that are not marked themselves
        for k in range(n - 1, 0, -1):
            up = self.parent[k]
            if self.tag[k] == "a":
                linked[k] = chars[k]
            chars[up] += chars[k]
            linked[up] += linked[k]
            heads[up] += (heads[k] if self.mark[k] < STRONG else 0) + (self.tag[k] in ("article", "main", "h1") and self.mark[k] == NONE)
        self.body = next((k for k in range(n) if self.tag[k] == "body"), 0)
        every = max(1, chars[self.body] - linked[self.body])
        self.noise = [False] * n
        for k in range(1, n):
            if self.noise[self.parent[k]] or self.mark[k] == DEAD:
                self.noise[k] = True
            elif self.mark[k] == STRONG:
                share = (chars[k] - linked[k]) / every
                self.noise[k] = not (share >= NEARLY_ALL or (share >= MOST and heads[k] > 0)) or (share < 1 and self._is_beside(k, heads))
            elif self.mark[k] == WEAK:
                self.noise[k] = chars[k] - linked[k] <= SMALL * every and 2 * linked[k] > chars[k]
        if not any(not self.noise[holder] for holder, _ in self.blocks):
            # a page of which all is beside something has no article
            self.blocks = []
        self.blocks = [(k, text) for k, text in self.blocks if not self.noise[k]]
        self.chars = [0 if gone else c for c, gone in zip(self.chars, self.noise, strict=True)]

    def _is_beside(self, k: int, heads: list[int]) -> bool:
        """Whether the page has an article of its own outside a marked part that has none."""
        return not heads[k] and heads[self.body] > 0

    def densities(self) -> tuple[list[float], list[float], int]:
        """Density sum and characters outside links per tag of every node, and the body."""
        n = len(self.tag)
        chars, tags = self.chars[:], [0] * n
        link_chars, link_tags = [0] * n, [0] * n
        for k in range(n - 1, 0, -1):
            if self.noise[k]:
                continue
            up = self.parent[k]
            if self.tag[k] == "a":
                link_chars[k], link_tags[k] = chars[k], 1 + link_tags[k]
            chars[up] += chars[k]
            tags[up] += tags[k] + 1
            link_chars[up] += link_chars[k]
            link_tags[up] += link_tags[k]
        body = self.body
        share = link_chars[body] / max(1, chars[body])

        def density(c: int, t: int, lc: int, lt: int) -> float:
            if not c:
                return 0.0
            t = max(1, t)
            base = math.log(c / max(1, c - lc) * lc + share * c + math.e)
            return c / t * max(0.0, math.log(c / max(1, lc) * t / max(1, lt))) / max(0.1, math.log(base) if base > 1 else 0.0)

        found = [0.0 if self.noise[k] else density(chars[k], tags[k], link_chars[k], link_tags[k]) for k in range(n)]
        sums = [0.0] * n
        for k in range(1, n):
            if self.tag[k] not in INLINE:
                sums[self.holder[self.parent[k]]] += found[k]
        for k, text in self.blocks:  # text that a container holds itself counts as a child
            sums[k] += density(sum(map(len, text.split())), 1, 0, 0) if self.tag[k] not in PARAGRAPHS else 0.0
        plain = [0.0 if self.noise[k] else (chars[k] - link_chars[k]) / max(1, tags[k]) for k in range(n)]
        return sums, plain, body

    def article(self) -> str:
        if not self.blocks:
            return ""
        sums, plain, body = self.densities()
        able = [k for k in range(len(self.tag)) if body <= k <= self.last[body] and not self.noise[k] and self.tag[k] not in PARAGRAPHS and self.tag[k] not in INLINE]
        best = max(able, key=lambda k: (sums[k], -k), default=body)
        path, node = [best], best
        while node not in (body, 0):
            node = self.parent[node]
            path.append(node)
        whole = next((k for tag in ("article", "main") for k in path if self.tag[k] == tag), best)
        path = path[path.index(whole) :]
        least = min(plain[k] for k in path) / 2
        above, kept = set(path[1:]), [False] * len(self.tag)
        kept[whole] = True
        beside = [False] * len(self.tag)  # a kept block, or one on the path, comes after
        inner = [False] * len(self.tag)  # holds something kept
        for k in range(len(self.tag) - 1, body, -1):
            up = self.parent[k]
            if self.noise[k] or self.tag[k] in INLINE:
                continue
            if k not in above and not kept[k]:
                heading = self.tag[k] in HEADINGS
                kept[k] = (beside[up] if heading else plain[k] >= least) and not (whole < k <= self.last[whole])
            inner[k] = inner[k] or kept[k]
            if inner[k] and self.tag[k] not in HEADINGS:
                inner[up] = beside[up] = True
        for k in range(body + 1, len(self.tag)):  # what a kept node holds
            kept[k] = kept[k] or kept[self.parent[k]]
        return " ".join(text for k, text in self.blocks if kept[k] or (k in above and len(text) >= least))


def main_text(html: str | None) -> str:
    """The article of one page, blocks in page order joined by one space."""
    return Page(html).article() if html else ""


def extract(pages: DataFrame) -> DataFrame:
    """Per row of ``pages`` (page_id, url, html): page_id, url, text, n_chars."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in text_slices(batches, "html"):
            found = [main_text(h) for h in part.column("html").to_pylist()]
            yield pa.RecordBatch.from_arrays([part.column("page_id"), part.column("url"), pa.array(found, pa.string()), pa.array([len(x) for x in found], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    kinds = ", ".join(f"{c} {pages.schema[c].dataType.simpleString()}" for c in ("page_id", "url"))
    return map_arrow(pages.select("page_id", "url", "html"), run, f"{kinds}, text string, n_chars long")
