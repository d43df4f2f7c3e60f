"""Main text of web pages by composite text density.

Every node of the page's tree gets a density: characters per tag, lowered by how much of it is links. The node whose
children's densities sum to most is the article. The least density on the path from it to the body is the threshold: what
else is at least as dense is searched the same way, its own node of the greatest sum being kept.

Tags, roles and names that say of a part that it is a sidebar, an advert, a form or the like weigh: characters of such a part count an
eighth, and beside or in the article it is kept only if it is then still half as dense. A page that is all of one such part loses
nothing. An article or main element around the densest node takes its place if it is at least a quarter as dense. Menus and footers by
tag, and what browsers do not show (scripts, hidden parts, fallbacks), take no part.

A null, empty or textless page has the empty text, and so has one of links alone. Broken markup is read as browsers do in the
main: a block closes an open paragraph, unmatched end tags are ignored, what never closes ends with the page. Of nodes that tie, the
first in page order counts. Every row is judged by its own html alone, repeated rows alike; further columns are not looked at.
"""

from __future__ import annotations

import re
from collections import Counter
from html import unescape
from math import e, log

from pyspark.sql import DataFrame

from .common import map_texts

# ------------------------------------------------------------------------------------------------------------
# Kinds of HTML elements, and words that names of boilerplate parts have.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre section summary table tbody td tfoot th thead tr ul".split()
)
#: Not shown, or a menu or footer by tag.
DROPPED = frozenset("script style textarea title iframe noembed noframes noscript template head nav footer menu select datalist svg canvas object dialog audio video".split())
#: Light by tag; headers only outside of article and main.
LIGHT = frozenset("aside form button header".split())
CLOSES_ITSELF = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
LIST_ENDS = frozenset("ul ol dl table tbody thead tfoot select body html".split())
HEADINGS = frozenset("h1 h2 h3".split())
NAMES = frozenset(
    "ad ads advert adverts advertisement advertisements advertising adbox banner breadcrumb breadcrumbs comment comments commentlist consent cookie cookies disclaimer disqus footer gdpr header masthead menu menubar modal nav navbar navigation newsletter notice notices notification outbrain overlay pager pagination paywall popup promo promoted promotion recommended related replies respond share sharing sidebar sidebars signup skip social sponsor sponsored subscribe subscription taboola toolbar topbar widget widgets".split()
)
#: What stands beside such words in names of that kind; any other word makes a name one of content.
BESIDE = frozenset("area bar block bottom box btn button buttons col column container global group icons inner item items layout left link links list main outer page panel post posts primary right row secondary section site top wrap wrapper".split())
ROLES = frozenset("navigation banner contentinfo complementary search dialog alertdialog alert menu menubar toolbar form".split())
# ------------------------------------------------------------------------------------------------------------

TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/>]*)((?:"[^"]*"|'[^']*'|[^'">])*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>""", re.S)
ATTRIBUTE = re.compile(r"""([^\s"'>/=]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
UNSEEN = re.compile(r"(?:^|;)\s*(?:display\s*:\s*none|visibility\s*:\s*hidden)\b", re.I)
NAME_PART = re.compile(r"[A-Z]?[a-z0-9]+|[A-Z0-9]+(?![a-z])")
LIGHTER, STILL, ENCLOSING = 0.125, 0.5, 0.25


def attributes_of(text: str) -> dict[str, str]:
    """Attributes of a start tag by lower-cased name; of a repeated one the first counts."""
    out: dict[str, str] = {}
    for m in ATTRIBUTE.finditer(text):
        out.setdefault(m[1].lower(), m[2] or m[3] or m[4] or "")
    return out


def says_boilerplate(name: str) -> bool:
    """Whether a class or id is made of words of boilerplate parts, and of nothing but what stands beside them."""
    parts = {p.lower() for p in NAME_PART.findall(name)}
    return not NAMES.isdisjoint(parts) and parts <= NAMES | BESIDE


class Page:
    """The tree of a page as lists by node in page order; a node's subtree is a range of them."""

    def __init__(self, html: str):
        self.parent, self.tag, self.end, self.out, self.weight = [-1], ["#root"], [0], [False], [1.0]
        self.segments: list[tuple[int, int, str]] = []  # node, block, text
        self.block = 0
        self._open = [0]
        self._held: Counter[str] = Counter()  # open elements by tag
        self._read(html)
        while self._open:
            self._close()

    def _close(self) -> None:
        node = self._open.pop()
        self.end[node] = len(self.tag)
        self._held[self.tag[node]] -= 1

    def _push(self, tag: str, dropped: bool, weight: float) -> None:
        above = self._open[-1]
        self.parent.append(above)
        self.out.append(dropped or self.out[above])
        self.weight.append(self.weight[above] * weight)
        self.tag.append(tag)
        self.end.append(len(self.tag))
        self._open.append(len(self.tag) - 1)
        self._held[tag] += 1

    def _close_to(self, tags: set[str] | frozenset[str], stop: frozenset[str]) -> None:
        for depth in range(len(self._open) - 1, 0, -1):
            tag = self.tag[self._open[depth]]
            if tag in tags:
                while len(self._open) > depth:
                    self._close()
                return
            if tag in stop:
                return

    def _read(self, html: str) -> None:
        at, held, last = 0, self._held, html.rfind(">")
        if html.find("<!--", last + 1) < 0:  # no tag begins after the last that ends; don't look for one from every <
            tail, html = html[last + 1 :], html[: last + 1]
        else:
            tail = ""
        while True:
            m = TOKEN.search(html, at)
            text = html[at : m.start()] if m else html[at:] + tail
            if text and not self.out[self._open[-1]]:
                self.segments.append((self._open[-1], self.block, unescape(text)))
            if not m:
                return
            at = m.end()
            name = m[2] or m[5]
            if not name:
                continue
            tag = name.lower()
            if tag in BLOCKS:
                self.block += 1
            if m[1] or m[4]:
                if held[tag]:
                    self._close_to({tag}, frozenset())
                continue
            if tag == "br":
                if not self.out[self._open[-1]]:
                    self.segments.append((self._open[-1], self.block, " "))
            if tag in BLOCKS and held["p"]:
                self._close_to({"p"}, frozenset(["button", "td", "th", "table", "object", "article", "section", "div"]))
            if tag in CLOSES_ITSELF and any(held[t] for t in CLOSES_ITSELF[tag]):
                self._close_to(CLOSES_ITSELF[tag], LIST_ENDS)
            if tag in ("html", "body") and held[tag]:
                continue
            attributes = m[3] or m[6] or ""
            self._push(tag, *self._judged(tag, attributes))
            if tag in VOID or attributes.endswith("/") and tag not in BLOCKS and tag not in RAW and tag != "a":
                self._close()
            elif tag in RAW:
                end = re.compile(rf"</{re.escape(tag)}(?=[\s/>])", re.I).search(html, at)
                if tag == "xmp" and not self.out[self._open[-1]]:  # shown as it stands
                    self.segments.append((self._open[-1], self.block, html[at : end.start() if end else len(html)]))
                at = len(html) if not end else html.find(">", end.end()) + 1 or len(html)
                self._close()

    def _judged(self, tag: str, attributes: str) -> tuple[bool, float]:
        """Whether an element takes no part, and what its density counts."""
        held = attributes_of(attributes) if attributes else {}
        dropped = tag in DROPPED or "hidden" in held or UNSEEN.search(held.get("style", "")) is not None
        if tag in ("html", "body", "article", "main"):
            return dropped, 1.0
        light = tag in LIGHT and not (tag == "header" and self._held["article"] + self._held["main"])
        light = light or held.get("role", "").strip().lower() in ROLES
        light = light or any(map(says_boilerplate, f"{held.get('class', '')} {held.get('id', '')}".split()))
        return dropped, LIGHTER if light else 1.0


def densities(page: Page) -> tuple[list[float], list[float]]:
    """Composite text density of each node, and the sum over its block children; a block without such has its own, a part of a
    line none."""
    n = len(page.tag)
    chars, link_chars, tags, link_tags = [0.0] * n, [0.0] * n, [0] * n, [0] * n
    linked = [False] * n
    for i in range(1, n):
        linked[i] = page.tag[i] == "a" or linked[page.parent[i]]
    for node, _, text in page.segments:
        size = len("".join(text.split())) * page.weight[node]
        chars[node] += size
        link_chars[node] += size * linked[node]
    for i in range(n - 1, 0, -1):
        if page.out[i]:
            continue
        up = page.parent[i]
        chars[up] += chars[i]
        link_chars[up] += link_chars[i]
        tags[up] += tags[i] + 1
        link_tags[up] += link_tags[i] + (page.tag[i] == "a")
    link_share = link_chars[0] / max(1.0, chars[0])
    density, sums, has = [0.0] * n, [0.0] * n, [False] * n
    for i in range(n - 1, -1, -1):
        if chars[i] and not page.out[i]:
            c, t, lc, lt = chars[i], max(1, tags[i]), max(1.0, link_chars[i]), max(1, link_tags[i])
            base = log(log(c * lc / max(1.0, c - link_chars[i]) + link_share * c + e))
            density[i] = c / t * max(0.0, log(c * t / (lc * lt))) / base
        if not has[i] and (not i or page.tag[i] in BLOCKS):
            sums[i] = density[i]
        if i and not page.out[i] and chars[i] and page.tag[i] in BLOCKS:
            sums[page.parent[i]] += density[i]
            has[page.parent[i]] = True
    return density, sums


def kept_nodes(page: Page, density: list[float], sums: list[float]) -> tuple[list[int], float]:
    """The nodes whose subtrees are the article, in page order, and how dense light parts must be."""
    n = len(page.tag)
    top = list(range(n))  # of each subtree, the node of the greatest sum
    for i in range(n - 1, 0, -1):
        up = page.parent[i]
        if not page.out[i] and (sums[top[i]], -top[i]) > (sums[top[up]], -top[up]):
            top[up] = top[i]
    path = [top[0]]
    while page.parent[path[-1]] >= 0 and page.tag[path[-1]] != "body":
        path.append(page.parent[path[-1]])
    threshold = min(density[i] for i in path if page.tag[i] != "#root" or len(path) == 1)

    def enclosing(node: int) -> int:
        found, up = node, page.parent[node]
        while up >= 0 and page.tag[up] != "body":
            if page.tag[up] in ("article", "main") and density[up] >= ENCLOSING * density[node]:
                found = up
            up = page.parent[up]
        return found

    best = enclosing(top[0])
    least = max(threshold, STILL * density[best])
    kept, on_path = [], set(path)
    i = 0
    while i < n:  # in page order; what is kept or too thin is passed over with all below it
        if i == best or page.out[i]:
            kept += [i] * (i == best)
            i = page.end[i]
        elif i in on_path or i == 0:
            i += 1
        elif page.tag[i] in BLOCKS and density[i] >= max(threshold, least * (page.weight[i] < page.weight[best])) > 0:
            node = top[i]
            node = max((enclosing(node), i)) if node != i else i
            kept.append(node)
            i = page.end[i]
        elif page.tag[i] in HEADINGS and i < best and page.parent[i] in on_path and page.weight[i] == 1:
            kept.append(i)
            i = page.end[i]
        else:
            i = i + 1 if page.end[i] > best > i else page.end[i]
    return kept, least


def main_text(html: str) -> str:
    page = Page(html)
    density, sums = densities(page)
    if any(sums):
        kept, least = kept_nodes(page, density, sums)
    elif all("a" in _tags_above(page, node) for node, _, text in page.segments if text.strip()):
        return ""
    else:  # too little text to tell anything by
        kept, least = [0], 0.0
    inside = [False] * len(page.tag)
    for top in kept:
        i = top
        while i < page.end[top]:
            light = i != top and page.weight[i] < page.weight[page.parent[i]] and density[i] < least
            if page.out[i] or light:
                i = page.end[i]
            else:
                inside[i] = True
                i += 1
    blocks: dict[int, list[str]] = {}
    for node, block, text in page.segments:
        if inside[node]:
            blocks.setdefault(block, []).append(text)
    lines = (" ".join("".join(b).split()) for b in blocks.values())
    return "\n".join(line for line in lines if line)


def _tags_above(page: Page, node: int) -> set[str]:
    out = set()
    while node >= 0:
        out.add(page.tag[node])
        node = page.parent[node]
    return out


def extract_main_text(pages: DataFrame) -> DataFrame:
    """``page_id, url, text, n_chars`` of every row of pages."""

    def row(html: bytes) -> tuple:
        text = main_text(html.decode("utf-8", "replace"))
        return text, len(text)

    return map_texts(pages, ["page_id", "url", "html"], row, "page_id long, url string, text string, n_chars long")
