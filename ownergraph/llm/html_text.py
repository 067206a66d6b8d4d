"""HTML extraction by composite text density.

A page becomes a list of nodes in page order.  Every node has its characters and tags, and those of links,
and from these a density: characters a tag, adjusted by how much of the text is links, against the share of
links in the whole body.  The sum of its children's densities tells the node that holds the article's blocks.
The least density on the way from there up to the body is the threshold by which the neighbours of that way
belong to the article too.
"""

from __future__ import annotations

import html
import math
import re

from pyspark.sql import DataFrame, SparkSession

from ownergraph.llm.common import map_rows
from ownergraph.session import table

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose content is no markup.
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q ruby rb rt rtc s samp small span strike strong sub sup time tt u var wbr br img picture source svg math".split()
)
#: A start tag ends an open element of these names, up to the element that contains them all.
ENDS = {
    "li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "option": ({"option"}, {"select", "datalist"}),
    "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}),
    "tbody": ({"thead", "tbody", "tr", "td", "th"}, {"table"}), "tfoot": ({"tbody", "tr", "td", "th"}, {"table"}), "body": ({"head"}, {"html"}),
}
#: Never part of an article.
DROPPED = frozenset("nav footer aside form script style noscript template head button select option input textarea dialog iframe object svg title menu noembed noframes xmp".split())
ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog form menu menubar toolbar".split())
#: Words of class and id that tell what a part is for.
NAMES = frozenset(
    """ad ads adv advert adverts advertisement advertising adsense sponsor sponsored promo promos promotion banner cookie cookies consent gdpr notice notices
    popup modal overlay newsletter subscribe subscription signup share sharing social related recommended recommendations recirculation sidebar sidenav aside
    menu nav navbar navigation breadcrumb breadcrumbs pagination pager footer masthead topbar toolbar comment comments commentlist disqus respond replies
    discussion login search skip paywall disclaimer alert warning form""".split()
)
HEADS = frozenset("header hgroup".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: A part of such a name stays if it holds this share of the page's text in paragraphs: then it wraps the article.
WRAPS = 0.6
_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*+(?:>|\Z)|</([a-zA-Z][^\s/>]*+)[^>]*+(?:>|\Z)"
    r"|<([a-zA-Z][^\s/>]*+)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+>|[^>]*+(?:>|\Z))",
    re.DOTALL,
)
_ATTRIBUTE = re.compile(r"""([^\s=/>"']+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>"']+)))?""")
_NAME = re.compile(r"[a-z]+")


class Page:
    """Nodes in page order: tag, parent, attributes; and texts with the node they stand in."""

    def __init__(self, source: str):
        self.tags, self.parents, self.attributes = ["#page"], [-1], [""]
        #: Page order of texts and of the starts and ends of nodes: (kind, node, text).
        self.events: list[tuple[str, int, str]] = []
        open_nodes, at, size = [0], 0, len(source)
        while at < size:
            m = _TOKEN.search(source, at)
            if m is None:
                self._text(open_nodes, source[at:])
                break
            if m.start() > at:
                self._text(open_nodes, source[at : m.start()])
            at = m.end()
            if m[2]:
                tag = m[2].lower()
                self._close_implied(open_nodes, tag)
                node = len(self.tags)
                self.tags.append(tag)
                self.parents.append(open_nodes[-1])
                self.attributes.append(m[3])
                self.events.append(("start", node, ""))
                if tag in VOID or m[3].endswith("/>") and tag in ("svg", "math"):
                    self.events.append(("end", node, ""))
                elif tag in RAW:
                    end = re.compile(rf"</{re.escape(tag)}(?=[\s/>])[^>]*>?", re.IGNORECASE).search(source, at)
                    self.events.append(("end", node, ""))
                    at = end.end() if end else size
                else:
                    open_nodes.append(node)
            elif m[1]:
                self._close(open_nodes, m[1].lower())
        while len(open_nodes) > 1:
            self.events.append(("end", open_nodes.pop(), ""))

    def _text(self, open_nodes: list[int], text: str) -> None:
        self.events.append(("text", open_nodes[-1], text))

    def _pop_to(self, open_nodes: list[int], depth: int) -> None:
        while len(open_nodes) > depth:
            self.events.append(("end", open_nodes.pop(), ""))

    def _close(self, open_nodes: list[int], tag: str) -> None:
        for depth in range(len(open_nodes) - 1, 0, -1):
            name = self.tags[open_nodes[depth]]
            if name == tag:
                self._pop_to(open_nodes, depth)
                return
            if tag in INLINE and name not in INLINE:  # a stray end of an inline element closes no block
                return

    def _close_implied(self, open_nodes: list[int], tag: str) -> None:
        if tag not in INLINE:  # a block ends an open paragraph
            for depth in range(len(open_nodes) - 1, 0, -1):
                name = self.tags[open_nodes[depth]]
                if name == "p":
                    self._pop_to(open_nodes, depth)
                    break
                if name not in INLINE:
                    break
        if tag in ENDS:
            ended, within = ENDS[tag]
            last = 0
            for depth in range(len(open_nodes) - 1, 0, -1):
                name = self.tags[open_nodes[depth]]
                if name in within:
                    break
                if name in ended:
                    last = depth
            if last:
                self._pop_to(open_nodes, last)

    def attribute(self, node: int) -> dict[str, str]:
        found = {}
        for m in _ATTRIBUTE.finditer(self.attributes[node]):
            found.setdefault(m[1].lower(), next((x for x in m.groups()[1:] if x is not None), ""))
        return found


def _marked(page: Page, node: int) -> bool:
    """Whether class, id, role or visibility tell that a node is no article."""
    if len(page.attributes[node]) < 3:
        return False
    a = page.attribute(node)
    if a.get("role", "").lower() in ROLES or "hidden" in a or a.get("aria-hidden") == "true" or "display:none" in a.get("style", "").replace(" ", "").lower():
        return True
    return any(n in NAMES for n in _NAME.findall(f"{a.get('class', '')} {a.get('id', '')}".lower()))


def density(chars: int, tags: int, link_chars: int, link_tags: int, body_ratio: float) -> float:
    """Characters a tag, times a logarithm of how little of it is links; counts of 0 are 1."""
    if not chars:
        return 0.0
    t, lc, lt = max(tags, 1), max(link_chars, 1), max(link_tags, 1)
    base = math.log(chars / max(chars - link_chars, 1) * link_chars + body_ratio * chars + math.e)
    return chars / t * math.log(max(chars / lc * t / lt, 1.0)) / max(math.log(base), 1e-3)


def main_text(source: str | None) -> str:
    """The article of a page: its blocks in page order, one to a line."""
    if not source:
        return ""
    page = Page(source)
    n = len(page.tags)
    parents, tags = page.parents, page.tags
    body = next((i for i, t in enumerate(tags) if t == "body"), 0)

    # what is dropped by its name goes before densities are taken, unless it wraps the page's paragraphs
    inside: list[int] = [0] * n  # characters in paragraphs and headings
    for kind, node, text in page.events:
        if kind == "text":
            at = node
            while at > 0 and tags[at] in INLINE:
                at = parents[at]
            if tags[at] in ("p", "blockquote", "pre") or tags[at] in HEADINGS:
                inside[node] += len(text.strip())
    for i in range(n - 1, 0, -1):
        inside[parents[i]] += inside[i]
    whole = inside[0]
    gone = [False] * n
    article = [False] * n  # within an article, or the main part
    for i in range(1, n):
        p = parents[i]
        article[i] = article[p] or tags[i] in ("article", "main")
        if gone[p]:
            gone[i] = True
        elif tags[i] in DROPPED or tags[i] not in ("html", "body", "article", "main") and _marked(page, i):
            wraps = whole and inside[i] >= WRAPS * whole and (tags[i] not in DROPPED or tags[i] == "form")
            gone[i] = not wraps
        elif tags[i] in HEADS and not article[p]:
            gone[i] = not (whole and inside[i] >= WRAPS * whole)

    chars, links = [0] * n, [0] * n
    in_link = [False] * n
    for i in range(1, n):
        in_link[i] = in_link[parents[i]] or tags[i] == "a"
    for kind, node, text in page.events:
        if kind == "text" and not gone[node]:
            size = len(text.strip())
            chars[node] += size
            if in_link[node]:
                links[node] += size
    tag_count, link_count = [0] * n, [0] * n
    for i in range(n - 1, 0, -1):
        if gone[i]:
            continue
        p = parents[i]
        chars[p] += chars[i]
        links[p] += links[i]
        tag_count[p] += tag_count[i] + 1
        link_count[p] += link_count[i] + (tags[i] == "a")
    ratio = links[body] / max(chars[body], 1)
    densities = [density(chars[i], tag_count[i], links[i], link_count[i], ratio) for i in range(n)]
    sums = [0.0] * n
    for i in range(n - 1, 0, -1):
        if not gone[i] and tags[i] not in INLINE:  # what is inline is text of its block, no block beside others
            sums[parents[i]] += densities[i]
    within = [i == body for i in range(n)]
    for i in range(body + 1, n):
        within[i] = within[parents[i]]
    best = max((i for i in range(n) if within[i] and not gone[i] and (i == body or tags[i] not in INLINE)), key=lambda i: (sums[i], -i), default=body)

    # the way up to the body has the threshold
    path, at = [], best
    while at > 0 and at != body:
        path.append(at)
        at = parents[at]
    path.append(body)
    threshold = min(densities[i] for i in path)
    chosen = [False] * n
    if best == body:
        chosen[body] = True
    else:
        chosen[best] = True
        on_path = set(path)
        for i in range(1, n):
            if parents[i] in on_path and parents[i] != best and i not in on_path and not gone[i] and chars[i]:
                linked = links[i] > chars[i] / 2
                if not linked and (densities[i] >= threshold or tags[i] in HEADINGS):
                    chosen[i] = True
    for i in range(1, n):
        chosen[i] = chosen[i] or chosen[parents[i]]

    heading = [False] * n
    in_head = [False] * n
    for i in range(1, n):
        heading[i] = heading[parents[i]] or tags[i] in HEADINGS
        in_head[i] = in_head[parents[i]] or tags[i] in HEADS
    blocks, parts = [], []
    for kind, node, text in page.events:
        if kind == "text":
            if chosen[node] and not gone[node] and (not in_head[node] or heading[node]):
                parts.append(text)
        elif tags[node] not in INLINE:
            if parts:
                blocks.append("".join(parts))
                parts = []
        elif tags[node] == "br" and parts:
            parts.append(" ")
    if parts:
        blocks.append("".join(parts))
    lines = (" ".join(html.unescape(b).split()) for b in blocks)
    return "\n".join(line for line in lines if line)


def extract_pages(pages: DataFrame) -> DataFrame:
    """``page_id, url, text, n_chars`` per row of ``pages``; ``n_chars`` are the text's code points.

    Defined results: a null or empty page, and one without text, has the text ""; a page without a body is read as
    one; rows that repeat each get a row; a null url stays null; other columns are not read; an empty table gives an
    empty table.  Pages nest to any depth.
    """

    def make():
        def row(given):
            text = main_text(given["html"])
            return [{"page_id": given["page_id"], "url": given["url"], "text": text, "n_chars": len(text)}]

        return row

    kind = pages.schema["page_id"].dataType.simpleString()
    return map_rows(pages.select("page_id", "url", "html"), make, f"page_id {kind}, url string, text string, n_chars long")


def op2_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract query over ``pages``."""
    return extract_pages(table(spark, sf_dir, "pages"))
