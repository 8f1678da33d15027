"""Main text of web pages by tree scoring.

Every block with text passes points for its length and commas to its parent, half to the grandparent, half
of that further up and so on, discounted by the share of its text in links. The container with the most points,
discounted by its own links, is the article; siblings of enough points or with real sentences stay with it.
Elements whose tag or role says menu, footer, sidebar, form, script or style are cut before, unless they hold the
article, or most of the unlinked text of a page that marks no article. A name (class or id) says as much
only if all its words are of that kind ("sidebar-left"); of names that merely contain such a word
("notice-period", "with-sidebar"), an element goes if its text is like a menu's: mostly links, or short pieces
without sentences. Each step takes time in proportion to the page.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .runtime import tune

TAG = re.compile(r"""</?([a-zA-Z][^\s/>]*)((?:[^>"']|"[^"]*"|'[^']*')*+)>""")
LOOSE_TAG = re.compile(r"</?([a-zA-Z][^\s/>]*)([^>]*)>")
ATTRIBUTE = re.compile(r"""([a-zA-Z_:][-\w:.]*)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))|([a-zA-Z_:][-\w:.]*)""")
NAME_PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])|\d+")

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
BLOCK = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre search section select summary table tbody td tfoot th thead tr ul caption".split()
)
CUT = frozenset("head script style noscript template nav aside footer form button select option textarea input iframe svg math object canvas audio video dialog menu search title xmp noembed noframes".split())
#: A start tag closes these, up to the nearest of the second set.
CLOSES = {
    "li": (frozenset(["li"]), frozenset(["ul", "ol", "menu", "dir"])),
    "dt": (frozenset(["dt", "dd"]), frozenset(["dl"])),
    "dd": (frozenset(["dt", "dd"]), frozenset(["dl"])),
    "tr": (frozenset(["tr", "td", "th"]), frozenset(["table"])),
    "td": (frozenset(["td", "th"]), frozenset(["tr", "table"])),
    "th": (frozenset(["td", "th"]), frozenset(["tr", "table"])),
    "option": (frozenset(["option"]), frozenset(["select"])),
}
ROLES = frozenset("navigation banner contentinfo complementary search alert alertdialog dialog form menu menubar toolbar".split())
SIDE_NAMES = frozenset(
    "ad ads adv advert adverts advertisement advertisements advertising adbox adslot adsense adunit sponsor sponsored sponsors promo promos promotion promoted banner banners sidebar menu menus nav navbar navigation breadcrumb breadcrumbs footer masthead topbar header cookie cookies consent gdpr notice notices alert alerts popup modal overlay newsletter subscribe subscription signup login share sharing sharebar social related recommended recommendations comment comments disqus respond replies reply widget widgets toolbar pagination pager skip outbrain taboola".split()
)
#: Words that go with those above in a name without telling of other content.
NEUTRAL_NAMES = frozenset(
    "area article bar block body bottom box btn button buttons card cell col column container content-info entry form global group heading head hidden icon icons inline inner item items js left links link list main meta mobile nav out outer page panel pane popular post posts primary right row secondary section site slot small sticky sub tabs text title top unit wide wrap wrapper".split()
)
#: What may be cut only where it doesn't hold the page's own marks: anything marked by name or role, and these.
CENTRAL = frozenset(["article", "main", "h1"])
CAN_WRAP = frozenset(["form"])


class Node:
    __slots__ = ("block", "central", "chars", "commas", "cut", "hidden", "holds", "index", "inner_chars", "inner_links", "links", "maybe", "parent", "score", "tag")

    def __init__(self, tag: str, parent: Node | None, index: int) -> None:
        self.tag, self.parent, self.index = tag, parent, index
        self.block = self if parent is None or tag in BLOCK else parent.block
        self.cut = self.hidden = self.holds = self.maybe = False
        self.central = (parent is not None and parent.central) or tag in ("article", "main")
        self.chars = self.links = self.commas = self.inner_chars = self.inner_links = 0
        self.score = 0.0


def _marked(tag: str, attributes: str, inside: bool) -> str:
    """"hidden", "side" where names or roles mark an element as no part of an article, "maybe" where a name
    has such a word among others."""
    found = ""
    for name, a, b, c, bare in ATTRIBUTE.findall(attributes):
        name, value = (name or bare).lower(), a or b or c
        if name == "hidden" or (name == "aria-hidden" and value == "true") or (name == "style" and re.search(r"display\s*:\s*none", value, re.I)):
            return "hidden"
        if name == "role" and value.lower() in ROLES:
            found = "side"
        if name in ("class", "id") and tag not in ("html", "body", "main"):
            for word in value.split():
                parts = [p.lower() for p in NAME_PART.findall(word)]
                if not any(p in SIDE_NAMES for p in (parts if tag != "article" else ["".join(parts)])) or (inside and parts[-1:] == ["header"]):
                    continue
                sure = all(p in SIDE_NAMES or p in NEUTRAL_NAMES or p.isdigit() for p in parts)
                found = "side" if sure else found or "maybe"
    return found


def parse(html: str) -> tuple[list[Node], list[tuple[Node, str, bool]]]:
    """Elements in page order, and the pieces of text with their element and whether they are in a link."""
    root = Node("html", None, 0)
    nodes, texts, stack = [root], [], [root]
    links = 0
    open_: dict[str, int] = {}
    at, end = 0, len(html)

    def pop_to(i: int) -> None:
        nonlocal links
        for n in stack[i:]:
            links -= n.tag == "a"
            open_[n.tag] -= 1
        del stack[i:]

    while at < end:
        lt = html.find("<", at)
        if lt < 0:
            lt = end
        if lt > at:
            texts.append((stack[-1], html[at:lt], links > 0))
        if lt == end:
            break
        if html.startswith("<!--", lt):
            close = html.find("-->", lt + 4)
            at = end if close < 0 else close + 3
            continue
        if html[lt + 1 : lt + 2] in ("!", "?"):
            close = html.find(">", lt)
            at = end if close < 0 else close + 1
            continue
        m = TAG.match(html, lt) or LOOSE_TAG.match(html, lt)
        if not m:
            if re.match(r"</?[a-zA-Z]", html[lt : lt + 3]):
                break  # a tag that the page's end cuts off
            texts.append((stack[-1], "<", links > 0))
            at = lt + 1
            continue
        at = m.end()
        tag = m.group(1).lower()
        if html[lt + 1] == "/":
            for i in range(len(stack) - 1, 0, -1) if open_.get(tag) else ():
                if stack[i].tag == tag:
                    pop_to(i)
                    break
                if stack[i].tag in BLOCK and tag not in BLOCK:
                    break  # an inline end doesn't close a block
            continue
        if tag in VOID:
            texts.append((stack[-1], " " if tag != "hr" else "\0", False))
            continue
        if tag == "html":
            continue
        if tag in BLOCK:
            for i in range(len(stack) - 1, 0, -1) if open_.get("p") else ():
                if stack[i].tag == "p":
                    pop_to(i)
                    break
                if stack[i].tag in BLOCK:
                    break
        if tag in CLOSES:
            closing, limit = CLOSES[tag]
            for i in range(len(stack) - 1, 0, -1) if any(open_.get(c) for c in closing) else ():
                if stack[i].tag in closing:
                    pop_to(i)
                elif stack[i].tag in limit:
                    break
        node = Node(tag, stack[-1], len(nodes))
        nodes.append(node)
        attributes = m.group(2)
        side = tag in CUT or (tag == "header" and not node.central)
        named = _marked(tag, attributes, node.central) if attributes else ""
        node.cut, node.hidden, node.maybe = side or named in ("side", "hidden"), named == "hidden", named == "maybe"
        if tag in CENTRAL and not (node.cut and tag == "article"):
            up = node.parent
            while up is not None and not up.holds:
                up.holds = True
                up = up.parent
        if tag in RAW:
            close = re.compile(rf"</{re.escape(tag)}[\s/>]", re.I).search(html, at)
            at = end if close is None else html.find(">", close.start()) + 1 or end
            continue
        if attributes.endswith("/") and tag not in BLOCK:
            continue
        stack.append(node)
        open_[tag] = open_.get(tag, 0) + 1
        links += tag == "a"
    return nodes, texts


def spare_wrappers(nodes: list[Node], texts: list[tuple[Node, str, bool]]) -> None:
    """Clears the mark of elements that hold the article, or most of the page's unlinked text outside what is cut."""
    for n in nodes:
        if n.cut and n.holds and (n.tag not in CUT or n.tag in CAN_WRAP):
            n.cut = False
    # what is cut for good, and what marks the article elsewhere
    gone, lost, site = ([False] * len(nodes) for _ in range(3))
    marks = set()
    for n in nodes:
        i, up = n.index, n.parent.index if n.parent is not None else 0
        gone[i] = gone[up] or (n.cut and (n.hidden or (n.tag in CUT and n.tag not in CAN_WRAP)))
        lost[i] = lost[up] or n.cut
        site[i] = site[up] or (n.tag == "header" and not n.central)
        if n.tag in CENTRAL and not lost[i] and not (n.tag == "h1" and site[i]):
            marks.add(n.tag)
    wrappers = [n for n in nodes if n.cut and not gone[n.index] and (n.tag in CAN_WRAP or not marks)]
    if not wrappers or marks & {"article", "main"}:
        return
    own = [0] * len(nodes)
    for n, text, link in texts:
        if not link and not gone[n.index] and text != "\0":
            own[n.index] += len(text.strip())
    for n in reversed(nodes):
        if n.parent is not None:
            own[n.parent.index] += own[n.index]
    for n in wrappers:
        if 2 * own[n.index] > own[0]:
            n.cut = False


def cut_maybes(nodes: list[Node], texts: list[tuple[Node, str, bool]]) -> None:
    """Cuts elements whose name has a side word among others, and whose text is like a menu's."""
    some = [n for n in nodes if n.maybe and not n.cut and not n.holds]
    if not some:
        return
    chars, linked, full = ([0] * len(nodes) for _ in range(3))
    for n, text, link in texts:
        size = len(text.strip())
        if size and text != "\0":
            chars[n.index] += size
            linked[n.index] += size * link
            full[n.index] += size * (size >= 80 or ("." in text and size >= 40))
    for n in reversed(nodes):
        if n.parent is not None:
            for x in (chars, linked, full):
                x[n.parent.index] += x[n.index]
    for n in some:
        n.cut = linked[n.index] * 2 > chars[n.index] or full[n.index] * 2 < chars[n.index]


def main_text(html: str | None) -> str:
    """The article's blocks, one space for white space inside, two line feeds between."""
    if not html:
        return ""
    nodes, texts = parse(html)
    spare_wrappers(nodes, texts)
    cut_maybes(nodes, texts)
    for n in nodes:
        n.cut = n.cut or (n.parent is not None and n.parent.cut)

    for n, text, link in texts:
        if n.cut:
            continue
        b, size = n.block, len(text.strip())
        if not size or text == "\0":
            continue
        b.chars += size
        b.links += size * link
        b.commas += text.count(",") + text.count("、") + text.count("，")
    # children come after their parents: one pass from behind adds up what is inside, and the points
    for n in reversed(nodes):
        n.inner_chars += n.chars
        n.inner_links += n.links
        if n.parent is None:
            continue
        n.parent.inner_chars += n.inner_chars
        n.parent.inner_links += n.inner_links
        if n is not n.block:
            continue
        points = (1 + n.commas + min(n.chars / 100, 3)) * (1 - n.links / n.chars) if n.chars >= 25 else 0.0
        n.parent.block.score += points + n.score / 2

    def density(n: Node) -> float:
        return n.inner_links / n.inner_chars if n.inner_chars else 0.0

    best = max((n for n in nodes if n.score > 0 and not n.cut), key=lambda n: (n.score * (1 - density(n)), -n.index), default=None)
    if best is None:
        central = [n for n in nodes if n.tag in ("article", "main") and not n.cut and n.inner_chars]
        best = central[0] if central else nodes[0]
    up = best
    while up is not None and up.tag not in ("article", "main"):
        up = up.parent
    kept = {(up or best).index}
    top = best.score * (1 - density(best))
    chosen = up or best
    if chosen.parent is not None:
        for n in nodes:
            if n.parent is not chosen.parent or n is chosen or n.cut:
                continue
            chars = n.inner_chars
            if n.score * (1 - density(n)) >= max(10, 0.2 * top) or (n.tag == "p" and density(n) < 0.25 and chars > 80) or (n.tag in ("h1", "h2") and n.index < chosen.index and density(n) == 0):
                kept.add(n.index)
    if up is None:
        kept |= {n.index for n in nodes if n.tag == "h1" and not n.cut and n.index < chosen.index}
    inside = [False] * len(nodes)
    for n in nodes:
        inside[n.index] = n.index in kept or (n.parent is not None and inside[n.parent.index])

    out: list[str] = []
    part: list[str] = []
    last: Node | None = None
    for n, text, _ in texts:
        if n.cut or not inside[n.index]:
            if n.cut and n.block is not last:
                last = None if n.block.tag in BLOCK else last
            continue
        b = n.block
        if b is not last or text == "\0":
            if part:
                out.append("".join(part))
            part, last = [], b
        if text != "\0":
            part.append(text)
    if part:
        out.append("".join(part))
    return "\n\n".join(s for s in (" ".join(unescape(x).split()) for x in out) if s)


def text_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = [main_text(h) for h in batch.column("html").to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64(), size=len(texts))], names=["page_id", "url", "text", "n_chars"])


def extract(spark: SparkSession, pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars of every row.

    A null or empty page, or one without article text, has an empty text. Pages may be cut off anywhere.
    Repeated rows and rows without page_id or url are extracted like any other; an empty table gives no row.
    Other columns are not read.
    """
    tune(spark)
    return pages.select("page_id", "url", "html").mapInArrow(text_rows, "page_id long, url string, text string, n_chars long")
