"""Main text of web pages by tree scoring.

A page becomes a tree of its block elements. Every paragraph-like block gives points for its length and
its commas to its parent, half of them to the grandparent and a falling share further up; a
container's points are discounted by its link density. The best container is kept together
with those of its siblings that score near it or are headings or running text; inside an article or main
element all of that element is kept. Navigation,
headers (but an article's own), footers, side columns, notices, adverts, forms, scripts, styles and reader comments go by
element, role or class, link lists by their density. A class drops no element around the main element, nor one named
after layout around most of the running text or of the articles' text; if nothing is left, classes are not looked at.

Character references are decoded, white space inside a block becomes one space, blocks are
joined in page order by one line feed. Nothing is cut or capped.

Defined cases: a null or empty page, or one without text outside dropped elements, gives an
empty text of 0 characters. Broken markup (open tags, stray ends, unclosed comments) is read
as far as it goes. Repeated rows and null ids are handled row by row; extra columns are ignored. An empty table gives no
row.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_OPENING = re.compile(r"<(?:!--|[!?]|(/?)([a-zA-Z][^\s/>]*))")
_STOP = re.compile(r"[>\"']")
_ATTRIBUTE = re.compile(r"([a-zA-Z-]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")

# Fixed values of HTML: element groups.
RAW = {"script", "style", "title", "textarea", "noscript", "template", "iframe", "svg", "object", "canvas", "noembed", "noframes", "xmp"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
INLINE = {"a", "abbr", "b", "bdi", "bdo", "big", "cite", "code", "data", "del", "dfn", "em", "font", "i", "ins", "kbd", "label", "mark", "q", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var", "picture", "audio", "video", "map", "output", "ruby", "rt", "rp", "nobr"}
DROPPED = {"nav", "footer", "aside", "form", "button", "select", "menu", "dialog", "fieldset", "head", "datalist", "progress", "meter"}
ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "form", "dialog", "alertdialog", "alert", "menu", "menubar", "toolbar", "tablist", "tooltip", "status", "feed"}
#: Characters of a link from which it reads as a title, on average over a list.
TITLE = 20
#: Elements whose start ends an open element of the named kind.
ENDS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}, "p": {"p"}}
SCOPES = {"ul", "ol", "dl", "table", "body", "html"}
HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}
#: Elements of formulas, read like text inside a sentence.
FORMULA = {"math", "mrow", "mi", "mo", "mn", "ms", "mtext", "msup", "msub", "msubsup", "mfrac", "msqrt", "mroot", "munder", "mover", "munderover", "mstyle", "mspace", "mpadded", "mphantom", "menclose", "mtable", "mtr", "mtd", "semantics"}
INLINE |= FORMULA
RAW |= {"annotation", "annotation-xml"}
NEVER_DROPPED = {"html", "body", "main", "article"}
PARAGRAPHS = {"p", "pre", "td", "blockquote", "div", "section", "article", "main", "li", "dd", "body"}

_BAD = re.compile(
    r"(?:^|[\s_-])(?:ads?|adverts?|advertisement|advertising|adbox|adsense|banner|promo|promotion|sponsor(?:ed|s)?|comments?|commentlist|disqus|discussion|replies|respond|"
    r"cookies?|consent|gdpr|notice|notices|notification|alert|popup|modal|overlay|newsletter|subscribe|subscription|signup|share|sharing|social|sidebar|side|rail|menu|menus|"
    r"nav|navbar|navigation|breadcrumbs?|pager|pagination|footer|foot|header|masthead|toolbar|topbar|related|recommended|recommendations|widget|widgets|skip|hidden|search|login|toc)(?=$|[\s_-])",
    re.IGNORECASE,
)
#: Words of ``_BAD`` that also name layout or a part of an article; the others name what is no part of it.
_LAYOUT = re.compile(r"(?:^|[\s_-])(?:banner|notice|notices|alert|popup|modal|overlay|sidebar|side|rail|menu|menus|nav|navbar|navigation|header|masthead|toolbar|topbar|footer|foot|search|toc|hidden|skip|widget|widgets)(?=$|[\s_-])", re.IGNORECASE)
#: Of these, words that an article's own parts carry: ``article-header`` stays, ``main-nav`` does not.
_OWN = re.compile(r"(?:^|[\s_-])(?:banner|notice|notices|alert|side|header|masthead|search|toc)(?=$|[\s_-])", re.IGNORECASE)
_MODIFIER = re.compile(r"(?:has|with|without|no|is|not)[_-]", re.IGNORECASE)
_GOOD = re.compile(r"(?:^|[\s_-])(?:article|main|content|body|post|entry|story|text|page)(?=$|[\s_-])", re.IGNORECASE)


class _Node:
    __slots__ = ("by_class", "children", "dropped", "good", "inside", "length", "links", "linked", "parent", "score", "tag", "whole")

    def __init__(self, tag: str, parent: _Node | None, dropped: bool, good: bool, whole: str = "", by_class: str = ""):
        self.tag, self.parent, self.dropped, self.good = tag, parent, dropped, good
        self.inside = parent is not None and (parent.inside or parent.whole == "article")  # an article
        self.whole = whole  # "article" or "main", by element or role
        self.by_class = by_class  # "layout" or "other", where its names ask to drop it
        self.children: list[_Node | str] = []  # blocks of text and block elements, in page order
        self.score = 0.0
        self.length = self.linked = self.links = 0
        if parent is not None:
            parent.children.append(self)


def _attributes(raw: str) -> dict[str, str]:
    return {m[1].lower(): html.unescape(m[2] or m[3] or m[4] or "") for m in _ATTRIBUTE.finditer(raw)} if raw.strip(" \t\r\n/") else {}


def _is_dropped(tag: str, attributes: dict[str, str]) -> bool:
    if tag in NEVER_DROPPED:
        return False
    if tag in DROPPED or attributes.get("role", "").lower() in ROLES:
        return True
    if "hidden" in attributes or attributes.get("aria-hidden") == "true" or re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", attributes.get("style", ""), re.IGNORECASE):
        return True
    return False


def _named(tag: str, attributes: dict[str, str]) -> str:
    """"layout" or "other" if class or id ask to drop the element, by the kind of their words."""
    kind = ""
    if tag in NEVER_DROPPED or attributes.get("role", "").lower() in ("main", "article"):
        return kind
    for name in f"{attributes.get('class', '')} {attributes.get('id', '')}".split():
        words = [w for w in _BAD.findall(name) if w]
        if not words or _MODIFIER.match(name):
            continue
        if _GOOD.search(name) and all(_OWN.search(w) for w in words):
            continue
        if not all(_LAYOUT.search(w) for w in words):
            return "other"
        kind = "layout"
    return kind


class _Scanner:
    """Comments, declarations and tags of a page, one after the other, in time linear in its length.

    A tag ends at the first ``>`` outside quotes. One that has none is text; the quotes its search came by are
    remembered, as any later tag that comes to one of them has no end either.
    """

    def __init__(self, page: str):
        self.page, self.last = page, page.rfind(">")
        self.dead: set[int] = set()
        self.near = (0, -1)  # no end or quote from the first position up to the second
        self.final = {quote: page.rfind(quote) for quote in "\"'"}

    def _stop(self, at: int) -> int:
        if not self.near[0] <= at <= self.near[1]:
            m = _STOP.search(self.page, at, self.last + 1)
            self.near = (at, m.start() if m else self.last + 1)
        return self.near[1]

    def _end(self, at: int) -> int:
        """Position of the ``>`` that ends a tag whose name ends at ``at``; -1 if there is none."""
        page, seen = self.page, []
        stop = self._stop(at)
        while stop <= self.last and stop not in self.dead:
            if page[stop] == ">":
                return stop
            seen.append(stop)
            if stop == self.final[page[stop]]:
                break
            close = page.find(page[stop], stop + 1)
            m = _STOP.search(page, close + 1, self.last + 1)
            stop = m.start() if m else self.last + 1
        self.dead.update(seen)
        return -1

    def next(self, at: int) -> tuple[int, int, bool, str, str] | None:
        """Start, end, whether it is an end tag, name ("" if no tag) and attributes of the next markup from ``at``."""
        page = self.page
        while (m := _OPENING.search(page, at)) is not None:
            if m[0] == "<!--":
                stop = page.find("-->", m.end())
                return m.start(), (stop + 3 if stop >= 0 else len(page)), False, "", ""
            if m.start() > self.last:
                at = m.end()  # only an unclosed comment may follow the last ``>``
                continue
            stop = page.find(">", m.end()) if m[2] is None else self._end(m.end())
            if stop >= 0:
                return m.start(), stop + 1, bool(m[1]), m[2] or "", page[m.end() : stop]
            at = m.end()
        return None


def parse(page: str) -> _Node:
    """The tree of block elements; text blocks are strings with single spaces."""
    root = _Node("html", None, False, False)
    node, run, linked, link_from = root, [], 0, None
    at = 0
    scanner = _Scanner(page)
    open_tags: Counter[str] = Counter()

    def text(piece: str) -> None:
        nonlocal linked
        if piece:
            piece = html.unescape(piece) if "&" in piece else piece
            run.append(piece)
            if link_from is not None:
                linked += len(piece.strip())

    def flush() -> None:
        nonlocal linked
        block = " ".join("".join(run).split())
        run.clear()
        if block:
            node.children.append(block)
            node.length += len(block)
            node.linked += min(linked, len(block))
        linked = 0

    def close(to: _Node) -> None:
        """Leave elements up to and with ``to``."""
        nonlocal node, link_from
        flush()
        while True:
            left = node
            if link_from is left:
                link_from = None
            node = left.parent or root
            if left is root:
                return
            open_tags[left.tag] -= 1
            if left is to:
                return

    def find(tags: set[str], within: set[str]) -> _Node | None:
        if not any(open_tags[t] > 0 for t in tags):
            return None
        up = node
        while up is not root and up.tag not in within:
            if up.tag in tags:
                return up
            up = up.parent
        return None

    while (m := scanner.next(at)) is not None:
        start, after, end, name, raw = m
        text(page[at:start])
        at = after
        if not name:
            continue
        tag = name.lower()
        if not end and tag in RAW:
            if not raw.endswith("/") or tag in ("script", "style", "title", "textarea"):
                stop = re.compile(rf"</{re.escape(tag)}(?=[\s/>])[^>]*>", re.IGNORECASE).search(page, at, scanner.last + 1)
                at = stop.end() if stop else len(page)
            continue
        if tag in VOID:
            if tag == "br":
                run.append(" ")
            elif tag == "hr":
                flush()
            continue
        if tag == "a":
            link_from = None if end else node
            if not end:
                node.links += 1
            continue
        if tag in INLINE:
            attributes = {} if end else _attributes(raw)
            if not attributes or not (_is_dropped(tag, attributes) or _named(tag, attributes)):
                continue
        if end:
            opened = find({tag}, {"html"} if tag not in ("li", "p") else SCOPES - {tag})
            if opened is not None:
                close(opened)
            continue
        flush()
        for ends in (ENDS.get(tag), {"p"} if tag not in INLINE else None):
            if ends and (opened := find(ends, SCOPES)) is not None:
                close(opened)
        if tag in ("html", "body") and node is root:
            continue
        attributes = _attributes(raw)
        names = f"{attributes.get('class', '')} {attributes.get('id', '')}"
        role = attributes.get("role", "").lower()
        whole = tag if tag in ("article", "main") else role if role in ("article", "main") else ""
        open_tags[tag] += 1
        dropped = _is_dropped(tag, attributes) or tag == "header" and not open_tags["article"]
        node = _Node(tag, node, node.dropped or dropped, bool(whole or _GOOD.search(names)), whole, _named(tag, attributes))
    tail = page[at:]
    text(tail if not re.match(r"<[/a-zA-Z!?]", tail) else "")
    flush()
    return root


def _drop_by_class(root: _Node) -> bool:
    """Mark what class and id drop, with all inside; false if they drop nothing."""
    nodes = _ordered(root)
    running, articles, mains = {}, {}, set()
    for n in reversed(nodes):  # children before parents
        running[n] = running.get(n, 0) + max(0, n.length - n.linked)
        if n.whole:
            articles[n] = running[n]
        if n.whole == "main":
            mains.add(n)
        if n.parent is not None:
            running[n.parent] = running.get(n.parent, 0) + running[n]
            articles[n.parent] = articles.get(n.parent, 0) + articles.get(n, 0)
            if n in mains:
                mains.add(n.parent)
    marked = False
    for n in nodes:  # parents first
        if n.parent is not None and n.parent.dropped:
            n.dropped = True
        elif n.by_class and n not in mains:
            most = 2 * running[n] > running[root] if not articles.get(root) else 2 * articles.get(n, 0) > articles[root]
            n.dropped = not (n.by_class == "layout" and most)
            marked = marked or n.dropped
    return marked


def _ordered(root: _Node) -> list[_Node]:
    """Kept nodes, parents first."""
    found, todo = [], [root]
    while todo:
        n = todo.pop()
        if not n.dropped:
            found.append(n)
            todo.extend(c for c in reversed(n.children) if isinstance(c, _Node))
    return found


def _score(root: _Node) -> list[_Node]:
    nodes = _ordered(root)
    for n in nodes:
        if n.tag not in PARAGRAPHS and n is not root:
            continue
        own = [c for c in n.children if isinstance(c, str)]
        if not own:
            continue
        length, commas = sum(map(len, own)), sum(c.count(",") + c.count("،") + c.count("，") for c in own)
        density = n.linked / n.length
        points = (min(length / 25, 1) + commas + min(length / 100, 3)) * (1 - density)
        up, level = (n if n.tag in ("div", "section", "article", "main", "body", "html") else n.parent), 0
        while up is not None:
            up.score += points / (1, 2)[level] if level < 2 else points / (3 * level)
            up, level = up.parent, level + 1
    for n in reversed(nodes):  # children before parents: totals of the subtree
        if n.parent is not None:
            n.parent.length += n.length
            n.parent.linked += n.linked
            n.parent.links += n.links
    for n in nodes:
        bonus = 25 if n.good and n.length else 0
        n.score = (n.score + bonus) * (1 - n.linked / n.length if n.length else 0)
    return nodes


def _link_list(n: _Node) -> bool:
    """Whether ``n`` is a menu or the like; inside an article, lists of titles and linked paragraphs are its own."""
    if n.inside and (n.tag == "p" or n.linked >= TITLE * n.links):
        return False
    return n.links > 2 and n.linked > 0.7 * n.length and n.tag in ("ul", "ol", "div", "section", "table", "dl", "p")


def _blocks(top: _Node, out: list[str]) -> None:
    todo: list[_Node | str] = [top]
    while todo:
        x = todo.pop()
        if isinstance(x, str):
            out.append(x)
        elif not x.dropped and not (x is not top and _link_list(x)):
            todo.extend(reversed(x.children))


def _around(best: _Node) -> _Node | None:
    """The article that ``best`` lies in, or else the main element."""
    above, up = [], best.parent
    while up is not None:
        if up.whole:
            above.append(up)
        up = up.parent
    if best.whole == "article":
        return next((n for n in above if n.whole == "main"), None)
    return next((n for n in above if n.whole == "article"), above[0] if above else None)


def _all_of(around: _Node, best: _Node) -> list[_Node | str]:
    """Everything in ``around`` that is not dropped; beside the way to ``best``, elements of few links only."""
    way, n = set(), best
    while n is not around:
        way.add(n)
        n = n.parent
    kept: list[_Node | str] = []
    todo: list[_Node | str] = list(reversed(around.children))
    while todo:
        x = todo.pop()
        if isinstance(x, str) or x is best:
            kept.append(x)
        elif x in way:
            todo.extend(reversed(x.children))
        elif not x.dropped and x.length and x.linked < 0.5 * x.length and not _link_list(x):
            kept.append(x)
    return kept


def main_text(page: str | None) -> str:
    if not page:
        return ""
    root = parse(page)
    marked = _drop_by_class(root)
    nodes = [n for n in _score(root) if n.length]
    if not nodes and marked:
        root = parse(page)
        nodes = [n for n in _score(root) if n.length]
    if not nodes:
        return ""
    holders = [n for n in nodes if n is root or n.tag in ("div", "section", "article", "main", "body", "td", "blockquote", "center", "tr", "tbody", "table", "ul", "ol", "dl", "details")]
    best = max(holders, key=lambda n: n.score) if holders else root
    kept: list[_Node | str] = [best]
    around = _around(best)
    if around is not None:
        kept = _all_of(around, best)
    elif best.parent is not None:
        least = max(5.0, 0.2 * best.score)
        kept = []
        for n in best.parent.children:
            if n is best:
                kept.append(n)
            elif isinstance(n, str):
                if len(n) > 80:
                    kept.append(n)
            elif not n.dropped and n.length and not _link_list(n):
                density = n.linked / n.length
                running = n.tag == "p" and density < 0.25 and (n.length > 80 or n.length and density == 0 and re.search(r"[.!?]", "".join(c for c in n.children if isinstance(c, str))))
                if n.score >= least or running or (n.tag in HEADINGS and density < 0.5):
                    kept.append(n)
    out: list[str] = []
    for x in kept:
        if isinstance(x, str):
            out.append(x)
        else:
            _blocks(x, out)
    return "\n".join(out)


def extract_pages(pages: DataFrame) -> DataFrame:
    """``page_id, url, text, n_chars`` of every page."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(x.as_py()).encode("utf-8", "replace").decode("utf-8") for x in batch.column("html")]
            yield pa.record_batch(
                [batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
                ["page_id", "url", "text", "n_chars"],
            )

    return pages.select(F.col("page_id").cast("bigint"), "url", "html").mapInArrow(run, "page_id bigint, url string, text string, n_chars bigint")
