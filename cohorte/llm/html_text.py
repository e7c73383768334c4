"""Main text of web pages by tree scoring.

A page becomes a light tree (tags may be unclosed or crossed). Elements that are
never article text (scripts, menus, headers, footers, sidebars, notices,
adverts, forms, reader comments) are marked by tag, role, class or id. Every
other paragraph passes points for its length and commas to its ancestors, less
the farther they are; an element's points shrink with its share of link text.
The best element, or the article around it, gives the blocks; without an article
also what stands beside it: headings, paragraphs, lists, tables and quotations that
aren't made of links, and anything of that kind between them.

A class or id marks an element by its whole name (``cookie-notice``), not by a word in
it (``related-work``), and never a heading.

Null and empty pages give an empty text; a page without paragraphs gives all its
unmarked text. Broken markup never fails, and very long pages and attributes cost
their length. Repeated rows are alike. Other columns are ignored; an empty table
gives an empty result.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from cohorte.llm.common import sliced

# Element names of the HTML standard, by how they are treated.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe noembed noframes xmp template".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark nobr q rb rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split()
)
NEVER = frozenset("head script style noscript template iframe object embed applet svg math canvas audio video map nav header footer aside form button select datalist textarea input option fieldset dialog menu title noembed noframes xmp".split())
CLOSES_P = frozenset(
    "address article aside blockquote center details dialog dir div dl dd dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr li main menu nav ol p pre section summary table ul".split()
)
CLOSED_BY = {
    "li": frozenset(["li"]),
    "dt": frozenset(["dt", "dd"]),
    "dd": frozenset(["dt", "dd"]),
    "option": frozenset(["option"]),
    "tr": frozenset(["tr", "td", "th"]),
    "td": frozenset(["td", "th"]),
    "th": frozenset(["td", "th"]),
    "tbody": frozenset(["tr", "td", "th", "thead", "tbody"]),
}
SCOPES = frozenset("table ul ol dl td th body html article section div aside main".split())
PARAGRAPHS = frozenset("p pre blockquote li dd td".split())
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alertdialog alert menu menubar toolbar tablist status".split())
#: Words of a class or id that mark an element, whatever it holds.
ALWAYS = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense adslot adbox sponsor sponsored promo promos promotion promoted comment comments commentlist disqus reply replies respond cookie cookies consent gdpr newsletter subscribe subscription signup popup modal paywall share sharing social related recommended recommendations notice notices notification banner outbrain taboola".split()
)
#: Words that mark an element unless an article stands in it.
UNLESS_ARTICLE = frozenset(
    "nav navbar navigation menu menus breadcrumb breadcrumbs header masthead topbar footer foot bottom sidebar side rail aside widget widgets pagination pager toolbar login search skip alert alerts form meta tags byline".split()
)

#: Words that say no more of an element than its place or shape; a name that
#: holds any other word besides marking ones is a name of its own (``related-work``).
PLAIN_WORDS = frozenset(
    "area bar block box btn button bottom center col cols column container content cta desktop elem element entry fixed float grid group holder icon icons id info inner item items js layer layout left link links list main media mobile module outer overlay page panel post posts article articles right row section site slot small sticky tab tabs text title top unit view wide wrap wrapper zone the by".split()
)
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6 hgroup".split())
#: Blocks that belong to the text beside the best element, however short.
BESIDE = HEADINGS | frozenset("p pre blockquote ul ol dl table figure figcaption address".split())

# a quote opens a value only after "=", as in the standard; so no start of a tag is read over twice
_TAG = re.compile(
    r"<(?:!--.*?(?:--!?>|\Z)|(/?)([a-zA-Z][^\s/>]*)((?:[^<>=]++|=\s*+(?:\"[^\"]*+\"|'[^']*+')?+)*+)>|[!?/][^>]*>)",
    re.S,
)
_ATTRIBUTE = re.compile(r"([^\s=/\"'>]+)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))")
_PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|[0-9]+")
_UNSEEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)
_END = {t: re.compile(rf"</{t}(?=[\s/>])[^>]*>?", re.I) for t in RAW}


class Node:
    __slots__ = ("tag", "parent", "items", "marked", "text", "linked", "points", "article", "inside")

    def __init__(self, tag: str, parent: Node | None, marked: str = "") -> None:
        self.tag, self.parent, self.marked = tag, parent, marked
        self.items: list[Node | str] = []
        self.text = self.linked = 0
        self.points = 0.0
        self.article = tag in ("article", "main")
        #: Stands in an article: what has no mark of its own belongs to it.
        self.inside = tag == "article" or (parent is not None and parent.inside)
        if tag == "header" and self.inside:
            self.marked = ""


def mark(tag: str, attributes: str) -> str:
    """``always``, ``soft`` (unless an article stands inside) or nothing."""
    if tag in NEVER:
        return "soft" if tag in ("form", "header", "fieldset", "button") else "always"
    if "=" not in attributes and "hidden" not in attributes:
        return ""
    values = {}
    for m in _ATTRIBUTE.finditer(attributes):
        values.setdefault(m[1].lower(), m[2] or m[3] or m[4] or "")
    if tag in ("html", "body"):
        return ""
    if values.get("role", "").lower() in ROLES or values.get("aria-hidden", "").lower() == "true" or _UNSEEN.search(values.get("style", "")):
        return "always"
    if re.search(r"(?:^|\s)hidden(?=\s|$|/)", _ATTRIBUTE.sub(" ", attributes)) or "hidden" in values:
        return "always"
    if tag in HEADINGS:
        return ""  # their names are slugs of what they say
    out = ""
    for name in (values.get("class", "") + " " + values.get("id", "")).split():
        words = {w.lower() for w in _PART.findall(name) if len(w) > 1 and not w.isdigit()}
        if words - ALWAYS - UNLESS_ARTICLE - PLAIN_WORDS:
            continue  # a name of its own
        if words & ALWAYS:
            return "always"
        if words & UNLESS_ARTICLE and tag not in ("article", "main"):
            out = "soft"
    return out


def tree(page: str) -> Node:
    """The element tree; text nodes are decoded."""
    root = Node("#root", None)
    here, at = root, 0

    def close_until(names: frozenset[str], scopes: frozenset[str]) -> None:
        nonlocal here
        n = here
        while n.parent is not None and n.tag not in names:
            if n.tag in scopes:
                return
            n = n.parent
        if n.parent is not None:
            here = n.parent

    while True:
        m = _TAG.search(page, at)
        upto = m.start() if m else len(page)
        if upto > at:
            here.items.append(html.unescape(page[at:upto]))
        if not m:
            return root
        at = m.end()
        tag = (m[2] or "").lower()
        if not tag:
            continue
        if m[1]:
            if tag in INLINE:
                close_until(frozenset([tag]), CLOSES_P | SCOPES)
            else:
                close_until(frozenset([tag]), frozenset(["table"]) if tag in ("li", "p") else frozenset())
            continue
        if tag in CLOSES_P:
            close_until(frozenset(["p"]), SCOPES)
        if tag in CLOSED_BY:
            close_until(CLOSED_BY[tag], frozenset("table ul ol dl".split()) - CLOSED_BY[tag])
        node = Node(tag, here, mark(tag, m[3]))
        here.items.append(node)
        if tag in RAW:
            end = _END[tag].search(page, at)
            at = end.end() if end else len(page)
        elif tag not in VOID and not m[3].endswith("/"):
            here = node


def _ordered(root: Node) -> list[Node]:
    """All nodes, parents first."""
    out, todo = [], [root]
    while todo:
        n = todo.pop()
        out.append(n)
        todo.extend(x for x in reversed(n.items) if isinstance(x, Node))
    return out


def _measured(root: Node) -> list[Node]:
    """Marks settled, text and link lengths and points; returns the nodes that stay."""
    nodes = _ordered(root)
    for n in reversed(nodes):
        if n.parent is not None and n.article and n.marked != "always":
            n.parent.article = True
    stay = []
    for n in nodes:
        if n.marked == "soft" and n.article:
            n.marked = ""
        if n.parent is not None and n.parent.marked:
            n.marked = n.parent.marked
        if not n.marked:
            stay.append(n)
    anchors: dict[int, int] = {}
    for n in reversed(stay):
        n.text += sum(len("".join(x.split())) for x in n.items if isinstance(x, str))
        if n.tag == "a":
            n.linked = n.text
        own = anchors.get(id(n), 0) + (n.tag == "a")
        if n.parent is not None:
            n.parent.text += n.text
            n.parent.linked += n.linked
            anchors[id(n.parent)] = anchors.get(id(n.parent), 0) + own
        if n.tag in ("ul", "ol", "div", "section", "p", "table", "dl") and own >= 3 and n.linked > 0.8 * n.text and not n.article and not n.inside:
            n.marked = "menu"  # nothing but links
    for n in stay:
        if n.parent is not None and n.parent.marked:
            n.marked = n.parent.marked
    return [n for n in stay if not n.marked]


def _score(nodes: list[Node]) -> None:
    for n in nodes:
        direct = [x for x in n.items if isinstance(x, str)]
        if n.tag not in PARAGRAPHS and not any(len(x.strip()) > 80 for x in direct):
            continue
        if not n.text:
            continue
        commas = sum(x.count(",") + x.count("，") + x.count("、") for x in _strings(n))
        points = (1 + min(commas, 20) + min(n.text / 100, 20)) * (1 - n.linked / n.text)
        up, level = n.parent if n.tag in PARAGRAPHS else n, 1
        while up is not None and level <= 4:
            up.points += points / level
            up, level = up.parent, level + 1


def _strings(node: Node) -> Iterator[str]:
    todo: list[Node | str] = [node]
    while todo:
        x = todo.pop()
        if isinstance(x, str):
            yield x
        elif not x.marked:
            todo.extend(reversed(x.items))


def _container(nodes: list[Node], root: Node) -> list[Node]:
    """The elements whose blocks are the text, in page order."""
    worth = lambda n: n.points * (1 - n.linked / n.text) if n.text else 0.0
    candidates = [n for n in nodes if n.points > 0 and n.tag not in INLINE]
    if not candidates:
        return [root]
    best = max(candidates, key=worth)
    up = best
    while up is not None:
        if up.tag in ("article", "main"):
            best = up
            if up.tag == "article":
                break
        up = up.parent
    if best.tag in ("body", "html", "#root", "main") or best.parent is None:
        return [best]
    floor = 0.2 * worth(best)
    beside = [x for x in best.parent.items if isinstance(x, Node) and not x.marked]
    plain = lambda x: x.linked < 0.25 * x.text
    kept = [x is best or (x.tag in BESIDE and plain(x)) or (x.tag == best.tag and worth(x) >= floor) for x in beside]
    first, last = kept.index(True), len(kept) - 1 - kept[::-1].index(True)
    return [x for i, x in enumerate(beside) if kept[i] or (first < i < last and plain(x))]


def _blocks(nodes: list[Node]) -> Iterator[str]:
    line: list[str] = []
    todo: list[Node | str | None] = list(reversed(nodes))
    while todo:
        x = todo.pop()
        if isinstance(x, str):
            line.append(x)
        elif x is None:  # a block's edge
            text = " ".join("".join(line).split())
            line.clear()
            if text:
                yield text
        elif x.tag == "br":
            line.append(" ")
        elif not x.marked:
            edges = x.tag not in INLINE
            if edges:
                todo.append(None)
            todo.extend(reversed(x.items))
            if edges:
                todo.append(None)
    text = " ".join("".join(line).split())
    if text:
        yield text


def main_text(page: str | None) -> str:
    """The article's blocks, white space made single, joined by an empty line."""
    if not page:
        return ""
    root = tree(page)
    nodes = _measured(root)
    _score(nodes)
    return "\n\n".join(_blocks(_container(nodes, root)))


def _extracted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in sliced(batches):
        texts = [main_text(p) for p in batch.column("html").to_pylist()]
        yield pa.RecordBatch.from_arrays(
            [batch.column("page_id").cast(pa.int64()), batch.column("url").cast(pa.string()), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
            names=["page_id", "url", "text", "n_chars"],
        )


def extract(pages: DataFrame) -> DataFrame:
    """``page_id, url, text, n_chars`` (code points) of every row of ``pages``."""
    return pages.select("page_id", "url", "html").mapInArrow(_extracted, "page_id long, url string, text string, n_chars long")
