"""Main text of HTML pages by scoring the document tree.

A small tolerant parser builds the tree.  Each text block passes points, for
its length and its commas, to the container it stands in and in part to higher
ones; containers are discounted by the share of their text that is in links and
favoured by what their tag, class, id and role say.  The best container is kept,
with those of its siblings that score like content, and the page's heading if
it stands before it.

Menus, adverts, notices and the like are told by tags and by the names of
containers; names of paragraphs, headings and inline elements are not looked
at, but for whole names that say advert or cookie notice.  If nothing but parts
with such names holds text, the names are not believed and the page is read
without them.

Every step costs a constant or a logarithm for each tag, however deep or
misnested the page.

Defined cases: null or empty html, or a page without text, gives an empty
string; unclosed, misnested and unknown tags are tolerated; white space inside
a block becomes one space; blocks are joined by an empty line, in page order;
of containers with equal scores the first in the page is kept; repeated rows
are pages of their own; an empty table gives an empty result; further columns
are left out unless ``keep`` names them, whatever their names.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections import defaultdict
from collections.abc import Iterator
from functools import lru_cache
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame

from .common import batches_of

# The roles of HTML elements.
VOID = frozenset("area base basefont br col embed frame hr img input keygen link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes noscript template svg".split())
#: What these hold is no text even if they are never closed.
SWALLOWING = frozenset({"script", "style"})
DROPPED = frozenset("script style textarea title xmp iframe noembed noframes noscript template svg head nav header footer aside menu form button select option input label fieldset dialog canvas object audio video map datalist annotation annotation-xml".split())
BLOCKS = frozenset(
    "html body address article aside blockquote center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul caption".split()
)
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
CONTAINERS = frozenset("html body article main section div td center blockquote".split())
#: Blocks that are texts rather than parts of a page: their names say nothing.
TEXTS = HEADINGS | {"p", "pre", "hr", "caption", "figcaption", "summary", "address"}
#: What an opening tag ends, up to the nearest of the fences.
IMPLIED = {
    "li": (frozenset({"li"}), frozenset({"ul", "ol", "menu"})),
    "dt": (frozenset({"dt", "dd"}), frozenset({"dl"})),
    "dd": (frozenset({"dt", "dd"}), frozenset({"dl"})),
    "tr": (frozenset({"tr", "td", "th"}), frozenset({"table"})),
    "td": (frozenset({"td", "th"}), frozenset({"tr", "table"})),
    "th": (frozenset({"td", "th"}), frozenset({"tr", "table"})),
    "tbody": (frozenset({"tbody", "thead", "tfoot", "tr", "td", "th"}), frozenset({"table"})),
    "option": (frozenset({"option"}), frozenset({"select"})),
}
ENDS_PARAGRAPH = BLOCKS - {"html", "body", "td", "th", "tr", "tbody", "thead", "tfoot", "caption"}
#: An end tag of an inline element does not reach beyond these.
FENCES = ("table", "td", "th")

# Words that name parts of pages.
UNLIKELY = frozenset(
    """ad ads advert adverts advertisement advertisements advertising adsense adbox adslot banner breadcrumb breadcrumbs comment comments commentlist disqus
    respond reply replies cookie cookies consent gdpr notice notices alert popup modal overlay newsletter subscribe subscription signup sidebar side widget
    menu menubar nav navbar navigation navi footer foot masthead header topbar toolbar share sharing social related recommended recommendations promo promoted
    promotion sponsor sponsored sponsors pagination pager tags toc login search skip contentinfo complementary dialog form legal copyright outbrain taboola""".split()
)
#: Of these, what no article's body bears, whatever else it is called.
PLAINLY = frozenset("ad ads advert adverts advertisement advertisements advertising comment comments commentlist sidebar nav navbar navigation menu menubar footer cookie cookies newsletter promo promoted promotion sponsor sponsored sponsors related share sharing social".split())
LIKELY = frozenset("article articlebody body content entry main page post story text blog".split())
#: A name that begins so, or is joined so, tells what is beside the text: has-sidebar, content-with-nav.
BESIDE = frozenset("has no with without is open show hide".split())
#: Names of paragraphs and inline elements that are adverts or notices.
LEAF = frozenset("ad ads advert advertisement sponsored promo cookie-notice cookie-banner cookie-consent".split())

_TAG = re.compile(
    r"<!--(?:-?>|.*?(?:--!?>|\Z))|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*>?"
    r"|</?([A-Za-z][^\s/>]*+)((?:[\s/]++|[^\s/>][^\s/>=]*+(?:\s*+=\s*+(?:\"[^\"]*+\"|'[^']*+'|[^\s>]*+))?+)*+)(?:>|\Z)",
    re.S,
)
_ATTRIBUTE = re.compile(r"""([^\s/>][^\s/>=]*+)(?:\s*+=\s*+("[^"]*+"|'[^']*+'|[^\s>]*+))?+""")
_UNSEEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)
_WORDS = re.compile(r"[A-Za-z]+")
_SPACE = re.compile(r"\s+")


class Node:
    """An element.  ``up`` is the nearest container around it, ``enter`` and ``leave`` frame its place in page order."""

    __slots__ = ("tag", "parent", "children", "names", "gone", "up", "inside", "score", "chars", "linked", "enter", "leave")

    def __init__(self, tag: str, parent: Node | None, names: str = "", gone: bool = False):
        self.tag, self.parent, self.names, self.gone = tag, parent, names, gone
        self.children: list[Node | str] = []
        self.score, self.chars, self.linked, self.enter, self.leave = 0.0, 0, 0, 0, 0
        self.up: Node | None = None if parent is None else parent if parent.tag in CONTAINERS else parent.up
        # in an article: a header there holds the article's headings
        self.inside: bool = parent is not None and (parent.inside or parent.tag in ("article", "main") or parent.tag in CONTAINERS and bool(parent.names) and told(parent.names)[1])


@lru_cache(maxsize=4096)
def told(names: str) -> tuple[bool, bool, bool, bool]:
    """What class, id and role say: unlikely, likely, plainly unlikely; and whether a whole name marks an advert."""
    unlikely = likely = plainly = leaf = False
    for name in names.split():
        words = [w.lower() for w in _WORDS.findall(name)]
        leaf = leaf or name.lower() in LEAF
        if not BESIDE.isdisjoint(words[:-1]):
            first = next(i for i, w in enumerate(words) if w in BESIDE)
            words = words[:first]
        likely = likely or not LIKELY.isdisjoint(words)
        unlikely = unlikely or not UNLIKELY.isdisjoint(words)
        plainly = plainly or not PLAINLY.isdisjoint(words)
    return unlikely, likely, plainly, leaf


def described(attributes: str) -> tuple[str, bool]:
    """The names in class, id, role and itemprop; whether the element is hidden."""
    names, hidden = [], False
    for key, value in _ATTRIBUTE.findall(attributes):
        key = key.lower()
        if key in ("class", "id", "role", "itemprop", "hidden", "aria-hidden", "style"):
            value = unescape(value[1:-1] if value[:1] in ("'", '"') and value[-1:] == value[:1] and len(value) > 1 else value)
            if key in ("class", "id", "role", "itemprop"):
                names.append(value)
            elif key == "hidden" or key == "aria-hidden" and value.strip().lower() == "true" or key == "style" and _UNSEEN.search(value):
                hidden = True
    return " ".join(names), hidden


def _by_name(tag: str, names: str) -> bool:
    """A part of the page that its names rule out."""
    unlikely, likely, plainly, leaf = told(names)
    if tag in ("article", "main"):
        return tag == "article" and not {"comment", "reply"}.isdisjoint(names.lower().split())
    if tag not in BLOCKS or tag in TEXTS:
        return leaf
    return unlikely and not (likely and tag in CONTAINERS and not plainly)


@lru_cache(maxsize=64)
def _end_of(tag: str) -> re.Pattern[str]:
    return re.compile(f"</{re.escape(tag)}(?![^\\s/>])[^>]*>?", re.I)


def parse(html: str, by_name: bool = True) -> Node:
    """A tree of elements and decoded texts; elements that hold no article text are marked gone."""
    root = Node("html", None)
    path = [root]  # the open elements
    opened: dict[str, list[int]] = defaultdict(list)  # their places in ``path``, by tag
    blocks = [0]  # places of open blocks other than paragraphs

    def close(to: int) -> None:
        while len(path) > to:
            node = path.pop()
            opened[node.tag].pop()
            if blocks[-1] == len(path):
                blocks.pop()

    endless: set[str] = set()
    at, scan = 0, _TAG.search
    while m := scan(html, at):
        if m.start() > at:
            text = html[at : m.start()]
            path[-1].children.append(unescape(text) if "&" in text else text)
        at = m.end()
        tag = m[1]
        if tag is None:
            if m[0].startswith("<![CDATA["):
                path[-1].children.append(m[0][9:].removesuffix("]]>"))
            continue
        tag = tag.lower()
        if html[m.start() + 1] == "/":
            places = opened.get(tag)
            fence = -1 if tag in BLOCKS else max((opened[f][-1] for f in FENCES if opened.get(f)), default=-1)
            if places and places[-1] > fence:
                close(places[-1])
            elif tag == "p":
                path[-1].children.append(Node("p", path[-1]))
            continue
        closed = m[2].endswith("/")
        if tag in RAW:
            if tag == "svg" and closed or tag in endless:
                continue
            if end := _end_of(tag).search(html, at):
                at = end.end()
            elif tag in SWALLOWING:
                at = len(html)
            else:
                endless.add(tag)
            continue
        if tag in ("html", "body"):
            continue
        if tag in ENDS_PARAGRAPH and opened.get("p") and opened["p"][-1] > blocks[-1]:
            close(opened["p"][-1])
        if tag in IMPLIED:
            ended, fences = IMPLIED[tag]
            fence = max((opened[f][-1] for f in fences if opened.get(f)), default=0)
            to = len(path)
            for name in ended:
                if places := opened.get(name):
                    first = bisect_right(places, fence)
                    if first < len(places):
                        to = min(to, places[first])
            close(to)
        names, hidden = described(m[2]) if m[2] else ("", False)
        node = Node(tag, path[-1], names, hidden or tag in DROPPED or by_name and bool(names) and _by_name(tag, names))
        path[-1].children.append(node)
        if tag not in VOID and not closed or tag in BLOCKS and tag != "hr":
            opened[tag].append(len(path))
            if tag in BLOCKS and tag != "p":
                blocks.append(len(path))
            path.append(node)
    if at < len(html):
        path[-1].children.append(unescape(html[at:]))
    return root


class Block:
    __slots__ = ("text", "owner", "linked", "heading")

    def __init__(self, text: str, owner: Node, linked: int, heading: bool):
        self.text, self.owner, self.linked, self.heading = text, owner, linked, heading


def blocks_of(root: Node) -> list[Block]:
    """Text blocks in page order, each with the block element it stands in and how many characters are in links.

    Counts the characters of every element on the way, and numbers the elements.
    """
    out: list[Block] = []
    parts: list[str] = []
    linked = number = 0

    def flush(owner: Node, skip: bool) -> None:
        nonlocal linked
        if parts:
            if not skip and (text := _SPACE.sub(" ", "".join(parts)).strip()):
                n = min(linked, len(text))
                out.append(Block(text, owner, n, owner.tag in HEADINGS))
                owner.chars += len(text)
                owner.linked += n
            parts.clear()
            linked = 0

    # (node, next child, owner, in a link, beside a header's headings): no recursion, however deep the page
    stack: list[list] = [[root, 0, root, False, False]]
    while stack:
        top = stack[-1]
        node, i, owner, link, beside = top
        if i == len(node.children):
            stack.pop()
            if node.tag in BLOCKS:
                flush(owner, beside)
            node.leave = number
            if node.parent is not None:
                node.parent.chars += node.chars
                node.parent.linked += node.linked
            continue
        top[1] = i + 1
        child = node.children[i]
        if isinstance(child, str):
            parts.append(child)
            if link:
                linked += len(child)
            continue
        number += 1
        child.enter = child.leave = number
        in_header = child.tag == "header" and child.inside
        if child.gone and not in_header or in_header and child.names and told(child.names)[2]:
            if child.tag in BLOCKS:
                flush(owner, beside)
            else:
                parts.append(" ")
        elif child.tag in VOID:
            if child.tag == "hr":
                flush(owner, beside)
            elif child.tag != "wbr":
                parts.append(" ")
        elif child.tag in BLOCKS:
            flush(owner, beside)
            stack.append([child, 0, child, link, child.tag not in HEADINGS and (beside or in_header)])
        else:
            stack.append([child, 0, owner, link or child.tag == "a", beside])
    flush(root, False)
    root.leave = number
    return out


# What a tag adds to a container's score; a likely name adds NAMED.
WEIGHTS = {"article": 30.0, "main": 25.0, "section": 3.0, "div": 5.0, "blockquote": 3.0, "td": 1.0}
NAMED = 15.0
#: Shares of a block's points that go to the container around it and to those further out.
SHARES = (1.0, 1 / 2, 1 / 6, 1 / 9)
COMMAS = re.compile("[,、，]")


def points_of(block: Block) -> float:
    return 0.0 if block.heading else 1.0 + len(COMMAS.findall(block.text)) + min(len(block.text) / 100.0, 3.0)


def scores(blocks: list[Block]) -> list[Node]:
    """Containers that got points, with their scores set, links discounted, in the order in which they were met."""
    found: dict[int, Node] = {}
    for b in blocks:
        points = points_of(b)
        node = b.owner if b.owner.tag in CONTAINERS else b.owner.up
        for share in SHARES:
            if node is None:
                break
            if id(node) not in found:
                found[id(node)] = node
                node.score = WEIGHTS.get(node.tag, 0.0) + NAMED * (bool(node.names) and told(node.names)[1])
            node.score += points * share
            node = node.up
    for node in found.values():
        node.score *= 1 - density(node)
    return list(found.values())


def density(node: Node) -> float:
    """The share of an element's characters that is in links."""
    return node.linked / node.chars if node.chars else 0.0


def _kept(best: Node) -> list[Node]:
    """The best container and those of its siblings that are content like it."""
    kept = [best]
    if best.parent is None:
        return kept
    whole = best.tag in ("article", "main")
    least = max(10.0, best.score * 0.2)
    for x in best.parent.children:
        if not isinstance(x, Node) or x is best or x.gone or not x.chars:
            continue
        alike = 0.2 * best.score if x.names and x.names == best.names else 0.0
        good = x.tag == best.tag and x.score + alike >= least
        if not whole and x.tag == "p":
            good = good or x.chars > 80 and density(x) < 0.25 or density(x) == 0 and x.chars > 20
        if not whole and x.tag in ("h1", "h2", "h3", "pre", "blockquote", "table", "ul", "ol", "dl", "figure") and density(x) < 0.25:
            good = True
        if good:
            kept.append(x)
    return kept


def _read(html: str, by_name: bool) -> list[str]:
    root = parse(html, by_name)
    blocks = blocks_of(root)
    if not blocks:
        return []
    best = max(scores(blocks) or [root], key=lambda n: n.score)
    # the article as a whole rather than a part of it
    node = best.up
    while node is not None:
        if node.tag in ("article", "main") or node.names and not {"articlebody", "article", "entry", "post"}.isdisjoint(w.lower() for w in _WORDS.findall(node.names)):
            best = node
        node = node.up
    kept = sorted((n.enter, n.leave) for n in _kept(best))
    starts = [a for a, _ in kept]

    def inside(b: Block) -> bool:
        i = bisect_right(starts, b.owner.enter) - 1
        return i >= 0 and b.owner.enter <= kept[i][1]

    taken = [i for i, b in enumerate(blocks) if inside(b)]
    # the page's heading may stand before the container
    if taken and not any(blocks[i].owner.tag == "h1" for i in taken):
        taken = [i for i in range(taken[0]) if blocks[i].owner.tag == "h1"][-1:] + taken
    return [blocks[i].text for i in taken]


def main_text(html: str | None) -> str:
    """The article's blocks joined by an empty line."""
    if not html:
        return ""
    return "\n\n".join(_read(html, True) or _read(html, False))


def extract(pages: DataFrame, html_column: str = "html", keep: tuple[str, ...] = ("page_id", "url")) -> DataFrame:
    """Per row: the ``keep`` columns, text and n_chars (its code points)."""
    kinds = dict(pages.dtypes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches_of(batches, html_column):
            texts = [main_text(h) for h in batch.column(html_column).to_pylist()]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], [*keep, "text", "n_chars"])

    schema = ", ".join([*(f"`{c}` {kinds[c]}" for c in keep), "text string", "n_chars bigint"])
    return pages.select(*keep, html_column).mapInArrow(run, schema)
