"""Main text of web pages by wrapper induction.

Pages of one host come from few templates. The trees of a host's pages are aligned by simple tree matching with a reference tree: that of the
host's most frequent layout (the set of places, paths of tags and classes, that have text), and that of the page's own layout, so that
several templates of a host don't hide each other. Over all pages aligned, each reference node is constant where most pages have the
same text in the node matched with it, and a slot where they vary: constant nodes are template, slots are content. What matches nothing is
content too.

A page's text is what stands in the article (or articles side by side), main or else the whole body, without what tags, roles, classes and
ids mark as boilerplate, and without the template; a name that has a word of another kind in it marks nothing, and marks by name and forms
that hold nearly all prose of a page are lifted; prose inside an article or main has to be the same on nearly all pages aligned to be template.

A page is read by a forgiving tokenizer: unclosed elements end with their parents, a comment or script that never ends takes the
rest, unknown end tags are ignored, a quote in a tag that isn't closed before the next tag counts as a character. Inside a block white
space, line breaks included, becomes one blank; blocks are joined by "\\n". Time grows with the length of a page.

Rows. Null or empty html: empty text. Null url: no host, so no template. A node matched by fewer than ``LEAST`` different pages
is no template, nor is one more than DEPTH levels down. Repeated pages and copies (the same text outside of marked boilerplate) count
once. Pages of any length are read whole.
"""

from __future__ import annotations

import hashlib
import html as entities
import json
import math
import re
import zlib
from collections import Counter
from functools import lru_cache
from urllib.parse import urlsplit

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ammlytics.llm._spark import texts, written

LEAST = 4
#: Share of the pages with a node that have to have the same text there for it to be template.
CONSTANT = 0.7
#: The same for prose (paragraphs, headings, list items, cells) inside an article or main, of all pages aligned, with the node or without.
CONSTANT_PROSE = 0.9
#: Wrappers of all hosts are broadcast up to so many bytes, and joined by host and layout beyond.
BROADCAST_BYTES = 16 << 20

#: Levels of a tree that are aligned.
DEPTH = 250

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([A-Za-z][^\s/>]*)", re.S)
_EDGE = re.compile(r"[>\"']")
_ATTR = re.compile(r"([^\s=/>\"']+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")
_RAW = frozenset("script style textarea title xmp iframe noembed noframes noscript template svg math object video audio canvas".split())
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr nobr".split())
_DROPPED = frozenset("head nav footer aside form button select option input menu dialog fieldset datalist output".split()) | _RAW
_ENDS = {  # what a start tag ends implicitly
    "li": ({"li"}, {"ul", "ol", "menu"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
    "option": ({"option"}, {"select"}),
}
_BAD = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense adslot adbox sponsor sponsored promo promotion promoted banner menu menus nav navbar navigation topbar sidebar sidebars "
    "breadcrumb breadcrumbs footer foot masthead cookie cookies consent gdpr notice notices notification notifications popup modal overlay newsletter subscribe subscription signup signin login "
    "register share sharing social related recommended recommendations recirculation comment comments reply replies discussion disqus respond widget widgets toolbar pagination pager skip search "
    "searchbox hidden alert toast copyright disclaimer legal paywall outbrain taboola".split()
)
_HEADER = frozenset("header head".split())
_GOOD = frozenset("article content main post entry story body text page".split())
#: These mark a node in any name; the others do where the whole name consists of marks and of words of place and form.
_FIRM = frozenset("comment comments reply replies discussion disqus respond ad ads advert adverts advertisement advertising sponsored sponsor promo taboola outbrain related cookie cookies gdpr".split())
_PLACES = frozenset(
    "site page global main top bottom left right upper lower inner outer primary secondary header head box bar block area panel slot unit zone section region container wrapper wrap holder group row col column "
    "list item items link links button buttons btn icon icons title heading label form field input text content body post posts article articles entry story el js is the and us my user".split()
)
_BAD_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alertdialog alert menu menubar toolbar".split())
_SPLIT = re.compile(r"[^A-Za-z0-9]+|(?<=[a-z0-9])(?=[A-Z])")


class Node:
    """An element; at: a hash of its path."""

    __slots__ = ("at", "children", "cover", "inside", "label", "mark", "parent", "root", "skip", "tag", "trunk")

    def __init__(self, tag, label, parent, mark=None, trunk=False):
        self.tag, self.label, self.parent, self.trunk = tag, label, parent, trunk
        self.inside = trunk or (parent is not None and parent.inside)  # an article or main, or in one
        self.mark, self.skip, self.root = mark, False, None
        self.cover = self if mark or parent is None else parent.cover  # the nearest marked node around
        self.children: list[Node] = []
        x = ((parent.at if parent is not None else 0) ^ zlib.crc32(label.encode("utf-8", "replace"))) * 0x9E3779B97F4A7C15 + 0x632BE59BD9B4E019
        self.at = (x ^ x >> 29) & 0x7FFFFFFFFFFFFFFF


#: Marks: HARD ones always count; FIRM and SOFT ones unless they would take what the page is about. FIRM: by name alone; SOFT: of several names, and a form.
HARD, FIRM, SOFT = 1, 2, 3


def _marked(tag: str, attrs: dict, in_article: bool) -> int | None:
    """Which mark tag, role, class or id give: whether they say that this is no main text."""
    if (tag in _DROPPED and tag != "form") or (tag == "header" and not in_article):
        return HARD
    if "hidden" in attrs or attrs.get("aria-hidden") == "true" or "display:none" in attrs.get("style", "").replace(" ", "").lower() or attrs.get("role", "").lower() in _BAD_ROLES:
        return HARD
    if tag == "form":
        return SOFT
    if not attrs or tag in ("html", "body", "main"):
        return None
    soft = others = False
    for name in (*attrs.get("class", "").split(), attrs.get("id", "")):
        words = [w.lower() for w in _SPLIT.split(name) if w]
        if not words or words[0] in ("no", "with", "has", "without"):
            others |= bool(words)
            continue
        if any(w in _FIRM for w in words):
            return FIRM
        # a foreign word ("overflow-hidden", "legal-news") makes another name of it
        if any(w in _BAD or (w in _HEADER and not in_article) for w in words) and all(w in _BAD or w in _PLACES or w.isdigit() for w in words) and ("sidebar" in words or not _GOOD & set(words)):
            soft = True
        else:
            others = True
    return (SOFT if others else FIRM) if soft else None


@lru_cache(4096)
def _element(tag: str, inner: str, in_article: bool) -> tuple[str, int | None, bool]:
    """Of a start tag and what stands in it: label, mark, and whether it is an article or main."""
    attrs: dict[str, str] = {}
    for a in _ATTR.finditer(inner):
        attrs.setdefault(a[1].lower(), entities.unescape(a[2] if a[2] is not None else a[3] if a[3] is not None else a[4] or ""))
    trunk = tag in ("article", "main") or attrs.get("role", "").lower() == "main" or attrs.get("itemprop") == "articleBody"
    return f"{tag}.{attrs.get('class', '')}", _marked(tag, attrs, in_article), trunk


def _weights(nodes: list[Node], sizes: dict[int, int]) -> dict[int, int]:
    """Of each node (by id) how much of the sizes is inside it; nodes: parents first."""
    held = dict(sizes)
    for node in reversed(nodes):
        if (n := held.get(id(node))) and node.parent is not None:
            held[id(node.parent)] = held.get(id(node.parent), 0) + n
    return held


def _settle(nodes: list[Node]) -> None:
    """What is skipped, by the marks, and each node's article root."""
    for node in nodes:
        up = node.parent
        if up is None:
            continue
        node.skip = up.skip or node.mark is not None
        node.root = up.root or (node if node.trunk and not node.skip else None)


def _judge(nodes: list[Node], blocks: list[tuple[Node, str]]) -> None:
    """Settles what is skipped; lifts FIRM and SOFT marks from blocks that hold nearly all prose of a page which keeps hardly any without them.

    A mark is lifted where half of all prose that no HARD mark takes is inside, and four times what the page keeps (more than that, if an article or main
    is inside and none is kept). FIRM marks are lifted only from what has an article or main and a first heading, forms only where prose outweighs the fields.
    """
    _settle(nodes)
    if not any(node.mark in (FIRM, SOFT) for node in nodes):
        return
    hard: dict[int, bool] = {}
    for node in nodes:
        hard[id(node)] = node.mark == HARD and node.tag not in _FIELDS or (node.parent is not None and hard[id(node.parent)])
    prose: dict[int, int] = {}
    kept = own = 0
    for node, text in blocks:
        if node.tag in _PROSE and not hard[id(node)]:
            prose[id(node)] = prose.get(id(node), 0) + len(text)
            kept += 0 if node.skip else len(text)
            own += len(text) if node.root is not None and not node.skip else 0
    whole = sum(prose.values())
    if kept * 2 >= whole:
        return
    held, trunks, heads, fields = (
        _weights(nodes, x) for x in (prose, *({id(x): 1 for x in nodes if not hard[id(x)] and is_(x)} for is_ in (lambda x: x.trunk, lambda x: x.tag == "h1", lambda x: x.tag in _FIELDS)))
    )
    for node in nodes:
        n, trunk = held.get(id(node), 0), trunks.get(id(node), 0)
        if node.mark not in (FIRM, SOFT) or node.tag in _INLINE or n * 2 <= whole or n <= kept * (1 if trunk and not own else 4):
            continue
        if (node.mark == SOFT or (trunk and heads.get(id(node)))) and (node.tag != "form" or n > FIELD * fields.get(id(node), 0)):
            node.mark = None
    _settle(nodes)


_FIELDS = frozenset("input select textarea".split())
#: Characters of prose that a field of a form weighs.
FIELD = 20


class _Quotes:
    """Where a tag ends, quotes in it taken as a browser takes them; a quote is looked for beyond the last one of its kind once only."""

    def __init__(self, page: str):
        self.page, self.last = page, {c: page.rfind(c) for c in "\"'"}

    def end(self, i: int) -> int:
        page, n = self.page, len(self.page)
        while m := _EDGE.search(page, i):
            j, c = m.start(), m[0]
            if c == ">":
                return j + 1
            if page[i:j].rstrip().endswith("="):
                k = page.find(c, j + 1) if j < self.last[c] else -1
                if k < 0 or (k + 1 < n and page[k + 1] not in " \t\n\r\f/>"):  # never closed, or by another tag's quote
                    stop = page.find(">", j)
                    return stop + 1 if stop >= 0 else n
                i = k + 1
            else:
                i = j + 1
        return n


def parse(page: str) -> tuple[Node, list[tuple[Node, str]]]:
    """The DOM tree, and all blocks of text with the node that each begins in."""
    quotes, opened = _Quotes(page), Counter()
    top = Node("#", "#", None)
    at, blocks, nodes = top, [], [top]
    buffer: list[str] = []
    holder: Node | None = None
    place = 0

    def flush():
        nonlocal holder
        if buffer:
            text = " ".join("".join(buffer).split())
            if text:
                blocks.append((holder, text))
            buffer.clear()
        holder = None

    def add(text):
        nonlocal holder
        if text:
            text = entities.unescape(text) if "&" in text else text
            if holder is None or holder.cover is not at.cover:
                if holder is not None:
                    flush()
                holder = at
            buffer.append(text)

    def leave_at(node):
        """Closes node and what is open in it."""
        nonlocal at
        while at is not node:
            opened[at.tag] -= 1
            at = at.parent
        opened[at.tag] -= 1
        at = at.parent
        return at

    def leave(tag):
        node = at
        while node.tag != tag:
            node = node.parent
        leave_at(node)

    n = len(page)
    while place < n:
        m = _TOKEN.search(page, place)
        if not m:
            add(page[place:])
            break
        if m.start() > place:
            add(page[place : m.start()])
        place = m.end()
        if m[2] is None:
            if page.startswith("<![CDATA[", m.start()):
                add(page[m.start() + 9 : place - 3])
            continue
        tag = m[2].lower()
        place = place + 1 if page.startswith(">", place) else quotes.end(place)
        inner = page[m.end() : place - 1] if page[place - 1] == ">" else page[m.end() : place]
        if m[1]:
            if not opened[tag]:
                if tag == "p":
                    flush()
                continue
            if tag not in _INLINE:
                flush()
            leave(tag)
            continue
        if tag == "br" or tag == "wbr":
            if buffer and tag == "br":
                buffer.append(" ")
            continue
        inline = tag in _INLINE
        if not inline:
            flush()
            if tag in _ENDS:
                ends, stop = _ENDS[tag]
                node = at
                while node is not top and node.tag not in stop and any(opened[e] for e in ends):
                    if node.tag in ends:
                        node = leave_at(node)
                        if tag != "tr":
                            break
                    else:
                        node = node.parent
            elif opened["p"]:
                node = at  # a block ends an open paragraph
                while node is not top and (node.tag in _INLINE or node.tag == "p"):
                    if node.tag == "p":
                        leave_at(node)
                        break
                    node = node.parent
        label, mark, trunk = _element(tag, inner, at.inside) if len(inner) < 300 else _element.__wrapped__(tag, inner, at.inside)
        node = Node(tag, label, at, mark, trunk)
        nodes.append(node)
        at.children.append(node)
        if tag in _VOID or inner.endswith("/") and tag not in _RAW:
            continue
        if tag in _RAW:
            end = re.compile(rf"</{re.escape(tag)}\s*>", re.I).search(page, place)
            place = end.end() if end else n
            continue
        at = node
        opened[tag] += 1
    flush()
    _judge(nodes, blocks)
    return top, blocks


_PROSE = frozenset("p h1 h2 h3 h4 h5 h6 blockquote pre li td dd dt figcaption".split())


def strict(node: Node) -> bool:
    """Is the node prose inside an article or main?"""
    return node.root is not None and node.tag in _PROSE


def _hash(text: str) -> int:
    return int.from_bytes(hashlib.blake2b(text.encode("utf-8", "replace"), digest_size=8).digest(), "little", signed=True)


def layout(blocks: list[tuple[Node, str]]) -> int:
    """The set of places that have text."""
    return _hash(" ".join(map(str, sorted({node.at for node, _ in blocks if not node.skip}))))


class Tree:
    """Blocks of a tree that aren't marked, in preorder: label, children, size, and a hash of all text inside (0: none)."""

    def __init__(self, labels: list[str], parents: list[int], own: list[int]):
        self.labels, self.parents, self.own = labels, parents, own
        self.kids, self.size, self.text = [[] for _ in labels], [1] * len(labels), list(own)
        for i, p in enumerate(parents):
            if p >= 0:
                self.kids[p].append(i)
        for i in range(len(labels) - 1, 0, -1):
            self.size[parents[i]] += self.size[i]
            if self.text[i]:
                self.text[parents[i]] = (self.text[parents[i]] * 31 + self.text[i]) % 0x7FFFFFFF or 1

    def shapes(self, numbers: dict[tuple, int]) -> list[int]:
        """A number for the structure of each subtree; equal ones have equal numbers."""
        shape = [0] * len(self.labels)
        for i in range(len(shape) - 1, -1, -1):
            shape[i] = numbers.setdefault((self.labels[i], *(shape[k] for k in self.kids[i])), len(numbers))
        return shape

    @classmethod
    def of(cls, top: Node, blocks: list[tuple[Node, str]] = ()) -> tuple[Tree, dict[int, int]]:
        """The tree, and each element's (by id) place in it: its own or that of the block around it."""
        labels, parents, place = ["#"], [-1], {id(top): 0}
        stack = [(k, 0, 1) for k in reversed(top.children)]
        while stack:
            node, parent, depth = stack.pop()
            if node.skip or depth > DEPTH:
                continue
            if node.tag in _INLINE:
                place[id(node)] = parent
            else:
                place[id(node)] = len(labels)
                labels.append(node.label), parents.append(parent)
            mine = place[id(node)]
            stack += [(k, mine, depth + 1) for k in reversed(node.children)]
        own = [0] * len(labels)
        for node, text in blocks:
            if (at := place.get(id(node))) is not None and not node.skip:
                own[at] = (own[at] * 31 + zlib.crc32(text.encode("utf-8", "replace"))) % 0x7FFFFFFF or 1
        return cls(labels, parents, own), place

    def packed(self) -> str:
        return json.dumps([self.labels, self.parents, self.own])

    @classmethod
    def unpacked(cls, text: str) -> Tree:
        return cls(*json.loads(text))


#: Weight of a matched node; an equal text weighs 1, so it only decides between matchings of one size.
NODE = 1 << 20
#: Pairs of children from which on equal structure at both ends is matched at once. A largest matching always has those pairs (any other partner
#: of either could be exchanged for it), so its size is the same; only which of several largest ones is taken, by equal texts, may differ.
LONG_LISTS = 250_000


def match(a: Tree | Node, b: Tree | Node) -> tuple[int, dict[int, int]]:
    """Simple tree matching: size of the largest matching that keeps labels, order and parents, and the node of a for each matched node of b; of equally large ones one with more equal texts."""
    a, b = (Tree.of(x)[0] if isinstance(x, Node) else x for x in (a, b))
    memo: dict[tuple[int, int], int] = {}
    numbers: dict[tuple, int] = {}
    shape_a, shape_b = a.shapes(numbers), b.shapes(numbers)

    def weight(i: int, j: int) -> int:
        if a.labels[i] != b.labels[j]:
            return 0
        if shape_a[i] == shape_b[j]:
            return a.size[i] * NODE
        key = shape_a[i], shape_b[j]
        if key not in memo:
            memo[key] = NODE + align(a.kids[i], b.kids[j])[0]
        return memo[key]

    def align(x: list[int], y: list[int]) -> tuple[int, list[tuple[int, int]]]:
        """Children in order: equal ends first (of long lists those of equal structure, too), dynamic programming between them."""
        pairs: list[tuple[int, int]] = []
        for same in (lambda i, j: shape_a[i] == shape_b[j] and a.text[i] == b.text[j], lambda i, j: shape_a[i] == shape_b[j]):
            lo = 0
            while lo < min(len(x), len(y)) and same(x[lo], y[lo]):
                lo += 1
            hi = 0
            while hi < min(len(x), len(y)) - lo and same(x[-1 - hi], y[-1 - hi]):
                hi += 1
            pairs += [*zip(x[:lo], y[:lo], strict=True), *zip(x[len(x) - hi :], y[len(y) - hi :], strict=True)]
            x, y = x[lo : len(x) - hi], y[lo : len(y) - hi]
            if len(x) * len(y) < LONG_LISTS:
                break
        total = sum(a.size[i] * NODE + (a.text[i] == b.text[j] != 0) for i, j in pairs)
        if not x or not y:
            return total, pairs
        kinds = {shape_a[i] for i in x} | {shape_b[j] for j in y}
        if len(kinds) == 1 and not {a.text[i] for i in x} & {b.text[j] for j in y} - {0}:  # as paragraphs of different texts: the first ones match
            n = min(len(x), len(y))
            return total + n * a.size[x[0]] * NODE, [*pairs, *zip(x[:n], y[:n], strict=True)]
        if len(x) * len(y) <= 900:
            table = [[0] * (len(y) + 1)]
            for i in x:
                last, row, t = table[-1], [0], a.text[i]
                for n, j in enumerate(y):
                    v = weight(i, j)
                    v = last[n] + v + (t == b.text[j] != 0) if v else 0
                    row.append(max(last[n + 1], row[n], v))
                table.append(row)
            return total + table[-1][-1], [*pairs, *traced(table, x, y)]
        # one weight for each pair of different subtrees
        xs, xi = np.unique([shape_a[i] for i in x], return_inverse=True)
        ys, yi = np.unique([shape_b[j] for j in y], return_inverse=True)
        of_x, of_y = dict(zip(xi.tolist(), x, strict=True)), dict(zip(yi.tolist(), y, strict=True))
        w = np.array([[weight(of_x[i], of_y[j]) for j in range(len(ys))] for i in range(len(xs))], np.int64)[:, yi]
        text = np.array([b.text[j] for j in y])
        best = np.zeros((len(x) + 1, len(y) + 1), np.int64)
        for i in range(len(x)):
            row = w[xi[i]]
            if t := a.text[x[i]]:
                row = row + ((text == t) & (row > 0))
            best[i + 1, 1:] = np.maximum.accumulate(np.maximum(best[i, 1:], np.where(row > 0, best[i, :-1] + row, 0)))
        return total + int(best[-1, -1]), [*pairs, *traced(best, x, y)]

    def traced(best, x, y):
        i, j = len(x), len(y)
        while i and j:
            if best[i][j] == best[i - 1][j]:
                i -= 1
            elif best[i][j] == best[i][j - 1]:
                j -= 1
            else:
                i, j = i - 1, j - 1
                yield x[i], y[j]

    found: dict[int, int] = {}
    if a.labels[0] != b.labels[0]:
        return 0, found
    todo = [(0, 0)]
    while todo:
        i, j = todo.pop()
        found[j] = i
        if shape_a[i] == shape_b[j]:
            todo += zip(a.kids[i], b.kids[j], strict=True)
        else:
            todo += align(a.kids[i], b.kids[j])[1]
    return len(found), found


def aligned(top: Node, blocks: list[tuple[Node, str]], reference: Tree, made: tuple | None = None) -> list[tuple[int, int] | None]:
    """For each block the reference node that it is matched with (doubled, odd for prose inside an article or main) and a hash of its text; None where there is none."""
    tree, place = made or Tree.of(top, blocks)
    _, found = match(reference, tree)
    out: list[tuple[int, int] | None] = []
    for node, text in blocks:
        at = found.get(place.get(id(node), -1)) if not node.skip else None
        out.append(None if at is None else (2 * at + strict(node), _hash(text)))
    return out


def extract(page: str | None, wrappers: list[tuple[Tree, frozenset]] = ()) -> str:
    """Main text of a page, given its wrappers: reference trees and their template, pairs of node and text."""
    if not page:
        return ""
    top, blocks = parse(page)
    return chosen_text(blocks, gone(top, blocks, wrappers))


def gone(top: Node, blocks: list[tuple[Node, str]], wrappers) -> set[int]:
    """Numbers of the blocks that are template."""
    out: set[int] = set()
    done: dict[int, list] = {}
    made = None
    for reference, template in wrappers:
        if template:
            made = made or Tree.of(top, blocks)
            if id(reference) not in done:
                done[id(reference)] = aligned(top, blocks, reference, made)
            out |= {n for n, x in enumerate(done[id(reference)]) if x in template}
    return out


def chosen_text(blocks: list[tuple[Node, str]], template: set[int] = frozenset()) -> str:
    """Main text of a page's blocks: of its heaviest article or main, and those beside it under the same parent with the same tag."""
    weight: dict[int, int] = {}
    parent: dict[int, tuple] = {}
    open_ = 0
    for node, text in blocks:
        if not node.skip:
            open_ += len(text)
            if node.root is not None:
                weight[id(node.root)] = weight.get(id(node.root), 0) + len(text)
                parent[id(node.root)] = id(node.root.parent), node.root.tag
    chosen = max(weight, key=weight.get) if weight else None
    beside = {x for x in parent if parent[x] == parent[chosen]} if chosen is not None else set()
    if sum(weight[x] for x in beside) * 5 < open_:
        beside = set()
    return "\n".join(text for n, (node, text) in enumerate(blocks) if not node.skip and (not beside or id(node.root) in beside) and n not in template)


def host(url: str | None) -> str | None:
    try:
        return (urlsplit(url).hostname or None) if url else None
    except ValueError:
        return None


#: Groups of a host's pages: all of them, aligned with the tree of its most frequent layout, and those of one layout.
WHOLE = 0
_SITE = "site long, grp long"


def _layouts(batches):
    """Of each page with a host: hashes of host, text and layout; the tree of the page with the least hash of each layout of a task."""
    schema = pa.schema([("site", pa.int64()), ("body", pa.int64()), ("grp", pa.int64()), ("tree", pa.string())])
    least: dict[tuple[int, int], int] = {}
    for batch in batches:
        rows = []
        for url, page in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            if (h := host(url)) and page:
                top, blocks = parse(page)
                site, body, grp = _hash(h), _body(blocks), layout(blocks)
                new = body < least.get((site, grp), 1 << 63)
                if new:
                    least[site, grp] = body
                rows.append((site, body, grp, Tree.of(top, blocks)[0].packed() if new else None))
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)


def _body(blocks: list[tuple[Node, str]]) -> int:
    return _hash("\n".join(text for node, text in blocks if not node.skip))


def references(pages: DataFrame) -> DataFrame:
    """Of pages(url, html): site, grp, tree: a reference tree for each layout of LEAST different pages or more, and WHOLE for the most frequent one of a host."""
    facts = written(texts(pages, "url", "html").mapInArrow(_layouts, "site long, body long, grp long, tree string"))
    once = facts.groupBy("site", "grp", "body").agg(F.lit(1).alias("one")).groupBy("site", "grp").agg(F.count("*").alias("n"))
    trees = facts.where("tree is not null").groupBy("site", "grp").agg(F.min_by("tree", "body").alias("tree"))
    known = written(once.join(trees, ["site", "grp"]))
    enough = known.groupBy("site").agg(F.sum("n").alias("pages")).where(F.col("pages") >= LEAST).select("site")
    main = known.join(enough, "site").groupBy("site").agg(F.max_by("tree", F.struct("n", "grp")).alias("tree")).select("site", F.lit(WHOLE).cast("long").alias("grp"), "tree")
    return main.unionByName(known.where(F.col("n") >= LEAST).select("site", "grp", "tree"))


def _nodes(find):
    """Of each page with a host and a reference: site, hash of its text, and for each group the matched nodes and hashes of their texts (packed, once each)."""
    schema = pa.schema([("site", pa.int64()), ("body", pa.int64()), ("grp", pa.int64()), ("nodes", pa.binary())])

    def run(batches):
        for batch in batches:
            rows = []
            for url, page, *given in zip(*(batch.column(i).to_pylist() for i in range(batch.num_columns)), strict=True):
                if (h := host(url)) and page:
                    top, blocks = parse(page)
                    site, done = _hash(h), {}
                    made, body = Tree.of(top, blocks), _body(blocks)
                    for grp, tree in find(site, blocks, *given):
                        if id(tree) not in done:  # the page's layout may be the host's most frequent one
                            done[id(tree)] = np.array(sorted({x for x in aligned(top, blocks, tree, made) if x is not None}), np.int64).tobytes()
                        rows.append((site, body, grp, done[id(tree)]))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

    return run


def _places(batches):
    """Rows of (site, group, node, text) of each page; the text is null once for each node and once, with node -1, for the page."""
    for batch in batches:
        rows = []
        for site, grp, packed in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
            nodes = np.frombuffer(packed, np.int64).reshape(-1, 2)
            spots = np.append(np.unique(nodes[:, 0]), -1)
            n = len(nodes) + len(spots)
            rows.append((np.full(n, site, np.int64), np.full(n, grp, np.int64), np.concatenate((nodes[:, 0], spots)), np.concatenate((nodes[:, 1], spots)), np.arange(n) >= len(nodes)))
        if rows:
            site, grp, node, text, none = (np.concatenate(x) for x in zip(*rows, strict=True))
            yield pa.RecordBatch.from_arrays([pa.array(site), pa.array(grp), pa.array(node), pa.array(text, mask=none)], names=["site", "grp", "node", "text"])


def wrappers(nodes: DataFrame) -> DataFrame:
    """Of aligned pages(site, body, grp, nodes): site, grp, keys (flat pairs of node and text that are template), counted over all different pages."""
    once = nodes.groupBy("site", "grp", "body").agg(F.min("nodes").alias("nodes")).select("site", "grp", "nodes")
    counts = written(once.mapInArrow(_places, f"{_SITE}, node long, text long").groupBy("site", "grp", "node", "text").agg(F.count("*").alias("n")))
    of = counts.where("text is null and node >= 0").where(F.col("n") >= LEAST).select("site", "grp", "node", F.col("n").alias("pages"))
    whole = counts.where("node = -1").select("site", "grp", F.col("n").alias("whole"))
    # a text of fewer pages can't be enough for LEAST
    often = counts.where("text is not null").where(F.col("n") >= math.ceil(CONSTANT * LEAST - 1e-9))
    same = often.join(of, ["site", "grp", "node"]).join(whole, ["site", "grp"]).where(F.col("n") >= F.when(F.expr("node & 1 = 1"), CONSTANT_PROSE * F.col("whole")).otherwise(CONSTANT * F.col("pages")) - 1e-9)
    return same.groupBy("site", "grp").agg(F.flatten(F.array_sort(F.collect_list(F.array("node", "text")))).alias("keys"))


def _template(keys) -> frozenset:
    return frozenset(zip(keys[::2], keys[1::2], strict=True)) if keys else frozenset()


def main_text(pages: DataFrame, *, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """Of pages(page_id, url, html): page_id, url, text."""
    base = texts(pages, "page_id", "url", "html")
    trees = written(references(pages))
    if (trees.agg(F.sum(F.octet_length("tree") + 16)).first()[0] or 0) > broadcast_bytes:
        return _joined(base, trees)
    known = pages.sparkSession.sparkContext.broadcast({(r.site, r.grp): r.tree for r in trees.collect()})
    made: dict[str, Tree] = {}

    def tree(key):
        text = known.value[key]
        if text not in made:
            if len(made) > 2000:
                made.clear()
            made[text] = Tree.unpacked(text)
        return made[text]

    def find(site, blocks):
        return [(grp, tree((site, grp))) for grp in (WHOLE, layout(blocks)) if (site, grp) in known.value]

    found = written(wrappers(texts(pages, "url", "html").mapInArrow(_nodes(find), f"site long, body long, grp long, nodes binary")))
    if (found.agg(F.sum(8 * F.size("keys") + 16)).first()[0] or 0) > broadcast_bytes:
        return _joined(base, trees)
    table = pages.sparkSession.sparkContext.broadcast({(r.site, r.grp): _template(r["keys"]) for r in found.collect()})

    def text(url, page):
        if not page:
            return ""
        top, blocks = parse(page)
        h = host(url)
        return chosen_text(blocks, gone(top, blocks, [(tree((s, g)), table.value[s, g]) for s in [_hash(h)] for g in (WHOLE, layout(blocks)) if (s, g) in table.value]) if h else frozenset())

    def direct(batches):
        for batch in batches:
            yield _out(batch, [text(u, p) for u, p in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)])

    return base.mapInArrow(direct, _OUT)


_OUT = "page_id long, url string, text string"


def _out(batch, found):
    return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(found, pa.string())], names=["page_id", "url", "text"])


def _joined(base: DataFrame, trees: DataFrame) -> DataFrame:
    """The same with references and templates joined to the pages by host and layout."""

    def named(batches):
        for batch in batches:
            s = [_hash(h) if (h := host(u)) else None for u in batch.column(1).to_pylist()]
            g = [layout(parse(p)[1]) if p and x is not None else None for x, p in zip(s, batch.column(2).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(s, pa.int64()), pa.array(g, pa.int64())], names=["page_id", "url", "html", "site", "grp"])

    rows = base.mapInArrow(named, f"page_id long, url string, html string, {_SITE}")

    def given(df, of, value):
        whole = of.where(F.col("grp") == WHOLE).select("site", F.col(value).alias(f"{value}_all"))
        return df.join(whole, "site", "left").join(of.select("site", "grp", value), ["site", "grp"], "left")

    def find(site, blocks, all_, own):
        return [(g, Tree.unpacked(x)) for g, x in ((WHOLE, all_), (layout(blocks), own)) if x]

    with_trees = given(rows, trees, "tree")
    found = written(wrappers(with_trees.select("url", "html", "tree_all", "tree").mapInArrow(_nodes(find), "site long, body long, grp long, nodes binary")))

    def joined(batches):
        for batch in batches:
            yield _out(batch, [extract(p, [(Tree.unpacked(t), _template(k)) for t, k in ((a, ka), (b, kb)) if t and k]) for p, a, b, ka, kb in zip(*(batch.column(i).to_pylist() for i in range(2, 7)), strict=True)])

    whole = given(with_trees, found, "keys")
    return whole.select("page_id", "url", "html", "tree_all", "tree", "keys_all", "keys").mapInArrow(joined, _OUT)
