"""Main text of web pages by wrapper induction.

Pages of one host are parsed to trees of their block elements; neighbours with
one label become one repeated node. Simple tree matching aligns the trees of a
host one after another into its template, whose nodes count the pages that have
them and keep their frequent texts. A text that is constant over nearly all of a
host's pages at its place is template; what varies is content.

The template decides where the article is: at the page's article elements, all
of them, or at its main element, unless the innermost template node with most of
the host's varying text is elsewhere and holds more of the page. Without such
elements that node is the article, less its constant texts. Elements whose tag,
role or name says plainly that they are menus, headers, footers, sidebars,
notices, adverts, forms, comments and the like are no part of it; where an
element's name only hints at that, the template decides, and it goes if its
texts are constant. Headings inside an article stay.
"""

from __future__ import annotations

import html
import json
import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .staging import Stage

#: A text is constant if this share of a host's pages, and two at least, have it in its place.
CONSTANT = 0.9
#: A template of more nodes is rid of those that less than this share of its pages have.
MOST_NODES = 5000
RARE = 0.01
#: Children are matched optimally; so many pairs of them are held at once, and longer lists are worked through in so many parts.
MOST_PAIRS = 200_000
CUTS = 16
#: Sizes of matches that are kept, others are worked out again.
HELD_SIZES = 1_000_000
#: Frequent texts kept per node: those of more than 1 / (TEXTS + 1) of its texts are surely among them.
TEXTS = 64
#: Templates are broadcast up to so many bytes in all, and joined to their pages beyond.
BROADCAST_BYTES = 32 << 20
FAN_IN = 32
HELD_HOSTS = 2000
#: Elements nested deeper than this become part of the one at this depth; their text stays.
DEPTH = 128

_TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']|"[^"]*"|'[^']*')*)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>|<[a-zA-Z/][^>]*\Z|[^<]+|<""", re.S)
_ATTRIBUTE = re.compile(r"""\b(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_RAW = {t: re.compile(rf"</{t}\s*>", re.I) for t in ("script", "style", "textarea", "title", "noscript", "template", "svg", "iframe")}
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q s samp small span strike strong sub sup time tt u var".split())
_CLOSES_P = frozenset("address article aside blockquote details div dl dt dd fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr li main nav ol p pre section table tbody td tfoot th thead tr ul".split())
_SAME = {"li": "li", "tr": "tr", "td": "td th", "th": "td th", "dt": "dt dd", "dd": "dt dd", "option": "option"}
_SCOPE = frozenset("ul ol table tr dl select body".split())
_NOT_TEXT = frozenset("nav footer aside form head script style noscript template iframe svg button select textarea menu dialog object".split())
_NOT_ROLE = frozenset("navigation banner contentinfo complementary search form dialog alert menu menubar".split())
#: Words of names. An element is out if its name has one of the first kind and otherwise only words of the second kind or numbers.
_NOT_CLASS = frozenset(
    "ad ads advert adverts advertisement adslot banner breadcrumb breadcrumbs comment comments cookie cookies consent disclaimer disqus footer header masthead menu modal nav navbar navigation newsletter notice notices "
    "pagination pager popup promo promotion related respond replies reply share sharing sidebar social sponsor sponsored subscribe toolbar topbar widget".split()
)
_GENERIC = frozenset(
    "area bar block blog body bottom box btn button buttons center col column container content count desktop entry form global group head holder icon icons inner item items left link links list main message mobile "
    "outer page panel post posts primary right row secondary section signup site slot stories tools top unit wrap wrapper".split()
)
#: Words that inside an article may as well name its own parts.
_OF_ARTICLE = frozenset("header banner masthead".split())


class Node:
    """An element: ``out`` is no content by itself or what is above it; ``hint`` may be none, which the template decides."""

    __slots__ = ("tag", "label", "out", "hint", "inside", "children", "blocks", "chars")

    def __init__(self, tag: str, label: str, out: bool, hint: bool = False, inside: bool = False):
        self.tag, self.label, self.out, self.hint, self.inside = tag, label, out, hint, inside
        self.children: list[Node] = []
        self.blocks: list[int] = []
        self.chars = 0


@lru_cache(10_000)
def _says(name: str) -> tuple[bool, bool, bool]:
    """Whether a name says that its element is no content, whether only such as an article has too, and whether it hints at it."""
    parts = [p for p in re.split(r"[-_]+", name) if p and not p[0].isdigit()]
    named = [p for p in parts if p in _NOT_CLASS]
    plain = bool(named) and all(p in _NOT_CLASS or p in _GENERIC for p in parts)
    return plain, plain and all(p in _OF_ARTICLE for p in named), bool(named) and not plain


def _made(tag: str, attributes: str, above: Node) -> Node:
    names = {k.lower(): (a or b or c).lower() for k, a, b, c in _ATTRIBUTE.findall(attributes)} if attributes and "=" in attributes else {}
    words = [w for k in ("class", "id") if k in names for w in names[k].split()]
    said = [_says(w) for w in words]
    if tag in ("article", "main", "body"):
        said = [x for w, x in zip(words, said, strict=True) if w in ("comment", "comments", "reply", "replies", "related", "ad", "ads")]
    out, hint = above.out or tag in _NOT_TEXT or names.get("role") in _NOT_ROLE, above.hint and tag not in ("article", "main")
    for plain, own, maybe in said:
        if plain and not (own and above.inside):
            out = True
        elif plain or maybe:
            hint = True
    if tag == "header":
        out, hint = out or not above.inside, hint or above.inside
    if names.get("role") == "main":
        tag = "main"
    return Node(tag, ".".join([tag, *sorted(set(words))]), out, hint, above.inside or tag in ("article", "main"))


def parse(page: str) -> tuple[Node, list[tuple[str, Node]]]:
    """The tree of block elements and the page's blocks of text, in order, each with its element."""
    root = Node("html", "html", False)
    stack, blocks, words, deep = [root], [], [], Counter()

    def flush() -> None:
        if words:
            raw = "".join(words)
            text = " ".join((html.unescape(raw) if "&" in raw else raw).split())
            words.clear()
            if text:
                own = stack[-1]
                own.blocks.append(len(blocks))
                own.chars += len(text)
                blocks.append((text, own))

    def close(tags: list[str], stop: frozenset = frozenset()) -> None:
        for i in range(len(stack) - 1, 0, -1):
            if stack[i].tag in tags:
                flush()
                del stack[i:]
                return
            if stack[i].tag in stop:
                return

    at, size = 0, len(page)
    while at < size:
        m = _TOKEN.match(page, at)
        at = m.end()
        piece = m[0]
        if piece[0] != "<" or piece == "<":
            words.append(piece)
            continue
        tag = m[2] or m[5]
        if not tag:
            continue
        tag, ends = tag.lower(), bool(m[1] or m[4])
        if tag == "br":
            words.append(" ")
        elif tag in _INLINE:
            continue
        elif ends:
            flush()
            if deep[tag]:
                deep[tag] -= 1
            else:
                close([tag])
        elif tag in _RAW:
            end = _RAW[tag].search(page, at)
            at = end.end() if end else size
        else:
            flush()
            if tag == "html" or (tag == "body" and any(n.tag == "body" for n in stack)):
                continue
            if tag in _CLOSES_P:
                close(["p"], _SCOPE)
            if tag in _SAME:
                close(_SAME[tag].split(), _SCOPE - {tag})
            if tag in _VOID:
                continue
            node = _made(tag, m[3] or m[6] or "", stack[-1])
            if len(stack) >= DEPTH and node.out == stack[-1].out:
                deep[tag] += 1
                continue
            stack[-1].children.append(node)
            stack.append(node)
    flush()
    return root, blocks


def _mark(text: str) -> str:
    return blake2b(text.encode("utf-8", "surrogatepass"), digest_size=6).hexdigest()


def folded(node: Node, blocks: list[tuple[str, Node]], places: dict[int, list[int]] | None = None) -> list:
    """[label, pages, characters, {text: pages}, children] of a page's tree, repeated neighbours as one.

    ``places`` gets the numbers of each folded node's own blocks, by its identity.
    """

    def fold(group: list[Node]) -> list:
        texts: dict[str, int] = {}
        chars, children, run = 0, [], []
        for n in group:
            for i in n.blocks:
                texts[_mark(blocks[i][0])] = 1
            chars += n.chars
        for child in (c for n in group for c in n.children):
            if run and run[0].label != child.label:
                children.append(fold(run))
                run = []
            run.append(child)
        if run:
            children.append(fold(run))
        out = [group[0].label, 1, chars, texts, children]
        if places is not None:
            places[id(out)] = [i for n in group for i in n.blocks]
        return out

    return fold([node])


class _Shapes:
    """Trees numbered by their shape, and the sizes of the best matches of two."""

    def __init__(self):
        self.numbers: dict[tuple, int] = {}
        self.of: dict[int, int] = {}
        self.labels: list[str] = []
        self.children: list[list[int]] = []
        self.nodes: list[int] = []
        self.sizes: dict[tuple[int, int], int] = {}

    def number(self, t: list) -> int:
        found = self.of.get(id(t))
        if found is None:
            children = [self.number(c) for c in t[4]]
            found = self.numbers.setdefault((t[0], *children), len(self.labels))
            if found == len(self.labels):
                self.labels.append(t[0])
                self.children.append(children)
                self.nodes.append(1 + sum([self.nodes[c] for c in children]))
            self.of[id(t)] = found
        return found

    def size(self, a: int, b: int) -> int:
        """Nodes of the best match of two shapes."""
        if a == b:
            return self.nodes[a]
        if self.labels[a] != self.labels[b]:
            return 0
        out = self.sizes.get((a, b))
        if out is None:
            x, y = self.children[a], self.children[b]
            p, q = [self.labels[c] for c in x], [self.labels[c] for c in y]
            if p == q:
                out = 1 + sum([self.size(i, j) for i, j in zip(x, y, strict=True)])
            else:
                both = set(p) & set(q)
                out = 1 + self.aligned([c for c, k in zip(x, p, strict=True) if k in both], [c for c, k in zip(y, q, strict=True) if k in both], None)
            if len(self.sizes) >= HELD_SIZES:
                self.sizes.clear()
            self.sizes[a, b] = out
        return out

    def aligned(self, x: list[int], y: list[int], pairs: list[tuple[int, int]] | None) -> int:
        """Size of the best order-keeping match of two lists of shapes; ``pairs`` gets its pairs in order.

        Row i of a table has, for each j, the size of the best match of the first
        i and the first j. The way back through it needs all rows: those at cuts
        are kept, and those between two cuts worked out again.
        """
        # Equal shapes at the start: no other partners are better.
        start, least = 0, min(len(x), len(y))
        while start < least and x[start] == y[start]:
            start += 1
        same = sum([self.nodes[c] for c in x[:start]])
        if pairs is not None:
            pairs += [(i, i) for i in range(start)]
        if start == least:
            return same
        x, y = x[start:], y[start:]
        places: dict[str, tuple[list[int], dict[int, int], list[int]]] = {}
        for j, c in enumerate(y):
            at, kinds, which = places.setdefault(self.labels[c], ([], {}, []))
            at.append(j)
            which.append(kinds.setdefault(c, len(kinds)))
        arrays = {k: (np.array(at), list(kinds), np.array(which)) for k, (at, kinds, which) in places.items()}
        held: dict[int, np.ndarray] = {}

        def below(row: np.ndarray, i: int) -> np.ndarray:
            if self.labels[x[i]] not in arrays:
                return row
            at, kinds, which = arrays[self.labels[x[i]]]
            sizes = held.get(x[i])
            if sizes is None:
                if len(held) * len(y) >= HELD_SIZES:
                    held.clear()
                sizes = held[x[i]] = np.array([self.size(x[i], c) for c in kinds], np.int32)
            if len(at) and at[-1] + 1 >= len(row):
                n = int(np.searchsorted(at, len(row) - 1))
                at, which = at[:n], which[:n]
            out = row.copy()
            out[at + 1] = np.maximum(row[at + 1], row[at] + sizes[which])
            return np.maximum.accumulate(out)

        first = np.zeros(len(y) + 1, np.int32)
        if pairs is None:
            for i in range(len(x)):
                first = below(first, i)
            return same + int(first[-1])
        back: list[tuple[int, int]] = []

        def way(lo: int, hi: int, row: np.ndarray, j: int) -> int:
            """Goes back from row ``hi`` and ``j`` to row ``lo``, which is given; the j there."""
            row = row[: j + 1]
            rows, n = [row], hi - lo
            if n * (j + 1) <= MOST_PAIRS or n == 1:
                for i in range(lo, hi):
                    rows.append(below(rows[-1], i))
                for i in range(hi, lo, -1):
                    above, own = rows[i - 1 - lo], rows[i - lo]
                    if own[j] != above[j]:
                        j = int(np.searchsorted(own, own[j])) - 1
                        back.append((start + i - 1, start + j))
                return j
            cuts = [lo + n * k // min(n, CUTS) for k in range(min(n, CUTS) + 1)]
            for i in range(lo, cuts[-2]):
                row = below(row, i)
                if i + 1 == cuts[len(rows)]:
                    rows.append(row)
            for k in range(len(rows) - 1, -1, -1):
                j = way(cuts[k], cuts[k + 1], rows.pop(), j)
            return j

        way(0, len(x), first, len(y))
        pairs += back[::-1]
        return same + sum([self.size(x[i - start], y[j - start]) for i, j in back])


def paired(a: list, b: list, memo: dict) -> list[tuple[int, int]]:
    """The pairs of the children of two trees of one label in their best order-keeping match.

    Lists of the same labels are paired one by one. ``memo`` is of one pair of
    trees, none of whose nodes may have changed that are still to be paired.
    """
    p, q = [c[0] for c in a[4]], [c[0] for c in b[4]]
    if p == q:
        return [(i, i) for i in range(len(p))]
    both = set(p) & set(q)
    if not both:
        return []
    shapes = memo.setdefault("shapes", _Shapes())
    x, y = ([i for i, k in enumerate(labels) if k in both] for labels in (p, q))
    pairs: list[tuple[int, int]] = []
    shapes.aligned([shapes.number(a[4][i]) for i in x], [shapes.number(b[4][j]) for j in y], pairs)
    return [(x[i], y[j]) for i, j in pairs]


def match(a: list, b: list, memo: dict) -> tuple[int, list[tuple[int, int]]]:
    """Simple tree matching: size of the best order-keeping match of two trees, and the children's pairs."""
    if a[0] != b[0]:
        return 0, []
    shapes = memo.setdefault("shapes", _Shapes())
    pairs = paired(a, b, memo)
    return 1 + sum([shapes.size(shapes.number(a[4][i]), shapes.number(b[4][j])) for i, j in pairs]), pairs


def _add_texts(into: dict[str, int], more: dict[str, int]) -> None:
    """Adds counts and keeps the TEXTS largest, less what the next one has: each stays a lower bound."""
    for t, c in more.items():
        into[t] = into.get(t, 0) + c
    if len(into) > TEXTS:
        least = sorted(into.values(), reverse=True)[TEXTS]
        for t in [t for t, c in into.items() if c <= least]:
            del into[t]
        for t in into:
            into[t] -= least


def merge(a: list, b: list, memo: dict | None = None) -> None:
    """Adds tree or template ``b`` to template ``a``; what has no partner is put in at its place."""
    memo = {} if memo is None else memo
    pairs = paired(a, b, memo)
    a[1] += b[1]
    a[2] += b[2]
    _add_texts(a[3], b[3])
    children, last = [], 0
    partner = {j: i for i, j in pairs}
    for j, q in enumerate(b[4]):
        if j in partner:
            i = partner[j]
            children += a[4][last : i + 1]
            last = i + 1
            merge(a[4][i], q, memo)
        else:
            children.append(q)
    a[4] = children + a[4][last:]


def nodes_in(t: list) -> int:
    return 1 + sum(map(nodes_in, t[4]))


def trimmed(t: list, least: float) -> None:
    """Takes out the nodes that fewer pages have; their text counts as varying text of the node above."""
    kept = []
    for c in t[4]:
        if c[1] < least:
            t[2] += _mass(c)
        else:
            trimmed(c, least)
            kept.append(c)
    t[4] = kept


def _mass(t: list) -> int:
    return t[2] + sum(map(_mass, t[4]))


def merged(a: list, b: list) -> None:
    """``merge``, and a bound: a template of many nodes keeps those that a share of its pages have."""
    merge(a, b)
    if len(a) < 6:
        a.append(0)
    a[5] += 1
    # Counted now and then only, since counting walks the template.
    if a[5] % 16 == 0 and nodes_in(a) > MOST_NODES:
        trimmed(a, RARE * a[1])


def _own_host() -> object:
    return F.coalesce(F.lower(F.regexp_extract(F.col("url"), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1)), F.lit(""))


def _induced(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per task: a template of each host from the pages that the task reads."""
    from pyspark import TaskContext

    part = TaskContext.get().partitionId()
    held: dict[str, list] = {}

    def flush() -> pa.RecordBatch:
        out = pa.RecordBatch.from_arrays([pa.array(list(held), pa.string()), pa.array([part] * len(held), pa.int64()), pa.array([json.dumps(t) for t in held.values()], pa.string())], ["host", "part", "template"])
        held.clear()
        return out

    for batch in batches:
        for host, page in zip(batch.column("host").to_pylist(), batch.column("html").to_pylist(), strict=True):
            tree = folded(*parse(page or ""))
            if host in held:
                merged(held[host], tree)
            else:
                held[host] = tree
            if len(held) > HELD_HOSTS:
                yield flush()
    yield flush()


def _merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by (host, part): one template of each."""
    last, tree = None, None

    def row() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([last[0]]), pa.array([last[1]], pa.int64()), pa.array([json.dumps(tree)])], ["host", "part", "template"])

    for batch in batches:
        for key in zip(*(batch.column(c).to_pylist() for c in ("host", "part", "template")), strict=True):
            if key[:2] == last:
                merged(tree, json.loads(key[2]))
            else:
                if tree is not None:
                    yield row()
                last, tree = key[:2], json.loads(key[2])
    if tree is not None:
        yield row()


def induce(pages: DataFrame, stage: Stage) -> DataFrame:
    """(host, template) of (host, html) rows; templates of tasks are merged FAN_IN at a time."""
    kinds = "host string, part long, template string"
    out = stage.write(pages.select("host", "html").mapInArrow(_induced, kinds), "templates")
    most = out.agg(F.max("part")).first()[0] or 0
    n = int(pages.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    first = True
    while first or most > 0:
        rows = out.withColumn("part", F.floor(F.col("part") / FAN_IN)).repartition(n, "host", "part").sortWithinPartitions("host", "part")
        out = stage.write(rows.mapInArrow(_merged, kinds), "templates")
        most, first = most // FAN_IN, False
    return out.select("host", "template")


def _steady(t: list, pages: int) -> bool:
    """Whether all texts that a node has are constant over its host's pages."""
    need = max(2.0, CONSTANT * pages)
    return bool(t[3]) and t[1] >= need and all(c >= need for c in t[3].values())


class Wrapper:
    """What a host's template says: the way to the node with most of the varying text, and what is constant."""

    def __init__(self, template: list):
        self.template, self.pages = template, template[1]
        self.need = max(2.0, CONSTANT * self.pages)
        varying: dict[int, int] = {}

        def weigh(t: list) -> int:
            varying[id(t)] = (0 if _steady(t, self.pages) else t[2]) + sum(weigh(c) for c in t[4])
            return varying[id(t)]

        total, node = max(1, weigh(template)), template
        self.path = [template[0]]
        while True:
            inner = [c for c in node[4] if _content_label(c[0])]
            best = max(inner, key=lambda c: varying[id(c)], default=None)
            if best is None or best[0].split(".")[0] in ("p", "li", "h1", "h2") or varying[id(best)] < 0.6 * total:
                break
            self.path.append(best[0])
            node = best

        def any_in(t: list) -> bool:
            return any(c >= self.need for c in t[3].values()) or any(map(any_in, t[4]))

        self.any_constant = any_in(template)

    def region(self, root: Node) -> Node:
        """The innermost element of a page along the way to the varying text."""
        at = root
        for label in self.path[1:]:
            inner = [c for c in at.children if c.label == label and not c.out]
            if len(inner) != 1:  # elements alike are one node of the template, which doesn't tell them apart
                break
            at = inner[0]
        return at

    def constant(self, root: Node, blocks: list[tuple[str, Node]]) -> set[int]:
        """Numbers of the blocks whose text is constant at their place in the template."""
        if not self.any_constant:
            return set()
        places: dict[int, list[int]] = {}
        tree, memo = folded(root, blocks, places), {}
        steady: set[int] = set()

        def walk(t: list, p: list) -> None:
            steady.update(i for i in places[id(p)] if t[3].get(_mark(blocks[i][0]), 0) >= self.need)
            for i, j in paired(t, p, memo):
                walk(t[4][i], p[4][j])

        walk(self.template, tree)
        return steady


def _content_label(label: str) -> bool:
    tag, *words = label.split(".")
    return tag not in _NOT_TEXT and not any(_says(w)[0] for w in words)


def _content_mass(n: Node) -> int:
    return 0 if n.out else n.chars + sum(map(_content_mass, n.children))


def _outermost(root: Node, tag: str) -> list[Node]:
    found, stack = [], [root]
    while stack:
        n = stack.pop()
        if n.out:
            continue
        if n.tag == tag:
            found.append(n)
        else:
            stack.extend(n.children)
    return found


def _regions(root: Node, wrapper: Wrapper | None) -> list[Node]:
    """The elements that hold the article."""
    articles, mains = _outermost(root, "article"), _outermost(root, "main")
    named, mass = articles, sum(map(_content_mass, articles))
    if mains and 2 * mass < sum(map(_content_mass, mains)):
        named, mass = mains, sum(map(_content_mass, mains))
    if wrapper is None or wrapper.pages < 2:
        return named if mass else [root]
    region = wrapper.region(root)
    # Most of what varies may be elsewhere, as where article elements are mere teasers.
    within = sum(_content_mass(n) for n in named if _holds(region, n))
    return named if mass and 2 * (mass - within) >= _content_mass(region) - 2 * within else [region]


def _holds(above: Node, node: Node) -> bool:
    stack = [above]
    while stack:
        n = stack.pop()
        if n is node:
            return True
        stack.extend(n.children)
    return False


def extract(page: str, wrapper: Wrapper | None) -> str:
    """The main text of a page, its blocks joined by an empty line."""
    root, blocks = parse(page)
    if not blocks:
        return ""
    regions = _regions(root, wrapper)
    inside: set[int] = set()
    stack = list(regions)
    while stack:
        n = stack.pop()
        if not n.out:
            inside.update(n.blocks)
            stack.extend(n.children)
    # An article element says itself what is content, but for parts whose names hint at something else.
    doubtful = {i for i in inside if blocks[i][1].hint or not blocks[i][1].inside}
    if wrapper is not None and doubtful:
        left = inside - (doubtful & wrapper.constant(root, blocks))
        inside = left or inside  # where nothing varies, pages are copies of one
    return "\n\n".join(blocks[i][0] for i in sorted(inside))


def _extracted(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = {h: Wrapper(json.loads(t)) for h, t in shared.value.items()} if shared is not None else {}
        for batch in batches:
            hosts = batch.column("host").to_pylist()
            if shared is None:
                for h, t in zip(hosts, batch.column("template").to_pylist(), strict=True):
                    if h not in known:
                        if len(known) >= HELD_HOSTS:
                            known.clear()
                        known[h] = Wrapper(json.loads(t)) if t is not None else None
            texts = [extract(p or "", known.get(h)) for h, p in zip(hosts, batch.column("html").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string())], ["page_id", "url", "text"])

    return run


def main_texts(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars) of every row of ``pages``.

    Null html is empty and gives empty text; a null or odd url counts as one
    host without name. Null ids and repeated rows come back as they are. A host
    of one page has no constant texts, nor has a page that has no others.
    """
    spark = pages.sparkSession
    stage = Stage(spark, "html")
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    rows = rows.withColumn("host", _own_host())
    templates = induce(rows, stage)
    size = templates.agg(F.coalesce(F.sum(F.octet_length("template") + F.octet_length("host")), F.lit(0))).first()[0]
    kinds = "page_id long, url string, text string"
    if size <= BROADCAST_BYTES:
        shared = spark.sparkContext.broadcast({r.host: r.template for r in templates.collect()})
        out = rows.mapInArrow(_extracted(shared), kinds)
    else:
        out = rows.join(templates, "host", "left").select("page_id", "url", "html", "host", "template").mapInArrow(_extracted(None), kinds)
    return out.withColumn("n_chars", F.length("text").cast("long"))
