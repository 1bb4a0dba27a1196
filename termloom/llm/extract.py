"""Main text of web pages by wrapper induction.

Pages of one host share templates. A page is read to a light tree in which siblings
that are like text blocks are one repeated node. The different trees of all pages of a
host are matched by simple tree matching, which gives its layouts; every page is then
aligned with the layout that it matches most, and what it shows at each place is summed
up. A place that shows the same text on every page is template, and the smallest element
with most of the varying text is the region of content, with whatever varies beside it
and reads as prose: an article's other parts. Records at the region's end, of a line and
a text each and as many as a page happens to have, are readers' remarks and no content.
Every page gets the regions of its layout, without places that show a template's text.
A form that holds articles or prose is none.
Roles that are never content (menus, forms, scripts, adverts and the like, by element,
role, or a name all of whose parts say so) are left out on any page, and alone serve
hosts with fewer than three different pages. Trees are walked on stacks, so pages may be
nested to any depth; alignment looks at the first DEPTH levels.

Defined cases: null or empty html gives an empty text; a null or odd url makes a
host of its own name; unclosed tags end with what holds them; repeated pages are
answered row by row; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import html as entities
import json
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, fields
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from termloom.llm.words import held, slices
from termloom.session import ship, written

#: Classes in which the different trees of a host are matched first; only their layouts then meet.
CLASSES = 16
#: Places, or trees, that a task sums up before it sends them on.
HELD = 50_000

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)(?:>|\Z)|<|[^<]+", re.S)
_ATTRIBUTE = re.compile(r"(?:^|\s)(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_SPACE = re.compile(r"\s+")
#: Elements by the HTML standard's content models.
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
_INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q s samp small span strike "
    "strong sub sup time tt u var wbr".split()
)
_CLOSES_P = frozenset(
    "address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header "
    "hr main menu nav ol p pre section table ul".split()
)
#: Elements, roles and name parts that are not an article's text.
_NEVER = frozenset(
    "head script style noscript template nav aside footer form button select option textarea iframe svg canvas object "
    "embed audio video dialog menu title input label".split()
)
_NEVER_ROLE = frozenset("navigation banner complementary contentinfo search form menu menubar dialog alert".split())
_NEVER_WORD = frozenset(
    "ad ads advert adverts advertisement banner sponsor sponsored promo promotion sidebar menu nav navbar navigation breadcrumb "
    "breadcrumbs footer masthead comment comments disqus replies cookie cookies consent gdpr notice popup modal newsletter "
    "subscribe signup share sharing social related recommended widget toolbar pagination pager skip".split()
)
#: Words that say where or how such a part stands, not what it is.
_PLACE_WORD = frozenset(
    "area articles bar block bottom box button buttons container form header inner item items left link links list main outer "
    "page panel post posts right section side site slot thread top unit wrap wrapper".split()
)


def never_name(name: str) -> bool:
    """Whether one of a node's names says in all its parts that it is no article text."""
    for token in name.lower().split():
        parts = [p for p in re.split(r"[-_\d]+", token) if p]
        if any(p in _NEVER_WORD for p in parts) and all(p in _NEVER_WORD or p in _PLACE_WORD for p in parts):
            return True
        if token in ("site-header", "page-header", "side-bar"):
            return True
    return False


_HEADING = frozenset("h1 h2 h3 h4 h5 h6".split())


class Node:
    __slots__ = ("tag", "label", "children", "text", "never")

    def __init__(self, tag: str, label: str, never: bool):
        self.tag, self.label, self.never = tag, label, never
        self.children: list[Node] = []
        self.text: list = []  # strings and nodes, in page order


def parse(page: str | None) -> Node:
    """A tree of a page; forgiving, in one pass, whatever its size."""
    root = Node("#root", "#root", False)
    forms: list[Node] = []
    stack, raw, at, page = [root], "", 0, page or ""
    size = len(page)
    while at < size:
        if raw:
            m = re.compile(rf"</{raw}\s*>", re.I).search(page, at)
            end = m.start() if m else size
            if raw == "textarea":
                pass
            at, raw = (m.end() if m else size), ""
            if len(stack) > 1:
                stack.pop()
            continue
        m = _TOKEN.match(page, at)
        at = m.end()
        tag = m[2]
        if tag is None:
            if m[0][:2] not in ("<!", "<?"):
                stack[-1].text.append(m[0])
            continue
        tag = tag.lower()
        if m[1]:
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].tag == tag:
                    del stack[k:]
                    break
                if tag in _INLINE and stack[k].tag not in _INLINE:
                    break
            continue
        if tag in _CLOSES_P:
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].tag == "p":
                    del stack[k:]
                    break
                if stack[k].tag not in _INLINE:
                    break
        elif tag in ("li", "option", "tr", "td", "th", "dt", "dd"):
            same = {"dt": ("dt", "dd"), "dd": ("dt", "dd"), "td": ("td", "th"), "th": ("td", "th")}.get(tag, (tag,))
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].tag in same:
                    del stack[k:]
                    break
                if stack[k].tag in ("ul", "ol", "dl", "table", "select", "tbody", "thead", "div", "article"):
                    break
        names, role = [], ""
        if m[3]:
            for a in _ATTRIBUTE.finditer(m[3]):
                value = a[2] or a[3] or a[4] or ""
                if a[1].lower() == "role":
                    role = value.lower()
                else:
                    names.append(value)
        name = " ".join(names)
        never = tag in _NEVER or role in _NEVER_ROLE or (tag not in ("html", "body", "article", "main") and never_name(name))
        if tag == "header" and not any(n.tag in ("article", "main") for n in stack):
            never = True
        label = f"{tag}.{re.sub(r'[0-9]+', '0', name).replace('/', '|')}" if name else tag.replace("/", "|")
        node = Node(tag, label, never)
        if tag == "form":
            forms.append(node)
        stack[-1].children.append(node)
        stack[-1].text.append(node)
        if tag in _RAW:
            stack.append(node)
            raw = tag
        elif tag not in _VOID and not (m[3] and m[3].endswith("/") and tag in ("svg", "path")):
            stack.append(node)
    for form in forms:
        form.never = not _holds_prose(form)
    return root


#: Code points of prose from which a form is an element about a text, not one to fill in.
PROSE = 200


def _holds_prose(form: Node) -> bool:
    """Whether a form holds an article or main element, or paragraphs and headings of some length."""
    todo, prose = [form], 0
    while todo and prose < PROSE:
        node = todo.pop()
        if node.tag in ("article", "main"):
            return True
        if node.tag in ("p", "h1", "h2", "h3", "li", "td"):
            prose += sum(map(len, blocks(node, lambda _: False)))
        elif node is form or not node.never:
            todo += node.children
    return prose >= PROSE


def blocks(node: Node, skip) -> list[str]:
    """Texts of the blocks under a node, in page order, without skipped nodes."""
    out: list[str] = []
    run: list[str] = []

    def flush():
        text = _SPACE.sub(" ", entities.unescape("".join(run))).strip()
        run.clear()
        if text:
            out.append(text)

    todo: list = [node]
    while todo:
        x = todo.pop()
        if x is None:
            flush()
        elif isinstance(x, str):
            run.append(x)
        elif x.tag == "br":
            run.append("\n")
        elif x is not node and (x.never or skip(x)):
            if x.tag not in _INLINE:
                flush()
        else:
            inline = x.tag in _INLINE
            if not inline:
                flush()
                todo.append(None)
            todo.extend(reversed(x.text))
    flush()
    return out


# -- simple tree matching ------------------------------------------------------


class Shape:
    """A tree in which like text blocks among siblings are one node, with all the nodes it stands for."""

    __slots__ = ("label", "children", "nodes", "size", "path", "inner")

    def __init__(self, label: str, nodes: list[Node]):
        self.label, self.nodes, self.children, self.size, self.path, self.inner = label, nodes, [], 1, "", None


#: Elements that are aligned each for itself; others among siblings, like paragraphs and list items, are one node.
_APART = frozenset("html body main article section nav aside header footer div table tbody thead tr td th ul ol dl form figure h1".split())
#: So many siblings of one label are records of a list, and one node too.
RECORDS = 24
#: A page's shape has no more levels than this; what lies deeper belongs to its last ancestor that has one.
DEPTH = 200


def shape_of(root: Node) -> Shape:
    """The shape of a page, sizes and paths included; two walks, whatever its depth."""
    top = Shape("#root", [root])
    top.path = "/#root"
    order, todo = [], [(top, 0)]
    while todo:
        shape, depth = todo.pop()
        order.append(shape)
        if depth >= DEPTH:
            continue
        groups: list[tuple[str, list[Node]]] = []
        known: dict[str, list[Node]] = {}
        many = Counter(c.label for n in shape.nodes for c in n.children)
        for node in shape.nodes:
            for child in node.children:
                if child.tag in _INLINE and not child.children or child.tag in _VOID:
                    continue
                repeats = child.tag not in _APART or many[child.label] > RECORDS
                if repeats and child.label in known:
                    known[child.label].append(child)
                else:
                    groups.append((child.label, [child]))
                    known[child.label] = groups[-1][1]
        shape.children = [Shape(k, g) for k, g in groups]
        for k, c in enumerate(shape.children):
            c.path = f"{shape.path}/{c.label}:{k}"
            todo.append((c, depth + 1))
    for shape in reversed(order):
        shape.size = 1 + sum(c.size for c in shape.children)
    return top


def stored_shape(data: list) -> Shape:
    """The shape of a stored tree: labels with the index of each one's parent, parents first."""
    made: list[Shape] = []
    for label, parent in data:
        shape = Shape(label, [])
        shape.path = f"{made[parent].path}/{label}:{len(made[parent].children)}" if made else f"/{label}"
        if made:
            made[parent].children.append(shape)
        made.append(shape)
    for shape in reversed(made):
        shape.size = 1 + sum(c.size for c in shape.children)
    return made[0]


def tree(shape: Shape) -> list:
    """A shape as (label, index of its parent), parents first, for storage."""
    out, todo = [], [(shape, -1)]
    while todo:
        x, parent = todo.pop()
        out.append((x.label, parent))
        todo += [(c, len(out) - 1) for c in reversed(x.children)]
    return out


def walk(shape: Shape) -> list[Shape]:
    """All nodes of a shape, parents first."""
    out, todo = [], [shape]
    while todo:
        x = todo.pop()
        out.append(x)
        todo += reversed(x.children)
    return out


def match(a: Shape, b: Shape) -> tuple[int, list[tuple[Shape, Shape]]]:
    """Simple tree matching: the largest order-keeping matching of two trees, and its pairs.

    Two nodes match if their labels do; their children are aligned like sequences by
    the sizes of their own matchings. Pairs are done children first, on a stack.
    """
    if a.label != b.label:
        return 0, []
    done: dict[tuple[int, int], tuple[int, list[tuple[Shape, Shape]]]] = {}
    todo = [(a, b, False)]
    while todo:
        x, y, ready = todo.pop()
        if (id(x), id(y)) in done:
            continue
        if not ready:
            todo.append((x, y, True))
            todo += [(c, e, False) for c in x.children for e in y.children if c.label == e.label]
            continue
        m, n = len(x.children), len(y.children)
        best = [[0] * (n + 1) for _ in range(m + 1)]
        for i, c in enumerate(x.children, 1):
            row, above = best[i], best[i - 1]
            for j, e in enumerate(y.children, 1):
                w = done[id(c), id(e)][0] if c.label == e.label else 0
                row[j] = max(row[j - 1], above[j], above[j - 1] + w)
        chosen, i, j = [], m, n
        while i and j:
            if best[i][j] == best[i - 1][j]:
                i -= 1
            elif best[i][j] == best[i][j - 1]:
                j -= 1
            else:
                chosen.append((x.children[i - 1], y.children[j - 1]))
                i, j = i - 1, j - 1
        done[id(x), id(y)] = (best[m][n] + 1, chosen)
    pairs, todo = [], [(a, b)]
    while todo:
        x, y = todo.pop()
        pairs.append((x, y))
        todo += done[id(x), id(y)][1]
    return done[id(a), id(b)][0], pairs


def own_text(shape: Shape) -> str:
    """The text of all nodes that a shape stands for, boilerplate roles left out."""
    if shape.inner is None:
        shape.inner = " ".join(t for n in shape.nodes for t in blocks(n, lambda _: False))
    return shape.inner


def text_key(text: str) -> str:
    return hashlib.sha1(text.encode("utf-8", "surrogatepass")).hexdigest()


#: Elements that hold an article, not a part of its text.
_HOLDERS = frozenset("#root html body main article section div td tr tbody table center".split())


def _tag(path: str) -> str:
    return re.split("[.:]", path.rsplit("/", 1)[1], maxsplit=1)[0]


def content_region(known: list[tuple[str, int]]) -> str:
    """The smallest element that holds most of the varying text; an article or main that does is taken as it is.

    known: (path, length of its varying text) of elements that are no boilerplate.
    """
    total = max((n for _, n in known), default=0)
    most = [(p, n) for p, n in known if n and 10 * n >= 7 * total and _tag(p) in _HOLDERS]
    for tag in ("article", "main"):
        named = [p for p, _ in most if _tag(p) == tag]
        if named:
            return max(named, key=len)
    return max((p for p, _ in most), key=lambda p: (p.count("/"), p), default="")


#: A part beside the region reads as prose if links have less than this part of its text.
LINKED = 1 / 3
#: Code points that a record's line, who wrote it and when, has at most.
LINE = 60


def _under(path: str, top: str) -> bool:
    return path == top or path.startswith(top + "/")


def beside(region: str, known: list[tuple[str, int]], linked: dict[str, float]) -> list[str]:
    """The region and the varying places beside it that read as prose, each as high as it stands apart from the region.

    An article or a place like the region itself counts at any length, another from a
    twentieth of the region's text on; single blocks count beside their region alone.
    linked: which part of a path's text is in links.
    """
    if not region:
        return []
    size = dict(known)
    out, label = [region], region.rsplit("/", 1)[1].split(":")[0]
    apart = lambda p: not _under(region, p) and not _under(p, region) and _under(region, p.rsplit("/", 1)[0])
    for path, n in known:
        if not n or not apart(path):
            continue
        tag, near = _tag(path), path.rsplit("/", 1)[0] == region.rsplit("/", 1)[0]
        alike = tag == "article" or near and path.rsplit("/", 1)[1].split(":")[0] == label
        prose = tag in _HOLDERS and 20 * n >= size[region] or near and tag in ("p", "blockquote", "pre", "ul", "ol")
        if (alike or prose) and linked[path] < LINKED:
            out.append(path)
    return out


def _is_record(node: Node) -> bool:
    """Whether a node is a short line that ends no sentence, and a text, without headings."""
    parts = [c for c in node.children if own_text(Shape(c.label, [c])) and c.tag not in _VOID]
    if len(parts) < 2 or any(c.tag in _HEADING for c in parts):
        return False
    line = own_text(Shape(parts[0].label, [parts[0]]))
    return parts[0].tag != "p" and len(line) <= LINE and not line.endswith((".", "!", "?", ":"))


def remarks(regions: list[str], shown: dict[str, Place], pages: int, different: int) -> list[str]:
    """Places within the regions that hold readers' remarks: the last of their parent, all of like records, of varying number."""
    out = []
    for path, place in shown.items():
        top = next((r for r in regions if path != r and _under(path, r)), None)
        if top is None or _tag(path) not in ("div", "section") or different < SHOWN:
            continue
        parent, k = path.rsplit("/", 1)[0], int(path.rsplit(":", 1)[1])
        if any(q.rsplit("/", 1)[0] == parent and int(q.rsplit(":", 1)[1]) > k and t.length for q, t in shown.items() if q != path and "/" in q[1:]):
            continue
        least = 0 if place.nodes < pages else place.fewest
        alike = place.first_label is not None and place.first_label == place.last_label and place.most >= 2 and place.most > least
        if alike and place.records and shown[parent].length > place.length:
            out.append(path)
    return out


#: Pages whose trees match in less than this part of the larger one have another layout.
ALIKE = 0.5
#: Different pages that must show one text at a place before it is template.
SHOWN = 3


def _least(a, b):
    return b if a is None or b is not None and b < a else a


def _greatest(a, b):
    return b if a is None or b is not None and b > a else a


@dataclass(slots=True)
class Place:
    """What pages show at a place of a layout; sums, extremes and flags, so that parts can be put together in any order."""

    pages: int = 0  # that have the place
    length: int = 0  # code points of their texts
    first: str | None = None  # least and greatest key of a text
    last: str | None = None
    prose: int = 0  # code points of blocks, and of those in links
    linked: int = 0
    never: bool = True  # on all pages
    nodes: int = 0
    fewest: int | None = None  # records of a node, and their labels
    most: int | None = None
    first_label: str | None = None
    last_label: str | None = None
    records: bool = True
    seen: tuple[int, ...] = ()  # the SHOWN least keys of different pages

    def add(self, o: Place) -> None:
        self.pages += o.pages
        self.length += o.length
        self.prose += o.prose
        self.linked += o.linked
        self.nodes += o.nodes
        self.never &= o.never
        self.records &= o.records
        self.first, self.last = _least(self.first, o.first), _greatest(self.last, o.last)
        if o.fewest is not None:
            self.fewest, self.most = _least(self.fewest, o.fewest), _greatest(self.most, o.most)
            self.first_label, self.last_label = _least(self.first_label, o.first_label), _greatest(self.last_label, o.last_label)
        if len(self.seen) < SHOWN or o.seen[0] < self.seen[-1]:
            self.seen = tuple(sorted({*self.seen, *o.seen})[:SHOWN])


def read(root: Node) -> tuple[list[str], dict[int, tuple[int, int, int]]]:
    """Blocks of a page, and for each of its block elements where its own begin and end and how much of them is in links; one walk."""
    out: list[str] = []
    run: list[str] = []
    spans: dict[int, tuple[int, int, int]] = {}
    linked = inside = 0

    def flush():
        text = _SPACE.sub(" ", entities.unescape("".join(run))).strip()
        run.clear()
        if text:
            out.append(text)

    todo: list = [root]
    while todo:
        x = todo.pop()
        if isinstance(x, str):
            run.append(x)
            continue
        if isinstance(x, tuple):
            node, start, before = x
            if node.tag == "a":
                inside -= 1
            else:
                flush()
                spans[id(node)] = (start, len(out), linked - before)
            continue
        if x.tag == "br":
            run.append("\n")
            continue
        if x.tag == "a" and not inside:
            linked += sum(map(len, blocks(x, lambda _: False)))
        inline = x.tag in _INLINE
        if not inline:
            flush()
        if x is root or not x.never:
            if x.tag == "a":
                inside += 1
            if not inline or x.tag == "a":
                todo.append((x, len(out), linked))
            todo.extend(reversed(x.text))
    return out, spans


def shown_by(page: str | None, stored: str) -> list[tuple[int, int, Place]]:
    """(layout, place, what the page shows there) of the layout that a page matches most; none for a page without text."""
    root = parse(page)
    shape = shape_of(root)
    made, spans = read(root)
    if not made:
        return []
    ends = [0, *accumulate(map(len, made))]
    key = int(text_key(" ".join(made))[:15], 16)
    k, pairs = fitted(shape, stored)
    there = walk(shape)
    left_out: set[int] = set()  # what lies in an element that is no content
    out = []
    for a, b in pairs:
        x = there[b]
        if id(x) in left_out or x.nodes[0].never:
            left_out.update(map(id, x.children))
        if id(x) in left_out:
            continue
        texts: list[str] = []
        place = Place(1, never=x.nodes[0].never, nodes=len(x.nodes), seen=(key,))
        for node in x.nodes:
            at = spans.get(id(node))
            if at is None:
                found = blocks(node, lambda _: False)
                n = sum(map(len, found))
                texts += found
                place.prose += n
                place.linked += n if node.tag == "a" else 0
            else:
                texts += made[at[0] : at[1]]
                place.prose += ends[at[1]] - ends[at[0]]
                place.linked += at[2]
        text = " ".join(texts)
        place.length, place.first = len(text), text_key(text)
        place.last = place.first
        if x.nodes[0].tag in ("div", "section"):
            records = [[c for c in n.children if c.tag not in _HEADING and c.tag not in _VOID] for n in x.nodes]
            every = [c for r in records for c in r]
            place.fewest, place.most = min(map(len, records)), max(map(len, records))
            place.first_label, place.last_label = min((c.label for c in every), default=None), max((c.label for c in every), default=None)
            place.records = place.first_label == place.last_label and all(map(_is_record, every))
        out.append((k, a, place))
    return out


def tree_text(shape: Shape) -> str:
    return json.dumps(tree(shape), separators=(",", ":"))


def _overlap(a: Counter, b: Counter) -> int:
    """No matching of two trees is larger than what their labels have in common."""
    return sum(min(n, b[x]) for x, n in a.items() if x in b)


def layouts(trees: list[str]) -> list[str]:
    """The first tree of each layout among different trees, the largest first; a tree joins the first layout that is alike."""
    out: list[tuple[Shape, Counter, str]] = []
    for text, shape in sorted(((t, stored_shape(json.loads(t))) for t in trees), key=lambda x: (-x[1].size, x[0])):
        labels = Counter(x.label for x in walk(shape))
        for first, known, _ in out:
            least = ALIKE * first.size
            if shape.size >= least and _overlap(labels, known) >= least and match(first, shape)[0] >= least:
                break
        else:
            out.append((shape, labels, text))
    return [text for _, _, text in out]


def wrapper_of(text: str, found: dict[int, Place]) -> dict:
    """The wrapper of a layout's tree and of what all its pages show at its places: tree, content regions and template texts.

    A place is template if at least SHOWN different pages have it and all show
    the same text there; the text is kept, so that other pages lose it only where
    they show it too. Headings of the region stay: articles may be named alike. The
    region is the place that holds the varying text.
    """
    data = json.loads(text)
    places = walk(stored_shape(data))
    shown = {p.path: found[k] for k, p in enumerate(places) if k in found}
    top = shown.get(places[0].path, Place())
    dead: set[str] = set()
    for p in places:
        if (p.path in shown and shown[p.path].never) or p.path.rsplit("/", 1)[0] in dead:
            dead.add(p.path)
    same = {p: x.first == x.last for p, x in shown.items()}
    known = [(p, x.length) for p, x in shown.items() if p not in dead and (len(top.seen) < SHOWN or not same[p])]
    regions = beside(content_region(known), known, {p: x.linked / x.prose if x.prose else 1.0 for p, x in shown.items()})
    template = {
        p: x.first
        for p, x in shown.items()
        if any(p.startswith(r + "/") for r in regions) and len(x.seen) >= SHOWN and same[p] and x.length and _tag(p) not in _HEADING
    }
    drop = remarks(regions, shown, top.pages, len(top.seen))
    return {"tree": data, "regions": sorted(regions), "drop": sorted(drop), "template": dict(sorted(template.items()))}


def induce(pages: list[str]) -> list[dict]:
    """The wrappers of some pages of one host, one a layout; as `wrappers` makes them."""
    first = layouts(sorted({tree_text(shape_of(parse(p))) for p in pages}))
    stored = _list(first)
    found: dict[tuple[int, int], Place] = {}
    for page in pages:
        for k, a, place in shown_by(page, stored):
            found.setdefault((k, a), Place()).add(place)
    return [wrapper_of(t, {a: x for (j, a), x in found.items() if j == k}) for k, t in enumerate(first)]


def _list(trees: list[str]) -> str:
    return f"[{','.join(trees)}]"


def _kept(key, make):
    """What a worker keeps for the pages of the same host."""
    known = held("wrappers", dict)
    if key not in known:
        if len(known) >= 2048:
            known.clear()
        made = make()
        known[key] = made
    return known[key]


def _stored(stored: str) -> list[tuple[Shape, Counter, dict]]:
    """Layouts (trees) or wrappers as they were stored, with the labels of each one's tree."""

    def make():
        out = []
        for w in json.loads(stored):
            w = w if isinstance(w, dict) else {"tree": w}
            shape = stored_shape(w["tree"])
            out.append((shape, Counter(x.label for x in walk(shape)), w | {k: set(w.get(k, ())) for k in ("regions", "drop")}))
        return out

    return _kept(stored, make)


def fitted(shape: Shape, stored: str) -> tuple[int, list[tuple[int, int]]]:
    """Which of the stored layouts matches a page's shape most, the first of equals, and its pairs by their numbers in `walk`."""

    def make():
        best, out = 0, (0, [])
        labels = Counter(x.label for x in walk(shape))
        for k, (first, known, _) in enumerate(_stored(stored)):
            if _overlap(labels, known) <= best:
                continue
            size, pairs = match(first, shape)
            if size > best:
                a, b = ({id(x): n for n, x in enumerate(walk(top))} for top in (first, shape))
                best, out = size, (k, [(a[id(x)], b[id(y)]) for x, y in pairs])
        return out

    return _kept((stored, tree_text(shape)), make)


def extract(page: str | None, wrapper: str | None = None) -> str:
    """A page's main text under the wrapper of its layout."""
    if not page:
        return ""
    root = parse(page)
    content: list[Node] = []
    drop: set[int] = set()
    if wrapper and (made := _stored(wrapper)):
        shape = shape_of(root)
        k, pairs = fitted(shape, wrapper)
        first, _, w = made[k]
        places, there = walk(first), walk(shape)
        for a, b in pairs if w["regions"] else ():
            path, nodes = places[a].path, there[b].nodes
            if path in w["regions"]:
                content += nodes
            elif path in w["drop"] or path in w["template"] and text_key(own_text(there[b])) == w["template"][path]:
                drop.update(id(n) for n in nodes)
        if len(w["regions"]) > 1:
            content = in_order(root, content)
    if not content:
        content = _fallback(root)
    out: list[str] = []
    for node in content:
        out += blocks(node, lambda n: id(n) in drop)
    return " ".join(out)


def in_order(root: Node, nodes: list[Node]) -> list[Node]:
    """Nodes of a page in page order, none within another."""
    wanted, out, todo = {id(n) for n in nodes}, [], [root]
    while todo:
        node = todo.pop()
        if id(node) in wanted:
            out.append(node)
        else:
            todo.extend(reversed(node.children))
    return out


def _fallback(root: Node) -> list[Node]:
    """Articles of a page that no wrapper fits, else its main element, else its body."""
    found: dict[str, list[Node]] = {"article": [], "main": [], "body": []}
    todo = [root]
    while todo:
        node = todo.pop()
        if node.tag in found:
            found[node.tag].append(node)
            if node.tag != "body":
                if node.tag == "main":
                    todo.extend(reversed(node.children))
                continue
        if not node.never:
            todo.extend(reversed(node.children))
    return found["article"] or found["main"][:1] or found["body"][:1] or [root]


# -- the operator --------------------------------------------------------------


def host(url):
    return F.coalesce(F.lower(F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]*)", 1)), F.lit(""))


def _trees(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(host, tree) of pages (host, html), each once as far as a task remembers."""
    known: set[tuple[str, str]] = set()
    for whole in batches:
        for batch in slices(whole, "html"):
            new = {
                (h, tree_text(shape_of(parse(page))))
                for h, page in zip(batch.column("host").to_pylist(), batch.column("html").to_pylist(), strict=True)
            } - known
            known = new if len(known) >= HELD else known | new
            yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in sorted(new)], pa.string()) for k in (0, 1)], names=["host", "tree"])


_PLACE = (
    "pages long, length long, first string, last string, prose long, linked long, never boolean, nodes long, fewest long, most long, "
    "first_label string, last_label string, records boolean, seen array<long>"
)
_PLACES = f"host string, layout int, place int, {_PLACE}"
_ARROW = pa.schema(
    [
        ("host", pa.string()), ("layout", pa.int32()), ("place", pa.int32()), ("pages", pa.int64()), ("length", pa.int64()), ("first", pa.string()),
        ("last", pa.string()), ("prose", pa.int64()), ("linked", pa.int64()), ("never", pa.bool_()), ("nodes", pa.int64()), ("fewest", pa.int64()),
        ("most", pa.int64()), ("first_label", pa.string()), ("last_label", pa.string()), ("records", pa.bool_()), ("seen", pa.list_(pa.int64())),
    ]
)


def _shown(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What pages (host, html, layouts) show at the places of their layouts, summed up as far as a task remembers."""
    found: dict[tuple[str, int, int], Place] = {}

    def rows() -> pa.RecordBatch:
        made = [(*k, *(getattr(x, f.name) for f in fields(Place))) for k, x in found.items()]
        return pa.RecordBatch.from_arrays([pa.array([r[k] for r in made], f.type) for k, f in enumerate(_ARROW)], schema=_ARROW)

    for whole in batches:
        for batch in slices(whole, "html"):
            for h, page, stored in zip(*(batch.column(c).to_pylist() for c in ("host", "html", "layouts")), strict=True):
                for k, a, place in shown_by(page, stored):
                    if (h, k, a) in found:
                        found[h, k, a].add(place)
                    else:
                        found[h, k, a] = place
            if len(found) >= HELD:
                yield rows()
                found.clear()
    yield rows()


def host_layouts(pages: DataFrame) -> DataFrame:
    """(host, layouts) of pages (host, html): the first trees of a host's layouts.

    All different trees of a host are dealt into CLASSES by their hashes; the layouts
    of each class then meet, so that no task has all the trees of a host.
    """
    trees = pages.mapInArrow(_trees, "host string, tree string").distinct()

    def some(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        made = layouts(table.column("tree").to_pylist())
        return pa.table({"host": pa.array([key[0].as_py()] * len(made), pa.string()), "tree": pa.array(made, pa.string())})

    def one(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        return pa.table({"host": pa.array([key[0].as_py()]), "layouts": pa.array([_list(layouts(table.column("tree").to_pylist()))])})

    dealt = trees.withColumn("part", F.pmod(F.xxhash64("tree"), F.lit(CLASSES)))
    return dealt.groupBy("host", "part").applyInArrow(some, "host string, tree string").groupBy("host").applyInArrow(one, "host string, layouts string")


def wrappers(pages: DataFrame) -> DataFrame:
    """(host, wrapper) of pages (host, html), from all of them.

    What every page shows at a place of its layout is summed up in tasks and then by
    place, so a host of any size sends a row a place and task.
    """
    pages = pages.where("html <> ''")
    first = written(host_layouts(pages), "layouts")
    shown = pages.join(first, "host").select("host", "html", "layouts").mapInArrow(_shown, _PLACES)
    places = shown.groupBy("host", "layout", "place").agg(
        *(F.sum(c).alias(c) for c in ("pages", "length", "prose", "linked", "nodes")),
        *(F.min(c).alias(c) for c in ("first", "never", "fewest", "first_label", "records")),
        *(F.max(c).alias(c) for c in ("last", "most", "last_label")),
        F.slice(F.array_sort(F.array_distinct(F.flatten(F.collect_list("seen")))), 1, SHOWN).alias("seen"),
    )

    def one(key: tuple[pa.Scalar, ...], table: pa.Table, stored: pa.Table) -> pa.Table:
        found: dict[int, dict[int, Place]] = {}
        for r in table.to_pylist():
            found.setdefault(r["layout"], {})[r["place"]] = Place(**{f.name: r[f.name] for f in fields(Place)})
        made = [wrapper_of(json.dumps(t), found.get(k, {})) for text in stored.column("layouts").to_pylist() for k, t in enumerate(json.loads(text))]
        return pa.table({"host": pa.array([key[0].as_py()]), "wrapper": pa.array([json.dumps(made)])})

    return places.groupBy("host").cogroup(first.groupBy("host")).applyInArrow(one, "host string, wrapper string")


def _extractor(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for batch in slices(whole, "html"):
            texts = [
                extract(h, w) for h, w in zip(batch.column("html").to_pylist(), batch.column("wrapper").to_pylist(), strict=True)
            ]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("page_id"),
                    batch.column("url"),
                    pa.array(texts, pa.string()),
                    pa.array([len(t) for t in texts], pa.int64()),
                ],
                names=["page_id", "url", "text", "n_chars"],
            )


def extract_pages(pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars of pages (page_id, url, html)."""
    ship(pages.sparkSession)
    p = pages.select(
        F.col("page_id").cast("long").alias("page_id"),
        F.col("url").cast("string").alias("url"),
        F.col("html").cast("string").alias("html"),
        host(F.col("url")).alias("host"),
    )
    made = written(wrappers(p.select("host", "html")), "wrappers")
    return (
        p.join(made, "host", "left")
        .select("page_id", "url", "html", "wrapper")
        .mapInArrow(_extractor, "page_id long, url string, text string, n_chars long")
    )


def op4_wrapper_induction(spark, sf_dir: str) -> DataFrame:
    """The main text of all pages."""
    return extract_pages(spark.read.parquet(f"{sf_dir}/pages.parquet"))
