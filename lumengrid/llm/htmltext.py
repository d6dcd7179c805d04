"""Main text of web pages by wrapper induction.

Pages of one host and layout (the containers near the top of the tree) share a
wrapper.  The group's pivot page, its least page_id, is aligned with every
other page by simple tree matching: trees match top-down, children in order,
by tag and class.  Text that stays equal at a matched place votes for
template, text that varies for content; votes of all pages are summed by node
of the pivot.  The deepest container that holds most of the varying text is
the content region, and slots in it that stay constant are template too.
Pages that also repeat what varies between the others are copies of the pivot
and don't count.

What an element is called only breaks ties: text in links, menus, adverts and
the like counts a tenth when the region is chosen, and containers inside the
region that are called so are left out unless much of its varying text stands
there.  A page whose group has no other page, or whose tree lacks the region,
is read by those names alone.
"""

from __future__ import annotations

import hashlib
import html
import re
from collections import OrderedDict, defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import textkernel as K
from .common import ship, spread_join, stage

#: A constant slot of the region is template if this share of the voters have its text.
SHARE = 0.8
#: The region holds this share of the varying text; a named container in it stays from this share of the region on.
REGION, NAMED = 0.75, 0.3
#: Voters are told apart by how much of the pivot's text they repeat, in so many steps.
STEPS = 16
#: The voters that repeat least, this share of them, show which of the pivot's text varies;
#: those that repeat this share of it are copies of the pivot and don't count.
OTHERS, COPY = 0.1, 0.8
#: A region whose text is constant beyond this share is an article copied, not a template.
CONSTANT = 0.9
#: Weight of text in links and in elements named as furniture.
FAINT = 0.1
#: Elements nest so deep at most, as in browsers; deeper ones lie side by side.
DEPTH = 512
#: Cells of a table for a longest common sequence; longer lists are halved until they fit.
TABLE = 20_000
#: Bytes of pivots that may be broadcast.
BROADCAST_BYTES = 32 << 20

TAG = re.compile(r"(/?)([a-zA-Z][^\s/>]*)")
REST = re.compile(r"(?:\"[^\"]*\"|'[^']*'|[^'\">])*+>")
ATTR = re.compile(r"\b(class|id|role|itemprop|hidden)(?:\s*+=\s*+(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?", re.I)
SPLIT = re.compile(r"[^A-Za-z]+|(?<=[a-z])(?=[A-Z])")
DIGITS = re.compile(r"\d+")
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript template iframe noembed noframes xmp".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q s samp small span strike strong sub sup time tt u var".split())
#: Elements without text for readers.
NEVER = frozenset("head script style noscript template iframe form button select option textarea input svg math canvas object embed audio video map title noembed noframes".split())
#: Elements that are furniture by their nature.
FURNITURE = frozenset("nav footer aside menu dialog".split())
ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog menu menubar toolbar form".split())
#: Words in a class or id that name furniture.
NAMES = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense sponsor sponsored promo promotion banner nav navbar navigation menu breadcrumb breadcrumbs pagination pager sidebar aside rail footer masthead "
    "comment comments disqus replies respond cookie cookies consent gdpr notice notices alert popup modal overlay newsletter subscribe subscription signup login share sharing social related recommended widget widgets toolbar skip".split()
)
PARAGRAPHS = frozenset("p h1 h2 h3 h4 h5 h6 blockquote pre li dd dt td th figcaption".split())
#: Elements whose names never count.
PLAIN = INLINE | frozenset("p h1 h2 h3 h4 h5 h6 blockquote pre figcaption html body article main".split())
CONTAINERS = frozenset("div section article main nav header footer aside form table center".split())
CLOSES = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
#: An element of these ends the search for one to close.
SCOPES = frozenset("html body div article section main table ul ol dl nav aside header footer form".split())


class Node:
    """An element: its texts are ``texts[first:last]`` of its tree, children are nodes or numbers of texts."""

    __slots__ = ("tag", "label", "children", "never", "furniture", "main", "header", "weight", "no", "first", "last", "parent")

    def __init__(self, tag: str, attrs: str, parent: Node | None, no: int, first: int):
        self.tag, self.label, self.children, self.parent, self.no, self.first, self.last = tag, tag, [], parent, no, first, None
        self.never, self.furniture, self.main, self.header = tag in NEVER, tag in FURNITURE, tag in ("article", "main"), tag == "header"
        if attrs and not attrs.isspace():
            for name, a, b, c in ATTR.findall(attrs):
                value, name = a or b or c, name.lower()
                if name in ("class", "id"):
                    if name == "class":
                        self.label = f"{tag}.{DIGITS.sub('#', value)}"
                    words = [w.lower() for w in SPLIT.split(value) if w]
                    if tag not in PLAIN and not NAMES.isdisjoint(words):
                        self.furniture = True
                    if words == ["header"] or words[:2] in (["site", "header"], ["page", "header"]):
                        self.header = True
                elif name == "role":
                    self.furniture |= value.lower() in ROLES
                    self.main |= value.lower() in ("main", "article")
                elif name == "itemprop":
                    self.main |= value.lower() == "articlebody"
                elif name == "hidden":
                    self.never = True
        self.weight = 0.0 if self.never else (parent.weight if parent else 1.0) * (FAINT if self.furniture or tag == "a" else 1.0)


class Tree:
    """Elements in page order, and the page's texts."""

    def __init__(self, source: str):
        self.nodes, self.texts, self.owner = [], [], []
        self._parse(source)
        self.size = [0.0]
        for text, node in zip(self.texts, self.owner):
            self.size.append(self.size[-1] + len(text.strip()) * node.weight)

    def _text(self, text: str, node: Node) -> None:
        if text and (node.children or node.tag in INLINE or not text.isspace()):
            node.children.append(len(self.texts))
            self.texts.append(text)
            self.owner.append(node)

    def _parse(self, source: str) -> None:
        """Unclosed elements end with their parent; time grows with the length of the page."""
        root = Node("#root", "", None, 0, 0)
        self.nodes.append(root)
        stack, opened, at, n, quotes, gt = [root], defaultdict(int), 0, len(source), True, -1

        def close(k: int) -> None:
            for node in stack[k:]:
                node.last = len(self.texts)
                opened[node.tag] -= 1
            del stack[k:]

        while at < n:
            lt = source.find("<", at)
            if 0 <= lt and gt < lt:
                gt = source.find(">", lt)
            if lt < 0 or gt < 0:  # no markup from here on
                self._text(source[at:], stack[-1])
                break
            self._text(source[at:lt], stack[-1])
            m = TAG.match(source, lt + 1)
            if m is None:
                c = source[lt + 1 : lt + 2]
                if source.startswith("!--", lt + 1):
                    end = source.find("-->", lt + 4)
                    at = n if end < 0 else end + 3
                elif source.startswith("![CDATA[", lt + 1):
                    end = source.find("]]>", lt)
                    at = n if end < 0 else end + 3
                elif c in ("!", "?", "/"):
                    at = source.find(">", lt) + 1
                else:
                    self._text("<", stack[-1])
                    at = lt + 1
                continue
            end = REST.match(source, m.end()) if quotes else None
            if end is None:  # a quote that never closes: from here on the next bracket ends a tag
                quotes = False
                stop = source.find(">", m.end()) + 1
                if not stop:
                    self._text(source[lt:], stack[-1])
                    break
            else:
                stop = end.end()
            attrs, tag, at = source[m.end() : stop - 1], m[2].lower(), stop
            if m[1]:
                if opened[tag] > 0:
                    for k in range(len(stack) - 1, 0, -1):
                        if stack[k].tag == tag:
                            close(k)
                            break
                        if tag in INLINE and stack[k].tag not in INLINE and stack[k].tag != "p":
                            break
                continue
            if tag not in INLINE and tag not in VOID:
                ends = CLOSES.get(tag, ())
                if opened["p"] > 0 or any(opened[t] > 0 for t in ends):
                    for k in range(len(stack) - 1, 0, -1):
                        top = stack[k].tag
                        if top == "p" or top in ends:
                            close(k)
                            break
                        if top in SCOPES and top not in ends:
                            break
            node = Node(tag, attrs, stack[-1], len(self.nodes), len(self.texts))
            self.nodes.append(node)
            stack[-1].children.append(node)
            if tag in RAW:
                found = re.compile(f"</{re.escape(tag)}(?=[\\s/>])", re.I).search(source, at)
                at = source.find(">", found.end()) + 1 if found else n
                at = at or n
            if tag in VOID or tag in RAW or len(stack) >= DEPTH:
                node.last = len(self.texts)
                continue
            opened[tag] += 1
            stack.append(node)
        close(0)

    def layout(self) -> str:
        """A name for the containers of the first two levels that branch, without what articles hold."""
        node = next((x for x in self.nodes if x.tag == "body"), self.nodes[0])
        inner = lambda x: [c for c in x.children if isinstance(c, Node) and c.tag in CONTAINERS]
        level = inner(node)
        while len(level) == 1 and not level[0].main and inner(level[0]):
            level = inner(level[0])
        paths = {x.label for x in level}
        for x in level:
            if not x.main and not any(isinstance(c, Node) and c.tag in PARAGRAPHS for c in x.children):
                paths.update(f"{x.label}>{c.label}" for c in inner(x))
        return hashlib.md5("|".join(sorted(paths)).encode("utf-8", "replace")).hexdigest()[:12]


def _reach(p: list[str], q: list[str]) -> np.ndarray:
    """Length of the longest common sequence of p and every head of q, by bit-parallel rows."""
    places: dict[str, int] = {}
    for k, label in enumerate(q):
        places[label] = places.get(label, 0) | 1 << k
    full = (1 << len(q)) - 1
    row = full
    for label in p:
        hit = row & places.get(label, 0)
        row = (row + hit | row - hit) & full
    bits = np.unpackbits(np.frombuffer((~row & full).to_bytes(len(q) // 8 + 1, "little"), np.uint8), bitorder="little")
    return np.r_[0, np.cumsum(bits[: len(q)], dtype=np.int64)]


def _common(p: list[str], q: list[str]) -> list[tuple[int, int]]:
    """Matching places of two label lists, in order: a longest common sequence, in memory that follows the lists."""
    out, todo = [], [(0, len(p), 0, len(q))]
    while todo:
        a, b, c, d = todo.pop()
        own, other = p[a:b], q[c:d]
        if not own or not other or set(own).isdisjoint(other):
            continue
        if len(own) * len(other) <= TABLE:
            out += [(a + s, c + t) for s, t in _table(own, other)]
        elif len(own) == 1:
            out.append((a, c + other.index(own[0])))
        else:
            mid = len(own) // 2
            cut = int((_reach(own[:mid], other) + _reach(own[:mid - 1 : -1], other[::-1])[::-1]).argmax())
            todo += [(a + mid, b, c + cut, d), (a, a + mid, c, c + cut)]
    return out


def _table(p: list[str], q: list[str]) -> list[tuple[int, int]]:
    """The same for short lists, by the whole table."""
    out = []
    best = [[0] * (len(q) + 1) for _ in range(len(p) + 1)]
    for s in range(len(p) - 1, -1, -1):
        row, below, label = best[s], best[s + 1], p[s]
        for t in range(len(q) - 1, -1, -1):
            row[t] = below[t + 1] + 1 if label == q[t] else max(below[t], row[t + 1])
    s = t = 0
    while s < len(p) and t < len(q):
        if p[s] == q[t]:
            out.append((s, t))
            s, t = s + 1, t + 1
        elif best[s + 1][t] >= best[s][t + 1]:
            s += 1
        else:
            t += 1
    return out


def align(a: Tree, b: Tree) -> tuple[list[tuple[int, int]], list[tuple[int, int]]]:
    """Simple tree matching: numbers of matched elements, and of matched texts.

    Equal heads and tails of two elements' children match as they are; what is
    left between is matched by a common sequence of labels.
    """
    elements, texts, todo = [(0, 0)], [], [(a.nodes[0], b.nodes[0])]
    while todo:
        x, y = todo.pop()
        lx, ly = ([c.label if isinstance(c, Node) else "#text" for c in z.children] for z in (x, y))
        i = 0
        while i < len(lx) and i < len(ly) and lx[i] == ly[i]:
            i += 1
        j = 0
        while j < len(lx) - i and j < len(ly) - i and lx[-1 - j] == ly[-1 - j]:
            j += 1
        pairs = [(k, k) for k in range(i)] + [(i + s, i + t) for s, t in _common(lx[i : len(lx) - j], ly[i : len(ly) - j])] + [(len(lx) - 1 - k, len(ly) - 1 - k) for k in range(j)]
        for s, t in pairs:
            p, q = x.children[s], y.children[t]
            if isinstance(p, Node):
                elements.append((p.no, q.no))
                if p.children and q.children and not p.never:
                    todo.append((p, q))
            else:
                texts.append((p, q))
    return elements, texts


def main_text(tree: Tree, top: Node | None = None, template: set[int] = frozenset(), content: set[int] = frozenset()) -> str:
    """Text under ``top``: all but the texts of ``template``, and named containers that aren't in ``content``.

    If articles or main elements stand there, only what is in them counts.
    """
    top = top or tree.nodes[0]
    need = _has_main(top, content)
    blocks: list[str] = []
    now: list[str] = []

    def flush():
        if now:
            t = " ".join(html.unescape("".join(now)).split())
            if t:
                blocks.append(t)
            now.clear()

    todo: list = [(top, top.main)]
    while todo:
        item = todo.pop()
        if item is None:
            flush()
            continue
        node, inside = item
        if not isinstance(node, Node):
            if (inside or not need) and node not in template:
                now.append(tree.texts[node])
            continue
        inside = inside or node.main
        block = node.tag not in INLINE
        if block:
            flush()
        if node.never or node is not top and (node.furniture and node.no not in content or node.header and not (inside and need)):
            continue
        if block:
            todo.append(None)
        todo.extend([(c, inside) for c in reversed(node.children)])
    flush()
    return " ".join(blocks)


def _has_main(top: Node, content: set[int]) -> bool:
    todo = [top]
    while todo:
        node = todo.pop()
        if node.never or node is not top and node.furniture and node.no not in content:
            continue
        if node.main:
            return True
        todo.extend(c for c in node.children if isinstance(c, Node))
    return False


def votes_of(a: Tree, b: Tree) -> list[tuple[int, str, int, float]]:
    """One page's votes on the pivot's nodes: (step, kind, node, value).

    step: how much of the pivot's text the page repeats.  voter: 1.  text: the
    page repeats the pivot's text.  volume: varying text under an element.
    """
    elements, texts = align(a, b)
    equal = [(p, q) for p, q in texts if a.texts[p] == b.texts[q]]
    same = sum(a.size[p + 1] - a.size[p] for p, _ in equal)
    step = int(STEPS * same / a.size[-1] + 1e-9) if a.size[-1] else 0
    varying, fixed = [0.0], {q for _, q in equal}
    for q in range(len(b.texts)):
        varying.append(varying[-1] + (0.0 if q in fixed else b.size[q + 1] - b.size[q]))
    out = [(step, "voter", 0, 1.0)] + [(step, "text", p, 1.0) for p, _ in equal if not a.texts[p].isspace()]
    for p, q in elements:
        node = b.nodes[q]
        if node.tag not in PARAGRAPHS and node.tag not in INLINE and not node.never:
            out.append((step, "volume", p, varying[node.last] - varying[node.first]))
    return out


def others(tree: Tree, votes: list[tuple[int, str, int, float]]) -> set[int]:
    """The steps whose voters are no copies of the pivot.

    The lowest steps show which of the pivot's text varies between pages;
    a step whose voters repeat most of that text too holds copies.
    """
    count, text = defaultdict(float), defaultdict(dict)
    for step, kind, node, value in votes:
        if kind == "voter":
            count[step] += value
        elif kind == "text":
            text[step][node] = text[step].get(node, 0.0) + value
    base, n = [], 0.0
    for step in sorted(count):
        if n < OTHERS * sum(count.values()):
            base.append(step)
            n += count[step]
    size = np.diff(np.asarray(tree.size, float))
    vary = size.copy()
    for step in base:
        for p, v in text[step].items():
            vary[p] -= size[p] * v / n
    whole = vary.sum()
    agree = lambda step: sum(vary[p] * v for p, v in text[step].items()) / count[step]
    return {step for step in count if step in base or agree(step) < COPY * whole}


def whole_blocks(tree: Tree, texts: set[int]) -> list[int]:
    """Those of ``texts`` whose block holds no other text: equal words within a varying paragraph are content."""
    blocks = defaultdict(list)
    for k, node in enumerate(tree.owner):
        if not tree.texts[k].isspace():
            while node.parent is not None and node.tag in INLINE:
                node = node.parent
            blocks[node.no].append(k)
    return [k for block in blocks.values() if texts.issuperset(block) for k in block]


def choose(tree: Tree, votes: list[tuple[int, str, int, float]]) -> tuple[int, list[int], list[int]]:
    """(region, template texts, named containers that are content) of a pivot from all votes."""
    plain, total = others(tree, votes), defaultdict(float)
    for step, kind, node, value in votes:
        if step in plain:
            total[kind, node] += value
    voters = total["voter", 0]
    volume = {k: v for (kind, k), v in total.items() if kind == "volume"}
    whole = volume.get(0, 0.0)
    region = tree.nodes[0]
    for node in tree.nodes:  # parents come before their children
        if volume.get(node.no, 0.0) >= REGION * whole > 0:
            region = node
    above = region
    while above is not None and not above.main:
        above = above.parent
    if above is not None:
        region = above
    elif region.parent and region.parent.tag not in ("body", "html", "#root") and any(isinstance(c, Node) and c.tag in ("h1", "h2", "header") for c in region.parent.children):
        region = region.parent
    template = {k for (kind, k), v in total.items() if kind == "text" and v >= SHARE * voters and region.first <= k < region.last}
    template = sorted(whole_blocks(tree, template))
    # Few voters are little evidence: one may repeat half of the region, two two thirds of it.
    constant = sum(tree.size[k + 1] - tree.size[k] for k in template)
    if constant > min(CONSTANT, voters / (voters + 1)) * (tree.size[region.last] - tree.size[region.first]):
        template = []
    own = volume.get(region.no, 0.0)
    # Named text is faint, so such a container has to hold about four fifths of the region's varying text.
    content = [x.no for x in tree.nodes if x.furniture and not x.never and x.no in volume and x is not region and volume[x.no] >= NAMED * own > 0]
    return region.no, template, content


def host(url: Column) -> Column:
    """Lower-case host of a URL, empty if there is none."""
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))


class Pivots:
    """Parsed pivot pages of the last groups seen."""

    def __init__(self, most: int = 64):
        self.most, self.kept = most, OrderedDict()

    def get(self, source: str) -> Tree:
        if source not in self.kept:
            self.kept[source] = Tree(source)
            if len(self.kept) > self.most:
                self.kept.popitem(last=False)
        self.kept.move_to_end(source)
        return self.kept[source]


def laid_out(pages: DataFrame) -> DataFrame:
    """(page_id, url, html, host, layout) of every page, staged; null html is empty."""
    ship(pages.sparkSession)
    rows = pages.select("page_id", "url", F.coalesce("html", F.lit("")).alias("html"), host(F.col("url")).alias("host"))

    @K.tidy
    def name(batches):
        for batch in batches:
            yield batch.append_column("layout", pa.array([Tree(s.as_py()).layout() for s in batch.column("html")], pa.string()))

    return stage(rows.mapInArrow(name, T.StructType([*rows.schema.fields, T.StructField("layout", T.StringType())])), "pages_laid_out")


def _beside(rows: DataFrame, table: DataFrame, how: str) -> DataFrame:
    """Pages beside their group's row: a small table is broadcast, else large groups are dealt over parts."""
    small = (table.agg(F.sum(F.octet_length("pivot"))).first()[0] or 0) <= BROADCAST_BYTES
    on = ["host", "layout"]
    return rows.join(F.broadcast(table), on, how) if small else spread_join(rows, table, on, ["page_id", "url"], rows.select(*on), how=how)


def induce(rows: DataFrame) -> DataFrame:
    """(host, layout, pivot, region, template, content): one row per group of two or more pages that differ.

    Every page of a group votes; votes are summed by pivot node before they move.
    """
    ship(rows.sparkSession)
    rows = rows.where("host != ''").select("host", "layout", "page_id", "url", "html")
    pivots = rows.groupBy("host", "layout").agg(F.min_by("html", F.struct("page_id", "html")).alias("pivot"), F.count("*").alias("pages"))
    pivots = stage(pivots.where("pages > 1").drop("pages"), "wrapper_pivots")
    paired = _beside(rows, pivots, "inner").select("host", "layout", "pivot", "html")

    @K.tidy
    def vote(batches):
        known = Pivots()
        for batch in batches:
            total: dict = defaultdict(float)
            for name, layout, pivot, source in zip(*(c.to_pylist() for c in batch.columns)):
                if source != pivot:
                    for step, kind, node, value in votes_of(known.get(pivot), Tree(source)):
                        total[name, layout, step, kind, node] += value
            columns = list(zip(*total)) or [[], [], [], [], []]
            kinds = [pa.string(), pa.string(), pa.int32(), pa.string(), pa.int32()]
            yield pa.RecordBatch.from_arrays([*[pa.array(c, k) for c, k in zip(columns, kinds)], pa.array(list(total.values()), pa.float64())], names=["host", "layout", "step", "kind", "node", "value"])

    votes = paired.mapInArrow(vote, "host string, layout string, step int, kind string, node int, value double")
    votes = votes.groupBy("host", "layout", "step", "kind", "node").agg(F.sum("value").alias("value"))
    # A list is at most STEPS votes per node of the pivot, however many pages vote.
    votes = votes.groupBy("host", "layout").agg(F.collect_list(F.struct("step", "kind", "node", "value")).alias("votes"))

    @K.tidy
    def decide(batches):
        for batch in batches:
            found = [choose(Tree(p), [(v["step"], v["kind"], v["node"], v["value"]) for v in vs]) for p, vs in zip(batch.column("pivot").to_pylist(), batch.column("votes").to_pylist())]
            region, template, content = zip(*found) if found else ([], [], [])
            kept = [batch.column(c) for c in ("host", "layout", "pivot")]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(region, pa.int32()), pa.array(template, pa.list_(pa.int32())), pa.array(content, pa.list_(pa.int32()))], names=["host", "layout", "pivot", "region", "template", "content"])

    wrappers = pivots.join(votes, ["host", "layout"]).mapInArrow(decide, "host string, layout string, pivot string, region int, template array<int>, content array<int>")
    return stage(wrappers, "wrappers")


def read_page(source: str, wrapper: tuple | None, known: Pivots) -> str:
    """A page's main text by its group's wrapper (pivot, region, template, content), or by itself."""
    b = Tree(source)
    if wrapper is not None:
        pivot, region, template, content = wrapper
        a = known.get(pivot)
        elements, texts = align(a, b)
        match = dict(elements)
        if region in match:
            fixed = set(template)
            gone = {q for p, q in texts if p in fixed and a.texts[p] == b.texts[q]}
            gone = set(whole_blocks(b, gone)) if gone else gone
            return main_text(b, b.nodes[match[region]], gone, {match[k] for k in content if k in match})
    return main_text(b)


def extract(pages: DataFrame, wrappers: DataFrame | None = None) -> DataFrame:
    """One row per page: page_id, url, text, n_chars (code points).

    Null or empty html gives empty text; a page without a usable url, or alone
    in its group, is read by its own structure; null and repeated page_ids are
    ordinary rows; an empty table gives none; other columns are ignored.  Very
    long and very deep pages take time in proportion to their length.
    """
    ids = dict(pages.dtypes)
    rows = laid_out(pages)
    wrappers = induce(rows) if wrappers is None else wrappers
    rows = _beside(rows, wrappers, "left").select("page_id", "url", "html", "pivot", "region", "template", "content")

    @K.tidy
    def read(batches):
        known = Pivots()
        for batch in batches:
            columns = [batch.column(k).to_pylist() for k in range(2, 7)]
            texts = [read_page(source, None if wrapper[0] is None else wrapper, known) for source, *wrapper in zip(*columns)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return rows.mapInArrow(read, f"page_id {ids['page_id']}, url string, text string, n_chars long")
