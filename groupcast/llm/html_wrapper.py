"""Main text of web pages by wrapper induction: simple tree matching of same-host pages.

A page is parsed to a tree of block elements; inline markup is transparent. Siblings with one label (tag and first
class or id) become one repeated node, its text that of the whole run: the page's pattern, whose text runs are nodes too.
Simple tree matching (align) of two trees with equal labels at the top is the heaviest alignment of their children
that keeps their order, each with the same for its children.

A host's pages are counted by pattern. Patterns merge one by one into the host's wrapper (merge): aligned nodes
become one, others are put in between. Each is then aligned with the whole wrapper, and its pages are counted at
the nodes it meets. A node is template if its text is the same on all its pages, at least ENOUGH and at least
half of the host's. A page's texts are template where the page, aligned with the wrapper, meets such nodes.

Nodes that align have equal labels up to the root, so labels on fewer pages than that cannot be template: a wrapper is merged
without them. Where pages disagree on the order of siblings, a wrapper gets a node in each place; of nodes with one label the one
with most pages stays. Patterns merge in groups of about LAYOUTS by their hash, then the groups, the most frequent first, of
these the largest, as it knows most of the order: neither the order of rows nor their partitions matter.

If a page has article or main elements, the largest of them is the content, else a container named so with half of
the text, else its body without lists that are mostly links. Elements that are no article by their tag or their class,
id or role go (menus, headers, footers, sidebars, notices, adverts, forms, comments; see FIXED). An article, main element or
named container keeps all else, also what other pages of the host repeat: headings shared by articles, near copies.
In a page without one the host's template goes. If that would leave nothing, it stays (a host of copies has no varying slot).

Text: character references decoded, white space in a block one space, trimmed, blocks in page order joined by a
newline. Cases: null, empty or tagless html gives its text, possibly empty; broken markup is closed where a new block
implies it, to any depth; null or odd urls form the host ''; a null page_id stays; repeated rows each get a row; empty table: no rows;
columns other than page_id, url, html are ignored.
"""

from __future__ import annotations

import html as entities
import re

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from groupcast.llm.common import cut, small_batches

ENOUGH = 3
HELD_NODES = 100_000
LAYOUTS = 256

# FIXED: markup rules. Elements whose text is never shown or never part of an article.
RAW = {"script", "style", "title", "textarea", "noscript", "template", "iframe", "xmp", "noembed", "noframes"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
INLINE = set(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span"
    " strike strong sub sup time tt u var".split()
)
DROPPED = set("head nav footer aside form button select option menu dialog svg math canvas audio video object fieldset".split())
CLOSES_P = set(
    "address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6"
    " header hgroup hr main menu nav ol p pre search section table ul body".split()
)
CLOSED_BY = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}}
SCOPE = {"ul", "ol", "table", "article", "main", "section", "nav", "aside", "footer", "header", "body", "html", "td", "th", "form"}
#: Words in class, id or role that mark what is not the article.
NOT_ARTICLE = set(
    "nav navbar navigation sidenav menu menubar submenu breadcrumb breadcrumbs sidebar rail footer masthead topbar ad ads adbox"
    " advert adverts advertisement advertising adsense sponsor sponsored promo promotion banner cookie cookies consent gdpr notice"
    " notices alert announcement popup modal overlay newsletter subscribe subscription signup login search share sharing social"
    " comment comments disqus replies respond responses reactions discussion related recommended recommendations widget"
    " pagination pager toolbar copyright disclaimer skip complementary contentinfo".split()
)
COMMENTS = {"comment", "comments", "disqus", "replies", "reply", "respond", "responses", "reactions", "discussion"}
#: Dropped outside of articles only: an article's own header holds its title.
OUTSIDE = {"header", "top"}
#: Words of a container that is the content if it holds at least half of the page's text and there is no article or main.
CONTAINER = {"article", "articlebody", "content", "entry", "main", "post", "story"}

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)(?:>|\Z)|[^<]+|<", re.S
)
_ATTRIBUTE = re.compile(r"(class|id|role|hidden|style|itemprop)\b(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+))?", re.I)
_WORD = re.compile(r"[a-z]+")


class Node:
    """An element: label, tag, children (elements and text blocks, as str, in order)."""

    __slots__ = ("children", "container", "dropped", "label", "links", "outside", "size", "tag")

    def __init__(self, tag: str, label: str, dropped: bool, words: frozenset = frozenset()):
        self.tag, self.label, self.dropped = tag, label, dropped
        self.outside = tag == "header" or bool(words & OUTSIDE)
        self.container = bool(words & CONTAINER)
        self.children: list = []
        self.links = 0  # characters of text inside links, of the whole element once it is measured
        self.size = 0  # characters of text that is not dropped


def _element(tag: str, attributes: str) -> Node:
    names: list[str] = []
    first = ""
    dropped = tag in DROPPED
    if attributes and not attributes.isspace():
        for name, value in _ATTRIBUTE.findall(attributes):
            name, value = name.lower(), value.strip("\"'").lower()
            if name == "hidden" or (name == "style" and "display:none" in value.replace(" ", "")):
                dropped = dropped or tag not in ("html", "body")
            elif name in ("class", "id", "role"):
                names += _WORD.findall(value)
                if value and not first:
                    first = re.sub(r"\d+", "", value.split()[0])
    words = frozenset(names)
    if words:
        if tag in ("article", "main", "html", "body"):
            dropped = dropped or (tag == "article" and bool(words & COMMENTS))
        else:
            dropped = dropped or bool(words & NOT_ARTICLE)
    return Node(tag, f"{tag}.{first}" if first else tag, dropped, words)


def parse(text: str | None) -> Node:
    """The page as a tree; block texts are raw (references not decoded)."""
    root = Node("html", "html", False)
    stack, buffer, in_link = [root], [], False
    raw = text or ""
    at, size = 0, len(raw)

    def flush():
        if buffer:
            joined = "".join(buffer)
            buffer.clear()
            if not joined.isspace():
                stack[-1].children.append(joined)

    def close(tags, scope=True):
        for k in range(len(stack) - 1, 0, -1):
            if stack[k].tag in tags:
                flush()
                del stack[k:]
                return
            if scope and stack[k].tag in SCOPE:
                return

    while at < size:
        m = _TOKEN.match(raw, at)
        at = m.end()
        tag = m[2]
        if tag is None:
            piece = m[0]
            if piece[0] != "<" or piece == "<":
                buffer.append(piece)
                if in_link:
                    stack[-1].links += len(piece)
            continue
        tag = tag.lower()
        if m[1]:
            if tag in INLINE:
                in_link = in_link and tag != "a"
            elif tag == "br":
                buffer.append(" ")
            elif tag not in ("html", "body"):
                close({tag}, scope=False)
            continue
        if tag in RAW:
            end = re.compile(f"</{re.escape(tag)}(?=[\\s/>])[^>]*(?:>|\\Z)", re.I).search(raw, at)
            at = end.end() if end else size
            continue
        if tag in INLINE:
            in_link = in_link or tag == "a"
            continue
        if tag in ("br", "wbr", "img"):
            if tag != "wbr":
                buffer.append(" ")
            continue
        if tag == "html":
            continue
        if tag in CLOSES_P:
            close({"p"})
        if tag in CLOSED_BY:
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].tag in CLOSED_BY[tag]:
                    flush()
                    del stack[k:]
                    break
                if stack[k].tag in ("ul", "ol", "dl", "table"):
                    break
        if tag == "body" and len(stack) > 1 and stack[-1].tag == "head":
            flush()
            stack.pop()
        flush()
        if tag in VOID:
            continue
        node = _element(tag, m[3])
        stack[-1].children.append(node)
        stack.append(node)
        if m[3].endswith("/") and tag in ("svg", "math"):
            stack.pop()
    flush()
    _measure(root)
    return root


def _measure(root: Node) -> None:
    """Sizes and link characters of all elements: children come after their parents in the list."""
    order = [root]
    for node in order:
        order += [c for c in node.children if isinstance(c, Node)]
    for node in reversed(order):
        for c in node.children:
            if isinstance(c, str):
                node.size += len(c.strip())
            else:
                node.size += c.size
                node.links += c.links
        if node.dropped:
            node.size = 0


def clean(text: str) -> str:
    return " ".join(entities.unescape(text).split())


# ---------------------------------------------------------------- patterns and wrappers
# The path of a node is a hash of the labels from the root. A pattern's or a wrapper's node is [path, pages, digest of its text
# or None, children]: below aligned nodes, paths are equal where labels are.
ROOT = 0
TEXT = "#"
#: A wrapper's column, for Spark and for Arrow.
WRAPPER = "array<struct<above:int,path:long,n:long>>"
NODES = pa.list_(pa.struct([("above", pa.int32()), ("path", pa.int64()), ("n", pa.int64())]))


def path(above: int, label: str) -> int:
    return xxhash.xxh3_64_intdigest(label.encode("utf-8", "surrogatepass"), above) >> 1


def pattern(root: Node) -> tuple[list, list[tuple[int, int, int | None]]]:
    """The page's tree of repeated nodes, and the same as rows: path above, path, digest of text, parents first.
    A node's children are in the order in which the page first has them."""
    top = [path(ROOT, root.label), 0, None, []]
    made: dict[int, list] = {top[0]: top}
    runs: dict[int, list[str]] = {}
    above = {top[0]: ROOT}
    stack: list = [(root, top)]
    while stack:
        node, at = stack.pop()
        if isinstance(node, str):
            runs[at[0]].append(clean(node))
            continue
        found = []
        for c in node.children:
            name = path(at[0], TEXT if isinstance(c, str) else c.label)
            child = made.get(name)
            if child is None:
                child = made[name] = [name, 0, None, []]
                above[name] = at[0]
                at[3].append(child)
                if isinstance(c, str):
                    runs[name] = []
            found.append((c, child))
        stack += reversed(found)
    for name, texts in runs.items():
        made[name][2] = path(ROOT, "\n".join(texts))
    return top, [(above[x[0]], x[0], x[2]) for x in _in_order(top)]


def _in_order(top: list) -> list[list]:
    """The tree's nodes, each before its children, these in order."""
    out, stack = [], [top]
    while stack:
        node = stack.pop()
        out.append(node)
        stack += reversed(node[3])
    return out


def _tree(rows: list[dict], n: int) -> list:
    """The tree of a pattern's rows (path above, path), parents first; n pages have it."""
    made: dict[int, list] = {}
    for r in rows:
        node = made[r["path"]] = [r["path"], n, None, []]
        if r["above"] in made:
            made[r["above"]][3].append(node)
    return made[rows[0]["path"]]


def pack(wrapper: list) -> list[dict]:
    """The wrapper's nodes in order: place of the node above (-1: none), path, pages."""
    nodes = _in_order(wrapper)
    above = {id(nodes[0]): -1}
    for place, node in enumerate(nodes):
        above.update((id(c), place) for c in node[3])
    return [{"above": above[id(x)], "path": x[0], "n": x[1]} for x in nodes]


def unpack(rows: list[dict]) -> tuple[list, list[list]]:
    """The wrapper and its nodes by place."""
    nodes = [[r["path"], r["n"], None, []] for r in rows]
    for node, r in zip(nodes[1:], rows[1:], strict=True):
        nodes[r["above"]][3].append(node)
    return nodes[0], nodes


def _heaviest(pairs: list[tuple[int, int, int]], weight: list[int], size: int) -> tuple[int, list]:
    """Of pairs (i, j, k), i ascending, the chain of greatest weight[k] in which i and j both rise."""
    if all(p[0] < q[0] and p[1] < q[1] for p, q in zip(pairs, pairs[1:], strict=False)):
        return sum(weight[k] for _, _, k in pairs), pairs
    best: list[tuple[int, int]] = [(0, -1)] * (size + 1)  # binary indexed tree over j: weight of a chain, its last pair
    before = [-1] * len(pairs)
    for e in sorted(range(len(pairs)), key=lambda e: (pairs[e][0], -pairs[e][1])):  # of one i, at most one j
        _, j, k = pairs[e]
        top, at = (0, -1), j
        while at:
            if best[at][0] > top[0]:
                top = best[at]
            at &= at - 1
        before[e] = top[1]
        top, at = (top[0] + weight[k], e), j + 1
        while at <= size:
            if top[0] > best[at][0]:
                best[at] = top
            at += at & -at
    top, at = (0, -1), size
    while at:
        if best[at][0] > top[0]:
            top = best[at]
        at &= at - 1
    chain, e = [], top[1]
    while e >= 0:
        chain.append(pairs[e])
        e = before[e]
    return top[0], chain[::-1]


def align(a: list, b: list) -> tuple[int, list[tuple[list, list]]]:
    """Simple tree matching of two trees ([label, _, _, children]) with equal labels: its weight, the number of matched nodes,
    and the matched (node of a, node of b), parents first. Of alignments of one weight the first found counts."""
    order, inner = [(a, b)], []
    for x, y in order:  # grows: all pairs of nodes whose labels agree up to the top
        places: dict = {}
        for j, d in enumerate(y[3]):
            places.setdefault(d[0], []).append(j)
        found = []
        for i, c in enumerate(x[3]):
            for j in places.get(c[0], ()):
                found.append((i, j, len(order)))
                order.append((c, y[3][j]))
        inner.append(found)
    weight = [1] * len(order)
    for k in range(len(order) - 1, -1, -1):
        if inner[k]:
            total, inner[k] = _heaviest(inner[k], weight, len(order[k][1][3]))
            weight[k] += total
    matched, stack = [], [0]
    while stack:
        k = stack.pop()
        matched.append(order[k])
        stack += [p[2] for p in reversed(inner[k])]
    return weight[0], matched


def merge(wrapper: list, other: list) -> None:
    """Merges another tree of the host into the wrapper: aligned nodes add their pages, the others come between them."""
    matched = align(wrapper, other)[1]
    of_other = {id(y): x for x, y in matched}
    for x, y in matched:
        x[1] += y[1]
        children, at = [], 0
        places = {id(c): i for i, c in enumerate(x[3])}
        for c in y[3]:
            same = of_other.get(id(c))
            if same is None:
                children.append(c)
            else:
                place = places[id(same)] + 1
                children += x[3][at:place]
                at = place
        x[3] = children + x[3][at:]


def settle(wrapper: list) -> None:
    """Leaves one of sibling nodes with one label: the first of those with most pages."""
    stack = [wrapper]
    while stack:
        node = stack.pop()
        best: dict[int, list] = {}
        for c in node[3]:
            if c[0] not in best or c[1] > best[c[0]][1]:
                best[c[0]] = c
        node[3] = [c for c in node[3] if best[c[0]] is c]
        stack += node[3]


def template_of(root: Node, wrapper: list, constant: set[int]) -> set[int]:
    """Paths of the page's elements whose own text meets a node of the wrapper that is constant (by id)."""
    page, rows = pattern(root)
    above = {at: over for over, at, _ in rows}
    return {above[x[0]] for x, y in align(page, wrapper)[1] if id(y) in constant}


def main_text(root: Node, template: set[int]) -> str:
    """The page's text; ``template``: the paths of elements whose own text is the host's template."""
    content = _content(root)

    def blocks(drop: bool) -> list[str]:
        out: list[str] = []
        stack: list = [(root, path(ROOT, root.label), False, False)]
        while stack:
            node, at, inside, article = stack.pop()
            if isinstance(node, str):
                if inside and not (drop and not article and at in template):
                    out.append(clean(node))
                continue
            if node.dropped or (node.outside and not article) or (not article and _link_list(node)):
                continue
            inside = inside or node is content
            article = article or node.tag in ("article", "main") or (node is content and node is not root)
            stack += [(c, at if isinstance(c, str) else path(at, c.label), inside, article) for c in reversed(node.children)]
        return out

    out = blocks(bool(template))
    if template and not any(out):
        out = blocks(False)
    return "\n".join(x for x in out if x)


def _content(root: Node) -> Node:
    """The largest article or main element that is not dropped; else the innermost container with
    at least half of the text; else the root."""
    best, size = root, 0
    inner, least = root, root.size / 2
    stack = [root]
    while stack:
        node = stack.pop()
        if node.dropped or node.outside:
            continue
        if node.tag in ("article", "main"):
            if node.size > size:
                best, size = node, node.size
            continue
        if node.container and node.size >= least > 0:
            inner, least = node, max(least, node.size / 2)
        stack += [c for c in reversed(node.children) if isinstance(c, Node)]
    return best if size else inner


def _link_list(node: Node) -> bool:
    return node.tag in ("ul", "ol", "table", "dl") and node.links * 2 > node.size > 0


def host(url):
    return F.coalesce(F.lower(F.regexp_extract(url, r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//(?:[^/@]*@)?([^/:?#]*)", 1)), F.lit(""))


def _count(pages: DataFrame) -> DataFrame:
    """(host, layout, place, above, path, n, low, high): the nodes of each pattern of a host, its pages, and
    the least and greatest digest of the node's text on them (null: the node is an element)."""

    def read(batches):
        held: dict[tuple, list] = {}  # (host, layout): pages, rows of the pattern, least and greatest digests
        size = 0

        def out():
            hosts, layouts = zip(*held, strict=True) if held else ((), ())
            n, rows, low, high = zip(*held.values(), strict=True) if held else ((), (), (), ())
            longs = pa.list_(pa.int64())
            columns = [
                pa.array(hosts, pa.string()), pa.array(layouts, pa.int64()), pa.array(n, pa.int64()),
                pa.array([[r[0] for r in x] for x in rows], longs), pa.array([[r[1] for r in x] for x in rows], longs),
                pa.array(low, longs), pa.array(high, longs),
            ]
            held.clear()
            return pa.RecordBatch.from_arrays(columns, names=["host", "layout", "n", "above", "path", "low", "high"])

        for b in batches:
            for name, text in zip(b.column("host").to_pylist(), b.column("html").to_pylist(), strict=True):
                rows = pattern(parse(text))[1]
                key = name, path(ROOT, ",".join(str(r[1]) for r in rows))
                texts = [r[2] for r in rows]
                had = held.get(key)
                if had is None:
                    held[key] = [1, rows, texts, texts]
                    size += len(rows)
                else:
                    had[0] += 1
                    had[2] = [x if x is None else min(x, y) for x, y in zip(had[2], texts, strict=True)]
                    had[3] = [x if x is None else max(x, y) for x, y in zip(had[3], texts, strict=True)]
            if size > HELD_NODES:
                yield out()
                size = 0
        yield out()

    kind = "host string, layout long, n long, above array<long>, path array<long>, low array<long>, high array<long>"
    parts = pages.select(host(F.col("url")).alias("host"), "html").mapInArrow(read, kind)
    rows = parts.select("host", "layout", "n", F.posexplode(F.arrays_zip("above", "path", "low", "high")).alias("place", "r"))
    rows = rows.select("host", "layout", "place", "n", "r.above", "r.path", "r.low", "r.high")
    return rows.groupBy("host", "layout", "place", "above", "path").agg(
        F.sum("n").alias("n"), F.min("low").alias("low"), F.max("high").alias("high")
    )


def _fold(trees: DataFrame, keys: list[str], tie: str) -> DataFrame:
    """Merges the trees of each key one after another, the most frequent and largest first: (keys, wrapper)."""

    def run(batches):
        key, wrapper = None, None

        def out():
            settle(wrapper)
            columns = [*(pa.array([k]) for k in key), pa.array([pack(wrapper)], NODES)]
            return pa.RecordBatch.from_arrays(columns, names=[*keys, "wrapper"])

        for b in batches:
            for row in b.to_pylist():
                tree = unpack(row["wrapper"])[0]
                this = tuple(row[k] for k in keys)
                if this == key:
                    merge(wrapper, tree)
                    continue
                if key is not None:
                    yield out()
                key, wrapper = this, tree
        if key is not None:
            yield out()

    kinds = {"host": "string", "salt": "long"}
    schema = ", ".join([*(f"{k} {kinds[k]}" for k in keys), f"wrapper {WRAPPER}"])
    order = [*keys, F.col("wrapper")[0]["n"].desc(), F.size("wrapper").desc(), tie]
    return trees.repartition(*keys).sortWithinPartitions(*order).select(*keys, "wrapper").mapInArrow(run, schema)


def induce(pages: DataFrame) -> DataFrame:
    """(host, wrapper, template): one row per host with template, its wrapper and the places in it of the texts that are
    constant on at least ENOUGH and at least half of its pages."""
    small_batches(pages.sparkSession)
    nodes = cut(_count(pages), "patterns")
    of_host = nodes.where("place = 0").groupBy("host").agg(F.sum("n").alias("pages")).where(F.col("pages") >= ENOUGH)
    # At most twice as many paths as a page of the host has nodes on average.
    often = nodes.groupBy("host", "path").agg(F.sum("n").alias("met")).join(of_host, "host")
    often = cut(often.where((F.col("met") >= ENOUGH) & (F.col("met") * 2 >= F.col("pages"))).select("host", "path"), "paths")
    nodes = nodes.join(often, ["host", "path"])
    row = F.struct("place", "above", "path")
    trees = nodes.groupBy("host", "layout").agg(F.max("n").alias("n"), F.sort_array(F.collect_list(row)).alias("rows"))
    tree = F.transform("rows", lambda r: F.struct(r["above"].alias("above"), r["path"].alias("path")))
    trees = cut(trees.withColumn("rows", tree), "trees")

    def packed(batches):
        for b in batches:
            made = [pack(_tree(rows, n)) for rows, n in zip(b.column("rows").to_pylist(), b.column("n").to_pylist(), strict=True)]
            columns = [*(b.column(name) for name in ("host", "salt", "layout")), pa.array(made, NODES)]
            yield pa.RecordBatch.from_arrays(columns, names=["host", "salt", "layout", "wrapper"])

    shapes = trees.groupBy("host", "rows").agg(F.sum("n").alias("n")).withColumn("layout", F.xxhash64("rows"))
    shapes = cut(shapes, "shapes")
    groups = shapes.groupBy("host").agg(F.ceil(F.count("*") / LAYOUTS).alias("groups"))
    shapes = shapes.join(groups, "host").withColumn("salt", F.pmod("layout", "groups"))
    shapes = shapes.select("host", "salt", "layout", "rows", "n")
    shapes = shapes.mapInArrow(packed, f"host string, salt long, layout long, wrapper {WRAPPER}")
    wrappers = cut(_fold(_fold(shapes, ["host", "salt"], "layout"), ["host"], "salt"), "wrappers")

    def meet(batches):
        """(host, layout, path, slot): the wrapper's places that the nodes of a pattern meet."""
        for b in batches:
            hosts, layouts, paths, slots = [], [], [], []
            for r in b.to_pylist():
                top, by_place = unpack(r["wrapper"])
                place = {id(x): i for i, x in enumerate(by_place)}
                for x, y in align(_tree(r["rows"], r["n"]), top)[1]:
                    hosts.append(r["host"])
                    layouts.append(r["layout"])
                    paths.append(x[0])
                    slots.append(place[id(y)])
            columns = [pa.array(hosts, pa.string()), *(pa.array(x, pa.int64()) for x in (layouts, paths)), pa.array(slots, pa.int32())]
            yield pa.RecordBatch.from_arrays(columns, names=["host", "layout", "path", "slot"])

    met = trees.join(wrappers, "host").select("host", "layout", "rows", "n", "wrapper")
    met = met.mapInArrow(meet, "host string, layout long, path long, slot int")
    met = met.join(nodes.where("low is not null"), ["host", "layout", "path"])
    slots = met.groupBy("host", "slot").agg(F.sum("n").alias("met"), F.min("low").alias("low"), F.max("high").alias("high"))
    slots = slots.join(of_host, "host").where((F.col("met") >= ENOUGH) & (F.col("met") * 2 >= F.col("pages")))
    template = slots.where("low = high").groupBy("host").agg(F.sort_array(F.collect_list("slot")).alias("template"))
    return cut(wrappers.join(template, "host"), "templates")


def extract(pages: DataFrame, templates: DataFrame | None = None) -> DataFrame:
    """page_id, url, text, n_chars for every row of pages (page_id, url, html)."""
    small_batches(pages.sparkSession)
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), "html")
    templates = induce(rows) if templates is None else templates
    joined = rows.withColumn("host", host(F.col("url"))).join(templates, "host", "left")

    def run(batches):
        for b in batches:
            texts, held = [], {}  # a batch's wrappers by host
            for i, (name, text) in enumerate(zip(b.column("host").to_pylist(), b.column("html").to_pylist(), strict=True)):
                if name not in held:
                    rows, places = b.column("wrapper")[i].as_py(), b.column("template")[i].as_py()
                    top, nodes = unpack(rows) if rows else (None, [])
                    held[name] = top, {id(nodes[k]) for k in places or ()}
                root = parse(text)
                texts.append(main_text(root, template_of(root, *held[name]) if held[name][0] else set()))
            yield pa.RecordBatch.from_arrays(
                [b.column("page_id"), b.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
                names=["page_id", "url", "text", "n_chars"],
            )

    flat = joined.select("page_id", "url", "html", "host", "wrapper", "template")
    return flat.mapInArrow(run, "page_id long, url string, text string, n_chars long")
