"""N-gram Jaccard join by signature trees: groups of documents linked at Jaccard >= PERCENT / 100.

A document's set is its distinct K-word shingles (fewer words: the whole sequence is one; none: empty,
linked with nothing), as 64-bit hashes. Equal sets are one class, read from a row with its smallest doc_id (``least``),
whose row number stands for the class (``node``). Before that row is known, half of the fingerprint names the class, so
signatures meet without a join of their documents.

Blocks. A pair at the threshold whose larger set has m shingles differs in at most
d = 2 * (100 - PERCENT) * m / (100 + PERCENT) of them. Sizes fall into classes (WIDTH apart); for a class with at most
d differences the hash range is cut into d + 1 + SPARE segments, so at least 1 + SPARE segments of the two
sets are equal: a document sends one signature per segment for every class in which it can be
part of a pair. Empty segments send one only if a document has more than SPARE of them (else an equal
segment that is not empty remains). So every linked pair shares a signature. Documents that share one are
joined in blocks (connected components of signature to its smallest holder), and all links lie within blocks.

Trees. A block's documents are dealt to pages of about PAGE documents. Over the documents of a page stands
a signature tree: leaves of LEAF documents, nodes above them, each with the OR and the AND of its
documents' token bitmaps and their range of sizes. Two nodes are walked together and left where no pair
below can reach the threshold: by sizes, or because bits that all on one side have and none on the other side has
bound the possible overlap. Pairs of documents already joined are skipped; the rest is verified on the sets.

Blocks of several pages go on in three steps, so that a hot block is spread and only unjoined
pairs are compared: each page by itself; then one document per component so found; then
pages arranged by component, whose OR bitmaps and size ranges decide which pairs of pages meet. Pairs of pages
of one and the same component are left out. No link between documents of unlike components is lost.

Cases: null and wordless texts have an empty set; a null doc_id links with nothing and its component is null; rows that
repeat a doc_id are one document (linked, whatever their texts), each with its own row; keep_one decides by texts
alone, so that no text leaves without a like one that stays; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from groupcast.llm.common import WordHashes, bit_filter, components, cut, free_name, mix64, shingle_hashes, small_batches, space_words

PERCENT = 90
K = 3
WIDTH = 1.25
SPARE = 2
PAGE = 256
PAGE_SHINGLES = 1 << 18
LEAF = 16
FAN = 4
BITMAP_WORDS = 32
FILTER_BITS = 1 << 23
#: Signatures that a task joins at a time
PART_SIGNATURES = 1 << 20


def size_bounds(most: int = 1 << 40) -> list[int]:
    """Lowest size of each class."""
    out = [1]
    while out[-1] < most:
        out.append(max(out[-1] + 1, int(out[-1] * WIDTH)))
    return out


BOUNDS = size_bounds()


def shingle_set(words: list[bytes], known: WordHashes, k: int = K) -> np.ndarray:
    """Sorted distinct hashes."""
    if not words:
        return np.empty(0, dtype=np.uint64)
    return np.unique(shingle_hashes(known.of(words), min(k, len(words))))


def segment_signatures(s: np.ndarray, percent: int = PERCENT) -> np.ndarray:
    """One hash per segment and size class in which a set of this size can be part of a pair."""
    n, out = len(s), []
    if not n:
        return np.empty(0, dtype=np.int64)
    first = np.searchsorted(BOUNDS, n, side="right") - 1
    last = np.searchsorted(BOUNDS, n * 100 // percent, side="right") - 1
    high = s >> np.uint64(32)
    sums = np.concatenate([[np.uint64(0)], np.cumsum(mix64(s), dtype=np.uint64)])
    for c in range(first, last + 1):
        d = 2 * (100 - percent) * (BOUNDS[c + 1] - 1) // (100 + percent)
        if not d:
            continue  # only equal sets
        k = d + 1 + SPARE
        at = np.searchsorted((high * np.uint64(k)) >> np.uint64(32), np.arange(k + 1))
        seg = np.arange(k, dtype=np.uint64) + np.uint64(c << 40)
        sig = mix64(mix64(seg + np.uint64(1)) ^ (sums[at[1:]] - sums[at[:-1]]))
        full = at[1:] > at[:-1]
        out.append(sig[full] if k - full.sum() <= SPARE else sig)
    return np.concatenate(out).astype(np.int64) if out else np.empty(0, dtype=np.int64)


def bitmaps(sets: list[np.ndarray], words: int = BITMAP_WORDS) -> np.ndarray:
    out = np.zeros((len(sets), words * 64), dtype=bool)
    for i, s in enumerate(sets):
        out[i, s % np.uint64(words * 64)] = True
    return np.packbits(out, axis=1).view(np.uint64)


def _lacking(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Number of bits of a that b has not, over the last axis."""
    return np.bitwise_count(a & ~b).sum(axis=-1, dtype=np.int64)


def can_link(all_a, any_a, low_a, high_a, all_b, any_b, low_b, high_b, percent=PERCENT):
    """Whether sets with these bits in common, any bits and sizes can reach the threshold (arrays broadcast).

    At least ``x`` shingles of each set of a are not in b and ``y`` the other way round, so the overlap is at
    most i = min(high_a - x, high_b - y) and the union at least i + x + y."""
    x, y = _lacking(all_a, any_b), _lacking(all_b, any_a)
    i = np.minimum(high_a - x, high_b - y)
    sizes = (100 * high_a >= percent * low_b) & (100 * high_b >= percent * low_a)
    return sizes & (100 * i >= percent * (i + x + y))


class Tree:
    """Levels of (OR bits, AND bits, least size, greatest size); level 0 is the documents in order of size."""

    def __init__(self, sets: list[np.ndarray], members: np.ndarray):
        sizes = np.array([len(sets[m]) for m in members], dtype=np.int64)
        order = np.argsort(sizes, kind="stable")
        self.members, sizes = members[order], sizes[order]
        bits = bitmaps([sets[m] for m in self.members])
        self.levels = [(bits, bits, sizes, sizes)]
        fan = LEAF
        while len(self.levels[-1][2]) > 1:
            any_, all_, low, high = self.levels[-1]
            cuts = np.arange(0, len(low), fan)
            self.levels.append(
                (
                    np.bitwise_or.reduceat(any_, cuts, axis=0), np.bitwise_and.reduceat(all_, cuts, axis=0),
                    np.minimum.reduceat(low, cuts), np.maximum.reduceat(high, cuts),
                )
            )
            self.fans = getattr(self, "fans", [0]) + [fan]
            fan = FAN

    def node(self, level: int, i) -> tuple:
        any_, all_, low, high = self.levels[level]
        return all_[i], any_[i], low[i], high[i]

    def below(self, level: int, i: int) -> range:
        fan = self.fans[level]
        return range(i * fan, min((i + 1) * fan, len(self.levels[level - 1][2])))


def dual_walk(a: Tree, b: Tree, link, percent: int = PERCENT) -> None:
    """Calls link(x, y) for every pair of members that the bounds cannot rule out."""
    same = a is b
    if not len(a.members) or not len(b.members):
        return
    stack = [(len(a.levels) - 1, 0, len(b.levels) - 1, 0)]
    while stack:
        la, i, lb, j = stack.pop()
        if not (la and lb):  # a single document on a side: its level is 0 at once
            xs = np.array([i]) if not la else np.array(a.below(la, i)) if la == 1 else None
            ys = np.array([j]) if not lb else np.array(b.below(lb, j)) if lb == 1 else None
            if xs is None:
                stack += [(la - 1, x, lb, j) for x in a.below(la, i)]
                continue
            if ys is None:
                stack += [(la, i, lb - 1, y) for y in b.below(lb, j)]
                continue
        else:
            if not can_link(*a.node(la, i), *b.node(lb, j), percent):
                continue
            if la > 1 or lb > 1:
                if la >= lb:
                    down = a.below(la, i)
                    if same and la == lb and i == j:
                        stack += [(la - 1, x, lb - 1, y) for x in down for y in down if x <= y]
                    else:
                        stack += [(la - 1, x, lb, j) for x in down]
                else:
                    stack += [(la, i, lb - 1, y) for y in b.below(lb, j)]
                continue
            xs, ys = np.array(a.below(1, i)), np.array(b.below(1, j))
        ax, bx = a.node(0, xs), b.node(0, ys)
        ok = can_link(*[v[:, None] for v in ax], *[v[None, :] for v in bx], percent)
        for x, y in np.argwhere(ok).tolist():
            p, q = int(xs[x]), int(ys[y])
            if not same or p < q:
                link(int(a.members[p]), int(b.members[q]))


def grouped(sets: list[np.ndarray], labels: list, sides: np.ndarray | None = None, percent: int = PERCENT) -> list[int]:
    """Place of each set's group: sets with equal labels and linked ones are together. Links are looked
    for where they join two groups, between the sides if given."""
    up = list(range(len(sets)))

    def root(x):
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    first: dict = {}
    for i, x in enumerate(labels):
        up[root(i)] = root(first.setdefault(x, i))

    def link(x, y):
        rx, ry = root(x), root(y)
        if rx == ry:
            return
        shared = len(np.intersect1d(sets[x], sets[y], assume_unique=True))
        if 100 * shared >= percent * (len(sets[x]) + len(sets[y]) - shared):
            up[rx] = ry

    everyone = np.arange(len(sets))
    if sides is None:
        tree = Tree(sets, everyone)
        dual_walk(tree, tree, link, percent)
    else:
        dual_walk(Tree(sets, everyone[sides == 0]), Tree(sets, everyone[sides == 1]), link, percent)
    return [root(i) for i in everyone]


def _sets_of(pdf: pd.DataFrame) -> list[np.ndarray]:
    return [np.frombuffer(x, dtype="<u8") for x in pdf["tokens"]]


def page_groups(pdf: pd.DataFrame) -> pd.DataFrame:
    """(node, comp) of a page: comp is the smallest node of the group."""
    at = grouped(_sets_of(pdf), pdf["node"].tolist())
    comp = pdf["node"].groupby(np.array(at)).transform("min")
    return pd.DataFrame({"node": pdf["node"], "comp": comp}).drop_duplicates()


def pair_links(pdf: pd.DataFrame) -> pd.DataFrame:
    """(x, y): components that a link between two pages, or within one, joins."""
    at = grouped(_sets_of(pdf), pdf["comp"].tolist(), pdf["side"].to_numpy() if pdf["sided"].iloc[0] else None)
    low = pdf["comp"].groupby(np.array(at)).transform("min")
    out = pd.DataFrame({"x": pdf["comp"], "y": low})
    return out[out["x"] != out["y"]].drop_duplicates()


SETS = "rid long, doc_id long, n long, fp binary, name long, sigs array<long>, low array<long>, a array<long>, b array<long>"


class Signatures:
    """The signatures of a part of a task, each with the smallest class name that holds it, and the edges between names
    that share one."""

    def __init__(self):
        self.sigs: list[np.ndarray] = []
        self.names: list[int] = []
        self.size = 0

    def add(self, sigs: np.ndarray, name: int) -> None:
        self.sigs.append(sigs)
        self.names.append(name)
        self.size += len(sigs)

    def take(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        sig = np.concatenate(self.sigs) if self.sigs else np.empty(0, dtype=np.int64)
        name = np.repeat(np.array(self.names, dtype=np.int64), [len(x) for x in self.sigs])
        order = np.lexsort((name, sig))
        sig, name = sig[order], name[order]
        first = np.flatnonzero(np.concatenate([[True], np.diff(sig) != 0])) if len(sig) else np.empty(0, np.int64)
        low = np.repeat(name[first], np.diff(np.append(first, len(sig))))
        meet = np.unique(np.stack([low, name])[:, low != name], axis=1)
        self.__init__()
        return sig[first], name[first], meet[0], meet[1]


def document_sets(docs: DataFrame, k: int = K, percent: int = PERCENT) -> DataFrame:
    """Written to the shared folder: per document rid, doc_id, n, fp (of the set; null if empty) and name (half of it);
    per PART_SIGNATURES of a task's signatures (rid null) sigs with the smallest name of each, and the pairs a, b of
    names that share one there. Documents without an id send none, equal sets of a task send theirs once."""
    def lists(columns):
        return [pa.array([c], pa.list_(pa.int64())) for c in columns]

    def run(batches):
        import xxhash

        known, sent, held = WordHashes(), set(), Signatures()
        names = [c.split()[0] for c in SETS.split(", ")]

        def part():
            nothing = [pa.nulls(1, t) for t in (pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int64())]
            return pa.RecordBatch.from_arrays([*nothing, *lists(held.take())], names=names)

        for b in batches:
            n, fp, name = [], [], []
            for text, doc_id in zip(b.column("text").to_pylist(), b.column("doc_id").to_pylist(), strict=True):
                s = shingle_set(space_words(text), known, k)
                mark = xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None
                n.append(len(s))
                fp.append(mark)
                name.append(None if mark is None else int.from_bytes(mark[:8], "little", signed=True))
                if mark is not None and doc_id is not None and mark not in sent:
                    sent.add(mark)  # 16 bytes a document of the task
                    held.add(segment_signatures(s, percent), name[-1])
            empty = [pa.nulls(len(n), pa.list_(pa.int64()))] * 4
            yield pa.RecordBatch.from_arrays(
                [b.column("rid"), b.column("doc_id"), pa.array(n, pa.int64()), pa.array(fp, pa.binary()), pa.array(name, pa.int64()), *empty], names=names)
            if held.size >= PART_SIGNATURES:
                yield part()
        if held.size:
            yield part()

    rows = docs.select(F.monotonically_increasing_id().alias("rid"), F.col("doc_id").cast("long").alias("doc_id"), "text")
    return cut(rows.mapInArrow(run, SETS), "sets")


def token_sets(docs: DataFrame, nodes: DataFrame, k: int = K) -> DataFrame:
    """nodes (node, least, fp, ..) with n and tokens, the sorted hashes of the document's set.

    Documents are chosen by a filter of fixed size before their texts are cut again; the join is exact."""
    spark = docs.sparkSession
    mask = spark.sparkContext.broadcast(np.packbits(bit_filter(nodes.select(F.xxhash64("least").alias("h")), "h", FILTER_BITS)))

    def run(batches):
        import xxhash

        known, bits = WordHashes(), np.unpackbits(mask.value).astype(bool)
        for b in batches:
            b = b.filter(pa.array(bits[b.column("at").to_numpy()]))
            sets = [shingle_set(space_words(t), known, k) for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [
                    b.column("least"), pa.array([xxhash.xxh3_128_digest(s.tobytes()) for s in sets], pa.binary()),
                    pa.array([len(s) for s in sets], pa.int64()), pa.array([s.tobytes() for s in sets], pa.binary()),
                ],
                names=["least", "fp", "n", "tokens"],
            )

    at = F.pmod(F.xxhash64(F.col("doc_id").cast("long")), F.lit(FILTER_BITS))
    rows = docs.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("least"), "text", at.alias("at"))
    sets = rows.mapInArrow(run, "least long, fp binary, n long, tokens binary")
    return nodes.drop("n").join(sets, ["least", "fp"]).dropDuplicates(["node"])


def _paged(members: DataFrame, keys: list[str]) -> DataFrame:
    """members (with node, n) with page, a part of its keys of about PAGE documents or PAGE_SHINGLES shingles."""
    wanted = F.greatest(F.ceil(F.count("*") / PAGE), F.ceil(F.sum("n") / PAGE_SHINGLES))
    pages = members.groupBy(*keys).agg(wanted.alias("pages"))
    return members.join(pages, keys).withColumn("page", F.pmod(F.xxhash64("node", F.lit("page")), F.col("pages")))


def page_pairs(members: DataFrame) -> DataFrame:
    """Pairs of pages (a, b: their ids; sided) that may hold links between unlike components.

    members: block, page (id), comp, n, tokens. A page's node has OR and AND bits and its size range."""

    def summary(pdf: pd.DataFrame) -> pd.DataFrame:
        bits = bitmaps([np.frombuffer(x, dtype="<u8") for x in pdf["tokens"]])
        return pd.DataFrame(
            {
                "block": [pdf["block"].iloc[0]], "page": [pdf["page"].iloc[0]],
                "low": [pdf["n"].min()], "high": [pdf["n"].max()], "c0": [pdf["comp"].min()], "c1": [pdf["comp"].max()],
                "any": [np.bitwise_or.reduce(bits, axis=0).tobytes()], "every": [np.bitwise_and.reduce(bits, axis=0).tobytes()],
            }
        )

    kind = "block long, page string, low long, high long, c0 long, c1 long, any binary, every binary"
    pages = cut(members.groupBy("page").applyInPandas(summary, kind), "pages")
    one = pages.where("c0 != c1").select(F.col("page").alias("a"), F.col("page").alias("b"), F.lit(False).alias("sided"))
    a, b = pages.alias("a"), pages.alias("b")
    near = a.join(
        b,
        F.expr(
            f"a.block = b.block and a.page < b.page and 100 * a.high >= {PERCENT} * b.low and 100 * b.high >= {PERCENT} * a.low"
            " and not (a.c0 = a.c1 and b.c0 = b.c1 and a.c0 = b.c0)"
        ),
    )
    flat = near.select(*[F.col(f"{t}.{c}").alias(f"{t}_{c}") for t in "ab" for c in ("page", "low", "high", "any", "every")])

    def prune(batches):
        for pdf in batches:
            side = [
                (
                    *(np.array([np.frombuffer(x, np.uint64) for x in pdf[f"{t}_{c}"]]).reshape(len(pdf), -1) for c in ("every", "any")),
                    pdf[f"{t}_low"].to_numpy(), pdf[f"{t}_high"].to_numpy(),
                )
                for t in "ab"
            ]
            kept = pdf[can_link(*side[0], *side[1])] if len(pdf) else pdf
            yield pd.DataFrame({"a": kept["a_page"], "b": kept["b_page"], "sided": True})

    return flat.mapInPandas(prune, "a string, b string, sided boolean").union(one)


def link_texts(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The rows (doc_id, n, fp) of docs (doc_id, text) and their classes (fp, least, top): top is the number of the
    group of linked classes. Empty sets have no class. Rows of one doc_id are linked by their texts only."""
    small_batches(docs.sparkSession)
    docs = docs.select("doc_id", "text")
    made = document_sets(docs)
    sets = made.where("rid is not null")
    first = sets.where("fp is not null and doc_id is not null").groupBy("fp").agg(F.min(F.struct("doc_id", "rid", "name", "n")).alias("m"))
    reps = cut(first.select("fp", F.col("m.doc_id").alias("least"), F.col("m.rid").alias("node"), "m.name", "m.n"), "classes")
    parts = made.where("rid is null")
    holders = parts.select(F.explode(F.arrays_zip("sigs", "low")).alias("z")).select(F.col("z.sigs").alias("sig"), F.col("z.low").alias("name"))
    # At most a row per task part and signature: a window holds one signature's.
    least = holders.withColumn("low", F.min("name").over(Window.partitionBy("sig")))
    meet = least.where("name != low").select(F.col("low").alias("a"), F.col("name").alias("b")).union(
        parts.select(F.explode(F.arrays_zip("a", "b")).alias("z")).select("z.a", "z.b")
    )
    blocks = components(meet.distinct()).select(F.col("node").alias("name"), F.col("root").alias("block"))
    # Who goes to which page is settled on narrow rows; the sets are joined to that once a step.
    nodes = cut(_paged(reps.join(blocks, "name").drop("name"), ["block"]), "nodes")
    members = cut(token_sets(docs, nodes), "members")

    # Each page by itself: a document is in one page, so its group there needs no further merging.
    inner = members.groupBy("block", "page").applyInPandas(page_groups, "node long, comp long")
    first = cut(inner.join(nodes.select("node", "block", "n", (F.col("pages") > 1).alias("more")), "node"), "first")
    # Blocks of several pages: one document per group, again a page each ...
    large = first.where("more").drop("more")
    tokens = members.where("pages > 1").select("node", "tokens")
    heads = _paged(large.where("node = comp").drop("comp"), ["block"])
    inner = tokens.join(heads, "node").groupBy("block", "page").applyInPandas(page_groups, "node long, comp long")
    bridge = cut(inner.select(F.col("node").alias("comp"), F.col("comp").alias("wide")), "bridge")
    # ... then pairs of pages that hold unlike groups.
    wide = large.join(bridge, "comp").drop("comp").withColumnRenamed("wide", "comp")
    counts = wide.groupBy("block", "comp").agg((F.count("*") >= PAGE // 2).alias("own"))
    wide = wide.join(counts, ["block", "comp"]).withColumn("pure", F.when(F.col("own"), F.col("comp")).otherwise(F.lit(-1)))
    places = _paged(wide.drop("own"), ["block", "pure"]).withColumn("page", F.concat_ws(":", "block", "pure", "page"))
    arranged = cut(tokens.join(places.select("node", "n", "comp", "block", "page"), "node"), "arranged")
    pairs = cut(page_pairs(arranged), "pairs")
    sides = pairs.select("a", "b", "sided", F.col("a").alias("page"), F.lit(0).alias("side")).union(
        pairs.where("sided").select("a", "b", "sided", F.col("b").alias("page"), F.lit(1).alias("side"))
    )
    met = sides.join(arranged.drop("block", "n"), "page").groupBy("a", "b").applyInPandas(pair_links, "x long, y long")
    roots = components(met.select(F.col("x").alias("a"), F.col("y").alias("b"))).select(F.col("node").alias("wide"), "root")
    groups = first.select("node", "comp").join(bridge, "comp", "left").join(roots, "wide", "left").select(
        "node", F.coalesce("root", "wide", "comp").alias("top")
    )
    top = reps.select("fp", "least", "node").join(groups, "node", "left").select("fp", "least", F.coalesce("top", "node").alias("top"))
    return sets.select("doc_id", "n", "fp"), top


def link_documents(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id for every row of docs (doc_id, text)."""
    rows, classes = link_texts(docs)
    classes = cut(classes, "groups")
    smallest = classes.groupBy("top").agg(F.min("least").alias("component"))
    linked = rows.join(classes.join(smallest, "top").select("fp", "component"), "fp", "left").select(
        "doc_id", "n", F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id")).alias("component")
    )
    linked = cut(linked, "linked")
    # Rows of one doc_id are linked too: their components meet in the smallest of them.
    several = linked.where("doc_id is not null").groupBy("doc_id").agg(
        F.min("component").alias("a"), F.max("component").alias("b")
    ).where("a < b")
    meet = linked.join(several.select("doc_id", "a"), "doc_id").where("component != a").select("a", F.col("component").alias("b"))
    roots = cut(components(meet.distinct()), "roots").withColumnRenamed("node", "component")
    return linked.join(roots, "component", "left").select(
        "doc_id", F.col("n").alias("n_shingles"), F.coalesce("root", "component").alias("component_id")
    )


def with_fingerprint(docs: DataFrame, name: str, k: int = K) -> DataFrame:
    """docs with a column more: the fingerprint of the text's set."""
    def run(batches):
        import xxhash

        known = WordHashes()
        for b in batches:
            sets = [shingle_set(space_words(t), known, k) for t in b.column("text").to_pylist()]
            fp = [xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None for s in sets]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(fp, pa.binary())], names=[*b.schema.names, name])

    small_batches(docs.sparkSession)
    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField(name, T.BinaryType())]))


def keep_one(docs: DataFrame) -> DataFrame:
    """docs with one row of each group of linked texts: one of the class that has the group's smallest doc_id, with
    that id. Of rows with an empty set one per doc_id stays, rows with a null id all stay. The same columns."""
    rows, classes = link_texts(docs)
    # The class that stays of each group, with the doc_id that keeps it.
    best = classes.groupBy("top").agg(F.min(F.struct("least", "fp")).alias("best")).select("best.fp", F.col("best.least").alias("keeper"))
    judged = rows.where("doc_id is not null").join(best, "fp", "left").select(
        "doc_id", "fp", (F.col("fp").isNull() | F.coalesce(F.col("doc_id") == F.col("keeper"), F.lit(False))).alias("stays")
    )
    judged = cut(judged, "judged")
    ids = cut(
        judged.groupBy("doc_id").agg(F.count("*").alias("n"), F.max("stays").alias("stays")).where("n > 1 or not stays"), "ids"
    )
    single = docs.join(ids.select("doc_id"), "doc_id", "left_anti").select(*docs.columns)
    # Rows of ids that repeat are told apart by their sets.
    again = ids.where("stays").select("doc_id")
    stay = judged.where("stays").join(again, "doc_id", "left_semi").select("doc_id", "fp").distinct()
    mark = free_name(docs, "fp")
    some = with_fingerprint(docs.join(again, "doc_id", "left_semi").select(*docs.columns), mark).dropDuplicates(["doc_id", mark])
    same = F.col("d.doc_id").eqNullSafe(F.col("s.doc_id")) & F.col(f"d.{mark}").eqNullSafe(F.col("s.fp"))
    return single.union(some.alias("d").join(stay.alias("s"), same, "left_semi").select(*docs.columns))
