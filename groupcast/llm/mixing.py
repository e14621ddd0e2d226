"""Mixing sources to target weights by a multivariate-hypergeometric splitting tree.

1. Sizes. A document's size is its number of words; a source's size is their sum.
2. Targets. Sources weigh 1, 2, 3, repeating, by code point with null last, and
   share the size of all; a target stops at CAP times its source's size and the
   excess is shared again by weight until none is above. In closed form: by
   rising CAP * size / weight the stopped sources come first, and a source stops
   if that ratio is at most (all - stopped before) / (weight from here on).
3. Blocks. A source's documents fall into blocks by a hash of (doc_id, text); a document of
   more than BLOCK_WORDS words is a block of its own. A
   target is ``floor(target / size)`` whole passes over the source plus a rest: the rest
   takes blocks in permuted order up to one that does not fit (the border), then of those from there
   on whole blocks that still fit, and at last of the next blocks those documents, in
   permuted order, that still fit. The plan of this is one row per source.
4. Tree. The block draws of all sources are split between the two halves of the
   output shards, each half again, down to single shards. At each node the left
   half gets a multivariate-hypergeometric draw: source by source the number of
   its draws that go left is hypergeometric in what is left of the node, by
   inversion of a hashed uniform. A source's permuted draws are then dealt to the shards
   in order of these quotas, so shards hold disjoint draws, and a shard's rows
   are put in order of a hash (``place``).

The tree works on one row per (node, source); the draws are never listed to split them.

Cases: a null text has size 0; null sources form one source; sources of size 0
get target 0; documents of size 0 are never taken; repeated rows are separate documents
with the same id; an empty table gives an empty mix; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from groupcast.llm.common import cut

CAP = 3
SHARDS = 64
BLOCK_WORDS = 50_000
LAST_BLOCKS = 4
SEED = 11


def words(col):
    """Number of ``[^\\x20\\x09-\\x0D]+`` in the text."""
    return F.coalesce(F.regexp_count(col, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def uniform(*cols):
    return (F.pmod(F.xxhash64(*cols), F.lit(1 << 52)).cast("double") + 0.5) / float(1 << 52)


def document_columns(of: str = "") -> dict:
    """doc_id, source, size and u, a hash that permutes documents."""
    doc_id = F.col(f"{of}doc_id").cast("long")
    return {
        "doc_id": doc_id,
        "source": F.col(f"{of}source").cast("string"),
        "size": words(F.col(f"{of}text")),
        "u": F.xxhash64(doc_id, F.col(f"{of}text"), F.lit(SEED)),
    }


def sized(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, source, size, u."""
    return docs.select(*[c.alias(n) for n, c in document_columns().items()])


def targets(rows: DataFrame) -> DataFrame:
    """One row per source: source, source_size, weight, target, passes, rest, blocks."""
    per = rows.groupBy("source").agg(F.sum("size").alias("source_size"))
    every = W.partitionBy(F.lit(1))  # one row per source
    rank = F.row_number().over(every.orderBy(F.col("source").asc_nulls_last())) - 1
    weighed = per.withColumn("weight", (rank % 3 + 1).cast("double")).withColumn("cap", CAP * F.col("source_size"))
    order = every.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    before = F.coalesce(F.sum("cap").over(order.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    from_here = F.sum("weight").over(order.rowsBetween(0, W.unboundedFollowing))
    level = (F.sum("source_size").over(every) - before) / from_here
    stopped = weighed.withColumn("level", level).withColumn("stops", F.col("cap") / F.col("weight") <= F.col("level"))
    # Past the stopped sources the level only falls: the first one's is the common level.
    common = F.max(F.when(~F.col("stops"), F.col("level"))).over(every)
    target = F.when(F.col("stops"), F.col("cap").cast("double")).otherwise(F.col("weight") * F.col("common"))
    passes = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0))
    return (
        stopped.withColumn("common", common)
        .withColumn("target", target)
        .withColumn("passes", F.least(passes, F.lit(CAP)).cast("int"))
        .withColumn("rest", F.col("target") - F.col("passes") * F.col("source_size"))
        .withColumn("blocks", F.greatest(F.lit(1), F.ceil(F.col("source_size") / BLOCK_WORDS)))
        .select("source", "source_size", "weight", "target", "passes", "rest", "blocks")
    )


def _place_blocks(df: DataFrame) -> DataFrame:
    """Adds block and ``turn``, the block's place in its source's permutation."""
    own = -1 - F.pmod(F.xxhash64("u", F.lit("own block")), F.lit((1 << 63) - 1))
    block = F.when(F.col("size") > BLOCK_WORDS, own).otherwise(F.pmod(F.xxhash64("u", F.lit("block")), F.col("blocks")))
    return df.withColumn("block", block).withColumn(
        "turn", F.xxhash64("block", F.coalesce("source", F.lit("")), F.lit(SEED))
    )


def draw_plan(rows: DataFrame) -> DataFrame:
    """targets() with what the rest takes: of each source the blocks before ``border_turn``, the blocks
    in ``border_blocks`` from there on, and the documents in ``border_us``.

    Blocks are ordered from one row per block; only LAST_BLOCKS blocks a source are ordered by document."""
    per_source = targets(rows)
    same = F.col("s.source").eqNullSafe(F.col("d.source"))
    placed = _place_blocks(
        rows.alias("d").join(per_source.alias("s"), same).select("d.*", "s.rest", "s.blocks")
    )
    blocks = cut(placed.groupBy("source", "block", "turn", "rest").agg(F.sum("size").alias("block_size")), "blocks")
    ahead = F.sum("block_size").over(W.partitionBy("source").orderBy("turn")) - F.col("block_size")
    border = cut(
        blocks.withColumn("ahead", ahead)
        .where("ahead <= rest and ahead + block_size > rest")
        .groupBy("source", "rest").agg(F.min("turn").alias("border_turn"), F.min_by("ahead", "turn").alias("ahead")),
        "border",
    )
    later = cut(
        blocks.alias("k").join(border.alias("b"), same_source("k", "b") & (F.col("k.turn") >= F.col("b.border_turn")))
        .where("block_size > 0").select("k.source", "k.block", "k.turn", "k.block_size"),
        "later",
    )
    border = _fill(border, later)
    open_blocks = later.alias("k").join(border.alias("b"), same_source("k", "b")).where(
        (F.col("k.block") >= 0) & ~F.array_contains("b.border_blocks", F.col("k.block"))
    )
    next_ = W.partitionBy("k.source").orderBy("k.turn", "k.block")
    last_blocks = open_blocks.withColumn("nth", F.row_number().over(next_)).where(F.col("nth") <= LAST_BLOCKS).select(
        "k.source", "k.block", "k.turn", "b.rest", "b.ahead"
    )
    inside = (
        placed.alias("d")
        .join(last_blocks.alias("b"), F.col("d.source").eqNullSafe(F.col("b.source")) & (F.col("d.block") == F.col("b.block")))
        .select("d.source", "d.doc_id", "d.u", "d.turn", "d.size", "b.rest", "b.ahead")
    )
    # What is open is less than any of these blocks: one fold per source takes, in permuted order, what still fits.
    start = F.struct(F.col("ahead").cast("double").alias("sum"), F.array().cast("array<bigint>").alias("out"))

    def take(state, x):
        fits = state["sum"] + x["size"] <= F.col("rest")
        return F.struct(
            (state["sum"] + F.when(fits, x["size"]).otherwise(F.lit(0))).alias("sum"),
            F.when(fits, F.array_append(state["out"], x["u"])).otherwise(state["out"]).alias("out"),
        )

    last = (
        inside.where("size > 0").groupBy("source", "rest", "ahead")
        .agg(F.sort_array(F.collect_list(F.struct("turn", "u", "size"))).alias("items"))
        .select("source", F.aggregate("items", start, take, lambda s: s["out"]).alias("border_us"))
    )
    return (
        per_source.alias("s")
        .join(border.alias("b"), same_source("s", "b"), "left")
        .join(last.alias("l"), same_source("s", "l"), "left")
        .select("s.*", "b.border_turn", "b.border_blocks", "l.border_us")
    )


def _fill(border: DataFrame, later: DataFrame) -> DataFrame:
    """border with border_blocks, whole blocks from the border on that fit, and their words added to ahead.

    A round takes the blocks that fit in order up to one that does not, or that one alone if it is
    larger than they are: what is open at least halves, so there are few rounds."""
    state = cut(border.withColumn("ahead", F.col("ahead").cast("long")).withColumn("border_blocks", F.array().cast("array<bigint>")), "fill")
    sum_ = F.sum("block_size").over(W.partitionBy("k.source").orderBy("k.turn", "k.block"))
    while True:
        fits = (F.col("block_size") <= F.col("rest") - F.col("ahead")) & ~F.array_contains("b.border_blocks", F.col("k.block"))
        run = later.alias("k").join(state.alias("b"), same_source("k", "b")).where(fits).withColumn("sum", sum_).select(
            "k.source", "k.block", "k.block_size", "sum", (F.col("sum") <= F.col("b.rest") - F.col("b.ahead")).alias("whole")
        )
        step = run.groupBy("source").agg(
            F.coalesce(F.max(F.when(F.col("whole"), F.col("sum"))), F.lit(0)).alias("words"),
            F.collect_list(F.when(F.col("whole"), F.col("block"))).alias("taken"),
            F.min_by(F.struct("block_size", "block"), F.when(~F.col("whole"), F.col("sum"))).alias("over"),
        )
        alone = F.coalesce(F.col("over.block_size") > F.col("words"), F.lit(False))
        step = cut(step.select(
            "source", F.when(alone, F.col("over.block_size")).otherwise(F.col("words")).alias("words"),
            F.when(alone, F.array("over.block")).otherwise(F.col("taken")).alias("taken"),
        ), "step")
        if step.isEmpty():
            return state
        state = cut(
            state.alias("b").join(step.alias("t"), same_source("b", "t"), "left").select(
                "b.source", "b.rest", "b.border_turn", (F.col("b.ahead") + F.coalesce("t.words", F.lit(0))).alias("ahead"),
                F.concat("b.border_blocks", F.coalesce("t.taken", F.array().cast("array<bigint>"))).alias("border_blocks"),
            ),
            "fill",
        )


def same_source(a: str, b: str):
    return F.col(f"{a}.source").eqNullSafe(F.col(f"{b}.source"))


def draws(rows: DataFrame, plan: DataFrame) -> DataFrame:
    """rows (with source, size, u) and their source's row of the plan, block, and ``copies``, how
    often the mix takes them. Needs no shuffle of the rows while the plan, one row per source, is small."""
    placed = _place_blocks(
        rows.alias("d").join(plan.alias("p"), same_source("d", "p"))
        .select("d.*", "p.source_size", "p.target", "p.passes", "p.blocks", "p.border_turn", "p.border_blocks", "p.border_us")
    )
    more = (
        F.col("border_turn").isNull()  # the rest is the whole source: only by rounding
        | (F.col("turn") < F.col("border_turn"))
        | (
            (F.col("turn") >= F.col("border_turn"))
            & (F.array_contains("border_blocks", F.col("block")) | F.coalesce(F.array_contains("border_us", F.col("u")), F.lit(False)))
        )
    )
    copies = F.least(F.lit(CAP), F.col("passes") + more.cast("int"))
    return placed.withColumn("copies", F.when(F.col("size") > 0, copies).otherwise(F.lit(0))).drop(
        "passes", "blocks", "turn", "border_turn", "border_blocks", "border_us"
    )


def hypergeometric(total, marked, drawn, u):
    """Inversion: the number of ``marked`` among ``drawn`` of ``total``, by uniform u.

    The ratio of neighbouring probabilities is followed from 12 standard deviations
    below the mean to 12 above; what lies outside weighs less than 1e-30."""
    mean = drawn * marked / F.greatest(total, F.lit(1.0))
    spread = F.sqrt(
        F.greatest(mean * (1 - marked / F.greatest(total, F.lit(1.0))) * (total - drawn) / F.greatest(total - 1, F.lit(1.0)), F.lit(0.0))
    )
    low = F.greatest(F.lit(0.0), drawn + marked - total, F.floor(mean - 12 * spread - 2).cast("double"))
    high = F.least(marked, drawn, F.ceil(mean + 12 * spread + 2).cast("double"))

    def ratio(k):  # P(k + 1) / P(k)
        return (marked - k) * (drawn - k) / ((k + 1) * F.greatest(total - marked - drawn + k + 1, F.lit(1.0)))

    ks = F.sequence(low.cast("long"), F.greatest(low, high).cast("long"))
    zero = F.struct(F.lit(1.0).alias("p"), F.lit(0.0).alias("sum"))

    def add(state, k):
        return F.struct((state["p"] * ratio(k.cast("double"))).alias("p"), (state["sum"] + state["p"]).alias("sum"))

    whole = F.aggregate(ks, zero, add, lambda s: s["sum"])
    seek = F.struct(F.lit(1.0).alias("p"), F.lit(0.0).alias("sum"), F.lit(0).cast("long").alias("k"))

    def find(state, k):
        after = state["sum"] + state["p"]
        return F.struct(
            (state["p"] * ratio(k.cast("double"))).alias("p"),
            after.alias("sum"),
            (state["k"] + F.when(after < u * state["whole"], 1).otherwise(0)).alias("k"),
            state["whole"].alias("whole"),
        )

    start = F.struct(seek["p"].alias("p"), seek["sum"].alias("sum"), seek["k"].alias("k"), whole.alias("whole"))
    passed = F.aggregate(ks, start, find, lambda s: s["k"])
    return F.least(low + passed.cast("double"), F.greatest(low, high))


def split_quotas(quotas: DataFrame, shards: int = SHARDS) -> DataFrame:
    """quotas (source, quota: number of its draws) to (source, shard, quota): the splitting tree.

    A node of n draws sends n // 2 left. Within a node the sources go by one
    after another; what they leave is a running sum over one row per source."""
    levels = (shards - 1).bit_length()
    nodes = quotas.select("source", F.lit(0).alias("node"), F.col("quota").cast("double").alias("quota"))
    for level in range(levels):
        # Sequential draw over the sources of a node, as one fold over an array of (source, quota).
        item = F.struct(F.col("source").isNull().alias("none"), "source", "quota")
        node = nodes.groupBy("node").agg(F.sort_array(F.collect_list(item)).alias("items"), F.sum("quota").alias("n"))
        kind = "array<struct<source:string,node:int,quota:double>>"
        start = F.struct(
            F.col("n").alias("total"), F.floor(F.col("n") / 2).cast("double").alias("left"), F.array().cast(kind).alias("out")
        )
        depth = F.lit(level)

        def step(state, x):
            u = uniform(F.coalesce(x["source"], F.lit("")), x["none"], F.col("node"), depth, F.lit(SEED))
            go = hypergeometric(state["total"], x["quota"], state["left"], u)
            halves = F.array(
                F.struct(x["source"].alias("source"), (F.col("node") * 2).alias("node"), go.alias("quota")),
                F.struct(x["source"].alias("source"), (F.col("node") * 2 + 1).alias("node"), (x["quota"] - go).alias("quota")),
            )
            return F.struct(
                (state["total"] - x["quota"]).alias("total"),
                (state["left"] - go).alias("left"),
                F.concat(state["out"], halves).alias("out"),
            )

        nodes = node.select(F.inline(F.aggregate("items", start, step, lambda s: s["out"])))
    return nodes.groupBy("source", F.pmod("node", F.lit(shards)).cast("int").alias("shard")).agg(
        F.sum("quota").cast("long").alias("quota")
    )


def mix(rows: DataFrame, plan: DataFrame, shards: int = SHARDS) -> DataFrame:
    """One row per document and pass of the mix, from sized() rows and their draw_plan(): doc_id, source,
    size, source_size, target, u, shard, block, pass, place. What is not taken has one row with pass 0
    and a null shard. Sorted by place within a shard, the rows are the shard's order."""
    taken = draws(rows, plan)
    passes = F.when(F.col("copies") > 0, F.sequence(F.lit(1), F.col("copies"))).otherwise(F.array(F.lit(0)))
    listed = taken.withColumn("pass", F.explode(passes))
    # A draw is one pass over one block; a source's draws are permuted and numbered.
    draw = (
        taken.where("copies > 0").groupBy("source", "block").agg(F.max("copies").alias("most"))
        .select("source", "block", F.explode(F.sequence(F.lit(1), F.col("most"))).alias("pass"))
    )
    by_hash = W.partitionBy("source").orderBy(F.xxhash64("block", "pass", F.lit("draw")), "block", "pass")
    draw = draw.withColumn("number", F.row_number().over(by_hash))
    quotas = split_quotas(draw.groupBy("source").agg(F.count("*").alias("quota")), shards)
    up_to = F.sum("quota").over(W.partitionBy("source").orderBy("shard"))
    # The shards of a source as one array of at most `shards` bounds: a draw finds its shard without a range join.
    bounds = quotas.withColumn("up_to", up_to).groupBy("source").agg(
        F.sort_array(F.collect_list(F.struct("shard", "up_to"))).alias("bounds")
    )
    to_shard = draw.alias("d").join(bounds.alias("q"), same_source("d", "q")).select(
        "d.source", "d.block", "d.pass",
        F.element_at(F.filter("q.bounds", lambda b: b["up_to"] >= F.col("d.number")), 1)["shard"].alias("shard"),
    )
    where = same_source("r", "t") & (F.col("r.block") == F.col("t.block")) & (F.col("r.pass") == F.col("t.pass"))
    return listed.alias("r").join(to_shard.alias("t"), where, "left").select(
        "r.doc_id", "r.source", "r.size", "r.source_size", "r.target", "r.u", "t.shard", "r.block", "r.pass",
        F.xxhash64("r.u", "r.pass", F.lit("place")).alias("place"),
    )


def per_document(mixed: DataFrame) -> DataFrame:
    """One row per document from the rows of mix(): doc_id, size, source_size, target, taken."""
    per = mixed.groupBy("doc_id", "u", "size", "source_size", "target").agg(
        F.sum(F.when(F.col("shard").isNotNull(), F.col("size")).otherwise(F.lit(0))).alias("all"),
        F.sum((F.col("pass") <= 1).cast("long")).alias("n"),  # rows that repeat an id and text
    )
    each = F.explode(F.array_repeat(F.expr("all div n"), F.col("n").cast("int")))
    return per.select("doc_id", "size", "source_size", "target", each.alias("taken"))


def mix_documents(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """docs as often as the mix takes them, the same columns: every row meets its source's row of the plan
    and is repeated, then the rows of a draw go to its shard and lie there in the order of their places."""
    rows = cut(sized(docs), "sizes")
    plan = cut(draw_plan(rows), "plan")
    draw = ["source", "block", "pass"]
    dealt = cut(mix(rows, plan, shards).where("shard is not null").select(*draw, "shard").distinct(), "dealt")
    whole = docs.select(F.struct(*docs.columns).alias("doc"))
    own = whole.select("doc", *[c.alias(n) for n, c in document_columns("doc.").items()])
    taken = draws(own, plan).where("copies > 0").withColumn("pass", F.explode(F.expr("sequence(1, copies)")))
    where = same_source("r", "t") & (F.col("r.block") == F.col("t.block")) & (F.col("r.pass") == F.col("t.pass"))
    placed = taken.alias("r").join(dealt.alias("t"), where).select(
        "r.doc", "t.shard", F.xxhash64("r.u", "r.pass", F.lit("place")).alias("place")
    )
    # A shard is as large as the data over `shards`: its rows go to several tasks by ranges of their places.
    return placed.repartitionByRange("shard", "place").sortWithinPartitions("shard", "place").select("doc.*")
