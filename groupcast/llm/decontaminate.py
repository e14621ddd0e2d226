"""Benchmark decontamination by a prefix-filtered set join.

A window is WINDOW consecutive words of an item, or the whole of a shorter one. Its set is its
shingles of K words (a window of fewer words is one shingle). To hold a window a document must hold
all its shingles, so the necessary prefix is one shingle: the rarest by the number of occurrences in
all documents. Windows with a shingle that never occurs cannot occur and are dropped.

1. The shingles of all windows set bits of a filter of fixed size (BITS bits), which goes to all tasks.
2. One pass over the documents lists their shingles that pass the filter ("postings"), with the
   words around that a window could cover. Runs of postings too short for any window are left out.
3. Postings are counted per shingle; each window's rarest shingle is joined to the postings.
4. Positional bound: the window must start in the run; length bound: it must end there.
   What remains is verified word by word.
5. Hits of a document are laid over each other; words under any are counted once.

A document has at most one posting per word and shingle length, so work grows with the text.

Cases: null and wordless texts have no words and are never hit; wordless items have no windows; items with a
null id are not items; items that repeat an id are joined to one; rows that repeat a doc_id each get a row; a
document without words is not contaminated; empty tables give no rows or no hits; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from groupcast.llm.common import WordHashes, bit_filter, cut, plain_words, shingle_hashes, small_batches

WINDOW = 13
K = 5
BITS = 1 << 23


def item_windows(items: DataFrame, window: int = WINDOW, k: int = K) -> DataFrame:
    """item_id, words (the window, joined by spaces), length, shingles (hashes in order), k."""

    def run(batches):
        known = WordHashes()
        for b in batches:
            rows = []
            for item, text in zip(b.column("item_id").to_pylist(), b.column("text").to_pylist(), strict=True):
                words = plain_words(text)
                for at in range(max(1, len(words) - window + 1) if words else 0):
                    part = words[at : at + window]
                    size = min(k, len(part))
                    hashes = shingle_hashes(known.of(part), size).astype(np.int64).tolist()
                    rows.append((item, b" ".join(part).decode(), len(part), hashes, size))
            columns = list(zip(*rows, strict=True)) or [()] * 5
            kinds = [pa.int64(), pa.string(), pa.int32(), pa.list_(pa.int64()), pa.int32()]
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(columns, kinds, strict=True)],
                names=["item_id", "words", "length", "shingles", "k"],
            )

    rows = items.where("item_id is not null").select(F.col("item_id").cast("long").alias("item_id"), "text")
    return rows.mapInArrow(run, "item_id long, words string, length int, shingles array<long>, k int").distinct()


def nameless(of: str = ""):
    """What a row with a null doc_id is known by: a digest of its text; null for all others."""
    return F.when(F.col(f"{of}doc_id").isNull(), F.sha2(F.col(f"{of}text").cast("binary"), 256))


def postings(docs: DataFrame, windows: DataFrame, window: int = WINDOW, k: int = K) -> DataFrame:
    """One row per document: rid, doc_id, nameless, n_words, posts of (pos, shingle, words, ahead): the shingle at
    word ``pos`` and the words around it, of which ``ahead`` come before it. Written to the shared folder."""
    spark = docs.sparkSession
    small_batches(spark)
    lengths = windows.groupBy("k").agg(F.min("length").alias("least")).collect()  # k rows at most
    need = {r.k: r.least - r.k + 1 for r in lengths}  # postings in a row that the shortest window has
    mask = spark.sparkContext.broadcast(np.packbits(bit_filter(windows.select(F.explode("shingles").alias("h")), "h", BITS)))

    def run(batches):
        known, bits = WordHashes(), np.unpackbits(mask.value).astype(bool)
        size = np.uint64(len(bits))
        for b in batches:
            n_words, posts = [], []
            for text in b.column("text").to_pylist():
                words, mine = plain_words(text), []
                n_words.append(len(words))
                hashes = known.of(words)
                for kk, least in need.items():
                    sh = shingle_hashes(hashes, kk)
                    at = np.flatnonzero(bits[sh % size])
                    if not len(at):
                        continue
                    cuts = np.flatnonzero(np.diff(at) != 1) + 1
                    for r in np.split(at, cuts):
                        if len(r) < least:
                            continue
                        first, last = int(r[0]), int(r[-1]) + kk  # words of the run
                        for p in r.tolist():
                            lo, hi = max(first, p - (window - kk)), min(last, p + window)
                            if kk < k:
                                lo, hi = p, p + kk
                            mine.append(
                                {
                                    "pos": p,
                                    "shingle": int(sh[p].astype(np.int64)),
                                    "words": b" ".join(words[lo:hi]).decode(),
                                    "ahead": p - lo,
                                }
                            )
                posts.append(mine)
            kind = pa.list_(
                pa.struct([("pos", pa.int32()), ("shingle", pa.int64()), ("words", pa.string()), ("ahead", pa.int32())])
            )
            yield pa.RecordBatch.from_arrays(
                [b.column("rid"), b.column("doc_id"), b.column("nameless"), pa.array(n_words, pa.int64()), pa.array(posts, kind)],
                names=["rid", "doc_id", "nameless", "n_words", "posts"],
            )

    rows = docs.select(F.monotonically_increasing_id().alias("rid"), F.col("doc_id").cast("long").alias("doc_id"), nameless().alias("nameless"), "text")
    kind = "rid long, doc_id long, nameless string, n_words long, posts array<struct<pos:int,shingle:long,words:string,ahead:int>>"
    return cut(rows.mapInArrow(run, kind), "postings")


def find_hits(posts: DataFrame, windows: DataFrame) -> DataFrame:
    """rid, start, length, window: every occurrence of every window."""
    post = posts.select("rid", F.explode("posts").alias("p")).select("rid", "p.*")
    often = post.groupBy("shingle").agg(F.count("*").alias("often"))
    shape = windows.select("words", "length", "shingles").distinct()
    each = shape.select("words", "length", F.size("shingles").alias("n"), F.posexplode("shingles").alias("offset", "shingle"))
    prefix = (
        each.join(often, "shingle")
        .groupBy("words", "length", "n")
        .agg(F.count("*").alias("met"), F.min(F.struct("often", "offset", "shingle")).alias("rarest"))
        .where("met = n")
        .select(F.col("words").alias("window"), "length", "rarest.offset", "rarest.shingle")
    )
    start = F.col("ahead") - F.col("offset")
    around = F.split("words", " ")
    same = F.array_join(F.slice(around, start + 1, F.col("length")), " ") == F.col("window")
    return (
        post.join(prefix, "shingle")
        .where((start >= 0) & (start + F.col("length") <= F.size(around)))
        .where(same)
        .select("rid", (F.col("pos") - F.col("offset")).alias("start"), "length", "window")
        .distinct()
    )


def decontaminate(docs: DataFrame, items: DataFrame, window: int = WINDOW) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated for every row of docs."""
    return verdicts(docs, items, window).drop("nameless")


def verdicts(docs: DataFrame, items: DataFrame, window: int = WINDOW) -> DataFrame:
    """decontaminate() with the column nameless."""
    small_batches(docs.sparkSession)
    windows = cut(item_windows(items, window), "windows")
    posts = postings(docs, windows, window)
    hits = cut(find_hits(posts, windows), "hits")
    spans = hits.groupBy("rid", "start").agg(F.max(F.col("start") + F.col("length")).alias("end"))
    before = F.max("end").over(W.partitionBy("rid").orderBy("start").rowsBetween(W.unboundedPreceding, -1))
    fresh = F.greatest(F.lit(0), F.col("end") - F.greatest(F.col("start"), F.coalesce(F.col("before"), F.lit(0))))
    n_hit = spans.withColumn("before", before).groupBy("rid").agg(F.sum(fresh).alias("n_hit"))
    found = (
        hits.select("rid", "window").distinct()
        .join(windows.select(F.col("words").alias("window"), "item_id").distinct(), "window")
        .groupBy("rid").agg(F.sort_array(F.collect_set(F.col("item_id").cast("string"))).alias("items"))
    )
    hit = F.coalesce("n_hit", F.lit(0))
    names = F.coalesce("items", F.array().cast("array<string>"))
    return (
        posts.select("rid", "doc_id", "nameless", "n_words")
        .join(n_hit.join(found, "rid"), "rid", "left")
        .select(
            "doc_id", "nameless", "n_words", hit.cast("long").alias("n_hit"), F.size(names).cast("long").alias("n_items"),
            F.sha2(F.array_join(names, ",").cast("binary"), 256).alias("items_sha256"),
            ((hit > 0) & (20 * hit >= F.col("n_words"))).alias("contaminated"),
        )
    )


def drop_contaminated(docs: DataFrame, items: DataFrame) -> DataFrame:
    """docs without contaminated documents (an id goes if any of its rows is contaminated; a row with a
    null id goes if it is itself)."""
    bad = cut(verdicts(docs, items).where("contaminated").select("doc_id", "nameless").distinct(), "contaminated")
    same = F.col("d.doc_id").eqNullSafe(F.col("b.doc_id")) & nameless("d.").eqNullSafe(F.col("b.nameless"))
    return docs.alias("d").join(bad.alias("b"), same, "left_anti").select(*docs.columns)
