"""Secret scans: patterns plus sliding-window Shannon entropy per character class.

Base spans come from three patterns (assign, access, hex; see FIXED). The method
adds ``entropy`` spans: candidate strings are runs of at least WINDOW characters
of ``[A-Za-z0-9+/_=-]``; each is put in the narrowest character class that
holds it, and a window of WINDOW characters slides over it. Counts of the characters in the
window are kept incrementally (one comes in, one goes out), and with them the sum of
c * log2(c), which gives the window's entropy. A candidate is a secret if its highest window
reaches the class's threshold. Suppressed are candidates on the allow list (see
ALLOW), candidates without both a digit and a letter, and candidates that touch a base span.

Spans are in code points, end exclusive. Everything is DataFrame functions: gaps and matches
of a pattern (split and extract) give the places by adding up their lengths.

Cases: a null or empty text has no spans; every occurrence counts, ties go by kind as
listed; repeated rows each get a row; other columns are ignored. Texts are read whole.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

WINDOW = 20

# FIXED: patterns of the base spans, and what a match must have to count.
ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{14,}"  # the run is taken whole, so 18+ characters in all
HEX = r"[0-9a-f]{16,}"

CANDIDATE = r"[A-Za-z0-9+/_=-]{20,}"
#: class, what all its characters are, least entropy (bits) of the best window of WINDOW characters
CLASSES = [
    ("lower hex", r"^[0-9a-f-]+$", 2.8),
    ("upper hex", r"^[0-9A-F-]+$", 2.8),
    ("one case", r"^(?:[0-9a-z_=-]+|[0-9A-Z_=-]+)$", 3.4),
    ("mixed", r"^[A-Za-z0-9+/_=-]+$", 3.7),
]
#: Not secrets: UUIDs; dates and numbers with separators; paths and identifiers made of words
#: and short numbers; published example keys.
ALLOW = (
    r"^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}$"
    r"|^[0-9/_=+-]+$"
    r"|^(?:[A-Za-z]+|[0-9]{1,4})(?:[/_=+-]+(?:[A-Za-z]+|[0-9]{1,4}))*[/_=+-]*$"
    r"|(?i:example)"
)


def matches(text, pattern: str):
    """All leftmost matches, as an array of (s, e, m): code point places and the match."""
    gaps = F.transform(F.split(text, pattern, -1), lambda g: F.char_length(g))
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    start = F.struct(
        F.lit(0).alias("at"),
        F.lit(0).alias("i"),
        F.array().cast("array<struct<s:int,e:int,m:string>>").alias("out"),
    )

    def step(state, pair):
        s = state["at"] + pair["gap"]
        e = s + F.char_length(pair["m"])
        row = F.struct(s.alias("s"), e.alias("e"), pair["m"].alias("m"))
        return F.struct(e.alias("at"), (state["i"] + 1).alias("i"), F.concat(state["out"], F.array(row)).alias("out"))

    # One gap more than matches: the last is not needed.
    pairs = F.zip_with(F.slice(gaps, F.lit(1), F.size(found)), found, lambda g, m: F.struct(g.alias("gap"), m.alias("m")))
    return F.when(F.size(found) > 0, F.aggregate(pairs, start, step, lambda s: s["out"])).otherwise(
        F.array().cast("array<struct<s:int,e:int,m:string>>")
    )


def _clog(c):
    return F.when(c > 1, c * F.log2(c.cast("double"))).otherwise(F.lit(0.0))


def best_window_entropy(text, window: int = WINDOW):
    """Highest Shannon entropy (bits) over the windows of this many characters."""
    codes = F.transform(F.split(text, ""), lambda c: F.ascii(c))
    # Each character with the one that leaves the window as it comes in (-1: none).
    before = F.slice(F.concat(F.array_repeat(F.lit(-1), window), codes), F.lit(1), F.size(codes))
    pairs = F.zip_with(codes, before, lambda c, g: F.struct(c.alias("came"), g.alias("gone")))
    zero = F.struct(
        F.array_repeat(F.lit(0), 128).alias("counts"), F.lit(0.0).alias("sum"), F.lit(1e9).alias("least"), F.lit(0).alias("i")
    )

    def step(state, x):
        came, gone = x["came"], x["gone"]
        c = F.element_at(state["counts"], came + 1)
        g = F.element_at(state["counts"], F.greatest(gone, F.lit(0)) + 1) + F.when(gone == came, 1).otherwise(0)
        total = (
            state["sum"] + _clog(c + 1) - _clog(c) - F.when(gone >= 0, _clog(g) - _clog(g - 1)).otherwise(F.lit(0.0))
        )
        counts = F.transform(
            state["counts"], lambda n, k: n + F.when(k == came, 1).otherwise(0) - F.when(k == gone, 1).otherwise(0)
        )
        least = F.when(state["i"] + 1 >= window, F.least(state["least"], total)).otherwise(state["least"])
        return F.struct(counts.alias("counts"), total.alias("sum"), least.alias("least"), (state["i"] + 1).alias("i"))

    bits = F.log2(F.lit(float(window)))
    return F.aggregate(pairs, zero, step, lambda s: bits - s["least"] / window)


def is_secret(m):
    threshold = F.coalesce(*[F.when(m.rlike(pattern), F.lit(least)) for _, pattern, least in CLASSES], F.lit(99.0))
    shaped = m.rlike("[0-9]") & m.rlike("[A-Za-z]") & ~m.rlike(ALLOW)
    return F.when(shaped, best_window_entropy(m) >= threshold).otherwise(F.lit(False))


def kind(spans, name: str, order: int):
    return F.transform(
        spans, lambda x: F.struct(x["s"].alias("s"), F.lit(order).alias("o"), x["e"].alias("e"), F.lit(name).alias("k"))
    )


def joined(spans):
    return F.array_join(
        F.transform(F.array_sort(spans), lambda x: F.concat_ws(":", x["k"], x["s"].cast("string"), x["e"].cast("string"))), ","
    )


def scan(docs: DataFrame) -> DataFrame:
    """Per row: doc_id and the arrays base and entropy of (s, o, e, k): start, order of the kind, end, kind."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    found = rows.select(
        "doc_id",
        matches(F.col("text"), ASSIGN).alias("assign"),
        matches(F.col("text"), ACCESS).alias("access"),
        matches(F.col("text"), HEX).alias("hex"),
        F.filter(
            matches(F.col("text"), CANDIDATE),
            lambda x: x["m"].rlike("[0-9]") & x["m"].rlike("[A-Za-z]"),
        ).alias("candidates"),
    )
    value = F.filter("assign", lambda x: F.char_length(F.regexp_extract(x["m"], ASSIGN, 1)) >= 12)
    based = found.select(
        "doc_id",
        F.concat(kind(value, "assign", 0), kind(F.col("access"), "access", 1), kind(F.col("hex"), "hex", 2)).alias("base"),
        "candidates",
    )
    free = F.filter(
        "candidates", lambda x: ~F.exists("base", lambda b: (b["s"] < x["e"]) & (x["s"] < b["e"]))
    )
    return based.select("doc_id", "base", kind(F.filter(free, lambda x: is_secret(x["m"])), "entropy", 3).alias("entropy"))


def report(found: DataFrame) -> DataFrame:
    def n(name):
        return F.size(F.filter("base", lambda x: x["k"] == name)).cast("long").alias(f"n_{name}")

    return found.select(
        "doc_id", n("assign"), n("access"), n("hex"),
        F.sha2(joined(F.col("base")).cast("binary"), 256).alias("base_sha256"),
        joined(F.concat("base", "entropy")).alias("spans"),
        F.size("entropy").cast("long").alias("n_entropy"),
    )
