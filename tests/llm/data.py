"""Small tables with the awkward cases: nulls, empty and long texts, repeats, extra columns."""

import random

KIND = "doc_id long, text string, lang string, source string, n_chars long, size long, component_id string, rid int, u string, shard int"


def texts(seed=3, n=40, words=(20, 120)):
    rng = random.Random(seed)
    pool = ["".join(rng.choice("abdeiklmnorstu") for _ in range(rng.randint(2, 9))) for _ in range(900)]
    return [" ".join(rng.choice(pool) for _ in range(rng.randint(*words))) for _ in range(n)]


def edited(text, seed, share=0.02):
    rng = random.Random(seed)
    return " ".join("zz" + w if rng.random() < share else w for w in text.split(" "))


def rows():
    base = texts()
    out = [(i, t, "en" if i % 3 else "de", f"s{i % 4}" if i % 7 else None) for i, t in enumerate(base)]
    out += [(100 + i, base[0], "en", "s0") for i in range(30)]  # exact copies
    out += [(200 + i, edited(" ".join(base[1:5]), i, 0.01), "en", "s1") for i in range(40)]  # near copies
    out += [(300, None, "en", "s0"), (301, "", None, None), (302, "  \t\n", "en", "s2"), (303, "one", "en", "s2")]
    out += [(304, "Ünï cödé 😀 words ОДИН два", "de", "ü"), (305, "x" * 60_000, "en", "s3")]
    out += [(306, " ".join(base) * 3, "en", "s3"), (None, base[3], "en", "s1"), (None, None, None, None)]
    out += [(307, base[5], "en", "s1")] * 2  # a repeated row
    return out


def frame(spark, some=None):
    some = rows() if some is None else some
    full = [(*r, 1, 5, "x", 7, "y", 2) for r in some]
    return spark.createDataFrame(full, KIND).repartition(5)


def lower(text):
    return text.translate({i: i + 32 for i in range(65, 91)})
