"""The trie against one built turn by turn in memory."""

import collections
import hashlib
import random
import zlib

import pytest

from groupcast.llm import conversation_trie as ct

KIND = "conv_id long, turn long, role string, text string, key string, said int, depth int, pos int, last string"


def table(seed=4, n=420):
    rng = random.Random(seed)
    say = ["", "hi", "a longer text 😀", "ok", None, "bye, é"]
    out = []
    for c in [*rng.sample(range(0, 900), n), -7, -100, -203]:
        same = rng.random() < 0.4  # a third or more hold one conversation
        turns = [("user", "hi"), ("assistant", "ok"), ("user", "hi")] if same else [(rng.choice(["user", "assistant", None]), rng.choice(say)) for _ in range(rng.choice([1, 2, 3, 5, 7, 12]))]
        first = rng.choice([0, 0, 5])
        out += [(c, first + 2 * k if k or rng.random() < 0.8 else None, *t) for k, t in enumerate(turns)]
    out += [(1000, k, "user", f"t{k}" * 3) for k in range(300)]  # a long one
    out += [(1001, 0, "user", "one")] * 3  # repeated rows, the first of them of equal turn
    out += [(None, 0, "user", "lost"), (None, None, None, None)]
    rng.shuffle(out)
    return out


def frame(spark, rows):
    return spark.createDataFrame([(*r, "k", 1, 2, 3, "l") for r in rows], KIND).repartition(4)


def brute(rows):
    def said(role, text):
        return hashlib.sha256(f"{len(role.encode())}:{role}{text}".encode()).digest()

    own = collections.defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            own[c].append((turn is not None, turn or 0, said(role or "", text or ""), (role or "", text or "")))
    own = {c: [x[3] for x in sorted(v)] for c, v in own.items()}
    members, ends = collections.defaultdict(list), collections.defaultdict(list)
    for c in sorted(own):
        h = zlib.crc32(str(c).encode()) % 6
        base = c - (abs(c) % 100) * (1 if c >= 0 else -1)
        seq = tuple(own.get(base, [])[:h] + own[c][h:])
        ends[seq].append(c)
        for d in range(len(seq) + 1):
            members[seq[:d]].append(c)
    children = collections.defaultdict(list)
    for path in members:
        if path:
            children[path[:-1]].append(path)
    leaves, saved = collections.Counter(), collections.Counter()
    for path in sorted(members, key=len, reverse=True):
        leaves[path] += not children[path]
        saved[path] += (len(members[path]) - 1) * len(path[-1][1]) if path else 0
        if path:
            leaves[path[:-1]] += leaves[path]
            saved[path[:-1]] += saved[path]
    return sorted(
        (m[0], len(p), members[p[:-1]][0] if p else None, len(m), len(children[p]), leaves[p], saved[p],
         hashlib.sha256(",".join(map(str, ends.get(p, []))).encode()).hexdigest())
        for p, m in members.items()
    )


def got(df):
    names = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    assert df.columns == names and all(t == "bigint" for _, t in df.dtypes[:-1])
    return sorted(tuple(r) for r in df.collect())


@pytest.mark.parametrize(("seed", "segment"), [(4, 1 << 16), (5, 24)])
def test_trie(spark, monkeypatch, seed, segment):
    monkeypatch.setattr(ct, "SEGMENT", segment)  # 24: end lists of many segments
    rows = table(seed)
    want = brute(rows)
    assert got(ct.trie(ct.rebuilt(frame(spark, rows)))) == want


def test_conversations_without_turns(spark):
    lost = next(c for c in range(101, 200) if zlib.crc32(str(c).encode()) % 6 > 1)
    rows = [(lost, 0, "user", "gone")]  # its base does not exist, and its only turn is replaced
    want = brute(rows)
    assert [w[1:6] for w in want] == [(0, None, 1, 0, 1)]
    assert got(ct.trie(ct.rebuilt(frame(spark, rows)))) == want


def test_empty_table(spark):
    assert got(ct.trie(ct.rebuilt(frame(spark, table()).limit(0)))) == []


def test_query_equals_its_sql(spark):
    import duckdb

    from groupcast.llm.queries import oracle_sql, queries

    sf = "/root/testdata/sf0.001"
    con = duckdb.connect()
    con.sql(f"CREATE VIEW conversations AS SELECT * FROM '{sf}/conversations.parquet'")
    want = con.sql(oracle_sql()["op12_conversation_trie"])
    df = queries()["op12_conversation_trie"](spark, sf).select(want.columns)
    assert sorted(map(tuple, df.collect()), key=str) == sorted(want.fetchall(), key=str)
