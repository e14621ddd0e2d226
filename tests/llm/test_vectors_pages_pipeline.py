"""Embedding near-duplicates, page text and the pipeline."""

import numpy as np
from pyspark.sql import functions as F

from tests.llm.data import frame, rows


def vectors():
    rng = np.random.default_rng(4)
    out = [(i, rng.normal(size=16).tolist(), int(i % 3)) for i in range(120)]
    base = rng.normal(size=16)
    out += [(200 + i, (base + rng.normal(scale=0.07, size=16)).tolist(), 1) for i in range(60)]
    out += [(300 + i, (2.0**i * base).tolist(), 1) for i in range(5)]  # the same direction
    out += [(400 + i, out[0][1], out[0][2]) for i in range(20)]  # copies
    out += [(500, out[0][1], 2), (501, out[0][1], None), (502, None, 1), (503, [0.0] * 16, 1), (504, [float("nan")] + [1.0] * 15, 1)]
    out += [(505, [None] + [1.0] * 15, 1), (506, [float("inf")] * 16, 1), (507, [1.0, 2.0], 1), (508, [2.0, 4.0], 1), (509, [], 1)]
    return out


def test_embedding_links(spark, monkeypatch):
    from groupcast.llm import embedding_dedup

    monkeypatch.setattr(embedding_dedup, "CHUNK", 16)  # hot buckets of several chunks
    table = vectors()
    df = spark.createDataFrame([(*r, 1) for r in table], "vec_id long, embedding array<double>, label int, key int").repartition(4)
    got = {r.vec_id: r for r in embedding_dedup.link_vectors(df).collect()}
    assert len(got) == len(table)
    ids = [r[0] for r in table]
    sound = {}
    for i, e, label in table:
        if label is not None and e and None not in e and np.isfinite(e).all() and any(e):
            sound[i] = (np.array(e) / np.linalg.norm(e), label)
    links = {i: set() for i in ids}
    for a, (x, p) in sound.items():
        for b, (y, q) in sound.items():
            if a != b and p == q and len(x) == len(y) and x @ y >= 0.98:
                links[a].add(b)
    top = {i: i for i in ids}
    while True:
        new = {i: min([top[i], *(top[j] for j in links[i])]) for i in ids}
        if new == top:
            break
        top = new
    missed = sum(got[i].n_links != len(links[i]) for i in ids)
    assert missed <= 2  # the tables' chance of a miss
    assert all(got[i].n_links <= len(links[i]) for i in ids)
    assert all(got[i].component_id == top[i] and got[i].kept == (top[i] == i) for i in ids)
    assert embedding_dedup.link_vectors(df.limit(0)).count() == 0


def page(k, body, menu="Home About"):
    items = "".join(f"<li><a href='/{w}'>{w}</a></li>" for w in menu.split())
    return (
        f"<!DOCTYPE html><html><head><title>T {k}</title><script>var x = '<p>no</p>';</script><style>p {{}}</style></head><body>"
        f"<header><h1>Site</h1></header><nav><ul>{items}</ul></nav><div class='cookie-notice'>We use cookies</div>"
        f"<div class='c1'><p>Always the same line here.</p></div><div id='main-text'>{body}</div>"
        f"<div class='comments'><p>reader {k} says</p></div><aside>side {k}</aside><form><p>mail</p></form><footer>&copy; {k}</footer></body></html>"
    )


def test_page_text(spark):
    from groupcast.llm.html_wrapper import extract

    pages = [(i, "http://A.example.org/x%d" % i, page(i, f"<h2>Head {i}</h2><p>Some <b>text</b> &amp;\n  number {i}<br>more<p>second {i} &lt;b&gt;")) for i in range(12)]
    want = {i: f"Head {i}\nSome text & number {i} more\nsecond {i} <b>" for i in range(12)}
    pages += [
        (20, None, None), (21, "http://b/1", ""), (22, "http://b/2", "just text"), (23, "::", "<p>open <i>inline"),
        (24, "http://c/1", "<article><h1>T</h1><p>a</p><div class=ad>buy</div><p>b</article><article>c</article><p>out</p>"),
        (25, "http://c/2", "<div><!-- gone <p>x</p> --><p>a&nbsp;b</p>" + "<p>long</p>" * 5000), (25, "http://c/2", "<p>repeat</p>"),
        (None, "http://c/3", "<main><p>m</p></main>tail"), (26, "http://c/4", "<<p>>1 < 2 & 3</p></div></p><table><tr><td>x<td>y"),
        (27, "http://c/5", "<nav>only menu</nav>"),
    ]
    want |= {20: "", 21: "", 22: "just text", 23: "open inline", 24: "T\na\nb", 27: ""}
    df = spark.createDataFrame([(*p, "w", "h") for p in pages], "page_id long, url string, html string, wrapper string, host string").repartition(3)
    got = extract(df).collect()
    assert len(got) == len(pages)
    for r in got:
        assert r.n_chars == len(r.text)
        if r.page_id in want:
            assert r.text == want[r.page_id]
        if r.page_id is None:
            assert r.text == "m"
    assert {r.text for r in got if r.page_id == 25} == {"repeat", "a b" + "\nlong" * 5000}
    assert extract(df.limit(0)).count() == 0


def test_tree_matching_is_the_best_alignment():
    from groupcast.llm.html_wrapper import align

    def tree(spec):
        return [spec[0], 1, None, [tree(c) for c in spec[1:]]]

    a = tree(("a", ("b", ("c",), ("d",)), ("e",), ("b", ("c",), ("f",))))
    b = tree(("a", ("e",), ("b", ("c",), ("d",), ("f",))))
    assert align(a, a)[0] == 8
    assert align(a, b)[0] == 5  # a, e, b, c, f


def test_tree_matching_equals_a_brute_force():
    import random

    from groupcast.llm.html_wrapper import align

    rng = random.Random(5)

    def tree(depth):
        return [rng.choice("abc"), 1, None, [tree(depth - 1) for _ in range(rng.randrange(4))] if depth else []]

    def weight(a, b):
        """The heaviest order-keeping alignment by trying all ways of leaving out the first child of either."""
        if a[0] != b[0]:
            return 0

        def rest(x, y):
            if not x or not y:
                return 0
            return max(rest(x[1:], y), rest(x, y[1:]), weight(x[0], y[0]) + rest(x[1:], y[1:]) if x[0][0] == y[0][0] else 0)

        return 1 + rest(a[3], b[3])

    def positions(top):
        out, stack = {}, [(top, ())]
        while stack:
            node, at = stack.pop()
            out[id(node)] = at
            stack += [(c, (*at, i)) for i, c in enumerate(node[3])]
        return out

    for _ in range(300):
        a, b = ["r", 1, None, tree(3)[3]], ["r", 1, None, tree(3)[3]]
        got, pairs = align(a, b)
        assert got == len(pairs) == weight(a, b)
        at, to = positions(a), positions(b)
        places = sorted((at[id(x)], to[id(y)]) for x, y in pairs)
        assert all(x[0] == y[0] for x, y in pairs)
        assert [q for _, q in places] == sorted({q for _, q in places})  # one to one, in order
        assert all((p[:-1], q[:-1]) in set(places) for p, q in places if p)  # below matched nodes


def test_template_is_what_meets_in_the_aligned_trees(spark):
    from groupcast.llm.html_wrapper import extract

    # One label path, in two places of the page: behind the body on five pages, before it on four.
    line, body = "<div class=x><p>Site</p></div>", "<div class=y><h2>Head {0}</h2><p>text {0}</p></div>"
    pages = [(i, "http://a/", body.format(i) + line) for i in range(5)]
    pages += [(i, "http://a/", line + body.format(i)) for i in range(5, 9)]
    want = {i: f"Head {i}\ntext {i}" if i < 5 else f"Site\nHead {i}\ntext {i}" for i in range(9)}
    # Pages that have some of a host's nodes, in one order: each node is counted on all pages that have it.
    line = ["<div class={0}><p>Part {0}</p></div>".format(c) for c in "abcd"]
    line.insert(2, body)
    for i in range(20, 36):
        pages.append((i, "http://b/", "".join(p for k, p in zip((0, 1, 9, 2, 3), line) if k == 9 or (i >> k) & 1).format(i)))
    want |= {i: f"Head {i}\ntext {i}" for i in range(20, 36)}
    for some, n in ((pages, 1), (pages[::-1], 5)):
        got = extract(spark.createDataFrame(some, "page_id long, url string, html string").repartition(n)).collect()
        assert {r.page_id: r.text for r in got} == want


def test_a_wrapper_holds_the_nodes_of_all_its_pages():
    from groupcast.llm.html_wrapper import align, merge, pack, settle, unpack

    def tree(spec, n=1):
        return [spec[0], n, None, [tree(c, n) for c in spec[1:]]]

    b = ("b", ("x",))  # heavier than a alone
    specs = [("r", ("a", ("x",)), b), ("r", b, ("c", ("y",))), ("r", ("a", ("z",)), ("c",)), ("r", b, ("a",))]
    numbers = {c: i for i, c in enumerate("rabcxyz")}

    def named(node):
        return [numbers[node[0]], node[1], None, [named(c) for c in node[3]]]

    wrapper = named(tree(specs[0], 2))
    for spec in specs[1:]:
        merge(wrapper, named(tree(spec)))
    assert wrapper[1] == 5
    again = unpack(pack(wrapper))[0]
    assert again == wrapper
    for spec in specs:
        page = named(tree(spec))
        assert align(page, wrapper)[0] == align(page, page)[0]
    counts = [(c[0], c[1]) for c in wrapper[3]]
    assert counts in ([(1, 3), (2, 4), (3, 2), (1, 1)], [(1, 3), (2, 4), (1, 1), (3, 2)])  # the late a is a node of its own
    settle(wrapper)
    assert [(c[0], c[1]) for c in wrapper[3]] == [(1, 3), (2, 4), (3, 2)]


def test_copies_of_one_page_keep_their_text(spark):
    from groupcast.llm.html_wrapper import extract

    html = "<body><article><p>one</p><p>two</p></article></body>"
    df = spark.createDataFrame([(i, "http://h/", html) for i in range(9)], "page_id long, url string, html string")
    assert {r.text for r in extract(df).collect()} == {"one\ntwo"}


def test_near_copies_and_shared_headings_keep_their_text(spark):
    from groupcast.llm.html_wrapper import extract

    kinds = {"a": "<article>{}</article>", "b": "<p>Site</p><main>{}</main>", "c": "<p>Site</p><div class=content>{}</div>"}
    body = "<h1>Title {}</h1><h2>Summary</h2><p>the same long body on each page</p>"
    pages = [(i, f"http://{h}/{i}", k.format(body.format(i))) for h, k in kinds.items() for i in range(5)]
    pages += [(i, f"http://d/{i}", f"<p>Site</p><p>page</p><div>text {i}</div>") for i in range(5)]  # no such element: template goes
    got = extract(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()
    for r in got:
        whole = f"Title {r.page_id}\nSummary\nthe same long body on each page"
        assert r.text == (f"text {r.page_id}" if "//d/" in r.url else whole)


def test_page_text_does_not_depend_on_row_order(spark):
    from groupcast.llm.html_wrapper import extract

    # 210 pages of one layout, then 215 of another whose nodes the first has not.
    pages = [(i, "http://h/", f"<div class=x><p>old {i}</p></div>") for i in range(210)]
    pages += [(i, "http://h/", f"<div class=y><h5>Site</h5><p>new {i}</p></div>") for i in range(210, 425)]
    want = {i: f"{'old' if i < 210 else 'new'} {i}" for i in range(425)}
    for some in (pages, pages[::-1]):
        for parts in (1, 4):
            df = spark.createDataFrame(some, "page_id long, url string, html string").coalesce(1)
            got = extract(df if parts == 1 else df.repartition(parts)).collect()
            assert {r.page_id: r.text for r in got} == want


def test_deeply_nested_pages(spark):
    from groupcast.llm.html_wrapper import extract

    pages = [(i, "http://h/", "<div>" * 5000 + f"deep {i}" + "<ul>" * 1000 + "<li>x") for i in range(4)]
    pages += [(9, "http://h/9", "<article>" * 2000 + "<p>a" + "</article>" * 2000 + "after")]
    got = extract(spark.createDataFrame(pages, "page_id long, url string, html string").coalesce(1)).collect()
    assert {r.page_id: r.text for r in got} == {i: f"deep {i}" for i in range(4)} | {9: "a"}


def test_pipeline(spark, tmp_path):
    import corpus_pipeline
    from tests.llm.test_text_operators import contamination, groups

    table = [(i, t, "de" if i is not None and i % 2 else "en", s) for i, t, _, s in rows()]
    items = [(1, rows()[7][1]), (2, "never there")]
    frame(spark, table).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "jaccard_join", "decontamination", "source_mix", "token_files"]
    docs, seen = frame(spark, table), {}
    for name, stage in corpus_pipeline.STAGES[:4]:
        out = stage(spark, docs, str(tmp_path))
        assert out.columns == docs.columns
        seen[name] = out.collect()
        docs = spark.createDataFrame(seen[name], docs.schema)
    first = [(r.doc_id, r.text, r.lang, r.source) for r in seen["language_id"]]
    assert {300, 301, 302}.isdisjoint(r[0] for r in first) and len(first) >= len(table) - 12
    want = groups(first)
    second = [(r.doc_id, r.text) for r in seen["jaccard_join"]]
    assert sorted(i for i, _ in second if i is not None) == sorted({i for i in want if want[i] == i})
    bad = {r[0] for r in contamination(second, items) if r[5]}
    assert 7 in bad
    assert {r.doc_id for r in seen["decontamination"]} == {i for i, _ in second} - bad
    final = corpus_pipeline.run(spark, str(tmp_path))
    assert final.columns == ["doc_id", "start", "n_tokens", "ids_crc32"]
    assert final.count() == len(seen["source_mix"])
    assert sorted(final.agg(F.sum("n_tokens").alias("n"), (F.max(F.col("start") + F.col("n_tokens"))).alias("m")).first()) == [final.agg(F.sum("n_tokens")).first()[0]] * 2


def test_oracles_and_queries_are_registered():
    import __spark_entry__ as entry

    for n in range(1, 11):
        assert sum(q.startswith(f"op{n}_") for q in entry.queries()) == 1
    assert "pipeline" in entry.queries() and set(entry.oracle_sql()) <= set(entry.queries())
