"""Linking, conjunctions, outlines, graphs, training, tries, nearest vectors and the key store against plain Python."""

import heapq
import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from termloom.operators import graph, hierarchy, index, keystore, learn, linking, nearest, trie
from termloom.operators import search as se
from termloom.sources import tables as src


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def words(text):
    return re.findall(r"[^\W_]+", (text or "").lower())


# -- linking -------------------------------------------------------------------

NAMES = ["New_York", "York", "new_york_city", "The,", "the", "City", "a_b", "b_a", "b", "A_B", "...", "x"]
TEXTS = {
    1: "New York City, the new york; York new  York", 2: "a b a b a b", 3: None, 4: "", 5: "b a b!", 6: "nothing here", 7: "the THE New", 8: "new york city " * 300,
}


def plain_spans(text):
    t, known, out, i = words(text), {tuple(words(n.replace("_", " "))) for n in NAMES} - {()}, [], 0
    while i < len(t):
        k = max((len(p) for p in known if tuple(t[i : i + len(p)]) == p), default=0)
        if k:
            out.append((i, k))
        i += k or 1
    return out


@pytest.fixture(scope="module")
def linked(spark):
    docs = spark.createDataFrame(list(TEXTS.items()), "doc_id long, text string").withColumn("phrase", F.lit("clash"))
    dictionary = linking.phrases(spark.createDataFrame([(n,) for n in [*NAMES, "York"]], "name string"))
    return docs, dictionary, linking.spans(docs, dictionary).cache()


def test_spans_are_the_longest_from_the_left(linked):
    docs, dictionary, spans = linked
    want = sorted(((d, *s) for d, t in TEXTS.items() for s in plain_spans(t)), key=repr)
    assert rows_of(spans.select("doc_id", "pos", "k")) == want
    assert (1, 0, 3) in want and (2, 0, 2) in want and (5, 0, 2) in want
    counts = Counter()
    for d, t in TEXTS.items():
        for i, k in plain_spans(t):
            for n in NAMES:
                counts[d, n] += words(n.replace("_", " ")) == words(t)[i : i + k]
    assert rows_of(linking.mentions(spans, dictionary)) == sorted(((*x, n) for x, n in counts.items() if n), key=repr)
    assert linking.spans(docs.limit(0), dictionary).count() == 0
    assert linking.spans(docs, dictionary.limit(0)).count() == 0


def test_confidence_cuts_and_tells_names_apart(spark, linked):
    _, dictionary, spans = linked
    links = ["a_b", "A_B", "A_B", "York", "the"] + ["new_york_city"] * 400
    got = {(r["phrase"], r["name"]): r["rho"] for r in linking.confidence(spans, dictionary, spark.createDataFrame([(x,) for x in links], "name string")).collect()}
    occurs = Counter(" ".join(words(t)[i : i + k]) for t in TEXTS.values() for i, k in plain_spans(t))
    assert got["a b", "A_B"] == pytest.approx(2 / (3 + occurs["a b"]))
    assert got["new york city", "new_york_city"] == pytest.approx(400 / (400 + occurs["new york city"]))
    sure = linking.annotations(spans, dictionary, spark.createDataFrame([(x,) for x in links], "name string"))
    assert {r["name"] for r in sure.collect()} == {n for (_, n), rho in got.items() if rho > 0.2}


def test_balls_of_spans_of_characters(spark):
    text = "Ab, cd ef-gh  ij kl mn op qr st uv " + "zz " * 60 + "end"
    docs = spark.createDataFrame([(1, text), (2, "x"), (3, None)], "doc_id long, text string")
    tokens = linking.token_offsets(docs).cache()
    want = [(m.start(), m.end(), m.group().lower()) for m in re.finditer(r"[^\W_]+", text)]
    assert [(r["begin"], r["end"], r["term"]) for r in tokens.where("doc_id = 1").orderBy("pos").collect()] == want
    marked = [(1, "e", 7, 12), (1, "f", text.index("end"), len(text)), (1, "g", 0, 1), (1, "none", 2, 4), (1, "h", 5, 200), (2, "i", 0, 1)]
    found = linking.covered(tokens, spark.createDataFrame(marked, "doc_id long, name string, begin int, end int"))
    got = {r["name"]: (r["pos"], r["k"]) for r in found.collect()}
    touch = lambda b, e: [i for i, (x, y, _) in enumerate(want) if x < e and y > b]
    assert got == {n: (touch(b, e)[0], len(touch(b, e))) for d, n, b, e in marked if d == 1 and touch(b, e)} | {"i": (0, 1)}
    balls = {r["name"]: r["terms"] for r in linking.balls(tokens, found, 2).collect()}
    for n, (pos, k) in got.items():
        assert balls[n] == (["x"] if n == "i" else [w for _, _, w in want[max(pos - 2, 0) : pos + k + 2]])


# -- conjunctions ----------------------------------------------------------------


def test_holding_has_all_terms(spark):
    rng = random.Random(2)
    texts = {d: " ".join(rng.choice("abcdefgh") for _ in range(rng.randint(0, 30))) for d in range(60)}
    queries = {q: rng.sample("abcdefgh", rng.randint(1, 7)) for q in range(12)} | {98: ["a", "absent"], 99: ["absent"]}
    ix = se.Index(index.postings(spark.createDataFrame(list(texts.items()), "doc_id long, text string")))
    q = spark.createDataFrame([(k, t) for k, ts in queries.items() for t in [*ts, ts[0]]], "query_id long, term string")
    want = sorted(((k, d) for k, ts in queries.items() for d, t in texts.items() if set(ts) <= set(t.split())), key=repr)
    assert rows_of(ix.holding(q)) == want
    assert rows_of(ix.holding(q.limit(0))) == []


# -- outlines ----------------------------------------------------------------------


def test_open_headings_are_a_stack(spark):
    rng = random.Random(6)
    pages = {p: [(i, rng.randint(1, 6), f"h{i}") for i in range(rng.randint(0, 25))] for p in range(12)}
    want = []
    for p, heads in pages.items():
        stack, info, order = [], {}, []
        for pos, level, h in heads:
            while stack and stack[-1][1] >= level:
                order.append(stack.pop()[0])
            stack.append((pos, level, h))
            info[pos] = ([x[2] for x in stack], stack[-2][0] if len(stack) > 1 else None)
        order += [x[0] for x in reversed(stack)]
        want += [(p, pos, info[pos][0], info[pos][1], k, order.index(pos)) for k, (pos, _, _) in enumerate(heads)]
    df = spark.createDataFrame([(p, *h) for p, hs in pages.items() for h in hs], "page_id long, pos int, level int, heading string")
    got = hierarchy.open_headings(df.repartition(3)).select("page_id", "pos", "path", "parent", "pre", "post")
    assert rows_of(got) == sorted(want, key=repr)


def test_outline_of_html(spark):
    html = "lead<h1 class='a > b'>One <i>x</i></h1><!-- <h2>no</h2> --><p>p</p><H3>Three</H3><script><h4>no</h4></script><h2>Two</h2>t"
    df = spark.createDataFrame([(1, html), (2, "<h2>only</h2>"), (3, ""), (4, None)], "page_id long, html string")
    got = [(r["page_id"], r["level"], r["heading"]) for r in src.outline(df).orderBy("page_id", "pos").collect()]
    assert got == [(1, 0, ""), (1, 1, "One x"), (1, 3, "Three"), (1, 2, "Two"), (2, 2, "only")]


def test_tree_orders_of_any_depth(spark):
    rng = random.Random(8)
    paths = [[rng.choice("abc") for _ in range(rng.randint(1, 7))] for _ in range(60)]
    nodes = sorted({tuple(p[:k]) for p in paths for k in range(1, len(p) + 1)})
    post = sorted(nodes, key=lambda n: (*n, "\x7f" * 9))
    want = sorted((("/".join(n), len(n), k, post.index(n)) for k, n in enumerate(nodes)), key=repr)
    after = lambda a, b: a != b and (b[: len(a)] != a and a < b or a[: len(b)] == b)
    numbers = {n: sum(after(m, n) for m in nodes) for n in nodes}  # nodes done before n
    want = sorted((("/".join(n), len(n), k, numbers[n]) for k, n in enumerate(nodes)), key=repr)
    assert rows_of(hierarchy.orders(spark.createDataFrame([(p,) for p in paths * 2], "path array<string>"))) == want
    assert [r["number"] for r in hierarchy.numbered(spark.range(1000).repartition(7), "id").orderBy("id").collect()] == list(range(1000))


# -- graphs ------------------------------------------------------------------------


def dijkstra(edges, starts):
    best, heap = {}, [(0.0, s) for s in starts]
    while heap:
        d, n = heapq.heappop(heap)
        if n not in best:
            best[n] = d
            for a, b, w in edges:
                if a == n and b not in best:
                    heapq.heappush(heap, (d + w, b))
    return best


@pytest.fixture(scope="module")
def net(spark):
    rng = random.Random(9)
    edges = [(f"n{i}", f"n{i + 1}", 1.0) for i in range(12)]  # a long chain
    edges += list({(a, b): (a, b, rng.randint(1, 9) / 4) for a, b in ((f"m{rng.randint(0, 9)}", f"m{rng.randint(0, 9)}") for _ in range(25)) if a != b}.values())
    edges += [("n12", "m0", 0.0), ("m1", "n0", 0.5)]
    return edges, spark.createDataFrame(edges, "src string, dst string, w double").cache()


def test_paths_go_on_to_the_end(spark, net):
    edges, df = net
    hubs = spark.createDataFrame([("n0",), ("m3",), ("absent",)], "node string")
    want = {(n, h): d for h in ("n0", "m3", "absent") for n, d in dijkstra(edges, [h]).items()}
    assert {(r["node"], r["hub"]): r["distance"] for r in graph.shortest_paths(df, hubs).collect()} == want
    near = graph.shortest_paths(df, hubs, limit=3.0)
    assert {(r["node"], r["hub"]): r["distance"] for r in near.collect()} == {k: d for k, d in want.items() if d <= 3.0}
    with pytest.raises(RuntimeError, match="still fall"):
        graph.shortest_paths(df, hubs, rounds=4).count()


def test_edge_distances_are_those_of_the_line_graph(spark, net):
    edges, df = net
    hubs = [("n0", "n1", "x"), ("m3", "n0", "y")]
    got = {(r["src"], r["dst"], r["hub"]): (r["ahead"], r["behind"], r["distance"]) for r in graph.edge_distances(df, spark.createDataFrame(hubs, "src string, dst string, hub string")).collect()}
    back = [(b, a, w) for a, b, w in edges]
    want = {}
    for a, b, h in hubs:
        fw, bw = [dijkstra(edges, [x]) for x in (a, b)], [dijkstra(back, [x]) for x in (a, b)]
        for s, t, w in edges:
            ahead = max((d[s] + w for d in fw if s in d), default=None)
            behind = max((d[t] + w for d in bw if t in d), default=None)
            if ahead is not None or behind is not None:
                want[s, t, h] = (ahead, behind, min(x for x in (ahead, behind) if x is not None))
    assert got == want
    near = graph.nearest_edge_hubs(spark.createDataFrame([(*k, *v) for k, v in want.items()], "src string, dst string, hub string, ahead double, behind double, distance double"))
    best = {e: min((v[2], k[2]) for k, v in want.items() if k[:2] == e) for e in {k[:2] for k in want}}
    assert {(r["src"], r["dst"]): (r["distance"], r["hub"]) for r in near.collect()} == best
    totals = {r["hub"]: (r["edges"], round(r["total"], 9)) for r in graph.hub_totals(near, df).collect()}
    whole = sum(w for _, _, w in edges)
    assert totals == {h: (sum(b[1] == h for b in best.values()), round(sum(b[0] for b in best.values() if b[1] == h) / whole, 9)) for h in {b[1] for b in best.values()}}


def stationary(edges, stay=0.15):
    nodes = sorted({x for e in edges for x in e[:2]})
    at, n = {x: i for i, x in enumerate(nodes)}, len(nodes)
    p = np.zeros((n, n))
    for a, b, w in edges:
        p[at[a], at[b]] += w
    out = p.sum(1, keepdims=True)
    p = np.where(out > 0, p / np.where(out > 0, out, 1), 1 / n)
    x = np.full(n, 1 / n)
    for _ in range(2000):
        x = stay / n + (1 - stay) * x @ p
    return dict(zip(nodes, x, strict=True)), {(a, b): p[at[a], at[b]] for a, b, _ in edges}


def test_walks_reach_their_long_run(spark, net):
    edges = [e for e in net[0] if e[2] > 0] + [("m0", "end", 1.0)]
    df = spark.createDataFrame(edges, "src string, dst string, w double")
    want, p = stationary(edges)
    got = {r["node"]: r["score"] for r in graph.hub_scores(df).collect()}
    assert got == pytest.approx(want, abs=1e-8)
    other, q = stationary([(b, a, w) for a, b, w in edges])
    flows = {(a, b): (want[a] * p[a, b] + other[b] * q[b, a]) / 2 for a, b, _ in edges}
    assert {(r["src"], r["dst"]): r["score"] for r in graph.walked_edges(df).collect()} == pytest.approx(flows, abs=1e-8)
    with pytest.raises(RuntimeError, match="still moves"):
        graph.hub_scores(df, 10, 1e-12)


def test_disjoint_edges_are_greedy(spark):
    rows = [("a", "b", 9.0), ("b", "c", 8.0), ("c", "d", 7.0), ("e", "f", 7.0), ("f", "a", 6.0)]
    got = graph.disjoint_edges(spark.createDataFrame(rows, "src string, dst string, score double"), 2)
    assert got == [("a", "b", 9.0), ("c", "d", 7.0)]


# -- training ------------------------------------------------------------------------


def test_joint_gradient_and_training(spark):
    rng = np.random.default_rng(3)
    ent = [(q, f"e{k}", rng.normal(size=2).tolist()) for q in range(3) for k in range(4)]
    cells = [(q, d, f"e{k}", rng.normal(size=3).tolist(), int(d % 2)) for q in range(3) for d in range(4) for k in range(4)]
    c = spark.createDataFrame(cells, "query_id long, doc_id long, name string, g array<double>, rel int").cache()
    e = spark.createDataFrame(ent, "query_id long, name string, f array<double>").cache()

    def value(v, w):
        total = 0.0
        for q in range(3):
            s = {n: math.exp(np.dot(f, v)) for x, n, f in ent if x == q}
            for d in (1, 3):
                m = {n: math.exp(np.dot(g, w)) for x, y, n, g, _ in cells if (x, y) == (q, d)}
                total += math.log(sum(s[n] / sum(s.values()) * m[n] / sum(m.values()) for n in s))
        return total

    v, w = [0.3, -0.2], [0.1, 0.5, -0.4]
    got, gv, gw = learn.joint_gradient(c, e, v, w)
    step = 1e-5
    slope = lambda x, k, f: (f([y + step * (i == k) for i, y in enumerate(x)]) - f([y - step * (i == k) for i, y in enumerate(x)])) / (2 * step)
    assert got == pytest.approx(value(v, w))
    assert gv == pytest.approx([slope(v, k, lambda x: value(x, w)) for k in range(2)], abs=1e-6)
    assert gw == pytest.approx([slope(w, k, lambda x: value(v, x)) for k in range(3)], abs=1e-6)
    v2, w2, curve = learn.train_joint(c, e, v, w, rounds=2, inner=2)
    assert curve == sorted(curve) and curve[-1] > curve[0]
    assert curve[-1] == pytest.approx(value(v2, w2))


# -- tries ---------------------------------------------------------------------------


def test_tries_against_plain_trees(spark):
    rng = random.Random(11)
    leaves = [[a, b, c] for a in "xy" for b in "pq" for c in "123" if rng.random() < 0.8] + [["z"]]
    items = [(p, i, float(rng.randint(0, 9)), int(rng.random() < 0.3)) for p in leaves for i in range(5) if rng.random() < 0.9]
    t = trie.rolled(spark.createDataFrame(items, "path array<string>, item int, score double, rel int")).cache()
    score, rel = defaultdict(float), defaultdict(int)
    for p, i, s, r in items:
        for k in range(1, len(p) + 1):
            score[tuple(p[:k]), i] += s
            rel[tuple(p[:k]), i] = max(rel[tuple(p[:k]), i], r)
    nodes = {n for n, _ in score}
    children = lambda n: [m for m in nodes if len(m) == len(n) + 1 and m[: len(n)] == n]
    as_dict = lambda df: {(tuple(r["node"]), r["item"]): r["score"] for r in df.collect()}

    handed = {}
    for n, i in sorted(score, key=lambda x: len(x[0])):
        total = sum(score.get((m, i), 0.0) for m in children(n[:-1])) if len(n) > 1 else 0
        share = 1.0 if len(n) == 1 else score[n, i] / total if total else 0.0
        handed[n, i] = share * (rel[n, i] if len(n) == 1 else handed[n[:-1], i])
    assert as_dict(trie.marginals(t)) == pytest.approx(handed)

    def best(n, i):
        below = [best(m, i) for m in children(n) if (m, i) in score]
        return score[n, i] * (max(below) if below else 1.0)

    assert as_dict(trie.max_products(t)) == pytest.approx({x: best(*x) for x in score})
    bottom = {(n, i): s for (n, i), s in score.items() if not children(n)}
    top = {i: max(s for (_, j), s in bottom.items() if j == i) for _, i in bottom}
    assert as_dict(trie.best_leaves(t)) == {x: s if s == top[x[1]] else 0.0 for x, s in bottom.items()}
    spread = {}
    for n in nodes:
        kids = children(n)
        some = [i for i in range(5) if any(rel.get((m, i)) for m in kids)]
        if some:
            mean = {i: sum(score.get((m, i), 0.0) for m in kids) / len(kids) for i in some}
            spread[n] = sum(abs(score.get((m, i), 0.0) - mean[i]) for m in kids for i in some) / len(kids)
    assert {tuple(r["node"]): r["dispersion"] for r in trie.dispersion(t).collect()} == pytest.approx(spread)
    for r in trie.node_precision(t).collect():
        n = tuple(r["node"])
        order = sorted((i for m, i in score if m == n), key=lambda i: (-score[n, i], i))
        hits = [k for k, i in enumerate(order, 1) if rel[n, i]]
        assert r["ap"] == pytest.approx(sum((j + 1) / k for j, k in enumerate(hits)) / max(1, len(hits)))


# -- nearest vectors -------------------------------------------------------------------


def test_nearest_is_exact(spark):
    rng = random.Random(12)
    terms = [f"t{k}" for k in range(40)]
    make = lambda n: Counter(rng.choices(terms, weights=[1 / (k + 1) for k in range(40)], k=n))
    others = {i: make(rng.randint(1, 12)) for i in range(80)}
    asked = {q: make(rng.randint(1, 12)) for q in range(30)} | {99: Counter(["absent"])}
    df = Counter(t for v in others.values() for t in v)

    def unit(v):
        w = {t: n * math.log(1 + 80 / df[t]) for t, n in v.items() if t in df}
        size = math.sqrt(sum(x * x for x in w.values()))
        return {t: x / size for t, x in w.items()}

    want = []
    for q, v in asked.items():
        a = unit(v)
        sims = [(-round(sum(x * unit(o).get(t, 0.0) for t, x in a.items()), 9), i) for i, o in others.items()]
        if min(sims)[0] < 0:
            want.append((q, min(sims)[1], -min(sims)[0]))
    table = lambda d, k: spark.createDataFrame([(i, t, n) for i, v in d.items() for t, n in v.items()], f"{k} long, term string, tf long")
    dfs = spark.createDataFrame(list(df.items()), "term string, df long")
    got = nearest.nearest(nearest.unit_vectors(table(asked, "q"), "q", dfs, 80), nearest.unit_vectors(table(others, "id"), "id", dfs, 80), dfs)
    assert rows_of(got) == sorted(want, key=repr)


# -- the key store -------------------------------------------------------------------


def test_prefix_scans_read_their_range_alone(spark, tmp_path, monkeypatch):
    import pyarrow.parquet as pq

    monkeypatch.setattr(keystore, "GROUP_ROWS", 500)
    keys = [f"{a}{b}{k:03d}" for a in "abcd" for b in "xyz" for k in range(300)] + ["", "\U0010ffff", "b", "hot"] + ["hot"] * 4000
    path = f"{tmp_path}/store"
    keystore.store(spark.createDataFrame(list(enumerate(keys)), "id long, key string"), "key", path, files=6)
    for prefix in ("b", "by", "by0", "hot", "e", "\U0010ffff", ""):
        got = keystore.scan(spark, path, "key", prefix)
        assert sorted(r["key"] for r in got.collect()) == sorted(k for k in keys if k.startswith(prefix))
    stop, groups, hot = keystore.after("by"), [], 0
    for f in sorted((tmp_path / "store").glob("*.parquet")):
        meta = pq.ParquetFile(f).metadata
        for g in range(meta.num_row_groups):
            s = meta.row_group(g).column(1).statistics
            groups.append(s.max >= "by" and s.min < stop)
            hot += s.min == s.max == "hot"
    assert sum(groups) <= 3 < len(groups) / 3  # of all row groups, those that a scan of "by" can't skip
    assert hot >= 4  # a key with many rows has several
    scan = keystore.scan(spark, path, "key", "by")
    plan = scan._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(key,by)" in plan and "LessThan(key,bz)" in plan
    assert keystore.after("\U0010ffff") is None and keystore.after("a\U0010ffff") == "b" and keystore.after("퟿") == ""


# -- stems -----------------------------------------------------------------------------


def test_stemmed_terms_are_counted_by_stem(spark):
    from termloom.functions import text as tx
    from termloom.plans import catalog

    sf = "/root/testdata/sf0.001"
    texts = [r[0] for r in spark.read.parquet(f"{sf}/documents.parquet").select("text").collect()]
    want = Counter(tx.stem(w) for t in texts for w in re.findall(r"[^\W_]+", (t or "").lower()))
    got = {r["stem"]: r["n"] for r in catalog.QUERIES["stemmed_terms"](spark, sf).collect()}
    odd = {s for s in want.keys() | got.keys() if want.get(s) != got.get(s)}
    # Python's word characters and the tokens' letters and digits differ in marks alone
    assert not {s for s in odd if s.isascii()}


def test_few_phrases_are_told_to_tasks(linked, monkeypatch):
    """Spans of a text and balls around them come without a shuffle of texts or places, as the join gives them."""
    docs, dictionary, _ = linked
    told, balls = linking.spans(docs, dictionary), linking.ball_counts(docs, dictionary, 2)
    assert "Exchange" not in told._jdf.queryExecution().executedPlan().toString()
    assert balls._jdf.queryExecution().executedPlan().toString().count("Exchange") == 1
    found = rows_of(told), rows_of(balls)
    monkeypatch.setattr(linking, "FEW", 1)
    assert found == (rows_of(linking.spans(docs, dictionary)), rows_of(linking.ball_counts(docs, dictionary, 2)))
    assert found[1]
