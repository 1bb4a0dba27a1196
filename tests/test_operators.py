"""Hand-computed fixtures and invariants of single operators."""

import math

import pytest
from pyspark.sql import functions as F

from termloom.functions import stats, vectors
from termloom.functions import text as tx
from termloom.operators import candidates, features, graph, hierarchy, index, learn, scores
from termloom.operators import search as se
from termloom.sources import sinks, tables
from termloom.streaming import indexing


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def arr(*xs):
    return F.array(*[F.lit(x) for x in xs])


def test_grams(spark):
    abc = arr("a", "b", "c")
    assert one(spark, tx.bigrams(abc)) == ["ab", "bc"]
    assert one(spark, tx.windowed_index(abc)) == ["ab", "ba", "ac", "ca", "bc", "cb"]
    assert one(spark, tx.windowed_query(arr(*"abcdefg"))) == []
    assert len(one(spark, tx.windowed_query(arr(*"abcdefgh")))) == 14
    assert one(spark, tx.char_ngrams(arr("abcd", "xy"), 3)) == ["abc", "bcd"]
    assert one(spark, tx.bigrams(arr("a"))) == [] and one(spark, tx.windowed_index(arr("a"))) == []
    assert one(spark, tx.token_ball(arr(*"abcdefg"), F.lit(1), F.lit(2), 2)) == ["a", "b", "c", "d"]


def test_analysis(spark):
    assert one(spark, tx.tokens(F.lit("Ab-c 1é"))) == ["ab", "c", "1é"]
    assert one(spark, tx.query_text(F.lit("enwiki:A%20b/c"))) == "A b c"
    assert one(spark, tx.entity_name(F.lit("enwiki:A%20b c"))) == "A_b_c"
    assert one(spark, tx.sentences(F.lit("a. b.. c0"))) == ["a", "b", "c0"]
    assert one(spark, tx.analyzed(F.lit("The cats' running"), "english")) == ["cat", "run"]


@pytest.mark.parametrize(
    "word,stem",
    [("caresses", "caress"), ("ponies", "poni"), ("agreed", "agre"), ("plastered", "plaster"), ("motoring", "motor"),
     ("hopping", "hop"), ("filing", "file"), ("happy", "happi"), ("relational", "relat"), ("rational", "ration"),
     ("formalize", "formal"), ("adoption", "adopt"), ("probate", "probat"), ("controll", "control"), ("sky", "sky")],
)
def test_stem(word, stem):
    assert tx.stem(word) == stem


def test_hierarchy(spark):
    df = spark.createDataFrame([(["p", "a", "b"], 1)], "path array<string>, x long")
    assert {r["query"] for r in hierarchy.query_set(df).collect()} == {"p", "p/a", "p/a/b"}
    assert {r["query"] for r in hierarchy.roll_up(df, "path", "x").collect()} == {"p/a", "p/a/b"}


def test_norms(spark):
    df = spark.createDataFrame([("q", 1.0), ("q", 2.0), ("q", 3.0), ("c", 5.0), ("c", 5.0)], "q string, x double")
    z = [r[0] for r in df.select(F.round(stats.zscore(F.col("x"), "q"), 5).alias("z"), "q", "x").orderBy("q", "x").collect()]
    assert z == [0, 0, -0.70711, 0, 0.70711]
    assert [r[0] for r in df.where("q = 'q'").orderBy("x").select(stats.linear(F.col("x"), "q")).collect()] == [0, 0.5, 1]
    s = spark.createDataFrame([("q", 1.0), ("q", 1.0), ("q", 2.0)], "q string, x double").select(stats.by_sum(F.col("x"), "q").alias("s"))
    assert sorted(r[0] for r in s.collect()) == [0.25, 0.25, 0.5]
    c = spark.createDataFrame([("q", 3.0), ("q", 4.0)], "q string, x double")
    assert sorted(round(r[0], 6) for r in c.select(stats.square_sum(F.col("x"), "q")).collect()) == [0.12, 0.16]
    assert sorted(round(r[0], 6) for r in c.select(stats.unit(F.col("x"), "q")).collect()) == [0.6, 0.8]


def test_average_precision(spark):
    rows = spark.createDataFrame([(1, 3.0, 1, 1), (1, 2.0, 2, 0), (1, 1.0, 3, 1)], "query_id int, score double, doc_id int, rel int")
    assert round(scores.average_precision(rows).first()["ap"], 5) == 0.83333
    n = spark.createDataFrame([(1, 4)], "query_id int, n_rel int")
    assert round(scores.average_precision(rows, "total", n).first()["ap"], 5) == 0.41667
    none = rows.withColumn("rel", F.lit(0))
    assert scores.average_precision(none).first()["ap"] == 0


def test_likelihood_and_distance(spark):
    c = spark.createDataFrame([(1, 1)], "query_id long, doc_id long")
    q = spark.createDataFrame([(1, "x", 1.0)], "query_id long, term string, boost double")
    p = spark.createDataFrame([(1, "x", 1)], "doc_id long, term string, tf long")
    t = spark.createDataFrame([("x", 0.5)], "term string, cf double")
    dl = spark.createDataFrame([(1, 2)], "doc_id long, dl long")
    assert round(features.likelihood(c, q, p, t, dl).first()["score"], 5) == -0.69315
    q2 = q.withColumn("boost", F.lit(2.0))
    assert features.query_distance(c, q2, p.where("false")).first()["score"] == 0
    a = spark.createDataFrame([("p", "a", 0.5), ("p", "b", 0.5)], "a_id string, term string, p double")
    e = spark.createDataFrame([("e", "a", 1.0)], "b_id string, term string, e double")
    assert round(features.log_overlap(a, e).first()["score"], 5) == -0.69315


def test_search(spark):
    docs = spark.createDataFrame([(1, "a b"), (2, "a a c"), (3, "d"), (4, None)], "doc_id long, text string")
    ix = se.Index(index.postings(docs))
    q = se.query_terms(spark.createDataFrame([(9, "a b")], "query_id long, text string"))
    assert [r["doc_id"] for r in ix.search(q, 10).orderBy("rank").collect()] == [1, 2]
    must = q.withColumn("occur", F.lit("must"))
    assert [r["doc_id"] for r in ix.search(must, 10).collect()] == [1]
    assert ix.search(q.where("false"), 10).count() == 0


def test_joint_and_neighbours(spark):
    p = spark.createDataFrame(
        [("u", 1, 1, "a", 1), ("u", 1, 1, "b", 1), ("u", 1, 2, "a", 1), ("u", 1, 3, "a", 1)], "field string, doc_id long, pid long, term string, tf long"
    )
    got = {(r["pid"], r["term"]): r["tf"] for r in index.joint_postings(p).collect()}
    assert got == {(1, "a"): 2, (2, "a"): 1, (3, "a"): 1}
    assert index.neighbor_postings(p).count() == 6


def test_edges_are_distinct(spark):
    docs = spark.createDataFrame([(1, 7)], "query_id long, doc_id long")
    m = spark.createDataFrame([(7, "e1"), (7, "e1")], "doc_id long, name string")
    e = scores.mention_edges(docs, m)
    assert [tuple(r) for r in e.collect()] == [(1, 7, "e1", 1.0)]
    s = spark.createDataFrame([(1, 7, 2.0)], "query_id long, node long, score double")
    assert scores.pushed(s, e).first()["score"] == 2.0


def test_graph(spark):
    t = spark.createDataFrame([(["a", "b", "a", "b"],)], "terms array<string>")
    e = graph.co_occurrence(t)
    assert {tuple(r) for r in e.collect()} == {("a", "b", 2.0), ("b", "a", 1.0)}
    assert {r["src"]: r["w"] for r in graph.reweighted(e, "inverse_log").collect()}["b"] == 0
    h = graph.hub_scores(e, 3)
    assert math.isclose(h.agg(F.sum("score")).first()[0], 1.0, abs_tol=1e-6)
    chain = spark.createDataFrame([("a", "b", 1.0), ("b", "c", 1.0), ("a", "c", 5.0)], "src string, dst string, w double")
    d = graph.shortest_paths(chain, spark.createDataFrame([("a",)], "node string"))
    assert {r["node"]: r["distance"] for r in d.collect()} == {"a": 0, "b": 1, "c": 2}


def test_vectors(spark):
    a, b = arr(3.0, 4.0), arr(4.0, 3.0)
    assert one(spark, vectors.norm(a)) == 5
    assert round(one(spark, vectors.cosine(a, b)), 4) == 0.96
    assert one(spark, vectors.cosine(a, arr(0.0, 0.0))) == 0
    assert round(sum(one(spark, vectors.softmax(a))), 9) == 1
    assert one(spark, vectors.rational(F.lit(6).cast("long"), F.lit(-4).cast("long"))).asDict() == {"n": -3, "d": 2}
    assert one(spark, vectors.fixed_point(F.lit(2), F.lit(-3))) == 3


def test_learning(spark):
    rows = [(q, i, int(i % 3 == 0), [float(i % 3 == 0), float((i * 7) % 5)]) for q in range(4) for i in range(9)]
    df = spark.createDataFrame(rows, "qid long, id long, rel int, features array<double>").cache()
    w, curve = learn.coordinate_search(lambda t: learn.evaluate_map(df, t), 2, rounds=6)
    assert curve == sorted(curve) and curve[-1] > curve[0]
    chosen, best = learn.forward_selection(df, 2)
    assert chosen[0] == 0 and best == 1.0
    _, c = learn.gradient_ascent(df, 2, rounds=2)
    assert c == sorted(c)
    _, s = learn.stochastic_search(lambda t: [-(x[0] - 0.2) ** 2 for x in t], 1, rounds=12)
    assert s[-1] > -0.05 and s == sorted(s)


def test_files(spark, tmp_path):
    rel = spark.createDataFrame([("q/a", "p1", 1)], "query string, id string, rel int")
    sinks.write_lines(sinks.qrel_lines(rel), f"{tmp_path}/q")
    assert [tuple(r) for r in tables.read_qrels(spark, f"{tmp_path}/q").collect()] == [("q/a", "p1", 1)]
    run = sinks.run_rows(spark.createDataFrame([("q/a", "x", 2.0), ("q/a", "y", 3.0), ("q", "z", 1.0)], "query string, name string, score double"), tag="T", below_article=True)
    sinks.write_lines(sinks.run_lines(run), f"{tmp_path}/r")
    assert [(r["id"], r["rank"]) for r in tables.read_run(spark, f"{tmp_path}/r").orderBy("rank").collect()] == [("y", 1), ("x", 2)]
    f = spark.createDataFrame([(1, 3, [0.5, 2.0], "q", 8, "PARAGRAPH")], "rel int, qid int, features array<double>, name string, id long, kind string")
    sinks.write_lines(sinks.ranklib_lines(f), f"{tmp_path}/l")
    back = tables.read_ranklib(spark, f"{tmp_path}/l").first()
    assert (back["rel"], back["qid"], back["features"]) == (1, 3, [0.5, 2.0])


def test_click_qrels(spark):
    clicks = spark.createDataFrame([("s", "e", 2), ("s", "e", 3), ("s", "f", 0)], "source string, target string, n long")
    m = spark.createDataFrame([(1, "e"), (1, "e"), (2, "f")], "doc_id long, name string")
    assert [tuple(r) for r in candidates.click_qrels(clicks, m).collect()] == [("s", 1, 5)]


def test_click_qrels_by_blocks(spark, monkeypatch):
    """Pairs of several blocks equal brute force, and no row is made for a pair's single names: nothing is joined."""
    import random

    rng = random.Random(14)
    monkeypatch.setattr(candidates, "SIDE", 7, raising=False)
    clicks = [(f"s{rng.randrange(40)}", f"e{rng.randrange(30)}", rng.choice([-1, 0, 1, 2, 3 << 31])) for _ in range(150)] + [("s1", None, 5), ("s2", "e1", None), (None, "e2", 4)]
    m = [(rng.randrange(50), f"e{rng.randrange(60)}") for _ in range(200)] + [(3, None), (None, "e2")]
    rel = {}
    for doc, name in set(m):
        for source, target, n in clicks:
            if name is not None and name == target:
                rel[source, doc] = rel.get((source, doc), 0) + (n or 0)
    df = candidates.click_qrels(spark.createDataFrame(clicks, "source string, target string, n long"), spark.createDataFrame(m, "doc_id long, name string"))
    got = [tuple(r) for r in df.collect()]
    assert len(got) == len(set(got)) and {(s, d): n for s, d, n in got} == {k: n for k, n in rel.items() if n > 0}
    assert "Join" not in df._jdf.queryExecution().toString()
    none = candidates.click_qrels(spark.createDataFrame([], "source long, target string, n long"), spark.createDataFrame(m, "doc_id long, name string"))
    assert none.collect() == [] and none.columns == ["source", "doc_id", "rel"]


def test_incremental_index(spark, tmp_path):
    for k, rows in enumerate(([(1, "a b")], [(2, "a"), (1, "a")])):
        spark.createDataFrame(rows, "doc_id long, text string").write.mode("append").parquet(f"{tmp_path}/in")
        indexing.start_indexing(indexing.document_stream(spark, f"{tmp_path}/in"), f"{tmp_path}/ix", f"{tmp_path}/cp", once=True).awaitTermination()
    got = {(r["doc_id"], r["term"]): r["tf"] for r in indexing.merged(spark, f"{tmp_path}/ix").collect()}
    assert got == {(1, "a"): 2, (1, "b"): 1, (2, "a"): 1}
