"""Queries on small tables of their own: nothing of the input is left out."""

from collections import Counter

from termloom.plans import ranking, retrieval
from termloom.sources import sinks, tables


def tables_of(spark, path, **tables):
    for name, (rows, schema) in tables.items():
        spark.createDataFrame(rows, schema).write.parquet(f"{path}/{name}.parquet")
    return str(path)


def test_neighbour_postings_need_no_label(spark, tmp_path):
    texts = {1: "a b\nb c", 2: "x\ny x", 3: "q"}
    d = tables_of(spark, tmp_path, documents=(list(texts.items()), "doc_id long, text string"), labels=([(1, 1, 0)], "doc_id long, quality int, toxic int"))
    want = set()
    for doc, text in texts.items():
        tf = Counter(text.split())
        want |= {(doc, pos, len(tf), sum(tf.values())) for pos in range(len(text.split("\n")))}
    assert {tuple(r) for r in retrieval.neighbor_unigrams(spark, d).collect()} == want


def test_learning_to_rank_rows_of_every_label(spark, tmp_path):
    docs = [(1, "x", "b", 10), (2, "y", "a", 20), (3, "z", "b", 30), (4, "no label", "c", 40), (5, "w", None, 50)]
    labels = [(1, 1, 0), (2, 0, 1), (3, 0, 0), (5, 1, 1)]
    d = tables_of(spark, tmp_path / "in", documents=(docs, "doc_id long, text string, source string, n_chars long"), labels=(labels, "doc_id long, quality int, toxic int"))
    sinks.write_lines(ranking.ranklib_schema(spark, d), f"{tmp_path}/l")
    got = {(r["rel"], r["qid"], tuple(r["features"]), r["info"]) for r in tables.read_ranklib(spark, f"{tmp_path}/l").collect()}
    assert got == {
        (1, 3, (0.0, 10.0), "b # 1 PARAGRAPH"), (0, 2, (1.0, 20.0), "a # 2 PARAGRAPH"),
        (0, 3, (0.0, 30.0), "b # 3 PARAGRAPH"), (1, 1, (1.0, 50.0), "# 5 PARAGRAPH"),
    }


def test_paragraphs_with_markup_and_without_ends(spark):
    html = (
        "<body><pre><p>in pre</p></pre><P class=\"a>b\">one <b>bo</b>ld<br/>line <a href='/x'>link</a></P><p id=it's>two"
        "<p>three < 3<!-- <p>no -->\n<script>var x = '<b>';</script>more<h2>not this</h2><p></p><param name=x>"
        "<div><p>four</div>not this<p>five"
    )
    pages = spark.createDataFrame([(1, html), (2, None), (3, "<b>none</b>")], "page_id long, html string")
    got = [tuple(r) for r in tables.page_paragraphs(pages).orderBy("page_id", "pos").collect()]
    texts = ["in pre", "one bold line link", "two", "three < 3\nmore", "", "four", "five"]
    assert got == [(1, k, x) for k, x in enumerate(texts)]
    long = spark.createDataFrame([(1, "<p>" + "a <b>b</b> " * 200000 + "</p>")], "page_id long, html string")
    assert len(tables.page_paragraphs(long).first()["text"].split()) == 400000
