"""Command line: python -m termloom.cli query NAME --data DIR [--out DIR], index, append, run, qrels, train, list."""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from termloom.operators import diskindex, index, learn
from termloom.operators import search as se
from termloom.plans import catalog, ranking, retrieval
from termloom.sources import sinks
from termloom.sources import tables as src


def main(args: list[str] | None = None) -> None:
    top = argparse.ArgumentParser(prog="termloom")
    sub = top.add_subparsers(dest="command", required=True)
    for name, text in (
        ("list", "names of all queries"),
        ("query", "run a query"),
        ("index", "write the postings of documents"),
        ("append", "add documents to an index that is there"),
        ("run", "search benchmark items, in an index if one is given, and write a run file"),
        ("qrels", "write relevance files of benchmark items"),
        ("train", "learn feature weights"),
    ):
        p = sub.add_parser(name, help=text)
        if name != "list":
            p.add_argument("--data", required=True)
            p.add_argument("--out")
        if name == "query":
            p.add_argument("name")
        if name in ("run", "index", "append"):
            p.add_argument("--fields", nargs="*", default=["unigram"])
        if name == "run":
            p.add_argument("--index")
            p.add_argument("--similarity", default="bm25", choices=("bm25", "dirichlet", "tfidf"))
            p.add_argument("-k", type=int, default=100)
        if name == "train":
            p.add_argument("--rounds", type=int, default=10)
    a = top.parse_args(args)
    if a.command == "list":
        print("\n".join(sorted(catalog.QUERIES)))
        return
    spark = SparkSession.builder.getOrCreate()
    if a.command == "query":
        out = catalog.QUERIES[a.name](spark, a.data)
        out.write.mode("overwrite").parquet(a.out) if a.out else out.show(truncate=False)
    elif a.command in ("index", "append"):
        write = diskindex.create if a.command == "index" else diskindex.append
        write(index.postings(retrieval.docs(spark, a.data), fields=tuple(a.fields)), a.out)
    elif a.command == "run":
        if a.index:
            ix = se.Index.stored(diskindex.open_index(spark, a.index), a.fields[0])
        else:
            ix = se.Index(index.postings(retrieval.docs(spark, a.data), fields=(a.fields[0],)), a.fields[0])
        found = ix.search(retrieval.bench_terms(spark, a.data), a.k, a.similarity)
        named = found.select(F.col("query_id").cast("string").alias("query"), F.col("doc_id").cast("string").alias("name"), "score")
        sinks.write_lines(sinks.run_lines(sinks.run_rows(named, tag="Paragraph")), a.out)
    elif a.command == "qrels":
        q = retrieval._qrels(spark, a.data)
        lines = q.select(F.col("query_id").cast("string").alias("query"), F.col("doc_id").cast("string").alias("id"), "rel")
        sinks.write_lines(sinks.qrel_lines(lines), a.out)
    elif a.command == "train":
        rows = learn.by_column(ranking.l2r_rows(spark, a.data), 4).cache()
        w, curve = learn.coordinate_search(lambda t: learn.evaluate_map(rows, t), 4, a.rounds)
        print({"weights": w, "map": curve[-1]})


if __name__ == "__main__":
    main()
