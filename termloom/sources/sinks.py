"""Writers of run, relevance, learning-to-rank and report files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def index_table(postings: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Postings by field, sorted by term so that row groups prune term lookups."""
    postings.repartition("field", F.pmod(F.xxhash64("term"), F.lit(64))).sortWithinPartitions("term").write.mode(mode).partitionBy(
        "field"
    ).parquet(path)


def run_rows(scored: DataFrame, *, tag: str, best: bool = False, encode: bool = False, below_article: bool = False) -> DataFrame:
    """(query, name, score) to (query, id, rank, score, tag); best keeps each name's best score."""
    df = scored.where(F.contains("query", F.lit("/"))) if below_article else scored
    if best:
        df = df.groupBy("query", "name").agg(F.max("score").alias("score"))
    w = Window.partitionBy("query").orderBy(F.desc("score"), "name")
    name = F.concat(F.lit("enwiki:"), F.replace("name", F.lit("_"), F.lit("%20"))) if encode else F.col("name")
    return df.withColumn("rank", F.row_number().over(w)).select("query", name.alias("id"), "rank", "score", F.lit(tag).alias("tag"))


def run_lines(rows: DataFrame) -> DataFrame:
    return rows.select(F.concat_ws(" ", "query", F.lit("Q0"), "id", "rank", "score", "tag").alias("value"))


def qrel_lines(qrels: DataFrame) -> DataFrame:
    return qrels.select(F.concat_ws(" ", "query", F.lit("0"), "id", F.col("rel").cast("string")).alias("value"))


def ranklib_lines(features: DataFrame, *keep: str) -> DataFrame:
    """(rel, qid, features, name, id, kind) to learning-to-rank rows; columns in keep stay beside them."""
    numbered = F.transform("features", lambda x, i: F.concat_ws(":", (i + 1).cast("string"), x.cast("string")))
    return features.select(
        *keep,
        F.concat(
            F.col("rel").cast("string"), F.lit(" qid:"), F.col("qid").cast("string"), F.lit(" "), F.array_join(numbered, " "),
            F.lit(" #"), F.col("name"), F.lit(" # "), F.col("id").cast("string"), F.lit(" "), F.col("kind"),
        ).alias("value")
    )


def extraction_rows(rows: DataFrame) -> DataFrame:
    """Lines of columns apart by tabs: arrays by spaces, tabs and line ends in texts as spaces, nulls as nothing."""
    cells = []
    for name, kind in rows.dtypes:
        text = F.array_join(name, " ") if kind.startswith("array") else F.col(name).cast("string")
        cells.append(F.coalesce(F.regexp_replace(text, r"[\t\r\n]", " "), F.lit("")))
    return rows.select(F.array_join(F.array(*cells), "\t").alias("value"))


def weight_lines(spark: SparkSession, weights: list[float], about: str = "") -> DataFrame:
    """A model file: what it is about, then numbered weights on its last line."""
    numbered = " ".join(f"{i}:{float(w)!r}" for i, w in enumerate(weights, 1))
    head = [f"## {x}" for x in about.splitlines()]
    return spark.createDataFrame([("\n".join([*head, numbered]),)], "value string")


def subset_lines(spark: SparkSession, features: list[int]) -> DataFrame:
    """A file of chosen features, a number a line."""
    return spark.createDataFrame([("\n".join(map(str, features)),)], "value string")


def write_lines(lines: DataFrame, path: str) -> None:
    lines.write.mode("overwrite").text(path)


def one_per_name(scored: DataFrame, seed: int) -> DataFrame:
    """A seeded pick of one row for each (query, name)."""
    w = Window.partitionBy("query", "name").orderBy(F.xxhash64(F.lit(seed), "query", "name", "id"))
    return scored.withColumn("_k", F.row_number().over(w)).where("_k = 1").drop("_k")


def report(sections: DataFrame, edges: DataFrame, top: int = 5) -> DataFrame:
    """HTML blocks: the top sections of a query, each with its top paragraphs not shown before.

    sections: query, section, score; edges: query, section, paragraph, weight. A
    paragraph is shown under the highest section that links it.
    """
    w = Window.partitionBy("query").orderBy(F.desc("score"), "section")
    best = sections.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= top)
    owner = Window.partitionBy("query", "paragraph").orderBy("rank")
    inner = Window.partitionBy("query", "section").orderBy(F.desc("weight"), "paragraph")
    shown = (
        edges.join(best, ["query", "section"])
        .withColumn("_o", F.row_number().over(owner))
        .where("_o = 1")
        .withColumn("place", F.row_number().over(inner))
        .where(F.col("place") <= top)
    )
    items = F.array_sort(F.collect_list(F.struct("place", F.concat(F.lit("<p>"), "paragraph", F.lit("</p>")).alias("p"))))
    blocks = shown.groupBy("query", "rank", "section").agg(items.alias("ps"))
    return blocks.select(
        "query", "rank", F.concat(F.lit("<h2>"), "section", F.lit("</h2>"), F.array_join(F.transform("ps", lambda x: x["p"]), "")).alias("html")
    )
