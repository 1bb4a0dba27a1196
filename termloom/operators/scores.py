"""Feature algebra, propagation over edges, and evaluation."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from termloom.functions import stats


def normalised(features: DataFrame, kind: str = "zscore", keys: tuple[str, ...] = ("query_id", "feature")) -> DataFrame:
    """Adds norm to feature rows (…, raw)."""
    return features.withColumn("norm", stats.NORMS[kind](F.col("raw").cast("double"), *keys))


def rescored(features: DataFrame, keys: tuple[str, ...] = ("query_id", "doc_id")) -> DataFrame:
    """Sum of norm times weight of each candidate."""
    return features.groupBy(*keys).agg(F.sum(F.col("norm") * F.col("weight")).alias("score"))


def pushed(scores: DataFrame, edges: DataFrame, normalize: bool = False) -> DataFrame:
    """(query_id, node, score) sent along (query_id, src, dst, w): added up at each target."""
    w = stats.by_sum(F.col("w"), "query_id", "src") if normalize else F.col("w")
    e = edges.select("query_id", F.col("src").alias("node"), "dst", w.alias("w"))
    return scores.join(e, ["query_id", "node"]).groupBy("query_id", F.col("dst").alias("node")).agg(F.sum(F.col("score") * F.col("w")).alias("score"))


def added(base: DataFrame, more: DataFrame) -> DataFrame:
    return base.unionByName(more).groupBy("query_id", "node").agg(F.sum("score").alias("score"))


def propagate(source: str, scores: dict[str, DataFrame], edges: dict[tuple[str, str], DataFrame]) -> dict[str, DataFrame]:
    """Joint propagation: paragraphs reach entities and sections, sections reach paragraphs and with them entities,
    entities reach paragraphs and with them sections. Later hops start from sums of earlier ones."""
    out = dict(scores)
    hops = {
        "paragraph": (("paragraph", "entity"), ("paragraph", "section")),
        "section": (("section", "paragraph"), ("paragraph", "entity")),
        "entity": (("entity", "paragraph"), ("paragraph", "section")),
    }[source]
    for a, b in hops:
        sent = pushed(out[a], edges[a, b])
        out[b] = added(out[b], sent) if b in out else sent
    return out


def mention_edges(query_docs: DataFrame, mentions: DataFrame) -> DataFrame:
    """Edges of weight 1 from documents to the entities that they mention, each once."""
    return query_docs.select("query_id", "doc_id").join(mentions.select("doc_id", "name").distinct(), "doc_id").select(
        "query_id", F.col("doc_id").alias("src"), F.col("name").alias("dst"), F.lit(1.0).alias("w")
    )


def reversed_edges(edges: DataFrame) -> DataFrame:
    return edges.select("query_id", F.col("dst").alias("src"), F.col("src").alias("dst"), "w")


def average_precision(ranked: DataFrame, denominator: str = "retrieved", n_rel: DataFrame | None = None) -> DataFrame:
    """(query_id, ap) of (query_id, score, doc_id, rel).

    The denominator is the relevant documents retrieved, all relevant ones
    ("total", n_rel has query_id and n_rel), or 1 with graded relevance ("graded",
    a running sum of rel).
    """
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "doc_id")
    run = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = ranked.withColumn("rank", F.row_number().over(w)).withColumn("seen", F.sum("rel").over(run))
    gain = F.sum(F.when(F.col("rel") > 0, F.col("seen") / F.col("rank")).otherwise(0.0)).alias("gain")
    out = rows.groupBy("query_id").agg(gain, F.sum(F.when(F.col("rel") > 0, 1).otherwise(0)).alias("found"), F.sum("rel").alias("mass"))
    if denominator == "total":
        out = out.join(n_rel, "query_id", "left").withColumn("found", F.coalesce("n_rel", F.lit(0)))
    if denominator == "graded":
        out = out.withColumn("found", F.col("mass"))
    return out.select("query_id", stats.ratio(F.col("gain"), F.col("found")).alias("ap"))


def mean_average_precision(ranked: DataFrame, **options) -> DataFrame:
    return average_precision(ranked, **options).agg(F.avg("ap").alias("map"))


def log_objective(scored: DataFrame, floor: float = 1e-5) -> DataFrame:
    """Sum over relevant candidates of ln(score), a score of 0 counting as floor."""
    s = F.when(F.col("score") == 0, F.lit(floor)).otherwise(F.col("score"))
    return scored.where("rel > 0").groupBy("query_id").agg(F.sum(F.when(s > 0, F.ln(s)).otherwise(0.0)).alias("objective"))


def rank_margin(scored: DataFrame) -> DataFrame:
    """The worst relevant score less the best other one."""
    return scored.groupBy("query_id").agg(
        (F.min(F.when(F.col("rel") > 0, F.col("score"))) - F.max(F.when(F.col("rel") <= 0, F.col("score")))).alias("margin")
    )


def marginal(weights: DataFrame, matrix: DataFrame) -> DataFrame:
    """(query_id, col, score): the sum over rows of weight times cell."""
    return matrix.join(weights, ["query_id", "row"]).groupBy("query_id", "col").agg(F.sum(F.col("weight") * F.col("value")).alias("score"))
