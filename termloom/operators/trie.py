"""Objectives over a trie of queries: every node has scores of the same items, sweeps go by levels.

A trie is a table (node, item, score, rel): node is a path array, and its children are
the paths one longer that begin with it. A sweep up or down takes one join a level, so
its cost is the depth of the trie, not its size; no subtree is gathered anywhere.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from termloom.functions import stats
from termloom.operators import hierarchy
from termloom.operators import scores as sc
from termloom.session import written


def rolled(rows: DataFrame) -> DataFrame:
    """(node, item, score, rel) of leaves (path, item, score, rel): a node has the sum of what lies below it, and is relevant if any of that is."""
    each = rows.select(F.explode(hierarchy.prefixes("path")).alias("node"), "item", "score", "rel")
    return each.groupBy("node", "item").agg(F.sum("score").alias("score"), F.max("rel").alias("rel"))


def parent_of(node="node"):
    """The path above, null at the top."""
    n = F.col(node)
    return F.when(F.size(n) > 1, F.slice(n, F.lit(1), F.size(n) - 1))


def leaves(trie: DataFrame) -> DataFrame:
    """Rows of nodes that have no child."""
    above = trie.select(parent_of().alias("node")).where("node is not null").distinct()
    return trie.join(above, "node", "left_anti")


def node_precision(trie: DataFrame, n_rel: DataFrame | None = None) -> DataFrame:
    """(node, ap): average precision of each node's ranking of items, over all its relevant ones (node, n_rel) or those it has."""
    ranked = trie.select(F.col("node").alias("query_id"), F.col("item").alias("doc_id"), "score", "rel")
    many = n_rel if n_rel is not None else trie.groupBy("node").agg(F.sum("rel").alias("n_rel"))
    many = many.select(F.col("node").alias("query_id"), F.greatest(F.col("n_rel"), F.lit(1)).alias("n_rel"))
    return sc.average_precision(ranked, "total", many).withColumnRenamed("query_id", "node")


def pushed_forward(trie: DataFrame) -> DataFrame:
    """Adds share: a node's part of what its item scores at all children of the node above; 1 at the top."""
    above = parent_of()
    # null parents would all be one group
    keyed = trie.withColumn("_up", F.coalesce(above, F.array().cast("array<string>")))
    share = stats.by_sum(F.col("score"), "_up", "item")
    return keyed.withColumn("share", F.when(F.size("node") > 1, share).otherwise(1.0)).drop("_up")


def _levels(trie: DataFrame) -> int:
    return trie.agg(F.max(F.size("node"))).first()[0] or 0


def marginals(trie: DataFrame, start: str = "rel") -> DataFrame:
    """(node, item, score): the top has its start, and every node hands down its score by its children's shares, a level a join."""
    rows = written(pushed_forward(trie), "pushed")
    top = rows.where(F.size("node") == 1).select("node", "item", F.col(start).cast("double").alias("score"))
    out, level = top, top
    for k in range(2, _levels(rows) + 1):
        below = rows.where(F.size("node") == k).select("node", parent_of().alias("_up"), "item", "share")
        up = level.select(F.col("node").alias("_up"), "item", "score")
        level = written(below.join(up, ["_up", "item"]).select("node", "item", (F.col("share") * F.col("score")).alias("score")), "level")
        out = out.unionByName(level)
    return out


def max_products(trie: DataFrame) -> DataFrame:
    """(node, item, score): the largest product of scores on a way from a node down to a leaf, a level a join from below."""
    deep = _levels(trie)
    out, level = None, None
    for k in range(deep, 0, -1):
        own = trie.where(F.size("node") == k).select("node", "item", "score")
        if level is not None:
            best = level.groupBy(parent_of().alias("node"), "item").agg(F.max("score").alias("_best"))
            own = own.join(best, ["node", "item"], "left").select("node", "item", (F.col("score") * F.coalesce("_best", F.lit(1.0))).alias("score"))
        level = written(own, "level")
        out = level if out is None else out.unionByName(level)
    return out if out is not None else trie.select("node", "item", "score")


def best_leaves(trie: DataFrame) -> DataFrame:
    """(node, item, score) of leaves: an item keeps its score where it is its best, ties included, and has 0 elsewhere."""
    best = F.max("score").over(Window.partitionBy("item"))
    return leaves(trie).select("node", "item", F.when(F.col("score") == best, F.col("score")).otherwise(0.0).alias("score"))


def dispersion(trie: DataFrame) -> DataFrame:
    """(node, dispersion): over the items relevant to a child, how far children's scores lie from their mean, a child on average."""
    rows = trie.where(F.size("node") > 1).select(parent_of().alias("up"), "node", "item", "score", "rel")
    any_rel = rows.groupBy("up", "item").agg(F.max("rel").alias("_r")).where("_r > 0").select("up", "item")
    many = rows.groupBy("up").agg(F.countDistinct("node").alias("_n"))
    kept = rows.join(any_rel, ["up", "item"], "left_semi").join(many, "up")
    # a child without the item scores 0 there
    sums = kept.groupBy("up", "item", "_n").agg(F.sum("score").alias("_s"), F.count("*").alias("_c"))
    far = kept.join(sums.select("up", "item", "_s"), ["up", "item"])
    near = far.groupBy("up", "item").agg(F.sum(F.abs(F.col("score") - F.col("_s") / F.col("_n"))).alias("_d"))
    total = near.join(sums, ["up", "item"]).select("up", "_n", (F.col("_d") + (F.col("_n") - F.col("_c")) * F.abs(F.col("_s") / F.col("_n"))).alias("_d"))
    return total.groupBy(F.col("up").alias("node"), "_n").agg(F.sum("_d").alias("_d")).select("node", (F.col("_d") / F.col("_n")).alias("dispersion"))
