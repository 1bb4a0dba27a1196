"""The nearest of many sparse vectors, exactly, through an inverted join with norm bounds."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from termloom.session import written

#: Rarest terms of a vector that find a first near one.
FIRST = 3


def unit_vectors(p: DataFrame, key: str, df: DataFrame, n: int) -> DataFrame:
    """(key, term, w) of postings (key, term, tf): tf times the logarithm of n over df (term, df), scaled to length 1."""
    w = p.join(df, "term").select(key, "term", (F.col("tf") * F.ln(1 + F.lit(n) / F.col("df"))).alias("w"))
    norm = F.sqrt(F.sum(F.col("w") * F.col("w")).over(Window.partitionBy(key)))
    return w.select(key, "term", (F.col("w") / norm).alias("w"))


def nearest(queries: DataFrame, others: DataFrame, df: DataFrame, digits: int = 9) -> DataFrame:
    """(q, id, cosine): for each query vector (q, term, w) the other one (id, term, w) of largest cosine, ties by id.

    A query's rarest terms find a few others, of which the best gives a bound. Whatever
    beats it shares a term of the query outside of those common ones whose weights
    together are shorter than the bound; so only terms before that tail, from the rarest
    on, look for candidates, and only these are compared whole. Vectors without a
    shared term never meet. df has (term, df), where others' terms occur.
    """
    order = Window.partitionBy("q").orderBy("df", "term")
    rows = queries.join(df, "term").withColumn("_k", F.row_number().over(order))
    tail = F.sum(F.col("w") * F.col("w")).over(order.rowsBetween(1, Window.unboundedFollowing))
    # the length of what comes after a term, this one included
    rows = written(rows.withColumn("_rest", F.sqrt(F.coalesce(tail, F.lit(0.0)) + F.col("w") * F.col("w"))), "queries")
    o = others.select("id", "term", F.col("w").alias("_v"))

    def compared(found: DataFrame) -> DataFrame:
        dots = found.join(rows.select("q", "term", "w"), "q").join(o, ["id", "term"])
        return dots.groupBy("q", "id").agg(F.round(F.sum(F.col("w") * F.col("_v")), digits).alias("cosine"))

    first = rows.where(F.col("_k") <= FIRST).select("q", "term").join(o.select("id", "term"), "term").select("q", "id").distinct()
    bound = written(compared(first).groupBy("q").agg(F.max("cosine").alias("_bound")), "bounds")
    # less a little, as sums are rounded; others are of length 1
    ahead = rows.join(bound, "q", "left").where(F.col("_rest") >= F.coalesce("_bound", F.lit(0.0)) - 1e-6)
    found = ahead.select("q", "term").join(o.select("id", "term"), "term").select("q", "id").distinct()
    best = compared(found).groupBy("q").agg(F.min(F.struct((-F.col("cosine")).alias("less"), "id")).alias("b"))
    return best.select("q", "b.id", (-F.col("b.less")).alias("cosine"))
