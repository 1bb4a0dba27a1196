"""Paths, prefixes and roll-ups of hierarchies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from termloom.session import written

#: Levels that headings have.
LEVELS = 6


def prefixes(path) -> Column:
    """All prefixes of a path array, the shortest first."""
    p = F.col(path) if isinstance(path, str) else path
    return F.transform(F.sequence(F.lit(1), F.size(p)), lambda i: F.slice(p, 1, i))


def query_set(paths: DataFrame, path: str = "path") -> DataFrame:
    """Every distinct prefix of every path, as a slash-joined query with its depth."""
    return paths.select(F.explode(prefixes(path)).alias("p")).select(F.array_join("p", "/").alias("query"), F.size("p").alias("depth")).distinct()


def roll_up(rows: DataFrame, path: str, item: str, least_depth: int = 2) -> DataFrame:
    """Each item at every prefix of its path of enough depth, once."""
    return (
        rows.select(F.explode(prefixes(path)).alias("p"), item)
        .where(F.size("p") >= least_depth)
        .select(F.array_join("p", "/").alias("query"), item)
        .distinct()
    )


def parents(paths: DataFrame, path: str = "path") -> DataFrame:
    """(node, parent, depth) of all prefixes; the root's parent is null."""
    p = paths.select(F.explode(prefixes(path)).alias("p")).distinct()
    return p.select(
        F.array_join("p", "/").alias("node"),
        F.when(F.size("p") > 1, F.array_join(F.slice("p", F.lit(1), F.size("p") - 1), "/")).alias("parent"),
        F.size("p").alias("depth"),
    )


def subtree_sums(values: DataFrame, path: str, value: str) -> DataFrame:
    """The sum of a value over each node's subtree, by prefixes instead of a bottom-up loop."""
    return values.select(F.explode(prefixes(path)).alias("p"), value).groupBy(F.array_join("p", "/").alias("node")).agg(F.sum(value).alias(value))


def open_headings(headings: DataFrame, tree: str = "page_id") -> DataFrame:
    """The outline of each tree's headings (tree, pos, level, heading), in page order.

    A heading is open until one of its level or a higher one comes. Adds path, the open
    headings down to this one, parent (the place of the one above, null at the top),
    depth, and the numbers pre and post of a walk that counts a node before and after
    those below it. Windows over a page's headings stand for a stack: of every level
    the last heading, closed where a higher one is later.
    """
    upto = Window.partitionBy(tree).orderBy("pos")
    rest = Window.partitionBy(tree).orderBy("pos").rowsBetween(1, Window.unboundedFollowing)
    rows = headings
    for level in range(1, LEVELS + 1):
        own = F.when(F.col("level") == level, F.struct("pos", "heading"))
        rows = rows.withColumn(f"_h{level}", F.last(own, ignorenulls=True).over(upto))
        rows = rows.withColumn(f"_c{level}", F.max(F.when(F.col("level") < level, F.col("pos"))).over(upto))
        rows = rows.withColumn(f"_n{level}", F.min(F.when(F.col("level") <= level, F.col("pos"))).over(rest))
    is_open = [
        F.when((F.lit(k) <= F.col("level")) & (F.col(f"_h{k}.pos") > F.coalesce(f"_c{k}", F.lit(-1))), F.col(f"_h{k}")) for k in range(1, LEVELS + 1)
    ]
    path = F.filter(F.array(*is_open), lambda x: x.isNotNull())
    after = F.coalesce(*[F.when(F.col("level") == k, F.col(f"_n{k}")) for k in range(1, LEVELS + 1)])
    rows = rows.withColumn("_o", path).withColumn("_after", after)
    number = F.row_number().over(upto) - 1
    # headings from here to the next of this level or a higher one are below this one
    count = F.count(F.lit(1)).over(Window.partitionBy(tree))
    rows = rows.withColumn("pre", number).withColumn("_all", count)
    first = rows.select(F.col(tree), F.col("pos").alias("_after"), F.col("pre").alias("_next"))
    out = rows.join(first, [tree, "_after"], "left").withColumn("_size", F.coalesce("_next", F.col("_all")) - F.col("pre"))
    depth = F.size("_o")
    return out.select(
        tree, "pos", "level", "heading", F.transform("_o", lambda x: x["heading"]).alias("path"),
        F.when(depth > 1, F.get("_o", depth - 2)["pos"]).alias("parent"), depth.alias("depth"),
        F.col("pre").alias("pre"), (F.col("pre") + F.col("_size") - depth).cast("int").alias("post"),
    )


def numbered(rows: DataFrame, *order: str, name: str = "number") -> DataFrame:
    """Rows with their place, from 0, in one order of the whole table, which no single task sees.

    Ranges of the order are dealt to tasks and stored; a row's number is its place in
    its range after all rows of ranges before, whose sizes alone come to the driver.
    """
    spark = rows.sparkSession
    dealt = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    # an identifier holds the range in its upper bits, the place in the others
    dealt = written(dealt.withColumn("_id", F.monotonically_increasing_id()).withColumn("_range", F.shiftright("_id", 33)), "numbered")
    sizes = dict(dealt.groupBy("_range").count().collect())
    before, table = 0, []
    for k in sorted(sizes):
        table.append((k, before))
        before += sizes[k]
    offsets = spark.createDataFrame(table, "_range long, _before long")
    place = F.col("_id").bitwiseAND(F.lit((1 << 33) - 1))
    return dealt.join(F.broadcast(offsets), "_range").withColumn(name, F.col("_before") + place).drop("_id", "_range", "_before")


def orders(paths: DataFrame, path: str = "path") -> DataFrame:
    """(node, depth, pre, post): all prefixes of paths (arrays) as trees, numbered by walks over all trees.

    pre counts a node before those below it, post after them; siblings go by name.
    A node's number after is its number before and those below it, less those above.
    """
    below = paths.select(path).distinct().select(F.explode(prefixes(path)).alias("p"))
    nodes = below.distinct()
    sizes = nodes.select(F.explode(prefixes("p")).alias("p")).groupBy("p").agg(F.count("*").alias("_size"))
    out = numbered(sizes, "p", name="pre")
    return out.select(
        F.array_join("p", "/").alias("node"), F.size("p").alias("depth"), "pre", (F.col("pre") + F.col("_size") - F.size("p")).alias("post")
    )
