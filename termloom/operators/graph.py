"""Term graphs: co-occurrence, weights, hubs, shortest paths, Voronoi cells.

Edges are (src, dst, w). Iterations are joins and aggregates; lineage is cut by a
written table every round, so a lost executor costs one round at most.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from termloom.functions import stats
from termloom.session import written


def co_occurrence(sequences: DataFrame, terms: str = "terms") -> DataFrame:
    """Directed edges of adjacent terms; the first and every further meeting add 1, no self loops."""
    t = F.col(terms)
    pairs = F.transform(F.sequence(F.lit(1), F.size(t) - 1), lambda i: F.struct(F.get(t, i - 1).alias("src"), F.get(t, i).alias("dst")))
    e = sequences.where(F.size(t) > 1).select(F.explode(pairs).alias("e")).select("e.src", "e.dst")
    return e.where("src != dst").groupBy("src", "dst").agg(F.count("*").cast("double").alias("w"))


WEIGHTS = {
    "inverse": lambda w: F.try_divide(F.lit(1.0), w),
    "inverse_square": lambda w: F.try_divide(F.lit(1.0), w * w),
    "exponential": lambda w: F.exp(-w),
    "inverse_log": lambda w: F.try_divide(F.lit(1.0), F.when(w > 0, F.ln(w))),
}


def reweighted(edges: DataFrame, kind: str) -> DataFrame:
    """Edges with a transformed weight; no finite value gives 0."""
    return edges.select("src", "dst", stats.finite(WEIGHTS[kind](F.col("w"))).alias("w"))


def transitions(edges: DataFrame) -> DataFrame:
    return edges.select("src", "dst", stats.by_sum(F.col("w"), "src").alias("w"))


#: Steps of a walk that one plan has; their sums are stored then, and looked at.
STEPS = 10


def hub_scores(edges: DataFrame, rounds: int = 400, tolerance: float = 1e-9, stay: float = 0.15) -> DataFrame:
    """(node, score): the long-run share of a random walk that restarts anywhere.

    Power iteration until a step moves less than tolerance in all; raises where
    that isn't reached in so many rounds. What ends at nodes without a way on restarts
    as well, which only scales the scores of a walk that loses it, so they are scaled
    once, at the end.
    """
    p = written(transitions(edges), "transitions")
    nodes = written(p.select(F.col("src").alias("node")).union(p.select("dst")).distinct(), "nodes")
    n = max(nodes.count(), 1)
    score = nodes.select("node", F.lit(1.0 / n).alias("score"))
    for _ in range(0, rounds, STEPS):
        for k in range(STEPS):
            sent = score.join(p, F.col("node") == F.col("src")).select(F.col("dst").alias("node"), (F.col("score") * F.col("w") * (1 - stay)).alias("in"), F.lit(0.0).alias("before"))
            # the last step of a plan keeps what was there before it
            kept = score if k == STEPS - 1 else nodes.withColumn("score", F.lit(0.0))
            ways = kept.select("node", F.lit(stay / n).alias("in"), F.col("score").alias("before")).unionByName(sent)
            score = ways.groupBy("node").agg(F.sum("in").alias("score"), F.sum("before").alias("before"))
        score = written(score, "hubs")
        moved, whole = score.agg(F.sum(F.abs(F.col("score") - F.col("before"))), F.sum("score")).first()
        score = score.select("node", "score")
        if (moved or 0.0) < tolerance:
            return score.select("node", (F.col("score") / (whole or 1.0)).alias("score"))
    raise RuntimeError(f"the walk still moves after {rounds} rounds")


def backwards(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "w")


def walked_edges(edges: DataFrame, **options) -> DataFrame:
    """(src, dst, score): how often walks along the edges, and as many against them, take an edge in the long run."""
    flows = []
    for e in (edges, backwards(edges)):
        steps = transitions(e).join(hub_scores(e, **options).withColumnRenamed("node", "src"), "src")
        flows.append(steps.select("src", "dst", (F.col("score") * F.col("w") / 2).alias("score")))
    ways = flows[0].unionByName(flows[1].select(F.col("dst").alias("src"), F.col("src").alias("dst"), "score"))
    return ways.groupBy("src", "dst").agg(F.sum("score").alias("score"))


def degree_edge_hubs(edges: DataFrame) -> DataFrame:
    """(src, dst, score): weight plus the logarithm of the strength that enters both ends."""
    s = edges.groupBy(F.col("dst").alias("node")).agg(F.sum("w").alias("s"))
    a, b = s.select(F.col("node").alias("src"), F.col("s").alias("sa")), s.select(F.col("node").alias("dst"), F.col("s").alias("sb"))
    both = edges.join(a, "src", "left").join(b, "dst", "left")
    strength = F.coalesce("sa", F.lit(0.0)) + F.coalesce("sb", F.lit(0.0))
    return both.select("src", "dst", (F.col("w") + F.when(strength > 0, F.ln(strength)).otherwise(0.0)).alias("score"))


def disjoint_edges(scored: DataFrame, most: int = 200) -> list[tuple]:
    """The best edges that share no node, greedily; the top-k report reads a bounded head."""
    used, out = set(), []
    for r in scored.orderBy(F.desc("score"), "src", "dst").limit(most * 20).collect():
        if r["src"] not in used and r["dst"] not in used:
            used |= {r["src"], r["dst"]}
            out.append((r["src"], r["dst"], r["score"]))
            if len(out) == most:
                break
    return out


def shortest_paths(edges: DataFrame, hubs: DataFrame, limit: float | None = None, rounds: int = 10_000) -> DataFrame:
    """(node, hub, distance) of every node that a hub reaches, within a distance if there is a limit.

    hubs has (node, hub): a hub may begin at several nodes; without hub each node is one. Distances fall until none
    does any more; a round goes one edge on from those that fell and is stored once.
    Raises if so many rounds don't suffice; as weights aren't negative, that takes a
    path of more edges.
    """
    if "hub" not in hubs.columns:
        hubs = hubs.withColumn("hub", F.col("node"))
    best = written(hubs.select("node", "hub", F.lit(0.0).alias("distance"), F.lit(True).alias("fell")).distinct(), "paths")
    for _ in range(rounds):
        front = best.where("fell").join(edges, F.col("node") == F.col("src"))
        reached = front.select(F.col("dst").alias("node"), "hub", (F.col("distance") + F.col("w")).alias("distance"))
        if limit is not None:
            reached = reached.where(F.col("distance") <= limit)
        known = F.min(F.when(F.col("known"), F.col("distance")))
        both = best.select("node", "hub", "distance", F.lit(True).alias("known")).unionByName(reached.withColumn("known", F.lit(False)))
        both = both.groupBy("node", "hub").agg(F.min("distance").alias("distance"), known.alias("_old"))
        fell = F.col("_old").isNull() | (F.col("distance") < F.col("_old"))
        best = written(both.select("node", "hub", "distance", fell.alias("fell")), "paths")
        if best.where("fell").isEmpty():
            return best.select("node", "hub", "distance")
    raise RuntimeError(f"distances still fall after {rounds} rounds")


def edge_distances(edges: DataFrame, hubs: DataFrame, limit: float | None = None) -> DataFrame:
    """(src, dst, hub, ahead, behind, distance): how far edges are from hub edges (src, dst, hub).

    The line graph isn't made: the way to an edge is that to its start and the edge
    itself, so distances of nodes give those of edges. Ways begin at either end of a
    hub and the longer one counts, ahead along the edges and behind against them;
    distance is the shorter of both.
    """
    ends = hubs.select("hub", F.explode(F.array(F.struct(F.lit("a").alias("end"), F.col("src").alias("node")), F.struct(F.lit("b").alias("end"), F.col("dst").alias("node")))).alias("e"))
    start = ends.select(F.col("e.node").alias("node"), F.struct("hub", F.col("e.end").alias("end")).alias("hub"))
    sides = {}
    for name, e in (("ahead", edges), ("behind", backwards(edges))):
        found = shortest_paths(e, start, limit)
        way = e.join(found, F.col("src") == F.col("node")).groupBy("src", "dst", F.col("hub.hub").alias("hub"))
        sides[name] = way.agg(F.max(F.col("distance") + F.col("w")).alias(name))
    ahead, behind = sides["ahead"], sides["behind"].select(F.col("dst").alias("src"), F.col("src").alias("dst"), "hub", "behind")
    both = ahead.join(behind, ["src", "dst", "hub"], "full")
    return both.withColumn("distance", F.least("ahead", "behind"))


def nearest_edge_hubs(distances: DataFrame) -> DataFrame:
    """(src, dst, hub, distance): the nearest hub edge of each edge, ties by hub."""
    best = distances.groupBy("src", "dst").agg(F.min(F.struct("distance", "hub")).alias("b"))
    return best.select("src", "dst", "b.hub", "b.distance")


def hub_totals(nearest: DataFrame, edges: DataFrame) -> DataFrame:
    """(hub, edges, total): the edges of each hub's cell and the sum of their distances over the weight of the graph."""
    whole = edges.agg(F.sum("w").alias("all"))
    cells = nearest.groupBy("hub").agg(F.count("*").alias("edges"), F.sum("distance").alias("sum"))
    return cells.crossJoin(F.broadcast(whole)).select("hub", "edges", stats.ratio(F.col("sum"), F.col("all")).alias("total"))


def strongest(edges: DataFrame, n: int) -> DataFrame:
    """(node, hub): the n nodes with the largest sum of weights of their edges, ties by name; each is its own hub."""
    ends = edges.select(F.explode(F.array("src", "dst")).alias("node"), "w")
    best = ends.groupBy("node").agg(F.sum("w").alias("s")).orderBy(F.desc("s"), "node").limit(n)
    return best.select("node", F.col("node").alias("hub"))


def voronoi(distances: DataFrame) -> DataFrame:
    """(node, hub, distance): the nearest hub of each node, ties by hub."""
    w = Window.partitionBy("node").orderBy("distance", "hub")
    return distances.withColumn("_k", F.row_number().over(w)).where("_k = 1").drop("_k")


def hub_metric(distances: DataFrame, a: str, b: str) -> DataFrame:
    """The shortest way from a to b by any hub: to it from a and on to b."""
    x = distances.where(F.col("node") == a).select("hub", F.col("distance").alias("x"))
    y = distances.where(F.col("node") == b).select("hub", F.col("distance").alias("y"))
    return x.join(y, "hub").agg(F.min(F.col("x") + F.col("y")).alias("distance"))


def greatest_of(columns: list[Column]) -> Column:
    return F.greatest(*columns)
