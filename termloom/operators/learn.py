"""Learning of feature weights: driver loops around one distributed evaluation each.

Trials of a round are evaluated in one job: a table of weight vectors meets the
feature rows of all queries, so a step costs one pass, and only a row a trial
returns to the driver.
"""

from __future__ import annotations

import math
import random
from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from termloom.functions import stats

STEPS = (0.15, -0.15)


def evaluate_map(rows: DataFrame, trials: list[list[float]]) -> list[float]:
    """Mean average precision of each weight vector over rows (qid, id, rel, features)."""
    spark = rows.sparkSession
    table = spark.createDataFrame([(i, [float(x) for x in w]) for i, w in enumerate(trials)], "trial int, w array<double>")
    dot = F.aggregate(F.zip_with("features", "w", lambda x, y: x * y), F.lit(0.0), lambda a, x: a + x)
    scored = rows.join(F.broadcast(table), F.lit(True)).select("trial", "qid", "id", "rel", F.round(dot, 9).alias("score"))
    w = Window.partitionBy("trial", "qid").orderBy(F.desc("score"), "id")
    run = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ranked = scored.withColumn("rank", F.row_number().over(w)).withColumn("seen", F.sum("rel").over(run))
    ap = ranked.groupBy("trial", "qid").agg(
        stats.ratio(F.sum(F.when(F.col("rel") > 0, F.col("seen") / F.col("rank")).otherwise(0.0)), F.sum("rel")).alias("ap")
    )
    found = {r["trial"]: r["m"] for r in ap.groupBy("trial").agg(F.avg("ap").alias("m")).collect()}
    return [found.get(i, 0.0) for i in range(len(trials))]


def coordinate_search(
    objective: Callable[[list[list[float]]], list[float]], n: int, rounds: int = 10, start: list[float] | None = None
) -> tuple[list[float], list[float]]:
    """Derivative-free search: the most promising coordinate is tried at +0.15, -0.15 and its negative.

    A move is taken if it does not lose; a coordinate whose weight becomes 0 leaves
    the queue. Returns the weights and the objective after each round.
    """
    w = list(start or [1.0] * n)
    best = objective([w])[0]
    gains, curve = {i: math.inf for i in range(n)}, [best]
    for _ in range(rounds):
        if not gains:
            break
        i = max(gains, key=lambda k: (gains[k], -k))
        moves = [*STEPS, -2 * w[i]]
        trials = [[x + (m if k == i else 0.0) for k, x in enumerate(w)] for m in moves]
        values = objective(trials)
        k = max(range(len(moves)), key=lambda j: (values[j], -j))
        gains[i] = values[k] - best
        if values[k] >= best:
            w, best = trials[k], values[k]
        if w[i] == 0:
            del gains[i]
        curve.append(best)
    return w, curve


def sweep(objective, w: list[float], step: float = 0.15) -> tuple[list[float], float]:
    """Every coordinate both ways in one job; the best move is taken if it gains."""
    trials = [w] + [[x + (s * step if k == i else 0.0) for k, x in enumerate(w)] for i in range(len(w)) for s in (1, -1)]
    values = objective(trials)
    k = max(range(len(trials)), key=lambda j: (values[j], -j))
    return trials[k], values[k]


def coordinate_ascent(rows: DataFrame, n: int, rounds: int = 3, folds: int = 5) -> list[dict]:
    """Coordinate ascent on MAP by cross-validation; folds by a hash of the query."""
    fold = F.pmod(F.xxhash64("qid"), F.lit(folds))
    out = []
    for f in range(folds):
        train, test = rows.where(fold != f), rows.where(fold == f)
        w, curve = coordinate_search(lambda t, r=train: evaluate_map(r, t), n, rounds)
        out.append({"fold": f, "weights": w, "train": curve[-1], "test": evaluate_map(test, [w])[0]})
    return out


def forward_selection(rows: DataFrame, n: int, least_gain: float = 0.001) -> tuple[list[int], float]:
    """Features added one by one while MAP gains enough; all candidates of a step in one job."""
    chosen: list[int] = []
    best = 0.0
    while len(chosen) < n:
        rest = [i for i in range(n) if i not in chosen]
        values = evaluate_map(rows, [[1.0 if k in (*chosen, i) else 0.0 for k in range(n)] for i in rest])
        k = max(range(len(rest)), key=lambda j: (values[j], -j))
        if values[k] - best <= least_gain:
            break
        chosen.append(rest[k])
        best = values[k]
    return chosen, best


def alpha_pairs(rows: DataFrame, n: int) -> list[tuple[int, float]]:
    """Feature 1 with each other one."""
    return list(enumerate(evaluate_map(rows, [[1.0 if k in (0, i) else 0.0 for k in range(n)] for i in range(1, n)]), 1))


def alternating(first, second, a: list[float], b: list[float], rounds: int = 20, inner: int = 10) -> tuple[list[float], list[float], list[float]]:
    """Two weight vectors trained in turn; first(trials, b) and second(trials, a) evaluate batches."""
    curve = []
    for _ in range(rounds):
        a, _ = coordinate_search(lambda t, b=b: first(t, b), len(a), inner, a)
        b, found = coordinate_search(lambda t, a=a: second(t, a), len(b), inner, b)
        curve.append(found[-1])
    return a, b, curve


def reweighted(rows: DataFrame, rounds: int = 4) -> tuple[DataFrame, list[list[float]]]:
    """Feature columns reweighted by exp of each feature's own MAP, a round at a time, until weights settle."""
    n = len(rows.select("features").first()[0])
    history: list[list[float]] = []
    for _ in range(rounds):
        values = evaluate_map(rows, [[1.0 if k == i else 0.0 for k in range(n)] for i in range(n)])
        top = max(values)
        e = [math.exp(v - top) for v in values]
        w = [x / sum(e) * n for x in e]
        if history and all(abs(x - y) < 1e-9 for x, y in zip(w, history[-1], strict=True)):
            break
        history.append(w)
        rows = rows.withColumn("features", F.zip_with("features", F.array(*[F.lit(x) for x in w]), lambda x, y: x * y))
    return rows, history


# -- the joint objective -----------------------------------------------------------


def joint_gradient(cells: DataFrame, entities: DataFrame, v: list[float], w: list[float]) -> tuple[float, list[float], list[float]]:
    """The joint objective at weights v of entity features and w of compatibility features, and its gradient.

    cells (query_id, doc_id, name, g, rel): the compatibility features of a document and
    an entity; entities (query_id, name, f): an entity's own. The objective is, over
    relevant documents, the logarithm of the sum over entities of softmaxed entity
    scores times softmaxed compatibilities. Its derivatives are differences of means of
    features: those of the entities as the document has them, less those before it is
    seen. One job gives all of it; a row of sums comes back.
    """
    dot = lambda c, x: F.aggregate(F.zip_with(c, F.array(*[F.lit(float(y)) for y in x]), lambda a, b: a * b), F.lit(0.0), lambda a, b: a + b)
    e = entities.withColumn("_e", stats.softmax(dot("f", v), "query_id"))
    expected = [F.sum(F.col("_e") * F.get("f", F.lit(k))).over(Window.partitionBy("query_id")).alias(f"_m{k}") for k in range(len(v))]
    e = e.select("query_id", "name", "f", "_e", *expected)
    c = cells.where("rel > 0").withColumn("_c", stats.softmax(dot("g", w), "query_id", "doc_id"))
    both = c.join(e, ["query_id", "name"])
    joint = F.col("_e") * F.col("_c")
    sums = [F.sum(joint * F.get("f", F.lit(k))).alias(f"_a{k}") for k in range(len(v))]
    sums += [F.sum(joint * F.get("g", F.lit(k))).alias(f"_b{k}") for k in range(len(w))]
    sums += [F.sum(F.col("_c") * F.get("g", F.lit(k))).alias(f"_d{k}") for k in range(len(w))]
    sums += [F.first(f"_m{k}").alias(f"_m{k}") for k in range(len(v))]
    docs = both.groupBy("query_id", "doc_id").agg(F.sum(joint).alias("_s"), *sums)
    docs = docs.where("_s > 0")
    total = docs.agg(
        F.sum(F.ln("_s")),
        *[F.sum(F.col(f"_a{k}") / F.col("_s") - F.col(f"_m{k}")) for k in range(len(v))],
        *[F.sum(F.col(f"_b{k}") / F.col("_s") - F.col(f"_d{k}")) for k in range(len(w))],
    ).first()
    value, *grad = [x or 0.0 for x in total]
    return value, grad[: len(v)], grad[len(v) :]


def train_joint(
    cells: DataFrame, entities: DataFrame, v: list[float], w: list[float], rounds: int = 20, inner: int = 3, tolerance: float = 1e-6
) -> tuple[list[float], list[float], list[float]]:
    """Both weight vectors by ascent on their gradients in turn: compatibilities, then entities, inner steps each.

    A step that loses is halved until it gains, and the next one begins twice as long,
    so the curve never falls; it ends after rounds or where a round gains too little.
    """
    value, gv, gw = joint_gradient(cells, entities, v, w)
    curve, steps = [value], {"w": 1.0, "v": 1.0}
    for _ in range(rounds):
        begun = value
        for side in ("w", "v"):
            for _ in range(inner):
                grad = gw if side == "w" else gv
                size = math.sqrt(sum(x * x for x in grad))
                while steps[side] > 1e-9 and size > tolerance:
                    moved = [x + steps[side] * g / size for x, g in zip(w if side == "w" else v, grad, strict=True)]
                    found = joint_gradient(cells, entities, v if side == "w" else moved, moved if side == "w" else w)
                    if found[0] > value:
                        value, gv, gw = found
                        w, v = (moved, v) if side == "w" else (w, moved)
                        steps[side] *= 2
                        break
                    steps[side] /= 2
            steps[side] = max(steps[side], 1e-3)
        curve.append(value)
        if value - begun < tolerance:
            break
    return v, w, curve


# -- transforms of learning-to-rank rows ------------------------------------------


def by_column(rows: DataFrame, n: int, kind: str = "linear") -> DataFrame:
    """Each feature normalised within its query."""
    f = [stats.NORMS[kind](F.get("features", F.lit(i)), "qid") for i in range(n)]
    return rows.withColumn("features", F.array(*f))


def by_row(rows: DataFrame) -> DataFrame:
    s = F.aggregate("features", F.lit(0.0), lambda a, x: a + x)
    return rows.withColumn("features", F.transform("features", lambda x: F.coalesce(F.try_divide(x, s), F.lit(0.0))))


def with_inverses(rows: DataFrame) -> DataFrame:
    inverse = F.transform("features", lambda x: F.coalesce(F.try_divide(F.lit(1.0), x), F.lit(0.0)))
    return rows.withColumn("features", F.concat("features", inverse))


def product(rows: DataFrame) -> DataFrame:
    return rows.withColumn("score", F.aggregate("features", F.lit(1.0), lambda a, x: a * x))


def with_bases(rows: DataFrame) -> DataFrame:
    """Features as elements: a value, the one before, a base, and scores down a column and along a row, all of them the value at first."""
    element = lambda x: F.struct(*[x.cast("double").alias(k) for k in ("value", "last", "base", "vertical", "horizontal")])
    return rows.withColumn("features", F.transform("features", element))


def each_element(rows: DataFrame, f: Callable) -> DataFrame:
    """f(element, index) in place of every element."""
    return rows.withColumn("features", F.transform("features", f))


def rescored(rows: DataFrame, f: Callable) -> DataFrame:
    """value becomes f(index, value, base); the one before is kept."""
    return each_element(rows, lambda x, i: x.withField("last", x["value"]).withField("value", f(i, x["value"], x["base"]).cast("double")))


def rescored_down(rows: DataFrame, f: Callable) -> DataFrame:
    """vertical becomes f(index, vertical, base)."""
    return each_element(rows, lambda x, i: x.withField("vertical", f(i, x["vertical"], x["base"]).cast("double")))


def rescored_along(rows: DataFrame, f: Callable) -> DataFrame:
    """horizontal becomes f(index, the product of the row's horizontal scores, base)."""
    total = F.aggregate("features", F.lit(1.0), lambda a, x: a * x["horizontal"])
    return each_element(rows.withColumn("_total", total), lambda x, i: x.withField("horizontal", f(i, F.col("_total"), x["base"]).cast("double"))).drop("_total")


def based_on_value(rows: DataFrame) -> DataFrame:
    """The values so far become the bases."""
    return each_element(rows, lambda x, i: x.withField("base", x["value"]))


def with_share(rows: DataFrame) -> DataFrame:
    """One feature more: one over the rows of the query."""
    return rows.withColumn("features", F.concat("features", F.array(1.0 / F.count(F.lit(1)).over(Window.partitionBy("qid")))))


def with_inverse_shares(rows: DataFrame, n: int) -> DataFrame:
    """As many features more: of each one the share of its inverse among those of the query, 0 where that isn't finite."""
    inverse = [F.try_divide(F.lit(1.0), F.get("features", F.lit(i))) for i in range(n)]
    shares = [stats.finite(F.try_divide(x, F.sum(x).over(Window.partitionBy("qid")))) for x in inverse]
    return rows.withColumn("features", F.concat("features", F.array(*shares)))


# -- gradients and stochastic searches ---------------------------------------------


def pairwise_gradient(rows: DataFrame, w: list[float], picks: int = 5, seed: int = 12941) -> list[float]:
    """The mean difference of features between seeded picks of relevant and other rows that score worse.

    Picks are by hash order within a query, so a run repeats exactly and a query of
    any size is one window.
    """
    dot = F.aggregate(F.zip_with("features", F.array(*[F.lit(float(x)) for x in w]), lambda x, y: x * y), F.lit(0.0), lambda a, x: a + x)
    win = Window.partitionBy("qid", "good").orderBy(F.xxhash64(F.lit(seed), "qid", "id"))
    picked = rows.withColumn("score", dot).withColumn("good", F.col("rel") > 0).withColumn("k", F.row_number().over(win)).where(F.col("k") <= picks)
    a = picked.where("good").select("qid", F.col("features").alias("fa"), F.col("score").alias("sa"))
    b = picked.where("not good").select("qid", F.col("features").alias("fb"), F.col("score").alias("sb"))
    pairs = a.join(b, "qid").where("sa <= sb")
    n = len(w)
    g = pairs.agg(*[F.avg(F.get("fa", F.lit(i)) - F.get("fb", F.lit(i))).alias(f"g{i}") for i in range(n)]).first()
    return [float(g[i] or 0.0) for i in range(n)]


def gradient_ascent(rows: DataFrame, n: int, rounds: int = 5, rate: float = 0.5) -> tuple[list[float], list[float]]:
    w, curve = [1.0] * n, []
    best = evaluate_map(rows, [w])[0]
    for k in range(rounds):
        g = pairwise_gradient(rows, w, seed=12941 + k)
        trials = [[x + rate * 2**-h * y for x, y in zip(w, g, strict=True)] for h in range(3)]
        values = evaluate_map(rows, trials)
        top = max(range(3), key=lambda j: (values[j], -j))
        if values[top] >= best:
            w, best = trials[top], values[top]
        curve.append(best)
    return w, curve


class Ball:
    """A place on one parameter with a Beta vote: rewarded or penalised, it draws near its place."""

    def __init__(self, place: float, width: float = 0.025):
        self.place, self.width, self.a, self.b = place, width, 1.0, 1.0

    def vote(self, rng: random.Random) -> float:
        return rng.betavariate(self.a, self.b)

    def draw(self, rng: random.Random) -> float:
        return rng.gauss(self.place, self.width)

    def told(self, good: bool, by: float = 1.0) -> None:
        if good:
            self.a += by
        else:
            self.b += by


class Cover:
    """Balls along a parameter; neighbours of a judged ball are judged by half as much."""

    def __init__(self, low: float = -0.5, high: float = 0.5, n: int = 40):
        self.balls = [Ball(low + (high - low) * (i + 0.5) / n, (high - low) / n) for i in range(n)]

    def draw(self, rng: random.Random) -> tuple[int, float]:
        i = max(range(len(self.balls)), key=lambda k: self.balls[k].vote(rng))
        return i, self.balls[i].draw(rng)

    def told(self, i: int, good: bool) -> None:
        for k, by in ((i, 1.0), (i - 1, 0.5), (i + 1, 0.5)):
            if 0 <= k < len(self.balls):
                self.balls[k].told(good, by)

    def regenerate(self) -> None:
        """The better half stays, each with a closer twin."""
        keep = sorted(self.balls, key=lambda b: -b.a / (b.a + b.b))[: len(self.balls) // 2]
        self.balls = sorted([*keep, *(Ball(b.place + b.width / 4, b.width / 2) for b in keep)], key=lambda b: b.place)

    def best(self) -> float:
        return max(self.balls, key=lambda b: b.a / (b.a + b.b)).place


def stochastic_search(objective, n: int, rounds: int = 10, batch: int = 8, seed: int = 12941) -> tuple[list[float], list[float]]:
    """A cover for each weight; a round's draws are evaluated in one job and judged against the mean."""
    rng = random.Random(seed)
    covers = [Cover() for _ in range(n)]
    best, value, curve = [0.0] * n, -math.inf, []
    for k in range(rounds):
        draws = [[c.draw(rng) for c in covers] for _ in range(batch)]
        values = objective([[x for _, x in d] for d in draws])
        mean = sum(values) / batch
        for d, v in zip(draws, values, strict=True):
            for c, (i, _) in zip(covers, d, strict=True):
                c.told(i, v >= mean)
            if v > value:
                best, value = [x for _, x in d], v
        if k % 4 == 3:
            for c in covers:
                c.regenerate()
        curve.append(value)
    return best, curve


def logit_fit(x: list[list[float]], y: list[float], rounds: int = 200, rate: float = 0.5) -> tuple[list[float], list[float]]:
    """Logistic fit of targets between 0 and 1; returns weights and the loss curve."""
    n, w, curve = len(x[0]), [0.0] * len(x[0]), []
    for _ in range(rounds):
        p = [1 / (1 + math.exp(-sum(a * b for a, b in zip(r, w, strict=True)))) for r in x]
        g = [sum((q - t) * r[k] for q, t, r in zip(p, y, x, strict=True)) / len(x) for k in range(n)]
        w = [a - rate * b for a, b in zip(w, g, strict=True)]
        curve.append(-sum(t * math.log(max(q, 1e-12)) + (1 - t) * math.log(max(1 - q, 1e-12)) for q, t in zip(p, y, strict=True)) / len(x))
    return w, curve


def perturbed(w: list[float], count: int, spread: float = 0.1, seed: int = 12941) -> list[list[float]]:
    rng = random.Random(seed)
    return [[x + rng.gauss(0, spread) for x in w] for _ in range(count)]


def covariance(draws: list[list[float]]) -> list[list[float]]:
    """Co-moments of parameters over the product of their root sums of squares."""
    n, m = len(draws[0]), len(draws)
    mean = [sum(d[i] for d in draws) / m for i in range(n)]
    c = [[sum((d[i] - mean[i]) * (d[j] - mean[j]) for d in draws) for j in range(n)] for i in range(n)]
    return [[c[i][j] / math.sqrt(c[i][i] * c[j][j]) if c[i][i] * c[j][j] > 0 else 0.0 for j in range(n)] for i in range(n)]
