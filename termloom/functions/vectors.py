"""Vector functions on array columns, by higher-order functions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def doubles(x) -> Column:
    return (F.col(x) if isinstance(x, str) else x).cast("array<double>")


def total(x: Column) -> Column:
    return F.aggregate(x, F.lit(0.0), lambda a, v: a + v)


def dot(a: Column, b: Column) -> Column:
    return total(F.zip_with(a, b, lambda x, y: x * y))


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    return F.coalesce(F.try_divide(dot(a, b), norm(a) * norm(b)), F.lit(0.0))


def euclidean(a: Column, b: Column) -> Column:
    return F.sqrt(total(F.zip_with(a, b, lambda x, y: (x - y) * (x - y))))


def manhattan(a: Column, b: Column) -> Column:
    return total(F.zip_with(a, b, lambda x, y: F.abs(x - y)))


def scaled(a: Column) -> Column:
    """Divided by its sum."""
    s = total(a)
    return F.transform(a, lambda x: F.coalesce(F.try_divide(x, s), F.lit(0.0)))


def unit(a: Column) -> Column:
    n = norm(a)
    return F.transform(a, lambda x: F.coalesce(F.try_divide(x, n), F.lit(0.0)))


def standardised(a: Column) -> Column:
    """Mean 0, population deviation 1."""
    n = F.size(a)
    mean = total(a) / n
    sd = F.sqrt(total(F.transform(a, lambda x: (x - mean) * (x - mean))) / n)
    return F.transform(a, lambda x: F.coalesce(F.try_divide(x - mean, sd), F.lit(0.0)))


def softmax(a: Column) -> Column:
    top = F.array_max(a)
    return scaled(F.transform(a, lambda x: F.exp(x - top)))


def kl(a: Column, b: Column) -> Column:
    """Sum of a ln(a/b) where both are positive."""
    return total(F.zip_with(a, b, lambda x, y: F.when((x > 0) & (y > 0), x * F.ln(x / y)).otherwise(0.0)))


def symmetric_kl(a: Column, b: Column) -> Column:
    return kl(a, b) + kl(b, a)


def inverse_distribution(a: Column) -> Column:
    return scaled(F.transform(a, lambda x: F.coalesce(F.try_divide(F.lit(1.0), x), F.lit(0.0))))


def variance(a: Column) -> Column:
    n = F.size(a)
    mean = total(a) / n
    return total(F.transform(a, lambda x: (x - mean) * (x - mean))) / n


def plus(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x + y)


def minus(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x - y)


def times(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x * y)


def over(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: F.try_divide(x, y))


def scale(a: Column, k) -> Column:
    return F.transform(a, lambda x: x * k)


def matvec(rows: Column, v: Column) -> Column:
    """A matrix, an array of rows, times a vector."""
    return F.transform(rows, lambda r: dot(r, v))


#: Element-wise functions by name.
UNARY: dict[str, Callable[[Column], Column]] = {
    "abs": F.abs,
    "neg": lambda x: -x,
    "sign": F.signum,
    "square": lambda x: x * x,
    "sqrt": lambda x: F.when(x >= 0, F.sqrt(x)),
    "exp": F.exp,
    "expm1": F.expm1,
    "log": lambda x: F.when(x > 0, F.ln(x)),
    "log1p": lambda x: F.when(x > -1, F.log1p(x)),
    "reciprocal": lambda x: F.try_divide(F.lit(1.0), x),
    "acos": lambda x: F.when(F.abs(x) <= 1, F.acos(x)),
    "sigmoid": lambda x: 1 / (1 + F.exp(-x)),
    "relu": lambda x: F.greatest(x, F.lit(0.0)),
    "leaky_relu": lambda x: F.when(x > 0, x).otherwise(x * 0.01),
    "elu": lambda x: F.when(x > 0, x).otherwise(F.exp(x) - 1),
    "softplus": lambda x: F.log1p(F.exp(-F.abs(x))) + F.greatest(x, F.lit(0.0)),
}


def each(a: Column, name: str) -> Column:
    return F.transform(a, UNARY[name])


def power(a: Column, p) -> Column:
    return F.transform(a, lambda x: F.pow(x, F.lit(p)))


# -- affine maps with rational coefficients ---------------------------------------


def _gcd(a: Column, b: Column) -> Column:
    """Greatest common divisor of two longs, by as many steps as 64-bit numbers can need."""
    steps = F.sequence(F.lit(1), F.lit(92))
    return F.aggregate(
        steps,
        F.struct(F.abs(a).alias("a"), F.abs(b).alias("b")),
        lambda s, _: F.struct(
            F.when(s["b"] == 0, s["a"]).otherwise(s["b"]).alias("a"),
            F.when(s["b"] == 0, s["b"]).otherwise(F.try_mod(s["a"], s["b"])).alias("b"),
        ),
        lambda s: s["a"],
    )


def rational(n: Column, d: Column) -> Column:
    """(n, d) in lowest terms, the denominator positive."""
    g = F.greatest(_gcd(n, d), F.lit(1).cast("long")) * F.when(d < 0, -1).otherwise(1)
    return F.struct(F.expr("1").cast("long").alias("_")).withField("n", (n / g).cast("long")).withField("d", (d / g).cast("long")).dropFields("_")


def composed(maps: Column) -> Column:
    """The composition of affine maps x -> a x + b, an array of (a, b); the first is applied last."""
    return F.aggregate(
        maps,
        F.struct(F.lit(1).cast("long").alias("a"), F.lit(0).cast("long").alias("b")),
        lambda s, m: F.struct((s["a"] * m["a"]).cast("long").alias("a"), (s["a"] * m["b"] + s["b"]).cast("long").alias("b")),
    )


def fixed_point(a: Column, b: Column) -> Column:
    """The x with a x + b = x, null where there is none or more than one."""
    return F.try_divide(b.cast("double"), (1 - a).cast("double"))
