"""Short dense vectors in array columns, in expressions that whole-stage code can hold."""

from pyspark.sql import Column
from pyspark.sql import functions as F


def items(x: Column, width: int) -> list[Column]:
    """The entries of a vector column."""
    return [x[i] for i in range(width)]


def vector_sum(x: Column, width: int) -> Column:
    """An aggregate: the entrywise sum."""
    return F.array(*[F.sum(v) for v in items(x, width)])


def vector_max(x: Column, width: int) -> Column:
    """An aggregate: the entrywise maximum."""
    return F.array(*[F.max(v) for v in items(x, width)])


def vector_avg(x: Column, width: int) -> Column:
    """An aggregate: the entrywise mean."""
    return F.array(*[F.avg(v) for v in items(x, width)])


def dot(a: Column, b: Column) -> Column:
    """The inner product of two vector columns."""
    return F.aggregate(F.zip_with(a, b, lambda p, q: p * q), F.lit(0.0), lambda s, v: s + v)


def scale(x: Column, by: Column) -> Column:
    """The vector times a number."""
    return F.transform(x, lambda v: v * by)


def add(a: Column, b: Column) -> Column:
    """The entrywise sum of two vectors."""
    return F.zip_with(a, b, lambda p, q: p + q)


def linear(x: Column, weight: list[list[float]], bias: list[float] | None = None) -> Column:
    """The affine image of a vector column under literal weights, one row for each output."""
    bias = bias or [0.0] * len(weight)
    rows = []
    for row, b in zip(weight, bias, strict=True):
        if len(row) * len(weight) <= 1024:
            total = F.lit(float(b))
            for i, w in enumerate(row):
                total = total + x[i] * F.lit(float(w))
        else:
            total = F.lit(float(b)) + dot(x, F.lit([float(w) for w in row]))
        rows.append(total)
    return F.array(*rows)


def relu(x: Column) -> Column:
    """Negative entries set to 0."""
    return F.transform(x, lambda v: F.greatest(v, F.lit(0.0)))


def sigmoid(v: Column) -> Column:
    """The logistic function."""
    return 1 / (1 + F.exp(-v))


def softplus(v: Column) -> Column:
    """log(1 + exp(v))."""
    return F.log1p(F.exp(v))


#: Coefficients of a published Chebyshev fit of the complementary error function.
ERFC = (-1.26551223, 1.00002368, 0.37409196, 0.09678418, -0.18628806, 0.27886807, -1.13520398, 1.48851587, -0.82215223, 0.17087277)


def bound(value: Column, body) -> Column:
    """``body`` of a value that is worked out once, however often the body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def gelu(v: Column) -> Column:
    """x times the normal distribution function at x, within 1e-7."""

    def tail(t: Column) -> Column:
        power = F.lit(ERFC[-1])
        for c in reversed(ERFC[:-1]):
            power = F.lit(c) + t * power
        return 0.5 * t * F.exp(power - v * v / 2)

    half = bound(1 / (1 + 0.5 * F.abs(v) / F.lit(2.0**0.5)), tail)
    return v * bound(half, lambda h: F.when(v >= 0, 1 - h).otherwise(h))
