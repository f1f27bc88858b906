"""Range lookup by split points, as plain column expressions."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def split_points(df: DataFrame, column: str, parts: int, accuracy: int = 20_000) -> list[int]:
    """At most ``parts - 1`` ascending values that cut an integer column into near-equal parts.

    The quantiles are a mergeable sketch, so the driver gets ``parts`` numbers and no rows.
    """
    if parts < 2:
        return []
    shares = [i / parts for i in range(1, parts)]
    found = df.agg(F.percentile_approx(column, F.lit(shares), F.lit(max(accuracy, 4 * parts))).alias("cuts")).first()["cuts"]
    return sorted(set(found or []))


def range_index(value: Column, bounds: list[int]) -> Column:
    """The number of ascending ``bounds`` at or below the value, in about two square roots of steps."""
    if not bounds:
        return F.lit(0)
    width = max(1, round(len(bounds) ** 0.5))
    rows = [bounds[i : i + width] for i in range(0, len(bounds), width)]
    heads = F.lit([r[0] for r in rows])
    row = F.size(F.filter(heads, lambda b: b <= value))
    padded = F.array(*[F.lit(r) for r in rows])
    inside = F.size(F.filter(F.element_at(padded, F.greatest(row, F.lit(1))), lambda b: b <= value))
    return F.when(row == 0, F.lit(0)).otherwise((row - 1) * width + inside).cast("int")
