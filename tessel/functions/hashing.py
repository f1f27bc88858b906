"""Deterministic uniform numbers: the same in any engine, on any cluster, for any partitioning."""

from pyspark.sql import Column
from pyspark.sql import functions as F

SPAN = float(1 << 32)


def uniform(seed: int, *parts: Column) -> Column:
    """The first 32 bits of the md5 of the seed and the parts, joined by ``|``, as a number."""
    text = F.concat_ws("|", F.lit(str(seed)), *[p.cast("string") for p in parts])
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("long")


def uniform_sql(seed: int, *parts: str) -> str:
    """The same number as a SQL expression of a DuckDB-like engine."""
    text = ", ".join([f"'{seed}'", *[f"CAST({p} AS VARCHAR)" for p in parts]])
    return f"CAST('0x' || substr(md5(concat_ws('|', {text})), 1, 8) AS BIGINT)"
