"""All graph queries by name, with their SQL twins."""

from tessel.plans import layer_queries, numeric_queries, sampling_queries, structure_queries, table_queries  # noqa: F401
from tessel.plans.registry import ORACLES, QUERIES


def queries() -> dict:
    """Query callables ``(spark, sf_dir) -> DataFrame``."""
    return dict(QUERIES)


def oracle_sql() -> dict:
    """SQL text for the queries that SQL can express."""
    return dict(ORACLES)
