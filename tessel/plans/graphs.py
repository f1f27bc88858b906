"""Graphs over the test tables, each with the SQL that gives the same rows.

``handoff``: in the order of all events, each event's user hands on to the next event's user; the
order is dealt by ranges of time, each closed by the next one's first event, so no window spans
the whole table; the graph is written once a session.  ``copart``: within an order, each line's part leads to the next line's part.
"""

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessel.functions.ordering import in_order, task_of
from tessel.model import PropertyGraph
from tessel.plans.staging import staged
from tessel.sources.tables import table

#: Entries of the features of layer queries, each a sum over a third of an embedding's, and of the
#: features of other queries.
WIDTH, FULL = 3, 64

SQL = {
    "users": "users AS (SELECT DISTINCT user_id AS id FROM events)",
    "handoff": """handoff AS (SELECT * FROM (SELECT event_id AS e_id, user_id AS src,
 lead(user_id) OVER (ORDER BY ts, event_id) AS dst, epoch_us(ts) AS t, value FROM events) WHERE dst IS NOT NULL)""",
    "feat_full": "feat_full AS (SELECT u.id, " + ", ".join(f"coalesce(CAST(v.embedding[{i + 1}] AS DOUBLE), 0) AS x{i}" for i in range(FULL)) + " FROM users u LEFT JOIN embeddings v ON v.vec_id = u.id)",
    "feat": "feat AS (SELECT u.id, " + ", ".join(f"coalesce(({' + '.join(f'CAST(v.embedding[{j + 1}] AS DOUBLE)' for j in range(i, FULL, WIDTH))}) / 4, 0) AS x{i}" for i in range(WIDTH)) + " FROM users u LEFT JOIN embeddings v ON v.vec_id = u.id)",
    "li": "li AS (SELECT l_orderkey * 1000 + row_number() OVER (PARTITION BY l_orderkey ORDER BY l_partkey, l_suppkey, l_linenumber, l_quantity, l_extendedprice, l_discount, l_tax) - 1 AS e_id, lineitem.* FROM lineitem)",
    "parts": "parts AS (SELECT p_partkey AS id FROM part)",
    "copart": """copart AS (SELECT * FROM (SELECT e_id, l_partkey AS src,
 lead(l_partkey) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, e_id) AS dst, l_quantity AS w FROM li) WHERE dst IS NOT NULL)""",
    "scored": """scored AS (SELECT l_orderkey AS q, CASE WHEN e_id % 1000 = 0 THEN 1 ELSE 0 END AS label,
 CAST(l_partkey % 97 AS DOUBLE) AS score, l_suppkey % 5 = 0 AS filtered FROM li)""",
    "preds": """preds AS (SELECT e_id, l_quantity / 10 AS z0, l_discount * 10 AS z1, l_tax * 20 AS z2,
 l_extendedprice / 100000 AS y0, l_quantity / 20 AS y1, l_tax * 10 AS y2, l_linenumber % 3 AS label FROM li)""",
}
NEEDS = {"feat": ["users"], "feat_full": ["users"], "copart": ["li"], "scored": ["li"], "preds": ["li"]}


def with_views(*names: str, more: str = "") -> str:
    """A WITH clause of the named views and what they need, then ``more`` clauses."""
    order: list[str] = []

    def take(n: str) -> None:
        for m in NEEDS.get(n, []):
            take(m)
        if n not in order:
            order.append(n)

    for n in names:
        take(n)
    return "WITH RECURSIVE " + ",\n".join([SQL[n] for n in order] + ([more] if more else [])) + "\n"


def micros(ts) -> object:
    """Microseconds since 1970 of a time without zone."""
    return F.expr(f"timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', {ts})")


def users(spark: SparkSession, sf: str) -> DataFrame:
    """Every user with an event."""
    return table(spark, sf, "events").select(F.col("user_id").alias("id")).distinct()


#: Tables that were written for a session, by application, directory and name.
_WRITTEN: dict[tuple[str, str, str], DataFrame] = {}


def once(spark: SparkSession, sf: str, name: str, build) -> DataFrame:
    """A table that costs a shuffle to build, written once for each application and directory."""
    key = (spark.sparkContext.applicationId, str(sf), name)
    if key not in _WRITTEN:
        _WRITTEN[key] = staged(build(), name, keep=True)
    return _WRITTEN[key]


def handoff(spark: SparkSession, sf: str) -> DataFrame:
    """Hand-offs between users."""
    return once(spark, sf, "handoff", lambda: _handoff(spark, sf))


def _handoff(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "events").select(F.col("event_id").alias("e_id"), F.col("user_id").alias("src"), micros("ts").alias("t"), "value")
    ordered = in_order(rows, "t", "e_id").withColumn("task", task_of("at"))
    # one row for each task: the user of the next one's first event
    firsts = ordered.groupBy("task").agg(F.min_by("src", "at").alias("src"))
    after = firsts.select("task", F.lead("src").over(W.orderBy("task")).alias("after"))
    following = F.coalesce(F.lead("src").over(W.partitionBy("task").orderBy("at")), F.col("after"))
    return ordered.join(F.broadcast(after), "task").select("e_id", "src", following.alias("dst"), "t", "value").where("dst is not null")


def feat(spark: SparkSession, sf: str, width: int = WIDTH) -> DataFrame:
    """Users with their embedding, or with sums over every ``width``-th entry from each of the first
    ``width``, a quarter of them, so that all entries are read; zeros where there is none."""
    entry = lambda j: F.col("embedding")[j].cast("double")
    folded = [entry(i) if width == FULL else reduce(lambda a, b: a + b, map(entry, range(i, FULL, width))) / 4 for i in range(width)]
    vec = table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), *[c.alias(f"v{i}") for i, c in enumerate(folded)])
    return users(spark, sf).join(vec, "id", "left").select("id", F.array(*[F.coalesce(f"v{i}", F.lit(0.0)) for i in range(width)]).alias("x"))


def user_total(spark: SparkSession, sf: str) -> int:
    """One more than the largest user id."""
    return table(spark, sf, "events").agg(F.max("user_id")).first()[0] + 1


def li(spark: SparkSession, sf: str) -> DataFrame:
    """Order lines with an id."""
    order = W.partitionBy("l_orderkey").orderBy("l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax")
    return table(spark, sf, "lineitem").withColumn("e_id", F.col("l_orderkey") * 1000 + F.row_number().over(order) - 1)


def parts(spark: SparkSession, sf: str) -> DataFrame:
    """Every part."""
    return table(spark, sf, "part").select(F.col("p_partkey").alias("id"))


def copart(spark: SparkSession, sf: str) -> DataFrame:
    """Parts that follow each other within an order."""
    order = W.partitionBy("l_orderkey").orderBy("l_linenumber", "e_id")
    rows = li(spark, sf).select("e_id", F.col("l_partkey").alias("src"), F.lead("l_partkey").over(order).alias("dst"), F.col("l_quantity").alias("w"))
    return rows.where("dst is not null")


def scored(spark: SparkSession, sf: str) -> DataFrame:
    """Ranking queries: per order one positive line and the others as negatives."""
    return li(spark, sf).select(F.col("l_orderkey").alias("q"), (F.col("e_id") % 1000 == 0).cast("int").alias("label"), (F.col("l_partkey") % 97).cast("double").alias("score"), (F.col("l_suppkey") % 5 == 0).alias("filtered"))


def preds(spark: SparkSession, sf: str) -> DataFrame:
    """Two predictions of three classes for every line."""
    first = F.array(F.col("l_quantity") / 10, F.col("l_discount") * 10, F.col("l_tax") * 20)
    second = F.array(F.col("l_extendedprice") / 100000, F.col("l_quantity") / 20, F.col("l_tax") * 10)
    return li(spark, sf).select("e_id", first.alias("z"), second.alias("y"), (F.col("l_linenumber") % 3).alias("label"))


def commerce(spark: SparkSession, sf: str) -> PropertyGraph:
    """Customers, orders, parts, suppliers, nations and regions."""
    t = lambda n: table(spark, sf, n)
    lines = li(spark, sf)
    nodes = {n: t(n).select(F.col(k).cast("long").alias("id")) for n, k in (("customer", "c_custkey"), ("orders", "o_orderkey"), ("part", "p_partkey"), ("supplier", "s_suppkey"), ("nation", "n_nationkey"), ("region", "r_regionkey"))}

    def edges(df: DataFrame, e: str, a: str, b: str) -> DataFrame:
        return df.select(F.col(e).cast("long").alias("e_id"), F.col(a).cast("long").alias("src"), F.col(b).cast("long").alias("dst"))

    return PropertyGraph.typed(nodes, {
        ("customer", "places", "orders"): edges(t("orders"), "o_orderkey", "o_custkey", "o_orderkey"),
        ("orders", "contains", "part"): edges(lines, "e_id", "l_orderkey", "l_partkey"),
        ("supplier", "ships", "part"): edges(lines, "e_id", "l_suppkey", "l_partkey"),
        ("customer", "based_in", "nation"): edges(t("customer"), "c_custkey", "c_custkey", "c_nationkey"),
        ("supplier", "sits_in", "nation"): edges(t("supplier"), "s_suppkey", "s_suppkey", "s_nationkey"),
        ("nation", "part_of", "region"): edges(t("nation"), "n_nationkey", "n_nationkey", "n_regionkey"),
    })


def ids(spark: SparkSession, values: list[int]) -> DataFrame:
    """``(pos, id)`` of a short list of ids."""
    return spark.createDataFrame([(i, v) for i, v in enumerate(values)], "pos long, id long")
