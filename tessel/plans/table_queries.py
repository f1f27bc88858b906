"""Queries on files of graphs, typed batches, link splits, views of matrices and metrics by name."""

from pyspark.sql import functions as F

from tessel.functions.hashing import uniform_sql
from tessel.model import PropertyGraph
from tessel.operators import features, metrics, sparse, subgraph, traverse
from tessel.plans import graphs as g
from tessel.plans.graphs import with_views as views
from tessel.plans.registry import query
from tessel.plans.staging import scratch_path
from tessel.sources import graph_files


@query("edge_list_roundtrip", views("copart") + "SELECT e_id, src, dst, w FROM copart")
def edge_list_roundtrip(spark, sf):
    path = scratch_path(spark, "edge-list")
    graph_files.write_edge_list(PropertyGraph.homogeneous(g.parts(spark, sf), g.copart(spark, sf)), path, ";")
    return graph_files.read_edge_list(spark, path, delimiter=";").edge_table().select("e_id", "src", "dst", "w")


@query("edge_list_ends", views("handoff") + "SELECT src, dst FROM handoff")
def edge_list_ends(spark, sf):
    return graph_files.to_edge_list(graph_files.from_edges(g.handoff(spark, sf)))


@query("graph_roundtrip", views("li") + """SELECT 'contains' AS relation, e_id, l_orderkey AS src, l_partkey AS dst FROM li UNION ALL SELECT 'places', o_orderkey, o_custkey, o_orderkey FROM orders
UNION ALL SELECT 'part_of', n_nationkey, n_nationkey, n_regionkey FROM nation""")
def graph_roundtrip(spark, sf):
    path = scratch_path(spark, "graph")
    graph_files.write_graph(g.commerce(spark, sf), path)
    edges = graph_files.read_graph(spark, path).edges
    named = [e.select(F.lit(k[1]).alias("relation"), "e_id", "src", "dst") for k, e in edges.items() if k[1] in ("contains", "places", "part_of")]
    return named[0].unionByName(named[1]).unionByName(named[2])


def _order_graphs(spark, sf):
    """Orders as graphs: a node for each line, numbered within, each leading to the next."""
    lines = g.li(spark, sf).select(F.col("l_orderkey").alias("graph_id"), (F.col("e_id") % 1000).alias("id"), F.col("l_suppkey").alias("supplier"), F.col("l_quantity").alias("x"))
    edges = lines.select("graph_id", (F.col("id") - 1).alias("src"), F.col("id").alias("dst")).where("src >= 0")
    return lines, edges


_SIZES = "sz AS (SELECT CAST(count(*) * 4 // 5 AS BIGINT) AS k FROM orders)"


def _dataset(spark, sf, split):
    n = g.table(spark, sf, "orders").count()
    path = scratch_path(spark, "dataset")
    graph_files.write_dataset(*_order_graphs(spark, sf), path, {"train": n * 4 // 5, "test": n - n * 4 // 5})
    return graph_files.read_dataset(spark, path, split)


@query("dataset_split", views("li", more=_SIZES) + "SELECT l_orderkey AS graph_id, e_id % 1000 AS id, l_quantity AS x FROM li, sz WHERE l_orderkey >= k")
def dataset_split(spark, sf):
    return _dataset(spark, sf, "test")[0].select("graph_id", "id", "x")


@query("dataset_edges", views("li", more=_SIZES) + "SELECT l_orderkey AS graph_id, e_id % 1000 - 1 AS src, e_id % 1000 AS dst FROM li, sz WHERE l_orderkey < k AND e_id % 1000 > 0")
def dataset_edges(spark, sf):
    return _dataset(spark, sf, "train")[1].select("graph_id", "src", "dst")


_INDICATED = "nd AS (SELECT l_orderkey AS graph_id, e_id AS node, l_quantity AS x FROM li), f AS (SELECT graph_id, min(node) AS first FROM nd GROUP BY 1)"


def _indicated(spark, sf):
    lines = g.li(spark, sf)
    pairs = lines.select((F.col("e_id") - 1).alias("src"), F.col("e_id").alias("dst"), F.col("l_discount").alias("w")).where("dst % 1000 > 0")
    labels = g.table(spark, sf, "orders").select(F.col("o_orderkey").alias("graph_id"), F.col("o_orderpriority").alias("label"))
    return graph_files.from_indicator_tables(pairs, lines.select(F.col("e_id").alias("node"), F.col("l_orderkey").alias("graph_id")), labels, lines.select(F.col("e_id").alias("node"), F.col("l_quantity").alias("x")))


@query("collection_nodes", views("li", more=_INDICATED) + "SELECT graph_id, node - first AS id, x FROM nd JOIN f USING (graph_id)")
def collection_nodes(spark, sf):
    return _indicated(spark, sf)[0].select("graph_id", "id", "x")


@query("collection_edges", views("li", more=_INDICATED) + "SELECT l_orderkey AS graph_id, e_id - 1 - first AS src, e_id - first AS dst, l_discount AS w FROM li JOIN f ON graph_id = l_orderkey WHERE e_id % 1000 > 0")
def collection_edges(spark, sf):
    return _indicated(spark, sf)[1].select("graph_id", "src", "dst", "w")


@query("collection_labels", "SELECT o_orderkey AS graph_id, dense_rank() OVER (ORDER BY o_orderpriority) - 1 AS y FROM orders")
def collection_labels(spark, sf):
    return _indicated(spark, sf)[2]


# batches of typed graphs and of samples

_TYPED = """nl AS (SELECT l_orderkey AS graph_id, e_id % 1000 AS id, l_suppkey FROM li), ns AS (SELECT graph_id, l_suppkey, row_number() OVER (PARTITION BY graph_id ORDER BY l_suppkey) - 1 AS id FROM (SELECT DISTINCT graph_id, l_suppkey FROM nl)),
fl AS (SELECT graph_id, sum(count(*)) OVER (ORDER BY graph_id) - count(*) AS first FROM nl GROUP BY graph_id), fs AS (SELECT graph_id, sum(count(*)) OVER (ORDER BY graph_id) - count(*) AS first FROM ns GROUP BY graph_id)"""


@query("typed_batch", views("li", more=_TYPED) + """SELECT 'from' AS relation, CAST(nl.id + fl.first AS BIGINT) AS src, CAST(ns.id + fs.first AS BIGINT) AS dst FROM nl JOIN ns USING (graph_id, l_suppkey) JOIN fl USING (graph_id) JOIN fs USING (graph_id)
UNION ALL SELECT 'then', CAST(id - 1 + first AS BIGINT), CAST(id + first AS BIGINT) FROM nl JOIN fl USING (graph_id) WHERE id > 0""")
def typed_batch(spark, sf):
    from pyspark.sql import Window as W

    lines, following = _order_graphs(spark, sf)
    own = lines.select("graph_id", "supplier").distinct().withColumn("id", (F.row_number().over(W.partitionBy("graph_id").orderBy("supplier")) - 1).cast("long"))
    sold = lines.select("graph_id", F.col("id").alias("src"), "supplier").join(own.withColumnRenamed("id", "dst"), ["graph_id", "supplier"]).select("graph_id", "src", "dst")
    edges = {("line", "from", "supplier"): sold, ("line", "then", "line"): following}
    moved = subgraph.typed_batch({"line": lines.select("graph_id", "id"), "supplier": own.select("graph_id", "id")}, edges)[1]
    named = [e.select(F.lit(k[1]).alias("relation"), "src", "dst") for k, e in moved.items()]
    return named[0].unionByName(named[1])


@query("sample_batch", views("li", more=_TYPED) + "SELECT graph_id, CAST(max(id) + first AS BIGINT) AS seed, 'order-' || graph_id AS sample_id FROM nl JOIN fl USING (graph_id) GROUP BY graph_id, first")
def sample_batch(spark, sf):
    lines, following = _order_graphs(spark, sf)
    samples = lines.groupBy("graph_id").agg(F.max("id").alias("seed")).withColumn("sample_id", F.concat(F.lit("order-"), F.col("graph_id").cast("string")))
    return subgraph.sample_batch(lines.select("graph_id", "id"), following, samples)[2].select("graph_id", "seed", "sample_id")


# link splits

_SPLIT = f"""nn AS (SELECT count(*) AS n FROM handoff), rk AS (SELECT e_id, src, dst, row_number() OVER (ORDER BY {uniform_sql(31, 'e_id')}, e_id) - 1 AS k FROM handoff),
pt AS (SELECT e_id, src, dst, CASE WHEN k < floor(n * 0.1) THEN 'val' WHEN k < floor(n * 0.1) + floor(n * 0.2) THEN 'test' ELSE 'train' END AS part FROM rk, nn),
ap AS (SELECT e_id, row_number() OVER (ORDER BY {uniform_sql(32, 'e_id')}, e_id) - 1 < floor((SELECT count(*) FROM pt WHERE part = 'train') * 0.3) AS asked FROM pt WHERE part = 'train')"""
_SPLIT_ARGS = {"val": 0.1, "test": 0.2, "seed": 31, "disjoint": 0.3}


@query("link_split", views("handoff", more=_SPLIT) + "SELECT e_id, src, dst, part FROM pt LEFT JOIN ap USING (e_id) WHERE part <> 'train' OR asked")
def link_split(spark, sf):
    return features.link_split(g.handoff(spark, sf), **_SPLIT_ARGS)[0]


@query("link_messages", views("handoff", more=_SPLIT + """, ps AS (SELECT s AS split, e_id, src, dst FROM pt LEFT JOIN ap USING (e_id), (VALUES ('train'), ('val'), ('test')) v(s) WHERE part = 'train' AND NOT asked
 UNION ALL SELECT 'test', e_id, src, dst FROM pt WHERE part = 'val'), turned AS (SELECT e_id + 1000000000 AS e_id, dst AS src, src AS dst FROM handoff WHERE e_id % 3 <> 1)""")
       + "SELECT split, 'edge' AS kind, e_id, src, dst FROM ps UNION ALL SELECT split, 'reverse', t.e_id, t.src, t.dst FROM turned t JOIN (SELECT DISTINCT split, dst AS src, src AS dst FROM ps) USING (src, dst)")
def link_messages(spark, sf):
    edges = g.handoff(spark, sf)
    back = edges.where("e_id % 3 <> 1").select((F.col("e_id") + 1_000_000_000).alias("e_id"), F.col("dst").alias("src"), F.col("src").alias("dst"))
    return features.link_split(edges, **_SPLIT_ARGS, reverse=back)[1]


_DRAWN = f"""lk AS (SELECT e_id AS q, src, dst, part FROM pt LEFT JOIN ap USING (e_id) WHERE (part <> 'train' OR asked) AND part <> 'test'),
od AS (SELECT *, row_number() OVER (PARTITION BY part ORDER BY {uniform_sql(35, 'q')}, q) - 1 AS k, count(*) OVER (PARTITION BY part) AS n FROM lk),
known AS (SELECT src, list_sort(list(DISTINCT dst)) AS taken FROM handoff GROUP BY src), total AS (SELECT max(user_id) + 1 AS t FROM events),
fr AS (SELECT src, list_filter(range(t), lambda i: NOT list_contains(taken, i)) AS free FROM known, total),
ng AS (SELECT part, q, src, free[{uniform_sql(33, 'q', 'slot')} % len(free) + 1] AS dst, slot FROM od JOIN fr USING (src), (VALUES (1), (2)) v(slot) WHERE len(free) > 0 AND (slot - 1) * n + k < floor(n * 1.5))"""


@query("link_negatives", views("handoff", more=_SPLIT + ", " + _DRAWN) + "SELECT part, q, src, dst, 1 AS label, 0 AS slot FROM od UNION ALL SELECT part, q, src, dst, 0, slot FROM ng")
def link_negatives(spark, sf):
    edges = g.handoff(spark, sf)
    links = features.link_split(edges, **_SPLIT_ARGS)[0]
    return features.split_negatives(edges, links, g.user_total(spark, sf), 1.5, ("train", "val"), seed=33)


# views of matrices, typed expansion, metrics by name

@query("coo_triples", views("copart") + "SELECT src AS row, dst AS col, w AS value, e_id FROM copart")
def coo_triples(spark, sf):
    blocks = sparse.compressed(sparse.adjacency(g.copart(spark, sf), "w"), g.parts(spark, sf), cells=8)[1]
    return sparse.uncompressed(blocks)


@query("cols_selected", views("handoff") + "SELECT src AS row, pos AS col, e_id FROM handoff JOIN (VALUES (3, 3), (1, 5), (2, 8)) v(pos, id) ON id = dst")
def cols_selected(spark, sf):
    picked = spark.createDataFrame([(0, 3), (1, 5), (2, 8), (3, 3)], "pos long, id long")
    return sparse.select_slices(sparse.adjacency(g.handoff(spark, sf)), picked, by="col").select("row", "col", "e_id")


for _kind, _sql in (("in", "SELECT dst AS row, c AS col, 1.0 AS value FROM r"), ("out", "SELECT src AS row, c AS col, 1.0 AS value FROM r")):
    query(f"incidence_{_kind}", views("handoff", more="r AS (SELECT *, row_number() OVER (ORDER BY e_id) - 1 AS c FROM handoff)") + _sql)(lambda spark, sf, kind=_kind: sparse.incidence(g.handoff(spark, sf), kind))


def _typed_hop(hop: int, cap: int) -> str:
    met = " UNION ".join(f"SELECT '{to}' AS type, r.{y} AS id FROM {rel} r JOIN h{hop - 1} f ON f.type = '{a}' AND f.id = r.{x}" for rel, (a, b) in (("pl", ("customer", "orders")), ("co", ("orders", "part"))) for a, to, x, y in ((a, b, "src", "dst"), (b, a, "dst", "src")))
    seen = " UNION ALL ".join(f"SELECT type, id FROM h{k}" for k in range(hop))
    return f"h{hop} AS (SELECT type, id, {hop} AS hop FROM (SELECT *, row_number() OVER (PARTITION BY type ORDER BY {uniform_sql(21, str(hop), 'id')}, id) AS n FROM (SELECT * FROM ({met}) EXCEPT ({seen}))) WHERE n <= {cap})"


@query("expand_typed", views("li", more="pl AS (SELECT o_custkey AS src, o_orderkey AS dst FROM orders), co AS (SELECT l_orderkey AS src, l_partkey AS dst FROM li), h0 AS (SELECT 'customer' AS type, c_custkey AS id, 0 AS hop FROM customer WHERE c_custkey % 50 = 0), " + _typed_hop(1, 30) + ", " + _typed_hop(2, 40))
       + "SELECT * FROM h0 UNION ALL SELECT * FROM h1 UNION ALL SELECT * FROM h2")
def expand_typed(spark, sf):
    edges = {k: e for k, e in g.commerce(spark, sf).edges.items() if k[1] in ("places", "contains")}
    seeds = g.table(spark, sf, "customer").where("c_custkey % 50 = 0").select(F.col("c_custkey").alias("id"))
    found = [df.select(F.lit(k).alias("type"), "id", "hop") for k, df in traverse.expand_typed(edges, {"customer": seeds}, [30, 40], seed=21).items()]
    out = found[0]
    for df in found[1:]:
        out = out.unionByName(df)
    return out


@query("accuracy_binary", views("preds") + "SELECT round(avg(CASE WHEN (z1 - 0.5 >= 0) = (label = 1) THEN 1.0 ELSE 0.0 END), 6) AS accuracy FROM preds WHERE label < 2")
def accuracy_binary(spark, sf):
    rows = g.preds(spark, sf).where("label < 2").select((F.col("z")[1] - 0.5).alias("logits"), "label")
    return metrics.build_metric("binary_accuracy")(rows).select(F.round("accuracy", 6).alias("accuracy"))
