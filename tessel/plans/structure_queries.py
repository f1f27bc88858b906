"""Queries on lookups, subgraphs, rewrites and traversal."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessel.functions.hashing import SPAN, uniform_sql
from tessel.operators import lookup, rewrite, sampling, subgraph, traverse
from tessel.operators.components import star_components
from tessel.plans import graphs as g
from tessel.plans.graphs import with_views as views
from tessel.plans.registry import query
from tessel.plans.staging import UNKNOWN, small_tasks

PICK = [3, 5, 8, 3, 13]
LISTED = ", ".join(map(str, sorted(set(PICK))))
NUMBERED = "sel AS (SELECT id, row_number() OVER (ORDER BY pos) - 1 AS new_id FROM (VALUES (0, 3), (1, 5), (2, 8), (4, 13)) v(pos, id))"


def rounded(df: DataFrame, column: str = "h", width: int = g.WIDTH, keep=("id",)) -> DataFrame:
    """The entries of a vector as rounded columns, without negative zeros."""
    return df.select(*keep, *[(F.round(F.col(column)[i], 5) + F.lit(0.0)).alias(f"{column}{i}") for i in range(width)])


@query("deg_in", views("users", "handoff") + "SELECT u.id, count(h.dst) AS degree FROM users u LEFT JOIN handoff h ON h.dst = u.id GROUP BY u.id")
def deg_in(spark, sf):
    return lookup.degrees(g.users(spark, sf), g.handoff(spark, sf), "dst")


@query("deg_out", views("parts", "copart") + "SELECT p.id, count(c.src) AS degree FROM parts p LEFT JOIN copart c ON c.src = p.id GROUP BY p.id")
def deg_out(spark, sf):
    return lookup.degrees(g.parts(spark, sf), g.copart(spark, sf), "src")


@query("node_count", """SELECT 'customer' AS type, count(*) AS n FROM customer UNION ALL SELECT 'orders', count(*) FROM orders UNION ALL SELECT 'part', count(*) FROM part
UNION ALL SELECT 'supplier', count(*) FROM supplier UNION ALL SELECT 'nation', count(*) FROM nation UNION ALL SELECT 'region', count(*) FROM region""")
def node_count(spark, sf):
    return lookup.node_counts(g.commerce(spark, sf).nodes)


@query("edge_count", """SELECT 'customer__places__orders' AS type, count(*) AS n FROM orders UNION ALL SELECT 'orders__contains__part', count(*) FROM lineitem
UNION ALL SELECT 'supplier__ships__part', count(*) FROM lineitem UNION ALL SELECT 'customer__based_in__nation', count(*) FROM customer
UNION ALL SELECT 'supplier__sits_in__nation', count(*) FROM supplier UNION ALL SELECT 'nation__part_of__region', count(*) FROM nation""")
def edge_count(spark, sf):
    return lookup.node_counts(g.commerce(spark, sf).edges)


@query("enumerate_srcdst", views("handoff") + "SELECT e_id, src, dst FROM handoff ORDER BY src, dst, e_id")
def enumerate_srcdst(spark, sf):
    return lookup.enumerate_edges(g.handoff(spark, sf).select("e_id", "src", "dst"), "srcdst")


def _asked(spark, sf):
    return g.handoff(spark, sf).select((F.col("e_id") * 10).alias("pos"), "e_id", "src", "dst")


@query("edges_by_id", views("handoff") + "SELECT e_id * 10 AS pos, e_id, src, dst FROM handoff")
def edges_by_id(spark, sf):
    return lookup.find_edges(g.handoff(spark, sf), _asked(spark, sf).select("pos", "e_id"))


@query("edges_between", views("handoff") + "SELECT a.e_id * 10 AS pos, a.src, a.dst, min(b.e_id) AS e_id FROM handoff a JOIN handoff b USING (src, dst) GROUP BY ALL")
def edges_between(spark, sf):
    return lookup.edge_ids(g.handoff(spark, sf), _asked(spark, sf).select("pos", "src", "dst"))


@query("edges_between_all", views("handoff") + "SELECT a.e_id * 10 AS pos, a.src, a.dst, b.e_id FROM handoff a JOIN handoff b USING (src, dst)")
def edges_between_all(spark, sf):
    return lookup.edge_ids(g.handoff(spark, sf), _asked(spark, sf).select("pos", "src", "dst"), every=True)


@query("edge_exists", views("handoff") + """SELECT a.e_id AS pos, a.src, a.dst + 1 AS dst, EXISTS (SELECT 1 FROM handoff b WHERE b.src = a.src AND b.dst = a.dst + 1) AS found FROM handoff a""")
def edge_exists(spark, sf):
    asked = g.handoff(spark, sf).select(F.col("e_id").alias("pos"), "src", (F.col("dst") + 1).alias("dst"))
    return lookup.has_edges(g.handoff(spark, sf), asked)


@query("edges_into", views("copart") + f"SELECT e_id, src, dst FROM copart WHERE dst IN ({LISTED})")
def edges_into(spark, sf):
    return lookup.edges_into(g.copart(spark, sf), g.ids(spark, PICK)).select("e_id", "src", "dst")


@query("edges_from", views("copart") + f"SELECT e_id, src, dst FROM copart WHERE src IN ({LISTED})")
def edges_from(spark, sf):
    return lookup.edges_from(g.copart(spark, sf), g.ids(spark, PICK)).select("e_id", "src", "dst")


@query("preds", views("copart") + "SELECT e_id, src AS id FROM copart WHERE dst = 3")
def preds(spark, sf):
    return lookup.predecessors(g.copart(spark, sf), 3)


@query("succs", views("copart") + "SELECT e_id, dst AS id FROM copart WHERE src = 3")
def succs(spark, sf):
    return lookup.successors(g.copart(spark, sf), 3)


_FRONTIER = """SELECT 'contains' AS relation, e_id, l_orderkey AS src, l_partkey AS dst FROM li WHERE {a}
UNION ALL SELECT 'ships', e_id, l_suppkey, l_partkey FROM li WHERE {b}"""


def _frontier(spark, sf, wanted, end):
    edges = {k: e for k, e in g.commerce(spark, sf).edges.items() if k[1] in ("contains", "ships")}
    found = subgraph.frontier_subgraph(edges, wanted, end)
    named = [e.select(F.lit(k[1]).alias("relation"), "e_id", "src", "dst") for k, e in found.items()]
    return named[0].unionByName(named[1])


@query("frontier_in", views("li") + _FRONTIER.format(a=f"l_partkey IN ({LISTED})", b=f"l_partkey IN ({LISTED})"))
def frontier_in(spark, sf):
    return _frontier(spark, sf, {"part": g.ids(spark, PICK)}, "dst")


@query("frontier_out", views("li") + _FRONTIER.format(a="false", b=f"l_suppkey IN ({LISTED})"))
def frontier_out(spark, sf):
    return _frontier(spark, sf, {"supplier": g.ids(spark, PICK)}, "src")


@query("induced", views("handoff", more=NUMBERED) + "SELECT e_id, a.new_id AS src, b.new_id AS dst FROM handoff h JOIN sel a ON a.id = h.src JOIN sel b ON b.id = h.dst")
def induced(spark, sf):
    return subgraph.node_subgraph(g.handoff(spark, sf).select("e_id", "src", "dst"), g.ids(spark, PICK))[1]


@query("edge_pick", views("handoff") + "SELECT pos, e_id, src, dst FROM (SELECT *, row_number() OVER (ORDER BY e_id) - 1 AS p FROM handoff) JOIN (VALUES (0, 9), (1, 2), (2, 9)) v(pos, p) USING (p)")
def edge_pick(spark, sf):
    return subgraph.edge_subgraph(g.handoff(spark, sf).select("e_id", "src", "dst"), g.ids(spark, [9, 2, 9]).withColumnRenamed("id", "position"))


@query("compacted", views("handoff", more="seen AS (SELECT src AS id FROM handoff UNION SELECT dst FROM handoff), num AS (SELECT id, row_number() OVER (ORDER BY id) - 1 AS new_id FROM seen)")
       + "SELECT e_id, a.new_id AS src, b.new_id AS dst FROM handoff h JOIN num a ON a.id = h.src JOIN num b ON b.id = h.dst")
def compacted(spark, sf):
    edges = g.handoff(spark, sf).select("e_id", "src", "dst")
    ends = edges.select(F.explode(F.array("src", "dst")).alias("id")).distinct().withColumn("pos", F.col("id"))
    return subgraph.compact(edges, ends, check=False)[1]


@query("simplify", views("handoff") + "SELECT min(e_id) AS e_id, src, dst, count(*) AS n FROM handoff GROUP BY src, dst")
def simplify(spark, sf):
    return rewrite.to_simple(g.handoff(spark, sf), "n").select("e_id", "src", "dst", "n")


@query("reversed", views("handoff") + "SELECT e_id, dst AS src, src AS dst, t FROM handoff")
def reversed_(spark, sf):
    return rewrite.reverse(g.handoff(spark, sf), features=True).select("e_id", "src", "dst", "t")


@query("loops_removed", views("copart") + "SELECT e_id, src, dst, w FROM copart WHERE src <> dst")
def loops_removed(spark, sf):
    return rewrite.remove_self_loops(g.copart(spark, sf))


_LOOPLESS = "lack AS (SELECT id FROM users WHERE id NOT IN (SELECT src FROM handoff WHERE src = dst))"


@query("loops_added", views("users", "handoff", more=_LOOPLESS) + """SELECT e_id, src, dst, value FROM handoff UNION ALL
SELECT (SELECT max(e_id) FROM handoff) + row_number() OVER (ORDER BY id), id, id, 1.0 FROM lack""")
def loops_added(spark, sf):
    return rewrite.add_self_loops(g.users(spark, sf), g.handoff(spark, sf).select("e_id", "src", "dst", "value"), 1.0)


@query("loops_padded", views("users", "handoff", more=_LOOPLESS) + "SELECT e_id, src, dst, value FROM handoff UNION ALL SELECT 0, id, id, 0.0 FROM lack")
def loops_padded(spark, sf):
    return rewrite.add_self_loops(g.users(spark, sf), g.handoff(spark, sf).select("e_id", "src", "dst", "value"))


@query("bidirected", views("copart") + """SELECT e_id, src, dst, w FROM copart UNION ALL
SELECT 0, dst, src, 0.0 FROM copart a WHERE NOT EXISTS (SELECT 1 FROM copart b WHERE b.src = a.dst AND b.dst = a.src)""")
def bidirected(spark, sf):
    return rewrite.to_bidirected(g.copart(spark, sf))


@query("undirected_copyfeat", views("copart", more="""lone AS (SELECT arg_min(w, e_id) AS w, min(e_id) AS first_id, src, dst FROM copart a
 WHERE NOT EXISTS (SELECT 1 FROM copart b WHERE b.src = a.dst AND b.dst = a.src) GROUP BY src, dst)""") + """SELECT e_id, src, dst, w FROM copart UNION ALL
SELECT (SELECT max(e_id) FROM copart) + row_number() OVER (ORDER BY first_id), dst, src, w FROM lone""")
def undirected_copyfeat(spark, sf):
    return rewrite.to_bidirected(g.copart(spark, sf), copy=True)


_LINKS = """links AS (SELECT DISTINCT o_custkey AS a, -l_suppkey - 1 AS b FROM orders JOIN lineitem ON l_orderkey = o_orderkey), both_ways AS (SELECT a, b FROM links UNION SELECT b, a FROM links),
reach AS (SELECT b AS id, b AS c FROM links UNION SELECT w.b, r.c FROM reach r JOIN both_ways w ON w.a = r.id)"""


@query("components", "WITH RECURSIVE " + _LINKS + " SELECT id, min(c) AS component FROM reach GROUP BY id")
def components(spark, sf):
    t = g.table
    links = t(spark, sf, "orders").join(t(spark, sf, "lineitem"), F.col("l_orderkey") == F.col("o_orderkey"))
    with small_tasks(spark, partitions=UNKNOWN):
        return star_components(links.select(F.col("o_custkey").alias("src"), (-F.col("l_suppkey") - 1).alias("dst")))


@query("components_top2", "WITH RECURSIVE " + _LINKS + """, comp AS (SELECT id, min(c) AS component FROM reach GROUP BY id),
best AS (SELECT component FROM comp GROUP BY component ORDER BY count(*) DESC, component LIMIT 2)
SELECT id, component, row_number() OVER (ORDER BY id) - 1 AS new_id FROM comp WHERE component IN (SELECT component FROM best)""")
def components_top2(spark, sf):
    t = g.table
    links = t(spark, sf, "orders").join(t(spark, sf, "lineitem"), F.col("l_orderkey") == F.col("o_orderkey"))
    edges = links.select(F.col("l_orderkey").alias("e_id"), F.col("o_custkey").alias("src"), (-F.col("l_suppkey") - 1).alias("dst")).distinct()
    nodes = edges.select(F.explode(F.array("src", "dst")).alias("id")).distinct()
    return rewrite.largest_components(nodes, edges, 2)[0]


@query("line_edges", views("handoff") + "SELECT a.e_id AS src, b.e_id AS dst FROM handoff a JOIN handoff b ON a.dst = b.src WHERE a.src <> b.dst")
def line_edges(spark, sf):
    return rewrite.line_graph(g.handoff(spark, sf), backtracking=False)


@query("metapath_cust_part", "SELECT DISTINCT o_custkey AS src, l_partkey AS dst FROM orders JOIN lineitem ON l_orderkey = o_orderkey")
def metapath_cust_part(spark, sf):
    e = {k[1]: v for k, v in g.commerce(spark, sf).edges.items()}
    return rewrite.metapath_pairs([e["places"], e["contains"]])


@query("metapath_supp_region", "SELECT DISTINCT s_suppkey AS src, CAST(n_regionkey AS BIGINT) AS dst FROM supplier JOIN nation ON n_nationkey = s_nationkey")
def metapath_supp_region(spark, sf):
    e = {k[1]: v for k, v in g.commerce(spark, sf).edges.items()}
    return rewrite.metapath_pairs([e["sits_in"], e["part_of"]])


_HOP = """h0 AS (SELECT id, 0 AS hop FROM (VALUES (3), (5)) v(id)),
h1 AS (SELECT DISTINCT c.{b} AS id, 1 AS hop FROM h0 JOIN copart c ON c.{a} = h0.id WHERE c.{b} NOT IN (SELECT id FROM h0)),
h2 AS (SELECT DISTINCT c.{b} AS id, 2 AS hop FROM h1 JOIN copart c ON c.{a} = h1.id WHERE c.{b} NOT IN (SELECT id FROM h0 UNION SELECT id FROM h1))"""


@query("khop_out2", views("copart", more=_HOP.format(a="src", b="dst")) + "SELECT * FROM h0 UNION ALL SELECT * FROM h1 UNION ALL SELECT * FROM h2")
def khop_out2(spark, sf):
    return traverse.khop(g.copart(spark, sf), g.ids(spark, [3, 5]), 2, "out")


@query("khop_in2", views("copart", more=_HOP.format(a="dst", b="src")) + "SELECT * FROM h0 UNION ALL SELECT * FROM h1 UNION ALL SELECT * FROM h2")
def khop_in2(spark, sf):
    return traverse.khop(g.copart(spark, sf), g.ids(spark, [3, 5]), 2, "in")


@query("shadow", views("copart") + """, s AS (SELECT * FROM (VALUES (0, 3), (1, 5), (2, 8)) v(q, id)),
seen AS (SELECT q, id FROM s UNION SELECT q, dst FROM s JOIN copart ON src = id)
SELECT a.q, e_id, src, dst FROM copart JOIN seen a ON a.id = src JOIN seen b ON b.id = dst AND a.q = b.q""")
def shadow(spark, sf):
    seeds = g.ids(spark, [3, 5, 8]).withColumnRenamed("pos", "q")
    seen = traverse.khop(g.copart(spark, sf), seeds, 1, "out", key="q").select("q", "id")
    edges = g.copart(spark, sf).select("e_id", "src", "dst").join(seen.withColumnRenamed("id", "src"), "src")
    return edges.join(seen.withColumnRenamed("id", "dst"), ["q", "dst"]).select("q", "e_id", "src", "dst")


_NEAR = "near AS (SELECT src AS at, dst AS id FROM copart UNION SELECT dst, src FROM copart)"


def _cap(hop: int, seen: str, n: int) -> str:
    u = uniform_sql(1, str(hop), "id")
    return f"c{hop} AS (SELECT id, {hop} AS hop FROM (SELECT DISTINCT n.id FROM near n JOIN c{hop - 1} f ON f.id = n.at WHERE n.id NOT IN (SELECT id FROM {seen})) ORDER BY {u}, id LIMIT {n})"


@query("expand_capped", views("copart", more=_NEAR + ", c0 AS (SELECT id, 0 AS hop FROM (VALUES (3), (5)) v(id)), " + _cap(1, "c0", 10) + ", s1 AS (SELECT id FROM c0 UNION SELECT id FROM c1), " + _cap(2, "s1", 20))
       + "SELECT * FROM c0 UNION ALL SELECT * FROM c1 UNION ALL SELECT * FROM c2")
def expand_capped(spark, sf):
    return traverse.expand(g.copart(spark, sf), g.ids(spark, [3, 5]), [10, 20], seed=1)


def _walk_sql(steps: int) -> str:
    out = "near AS (SELECT src AS here, row_number() OVER (PARTITION BY src ORDER BY dst, e_id) - 1 AS k, count(*) OVER (PARTITION BY src) AS n, dst AS too FROM copart),\nw0 AS (SELECT id AS walk, id AS here FROM parts WHERE id % 50 = 0)"
    for i in range(1, steps + 1):
        out += f",\nw{i} AS (SELECT w.walk, coalesce(b.too, -1) AS here FROM w{i - 1} w LEFT JOIN near a ON a.here = w.here AND a.k = 0 LEFT JOIN near b ON b.here = w.here AND b.k = {uniform_sql(2, 'w.walk', str(i))} % a.n)"
    return out


@query("walk3", views("parts", "copart", more=_walk_sql(3)) + " UNION ALL ".join(f"SELECT walk, {i} AS step, here AS id FROM w{i}" for i in range(4)))
def walk3(spark, sf):
    starts = g.parts(spark, sf).where("id % 50 = 0").select(F.col("id").alias("walk"), "id")
    edges = g.copart(spark, sf)
    return traverse.random_walk([edges] * 3, starts, seed=2)


@query("metapath_walk", views("li", more=f"""n1 AS (SELECT o_custkey AS here, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS k, count(*) OVER (PARTITION BY o_custkey) AS n, o_orderkey AS too FROM orders),
n2 AS (SELECT l_orderkey AS here, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_partkey, e_id) - 1 AS k, count(*) OVER (PARTITION BY l_orderkey) AS n, l_partkey AS too FROM li),
w0 AS (SELECT c_custkey AS walk, c_custkey AS here FROM customer),
w1 AS (SELECT w.walk, coalesce(b.too, -1) AS here FROM w0 w LEFT JOIN n1 a ON a.here = w.here AND a.k = 0 LEFT JOIN n1 b ON b.here = w.here AND b.k = {uniform_sql(3, 'w.walk', '1')} % a.n),
w2 AS (SELECT w.walk, coalesce(b.too, -1) AS here FROM w1 w LEFT JOIN n2 a ON a.here = w.here AND a.k = 0 LEFT JOIN n2 b ON b.here = w.here AND b.k = {uniform_sql(3, 'w.walk', '2')} % a.n)""")
       + " UNION ALL ".join(f"SELECT walk, {i} AS step, here AS id FROM w{i}" for i in range(3)))
def metapath_walk(spark, sf):
    e = {k[1]: v for k, v in g.commerce(spark, sf).edges.items()}
    starts = g.table(spark, sf, "customer").select(F.col("c_custkey").alias("walk"), F.col("c_custkey").alias("id"))
    return traverse.random_walk([e["places"], e["contains"]], starts, seed=3)


@query("node2vec3", views("parts", "copart", more=_walk_sql(1) + f""",
d AS (SELECT src AS here, count(*) AS n FROM copart GROUP BY 1),
o AS (SELECT walk, walk AS prev, w1.here AS here, j, d.n FROM w1 JOIN d ON d.here = w1.here, unnest(range(320)) r(j)),
opt AS (SELECT o.walk, o.j, near.too, CASE WHEN near.too = o.prev THEN 0.5 WHEN z.src IS NOT NULL THEN 1.0 ELSE 0.25 END AS w FROM o JOIN near ON near.here = o.here AND near.k = {uniform_sql(2, 'o.walk', '2', 'o.j', "'edge'")} % o.n
 LEFT JOIN (SELECT DISTINCT src, dst FROM copart) z ON z.src = o.prev AND z.dst = near.too),
got AS (SELECT walk, arg_min(too, j) AS nxt FROM opt WHERE {uniform_sql(2, 'walk', '2', 'j', "'take'")} / {SPAN} < w GROUP BY walk)""")
       + "SELECT walk, 0 AS step, here AS id FROM w0 UNION ALL SELECT walk, 1, here FROM w1 UNION ALL SELECT w1.walk, 2, coalesce(nxt, -1) FROM w1 LEFT JOIN got USING (walk)")
def node2vec3(spark, sf):
    starts = g.parts(spark, sf).where("id % 50 = 0").select(F.col("id").alias("walk"), "id")
    return traverse.node2vec_walk(g.copart(spark, sf), starts, 2, p=2.0, q=4.0, seed=2)


@query("saint_node", views("users", "handoff", more=f"s AS (SELECT id FROM users ORDER BY {uniform_sql(4, 'id')}, id LIMIT 40)") + "SELECT e_id, src, dst FROM handoff WHERE src IN (SELECT id FROM s) AND dst IN (SELECT id FROM s)")
def saint_node(spark, sf):
    return subgraph.induced_edges(g.handoff(spark, sf).select("e_id", "src", "dst"), traverse.draw_rows(g.users(spark, sf), "id", 40, seed=4))


@query("saint_edge", views("handoff", more=f"s AS (SELECT * FROM handoff ORDER BY {uniform_sql(5, 'e_id')}, e_id LIMIT 30), n AS (SELECT src AS id FROM s UNION SELECT dst FROM s)")
       + "SELECT e_id, src, dst FROM handoff WHERE src IN (SELECT id FROM n) AND dst IN (SELECT id FROM n)")
def saint_edge(spark, sf):
    edges = g.handoff(spark, sf).select("e_id", "src", "dst")
    drawn = traverse.draw_rows(edges, "e_id", 30, seed=5)
    return subgraph.induced_edges(edges, drawn.select(F.explode(F.array("src", "dst")).alias("id")))


@query("saint_walk", views("parts", "copart", more=_walk_sql(2) + ", n AS (SELECT here AS id FROM w0 UNION SELECT here FROM w1 UNION SELECT here FROM w2)") + "SELECT e_id, src, dst FROM copart WHERE src IN (SELECT id FROM n) AND dst IN (SELECT id FROM n)")
def saint_walk(spark, sf):
    starts = g.parts(spark, sf).where("id % 50 = 0").select(F.col("id").alias("walk"), "id")
    edges = g.copart(spark, sf)
    return subgraph.induced_edges(edges.select("e_id", "src", "dst"), traverse.random_walk([edges] * 2, starts, seed=2))


@query("cluster_parts", views("parts", "copart", more=f"c AS (SELECT id, CAST(floor({uniform_sql(6, 'id')} * 8 / {SPAN}) AS INTEGER) AS part FROM parts)")
       + "SELECT e_id, src, dst, a.part FROM copart JOIN c a ON a.id = src JOIN c b ON b.id = dst WHERE a.part = b.part")
def cluster_parts(spark, sf):
    return traverse.cluster_edges(g.copart(spark, sf).select("e_id", "src", "dst"), traverse.clusters(g.parts(spark, sf), 8, seed=6)).select("e_id", "src", "dst", "part")


_BLOCK = """wanted AS (SELECT id, row_number() OVER (ORDER BY pos) - 1 AS new_id FROM (VALUES (0, 3), (1, 5), (2, 8), (4, 13)) v(pos, id)),
into_ AS (SELECT * FROM copart WHERE dst IN (SELECT id FROM wanted)),
src_ AS (SELECT id, row_number() OVER (ORDER BY part, pos) - 1 AS new_id FROM (SELECT id, 0 AS part, new_id AS pos FROM wanted UNION ALL
 SELECT src, 1, min(e_id) FROM into_ WHERE src NOT IN (SELECT id FROM wanted) GROUP BY src))"""


@query("block_layer", views("copart", more=_BLOCK) + "SELECT e_id, s.new_id AS src, d.new_id AS dst FROM into_ e JOIN src_ s ON s.id = e.src JOIN wanted d ON d.id = e.dst")
def block_layer(spark, sf):
    return subgraph.to_block(g.copart(spark, sf).select("e_id", "src", "dst"), g.ids(spark, PICK))[2]


@query("hetero_block", views("li", more="""wanted AS (SELECT id, row_number() OVER (ORDER BY pos) - 1 AS new_id FROM (VALUES (0, 3), (1, 5), (2, 8), (4, 13)) v(pos, id)),
a AS (SELECT * FROM li WHERE l_partkey IN (SELECT id FROM wanted)), so AS (SELECT l_orderkey AS id, row_number() OVER (ORDER BY min(e_id), l_orderkey) - 1 AS new_id FROM a GROUP BY l_orderkey),
ss AS (SELECT l_suppkey AS id, row_number() OVER (ORDER BY min(e_id), l_suppkey) - 1 AS new_id FROM a GROUP BY l_suppkey)""") + """SELECT 'contains' AS relation, e_id, so.new_id AS src, w.new_id AS dst FROM a JOIN so ON so.id = l_orderkey JOIN wanted w ON w.id = l_partkey
UNION ALL SELECT 'ships', e_id, ss.new_id, w.new_id FROM a JOIN ss ON ss.id = l_suppkey JOIN wanted w ON w.id = l_partkey""")
def hetero_block(spark, sf):
    edges = {k: e for k, e in g.commerce(spark, sf).edges.items() if k[1] in ("contains", "ships")}
    found = subgraph.to_hetero_block(edges, {"part": g.ids(spark, PICK)})[2]
    named = [e.select(F.lit(k[1]).alias("relation"), "e_id", "src", "dst") for k, e in found.items()]
    return named[0].unionByName(named[1])


@query("union_batch", views("li", more="""n AS (SELECT l_orderkey AS gid, count(*) AS n FROM li GROUP BY 1), f AS (SELECT gid, sum(n) OVER (ORDER BY gid) - n AS first FROM n)""")
       + "SELECT l_orderkey AS graph_id, CAST(e_id % 1000 + first AS BIGINT) AS id, l_quantity AS x FROM li JOIN f ON gid = l_orderkey")
def union_batch(spark, sf):
    nodes = g.li(spark, sf).select(F.col("l_orderkey").alias("graph_id"), (F.col("e_id") % 1000).alias("id"), F.col("l_quantity").alias("x"))
    none = spark.createDataFrame([], "graph_id long, src long, dst long")
    return subgraph.union_batch(nodes, none)[0].select("graph_id", "id", "x")


@query("supervision_removed", views("handoff") + "SELECT e_id, src, dst FROM handoff WHERE (src, dst) NOT IN (SELECT (src, dst) FROM handoff WHERE e_id % 11 = 0)")
def supervision_removed(spark, sf):
    edges = g.handoff(spark, sf).select("e_id", "src", "dst")
    return subgraph.without_supervision(edges, edges.where("e_id % 11 = 0")).select("e_id", "src", "dst")


_EVENTS = "ev AS (SELECT e_id AS q, src, dst, t FROM handoff)"
_DAY = 86_400_000_000


def _events(spark, sf):
    return g.handoff(spark, sf).select(F.col("e_id").alias("q"), "src", "dst", "t")


@query("history_strict", views("handoff", more=_EVENTS) + "SELECT q, e_id FROM ev JOIN handoff h ON h.src = ev.src WHERE h.t < ev.t")
def history_strict(spark, sf):
    return sampling.history(g.handoff(spark, sf), _events(spark, sf), on=[("src", "src")]).select("q", "e_id")


@query("history_window", views("handoff", more=_EVENTS) + f"SELECT q, e_id FROM ev JOIN handoff h ON h.src = ev.src WHERE h.t <= ev.t AND h.t >= ev.t - {7 * _DAY}")
def history_window(spark, sf):
    return sampling.history(g.handoff(spark, sf), _events(spark, sf), strict=False, window=7 * _DAY, on=[("src", "src")]).select("q", "e_id")


@query("history_lastk", views("handoff", more=_EVENTS) + "SELECT q, e_id FROM (SELECT q, h.e_id, row_number() OVER (PARTITION BY q ORDER BY h.t DESC, h.e_id DESC) AS n FROM ev JOIN handoff h ON h.src = ev.src WHERE h.t < ev.t) WHERE n <= 5")
def history_lastk(spark, sf):
    return sampling.history(g.handoff(spark, sf), _events(spark, sf), last=5, on=[("src", "src")]).select("q", "e_id")


_POS = "pos_ AS (SELECT e_id AS q, src, dst FROM handoff WHERE e_id % 50 = 0)"


def _positives(spark, sf):
    return g.handoff(spark, sf).where("e_id % 50 = 0").select(F.col("e_id").alias("q"), "src", "dst")


@query("neg_uniform", views("handoff", more=_POS + f""", tot AS (SELECT unnest(range((SELECT max(user_id) + 1 FROM events))) AS id), s AS (SELECT DISTINCT src FROM pos_),
free AS (SELECT s.src, tot.id, row_number() OVER (PARTITION BY s.src ORDER BY tot.id) - 1 AS k, count(*) OVER (PARTITION BY s.src) AS n FROM s, tot WHERE NOT EXISTS (SELECT 1 FROM handoff h WHERE h.src = s.src AND h.dst = tot.id)),
d AS (SELECT q, src, slot, {uniform_sql(7, 'q', 'slot')} AS u FROM pos_, (VALUES (1), (2), (3)) v(slot))""") + """SELECT q, src, dst, 1 AS label, 0 AS slot FROM pos_ UNION ALL
SELECT q, d.src, f.id, 0, slot FROM d JOIN free f ON f.src = d.src AND f.k = d.u % f.n""")
def neg_uniform(spark, sf):
    return sampling.uniform_negatives(g.handoff(spark, sf), _positives(spark, sf), 3, g.user_total(spark, sf), seed=7)


@query("neg_hard", views("handoff", more=_POS + f""", h AS (SELECT q, (dst + k * 7) % (SELECT max(user_id) + 1 FROM events) AS dst FROM pos_, (VALUES (0), (1), (2), (3), (4)) v(k)),
o AS (SELECT DISTINCT p.q, p.src, h.dst FROM pos_ p JOIN h USING (q) WHERE NOT EXISTS (SELECT 1 FROM handoff x WHERE x.src = p.src AND x.dst = h.dst))""")
       + f"SELECT * FROM (SELECT q, src, dst, row_number() OVER (PARTITION BY q ORDER BY {uniform_sql(8, 'q', 'dst')}, dst) AS slot FROM o) WHERE slot <= 2")
def neg_hard(spark, sf):
    p = _positives(spark, sf)
    hard = p.withColumn("k", F.explode(F.array(*map(F.lit, range(5))))).select("q", ((F.col("dst") + F.col("k") * 7) % g.user_total(spark, sf)).alias("dst"))
    return sampling.hard_negatives(g.handoff(spark, sf), p, hard, 2, seed=8)


@query("candidates_flagged", views("handoff", more=_POS + ", o AS (SELECT q, (dst + k * 3) % (SELECT max(user_id) + 1 FROM events) AS dst FROM pos_, (VALUES (0), (1), (2), (3), (4)) v(k))") + """SELECT q, src, dst, 1 AS label, false AS filtered FROM pos_ UNION ALL
SELECT DISTINCT p.q, p.src, o.dst, 0, EXISTS (SELECT 1 FROM handoff x WHERE x.src = p.src AND x.dst = o.dst) FROM pos_ p JOIN o USING (q) WHERE o.dst <> p.dst""")
def candidates_flagged(spark, sf):
    p = _positives(spark, sf)
    options = p.withColumn("k", F.explode(F.array(*map(F.lit, range(5))))).select("q", ((F.col("dst") + F.col("k") * 3) % g.user_total(spark, sf)).alias("dst"))
    return sampling.candidates(g.handoff(spark, sf), p, options)
