"""Graphs from and to CSV tables, edge lists, parquet data sets and other libraries' objects."""

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, NumericType

from tessel.functions.joins import join_back
from tessel.functions.ordering import with_position
from tessel.model import GraphError, PropertyGraph


def _numeric(df: DataFrame, skip: tuple[str, ...]) -> DataFrame:
    """Integers as longs, other numbers as doubles; anything else is refused."""
    out = df
    for f in df.schema.fields:
        if f.name in skip:
            continue
        if not isinstance(f.dataType, NumericType):
            raise GraphError(f"column {f.name!r} is not numeric")
        out = out.withColumn(f.name, F.col(f"`{f.name}`").cast("long" if isinstance(f.dataType, (IntegerType, LongType)) else "double"))
    return out


def _read_csv(spark: SparkSession, path: str, delimiter: str, columns: list[str] | None, needed: list[str]) -> DataFrame:
    df = spark.read.csv(path, header=True, sep=delimiter, inferSchema=True)
    if missing := [c for c in needed if c not in df.columns]:
        raise GraphError(f"the file has no columns {missing}")
    return df.select(*needed, *(columns if columns is not None else [c for c in df.columns if c not in needed]))


def read_csv_tables(spark: SparkSession, nodes: str, edges: str, node_id: str = "node_id", src: str = "src", dst: str = "dst", node_columns: list[str] | None = None, edge_columns: list[str] | None = None, delimiter: str = ",") -> PropertyGraph:
    """A graph from a node and an edge table with headers.

    Public ids become dense ids in ascending order and stay as ``n_id``; repeated ids and edges
    to unknown nodes are refused.
    """
    n = _numeric(_read_csv(spark, nodes, delimiter, node_columns, [node_id]), ()).withColumnRenamed(node_id, "n_id")
    if not n.groupBy("n_id").agg(F.count(F.lit(1)).alias("c")).where("c > 1 or n_id is null").isEmpty():
        raise GraphError("node ids must be present and unique")
    n = with_position(n, "n_id", name="id")
    e = _numeric(_read_csv(spark, edges, delimiter, edge_columns, [src, dst]), ()).withColumnsRenamed({src: "__a", dst: "__b"})
    known = n.select("n_id", "id")
    ends = e.select(F.explode(F.array("__a", "__b")).alias("n_id"))
    if not ends.join(known, "n_id", "left_anti").isEmpty():
        raise GraphError("an edge has an end that is no node")
    e = e.join(known.select(F.col("n_id").alias("__a"), F.col("id").alias("src")), "__a").join(known.select(F.col("n_id").alias("__b"), F.col("id").alias("dst")), "__b").drop("__a", "__b")
    if "e_id" not in e.columns:
        e = with_position(e, "src", "dst", name="e_id")
    return PropertyGraph.homogeneous(n, e)


def write_csv_tables(graph: PropertyGraph, nodes: str, edges: str, node_id: str = "node_id", delimiter: str = ",") -> None:
    """Scalar numeric columns of a one-type graph as two CSV folders with headers."""
    n, e = graph.node_table(), graph.edge_table()
    public = "n_id" if "n_id" in n.columns else "id"
    names = n.select("id", F.col(public).alias("__p"))
    scalars = lambda df, skip: [f.name for f in df.schema.fields if isinstance(f.dataType, NumericType) and f.name not in skip]
    n.select(F.col(public).alias(node_id), *scalars(n, ("id", "n_id"))).write.csv(nodes, header=True, sep=delimiter)
    out = e.join(names.select(F.col("id").alias("src"), F.col("__p").alias("__a")), "src").join(names.select(F.col("id").alias("dst"), F.col("__p").alias("__b")), "dst")
    out.select(F.col("__a").alias("src"), F.col("__b").alias("dst"), *scalars(e, ("src", "dst"))).write.csv(edges, header=True, sep=delimiter)


def read_edge_list(spark: SparkSession, path: str, src: str = "src", dst: str = "dst", columns: list[str] | None = None, delimiter: str = ",", nodes: int | None = None) -> PropertyGraph:
    """A graph from an edge table; ids count from 0 to the largest end, or to ``nodes``."""
    e = _numeric(_read_csv(spark, path, delimiter, columns, [src, dst]), ()).withColumnsRenamed({src: "src", dst: "dst"})
    return from_edges(e, nodes)


def from_edges(edges: DataFrame, nodes: int | None = None) -> PropertyGraph:
    """A graph of an edge table ``(src, dst, …)``."""
    top = edges.agg(F.max(F.greatest("src", "dst")).alias("t"), F.min(F.least("src", "dst")).alias("b")).first()
    most = -1 if top["t"] is None else top["t"]
    if nodes is not None and most >= nodes or top["b"] is not None and top["b"] < 0:
        raise GraphError("an edge has an end out of range")
    if "e_id" not in edges.columns:
        edges = with_position(edges, "src", "dst", name="e_id")
    return PropertyGraph.homogeneous(edges.sparkSession.range(nodes if nodes is not None else most + 1), edges)


def from_pairs(spark: SparkSession, pairs: list, nodes: int | None = None, node_data: dict[str, list] | None = None, edge_data: dict[str, list] | None = None) -> PropertyGraph:
    """A graph of a short list: rows of two, or two rows; two of two are two rows.

    ``node_data`` and ``edge_data`` are columns of as many values as there are nodes and pairs; a
    value may be a number or a list of numbers.
    """
    if len(pairs) == 2 and len(pairs[0]) == len(pairs[1]):
        pairs = list(zip(*pairs, strict=True))
    node_data, edge_data = node_data or {}, edge_data or {}
    if any(len(v) != len(pairs) for v in edge_data.values()):
        raise GraphError("edge data must have a value for each pair")
    known = {len(v) for v in node_data.values()} | ({nodes} if nodes is not None else set())
    if len(known) > 1:
        raise GraphError("node data must have a value for each node")
    edge_data, node_data = ({k: _typed(v) for k, v in data.items()} for data in (edge_data, node_data))
    rows = [(i, int(a), int(b), *[v[i] for v in edge_data.values()]) for i, (a, b) in enumerate(pairs)]
    graph = from_edges(spark.createDataFrame(rows, ", ".join(["e_id long, src long, dst long", *[f"`{k}` {_kind(v)}" for k, v in edge_data.items()]])), next(iter(known), None))
    if not node_data:
        return graph
    n = next(iter(known))
    table = spark.createDataFrame([(i, *[v[i] for v in node_data.values()]) for i in range(n)], ", ".join(["id long", *[f"`{k}` {_kind(v)}" for k, v in node_data.items()]]))
    return PropertyGraph.homogeneous(table, graph.edge_table())


def _typed(values: list) -> list:
    """The values of a column as Spark takes them: all longs, all doubles or lists of doubles."""
    kind = _kind(values)
    return [[float(x) for x in v] if kind == "array<double>" else int(v) if kind == "long" else float(v) for v in values]


def _kind(values: list) -> str:
    if any(isinstance(v, (list, tuple)) for v in values):
        return "array<double>"
    return "long" if all(isinstance(v, int) for v in values) else "double"


def write_edge_list(graph: PropertyGraph, path: str, delimiter: str = ",") -> None:
    """Edges with their scalar numeric columns as a CSV folder."""
    e = graph.edge_table()
    if not e.groupBy("e_id").agg(F.count(F.lit(1)).alias("c")).where("c > 1").isEmpty():
        raise GraphError("edge ids must be unique")
    e.select("src", "dst", *[f.name for f in e.schema.fields if isinstance(f.dataType, NumericType) and f.name not in ("src", "dst")]).write.csv(path, header=True, sep=delimiter)


def to_edge_list(graph: PropertyGraph) -> DataFrame:
    """``(src, dst)`` by edge id."""
    return graph.edge_table().orderBy("e_id").select("src", "dst")


def write_graph(graph: PropertyGraph, path: str) -> None:
    """Every table as parquet, with a schema file that names types, relations and the time column."""
    schema = {"nodes": sorted(graph.nodes), "edges": [list(k) for k in sorted(graph.edges)], "time": graph.time}
    for k, df in graph.nodes.items():
        df.write.parquet(f"{path}/nodes/{k}")
    for k, df in graph.edges.items():
        df.write.parquet(f"{path}/edges/{'__'.join(k)}")
    graph.spark.createDataFrame([(json.dumps(schema),)], "value string").coalesce(1).write.text(f"{path}/schema")


def read_graph(spark: SparkSession, path: str) -> PropertyGraph:
    """A graph written by :func:`write_graph`, lazily."""
    schema = json.loads(spark.read.text(f"{path}/schema").first()["value"])
    nodes = {k: spark.read.parquet(f"{path}/nodes/{k}") for k in schema["nodes"]}
    edges = {tuple(k): spark.read.parquet(f"{path}/edges/{'__'.join(k)}") for k in schema["edges"]}
    return PropertyGraph.typed(nodes, edges, schema["time"])


def write_dataset(nodes: DataFrame, edges: DataFrame, path: str, splits: dict[str, int], name: str = "graphs", version: str = "1") -> dict:
    """Many graphs, tables with ``graph_id``, with a manifest of consecutive splits."""
    nodes.repartition("graph_id").sortWithinPartitions("graph_id").write.mode("overwrite").parquet(f"{path}/nodes")
    edges.repartition("graph_id").sortWithinPartitions("graph_id").write.mode("overwrite").parquet(f"{path}/edges")
    manifest = checked_manifest({"name": name, "version": version, "splits": splits})
    nodes.sparkSession.createDataFrame([(json.dumps(manifest),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/manifest")
    return manifest


def read_dataset(spark: SparkSession, path: str, split: str | None = None) -> tuple[DataFrame, DataFrame]:
    """``(nodes, edges)`` of all graphs or of a split; the range of ids prunes row groups."""
    nodes, edges = spark.read.parquet(f"{path}/nodes"), spark.read.parquet(f"{path}/edges")
    if split is None:
        return nodes, edges
    splits = checked_manifest(json.loads(spark.read.text(f"{path}/manifest").first()["value"]))["splits"]
    if split not in splits:
        raise GraphError(f"no split {split!r}")
    first = 0
    for name, n in splits.items():
        if name == split:
            break
        first += n
    inside = F.col("graph_id").between(first, first + splits[split] - 1)
    return nodes.where(inside), edges.where(inside)


#: Fields of a manifest and what each must be.
MANIFEST = {"name": str, "version": str, "splits": dict}


def checked_manifest(found: dict) -> dict:
    """A manifest with all its fields, of the right kinds and sizes; anything else is refused."""
    if not isinstance(found, dict):
        raise GraphError("a manifest must be a mapping")
    for field, kind in MANIFEST.items():
        if field not in found:
            raise GraphError(f"the manifest has no {field!r}")
        if not isinstance(found[field], kind) or not found[field]:
            raise GraphError(f"the manifest's {field!r} must be a {kind.__name__} that isn't empty")
    for name, n in found["splits"].items():
        if not isinstance(n, int) or isinstance(n, bool) or n < 0:
            raise GraphError(f"the size of split {name!r} must be a whole number")
    return dict(found)


def fingerprint(manifest: dict) -> str:
    """The SHA-256 of a manifest."""
    import hashlib

    return hashlib.sha256(json.dumps(manifest, sort_keys=True).encode()).hexdigest()


def from_indicator_tables(adjacency: DataFrame, indicator: DataFrame, labels: DataFrame, node_attributes: DataFrame | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """``(nodes, edges, graphs)`` of a collection given by node pairs, each node's graph and each graph's label.

    Nodes ``indicator(node, graph_id)``; pairs ``adjacency(src, dst, …)`` in node numbers, whose
    other columns are edge attributes; ``node_attributes(node, …)`` are joined to the nodes;
    labels ``(graph_id, label)`` become dense numbers by ascending value.
    """
    first = indicator.groupBy("graph_id").agg(F.min("node").alias("first"))
    nodes = join_back(indicator, first, "graph_id").select("graph_id", (F.col("node") - F.col("first")).alias("id"), "node")
    at = nodes.select(F.col("node").alias("src"), "graph_id", F.col("id").alias("__a"))
    to = nodes.select(F.col("node").alias("dst"), F.col("id").alias("__b"))
    more = [c for c in adjacency.columns if c not in ("src", "dst")]
    edges = adjacency.join(at, "src").join(to, "dst").select("graph_id", F.col("__a").alias("src"), F.col("__b").alias("dst"), *more)
    if node_attributes is not None:
        nodes = nodes.join(node_attributes, "node", "left")
    dense = with_position(labels.select("label").distinct(), "label", name="y")
    return nodes.drop("node"), edges, labels.join(dense, "label").select("graph_id", "y")


def from_object(spark: SparkSession, graph) -> PropertyGraph:
    """A graph of another library's small in-memory object.

    Directed graphs with ``nodes(data=True)`` and ``edges(data=True)``, or objects with
    ``edge_index`` and optional ``num_nodes``; the object is on the driver to begin with.
    """
    if hasattr(graph, "edge_index"):
        a, b = ([int(v) for v in r] for r in graph.edge_index)
        return from_edges(spark.createDataFrame([(i, *p) for i, p in enumerate(zip(a, b, strict=True))], "e_id long, src long, dst long"), getattr(graph, "num_nodes", None))
    if not graph.is_directed():
        raise GraphError("the graph must be directed")
    names = {n: i for i, n in enumerate(graph.nodes())}
    nodes = spark.createDataFrame([(i, int(n)) for n, i in names.items()], "id long, n_id long")
    edges = spark.createDataFrame([(i, names[a], names[b]) for i, (a, b) in enumerate(graph.edges())], "e_id long, src long, dst long")
    return PropertyGraph.homogeneous(nodes, edges)
