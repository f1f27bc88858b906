"""The property graph: typed node and edge tables, held as lazy DataFrames.

Nodes have an ``id``; edges have ``e_id``, ``src`` and ``dst``.  Any further column is a feature.
``e_id`` gives the order of edges wherever order matters.  A relation is named by its source
type, its own name and its destination type.
"""

from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

Relation = tuple[str, str, str]
NODE = "node"
EDGE: Relation = (NODE, "to", NODE)


class GraphError(ValueError):
    """A graph, a request or a relation that cannot be."""


@dataclass(frozen=True)
class PropertyGraph:
    """Nodes by type, edges by relation, and the name of the time column if edges have one."""

    nodes: dict[str, DataFrame]
    edges: dict[Relation, DataFrame]
    time: str | None = None
    spark: SparkSession | None = field(default=None, compare=False)

    @classmethod
    def homogeneous(cls, nodes: DataFrame, edges: DataFrame, time: str | None = None) -> "PropertyGraph":
        """One node type and one relation."""
        return cls.typed({NODE: nodes}, {EDGE: edges}, time)

    @classmethod
    def typed(cls, nodes: dict[str, DataFrame], edges: dict[Relation, DataFrame], time: str | None = None) -> "PropertyGraph":
        """Many types; columns and endpoint types are checked, rows are not read."""
        for kind, df in nodes.items():
            if "id" not in df.columns:
                raise GraphError(f"nodes {kind!r} need an id column")
        for (src, name, dst), df in edges.items():
            if missing := {"e_id", "src", "dst"} - set(df.columns):
                raise GraphError(f"relation {name!r} needs columns {sorted(missing)}")
            if src not in nodes or dst not in nodes:
                raise GraphError(f"relation {name!r} joins node types that are not declared")
            if time is not None and time not in df.columns:
                raise GraphError(f"relation {name!r} has no time column {time!r}")
        found = next(iter([*nodes.values(), *edges.values()]), None)
        return cls(dict(nodes), dict(edges), time, None if found is None else found.sparkSession)

    def relation(self, edge_type: Relation | None = None) -> Relation:
        """The named relation, or the only one."""
        if edge_type is not None:
            if edge_type not in self.edges:
                raise GraphError(f"no relation {edge_type}")
            return edge_type
        if EDGE in self.edges:
            return EDGE
        if len(self.edges) != 1:
            raise GraphError("the graph has several relations; name one")
        return next(iter(self.edges))

    def edge_table(self, edge_type: Relation | None = None) -> DataFrame:
        """The edges of a relation."""
        return self.edges[self.relation(edge_type)]

    def node_table(self, node_type: str | None = None) -> DataFrame:
        """The nodes of a type, or of the only one."""
        if node_type is None:
            node_type = NODE if NODE in self.nodes else next(iter(self.nodes))
        if node_type not in self.nodes:
            raise GraphError(f"no node type {node_type!r}")
        return self.nodes[node_type]

    def with_edges(self, edges: DataFrame, edge_type: Relation | None = None) -> "PropertyGraph":
        """The graph with one relation's edges replaced."""
        return replace(self, edges={**self.edges, self.relation(edge_type): edges})

    def snapshot(self, at) -> "PropertyGraph":
        """Edges up to and including a time, in every relation."""
        return self._timed(lambda t: t <= at)

    def window(self, start, end) -> "PropertyGraph":
        """Edges from ``start`` to ``end``, both included, in every relation."""
        return self._timed(lambda t: t.between(start, end))

    def _timed(self, test) -> "PropertyGraph":
        if self.time is None:
            raise GraphError("the graph has no time column")
        return replace(self, edges={k: e.where(test(F.col(self.time))) for k, e in self.edges.items()})

    def register(self, prefix: str) -> list[str]:
        """Temporary views of every table, so that SQL can use them; returns their names."""
        named = {f"{prefix}_{k}": df for k, df in self.nodes.items()} | {f"{prefix}_{'_'.join(k)}": df for k, df in self.edges.items()}
        for name, df in named.items():
            df.createOrReplaceTempView(name)
        return sorted(named)

    def check_endpoints(self) -> None:
        """Read the tables and fail on an edge whose endpoint is no node."""
        for (src, name, dst), e in self.edges.items():
            for kind, end in ((src, "src"), (dst, "dst")):
                ids = self.nodes[kind].select(F.col("id").alias(end))
                if not e.join(ids, end, "left_anti").isEmpty():
                    raise GraphError(f"relation {name!r} has a {end} that is no {kind!r} node")
