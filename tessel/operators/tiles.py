"""Layers over graphs of one tile in numpy, on Arrow batches of rows with a graph each.

Spark deals nodes and edges by their graph and makes the rows; a task takes them in Arrow batches.
Graphs of a batch that have equally many nodes are stacked, ``(graphs, nodes, entries)``, and a
layer is a few operations on a stack.  A stack has ``CELLS`` pairs of nodes at most, or one graph.
"""

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from tessel.functions.batches import starts
from tessel.functions.vectors import ERFC

#: Pairs of nodes of a stack.
CELLS = 1 << 18

#: ``(x, links, more)``: nodes' vectors, ``links[g, b, a]`` the number of edges from ``a`` to ``b``, and
#: ``more[g, b]`` those from nodes that aren't of the graph.
Layers = Callable[[np.ndarray, np.ndarray, np.ndarray], list[np.ndarray]]


def affine(x: np.ndarray, weight: list[list[float]], bias: list[float] | None = None) -> np.ndarray:
    """The affine image of the vectors."""
    out = x.reshape(-1, x.shape[-1]) @ np.asarray(weight, float).T
    return (out if bias is None else out + np.asarray(bias, float)).reshape(*x.shape[:-1], len(weight))


def norm(x: np.ndarray, eps: float = 1e-5) -> np.ndarray:
    """Vectors less their mean, over their deviation."""
    x = x - x.mean(-1, keepdims=True)
    return x / np.sqrt((x * x).mean(-1, keepdims=True) + eps)


def gelu(v: np.ndarray) -> np.ndarray:
    """As ``functions.vectors.gelu``."""
    t = 1 / (1 + 0.5 * np.abs(v) / 2.0**0.5)
    power = np.full_like(v, ERFC[-1])
    for c in reversed(ERFC[:-1]):
        power = c + t * power
    half = 0.5 * t * np.exp(power - v * v / 2)
    return v * np.where(v >= 0, 1 - half, half)


def attended(x: np.ndarray, w: dict, heads: int, bias: np.ndarray | None = None) -> np.ndarray:
    """Attention of every node of a graph to every one, through ``out``; ``bias`` is ``(graphs, nodes, nodes, heads)``."""
    size = len(w["query"][0]) // heads
    q, k, v = (affine(x, *w[of]) for of in ("query", "key", "value"))
    out = np.empty_like(v)
    for h in range(heads):
        at = slice(h * size, (h + 1) * size)
        score = q[..., at] @ k[..., at].swapaxes(1, 2) / size**0.5
        if bias is not None:
            score += bias[..., h]
        score = np.exp(score - score.max(-1, keepdims=True))
        out[..., at] = score @ v[..., at] / score.sum(-1, keepdims=True)
    return affine(out, *w["out"])


def settled(x: np.ndarray, more: np.ndarray, w: dict) -> np.ndarray:
    """A residual and a layer norm around ``more``, then around the feed-forward network."""
    x = norm(x + more)
    return norm(x + affine(gelu(affine(x, *w["up"])), *w["down"]))


def mean(x: np.ndarray, links: np.ndarray) -> np.ndarray:
    """The mean of the sources' vectors, zeros without any."""
    return links @ x / np.maximum(links.sum(-1, keepdims=True), 1)


def distances(links: np.ndarray, most: int) -> np.ndarray:
    """The edges between two nodes, either way; ``most + 1`` for those farther than ``most``."""
    n = links.shape[1]
    beside = ((links + links.swapaxes(1, 2)) > 0).astype(np.float32)
    far = np.full(links.shape, most + 1)
    far[:, np.arange(n), np.arange(n)] = 0
    front = (far == 0).astype(np.float32)
    for d in range(1, most + 1):
        front = ((front @ beside > 0) & (far > d)).astype(np.float32)
        far[front > 0] = d
    return far


def _vectors(x: pa.ListArray, width: int) -> np.ndarray:
    """A matrix of a column of vectors; what is null is NaN."""
    values = x.flatten().to_numpy(zero_copy_only=False).astype(float, copy=False)
    if len(values) == len(x) * width and not x.null_count:
        return values.reshape(-1, width)
    out = np.full((len(x), width), np.nan)
    out[np.arange(width) < pc.fill_null(pc.list_value_length(x), 0).to_numpy(zero_copy_only=False)[:, None]] = values
    return out


def _column(x: np.ndarray, nulls: bool) -> pa.ListArray:
    ends = np.arange(0, x.size + 1, x.shape[-1], dtype=np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(x.reshape(-1), from_pandas=nulls))


def _linked(batch: pa.RecordBatch, start: np.ndarray, ids: pa.Array) -> tuple[np.ndarray, ...]:
    """``(target, source, n)`` of the batch's edges, ends as numbers of nodes in the batch, a source of no node -1."""
    links = batch.column("links")
    cells = links.flatten()
    graphs = len(batch)
    codes = pa.concat_arrays([ids, cells.field("src"), cells.field("dst")]).dictionary_encode().indices.fill_null(-1).to_numpy().astype(np.int64)
    of = np.repeat(np.arange(graphs), np.diff(starts(links)))
    nodes = codes[: len(ids)] * graphs + np.repeat(np.arange(graphs), np.diff(start))
    order = np.argsort(nodes, kind="stable")
    ranked = nodes[order]

    def place(code: np.ndarray) -> np.ndarray:
        key = code * graphs + of
        at = np.minimum(np.searchsorted(ranked, key), len(ranked) - 1)
        return np.where((ranked[at] == key) & (code >= 0), order[at], -1)

    src, dst = codes[len(ids) : len(ids) + len(cells)], codes[len(ids) + len(cells) :]
    n = cells.field("n").to_numpy(zero_copy_only=False).astype(float)
    source, target = place(src), place(dst)
    return target[target >= 0], source[target >= 0], n[target >= 0]


def over(rows: DataFrame, width: int, names: list[str], layers: Layers) -> DataFrame:
    """``(id, <names>)`` for each node of ``rows(ids, xs[, links])``: the vectors that ``layers`` gives for stacks of graphs."""
    kind = rows.schema["ids"].dataType.elementType.simpleString()
    linked = "links" in rows.columns

    def batches(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in found:
            if not len(batch):
                continue
            ids = batch.column("ids").flatten()
            vectors = batch.column("xs").flatten()
            x, nulls = _vectors(vectors, width), bool(vectors.null_count or vectors.flatten().null_count)
            start = starts(batch.column("ids"))
            sizes = np.diff(start)
            local = np.arange(len(ids)) - np.repeat(start[:-1], sizes)
            if linked:
                target, source, n = _linked(batch, start, ids)
                graph = np.repeat(np.arange(len(batch)), sizes)[target]
            for size in np.unique(sizes[sizes > 0]):
                same = np.flatnonzero(sizes == size)
                if linked:
                    mine = np.flatnonzero(sizes[graph] == size)
                    mine = mine[np.argsort(graph[mine], kind="stable")]
                step = max(1, CELLS // int(size) ** 2)
                for low in range(0, len(same), step):
                    graphs = same[low : low + step]
                    nodes = start[graphs][:, None] + np.arange(size)
                    links, more = np.zeros((len(graphs), size, size)), np.zeros((len(graphs), size))
                    if linked:
                        ends = np.searchsorted(graph[mine], [graphs[0], graphs[-1] + 1])
                        part = mine[ends[0] : ends[1]]
                        g, known = np.searchsorted(graphs, graph[part]), source[part] >= 0
                        np.add.at(links, (g[known], local[target[part]][known], local[source[part]][known]), n[part][known])
                        np.add.at(more, (g[~known], local[target[part]][~known]), n[part][~known])
                    out = layers(x[nodes], links, more)
                    yield pa.RecordBatch.from_arrays([ids.take(pa.array(nodes.reshape(-1))), *[_column(o, nulls) for o in out]], ["id", *names])

    return rows.mapInArrow(batches, f"id {kind}, " + ", ".join(f"{n} array<double>" for n in names))
