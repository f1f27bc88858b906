"""Quality scores from random-indexing word vectors and a two-layer network.

Every token has a sparse ternary index vector drawn from its hash, to which that of its shape
(case, digits, symbols, length) is added.  Over all documents each token of the vocabulary gathers
the index vectors of its neighbours, permuted by side, as its context vector; its word vector is
the sum of both.  A document is pooled from the vectors of its tokens: the mean, the root mean
square, and the mean product of neighbours, which tells runs of repeated words.  A network of
one hidden layer is trained in numpy; a temperature, fitted on texts that it didn't see, scales
its logits to probabilities.

Token counts and context sums are whole numbers gathered from every whole text, per task first
and then by token, so they are the same on any cluster.  The vocabulary is the most frequent
tokens, ``VOCABULARY`` at most, each seen ``LEAST`` times; any other token has its index vector
alone.  Only the network is fitted on a bounded sample of labelled rows (``max_rows`` and
``max_chars``).  Every whole text is scored in one narrow stage.  Null and empty texts have no
token and are scored as the zero vector.  Without labelled rows of both classes, the score is the
smoothed share of label 1.  Repeated rows are scored alike; other columns are ignored or, in
``keep_good``, kept.
"""

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from tessel.llm.common import SLICE, free_name, remainder, slices, training_rows
from tessel.plans.staging import staged

WIDTH, NONZERO = 48, 6
VOCABULARY, LEAST = 20_000, 5
#: Neighbours on each side, and characters of the longest token that has a context vector.
REACH, LONGEST = 2, 64
#: Distinct tokens that a task counts before it hands them on, and bytes of texts cut into pieces
#: at a time to count tokens, to number them.
KEPT, COUNTED, HELD = 200_000, 1 << 23, 1 << 20
#: Rows scored at a time.
SCORED = 1024
#: Tokens of a zero vector that every document is taken to have besides its own: it keeps the
#: averages of a very short text from being those of one or two chance vectors.
SHRINK = 8
MODULUS, HELD_OUT = 3, 1
#: Labelled rows of a fit at most, and characters of all their texts.
MAX_ROWS, MAX_CHARS = 4000, 40_000_000
_TOKENS = re.compile(r"[^\W_]+|(?:[^\w\s]|_)+|\n").findall


def tokens(text: str) -> list[str]:
    """Words, runs of symbols, and line breaks."""
    return _TOKENS(text)


def _ternary(keys: list[str]) -> np.ndarray:
    """A row of ``NONZERO`` signs in drawn places for each key."""
    h = np.array([zlib.crc32(k.encode("utf-8", "surrogatepass")) for k in keys], np.uint64)
    out, rows = np.zeros((len(keys), WIDTH), np.float32), np.arange(len(keys))
    for _ in range(NONZERO):
        h = h * np.uint64(6364136223846793005) + np.uint64(1442695040888963407)
        out[rows, (h >> np.uint64(33)) % np.uint64(WIDTH)] += np.where(h >> np.uint64(63), 1.0, -1.0).astype(np.float32)
    return out


def _shape(token: str) -> str:
    if token.isalpha():
        case = "lower" if token.islower() else "upper" if token.isupper() and len(token) > 1 else "title" if token[0].isupper() else "mixed"
        return f"{case} {min(len(token), 12) // 3}"
    if token.isalnum():
        return f"number {token.isdecimal()}"
    return f"symbol {token[:1]} {min(len(token), 4)}"


@lru_cache(maxsize=4096)
def _of_shape(shape: str) -> np.ndarray:
    return _ternary(["\0" + shape])[0]


def index_vectors(found: list[str]) -> np.ndarray:
    """Each token's own random vector plus that of its shape."""
    if not found:
        return np.zeros((0, WIDTH), np.float32)
    shapes = _Rows()
    at = np.fromiter(map(shapes.__getitem__, map(_shape, found)), np.int32, len(found))
    return _ternary(found) + np.stack([_of_shape(s) for s in shapes.new])[at]


class _Rows(dict):
    """Row numbers of keys, dealt on first sight; ``new`` are the keys in that order."""

    def __init__(self):
        super().__init__()
        self.new: list[str] = []

    def __missing__(self, token: str) -> int:
        self[token] = at = len(self)
        self.new.append(token)
        return at


def stretches(texts: pa.Array, most: int = HELD) -> Iterator[pa.Array]:
    """Consecutive texts of at most ``most`` bytes in all, or one longer text."""
    ends, at, before = np.cumsum(pc.binary_length(texts).to_numpy(), dtype=np.int64), 0, 0
    while at < len(texts):
        end = max(at + 1, int(np.searchsorted(ends, before + most, "right")))
        yield texts.slice(at, end - at)
        at, before = end, ends[end - 1]


def _cut(pieces: list[str]) -> tuple[list[str], list[int]]:
    """The tokens of pieces that hold no space, and how many each has."""
    found, many = [], []
    for p in pieces:
        if p.isalnum():
            found.append(p)
            many.append(1)
        else:
            inside = tokens(p)
            found += inside
            many.append(len(inside))
    return found, many


def numbered(texts: pa.Array, known: list[str], number) -> tuple[np.ndarray, np.ndarray]:
    """The numbers of the tokens of whole texts in a row, and how many each text has.

    No token holds a space, so those of a text are those of its pieces between spaces.  A piece
    that is a token of ``known`` has its place there; tokens of the others have what ``number``
    gives for a list of tokens.
    """
    cut = pc.split_pattern(texts, " ")
    pieces = cut.flatten()
    rows = pc.fill_null(pc.index_in(pieces, value_set=pa.array(known, pieces.type)), -1).to_numpy()
    other, many = rows < 0, np.ones(len(rows), np.int64)
    rest = pieces.filter(pa.array(other)).dictionary_encode()
    found, each = _cut(rest.dictionary.to_numpy(zero_copy_only=False).tolist())
    numbers, each, of = number(found), np.array(each, np.int64), rest.indices.to_numpy()
    many[other] = each[of]
    out, ends = np.repeat(rows, many), np.cumsum(each[of])
    if len(ends):
        out[np.repeat(other, many)] = numbers[np.arange(ends[-1]) + np.repeat((np.cumsum(each) - each)[of] - (ends - each[of]), each[of])]
    lengths = pc.list_value_length(cut).to_numpy()  # one at least
    return out, np.add.reduceat(many, np.cumsum(lengths) - lengths)


def _room(rows: np.ndarray, size: int) -> np.ndarray:
    """The same rows with room for ``size`` of them at least."""
    if len(rows) >= size:
        return rows
    out = np.zeros((max(size, 2 * len(rows)), *rows.shape[1:]), rows.dtype)
    out[: len(rows)] = rows
    return out


class QualityModel:
    """Context vectors, standardisation, network and temperature."""

    def __init__(self, context: dict[str, np.ndarray], layers: list[np.ndarray], centre: np.ndarray, spread: np.ndarray, temperature: float = 1.0, fitted: bool = True):
        self.context, self.layers, self.centre, self.spread, self.temperature, self.fitted = context, layers, centre, spread, temperature, fitted
        self._fresh()

    def _fresh(self) -> None:
        """Number the tokens of the context; those that a stretch of texts has besides follow them."""
        self._names = list(self.context)
        self._at = dict(zip(self._names, range(len(self._names)), strict=True))
        self._vectors = index_vectors(self._names)
        if self._names:
            self._vectors += np.stack(list(self.context.values()))

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if not k.startswith("_")}

    def __setstate__(self, state: dict) -> None:
        self.__dict__.update(state)
        self._fresh()

    def _numbers(self, found: list[str]) -> np.ndarray:
        """The numbers of tokens, whose vectors are made."""
        n, others = len(self._at), _Rows()
        out = np.fromiter(map(self._at.get, found, repeat(-1)), np.int32, len(found))
        at = np.flatnonzero(out < 0)
        out[at] = n + np.fromiter(map(others.__getitem__, map(found.__getitem__, at.tolist())), np.int32, len(at))
        self._vectors = _room(self._vectors, n + len(others))
        self._vectors[n : n + len(others)] = index_vectors(others.new)
        return out

    def pooled(self, texts: pa.Array) -> np.ndarray:
        """The pooled vectors of whole texts."""
        out = []
        for part in stretches(texts):
            found, many = numbered(part, self._names, self._numbers)
            out += map(self._pool, np.split(found, np.cumsum(many)[:-1]))
        return np.stack(out)

    def _pool(self, found: np.ndarray, step: int = 8192) -> np.ndarray:
        """The pooled vector of a text's tokens, summed in stretches."""
        total, square, product = (np.zeros(WIDTH) for _ in range(3))
        for at in range(0, len(found), step):
            v = self._vectors[found[at : at + step + 1]]
            here = v[:step]
            total += here.sum(axis=0)
            square += np.einsum("ij,ij->j", here, here)
            if len(v) > 1:
                product += np.einsum("ij,ij->j", v[:-1], v[1:])
        n = len(found) + SHRINK
        return np.concatenate([total / n, np.sqrt(square / n), product / n, [np.log1p(len(found))]])

    def logits(self, pooled: np.ndarray) -> np.ndarray:
        """The network's logits for rows of pooled vectors, before the temperature."""
        first, bias, second, shift = self.layers
        return np.tanh((pooled - self.centre) / self.spread @ first + bias) @ second + shift

    def score(self, texts: list[str] | pa.Array) -> np.ndarray:
        """The calibrated probability of label 1 for each text."""
        if not len(texts):
            return np.zeros(0)
        texts = texts if isinstance(texts, pa.Array) else pa.array(texts, pa.string())
        z = self.logits(self.pooled(texts)) / self.temperature
        return 1 / (1 + np.exp(-np.clip(z, -60, 60)))


class Contexts:
    """Sums of the neighbours' index vectors of each token of a vocabulary."""

    def __init__(self, names: list[str]):
        self.names, n = names, len(names)
        self.at = dict(zip(names, range(n), strict=True))
        index = np.concatenate([index_vectors(names), np.zeros((1, WIDTH), np.float32)]).astype(np.int8)
        self.rolled = {d: np.roll(index, d, axis=1) for d in range(-REACH, REACH + 1) if d}
        self.sums = np.zeros((n, WIDTH), np.int64)

    def add(self, texts: pa.Array, step: int = 1 << 15) -> None:
        """Gather from whole texts; none is a neighbour of another."""
        n = len(self.names)
        found, many = numbered(texts, self.names, lambda others: np.fromiter(map(self.at.get, others, repeat(n)), np.int32, len(others)))
        rows = np.full(len(found) + 2 * REACH * len(texts), n, np.min_scalar_type(n))
        rows[np.arange(len(found)) + np.repeat(np.arange(len(texts)) * 2 * REACH + REACH, many)] = found
        for at in range(REACH, len(rows) - REACH, step):
            here = rows[at : min(at + step, len(rows) - REACH)]
            near = sum(vectors[rows[at + d : at + d + len(here)]] for d, vectors in self.rolled.items())
            order = np.argsort(here, kind="stable")
            of = here[order]
            first = np.flatnonzero(np.concatenate([[True], of[1:] != of[:-1]]))
            sums = np.add.reduceat(near[order], first, axis=0, dtype=np.int64)
            known = of[first] < n
            self.sums[of[first][known]] += sums[known]

    def vectors(self) -> dict[str, np.ndarray]:
        """The normed sums by token."""
        norm = np.linalg.norm(self.sums, axis=1, keepdims=True)
        return dict(zip(self.names, (self.sums / np.where(norm > 0, norm, 1) * np.sqrt(NONZERO)).astype(np.float32), strict=True))


def vocabulary(rows: DataFrame, most: int = VOCABULARY) -> list[str]:
    """The most frequent tokens of ``text``, at most ``most``, those of equal rank all or none."""

    def run(batches):
        counts: Counter = Counter()
        for part in (p for batch in batches for p in stretches(batch.column(0), COUNTED)):
            count(part, counts)
            if len(counts) > KEPT:
                yield _counted(counts)
                counts.clear()
        yield _counted(counts)

    found = rows.mapInArrow(run, "token string, n long").groupBy("token").agg(F.sum("n").alias("n")).where(F.col("n") >= LEAST)
    found = staged(found.withColumn("rank", (F.log2("n") * 64).cast("int")), "tokens")
    left, least = most, None
    for r in found.groupBy("rank").agg(F.count(F.lit(1)).alias("many")).orderBy(F.desc("rank")).collect():  # at most 64 ranks a doubling
        left -= r["many"]
        if left < 0:
            break
        least = r["rank"]
    return [] if least is None else sorted(r["token"] for r in found.where(F.col("rank") >= least).select("token").collect())


def count(texts: pa.Array, counts: Counter) -> None:
    """Add the tokens of whole texts to ``counts``, each distinct piece between spaces cut once."""
    pieces, n = pc.value_counts(pc.split_pattern(texts, " ").flatten()).flatten()
    for piece, n in zip(pieces.to_numpy(zero_copy_only=False).tolist(), n.to_numpy().tolist(), strict=True):
        if piece.isalnum():
            counts[piece] += n
        else:
            for t in tokens(piece):
                counts[t] += n


def _counted(counts: Counter) -> pa.RecordBatch:
    kept = [(t, n) for t, n in counts.items() if len(t) <= LONGEST]
    return pa.RecordBatch.from_arrays([pa.array([t for t, _ in kept], pa.string()), pa.array([n for _, n in kept], pa.int64())], ["token", "n"])


def corpus_contexts(docs: DataFrame, text_col: str = "text") -> dict[str, np.ndarray]:
    """Context vectors gathered from every whole text."""
    rows = docs.select(F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    names = vocabulary(rows)
    if not names:
        return {}
    sent = docs.sparkSession.sparkContext.broadcast(names)  # at most VOCABULARY tokens of LONGEST characters
    columns = [f"c{i}" for i in range(WIDTH)]

    def run(batches):
        found = Contexts(sent.value)
        for part in (p for batch in batches for p in stretches(batch.column(0))):
            found.add(part)
        used = np.flatnonzero(found.sums.any(axis=1))
        yield pa.RecordBatch.from_arrays([pa.array(used), *(pa.array(found.sums[used, i]) for i in range(WIDTH))], ["token", *columns])

    sums = rows.mapInArrow(run, "token long, " + ", ".join(f"{c} long" for c in columns))
    out = Contexts(names)
    for r in sums.groupBy("token").agg(*[F.sum(c).alias(c) for c in columns]).collect():
        out.sums[r[0]] = r[1:]
    return out.vectors()


def context_vectors(texts: list[str]) -> dict[str, np.ndarray]:
    """Context vectors of a few texts."""
    counts = Counter(t for text in texts for t in tokens(text))
    out = Contexts(sorted(t for t, n in counts.most_common(VOCABULARY) if n >= LEAST and len(t) <= LONGEST))
    for at in range(0, len(texts), SLICE):
        out.add(pa.array(texts[at : at + SLICE], pa.string()))
    return out.vectors()


def _descend(x: np.ndarray, y: np.ndarray, hidden: int, epochs: int, rate: float, decay: float, rng: np.random.Generator) -> list[np.ndarray]:
    """Adam on the log loss of a two-layer network."""
    layers = [rng.normal(0, x.shape[1] ** -0.5, (x.shape[1], hidden)), np.zeros(hidden), rng.normal(0, hidden**-0.5, hidden), np.zeros(())]
    moments, step = [[np.zeros_like(p), np.zeros_like(p)] for p in layers], 0
    for _ in range(epochs):
        order = rng.permutation(len(x))
        for part in np.array_split(order, max(1, len(x) // 128)):
            h = np.tanh(x[part] @ layers[0] + layers[1])
            slope = (1 / (1 + np.exp(-np.clip(h @ layers[2] + layers[3], -60, 60))) - y[part]) / len(part)
            back = np.outer(slope, layers[2]) * (1 - h * h)
            grads = [x[part].T @ back + decay * layers[0], back.sum(axis=0), h.T @ slope + decay * layers[2], slope.sum()]
            step += 1
            for i, (g, (m, v)) in enumerate(zip(grads, moments, strict=True)):
                m += 0.1 * (g - m)
                v += 0.001 * (g * g - v)
                layers[i] = layers[i] - rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return layers


def train(rows: list[tuple[str, int]], context: dict[str, np.ndarray] | None = None, hidden: int = 32, epochs: int = 30, seed: int = 11) -> QualityModel:
    """The model of labelled texts and of the corpus's context vectors, by default those of the
    texts; a fifth of the texts calibrates the temperature."""
    size = 3 * WIDTH + 1
    ones = sum(y for _, y in rows)
    if not 0 < ones < len(rows):
        share = (ones + 1) / (len(rows) + 2)
        layers = [np.zeros((size, 1)), np.zeros(1), np.zeros(1), np.array(np.log(share / (1 - share)))]
        return QualityModel({}, layers, np.zeros(size), np.ones(size), fitted=False)
    rng = np.random.default_rng(seed)
    texts, y = [t for t, _ in rows], np.array([v for _, v in rows], float)
    model = QualityModel(context_vectors(texts) if context is None else context, [], np.zeros(size), np.ones(size))
    x = np.concatenate([model.pooled(pa.array(texts[at : at + SLICE], pa.string())) for at in range(0, len(texts), SLICE)])
    order = rng.permutation(len(x))
    held, used = order[: len(x) // 5], order[len(x) // 5 :]
    model.centre, model.spread = x[used].mean(axis=0), x[used].std(axis=0) + 1e-3
    model.layers = _descend((x[used] - model.centre) / model.spread, y[used], hidden, epochs, 0.003, 1e-4, rng)
    if len(held):
        z, t = model.logits(x[held]), y[held]
        trials = np.exp(np.linspace(np.log(0.05), np.log(20), 121))
        n1, n0 = t.sum(), (1 - t).sum()
        t = np.where(t > 0, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))  # smoothed, so that a perfect split isn't certain
        losses = [float(np.mean(np.logaddexp(0, z / a) - t * z / a)) for a in trials]
        model.temperature = float(trials[int(np.argmin(losses))])
    return model


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", modulus: int = MODULUS, held_out: int = HELD_OUT, max_rows: int = MAX_ROWS, max_chars: int = MAX_CHARS, id_col: str = "doc_id", text_col: str = "text") -> QualityModel:
    """Gather contexts from all documents and train on at most ``max_rows`` whole labelled
    texts of ``max_chars`` characters in all."""
    rows = training_rows(docs, labels, label, modulus, held_out, max_rows, max_chars, id_col, text_col)
    return train(rows, corpus_contexts(docs, text_col) if len({y for _, y in rows}) == 2 else {})


def score(docs: DataFrame, model: QualityModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, held_out, score, predicted)`` of every whole text."""
    scored = with_score(docs.select(id_col, text_col), model, text_col, "__score")
    return scored.select(id_col, (remainder(F.col(id_col), MODULUS) == HELD_OUT).alias("held_out"), F.col("__score").alias("score"), (F.col("__score") >= 0.5).cast("int").alias("predicted"))


def with_score(docs: DataFrame, model, text_col: str, name: str) -> DataFrame:
    """All columns and the score under a name that none of them has."""
    sent = docs.sparkSession.sparkContext.broadcast(model)  # at most VOCABULARY vectors of WIDTH

    def run(batches):
        scored = sent.value
        for part in (p for batch in batches for p in slices(batch, SCORED)):
            values = pa.array(scored.score(pc.fill_null(part.column(at), "")), pa.float64())
            yield pa.RecordBatch.from_arrays([*part.columns, values], [*part.schema.names, name])

    at = docs.columns.index(text_col)
    return docs.mapInArrow(run, StructType([*docs.schema.fields, StructField(name, DoubleType())]))


def keep_good(docs: DataFrame, model: QualityModel, text_col: str = "text") -> DataFrame:
    """The documents with a score of at least one half, all columns kept; all, if no two classes were known."""
    if not model.fitted:
        return docs
    name = free_name(docs.columns)
    return with_score(docs, model, text_col, name).where(F.col(name) >= 0.5).drop(name)
