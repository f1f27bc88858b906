"""Toxicity by subword-bag embeddings and a linear softmax.

A word is the bag of its character n-grams (with marks at both ends) and itself, hashed to
buckets; a window of words is the average of the buckets' embeddings, and a linear softmax turns
it into two probabilities.  Embeddings and softmax are trained together in numpy, so a word that
was never seen, a misspelling or an inflected form, shares the vectors of its n-grams.  A
document's score is that of its worst window, one starting at every word: a few words count the
same in a short text as in a very long one, and wherever they stand.  Training follows suit: a
document is represented by its two worst windows that don't overlap, clean ones also by a draw of
their others.  The first pass takes toxic documents' windows with the highest log odds of words
between the classes' documents, and a draw of the clean ones; later passes those that the model
finds worst.

The model is linear in the buckets, so scoring needs one number for each bucket; this vector
(2**19 floats by default) is all that is sent to executors, and every whole text is scored in
one narrow stage.  The fit uses a bounded sample of labelled rows (``max_rows`` and
``max_chars`` below).

Null and empty texts have no window and get the score of a window without any subword.  Without
labelled rows of both classes that have words, the score is the smoothed share of label 1 for
every document, and ``drop_toxic`` keeps all.
Repeated rows are scored alike; other columns are ignored or, in ``drop_toxic``, kept.
"""

import re
from array import array
from collections.abc import Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from tessel.llm.common import free_name, remainder, slices, training_rows

BUCKETS, WIDTH, WINDOW = 1 << 19, 4, 6
MODULUS, HELD_OUT = 5, 0
#: Labelled rows of a fit at most, and characters of all their texts.
MAX_ROWS, MAX_CHARS = 4000, 40_000_000
REMEMBERED = 400_000
#: Words of a fit whose subwords are made at a time, which bounds what the driver holds.
WORDS_AT_ONCE = 10_000
_WORDS = re.compile(r"[^\W_]+").findall


def words(text: str) -> list[str]:
    """Lower-cased runs of letters and digits."""
    return _WORDS(text.lower())


def subwords(found: list[str], buckets: int = BUCKETS) -> tuple[np.ndarray, np.ndarray]:
    """The buckets of words, one word after the other, and how many each has.

    A word, between marks, has its n-grams of 3 to 6 characters and itself, all hashed by the
    same polynomial.
    """
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    signs = np.frombuffer("".join([f"<{w}>" for w in found]).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    size = np.array([len(w) + 2 for w in found])
    start = np.cumsum(size) - size
    of = np.repeat(np.arange(len(found)), size)
    left = (start + size)[of] - np.arange(len(signs))  # signs from here to the end of the word
    place = np.arange(len(signs)) - start[of]
    prime = np.uint64(0x9E3779B97F4A7C15)
    powers = np.multiply.accumulate(np.full(max(6, int(size.max())), prime))
    hashes, words_of = [np.add.reduceat(signs * powers[place], start)], [np.arange(len(found))]
    gram = signs * powers[0]
    for n in range(2, 7):
        gram = gram[: len(signs) - n + 1] + signs[n - 1 :] * powers[n - 1] if len(signs) >= n else gram[:0]
        if n > 2:
            whole = np.flatnonzero(left[: len(gram)] >= n)
            hashes.append(gram[whole])
            words_of.append(of[whole])
    h, word = np.concatenate(hashes), np.concatenate(words_of)
    h = (h ^ h >> np.uint64(29)) * np.uint64(0xBF58476D1CE4E5B9)
    order = np.argsort(word, kind="stable")
    ids = ((h >> np.uint64(32)) % np.uint64(buckets)).astype(np.int64)
    return ids[order], np.bincount(word, minlength=len(found))


def window_starts(n: int, window: int = WINDOW) -> np.ndarray:
    """Starts of all whole windows in n words, one at every word; fewer words are one window."""
    return np.arange(min(n, 1) if n <= window else n - window + 1)


class _Rows(dict):
    """Row numbers of words, dealt on first sight; ``new`` are those without a row yet."""

    def __init__(self):
        super().__init__()
        self.new: list[str] = []

    def __missing__(self, word: str) -> int:
        self[word] = at = len(self)
        self.new.append(word)
        return at


class SubwordModel:
    """``weights[b]``: what bucket b adds to the logit difference of a window's average."""

    def __init__(self, weights: np.ndarray, bias: float, scale: float = 1.0, fitted: bool = True):
        self.weights, self.bias, self.scale, self.fitted = weights.astype(np.float32), bias, scale, fitted
        self._fresh()

    def _fresh(self) -> None:
        self._rows = _Rows()
        #: For each word, its sum of weights and its number of subwords.
        self._sums, self._made = np.zeros((4096, 2)), 0

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if not k.startswith("_")}

    def __setstate__(self, state: dict) -> None:
        self.__dict__.update(state)
        self._fresh()

    def _of(self, found: list[str]) -> np.ndarray:
        if len(self._rows) > REMEMBERED:
            self._fresh()
        at = np.fromiter(map(self._rows.__getitem__, found), np.int32, len(found))
        if new := self._rows.new:
            while len(self._sums) < self._made + len(new):
                self._sums = np.concatenate([self._sums, np.zeros_like(self._sums)])
            ids, size = subwords(new, len(self.weights))
            word = np.repeat(np.arange(len(new)), size)
            self._sums[self._made : self._made + len(new)] = np.stack([np.bincount(word, self.weights[ids], len(new)), size], axis=1)
            self._made += len(new)
            self._rows.new = []
        return self._sums[at]

    def logit(self, text: str) -> float:
        """The logit difference of the worst window."""
        found = words(text)
        if not found:
            return self.bias * self.scale
        of = self._of(found)
        sums, wide = np.concatenate([[[0, 0]], np.cumsum(of, axis=0)]), min(WINDOW, len(of))
        value, size = (sums[wide:] - sums[:-wide]).T
        return float((value / size + self.bias).max()) * self.scale

    def score(self, text: str) -> float:
        """The probability of label 1."""
        return float(1 / (1 + np.exp(-np.clip(self.logit(text), -60, 60))))


class _Trainer:
    """Full-batch descent on the embeddings and the softmax, over windows of word numbers.

    Each matrix steps along its smoothed gradient, scaled as a whole to a largest entry of the
    rate: a bucket moves by its share of the evidence, so n-grams that many words share lead
    and those of a single word hardly move.
    """

    def __init__(self, vocabulary: list[str], counts: np.ndarray, buckets: int, width: int, seed: int, least: int = 3):
        flat, sizes, times = [], [], np.zeros(buckets)
        for at in range(0, len(vocabulary), WORDS_AT_ONCE):
            ids, size = subwords(vocabulary[at : at + WORDS_AT_ONCE], buckets)
            times += np.bincount(ids, np.repeat(counts[at : at + len(size)], size), buckets)  # whole numbers
            flat.append(ids.astype(np.int32))
            sizes.append(size)
        flat, sizes = np.concatenate(flat), np.concatenate(sizes)
        self.size = sizes.astype(np.float64)
        word = np.repeat(np.arange(len(sizes), dtype=np.int32), sizes)
        seen = times >= least  # a rarer bucket stays at zero
        self.used, self.all = np.flatnonzero(seen), buckets
        kept = seen[flat]
        self.flat, self.word = (np.cumsum(seen) - 1).astype(np.int32)[flat[kept]], word[kept]
        self.cuts = np.searchsorted(self.word, [*range(0, len(sizes), WORDS_AT_ONCE), len(sizes)])
        rng = np.random.default_rng(seed)
        self.buckets = len(self.used)
        self.params = [rng.normal(0, 0.01, (self.buckets, width)).astype(np.float32), rng.normal(0, 0.5, (width, 2)), np.zeros(2)]
        self.moments = [np.zeros_like(p) for p in self.params]

    def weights(self) -> tuple[np.ndarray, float]:
        embed, soft, bias = self.params
        return embed @ (soft[:, 1] - soft[:, 0]), float(bias[1] - bias[0])

    def per_word(self, per_bucket: np.ndarray) -> np.ndarray:
        """Each word's sum over its buckets, made for some words at a time."""
        return np.concatenate([np.bincount(self.word[a:b] - i, per_bucket[self.flat[a:b]], min(WORDS_AT_ONCE, len(self.size) - i)) for i, (a, b) in zip(range(0, len(self.size), WORDS_AT_ONCE), pairwise(self.cuts), strict=True)])

    def model(self) -> SubwordModel:
        weights, bias = self.weights()
        out = np.zeros(self.all)
        out[self.used] = weights
        return SubwordModel(out, bias)

    def logits(self, tokens: np.ndarray, begin: np.ndarray, window: int = WINDOW) -> Iterator[np.ndarray]:
        """For each document in turn, the logits of its windows; no more than one's are held."""
        per_bucket, bias = self.weights()
        per_word = self.per_word(per_bucket)
        for a, b in pairwise(begin):
            of, wide = tokens[a:b], min(window, b - a)
            value, size = np.concatenate([[0], np.cumsum(per_word[of])]), np.concatenate([[0], np.cumsum(self.size[of])])
            yield (value[wide:] - value[:-wide]) / (size[wide:] - size[:-wide]) + bias

    def fit(self, tokens: np.ndarray, starts: np.ndarray, lengths: np.ndarray, labels: np.ndarray, weight: np.ndarray, steps: int, rate: float, decay: float = 1e-7) -> None:
        at = np.repeat(starts, lengths) + np.arange(lengths.sum()) - np.repeat(np.cumsum(lengths) - lengths, lengths)
        of, used = np.repeat(np.arange(len(starts)), lengths), tokens[at]
        bag = np.bincount(of, self.size[used], len(starts))
        share = weight / weight.sum()
        for _ in range(steps):
            embed, soft, bias = self.params
            per_bucket, offset = self.weights()
            per_word = self.per_word(per_bucket)
            logit = np.bincount(of, per_word[used], len(starts)) / bag + offset
            slope = share * (1 / (1 + np.exp(-np.clip(logit, -60, 60))) - labels)
            pull = np.bincount(used, (slope / bag)[of], len(self.size))
            pull = np.bincount(self.flat, pull[self.word], self.buckets)
            along = embed.T @ pull
            grads = [np.outer(pull, soft[:, 1] - soft[:, 0]).astype(np.float32) + np.float32(decay) * embed, np.stack([-along, along], 1), np.array([-slope.sum(), slope.sum()])]
            for p, g, m, r in zip(self.params, grads, self.moments, (rate, rate / 20, rate / 20), strict=True):
                m *= 0.8
                m += 0.2 * g
                p -= p.dtype.type(r / (max(float(m.max()), -float(m.min())) + 1e-12)) * m


def odds_of_windows(tokens: np.ndarray, begin: np.ndarray, toxic: np.ndarray) -> Iterator[np.ndarray]:
    """For each document in turn, its windows' mean log odds of words by the documents of either class
    that have them: where a long toxic text is to be looked at first."""
    have = np.zeros((2, int(tokens.max()) + 1))
    for y, (a, b) in zip(toxic, pairwise(begin), strict=True):
        have[int(y), np.unique(tokens[a:b])] += 1
    share = (have + 0.5) / (np.array([[(~toxic).sum()], [toxic.sum()]]) + 1)
    odds = np.log(share[1]) - np.log(share[0])
    for a, b in pairwise(begin):
        sums, wide = np.concatenate([[0], np.cumsum(odds[tokens[a:b]])]), min(WINDOW, b - a)
        yield (sums[wide:] - sums[:-wide]) / wide


def train(rows: list[tuple[str, int]], buckets: int = BUCKETS, width: int = WIDTH, seed: int = 7, steps: tuple[int, int, int] = (60, 40, 3), max_windows: int = 40_000) -> SubwordModel:
    """The model of labelled texts.

    ``steps``: of the first pass, of each later pass, and the number of later passes.
    """
    vocabulary: dict[str, int] = {}
    numbers, docs = array("i"), []  # words as numbers at once: lists of words would be the largest thing here
    for text, y in rows:
        if found := words(text):
            numbers.extend(vocabulary.setdefault(w, len(vocabulary)) for w in found)
            docs.append((len(found), y))
    if len({y for _, y in docs}) < 2:
        share = (sum(y for _, y in rows) + 1) / (len(rows) + 2)
        return SubwordModel(np.zeros(buckets), float(np.log(share / (1 - share))), fitted=False)
    tokens = np.frombuffer(numbers, np.int32)
    begin = np.cumsum([0, *(n for n, _ in docs)])
    many = np.array([len(window_starts(n)) for n, _ in docs])
    toxic = np.array([y for _, y in docs], bool)
    rng = np.random.default_rng(seed)
    trainer = _Trainer(list(vocabulary), np.bincount(tokens), buckets, width, seed)

    def run(doc: np.ndarray, at: np.ndarray, n: int, rate: float) -> None:
        starts = begin[doc] + at
        y = toxic[doc].astype(float)
        weight = np.where(y > 0, 0.5 / max(y.sum(), 1), 0.5 / max((1 - y).sum(), 1))
        trainer.fit(tokens, starts, np.minimum(WINDOW, begin[doc + 1] - starts), y, weight, n, rate)

    def draw(which: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
        """Documents and places of windows drawn from all of some documents, which are never listed."""
        ends = np.cumsum(many[which])
        n = int(ends[-1])
        at = np.arange(n) if n <= most else rng.choice(n, most, replace=False)
        of = np.searchsorted(ends, at, side="right")
        return which[of], at - (ends - many[which])[of]

    def joined(*parts: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        return np.concatenate([d for d, _ in parts]), np.concatenate([a for _, a in parts])

    def worst(logits: Iterator[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """Each document's two worst windows that don't overlap."""
        doc, at = array("i"), array("i")
        for i, logit in enumerate(logits):
            best = int(logit.argmax())
            logit[max(0, best - WINDOW + 1) : best + WINDOW] = -np.inf
            second = int(logit.argmax())
            for k in (best, second) if np.isfinite(logit[second]) else (best,):
                doc.append(i)
                at.append(k)
        return np.array(doc), np.array(at)

    clean = np.flatnonzero(~toxic)
    doc, at = worst(odds_of_windows(tokens, begin, toxic))
    run(*joined((doc[toxic[doc]], at[toxic[doc]]), draw(clean, max_windows // 2)), steps[0], 0.5)
    for _ in range(steps[2]):
        run(*joined(worst(trainer.logits(tokens, begin)), draw(clean, max_windows // 3)), steps[1], 0.5)
    model = trainer.model()
    top = np.array([logit.max() for logit in trainer.logits(tokens, begin)])
    return _calibrated(model, top, toxic)


def _calibrated(model: SubwordModel, top: np.ndarray, toxic: np.ndarray) -> SubwordModel:
    """Shift the bias to the cut between the classes' worst windows that errs least, halfway in its gap."""
    order = np.argsort(top)
    y = toxic[order]
    cost = np.concatenate([[0], np.cumsum(y)]) / max(y.sum(), 1) + (~y).sum() / max((~y).sum(), 1) - np.concatenate([[0], np.cumsum(~y)]) / max((~y).sum(), 1)
    best = np.flatnonzero(cost <= cost.min() + 1e-12)
    values = top[order]
    cuts = [(values[min(i, len(values) - 1)] + values[max(i - 1, 0)]) / 2 for i in best]
    gaps = [values[min(i, len(values) - 1)] - values[max(i - 1, 0)] for i in best]
    model.bias -= float(cuts[int(np.argmax(gaps))])
    return model


def fit(docs: DataFrame, labels: DataFrame, label: str = "toxic", modulus: int = MODULUS, held_out: int = HELD_OUT, max_rows: int = MAX_ROWS, max_chars: int = MAX_CHARS, id_col: str = "doc_id", text_col: str = "text") -> SubwordModel:
    """Train on at most ``max_rows`` whole labelled texts of ``max_chars`` characters in all."""
    return train(training_rows(docs, labels, label, modulus, held_out, max_rows, max_chars, id_col, text_col))


def score(docs: DataFrame, model: SubwordModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, held_out, score, predicted)`` of every whole text."""
    scored = with_score(docs.select(id_col, text_col), model, text_col, "__score")
    return scored.select(id_col, (remainder(F.col(id_col), MODULUS) == HELD_OUT).alias("held_out"), F.col("__score").alias("score"), (F.col("__score") >= 0.5).cast("int").alias("predicted"))


def with_score(docs: DataFrame, model, text_col: str, name: str) -> DataFrame:
    """All columns and the score under a name that none of them has."""
    sent = docs.sparkSession.sparkContext.broadcast(model)  # one number for each bucket

    def run(batches):
        scored = sent.value
        for part in (p for batch in batches for p in slices(batch)):
            values = pa.array([scored.score(t or "") for t in part.column(at).to_pylist()], pa.float64())
            yield pa.RecordBatch.from_arrays([*part.columns, values], [*part.schema.names, name])

    at = docs.columns.index(text_col)
    return docs.mapInArrow(run, StructType([*docs.schema.fields, StructField(name, DoubleType())]))


def drop_toxic(docs: DataFrame, model: SubwordModel, text_col: str = "text") -> DataFrame:
    """The documents with a score under one half, all columns kept; all, if no two classes were known."""
    if not model.fitted:
        return docs
    name = free_name(docs.columns)
    return with_score(docs, model, text_col, name).where(F.col(name) < 0.5).drop(name)
