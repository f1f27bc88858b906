"""Losses as row expressions; a mean over rows gives the batch loss.

``logits`` is a vector column, ``label`` the true class.
"""

from pyspark.sql import Column
from pyspark.sql import functions as F

from tessel.functions.vectors import sigmoid, softplus


def log_softmax(logits: Column) -> Column:
    """Log probabilities."""
    top = F.array_max(logits)
    total = F.aggregate(logits, F.lit(0.0), lambda a, v: a + F.exp(v - top))
    return F.transform(logits, lambda v: v - top - F.log(total))


def _at(values: Column, label: Column) -> Column:
    return F.element_at(values, label + 1)


def cross_entropy(logits: Column, label: Column, smoothing: float = 0.0) -> Column:
    """Cross entropy, with label smoothing."""
    logp = log_softmax(logits)
    mean = F.aggregate(logp, F.lit(0.0), lambda a, v: a + v) / F.size(logp)
    return -(1 - smoothing) * _at(logp, label) - smoothing * mean


def focal(logits: Column, label: Column, gamma: float = 2.0) -> Column:
    """(1 - p) ** gamma times the cross entropy."""
    logp = _at(log_softmax(logits), label)
    return -F.pow(1 - F.exp(logp), F.lit(gamma)) * logp


def shifted(logits: Column, by: list[float]) -> Column:
    """Logits plus a constant for each class."""
    return F.zip_with(logits, F.lit([float(v) for v in by]), lambda a, b: a + b)


def balanced_softmax(logits: Column, label: Column, counts: list[int]) -> Column:
    """Cross entropy on logits plus the log class counts."""
    import math

    return cross_entropy(shifted(logits, [math.log(c) for c in counts]), label)


def logit_adjusted(logits: Column, label: Column, counts: list[int], tau: float = 1.0) -> Column:
    """Cross entropy on logits plus tau times the log class shares."""
    import math

    return cross_entropy(shifted(logits, [tau * math.log(c / sum(counts)) for c in counts]), label)


def ldam(logits: Column, label: Column, counts: list[int], margin: float = 0.5) -> Column:
    """Cross entropy after a margin, larger for rarer classes, is taken off the true logit."""
    raw = [c**-0.25 for c in counts]
    margins = F.lit([m * margin / max(raw) for m in raw])
    off = F.transform(logits, lambda v, i: F.when(i == label, v - F.element_at(margins, label + 1)).otherwise(v))
    return cross_entropy(off, label)


def binary_cross_entropy(logit: Column, label: Column, weight: float = 1.0) -> Column:
    """Log loss of a logit, positives weighted."""
    return softplus(logit) - label * logit + (weight - 1) * label * softplus(-logit)


def focal_binary(logit: Column, label: Column, gamma: float = 2.0, weight: float = 1.0) -> Column:
    """Focal log loss of a logit."""
    p = sigmoid(logit)
    truth = F.when(label == 1, p).otherwise(1 - p)
    return F.pow(1 - truth, F.lit(gamma)) * binary_cross_entropy(logit, label, weight)


def bootstrap(logits: Column, label: Column, beta: float = 0.95, hard: bool = False) -> Column:
    """Cross entropy to a mix of the label and the model's own belief."""
    logp = log_softmax(logits)
    if hard:
        own = -F.array_max(logp)
    else:
        own = -F.aggregate(logp, F.lit(0.0), lambda a, v: a + F.exp(v) * v)
    return -beta * _at(logp, label) + (1 - beta) * own


def entropy(logits: Column) -> Column:
    """The entropy of the predicted distribution."""
    return -F.aggregate(log_softmax(logits), F.lit(0.0), lambda a, v: a + F.exp(v) * v)


def confidence_penalty(logits: Column, label: Column, coefficient: float) -> Column:
    """Cross entropy less a multiple of the entropy."""
    return cross_entropy(logits, label) - coefficient * entropy(logits)


def flooding(loss: Column, level: float) -> Column:
    """|loss - level| + level, of a batch loss."""
    return F.abs(loss - level) + level


def generalized_cross_entropy(logits: Column, label: Column, q: float = 0.7) -> Column:
    """(1 - p ** q) / q."""
    return (1 - F.exp(q * _at(log_softmax(logits), label))) / q


def poly1(logits: Column, label: Column, epsilon: float = 1.0) -> Column:
    """Cross entropy plus epsilon times (1 - p)."""
    logp = _at(log_softmax(logits), label)
    return -logp + epsilon * (1 - F.exp(logp))


def symmetric_cross_entropy(logits: Column, label: Column, alpha: float = 1.0, beta: float = 1.0, clip: float = 1e-4) -> Column:
    """Cross entropy and its reverse, the label's zeros clipped."""
    import math

    p = F.exp(_at(log_softmax(logits), label))
    return alpha * cross_entropy(logits, label) - beta * math.log(clip) * (1 - p)


def rdrop(first: Column, second: Column, label: Column, alpha: float = 1.0) -> Column:
    """Mean cross entropy of two predictions plus alpha times their mean divergence."""
    a, b = log_softmax(first), log_softmax(second)
    ab = F.aggregate(F.zip_with(a, b, lambda p, q: F.exp(p) * (p - q)), F.lit(0.0), lambda s, v: s + v)
    ba = F.aggregate(F.zip_with(b, a, lambda p, q: F.exp(p) * (p - q)), F.lit(0.0), lambda s, v: s + v)
    return (cross_entropy(first, label) + cross_entropy(second, label)) / 2 + alpha * (ab + ba) / 2
