"""Arithmetic on probability vectors and logits held as arrays of doubles."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .keys import col


def bound(value, body) -> Column:
    """body(x), where x stands for the value: it is worked out once, however often the body names it. An expression that a
    lambda names is worked out again for each element otherwise."""
    return F.get(F.transform(F.array(col(value)), body), F.lit(0))


def total(v) -> Column:
    return F.aggregate(col(v), F.lit(0.0), lambda a, x: a + x)


def dot(a, b) -> Column:
    return total(F.zip_with(col(a), col(b), lambda x, y: x * y))


def softmax(z, temperature=1.0) -> Column:
    """Shifted by the greatest logit."""
    t = temperature if isinstance(temperature, Column) else F.lit(float(temperature))
    scaled = lambda e: bound(total(e), lambda mass: F.transform(e, lambda x: x / mass))
    return bound(z, lambda z: bound(F.array_max(z), lambda top: bound(F.transform(z, lambda x: F.exp((x - top) / t)), scaled)))


def log_softmax(z) -> Column:
    norm = lambda z, top: top + F.log(total(F.transform(z, lambda x: F.exp(x - top))))
    return bound(z, lambda z: bound(bound(F.array_max(z), lambda top: norm(z, top)), lambda n: F.transform(z, lambda x: x - n)))


def teacher_kl(z, teacher, temperature: float = 2.0) -> Column:
    """How far the logits' distribution is from the teacher's, both at a temperature, times its square."""
    own, wanted = (log_softmax(F.transform(col(x), lambda v: v / temperature)) for x in (z, teacher))
    return total(F.zip_with(own, wanted, lambda a, b: F.exp(b) * (b - a))) * temperature**2


def argmax(p) -> Column:
    """From 0; the first of equals."""
    return F.array_position(col(p), F.array_max(col(p))) - 1


def one_hot(gold, k: int) -> Column:
    return F.transform(F.sequence(F.lit(0), F.lit(k - 1)), lambda i: F.when(i == col(gold), 1.0).otherwise(0.0))


def smoothed(target, eps: float = 0.02) -> Column:
    return F.transform(col(target), lambda t: (1 - eps) * t + F.lit(eps) / F.size(col(target)))


def normalised(p) -> Column:
    """Negative entries become 0, the rest sum to 1; null where nothing is left."""
    clipped = F.transform(col(p), lambda x: F.greatest(x, F.lit(0.0)))
    return bound(clipped, lambda c: bound(total(c), lambda mass: F.when(mass > 0, F.transform(c, lambda x: x / mass))))


def nll(p, target) -> Column:
    return -total(F.zip_with(col(p), col(target), lambda x, t: t * F.log(F.least(F.greatest(x, F.lit(1e-12)), F.lit(1.0)))))


def brier(p, target) -> Column:
    return total(F.zip_with(col(p), col(target), lambda x, t: (x - t) * (x - t)))


def expected_level(p) -> Column:
    return total(F.transform(col(p), lambda x, i: x * i))


def entropy_confidence(p) -> Column:
    """1 - entropy / ln k."""
    h = -total(F.transform(col(p), lambda x: F.when(x > 0, x * F.log(x)).otherwise(0.0)))
    return 1 - h / F.log(F.size(col(p)).cast("double"))


def ranked_probability_score(p, target) -> Column:
    """Mean squared gap of the cumulative sums over the k - 1 inner cuts."""
    gap = F.zip_with(col(p), col(target), lambda x, t: x - t)
    run = F.aggregate(gap, F.struct(F.lit(0.0).alias("c"), F.lit(0.0).alias("s")), lambda a, x: F.struct((a["c"] + x).alias("c"), (a["s"] + (a["c"] + x) * (a["c"] + x)).alias("s")))
    last = total(gap)
    return (run["s"] - last * last) / (F.size(col(p)) - 1)


def kl(teacher, student, temperature: float = 2.0) -> Column:
    """Forward divergence of softened logits, times the squared temperature."""
    soft = lambda z: log_softmax(F.transform(col(z), lambda x: x / temperature))
    return F.lit(temperature**2) * total(F.zip_with(soft(teacher), soft(student), lambda a, b: F.exp(a) * (a - b)))
