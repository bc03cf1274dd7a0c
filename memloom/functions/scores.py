"""Column functions for scores of memories."""

from __future__ import annotations

from math import exp, log

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..config import Decay


def squared_distance(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double"))), F.lit(0.0), lambda s, x: s + x)


def relevance(distance: Column, confidence: Column | None = None) -> Column:
    """Confidence where there is one, else what a squared distance of unit vectors leaves of 1."""
    r = 1 - distance / 4
    return r if confidence is None else F.coalesce(confidence, r)


def match_probability(distance: Column, factor: float = 0.75) -> Column:
    """exp(-(factor * d)^2) of the plain distance d, from the squared one."""
    return F.exp(-F.pow(F.lit(factor) * F.sqrt(distance), 2))


def recency(age: Column, half_life: float, decay: Decay = Decay.EXPONENTIAL) -> Column:
    age = F.greatest(age, F.lit(0.0))
    if decay is Decay.EXPONENTIAL:
        return F.exp(-age * F.lit(log(2) / half_life))
    return F.lit(half_life) / (F.lit(half_life) + age)


def memory_score(recent: Column, important: Column | None, relevant: Column, weights: tuple[float, float, float] = (1.0, 1.0, 1.0), multiplicative: bool = False) -> Column:
    """Weighted sum of recency, importance and relevance, or of their logarithms. Null importance is 0; negative factors fail."""
    parts = [(recent, weights[0]), (relevant, weights[2])] + ([(F.coalesce(important, F.lit(0.0)), weights[1])] if important is not None else [])
    if multiplicative:
        parts = [(F.when(x < 0, F.raise_error(F.lit("a factor of the score is negative")).cast("double")).otherwise(F.log(x + F.lit(1e-20))), w) for x, w in parts]
    out = F.lit(0.0)
    for x, w in parts:
        out = out + x * F.lit(w)
    return out


def importance_from_rating(answer: Column) -> Column:
    """A rating of 1 to 10 as 0 to 1; what is no number is 0."""
    return F.coalesce(F.least(F.greatest((F.try_to_number(F.trim(answer), F.lit("99999")).cast("double") - 1) / 9, F.lit(0.0)), F.lit(1.0)), F.lit(0.0))


def least_mean_square(a: Column, b: Column) -> Column:
    """Least mean squared difference between any of the vectors a and any of b; null where either has none."""
    pair = lambda x, y: squared_distance(x, y) / F.size(x)
    return F.array_min(F.transform(a, lambda x: F.array_min(F.transform(b, lambda y: pair(x, y)))))


def contrast_probability(mean_square: Column, scale: float = 1.0, factor: float = 1.0, prior_logit: float = 0.0, weight_logit: float = -5.0) -> Column:
    """exp(-d factor^2) of the scaled mean square d, blended with a prior."""
    prior, weight = (1 / (1 + exp(-x)) for x in (prior_logit, weight_logit))
    return F.lit(prior * weight) + F.exp(-mean_square * F.lit(scale * scale * factor * factor)) * F.lit(1 - weight)


def normalized(v: Column) -> Column:
    """v at unit length; a zero vector stays."""
    size = F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    return F.transform(v, lambda x: x.cast("double") / F.greatest(size, F.lit(1e-12)))


def softmax(v: Column) -> Column:
    high = F.array_max(v)
    e = F.transform(v, lambda x: F.exp(x - high))
    return F.transform(e, lambda x: x / F.aggregate(e, F.lit(0.0), lambda s, y: s + y))
