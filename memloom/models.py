"""Hooks for models: what the plans call instead of a fixed embedder, matcher or text generator.

A hook maps a DataFrame to the same rows with one more column, so a model runs where the rows are: as a
column expression, a pandas UDF or mapInArrow. Factories are found by name, and made once.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .functions import scores as S
from .operators import vectors

Rows = Callable[[DataFrame], DataFrame]


@dataclass(frozen=True)
class Embedder:
    """encode_corpus and encode_queries add `embedding` to rows with `tokens` and `text`; slots are vectors a text."""

    name: str
    dim: int
    encode_corpus: Rows
    encode_queries: Rows
    corpus_slots: int = 1
    query_slots: int = 1

    def info(self) -> str:
        """What a stored memory must agree with."""
        return f"{self.name}:{self.dim}:{self.corpus_slots}"


@dataclass(frozen=True)
class TextModel:
    """generate(prompt) is a column; prompt and cost are what callbacks would be told of a call."""

    generate: Callable[[Column], Column]
    cost_per_token: float = 0.0


def hashed_embedder(dim: int = 256) -> Embedder:
    def encode(rows: DataFrame) -> DataFrame:
        return vectors.embed(rows, dim=dim)

    return Embedder("hashed", dim, encode, encode)


_factories: dict[str, Callable[..., object]] = {"hashed": hashed_embedder}
_made: dict[tuple, object] = {}


def register(name: str, make: Callable[..., object]) -> None:
    """A factory for names that begin with `name` and a colon, or equal it."""
    _factories[name] = make


def create(name: str) -> object:
    """The model of a name such as hashed or hashed:128; made once. ValueError for an unknown one."""
    kind, _, rest = name.partition(":")
    if kind not in _factories:
        raise ValueError(f"no model {name}: {', '.join(sorted(_factories))}")
    args = tuple(int(x) if x.isdigit() else x for x in rest.split(",") if x)
    if (kind, args) not in _made:
        _made[kind, args] = _factories[kind](*args)
    return _made[kind, args]


def contrast_matcher(scale: float = 1.0, factor: float = 1.0, prior_logit: float = 0.0, weight_logit: float = -5.0) -> Rows:
    """Confidence of rows with `query_keys` and `passage_keys`, arrays of vectors, by the contrast of their nearest keys."""
    return lambda rows: rows.withColumn("confidence", S.contrast_probability(S.least_mean_square(F.col("query_keys"), F.col("passage_keys")), scale, factor, prior_logit, weight_logit))


def importance(rows: DataFrame, model: Rows | None, used: bool) -> DataFrame:
    """rows with `importance` by the model; without one a reranker that uses it fails, as it would rank by nothing."""
    if model is None:
        if used:
            raise RuntimeError("the reranker uses importance, but the memory has no importance model")
        return rows
    return model(rows)
