"""Scorers: formulas over columns.

A scorer sees a match's frequency (tf), the document's length in tokens, the idf that the filter chose, the mean length and
the boost.  Registered by name, so that others can be added.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import dataclass
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F


class Scorer:
    """``idf`` of one term (filters add up several), ``score`` of a match, ``constant`` of a match without frequency."""

    def idf(self, df: Column, n: Column) -> Column:
        return F.lit(1.0)

    def score(self, tf: Column, length: Column, idf: Column, mean: Column, boost: Column) -> Column:
        raise NotImplementedError

    def constant(self, boost: float) -> float:
        return 0.0


@dataclass(frozen=True)
class BM25(Scorer):
    """``b`` = 0: BM15, 1: BM11; ``k`` = 0: BM1.  ``legacy_norm`` takes the roots of frequency and length."""

    k: float = 1.2
    b: float = 0.75
    boost_as_score: bool = False
    legacy_norm: bool = False

    def idf(self, df: Column, n: Column) -> Column:
        return F.log1p((n - df + 0.5) / (df + 0.5))

    def score(self, tf: Column, length: Column, idf: Column, mean: Column, boost: Column) -> Column:
        tf, length = (F.sqrt(tf), F.sqrt(length)) if self.legacy_norm else (tf, length)
        return boost * (self.k + 1) * idf * tf / (self.k * (1 - self.b) + self.k * self.b * length / mean + tf)

    def constant(self, boost: float) -> float:
        return boost if self.boost_as_score else 0.0


@dataclass(frozen=True)
class TFIDF(Scorer):
    with_norms: bool = False
    boost_as_score: bool = False

    def idf(self, df: Column, n: Column) -> Column:
        return F.log1p((n + 1.0) / (df + 1.0))

    def score(self, tf: Column, length: Column, idf: Column, mean: Column, boost: Column) -> Column:
        out = F.sqrt(tf) * idf * boost
        return out / F.sqrt(length) if self.with_norms else out

    def constant(self, boost: float) -> float:
        return boost if self.boost_as_score else 0.0


@dataclass(frozen=True)
class BoostScore(Scorer):
    def score(self, tf: Column, length: Column, idf: Column, mean: Column, boost: Column) -> Column:
        return boost

    def constant(self, boost: float) -> float:
        return boost


def _bm25(args: Any) -> Scorer:
    return BM25(*args) if isinstance(args, list) else BM25(**{k: args[k] for k in ("k", "b") if k in args})


def _tfidf(args: Any) -> Scorer:
    return TFIDF(args if isinstance(args, bool) else args[0] if isinstance(args, list) else args.get("withNorms", False))


_REGISTRY: dict[str, Callable[[Any], Scorer]] = {"bm25": _bm25, "tfidf": _tfidf, "boostscore": lambda _: BoostScore()}


def register_scorer(name: str, factory: Callable[[Any], Scorer]) -> None:
    _REGISTRY[name] = factory


def make_scorer(name: str, args: str | dict[str, Any] | list[Any] | bool | None = None) -> Scorer:
    """``args``: JSON or its value."""
    if name not in _REGISTRY:
        raise ValueError(f"no scorer {name}")
    return _REGISTRY[name]((json.loads(args) if isinstance(args, str) else args) if args not in (None, "") else {})
