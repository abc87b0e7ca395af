"""Search filters: immutable values that compare by content.

A filter says what matches; ``quern.plans`` rewrites it and turns it into a DataFrame of (doc_id, score).  Boosts multiply
downwards.  ``merge`` combines the scores of what matched: sum, max, min or none.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass


@dataclass(frozen=True)
class Filter:
    pass


@dataclass(frozen=True)
class Empty(Filter):
    """Nothing."""


@dataclass(frozen=True)
class All(Filter):
    """Every document."""

    boost: float = 1.0


@dataclass(frozen=True)
class Term(Filter):
    field: str
    term: str
    boost: float = 1.0


@dataclass(frozen=True)
class Terms(Filter):
    """At least ``min_match`` of the (term, boost) pairs; 0 matches every document."""

    field: str
    terms: tuple[tuple[str, float], ...]
    min_match: int = 1
    merge: str = "sum"
    boost: float = 1.0


@dataclass(frozen=True)
class Prefix(Filter):
    field: str
    prefix: str
    scored_terms_limit: int = 1024
    boost: float = 1.0


@dataclass(frozen=True)
class Range(Filter):
    """Terms between two bounds by their bytes; None is unbounded."""

    field: str
    low: str | None = None
    high: str | None = None
    low_inclusive: bool = True
    high_inclusive: bool = True
    scored_terms_limit: int = 1024
    boost: float = 1.0


@dataclass(frozen=True)
class NumericRange(Filter):
    """Stored numbers between two bounds."""

    field: str
    low: float | None = None
    high: float | None = None
    low_inclusive: bool = True
    high_inclusive: bool = True
    boost: float = 1.0


@dataclass(frozen=True)
class Wildcard(Filter):
    field: str
    pattern: str
    scored_terms_limit: int = 1024
    boost: float = 1.0


@dataclass(frozen=True)
class Fuzzy(Filter):
    """Terms that start with ``prefix`` and whose rest is within ``max_distance`` of ``term``.  ``max_terms`` (0: no limit) keeps the most similar
    terms; others don't match at all."""

    field: str
    term: str
    max_distance: int = 1
    prefix: str = ""
    transpositions: bool = False
    max_terms: int = 0
    boost: float = 1.0


@dataclass(frozen=True)
class Phrase(Filter):
    """Parts at exact relative positions: (position, Term | Terms | Prefix | Range | Wildcard | Fuzzy)."""

    field: str
    parts: tuple[tuple[int, Filter], ...]
    boost: float = 1.0

    @staticmethod
    def of(field: str, *words: str, boost: float = 1.0) -> Phrase:
        """Following words; an empty one leaves a gap."""
        return Phrase(field, tuple((k, Term(field, w)) for k, w in enumerate(words) if w), boost)


@dataclass(frozen=True)
class NGramSimilarity(Filter):
    """Documents with at least ``threshold`` of the n-grams in order; all of them: as a phrase."""

    field: str
    ngrams: tuple[str, ...]
    threshold: float = 1.0
    allow_phrase: bool = True
    boost: float = 1.0


@dataclass(frozen=True)
class SamePosition(Filter):
    """All (field, term) pairs at one position."""

    terms: tuple[tuple[str, str], ...]
    boost: float = 1.0


@dataclass(frozen=True)
class Exists(Filter):
    """A stored value, be it empty; with ``as_prefix`` in any column that starts with ``field`` and that ``accept`` takes."""

    field: str
    as_prefix: bool = False
    accept: Callable[[str, str], bool] | None = None
    boost: float = 1.0


@dataclass(frozen=True)
class Where(Filter):
    """A SQL condition over stored columns: the way to add filters of one's own."""

    condition: str
    boost: float = 1.0


@dataclass(frozen=True)
class Nested(Filter):
    """Parents by their matching children, ``relation`` naming a table (child_id, parent_id).  ``low`` to ``high`` (None: no limit)
    children match; 0 to 0: none does.  With ``all_of`` the matching children must be exactly those that all_of matches, and at least one."""

    relation: str
    child: Filter
    low: int = 1
    high: int | None = None
    merge: str = "sum"
    all_of: Filter | None = None
    boost: float = 1.0

    def __post_init__(self) -> None:
        if self.high is not None and self.low > self.high:
            raise ValueError("low exceeds high")


@dataclass(frozen=True)
class And(Filter):
    children: tuple[Filter, ...]
    merge: str = "sum"
    boost: float = 1.0


@dataclass(frozen=True)
class Or(Filter):
    children: tuple[Filter, ...]
    min_match: int = 1
    merge: str = "sum"
    boost: float = 1.0


@dataclass(frozen=True)
class Not(Filter):
    """The complement.  Beside other children of an Or it excludes: ``Or(a, Not(b))`` is every document without b."""

    child: Filter | None = None


@dataclass(frozen=True)
class Proxy(Filter):
    """Keeps the documents of ``filter`` (without scores) for later queries on the same snapshot."""

    filter: Filter


def visit(node: Filter, see: Callable[[Filter], None]) -> None:
    """Calls ``see`` for the filter and all below it."""
    see(node)
    below = list(getattr(node, "children", ())) + [p for _, p in getattr(node, "parts", ())]
    below += [x for x in (getattr(node, "child", None), getattr(node, "filter", None), getattr(node, "all_of", None)) if isinstance(x, Filter)]
    for x in below:
        visit(x, see)
