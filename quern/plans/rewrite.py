"""Rewrites of filter trees: pure functions from filter to filter that keep what matches."""

from __future__ import annotations

import math
from dataclasses import replace

from quern.functions.wildcards import PREFIX, TERM, classify
from quern.operators.filters import All, And, Empty, Filter, Fuzzy, Nested, NGramSimilarity, Not, Or, Phrase, Prefix, Proxy, Range, Term, Terms, Wildcard

MAX_DISTANCE = 4


def needed_ngrams(f: NGramSimilarity) -> int:
    n = len(f.ngrams)
    return min(max(math.ceil(n * min(max(f.threshold, 0.0), 1.0)), 1), n)


def rewrite(f: Filter, scored: bool = True) -> Filter:
    """``scored`` keeps what matters to scores alone."""
    if isinstance(f, Terms):
        return _terms(f, scored)
    if isinstance(f, Range):
        if f.low is not None and f.low == f.high:
            return Term(f.field, f.low, f.boost) if f.low_inclusive and f.high_inclusive else Empty()
        if f.low is not None and f.high is not None and f.low.encode() > f.high.encode():
            return Empty()
        return f
    if isinstance(f, Wildcard):
        kind, literal = classify(f.pattern)
        return Term(f.field, literal, f.boost) if kind == TERM else Prefix(f.field, literal, f.scored_terms_limit, f.boost) if kind == PREFIX else f
    if isinstance(f, Fuzzy):
        if not 0 <= f.max_distance <= MAX_DISTANCE:
            return Empty()
        return Term(f.field, f.prefix + f.term, f.boost) if f.max_distance == 0 else f
    if isinstance(f, NGramSimilarity):
        if not f.ngrams:
            return Empty()
        m = needed_ngrams(f)
        if m == 1 and not scored:
            return rewrite(Terms(f.field, tuple((g, 1.0) for g in dict.fromkeys(f.ngrams)), boost=f.boost), scored)
        return rewrite(Phrase.of(f.field, *f.ngrams, boost=f.boost), scored) if m == len(f.ngrams) and f.allow_phrase else f
    if isinstance(f, Phrase):
        if not f.parts:
            return Empty()
        if len(f.parts) == 1 and not isinstance(f.parts[0][1], Terms):
            only = f.parts[0][1]
            return rewrite(replace(only, boost=only.boost * f.boost), scored)
        return replace(f, parts=tuple((at, rewrite(p, scored) if not isinstance(p, Terms) else p) for at, p in f.parts))
    if isinstance(f, Not):
        return _not(f, scored)
    if isinstance(f, (And, Or)):
        return _boolean(f, scored)
    if isinstance(f, Nested):
        return replace(f, child=rewrite(f.child, scored), all_of=f.all_of and rewrite(f.all_of, False))
    if isinstance(f, Proxy):
        return Proxy(rewrite(f.filter, False))
    return f


def _terms(f: Terms, scored: bool) -> Filter:
    if f.min_match == 0:
        return Or((All(0.0), replace(f, min_match=1)), 1, f.merge) if scored and f.terms else All(f.boost)
    if not f.terms or f.min_match > len({t for t, _ in f.terms}):
        return Empty()
    return Term(f.field, f.terms[0][0], f.terms[0][1] * f.boost) if len(f.terms) == 1 else f


def _not(f: Not, scored: bool) -> Filter:
    if f.child is None:
        return Empty()
    if isinstance(f.child, Not):
        return rewrite(f.child.child, scored) if f.child.child is not None else Empty()
    return Not(rewrite(f.child, False))


def _times(f: Filter, boost: float) -> Filter:
    return replace(f, boost=f.boost * boost) if boost != 1.0 and hasattr(f, "boost") else f


def _boolean(f: And | Or, scored: bool) -> Filter:
    if not f.children:
        return Empty()
    if isinstance(f, Or) and f.min_match == 0:
        return All(f.boost)
    children = [rewrite(c, scored) for c in f.children]
    keep = [c for c in children if not isinstance(c, Not)]
    drop = [c for c in children if isinstance(c, Not)]
    if any(isinstance(c.child, All) for c in drop):
        return Empty()
    drop = [c for c in drop if not isinstance(c.child, Empty)]
    lost = len(children) - len(keep) - len(drop)  # complements of nothing: every document
    if isinstance(f, And):
        if any(isinstance(c, Empty) for c in keep):
            return Empty()
        if not keep:
            keep = [All(0.0)]
        if not scored and len(keep) > 1:
            keep = [c for c in keep if not isinstance(c, All)] or [All(0.0)]
        if len(keep) == 1 and not drop:
            return _times(keep[0], f.boost)
        same = {c.field for c in keep if isinstance(c, Term)}
        if len(keep) > 1 and len(same) == 1 and all(isinstance(c, Term) for c in keep) and len({c.term for c in keep}) == len(keep):
            keep = [Terms(same.pop(), tuple((c.term, c.boost) for c in keep), len(keep), f.merge, f.boost)]
            return And((*keep, *drop), f.merge) if drop else keep[0]
        return replace(f, children=(*keep, *drop))
    # each complement puts every document, unscored, into the pool, and excludes
    pool = [c for c in keep if not isinstance(c, Empty)] + [All(0.0)] * (len(drop) + lost)
    need = f.min_match
    if need > len(pool):
        return Empty()
    if len(pool) == 1:
        inner = _times(pool[0], f.boost)
        return And((inner, *drop), f.merge) if drop else inner
    if need == len(pool):
        return _boolean(And((*pool, *drop), f.merge, f.boost), scored)
    same = {c.field for c in pool if isinstance(c, Term)}
    if len(same) == 1 and all(isinstance(c, Term) for c in pool) and len({c.term for c in pool}) == len(pool):
        inner = Terms(same.pop(), tuple((c.term, c.boost) for c in pool), need, f.merge, f.boost)
    else:
        inner = Or(tuple(pool), need, f.merge, f.boost)
    return And((inner, *drop), f.merge) if drop else inner
