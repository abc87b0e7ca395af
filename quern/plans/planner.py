"""Filter trees to DataFrames of (doc_id, score).

Dictionary predicates run on ``term_dict`` and, where they are sargable, on the postings' scan too.  Terms of one field share one
scan of the postings.  Field statistics are one row per field, hence the only explicit broadcast.  All scores are double.
"""

from __future__ import annotations

from dataclasses import replace
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from quern.functions.similarity import damerau
from quern.functions.wildcards import literal_prefix, to_regex
from quern.operators.filters import All, And, Empty, Exists, Filter, Fuzzy, Nested, NGramSimilarity, Not, NumericRange, Or, Phrase, Prefix, Proxy, Range, SamePosition, Term, Terms, Where, Wildcard
from quern.operators.scorers import Scorer
from quern.plans.rewrite import needed_ngrams, rewrite
from quern.sources.index import Index

_MERGE = {"sum": F.sum, "max": F.max, "min": F.min}


def merged(merge: str, col: str = "score") -> Column:
    return F.lit(0.0) if merge == "none" else _MERGE[merge](col)


class Search:
    """Plans filters over one snapshot.  Without a scorer all scores are 0."""

    def __init__(self, index: Index, scorer: Scorer | None = None, cache: dict[Filter, DataFrame] | None = None) -> None:
        self.index, self.scorer = index, scorer
        self.cache = {} if cache is None else cache

    # --- entry points

    def matches(self, f: Filter, live: bool = True) -> DataFrame:
        """(doc_id, score), one row per matching document; deleted ones are masked unless ``live`` is false."""
        out = self._plan(rewrite(f, self.scorer is not None), 1.0)
        if live and self.index.deleted is not None:
            out = out.join(self.index.deleted.select("doc_id"), "doc_id", "left_anti")
        return out

    def top(self, f: Filter, k: int, decimals: int | None = None) -> DataFrame:
        """The k best by score, then id."""
        rows = self.matches(f)
        if decimals is not None:
            rows = rows.withColumn("score", F.round("score", decimals))
        return rows.orderBy(F.col("score").desc(), F.col("doc_id")).limit(k)

    def fetch(self, f: Filter, *columns: str) -> DataFrame:
        """Matches with stored columns."""
        return self.matches(f).join(self.index.docs.select("doc_id", *columns), "doc_id")

    # --- helpers

    def _dictionary(self, field: str, condition: Column | None = None) -> DataFrame:
        rows = self.index.term_dict.filter(F.col("field") == field)
        return (rows if condition is None else rows.filter(condition)).select("term", "df")

    def _stats(self, field: str) -> DataFrame:
        rows = self.index.field_stats if self.index.counts is None else self.index.counts
        return F.broadcast(rows.filter(F.col("field") == field).select("n_docs", (F.col("ttf") / F.col("n_docs")).alias("mean")))

    def _postings(self, field: str, condition: Column | None, *columns: str) -> DataFrame:
        rows = self.index.postings.filter(F.col("field") == field)
        return (rows if condition is None else rows.filter(condition)).select("term", "doc_id", *columns)

    def _none(self) -> DataFrame:
        return self.index.docs.select("doc_id", F.lit(0.0).alias("score")).limit(0)

    def _constant(self, docs: DataFrame, boost: float) -> DataFrame:
        return docs.select("doc_id", F.lit(float(self.scorer.constant(boost)) if self.scorer else 0.0).alias("score"))

    def _lacks(self, field: str, feature: str) -> bool:
        spec = self.index.spec(field)
        return spec is not None and not spec.has(feature)

    def _scored(self, field: str, hits: DataFrame, idf: str, boost: Column) -> DataFrame:
        """Adds ``score`` to hits with tf, length and the column named ``idf``."""
        if self.scorer is None:
            return hits.withColumn("score", F.lit(0.0))
        return hits.crossJoin(self._stats(field)).withColumn("score", self.scorer.score(F.col("tf").cast("double"), F.col("length").cast("double"), F.col(idf), F.col("mean"), boost))

    def _idf(self, field: str, terms: DataFrame, df: Column | None = None) -> DataFrame:
        """Adds ``idf`` to terms with df."""
        if self.scorer is None:
            return terms.withColumn("idf", F.lit(0.0))
        return terms.crossJoin(self._stats(field)).withColumn("idf", self.scorer.idf((F.col("df") if df is None else df).cast("double"), F.col("n_docs").cast("double"))).drop("n_docs", "mean")

    def _terms_hits(self, field: str, terms: DataFrame, condition: Column | None, boost: Column, merge: str, min_match: int = 1) -> DataFrame:
        """``terms``: (term, df, and what ``boost`` needs, optionally scored)."""
        if self.scorer is None:
            rows = self._postings(field, condition).join(terms.select("term"), "term")
            out = rows.groupBy("doc_id").agg(F.count("*").alias("n"))
            return out.filter(F.col("n") >= min_match).select("doc_id", F.lit(0.0).alias("score"))
        with_idf = self._idf(field, terms)
        hits = self._scored(field, self._postings(field, condition, "tf", "length").join(with_idf, "term"), "idf", boost)
        if "scored" in terms.columns:
            hits = hits.withColumn("score", F.when(F.col("scored"), F.col("score")).otherwise(0.0))
        return hits.groupBy("doc_id").agg(F.count("*").alias("n"), merged(merge).alias("score")).filter(F.col("n") >= min_match).select("doc_id", "score")

    def _limited(self, terms: DataFrame, limit: int) -> DataFrame:
        """Only the terms with the most documents are scored; ties: the later term."""
        best = terms.orderBy(F.col("df").desc(), F.col("term").desc()).limit(limit).select("term", F.lit(True).alias("scored"))
        return terms.join(best, "term", "left").withColumn("scored", F.coalesce("scored", F.lit(False)))

    # --- dictionary predicates

    def _condition(self, f: Filter) -> Column:
        """On a column ``term``, for filters whose terms a predicate names."""
        term = F.col("term")
        if isinstance(f, Term):
            return term == f.term
        if isinstance(f, Terms):
            return term.isin([t for t, _ in f.terms])
        if isinstance(f, Prefix):
            return term.startswith(f.prefix) if f.prefix else F.lit(True)
        if isinstance(f, Wildcard):
            lead = literal_prefix(f.pattern)
            return (term.startswith(lead) if lead else F.lit(True)) & term.rlike(to_regex(f.pattern))
        if isinstance(f, Range):
            out = F.lit(True)
            if f.low is not None:
                out = out & ((term >= f.low) if f.low_inclusive else (term > f.low))
            if f.high is not None:
                out = out & ((term <= f.high) if f.high_inclusive else (term < f.high))
            return out
        if isinstance(f, Fuzzy):
            rest = F.substr(term, F.lit(len(f.prefix) + 1))
            near = (damerau(rest, F.lit(f.term), f.max_distance) if f.transpositions else F.levenshtein(rest, F.lit(f.term), f.max_distance)) >= 0
            return (term.startswith(f.prefix) if f.prefix else F.lit(True)) & near
        raise TypeError(f"{type(f).__name__} has no terms")

    def _fuzzy_terms(self, f: Fuzzy) -> DataFrame:
        """(term, df, similarity), limited to the most similar."""
        rest = F.substr(F.col("term"), F.lit(len(f.prefix) + 1))
        distance = damerau(rest, F.lit(f.term), f.max_distance) if f.transpositions else F.levenshtein(rest, F.lit(f.term), f.max_distance)
        rows = self._dictionary(f.field, F.col("term").startswith(f.prefix) if f.prefix else None)
        # a distance within k needs lengths within k: cheap, and done before the distance
        rows = rows.filter(F.length("term").between(len(f.prefix + f.term) - f.max_distance, len(f.prefix + f.term) + f.max_distance)).withColumn("distance", distance).filter("distance >= 0")
        shorter = F.least(F.length("term"), F.lit(len(f.prefix + f.term)))
        rows = rows.withColumn("similarity", F.when(shorter == 0, F.lit(0.0)).otherwise(1 - F.col("distance") / shorter)).select("term", "df", "similarity")
        return rows.orderBy(F.col("similarity").desc(), F.col("term").desc()).limit(f.max_terms) if f.max_terms else rows

    def _part_terms(self, f: Filter) -> DataFrame:
        """(term, df, boost) of a phrase's part: a fuzzy term counts by its similarity, others by their boost, which isn't negative."""
        if isinstance(f, Fuzzy):
            return self._fuzzy_terms(f).withColumnRenamed("similarity", "boost")
        boost = F.lit(1.0)
        if isinstance(f, Terms):
            boost = F.element_at(F.create_map(*[F.lit(x) for t, b in f.terms for x in (t, max(0.0, float(b)))]), F.col("term"))
        elif isinstance(f, Term):
            boost = F.lit(max(0.0, float(f.boost)))
        return self._dictionary(f.field, self._condition(f)).withColumn("boost", boost)

    # --- filters

    def _plan(self, f: Filter, boost: float) -> DataFrame:
        boost = boost * getattr(f, "boost", 1.0)
        if hasattr(f, "plan"):  # filters of one's own: plan(search, boost) gives (doc_id, score)
            return f.plan(self, boost)
        return getattr(self, f"_{type(f).__name__.lower()}")(f, boost)

    def _empty(self, f: Empty, boost: float) -> DataFrame:
        return self._none()

    def _all(self, f: All, boost: float) -> DataFrame:
        return self._constant(self.index.docs, boost)

    def _where(self, f: Where, boost: float) -> DataFrame:
        return self._constant(self.index.docs.filter(f.condition), boost)

    def _numericrange(self, f: NumericRange, boost: float) -> DataFrame:
        col, keep = F.col(f.field), F.col(f.field).isNotNull()
        if f.low is not None and f.high is not None and (f.low > f.high or f.low == f.high and not (f.low_inclusive and f.high_inclusive)):
            return self._none()
        if f.low is not None:
            keep = keep & ((col >= f.low) if f.low_inclusive else (col > f.low))
        if f.high is not None:
            keep = keep & ((col <= f.high) if f.high_inclusive else (col < f.high))
        return self._constant(self.index.docs.filter(keep), boost)

    def _exists(self, f: Exists, boost: float) -> DataFrame:
        names = [c for c in self.index.docs.columns if c != "doc_id" and (c.startswith(f.field) and (f.accept is None or f.accept(c, f.field)) if f.as_prefix else c == f.field)]
        if not names:
            return self._none()
        held = [F.col(c).isNotNull() for c in names]
        rows = self.index.docs.filter(reduce(Column.__or__, held))
        each = float(self.scorer.constant(boost)) if self.scorer else 0.0
        return rows.select("doc_id", (reduce(Column.__add__, [h.cast("double") for h in held]) * each).alias("score"))

    def _term(self, f: Term, boost: float) -> DataFrame:
        condition = F.col("term") == f.term
        if self.scorer is None:
            return self._postings(f.field, condition).select("doc_id", F.lit(0.0).alias("score"))
        if "df" in self.index.postings.columns:
            return self._scored_by_df(f.field, condition, F.lit(boost)).select("doc_id", "score")
        hits = self._postings(f.field, condition, "tf", "length").join(self._idf(f.field, self._dictionary(f.field, condition)), "term")
        return self._scored(f.field, hits, "idf", F.lit(boost)).select("doc_id", "score")

    def _scored_by_df(self, field: str, condition: Column, boost: Column) -> DataFrame:
        """Postings with ``score``, by the df that saved ones carry."""
        rows = self._postings(field, condition, "tf", "length", "df").crossJoin(self._stats(field))
        idf = self.scorer.idf(F.col("df").cast("double"), F.col("n_docs").cast("double"))
        return rows.withColumn("score", self.scorer.score(F.col("tf").cast("double"), F.col("length").cast("double"), idf, F.col("mean"), boost))

    def _terms(self, f: Terms, boost: float) -> DataFrame:
        condition = self._condition(f)
        given = dict(f.terms)
        boosts = F.element_at(F.create_map(*[F.lit(x) for t, b in given.items() for x in (t, float(b))]), F.col("term")) * boost
        if self.scorer is not None and "df" in self.index.postings.columns:
            hits = self._scored_by_df(f.field, condition, boosts)
            return hits.groupBy("doc_id").agg(F.count("*").alias("n"), merged(f.merge).alias("score")).filter(F.col("n") >= f.min_match).select("doc_id", "score")
        return self._terms_hits(f.field, self._dictionary(f.field, condition), condition, boosts, f.merge, f.min_match)

    def _multi(self, f: Prefix | Range | Wildcard, boost: float) -> DataFrame:
        condition = self._condition(f)
        terms = self._dictionary(f.field, condition)
        if self.scorer is not None:
            terms = self._limited(terms, f.scored_terms_limit)
        return self._terms_hits(f.field, terms, condition, F.lit(boost), "sum")

    _prefix = _range = _wildcard = _multi

    def _fuzzy(self, f: Fuzzy, boost: float) -> DataFrame:
        """All matched terms share one idf, of their summed df; the best similarity counts.  A limited number of terms is looked up first: the
        postings' scan then has their names, and nothing is joined."""
        terms = self._fuzzy_terms(f)
        if f.max_terms and self.scorer is not None:
            found = terms.collect()  # max_terms at most
            if not found:
                return self._none()
            near = F.element_at(F.create_map(*[F.lit(x) for r in found for x in (r.term, float(r.similarity))]), F.col("term"))
            rows = self._postings(f.field, F.col("term").isin([r.term for r in found]), "tf", "length").withColumn("df", F.lit(float(sum(r.df for r in found)))).crossJoin(self._stats(f.field))
            idf = self.scorer.idf(F.col("df"), F.col("n_docs").cast("double"))
            hits = rows.withColumn("score", self.scorer.score(F.col("tf").cast("double"), F.col("length").cast("double"), idf, F.col("mean"), near * boost))
            return hits.groupBy("doc_id").agg(F.max("score").alias("score"))
        lead = F.col("term").startswith(f.prefix) if f.prefix else None
        if self.scorer is not None:
            # over the few terms within the distance
            terms = terms.select("term", F.sum("df").over(Window.partitionBy(F.lit(0))).alias("df"), "similarity")
        return self._terms_hits(f.field, terms, lead, F.col("similarity") * boost, "max")

    def _occurrences(self, f: Phrase, *more: str) -> DataFrame:
        """Postings of a phrase's parts with part, shift and boost.  Where all parts are terms and one is much rarer than another, the
        frequent ones' postings are cut down to its documents before their positions are touched."""
        shift = [at - f.parts[0][0] for at, _ in f.parts]
        if all(isinstance(p, Term) for _, p in f.parts):
            names = list(dict.fromkeys(p.term for _, p in f.parts))
            known = {r.term: r.df for r in self._dictionary(f.field, F.col("term").isin(names)).collect()}  # one row per part at most
            where = {t: F.array(*[F.struct(F.lit(k).alias("part"), F.lit(s).alias("shift"), F.lit(1.0).alias("boost")) for k, (s, (_, p)) in enumerate(zip(shift, f.parts)) if p.term == t]) for t in names}
            if len(known) < len(names):
                names = []
            rare = min(names, key=known.get, default=None)
            often = [t for t in names if known[t] > 8 * known[rare]]
            of = lambda terms: self._postings(f.field, F.col("term").isin(terms), "length", "positions", *more)
            rows = of([t for t in names if t not in often])
            if often:
                rows = rows.unionByName(of(often).join(self._postings(f.field, F.col("term") == rare).select("doc_id"), "doc_id", "left_semi").select(rows.columns))
            parts = F.element_at(F.create_map(*[x for t, w in where.items() for x in (F.lit(t), w)]), F.col("term"))
            return rows.select("term", "doc_id", "length", "positions", *more, F.inline(parts))
        parts = None
        for k, (_, p) in enumerate(f.parts):
            rows = self._part_terms(p).select("term", F.lit(k).alias("part"), F.lit(shift[k]).alias("shift"), F.col("boost").cast("double").alias("boost"))
            parts = rows if parts is None else parts.unionByName(rows)
        condition = reduce(Column.__or__, [self._condition(p) for _, p in f.parts]) if not any(isinstance(p, Fuzzy) for _, p in f.parts) else None
        return self._postings(f.field, condition, "length", "positions", *more).join(parts, "term")

    def _phrase(self, f: Phrase, boost: float) -> DataFrame:
        """A document's boost is the mean of its matched terms' boosts over all places and parts."""
        if self._lacks(f.field, "pos"):
            return self._none()
        n, rows = len(f.parts), self._occurrences(f)
        own = self.scorer is not None and any(isinstance(p, Fuzzy) or isinstance(p, Terms) and any(b != 1 for _, b in p.terms) for _, p in f.parts)
        if own:
            at = rows.select("doc_id", "length", "part", "boost", (F.explode("positions")).alias("at"), "shift").groupBy("doc_id", "length", (F.col("at") - F.col("shift")).alias("start"), "part").agg(F.max("boost").alias("boost"))
            starts = at.groupBy("doc_id", "length", "start").agg(F.count("*").alias("n"), F.sum("boost").alias("boost")).filter(F.col("n") == n)
            found = starts.groupBy("doc_id", "length").agg(F.count("*").alias("tf"), (F.sum("boost") / (F.count("*") * n)).alias("part_boost"))
        else:
            each = rows.select("doc_id", "length", "part", F.transform("positions", lambda p: p - F.col("shift")).alias("starts"))
            docs = each.groupBy("doc_id", "length").agg(F.collect_list(F.struct("part", "starts")).alias("of")).filter(F.size(F.array_distinct(F.col("of.part"))) == n)
            of = lambda k: F.flatten(F.transform(F.filter("of", lambda x: x["part"] == k), lambda x: x["starts"]))
            common = reduce(F.array_intersect, [of(k) for k in range(1, n)], F.array_distinct(of(0)))
            found = docs.select("doc_id", "length", F.size(common).cast("bigint").alias("tf"), F.lit(1.0).alias("part_boost")).filter("tf > 0")
        if self.scorer is None:
            return found.select("doc_id", F.lit(0.0).alias("score"))
        terms = reduce(DataFrame.unionByName, [self._part_terms(p).select("term", "df") for _, p in f.parts])
        idf = self._idf(f.field, terms).agg(F.sum("idf").alias("idf"))
        return self._scored(f.field, found.crossJoin(F.broadcast(idf)), "idf", F.col("part_boost") * boost).select("doc_id", "score")

    def _phrase_spans(self, f: Phrase) -> DataFrame:
        """(doc_id, begin, end) of each place where all parts stand."""
        rows = self._occurrences(f, "starts", "ends").withColumn("at", F.explode(F.arrays_zip("positions", "starts", "ends")))
        rows = rows.select("doc_id", "part", (F.col("at.positions") - F.col("shift")).alias("start"), "at.starts", "at.ends")
        return rows.groupBy("doc_id", "start").agg(F.countDistinct("part").alias("n"), F.min("starts").alias("begin"), F.max("ends").alias("end")).filter(F.col("n") == len(f.parts)).select("doc_id", "begin", "end")

    def offsets(self, f: Filter) -> DataFrame:
        """(doc_id, begin, end) of each match of a term, phrase or n-gram sequence, in code points; the field needs offsets."""
        f = rewrite(f, False)
        if isinstance(f, Term):
            rows = self._postings(f.field, F.col("term") == f.term, "starts", "ends")
            return rows.select("doc_id", F.explode(F.arrays_zip("starts", "ends")).alias("at")).select("doc_id", F.col("at.starts").alias("begin"), F.col("at.ends").alias("end"))
        if isinstance(f, Phrase):
            return self._phrase_spans(f)
        if isinstance(f, NGramSimilarity):
            need, grams = needed_ngrams(f), list(dict.fromkeys(f.ngrams))
            rows = self._postings(f.field, F.col("term").isin(grams), "positions", "starts", "ends").groupBy("doc_id").agg(F.collect_list(F.struct("term", "positions", "starts", "ends")).alias("found"))

            @pandas_udf("array<struct<begin:int,end:int>>")
            def spans(found: pd.Series) -> pd.Series:
                out = []
                for each in found:
                    length, places = sequence_places(f.ngrams, sorted((int(p), k) for x in each for p in x["positions"] for k, g in enumerate(f.ngrams) if g == x["term"]))
                    start = {p: a for x in each for p, a in zip(x["positions"], x["starts"])}
                    end = {p: b for x in each for p, b in zip(x["positions"], x["ends"])}
                    out.append([{"begin": int(start[a]), "end": int(end[b])} for a, b in places] if length >= need else [])
                return pd.Series(out)

            return rows.select("doc_id", F.inline(spans("found")))
        raise TypeError("offsets are kept for terms, phrases and n-gram sequences")

    def _ngramsimilarity(self, f: NGramSimilarity, boost: float) -> DataFrame:
        if self._lacks(f.field, "pos"):
            return self._none()
        need, n = needed_ngrams(f), len(f.ngrams)
        grams = list(dict.fromkeys(f.ngrams))
        condition = F.col("term").isin(grams)
        # a place is position * n + place in the query: one sorted array of numbers per document
        slots = F.element_at(F.create_map(*[x for g in grams for x in (F.lit(g), F.array(*[F.lit(k) for k, h in enumerate(f.ngrams) if h == g]))]), F.col("term"))
        own = F.flatten(F.transform("positions", lambda p: F.transform(slots, lambda k: p.cast("bigint") * n + k)))
        rows = self._postings(f.field, condition, "length", "positions").select("doc_id", "length", own.alias("own")).groupBy("doc_id", "length").agg(F.array_sort(F.flatten(F.collect_list("own"))).alias("places"), F.count("*").alias("n"))

        @pandas_udf("longest int, tf int")
        def sequences(places: pd.Series) -> pd.DataFrame:
            return pd.DataFrame([longest_sequence(f.ngrams, [divmod(x, n) for x in each.tolist()]) for each in places], columns=["longest", "tf"])

        # fewer distinct grams than needed can't make a sequence, unless the query repeats some
        rows = rows.filter(F.col("n") >= max(1, need - (n - len(grams)))).withColumn("s", sequences("places")).select("doc_id", "length", "s.longest", "s.tf").filter(F.col("longest") >= need)
        if self.scorer is None:
            return rows.select("doc_id", F.lit(0.0).alias("score"))
        times = F.element_at(F.create_map(*[F.lit(x) for g in grams for x in (g, float(f.ngrams.count(g)))]), F.col("term"))
        idf = self._idf(f.field, self._dictionary(f.field, condition)).agg(F.sum(F.col("idf") * times).alias("idf"))
        return self._scored(f.field, rows.crossJoin(F.broadcast(idf)), "idf", F.col("longest") / F.lit(n) * boost).select("doc_id", "score")

    def _sameposition(self, f: SamePosition, boost: float) -> DataFrame:
        if not f.terms or any(self._lacks(x, "pos") for x, _ in f.terms):
            return self._none()
        pairs = list(dict.fromkeys(f.terms))
        hits = []
        for k, (field, term) in enumerate(pairs):
            rows = self._postings(field, F.col("term") == term, "tf", "length", "positions")
            if self.scorer is not None:
                rows = self._scored(field, rows.join(self._idf(field, self._dictionary(field, F.col("term") == term)), "term"), "idf", F.lit(boost))
            else:
                rows = rows.withColumn("score", F.lit(0.0))
            hits.append(rows.select("doc_id", F.lit(k).alias("pair"), "score", F.explode("positions").alias("pos")))
        at = reduce(DataFrame.unionByName, hits).groupBy("doc_id", "pos").agg(F.countDistinct("pair").alias("n"), F.sum("score").alias("score")).filter(F.col("n") == len(pairs))
        return at.groupBy("doc_id").agg(F.max("score").alias("score"))

    def _children(self, children: list[Filter], boost: float, merge: str, need: int) -> DataFrame:
        rows = reduce(DataFrame.unionByName, [self._plan(c, boost) for c in children])
        return rows.groupBy("doc_id").agg(F.count("*").alias("n"), merged(merge).alias("score")).filter(F.col("n") >= need).select("doc_id", "score")

    def _and(self, f: And, boost: float) -> DataFrame:
        keep, drop = [c for c in f.children if not isinstance(c, Not)], [c for c in f.children if isinstance(c, Not)]
        out = self._plan(keep[0], boost) if len(keep) == 1 else self._children(keep, boost, f.merge, len(keep))
        for c in drop:
            out = out.join(Search(self.index, None, self.cache)._plan(c.child, 1.0).select("doc_id"), "doc_id", "left_anti")
        return out

    def _or(self, f: Or, boost: float) -> DataFrame:
        return self._children(list(f.children), boost, f.merge, f.min_match)

    def _not(self, f: Not, boost: float) -> DataFrame:
        return self._and(And((All(0.0), f)), boost)

    def _nested(self, f: Nested, boost: float) -> DataFrame:
        relation = self.index.relations[f.relation].select("child_id", "parent_id")
        parents = relation.select("parent_id").distinct()
        # without a merge the children aren't scored, and a parent's score is its boost
        inner = self if f.merge != "none" else Search(self.index, None, self.cache)
        child = inner._plan(f.child, boost if f.merge != "none" else 1.0)
        hits = child.join(relation, child.doc_id == relation.child_id).groupBy("parent_id").agg(F.count("*").alias("n"), merged(f.merge).alias("score"))
        if f.all_of is not None:
            wanted = Search(self.index, None, self.cache)._plan(f.all_of, 1.0)
            both = child.select("doc_id").join(wanted.select("doc_id", F.lit(1).alias("w")), "doc_id", "left")
            inside = both.filter("w is not null").join(relation, F.col("doc_id") == F.col("child_id")).groupBy("parent_id").agg(F.count("*").alias("inside"))
            total = wanted.join(relation, F.col("doc_id") == F.col("child_id")).groupBy("parent_id").agg(F.count("*").alias("wanted"))
            rows = hits.join(inside, "parent_id").join(total, "parent_id").filter("n = inside and n = wanted")
        elif f.low == 0:
            rows = parents.join(hits, "parent_id", "left").withColumn("n", F.coalesce("n", F.lit(0))).withColumn("score", F.coalesce("score", F.lit(0.0)))
            rows = rows if f.high is None else rows.filter(F.col("n") <= f.high)
        else:
            rows = hits.filter((F.col("n") >= f.low) & (F.lit(True) if f.high is None else F.col("n") <= f.high))
        if f.merge == "none" and self.scorer is not None:
            rows = rows.withColumn("score", F.lit(float(boost)))
        return rows.select(F.col("parent_id").alias("doc_id"), F.col("score").cast("double").alias("score"))

    def _proxy(self, f: Proxy, boost: float) -> DataFrame:
        if f.filter not in self.cache:
            self.cache[f.filter] = Search(self.index, None, self.cache)._plan(f.filter, 1.0).select("doc_id").persist()
        return self._constant(self.cache[f.filter], boost)


def sequence_places(query: tuple[str, ...], places: list[tuple[int, int]]) -> tuple[int, list[tuple[int, int]]]:
    """Length of the longest chain of query n-grams, in the query's order, at rising positions, and the (first, last) positions at
    which its n-grams follow each other without overlap.  ``places``: sorted (position, place in the query)."""
    if not places:
        return 0, []
    # by place in the query the longest chain that ends there and its end, the earliest of equals; work is places times the query's length
    ends: list[tuple[int, int]] = [(0, -1)] * len(query)
    best: list[tuple[int, int]] = []  # (length, previous)
    i = 0
    while i < len(places):
        at = i
        while at < len(places) and places[at][0] == places[i][0]:
            length, before = 0, -1
            for n, j in ends[: places[at][1]]:
                if n > length or n == length and n and j < before:
                    length, before = n, j
            best.append((length + 1, before))
            at += 1
        for j in range(i, at):
            if best[j][0] > ends[places[j][1]][0]:
                ends[places[j][1]] = (best[j][0], j)
        i = at
    end = max(range(len(places)), key=lambda i: (best[i][0], -i))
    chain, i = [], end
    while i >= 0:
        chain.append(places[i][1])
        i = best[i][1]
    chain.reverse()
    found: list[tuple[int, int]] = []
    at, first, last = 0, -1, -1
    for p, k in places:
        if p > last and query[k] == query[chain[at]]:
            first = p if at == 0 else first
            at, last = at + 1, p
            if at == len(chain):
                found.append((first, last))
                at = 0
    return len(chain), found


def longest_sequence(query: tuple[str, ...], places: list[tuple[int, int]]) -> tuple[int, int]:
    """Length of the longest chain, and how often it comes."""
    length, found = sequence_places(query, places)
    return length, len(found)


def search_all(index: Index, f: Filter, scorers: list[Scorer]) -> DataFrame:
    """(doc_id, scores): one slot per scorer."""
    parts = [Search(index, s).matches(f).select("doc_id", F.lit(k).alias("k"), "score") for k, s in enumerate(scorers)]
    rows = reduce(DataFrame.unionByName, parts).groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("k", "score"))).alias("s"))
    return rows.select("doc_id", F.transform("s", lambda x: x["score"]).alias("scores"))


def with_boost(f: Filter, boost: float) -> Filter:
    return replace(f, boost=boost)
