import math
import random
import re
from collections import Counter
from dataclasses import dataclass

import pytest
from pyspark.sql import functions as F

from quern.operators.filters import All, And, Empty, Exists, Filter, Fuzzy, Nested, NGramSimilarity, Not, NumericRange, Or, Phrase, Prefix, Proxy, Range, SamePosition, Term, Terms, Wildcard, visit
from quern.operators.scorers import BM25, TFIDF, BoostScore, make_scorer
from quern.plans.planner import Search, longest_sequence
from quern.plans.rewrite import rewrite
from quern.sources.index import FieldSpec, Index, keyword_field, text_field
from quern.sources.loaders import parent_relation

WORDS = ["ab", "abc", "abd", "xyz", "x_z", "jumps", "high", "é"]


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(3)
    docs = [(k, " ".join(rng.choice(WORDS[:4] + WORDS[5:]) for _ in range(rng.randint(0, 12))), rng.choice(["a", "b", None]), k % 5) for k in range(1, 60)]
    return [*docs, (60, None, "a", None), (61, "", None, 1)]


@pytest.fixture(scope="module")
def index(spark, corpus, tmp_path_factory):
    df = spark.createDataFrame(corpus, "doc_id long, text string, tag string, num int")
    fields = [text_field("text", features="offs"), keyword_field("tag")]
    return Index.build(df, fields).save(str(tmp_path_factory.mktemp("index")) + "/i")


def words(doc):
    return (doc[1] or "").split()


def ids(index, f, scorer=None):
    return sorted(r.doc_id for r in Search(index, scorer).matches(f).collect())


def having(corpus, test):
    return sorted(d[0] for d in corpus if test(d))


def test_single_filters(index, corpus):
    assert ids(index, All()) == having(corpus, lambda d: True)
    assert ids(index, Empty()) == []
    assert ids(index, Term("text", "abc")) == having(corpus, lambda d: "abc" in words(d))
    assert ids(index, Prefix("text", "ab")) == having(corpus, lambda d: any(w.startswith("ab") for w in words(d)))
    assert ids(index, Wildcard("text", "a_c")) == having(corpus, lambda d: "abc" in words(d))
    assert ids(index, Wildcard("text", "_")) == having(corpus, lambda d: "é" in words(d))
    assert ids(index, Range("text", "abc", "jumps", False)) == having(corpus, lambda d: any("abc" < w <= "jumps" for w in words(d)))
    assert ids(index, Range("text", "b", "a")) == []
    assert ids(index, NumericRange("num", 1, 3, False)) == having(corpus, lambda d: d[3] is not None and 1 < d[3] <= 3)
    assert ids(index, Exists("tag")) == having(corpus, lambda d: d[2] is not None)
    assert ids(index, Exists("t", True)) == having(corpus, lambda d: d[2] is not None or d[1] is not None)
    assert ids(index, Exists("t", True, lambda name, prefix: name == "tag")) == ids(index, Exists("tag"))
    assert ids(index, Fuzzy("text", "abx", 1)) == having(corpus, lambda d: {"ab", "abc", "abd"} & {*words(d)})
    assert ids(index, Fuzzy("text", "abx", 1, max_terms=1)) == having(corpus, lambda d: "abd" in words(d))
    assert ids(index, Fuzzy("text", "jmups", 1, transpositions=True)) == having(corpus, lambda d: "jumps" in words(d))
    assert ids(index, Fuzzy("text", "é", 5)) == []


def test_phrases(index, corpus):
    follows = lambda d, a, b, n=1: any(x == a and y == b for x, y in zip(words(d), words(d)[n:]))
    assert ids(index, Phrase.of("text", "jumps", "high")) == having(corpus, lambda d: follows(d, "jumps", "high"))
    assert ids(index, Phrase.of("text", "jumps", "", "high")) == having(corpus, lambda d: follows(d, "jumps", "high", 2))
    assert ids(index, Phrase("text", ((0, Prefix("text", "ab")), (1, Term("text", "xyz"))))) == having(corpus, lambda d: any(x.startswith("ab") and y == "xyz" for x, y in zip(words(d), words(d)[1:])))
    assert ids(index, Phrase("text", ())) == []
    starts = {(r.doc_id, r.begin, r.end) for r in Search(index).offsets(Phrase.of("text", "jumps", "high")).collect()}
    assert starts == {(d[0], k, k + 10) for d in corpus for k in range(len(d[1] or "")) if (d[1][k : k + 10] == "jumps high") and (k == 0 or d[1][k - 1] == " ")}


def test_booleans(index, corpus):
    a, b, c = (Term("text", w) for w in ("abc", "xyz", "high"))
    has = lambda d, *w: [x in words(d) for x in w]
    assert ids(index, And((a, b))) == having(corpus, lambda d: all(has(d, "abc", "xyz")))
    assert ids(index, And((a, Not(b)))) == having(corpus, lambda d: has(d, "abc", "xyz") == [True, False])
    assert ids(index, And((Not(a), Not(b)))) == having(corpus, lambda d: not any(has(d, "abc", "xyz")))
    assert ids(index, Or((a, b, c), 2)) == having(corpus, lambda d: sum(has(d, "abc", "xyz", "high")) >= 2)
    assert ids(index, Or((a, b), 3)) == []
    assert ids(index, Or((a,), 0)) == ids(index, All())
    assert ids(index, Or((a, Not(b)))) == having(corpus, lambda d: "xyz" not in words(d))
    assert ids(index, Or((a, Not(b)), 2)) == ids(index, And((a, Not(b))))
    assert ids(index, And((a, Not(All())))) == ids(index, Or((a, Not(All())))) == []
    assert ids(index, Not()) == [] and ids(index, Not(Not(a))) == ids(index, a)
    assert ids(index, And((a, Empty()))) == [] and ids(index, And(())) == []
    assert ids(index, And((Proxy(a), b))) == ids(index, And((a, b)))
    seen = []
    visit(And((a, Or((b, Not(c))))), lambda f: seen.append(type(f).__name__))
    assert seen == ["And", "Term", "Or", "Term", "Not", "Term"]


@dataclass(frozen=True)
class Odd(Filter):
    """Documents with odd ids."""

    def plan(self, search, boost):
        return search.index.docs.filter("doc_id % 2 = 1").select("doc_id", F.lit(boost).alias("score"))


def test_custom_filter(index, corpus):
    assert ids(index, And((Odd(), Term("text", "abc"))), BM25()) == having(corpus, lambda d: d[0] % 2 and "abc" in words(d))


def test_terms(index, corpus):
    pairs = (("abc", 1.0), ("xyz", 1.0), ("high", 1.0))
    assert ids(index, Terms("text", pairs, 2)) == having(corpus, lambda d: len({"abc", "xyz", "high"} & {*words(d)}) >= 2)
    assert ids(index, Terms("text", pairs, 4)) == [] and ids(index, Terms("text", ())) == []
    assert ids(index, Terms("text", pairs, 0)) == ids(index, Terms("text", pairs, 0), BM25()) == ids(index, All())


def test_rewrites():
    assert rewrite(Wildcard("f", "a%%")) == Prefix("f", "a") and rewrite(Wildcard("f", "a")) == Term("f", "a")
    assert rewrite(Range("f", "a", "a")) == Term("f", "a") and rewrite(Range("f", "a", "a", False)) == Empty()
    assert rewrite(Fuzzy("f", "b", 0, "a")) == Term("f", "ab")
    assert rewrite(And((Term("f", "a", 2.0),), boost=3.0)) == Term("f", "a", 6.0)
    assert rewrite(Or((Term("f", "a"), Term("f", "b")), 2)) == Terms("f", (("a", 1.0), ("b", 1.0)), 2)
    assert rewrite(NGramSimilarity("f", ("a", "b"), 0.2), False) == Terms("f", (("a", 1.0), ("b", 1.0)))
    assert rewrite(NGramSimilarity("f", ("a", "b"), 1.0)) == Phrase.of("f", "a", "b")


def bm25(corpus, doc, term, k=1.2, b=0.75):
    lengths = {d[0]: len(words(d)) for d in corpus if words(d)}
    df = sum(term in words(d) for d in corpus)
    idf = math.log1p((len(lengths) - df + 0.5) / (df + 0.5))
    tf = words(doc).count(term)
    return (k + 1) * idf * tf / (k * (1 - b) + k * b * len(words(doc)) / (sum(lengths.values()) / len(lengths)) + tf) if tf else 0.0


@pytest.mark.parametrize("k,b", [(1.2, 0.75), (1.2, 0.0), (1.2, 1.0), (0.0, 0.75)])
def test_bm25(index, corpus, k, b):
    got = {r.doc_id: r.score for r in Search(index, BM25(k, b)).matches(Or((Term("text", "abc", 2.0), Term("text", "high")))).collect()}
    for d in corpus:
        want = 2 * bm25(corpus, d, "abc", k, b) + bm25(corpus, d, "high", k, b)
        assert got.get(d[0], 0.0) == pytest.approx(want)


def test_other_scores(index, corpus):
    n = sum(bool(words(d)) for d in corpus)
    df = sum("abc" in words(d) for d in corpus)
    got = {r.doc_id: r.score for r in Search(index, TFIDF(True)).matches(Term("text", "abc")).collect()}
    for d in corpus:
        if d[0] in got:
            assert got[d[0]] == pytest.approx(math.sqrt(words(d).count("abc") / len(words(d))) * math.log1p((n + 1) / (df + 1)))
    assert {r.score for r in Search(index, BoostScore()).matches(All(3.0)).collect()} == {3.0}
    assert {r.score for r in Search(index, BM25()).matches(Exists("tag")).collect()} == {0.0}
    assert make_scorer("bm25", "[1.5, 0.5]") == BM25(1.5, 0.5) and make_scorer("tfidf", '{"withNorms": true}') == TFIDF(True)
    top = Search(index, BM25()).top(Term("text", "abc"), 3).collect()
    best = sorted(((-bm25(corpus, d, "abc"), d[0]) for d in corpus))[:3]
    assert [(r.doc_id) for r in top] == [i for _, i in best]


def test_scored_limit_and_fuzzy(index):
    full = {r.doc_id: r.score for r in Search(index, BM25()).matches(Prefix("text", "ab")).collect()}
    one = {r.doc_id: r.score for r in Search(index, BM25()).matches(Prefix("text", "ab", 1)).collect()}
    assert full.keys() == one.keys() and any(v == 0 for v in one.values()) and sum(full.values()) > sum(one.values())
    near = Search(index, BM25()).matches(Fuzzy("text", "abc", 1)).collect()
    assert len(near) == len({r.doc_id for r in near})


def test_phrase_boosts(spark):
    """The mean of the matched terms' boosts over places and parts."""
    df = spark.createDataFrame([(1, "red sail"), (2, "blue sail"), (3, "red sail and blue sail"), (4, "red boat"), (5, "sail red")], "doc_id long, t string")
    index = Index.build(df, [text_field("t")])
    parts = lambda x, y: Phrase("t", ((0, Terms("t", (("red", x), ("blue", y)))), (1, Term("t", "sail"))))
    score = lambda f: {r.doc_id: r.score for r in Search(index, BM25(b=0.0)).matches(f).collect()}
    plain, boosted = score(parts(1.0, 1.0)), score(parts(3.0, 0.5))
    assert plain.keys() == boosted.keys() == {1, 2, 3}
    for doc, mean in ((1, (3 + 1) / 2), (2, (0.5 + 1) / 2), (3, (3 + 1 + 0.5 + 1) / 4)):
        assert boosted[doc] == pytest.approx(plain[doc] * mean)
    fuzzy = score(Phrase("t", ((0, Fuzzy("t", "rex", 1)), (1, Term("t", "sail")))))
    assert fuzzy.keys() == {1, 3} and fuzzy[1] == pytest.approx((2 / 3 + 1) / 2 * score(Phrase.of("t", "red", "sail"))[1])


def test_ngram_sequences(spark):
    assert longest_sequence(("a", "b", "c"), [(1, 0), (2, 1), (4, 2), (5, 0), (6, 1)]) == (3, 1)
    assert longest_sequence(("a", "b"), [(1, 0), (2, 1), (5, 0), (6, 1)]) == (2, 2)
    assert longest_sequence(("a", "b"), [(2, 1), (3, 0)]) == (1, 1)
    assert longest_sequence(("a",), []) == (0, 0)
    rng = random.Random(6)
    for _ in range(200):  # several grams at one position, repeated grams
        query = tuple(rng.choice("abc") for _ in range(rng.randint(1, 4)))
        places = sorted({(rng.randint(1, 8), k) for k in range(len(query)) for _ in range(rng.randint(0, 4))})
        longest = {(): 0}
        best = [1] * len(places)
        for i, (p, k) in enumerate(places):
            best[i] += max((best[j] for j in range(i) if places[j][0] < p and places[j][1] < k), default=0)
        assert longest_sequence(query, places)[0] == max(best, default=0)
    text = spark.createDataFrame([(1, "a x b c a b c"), (2, "c b a")], "doc_id long, t string")
    spans = Search(Index.build(text, [text_field("t", features="offs")])).offsets(NGramSimilarity("t", ("a", "b", "c"), 0.7, False))
    assert sorted(map(tuple, spans.collect())) == [(1, 0, 7), (1, 8, 13)]
    df = spark.createDataFrame([(1, ["at", "tl", "la", "as"]), (2, ["as", "la", "tl", "at"]), (3, ["at", "x", "la"])], "doc_id long, f array<string>")
    index = Index.build(df, [keyword_field("f")])
    assert ids(index, NGramSimilarity("f", ("at", "tl", "la", "as", "ll"), 0.6)) == [1]
    assert ids(index, NGramSimilarity("f", ("at", "tl", "la", "as", "ll"), 0.4)) == [1, 3]
    assert ids(index, NGramSimilarity("f", ("at", "tl", "la", "as", "ll"), 0.4), BM25()) == [1, 3]


def test_same_position(spark):
    df = spark.createDataFrame([(1, "a b", "x y"), (2, "b a", "x y")], "doc_id long, p string, q string")
    index = Index.build(df, [text_field("p"), text_field("q"), text_field("n", column="p", features="freq")])
    assert ids(index, SamePosition((("p", "a"), ("q", "x")))) == [1]
    assert ids(index, SamePosition((("p", "a"), ("q", "y")))) == [2]
    assert ids(index, SamePosition((("n", "a"), ("q", "y")))) == [] and ids(index, Phrase.of("n", "a", "b")) == []
    assert ids(index, SamePosition((("p", "a"), ("q", "y"))), BM25()) == [2]


ORDERS = [("Keyboard", 100, 1), ("Mouse", 50, 2), ("Display", 1000, 2), ("CPU", 5000, 1), ("RAM", 5000, 1), "A", ("CPU", 1000, 3), "B", ("Mouse", 10, 2), ("Display", 1000, 2), ("CPU", 1000, 2), ("RAM", 5000, 2), "C", ("Mouse", 10, 2), None, ("Stand", 10, 2), ("Display", 1000, 2), ("CPU", 1000, 2), ("RAM", 5000, 2), "D"]


def test_nested(spark):
    rows = [(k, *(x if isinstance(x, tuple) else (None, None, None)), x if isinstance(x, str) else None) for k, x in enumerate(ORDERS, 1)]
    df = spark.createDataFrame(rows, "doc_id long, item string, price int, cnt int, customer string")
    index = Index.build(df, [keyword_field("item"), keyword_field("customer")])
    children = df.filter("item is not null or customer is not null")
    relation = parent_relation(children, F.col("customer").isNotNull())
    index = index.with_relation("order", relation)
    item, count = lambda x: Term("item", x), lambda n: NumericRange("cnt", n, n)
    nested = lambda child, *a, **k: ids(index, Nested("order", child, *a, **k))
    assert nested(item("Keyboard")) == [6] and nested(item("Mouse")) == [6, 13, 20]
    assert nested(And((item("Mouse"), NumericRange("price", None, 11)))) == [13, 20]
    assert nested(count(2)) == [6, 13, 20] and nested(count(2), all_of=All()) == [13, 20]
    assert nested(count(2), 3) == [13, 20] and nested(count(1), 3) == [6] and nested(count(2), 3, 5) == [13, 20]
    assert nested(Or((count(1), count(42))), 0) == [6, 8, 13, 20] and nested(count(2), 0, 5) == [6, 8, 13, 20]
    assert nested(item("Mouse"), 0, 0) == [8] and nested(Empty(), 0, 0) == [6, 8, 13, 20]
    with pytest.raises(ValueError):
        Nested("order", All(), 2, 1)


def test_parents_in_linear_work(spark):
    rng = random.Random(5)
    rows = [(k, rng.random() < 0.02) for k in range(20_000) if k % 7]
    rng.shuffle(rows)
    relation = parent_relation(spark.createDataFrame(rows, "doc_id long, last boolean"), F.col("last"))
    expected, parent = [], None
    for k, last in sorted(rows, reverse=True):
        parent = k if last else parent
        if not last and parent is not None:
            expected.append((k, parent))
    assert sorted(map(tuple, relation.collect())) == expected[::-1]
    # a frame from the current row on is folded anew for each row
    plan = relation._jdf.queryExecution().executedPlan().toString()
    assert "Window" in plan and "unboundedfollowing" not in plan.lower()


def test_reader_surface(index, corpus):
    assert index.docs_count() == index.live_docs_count() == len(corpus)
    assert {r.field for r in index.field_names().collect()} == {"text", "tag"}
    listed = [r.term for r in index.terms("text", "b").collect()]
    assert listed == sorted(listed) and all(t >= "b" for t in listed)
    norm = {r.doc_id: r for r in index.norms.filter("field = 'text'").collect()}
    for d in corpus:
        if words(d):
            r = norm[d[0]]
            assert (r.length, r.num_unique, r.max_tf, r.num_overlap) == (len(words(d)), len(set(words(d))), max(map(words(d).count, words(d))), 0)
    assert [r.doc_id for r in index.read_documents("text", "abc", 2).collect()] == having(corpus, lambda d: "abc" in words(d))[:2]


def test_plans_push_down(index):
    plan = Search(index, BM25()).matches(Term("text", "abc"))._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(term,abc)" in plan and "CartesianProduct" not in plan and "ArrowEvalPython" not in plan


def test_empty_table(spark):
    index = Index.build(spark.createDataFrame([], "doc_id long, text string"), [text_field("text")])
    assert ids(index, Or((Term("text", "a"), Prefix("text", "b"))), BM25()) == [] and ids(index, Phrase.of("text", "a", "b"), BM25()) == []


def test_postings_are_grouped_where_the_document_lies(spark, tmp_path, monkeypatch):
    """Repeated, null and missing ids and texts, repeated fields, pieces of few tokens; no token is shuffled."""
    monkeypatch.setattr("quern.sources.invert.PIECE", 7)
    rng = random.Random(11)
    rows = [(rng.choice([None, 1, 2, 3, *range(4, 60)]), " ".join(rng.choices(["a", "b", "Ab", "é", "x" * 40_000], [8, 4, 2, 1, 0.1], k=rng.randint(0, 9))), [rng.choice("uvw") for _ in range(rng.randint(0, 3))]) for _ in range(90)]
    rows += [(100, None, None), (None, None, None), (101, "", [])]
    df = spark.createDataFrame(rows, "doc_id long, text string, many array<string>")
    for features in ("pos", "offs"):
        index = Index.build(df, [text_field("text", features=features), keyword_field("many")])
        expected, norms = {}, {}
        for doc, text, many in rows:
            words = [(t.lower(), k, *((m.start(), m.end()) if features == "offs" else (None, None))) for k, (t, m) in enumerate(((m[0], m) for m in re.finditer(r"\w+", text or "")), 1)]
            for name, tokens in (("text", words), ("many", [(t, k, 0, 1) for k, t in enumerate(many or [], 1)])):
                for t, *at in tokens:
                    if len(t) <= 32768:
                        expected.setdefault((name, t, doc, len(tokens)), []).append(tuple(at))
                        norms.setdefault((name, doc), []).append((t, at[0]))
        # the values' place in an array adds the last end to offsets
        place = lambda name, at: (at[0], None, None) if name == "many" else at
        want = sorted((*k, len(v), sorted(map(lambda at: place(k[0], at), v))) for k, v in expected.items() if k[2] is not None)
        saved = index.save(f"{tmp_path}/{features}")
        for one in (index, saved):
            found = one.postings.collect()
            assert len(found) == len(expected)
            assert want == sorted((r.field, r.term, r.doc_id, r.length, r.tf, sorted(place(r.field, x) for x in zip(r.positions, r.starts, r.ends))) for r in found if r.doc_id is not None)
            assert {(r.field, r.doc_id): (r.num_overlap) for r in one.norms.collect()} == {k: len(v) - len({p for _, p in v}) for k, v in norms.items()}
            assert {(r.field, r.term): r.df for r in one.term_dict.collect()} == Counter(k[:2] for k in expected)
        assert {(r.field, r.term, r.df) for r in saved.postings.collect()} == {(r.field, r.term, r.df) for r in saved.term_dict.collect()}
        plan = index.postings._jdf.queryExecution().executedPlan().toString()
        assert "ObjectHashAggregate" not in plan and "collect_list" not in plan
