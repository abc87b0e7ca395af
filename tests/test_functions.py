import math
import random

import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quern.functions import analysis
from quern.functions import similarity as sim
from quern.functions.analysis import MinHash, NGram, Pipeline, Text, Words, make_analyzer, normalize, register_analyzer, segments
from quern.functions.stemming import stem_english
from quern.functions.wildcards import PREFIX, TERM, WILDCARD, classify, literal_prefix, to_regex


def terms(a, text):
    return [t for t, *_ in a.raw(text)]


@pytest.mark.parametrize(
    "word,stem",
    [("running", "run"), ("foxes", "fox"), ("consistently", "consist"), ("knightly", "knight"), ("generously", "generous"), ("hopping", "hop"), ("hoping", "hope"), ("relational", "relat"), ("skies", "sky"), ("ties", "tie"), ("dying", "die"), ("by", "by"), ("happy", "happi"), ("agreed", "agre"), ("adjustment", "adjust"), ("rate", "rate"), ("probate", "probat"), ("controll", "control")],
)
def test_stems(word, stem):
    assert stem_english(word) == stem


def test_wildcards():
    import re

    assert classify("abc") == (TERM, "abc")
    assert classify(r"a\%b%") == (PREFIX, "a%b")
    assert classify("a%b")[0] == WILDCARD
    assert classify("a\\") == (TERM, "a")
    assert classify("") == (TERM, "")
    assert literal_prefix(r"a\_b_c") == "a_b"
    for pattern, yes, no in (("x_z", ["xyz", "xéz"], ["xz", "xyyz"]), ("%yz", ["yz", "xyz"], ["yzx"]), (r"x\_z", ["x_z"], ["xyz"]), ("a.c", ["a.c"], ["abc"])):
        assert all(re.search(to_regex(pattern), x) for x in yes) and not any(re.search(to_regex(pattern), x) for x in no)


def test_delimiters():
    assert terms(make_analyzer("delimiter", ","), 'a,"b,c","d""e",,"x') == ["a", "b,c", 'd"e', "", '"x']
    assert terms(make_analyzer("delimiter", {"delimiter": ""}), "abc") == ["a", "b", "c"]
    assert terms(make_analyzer("multi_delimiter", {"delimiters": [";", "::"]}), ";a::b;;c") == ["a", "b", "c"]
    assert terms(make_analyzer("multi_delimiter", {"delimiters": []}), "a b") == ["a b"]
    with pytest.raises(ValueError):
        make_analyzer("multi_delimiter", {"delimiters": ["a", "ab"]})
    with pytest.raises(ValueError):
        make_analyzer("delimiter", {})


def test_ngrams():
    assert [(t, s) for t, s, *_ in NGram(2, 3, stream_type="utf8").raw("qué")] == [("qu", 1), ("qué", 0), ("ué", 1)]
    assert terms(NGram(1, 2, True, "utf8"), "abc") == ["a", "ab", "abc", "b", "bc", "c"]
    assert terms(NGram(2, 2, False, "utf8", "^", "$"), "ab") == ["^ab", "ab$"]
    assert NGram(0, 0).min == NGram(0, 0).max == 1


def test_text_analyzer():
    raw = Text(stopwords=[]).raw(" A  hErd of   quIck brown  foXes ran")
    assert [(t, a, b) for t, _, a, b in raw] == [("a", 1, 2), ("herd", 4, 8), ("of", 9, 11), ("quick", 14, 19), ("brown", 20, 25), ("fox", 27, 32), ("ran", 33, 36)]
    assert terms(Text(stopwords=["of"], stemming=False), "Père of Foxes") == ["pere", "foxes"]
    assert terms(Text(stopwords=[], stemming=False, edge_ngram={"min": 1, "max": 2, "preserveOriginal": True}), "quick") == ["q", "qu", "quick"]
    assert [s for s, *_ in segments("1,24 prosenttia") if s != " "] == ["1,24", "prosenttia"]
    with pytest.raises(ValueError):
        make_analyzer("text", {"locale": "en", "stopwords": [], "edgeNgram": {"min": 3, "max": 2}})


def test_stopword_files(tmp_path):
    (tmp_path / "en").mkdir()
    (tmp_path / "en" / "words.txt").write_text("the a comment\n  ignored\nof\n\n")
    a = make_analyzer("text", {"locale": "en_US", "stopwordsPath": str(tmp_path), "stemming": False})
    assert terms(a, "the ignored of word") == ["ignored", "word"]


def test_pipeline_positions():
    p = make_analyzer("pipeline", {"pipeline": [{"type": "delimiter", "properties": {"delimiter": " "}}, {"type": "stopwords", "properties": {"stopwords": ["b"]}}, {"type": "ngram", "properties": {"min": 1, "max": 2, "preserveOriginal": False, "streamType": "utf8"}}]})
    assert isinstance(p, Pipeline)
    from quern.functions.analysis import placed

    assert [(x["term"], x["pos"]) for x in placed(p.raw("ab b c"))] == [("a", 1), ("ab", 1), ("b", 2), ("c", 4)]
    assert normalize("pipeline", {"pipeline": [{"type": "stem", "properties": {"locale": "en"}}]}) == '{"stages": [{"locale": "en", "type": "stem"}], "type": "pipeline"}'


def test_columns_agree_with_raw(spark):
    df = spark.createDataFrame([("Été a,b c2; d",), ("",), (None,), ('q,"x,y"',)], "t string").cache()
    for a in (Words(), make_analyzer("delimiter", ","), NGram(2, 3, stream_type="utf8"), make_analyzer("norm", {"locale": "fr", "case": "upper", "accent": False}), make_analyzer("multi_delimiter", {"delimiters": [",", ";"]})):
        for row in df.select("t", a.tokens(F.col("t")).alias("k")).collect():
            assert [x["term"] for x in row.k] == ([] if row.t is None else terms(a, row.t)), (a, row)
    words = df.select(Words().tokens(F.col("t"), True).alias("k")).first().k
    assert [(x["start"], x["end"]) for x in words] == [(0, 3), (4, 5), (6, 7), (8, 10), (12, 13)]


def test_model_analyzers_and_registry():
    a = make_analyzer("classification", {"model": lambda t: [("x", 0.9), ("y", 0.2)], "top_k": 2, "threshold": 0.5})
    assert terms(a, "any") == ["x"]
    n = make_analyzer("nearest_neighbors", {"vectors": {"a": [1, 0], "b": [0.9, 0.1], "c": [0, 1]}, "top_k": 1})
    assert terms(n, "a z c") == ["b", "b"]
    register_analyzer("shout", lambda p: make_analyzer("norm", {"locale": "en", "case": "upper"}))
    assert terms(make_analyzer("shout"), "a") == ["A"]
    with pytest.raises(ValueError):
        make_analyzer("no such")
    with pytest.raises(ValueError):
        MinHash(0)


def test_minhash(spark):
    row = spark.sql("SELECT array('a','b','c') x, array('b','c','d') y, cast(array() AS array<string>) z").select(sim.minhash_jaccard(sim.minhash(F.col("x"), 10), sim.minhash(F.col("y"), 10)).alias("j"), sim.minhash_jaccard(sim.minhash(F.col("z"), 3), sim.minhash(F.col("z"), 3)).alias("e")).first()
    assert row.j == 0.5 and row.e == 1.0
    assert sim.minhash_size(0.1) == 100 and sim.minhash_error(100) == 0.1 and sim.minhash_error(0) == math.inf
    tokens = spark.sql("SELECT 'a b a' t").select(make_analyzer("minhash", {"numHashes": 5, "analyzer": {"type": "words"}}).tokens(F.col("t")).alias("k")).first().k
    assert len(tokens) == 2 and all(len(t["term"]) == 11 for t in tokens)


def _slow_damerau(a, b):
    d = {(i, j): i or j for i in range(len(a) + 1) for j in range(len(b) + 1) if not i or not j}
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            d[i, j] = min(d[i - 1, j] + 1, d[i, j - 1] + 1, d[i - 1, j - 1] + (a[i - 1] != b[j - 1]))
            if i > 1 and j > 1 and a[i - 1] == b[j - 2] and a[i - 2] == b[j - 1]:
                d[i, j] = min(d[i, j], d[i - 2, j - 2] + 1)
    return d[len(a), len(b)]


@given(st.text("abc", max_size=7), st.text("abc", max_size=7), st.integers(0, 4))
@settings(max_examples=200, deadline=None)
def test_damerau(a, b, k):
    d = _slow_damerau(a, b)
    assert sim.damerau_distance(a, b, k) == (d if d <= k else -1)


def test_ngram_similarity():
    assert sim.ngram_score("", "", 2, False) == 1.0
    assert sim.ngram_score("abcd", "abcd", 2, True) == 1.0
    assert sim.ngram_score("abcd", "xxab", 2, True) == pytest.approx(1 / 3)
    assert sim.ngram_score("abc", "abd", 2, False) == sim.ngram_score("abd", "abc", 2, False) == pytest.approx(0.75)


def test_token_columns_are_what_raw_gives(spark, monkeypatch):
    rng = random.Random(8)
    signs = [*" \t\n aAbz09'.,:;_-\"", "é", "’", "ß", "İ", "²", "中", "カ", "ﾞ", "א", "👨", "🏽", "🇩", "\u0301", "\u200d", "\u3000", "can't", "l'eau", "3.5"]
    texts = ["".join(rng.choice(signs) for _ in range(rng.randint(0, 16))) for _ in range(2000)] + [None, "", "the running dogs' 'own"]
    analyzers = [make_analyzer("segmentation", {}), make_analyzer("text", {"locale": "en", "stopwords": ["a", "the"]}), make_analyzer("text", {"locale": "en", "stopwords": [], "edgeNgram": {"min": 1, "max": 3, "preserveOriginal": True}}), Words(), make_analyzer("stem", {"locale": "en"})]
    monkeypatch.setattr(analysis, "PIECE", 50)
    for a in analyzers:
        pieces = [(counts, [c.to_pylist() for c in columns]) for counts, *columns in analysis.token_columns(a, pa.array(texts))]
        assert max(sum(counts) for counts, _ in pieces) < 50 + 60  # a piece ends with the text that fills it
        rows, counts = [t for _, columns in pieces for t in zip(*columns)], [n for counts, _ in pieces for n in counts]
        expected = [analysis.placed(a.raw(t)) if t is not None else [] for t in texts]
        assert counts == list(map(len, expected))
        assert rows == [tuple(t.values()) for x in expected for t in x]
    rows = spark.createDataFrame([(k, t) for k, t in enumerate(texts[-200:])], "id int, text string")
    assert sorted(map(tuple, analysis.token_rows(rows, analyzers[1]).collect())) == sorted((k, *t.values()) for k, x in enumerate(texts[-200:]) if x is not None for t in analysis.placed(analyzers[1].raw(x)))
    in_column = rows.select("id", F.inline(analyzers[1].tokens(F.col("text"), True)))
    assert sorted(map(tuple, in_column.collect())) == sorted(map(tuple, analysis.token_rows(rows, analyzers[1]).collect()))


def test_a_word_is_stemmed_once(monkeypatch):
    seen = []
    monkeypatch.setattr(analysis, "stem_english", lambda w: seen.append(w) or w)
    list(analysis.token_columns(make_analyzer("text", {"locale": "en", "stopwords": []}), pa.array(["running dogs ran running"] * 50)))
    assert sorted(seen) == ["dogs", "ran", "running"]
