"""The engine's own queries with their SQL equivalents.

All run over whole tables.  An index is built once per session and data folder and read from its tables after that.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quern.functions import similarity as sim
from quern.functions.analysis import Identity, NGram, StopWords, Words, make_analyzer, token_rows
from quern.operators.filters import All, And, Empty, Exists, Filter, Fuzzy, Nested, NGramSimilarity, Not, NumericRange, Or, Phrase, Prefix, Proxy, Range, SamePosition, Term, Terms, Where, Wildcard
from quern.operators.scorers import BM25, TFIDF, BoostScore, Scorer
from quern.plans.planner import Search, search_all
from quern.sources.index import FieldSpec, Index, keyword_field, text_field
from quern.sources.loaders import parent_relation
from quern.sources.policies import Tier, by_count
from quern.sources.snapshot import Reader, Writer
from quern.sources.storage import shared_path

Query = Callable[[SparkSession, str], DataFrame]
_INDEXES: dict[tuple[str, str, str], Index] = {}


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _spread(scan: DataFrame) -> DataFrame:
    """A table of few splits would be tokenized by few tasks; a large one keeps its own.  For plain scans, whose splits are
    known without running anything."""
    n = int(scan.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return scan.repartition(n) if scan.rdd.getNumPartitions() < n else scan


def _kept(spark: SparkSession, sf_dir: str, name: str, build: Callable[[], Index]) -> Index:
    key = (spark.sparkContext.applicationId, sf_dir, name)
    if key not in _INDEXES:
        _INDEXES[key] = build().save(shared_path(spark, f"index-{name}"))
    return _INDEXES[key]


def documents_index(spark: SparkSession, sf_dir: str) -> Index:
    def build() -> Index:
        labels = _table(spark, sf_dir, "labels").dropDuplicates(["doc_id"])
        index = Index.build(_table(spark, sf_dir, "documents"), [text_field("text"), keyword_field("source"), keyword_field("lang")], stored=["source", "lang", "n_chars"])
        return replace(index, docs=index.docs.join(labels.select("doc_id", "quality", "toxic"), "doc_id", "left"))

    return _kept(spark, sf_dir, "documents", build)


def offsets_index(spark: SparkSession, sf_dir: str) -> Index:
    return _kept(spark, sf_dir, "offsets", lambda: Index.build(_table(spark, sf_dir, "documents"), [text_field("text", features="offs")], stored=["source"]))


def parts_index(spark: SparkSession, sf_dir: str) -> Index:
    def build() -> Index:
        rows = _table(spark, sf_dir, "part").withColumnRenamed("p_partkey", "doc_id")
        return Index.build(rows, [text_field("p_name"), text_field("p_type"), FieldSpec("grams", NGram(3, 3, stream_type="utf8"), "p_name")])

    return _kept(spark, sf_dir, "parts", build)


def turns_index(spark: SparkSession, sf_dir: str) -> Index:
    rows = _table(spark, sf_dir, "conversations").withColumn("doc_id", F.col("conv_id") * 100000 + F.col("turn"))
    index = _kept(spark, sf_dir, "turns", lambda: Index.build(rows, [text_field("text"), keyword_field("role")], stored=["conv_id", "turn", "role"]))
    return index.with_relation("conversation", index.docs.select(F.col("doc_id").alias("child_id"), F.col("conv_id").alias("parent_id")))


def items_index(spark: SparkSession, sf_dir: str) -> Index:
    rows = _table(spark, sf_dir, "lineitem")  # line numbers repeat within an order, so all columns make the id
    rows = rows.withColumn("doc_id", F.xxhash64(*rows.columns))
    index = _kept(spark, sf_dir, "items", lambda: Index.build(rows, [keyword_field("l_returnflag")], stored=["l_orderkey", "l_quantity", "l_discount", "l_returnflag"]))
    return index.with_relation("order", index.docs.select(F.col("doc_id").alias("child_id"), F.col("l_orderkey").alias("parent_id")))


_FOUND: dict[str, tuple[Query, str | None]] = {}


def _add(name: str, query: Query, sql: str | None = None) -> None:
    _FOUND[name] = (query, sql)


# --- SQL pieces

_TOK = r"""WITH words AS (SELECT doc_id, regexp_extract_all(lower(coalesce(text, '')), '[\p{L}\p{N}]+') AS w FROM documents),
 tok AS (SELECT doc_id, unnest(w) AS term, unnest(range(1, len(w) + 1)) AS pos FROM words),
 post AS (SELECT term, doc_id, count(*) AS tf FROM tok GROUP BY ALL),
 len AS (SELECT doc_id, count(*) AS dl FROM tok GROUP BY ALL),
 fs AS (SELECT count(*) AS n, avg(dl) AS mean, sum(dl)::BIGINT AS ttf FROM len),
 dict AS (SELECT term, count(*) AS df, sum(tf)::BIGINT AS ttf FROM post GROUP BY ALL)
"""
_IDF, _IDF2 = "ln(1 + (n - df + 0.5) / (df + 0.5))", "ln(1 + (n + 1) / (df + 1))"
_BM25 = _IDF + " * 2.2 * tf / (1.2 * (0.25 + 0.75 * dl / mean) + tf)"
_FROM = "FROM post JOIN dict USING (term) JOIN len USING (doc_id) CROSS JOIN fs"


def _docs(sql: str) -> str:
    return f"{_TOK} {sql}"


def _scores(where: str, score: str = _BM25, agg: str = "sum", having: str = "") -> str:
    return f"{_TOK} SELECT doc_id, round({agg}({score}), 4) AS score {_FROM} WHERE {where} GROUP BY doc_id {having}"


def _ids(f: Filter, index: Callable[[SparkSession, str], Index] = documents_index) -> Query:
    return lambda spark, d: Search(index(spark, d)).matches(f).select("doc_id")


def _ranked(f: Filter, scorer: Scorer | None = None, index: Callable[[SparkSession, str], Index] = documents_index) -> Query:
    return lambda spark, d: Search(index(spark, d), scorer or BM25()).matches(f).select("doc_id", F.round("score", 4).alias("score"))


# --- analyzers


def _tokens(analyzer, table: str, column: str, key: str, offsets: bool = False) -> Query:
    def run(spark: SparkSession, d: DataFrame) -> DataFrame:
        rows = _table(spark, d, table)
        if analyzer.in_python(offsets):
            rows = token_rows(_spread(rows.select(F.col(key).alias("id"), column)), analyzer)
        else:
            rows = rows.select(F.col(key).alias("id"), F.inline(analyzer.tokens(F.col(column), offsets)))
        return rows.select("id", "term", "pos", *(["start", "end"] if offsets else []))

    return run


def _unnested(source: str, table: str, key: str) -> str:
    return f"SELECT id, unnest(t) AS term, unnest(range(1, len(t) + 1)) AS pos FROM (SELECT {key} AS id, {source} AS t FROM {table})"


_add("tokens_words", _tokens(Words(), "documents", "text", "doc_id"), _unnested(r"regexp_extract_all(lower(text), '[\p{L}\p{N}]+')", "documents", "doc_id"))
_add("tokens_identity", _tokens(Identity(), "part", "p_name", "p_partkey"), "SELECT p_partkey AS id, p_name AS term, 1 AS pos FROM part")
_add("tokens_delimiter", _tokens(make_analyzer("delimiter", "/"), "pages", "url", "page_id"), _unnested("string_split(url, '/')", "pages", "page_id"))
_add("tokens_multi_delimiter", _tokens(make_analyzer("multi_delimiter", {"delimiters": ["/", ".", "?"]}), "pages", "url", "page_id"), _unnested("list_filter(regexp_split_to_array(url, '[/.?]'), lambda x: x <> '')", "pages", "page_id"))
_add("tokens_ngram_utf8", _tokens(NGram(2, 3, stream_type="utf8"), "part", "p_name", "p_partkey"), "SELECT p_partkey AS id, substr(p_name, s, k) AS term, s AS pos FROM part, range(1, 200) r(s), range(2, 4) q(k) WHERE s + k - 1 <= length(p_name)")
_add("tokens_ngram_marked", _tokens(NGram(2, 3, True, "utf8", "^", "$"), "part", "p_brand", "p_partkey"), "SELECT p_partkey AS id, CASE WHEN s = 1 THEN '^' ELSE '' END || substr(p_brand, s, k) || CASE WHEN s + k - 1 = length(p_brand) THEN '$' ELSE '' END AS term, s AS pos FROM part, range(1, 200) r(s), range(2, 4) q(k) WHERE s + k - 1 <= length(p_brand) UNION ALL SELECT p_partkey, p_brand, 1 FROM part")
_add("tokens_edge_ngram", _tokens(make_analyzer("text", {"locale": "en", "stopwords": [], "stemming": False, "edgeNgram": {"min": 1, "max": 3}}), "nation", "n_name", "n_nationkey"), "SELECT n_nationkey AS id, lower(substr(n_name, 1, k)) AS term, 1 AS pos FROM nation, range(1, 4) q(k)")
_add("tokens_stopwords", _tokens(StopWords(["src1", "src2"]), "documents", "source", "doc_id"), "SELECT doc_id AS id, source AS term, 1 AS pos FROM documents WHERE source NOT IN ('src1', 'src2')")
_add("tokens_norm", _tokens(make_analyzer("norm", {"locale": "en", "case": "upper"}), "customer", "c_name", "c_custkey"), "SELECT c_custkey AS id, upper(c_name) AS term, 1 AS pos FROM customer")
_add("tokens_norm_accents", _tokens(make_analyzer("norm", {"locale": "fr", "case": "lower", "accent": False}), "documents", "text", "doc_id"), "SELECT doc_id AS id, strip_accents(lower(text)) AS term, 1 AS pos FROM documents")
_add("tokens_segmentation", _tokens(make_analyzer("segmentation", {}), "documents", "text", "doc_id", True))
_add("tokens_text", _tokens(make_analyzer("text", {"locale": "en", "stopwords": ["the", "of"]}), "documents", "text", "doc_id", True))
_add("tokens_stem", _tokens(make_analyzer("stem", {"locale": "en"}), "part", "p_name", "p_partkey"))
_add("tokens_collation", lambda spark, d: _table(spark, d, "nation").select("n_nationkey", F.row_number().over(Window.orderBy(make_analyzer("collation", {"locale": "en"}).order(F.col("n_name")))).cast("bigint").alias("place")), "SELECT n_nationkey, row_number() OVER (ORDER BY lower(n_name)) AS place FROM nation")
_add("tokens_pipeline", _tokens(make_analyzer("pipeline", {"pipeline": [{"type": "delimiter", "properties": {"delimiter": " "}}, {"type": "norm", "properties": {"locale": "en", "case": "upper"}}]}), "part", "p_type", "p_partkey"), _unnested("string_split(upper(p_type), ' ')", "part", "p_partkey"))
_add("tokens_minhash", _tokens(make_analyzer("minhash", {"numHashes": 8, "analyzer": {"type": "words"}}), "benchmark", "text", "item_id"))

# --- dictionary and statistics

_add("term_dict", lambda s, d: documents_index(s, d).term_dict.filter("field = 'text'").select("term", "df", "ttf"), _docs("SELECT term, df, ttf FROM dict"))
_add("field_stats", lambda s, d: documents_index(s, d).field_stats.filter("field = 'text'").select("n_docs", "ttf", "n_terms", "min_term", "max_term"), _docs("SELECT n AS n_docs, ttf, (SELECT count(*) FROM dict) AS n_terms, (SELECT min(term) FROM dict) AS min_term, (SELECT max(term) FROM dict) AS max_term FROM fs"))
_add("norms", lambda s, d: documents_index(s, d).norms.filter("field = 'text'").select("doc_id", "length", "max_tf", "num_unique", "num_overlap"), _docs("SELECT doc_id, dl AS length, max(tf) AS max_tf, count(*) AS num_unique, 0 AS num_overlap FROM post JOIN len USING (doc_id) GROUP BY doc_id, dl"))
_add("fields", lambda s, d: documents_index(s, d).field_names(), "SELECT unnest(['text', 'source', 'lang']) AS field")
_add("term_scan_seek", lambda s, d: documents_index(s, d).terms("text", "zz").select("term", "df"), _docs("SELECT term, df FROM dict WHERE term >= 'zz'"))
_add("terms_by_regex", lambda s, d: documents_index(s, d).matching_terms("text", "^th[a-e]+$").select("term", "df"), _docs("SELECT term, df FROM dict WHERE regexp_full_match(term, 'th[a-e]+')"))
_add("term_lookup", lambda s, d: documents_index(s, d).term("text", "the").select("term", "df", "ttf"), _docs("SELECT term, df, ttf FROM dict WHERE term = 'the'"))
_add("read_documents", lambda s, d: documents_index(s, d).read_documents("text", "the", 5), _docs("SELECT doc_id FROM post WHERE term = 'the' ORDER BY doc_id LIMIT 5"))
_add("postings_union", lambda s, d: documents_index(s, d).union_of("text", ["la", "der"]), _docs("SELECT DISTINCT doc_id FROM post WHERE term IN ('la', 'der')"))
_add("postings", lambda s, d: documents_index(s, d).postings.filter("field = 'text'").select("term", "doc_id", "tf", F.concat_ws(",", F.transform("positions", lambda p: p.cast("string"))).alias("positions")), _docs("SELECT term, doc_id, count(*) AS tf, string_agg(pos::VARCHAR, ',' ORDER BY pos) AS positions FROM tok GROUP BY term, doc_id"))
_add("column_scan", lambda s, d: documents_index(s, d).column("quality"), "SELECT d.doc_id, quality FROM documents d JOIN labels USING (doc_id) WHERE quality IS NOT NULL")
_add("primary_sort", lambda s, d: documents_index(s, d).sorted_by("source", "doc_id").select("source", "doc_id"), "SELECT source, doc_id FROM documents ORDER BY source, doc_id")
_add("top_terms", lambda s, d: documents_index(s, d).top_terms("text", 20).select("term", "df"), _docs("SELECT term, df FROM dict ORDER BY df DESC, term DESC LIMIT 20"))

# --- filters

_add("all", _ids(All()), "SELECT doc_id FROM documents")
_add("empty", _ids(Empty()), "SELECT doc_id FROM documents WHERE false")
_add("term", _ids(Term("text", "the")), _docs("SELECT doc_id FROM post WHERE term = 'the'"))
_add("term_keyword", _ids(Term("source", "src3")), "SELECT doc_id FROM documents WHERE source = 'src3'")
_add("terms", _ids(Terms("text", (("la", 1.0), ("der", 1.0), ("with", 1.0)))), _docs("SELECT DISTINCT doc_id FROM post WHERE term IN ('la', 'der', 'with')"))
_add("terms_min_match", _ids(Terms("text", (("the", 1.0), ("of", 1.0), ("with", 1.0), ("from", 1.0)), 3)), _docs("SELECT doc_id FROM post WHERE term IN ('the', 'of', 'with', 'from') GROUP BY doc_id HAVING count(*) >= 3"))
_add("terms_min0_all", _ids(Terms("text", (("the", 1.0),), 0)), "SELECT doc_id FROM documents")
_add("terms_min_over", _ids(Terms("text", (("the", 1.0), ("of", 1.0)), 3)), "SELECT doc_id FROM documents WHERE false")
_add("prefix", _ids(Prefix("text", "thonl")), _docs("SELECT DISTINCT doc_id FROM post WHERE starts_with(term, 'thonl')"))
_add("prefix_empty", _ids(Prefix("text", "")), _docs("SELECT DISTINCT doc_id FROM post"))
_add("range_incl_excl", _ids(Range("text", "thou", "thr", True, False)), _docs("SELECT DISTINCT doc_id FROM post WHERE term >= 'thou' AND term < 'thr'"))
_add("range_unbounded", _ids(Range("text", "zo", None, False)), _docs("SELECT DISTINCT doc_id FROM post WHERE term > 'zo'"))
_add("range_degenerate", _ids(Range("text", "with", "with")), _docs("SELECT doc_id FROM post WHERE term = 'with'"))
_add("range_degenerate_open", _ids(Range("text", "with", "with", True, False)), "SELECT doc_id FROM documents WHERE false")
_add("numeric_range", _ids(NumericRange("n_chars", 1000, 2000, True, False)), "SELECT doc_id FROM documents WHERE n_chars >= 1000 AND n_chars < 2000")
_add("numeric_range_items", lambda s, d: Search(items_index(s, d)).fetch(NumericRange("l_discount", 0.05, 0.07), "l_orderkey", "l_discount").select("l_orderkey", "l_discount"), "SELECT l_orderkey, l_discount FROM lineitem WHERE l_discount BETWEEN 0.05 AND 0.07")
_add("numeric_range_empty", _ids(NumericRange("n_chars", 2000, 1000)), "SELECT doc_id FROM documents WHERE false")
_add("wildcard_prefix", _ids(Wildcard("text", "withth%")), _docs("SELECT DISTINCT doc_id FROM post WHERE term LIKE 'withth%'"))
_add("wildcard_infix", _ids(Wildcard("text", "w%_st")), _docs("SELECT DISTINCT doc_id FROM post WHERE term LIKE 'w%_st'"))
_add("wildcard_escaped", _ids(Wildcard("source", r"src\_%", 8)), r"SELECT doc_id FROM documents WHERE source LIKE 'src\_%' ESCAPE '\'")
_add("wildcard_term", _ids(Wildcard("source", r"s\rc1")), "SELECT doc_id FROM documents WHERE source = 'src1'")
_add("fuzzy1", _ids(Fuzzy("text", "thon", 1)), _docs("SELECT DISTINCT doc_id FROM post WHERE levenshtein(term, 'thon') <= 1"))
_add("fuzzy2_prefix", _ids(Fuzzy("text", "nter", 2, "th")), _docs("SELECT DISTINCT doc_id FROM post WHERE starts_with(term, 'th') AND levenshtein(substr(term, 3), 'nter') <= 2"))
_add("fuzzy0", _ids(Fuzzy("text", "th", 0, "wi")), _docs("SELECT doc_id FROM post WHERE term = 'with'"))
_add("fuzzy_unsupported", _ids(Fuzzy("text", "the", 5)), "SELECT doc_id FROM documents WHERE false")
_add("fuzzy_max_terms", _ids(Fuzzy("text", "thon", 2, max_terms=10)), _docs("SELECT DISTINCT doc_id FROM post WHERE term IN (SELECT term FROM dict WHERE levenshtein(term, 'thon') <= 2 ORDER BY 1 - levenshtein(term, 'thon') / least(length(term), 4) DESC, term DESC LIMIT 10)"))
_add("fuzzy_transposition", _ids(Fuzzy("text", "wiht", 1, transpositions=True)), _docs("SELECT DISTINCT doc_id FROM post WHERE damerau_levenshtein(term, 'wiht') <= 1"))
_add("phrase_fixed", _ids(Phrase.of("text", "of", "the")), _docs("SELECT DISTINCT a.doc_id FROM tok a JOIN tok b ON a.doc_id = b.doc_id AND b.pos = a.pos + 1 WHERE a.term = 'of' AND b.term = 'the'"))
_add("phrase_gap", _ids(Phrase.of("text", "of", "", "the")), _docs("SELECT DISTINCT a.doc_id FROM tok a JOIN tok b ON a.doc_id = b.doc_id AND b.pos = a.pos + 2 WHERE a.term = 'of' AND b.term = 'the'"))
_add("phrase_prefix_part", _ids(Phrase("text", ((0, Term("text", "the")), (1, Prefix("text", "thon"))))), _docs("SELECT DISTINCT a.doc_id FROM tok a JOIN tok b ON a.doc_id = b.doc_id AND b.pos = a.pos + 1 WHERE a.term = 'the' AND starts_with(b.term, 'thon')"))
_add("phrase_wildcard_part", _ids(Phrase("text", ((0, Wildcard("text", "w_th")), (1, Terms("text", (("the", 1.0), ("a", 1.0))))))), _docs("SELECT DISTINCT a.doc_id FROM tok a JOIN tok b ON a.doc_id = b.doc_id AND b.pos = a.pos + 1 WHERE a.term LIKE 'w_th' AND b.term IN ('the', 'a')"))
_add("phrase_fuzzy_part", _ids(Phrase("text", ((0, Fuzzy("text", "thon", 1)), (1, Range("text", "of", "or"))))), _docs("SELECT DISTINCT a.doc_id FROM tok a JOIN tok b ON a.doc_id = b.doc_id AND b.pos = a.pos + 1 WHERE levenshtein(a.term, 'thon') <= 1 AND b.term BETWEEN 'of' AND 'or'"))
_add("same_position", _ids(SamePosition((("p_name", "small"), ("p_type", "medium"))), parts_index), "SELECT p_partkey AS doc_id FROM part, range(1, 50) r(k) WHERE regexp_extract_all(lower(p_name), '[a-z0-9]+')[k] = 'small' AND regexp_extract_all(lower(p_type), '[a-z0-9]+')[k] = 'medium'")
_add("same_position_one", _ids(SamePosition((("text", "the"), ("text", "the")))), _docs("SELECT doc_id FROM post WHERE term = 'the'"))
_add("ngram_terms", _ids(NGramSimilarity("text", ("la", "der", "with"), 0.3)), _docs("SELECT DISTINCT doc_id FROM post WHERE term IN ('la', 'der', 'with')"))
_add("ngram_phrase", _ids(NGramSimilarity("text", ("in", "the"), 1.0)), _docs("SELECT DISTINCT a.doc_id FROM tok a JOIN tok b ON a.doc_id = b.doc_id AND b.pos = a.pos + 1 WHERE a.term = 'in' AND b.term = 'the'"))
_add("ngram_sequence", _ids(NGramSimilarity("text", ("with", "from", "was"), 0.6, False)), _docs("SELECT doc_id FROM (SELECT doc_id, list_min(list(pos) FILTER (term = 'with')) AS a, max(pos) FILTER (term = 'was') AS c, max(pos) FILTER (term = 'from') AS b, min(pos) FILTER (term = 'from') AS b0 FROM tok WHERE term IN ('with', 'from', 'was') GROUP BY doc_id) WHERE a < b OR b0 < c OR a < c"))
_add("exists", _ids(Exists("quality")), "SELECT d.doc_id FROM documents d JOIN labels USING (doc_id) WHERE quality IS NOT NULL")
_add("exists_prefix", _ids(Exists("to", True)), "SELECT d.doc_id FROM documents d JOIN labels USING (doc_id) WHERE toxic IS NOT NULL")
_add("where", _ids(Where("n_chars % 2 = 0 AND quality = 1")), "SELECT d.doc_id FROM documents d JOIN labels USING (doc_id) WHERE n_chars % 2 = 0 AND quality = 1")
_HAS = "EXISTS (SELECT 1 FROM post p WHERE p.doc_id = d.doc_id AND p.term = '{}')"
_A, _B, _C = (_HAS.format(t) for t in ("the", "la", "with"))
_T = lambda *words: tuple(Term("text", w) for w in words)
_add("and", _ids(And(_T("the", "with"))), _docs(f"SELECT doc_id FROM documents d WHERE {_A} AND {_C}"))
_add("and_mixed", _ids(And((Term("text", "with"), NumericRange("n_chars", 0, 2000), Prefix("text", "thon")))), _docs(f"SELECT doc_id FROM documents d WHERE {_C} AND n_chars BETWEEN 0 AND 2000 AND EXISTS (SELECT 1 FROM post p WHERE p.doc_id = d.doc_id AND starts_with(p.term, 'thon'))"))
_add("and_not", _ids(And((Term("text", "the"), Not(Term("text", "with"))))), _docs(f"SELECT doc_id FROM documents d WHERE {_A} AND NOT {_C}"))
_add("and_only_not", _ids(And((Not(Term("text", "the")), Not(Term("text", "la"))))), _docs(f"SELECT doc_id FROM documents d WHERE NOT {_A} AND NOT {_B}"))
_add("or", _ids(Or(_T("the", "la"))), _docs(f"SELECT doc_id FROM documents d WHERE {_A} OR {_B}"))
_add("or_min_match", _ids(Or((Term("text", "the"), Term("text", "with"), NumericRange("n_chars", 2000, None)), 2)), _docs(f"SELECT doc_id FROM documents d WHERE {_A}::INT + {_C}::INT + (n_chars >= 2000)::INT >= 2"))
_add("or_min0_all", _ids(Or(_T("the", "la"), 0)), "SELECT doc_id FROM documents")
_add("not", _ids(Not(Term("text", "the"))), _docs(f"SELECT doc_id FROM documents d WHERE NOT {_A}"))
_add("not_not", _ids(Not(Not(Term("text", "the")))), _docs(f"SELECT doc_id FROM documents d WHERE {_A}"))
_add("or_not_quirk", _ids(Or((Term("text", "the"), Not(Term("text", "with"))))), _docs(f"SELECT doc_id FROM documents d WHERE NOT {_C}"))
_add("proxy", _ids(And((Proxy(Prefix("text", "thon")), Term("text", "with")))), _docs(f"SELECT doc_id FROM documents d WHERE {_C} AND EXISTS (SELECT 1 FROM post p WHERE p.doc_id = d.doc_id AND starts_with(p.term, 'thon'))"))

# --- nested

_CT = "count(*) FILTER (regexp_matches(lower(text), '(^|[^\\p{L}\\p{N}])with($|[^\\p{L}\\p{N}])'))"


def _turns(f: Nested) -> Query:
    return _ids(f, turns_index)


_WITH = Term("text", "with")
_add("nested_any", _turns(Nested("conversation", _WITH)), f"SELECT conv_id AS doc_id FROM conversations GROUP BY 1 HAVING {_CT} >= 1")
_add("nested_none", _turns(Nested("conversation", _WITH, 0, 0)), f"SELECT conv_id AS doc_id FROM conversations GROUP BY 1 HAVING {_CT} = 0")
_add("nested_min", _turns(Nested("conversation", _WITH, 2)), f"SELECT conv_id AS doc_id FROM conversations GROUP BY 1 HAVING {_CT} >= 2")
_add("nested_range", _turns(Nested("conversation", _WITH, 1, 2)), f"SELECT conv_id AS doc_id FROM conversations GROUP BY 1 HAVING {_CT} BETWEEN 1 AND 2")
_add("nested_min0", _turns(Nested("conversation", _WITH, 0, 1)), f"SELECT conv_id AS doc_id FROM conversations GROUP BY 1 HAVING {_CT} <= 1")
_add("nested_all", _ids(Nested("order", NumericRange("l_quantity", 5, None), all_of=All()), items_index), "SELECT l_orderkey AS doc_id FROM lineitem GROUP BY 1 HAVING count(*) FILTER (l_quantity >= 5) = count(*)")
_add("nested_orders", _ids(Nested("order", And((NumericRange("l_quantity", 30, None), Term("l_returnflag", "R"))), 3), items_index), "SELECT l_orderkey AS doc_id FROM lineitem WHERE l_quantity >= 30 AND l_returnflag = 'R' GROUP BY 1 HAVING count(*) >= 3")
for _m in ("sum", "max", "min"):
    _add(f"nested_score_{_m}", _ranked(Nested("order", Term("l_returnflag", "R"), merge=_m), BoostScore(), items_index), f"SELECT l_orderkey AS doc_id, round({_m}(1.0::DOUBLE), 4) AS score FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1")
_add("nested_score_none", _ranked(Nested("order", Term("l_returnflag", "R"), merge="none", boost=2.0), BM25(), items_index), "SELECT DISTINCT l_orderkey AS doc_id, 2.0::DOUBLE AS score FROM lineitem WHERE l_returnflag = 'R'")
_add("parent_relation", lambda s, d: parent_relation(_table(s, d, "events").select("event_id", "event_type"), F.col("event_type") == "purchase", "event_id"), "SELECT event_id AS child_id, parent_id FROM (SELECT event_id, event_type, min(CASE WHEN event_type = 'purchase' THEN event_id END) OVER (ORDER BY event_id ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS parent_id FROM events) WHERE event_type <> 'purchase' AND parent_id IS NOT NULL")

# --- scores

_WITH_SCORES = _scores("term = 'with'")
_OR = Or(_T("with", "from", "la"))
_IN = "term IN ('with', 'from', 'la')"
_add("bm25_term", _ranked(Term("text", "with")), _scores("term = 'with'"))
_add("bm25_or", _ranked(_OR), _scores(_IN))
_add("bm25_and", _ranked(And(_T("with", "from"))), _scores("term IN ('with', 'from')", having="HAVING count(*) = 2"))
_add("bm25_boosted", _ranked(Or((Term("text", "with", 2.5), Term("text", "from")))), _scores("term IN ('with', 'from')", f"(CASE term WHEN 'with' THEN 2.5 ELSE 1 END) * {_BM25}"))
_add("bm15", _ranked(_OR, BM25(b=0.0)), _scores(_IN, f"{_IDF} * 2.2 * tf / (1.2 + tf)"))
_add("bm11", _ranked(_OR, BM25(b=1.0)), _scores(_IN, f"{_IDF} * 2.2 * tf / (1.2 * dl / mean + tf)"))
_add("bm1", _ranked(_OR, BM25(k=0.0)), _scores(_IN, _IDF))
_add("bm25_legacy_norm", _ranked(_OR, BM25(legacy_norm=True)), _scores(_IN, f"{_IDF} * 2.2 * sqrt(tf) / (1.2 * (0.25 + 0.75 * sqrt(dl) / mean) + sqrt(tf))"))
_add("tfidf", _ranked(_OR, TFIDF()), _scores(_IN, f"{_IDF2} * sqrt(tf)"))
_add("tfidf_norms", _ranked(_OR, TFIDF(True)), _scores(_IN, f"{_IDF2} * sqrt(tf) / sqrt(dl)"))
_add("boost_score", _ranked(Or((Term("text", "with", 2.5), Term("text", "from"))), BoostScore()), _scores("term IN ('with', 'from')", "CASE term WHEN 'with' THEN 2.5::DOUBLE ELSE 1 END"))
_add("merge_max", _ranked(Or(_T("with", "from", "la"), merge="max")), _scores(_IN, agg="max"))
_add("merge_min", _ranked(Or(_T("with", "from", "la"), merge="min")), _scores(_IN, agg="min"))
_add("bm25_prefix", _ranked(Prefix("text", "thonl")), _scores("starts_with(term, 'thonl')"))
_add("prefix_scored_limit", _ranked(Prefix("text", "thon", 5)), _scores("starts_with(term, 'thon')", f"CASE WHEN term IN (SELECT term FROM dict WHERE starts_with(term, 'thon') ORDER BY df DESC, term DESC LIMIT 5) THEN {_BM25} ELSE 0 END"))
_PH = "hit AS (SELECT a.doc_id, count(*) AS tf FROM tok a JOIN tok b ON a.doc_id = b.doc_id AND b.pos = a.pos + 1 WHERE a.term = 'of' AND b.term = 'the' GROUP BY 1)"
_PI = f"idf AS (SELECT sum({_IDF}) AS idf FROM dict, fs WHERE term IN ('of', 'the'))"
_add("bm25_phrase", _ranked(Phrase.of("text", "of", "the")), f"{_TOK}, {_PH}, {_PI} SELECT doc_id, round(idf * 2.2 * tf / (1.2 * (0.25 + 0.75 * dl / mean) + tf), 4) AS score FROM hit JOIN len USING (doc_id), idf, fs")
_FZ = "near AS (SELECT term, df, 1 - levenshtein(term, 'thon') / least(length(term), 4) AS s FROM dict WHERE levenshtein(term, 'thon') <= 1), shared AS (SELECT sum(df) AS df FROM near)"
_add("fuzzy_scored", _ranked(Fuzzy("text", "thon", 1)), f"{_TOK}, {_FZ} SELECT doc_id, round(max(s * ln(1 + (n - shared.df + 0.5) / (shared.df + 0.5)) * 2.2 * tf / (1.2 * (0.25 + 0.75 * dl / mean) + tf)), 4) AS score FROM post JOIN near USING (term) JOIN len USING (doc_id), shared, fs GROUP BY doc_id")
_add("topk", lambda s, d: Search(documents_index(s, d), BM25()).top(_OR, 10, 4), f"{_scores(_IN)} ORDER BY score DESC, doc_id LIMIT 10")
_add("multi_scorer", lambda s, d: search_all(documents_index(s, d), _OR, [BM25(), TFIDF()]).select("doc_id", F.round(F.col("scores")[0], 4).alias("bm25"), F.round(F.col("scores")[1], 4).alias("tfidf")), f"{_TOK} SELECT doc_id, round(sum({_BM25}), 4) AS bm25, round(sum({_IDF2} * sqrt(tf)), 4) AS tfidf {_FROM} WHERE {_IN} GROUP BY doc_id")
_add("fetch_stored", lambda s, d: Search(documents_index(s, d), BM25()).fetch(Term("text", "with"), "source", "n_chars").select("doc_id", "source", "n_chars", F.round("score", 4).alias("score")), f"WITH s AS ({_WITH_SCORES}) SELECT doc_id, source, n_chars, score FROM s JOIN documents USING (doc_id)")
_AT = r"""WITH cut AS (SELECT doc_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS w, regexp_split_to_array(lower(text), '[\p{L}\p{N}]+') AS gap FROM documents),
 each AS (SELECT doc_id, unnest(range(1, len(w) + 1)) AS pos, unnest(w) AS term, unnest(gap[1:len(w)]) AS gap FROM cut),
 spot AS (SELECT doc_id, pos, term, (sum(length(gap) + length(term)) OVER (PARTITION BY doc_id ORDER BY pos))::INT AS "end" FROM each)
"""
_add("offsets_term", lambda s, d: Search(offsets_index(s, d)).offsets(Term("text", "with")), f"""{_AT} SELECT doc_id, "end" - 4 AS begin, "end" FROM spot WHERE term = 'with'""")
_add("offsets_phrase", lambda s, d: Search(offsets_index(s, d)).offsets(Phrase.of("text", "of", "the")), f"""{_AT} SELECT a.doc_id, a."end" - 2 AS begin, b."end" AS "end" FROM spot a JOIN spot b ON a.doc_id = b.doc_id AND b.pos = a.pos + 1 WHERE a.term = 'of' AND b.term = 'the'""")
_add("phrase_rare", _ranked(Phrase.of("text", "the", "thed")), f"{_TOK}, {_PH.replace("'of'", "'the'", 1).replace("b.term = 'the'", "b.term = 'thed'")}, {_PI.replace("'of', 'the'", "'the', 'thed'")} SELECT doc_id, round(idf * 2.2 * tf / (1.2 * (0.25 + 0.75 * dl / mean) + tf), 4) AS score FROM hit JOIN len USING (doc_id), idf, fs")
_VAR = Phrase("text", ((0, Terms("text", (("of", 2.0), ("in", 0.5)))), (1, Term("text", "the"))))
_VH = "hit AS (SELECT a.doc_id, count(*) AS tf, avg((CASE a.term WHEN 'of' THEN 2.0 ELSE 0.5 END + 1) / 2)::DOUBLE AS boost FROM tok a JOIN tok b ON a.doc_id = b.doc_id AND b.pos = a.pos + 1 WHERE a.term IN ('of', 'in') AND b.term = 'the' GROUP BY 1)"
_add("phrase_boosted", _ranked(_VAR), f"{_TOK}, {_VH}, {_PI.replace("'of', 'the'", "'of', 'in', 'the'")} SELECT doc_id, round(boost * idf * 2.2 * tf / (1.2 * (0.25 + 0.75 * dl / mean) + tf), 4) AS score FROM hit JOIN len USING (doc_id), idf, fs")
_add("fuzzy_scored_limit", _ranked(Fuzzy("text", "thon", 2, max_terms=10)), f"{_TOK}, near AS (SELECT term, df, 1 - levenshtein(term, 'thon') / least(length(term), 4) AS s FROM dict WHERE levenshtein(term, 'thon') <= 2 ORDER BY s DESC, term DESC LIMIT 10), shared AS (SELECT sum(df) AS df FROM near) SELECT doc_id, round(max(s * ln(1 + (n - shared.df + 0.5) / (shared.df + 0.5)) * 2.2 * tf / (1.2 * (0.25 + 0.75 * dl / mean) + tf)), 4) AS score FROM post JOIN near USING (term) JOIN len USING (doc_id), shared, fs GROUP BY doc_id")

# --- life cycle


def _writer(spark: SparkSession) -> Writer:
    return Writer(spark, shared_path(spark, "life"), [text_field("text")])


def _after(spark: SparkSession, w: Writer) -> DataFrame:
    w.close()
    return Reader.open(spark, w.root, tuple(w.fields)).index.live_docs().select(F.col("original").alias("doc_id"))


def _life(change: Callable[[SparkSession, DataFrame, Writer], None]) -> Query:
    def run(spark: SparkSession, d: str) -> DataFrame:
        docs = _table(spark, d, "documents").select(F.col("doc_id").alias("original"), "text")
        w = _writer(spark)
        w.insert(docs)
        w.commit()
        change(spark, docs, w)
        return _after(spark, w)

    return run


def _scored(f: Filter, remove: Filter | None = None) -> Query:
    """Scores over a committed index of two segments; removed documents still count in its statistics, until a merge drops them."""

    def run(spark: SparkSession, d: str) -> DataFrame:
        docs = _table(spark, d, "documents").select(F.col("doc_id").alias("original"), "text")
        w = _writer(spark)
        w.insert(docs.filter("original % 2 = 0")).insert(docs.filter("original % 2 = 1"))
        w.commit()
        if remove is not None:
            w.remove(remove)
            w.commit()
        w.close()
        found = Search(Reader.open(spark, w.root, tuple(w.fields)).index, BM25()).fetch(f, "original")
        return found.select(F.col("original").alias("doc_id"), F.round("score", 4).alias("score"))

    return run


def _delete(spark: SparkSession, docs: DataFrame, w: Writer) -> None:
    w.remove(Term("text", "with")).insert(docs.filter("original < 10"))
    w.commit()


def _replace(spark: SparkSession, docs: DataFrame, w: Writer) -> None:
    w.replace(Term("text", "with"), docs.filter("original = 1")).replace(Term("text", "no such term"), docs.filter("original = 2"))
    w.commit()


def _consolidate(spark: SparkSession, docs: DataFrame, w: Writer) -> None:
    w.insert(docs.filter("original % 3 = 0"))
    w.commit()
    w.remove(Term("text", "la"))
    w.commit()
    w.consolidate(Tier(1, 10)) or w.consolidate(by_count(10))
    w.clean()


_add("delete_by_filter", _life(_delete), _docs(f"SELECT doc_id FROM documents d WHERE NOT {_C} UNION ALL SELECT doc_id FROM documents WHERE doc_id < 10"))
_add("replace_by_filter", _life(_replace), _docs(f"SELECT doc_id FROM documents d WHERE NOT {_C} UNION ALL SELECT doc_id FROM documents WHERE doc_id = 1"))
_add("consolidate_tier", _life(_consolidate), _docs(f"SELECT doc_id FROM documents d WHERE NOT {_B} UNION ALL SELECT doc_id FROM documents d WHERE NOT {_B} AND doc_id % 3 = 0"))

_add("bm25_committed", _scored(_OR), _scores(_IN))
_add("bm25_after_delete", _scored(_OR, Term("text", "la")), f"{_scores(_IN)} HAVING count(*) FILTER (term = 'la') = 0")

# --- scalar functions

_PAIRS = "SELECT a.n_nationkey AS a, b.n_nationkey AS b, {} FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey"


def _pairs(**columns: Callable[..., object]) -> Query:
    def run(spark: SparkSession, d: str) -> DataFrame:
        n = _table(spark, d, "nation")
        a, b = n.select(F.col("n_nationkey").alias("a"), F.col("n_name").alias("x"), "n_regionkey"), n.select(F.col("n_nationkey").alias("b"), F.col("n_name").alias("y"), "n_regionkey")
        return a.join(b, "n_regionkey").select("a", "b", *[f(F.col("x"), F.col("y")).alias(k) for k, f in columns.items()])

    return run


_add("edit_distance", _pairs(distance=sim.edit_distance), _PAIRS.format("levenshtein(a.n_name, b.n_name)::INT AS distance"))
_add("bounded_edit_distance", _pairs(distance=lambda x, y: sim.bounded_edit_distance(x, y, 4)), _PAIRS.format("CASE WHEN levenshtein(a.n_name, b.n_name) <= 4 THEN levenshtein(a.n_name, b.n_name) ELSE -1 END::INT AS distance"))
_add("ngram_similarity", _pairs(similarity=lambda x, y: F.round(sim.ngram_similarity(x, y, 2), 4), search=lambda x, y: F.round(sim.ngram_similarity(x, y, 2, True), 4)))
_add("minhash_jaccard", lambda s, d: _jaccard(s, d))


def _jaccard(spark: SparkSession, d: str) -> DataFrame:
    """Each benchmark passage against each: the query set is the table itself, whose size doesn't follow the corpus."""
    rows = _table(spark, d, "benchmark").select("item_id", sim.minhash(F.transform(Words().tokens(F.col("text")), lambda t: t["term"]), 64).alias("s"))
    shared = rows.select("item_id", F.explode("s").alias("h"))
    pairs = shared.join(shared.withColumnRenamed("item_id", "other"), "h").groupBy("item_id", "other").agg(F.count("*").alias("both")).filter("item_id < other")
    sizes = rows.select("item_id", F.size("s").alias("n"))
    return pairs.join(sizes, "item_id").join(sizes.select(F.col("item_id").alias("other"), F.col("n").alias("m")), "other").select("item_id", "other", F.round(F.col("both") / (F.col("n") + F.col("m") - F.col("both")), 4).alias("jaccard"))


QUERIES: dict[str, Query] = {name: q for name, (q, _) in _FOUND.items()}
ORACLE_SQL: dict[str, str] = {name: sql for name, (_, sql) in _FOUND.items() if sql}
