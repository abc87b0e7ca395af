"""The inverted index as tables.

docs       doc_id and the stored columns
postings   field, term, doc_id, tf, length (the document's tokens in the field), positions, starts, ends
term_dict  field, term, df, ttf
norms      field, doc_id, length, num_overlap, max_tf, num_unique
field_stats  field, n_docs, ttf, n_terms, min_term, max_term

A posting carries its document's length, so scoring joins nothing of the corpus' size.  Saved postings and dictionary are range-partitioned and
sorted by (field, term), so row-group statistics leave the files of other terms unread.  A saved posting also carries its term's df (one run
of equal values per term, which costs next to nothing), so named terms are scored from one scan without the dictionary.
"""

from __future__ import annotations

from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quern.functions.analysis import TOKENS, Analyzer, Identity, Words
from quern.sources.files import Files
from quern.sources.invert import grouped

#: A longer term is left out; its position stays taken.
MAX_TERM_BYTES = 32768
TABLES = ("docs", "postings", "term_dict", "norms", "field_stats")


@dataclass(frozen=True)
class FieldSpec:
    """An indexed field: its source column (the name by default) and its analyzer.  ``features``: none, freq, pos or offs; filters that
    need more than a field has match nothing there."""

    name: str
    analyzer: Analyzer = field(default_factory=Words)
    column: str | None = None
    features: str = "pos"

    def has(self, feature: str) -> bool:
        order = ("none", "freq", "pos", "offs")
        return order.index(self.features) >= order.index(feature)


def text_field(name: str, **more: object) -> FieldSpec:
    return FieldSpec(name, Words(), **more)


def keyword_field(name: str, **more: object) -> FieldSpec:
    return FieldSpec(name, Identity(), **more)


def _tokens(df: DataFrame, source: str, spec: FieldSpec) -> Column:
    """Several values of one field follow each other's positions, and offsets shift by the last end."""
    if not isinstance(df.schema[source].dataType, T.ArrayType):
        return spec.analyzer.tokens(F.col(source).cast("string"), spec.has("offs"))
    each = F.transform(F.coalesce(F.col(source), F.array()), lambda v: spec.analyzer.tokens(v.cast("string"), False)) if isinstance(spec.analyzer, (Identity, Words)) else None
    if each is None:
        raise ValueError("arrays take the identity and words analyzers; explode them for others")
    return F.aggregate(each, F.expr(f"cast(array() as {TOKENS})"), lambda acc, more: F.concat(acc, F.transform(more, lambda t: F.struct(t["term"].alias("term"), (t["pos"] + F.coalesce(F.element_at(F.when(F.size(acc) > 0, acc), -1)["pos"], F.lit(0))).alias("pos"), t["start"].alias("start"), t["end"].alias("end")))))


def _values(df: DataFrame, source: str, spec: FieldSpec) -> tuple[Column, Analyzer | None]:
    """What ``grouped`` takes: terms at following positions where that says all, texts for an analyzer that runs in Python, or tokens."""
    if not isinstance(df.schema[source].dataType, T.ArrayType):
        if spec.analyzer.in_python(spec.has("offs")):
            return F.col(source).cast("string"), spec.analyzer
        if isinstance(spec.analyzer, Words):
            return spec.analyzer.words(F.col(source).cast("string")), None
    return _tokens(df, source, spec), None


def _whole(rows: DataFrame) -> DataFrame:
    """Rows of ``grouped`` as postings: a place without a start or end has a null one."""
    unknown = F.array_repeat(F.lit(None).cast("int"), F.size("positions"))
    return rows.withColumns({c: F.coalesce(c, unknown) for c in ("starts", "ends")}).drop("overlap")


def _field_stats(term_dict: DataFrame, norms: DataFrame) -> DataFrame:
    terms = term_dict.groupBy("field").agg(F.sum("ttf").alias("ttf"), F.count("*").alias("n_terms"), F.min("term").alias("min_term"), F.max("term").alias("max_term"))
    return norms.groupBy("field").agg(F.count("*").alias("n_docs")).join(terms, "field").select("field", "n_docs", "ttf", "n_terms", "min_term", "max_term")


@dataclass(frozen=True)
class Index:
    docs: DataFrame
    postings: DataFrame
    term_dict: DataFrame
    norms: DataFrame
    field_stats: DataFrame
    fields: tuple[FieldSpec, ...] = ()
    deleted: DataFrame | None = None
    relations: dict[str, DataFrame] = field(default_factory=dict)
    #: field, n_docs, ttf alone, where they are cheaper to have than all of field_stats
    counts: DataFrame | None = None
    #: the postings as built, with ``overlap``
    rows: DataFrame | None = None

    @property
    def spark(self) -> SparkSession:
        return self.docs.sparkSession

    def spec(self, name: str) -> FieldSpec | None:
        return next((f for f in self.fields if f.name == name), None)

    @staticmethod
    def build(df: DataFrame, fields: list[FieldSpec], id_col: str = "doc_id", stored: list[str] | None = None) -> Index:
        """Plans the tables over ``df``; nothing runs until they are read or saved."""
        docs = df.select(F.col(id_col).cast("bigint").alias("doc_id"), *[F.col(c) for c in (df.columns if stored is None else stored) if c not in (id_col, "doc_id")])
        parts = []
        for spec in fields:
            # values alone are shuffled; they become tokens behind that
            values = df.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(spec.column or spec.name).alias("own"))
            rows = grouped(values, *_values(values, "own", spec), MAX_TERM_BYTES)
            parts.append(rows.select(F.lit(spec.name).alias("field"), "term", "doc_id", "tf", "length", "positions", "starts", "ends", "overlap"))
        postings = parts[0]
        for p in parts[1:]:
            postings = postings.unionByName(p)
        return replace(Index.of_tables(docs, _whole(postings), tuple(fields)), rows=postings)

    @staticmethod
    def of_tables(docs: DataFrame, postings: DataFrame, fields: tuple[FieldSpec, ...] = ()) -> Index:
        """Dictionary, norms and statistics follow from the postings."""
        term_dict = postings.groupBy("field", "term").agg(F.count("*").alias("df"), F.sum("tf").alias("ttf"))
        norms = postings.groupBy("field", "doc_id").agg(F.first("length").alias("length"), (F.sum("tf") - F.size(F.array_distinct(F.flatten(F.collect_list("positions"))))).alias("num_overlap"), F.max("tf").alias("max_tf"), F.count("*").alias("num_unique"))
        return Index(docs, postings, term_dict, norms, _field_stats(term_dict, norms), fields)

    def write_statistics(self, path: str, write) -> None:
        """Dictionary, norms and counts of the postings, as tables beside them."""
        n = int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        write(self.term_dict.repartitionByRange(n, "field", "term").sortWithinPartitions("field", "term"), f"{path}/term_dict")
        write(self.norms, f"{path}/norms")
        norms, terms = self.spark.read.parquet(f"{path}/norms"), self.spark.read.parquet(f"{path}/term_dict")
        counts = norms.groupBy("field").agg(F.count("*").alias("n_docs")).join(terms.groupBy("field").agg(F.sum("ttf").alias("ttf")), "field")
        write(counts.coalesce(1), f"{path}/counts")

    @staticmethod
    def of_segments(spark: SparkSession, paths: list[str], fields: tuple[FieldSpec, ...] = ()) -> Index:
        """The segments' stored tables put together: scans of postings need no other pass over them, and statistics are sums of theirs."""
        read = lambda t: spark.read.parquet(*[f"{p}/{t}" for p in paths])
        docs, terms, norms = spark.read.option("mergeSchema", "true").parquet(*[f"{p}/docs" for p in paths]), read("term_dict"), read("norms")
        if len(paths) > 1:
            terms = terms.groupBy("field", "term").agg(F.sum("df").alias("df"), F.sum("ttf").alias("ttf"))
        counts = read("counts").groupBy("field").agg(F.sum("n_docs").alias("n_docs"), F.sum("ttf").alias("ttf"))
        return Index(docs, read("postings"), terms, norms, _field_stats(terms, norms), fields, counts=counts)

    def save(self, path: str, partitions: int | None = None) -> Index:
        """Writes the tables and returns the index that reads them."""
        n = partitions or int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        self.docs.write.parquet(f"{path}/docs")
        # tokenized once
        raw = f"{path}/_postings"
        (self.postings.drop("df") if self.rows is None else self.rows).write.parquet(raw)
        rows = self.spark.read.parquet(raw)
        saved = Index.of_tables(self.docs, rows)
        saved.term_dict.repartitionByRange(n, "field", "term").sortWithinPartitions("field", "term").write.parquet(f"{path}/term_dict")
        terms = self.spark.read.parquet(f"{path}/term_dict")
        # one shuffle: a term's postings lie together and are counted there; those of the few frequent terms, whose df the dictionary gives, are
        # spread by document
        most = terms.agg(F.sum("df").alias("n")).first().n or 0
        frequent = F.broadcast(terms.filter(F.col("df") > max(1000, most // (4 * n))).select("field", "term", F.col("df").alias("known")))
        rows = rows.drop("overlap").join(frequent, ["field", "term"], "left").withColumn("slice", F.when(F.col("known").isNotNull(), F.col("doc_id")))
        rows = rows.repartitionByRange(n, "field", "term", "slice").sortWithinPartitions("field", "term", "slice", "doc_id")
        rows = rows.withColumn("df", F.coalesce("known", F.count("*").over(Window.partitionBy("field", "term", "slice")))).drop("known", "slice")
        (rows if self.rows is None else _whole(rows)).select("field", "term", "doc_id", "tf", "length", "positions", "starts", "ends", "df").write.parquet(f"{path}/postings")
        if self.rows is None:
            norms = saved.norms
        else:  # a document's postings lie in one file
            norms = self.spark.read.parquet(raw).groupBy("field", "doc_id").agg(F.first("length").alias("length"), F.first("overlap").alias("num_overlap"), F.max("tf").alias("max_tf"), F.count("*").alias("num_unique"))
        norms.write.parquet(f"{path}/norms")
        _field_stats(terms, self.spark.read.parquet(f"{path}/norms")).coalesce(1).write.parquet(f"{path}/field_stats")
        Files(self.spark, raw).delete(raw)
        return replace(Index.open(self.spark, path), fields=self.fields, relations=self.relations)

    @staticmethod
    def open(spark: SparkSession, path: str, fields: tuple[FieldSpec, ...] = ()) -> Index:
        return Index(*[spark.read.parquet(f"{path}/{t}") for t in TABLES], fields=fields)

    def with_relation(self, name: str, relation: DataFrame) -> Index:
        """``relation``: (child_id, parent_id)."""
        return replace(self, relations=self.relations | {name: relation})

    # --- scans

    def live_docs(self) -> DataFrame:
        return self.docs if self.deleted is None else self.docs.join(self.deleted.select("doc_id"), "doc_id", "left_anti")

    def docs_count(self) -> int:
        return self.docs.count()

    def live_docs_count(self) -> int:
        return self.live_docs().count()

    def field_names(self) -> DataFrame:
        return self.field_stats.select("field")

    def terms(self, name: str, at_least: str | None = None) -> DataFrame:
        """The field's dictionary from a term on, in byte order."""
        rows = self.term_dict.filter(F.col("field") == name)
        return (rows if at_least is None else rows.filter(F.col("term") >= at_least)).orderBy("term")

    def matching_terms(self, name: str, regex: str) -> DataFrame:
        return self.term_dict.filter((F.col("field") == name) & F.col("term").rlike(regex))

    def term(self, name: str, term: str) -> DataFrame:
        return self.term_dict.filter((F.col("field") == name) & (F.col("term") == term))

    def read_documents(self, name: str, term: str, limit: int) -> DataFrame:
        """The term's first documents."""
        return self.postings.filter((F.col("field") == name) & (F.col("term") == term)).select("doc_id").orderBy("doc_id").limit(limit)

    def union_of(self, name: str, terms: list[str]) -> DataFrame:
        return self.postings.filter((F.col("field") == name) & F.col("term").isin(terms)).select("doc_id").distinct()

    def column(self, name: str) -> DataFrame:
        return self.docs.select("doc_id", name).filter(F.col(name).isNotNull())

    def top_terms(self, name: str, k: int) -> DataFrame:
        return self.term_dict.filter(F.col("field") == name).orderBy(F.col("df").desc(), F.col("term").desc()).limit(k)

    def sorted_by(self, *columns: str) -> DataFrame:
        """Live documents in a primary order that holds over all partitions."""
        return self.live_docs().orderBy(*columns)
