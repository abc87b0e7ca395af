"""Document loaders, parent relations and dumps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quern.sources.index import Index



def base36(number: Column, width: int = 6) -> Column:
    return F.lpad(F.lower(F.conv(number.cast("string"), 10, 36)), width, "0")


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """Tab-separated title, date and body per line; adds a base-36 id and a constant time."""
    rows = spark.read.csv(path, sep="\t", quote="", schema="title string, date string, body string")
    place = F.monotonically_increasing_id()
    return rows.withColumn("doc_id", place).withColumn("id", base36(F.col("doc_id"))).withColumn("timesecnum", F.lit(0).cast("bigint"))


def read_json(spark: SparkSession, path: str, schema: str | None = None, multi_line: bool = True) -> DataFrame:
    """A JSON array or JSON lines; a given schema saves the pass that infers one."""
    reader = spark.read.option("multiLine", str(multi_line).lower())
    return (reader.schema(schema) if schema else reader).json(path)


def parent_relation(df: DataFrame, is_parent: Column, id_col: str = "doc_id") -> DataFrame:
    """(child_id, parent_id) where children come right before their parent in id order; those after the last one have none.

    Ranges of ids are worked on apart; each then needs only the first parent of a later range, one row per range.  Windows run from the last id
    down: a frame that ends at the current row grows by a row at a time, while one that starts there is folded anew for each row."""
    rows = df.select(F.col(id_col).alias("child_id"), F.when(is_parent, F.col(id_col)).alias("own"))
    # a number of ranges of its own: they aren't put together, so the numbers are the same wherever they are used
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = rows.repartitionByRange(n, F.col("child_id")).withColumn("part", F.spark_partition_id())
    within = Window.partitionBy("part").orderBy(F.col("child_id").desc()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = rows.withColumn("parent", F.min("own").over(within))
    later = Window.orderBy(F.col("part").desc()).rowsBetween(Window.unboundedPreceding, -1)
    edges = rows.groupBy("part").agg(F.min("own").alias("first")).select(F.col("part").alias("p"), F.min("first").over(later).alias("next"))
    out = rows.join(edges, F.col("part") == F.col("p")).select("child_id", F.coalesce("parent", "next").alias("parent_id"), "own")
    return out.filter(F.col("own").isNull() & F.col("parent_id").isNotNull()).select("child_id", "parent_id")


def dump(index: Index, path: str) -> None:
    """The dictionary with its postings as JSON lines, one term per line."""
    postings = index.postings.groupBy("field", "term").agg(F.array_sort(F.collect_list(F.struct("doc_id", "tf", "positions"))).alias("documents"))
    index.term_dict.join(postings, ["field", "term"]).write.json(path)


def convert(spark: SparkSession, source: str, target: str, codec: str) -> None:
    """Rewrites a saved index with another parquet codec."""
    for table in ("docs", "postings", "term_dict", "norms", "field_stats"):
        spark.read.parquet(f"{source}/{table}").write.option("compression", codec).parquet(f"{target}/{table}")
