"""Helpers that the training-data operators share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.sources.storage import shared_path


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The named table.  One of fewer splits than the cluster has cores is small, and is spread over them; larger ones are read as they lie."""
    scan = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    cores = spark.sparkContext.defaultParallelism
    return scan.repartition(cores) if scan._jdf.rdd().getNumPartitions() < cores else scan


def new_path(spark: SparkSession, name: str) -> str:
    """Under the folder that all executors share: ``spark.checkpoint.dir``."""
    return shared_path(spark, name)


def cut(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` into the shared folder and read it back.  The lineage ends there, so a lost executor costs
    its running tasks alone, and what is read twice is computed once."""
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def text_or_empty(col: str | Column) -> Column:
    return F.coalesce(F.col(col) if isinstance(col, str) else col, F.lit(""))


_RUN = 64


def running(values: Column, how: str) -> Column:
    """For each of an array's big integers the sum, or the greatest, of those before it (0 at first).  Blocks of ``_RUN`` first, then over the
    blocks, since a fold that appends copies what it has: the work stays near linear."""
    step = (lambda a, b: a + b) if how == "sum" else (lambda a, b: F.greatest(a, b))
    zero = F.lit(0).cast("bigint")
    blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(values) - 1) / _RUN).cast("int")), lambda k: F.slice(values, k * _RUN + 1, F.lit(_RUN)))
    inner = F.transform(blocks, lambda block: F.aggregate(block, F.struct(zero.alias("at"), F.expr("cast(array() as array<bigint>)").alias("out")), lambda acc, x: F.struct(step(acc["at"], x).alias("at"), F.array_append(acc["out"], acc["at"]).alias("out"))))
    outer = F.aggregate(inner, F.struct(zero.alias("at"), F.expr("cast(array() as array<array<bigint>>)").alias("out")), lambda acc, x: F.struct(step(acc["at"], x["at"]).alias("at"), F.array_append(acc["out"], F.transform(x["out"], lambda v: step(acc["at"], v))).alias("out")))
    return F.when(F.size(values) > 0, F.flatten(outer["out"])).otherwise(F.expr("cast(array() as array<bigint>)"))


def pick(df: DataFrame, **names: str) -> DataFrame:
    """Only the named columns, under internal names; other columns of whatever name can't clash."""
    return df.select(*[df[src].alias(dst) for dst, src in names.items()])
