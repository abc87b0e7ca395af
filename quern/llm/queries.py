"""The queries of the ten operators.  Each derives its digest columns from what the operator returns."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.llm import html, pii
from quern.llm.chat import format_conversations, parsed, under_mask
from quern.llm.common import new_path, table
from quern.llm.dac import read_files, write_files
from quern.llm.mixing import mix
from quern.llm.oracle import ORACLE_SQL  # noqa: F401
from quern.llm.packing import pack
from quern.llm.quality import quality_scores
from quern.llm.secrets import count_kind, secret_spans, verdicts, written
from quern.llm.simhash import simhash_groups
from quern.llm.topk import top_k


def op1_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    both = "</s>[INST] ok [/INST]"
    more = spark.sql("SELECT CAST(-7 AS BIGINT) conv_id, CAST(turn AS BIGINT) turn, role, text FROM VALUES (0, 'user', :t), (1, 'assistant', :t) AS v(turn, role, text)", args={"t": both})
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(more)
    done = format_conversations(rows).withColumn("turns", parsed(F.col("text"))).withColumn("learnt", under_mask(F.col("text"), F.col("loss")))
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return done.select("conv_id", F.size("turns").cast("bigint").alias("n_turns"), F.sha2(said, 256).alias("turns_sha256"), F.length("learnt").cast("bigint").alias("loss_chars"), F.sha2("learnt", 256).alias("loss_sha256"), F.length("text").cast("bigint").alias("formatted_chars"))


def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.personal_data(table(spark, sf_dir, "documents"))
    kinds = F.array(*[F.lit(k) for k in pii.KINDS])
    written_ = lambda c: F.array_join(F.transform(c, lambda s: F.concat_ws(":", F.element_at(kinds, s["kind"] + 1), s["start"], s["end"])), ",")
    # a lambda's second parameter would be the place
    of_kind = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("bigint")
    counts = [of_kind(k).alias(f"n_{name}") for k, name in enumerate(pii.KINDS)]
    return found.select("doc_id", *counts, F.sha2(written_("base"), 256).alias("base_sha256"), written_("spans").alias("spans"))


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mix(table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))


def op4_top_k_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = top_k(table(spark, sf_dir, "documents"))
    return found.select("query_id", "rank", "doc_id", F.round("score", 4).alias("score"))


def op5_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secret_spans(table(spark, sf_dir, "documents"))
    kinds = [count_kind("base", rank).alias(name) for rank, name in enumerate(("n_assign", "n_access", "n_hex"))]
    judged = [F.size(F.filter("spans", lambda s: s["live"])).cast("bigint").alias("n_live"), F.size(F.filter("spans", lambda s: ~s["live"])).cast("bigint").alias("n_copied")]
    return found.select("doc_id", *kinds, F.sha2(written("base"), 256).alias("base_sha256"), written("spans").alias("spans"), *judged, verdicts("spans").alias("verdicts"))


def op6_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.main_text(table(spark, sf_dir, "pages")).withColumn("n_chars", F.length("text").cast("bigint"))


def op7_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    manifest = write_files(table(spark, sf_dir, "documents"), new_path(spark, "token-files"))
    return read_files(manifest).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_scores(table(spark, sf_dir, "documents"))


def op9_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = simhash_groups(table(spark, sf_dir, "documents"))
    return groups.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = pack(table(spark, sf_dir, "documents"))
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset", "bucket")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_chat_formatting": op1_chat_formatting,
    "op2_pii": op2_pii,
    "op3_mixing": op3_mixing,
    "op4_top_k_search": op4_top_k_search,
    "op5_secret_scans": op5_secret_scans,
    "op6_html_extraction": op6_html_extraction,
    "op7_token_files": op7_token_files,
    "op8_quality_rules": op8_quality_rules,
    "op9_simhash_near_dedup": op9_simhash_near_dedup,
    "op10_packing": op10_packing,
}
