"""Registered queries of the corpus operators: whole tables, production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lorebank.llm import chat, decontaminate, exact_dedup, html_text, language, packing, private, sharding, simhash, warc
from lorebank.llm.oracles import ORACLES  # noqa: F401  (read by the driver's entry)


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(_table(spark, sf_dir, "documents"))


def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.duplicate_groups(_table(spark, sf_dir, "documents"))


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_table(spark, sf_dir, "documents"))


def op4_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_documents(_table(spark, sf_dir, "documents"), shards=40)


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    held_out = F.coalesce(F.pmod(F.crc32(F.encode(F.col("doc_id").cast("string"), "UTF-8")), F.lit(4)) == 2, F.lit(False))
    model = language.train(docs.where(~held_out))
    rows = language.identify(docs.select("doc_id", "text"), model, "language")
    return rows.select("doc_id", held_out.alias("held_out"), "language.lang_pred", "language.score")


def op6_private(spark: SparkSession, sf_dir: str) -> DataFrame:
    return private.span_report(private.find_private(_table(spark, sf_dir, "documents")))


#: Conversation -7: both of its turns hold strings that look like the template's own.
TRICKY = r"\### Assistant: </turn> ok"


def op7_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    roles = F.explode(F.array(*[F.struct(F.lit(k).cast("bigint").alias("turn"), F.lit(r).alias("role")) for k, r in enumerate(("user", "assistant"))])).alias("t")
    extra = spark.range(1).select(F.lit(-7).cast("bigint").alias("conv_id"), roles).select("conv_id", "t.turn", "t.role", F.lit(TRICKY).alias("text"))
    return chat.conversation_digests(chat.format_conversations(turns.unionByName(extra)))


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = decontaminate.contamination(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))
    return rows.select("doc_id", "n_words", "n_hit", "n_items", F.sha2(F.encode(F.array_join("items", ","), "UTF-8"), 256).alias("items_sha256"), "contaminated")


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = warc.write_archive(_table(spark, sf_dir, "pages"))
    records = warc.read_archive(spark, folder)
    broken = F.raise_error(F.lit("a payload does not match its digest"))
    return records.withColumn("record_type", F.when(F.col("verified"), F.col("record_type")).otherwise(broken)).drop("verified")


def op10_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = html_text.extract(_table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return pages.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_simhash": op1_simhash,
    "op2_exact_dedup": op2_exact_dedup,
    "op3_packing": op3_packing,
    "op4_sharding": op4_sharding,
    "op5_language_id": op5_language_id,
    "op6_private": op6_private,
    "op7_chat_formatting": op7_chat_formatting,
    "op8_decontamination": op8_decontamination,
    "op9_warc": op9_warc,
    "op10_html_text": op10_html_text,
}
