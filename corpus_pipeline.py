"""The corpus pipeline: raw documents to packed training sequences.

Every stage reads what its predecessor wrote, and every stage but the last returns the columns of
``documents``. An empty table passes through every stage as an empty table.
"""

from __future__ import annotations

from collections.abc import Callable

from lorebank.llm import decontaminate, exact_dedup, language, packing, simhash
from lorebank.llm.common import fresh, fresh_folder, remove_folder
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents without a language (null, empty or no letter), those that no learned language explains
    better than plain bytes, and those whose text is plainly in another language than ``lang`` states; keeps
    all others as they are."""
    model = language.train(docs)
    if not model.languages:  # nothing was learned, so every text is UNKNOWN
        return docs.where(language.has_letter(docs["text"]))
    guess = fresh(docs, "language")
    marked = language.identify(docs, model, guess, stated_col="lang")
    return marked.where(~language.rejected(guess, F.col("text"))).select(*docs.columns)


def exact_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts one document stays."""
    return exact_dedup.drop_duplicates(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates the document with the smallest doc_id stays."""
    return simhash.keep_representatives(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents contaminated by the benchmark go."""
    return decontaminate.drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the documents that are left, by sequence."""
    return packing.pack(docs)


STAGES: list[tuple[str, Stage]] = [
    ("language_id", language_id),
    ("exact_dedup", exact_duplicates),
    ("near_dedup", near_duplicates),
    ("decontamination", decontamination),
    ("packing", pack),
]

#: Language models, fingerprints and token ids are beyond SQL; the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each one's result written to the shared folder and read again.

    A stage's result is deleted when the next one is written; the last one stays.
    """
    docs, read = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    folder = fresh_folder(spark, "pipeline")
    for k, (name, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(out := f"{folder}/{k}_{name}")
        if read:
            remove_folder(spark, read)
        docs, read = spark.read.parquet(out), out
    return docs
