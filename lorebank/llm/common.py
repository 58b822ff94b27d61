"""Shared helpers of the corpus operators: durable cuts of lineage and safe column names."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lorebank.runtime import durable, shared_folder

__all__ = ["BLANKS", "bounded_batches", "durable", "fresh", "fresh_folder", "remove_folder", "whole_text"]

#: The characters of ``[\x20\x09-\x0D]``.
BLANKS = " \t\n\x0b\x0c\r"
#: The setting that bounds a batch of rows on its way to a Python worker, Spark's default for it, and ours.
BATCH_KEY, BATCH_DEFAULT, BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch", "67108864b", "8m"


def bounded_batches(spark: SparkSession) -> None:
    """Ask for small Arrow batches in this session, unless it names a size of its own.

    A worker holds a batch several times over, as bytes and as strings, and so does its executor; results
    do not depend on the size. The setting has to last until the lazy result is computed.
    """
    if spark.conf.get(BATCH_KEY) == BATCH_DEFAULT:
        spark.conf.set(BATCH_KEY, BATCH_BYTES)


def fresh_folder(spark: SparkSession, purpose: str) -> str:
    """A path in the shared folder that nothing else uses."""
    return f"{shared_folder(spark)}/{purpose}-{uuid.uuid4().hex}"


def remove_folder(spark: SparkSession, path: str) -> None:
    """Delete a folder in whatever store it lies."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def fresh(df: DataFrame, base: str) -> str:
    """A column name that ``df`` does not have, whatever the case of its letters."""
    taken, name = {c.lower() for c in df.columns}, f"_lb_{base}"
    while name.lower() in taken:
        name += "_"
    return name


def whole_text(column: str = "text"):
    """The text as a string; null counts as empty."""
    return F.coalesce(F.col(column).cast("string"), F.lit(""))
