"""Running a stream to its end over files, with its result in the shared folder."""

from __future__ import annotations

import contextlib
import uuid
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lorebank.runtime import shared_folder

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@contextlib.contextmanager
def settings(spark: SparkSession, **conf: str) -> Iterator[None]:
    """Session settings for the queries started inside; names have __ for dots."""
    names = {k.replace("__", "."): v for k, v in conf.items()}
    before = {k: spark.conf.get(k) for k in names}
    try:
        for k, v in names.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def file_stream(spark: SparkSession, path: str, files_per_batch: int = 1000) -> DataFrame:
    """A table's files as a stream; a glob, so that a table of one file will do."""
    schema = spark.read.parquet(path).schema
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(f"{path}*")


def bounded_calls(rows: DataFrame, call: Callable[[str], str], text: str = "text", concurrent: int = 4, out: str = "answer") -> DataFrame:
    """Rows with the answers of a slow callable, at most ``concurrent`` calls at a time.

    With ``file_stream(..., files_per_batch=64)`` this is a bounded queue: what has not been read waits in
    its files, and a batch that fails is read again.
    """

    @F.pandas_udf("string")
    def answers(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: call(t) if isinstance(t, str) else None)

    return rows.repartition(concurrent).withColumn(out, answers(F.col(text)))


def run_to_end(stream: DataFrame, mode: str = "append", partitions: int | None = None) -> DataFrame:
    """All rows that a stream emits until its input is used up, with the number of their batch.

    Keyed state with lists and maps needs the RocksDB store. State has a fixed number of partitions,
    which adaptive execution cannot merge: one per core unless told otherwise. Each batch overwrites
    its own folder, so a batch that is run again after a failure counts once.
    """
    spark = stream.sparkSession
    partitions = partitions or spark.sparkContext.defaultParallelism
    folder = f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/out/batch={number}")

    with settings(spark, spark__sql__streaming__stateStore__providerClass=ROCKSDB, spark__sql__shuffle__partitions=str(partitions)):
        running = stream.writeStream.outputMode(mode).foreachBatch(write).option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start()
        running.awaitTermination()
    if running.exception() is not None:
        raise running.exception()
    out = spark.read.schema(stream.schema).option("basePath", f"{folder}/out").parquet(f"{folder}/out/*")
    return out.withColumn("batch", F.col("batch").cast("long")) if "batch" in out.columns else out
