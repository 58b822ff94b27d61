"""Session helper and durable cuts of lineage."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_KEY = "spark.checkpoint.dir"


def session(app: str = "lorebank", cpus: int | str = "*", **conf: str) -> SparkSession:
    """A local session with the settings the engine expects; a cluster brings its own."""
    builder = SparkSession.builder.master(f"local[{cpus}]").appName(app)
    defaults = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.shuffle.partitions": str(8 if cpus == "*" else cpus),
        "spark.driver.memory": "8g",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
    }
    for key, value in (defaults | conf).items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """The session's checkpoint folder, which driver and executors share.

    A local one is set only where there is none and everything runs in one JVM.
    """
    context = spark.sparkContext
    if named := spark.conf.get(CHECKPOINT_KEY, None) or context.getCheckpointDir():
        return named.rstrip("/")
    if not context.master.startswith("local") or "cluster" in context.master:
        raise RuntimeError(f"set {CHECKPOINT_KEY} to a folder that all executors share")
    context.setCheckpointDir(folder := tempfile.mkdtemp(prefix="lorebank-"))
    return folder


def durable(df: DataFrame) -> DataFrame:
    """The rows of ``df``, computed once and kept in the shared folder."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)
