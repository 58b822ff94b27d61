"""Append-only storage: versioned rows in Parquet, read back as the latest view.

Every change appends rows with a higher version; readers take the newest row of a key and skip keys
whose newest row is a tombstone. A commit is one directory that Spark's committer publishes whole.
"""

from __future__ import annotations

import json
import time
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lorebank import types
from lorebank.types import EDGE, LIFECYCLE, MEMORY, OPERATION

VERSION, DELETED = "version", "deleted"


def latest_view(log: DataFrame, key: str = "id", created: str = "created_at_us") -> DataFrame:
    """The newest row of each key; the creation time stays that of the first.

    One grouped maximum, combined before its shuffle; tombstones are dropped at the end.
    """
    rest = [c for c in log.columns if c not in (key, VERSION, created)]
    row = F.struct(VERSION, *rest)
    out = log.groupBy(key).agg(F.max_by(row, F.col(VERSION)).alias("r"), F.min_by(created, VERSION).alias(created))
    out = out.select(key, created, *[F.col(f"r.{c}").alias(c) for c in rest])
    return out.where(~F.coalesce(F.col(DELETED), F.lit(False))).drop(DELETED) if DELETED in rest else out


class Log:
    """One append-only table under a folder."""

    def __init__(self, spark: SparkSession, folder: str, name: str, schema: T.StructType):
        self.spark, self.path = spark, f"{folder.rstrip('/')}/{name}"
        self.schema = T.StructType([*schema.fields, T.StructField(VERSION, T.LongType()), T.StructField(DELETED, T.BooleanType())])

    def read(self) -> DataFrame:
        """All versions; an empty table before the first append."""
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        if not path.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(path):
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(self.path)

    def append(self, rows: DataFrame, version: int | None = None, deleted: bool = False) -> None:
        columns = []
        for f in self.schema.fields[:-2]:
            columns.append((F.col(f.name) if f.name in rows.columns else F.lit(None)).cast(f.dataType).alias(f.name))
        rows.select(*columns, F.lit(time.time_ns() // 1000 if version is None else version).cast("long").alias(VERSION), F.lit(deleted).alias(DELETED)).write.mode("append").parquet(self.path)


class KeyedTable(Log):
    """A table whose rows are replaced by key: the newest row of a key counts."""

    def __init__(self, spark: SparkSession, folder: str, name: str, schema: T.StructType, key: tuple[str, ...]):
        super().__init__(spark, folder, name, schema)
        self.key = key

    def rows(self) -> DataFrame:
        """One row per key, by a grouped maximum; tombstones are dropped."""
        log = self.read()
        rest = [c for c in log.columns if c not in (*self.key, VERSION)]
        best = log.groupBy(*self.key).agg(F.max_by(F.struct(*rest), F.col(VERSION)).alias("r"))
        out = best.select(*self.key, *[F.col(f"r.{c}").alias(c) for c in rest])
        return out.where(~F.coalesce(F.col(DELETED), F.lit(False))).drop(DELETED).select(*[f.name for f in self.schema.fields[:-2]])

    def upsert(self, rows: DataFrame, version: int | None = None) -> None:
        self.append(rows, version)

    def delete(self, keys: DataFrame, version: int | None = None) -> None:
        """Tombstones for all rows that agree with ``keys`` on its columns."""
        self.append(self.rows().join(keys.distinct(), keys.columns, "left_semi"), version, deleted=True)

    def replace(self, rows: DataFrame, by: str, version: int | None = None) -> None:
        """Replace all rows with the values of one column that ``rows`` has, as one bundle."""
        now = time.time_ns() // 1000 if version is None else version
        self.delete(rows.select(by), now)
        self.append(rows, now + 1)


#: Name, schema and key of the derived layer's tables.
DERIVED = (
    ("sources", types.SOURCE, ("memory_id", "source_type")), ("entities", types.ENTITY, ("entity_id",)), ("aliases", types.ALIAS, ("entity_id", "alias")), ("memory_entities", types.MEMORY_ENTITY, ("memory_id", "entity_id", "role")),
    ("claims", types.CLAIM, ("claim_id",)), ("claim_evidence", types.CLAIM_EVIDENCE, ("claim_id", "memory_id")), ("relationships", types.RELATIONSHIP, ("relationship_id",)), ("policy_runs", types.POLICY_RUN, ("run_id",)),
    ("policy_actions", types.POLICY_ACTION, ("run_id", "memory_id", "action")), ("extraction_runs", types.EXTRACTION_RUN, ("run_id",)), ("traces", types.TRACE, ("trace_id",)), ("relationship_evidence", types.RELATIONSHIP_EVIDENCE, ("relationship_id", "memory_id")), ("agents", types.AGENT, ("agent_id",)), ("trace_hits", types.TRACE_HIT, ("trace_id", "rank")), ("snapshots", types.SNAPSHOT, ("name",)),
)
#: Tables whose rows go with a memory, and the column that names it.
DEPENDENT = (("sources", "memory_id"), ("memory_entities", "memory_id"), ("claim_evidence", "memory_id"), ("relationship_evidence", "memory_id"))


class Tables:
    """The logs of one store: memories, edges, operations, lifecycle events and the derived layer."""

    def __init__(self, spark: SparkSession, folder: str):
        self.memories = Log(spark, folder, "memories", MEMORY)
        self.edges = Log(spark, folder, "edges", EDGE)
        self.operations = Log(spark, folder, "operations", OPERATION)
        self.lifecycle = Log(spark, folder, "lifecycle", LIFECYCLE)
        self.derived = {name: KeyedTable(spark, folder, name, schema, key) for name, schema, key in DERIVED}

    def cascade(self, ids: DataFrame) -> None:
        """Remove what depends on forgotten memories (column id)."""
        for name, column in DEPENDENT:
            self.derived[name].delete(ids.select(F.col("id").alias(column)))

    def save_snapshot(self, name: str, body: dict, format_version: int) -> None:
        spark = self.memories.spark
        row = spark.createDataFrame([(name, format_version, json.dumps(body, sort_keys=True), time.time_ns() // 1000)], types.SNAPSHOT)
        self.derived["snapshots"].upsert(row)

    def load_snapshot(self, name: str, newest_version: int) -> dict | None:
        """The body of a snapshot; None if there is none, an error if a newer format wrote it."""
        row = self.derived["snapshots"].rows().where(F.col("name") == name).head()
        if row is None:
            return None
        if row.format_version > newest_version:
            raise ValueError(f"snapshot {name} has format {row.format_version}, this reads up to {newest_version}")
        return json.loads(row.body_json)


def read_bank(spark: SparkSession, path: str) -> DataFrame:
    """Items of a memory-bank JSON file: section, tags, position and text."""
    schema = "memory_bank array<struct<section:string,tags:array<string>,items:array<string>>>"
    bank = spark.read.schema(schema).json(path, multiLine=True)
    sections = bank.select(F.explode("memory_bank").alias("s"))
    return sections.select("s.section", "s.tags", F.posexplode("s.items").alias("pos", "content"))


def pack_lines(text: str, most: int) -> Iterator[str]:
    """Trimmed lines that are not blank, packed greedily into chunks; a line that is too long is split."""
    now = ""
    for line in (x.strip() for x in text.splitlines()):
        while len(line) > most:
            if now:
                yield now
                now = ""
            yield line[:most]
            line = line[most:]
        if not line:
            continue
        if now and len(now) + 1 + len(line) > most:
            yield now
            now = line
        else:
            now = f"{now}\n{line}" if now else line
    if now:
        yield now


def ingest_text(texts: DataFrame, most: int = 800) -> DataFrame:
    """Chunks of texts (source, content) as rows with tags and attributes."""

    @F.pandas_udf("array<string>")
    def chunks(batch: pd.Series) -> pd.Series:
        return pd.Series([list(pack_lines(t if isinstance(t, str) else "", most)) for t in batch], dtype=object)

    rows = texts.select("source", F.posexplode(chunks("content")).alias("chunk_index", "content"))
    return rows.withColumn("tags", F.array(F.lit("memory_bank"), F.concat(F.lit("source:"), "source"))).withColumn("attributes", F.to_json(F.struct("source", "chunk_index")))


def replace_source(memories: DataFrame, source: str) -> DataFrame:
    """Memories without those of a source, before its text is ingested again."""
    return memories.where(~F.array_contains("tags", f"source:{source}"))


def split_turns(text: DataFrame) -> DataFrame:
    """Episodic rows of the lines that begin with a speaker and have more than 15 bytes."""
    lines = text.select("id", F.posexplode(F.split("content", "\n")).alias("pos", "line"))
    role = F.lower(F.regexp_extract("line", "^(User|Assistant):", 1))
    return lines.where(F.col("line").rlike("^(User|Assistant):") & (F.octet_length("line") > 15)).select(
        "id", "pos", F.col("line").alias("content"), F.lit("Episodic").alias("memory_type"), F.lit(0.75).alias("salience"), F.lit(0.8).alias("confidence"), F.array(F.lit("turn"), F.concat(F.lit("turn:"), role)).alias("tags")
    )


def check_dimension(rows: DataFrame, dim: int) -> DataFrame:
    """Rows unchanged; a vector of another length fails the job."""
    bad = F.raise_error(F.lit(f"an embedding does not have {dim} values"))
    return rows.withColumn("embedding", F.when(F.col("embedding").isNull() | (F.size("embedding") == dim), F.col("embedding")).otherwise(bad))
