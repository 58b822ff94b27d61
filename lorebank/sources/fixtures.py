"""Views of the data model over the driver's tables.

Each view is a plain projection or equi-join, so filters and column selections reach the scans. Times
come from zone-less timestamps and do not depend on the session's time zone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: 2024-02-01 00:00:00 UTC; the events end on 2024-01-30.
NOW_US = 1_706_745_600_000_000
HOUR_US, DAY_US = 3_600_000_000, 86_400_000_000

EPOCH_US = "timestampdiff(MICROSECOND, TIMESTAMP_NTZ '1970-01-01 00:00:00', {})"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def memories(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M: one memory per event, without an embedding."""
    e = table(spark, sf_dir, "events").withColumn("us", F.expr(EPOCH_US.format("ts")))
    kind = F.expr("CASE event_type WHEN 'view' THEN 'Episodic' WHEN 'click' THEN 'Semantic' WHEN 'purchase' THEN 'Procedural' WHEN 'error' THEN 'AntiPattern' ELSE 'Correction' END")
    return e.select(
        F.col("event_id").alias("id"),
        F.col("user_id").alias("agent_id"),
        kind.alias("memory_type"),
        F.col("props").alias("content"),
        F.col("us").alias("created_at_us"),
        (F.col("us") + (F.col("event_id") % 48) * HOUR_US).alias("accessed_at_us"),
        (F.col("event_id") % 7).alias("access_count"),
        F.least(F.col("value") / F.lit(500.0), F.lit(1.0)).alias("salience"),
        (F.lit(0.3) + F.lit(0.1) * (F.col("event_id") % 8).cast("double")).alias("confidence"),
        F.array("event_type", F.concat(F.lit("b"), (F.col("event_id") % 5).cast("string"))).alias("tags"),
        (F.col("user_id") % 4).alias("space_id"),
        F.col("us").alias("valid_from_us"),
        F.when(F.col("event_id") % 11 == 0, F.col("us") + 3 * DAY_US).alias("valid_until_us"),
    )


def vector_memories(spark: SparkSession, sf_dir: str, content: Column | None = None) -> DataFrame:
    """MV: memories with vectors, text and tags, from embeddings and documents of equal id.

    ``content``, an expression on the column text, stands for the text; it is taken before the join,
    so that whole texts are not shuffled.
    """
    v, d = table(spark, sf_dir, "embeddings"), table(spark, sf_dir, "documents")
    if content is not None:
        d = d.withColumn("text", content)
    i = F.col("vec_id")
    created = F.lit(NOW_US) - i * HOUR_US
    return v.join(d, v.vec_id == d.doc_id).select(
        i.alias("id"),
        "embedding",
        F.col("label").cast("long").alias("label"),
        F.col("text").alias("content"),
        F.array("lang", "source").alias("tags"),
        F.element_at(F.array(*[F.lit(x) for x in ("Episodic", "Semantic", "Procedural", "AntiPattern", "Reasoning", "Correction")]), (i % 6 + 1).cast("int")).alias("memory_type"),
        (i % 3).alias("agent_id"),
        (i % 4).alias("space_id"),
        created.alias("created_at_us"),
        (created + (i % 48) * HOUR_US).alias("accessed_at_us"),
        (i % 7).alias("access_count"),
        ((i % 10).cast("double") / F.lit(10.0)).alias("salience"),
        (F.lit(0.3) + F.lit(0.1) * (i % 8).cast("double")).alias("confidence"),
        created.alias("valid_from_us"),
        F.when(i % 13 == 0, created + 5 * DAY_US).alias("valid_until_us"),
    )


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """E: two typed edges per vector, without self loops."""
    v = table(spark, sf_dir, "embeddings").select("vec_id")
    n = v.agg(F.count(F.lit(1)).alias("n"))
    i = F.col("vec_id")
    kinds = F.array(*[F.lit(x) for x in ("Caused", "Before", "Related", "Contradicts", "Supports", "Supersedes", "Derived", "PartOf")])
    both = v.join(F.broadcast(n)).select(i, "n", F.explode(F.array((i * 7 + 3) % F.col("n"), F.when(i + 8 < F.col("n"), i + 8))).alias("target"))
    return both.where(F.col("target").isNotNull() & (F.col("target") != i)).select(
        i.alias("source"),
        "target",
        F.element_at(kinds, (i % 8 + 1).cast("int")).alias("edge_type"),
        (F.lit(0.5) + F.lit(0.1) * (i % 5).cast("double")).alias("weight"),
        (i * 1_000_000).alias("created_at_us"),
        F.lit(None).cast("long").alias("valid_from_us"),
        F.when(i % 13 == 0, i * 1_000_000 + 5).alias("valid_until_us"),
    )


def turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """T: conversation turns with a topic, the first three lower-cased words."""
    c = table(spark, sf_dir, "conversations")
    words = F.slice(F.split(F.trim(F.regexp_replace(F.lower("text"), r"[ \t\r\n]+", " ")), " "), 1, 3)
    return c.select("conv_id", "turn", "role", "text", F.array_join(words, " ").alias("topic"))


# The same views for DuckDB, as common table expressions.
M_SQL = f"""M AS (
  SELECT event_id AS id, user_id AS agent_id,
         CASE event_type WHEN 'view' THEN 'Episodic' WHEN 'click' THEN 'Semantic' WHEN 'purchase' THEN 'Procedural' WHEN 'error' THEN 'AntiPattern' ELSE 'Correction' END AS memory_type,
         props AS content, epoch_us(ts) AS created_at_us, epoch_us(ts) + (event_id % 48) * {HOUR_US} AS accessed_at_us,
         event_id % 7 AS access_count, least(value / 500.0::DOUBLE, 1.0::DOUBLE) AS salience,
         0.3::DOUBLE + 0.1::DOUBLE * (event_id % 8)::DOUBLE AS confidence,
         [event_type, 'b' || (event_id % 5)] AS tags, user_id % 4 AS space_id,
         epoch_us(ts) AS valid_from_us, CASE WHEN event_id % 11 = 0 THEN epoch_us(ts) + 3 * {DAY_US} END AS valid_until_us
  FROM events)"""

MV_SQL = f"""MV AS (
  SELECT vec_id AS id, CAST(embedding AS DOUBLE[]) AS embedding, CAST(label AS BIGINT) AS label, text AS content, [lang, source] AS tags,
         (['Episodic', 'Semantic', 'Procedural', 'AntiPattern', 'Reasoning', 'Correction'])[CAST(vec_id % 6 + 1 AS INTEGER)] AS memory_type,
         vec_id % 3 AS agent_id, vec_id % 4 AS space_id, {NOW_US} - vec_id * {HOUR_US} AS created_at_us,
         {NOW_US} - vec_id * {HOUR_US} + (vec_id % 48) * {HOUR_US} AS accessed_at_us, vec_id % 7 AS access_count,
         (vec_id % 10)::DOUBLE / 10.0::DOUBLE AS salience, 0.3::DOUBLE + 0.1::DOUBLE * (vec_id % 8)::DOUBLE AS confidence,
         {NOW_US} - vec_id * {HOUR_US} AS valid_from_us,
         CASE WHEN vec_id % 13 = 0 THEN {NOW_US} - vec_id * {HOUR_US} + 5 * {DAY_US} END AS valid_until_us
  FROM embeddings JOIN documents ON vec_id = doc_id)"""

E_SQL = """E AS (
  SELECT vec_id AS source, target,
         (['Caused', 'Before', 'Related', 'Contradicts', 'Supports', 'Supersedes', 'Derived', 'PartOf'])[CAST(vec_id % 8 + 1 AS INTEGER)] AS edge_type,
         0.5::DOUBLE + 0.1::DOUBLE * (vec_id % 5)::DOUBLE AS weight, vec_id * 1000000 AS created_at_us, CAST(NULL AS BIGINT) AS valid_from_us,
         CASE WHEN vec_id % 13 = 0 THEN vec_id * 1000000 + 5 END AS valid_until_us
  FROM (SELECT vec_id, unnest([(vec_id * 7 + 3) % n, CASE WHEN vec_id + 8 < n THEN vec_id + 8 END]) AS target
        FROM embeddings, (SELECT count(*) AS n FROM embeddings))
  WHERE target IS NOT NULL AND target <> vec_id)"""

T_SQL = r"""T AS (
  SELECT conv_id, turn, role, text,
         array_to_string((string_split(trim(regexp_replace(lower(text), '[ \t\r\n]+', ' ', 'g'), ' '), ' '))[1:3], ' ') AS topic
  FROM conversations)"""
