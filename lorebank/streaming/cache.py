"""Speculative retrieval: contexts prepared for likely next topics, and the score of a hit."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lorebank.functions.text import jaccard
from lorebank.functions.vectors import cosine_to

# Least scores of a hit, and entries a session keeps.
VECTOR_HIT, WORD_HIT, ENTRIES = 0.4, 0.5, 10


#: What a builder gives for a topic: a context, the ids of its memories and, if it has one, a vector; or nothing.
Built = tuple[str, Sequence[str], Sequence[float] | None]


def pre_assemble(entries: DataFrame, session_id, topics: Sequence[str], build: Callable[[str], Built | None], now_us: int) -> DataFrame:
    """A session's entries with one more for each predicted topic that has none and that the builder has something for.

    Predictions are a handful; each is built once, on the driver. Entries: session_id, topic, context,
    memory_ids, embedding, used_us.
    """
    spark, schema = entries.sparkSession, entries.schema
    known = {r.topic for r in entries.where(F.col("session_id") == session_id).select("topic").collect()}
    rows = []
    for topic in dict.fromkeys(topics):
        if topic not in known and (made := build(topic)) is not None:
            context, ids, vector = made
            rows.append({"session_id": session_id, "topic": topic, "context": context, "memory_ids": list(ids), "embedding": None if vector is None else [float(x) for x in vector], "used_us": now_us})
    new = spark.createDataFrame([tuple(r.get(f.name) for f in schema.fields) for r in rows], schema)
    return newest_entries(entries.unionByName(new), now_us, now_us)


def newest_entries(entries: DataFrame, now_us: int, max_age_us: int, keep: int = ENTRIES) -> DataFrame:
    """Entries (session_id, topic, used_us, ...) that are neither stale nor pushed out."""
    fresh = entries.where(F.lit(now_us) - F.col("used_us") <= max_age_us)
    w = Window.partitionBy("session_id").orderBy(F.desc("used_us"), "topic")
    return fresh.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= keep).drop("_r")


def hits(entries: DataFrame, text: str, vector: Sequence[float] | None) -> DataFrame:
    """The best entry of each session that is near enough to a query.

    Vectors decide if any entry of the session has one, else the words of the topic.
    """
    scored = entries.withColumn("by_vector", F.coalesce(cosine_to("embedding", vector), F.lit(0.0)) if vector else F.lit(0.0)).withColumn("by_words", jaccard("topic", F.lit(text)))
    any_vector = F.max(F.col("embedding").isNotNull() & F.lit(bool(vector))).over(Window.partitionBy("session_id"))
    scored = scored.withColumn("_v", any_vector).withColumn("score", F.when(F.col("_v"), F.col("by_vector")).otherwise(F.col("by_words")))
    near = scored.where(F.col("score") > F.when(F.col("_v"), VECTOR_HIT).otherwise(WORD_HIT))
    return near.groupBy("session_id").agg(F.max_by(F.struct("topic", "score"), "score").alias("h")).select("session_id", "h.topic", "h.score")
