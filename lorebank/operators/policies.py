"""Policies with previews and logs: forget, correct, enrich; versions, conflicts, access and limits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

CONFLICT_WINDOW_US = 1_000_000


def forget_scope(scope: str, value, memories: DataFrame, links: DataFrame | None = None, aliases: DataFrame | None = None, sources: DataFrame | None = None) -> DataFrame:
    """Ids (column id) that a scope names: memory, agent, space, tag, entity, alias or conversation."""
    if scope in ("memory", "agent", "space"):
        return memories.where(F.col({"memory": "id", "agent": "agent_id", "space": "space_id"}[scope]) == value).select("id")
    if scope == "tag":
        return memories.where(F.array_contains("tags", value)).select("id")
    if scope == "conversation":
        return sources.where(F.col("conversation_id") == value).select(F.col("memory_id").alias("id")).distinct()
    if scope == "entity":
        return links.where(F.col("entity_id") == value).select(F.col("memory_id").alias("id")).distinct()
    if scope == "alias":
        named = aliases.where(F.col("alias") == value).select("entity_id").distinct()
        return links.join(named, "entity_id", "left_semi").select(F.col("memory_id").alias("id")).distinct()
    raise ValueError(f"unknown scope {scope!r}")


def touching(edges: DataFrame, ids: DataFrame) -> DataFrame:
    """Edges with at least one endpoint among the ids, each row once."""
    a = ids.select(F.col("id").alias("source")).distinct()
    b = ids.select(F.col("id").alias("target")).distinct()
    marked = edges.join(a.withColumn("_a", F.lit(1)), "source", "left").join(b.withColumn("_b", F.lit(1)), "target", "left")
    return marked.where(F.col("_a").isNotNull() | F.col("_b").isNotNull()).select(*edges.columns)


def forget_plan(ids: DataFrame, edges: DataFrame) -> DataFrame:
    """One row: how many memories and edges go."""
    return ids.agg(F.count(F.lit(1)).alias("memories")).join(touching(edges, ids).agg(F.count(F.lit(1)).alias("edges")))


def forget_soft(memories: DataFrame, ids: DataFrame, now_us: int) -> DataFrame:
    marked = memories.join(ids.select("id").distinct().withColumn("_f", F.lit(True)), "id", "left")
    return marked.withColumn("valid_until_us", F.when(F.col("_f"), F.lit(now_us)).otherwise(F.col("valid_until_us"))).select(*memories.columns)


def forget_hard(memories: DataFrame, edges: DataFrame, ids: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Memories and edges that are left."""
    own = ids.select("id").distinct()
    left = edges.join(own.withColumnRenamed("id", "source"), "source", "left_anti").join(own.withColumnRenamed("id", "target"), "target", "left_anti")
    return memories.join(own, "id", "left_anti"), left


def cascade(table: DataFrame, ids: DataFrame, column: str = "memory_id") -> DataFrame:
    """A dependent table without the rows of forgotten memories."""
    return table.join(ids.select(F.col("id").alias(column)).distinct(), column, "left_anti")


def correction_plan(corrections: DataFrame, links: DataFrame, memories: DataFrame) -> DataFrame:
    """Old memories that share an entity with a correction and are older: correction, memory, entities."""
    mine = corrections.select(F.col("id").alias("correction"), F.col("created_at_us").alias("at_us"))
    own = links.join(mine, links.memory_id == mine.correction).select("correction", "at_us", "entity_id")
    other = links.select("entity_id", F.col("memory_id").alias("memory")).join(memories.select(F.col("id").alias("memory"), F.col("created_at_us").alias("old_us")), "memory")
    met = own.join(other, "entity_id").where("memory <> correction and old_us < at_us")
    return met.groupBy("correction", "memory").agg(F.count_distinct("entity_id").alias("entities"))


def policy_actions(plan: DataFrame, run_id: str, action: str, applied: bool, now_us: int) -> DataFrame:
    """Log rows of a policy run; a preview names what it would do."""
    return plan.select(F.lit(run_id).alias("run_id"), F.lit(action if applied else f"would_{action}").alias("action"), F.col("id").alias("memory_id"), F.lit("applied" if applied else "planned").alias("status"), F.lit(now_us).alias("created_at_us"))


def enrichment_edges(pairs: DataFrame, now_us: int) -> DataFrame:
    """Supporting edges; a weight that is not finite becomes 0.85, others are kept within 0 and 1."""
    w = F.col("weight")
    bad = w.isNull() | F.isnan(w) | (F.abs(w) == F.lit(float("inf")))
    return pairs.select("source", "target", F.lit("Supports").alias("edge_type"), F.when(bad, 0.85).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), w))).alias("weight"), F.lit(now_us).alias("created_at_us"))


def audit_of(operations: DataFrame, memory) -> DataFrame:
    return operations.where((F.col("memory_id") == memory) | (F.col("source") == memory) | (F.col("target") == memory)).orderBy(F.desc("created_at_us"))


def versions_as_of(versions: DataFrame, at: Column, key: str = "memory_id", ts: str = "ts", tie: tuple[str, ...] = ()) -> DataFrame:
    """The latest version of each key up to a time, by a grouped maximum."""
    rest = [c for c in versions.columns if c not in (key, ts, *tie)]
    best = versions.where(F.col(ts) <= at).groupBy(key).agg(F.max(F.struct(ts, *tie, *rest)).alias("v"))
    return best.select(key, *[F.col(f"v.{c}").alias(c) for c in (ts, *tie, *rest)])


def conflicts(versions: DataFrame, window_us: int = CONFLICT_WINDOW_US) -> DataFrame:
    """Pairs of versions of a memory by different agents within a window, each pair once.

    Versions meet by memory and by window-sized bucket, their own and the next one, so a memory with a
    long history is not paired with itself in full.
    """
    v = versions.withColumn("b", F.floor(F.col("ts_us") / window_us))
    a = v.select("memory_id", F.col("agent").alias("agent_a"), F.col("ts_us").alias("ts_a"), F.col("uid").alias("uid_a"), F.explode(F.array(F.col("b"), F.col("b") + 1)).alias("b"), F.col("b").alias("own"))
    b = v.select("memory_id", F.col("agent").alias("agent_b"), F.col("ts_us").alias("ts_b"), F.col("uid").alias("uid_b"), "b")
    met = a.join(b, ["memory_id", "b"]).where((F.col("agent_a") != F.col("agent_b")) & (F.abs(F.col("ts_a") - F.col("ts_b")) <= window_us))
    once = (F.col("own") < F.col("b")) | (F.struct("ts_a", "uid_a") < F.struct("ts_b", "uid_b"))
    return met.where(once).select("memory_id", F.least("uid_a", "uid_b").alias("first"), F.greatest("uid_a", "uid_b").alias("second")).distinct()


def resolve_latest(versions: DataFrame, key: str = "memory_id") -> DataFrame:
    return versions.groupBy(key).agg(F.max_by("uid", F.struct("ts_us", "uid")).alias("uid"))


def resolve_surest(versions: DataFrame, key: str = "memory_id") -> DataFrame:
    """The version of greatest confidence, the last one of equals."""
    return versions.groupBy(key).agg(F.max_by("uid", F.struct("confidence", "ts_us", "uid")).alias("uid"))


def usage(memories: DataFrame, most_memories: int, most_bytes: int) -> DataFrame:
    """One row: counts, bytes and the greater utilisation in per cent."""
    used = memories.agg(F.count(F.lit(1)).alias("memories"), F.sum(F.octet_length("content")).alias("bytes"))
    return used.withColumn("utilisation", F.greatest(F.col("memories") * 100.0 / most_memories, F.col("bytes") * 100.0 / most_bytes))


def over_limit(memories: DataFrame, per_agent: int) -> DataFrame:
    return memories.groupBy("agent_id").agg(F.count(F.lit(1)).alias("memories")).where(F.col("memories") > per_agent)


def grant(acl: DataFrame, space_id, agent_id, permission: str) -> DataFrame:
    """An access list with one agent's grant on a space set."""
    spark = acl.sparkSession
    one = spark.range(1).select(F.lit(space_id).alias("space_id"), F.lit(agent_id).alias("agent_id"), F.lit(permission).alias("permission"))
    return revoke(acl, space_id, agent_id).unionByName(one)


def revoke(acl: DataFrame, space_id, agent_id) -> DataFrame:
    return acl.where(~((F.col("space_id") == space_id) & (F.col("agent_id") == agent_id)))


def recent(log: DataFrame, n: int, time: str = "created_at_us", *ties: str) -> DataFrame:
    return log.orderBy(F.desc(time), *ties).limit(n)


def numbered(versions: DataFrame, key: str, *order: str) -> DataFrame:
    """Monotonic version numbers per key, from 1."""
    return versions.withColumn("version", F.row_number().over(Window.partitionBy(key).orderBy(*order)))
