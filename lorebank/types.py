"""Schemas and enumerations of the data model, and the validity predicate."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The enumerations of the data model, in their order.
MEMORY_TYPES = ("Episodic", "Semantic", "Procedural", "AntiPattern", "Reasoning", "Correction")
EDGE_TYPES = ("Caused", "Before", "Related", "Contradicts", "Supports", "Supersedes", "Derived", "PartOf")
PERMISSIONS = ("Read", "Write", "ReadWrite", "Admin")
TIERS = ("Working", "Episodic", "Semantic", "Procedural", "Archival")

MEMORY = T.StructType(
    [
        T.StructField("id", T.StringType(), False),
        T.StructField("agent_id", T.StringType()),
        T.StructField("space_id", T.StringType()),
        T.StructField("memory_type", T.StringType()),
        T.StructField("content", T.StringType()),
        T.StructField("embedding", T.ArrayType(T.FloatType())),
        T.StructField("created_at_us", T.LongType()),
        T.StructField("accessed_at_us", T.LongType()),
        T.StructField("access_count", T.LongType()),
        T.StructField("salience", T.DoubleType()),
        T.StructField("confidence", T.DoubleType()),
        T.StructField("tags", T.ArrayType(T.StringType())),
        T.StructField("attributes", T.StringType()),
        T.StructField("valid_from_us", T.LongType()),
        T.StructField("valid_until_us", T.LongType()),
    ]
)

EDGE = T.StructType(
    [
        T.StructField("source", T.StringType(), False),
        T.StructField("target", T.StringType(), False),
        T.StructField("edge_type", T.StringType()),
        T.StructField("weight", T.DoubleType()),
        T.StructField("created_at_us", T.LongType()),
        T.StructField("valid_from_us", T.LongType()),
        T.StructField("valid_until_us", T.LongType()),
        T.StructField("label", T.StringType()),
    ]
)

OPERATION = T.StructType(
    [
        T.StructField("operation_type", T.StringType(), False),
        T.StructField("memory_id", T.StringType()),
        T.StructField("source", T.StringType()),
        T.StructField("target", T.StringType()),
        T.StructField("payload_json", T.StringType()),
        T.StructField("created_at_us", T.LongType()),
    ]
)

LIFECYCLE = T.StructType(
    [
        T.StructField("event_type", T.StringType(), False),
        T.StructField("memory_id", T.StringType()),
        T.StructField("reason", T.StringType()),
        T.StructField("policy", T.StringType()),
        T.StructField("payload_json", T.StringType()),
        T.StructField("created_at_us", T.LongType()),
    ]
)

def _table(**columns: str) -> T.StructType:
    kinds = {"string": T.StringType(), "double": T.DoubleType(), "long": T.LongType(), "int": T.IntegerType()}
    return T.StructType([T.StructField(name, kinds[kind]) for name, kind in columns.items()])


# Tables of the derived layer and of the logs beside it.
SOURCE = _table(memory_id="string", source_type="string", conversation_id="string", turn_id="string", actor_id="string", observed_at_us="long", extractor="string", prompt_hash="string", payload_json="string", created_at_us="long")
ENTITY = _table(entity_id="string", entity_type="string", canonical="string", confidence="double", attributes="string", created_at_us="long")
ALIAS = _table(entity_id="string", alias="string", confidence="double")
MEMORY_ENTITY = _table(memory_id="string", entity_id="string", role="string", confidence="double", evidence="string")
CLAIM = _table(claim_id="string", subject_id="string", object_id="string", predicate="string", status="string", confidence="double", valid_from_us="long", valid_until_us="long", created_at_us="long")
CLAIM_EVIDENCE = _table(claim_id="string", memory_id="string", span_start="long", span_stop="long", confidence="double")
RELATIONSHIP = _table(relationship_id="string", source="string", target="string", relation_type="string", status="string", confidence="double", valid_from_us="long", valid_until_us="long")
POLICY_RUN = _table(run_id="string", policy="string", mode="string", status="string", scope_json="string", created_at_us="long")
POLICY_ACTION = _table(run_id="string", action="string", memory_id="string", status="string", before_json="string", after_json="string", created_at_us="long")
EXTRACTION_RUN = _table(run_id="string", extractor="string", model="string", prompt_hash="string", conversation_id="string", status="string", output_json="string", created_at_us="long")
TRACE = _table(trace_id="string", query_text="string", k="int", fetch_k="int", config_json="string", created_at_us="long")
TRACE_HIT = _table(trace_id="string", rank="int", memory_id="string", score="double", vector_rank="int", bm25_rank="int", salience="double")
SNAPSHOT = _table(name="string", format_version="int", body_json="string", created_at_us="long")

RELATIONSHIP_EVIDENCE = _table(relationship_id="string", memory_id="string", confidence="double")
AGENT = _table(agent_id="string", name="string", default_space="string", metadata="string", created_at_us="long")
CACHE_ENTRY = _table(session_id="string", topic="string", context="string", memory_ids="string", used_us="long")

EXTRACTION = T.StructType(
    [
        T.StructField("memories", T.ArrayType(T.StructType([
            T.StructField("content", T.StringType()),
            T.StructField("memory_type", T.StringType()),
            T.StructField("confidence", T.DoubleType()),
            T.StructField("entities", T.ArrayType(T.StringType())),
            T.StructField("tags", T.ArrayType(T.StringType())),
            T.StructField("reasoning", T.StringType()),
        ]))),
        T.StructField("entities", T.ArrayType(T.StructType([
            T.StructField("name", T.StringType()),
            T.StructField("entity_type", T.StringType()),
            T.StructField("attributes", T.MapType(T.StringType(), T.StringType())),
        ]))),
        T.StructField("relationships", T.ArrayType(T.StructType([
            T.StructField("source", T.StringType()),
            T.StructField("target", T.StringType()),
            T.StructField("relation_type", T.StringType()),
            T.StructField("confidence", T.DoubleType()),
            T.StructField("evidence", T.StringType()),
        ]))),
    ]
)


def valid_at(at_us: Column | int, valid_from: str = "valid_from_us", valid_until: str = "valid_until_us") -> Column:
    """Half-open validity: from (0 if null) up to, and not including, until (never if null)."""
    at = at_us if isinstance(at_us, Column) else F.lit(at_us).cast("long")
    return (F.coalesce(F.col(valid_from), F.lit(0)) <= at) & (F.col(valid_until).isNull() | (at < F.col(valid_until)))
