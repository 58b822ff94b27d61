"""Plans to lazy DataFrames; Catalyst does the rest."""

from __future__ import annotations

import datetime
from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lorebank.functions.vectors import cosine_to
from lorebank.operators import filters, graph, lifecycle, pairs, policies, retrieval
from lorebank.plans.mql.parser import Filter, MqlError, parse
from lorebank.plans.mql.planner import Plan, plan

COLUMNS = {"content": "content", "type": "memory_type", "agent": "agent_id", "space": "space_id", "salience": "salience", "confidence": "confidence", "created": "created_at_us", "accessed": "accessed_at_us"}
CLUSTER_ABOVE = 0.85


@dataclass
class Engine:
    """What statements run against. ``hide`` drops rows that are not current at ``now_us`` from recalls."""

    memories: DataFrame
    edges: DataFrame
    now_us: int
    embed: Callable[[str], Sequence[float]] | None = None
    hide: bool = False
    cluster_above: float = CLUSTER_ABOVE


def micros(value: object) -> int:
    """A time as microseconds: a number as it is, a text as an ISO date or time in UTC."""
    if isinstance(value, int | float):
        return int(value)
    try:
        t = datetime.datetime.fromisoformat(str(value))
    except ValueError:
        raise MqlError(f"no date: {value!r}") from None
    t = t if t.tzinfo else t.replace(tzinfo=datetime.UTC)
    return (t - datetime.datetime(1970, 1, 1, tzinfo=datetime.UTC)) // datetime.timedelta(microseconds=1)


def condition(f: Filter) -> Column:
    if f.field == "tag":
        has = F.coalesce(F.array_contains("tags", str(f.value)), F.lit(False))
        if f.op not in ("=", "!="):
            raise MqlError(f"tags have no {f.op}")
        return has if f.op == "=" else ~has
    left = F.col(COLUMNS[f.field])
    right = F.lit(micros(f.value)) if f.field in ("created", "accessed") else F.lit(f.value)
    return {"=": left == right, "!=": left != right, ">": left > right, "<": left < right, ">=": left >= right, "<=": left <= right}[f.op]


def filtered(rows: DataFrame, conditions: Sequence[Filter]) -> DataFrame:
    for f in conditions:
        rows = rows.where(condition(f))
    return rows


def execute(p: Plan, engine: Engine) -> DataFrame:
    """The result of a plan. Changes return the changed table: edges, or memories that are left."""
    s = p.statement
    if p.kind == "edge_insert":
        kind = dict(engine.edges.dtypes)["source"]
        ends = engine.memories.where(F.col("id").cast("string").isin(str(s.source), str(s.target))).select("id").distinct().count()
        if ends < len({str(s.source), str(s.target)}):
            raise MqlError("an endpoint of the edge is unknown")
        new = engine.edges.sparkSession.range(1).select(F.lit(s.source).cast(kind).alias("source"), F.lit(s.target).cast(kind).alias("target"), F.lit(s.edge_type).alias("edge_type"), F.lit(float(s.weight)).alias("weight"), F.lit(engine.now_us).cast("long").alias("created_at_us"))
        return engine.edges.unionByName(new, allowMissingColumns=True)
    if p.kind == "delete":
        return policies.forget_hard(engine.memories, engine.edges, policies.forget_scope("memory", s.id, engine.memories))[0]
    if p.kind == "traversal":
        roots = engine.memories.where(F.col("id") == s.start).select("id")
        return graph.bfs(engine.edges, roots, s.depth, s.edge_types)
    rows = filtered(engine.memories, p.filters)
    if p.kind == "consolidate":
        due = rows.where(lifecycle.should_consolidate(engine.now_us))
        links = pairs.similar_pairs(due, engine.cluster_above)
        return lifecycle.consolidated(due, pairs.components(links))
    if engine.hide:
        rows = filters.current(rows, engine.edges, engine.now_us, [f.value for f in p.filters if f.field == "tag"])
    vector = p.vector
    if p.kind == "similar_text":
        if engine.embed is None:
            raise MqlError("~> needs an embedder")
        vector = list(engine.embed(p.text))
    order = [F.col(COLUMNS.get(p.order_by, "id") if p.order_by != "tag" else "tags")] if p.order_by else []
    order = [c.desc() if p.descending else c.asc() for c in order]
    if vector is not None:
        rows = rows.where(F.col("embedding").isNotNull()).withColumn("score", F.greatest(F.lit(0.0), F.least(F.lit(1.0), cosine_to("embedding", vector))))
        if order:  # the best k, then in the order asked for
            return retrieval.top(rows, "score", p.limit).orderBy(*order, "id")
        return retrieval.top(rows, "score", p.limit)
    return rows.orderBy(*order, "id").limit(p.limit)


def run(text: str, engine: Engine) -> DataFrame:
    """Parse, plan and execute one statement."""
    return execute(plan(parse(text)), engine)
