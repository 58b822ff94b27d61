"""Graph operators on an edge table (source, target, edge_type, weight, ...).

Traversals go level by level: a frontier joins the edges, loses what was visited, and is written to
the checkpoint folder, so plans stay small, paths never multiply, and a lost executor costs one level.
"""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lorebank.runtime import durable
from lorebank.types import valid_at

FLAT = 8
# Factors of belief propagation.
CAUSED, SUPPORTS, CONTRADICTS, SUPERSEDES, BELIEF_DEPTH = 0.9, 0.5, 0.7, 0.1, 5


def of_types(edges: DataFrame, kinds: Sequence[str] | None) -> DataFrame:
    """Edges of the listed types; None means all, an empty list none."""
    return edges if kinds is None else edges.where(F.col("edge_type").isin(*kinds) if kinds else F.lit(False))


def at_time(edges: DataFrame, at_us: int | None) -> DataFrame:
    return edges if at_us is None else edges.where(valid_at(at_us))


def nodes(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("source").alias("id")).union(edges.select("target")).distinct()


def neighbours(edges: DataFrame, node, kinds: Sequence[str] | None = None, direction: str = "both") -> DataFrame:
    """Distinct other endpoints."""
    edges = of_types(edges, kinds)
    out = edges.where(F.col("source") == node).select(F.col("target").alias("id"))
    into = edges.where(F.col("target") == node).select(F.col("source").alias("id"))
    return {"outgoing": out, "incoming": into, "both": out.union(into)}[direction].distinct()


def grown(visited: DataFrame, level: DataFrame, depth: int) -> DataFrame:
    """What was visited and one more level; written anew every FLAT levels, so plans do not grow with the depth."""
    both = visited.unionByName(level)
    return durable(both) if depth % FLAT == 0 else both


def bfs(edges: DataFrame, roots: DataFrame, depth: int, kinds: Sequence[str] | None = None, at_us: int | None = None) -> DataFrame:
    """id and least depth of all that the roots (column id) reach along outgoing edges within ``depth``."""
    steps = at_time(of_types(edges, kinds), at_us).select("source", F.col("target").alias("id")).distinct()
    reached = durable(roots.select("id").distinct().withColumn("depth", F.lit(0)))
    visited, level = reached, reached
    for d in range(1, depth + 1):
        step = level.select(F.col("id").alias("source")).join(steps, "source").select("id").distinct()
        level = durable(step.join(visited.select("id"), "id", "left_anti").withColumn("depth", F.lit(d)))
        if level.isEmpty():
            break
        visited = grown(visited, level, d)
    return visited


def dfs(edges: DataFrame, start, depth: int) -> DataFrame:
    """id and depth in the order of a depth-first walk that takes neighbours in id order.

    The walk marks a node at its first visit, so a depth may not be the least one, and what is only
    reachable in time by a shorter way seen later is missed. It is sequential by nature and runs in one
    task, on the part of the graph that the start reaches within the depth.
    """
    spark = edges.sparkSession
    kind = dict(edges.dtypes)["source"]
    root = spark.range(1).select(F.lit(start).cast(kind).alias("id")).join(nodes(edges), "id", "left_semi")
    near = subgraph_edges(edges.select("source", "target"), bfs(edges, root, depth)).distinct()
    near = near.unionByName(root.select(F.col("id").alias("source"), F.col("id").alias("target")))  # a known start without edges

    def walk(part: pd.DataFrame) -> pd.DataFrame:
        after = part.sort_values("target", ascending=False).groupby("source")["target"].agg(list).to_dict()
        seen, out, stack = set(), [], [(start, 0)]
        while stack:
            node, d = stack.pop()
            if node in seen:
                continue
            seen.add(node)
            out.append((node, d, len(out)))
            if d < depth:
                stack += [(x, d + 1) for x in after.get(node, []) if x not in seen]
        return pd.DataFrame(out, columns=["id", "depth", "place"])

    return near.withColumn("part", F.lit(1)).groupBy("part").applyInPandas(walk, f"id {kind}, depth int, place int")


def subgraph_edges(edges: DataFrame, reached: DataFrame) -> DataFrame:
    """Edges whose two endpoints were reached."""
    ids = reached.select("id")
    return edges.join(ids.withColumnRenamed("id", "source"), "source", "left_semi").join(ids.withColumnRenamed("id", "target"), "target", "left_semi")


def shortest_path(edges: DataFrame, start, goal, longest: int | None = None) -> list | None:
    """The first of the shortest paths in id order, by levels from the start; None if there is none.

    With ``longest``, paths of more steps do not count.
    """
    spark = edges.sparkSession
    kind = dict(edges.dtypes)["source"]
    frontier = spark.range(1).select(F.lit(start).cast(kind).alias("id"), F.array(F.lit(start).cast(kind)).alias("path"))
    if start == goal:
        return [start]
    steps = edges.select(F.col("source"), F.col("target").alias("next")).distinct()
    visited = frontier.select("id")
    depth = 0
    while longest is None or depth < longest:
        step = frontier.join(steps, frontier.id == steps.source).select(F.col("next").alias("id"), F.concat("path", F.array("next")).alias("path"))
        frontier = durable(step.join(visited, "id", "left_anti").groupBy("id").agg(F.min("path").alias("path")))
        if found := frontier.where(F.col("id") == goal).head():
            return list(found.path)
        if frontier.isEmpty():
            return None
        depth += 1
        visited = grown(visited, frontier.select("id"), depth)
    return None


def contradictions(edges: DataFrame, node) -> DataFrame:
    """Direct contradictions both ways, and those of its direct supporters and of what it supports."""
    kind = F.col("edge_type")
    both = edges.select("source", "target", "edge_type").union(edges.select("target", "source", "edge_type"))
    direct = both.where((F.col("source") == node) & (kind == "Contradicts")).select(F.col("target").alias("id"))
    supporting = both.where((F.col("source") == node) & (kind == "Supports")).select(F.col("target").alias("via")).distinct()
    outgoing = edges.where(kind == "Contradicts").select(F.col("source").alias("via"), F.col("target").alias("id"))
    return direct.union(outgoing.join(supporting, "via").where(F.col("id") != node).select("id")).distinct()


def on_cycles(steps: DataFrame, rounds: int = 4) -> DataFrame:
    """Edges (source, target) without some that lie on no cycle: those that nothing leads to or that lead nowhere.

    Each round takes off a layer, so trees and long tails are not walked; fewer rounds only leave more.
    """
    left = durable(steps)
    for _ in range(rounds):
        before = left.count()
        left = durable(left.join(left.select(F.col("target").alias("source")).distinct(), "source", "left_semi").join(left.select(F.col("source").alias("target")).distinct(), "target", "left_semi").select("source", "target"))
        if left.count() == before:
            break
    return left


def detect_cycles(edges: DataFrame, kinds: Sequence[str] | None = None, longest: int = 8) -> DataFrame:
    """Node sets (sorted arrays) of the simple cycles up to a length, each once.

    Paths start at a cycle's smallest node and visit larger ones only, so a cycle is found once.
    """
    steps = on_cycles(of_types(edges, kinds).select("source", "target").distinct())
    paths = steps.select(F.col("source").alias("root"), F.col("target").alias("last"), F.array("source", "target").alias("path"))
    paths = paths.where(F.col("last") >= F.col("root"))
    found = paths.where(F.col("last") == F.col("root")).select(F.array("root").alias("cycle"))
    paths = durable(paths.where(F.col("last") > F.col("root")))
    for _ in range(2, longest + 1):
        step = paths.join(steps, paths.last == steps.source).where(F.col("target") >= F.col("root"))
        found = found.union(step.where(F.col("target") == F.col("root")).select(F.array_sort("path").alias("cycle")))
        paths = durable(step.where((F.col("target") > F.col("root")) & ~F.array_contains("path", F.col("target"))).select("root", F.col("target").alias("last"), F.concat("path", F.array("target")).alias("path")))
        if paths.isEmpty():
            break
    return found.distinct()


def propagate_belief(edges: DataFrame, changed, confidence: float, depth: int = BELIEF_DEPTH) -> DataFrame:
    """id and confidence after a change, level by level.

    Within a level the edges into one node are folded in the order of source, then type; a node that
    was reached before is given its new value but does not pass it on again.
    """
    spark = edges.sparkSession
    kind = dict(edges.dtypes)["source"]
    known = spark.range(1).select(F.lit(changed).cast(kind).alias("id"), F.lit(float(confidence)).alias("confidence"))
    frontier = known
    steps = edges.where(F.col("edge_type").isin("Caused", "Supports", "Contradicts", "Supersedes"))

    def fold(current, e):
        p, w, t = e["confidence"], e["weight"], e["edge_type"]
        clamp = lambda x: F.greatest(F.lit(0.0), F.least(F.lit(1.0), x))
        return (
            F.when(t == "Caused", p * w * CAUSED)
            .when(t == "Supports", clamp(current + (p - 1.0) * w * SUPPORTS))
            .when(t == "Contradicts", clamp(current - p * w * CONTRADICTS))
            .otherwise(F.least(current, p * SUPERSEDES))
        )

    for _ in range(depth):
        into = frontier.join(steps, frontier.id == steps.source).select(F.col("target").alias("id"), F.struct("source", "edge_type", F.col("weight").cast("double").alias("weight"), "confidence").alias("e"))
        into = into.groupBy("id").agg(F.array_sort(F.collect_list("e")).alias("es"))
        into = into.join(known.withColumnRenamed("confidence", "before"), "id", "left")
        moved = durable(into.select("id", F.aggregate("es", F.coalesce("before", F.lit(1.0)), fold).alias("confidence"), F.col("before").isNull().alias("new")))
        if moved.isEmpty():
            break
        known = known.join(moved.select("id"), "id", "left_anti").unionByName(moved.select("id", "confidence"))
        frontier = moved.where("new").select("id", "confidence")
    return known


def latest_pair_edges(edges: DataFrame) -> DataFrame:
    """Of parallel edges (source, target, edge_type) the one created last, then the heaviest."""
    order = Window.partitionBy("source", "target", "edge_type").orderBy(F.desc("created_at_us"), F.desc("weight"))
    return edges.withColumn("_r", F.row_number().over(order)).where("_r = 1").drop("_r")


def strengthened(edges: DataFrame, source, target, by: float, now_us: int) -> DataFrame:
    """A second edge with more weight (1 at most) beside the newest one between two nodes."""
    pair = edges.where((F.col("source") == source) & (F.col("target") == target))
    return edges.unionByName(latest_pair_edges(pair).withColumn("weight", F.least(F.col("weight") + by, F.lit(1.0))).withColumn("created_at_us", F.lit(now_us)))


def projection_nodes(rows: DataFrame, limit: int = 500, label_chars: int = 40, preview_chars: int = 160) -> DataFrame:
    """The most salient nodes with a label (first line that is not blank) and a preview."""
    lines = F.filter(F.split("content", "\n"), lambda x: F.trim(x) != "")
    chosen = rows.orderBy(F.desc("salience"), F.desc("created_at_us"), "id").limit(limit)
    return chosen.select("id", "memory_type", "salience", "created_at_us", F.substring(F.trim(F.coalesce(F.get(lines, F.lit(0)), F.lit(""))), 1, label_chars).alias("label"), F.substring("content", 1, preview_chars).alias("preview"))


def projection_edges(edges: DataFrame, shown: DataFrame) -> DataFrame:
    """Edges among the shown nodes, parallel ones of a type once."""
    columns = ["source", "target", "edge_type", *[c for c in ("label",) if c in edges.columns]]
    return subgraph_edges(edges, shown).dropDuplicates(columns)


def resolve_states(edges: DataFrame, relations: Sequence[str]) -> DataFrame:
    """Of each source's edges of a stateful relation (label up to the colon) all but the newest, closed.

    Adds to each outdated edge the end of its validity, the creation of the newest one.
    """
    rel = F.substring_index("label", ":", 1)
    own = edges.withColumn("relation", rel).where(F.col("relation").isin(*relations))
    group = Window.partitionBy("source", "relation")
    out = own.withColumn("_r", F.row_number().over(group.orderBy(F.desc("created_at_us"), "target"))).withColumn("newest_us", F.max("created_at_us").over(group))
    return out.where(F.col("_r") > 1).select("source", "target", "relation", "created_at_us", F.col("newest_us").alias("valid_until_us"))


# Relations of which an entity has one at a time.
STATEFUL_RELATIONS = ("lives_in", "works_at", "has_role", "married_to", "dating", "owns", "uses", "drives", "studies_at", "located_in", "employed_by", "salary", "title", "status")
