"""Predicates and suppressions over memories and edges."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lorebank.functions.text import permits
from lorebank.types import valid_at

ARCHIVED = "archived"


def tags_any(tags: Sequence[str], column: str = "tags") -> Column:
    return F.arrays_overlap(F.coalesce(F.col(column), F.array().cast("array<string>")), F.array(*[F.lit(t) for t in tags]).cast("array<string>"))


def tags_all(tags: Sequence[str], column: str = "tags") -> Column:
    """Every requested tag; an empty or repeating request matches nothing."""
    if not tags or len(set(tags)) < len(tags):
        return F.lit(False)
    out = F.lit(True)
    for t in tags:
        out = out & F.array_contains(column, t)
    return F.coalesce(out, F.lit(False))


def tag_prefix(prefix: str, column: str = "tags") -> Column:
    return F.exists(column, lambda t: t.startswith(prefix))


def created_between(start_us: int | None, end_us: int | None, column: str = "created_at_us") -> Column:
    """Inclusive at both ends; None leaves an end open."""
    out = F.lit(True)
    if start_us is not None:
        out = out & (F.col(column) >= start_us)
    if end_us is not None:
        out = out & (F.col(column) <= end_us)
    return out


def visible(tags: Sequence[str] = (), column: str = "tags") -> Column:
    """Archived rows are hidden unless the tag is asked for."""
    return F.lit(True) if ARCHIVED in tags else ~F.coalesce(F.array_contains(column, ARCHIVED), F.lit(False))


def candidates(rows: DataFrame, tags: Sequence[str] = (), tags_or: bool = False, start_us: int | None = None, end_us: int | None = None) -> DataFrame:
    """Rows by tag and time; Catalyst pushes what it can into the scan."""
    keep = created_between(start_us, end_us)
    if tags:
        keep = keep & (tags_any(tags) if tags_or else tags_all(tags))
    return rows.where(keep)


def suppressed(edges: DataFrame, at_us: int, kinds: Sequence[str] = ("Supersedes", "Contradicts")) -> DataFrame:
    """Ids with an incoming superseding or contradicting edge that is valid at a time."""
    return edges.where(F.col("edge_type").isin(*kinds) & valid_at(at_us)).select(F.col("target").alias("id")).distinct()


def without_suppressed(rows: DataFrame, edges: DataFrame, at_us: int) -> DataFrame:
    return rows.join(suppressed(edges, at_us), "id", "left_anti")


def current(rows: DataFrame, edges: DataFrame, at_us: int, tags: Sequence[str] = ()) -> DataFrame:
    """Rows a recall may return at a time: valid, not suppressed, not archived."""
    return without_suppressed(rows.where(valid_at(at_us) & visible(tags)), edges, at_us)


def accessible_spaces(spaces: DataFrame, acl: DataFrame, agent_id, permission: str) -> DataFrame:
    """Spaces that an agent owns or has a sufficient grant for.

    ``spaces``: space_id, owner_id; ``acl``: space_id, agent_id, permission.
    """
    granted = acl.where((F.col("agent_id") == agent_id) & permits("permission", F.lit(permission))).select("space_id")
    return spaces.where(F.col("owner_id") == agent_id).select("space_id").union(granted).distinct()


def latest(rows: DataFrame, key: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """One row per key: the first by ``order``."""
    from pyspark.sql import Window

    rank = "_rank"
    return rows.withColumn(rank, F.row_number().over(Window.partitionBy(*key).orderBy(*order))).where(F.col(rank) == 1).drop(rank)
