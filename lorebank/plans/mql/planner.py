"""Plans: which kind of access a statement asks for, with all of its filters kept."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from lorebank.plans.mql import parser as ast

DEFAULT_LIMIT = 20


@dataclass(frozen=True)
class Plan:
    """kind: vector_search, similar_text, tag_scan, time_scan, full_scan, point_lookup, traversal,
    edge_insert, delete or consolidate."""

    kind: str
    filters: Sequence[ast.Filter] = ()
    vector: Sequence[float] | None = None
    text: str | None = None
    order_by: str | None = None
    descending: bool = False
    limit: int | None = None
    statement: object = field(default=None, compare=False)


def plan(statement) -> Plan:
    s = statement
    if isinstance(s, ast.Relate):
        return Plan("edge_insert", statement=s)
    if isinstance(s, ast.Forget):
        return Plan("delete", statement=s)
    if isinstance(s, ast.Traverse):
        return Plan("traversal", statement=s)
    if isinstance(s, ast.Consolidate):
        return Plan("consolidate", tuple(s.filters), statement=s)
    text = next((f.value for f in s.filters if f.op == "~>"), None)
    rest = tuple(f for f in s.filters if f.op != "~>")
    if s.near is not None:
        kind = "vector_search"
    elif text is not None:
        kind = "similar_text"
    elif rest and all(f.field == "tag" for f in rest):
        kind = "tag_scan"
    elif any(f.field in ("created", "accessed") for f in rest):
        kind = "time_scan"
    else:
        kind = "full_scan"
    return Plan(kind, rest, s.near, text, s.order_by, s.descending, DEFAULT_LIMIT if s.limit is None else s.limit, s)
