"""From ranked hits to evidence: what is shown, counted, summed or left out."""

from __future__ import annotations

import re
from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Relations that count as the user's own, cues of a sum, budgets of evidence rows.
OWN = ("owns", "uses", "attends", "plays", "member")
NOT_OWN = ("someone_else", "considering", "wants", "previously")
SPENDING = ("money", "spend", "spent", "cost", "paid", "save", "earn", "raised")
TOTALS = ("money", "spend", "spent", "cost", "hours", "days", "miles", "raised")
UNITS = ("hours", "days", "miles")
ARTICLES = ("the ", "a ", "an ", "my ")
NO_EVIDENCE = "There is no information about this in memory."
MULTI_SESSIONS = 3
PREFIX_BYTES = 100


def tag_value(prefix: str, tags: str = "tags") -> Column:
    """What follows the prefix in the first tag that has it."""
    return F.get(F.transform(F.filter(tags, lambda t: t.startswith(prefix)), lambda t: F.substring(t, F.lit(len(prefix) + 1), F.length(t))), F.lit(0))


def has_tag_prefix(prefix: str, tags: str = "tags") -> Column:
    return F.exists(tags, lambda t: t.startswith(prefix))


def drop_derived(rows: DataFrame, synthesis_id=None) -> DataFrame:
    """Hits without entity nodes and without earlier syntheses."""
    stale = F.array_contains("tags", "synthesis:true")
    if synthesis_id is not None:
        stale = stale & (F.col("id") != synthesis_id)
    return rows.where(~has_tag_prefix("entity_name:") & ~stale)


def evidence_rows(rows: DataFrame, before_us: int | None = None) -> DataFrame:
    """Rows as evidence with session and date; entity and community nodes go.

    In more than MULTI_SESSIONS sessions the assistant's turns go too. Rows of after the question go
    unless a tag dates them.
    """
    own = rows.where(~has_tag_prefix("entity_name:") & ~F.array_contains("tags", "community_summary"))
    dated = has_tag_prefix("date:")
    if before_us is not None:
        own = own.where((F.col("created_at_us") <= before_us) | dated)
    day = F.date_add(F.lit("1970-01-01").cast("date"), F.floor(F.col("created_at_us") / 86_400_000_000).cast("int")).cast("string")
    own = own.withColumn("session", F.coalesce(tag_value("session:"), F.lit(""))).withColumn("date", F.coalesce(tag_value("date:"), day))
    sessions = rows.select(tag_value("session:").alias("s")).where("s is not null").agg(F.count_distinct("s").alias("n_sessions"))
    own = own.join(F.broadcast(sessions))  # one row
    return own.where((F.col("n_sessions") <= MULTI_SESSIONS) | ~F.array_contains("tags", "turn:assistant")).drop("n_sessions")


def near_duplicate_evidence(rows: DataFrame, order: Sequence[str] = ("date", "id")) -> DataFrame:
    """Rows without those that repeat an earlier one: equal first 100 bytes, lengths within a tenth.

    Of one prefix and length only the earliest row can stay, which a grouped minimum finds before rows
    meet by prefix; a fold over the lengths of a prefix keeps those which stay.
    """
    size = F.octet_length("content")
    key = F.substring(F.encode("content", "UTF-8"), 1, PREFIX_BYTES)
    item = F.struct(*order, size.alias("size"), F.col("id").alias("_id"))
    firsts = rows.select(key.alias("k"), size.alias("s"), item.alias("x")).groupBy("k", "s").agg(F.min("x").alias("x"))
    grouped = firsts.groupBy("k").agg(F.array_sort(F.collect_list("x")).alias("xs"))

    def step(acc: Column, x: Column) -> Column:
        close = F.exists(acc, lambda y: F.abs(y["size"] - x["size"]) * 10 <= F.greatest(y["size"], x["size"]))
        return F.when(close, acc).otherwise(F.array_append(acc, F.struct(x["size"].alias("size"), x["_id"].alias("id"))))

    kind = dict(rows.dtypes)["id"]
    kept = grouped.select(F.explode(F.aggregate("xs", F.array().cast(f"array<struct<size:int,id:{kind}>>"), step)).alias("e")).select("e.id")
    return rows.join(kept, "id", "left_semi")


def owned_entities(entities: DataFrame) -> DataFrame:
    """Entities (name, relation) that the user has or does: counted for "how many" questions, once per name."""
    r = F.lower(F.coalesce("relation", F.lit("unknown")))
    own, other = F.lit(False), F.lit(False)
    for w in OWN:
        own = own | r.contains(w)
    for w in NOT_OWN:
        other = other | r.contains(w)
    return entities.where((own | (r == "unknown")) & ~other & (F.trim("name") != "")).select(F.lower("name").alias("name")).distinct()


def linked_entities(hits: DataFrame, edges: DataFrame, entities: DataFrame) -> DataFrame:
    """Entities (id, name, relation) among the hits, and those that hits are part of, once per name."""
    direct = entities.join(hits.select("id"), "id", "left_semi")
    part = edges.where("edge_type = 'PartOf'").join(hits.select(F.col("id").alias("source")), "source", "left_semi").select(F.col("target").alias("id")).distinct()
    more = entities.join(part, "id", "left_semi").join(direct.select(F.lower("name").alias("n")).distinct(), F.lower("name") == F.col("n"), "left_anti")
    return direct.unionByName(more)


def is_sum_question(query: str) -> bool:
    q = query.lower()
    has = lambda words: any(w in q for w in words)
    return ("how much" in q and has(SPENDING)) or ("total" in q and has(TOTALS)) or ("how many" in q and ("spend" in q or "spent" in q) and has(UNITS))


def distinct_items(names: Iterable[str]) -> list[str]:
    """Names of a short list without those that repeat an earlier one: a part of it or it a part, or
    more than 0.6 of the words in common."""
    kept: list[tuple[str, str]] = []
    for name in names:
        norm = name.lower()
        for a in ARTICLES:
            norm = norm.replace(a, "")
        norm = norm.strip()
        words = set(norm.split())
        if norm and not any(norm in k or k in norm or len(words & set(k.split())) / len(words | set(k.split())) > 0.6 for k, _ in kept):
            kept.append((norm, name))
    return [n for _, n in kept]


def answer_or_abstain(items: DataFrame, text: str = "content") -> DataFrame:
    """One row: how many items there are, and the fixed sentence if there are none."""
    return items.agg(F.count(F.lit(1)).alias("items")).withColumn("answer", F.when(F.col("items") == 0, NO_EVIDENCE))


def metrics(log: DataFrame) -> DataFrame:
    """One row of counts, rates and mean latencies of an operations log (kind, hit, latency_us)."""
    kind = F.col("kind")
    rate = lambda k: F.coalesce(F.avg(F.when(kind == k, F.col("hit").cast("double"))), F.lit(0.0))
    mean = lambda k: F.coalesce(F.avg(F.when(kind == k, F.col("latency_us").cast("double"))), F.lit(0.0))
    return log.agg(
        F.count_if(kind == "write").alias("writes_total"), F.count_if(kind == "read").alias("reads_total"), F.count_if(kind == "delete").alias("deletes_total"),
        rate("cache").alias("cache_hit_rate"), mean("write").alias("avg_write_latency_us"), mean("read").alias("avg_read_latency_us"),
    )


def prometheus(row) -> str:
    """A metrics row in the text format of Prometheus."""
    return "".join(f"# TYPE lorebank_{k} {'counter' if k.endswith('_total') else 'gauge'}\nlorebank_{k} {v}\n" for k, v in row.asDict().items())


def parse_day(text: str) -> int | None:
    """Days since 1970-01-01 of a date in ISO form, with slashes allowed; None if there is none."""
    import datetime

    m = re.search(r"(\d{4})[-/](\d{1,2})[-/](\d{1,2})", text)
    try:
        return (datetime.date(*map(int, m.groups())) - datetime.date(1970, 1, 1)).days if m else None
    except ValueError:
        return None


def unresolved(gaps: DataFrame, most: int = 5) -> DataFrame:
    """Open gaps (term, priority, resolved) by priority, with their warning."""
    rank = F.array_position(F.array(F.lit("Low"), F.lit("Medium"), F.lit("High"), F.lit("Critical")), F.col("priority"))
    return gaps.where(~F.col("resolved")).withColumn("rank", rank).orderBy(F.desc("rank"), "term").limit(most).select("term", "priority", F.concat(F.lit("No stored knowledge about '"), F.col("term"), F.lit("'")).alias("warning"))


def ranks_by_session(rows: DataFrame) -> DataFrame:
    """Rows numbered within their session by date."""
    return rows.withColumn("place", F.row_number().over(Window.partitionBy("session").orderBy("date", "id")))
