"""Context assembly: zones, token budget, serialisation and deltas.

A context is one window for one reader. The greedy fill folds an array, but only of rows that can
matter: once a text of some cost does not fit, no later one of that cost does, so of each cost c the
best budget / c rows suffice. That is about budget x ln(budget) rows, however many there are.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lorebank.functions.text import token_estimate

# Zones in order, their labels, thresholds and shares of a budget.
ZONES = ("Opening", "Critical", "Primary", "Supporting", "Closing")
LABELS = ("⚠️ Warnings & Corrections", "🎯 Critical Context", "📋 Primary Context", "📎 Supporting Context", "🔁 Summary & Reinforcement")
CRITICAL_SCORE, CRITICAL_SALIENCE, PRIMARY_SCORE, SUPPORTING_SCORE = 0.8, 0.7, 0.5, 0.2
SHARES = (10, 25, 35, 20, 10)
BUDGET = 4096
#: Characters of a numbered line without its text, and its line feed.
LEAST_LINE = len("1.  (score 0.000)\n")


def zone() -> Column:
    score = F.col("score")
    return (
        F.when(F.col("memory_type").isin("AntiPattern", "Correction"), "Opening")
        .when((score >= CRITICAL_SCORE) & (F.col("salience") >= CRITICAL_SALIENCE), "Critical")
        .when(score >= PRIMARY_SCORE, "Primary")
        .when(score >= SUPPORTING_SCORE, "Supporting")
        .otherwise("Closing")
    )


def zone_order(column: str = "zone") -> Column:
    return F.array_position(F.array(*[F.lit(z) for z in ZONES]), F.col(column))


def zone_allocation(spark, total: int) -> DataFrame:
    """zone and tokens: each zone's share of a budget, rounded down."""
    return spark.range(len(ZONES)).select(F.element_at(F.array(*[F.lit(z) for z in ZONES]), (F.col("id") + 1).cast("int")).alias("zone"), F.floor(F.lit(total) * F.element_at(F.array(*[F.lit(s) for s in SHARES]), (F.col("id") + 1).cast("int")) / 100).cast("long").alias("tokens"))


def fill_budget(rows: DataFrame, budget: int = BUDGET, key: Sequence[str] = ()) -> DataFrame:
    """The rows that a greedy fill includes, best score first, skipping what does not fit.

    With ``key`` each key has a budget of its own. Blank texts cost nothing and always fit, so they do
    not go through the fold.
    """
    costed = rows.withColumn("tokens", F.coalesce(token_estimate("content"), F.lit(0)))
    item = F.struct((-F.col("score")).alias("neg"), F.col("id").alias("id"), F.col("tokens").alias("tokens"))
    place = F.row_number().over(Window.partitionBy(*key, "tokens").orderBy(F.desc("score"), "id"))
    able = costed.where((F.col("tokens") > 0) & (F.col("tokens") <= budget)).select(*key, "score", "id", "tokens").withColumn("_place", place)
    able = able.where(F.col("_place") <= F.lit(budget) / F.col("tokens"))
    grouped = able.select(*key, item.alias("x")).groupBy(*key).agg(F.array_sort(F.collect_list("x")).alias("xs"))
    start = F.struct(F.lit(0).cast("long").alias("used"), F.array().cast(f"array<{dict(rows.dtypes)['id']}>").alias("ids"))

    def step(acc: Column, x: Column) -> Column:
        fits = acc["used"] + x["tokens"] <= budget
        return F.when(fits, F.struct((acc["used"] + x["tokens"]).alias("used"), F.array_append(acc["ids"], x["id"]).alias("ids"))).otherwise(acc)

    chosen = grouped.select(*key, F.explode(F.aggregate("xs", start, step)["ids"]).alias("id"))
    return costed.join(chosen, [*key, "id"], "left_semi").unionByName(costed.where(F.col("tokens") == 0))


def blocks(included: DataFrame) -> DataFrame:
    """zone, memories and tokens of the zones in use."""
    return included.withColumn("zone", zone()).groupBy("zone").agg(F.count(F.lit(1)).alias("memories"), F.sum(token_estimate("content")).alias("tokens"))


def compact_line() -> Column:
    tags = F.when(F.size("tags") > 0, F.concat(F.lit("|tags:"), F.array_join("tags", ","))).otherwise(F.lit(""))
    return F.concat(F.lit("M|"), F.col("memory_type"), F.lit("|"), F.format_string("%.2f", F.col("salience")), F.lit("|"), F.col("content"), tags)


def structured_line() -> Column:
    tags = F.when(F.size("tags") > 0, F.concat(F.lit(" ["), F.array_join("tags", ", "), F.lit("]"))).otherwise(F.lit(""))
    return F.concat(F.lit("- **["), F.col("memory_type"), F.lit("]** (salience: "), F.format_string("%.2f", F.col("salience")), F.lit(") "), F.col("content"), tags)


def delta_line() -> Column:
    return F.concat(F.lit("- [NEW] "), F.col("memory_type"), F.lit(" | "), F.col("content"))


def relationship_line() -> Column:
    return F.concat(F.lit("- "), F.substring(F.col("source").cast("string"), 1, 8), F.lit(" --["), F.col("edge_type"), F.format_string(" w=%.2f]--> ", F.col("weight")), F.substring(F.col("target").cast("string"), 1, 8))


def serialise(included: DataFrame, style: str = "structured", header: str = "") -> DataFrame:
    """One row with the text of a context: zones in order, rows by score."""
    line = {"compact": compact_line, "structured": structured_line, "delta": delta_line}[style]()
    label = F.element_at(F.array(*[F.lit(x) for x in LABELS]), F.col("z").cast("int"))
    mark, gap = ("# ", "") if style == "compact" else ("## ", "\n" if style == "structured" else "")
    rows = included.withColumn("zone", zone()).select(zone_order().alias("z"), F.struct((-F.col("score")).alias("a"), F.col("id").alias("b"), line.alias("line")).alias("x"))
    per_zone = rows.groupBy("z").agg(F.array_join(F.transform(F.array_sort(F.collect_list("x")), lambda x: x["line"]), "\n").alias("body"))
    part = F.struct("z", F.concat(F.lit(mark), label, F.lit("\n"), F.col("body"), F.lit(gap)).alias("part"))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(part)), lambda p: p["part"]), "\n")
    return per_zone.agg((F.concat(F.lit(f"{header}\n\n"), text) if style == "delta" else text).alias("context"))


def assemble(rows: DataFrame, budget: int = BUDGET, style: str = "structured") -> DataFrame:
    return serialise(fill_budget(rows, budget), style)


def delta(previous: DataFrame, now: DataFrame) -> DataFrame:
    """id and status (added, removed, unchanged) between two served sets."""
    a, b = previous.select("id", F.lit(True).alias("was")).distinct(), now.select("id", F.lit(True).alias("is")).distinct()
    status = F.when(F.col("was").isNull(), "added").when(F.col("is").isNull(), "removed").otherwise("unchanged")
    return a.join(b, "id", "full").select("id", status.alias("status"))


def delta_text(changes: DataFrame, rows: DataFrame) -> DataFrame:
    """The readable form: new texts, removals (one by name, more by count), the number unchanged."""
    told = changes.join(rows.select("id", "content"), "id", "left")
    new = F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("status") == "added", F.struct("id", "content")))), lambda x: F.concat(F.lit("[NEW] "), x["content"])), "\n")
    n_gone, gone = F.count_if(F.col("status") == "removed"), F.max(F.when(F.col("status") == "removed", F.col("content")))
    removed = F.when(n_gone == 1, F.concat(F.lit("[REMOVED] "), gone)).when(n_gone > 1, F.concat(F.lit("[REMOVED] "), n_gone.cast("string"), F.lit(" memories no longer relevant")))
    same = F.count_if(F.col("status") == "unchanged")
    kept = F.when(same > 0, F.concat(F.lit("[UNCHANGED] "), same.cast("string"), F.lit(" memories from previous turn")))
    return told.agg(F.concat_ws("\n", F.when(new != "", new), removed, kept).alias("delta"))


def assemble_delta(previous: DataFrame, now: DataFrame, budget: int = BUDGET, header: str = "") -> DataFrame:
    """The context of what was added; the header's tokens are spent first."""
    added = now.join(previous.select("id"), "id", "left_anti")
    spent = -(-len(header.split()) * 13 // 10)
    return serialise(fill_budget(added, max(0, budget - spent)), "delta", header)


def bounded_list(rows: DataFrame, cap: int, text: str = "content") -> DataFrame:
    """Numbered lines with scores until the character cap; stops at the first line that does not fit.

    A first line that alone is too long is cut. No line is shorter than LEAST_LINE, so only the best rows that
    could fit are ranked.
    """
    rows = rows.orderBy(F.desc("score"), "id").limit(cap // LEAST_LINE + 1)
    order = Window.orderBy(F.desc("score"), "id")
    n = F.row_number().over(order)
    lines = rows.select("id", "score", n.alias("n"), F.concat(n.cast("string"), F.lit(". "), F.col(text), F.format_string(" (score %.3f)", F.col("score"))).alias("line"))
    used = F.sum(F.length("line") + 1).over(order.rowsBetween(Window.unboundedPreceding, 0)) - 1
    lines = lines.withColumn("used", used)
    return lines.where((F.col("used") <= cap) | (F.col("n") == 1)).select("id", "n", F.substring("line", 1, cap).alias("line"))


def session_headers(rows: DataFrame) -> DataFrame:
    """Numbered evidence lines in order of date; a header line wherever the session changes.

    ``rows``: pos, session, date, content.
    """
    order = Window.orderBy("pos")
    changed = ~F.lag("session").over(order).eqNullSafe(F.col("session")) | (F.row_number().over(order) == 1)
    head = F.when(changed, F.concat(F.lit("--- [Session: "), F.col("session"), F.lit("] ---\n"))).otherwise(F.lit(""))
    line = F.concat(head, F.lit("["), F.row_number().over(order).cast("string"), F.lit("] ["), F.col("date"), F.lit("] "), F.col("content"))
    return rows.select("pos", line.alias("line"))
