"""Signals on text: pain warnings, knowledge gaps, query intent and time windows."""

from __future__ import annotations

import datetime
import re
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lorebank.functions.text import bare_words, ngrams

DAY_US = 86_400_000_000

# Cue lists of the query intents.
TEMPORAL = ("when", "how long", "before", "after", "first", "most recent", "days", "weeks", "months ago", "order", "ago", "last saturday", "last sunday", "last monday", "last tuesday", "last wednesday", "last thursday", "last friday")
ORDERING = ("order", "earliest", "latest", "first", "most recent")
PREFERENCE = ("suggest", "recommend", "any tips", "any advice", "what should", "do you think", "can you help me find")
KNOWLEDGE_UPDATE = ("current", "latest", "now", "updated", "changed", "still", "most recent", "switch", "previously", "how often", "how many followers", "new")
CONTEXTUAL = ("who did", "who was", "who accompanied", "who joined", "who came", "where did we", "what happened", "what did we do", "who else", "who went")
WEEKDAYS = ("monday", "tuesday", "wednesday", "thursday", "friday", "saturday", "sunday")
NUMBERS = ("zero", "one", "two", "three", "four", "five", "six", "seven", "eight", "nine", "ten")
UNIT_DAYS = (("day", 1), ("week", 7), ("month", 30), ("year", 365))
NOT_NAMES = ("The", "This", "That", "With", "From", "About", "When", "What", "Where", "Which", "User", "They", "Their", "Have", "Been", "Will", "Would", "Could", "Should")
MAX_WARNINGS = 5
LONGEST_TERM = 5


def pain_scores(signals: DataFrame, keywords: Sequence[str], now_us: int | None = None) -> DataFrame:
    """Signals (id, description, intensity, triggers, decay_rate, created_at_us) that a context touches, by score.

    The score is the intensity, decayed if a time is given, times the share of triggers that occur.
    """
    context = [k.lower() for k in keywords]
    age = F.greatest(F.lit(now_us or 0) - F.col("created_at_us"), F.lit(0)).cast("double")
    strength = F.col("intensity") * F.exp(-F.col("decay_rate") * age) if now_us is not None else F.col("intensity")
    hit = F.filter("triggers", lambda t: F.exists(F.array(*[F.lit(c) for c in context]).cast("array<string>"), lambda c: c.contains(F.lower(t))))
    scored = signals.withColumn("strength", strength).withColumn("score", F.col("strength") * F.size(hit) / F.greatest(F.size("triggers"), F.lit(1)))
    return scored.where(F.size(hit) > 0).orderBy(F.desc("score"), "id")


def pain_warnings(scored: DataFrame, most: int = MAX_WARNINGS) -> DataFrame:
    top = scored.orderBy(F.desc("score"), "id").limit(most)
    return top.select("id", F.format_string("CAUTION: %s (pain: %.2f). Triggers: [%s]", "description", "strength", F.array_join("triggers", ", ")).alias("warning"))


def registry_gaps(texts: DataFrame, registry: DataFrame, known: DataFrame) -> DataFrame:
    """Registered terms that a text mentions and that are not known: id, term, priority.

    ``texts``: id, content; ``registry`` and ``known``: term. The registry is matched in one pass over
    the texts' word n-grams, so it may be large.
    """
    words = texts.select("id", bare_words("content").alias("w"))
    grams = words.select("id", F.explode(ngrams(F.col("w"), LONGEST_TERM)).alias("gram"))
    terms = registry.select("term", F.lower("term").alias("gram")).dropDuplicates(["gram"])
    unknown = terms.join(known.select(F.lower("term").alias("gram")), "gram", "left_anti")
    return grams.join(unknown, "gram").select("id", "term", F.when(F.size(F.split("term", r"\s+")) > 1, "High").otherwise("Medium").alias("priority"))


def heuristic_gaps(text: str, stop_words: Sequence[str] = (), known: Sequence[str] = (), least: int = 3) -> list[str]:
    """Quoted terms, runs of capitalised words and technical tokens of a text, each once."""
    seen, out = {k.lower() for k in known}, []

    def add(term: str) -> None:
        if term.lower() not in seen:
            seen.add(term.lower())
            out.append(term)

    for quoted in re.findall(r"['\"‘’]([^'\"‘’]*)['\"‘’]", text):
        if len(quoted.strip().encode()) >= 2:
            add(quoted.strip())
    run: list[str] = []

    def close() -> None:
        if run and not (len(run) == 1 and (run[0].lower() in stop_words or len(run[0].encode()) < 2)):
            add(" ".join(run))
        run.clear()

    for raw in text.split():
        word = re.sub(r"^[^\w.\-]+|[^\w.\-]+$", "", raw)
        if word[:1].isupper():
            run.append(word)
            continue
        close()
        if len(word) >= least and (any(c in "-._" for c in word) or all(c.isupper() or c in "0123456789_" for c in word)):
            add(word)
    close()
    return out


def follow_up_words(text: Column | str, most: int = 10) -> Column:
    """Capitalised words of more than three characters, without common ones, sorted, at most ``most``."""
    c = F.col(text) if isinstance(text, str) else text
    trimmed = F.transform(F.split(c, r"\s+"), lambda w: F.regexp_replace(w, r"^[^\p{L}\p{N}]+|[^\p{L}\p{N}]+$", ""))
    names = F.filter(trimmed, lambda w: (F.octet_length(w) > 3) & w.rlike(r"^\p{Lu}") & ~w.isin(*NOT_NAMES))
    return F.slice(F.array_sort(F.array_distinct(names)), 1, most)


@dataclass(frozen=True)
class Intent:
    temporal: bool
    ordering: bool
    preference: bool
    knowledge_update: bool
    contextual: bool


def intent(query: str) -> Intent:
    q = query.lower()
    has = lambda cues: any(c in q for c in cues)
    temporal = has(TEMPORAL) or ("last" in q and ("week" in q or "month" in q))
    return Intent(temporal, temporal and has(ORDERING), has(PREFERENCE), has(KNOWLEDGE_UPDATE), has(CONTEXTUAL))


def number(word: str) -> int | None:
    if word.isdigit():
        return int(word)
    if word in ("a", "an"):
        return 1
    return NUMBERS.index(word) if word in NUMBERS[1:] else None


def days_back(query: str, reference_us: int) -> int | None:
    """Days between a query's reference and the time it speaks of; None if it names none."""
    words = [w.strip("?.,!") for w in query.lower().split()]
    for n, unit in zip(words, words[1:], strict=False):
        days = next((d for name, d in UNIT_DAYS if unit.startswith(name)), None)
        if days and n.isdigit():
            return int(n) * days
    if "last" in words:
        today = datetime.datetime.fromtimestamp(reference_us / 1e6, datetime.UTC).weekday()
        for k, name in enumerate(WEEKDAYS):
            if name in words:
                return (today - k) % 7 or 7
    for a, b, c in zip(words, words[1:], words[2:], strict=False):
        days = next((d for name, d in UNIT_DAYS if b.startswith(name)), None)
        if c == "ago" and days and (n := number(a)):
            return n * days
    for unit, days in (("week", 7), ("month", 30)):
        if f"last {unit}" in query.lower():
            return days
    return None


def time_window(query: str, reference_us: int) -> tuple[int, int, int] | None:
    """(target, start, end) of the time a query speaks of: two days around it within a week, else five."""
    days = days_back(query, reference_us)
    if days is None:
        return None
    target = max(0, reference_us - days * DAY_US)
    margin = (2 if days <= 7 else 5) * DAY_US
    return target, max(0, target - margin), min(target + margin, reference_us)


def ordering_window(query: str, reference_us: int) -> tuple[int, int] | None:
    """(start, end) of "past N months" in a query about an order of events."""
    words = query.lower().split()
    for a, n, unit in zip(words, words[1:], words[2:], strict=False):
        if a in ("past", "last") and unit.startswith("month") and (months := number(n)):
            return max(0, reference_us - months * 30 * DAY_US), reference_us
    return None
