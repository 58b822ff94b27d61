"""Expanded search: extra lists for one question, reranking and a second round, with pluggable callables.

A judge is any callable from a prompt text to a text; none is built in, and without one the step that
needs it changes nothing.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lorebank.operators import retrieval

Judge = Callable[[str], str]

# Weights of the lists and their sizes.
WEIGHTS = {"main": 1.0, "query": 1.0, "nouns": 1.0, "keywords": 1.0, "broad": 0.4, "activation": 0.6, "categorical": 1.5, "window": 1.8, "contextual": 1.2, "preference": 1.5, "recency": 2.0, "date": 2.0}
CATEGORY_ATTRIBUTE, CATEGORY_TAG, PREFERENCE_K, GAP_K, KEEP_FROM = 1.0, 1.2, 40, 8, 1
PREFERENCES = ("user preferences about {0}", "what the user likes or dislikes about {0}", "user experience with {0}", "user interests related to {0}")
COUNTING = ("how many", "how much", "total", "number of", "count", "in all", "altogether")
PER_KEYWORD = 15
VERDICTS = ("keep", "update", "enrich", "invalidate")
CONTRADICTION_VERDICTS = ("compatible", "contradicts", "supersedes")
CONSOLIDATION = ("keep_all", "merge", "deduplicate")


def preference_queries(question: str) -> list[str]:
    """Four queries for what a user prefers."""
    return [p.format(question) for p in PREFERENCES]


@dataclass(frozen=True)
class Parts:
    """What a question is searched by besides itself."""

    queries: Sequence[str] = ()
    nouns: str = ""
    items: Sequence[str] = ()
    broad: Sequence[str] = ()


def is_counting(question: str) -> bool:
    """Whether a question asks for a number or a total."""
    q = question.lower()
    return any(cue in q for cue in COUNTING)


def take_apart(question: str, judge: Judge | None) -> Parts:
    """A judge's sub-queries, key nouns and, for a counting question, item and category words; nothing without one.

    The judge answers with a JSON object; what it leaves out or misspells is left out.
    """
    if judge is None:
        return Parts()
    answer = judge(f"Take the question apart for retrieval. Answer with a JSON object with the keys queries (list), nouns (text), items (list) and broad (list).\nQuestion: {question}")
    start = answer.find("{")
    try:
        found, _ = json.JSONDecoder().raw_decode(answer, start) if start >= 0 else ({}, 0)
    except ValueError:
        found = {}
    listed = lambda name: tuple(str(x).strip() for x in found.get(name) or () if str(x).strip()) if isinstance(found.get(name), list) else ()
    nouns = found.get("nouns")
    counting = is_counting(question)
    return Parts(listed("queries"), nouns.strip() if isinstance(nouns, str) else "", listed("items") if counting else (), listed("broad") if counting else ())


def category_names(parts: Parts) -> list[str]:
    """Category terms of the item and broad words: as they are, and without a plural s."""
    out = [w.lower().replace(" ", "_") for w in parts.broad]
    return sorted({*out, *(w.lower().replace(" ", "_").rstrip("s") for w in (*parts.broad, *parts.items))})


def categorical(rows: DataFrame, names: Sequence[str]) -> DataFrame:
    """id and score of rows of a category: by their attribute (1.0) or a context tag (1.2), the better counts."""
    wanted = [n.strip().lower().replace(" ", "_") for n in names if n.strip()]
    if not wanted:
        return rows.select("id", F.lit(0.0).alias("score")).limit(0)
    own = F.split(F.replace(F.lower(F.coalesce(F.get_json_object("attributes", "$.category"), F.lit(""))), F.lit(" "), F.lit("_")), ",_?")
    by_attribute = F.arrays_overlap(own, F.array(*[F.lit(w) for w in wanted]))
    by_tag = F.arrays_overlap("tags", F.array(*[F.lit(f"context:{w}") for w in wanted]))
    score = F.when(by_tag, CATEGORY_TAG).when(by_attribute, CATEGORY_ATTRIBUTE)
    return rows.select("id", score.alias("score")).where(F.col("score").isNotNull())


def fuse(lists: dict[str, DataFrame], k: int) -> DataFrame:
    """Named lists (id, score) fused by rank with their weights and cut."""
    parts = [(retrieval.ranked(rows), WEIGHTS[name.partition(":")[0]]) for name, rows in lists.items()]
    return retrieval.top(retrieval.rrf(parts).withColumnRenamed("rrf", "score"), "score", k)


def parse_scores(answer: str, n: int) -> list[float]:
    """n scores of 0 to 10 from a judge's answer: its first JSON array; what is missing or no number is 0."""
    m = re.search(r"\[[^\[\]]*\]", answer)
    try:
        values = json.loads(m[0]) if m else []
    except ValueError:
        values = []
    numbers = [float(v) if isinstance(v, int | float) and not isinstance(v, bool) else 0.0 for v in values]
    return [min(10.0, max(0.0, v)) for v in (numbers + [0.0] * n)[:n]]


def judged(hits: DataFrame, question: str, judge: Judge | None, text: str = "content", batch: int = 20) -> DataFrame:
    """Hits with a judge's score of at least one, best first; all hits unchanged without a judge.

    Hits are a ranked list of bounded length; the judge sees them in batches on the executors.
    """
    if judge is None:
        return hits

    @F.pandas_udf("double")
    def scores(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            out: list[float] = []
            for at in range(0, len(texts), batch):
                part = texts.iloc[at : at + batch].tolist()
                lines = "\n".join(f"[{i}] {t}" for i, t in enumerate(part))
                out += parse_scores(judge(f"Score each memory from 0 to 10 for the question, as a JSON array.\nQuestion: {question}\n{lines}"), len(part))
            yield pd.Series(out)

    return hits.withColumn("judged", scores(F.col(text))).where(F.col("judged") >= KEEP_FROM).orderBy(F.desc("judged"), F.desc("score"), "id")


def cross_encoded(hits: DataFrame, question: str, score: Callable[[str, list[str]], list[float]], text: str = "content") -> DataFrame:
    """Hits with a cross-encoder's scores blended in."""

    @F.pandas_udf("double")
    def cross(texts: pd.Series) -> pd.Series:
        return pd.Series(score(question, texts.tolist()), dtype=float)

    return retrieval.blend_rerank(hits.withColumn("cross_score", cross(F.col(text))))


def second_round(hits: DataFrame, more: Sequence[DataFrame], k: int) -> DataFrame:
    """Hits with the lists of a second round added by rank, GAP_K rows of each."""
    lists = [(retrieval.ranked(hits), 1.0)] + [(retrieval.ranked(retrieval.top(m, "score", GAP_K)), 1.0) for m in more]
    return retrieval.top(retrieval.rrf(lists).withColumnRenamed("rrf", "score"), "score", k)


def gap_terms(answer: str, most: int = 5) -> list[str]:
    """What a judge says is missing: the strings of its first JSON array."""
    m = re.search(r"\[[^\[\]]*\]", answer)
    try:
        return [str(x) for x in json.loads(m[0]) if str(x).strip()][:most] if m else []
    except ValueError:
        return []


def verdict(answer: str, allowed: Sequence[str], default: str) -> str:
    """The first allowed word of a judge's answer, whatever its case."""
    found = [(at, v) for v in allowed if (at := answer.lower().find(v)) >= 0]
    return min(found)[1] if found else default


def write_verdicts(pairs: DataFrame, judge: Judge | None) -> DataFrame:
    """Pairs (new_content, old_content) with a judge's verdict on the old memory; keep without one."""
    if judge is None:
        return pairs.withColumn("verdict", F.lit("keep"))

    @F.pandas_udf("string")
    def ask(new: pd.Series, old: pd.Series) -> pd.Series:
        prompt = "Given the new memory, what happens to the old one: keep, update, enrich or invalidate?\nNew: {0}\nOld: {1}"
        return pd.Series([verdict(judge(prompt.format(n, o)), VERDICTS, "keep") for n, o in zip(new, old, strict=True)])

    return pairs.withColumn("verdict", ask("new_content", "old_content"))
