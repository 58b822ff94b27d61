"""Decay, archival, consolidation, compression, facts and inference on write."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lorebank.functions import text as fx
from lorebank.operators.pairs import nearest, pairs_between
from lorebank.operators.retrieval import decay
from lorebank.runtime import durable

DAY_US = 86_400_000_000

# Thresholds of the batch rules.
DECAY_CHANGE = 0.001
DELETE_BELOW, DELETE_AGE_US, DELETE_ACCESSES = 0.05, 30 * DAY_US, 2
ARCHIVE_BELOW, ARCHIVE_AGE_US = 0.1, 7 * DAY_US
ARCHIVED_SALIENCE = 0.02
CONTRADICTS_ABOVE, OBSOLETE_ABOVE, RELATED_ABOVE, CORRECTS_ABOVE = 0.95, 0.85, 0.6, 0.5
INTERFERES_ABOVE, DUPLICATE_FROM = 0.8, 0.85


def decayed(rows: DataFrame, now_us: int) -> DataFrame:
    return rows.withColumn("decayed", decay(F.col("salience"), F.col("accessed_at_us"), F.col("access_count"), now_us))


def decay_policy(rows: DataFrame, now_us: int) -> DataFrame:
    """id, before and after of each salience that decay changes noticeably."""
    return decayed(rows, now_us).where(F.abs(F.col("decayed") - F.col("salience")) > DECAY_CHANGE).select("id", F.col("salience").alias("before"), F.col("decayed").alias("after"))


def archival_decision(now_us: int) -> Column:
    age = F.greatest(F.lit(now_us) - F.col("created_at_us"), F.lit(0))
    return (
        F.when((F.col("salience") < DELETE_BELOW) & (age > DELETE_AGE_US) & (F.col("access_count") < DELETE_ACCESSES), "Delete")
        .when((F.col("salience") < ARCHIVE_BELOW) & (age > ARCHIVE_AGE_US), "Archive")
        .otherwise("Keep")
    )


def archive_policy(rows: DataFrame, now_us: int) -> DataFrame:
    """Rows to archive or delete, with the tag and the capped salience that the policy gives them."""
    due = rows.withColumn("decision", archival_decision(now_us)).where(F.col("decision") != "Keep")
    return due.withColumn("tags", F.array_distinct(F.array_append("tags", F.lit("archived")))).withColumn("salience", F.least("salience", F.lit(ARCHIVED_SALIENCE)))


def should_consolidate(now_us: int) -> Column:
    return (F.col("memory_type") == "Episodic") & (F.lit(now_us) - F.col("created_at_us") > DAY_US) & (F.col("access_count") > 2)


def consolidated(rows: DataFrame, roots: DataFrame) -> DataFrame:
    """One Semantic text per cluster: its distinct sentences in order of member and position."""
    own = rows.join(roots, "id").select("root", "id", "confidence", F.posexplode(fx.sentences("content")).alias("pos", "sentence"))
    key = F.lower("sentence")
    first = Window.partitionBy("root", key).orderBy("id", "pos")
    one = own.withColumn("_r", F.row_number().over(first)).where("_r = 1")
    body = one.groupBy("root").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("id", "pos", "sentence"))), lambda s: F.lower(s["sentence"])), ". ").alias("content"))
    sure = rows.join(roots, "id").groupBy("root").agg(F.max("confidence").alias("confidence"), F.count(F.lit(1)).alias("members"))
    return body.join(sure, "root").withColumn("memory_type", F.lit("Semantic"))


def compress_text(text: str, keywords: Sequence[str] = fx.KEY_WORDS, fillers: Sequence[str] = fx.FILLERS) -> str:
    """Per paragraph the first sentence and those with a keyword, each without the first use of every filler."""

    def strip(sentence: str) -> str:
        for f in fillers:
            at = sentence.lower().find(f)
            if at >= 0 and len(sentence.lower()) == len(sentence):
                sentence = sentence.replace(sentence[at : at + len(f)], "", 1)
        return " ".join(sentence.split())

    kept: list[str] = []
    for paragraph in text.split("\n\n"):
        own = [s.strip() for s in paragraph.split(".") if s.strip()]
        for k, s in enumerate(own):
            if k == 0 or any(w in s.lower() for w in keywords):
                clean = strip(s)
                if clean and clean not in kept:
                    kept.append(clean)
    return ". ".join(kept)


def compressed(rows: DataFrame, content: str = "content") -> DataFrame:
    """id, compressed text and its share of the bytes."""

    @F.pandas_udf("string")
    def shorter(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield texts.map(lambda t: compress_text(t) if isinstance(t, str) else t)

    out = rows.select("id", F.col(content).alias("original"), shorter(F.col(content)).alias("compressed"))
    return out.select("id", "compressed", (F.octet_length("compressed") / F.greatest(F.octet_length("original"), F.lit(1))).alias("ratio"))


def extract_facts(rows: DataFrame, patterns: Sequence[tuple[str, str]] = fx.FACT_PATTERNS) -> DataFrame:
    return rows.select("id", "confidence", F.inline(fx.facts("content", patterns)))


def dedupe_facts(facts: DataFrame) -> DataFrame:
    """The first of the facts that are equal but for case, by id and sentence."""
    w = Window.partitionBy(F.lower("subject"), F.lower("predicate"), F.lower("object")).orderBy("id", "sentence_no", "subject", "object")
    return facts.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")


def contradicting_facts(facts: DataFrame) -> DataFrame:
    """Pairs of facts of one subject and predicate with different objects, each once per pair of objects.

    The distinct objects of a key are listed first, so that repeated facts are not paired.
    """
    keys = facts.select(F.lower("subject").alias("subject"), F.lower("predicate").alias("predicate"), F.lower("object").alias("object")).distinct()
    other = keys.withColumnRenamed("object", "other")
    return keys.join(other, ["subject", "predicate"]).where("object < other")


def interference(pairs: DataFrame, rows: DataFrame) -> DataFrame:
    """Pairs that are similar but differ in text."""
    a, b = rows.select(F.col("id").alias("a"), F.col("content").alias("content_a")), rows.select(F.col("id").alias("b"), F.col("content").alias("content_b"))
    return pairs.join(a, "a").join(b, "b").where("content_a <> content_b").select("a", "b", "similarity")


def new_against_existing(new: DataFrame, existing: DataFrame, least: float) -> DataFrame:
    """new_id, old_id and similarity of new rows and other, existing ones above a cosine."""
    return pairs_between(new, existing, least).toDF("new_id", "old_id", "similarity")


def _facts(rows: DataFrame, *more: str) -> DataFrame:
    """What the rules on pairs read. Contents are only compared, so a SHA-256 stands for each."""
    return rows.select("id", *more, "memory_type", "agent_id", F.unhex(F.sha2("content", 256)).alias("content"), "created_at_us", "confidence")


def _act(when: Column, name: str, weight: Column) -> Column:
    return F.when(when, F.struct(F.lit(name).alias("action"), F.col("new_id").alias("source"), F.col("old_id").alias("target"), weight.cast("double").alias("weight")))


def _pair_actions(contradicts: float, obsolete: float, related: float) -> list[Column]:
    s, one = F.col("similarity"), F.lit(1.0)
    is_contradiction = (s > contradicts) & (F.col("new_agent_id") == F.col("old_agent_id")) & (F.col("new_content") != F.col("old_content"))
    is_obsolete = (s > obsolete) & (F.col("new_created_at_us") > F.col("old_created_at_us"))
    is_related = (s > related) & (s <= obsolete)
    return [_act(is_contradiction, "contradicts", one), _act(is_obsolete, "mark_obsolete", one), _act(is_obsolete, "invalidate", one), _act(is_related, "related", s)]


def _correction_actions(corrects: float) -> list[Column]:
    is_correction = (F.col("new_memory_type") == "Correction") & (F.col("similarity") > corrects) & F.col("best")
    return [_act(is_correction, "supersedes", F.lit(1.0)), _act(is_correction, "lower_confidence", F.greatest(F.col("old_confidence") * 0.5, F.lit(0.1)))]


def _listed(met: DataFrame, actions: list[Column]) -> DataFrame:
    return met.select(F.inline(F.filter(F.array(*actions), lambda x: x.isNotNull())))


def _with_facts(pairs: DataFrame, new: DataFrame, old: DataFrame) -> DataFrame:
    """Pairs (new_id, old_id, ...) with the facts of both rows as new_<name> and old_<name>."""
    named = lambda rows, side: rows.select(*[F.col(c).alias(f"{side}_{c}") for c in rows.columns])
    return pairs.join(named(new, "new"), "new_id").join(named(old, "old"), "old_id")


def write_inference(pairs: DataFrame, rows: DataFrame, contradicts: float = CONTRADICTS_ABOVE, obsolete: float = OBSOLETE_ABOVE, related: float = RELATED_ABOVE, corrects: float = CORRECTS_ABOVE) -> DataFrame:
    """Actions (action, source, target, weight) for pairs (new_id, old_id, similarity).

    Same agent, very similar, other text: a contradiction. Very similar and newer: the old one is
    obsolete. Moderately similar: related. A correction supersedes its best match.
    """
    best = F.row_number().over(Window.partitionBy("new_id").orderBy(F.desc("similarity"), "old_id")) == 1
    some = pairs.withColumn("best", best).where((F.col("similarity") > min(contradicts, obsolete, related)) | F.col("best"))
    facts = _facts(rows)
    return _listed(_with_facts(some, facts, facts), [*_pair_actions(contradicts, obsolete, related), *_correction_actions(corrects)])


def write_inference_between(new: DataFrame, existing: DataFrame, least: float, contradicts: float = CONTRADICTS_ABOVE, obsolete: float = OBSOLETE_ABOVE, related: float = RELATED_ABOVE, corrects: float = CORRECTS_ABOVE) -> DataFrame:
    """``write_inference`` of new rows and other, existing ones above a cosine, without moving a pair.

    The facts travel with the vectors, so the rules hold where a pair is found; a correction's best match
    comes from a search of its own. What is shuffled is in proportion to rows and blocks, never to pairs.
    """
    a, b = durable(_facts(new, "embedding")), durable(_facts(existing, "embedding"))
    facts = ("agent_id", "content", "created_at_us")
    met = pairs_between(a, b, max(least, min(contradicts, obsolete, related)), carry=facts)
    met = met.withColumnsRenamed({"a": "new_id", "b": "old_id"} | {f"{x}_{c}": f"{y}_{c}" for x, y in (("left", "new"), ("right", "old")) for c in facts})
    # Of two nearest rows one at least is another row.
    near = nearest(b, a.where(F.col("memory_type") == "Correction"), 2).where((F.col("query") != F.col("id")) & (F.col("score") > least))
    near = near.groupBy(F.col("query").alias("new_id")).agg(F.min_by(F.struct(F.col("id").alias("old_id"), F.col("score").alias("similarity"), F.lit(True).alias("best")), "rank").alias("x")).select("new_id", "x.*")
    corrected = _with_facts(near, a.select("id", "memory_type"), b.select("id", "confidence"))
    return _listed(met, _pair_actions(contradicts, obsolete, related)).unionByName(_listed(corrected, _correction_actions(corrects)))


def actions_to_edges(actions: DataFrame, now_us: int) -> DataFrame:
    """Edges that the actions add; marking and invalidating each add a superseding one."""
    kind = F.when(F.col("action") == "contradicts", "Contradicts").when(F.col("action") == "related", "Related").when(F.col("action").isin("mark_obsolete", "invalidate", "supersedes"), "Supersedes")
    return actions.withColumn("edge_type", kind).where(F.col("edge_type").isNotNull()).select("source", "target", "edge_type", F.when(F.col("action") == "related", F.col("weight")).otherwise(1.0).alias("weight"), F.lit(now_us).alias("created_at_us"))


def apply_invalidations(rows: DataFrame, actions: DataFrame, now_us: int) -> DataFrame:
    """Rows after the actions: validity closed, confidence lowered."""
    ended = actions.where(F.col("action") == "invalidate").select(F.col("target").alias("id")).distinct().withColumn("_end", F.lit(now_us))
    lower = actions.where(F.col("action") == "lower_confidence").groupBy(F.col("target").alias("id")).agg(F.min("weight").alias("_c"))
    out = rows.join(ended, "id", "left").join(lower, "id", "left")
    return out.withColumn("valid_until_us", F.coalesce("_end", "valid_until_us")).withColumn("confidence", F.coalesce("_c", "confidence")).select(*rows.columns)


def enrichment_candidates(rows: DataFrame, since_us: int) -> DataFrame:
    return rows.where((F.col("memory_type") == "Episodic") & ~F.array_contains("tags", "source:enrichment") & (F.col("created_at_us") > since_us)).orderBy("created_at_us", "id")


def maintenance_due(turn: Column | str) -> Column:
    """Which upkeep a turn count calls for: decay every 50, archival every 100, consolidation every 200 turns."""
    t = F.col(turn) if isinstance(turn, str) else turn
    due = F.array(F.when(t % 50 == 0, "decay"), F.when(t % 100 == 0, "archive"), F.when(t % 200 == 0, "consolidate"))
    return F.when(t > 0, F.filter(due, lambda x: x.isNotNull())).otherwise(F.array().cast("array<string>"))


def arrange_apart(ids: Sequence, conflicts: set[tuple]) -> list:
    """Greedy order in which neighbours do not conflict where another choice is left."""
    left, out = list(ids), []
    clash = conflicts | {(b, a) for a, b in conflicts}
    while left:
        at = next((k for k, x in enumerate(left) if not out or (out[-1], x) not in clash), 0)
        out.append(left.pop(at))
    return out
