"""Extracted memories and entities: classification, storage rows, links, enrichment and upkeep jobs."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lorebank.functions.embeddings import categories
from lorebank.functions.text import mapped_type, normalise_name, words
from lorebank.operators import lifecycle, pairs
from lorebank.runtime import durable
from lorebank.types import EXTRACTION

# Thresholds and weights of the extraction rules.
QUALITY, ENRICHED_CONFIDENCE, ENRICHED_WEIGHT, PART_OF_WEIGHT, CATEGORY_WEIGHT = 0.6, 0.7, 0.8, 0.8, 0.7
MERGE_ABOVE, MERGE_SAME_TYPE_ABOVE, GIST_LINKS = 0.85, 0.7, 5
LONGEST_NAME = 8
#: Of mentions: sources in a list, pairs of a list and a part of the texts, words that are broadcast.
MENTION_SOURCES, MENTION_PAIRS, MENTION_WORDS = 1024, 8_000_000, 300_000


def parse(raw: DataFrame, text: str = "text") -> DataFrame:
    """Rows of extractor answers with the parsed struct; the outermost braces count, fences do not."""
    body = F.regexp_extract(F.col(text), r"(?s)(\{.*\})", 1)
    return raw.withColumn("x", F.from_json(body, EXTRACTION, {"mode": "PERMISSIVE"}))


def memories_of(parsed: DataFrame) -> DataFrame:
    rows = parsed.select("id", F.posexplode("x.memories").alias("pos", "m")).select("id", "pos", "m.*")
    return rows.withColumn("confidence", F.coalesce("confidence", F.lit(0.5))).withColumn("memory_type", mapped_type("memory_type"))


def classify(rows: DataFrame, nearest: DataFrame, contradicted: DataFrame) -> DataFrame:
    """verdict of each extracted row (id, confidence): low_quality, duplicate, contradiction or store.

    ``nearest``: id, similarity of the nearest existing memory; ``contradicted``: ids with a contradiction.
    """
    own = rows.join(nearest, "id", "left").join(contradicted.select("id").distinct().withColumn("c", F.lit(True)), "id", "left")
    verdict = F.when(F.col("confidence") < QUALITY, "low_quality").when(F.col("similarity") >= lifecycle.DUPLICATE_FROM, "duplicate").when(F.col("c"), "contradiction").otherwise("store")
    return own.select("id", verdict.alias("verdict"))


def statistics(verdicts: DataFrame) -> DataFrame:
    v = F.col("verdict")
    return verdicts.agg(F.count(F.lit(1)).alias("total"), F.count_if(v == "store").alias("accepted"), F.count_if(v == "low_quality").alias("rejected_quality"), F.count_if(v == "duplicate").alias("rejected_duplicate"), F.count_if(v == "contradiction").alias("contradictions"))


def entity_rows(parsed: DataFrame) -> DataFrame:
    """One row per entity name: greatest type, attributes with the last value of a key."""
    found = parsed.select("id", F.posexplode("x.entities").alias("pos", "e")).select("id", "pos", "e.*")
    attributes = found.select(normalise_name("name").alias("key"), "id", "pos", F.explode("attributes").alias("k", "v"))
    last = attributes.groupBy("key", "k").agg(F.max_by("v", F.struct("id", "pos")).alias("v")).groupBy("key").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("k", "v")))).alias("attributes"))
    names = found.groupBy(normalise_name("name").alias("key")).agg(F.min_by("name", F.struct("id", "pos")).alias("name"), F.max_by("entity_type", F.struct("id", "pos")).alias("entity_type"))
    return names.join(last, "key", "left")


def claims_of(rows: DataFrame) -> DataFrame:
    """Claims: the first entity of a memory is the subject, the second the object."""
    return rows.where(F.size("entities") > 0).select("id", "pos", F.get("entities", F.lit(0)).alias("subject"), F.get("entities", F.lit(1)).alias("object"), F.col("content").alias("predicate"), "confidence")


def context_of(rows: DataFrame, entities: DataFrame) -> DataFrame:
    """Rows (id, entities) with the sorted categories of the entities they name."""
    named = rows.select("id", F.explode("entities").alias("n")).select("id", F.lower("n").alias("key"))
    own = entities.select(F.lower("name").alias("key"), F.explode(categories(F.element_at("attributes", F.lit("category")))).alias("c"))
    found = named.join(own, "key").groupBy("id").agg(F.array_sort(F.collect_set("c")).alias("context"))
    return rows.join(found, "id", "left").withColumn("context", F.coalesce("context", F.array().cast("array<string>")))


def name_variants(name: Column | str) -> Column:
    """A name and, from three words on, its endings of two words or more; lower case."""
    own = words(F.lower(F.col(name) if isinstance(name, str) else name))
    tails = F.when(F.size(own) > 2, F.transform(F.sequence(F.lit(2), F.size(own) - 1), lambda i: F.array_join(F.slice(own, i, F.size(own)), " "))).otherwise(F.array().cast("array<string>"))
    return F.array_distinct(F.concat(F.array(F.array_join(own, " ")), tails))


def part_of_edges(rows: DataFrame, entities: DataFrame, now_us: int) -> DataFrame:
    """PartOf edges from memories to the entities whose name, or its ending, they mention.

    Mentions are whole words. A text's word n-grams meet the names by equality, so the cost follows the
    texts and not texts times names. ``entities``: entity_id, name, relation.
    """
    own = F.transform(words(F.lower("content")), lambda w: F.regexp_replace(w, r"^[^\p{L}\p{N}]+|[^\p{L}\p{N}]+$", ""))

    def grams(n: int) -> Column:
        return F.when(F.size("w") >= n, F.transform(F.sequence(F.lit(1), F.size("w") - (n - 1)), lambda i: F.array_join(F.slice("w", i, n), " "))).otherwise(F.array().cast("array<string>"))

    texts = rows.select("id", own.alias("w")).select("id", F.explode(F.array_distinct(F.flatten(F.array(*[grams(n) for n in range(1, LONGEST_NAME + 1)])))).alias("gram"))
    names = entities.select("entity_id", "relation", F.explode(name_variants("name")).alias("gram"))
    met = texts.join(names, "gram").where(F.col("id") != F.col("entity_id")).select("id", "entity_id", "relation").distinct()
    return met.select(F.col("id").alias("source"), F.col("entity_id").alias("target"), F.lit("PartOf").alias("edge_type"), F.lit(PART_OF_WEIGHT).alias("weight"), F.col("relation").alias("label"), F.lit(now_us).alias("created_at_us"))


def category_edges(entities: DataFrame) -> DataFrame:
    """Related edges between all pairs of entities of one category."""
    own = entities.select("entity_id", F.explode(categories(F.col("category"))).alias("c"))
    met = pairs.pairs_within(own, "c", "entity_id").withColumnsRenamed({"a": "source", "b": "target"})
    return met.select("source", "target", F.lit("Related").alias("edge_type"), F.lit(CATEGORY_WEIGHT).alias("weight"), F.concat(F.lit("same_category:"), F.replace("c", F.lit(" "), F.lit("_"))).alias("label"))


def category_classes(entities: DataFrame) -> DataFrame:
    """The edges of ``category_edges`` as classes: entity_id, label, representative (the category's smallest entity)
    and links, the other entities of the category. Any two entities of a label are joined by one edge."""
    own = entities.select("entity_id", F.explode(categories(F.col("category"))).alias("c")).distinct()
    sizes = own.groupBy("c").agg(F.min("entity_id").alias("representative"), (F.count(F.lit(1)) - 1).alias("links"))
    return own.join(sizes, "c").select("entity_id", F.concat(F.lit("same_category:"), F.replace("c", F.lit(" "), F.lit("_"))).alias("label"), "representative", "links")


def _mentions(own: DataFrame, rows: DataFrame) -> DataFrame:
    """source (of own: source, w) and target of all rows that hold w as a word; a target once for each w of a source.

    A word's sources are lists of about MENTION_SOURCES, and its texts are dealt to parts, so that a list and a part
    make MENTION_PAIRS pairs at most or so. Pairs come from unfolding the lists and are not shuffled.
    """
    spark, n = own.sparkSession, F.count(F.lit(1))
    parts = F.ceil(F.least("n", F.lit(MENTION_SOURCES)) * F.lit(rows.count()) / MENTION_PAIRS)
    words_of = own.groupBy("w").agg(n.alias("n")).select("w", F.monotonically_increasing_id().alias("word"), F.ceil(F.col("n") / MENTION_SOURCES).cast("int").alias("shares"), F.greatest(parts, F.lit(1)).cast("int").alias("parts"))
    words_of = durable(words_of)
    asked = F.broadcast(words_of) if words_of.count() <= MENTION_WORDS else words_of
    texts = rows.select(F.col("id").alias("target"), F.explode(F.array_distinct(words(F.lower("content")))).alias("w")).join(asked, "w")
    texts = texts.select("word", F.explode(F.sequence(F.lit(0), F.col("shares") - 1)).alias("share"), F.pmod(F.xxhash64("target"), "parts").cast("int").alias("part"), "target")
    lists = own.join(asked, "w").groupBy("word", "parts", F.pmod(F.xxhash64("source"), "shares").cast("int").alias("share")).agg(F.collect_list("source").alias("sources"))
    lists = lists.select("word", "share", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), "sources")
    key, dealt = ["word", "share", "part"], int(spark.conf.get("spark.sql.shuffle.partitions"))
    texts = texts.repartition(dealt, *key).dropDuplicates([*key, "target"])  # rows of one id
    return texts.join(lists.repartition(dealt, *key).hint("shuffle_hash"), key).select(F.explode("sources").alias("source"), "target").where("source <> target")


def mention_edges(facts: DataFrame, rows: DataFrame, now_us: int) -> DataFrame:
    """Related edges from a fact's memory to the memories that hold its subject as a word.

    ``facts``: id, subject; single words meet the texts' words by equality. Only memories with several
    subjects can meet a text twice, so no other pairs are compared.
    """
    own = facts.select(F.col("id").alias("source"), F.lower("subject").alias("w")).where("w is not null").distinct()
    own = durable(own.withColumn("subjects", F.count(F.lit(1)).over(Window.partitionBy("source"))))
    met, several = _mentions(own.where("subjects = 1"), rows), own.where("subjects > 1")
    if not several.isEmpty():
        met = met.unionByName(_mentions(several, rows).distinct())
    return met.select("source", "target", F.lit("Related").alias("edge_type"), F.lit(0.5).alias("weight"), F.lit(now_us).alias("created_at_us"))


def merge_similar(entities: DataFrame) -> DataFrame:
    """entity_id and root of entities to merge: very similar vectors, or similar ones of one type.

    ``entities``: id, entity_type, embedding. Groups are the components of the links.
    """
    links = pairs.similar_pairs(entities, MERGE_SAME_TYPE_ABOVE)
    kind = entities.select("id", "entity_type")
    typed = links.join(kind.toDF("a", "ta"), "a").join(kind.toDF("b", "tb"), "b")
    return pairs.components(typed.where((F.col("similarity") > MERGE_ABOVE) | (F.col("ta") == F.col("tb"))).select("a", "b"))


def redirected(edges: DataFrame, roots: DataFrame) -> DataFrame:
    """Edges between the merged entities' roots; loops and repeats go."""
    s, t = roots.toDF("source", "rs"), roots.toDF("target", "rt")
    out = edges.join(s, "source", "left").join(t, "target", "left").withColumn("source", F.coalesce("rs", "source")).withColumn("target", F.coalesce("rt", "target"))
    return out.where("source <> target").select(*edges.columns).dropDuplicates(["source", "target", "edge_type"])


def enriched(rows: DataFrame) -> DataFrame:
    """Rows as enrichment: tagged, with a capped confidence."""
    return rows.withColumn("tags", F.array_union("tags", F.array(F.lit("source:enrichment")))).withColumn("confidence", F.least("confidence", F.lit(ENRICHED_CONFIDENCE)))


def derived_edges(rows: DataFrame, sources: DataFrame, now_us: int) -> DataFrame:
    """An edge from every enriched row of a batch to every source of the batch (both have a column batch)."""
    met = rows.select("batch", F.col("id").alias("source")).join(sources.select("batch", F.col("id").alias("target")), "batch")
    return met.select("source", "target", F.lit("Derived").alias("edge_type"), F.lit(ENRICHED_WEIGHT).alias("weight"), F.lit("enrichment").alias("label"), F.lit(now_us).alias("created_at_us"))


def gist_candidates(links: DataFrame, gists: DataFrame, least: int = GIST_LINKS) -> DataFrame:
    """Entities with at least ``least`` linked memories and no gist yet."""
    counts = links.groupBy("entity_id").agg(F.count_distinct("memory_id").alias("memories")).where(F.col("memories") >= least)
    return counts.join(gists.select("entity_id"), "entity_id", "left_anti")


def profile_facts(rows: DataFrame, most: int = 100, chars: int = 300) -> DataFrame:
    """The surest facts for a profile, cut to a length."""
    return rows.where(F.col("memory_type").isin("Semantic", "Procedural") & (F.col("confidence") >= 0.5)).orderBy(F.desc("confidence"), "id").limit(most).select("id", F.substring("content", 1, chars).alias("content"))


def sleep_job(rows: DataFrame, now_us: int, batch: int = 1000, above: float = 0.85, most_clusters: int = 4) -> dict[str, DataFrame]:
    """One maintenance run over the first rows by id: decay, archival, the largest clusters.

    Returns what each step would write; the caller commits it.
    """
    own = rows.orderBy("id").limit(batch)
    due = own.where(lifecycle.should_consolidate(now_us))
    roots = pairs.components(pairs.similar_pairs(due, above))
    top = roots.groupBy("root").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "root").limit(most_clusters)
    return {"decay": lifecycle.decay_policy(own, now_us), "archive": lifecycle.archive_policy(own, now_us), "clusters": lifecycle.consolidated(due, roots.join(top, "root", "left_semi"))}


def enrichment_run(rows: DataFrame, since_us: int, extract: Callable[[str], str], batch: int = 10) -> DataFrame:
    """Answers of an extractor over the candidate rows in batches of texts, as one Arrow pass.

    The extractor is shipped to the executors; rows are dealt to batches in order of time.
    """
    own = lifecycle.enrichment_candidates(rows, since_us).select("id", "content", "created_at_us")
    own = own.withColumn("day", F.floor(F.col("created_at_us") / lifecycle.DAY_US))
    own = own.withColumn("batch", F.concat_ws(":", "day", F.floor((F.row_number().over(Window.partitionBy("day").orderBy("created_at_us", "id")) - 1) / batch)))
    grouped = own.groupBy("batch").agg(F.array_sort(F.collect_list(F.struct("created_at_us", "id", "content"))).alias("xs")).select("batch", F.transform("xs", lambda x: x["id"]).alias("ids"), F.array_join(F.transform("xs", lambda x: x["content"]), "\n").alias("text"))

    @F.pandas_udf("string")
    def answers(texts: pd.Series) -> pd.Series:
        return texts.map(extract)

    return grouped.select("batch", "ids", answers("text").alias("answer"))
