"""Entities, claims and relationships: lookup joins, recall boosts, resolution and extraction."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lorebank.functions.text import normalise_name, query_ngrams
from lorebank.operators.pairs import pairs_within

# Weights of the recall boost, and the most rows a hop takes per entity.
ALIAS_WEIGHT, CLAIM_WEIGHT, EVIDENCE_WEIGHT, RELATED_WEIGHT, HOP_LIMIT = 1.0, 0.9, 1.0, 0.6, 32
MIN_CONFIDENCE, MIN_CHARS, MAX_CHARS, MAX_ENTITIES = 0.55, 2, 80, 16
TAG_CONFIDENCE, STRUCTURED_CONFIDENCE, WORD_MATCH = 0.98, 0.95, 0.7
SPLIT_WORDS = ("with", "and", "plus")
FIELDS = (
    ("Name", "person", "subject"), ("Location", "place", "location"), ("Base location", "place", "location"), ("Organization", "organization", "affiliation"), ("Company", "organization", "affiliation"),
    ("Employer", "organization", "affiliation"), ("Technology", "technology", "tool"), ("Technologies", "technology", "tool"), ("Stack", "technology", "tool"), ("Core stack", "technology", "tool"),
)


def alias_lookup(aliases: DataFrame, entities: DataFrame, alias: str) -> DataFrame:
    return aliases.where(F.col("alias") == alias).join(entities, "entity_id").select("entity_id", "entity_type", "canonical", "alias", "confidence").orderBy(F.desc("confidence"), "entity_id")


def top_links(links: DataFrame, key: str = "entity_id", k: int = HOP_LIMIT) -> DataFrame:
    """The k surest rows of each key."""
    w = Window.partitionBy(key).orderBy(F.desc("confidence"), "memory_id")
    return links.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= k).drop("_r")


def related_entities(entities: DataFrame, relationships: DataFrame) -> DataFrame:
    """entity_id, other and confidence: two equi-joins instead of one with OR."""
    a = relationships.select(F.col("source").alias("entity_id"), F.col("target").alias("other"), "confidence")
    b = relationships.select(F.col("target").alias("entity_id"), F.col("source").alias("other"), "confidence")
    return a.unionByName(b).join(entities.select("entity_id"), "entity_id", "left_semi")


def matched_aliases(spark, query: str, aliases: DataFrame) -> DataFrame:
    """Entities whose alias is one of the query's word n-grams, with the surest alias."""
    grams = spark.range(1).select(F.explode(query_ngrams(F.lit(query))).alias("gram"))
    return aliases.join(F.broadcast(grams), normalise_name("alias") == F.col("gram")).groupBy("entity_id").agg(F.max("confidence").alias("alias_confidence"))


def recall_boost(matched: DataFrame, links: DataFrame, claims: DataFrame | None = None, evidence: DataFrame | None = None, relationships: DataFrame | None = None, relationship_evidence: DataFrame | None = None) -> DataFrame:
    """id and boost: the strongest of the ways that lead from matched entities to a memory.

    Direct links; claims of the entity and their evidence; evidence of the entity's relationships; links of
    related entities. The caller leaves out claims and relationships that are not active and valid.
    """
    direct = top_links(links.join(matched, "entity_id")).select(F.col("memory_id").alias("id"), (F.lit(ALIAS_WEIGHT) * F.col("alias_confidence") * F.col("confidence")).alias("boost"))
    parts = [direct]
    if claims is not None and evidence is not None:
        own = claims.join(matched, "entity_id").withColumn("_r", F.row_number().over(Window.partitionBy("entity_id").orderBy(F.desc("confidence"), "claim_id"))).where(F.col("_r") <= HOP_LIMIT)
        own = own.select("claim_id", "alias_confidence", F.col("confidence").alias("claim_confidence"))
        shown = top_links(evidence.join(own.select("claim_id").distinct(), "claim_id", "left_semi"), "claim_id")
        parts.append(shown.join(own, "claim_id").select(F.col("memory_id").alias("id"), (F.lit(CLAIM_WEIGHT) * F.col("claim_confidence") * F.col("confidence") * F.col("alias_confidence")).alias("boost")))
    if relationships is not None and relationship_evidence is not None:
        ends = relationships.select("relationship_id", "confidence", F.explode(F.array_distinct(F.array("source", "target"))).alias("entity_id"))
        own = ends.join(matched, "entity_id").withColumn("_r", F.row_number().over(Window.partitionBy("entity_id").orderBy(F.desc("confidence"), "relationship_id"))).where(F.col("_r") <= HOP_LIMIT)
        own = own.groupBy("relationship_id").agg(F.max(F.col("confidence") * F.col("alias_confidence")).alias("w"))
        shown = top_links(relationship_evidence.join(own.select("relationship_id"), "relationship_id", "left_semi"), "relationship_id")
        parts.append(shown.join(own, "relationship_id").select(F.col("memory_id").alias("id"), (F.lit(EVIDENCE_WEIGHT) * F.col("w") * F.col("confidence")).alias("boost")))
    if relationships is not None:
        other = related_entities(matched, relationships).select(F.col("entity_id").alias("via"), F.col("other").alias("entity_id"), F.col("confidence").alias("rel_confidence"))
        other = other.join(matched.withColumnRenamed("entity_id", "via"), "via").groupBy("entity_id").agg(F.max(F.col("rel_confidence") * F.col("alias_confidence")).alias("w"))
        parts.append(top_links(links.join(other, "entity_id")).select(F.col("memory_id").alias("id"), (F.lit(RELATED_WEIGHT) * F.col("w") * F.col("confidence")).alias("boost")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.groupBy("id").agg(F.max("boost").alias("boost"))


def resolve(names: DataFrame, aliases: DataFrame, canonicals: DataFrame) -> DataFrame:
    """name, canonical, confidence and source: learned alias, else shared words, else the name itself.

    Two names share words if the words of one are among those of the other; of several canonical
    names the first in order counts. Candidates meet on a word, not by comparing all names.
    """
    own = names.select("name", normalise_name("name").alias("norm")).distinct()
    cached = aliases.select(normalise_name("alias").alias("norm"), F.col("canonical").alias("c_name"), F.col("confidence").alias("c_conf")).dropDuplicates(["norm"])
    word = lambda c: F.array_distinct(F.filter(F.split(c, r"[\s\-_]+"), lambda w: w != ""))
    canon = canonicals.select(normalise_name("canonical").alias("canonical")).distinct().withColumn("cw", word(F.col("canonical")))
    met = own.withColumn("nw", word(F.col("norm"))).withColumn("w", F.explode("nw")).join(canon.withColumn("w", F.explode("cw")), "w")
    subset = (F.size(F.array_except("nw", "cw")) == 0) | (F.size(F.array_except("cw", "nw")) == 0)
    ruled = met.where(subset & (F.col("canonical") != F.col("norm"))).groupBy("name").agg(F.min("canonical").alias("r_name"))
    out = own.join(cached, "norm", "left").join(ruled, "name", "left")
    return out.select(
        "name",
        F.coalesce("c_name", "r_name", "norm").alias("canonical"),
        F.when(F.col("c_name").isNotNull(), F.col("c_conf")).when(F.col("r_name").isNotNull(), WORD_MATCH).otherwise(1.0).alias("confidence"),
        F.when(F.col("c_name").isNotNull(), "cache").when(F.col("r_name").isNotNull(), "rule").otherwise("identity").alias("source"),
    )


def negative_key(a: str, b: str) -> list[Column]:
    """The ordered pair under which two different names are remembered."""
    x, y = normalise_name(a), normalise_name(b)
    return [F.least(x, y).alias("first"), F.greatest(x, y).alias("second")]


def canonical_phrase(raw: Column | str) -> Column:
    """Trimmed of punctuation, single blanks, without the words Project or Name in front, in title case
    if it has no capital; null if it has no letter."""
    c = F.col(raw) if isinstance(raw, str) else raw
    c = F.regexp_replace(F.regexp_replace(F.trim(c), r"^[,;:\"'()\[\]]+|[,;:\"'()\[\]]+$", ""), r"\.+$", "")
    c = F.regexp_replace(F.trim(F.regexp_replace(c, r"\s+", " ")), r"^(Project|Name) ", "")
    titled = F.array_join(F.transform(F.split(c, " "), lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.substring(w, F.lit(2), F.length(w)))), " ")
    return F.when(c.rlike("[A-Za-z]"), F.when(c.rlike("[A-Z]"), c).otherwise(titled))


def structured_entities(rows: DataFrame) -> DataFrame:
    """id, canonical, entity_type, role and confidence from tags and from fields of the text's lines."""
    tagged_type = F.get(F.filter("tags", lambda t: t.startswith("entity_type:")), F.lit(0))
    kind = F.coalesce(F.lower(F.trim(F.substring(tagged_type, 13, 200))), F.lit("concept"))
    tagged = rows.select("id", kind.alias("entity_type"), F.explode(F.filter("tags", lambda t: t.startswith("entity:"))).alias("t")).select("id", F.substring("t", 8, 400).alias("raw"), "entity_type", F.lit("mentioned").alias("role"), F.lit(TAG_CONFIDENCE).alias("confidence"))
    line = F.trim(F.regexp_replace(F.regexp_replace(F.trim("line"), r"^\[[^\]]*\]\s*", ""), r"^(User|Assistant|System):", ""))
    lines = rows.select("id", F.explode(F.split("content", "\n")).alias("line")).select("id", line.alias("line"))
    key = F.create_map(*[x for name, kind, role in FIELDS for x in (F.lit(name.lower()), F.struct(F.lit(kind).alias("kind"), F.lit(role).alias("role")))])
    fields = lines.where(F.col("line").contains(":")).select("id", F.element_at(key, F.lower(F.trim(F.substring_index("line", ":", 1)))).alias("f"), F.trim(F.expr("substring(line, instr(line, ':') + 1)")).alias("value")).where(F.col("f").isNotNull())
    listed = F.split(F.regexp_replace("value", rf" (?:{'|'.join(SPLIT_WORDS)}) ", ","), ",")
    first = F.array(F.split_part("value", F.lit(". "), F.lit(1)))
    parts = fields.select("id", F.explode(F.when(F.col("f.kind") == "person", first).otherwise(listed)).alias("raw"), F.col("f.kind").alias("entity_type"), F.col("f.role").alias("role")).where(~((F.col("entity_type") == "place") & F.lower(F.trim("raw")).startswith("near "))).withColumn("confidence", F.lit(STRUCTURED_CONFIDENCE))
    project = lines.where(F.col("line").startswith("Project ")).select("id", F.regexp_replace(F.substring("line", 9, 400), r" (is|uses|includes) .*$", "").alias("raw"), F.lit("project").alias("entity_type"), F.lit("subject").alias("role"), F.lit(STRUCTURED_CONFIDENCE).alias("confidence"))
    found = tagged.unionByName(parts.select(*tagged.columns)).unionByName(project).withColumn("canonical", canonical_phrase(F.regexp_replace(F.trim("raw"), r"\.+$", "")))
    size = F.octet_length("canonical")
    found = found.where(F.col("canonical").isNotNull() & (F.col("confidence") >= MIN_CONFIDENCE) & (size >= MIN_CHARS) & (size <= MAX_CHARS))
    one = found.groupBy("id", "entity_type", F.lower("canonical").alias("_k")).agg(F.max_by(F.struct("canonical", "role"), "confidence").alias("x"), F.max("confidence").alias("confidence"))
    w = Window.partitionBy("id").orderBy(F.desc("confidence"), "x.canonical", "entity_type")
    return one.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= MAX_ENTITIES).select("id", F.col("x.canonical").alias("canonical"), "entity_type", F.col("x.role").alias("role"), "confidence")


def shared_entity_pairs(links: DataFrame, edges: DataFrame) -> DataFrame:
    """All pairs of memories that share an entity and that no edge joins yet."""
    pairs = pairs_within(links, "entity_id", "memory_id").select("a", "b").distinct()
    linked = edges.select(F.least("source", "target").alias("a"), F.greatest("source", "target").alias("b")).distinct()
    return pairs.join(linked, ["a", "b"], "left_anti")


def shared_entity_classes(links: DataFrame, edges: DataFrame) -> DataFrame:
    """The pairs of ``shared_entity_pairs`` as classes: entity_id, memory_id, representative (the entity's smallest
    memory) and new_links, the other memories of the entity that no edge joins to this one yet.

    Two memories of one entity are a pair unless an edge joins them, so the rows and the edges say all
    pairs, and their number follows the links and not the squares of the groups.
    """
    own = links.select("entity_id", "memory_id").distinct()
    ends = edges.select(F.least("source", "target").alias("a"), F.greatest("source", "target").alias("b")).where("a <> b").distinct()
    inside = ends.join(own.withColumnRenamed("memory_id", "a"), "a").join(own.withColumnRenamed("memory_id", "b"), ["entity_id", "b"])
    joined = inside.select("entity_id", F.explode(F.array("a", "b")).alias("memory_id")).groupBy("entity_id", "memory_id").agg(F.count(F.lit(1)).alias("n"))
    sizes = own.groupBy("entity_id").agg(F.min("memory_id").alias("representative"), F.count(F.lit(1)).alias("size"))
    return own.join(sizes, "entity_id").join(joined, ["entity_id", "memory_id"], "left").select("entity_id", "memory_id", "representative", (F.col("size") - 1 - F.coalesce("n", F.lit(0))).alias("new_links"))


def categories(entities: DataFrame, least: int = 2) -> DataFrame:
    """Types with at least ``least`` entities and their names in order."""
    return entities.groupBy("entity_type").agg(F.array_sort(F.collect_set("canonical")).alias("names")).where(F.size("names") >= least)


def merge_entities(entities: DataFrame) -> DataFrame:
    """One row per normalised name: greatest confidence, first spelling, all types."""
    return entities.groupBy(normalise_name("canonical").alias("key")).agg(F.min("canonical").alias("canonical"), F.max("confidence").alias("confidence"), F.array_sort(F.collect_set("entity_type")).alias("types"))


def violations(memories: DataFrame) -> DataFrame:
    """Broken rules of extracted memories, one row each: empty text, confidence, time order, attributes."""
    checks = F.array(
        F.when(F.coalesce(F.trim("content"), F.lit("")) == "", "empty content"),
        F.when(~F.coalesce(F.col("confidence").between(0, 1), F.lit(False)), "confidence out of range"),
        F.when(F.col("valid_until_us") <= F.col("valid_from_us"), "validity ends before it begins"),
        F.when(F.col("attributes").isNotNull() & ~F.coalesce(F.schema_of_variant(F.try_parse_json("attributes")).startswith("OBJECT"), F.lit(False)), "attributes are no object"),
    )
    return memories.select("id", F.explode(F.filter(checks, lambda x: x.isNotNull())).alias("violation"))


def list_of(names: Sequence[str]) -> Column:
    return F.array(*[F.lit(n) for n in names])
