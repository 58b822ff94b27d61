"""The client: a store of memories with the calls of a memory client, every answer a DataFrame.

Writes append to versioned logs; reads see the latest view. Embedders, extractors and judges are
callables; without one the call that needs it says so. Times are parameters with the clock as default.
"""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Callable, Iterable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lorebank.functions.text import mapped_type
from lorebank.operators import context, entities, expansion, extraction, graph, lifecycle, pairs, policies, retrieval, signals
from lorebank.plans import mql
from lorebank.runtime import durable
from lorebank.sources.store import Tables, latest_view
from lorebank.streaming.events import EventBus
from lorebank.types import AGENT, EDGE, MEMORY, MEMORY_TYPES, POLICY_RUN, valid_at

Embed = Callable[[str], Sequence[float]]
#: Rows of spreading activation that are ranked in one task; a rank beyond adds less than 0.0001 to a score.
ACTIVATED = 10_000


class DimensionError(ValueError):
    """An embedding whose length is not that of the store."""


class Lorebank:
    """One store under a folder that all executors can reach."""

    def __init__(self, spark: SparkSession, folder: str, embed: Embed | None = None, extract: Callable[[str], str] | None = None, judge: Callable[[str], str] | None = None):
        self.spark, self.embed, self.extractor, self.judge = spark, embed, extract, judge
        self._tables: Tables | None = Tables(spark, folder)
        self.dim: int | None = None
        self.events = EventBus()

    @property
    def tables(self) -> Tables:
        if self._tables is None:
            raise RuntimeError("the store is closed")
        return self._tables

    def close(self) -> None:
        """Every write is on storage when its call returns; later calls are an error. Closing twice is none."""
        self._tables = None

    def __enter__(self) -> Lorebank:
        return self

    def __exit__(self, *error: object) -> None:
        self.close()

    # Views.

    def memories(self) -> DataFrame:
        return latest_view(self.tables.memories.read())

    def edges(self) -> DataFrame:
        log = self.tables.edges.read().where("not deleted")
        gone = self.tables.edges.read().where("deleted").select("source", "target", F.col("version").alias("gone"))
        dead = log.join(gone, ["source", "target"]).where("version <= gone").select("source", "target", "version").distinct()
        return log.join(dead, ["source", "target", "version"], "left_anti").drop("version", "deleted")

    def operations(self) -> DataFrame:
        return self.tables.operations.read().drop("version", "deleted")

    def lifecycle_events(self) -> DataFrame:
        return self.tables.lifecycle.read().drop("version", "deleted")

    # Writes.

    def _log(self, rows: DataFrame, kind: str, now: int) -> None:
        columns = {"operation_type": F.lit(kind), "created_at_us": F.lit(now)}
        self.tables.operations.append(rows.withColumns(columns))
        self.events.publish(kind, rows)

    def store(self, content: str, memory_type: str = "Episodic", embedding: Sequence[float] | None = None, tags: Sequence[str] = (), agent_id: str = "default", **fields) -> str:
        """Store one memory; its id."""
        return self.store_many([{"content": content, "memory_type": memory_type, "embedding": embedding, "tags": tags, "agent_id": agent_id, **fields}])[0]

    def store_many(self, memories: Iterable[dict]) -> list[str]:
        """Store memories in one commit, after checking all of them."""
        rows, now = [], time.time_ns() // 1000
        for m in memories:
            if m.get("memory_type", "Episodic") not in MEMORY_TYPES:
                raise ValueError(f"unknown memory type {m['memory_type']!r}")
            vector = m.get("embedding")
            if vector is None and self.embed is not None:
                vector = self.embed(m["content"])
            vector = [float(x) for x in vector] if vector is not None and len(vector) else None
            if vector is not None:
                if self.dim is None:
                    known = self.tables.memories.read().where("embedding is not null").select(F.size("embedding").alias("d")).head()
                    self.dim = known.d if known else len(vector)
                if len(vector) != self.dim:
                    raise DimensionError(f"{len(vector)} values, the store has {self.dim}")
            created = m.get("created_at_us", now)
            rows.append((
                str(m.get("id") or uuid.uuid4()), str(m.get("agent_id", "default")), m.get("space_id"), m.get("memory_type", "Episodic"), m["content"], vector, created, m.get("accessed_at_us", created), int(m.get("access_count", 0)),
                float(m.get("salience", 0.5)), float(m.get("confidence", 1.0)), sorted(set(m.get("tags") or ())), json.dumps(m["attributes"]) if m.get("attributes") else None, m.get("valid_from_us", created if "created_at_us" in m else None), m.get("valid_until_us"),
            ))
        df = self.spark.createDataFrame(rows, MEMORY)
        self.tables.memories.append(df)
        self._log(df.select(F.col("id").alias("memory_id")), "store", now)
        return [r[0] for r in rows]

    def store_with_source(self, content: str, source_type: str, conversation_id: str | None = None, turn_id: str | None = None, actor_id: str | None = None, **fields) -> str:
        """Store one memory and where it came from."""
        memory_id = self.store(content, **fields)
        row = self.spark.createDataFrame([(memory_id, source_type, conversation_id, turn_id, actor_id, time.time_ns() // 1000)], "memory_id string, source_type string, conversation_id string, turn_id string, actor_id string, created_at_us long")
        self.tables.derived["sources"].upsert(row)
        return memory_id

    def index_entities(self) -> None:
        """Entities, aliases and links extracted from all memories, replacing what a memory had before."""
        found = durable(entities.structured_entities(self.memories()))
        key = F.concat_ws(":", "entity_type", F.lower("canonical"))
        self.tables.derived["entities"].upsert(found.groupBy(key.alias("entity_id")).agg(F.min("entity_type").alias("entity_type"), F.min("canonical").alias("canonical"), F.max("confidence").alias("confidence")))
        self.tables.derived["aliases"].upsert(found.select(key.alias("entity_id"), F.explode(F.array("canonical", F.lower("canonical"))).alias("alias"), "confidence").groupBy("entity_id", "alias").agg(F.max("confidence").alias("confidence")))
        self.tables.derived["memory_entities"].replace(found.select(F.col("id").alias("memory_id"), key.alias("entity_id"), "role", "confidence"), by="memory_id")

    def entity_boost(self, text: str, now_us: int | None = None) -> DataFrame:
        """id and boost of the memories that a question's entities lead to."""
        t = self.tables.derived
        now = now_us or time.time_ns() // 1000
        hit = entities.matched_aliases(self.spark, text, t["aliases"].rows())
        live = (F.coalesce("status", F.lit("active")) == "active") & valid_at(now)
        own = t["claims"].rows().where(live).select("claim_id", F.col("subject_id").alias("entity_id"), "confidence")
        return entities.recall_boost(hit, t["memory_entities"].rows(), own, t["claim_evidence"].rows(), t["relationships"].rows().where(live), t["relationship_evidence"].rows())

    def search_traced(self, text: str, k: int = 10, trace_id: str | None = None, retain: int = 200) -> DataFrame:
        """A hybrid search whose ranks are kept; the newest ``retain`` traces stay."""
        now, trace_id = time.time_ns() // 1000, trace_id or str(uuid.uuid4())
        hits = retrieval.trace_rows(retrieval.hybrid(self.memories(), self._vector(text, None), text, k, trace=True), trace_id, now)
        header = self.spark.createDataFrame([(trace_id, text, k, retrieval.OVERFETCH * k, now)], "trace_id string, query_text string, k int, fetch_k int, created_at_us long")
        t = self.tables.derived
        t["traces"].upsert(header)
        t["trace_hits"].upsert(hits.withColumnRenamed("id", "memory_id"))
        old = t["traces"].rows().join(retrieval.retain(t["traces"].rows(), retain).select("trace_id"), "trace_id", "left_anti").select("trace_id")
        if not old.isEmpty():
            t["trace_hits"].delete(durable(old))
            t["traces"].delete(durable(old))
        return t["trace_hits"].rows().where(F.col("trace_id") == trace_id).orderBy("rank")

    def store_turn(self, user: str, assistant: str, **fields) -> tuple[str, str]:
        """A user's and an assistant's turn as two memories with an edge between them."""
        a, b = self.store_many([{"content": f"User: {user}", "tags": ["turn", "turn:user"], **fields}, {"content": f"Assistant: {assistant}", "tags": ["turn", "turn:assistant"], **fields}])
        self.relate(a, b, "Before", label="assistant_response")
        return a, b

    def relate(self, source: str, target: str, edge_type: str = "Related", weight: float = 1.0, label: str | None = None, now_us: int | None = None) -> None:
        """Add an edge between two known memories."""
        known = self.memories().where(F.col("id").isin(source, target)).select("id").distinct().count()
        if known < len({source, target}):
            raise KeyError("an endpoint of the edge is unknown")
        now = now_us or time.time_ns() // 1000
        df = self.spark.createDataFrame([(source, target, edge_type, float(weight), now, None, None, label)], EDGE)
        self.tables.edges.append(df)
        self._log(df.select("source", "target"), "relate", now)

    def update(self, changed: DataFrame, event: str, policy: str, now_us: int) -> None:
        """Append changed rows as new versions, with a lifecycle event each."""
        self.tables.memories.append(changed)
        self.tables.lifecycle.append(changed.select(F.lit(event).alias("event_type"), F.col("id").alias("memory_id"), F.lit(policy).alias("policy"), F.lit(now_us).alias("created_at_us")))

    def run_policy(self, policy: str, changed: DataFrame, action: str, preview: bool = False, scope: dict | None = None, now_us: int | None = None) -> str:
        """Run a policy over changed rows (all columns of a memory) and log it; the run's id. A preview changes nothing.

        Several tables cannot be written at once, so the run is its own commit mark: it is logged as started,
        then its actions, then the rows in one append, and last that it is done. Readers of ``policy_log``
        see the actions of finished runs alone; a run that stays started was cut off, and running it again
        with the same rows gives the same state.
        """
        now, run = now_us or time.time_ns() // 1000, str(uuid.uuid4())
        t, rows = self.tables.derived, durable(changed)
        head = lambda status: self.spark.createDataFrame([(run, policy, "preview" if preview else "apply", status, json.dumps(scope or {}, sort_keys=True), now)], POLICY_RUN)
        t["policy_runs"].upsert(head("started"))
        t["policy_actions"].upsert(policies.policy_actions(rows, run, action, not preview, now))
        if not preview:
            self.update(rows, action, policy, now)
        t["policy_runs"].upsert(head("planned" if preview else "applied"))
        return run

    def policy_log(self) -> DataFrame:
        """Actions of finished runs, with their policy and mode."""
        done = self.tables.derived["policy_runs"].rows().where("status <> 'started'").select("run_id", "policy", "mode")
        return self.tables.derived["policy_actions"].rows().join(done, "run_id")

    def invalidate(self, memory_id: str, at_us: int) -> None:
        self.update(self.memories().where(F.col("id") == memory_id).withColumn("valid_until_us", F.lit(at_us)), "invalidated", "invalidate", at_us)

    def forget(self, value: str, scope: str = "memory", hard: bool = True, now_us: int | None = None) -> int:
        """Forget what a scope names; how many memories that is."""
        now = now_us or time.time_ns() // 1000
        own = self.memories()
        hit = durable(own.join(policies.forget_scope(scope, value, own), "id", "left_semi"))
        n = hit.count()
        if n and hard:
            gone = policies.touching(self.edges(), hit.select("id"))
            self.tables.edges.append(gone.select(*[f.name for f in EDGE.fields]), deleted=True)
            self.tables.memories.append(hit, deleted=True)
            self.tables.cascade(hit.select("id"))
        elif n:
            self.update(hit.withColumn("valid_until_us", F.lit(now)), "forgotten", "forget", now)
        self._log(hit.select(F.col("id").alias("memory_id")) if not hard else self.spark.createDataFrame([(value,)], "memory_id string"), "forget", now)
        return n

    def run_decay(self, now_us: int) -> DataFrame:
        """Write decayed saliences; what changed."""
        own = self.memories()
        changes = durable(lifecycle.decay_policy(own, now_us))
        self.update(own.join(changes, "id").withColumn("salience", F.col("after")).drop("before", "after"), "decayed", "decay", now_us)
        return changes

    def run_archival(self, now_us: int) -> None:
        self.update(lifecycle.archive_policy(self.memories(), now_us).drop("decision"), "archived", "archive", now_us)

    def clusters(self, above: float = 0.85) -> DataFrame:
        """id and root of similar memories, by exact comparison in blocks."""
        numbered = durable(self.memories().where("embedding is not null").select("id", "embedding").withColumn("n", F.monotonically_increasing_id()))
        roots = pairs.components(pairs.similar_pairs(numbered, above, id_col="n"))
        named = numbered.select("n", "id")
        return roots.join(named, roots.id == named.n).select(named.id.alias("id"), "root")

    # Reads.

    def get_memory(self, memory_id: str) -> DataFrame:
        return self.memories().where(F.col("id") == memory_id)

    def _vector(self, text: str | None, vector: Sequence[float] | None) -> Sequence[float] | None:
        return vector if vector is not None else self.embed(text) if self.embed and text else None

    def recall(self, statement: str, now_us: int | None = None, budget: int = context.BUDGET) -> str:
        """The context that a recall statement gives, as text."""
        hits = self.query(statement, now_us)
        if "score" not in hits.columns:
            hits = hits.withColumn("score", F.col("salience"))
        return context.assemble(hits, budget).head()[0] if hits.head() else ""

    def query(self, statement: str, now_us: int | None = None) -> DataFrame:
        """One statement of the query language."""
        engine = mql.Engine(self.memories(), self.edges(), now_us or time.time_ns() // 1000, self.embed, hide=True)
        return mql.run(statement, engine)

    def search(self, vector: Sequence[float], k: int = 10, tags: Sequence[str] = (), tags_or: bool = False, now_us: int | None = None) -> DataFrame:
        return self.search_text(None, k, vector, tags, tags_or, now_us=now_us)

    def search_text(self, text: str | None, k: int = 10, vector: Sequence[float] | None = None, tags: Sequence[str] = (), tags_or: bool = False, after: int | None = None, before: int | None = None, now_us: int | None = None, boost: DataFrame | None = None) -> DataFrame:
        """Hybrid recall; a time range counts only if both of its ends are given."""
        both = after is not None and before is not None
        rows = self.memories()
        hits = retrieval.recall(rows, self.edges(), self._vector(text, vector), text, k, now_us or time.time_ns() // 1000, tags, tags_or, after if both else None, before if both else None, boost)
        return hits.join(rows.drop("embedding"), "id").orderBy(F.desc("score"), "id")

    def search_multi(self, texts: Sequence[str], k: int = 10, before: int | None = None, now_us: int | None = None) -> DataFrame:
        rows, edges, now = self.memories(), self.edges(), now_us or time.time_ns() // 1000
        lists = [retrieval.recall(rows, edges, self._vector(t, None), t, k, now, start_us=0 if before is not None else None, end_us=before) for t in texts]
        return retrieval.multi_query(lists, k)

    def search_expanded(self, text: str, k: int = 20, reference_us: int | None = None, expand: Callable[[str], Sequence[str]] | None = None, now_us: int | None = None, before: int | None = None) -> DataFrame:
        """id and score: several weighted lists for one question, fused by rank.

        The lists are the question, the judge's parts of it (sub-queries, key nouns, words to count by and
        their categories), what ``expand`` adds, spreading activation, a window of time, the newest hits,
        names among the best hits and preferences, as the question asks for them. With a judge, what it
        finds missing is searched in a second round, and it rates the result.
        """
        rows, edges, now = self.memories(), self.edges(), now_us or time.time_ns() // 1000
        if before is not None:
            rows = rows.where(F.col("created_at_us") <= before)
        wanted, parts, vector = signals.intent(text), expansion.take_apart(text, self.judge), self._vector(text, None)

        def found(query: str, most: int, start: int | None = None, end: int | None = None) -> DataFrame:
            return retrieval.recall(rows, edges, self._vector(query, None), query, most, now, start_us=start, end_us=end)

        lists = {"main": found(text, 2 * k)}
        lists |= {f"query:{i}": found(q, k) for i, q in enumerate((*parts.queries, *(expand(text) if expand else ())))}
        if parts.nouns:
            lists["nouns"] = found(parts.nouns, k)
        lists |= {f"keywords:{i}": found(q, expansion.PER_KEYWORD) for i, q in enumerate(parts.items)}
        lists |= {f"broad:{i}": found(q, expansion.PER_KEYWORD) for i, q in enumerate(parts.broad)}
        if names := expansion.category_names(parts):
            lists["categorical"] = retrieval.top(expansion.categorical(rows, names), "score", expansion.PREFERENCE_K)
        if vector is not None:
            near = retrieval.spreading_activation(rows.where("embedding is not null"), edges, vector)
            lists["activation"] = retrieval.top(near.select("id", F.col("activation").alias("score")), "score", ACTIVATED)
        target = None
        if wanted.temporal and reference_us and (window := signals.time_window(text, reference_us)):
            target = window[0]
            lists["window"] = found(text, 20, window[1], window[2])
        if wanted.ordering and reference_us and (wide := signals.ordering_window(text, reference_us)):
            lists["date"] = found(text, expansion.PREFERENCE_K, *wide)
        if wanted.knowledge_update:
            latest = retrieval.newest(lists["main"], rows)
            lists["recency"] = latest.select("id", F.col("created_at_us").cast("double").alias("score"))
        if wanted.contextual:
            names = lists["main"].limit(5).join(rows, "id").select(F.explode(signals.follow_up_words("content")).alias("w")).distinct().orderBy("w").limit(10)
            if follow := " ".join(r.w for r in names.collect()):
                lists["contextual"] = retrieval.recall(rows, edges, self._vector(follow, None), None, 20, now)
        if wanted.preference:
            lists |= {f"preference:{i}": found(q, expansion.PREFERENCE_K) for i, q in enumerate(expansion.preference_queries(text))}
        final = max(k, 120) if wanted.temporal else k
        hits = expansion.fuse(lists, final)
        if self.judge is not None:
            shown = hits.limit(20).join(rows.select("id", "content"), "id").orderBy(F.desc("score"), "id").select("content").collect()
            answer = self.judge("Which search terms would find what is missing to answer the question? Answer with a JSON array of texts.\n" + f"Question: {text}\n" + "\n".join(r.content for r in shown))
            if gaps := expansion.gap_terms(answer):
                hits = expansion.second_round(hits, [found(g, expansion.GAP_K) for g in gaps], final)
        if wanted.knowledge_update or target is not None:
            dated = hits.join(rows.select("id", "created_at_us"), "id")
            score = F.col("score")
            if wanted.knowledge_update:
                score = retrieval.recency_boost(score, F.col("created_at_us"), reference_us or now)
            if target is not None:
                score = retrieval.proximity_boost(score, F.col("created_at_us"), target)
            hits = retrieval.top(dated.select("id", score.alias("score")), "score", final)
        if self.judge is None:
            return hits
        rated = expansion.judged(durable(hits.join(rows.select("id", "content"), "id")).orderBy(F.desc("score"), "id"), text, self.judge)
        return rated.select("id", F.col("judged").cast("double").alias("score"))

    def entity_memories(self, entity: str) -> DataFrame:
        """Memories tagged with an entity or extracted from their fields."""
        own = self.memories()
        found = entities.structured_entities(own).where(F.lower("canonical") == entity.lower()).select("id").distinct()
        return own.join(found, "id", "left_semi")

    def link_entities(self, now_us: int | None = None) -> int:
        """Related edges between memories that share an entity; how many were added."""
        now = now_us or time.time_ns() // 1000
        links = entities.structured_entities(self.memories()).select(F.concat_ws(":", "entity_type", F.lower("canonical")).alias("entity_id"), F.col("id").alias("memory_id"), "confidence")
        new = entities.shared_entity_pairs(links, self.edges()).select(F.col("a").alias("source"), F.col("b").alias("target"), F.lit("Related").alias("edge_type"), F.lit(1.0).alias("weight"), F.lit(now).alias("created_at_us"))
        n = new.count()
        if n:
            self.tables.edges.append(new)
        return n

    def extract(self, conversation: str) -> dict:
        """What the extractor finds in a conversation, as a dict."""
        if self.extractor is None:
            raise RuntimeError("no extractor is configured")
        return tolerant_json(self.extractor(conversation))

    def ingest(self, conversation: str, least_confidence: float = 0.6, **fields) -> list[str]:
        """Store the extracted memories that are sure enough."""
        return self.store_extracted(self.extract(conversation), least_confidence, **fields)

    def store_extracted(self, extracted: dict | Iterable[dict], least_confidence: float = 0.0, **fields) -> list[str]:
        """Store memories that ``extract`` found, or a list of them; the ids of those that are sure enough."""
        every = extracted.get("memories", []) if isinstance(extracted, dict) else list(extracted)
        found = [m for m in every if m.get("confidence", 0.5) >= least_confidence]
        if not found:
            return []
        kinds = self.spark.createDataFrame([(i, m.get("memory_type") or "") for i, m in enumerate(found)], "i int, k string").select("i", mapped_type("k").alias("t")).collect()
        types = {r.i: r.t for r in kinds}
        return self.store_many([{"content": m["content"], "memory_type": types[i], "tags": m.get("tags") or (), "salience": m.get("confidence", 0.5), "confidence": m.get("confidence", 0.5), **fields} for i, m in enumerate(found)])

    def consolidate_cluster(self, ids: Sequence[str], now_us: int | None = None) -> str:
        """Merge memories into one: store it, end the validity of its sources, join it to them, and log all of it."""
        now = now_us or time.time_ns() // 1000
        own = durable(self.memories().where(F.col("id").isin(*ids)))
        if own.count() < 2:
            raise ValueError("consolidation needs two memories or more")
        merged = lifecycle.consolidated(own, own.select("id", F.lit(0).cast("long").alias("root"))).head()
        with_vector = own.where("embedding is not null").withColumn("root", F.lit(0))
        mean = [r.value for r in pairs.mean_embedding(with_vector, "root").orderBy("pos").collect()]
        agent = own.orderBy("created_at_us", "id").head().agent_id
        new = self.store(merged.content, merged.memory_type, mean or None, agent_id=agent, confidence=merged.confidence, created_at_us=now)
        log = lambda rows, reason: rows.select(F.lit("consolidated").alias("event_type"), F.col("id").alias("memory_id"), F.lit(reason).alias("reason"), F.lit("consolidation").alias("policy"), F.lit(now).alias("created_at_us"))
        self.tables.lifecycle.append(log(self.spark.createDataFrame([(new,)], "id string"), "consolidated_memory_created"))
        self.update(own.withColumn("valid_until_us", F.lit(now)), "invalidated", "invalidate", now)
        edges = own.select(F.lit(new).alias("source"), F.col("id").alias("target"), F.lit("Derived").alias("edge_type"), F.lit(1.0).alias("weight"), F.lit(now).alias("created_at_us"))
        self.tables.edges.append(edges)
        self._log(edges.select("source", "target"), "relate", now)
        self.tables.lifecycle.append(log(own, "merged_into_consolidated_memory"))
        return new

    def build_communities(self, least: int = 2, now_us: int | None = None) -> list[str]:
        """Store a summary of each type of entities with ``least`` names or more, in place of the last ones; their ids."""
        own = self.memories().where(~F.array_contains("tags", "community_summary"))
        groups = entities.categories(entities.structured_entities(own), least).orderBy("entity_type").collect()
        texts = [f"{g.entity_type}: {', '.join(g.names)}" for g in groups]
        if self.judge is not None:
            texts = [self.judge(f"Summarise this group of entities in a sentence.\n{t}") for t in texts]
        ids = [f"community:{g.entity_type}" for g in groups]
        fields = {"created_at_us": now_us} if now_us else {}
        if ids:
            self.store_many([{"id": i, "content": t, "memory_type": "Semantic", "tags": ["community_summary"], **fields} for i, t in zip(ids, texts, strict=True)])
        return ids

    def run_enrichment(self, since_us: int = 0, batch: int = 10, skip_extraction: bool = False, now_us: int | None = None) -> dict[str, int]:
        """Extraction over what is new, entity links, communities and the user's profile; counts of what was written."""
        now = now_us or time.time_ns() // 1000
        out = dict.fromkeys(("memories_stored", "edges_created", "duplicates_skipped", "entities_linked", "communities_created", "profile_facts"), 0)
        own = durable(self.memories())
        if not skip_extraction and self.extractor is not None:
            answers = durable(extraction.enrichment_run(own, since_us, self.extractor, batch))
            rows = extraction.memories_of(extraction.parse(answers.withColumn("id", F.col("batch")), "answer")).withColumnRenamed("id", "batch")
            rows = rows.where(F.col("confidence") >= extraction.QUALITY).withColumn("tags", F.coalesce("tags", F.array().cast("array<string>")))
            known = own.select(F.lower("content").alias("k")).distinct()
            fresh = extraction.enriched(rows).withColumn("k", F.lower("content")).dropDuplicates(["k"])
            new = durable(fresh.join(known, "k", "left_anti").withColumn("id", F.sha2(F.concat_ws(":", F.lit("enriched"), "batch", "k"), 256)))
            out["memories_stored"], kept = new.count(), rows.count()
            out["duplicates_skipped"] = kept - out["memories_stored"]
            if out["memories_stored"]:
                stored = new.select("id", "memory_type", "content", "confidence", "tags", F.lit("default").alias("agent_id"), F.lit(now).alias("created_at_us"), F.lit(now).alias("accessed_at_us"), F.lit(0).alias("access_count"), F.col("confidence").alias("salience"))
                self.tables.memories.append(stored)
                self._log(stored.select(F.col("id").alias("memory_id")), "store", now)
                sources = answers.select("batch", F.explode("ids").alias("id"))
                edges = extraction.derived_edges(new, sources, now)
                self.tables.edges.append(edges)
                out["edges_created"] = edges.count()
        out["entities_linked"] = self.link_entities(now)
        out["communities_created"] = len(self.build_communities(now_us=now))
        profile = [r.content for r in extraction.profile_facts(self.memories().where(~F.array_contains("tags", "community_summary") & ~F.array_contains("tags", "user_profile"))).collect()]
        if profile:
            self.store_many([{"id": "profile:user", "content": "\n".join(profile), "memory_type": "Semantic", "tags": ["user_profile"], "created_at_us": now}])
        out["profile_facts"] = len(profile)
        return out

    # Agents.

    def register_agent(self, name: str, now_us: int | None = None) -> str:
        """A new agent's id."""
        agent = str(uuid.uuid4())
        self.tables.derived["agents"].upsert(self.spark.createDataFrame([(agent, name, None, "{}", now_us or time.time_ns() // 1000)], AGENT))
        return agent

    def agents(self) -> DataFrame:
        return self.tables.derived["agents"].rows()

    def remove_agent(self, agent_id: str) -> None:
        self.tables.derived["agents"].delete(self.spark.createDataFrame([(agent_id,)], "agent_id string"))

    def set_agent_metadata(self, agent_id: str, key: str, value: str) -> None:
        """Set one key; an unknown agent stays unknown."""
        row = self.agents().where(F.col("agent_id") == agent_id).head()
        if row is not None:
            body = json.dumps(json.loads(row.metadata or "{}") | {key: value}, sort_keys=True)
            self.tables.derived["agents"].upsert(self.spark.createDataFrame([(agent_id, row.name, row.default_space, body, row.created_at_us)], AGENT))

    def traverse(self, start: str, depth: int, kinds: Sequence[str] | None = None) -> DataFrame:
        return graph.bfs(self.edges(), self.get_memory(start).select("id"), depth, kinds)

    def communities(self) -> DataFrame:
        return entities.categories(entities.structured_entities(self.memories()))

    def needs_enrichment(self, since_us: int, least: int = 50) -> bool:
        return lifecycle.enrichment_candidates(self.memories(), since_us).limit(least).count() >= least


def tolerant_json(text: str) -> dict:
    """The outermost JSON object of a text, fenced or not; {} if there is none. Of equal keys the last counts."""
    start = text.find("{")
    while start >= 0:
        try:
            value, _ = json.JSONDecoder().raw_decode(text, start)
            if isinstance(value, dict):
                return value
        except ValueError:
            pass
        start = text.find("{", start + 1)
    return {}
