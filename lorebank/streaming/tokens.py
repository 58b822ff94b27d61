"""Token streams: an ever-growing buffer per stream, checked against known facts.

``alerts`` is the stateless check of assembled text against facts; ``TokenBuffer`` keeps the text of a
stream in state, emits it on every check row and clears it on a flush.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from lorebank.functions.text import NEGATIONS, contains_any, words

# Shares of a fact's words that must be in the text.
CONTRADICTION_SHARE, REINFORCEMENT_SHARE = 0.5, 0.8
CAPACITY = 1000


def alerts(texts: DataFrame, facts: DataFrame) -> DataFrame:
    """key, fact_id and kind (contradiction or reinforcement) of texts (key, text) against facts (key, fact_id, fact).

    Facts belong to a stream, so texts and facts meet by key.
    """
    lower, fact = F.lower("text"), F.lower("fact")
    keywords = F.filter(words(fact), lambda w: F.octet_length(w) >= 3)
    met = texts.join(facts, "key").withColumn("lower", lower).withColumn("kw", keywords).where(F.size("kw") > 0)
    share = F.size(F.filter("kw", lambda w: F.col("lower").contains(w))).cast("double") / F.size("kw")
    met = met.withColumn("share", share).withColumn("verbatim", F.col("lower").contains(F.lower("fact")))
    against = (F.col("share") > CONTRADICTION_SHARE) & ~F.col("verbatim") & contains_any("lower", NEGATIONS)
    kind = F.when(against, "contradiction").when(F.col("share") > REINFORCEMENT_SHARE, "reinforcement")
    return met.select("key", "fact_id", kind.alias("kind")).where(F.col("kind").isNotNull())


class TokenBuffer(StatefulProcessor):
    """State of one stream: the newest tokens, and the text of those that were pushed out."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.recent = handle.getListState("recent", "token string")
        self.older = handle.getValueState("older", "text string")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        events = sorted((int(n), kind, token) for pdf in rows for n, kind, token in zip(pdf["seq"], pdf["kind"], pdf["token"], strict=True))
        tokens = [t[0] for t in self.recent.get()] if self.recent.exists() else []
        older = self.older.get()[0] if self.older.exists() else ""
        out = []
        for seq, kind, token in events:
            if kind == "token":
                tokens.append(token)
                if len(tokens) > CAPACITY:
                    older += tokens.pop(0)
            elif kind in ("end_of_turn", "flush"):
                out.append((key[0], seq, kind, older + "".join(tokens)))
                if kind == "flush":
                    tokens, older = [], ""
        self.recent.clear()
        if tokens:
            self.recent.put([(t,) for t in tokens])
        self.older.update((older,))
        yield pd.DataFrame(out, columns=["stream_id", "seq", "kind", "text"])

    def close(self) -> None:
        pass


def buffered(events: DataFrame) -> DataFrame:
    """Streaming texts of events (stream_id, seq, kind, token) at every end of turn and flush."""
    return events.groupBy("stream_id").transformWithStateInPandas(TokenBuffer(), outputStructType="stream_id long, seq long, kind string, text string", outputMode="Append", timeMode="None")


def check(text: str, facts: list[tuple[int, str]]) -> list[tuple[int, str]]:
    """(fact_id, kind) of the alerts that a text gives, by the rule of ``alerts``."""
    lower, out = text.lower(), []
    for fact_id, fact in facts:
        keywords = [w for w in fact.lower().split() if len(w.encode()) >= 3]
        if not keywords:
            continue
        share = sum(w in lower for w in keywords) / len(keywords)
        if share > CONTRADICTION_SHARE and fact.lower() not in lower and any(n in lower for n in NEGATIONS):
            out.append((fact_id, "contradiction"))
        elif share > REINFORCEMENT_SHARE:
            out.append((fact_id, "reinforcement"))
    return out


class Cognition(StatefulProcessor):
    """State of one stream: its buffered text and the facts it was told; alerts after every token and turn."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.recent = handle.getListState("recent", "token string")
        self.older = handle.getValueState("older", "text string")
        self.facts = handle.getListState("facts", "fact_id long, fact string")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        events = sorted((int(n), kind, int(i), text) for pdf in rows for n, kind, i, text in zip(pdf["seq"], pdf["kind"], pdf["fact_id"], pdf["text"], strict=True))
        tokens = [t[0] for t in self.recent.get()] if self.recent.exists() else []
        older = self.older.get()[0] if self.older.exists() else ""
        facts = [(int(f[0]), f[1]) for f in self.facts.get()] if self.facts.exists() else []
        out = []
        for seq, kind, fact_id, text in events:
            if kind == "known_fact":
                facts.append((fact_id, text))
            elif kind == "token":
                tokens.append(text)
                if len(tokens) > CAPACITY:
                    older += tokens.pop(0)
            elif kind == "flush":
                out.append((key[0], seq, -1, "buffer_flushed", older + "".join(tokens)))
                tokens, older = [], ""
            if kind in ("token", "end_of_turn"):
                out += [(key[0], seq, f, alert, "") for f, alert in check(older + "".join(tokens), facts)]
        for state, values in ((self.recent, [(t,) for t in tokens]), (self.facts, facts)):
            state.clear()
            if values:
                state.put(values)
        self.older.update((older,))
        yield pd.DataFrame(out, columns=["stream_id", "seq", "fact_id", "kind", "text"])

    def close(self) -> None:
        pass


def cognition(events: DataFrame) -> DataFrame:
    """Streaming alerts of events (stream_id, seq, kind, fact_id, text): token, known_fact, end_of_turn, flush.

    Every stream has a fact list and a buffer of its own.
    """
    return events.groupBy("stream_id").transformWithStateInPandas(Cognition(), outputStructType="stream_id long, seq long, fact_id long, kind string, text string", outputMode="Append", timeMode="None")


class ServedSet(StatefulProcessor):
    """Delta serving: per session the set served last; emits what a new set adds and removes."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.served = handle.getListState("served", "id long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        by_turn: dict[int, set[int]] = {}
        for pdf in rows:
            for turn, i in zip(pdf["turn"], pdf["id"], strict=True):
                by_turn.setdefault(int(turn), set()).add(int(i))
        last, out = {r[0] for r in self.served.get()} if self.served.exists() else set(), []
        for turn, now in sorted(by_turn.items()):
            out += [(key[0], turn, i, "added") for i in sorted(now - last)] + [(key[0], turn, i, "removed") for i in sorted(last - now)]
            last = now
        self.served.clear()
        if last:
            self.served.put([(i,) for i in sorted(last)])
        yield pd.DataFrame(out, columns=["session_id", "turn", "id", "status"])

    def close(self) -> None:
        pass


def served_deltas(rows: DataFrame) -> DataFrame:
    """Streaming deltas of served rows (session_id, turn, id)."""
    return rows.groupBy("session_id").transformWithStateInPandas(ServedSet(), outputStructType="session_id long, turn long, id long, status string", outputMode="Append", timeMode="None")


def event_windows(events: DataFrame, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """Sessions of a user's events with a watermark; works on streams and on tables alike."""
    e = events.withWatermark("ts", late) if events.isStreaming else events
    return e.groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.count(F.lit(1)).alias("events"), F.sum("value").alias("value")).select("user_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "events", "value")
