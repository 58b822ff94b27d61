"""Trajectories of conversation turns: transition counts, predictions and resume texts.

The batch forms are windows and grouped counts; the streaming form keeps the last topic and the counts
per key and emits every change of a count.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle


def transitions(turns: DataFrame, key: str = "conv_id", order: str = "turn") -> DataFrame:
    """prev, topic and how often one followed the other."""
    prev = F.lag("topic").over(Window.partitionBy(key).orderBy(order))
    return turns.select(prev.alias("prev"), "topic").where(F.col("prev").isNotNull()).groupBy("prev", "topic").agg(F.count(F.lit(1)).alias("n"))


def reinforce(counts: DataFrame, prev: str, topic: str, hit: bool) -> DataFrame:
    """Counts after a prediction: two more for a hit, one less for a miss; a count of zero goes."""
    own = (F.col("prev") == prev) & (F.col("topic") == topic)
    return counts.withColumn("n", F.when(own, F.col("n") + (2 if hit else -1)).otherwise(F.col("n"))).where("n > 0")


def predictions(counts: DataFrame, k: int = 3) -> DataFrame:
    """The k most frequent followers of each topic."""
    w = Window.partitionBy("prev").orderBy(F.desc("n"), "topic")
    return counts.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= k).drop("_r")


def fill_predictions(learned: list[str], open_questions: list[str], last: str, previous: str | None, k: int = 3) -> list[str]:
    """Learned topics, then open questions, a continuation and a revisit, without repetition."""
    more = [f"{last} (continued)", *([f"{previous} (revisit)"] if previous is not None else [])]
    return list(dict.fromkeys([*learned, *open_questions, *more]))[:k]


def resume(turns: DataFrame, key: str = "conv_id", order: str = "turn") -> DataFrame:
    """Per key what was worked on last and the three topics before it."""
    r = F.row_number().over(Window.partitionBy(key).orderBy(F.desc(order)))
    few = turns.select(key, "topic", r.alias("r")).where("r <= 4")
    grouped = few.groupBy(key).agg(F.max_by("topic", -F.col("r")).alias("last"), F.array_sort(F.collect_list(F.when(F.col("r") > 1, F.struct((-F.col("r")).alias("o"), "topic")))).alias("before"))
    trail = F.array_join(F.transform("before", lambda x: x["topic"]), " → ")
    return grouped.select(key, F.concat(F.lit("You were working on: "), "last", F.when(F.size("before") > 0, F.concat(F.lit(" Recent trajectory: "), trail)).otherwise(F.lit(""))).alias("context"))


class TransitionCounter(StatefulProcessor):
    """Per key: the last topic and the count of each transition. Emits prev, topic and the new count."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.last = handle.getValueState("last", "topic string, at long")
        self.counts = handle.getMapState("counts", "prev string, topic string", "n long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        turns = sorted((int(at), topic) for pdf in rows for at, topic in zip(pdf["turn"], pdf["topic"], strict=True))
        prev = self.last.get()[0] if self.last.exists() else None
        changed: dict[tuple[str, str], int] = {}
        at = None
        for at, topic in turns:
            if prev is not None:
                pair = (prev, topic)
                n = changed.get(pair) or (self.counts.getValue(pair)[0] if self.counts.containsKey(pair) else 0)
                changed[pair] = n + 1
            prev = topic
        for pair, n in changed.items():
            self.counts.updateValue(pair, (n,))
        if at is not None:
            self.last.update((prev, at))
        yield pd.DataFrame([(key[0], p, t, n) for (p, t), n in sorted(changed.items())], columns=["conv_id", "prev", "topic", "n"])

    def close(self) -> None:
        pass


def stream_transitions(turns: DataFrame) -> DataFrame:
    """Streaming counts per conversation; needs the RocksDB state store."""
    return turns.select("conv_id", "turn", "topic").groupBy("conv_id").transformWithStateInPandas(TransitionCounter(), outputStructType="conv_id long, prev string, topic string, n long", outputMode="Update", timeMode="None")
