"""Turns as a stream: stateless signals per turn, and a sink that stores a micro-batch.

A micro-batch sees the store as it was when the batch began; turns of a batch are ordered by
conversation and turn.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lorebank.functions import text as tx


def turn_signals(turns: DataFrame) -> DataFrame:
    """Per turn: sentiment, action types, correction and speculation, token estimate."""
    return turns.select(
        "conv_id", "turn", "role",
        tx.sentiment("text").alias("sentiment"),
        F.array_join(F.transform(tx.actions("text"), lambda a: a["action_type"]), ",").alias("actions"),
        tx.is_correction("text").alias("correction"),
        tx.is_speculation("text").alias("speculation"),
        tx.token_estimate("text").alias("tokens"),
    )


def exchanges(turns: DataFrame) -> DataFrame:
    """A user's turn with the assistant's answer after it, as one Episodic text."""
    w = Window.partitionBy("conv_id").orderBy("turn")
    both = turns.withColumn("answer", F.when(F.lead("role").over(w) == "assistant", F.lead("text").over(w)))
    text = F.concat(F.lit("User: "), "text", F.when(F.col("answer").isNotNull(), F.concat(F.lit("\nAssistant: "), "answer")).otherwise(F.lit("")))
    return both.where("role = 'user'").select("conv_id", "turn", text.alias("content"), F.lit("Episodic").alias("memory_type"), F.array(F.lit("turn")).alias("tags"))


def corrections(turns: DataFrame) -> DataFrame:
    """Memories of turns that correct something."""
    own = turns.where((F.col("role") == "user") & tx.is_correction("text"))
    return own.select("conv_id", "turn", F.concat(F.lit("Correction: "), "text").alias("content"), F.lit("Semantic").alias("memory_type"), F.array(F.lit("auto-correction"), F.lit("anti_pattern")).alias("tags"))


def ghosts(turns: DataFrame, chars: int = 300) -> DataFrame:
    """Unsure memories of turns that speculate about an action."""
    own = turns.where((F.col("role") == "user") & tx.is_speculation("text") & (F.size(tx.actions("text")) > 0))
    return own.select("conv_id", "turn", F.concat(F.lit("Unconfirmed: "), F.substring("text", 1, chars)).alias("content"), F.lit("Episodic").alias("memory_type"), F.lit(0.3).alias("confidence"), F.array(F.lit("ghost")).alias("tags"))


def memories_of_turns(turns: DataFrame) -> DataFrame:
    """All memories that a batch of turns adds, with an id that is the same when a batch is run again."""
    rows = exchanges(turns).unionByName(corrections(turns)).withColumn("confidence", F.lit(1.0)).unionByName(ghosts(turns))
    return rows.withColumn("id", F.sha2(F.concat_ws(":", F.col("conv_id").cast("string"), F.col("turn").cast("string"), "memory_type", F.array_join("tags", ",")), 256))


def store_turns(append: Callable[[DataFrame, int], None]) -> Callable[[DataFrame, int], None]:
    """A function for ``foreachBatch`` that stores a batch's memories by ``append(rows, batch_id)``."""

    def run(batch: DataFrame, batch_id: int) -> None:
        append(memories_of_turns(batch), batch_id)

    return run


def canonical_topics(turns: DataFrame, learned: DataFrame) -> DataFrame:
    """Turns with the learned canonical topic, else the normalised one; ``learned``: raw, canonical."""
    known = learned.select(tx.normalise_name("raw").alias("k"), "canonical").dropDuplicates(["k"])
    return turns.withColumn("k", tx.normalise_name("topic")).join(known, "k", "left").withColumn("topic", F.coalesce("canonical", "k")).drop("k", "canonical")
