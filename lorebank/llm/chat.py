r"""Chat formatting by relational means: Spark expressions alone render, mask and read back.

Template. Adjacent turns of one role share a block::

    ### role:
    first text
    <turn/>
    second text
    </turn>

A text that holds one of the control strings ``###``, ``<turn/>`` or ``</turn>`` gets one backslash
in front of that string and of the backslashes that already precede it. The template puts a line
feed before each of its own control strings (or starts the output with it), so a control string is
real exactly when no backslash precedes it, and taking one backslash away restores the text. In a
role, a backslash becomes two and a line feed becomes ``\n``.

The loss mask is a list of half-open code point spans of the output, one for each assistant text.

Defined cases: null texts and roles count as empty; a conversation is its rows ordered by turn (null
first), then role, then text, so repeated rows and ties stay and have a fixed order; a null conv_id
is a conversation of its own; an empty table gives an empty result; extra columns are never read. A
conversation is one row of the output and so has to fit in one; nothing else is gathered.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

CLOSE, NEXT = "</turn>", "<turn/>"
#: A control string with the backslashes before it, and one that follows no backslash.
CONTROLS = r"(\\*)(###|</turn>|<turn/>)"
ESCAPED = r"\\(\\*)(###|</turn>|<turn/>)"
REAL_CLOSE, REAL_NEXT = r"\n(?<!\\)</turn>\n", r"\n(?<!\\)<turn/>\n"
LOSS_ROLE = "assistant"


def escape(text: Column) -> Column:
    return F.regexp_replace(text, CONTROLS, r"\\$1$2")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, ESCAPED, "$1$2")


def escape_role(role: Column) -> Column:
    return F.replace(F.replace(role, F.lit("\\"), F.lit("\\\\")), F.lit("\n"), F.lit("\\n"))


def unescape_role(role: Column) -> Column:
    # Every pair of backslashes, taken from the left, is one backslash; what is left of \n is a line feed.
    return F.array_join(F.transform(F.split(role, r"\\\\", -1), lambda part: F.replace(part, F.lit("\\n"), F.lit("\n"))), "\\")


def merged_blocks(turns: Column) -> Column:
    """Blocks (role, texts) of an ordered array of (turn, role, text)."""
    at = F.sequence(F.lit(0), F.size(turns) - 1)
    first = F.filter(at, lambda i: (i == 0) | (F.get(turns, i).getField("role") != F.get(turns, i - 1).getField("role")))
    return F.transform(
        first,
        lambda i, k: F.struct(
            F.get(turns, i).getField("role").alias("role"),
            F.transform(F.slice(turns, i + 1, F.coalesce(F.get(first, k + 1), F.size(turns)) - i), lambda t: t.getField("text")).alias("texts"),
        ),
    )


def format_conversations(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """One row per conversation: conv_id, formatted, loss_spans (array of start, stop)."""
    empty = F.lit("")
    rows = turns.select(F.col(conv_col).alias("conv_id"), F.struct(F.col(turn_col).alias("turn"), F.coalesce(F.col(role_col), empty).alias("role"), F.coalesce(F.col(text_col), empty).alias("text")).alias("t"))
    grouped = rows.groupBy("conv_id").agg(F.array_sort(F.collect_list("t")).alias("turns"))
    blocks = grouped.select("conv_id", F.posexplode(merged_blocks(F.col("turns"))).alias("at", "block"))
    # One piece per text: what the template puts before it, the escaped text, what follows it.
    pieces = blocks.select("conv_id", "at", F.col("block.role").alias("role"), F.size("block.texts").alias("n"), F.posexplode("block.texts").alias("k", "text")).select(
        "conv_id",
        "at",
        "k",
        (F.col("role") == LOSS_ROLE).alias("loss"),
        F.when(F.col("k") == 0, F.concat(F.lit("### "), escape_role(F.col("role")), F.lit(":\n"))).otherwise(empty).alias("head"),
        escape(F.col("text")).alias("body"),
        F.when(F.col("k") == F.col("n") - 1, F.lit(f"\n{CLOSE}\n")).otherwise(F.lit(f"\n{NEXT}\n")).alias("tail"),
    )
    # The windows and the second grouping reuse the partitioning by conv_id.
    order = Window.partitionBy("conv_id").orderBy("at", "k")
    pieces = pieces.withColumn("piece", F.concat("head", "body", "tail")).withColumn("end", F.sum(F.length("piece").cast("long")).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    stop = F.col("end") - F.length("tail")
    pieces = pieces.select("conv_id", F.struct("at", "k", "piece", "loss", (stop - F.length("body")).alias("start"), stop.alias("stop")).alias("p"))
    out = pieces.groupBy("conv_id").agg(F.array_sort(F.collect_list("p")).alias("ps"))
    return out.select(
        "conv_id",
        F.array_join(F.transform("ps", lambda p: p["piece"]), "").alias("formatted"),
        F.transform(F.filter("ps", lambda p: p["loss"]), lambda p: F.struct(p["start"].alias("start"), p["stop"].alias("stop"))).alias("loss_spans"),
    )


def read_back(formatted: Column) -> Column:
    """The turns (role, text) that an output holds, in order."""
    blocks = F.filter(F.split(formatted, REAL_CLOSE, -1), lambda b: b != "")

    def turns(block: Column) -> Column:
        role = unescape_role(F.regexp_extract(block, r"^### ([^\n]*):\n", 1))
        body = F.regexp_replace(block, r"^### [^\n]*:\n", "")
        return F.transform(F.split(body, REAL_NEXT, -1), lambda t: F.struct(role.alias("role"), unescape(t).alias("text")))

    return F.flatten(F.transform(blocks, turns))


def masked_text(formatted: Column, spans: Column) -> Column:
    """The text under the loss mask, unescaped, with nothing between its parts."""
    return F.array_join(F.transform(spans, lambda s: unescape(F.substring(formatted, (s["start"] + 1).cast("int"), (s["stop"] - s["start"]).cast("int")))), "")


def conversation_digests(formatted: DataFrame) -> DataFrame:
    """What the outputs say, read back from them: counts and digests of turns and loss text."""
    turns = read_back(F.col("formatted"))
    parts = formatted.select("conv_id", "formatted", turns.alias("turns"), masked_text(F.col("formatted"), F.col("loss_spans")).alias("loss"))
    return parts.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(F.encode(F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), ""), "UTF-8"), 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2(F.encode("loss", "UTF-8"), 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )
