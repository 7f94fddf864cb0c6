"""Chat formatting by prefix-target expansion.

Every assistant turn becomes an example of its own: all preceding turns as context, then that reply, which alone
is trainable.  Turns after the last reply stand in one more example with nothing trainable, so that no turn is
lost.  A turn is ``<|im_start|>role<|im_end|>`` in front of its text and ``<|im_end|>`` behind it.  Inside roles and
texts the character ``^`` becomes ``^^`` and ``<|`` becomes ``<^|``, so no marker can occur there, and both are undone
when read.  Everything is native SQL expressions on one row per conversation.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import stored

START, END = "<|im_start|>", "<|im_end|>"


def escaped(c: Column) -> Column:
    return F.replace(F.replace(c, F.lit("^"), F.lit("^^")), F.lit("<|"), F.lit("<^|"))


def unescaped(c: Column) -> Column:
    """The inverse: reading from the left, ``^`` and the character after it stand for that character."""
    return F.regexp_replace(c, r"\^(\^|\|)", "$1")


def examples(conversations: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """One row per example: conv_id, example (from 0), formatted, loss_start, loss_end (characters; null: none), last.

    A null role or text is empty.  Turns go by turn (null first), role, text; repeated rows are turns each.  A null
    conv_id is a conversation like any other.  An empty table gives no rows; other columns are ignored.
    """
    turn = F.struct(F.col(turn_col).cast("long").alias("turn"), F.coalesce(F.col(role_col), F.lit("")).alias("role"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    convs = conversations.select(F.col(conv_col).cast("long").alias("conv_id"), turn.alias("t")).groupBy("conv_id").agg(F.array_sort(F.collect_list("t")).alias("t"))
    parts = convs.select(
        "conv_id",
        F.transform("t", lambda x: F.struct(x["role"].alias("role"), F.concat(F.lit(START), escaped(x["role"]), F.lit(END)).alias("head"), escaped(x["text"]).alias("body"))).alias("t"),
    )
    # an example ends at each assistant turn, and at the last turn whatever it is
    each = parts.select("conv_id", "t", F.posexplode("t").alias("at", "own")).where("own.role = 'assistant' or at = size(t) - 1")
    before = F.expr("concat_ws('', transform(slice(t, 1, at), x -> concat(x.head, x.body, '" + END + "')))")
    made = each.select("conv_id", F.col("at").alias("example"), "own", before.alias("context"), F.expr("at = size(t) - 1").alias("last"))
    reply = F.col("own.role") == "assistant"
    start = F.char_length("context") + F.char_length("own.head")
    return made.select(
        "conv_id",
        "example",
        F.concat("context", "own.head", "own.body", F.lit(END)).alias("formatted"),
        F.when(reply, start).alias("loss_start"),
        F.when(reply, start + F.char_length("own.body")).alias("loss_end"),
        "last",
    )


def read_back(made: DataFrame) -> DataFrame:
    """From formatted examples: conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars, n_examples."""
    cells = F.split(F.col("formatted"), r"<\|im_end\|>", -1)
    turns = made.where("last").select("conv_id", cells.alias("cells"))
    whole = F.expr("transform(sequence(0, (size(cells) - 1) div 2 - 1), i -> struct(substr(cells[2 * i], 13) as role, cells[2 * i + 1] as text))")
    turns = turns.select("conv_id", whole.alias("t")).select(
        "conv_id",
        F.size("t").cast("long").alias("n_turns"),
        F.sha2(F.array_join(F.transform("t", lambda x: F.concat(unescaped(x["role"]), F.lit("\n"), unescaped(x["text"]), F.lit("\n"))), ""), 256).alias("turns_sha256"),
    )
    loss = unescaped(F.when(F.col("loss_start").isNotNull(), F.expr("substr(formatted, loss_start + 1, loss_end - loss_start)")).otherwise(F.lit("")))
    losses = (
        made.select("conv_id", F.struct("example", loss.alias("s")).alias("x"), F.char_length("formatted").cast("long").alias("chars"), F.col("loss_start").isNotNull().alias("trains"))
        .groupBy("conv_id")
        .agg(F.array_join(F.expr("transform(array_sort(collect_list(x)), x -> x.s)"), "").alias("loss"), F.sum("chars").alias("formatted_chars"), F.sum(F.col("trains").cast("long")).alias("n_examples"))
    )
    t, s = turns.alias("t"), losses.alias("s")
    return t.join(s, F.expr("t.conv_id <=> s.conv_id")).select(
        F.col("t.conv_id").alias("conv_id"), "n_turns", "turns_sha256", F.char_length("loss").cast("long").alias("loss_chars"), F.sha2("loss", 256).alias("loss_sha256"), "formatted_chars", "n_examples"
    )


def format_and_check(conversations: DataFrame) -> DataFrame:
    """Writes the examples to the shared folder, reads them back and digests them."""
    return read_back(stored(examples(conversations), "chat"))
