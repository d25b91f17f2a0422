"""Chat formatting by prefix-target expansion, with DataFrame functions alone.

Every assistant turn becomes an example of its own: all turns before it are context, and only its text is trainable.
A conversation that doesn't end with an assistant turn gets one more example, all context and nothing trainable, so that no turn
is lost. Template: <|role|>text<|end|> for each turn.

Defined cases: null text or role counts as empty; rows of a null conv_id are one conversation; rows that share a turn number come
in the order of role, then text; repeated rows are repeated turns; other columns are ignored; an empty table gives an empty one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: What stands for the characters that control strings are made of. & comes first.
ESCAPES = (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ("[", "&#91;"))
END = "<|end|>"
TARGET = "assistant"


def escaped(text: Column) -> Column:
    """No control string, of this template or of others such as </s> or [INST], is left in the text."""
    for plain, safe in ESCAPES:
        text = F.replace(text, F.lit(plain), F.lit(safe))
    return text


def unescaped(text: Column) -> Column:
    for plain, safe in reversed(ESCAPES):
        text = F.replace(text, F.lit(safe), F.lit(plain))
    return text


def format_chats(turns: DataFrame) -> DataFrame:
    """conv_id, example_no, formatted, loss_start, loss_chars: the mask covers code points loss_start up to loss_start + loss_chars."""
    order = Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_last(), "role", "text")
    rows = (
        turns.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
        .withColumn("head", F.concat(F.lit("<|"), escaped(F.col("role")), F.lit("|>")))
        .withColumn("body", escaped(F.col("text")))
        .withColumn("said", F.concat("head", "body", F.lit(END)))
        .withColumn("example_no", F.row_number().over(order).cast("long"))
        .withColumn("last", F.lead(F.lit(1)).over(order).isNull())
        .withColumn("before", F.when(F.col("last") | (F.col("role") == TARGET), F.array_join(F.collect_list("said").over(order.rowsBetween(Window.unboundedPreceding, -1)), "")))
    )
    trained = F.col("role") == TARGET
    return rows.filter(trained | F.col("last")).select(
        "conv_id",
        "example_no",
        F.concat("before", "said").alias("formatted"),
        F.when(trained, F.length("before") + F.length("head")).otherwise(0).cast("long").alias("loss_start"),
        F.when(trained, F.length("body")).otherwise(0).cast("long").alias("loss_chars"),
    )


def parsed(formatted: Column) -> Column:
    """The turns of an example: array of (role, text)."""
    turns = F.split(formatted, r"<\|end\|>", -1)
    return F.transform(
        F.slice(turns, 1, F.size(turns) - 1),
        lambda t: F.struct(
            unescaped(F.substr(F.substring_index(t, "|>", 1), F.lit(3))).alias("role"),
            unescaped(F.substr(t, F.length(F.substring_index(t, "|>", 1)) + 3)).alias("text"),
        ),
    )


def trainable(formatted: Column, start: Column, chars: Column) -> Column:
    """The text under the mask, unescaped."""
    return unescaped(F.substr(formatted, (start + 1).cast("int"), chars.cast("int")))


def digest(examples: DataFrame) -> DataFrame:
    """One row for each conversation, read back from its examples."""
    said = F.col("examples")
    return (
        examples.withColumn("loss", trainable(F.col("formatted"), F.col("loss_start"), F.col("loss_chars")))
        .groupBy("conv_id")
        .agg(
            F.max_by("formatted", "example_no").alias("all"),
            F.array_sort(F.collect_list(F.struct("example_no", "loss"))).alias("examples"),
            F.sum(F.length("formatted")).cast("long").alias("formatted_chars"),
        )
        .withColumn("turns", parsed(F.col("all")))
        .withColumn("loss", F.array_join(F.transform(said, lambda x: x.loss), ""))
        .select(
            "conv_id",
            F.size("turns").cast("long").alias("n_turns"),
            F.sha2(F.array_join(F.transform("turns", lambda t: F.concat(t.role, F.lit("\n"), t.text, F.lit("\n"))), ""), 256).alias("turns_sha256"),
            F.length("loss").cast("long").alias("loss_chars"),
            F.sha2(F.col("loss"), 256).alias("loss_sha256"),
            "formatted_chars",
        )
    )
