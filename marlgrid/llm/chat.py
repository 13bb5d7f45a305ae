"""Chat formatting (operator 6): prefix-target expansion, in DataFrame functions only.

Every assistant turn becomes an example of its own, with all turns before it as context and its text alone trainable.
Turns after the last assistant turn form one example without a target.

The examples of a conversation share their beginnings, so all of them together grow with the square of its turns.  They are
built one after another in a conversation's partition and flow on: only what reads them decides whether they are written.
prefix_segments() is the compact form that they are built from, with each character once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: The template: `### role: text</turn>` and a line break.  Inside roles and texts these characters are written as codes,
#: so that neither mark can stand there; the backslash, as the sign of a code, is written as one too.
OPEN, MIDDLE, CLOSE = "### ", ": ", "</turn>\n"
CODES = (("\\", "\\0"), ("#", "\\1"), ("<", "\\2"), (":", "\\3"))
TARGET = "assistant"


def escaped(column: Column) -> Column:
    for plain, code in CODES:
        column = F.replace(column, F.lit(plain), F.lit(code))
    return column


def unescaped(column: Column) -> Column:
    for plain, code in reversed(CODES):
        column = F.replace(column, F.lit(code), F.lit(plain))
    return column


def _joined(parts: str, order: str) -> Column:
    """The strings of a group, concatenated in order."""
    return F.array_join(F.transform(F.sort_array(F.collect_list(F.struct(order, parts))), lambda x: x[parts]), "")


def prefix_segments(conversations: DataFrame) -> DataFrame:
    """conv_id, example (int from 0), segment (what the example adds to the one before), context_chars, loss_start, loss_end, n_turns (of the segment), has_target."""
    rows = conversations.select(F.col("conv_id").cast("bigint").alias("conv_id"), F.col("turn").cast("bigint").alias("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    is_target = F.when(F.col("role") == TARGET, 1).otherwise(0)
    placed = rows.select("conv_id", F.row_number().over(order).alias("at"), (F.sum(is_target).over(order.rowsBetween(Window.unboundedPreceding, 0)) - is_target).cast("int").alias("example"), is_target.alias("is_target"), F.concat(F.lit(OPEN), escaped(F.col("role")), F.lit(MIDDLE), escaped(F.col("text")), F.lit(CLOSE)).alias("shown"), F.length(escaped(F.col("text"))).cast("bigint").alias("reply_chars"))
    grouped = placed.groupBy("conv_id", "example").agg(_joined("shown", "at").alias("segment"), F.count("*").alias("n_turns"), F.max("is_target").alias("target"), F.max(F.when(F.col("is_target") == 1, F.col("reply_chars"))).alias("reply"))
    before = F.sum(F.length("segment").cast("bigint")).over(Window.partitionBy("conv_id").orderBy("example")) - F.length("segment")
    done = grouped.withColumn("context_chars", before)
    end = F.col("context_chars") + F.length("segment") - len(CLOSE)
    has = F.col("target") == 1
    return done.select("conv_id", "example", "segment", "context_chars", F.when(has, end - F.col("reply")).alias("loss_start"), F.when(has, end).alias("loss_end"), "n_turns", has.alias("has_target"))


def prefix_targets(conversations: DataFrame) -> DataFrame:
    """conv_id, example (int from 0), text (the whole context, then the target turn), loss_start, loss_end, n_turns (in text), has_target, is_last.

    loss_start and loss_end are code points in text and span the escaped reply alone (null without a target); is_last marks a
    conversation's last example, whose text is the whole conversation.  Rows are ordered by turn, then role, then text, so ties and
    repeated rows have a defined order and all stay; null turns come first; null roles and texts count as empty; rows with a null
    conv_id form one conversation; an empty table gives no rows; extra columns are ignored, whatever their names.  A task holds
    one conversation's segments and one example's text at a time, however long they are.
    """
    own = Window.partitionBy("conv_id").orderBy("example")
    so_far = own.rowsBetween(Window.unboundedPreceding, 0)
    text = F.array_join(F.collect_list("segment").over(so_far), "")
    return prefix_segments(conversations).select("conv_id", "example", text.alias("text"), "loss_start", "loss_end", F.sum("n_turns").over(so_far).alias("n_turns"), "has_target", F.lead("example").over(own).isNull().alias("is_last"))


def read_back(examples: DataFrame) -> DataFrame:
    """Per conversation, from the examples alone: n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars, n_examples, expanded_chars.

    Each reply is cut out of its own example by the loss mask; the turns are read from the last example.  formatted_chars are those of the
    formatted conversation, expanded_chars those of all examples with a target together.
    """
    reply = F.when(F.col("has_target"), unescaped(F.expr("substring(text, cast(loss_start + 1 as int), cast(loss_end - loss_start as int))"))).otherwise("")
    each = examples.select("conv_id", "example", reply.alias("reply"), F.when(F.col("is_last"), F.col("text")).alias("shown"), F.when(F.col("has_target"), F.length("text")).otherwise(0).alias("chars"), "has_target")
    whole = each.groupBy("conv_id").agg(F.max("shown").alias("shown"), _joined("reply", "example").alias("loss"), F.count_if("has_target").alias("n_examples"), F.sum("chars").cast("bigint").alias("expanded_chars"))
    shown = F.split("shown", CLOSE)
    turns = F.filter(shown, lambda t: t != "")

    def turn(t: Column) -> Column:
        head = F.substring_index(t, MIDDLE, 1)
        role = unescaped(head.substr(F.lit(len(OPEN) + 1), F.length(head)))
        text = unescaped(t.substr(F.length(head) + len(MIDDLE) + 1, F.length(t)))
        return F.concat(role, F.lit("\n"), text, F.lit("\n"))

    said = F.array_join(F.transform(turns, turn), "")
    return whole.select("conv_id", F.size(turns).cast("bigint").alias("n_turns"), F.sha2(said, 256).alias("turns_sha256"), F.length("loss").cast("bigint").alias("loss_chars"), F.sha2("loss", 256).alias("loss_sha256"), F.length("shown").cast("bigint").alias("formatted_chars"), "n_examples", "expanded_chars")
