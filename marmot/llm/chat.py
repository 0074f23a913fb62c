"""Chat formatting by prefix-target expansion, in DataFrame functions only.

A turn is written ``<|turn|>role<|text|>text<|end|>``.  Inside roles and texts every
``<`` followed by backslashes (or none) and ``|`` gets one backslash more before
the ``|``, so no control string can occur there, and taking one off again gives
the very text back.

Every assistant turn becomes an example of its own: all turns before it are its
context and only its text is under the loss mask.  Turns after the last assistant
turn (or a conversation without one) make one further example with an empty mask,
so that the examples hold the whole conversation.  A conversation is grouped once
by its id; an example is as long as its prefix, and one example at a time is built.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# control strings of the template
TURN, TEXT, END = "<|turn|>", "<|text|>", "<|end|>"
ASSISTANT = "assistant"


def escaped(c: Column) -> Column:
    """One backslash more between ``<`` and ``|``."""
    return F.regexp_replace(c, r"<(\\*)\|", r"<$1\\|")


def unescaped(c: Column) -> Column:
    return F.regexp_replace(c, r"<(\\*)\\\|", r"<$1|")


def examples(conversations: DataFrame) -> DataFrame:
    """conv_id, example, n_turns, text, loss_start, loss_end, closes: the training examples.

    ``conversations`` needs conv_id, turn, role and text; other columns are ignored.  Turns go by
    ``turn``, nulls first, rows of one turn by role and text as written; repeated rows stay.  A null role or
    text is empty; rows with a null conv_id are one conversation.  ``text`` holds ``n_turns`` turns,
    its characters (code points) from ``loss_start`` up to ``loss_end`` are trainable; ``closes`` marks
    a conversation's last example, which holds all its turns.  An empty table gives none.
    """
    def part(name: str) -> Column:
        return escaped(F.coalesce(F.col(name).cast("string"), F.lit("")))

    written = conversations.select(
        "conv_id", F.col("turn").cast("bigint").alias("turn"), part("role").alias("role"), part("text").alias("text"))
    turn = F.struct("turn", F.concat(F.lit(TURN), "role", F.lit(TEXT)).alias("head"), "text", (F.col("role") == ASSISTANT).alias("reply"))
    whole = written.groupBy("conv_id").agg(F.array_sort(F.collect_list(turn)).alias("turns"))
    last = F.size("turns")
    targets = F.filter(F.sequence(F.lit(1), last), lambda i: F.element_at("turns", i)["reply"] | (i == last))
    each = whole.select("conv_id", "turns", F.posexplode(targets).alias("example", "n_turns"))
    before = F.transform(F.slice("turns", F.lit(1), F.col("n_turns") - 1), lambda t: F.concat(t["head"], t["text"], F.lit(END)))
    built = each.select("conv_id", "example", "n_turns", (F.col("n_turns") == last).alias("closes"),
                        F.array_join(before, "").alias("context"), F.element_at("turns", F.col("n_turns")).alias("target"))
    start = F.length("context") + F.length("target.head")
    loss_end = start + F.length("target.text")
    return built.select(
        "conv_id", "example", "n_turns", F.concat("context", "target.head", "target.text", F.lit(END)).alias("text"),
        F.when(F.col("target.reply"), start).otherwise(loss_end).alias("loss_start"), loss_end.alias("loss_end"), "closes")


def turns_of(text: Column) -> Column:
    """The (role, text) structs that a formatted text holds, as they were before escaping."""
    parts = F.split(text, r"<\|end\|>")
    return F.transform(F.slice(parts, F.lit(1), F.size(parts) - 1), lambda p: F.struct(
        unescaped(F.replace(F.substring_index(p, TEXT, 1), F.lit(TURN), F.lit(""))).alias("role"),
        unescaped(F.substring_index(p, TEXT, -1)).alias("text")))


def trainable(text: Column, start: Column, end: Column) -> Column:
    """The text under the loss mask, as it was before escaping."""
    return unescaped(F.substring(text, start + 1, end - start))


def digests(formatted: DataFrame) -> DataFrame:
    """One row per conversation, read from the texts and masks of its examples alone.

    The examples of a conversation are still together, so this groups them without a further shuffle;
    read back from files they are shuffled by conv_id.
    """
    line = F.transform(turns_of(F.col("text")), lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n")))
    read = formatted.select(
        "conv_id", "example", F.length("text").alias("chars"),
        F.when(F.col("closes"), F.size(line).cast("bigint")).alias("n_turns"),
        F.when(F.col("closes"), F.sha2(F.array_join(line, ""), 256)).alias("turns_sha256"),
        trainable(F.col("text"), F.col("loss_start"), F.col("loss_end")).alias("reply"))
    replies = F.transform(F.array_sort(F.collect_list(F.struct("example", "reply"))), lambda r: r["reply"])
    return read.groupBy("conv_id").agg(
        F.max("n_turns").alias("n_turns"), F.max("turns_sha256").alias("turns_sha256"),
        F.sum(F.length("reply")).cast("bigint").alias("loss_chars"), F.sha2(F.array_join(replies, ""), 256).alias("loss_sha256"),
        F.sum("chars").cast("bigint").alias("formatted_chars"))
