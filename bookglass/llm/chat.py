"""Chat formatting by prefix-target expansion, with DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: A turn is HEAD role NEXT text END. None of the three can stand in an escaped role or text.
HEAD, NEXT, END = "### ", "\n", "</turn>\n"
#: Control characters and what stands for them, backslash first: escaped texts hold no "#" and no "<", roles no newline either.
TEXT_ESCAPES = [("\\", "\\b"), ("#", "\\h"), ("<", "\\l")]
ROLE_ESCAPES = [*TEXT_ESCAPES, ("\n", "\\n")]


def escape(c: Column, pairs: list[tuple[str, str]] = TEXT_ESCAPES) -> Column:
    for raw, out in pairs:
        c = F.replace(c, F.lit(raw), F.lit(out))
    return c


def unescape(c: Column, pairs: list[tuple[str, str]] = TEXT_ESCAPES) -> Column:
    for raw, out in reversed(pairs):
        c = F.replace(c, F.lit(out), F.lit(raw))
    return c


def format_conversations(turns: DataFrame, *, target_role: str = "assistant") -> DataFrame:
    """An example per turn of target_role: all turns before it as context, and its text alone trainable.

    Columns conv_id, example (the target's place among the turns), formatted, loss_start, loss_length (code points of
    ``formatted`` under the loss mask; 0 and 0 if none), last. Turns after the last target, or of a conversation
    without one, come in one more example whose mask is empty, so every turn can be read back from the example marked
    ``last``.

    Turns are placed by a running sum of their lengths, a window that spills, and dealt by conversation once. A conversation's text
    is then one string, of which each example is a prefix, cut off row by row: a task holds one conversation and one example of it at a
    time, however many turns there are.

    Turns are ordered by turn, then role, then text; repeated rows are turns of their own. Null texts and roles are
    empty, a null turn comes first, null conv_ids form one conversation. Other columns are not read. No rows give none.
    A conversation's turns meet in one row, as its digests need them in order.
    """
    role, text = F.coalesce(F.col("role").cast("string"), F.lit("")), F.coalesce(F.col("text").cast("string"), F.lit(""))
    t = turns.select("conv_id", "turn", role.alias("role"), text.alias("text"))
    head, said = F.concat(F.lit(HEAD), escape(F.col("role"), ROLE_ESCAPES), F.lit(NEXT)), escape(F.col("text"))
    w = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    t = t.select("conv_id", F.row_number().over(w).alias("example"), head.alias("head"), said.alias("said"), (F.col("role") == target_role).alias("target"), F.sum(F.length(head) + F.length(said) + len(END)).over(w.rowsBetween(Window.unboundedPreceding, 0)).cast("int").alias("end"))
    start = F.col("end") - len(END) - F.length("said")
    mark = F.struct("example", "end", F.when(F.col("target"), start).otherwise(0).alias("loss_start"), F.when(F.col("target"), F.length("said")).otherwise(0).alias("loss_length"))
    piece = F.struct("example", F.concat("head", "said", F.lit(END)).alias("piece"))
    talks = t.groupBy("conv_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(piece)), lambda x: x["piece"]), "").alias("whole"), F.collect_list(F.when(F.col("target"), mark)).alias("targets"), F.max(mark).alias("end_mark"))
    closing = F.when(F.exists("targets", lambda x: x["example"] == F.col("end_mark")["example"]), F.array()).otherwise(F.array("end_mark"))
    rows = talks.select("conv_id", "whole", F.col("end_mark")["example"].alias("turns"), F.explode(F.concat("targets", closing)).alias("m"))
    return rows.select("conv_id", "m.example", F.left("whole", "m.end").alias("formatted"), "m.loss_start", "m.loss_length", (F.col("m.example") == F.col("turns")).alias("last"))


def parse_turns(formatted: Column) -> Column:
    """Array of struct(role, text) read back from a formatted example."""
    parts = F.filter(F.split(formatted, END, -1), lambda x: x != "")
    body = lambda x: F.substring(x, len(HEAD) + 1, 2**31 - 1)
    at = lambda x: F.instr(body(x), NEXT)
    return F.transform(parts, lambda x: F.struct(unescape(F.left(body(x), at(x) - 1), ROLE_ESCAPES).alias("role"), unescape(F.substring(body(x), at(x) + 1, F.lit(2**31 - 1))).alias("text")))


def loss_text(examples: DataFrame) -> Column:
    """The unescaped text under the mask of a row of format_conversations."""
    return unescape(F.substring(F.col("formatted"), F.col("loss_start") + 1, F.col("loss_length")))


def digests(examples: DataFrame) -> DataFrame:
    """Per conversation, read back from its formatted examples: turns, their digest, the text under the loss masks, all code points."""
    own = examples.select("conv_id", F.length("formatted").cast("long").alias("chars"), F.struct("example", loss_text(examples).alias("text")).alias("loss"), F.when(F.col("last"), F.col("formatted")).alias("whole"))
    one = own.groupBy("conv_id").agg(F.sum("chars").alias("formatted_chars"), F.array_join(F.transform(F.sort_array(F.collect_list("loss")), lambda x: x["text"]), "").alias("loss"), F.max("whole").alias("whole"))
    one = one.withColumn("turns", parse_turns(F.col("whole")))
    said = F.array_join(F.transform("turns", lambda x: F.concat(x["role"], F.lit("\n"), x["text"], F.lit("\n"))), "")
    return one.select("conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(said.cast("binary"), 256).alias("turns_sha256"), F.length("loss").cast("long").alias("loss_chars"), F.sha2(F.col("loss").cast("binary"), 256).alias("loss_sha256"), "formatted_chars")
