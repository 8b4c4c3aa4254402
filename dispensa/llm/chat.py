"""Chat formatting by prefix-target expansion (DataFrame functions only).

Every assistant turn of a conversation becomes one training example: all
preceding turns are its context, and only that reply is trainable.  Turns that
follow the last reply have no target; they come as one closing example with an
empty loss span, so no turn is lost.

Template: ``<|im_start|>{role}\\n{text}<|im_end|>\\n`` per turn.  Inside texts
and roles ``\\`` becomes ``\\\\`` and ``<|`` becomes ``<\\|``, so no text can
hold a control string, and ``unescape`` gives the text back.  A role's line
breaks become ``\\n`` (backslash and n).

Defined results: a null text or role is the empty string; a null turn sorts
first; turns that share a number are ordered by role, then text (by code
point); rows that repeat stay as separate turns; rows with a null conv_id form
one conversation.  Extra columns are ignored.  An empty table gives no rows.

A conversation is one value by the contract (its digest covers all its turns
in order), so its rows meet in one array; different conversations are spread
by a hash of the id.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

START, END = "<|im_start|>", "<|im_end|>"


def escape(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit("<|"), F.lit("<\\|"))


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"\\([\\|])", "$1")


def escape_role(role: Column) -> Column:
    return F.replace(escape(role), F.lit("\n"), F.lit("\\n"))


def unescape_role(role: Column) -> Column:
    # a backslash-n counts as a line break when an even number of backslashes precedes it
    return unescape(F.regexp_replace(role, r"(?<!\\)((?:\\\\)*)\\n", "$1\n"))


def _turn(role: Column, text: Column) -> Column:
    return F.concat(F.lit(START), escape_role(role), F.lit("\n"), escape(text), F.lit(END + "\n"))


def format_conversations(rows: DataFrame) -> DataFrame:
    """``rows``: conv_id, turn, role, text.  Returns one row per example:
    conv_id, example (from 0), formatted, loss_start (code points from 0),
    loss_chars (0 for a closing example without reply), has_target."""
    turn = F.struct(F.col("turn"), F.coalesce(F.col("role"), F.lit("")).alias("role"),
                    F.coalesce(F.col("text"), F.lit("")).alias("text"))
    convs = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list(turn)).alias("turns"))
    n = F.size("turns")
    # ends of the examples: each assistant turn, and the last turn if it is no reply
    ends = F.filter(F.sequence(F.lit(1), n),
                    lambda i: (F.get(F.col("turns"), i - 1)["role"] == "assistant") | (i == n))
    examples = convs.select("conv_id", "turns", F.posexplode(ends).alias("example", "_end"))
    context = F.array_join(F.transform(F.slice("turns", 1, F.col("_end") - 1),
                                       lambda t: _turn(t["role"], t["text"])), "")
    last = F.get(F.col("turns"), F.col("_end") - 1)
    parts = examples.select("conv_id", "example", context.alias("context"),
                            escape_role(last["role"]).alias("role"), escape(last["text"]).alias("reply"),
                            (last["role"] == "assistant").alias("has_target"))
    head = F.concat(F.lit(START), F.col("role"), F.lit("\n"))
    return parts.select(
        "conv_id", "example",
        F.concat("context", head, "reply", F.lit(END + "\n")).alias("formatted"),
        (F.length("context") + F.length(head)).cast("long").alias("loss_start"),
        F.when(F.col("has_target"), F.length("reply")).otherwise(0).cast("long").alias("loss_chars"),
        "has_target")


def parse_turns(formatted: Column) -> Column:
    """The turns of a formatted example as array<struct<role, text>>, unescaped."""
    pieces = F.filter(F.split(formatted, r"<\|im_start\|>", -1), lambda p: p != "")
    return F.transform(pieces, lambda p: F.struct(
        unescape_role(F.substring_index(p, "\n", 1)).alias("role"),
        unescape(F.regexp_extract(p, r"(?s)^[^\n]*\n(.*)<\|im_end\|>\n$", 1)).alias("text")))


def trained_text(formatted: Column, loss_start: Column, loss_chars: Column) -> Column:
    """The text under an example's loss mask, unescaped."""
    return unescape(F.substring(formatted, loss_start.cast("int") + 1, loss_chars.cast("int")))


def digest(examples: DataFrame) -> DataFrame:
    """Per conversation, read back from the formatted examples: conv_id,
    n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars and
    n_examples.  The last example holds every turn; the trained texts come
    from each example's own loss span, in example order."""
    per = examples.select(
        "conv_id", "example", "formatted",
        trained_text(F.col("formatted"), F.col("loss_start"), F.col("loss_chars")).alias("trained"))
    convs = per.groupBy("conv_id").agg(
        F.max_by("formatted", "example").alias("whole"),
        F.sort_array(F.collect_list(F.struct("example", "trained"))).alias("targets"),
        F.sum(F.length("formatted").cast("long")).alias("formatted_chars"))
    # columns of their own: each is used twice
    convs = convs.withColumn("turns", parse_turns(F.col("whole"))) \
        .withColumn("trained", F.array_join(F.transform("targets", lambda x: x["trained"]), ""))
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return convs.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"),
        F.sha2(said.cast("binary"), 256).alias("turns_sha256"),
        F.length("trained").cast("long").alias("loss_chars"),
        F.sha2(F.col("trained").cast("binary"), 256).alias("loss_sha256"),
        "formatted_chars", F.size("targets").cast("long").alias("n_examples"))
