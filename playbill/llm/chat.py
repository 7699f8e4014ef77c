"""Chat formatting: every assistant turn becomes an example of its own.

An example holds all turns before the reply, then the reply; only the reply's
text is under the loss mask. Turns stand as ``<|im_start|>role\\ntext<|im_end|>\\n``.
Control strings inside a text get a backslash after their first character, and
backslashes are doubled, so no text can forge a turn and every text comes back.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from playbill.functions.text import let

# Strings that chat templates in use treat as control tokens.
CONTROL = [
    "<|im_start|>", "<|im_end|>", "<|endoftext|>", "<|system|>", "<|user|>", "<|assistant|>", "<|end|>",
    "<|eot_id|>", "<|begin_of_text|>", "<|start_header_id|>", "<|end_header_id|>",
    "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>",
]
START, END = "<|im_start|>", "<|im_end|>\n"
_FIND = "|".join(f"{re.escape(c[0])}(?={re.escape(c[1:])})" for c in CONTROL)


def escape(text: Column) -> Column:
    r"""Doubles backslashes, then puts one after the first character of each control string."""
    return F.regexp_replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), f"({_FIND})", r"$1\\")


def unescape(text: Column) -> Column:
    r"""A backslash stands for the character after it."""
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def escape_role(role: Column) -> Column:
    """As ``escape``, with line ends escaped too, since a line end closes the role."""
    return F.replace(escape(role), F.lit("\n"), F.lit("\\\n"))


def conversations_of(turns: DataFrame) -> DataFrame:
    """One row per conversation: ``turns``, an array of (turn, role, text) in order."""
    row = F.struct(F.col("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    return turns.groupBy("conv_id").agg(F.array_sort(F.collect_list(row)).alias("turns"))


def examples(turns: DataFrame, target: str = "assistant") -> DataFrame:
    """Prefix-target examples: (conv_id, example, target_turn, formatted, loss_start, loss_end).

    ``turns`` has conv_id, turn, role and text. A turn's order is its number, null first, then role
    and text; repeated rows are turns of their own. A null role or text is empty; a null conv_id is one
    conversation. ``formatted`` ends with the reply, and [loss_start, loss_end) are its code points,
    escapes included. Turns after the last reply, or a conversation without any, give one more example
    without a target: target_turn null and an empty mask, so that no turn is lost. Other input columns
    are ignored. An empty table gives no example. Examples of one conversation repeat their
    context, which is what the method asks for; they are exploded, never held together.
    """
    piece = lambda t: F.concat(F.lit(START), escape_role(t["role"]), F.lit("\n"), escape(t["text"]), F.lit(END))
    base = conversations_of(turns).select(
        "conv_id", F.transform("turns", lambda t: F.struct(
            piece(t).alias("piece"), F.char_length(escape(t["text"])).alias("n"), (t["role"] == target).alias("reply"))).alias("turns"))
    n = F.size("turns")
    ends = F.filter(F.sequence(F.lit(1), n), lambda i: F.get("turns", i - 1)["reply"] | (i == n))
    out = base.select("conv_id", F.posexplode(ends).alias("example", "end"), "turns").select(
        "conv_id", F.col("example").cast("bigint").alias("example"),
        F.get("turns", F.col("end") - 1)["reply"].alias("reply"), F.get("turns", F.col("end") - 1)["n"].alias("n"),
        F.col("end"), F.array_join(F.transform(F.slice("turns", 1, F.col("end")), lambda t: t["piece"]), "").alias("formatted"))
    last = F.char_length("formatted") - len(END)
    return out.select(
        "conv_id", "example", F.when(F.col("reply"), F.col("end")).cast("bigint").alias("target_turn"), "formatted",
        F.when(F.col("reply"), last - F.col("n")).otherwise(0).cast("bigint").alias("loss_start"),
        F.when(F.col("reply"), last).otherwise(0).cast("bigint").alias("loss_end"))


def loss_text(example: DataFrame) -> Column:
    """The unescaped text under the mask."""
    return unescape(F.substr("formatted", (example["loss_start"] + 1).cast("int"), (example["loss_end"] - example["loss_start"]).cast("int")))


def parse(formatted: Column) -> Column:
    """The turns of a formatted text, as an array of (role, text)."""
    pieces = F.filter(F.split(formatted, re.escape(END)), lambda p: p != "")
    body = lambda p: F.substr(p, F.lit(len(START) + 1))
    role = lambda b: F.regexp_extract(b, r"(?s)^((?:[^\\\n]|\\.)*)\n", 1)
    return F.transform(pieces, lambda p: let(body(p), lambda b: let(role(b), lambda r: F.struct(
        unescape(r).alias("role"), unescape(F.substr(b, F.char_length(r) + 2)).alias("text")))))


def read_back(formatted: DataFrame) -> DataFrame:
    """Per conversation, from examples alone: ``turns`` of the longest one, ``loss`` (texts in order) and ``formatted_chars``."""
    longest = F.max(F.struct("example", "formatted"))["formatted"]
    return formatted.groupBy("conv_id").agg(
        parse(longest).alias("turns"),
        F.transform(F.array_sort(F.collect_list(F.when(F.col("target_turn").isNotNull(), F.struct(
            F.col("example"), loss_text(formatted).alias("text"))))), lambda x: x["text"]).alias("loss"),
        F.sum(F.char_length("formatted")).cast("bigint").alias("formatted_chars"))
