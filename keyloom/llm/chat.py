"""Chat formatting with Spark expressions only.

Each conversation's turns are collected as structs, sorted, and adjacent turns of one role merged into a
block; blocks are concatenated between marks. Inside texts and roles an escape character is put before
itself and into every control string, so marks never arise from content and removing one escape
character before any character restores the original. The loss mask is a list of spans (code points of
the formatted string), one for each turn of the trained role.

A conversation is one output row, so its turns meet in one task; conversations are spread over all tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Marks of the template: start of a block, end of its role, between merged turns, end of a block.
START, SEP, TURN, END = "<|im_start|>", "<|im_sep|>", "<|im_turn|>", "<|im_end|>"
#: What an escape character is put into, after the first character: the template's marks and those of others.
CONTROL = r"([<\[])(?=\||/?s>|/?INST\]|/?SYS>|</?SYS>|BOS\]|EOS\]|PAD\]|SEP\]|CLS\]|MASK\])"
OUT = "conv_id long, formatted string, turns array<struct<role:string,text:string>>, loss_spans array<struct<start:int,stop:int>>"


def escape(c: Column) -> Column:
    return F.regexp_replace(F.replace(c, F.lit("\\"), F.lit("\\\\")), CONTROL, "$1\\\\")


def unescape(c: Column) -> Column:
    return F.regexp_replace(c, r"(?s)\\(.)", "$1")


def _zip_ends(lengths: Column) -> Column:
    """Running sums: where each piece ends."""
    return F.aggregate(
        lengths,
        F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("ends")),
        lambda s, x: F.struct((s.at + x).alias("at"), F.array_append(s.ends, s.at + x).alias("ends")),
        lambda s: s.ends,
    )


def format_chats(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", trained: str = "assistant") -> DataFrame:
    """conv_id, formatted, loss_spans: one row for each conversation.

    Turns are sorted by number, then role, then text, so ties and repeated rows have one defined order;
    null numbers come first. Null roles and texts are empty. All rows with a null conversation id form
    one conversation. No rows give no rows. Other columns are ignored.
    """
    t = turns.select(
        turns[conv].cast("long").alias("conv_id"),
        F.struct(
            turns[turn].cast("long").alias("turn"),
            F.coalesce(turns[role].cast("string"), F.lit("")).alias("role"),
            F.coalesce(turns[text].cast("string"), F.lit("")).alias("text"),
        ).alias("t"),
    )
    sorted_turns = t.groupBy("conv_id").agg(F.array_sort(F.collect_list("t")).alias("ts"))
    # A turn becomes what stands before its text, its escaped text, and what follows.
    pieces = F.transform(
        F.col("ts"),
        lambda x, i: F.struct(
            F.when((i > 0) & (F.get(F.col("ts"), i - 1).role == x.role), F.lit(TURN)).otherwise(F.concat(F.lit(START), escape(x.role), F.lit(SEP))).alias("lead"),
            escape(x.text).alias("body"),
            F.when((i + 1 < F.size("ts")) & (F.get(F.col("ts"), i + 1).role == x.role), F.lit("")).otherwise(F.lit(END + "\n")).alias("trail"),
            (x.role == trained).alias("loss"),
        ),
    )
    p = sorted_turns.select("conv_id", pieces.alias("ps"))
    lengths = F.transform("ps", lambda x: F.char_length(x.lead) + F.char_length(x.body) + F.char_length(x.trail))
    p = p.select("conv_id", "ps", _zip_ends(lengths).alias("ends"))
    spans = F.transform(
        F.filter(F.arrays_zip("ps", "ends"), lambda z: z.ps.loss),
        lambda z: F.struct((z.ends - F.char_length(z.ps.trail) - F.char_length(z.ps.body)).alias("start"), (z.ends - F.char_length(z.ps.trail)).alias("stop")),
    )
    return p.select(
        "conv_id",
        F.array_join(F.transform("ps", lambda x: F.concat(x.lead, x.body, x.trail)), "").alias("formatted"),
        spans.alias("loss_spans"),
    )


def read_chats(formatted: DataFrame) -> DataFrame:
    """The turns and the texts under the loss mask, read back from conv_id, formatted and loss_spans."""
    blocks = F.filter(F.split("formatted", r"<\|im_end\|>\n"), lambda b: b != "")
    turns = F.flatten(
        F.transform(
            blocks,
            lambda b: F.transform(
                F.split(F.substring_index(b, SEP, -1), r"<\|im_turn\|>"),
                lambda body: F.struct(unescape(F.substring(F.substring_index(b, SEP, 1), len(START) + 1, 2**31 - 1)).alias("role"), unescape(body).alias("text")),
            ),
        )
    )
    under = F.transform("loss_spans", lambda s: unescape(F.substring(F.col("formatted"), s.start + 1, s.stop - s.start)))
    return formatted.select("conv_id", "formatted", "loss_spans", turns.alias("turns"), under.alias("loss_texts"))
