"""Multi-party perspective rotation of dialogues, in DataFrame operations alone.

For every participant of a conversation the dialogue is rendered once more: their messages become those of the
assistant, everybody else's those of users with names, and the mask covers what the assistant says, so that a
model can be trained to speak as any of them. System messages stay system messages; nobody takes their part.

A conversation is rendered in parts of a bounded number of messages, so a conversation of any length is many rows.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

OPEN, CLOSE = "<|im_start|>", "<|im_end|>"
SYSTEM = "system"
UNKNOWN = "unknown"


@dataclass(frozen=True)
class Rendering:
    """A part covers ``part_turns`` turn numbers; one of more than ``part_messages`` messages is split further."""

    part_turns: int = 64
    part_messages: int = 1024


def _plain(text: Column) -> Column:
    """Text that cannot be taken for a marker."""
    return F.replace(text, F.lit("<|"), F.lit("< |"))


def rotate(
    turns: DataFrame,
    config: Rendering = Rendering(),
    conv_col: str = "conv_id",
    turn_col: str = "turn",
    speaker_col: str = "role",
    text_col: str = "text",
) -> DataFrame:
    """One row per conversation, perspective and part: conversation, perspective, part, n_messages, text, mask.

    Parts are numbered from 0; joined in order they are the whole rendering. ``mask`` holds the spans (start, end)
    in characters of the part's text that the assistant speaks, closing markers included. Messages are ordered by turn,
    then by a hash of speaker and text; null turns come first. Rows that repeat a message in all four columns
    count once. Line breaks in speakers are spaces, and ``<|`` is ``< |`` in speakers and texts, so that neither can be
    taken for a header. Null or empty speakers are "unknown", null texts are empty messages, and rows without a
    conversation form one of their own. A conversation of system messages alone has no participants
    and gives no rows. Other columns are ignored.
    """
    given = F.coalesce(F.col(speaker_col).cast("string"), F.lit(""))
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = turns.select(
        F.col(conv_col).alias("conv"),
        F.coalesce(F.concat(F.lit("="), F.col(conv_col).cast("string")), F.lit("")).alias("key"),
        F.col(turn_col).cast("long").alias("turn"),
        _plain(F.translate(F.when(given == "", F.lit(UNKNOWN)).otherwise(given), "\r\n", "  ")).alias("speaker"),
        _plain(text).alias("text"),
    ).distinct()
    rows = rows.withColumn("tie", F.md5(F.concat(F.col("speaker"), F.lit(":"), F.col("text")).cast("binary")))
    rows = rows.withColumn("block", F.floor(F.coalesce("turn", F.lit(-1)) / config.part_turns))
    rows = _placed(rows, config)

    people = rows.where(F.col("speaker") != SYSTEM).select("key", F.col("speaker").alias("perspective")).distinct()
    message = F.struct("turn", "tie", "speaker", "text")
    parts = rows.groupBy("conv", "key", "part").agg(F.sort_array(F.collect_list(message)).alias("messages"))
    own = lambda m: m["speaker"] == F.col("perspective")
    head = lambda m: (
        F.when(m["speaker"] == SYSTEM, F.lit(f"{OPEN}system\n"))
        .when(own(m), F.lit(f"{OPEN}assistant\n"))
        .otherwise(F.concat(F.lit(f"{OPEN}user name="), m["speaker"], F.lit("\n")))
    )
    seen = parts.join(people, "key").withColumn(
        "pieces",
        F.transform("messages", lambda m: F.struct(head(m).alias("head"), F.concat(m["text"], F.lit(CLOSE)).alias("body"), own(m).alias("own"))),
    )
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int>>").alias("mask"))

    def step(acc: Column, p: Column) -> Column:
        begin = acc["at"] + F.length(p["head"])
        end = begin + F.length(p["body"])
        span = F.array(F.struct(begin.alias("start"), end.alias("end")))
        return F.struct((end + 1).alias("at"), F.when(p["own"], F.concat(acc["mask"], span)).otherwise(acc["mask"]).alias("mask"))

    return seen.select(
        F.col("conv").alias(conv_col),
        "perspective",
        "part",
        F.size("messages").alias("n_messages"),
        F.array_join(F.transform("pieces", lambda p: F.concat(p["head"], p["body"], F.lit("\n"))), "").alias("text"),
        F.aggregate("pieces", start, step, lambda acc: acc["mask"]).alias("mask"),
    )


def _placed(rows: DataFrame, config: Rendering) -> DataFrame:
    """Number the parts of each conversation in the order of their messages: adds ``part``.

    A block of too many messages is split by turn and by leading digits of the tie-breaking hash, as many as
    it takes. Only counts of parts are put in order.
    """
    sizes = rows.groupBy("key", "block").agg(F.count("*").alias("n"))
    digits = F.ceil(F.log(F.col("n") / config.part_messages) / F.log(F.lit(16.0)))
    sizes = sizes.withColumn("digits", F.greatest(F.lit(0), digits).cast("int")).drop("n")
    split = rows.join(sizes, ["key", "block"])
    turn = F.when(F.col("digits") > 0, F.coalesce("turn", F.lit(-1))).otherwise(F.lit(-1))
    split = split.withColumn("at", F.struct("block", turn.alias("t"), F.expr("substring(tie, 1, digits)").alias("d")))
    order = W.partitionBy("key").orderBy("at")
    number = split.select("key", "at").distinct().withColumn("part", F.row_number().over(order) - 1)
    return split.join(number, ["key", "at"]).drop("at", "digits", "block")


def mask_text(mask: Column) -> Column:
    """Spans as "start-end,start-end"."""
    return F.array_join(
        F.transform(mask, lambda s: F.concat_ws("-", s["start"].cast("string"), s["end"].cast("string"))), ","
    )
