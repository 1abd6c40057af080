"""Multi-party perspective rotation of dialogues, in DataFrame operations only.

For every participant of a conversation the dialogue is rendered once with
that speaker as ``assistant`` and all others as named users; the loss mask is
1 on what the assistant says and 0 elsewhere.

``rotate`` has one row per turn and perspective; ``render`` joins the turns to
texts with their masks.  Neither collects a conversation: ``render`` gathers
turns by ranges of turn numbers, cut again where rows repeat a number, so a
row holds a fixed number of turns.  These parts move once and meet the few
participants in an equi-join on the conversation, which adaptive execution
splits when one conversation holds most of the rows; the renderings are made
after it and are not shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

CONTEXT_ROLES = ("system",)
START, NAME, END = "<|", "|>", "<|end|>\n"
TURNS_PER_ROW = 256


def _turns(turns: DataFrame) -> DataFrame:
    return turns.select(F.col("conv_id"), F.col("turn"), F.coalesce(F.col("role"), F.lit("unknown")).alias("speaker"),
                        F.coalesce(F.col("text"), F.lit("")).alias("body"), F.col("role").isNull().alias("nameless"))


def _participants(rows: DataFrame, context_roles: tuple[str, ...]) -> DataFrame:
    return (rows.where(~F.col("nameless") & ~F.col("speaker").isin(*context_roles))
            .select(F.col("conv_id").alias("_conv"), F.col("speaker").alias("perspective")).distinct())


def _own(speaker: Column, nameless: Column) -> Column:
    return (speaker == F.col("perspective")) & ~nameless


def _name(speaker: Column, nameless: Column, context_roles: tuple[str, ...]) -> Column:
    return F.when(~_own(speaker, nameless) & ~speaker.isin(*context_roles), speaker)


def _chat_role(speaker: Column, nameless: Column, context_roles: tuple[str, ...]) -> Column:
    return F.when(_own(speaker, nameless), "assistant").when(speaker.isin(*context_roles), speaker).otherwise("user")


def _header(speaker: Column, nameless: Column, context_roles: tuple[str, ...]) -> Column:
    name = F.concat(F.lit(" name="), _name(speaker, nameless, context_roles))
    return F.concat(F.lit(START), _chat_role(speaker, nameless, context_roles), F.coalesce(name, F.lit("")), F.lit(NAME))


def rotate(turns: DataFrame, context_roles: tuple[str, ...] = CONTEXT_ROLES) -> DataFrame:
    """(conv_id, perspective, turn, speaker, chat_role, name, segment, prefix_chars, loss_mask).

    ``turns`` needs conv_id, turn, role and text; other columns are ignored.
    Every distinct role is a participant, apart from context roles, which keep
    their role in every rotation and are never trained on.  A turn without a
    role is spoken by ``unknown``: it is a named user in all rotations but no
    participant.  A null text is empty.  Repeated rows and rows with the same
    turn number are each rendered; a null conv_id is a conversation of its own.
    A conversation without participants has no rendering.  In ``segment`` the
    first prefix_chars characters are the role header; the mask holds for the
    rest.
    """
    rows = _turns(turns)
    who = F.col("speaker"), F.col("nameless")
    return (rows.join(_participants(rows, context_roles), F.col("conv_id").eqNullSafe(F.col("_conv")))
            .withColumns({"chat_role": _chat_role(*who, context_roles), "name": _name(*who, context_roles),
                          "loss_mask": _own(*who).cast("int"), "header": _header(*who, context_roles)})
            .select("conv_id", "perspective", "turn", "speaker", "chat_role", "name",
                    F.concat("header", "body", F.lit(END)).alias("segment"),
                    F.length("header").alias("prefix_chars"), "loss_mask"))


def render(turns: DataFrame, context_roles: tuple[str, ...] = CONTEXT_ROLES,
           turns_per_row: int = TURNS_PER_ROW) -> DataFrame:
    """(conv_id, perspective, part, piece, n_turns, text, masks): the rotated dialogue as text.

    The rows of a dialogue in order of (part, piece) are its whole rendering: a
    part is a range of ``turns_per_row`` turn numbers, and where it has more
    rows than that, pieces cut it at every ``turns_per_row`` rows.  Ordinary
    dialogues are part 0, piece 0 alone.  ``masks`` has (chars, mask) for each
    role header and each body with its end mark, in the text's order; the
    lengths add up to the text's.  Ties on the turn are ordered by speaker,
    namelessness and text; null turns lie in part 0 and go first in it.  All
    else is as in ``rotate``.
    """
    rows = _turns(turns)
    part = F.floor(F.coalesce(F.col("turn"), F.lit(0)) / turns_per_row)
    order = Window.partitionBy("conv_id", "part").orderBy("turn", "speaker", "nameless", "body")
    pieces = (rows.withColumn("part", part)
              .withColumn("_n", F.row_number().over(order) - 1)
              .groupBy("conv_id", "part", F.floor(F.col("_n") / turns_per_row).alias("piece"))
              .agg(F.sort_array(F.collect_list(F.struct("_n", "speaker", "nameless", "body"))).alias("_turns")))

    def segment(t: Column) -> Column:
        header = _header(t["speaker"], t["nameless"], context_roles)
        body = F.concat(t["body"], F.lit(END))
        return F.struct(F.concat(header, body).alias("segment"), F.array(
            F.struct(F.length(header).alias("chars"), F.lit(0).alias("mask")),
            F.struct(F.length(body).alias("chars"), _own(t["speaker"], t["nameless"]).cast("int").alias("mask")),
        ).alias("masks"))

    return (pieces.join(_participants(rows, context_roles), F.col("conv_id").eqNullSafe(F.col("_conv")))
            .withColumn("_segments", F.transform("_turns", segment))
            .select("conv_id", "perspective", "part", "piece", F.size("_turns").alias("n_turns"),
                    F.array_join("_segments.segment", "").alias("text"), F.flatten("_segments.masks").alias("masks")))
