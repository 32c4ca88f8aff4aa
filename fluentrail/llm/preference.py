"""Preference formatting: the common turns of two conversations once, then their masked endings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _turns(conversations: DataFrame, pair: str, turn: str, role: str, text: str) -> DataFrame:
    """One row per pair and turn; of several rows at one place the smallest role and text counts."""
    said = F.struct(F.coalesce(F.col(role), F.lit("")).alias("role"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    source = conversations.select(F.col(pair).alias("pair"), F.col(turn).alias("turn"), said.alias("said"))
    return source.filter(F.col("pair").isNotNull() & F.col("turn").isNotNull()).groupBy("pair", "turn").agg(F.min("said").alias("said"))


def _header(role: Column) -> Column:
    return F.concat(F.lit("<|"), role, F.lit("|>\n"))


def format_preferences(
    chosen: DataFrame,
    rejected: DataFrame,
    pair: str = "pair_id",
    turn: str = "turn",
    role: str = "role",
    text: str = "text",
    learned_role: str = "assistant",
) -> DataFrame:
    """Training text of preference pairs, a row per turn.

    Columns: ``pair, part, turn, role, rendered, mask_start, mask_end``. ``part`` is ``prompt`` for the longest
    common prefix of turns (same place, role and text), which is rendered once per pair, then ``chosen`` and
    ``rejected`` for what follows in either. Joined in turn order, ``rendered`` gives the texts; the signs
    from ``mask_start`` up to ``mask_end`` are learned: the words of ``learned_role`` outside the prompt.

    A turn missing on one side ends the prefix; a number missing in both is no turn. Null texts or roles are empty.
    Rows without pair or turn take no part. A pair that has one side only has that side as completion from
    its first turn; equal conversations are all prompt. Turns are rows throughout: a conversation with a
    third of all turns is joined and counted in parts, never gathered.
    """
    a = _turns(chosen, pair, turn, role, text).withColumnRenamed("said", "chosen")
    b = _turns(rejected, pair, turn, role, text).withColumnRenamed("said", "rejected")
    both = a.join(b, ["pair", "turn"], "full_outer")
    same = F.col("chosen").eqNullSafe(F.col("rejected"))
    parting = both.groupBy("pair").agg(F.min(F.when(~same, F.col("turn"))).alias("parting"))
    part = F.explode(
        F.when(F.col("in_prompt"), F.array(F.struct(F.lit("prompt").alias("part"), F.col("chosen").alias("said")))).otherwise(
            F.array(
                F.struct(F.lit("chosen").alias("part"), F.col("chosen").alias("said")),
                F.struct(F.lit("rejected").alias("part"), F.col("rejected").alias("said")),
            )
        )
    )
    in_prompt = F.coalesce(F.col("turn") < F.col("parting"), F.lit(True))
    rows = both.join(parting, "pair").withColumn("in_prompt", in_prompt).select("pair", "turn", part.alias("row")).select("pair", "turn", "row.*")
    header = _header(F.col("said.role"))
    learned = (F.col("part") != "prompt") & (F.col("said.role") == learned_role)
    start = F.length(header)
    return rows.filter(F.col("said").isNotNull()).select(
        F.col("pair").alias(pair),
        "part",
        F.col("turn").alias(turn),
        F.col("said.role").alias(role),
        F.concat(header, F.col("said.text"), F.lit("\n")).alias("rendered"),
        start.cast("long").alias("mask_start"),
        (start + F.when(learned, F.length("said.text")).otherwise(0)).cast("long").alias("mask_end"),
    )


def preference_records(rows: DataFrame, pair: str = "pair_id", turn: str = "turn") -> DataFrame:
    """One record per pair out of the rows of ``format_preferences``: the prompt, and both completions with their masks.

    Columns: ``pair, prompt, chosen, chosen_mask, rejected, rejected_mask``. The texts are the rendered turns in order, empty
    if a part has none; a mask lists the learned stretches of its text as ``start, end`` in signs. A record is as long as its conversation.
    """
    part = F.struct(F.col(turn).alias("turn"), "rendered", "mask_start", "mask_end")
    parts = rows.groupBy(pair).agg(*[F.array_sort(F.collect_list(F.when(F.col("part") == name, part))).alias(name) for name in ("prompt", "chosen", "rejected")])

    def text(name: str) -> Column:
        return F.array_join(F.transform(name, lambda t: t["rendered"]), "").alias(name)

    def mask(name: str) -> Column:
        none = F.array().cast("array<struct<start: bigint, end: bigint>>")
        first = F.struct(F.lit(0).cast("bigint").alias("at"), none.alias("spans"))

        def add(state: Column, t: Column) -> Column:
            span = F.struct((state["at"] + t["mask_start"]).alias("start"), (state["at"] + t["mask_end"]).alias("end"))
            spans = F.when(t["mask_end"] > t["mask_start"], F.concat(state["spans"], F.array(span))).otherwise(state["spans"])
            return F.struct((state["at"] + F.length(t["rendered"])).alias("at"), spans.alias("spans"))

        return F.aggregate(name, first, add, lambda state: state["spans"]).alias(f"{name}_mask")

    return parts.select(pair, text("prompt"), text("chosen"), mask("chosen"), text("rejected"), mask("rejected"))
