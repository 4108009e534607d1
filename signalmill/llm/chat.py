"""Multi-party dialogues from every participant's perspective, with DataFrame functions only.

For each participant of a conversation the dialogue is rendered with that speaker as the assistant and
all others as named users. A rendered dialogue is a sequence of segments, one row for each turn, with
their places in the whole text; the mask covers what the assistant says and its end mark. Places are
running sums in two steps, within chunks of turns and over chunks, so a conversation that holds a large
share of all rows is spread over its chunks.

Rows repeated in all four columns are one turn. Turns with equal numbers are ordered by role and text,
turns without a number come last. A null role is the participant ``unknown``, a null text is empty, null
conversation ids are one conversation. Other columns are ignored, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

CHUNK_TURNS = 256
#: The template. A name is the role as it stands.
ASSISTANT, USER, USER_END, END = "<|assistant|>\n", "<|user name=", "|>\n", "<|end|>\n"


def segments(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """One row per participant and turn.

    Returns ``conv``, ``perspective``, ``position`` (from 0), ``turn``, ``speaker``, ``is_assistant``,
    ``segment``, ``seg_start`` and ``seg_end`` (characters of the whole dialogue), ``mask_start`` and
    ``mask_end`` (null for users).
    """
    rows = turns.select(
        F.col(conv).alias("_conv"), F.col(turn).alias("_turn"),
        F.coalesce(F.col(role), F.lit("unknown")).alias("_role"), F.coalesce(F.col(text), F.lit("")).alias("_text"),
    )
    # Nulls would not join: turns without a number have the last chunk, null conversations a key that no id has.
    def key_of(conv: Column) -> Column:
        return F.when(conv.isNull(), F.lit("")).otherwise(F.concat(F.lit("="), conv.cast("string")))

    chunk = F.coalesce(F.floor(F.col("_turn") / CHUNK_TURNS), F.lit(2**62))
    rows = rows.withColumns({"_chunk": chunk, "_key": key_of(F.col("_conv"))})
    # The only exchange of texts; grouping, join and windows below keep its partitioning.
    rows = rows.repartition("_key", "_chunk").distinct()
    names = turns.select(
        key_of(F.col(conv)).alias("_key"),
        F.coalesce(F.floor(F.col(turn) / CHUNK_TURNS), F.lit(2**62)).alias("_chunk"),
        F.coalesce(F.col(role), F.lit("unknown")).alias("perspective"),
    )
    parts = names.select("_key", "perspective").distinct().join(names.select("_key", "_chunk").distinct(), "_key")
    seen = rows.join(parts.hint("shuffle_hash"), ["_key", "_chunk"])

    own = F.col("_role") == F.col("perspective")
    head = F.when(own, F.lit(ASSISTANT)).otherwise(F.concat(F.lit(USER), F.col("_role"), F.lit(USER_END)))
    seen = seen.withColumns({"_head": head, "_own": own})
    seen = seen.withColumn("_segment", F.concat("_head", "_text", F.lit(END)))
    order = [F.col("_turn").asc_nulls_last(), F.col("_role"), F.col("_text")]
    within = Window.partitionBy("_key", "_chunk", "perspective").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    length = F.length("_segment").cast("long")
    seen = seen.withColumns({"_size": length, "_upto": F.sum(length).over(within), "_rank": F.count("*").over(within)})

    # Chunk totals from roles alone: sizes of heads, texts and ends by chunk and role.
    sizes = rows.groupBy("_key", "_chunk", "_role").agg(
        F.sum(F.length("_text").cast("long")).alias("_chars"), F.count("*").alias("_turns")
    )
    by_part = sizes.join(parts, ["_key", "_chunk"])
    head_size = F.when(F.col("_role") == F.col("perspective"), F.lit(len(ASSISTANT))).otherwise(
        F.length("_role") + len(USER) + len(USER_END)
    )
    totals = by_part.groupBy("_key", "_chunk", "perspective").agg(
        F.sum(F.col("_chars") + F.col("_turns") * (head_size + len(END))).alias("_sum"), F.sum("_turns").alias("_count")
    )
    before = Window.partitionBy("_key", "perspective").orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select(
        "_key", "_chunk", "perspective",
        F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_from"),
        F.coalesce(F.sum("_count").over(before), F.lit(0)).alias("_first"),
    )
    out = seen.join(totals.hint("shuffle_hash"), ["_key", "_chunk", "perspective"])
    start = (F.col("_from") + F.col("_upto") - F.col("_size")).cast("long")

    def masked(value: Column) -> Column:
        return F.when(F.col("_own"), value)

    return out.select(
        F.col("_conv").alias(conv), "perspective", (F.col("_first") + F.col("_rank") - 1).cast("long").alias("position"),
        F.col("_turn").alias("turn"), F.col("_role").alias("speaker"), F.col("_own").alias("is_assistant"),
        F.col("_segment").alias("segment"), start.alias("seg_start"), (start + F.col("_size")).alias("seg_end"),
        masked(start + F.length("_head")).cast("long").alias("mask_start"), masked(start + F.col("_size")).alias("mask_end"),
    )


def dialogues(rendered: DataFrame, conv: str = "conv_id") -> DataFrame:
    """One row per conversation and perspective: the whole text and the masked ranges.

    A row holds its whole dialogue, so this is for conversations that fit one; segments are not bound by it.
    """
    part = F.struct("position", "segment", "mask_start", "mask_end")
    ordered = rendered.groupBy(conv, "perspective").agg(F.array_sort(F.collect_list(part)).alias("_parts"))
    ranges = F.transform(
        F.filter("_parts", lambda p: p["mask_start"].isNotNull()), lambda p: F.struct(p["mask_start"].alias("start"), p["mask_end"].alias("end"))
    )
    return ordered.select(conv, "perspective", F.array_join(F.transform("_parts", lambda p: p["segment"]), "").alias("text"), ranges.alias("masks"))
