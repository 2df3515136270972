"""Conversation state in batch: histories, summaries, evidence memory."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def exchanges(turns: DataFrame) -> DataFrame:
    """(conv_id, turn, user, assistant): each user turn with the assistant's next one before another user turn."""
    order = Window.partitionBy("conv_id").orderBy("turn")
    numbered = turns.where(F.col("role").isin("user", "assistant")).withColumn("n", F.sum((F.col("role") == "user").cast("int")).over(order))
    pairs = numbered.where("n > 0").groupBy("conv_id", "n").agg(
        F.min("turn").alias("turn"), F.min_by("text", F.when(F.col("role") == "user", F.col("turn"))).alias("user"), F.min_by("text", F.when(F.col("role") == "assistant", F.col("turn"))).alias("assistant")
    )
    return pairs.select("conv_id", F.col("n").alias("exchange"), "turn", "user", F.coalesce("assistant", F.lit("")).alias("assistant"))


def recent(turns: DataFrame, most: int, by: str = "conv_id", order: str = "turn") -> DataFrame:
    """The last turns of each conversation."""
    last = Window.partitionBy(by).orderBy(F.col(order).desc())
    return turns.withColumn("_n", F.row_number().over(last)).where(F.col("_n") <= most).drop("_n")


def summary_entry(user: Column, assistant: Column) -> Column:
    """How an exchange that leaves the history is written into the summary."""
    return F.concat(F.lit("[USER]\n"), user, F.lit("\n[ASSISTANT]\n"), assistant)


def rolling_summary(pairs: DataFrame, history: int = 8, limit: int = 800) -> DataFrame:
    """(conv_id, summary): exchanges older than the history, oldest dropped until the rest, joined by bars, fits.

    An entry stays if it and all later ones fit; sizes run backwards from the newest.
    """
    back = Window.partitionBy("conv_id").orderBy(F.col("exchange").desc())
    rows = pairs.withColumn("_n", F.row_number().over(back)).where(F.col("_n") > history).withColumn("_e", summary_entry(F.col("user"), F.col("assistant")))
    # the joint takes five characters
    size = F.sum(F.length("_e") + 5).over(back.rowsBetween(Window.unboundedPreceding, Window.currentRow)) - 5
    kept = rows.withColumn("_size", size).where(F.col("_size") <= limit)
    joined = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("exchange", "_e"))), lambda x: x["_e"]), "\n---\n")
    summaries = kept.groupBy("conv_id").agg(joined.alias("summary"))
    return pairs.select("conv_id").distinct().join(summaries, "conv_id", "left").select("conv_id", F.coalesce("summary", F.lit("")).alias("summary"))


def latest_slots(updates: DataFrame) -> DataFrame:
    """(conv_id, slot, value): the last value set for each slot of a conversation."""
    return updates.groupBy("conv_id", "slot").agg(F.max_by("value", "turn").alias("value"))


def contextual_query(question: Column, place: Column, topic: Column) -> Column:
    """The question after the active place and topic that it doesn't name itself."""
    named = lambda x: F.when((F.coalesce(x, F.lit("")) != "") & ~F.contains(question, x), x)
    return F.concat_ws(" ", named(place), named(topic), question)
