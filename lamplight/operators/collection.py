"""Batches of collection: what becomes of candidates that come in order, under limits for sources and for the whole.

Limits depend on what was accepted before.  Running counts are sums over ranges of the
order first, then within a range, so neither the whole order nor a source that holds a
third of all candidates has to pass through one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lamplight.sources.tables import written

#: Errors after which a source is left alone.
ERRORS = 2


def in_ranges(rows: DataFrame, order: str) -> DataFrame:
    """rows with _part, the number of their range of the order; stored, so that the ranges stay as they are."""
    return written(rows.repartitionByRange(order).withColumn("_part", F.spark_partition_id()), "collection-ranges")


def counts_before(ranged: DataFrame, order: str, values: dict[str, Column], by: str | None = None) -> DataFrame:
    """ranged with running sums of the values over all rows before each one, of its group if there is one.

    A group has a sum for each range, and its sums are added up over the ranges; within a
    range a window goes on from there.
    """
    group = [by] if by else []
    sums = ranged.groupBy("_part", *group).agg(*[F.sum(v).alias(f"_s_{name}") for name, v in values.items()])
    ranges_before = Window.partitionBy(*group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.select("_part", *[F.col(g).alias("_group") for g in group], *[F.coalesce(F.sum(f"_s_{name}").over(ranges_before), F.lit(0)).alias(f"_b_{name}") for name in values])
    on = ranged["_part"] == starts["_part"]
    if by:
        on = on & ranged[by].eqNullSafe(starts["_group"])
    both = ranged.join(starts, on, "left").drop(starts["_part"], "_group")
    inside = Window.partitionBy("_part", *group).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return both.withColumns({name: F.col(f"_b_{name}") + F.coalesce(F.sum(v).over(inside), F.lit(0)) for name, v in values.items()}).drop(*[f"_b_{name}" for name in values])


def batch_outcomes(rows: DataFrame, order: str, source: str, good: Column, failed: Column, blocked: Column, source_limit: Column, most: int, errors: int = ERRORS) -> DataFrame:
    """rows with outcome: what a batch that takes them in order makes of each.

    accepted, rejected, failed, blocked; over_limit: its source had as many accepted as
    source_limit; source_stopped: its source had failed `errors` times; not_reached: `most`
    were accepted.  Rows of the last three are not looked at, so they neither fail nor
    count.  A source's first of over_limit and source_stopped holds for all its later rows.

    Cases: a null test doesn't hold; rows without a source are a source of their own; order
    has to be unique; a column named outcome is replaced; empty tables give empty results.
    """
    is_ = lambda c: F.coalesce(c, F.lit(False))
    tested = rows.drop("outcome").withColumns({"_blocked": is_(blocked), "_limit": source_limit.cast("long")})
    tested = tested.withColumn("_failed", is_(failed) & ~F.col("_blocked"))
    tested = tested.withColumn("_good", is_(good) & ~F.col("_blocked") & ~F.col("_failed"))
    one = lambda c: F.col(c).cast("long")
    # Counts of all rows before are right up to the first row that its source's limits keep out, and only that one is asked for.
    counted = written(counts_before(in_ranges(tested, order), order, {"_taken": one("_good"), "_errors": one("_failed")}, source), "collection-counts")
    ended = F.when(F.col("_taken") >= F.col("_limit"), "over_limit").when(F.col("_errors") >= errors, "source_stopped")
    first = counted.where(ended.isNotNull()).groupBy(F.col(source).alias("_of")).agg(F.min(F.struct(F.col(order).alias("at"), ended.alias("why"))).alias("_end"))
    known = counted.join(first, F.col(source).eqNullSafe(F.col("_of")), "left")
    outcome = F.when(F.col(order) >= F.col("_end.at"), F.col("_end.why")).when(F.col("_blocked"), "blocked").when(F.col("_failed"), "failed").when(F.col("_good"), "accepted").otherwise("rejected")
    decided = written(known.withColumn("outcome", outcome).drop("_of", "_end", "_taken", "_errors"), "collection-decided")
    total = counts_before(decided, order, {"_all": (F.col("outcome") == "accepted").cast("long")})
    return total.withColumn("outcome", F.when(F.col("_all") >= most, "not_reached").otherwise(F.col("outcome"))).select(*rows.drop("outcome").columns, "outcome")
