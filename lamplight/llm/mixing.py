"""Mixing sources to target weights by Pareto order sampling.

Every source gets a target number of words.  A document of a source whose target
is r times its size is taken floor(r) times for certain; the rest is a sample
without replacement in Pareto order: documents are ranked by

    (u / (1 - u)) / (p / (1 - p)),

the odds of a uniform number u over the odds of the wanted inclusion p, and taken
from the lowest rank until the source's words are used up.  u is a hash of the
row, so that reruns agree.

Nothing here orders a whole source in one task.  Ranks are cut into bins, the
words of each (source, bin) are summed with map-side combining, and only the one
bin per source in which the target is crossed is ordered row by row.

Cases: a null text has size 0; documents of size 0 are never taken; a null
source is a source of its own, after all others; a source without words has
target 0; identical rows draw the same number and are interchangeable; an empty
table gives an empty result.  Input columns other than the ones named are kept,
and names that clash with results are replaced by the results.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lamplight.llm.common import written

#: A word is a run of characters other than ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
BINS = 1 << 16
STEP = 1 << 8
#: The per-source table (a few numbers a row) is broadcast up to this many sources, else joined by shuffle.
BROADCAST_SOURCES = 100_000
RESULTS = ("size", "source_size", "target", "taken", "copies")


def word_count(text: Column) -> Column:
    """Number of words; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def uniform(*parts: Column, seed: int = 0) -> Column:
    """A number in (0, 1) from an md5 of the parts: 13 hexadecimal digits, so exact in a double."""
    text = F.concat_ws("|", F.lit(str(seed)), *[F.coalesce(p.cast("string"), F.lit("")) for p in parts])
    return (F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("double") + 0.5) / F.lit(float(1 << 52))


def source_targets(sizes: DataFrame, weights: tuple[float, ...], cap: float) -> DataFrame:
    """Targets of sources: they share the total size by weight, at most cap times each source's own size.

    sizes: a row (source, source_size) per source.  Weights repeat over the sources
    in code point order, null last.  Sources in order of cap-to-weight ratio fill
    first; what they leave is shared by weight, which is where sharing the excess
    again and again ends.  The windows run over one row per source, not over documents.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    place = (F.row_number().over(order) - 1) % len(weights)
    listed = sizes.select(
        "source",
        "source_size",
        F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (place + 1).cast("int")).alias("weight"),
        (F.col("source_size") * F.lit(float(cap))).alias("most"),
    )
    filling = Window.orderBy(F.col("most") / F.col("weight"), F.col("source").asc_nulls_last())
    before = filling.rowsBetween(Window.unboundedPreceding, -1)
    after = filling.rowsBetween(0, Window.unboundedFollowing)
    everything = Window.partitionBy()
    level = (F.sum("source_size").over(everything) - F.coalesce(F.sum("most").over(before), F.lit(0.0))) / F.sum("weight").over(after)
    # The level of the first source that isn't full holds for all after it; from there on levels only fall.
    final = F.max(F.when(F.col("most") >= F.col("level") * F.col("weight"), F.col("level"))).over(everything)
    return listed.withColumn("level", level).select(
        "source", "source_size", F.least(F.col("most"), F.coalesce(final * F.col("weight"), F.col("most"))).alias("target")
    )


def mix(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    weights: tuple[float, ...] = (1.0, 2.0, 3.0),
    cap: int = 3,
    seed: int = 0,
    importance: Column | None = None,
) -> DataFrame:
    """docs with size, source_size, target, copies (whole times a row is taken) and taken (copies * size).

    importance: a positive column of docs that multiplies a row's inclusion odds, for samples
    that favour some rows; without it all rows of a source have the same.
    Each source's taken words end within half a document of its target.
    """
    kept = docs.drop(*RESULTS)
    spark = docs.sparkSession

    def drawn(df: DataFrame) -> DataFrame:
        u = uniform(F.col(id_col), F.col(source_col), seed=seed)
        weigh = importance if importance is not None else F.lit(1.0)
        return df.withColumns({"size": word_count(F.col(text_col)), "_odds": u / (1 - u) / weigh})

    # Texts are read here only for their sizes; all ordering works on this slim table.
    slim = written(drawn(kept).select(F.col(id_col).alias("_id"), F.col(source_col).alias("_source"), "size", "_odds"), "mix-sizes")
    sizes = slim.groupBy(F.col("_source").alias("source")).agg(F.sum("size").alias("source_size"))
    whole = F.floor("_r")
    targets = written(
        source_targets(sizes, weights, cap)
        .withColumn("_r", F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0))
        .select("source", "source_size", "target", whole.alias("_whole"), (F.col("_r") - whole).alias("_p"), (F.col("target") - whole * F.col("source_size")).alias("_want")),
        "mix-targets",
    )
    few = targets.count() <= BROADCAST_SOURCES

    def with_source(df: DataFrame, per_source: DataFrame, on: str) -> DataFrame:
        side = F.broadcast(per_source) if few else per_source
        return df.join(side.withColumnRenamed("source", "_s"), F.col(on).eqNullSafe(F.col("_s")), "left").drop("_s")

    def ranked(df: DataFrame) -> DataFrame:
        q = F.col("_odds") * (1 - F.col("_p")) / F.when(F.col("_p") > 0, F.col("_p"))
        df = df.withColumn("_rank", q / (1 + q))
        return df.withColumn("_bin", F.least(F.floor(F.col("_rank") * BINS), F.lit(BINS - 1)))

    keyed = ranked(with_source(slim, targets, "_source")).where("_want > 0 and size > 0")
    # Two levels of bins, so that no window has more than STEP rows of a source.
    coarse = crossing(keyed.withColumn("_step", F.floor(F.col("_bin") / STEP)), "_step", F.lit(0).cast("long"))
    inside = with_source(keyed, coarse.withColumnRenamed("_sum_before", "_sum_from"), "_source").where(F.floor(F.col("_bin") / STEP) == F.col("_at"))
    crossed = crossing(inside, "_bin", F.col("_sum_from")).withColumnsRenamed({"_at": "_cross", "_sum_before": "_before"})
    edge = with_source(keyed, crossed, "_source").where("_bin = _cross")
    run = Window.partitionBy("_source").orderBy("_rank", "_id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    # Taken while at least half of the row lies below the wanted words.
    below = F.col("_before") + F.sum("size").over(run) - F.col("size") / 2 <= F.col("_want")
    last = edge.withColumn("_below", below).groupBy(F.col("_source").alias("source")).agg(F.first("_cross").alias("_cross"), F.max(F.when(F.col("_below"), F.struct("_rank", "_id"))).alias("_last"))
    bounds = written(targets.join(last, targets["source"].eqNullSafe(last["source"]), "left").drop(last["source"]), "mix-bounds")

    out = ranked(with_source(drawn(kept), bounds, source_col))
    extra = (F.col("_bin") < F.col("_cross")) | ((F.col("_bin") == F.col("_cross")) & (F.struct(F.col("_rank"), F.col(id_col).alias("_id")) <= F.col("_last")))
    copies = F.when(F.col("size") > 0, F.least(F.col("_whole") + F.coalesce(extra, F.lit(False)).cast("long"), F.lit(cap))).otherwise(0).cast("long")
    return out.withColumn("copies", copies).select(*kept.columns, "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"), "copies")


def crossing(rows: DataFrame, bin_col: str, start: Column) -> DataFrame:
    """(source, _at, _sum_before): the bin in which a source's words reach the wanted ones, and the words before it."""
    per_bin = rows.groupBy("_source", bin_col).agg(F.sum("size").alias("_in"), F.first("_want").alias("_w"), F.first(start).alias("_start"))
    up_to = Window.partitionBy("_source").orderBy(bin_col).rowsBetween(Window.unboundedPreceding, -1)
    summed = per_bin.withColumn("_sum_before", F.col("_start") + F.coalesce(F.sum("_in").over(up_to), F.lit(0)))
    found = summed.where("_sum_before <= _w and _sum_before + _in > _w")
    return found.select(F.col("_source").alias("source"), F.col(bin_col).alias("_at"), "_sum_before")


def replicated(mixed: DataFrame) -> DataFrame:
    """The rows of mix() as many times as they are taken."""
    return mixed.where("copies > 0").withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("copies")))).drop("_copy")


#: DuckDB SQL for the result of op1: one order per source instead of bins.
ORACLE = r"""
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
         (('0x' || substr(md5('0|' || coalesce(doc_id::VARCHAR, '') || '|' || coalesce(source, '')), 1, 13))::BIGINT::DOUBLE + 0.5) / 4503599627370496.0 AS u
  FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
l AS (SELECT source, source_size, ((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::DOUBLE AS weight, source_size * 3.0 AS most FROM s),
v AS (SELECT *, (sum(source_size) OVER () - coalesce(sum(most) OVER (ORDER BY most / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0))
             / sum(weight) OVER (ORDER BY most / weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM l),
t AS (SELECT source, source_size, least(most, coalesce(max(CASE WHEN most >= level * weight THEN level END) OVER () * weight, most)) AS target FROM v),
r AS (SELECT *, CASE WHEN source_size > 0 THEN target / source_size ELSE 0.0 END AS ratio FROM t),
w AS (SELECT *, floor(ratio) AS whole, target - floor(ratio) * source_size AS want FROM r),
k AS (SELECT d.doc_id, d.source, d.size, w.source_size, w.target, w.whole, w.want,
             (u / (1 - u)) * (1 - (ratio - whole)) / CASE WHEN ratio - whole > 0 THEN ratio - whole END AS q
      FROM d JOIN w ON d.source IS NOT DISTINCT FROM w.source),
o AS (SELECT *, sum(size) OVER (PARTITION BY source ORDER BY q / (1 + q), doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS run FROM k)
SELECT doc_id, size, source_size, target,
       (CASE WHEN size > 0 THEN least(whole + CASE WHEN want > 0 AND run - size / 2.0 <= want THEN 1 ELSE 0 END, 3) ELSE 0 END * size)::BIGINT AS taken
FROM o
"""
