"""Document fingerprints: bottom-k sketches of word-shingle hashes, in Spark functions only.

A sketch is the sorted array of the k smallest distinct 64-bit hashes of a text's word
shingles (five words; fewer words: the whole sequence; none: an empty sketch).  The
bottom k of a union follows from the bottom k of its parts, so sketches merge, and a
merged sketch estimates resemblance, containment and the number of distinct shingles.

Cases: null is an empty text; two empty sketches have resemblance 1, an empty and another
one 0; equal texts have equal sketches; extra columns are kept, clashing ones replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lamplight.llm.common import written

K = 128
WIDTH = 5


def with_sketch(df: DataFrame, text: Column, name: str, k: int = K, width: int = WIDTH) -> DataFrame:
    """df with a column of the bottom-k sketch of text.

    The word hashes are a column of their own, which the shingle lambda reads by index:
    strings are hashed once a word, not once a shingle.
    """
    words = f"_{name}_words"
    split = F.array_remove(F.split(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+"), "")
    n = F.size(words)
    shingle = lambda i: F.xxhash64(*[F.get(F.col(words), i + j) for j in range(width)])
    hashes = (
        F.when(n >= width, F.transform(F.sequence(F.lit(0), n - width), shingle))
        .when(n > 0, F.array(F.xxhash64(F.col(words))))
        .otherwise(F.array().cast("array<bigint>"))
    )
    hashed = df.withColumn(words, F.transform(split, lambda w: F.xxhash64(w)))
    return hashed.withColumn(name, F.slice(F.sort_array(F.array_distinct(hashes)), 1, k)).drop(words)


def merged(a: Column, b: Column, k: int = K) -> Column:
    """The sketch of the union of two parts."""
    return F.slice(F.sort_array(F.array_union(a, b)), 1, k)


def resemblance(a: Column, b: Column, k: int = K) -> Column:
    """Estimated share of common shingles among all of both, 0 to 1."""
    both = merged(a, b, k)
    shared = F.size(F.array_intersect(both, F.array_intersect(a, b)))
    return F.when(F.size(both) == 0, 1.0).otherwise(shared / F.size(both))


def distinct_count(a: Column, k: int = K) -> Column:
    """Estimated number of distinct shingles: exact below k, else (k - 1) over the k-th smallest hash's place in the hash range."""
    kth = (F.element_at(a, -1).cast("double") + 2.0**63) / 2.0**64
    return F.when(F.size(a) < k, F.size(a).cast("double")).otherwise((k - 1) / kth)


def containment(a: Column, b: Column, k: int = K) -> Column:
    """Estimated share of a's shingles that b has: the common ones by resemblance times the union's count."""
    common = resemblance(a, b, k) * distinct_count(merged(a, b, k), k)
    return F.when(F.size(a) == 0, 1.0).otherwise(F.least(F.lit(1.0), common / distinct_count(a, k)))


def hex_form(a: Column) -> Column:
    """A sketch as text: sixteen hexadecimal digits for each hash."""
    return F.lower(F.array_join(F.transform(a, lambda h: F.lpad(F.hex(h), 16, "0")), ""))


def merge_groups(sketches: DataFrame, key: str, sketch_col: str, k: int = K, salts: int = 64) -> DataFrame:
    """(key, sketch) of all sketches of each key.

    Hashes are made distinct with map-side combining, then the k smallest are taken per
    (key, salt) and of these per key, so that a hot key is spread over the salts.
    """
    hashes = sketches.select(F.col(key), F.explode(sketch_col).alias("_h")).distinct()
    salted = hashes.withColumn("_salt", F.pmod(F.xxhash64("_h"), F.lit(salts)))
    some = salted.withColumn("_n", F.row_number().over(Window.partitionBy(key, "_salt").orderBy("_h"))).where(F.col("_n") <= k)
    few = some.withColumn("_n", F.row_number().over(Window.partitionBy(key).orderBy("_h"))).where(F.col("_n") <= k)
    return few.groupBy(key).agg(F.sort_array(F.collect_list("_h")).alias(sketch_col))


def next_links(docs: DataFrame, id_col: str) -> DataFrame:
    """For each document (_i, _h: hashes of id and text) the one before it in descending order of id, and its length.

    The last document's next is the first.  Only ids and hashes are ordered: by range over
    the partitions, within each by a window, and between them by one row per partition.
    """
    order = [F.col(id_col).desc_nulls_last(), F.col("_h")]
    ids = docs.select(id_col, "_i", "_h", "_n").distinct().repartitionByRange(*order).withColumn("_part", F.spark_partition_id())
    ids = written(ids, "sketch-order")
    this, window = F.struct("_i", "_h", "_n"), Window.partitionBy("_part").orderBy(*order)
    placed = ids.withColumn("_before", F.lag(this).over(window)).withColumn("_row", F.row_number().over(Window.partitionBy("_part").orderBy(F.col(id_col).asc_nulls_first(), F.col("_h").desc())))
    tails = placed.where("_row = 1").select("_part", this.alias("_tail"))
    across = Window.orderBy("_part")
    every = across.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    tails = tails.select("_part", F.coalesce(F.lag("_tail").over(across), F.last("_tail").over(every)).alias("_then"))
    linked = placed.join(tails, "_part").withColumn("_before", F.coalesce("_before", "_then"))
    return written(linked.select("_i", "_h", F.col("_before._i").alias("_for_i"), F.col("_before._h").alias("_for_h"), F.floor(F.col("_before._n") / 3).cast("int").alias("_take")), "sketch-links")


def fingerprint_edits(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = K) -> DataFrame:
    """Fingerprints of whole texts, of their edited texts, and their likeness to these and to the next document.

    The edited text has the last third replaced by the start of the next document.  A
    document sends its start and its sketch to the one before it; ids that occur in
    several rows are told apart by their texts, and equal rows have equal results.

    Both uses of the texts read the same columns by the same keys, so Spark shuffles them
    once and reuses the exchange.
    """
    rows = docs.select(F.col(id_col), F.coalesce(F.col(text_col), F.lit("")).alias("_text"))
    rows = rows.withColumns({"_i": F.xxhash64(id_col), "_h": F.xxhash64("_text"), "_n": F.length("_text").cast("long")})
    texts = rows.select(id_col, "_i", "_h", "_n", "_text")
    starts = texts.join(next_links(rows, id_col), ["_i", "_h"])
    starts = with_sketch(starts.select(id_col, "_for_i", "_for_h", F.least("_take", "_n").cast("int").alias("_take"), "_text"), F.col("_text"), "_next_sketch", k)
    starts = starts.select(F.col("_for_i").alias("_i"), F.col("_for_h").alias("_h"), F.col(id_col).alias("_next_id"), F.substring(F.col("_text"), F.lit(1), F.col("_take")).alias("_start"), "_next_sketch")
    starts = starts.groupBy("_i", "_h").agg(F.first("_start").alias("_start"), F.first("_next_sketch").alias("_next_sketch"), F.first("_next_id").alias("next_id"))
    own = texts.join(starts, ["_i", "_h"])
    kept = F.substring(F.col("_text"), F.lit(1), (F.col("_n") - F.floor(F.col("_n") / 3)).cast("int"))
    own = own.select(id_col, F.col("_n").alias("n_chars"), "_text", F.concat(kept, F.col("_start")).alias("_edited"), "_next_sketch", "next_id")
    own = with_sketch(with_sketch(own, F.col("_text"), "_sketch", k), F.col("_edited"), "_edited_sketch", k)
    return own.select(
        id_col,
        "n_chars",
        F.sha2(F.col("_edited"), 256).alias("edited_sha256"),
        hex_form(F.col("_sketch")).alias("fingerprint"),
        hex_form(F.col("_edited_sketch")).alias("edited_fingerprint"),
        resemblance(F.col("_sketch"), F.col("_edited_sketch"), k).alias("near_edited"),
        resemblance(F.col("_sketch"), F.col("_next_sketch"), k).alias("near_next"),
        "next_id",
    )
