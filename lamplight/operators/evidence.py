"""From search results to evidence: support, facts, citations, sufficiency, answers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lamplight.functions import text as X


def sentence_rows(results: DataFrame) -> DataFrame:
    """A row per sentence of each result: query_id, chunk_id, rank, pos, sentence."""
    return results.select("query_id", "chunk_id", "rank", F.posexplode(X.sentences(F.col("text"))).alias("pos", "sentence"))


def direct_support(results: DataFrame, queries: DataFrame) -> DataFrame:
    """(query_id, support, direct, local): DIRECT where a sentence has subject and intent, PARTIAL where they are neighbours.

    results: query_id, chunk_id, rank, text; queries: query_id, subject, intent (a pattern).
    """
    squeeze = lambda x: F.regexp_replace(x, X.SPACE, "")
    rows = sentence_rows(results).join(queries.select("query_id", "subject", "intent"), "query_id")
    rows = rows.withColumns({"s": F.contains(squeeze(F.col("sentence")), squeeze(F.col("subject"))), "i": F.regexp_like("sentence", "intent")})
    beside = Window.partitionBy("query_id", "chunk_id").orderBy("pos")
    near = F.coalesce(F.lag("s").over(beside), F.lit(False)) | F.coalesce(F.lead("s").over(beside), F.lit(False))
    rows = rows.withColumns({"direct": F.col("s") & F.col("i"), "local": F.col("i") & ~F.col("s") & near})
    found = rows.groupBy("query_id").agg(F.count_if("direct").alias("direct"), F.count_if("local").alias("local"), F.bool_or("s").alias("_subject"))
    support = F.when(F.col("direct") > 0, "DIRECT").when(F.col("local") > 0, "PARTIAL").when(F.col("_subject"), "RELATED_ONLY").otherwise("NONE")
    every = queries.select("query_id").join(found.select("query_id", support.alias("support"), "direct", "local"), "query_id", "left")
    return every.select("query_id", F.coalesce("support", F.lit("NONE")).alias("support"), F.coalesce("direct", F.lit(0)).alias("direct"), F.coalesce("local", F.lit(0)).alias("local"))


def usable_sentence(sentence: Column, markers: str = "") -> Column:
    """12 to 700 characters, brackets and quotes paired, no metadata marker."""
    n = lambda ch: F.length(sentence) - F.length(F.replace(sentence, F.lit(ch), F.lit("")))
    good = F.length(sentence).between(12, 700) & (n("(") == n(")")) & (n("[") == n("]")) & (n("“") == n("”")) & (n('"') % 2 == 0)
    return good & ~sentence.rlike(markers) if markers else good


def fact_packet(results: DataFrame, queries: DataFrame, keep: int = 2) -> DataFrame:
    """The best usable sentences of each query: those with more of its words first, then by rank and place.

    queries: query_id, words.
    """
    rows = sentence_rows(results).where(usable_sentence(F.col("sentence"))).join(queries.select("query_id", "words"), "query_id")
    hits = F.size(F.array_intersect(X.keyword_tokens(F.col("sentence")), "words"))
    scored = rows.withColumn("hits", hits).where("hits > 0")
    order = Window.partitionBy("query_id").orderBy(F.col("hits").desc(), "rank", "pos", "chunk_id")
    return scored.withColumn("place", F.row_number().over(order)).where(F.col("place") <= keep).select("query_id", "place", "chunk_id", "sentence", "hits")


def time_conflicts(facts: DataFrame) -> DataFrame:
    """(subject, predicate, dates) with more than one date."""
    return facts.groupBy("subject", "predicate").agg(F.sort_array(F.collect_set("date")).alias("dates")).where(F.size("dates") > 1)


def citations(results: DataFrame) -> DataFrame:
    """One citation per query and document: its first chunk, 160 characters of it, the score to six digits."""
    first = Window.partitionBy("query_id", "document_id").orderBy("rank")
    rows = results.withColumn("_n", F.row_number().over(first)).where("_n = 1")
    return rows.select("query_id", "document_id", "chunk_id", "rank", F.left("text", F.lit(160)).alias("excerpt"), F.round("score", 6).alias("retrieval_score"))


def sufficiency(results: DataFrame, support: DataFrame) -> DataFrame:
    """(query_id, sufficiency) from what was found, conflicts in it, and its support."""
    found = results.groupBy("query_id").agg(F.bool_or(F.coalesce("conflict", F.lit(False))).alias("_conflict"))
    rows = support.select("query_id", "support").join(found, "query_id", "left")
    state = F.when(F.col("_conflict").isNull(), "insufficient").when(F.col("_conflict"), "conflicting").when(F.col("support") != "DIRECT", "partial").otherwise("sufficient")
    return rows.select("query_id", state.alias("sufficiency"))


def keep_matching_if_any(rows: DataFrame, test: Column, by: str = "query_id") -> DataFrame:
    """Of each query the rows that match, or all where none does."""
    any_ = F.max(F.coalesce(test, F.lit(False)).cast("int")).over(Window.partitionBy(by))
    return rows.withColumn("_any", any_).where((F.col("_any") == 0) | F.coalesce(test, F.lit(False))).drop("_any")


def remembered_first(retrieved: DataFrame, remembered: DataFrame) -> DataFrame:
    """The newest remembered row, the retrieved ones, the other remembered ones; the first of each chunk."""
    a = remembered.select("query_id", "chunk_id", F.when(F.col("rank") == 1, 0).otherwise(2).alias("_part"), "rank")
    b = retrieved.select("query_id", "chunk_id", F.lit(1).alias("_part"), "rank")
    rows = a.unionByName(b)
    first = rows.groupBy("query_id", "chunk_id").agg(F.min(F.struct("_part", "rank")).alias("o"))
    return first.select("query_id", "chunk_id", F.row_number().over(Window.partitionBy("query_id").orderBy("o._part", "o.rank", "chunk_id")).alias("rank"))


def budget(required: Column, recent: Column, evidence: Column, older: Column, available: Column) -> Column:
    """What fits: the newest turn, then evidence in order, then older turns from the newest, each skipped if it is too large.

    Sizes are half the characters, rounded up.  Arrays of texts in, a struct of kept texts
    and the size used out.
    """
    size = lambda t: F.ceil(F.length(t) / 2).cast("int")

    def fold(items: Column, used: Column) -> Column:
        start = F.struct(used.cast("int").alias("used"), F.array().cast("array<string>").alias("kept"))
        fits = lambda a, t: a["used"] + size(t) <= available
        step = lambda a, t: F.struct(F.when(fits(a, t), a["used"] + size(t)).otherwise(a["used"]).alias("used"), F.when(fits(a, t), F.concat(a["kept"], F.array(t))).otherwise(a["kept"]).alias("kept"))
        return F.aggregate(items, start, step)

    first = fold(recent, required)
    second = fold(evidence, first["used"])
    third = fold(F.reverse(older), second["used"])
    return F.struct(second["kept"].alias("evidence"), F.concat(F.reverse(third["kept"]), first["kept"]).alias("conversation"), third["used"].alias("used"))


def extractive_answer(facts: Column, most: int = 2) -> Column:
    return F.array_join(F.slice(facts, 1, most), " ")
