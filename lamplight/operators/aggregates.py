"""Corpus-wide reports: corroboration, balance, gates, audits, coverage.

All are one or two aggregations with map-side combining; shares and thresholds are computed
on the few rows that remain.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lamplight.functions import text as X


def corroboration(facts: DataFrame) -> DataFrame:
    """A row per (subject, predicate, place): conflict where values differ, corroborated by two publisher families, else single_source.

    facts: subject, predicate, place, normalized_value, publisher_family.  Families count
    over all values, also in a conflict.
    """
    keys = [F.trim(F.col(k)).alias(k) for k in ("subject", "predicate", "place")]
    values = facts.groupBy(*keys, "normalized_value").agg(F.collect_set("publisher_family").alias("families"))
    grouped = values.groupBy("subject", "predicate", "place").agg(
        F.count("*").alias("n_values"),
        F.sort_array(F.array_distinct(F.flatten(F.collect_list("families")))).alias("supporting_sources"),
        F.sort_array(F.collect_list(F.struct(F.col("normalized_value").alias("value"), F.sort_array("families").alias("supporting_sources")))).alias("_all"),
    )
    conflict = F.col("n_values") > 1
    enough = F.size("supporting_sources") >= 2
    return grouped.select(
        "subject",
        "predicate",
        "place",
        F.when(conflict, "conflict").when(enough, "corroborated").otherwise("single_source").alias("status"),
        (~conflict & enough).alias("corroborated"),
        conflict.alias("fact_conflict"),
        F.when(conflict, F.col("_all")).otherwise(F.slice("_all", 1, 0)).alias("conflicting_values"),
        "supporting_sources",
    )


def distribution(rows: DataFrame, value: Column, name: str = "value") -> DataFrame:
    return rows.groupBy(value.alias(name)).agg(F.count("*").alias("n"))


def balance(rows: DataFrame) -> DataFrame:
    """(kind, value, n, share) of publishers and topics among rows that are no confirmed duplicates.

    rows: publisher_family, publisher, topics, duplicate_status.  A topic counts once per row.
    """
    own = rows.where(F.coalesce("duplicate_status", F.lit("")) != "confirmed")
    publisher = F.coalesce(F.nullif("publisher_family", F.lit("")), F.nullif("publisher", F.lit("")), F.lit("unknown"))
    tagged = own.select(F.explode(F.concat(F.array(F.struct(F.lit("publisher").alias("kind"), publisher.alias("value"))), F.transform(F.array_distinct("topics"), lambda t: F.struct(F.lit("topic").alias("kind"), t.alias("value"))))).alias("x"))
    counts = tagged.groupBy("x.kind", "x.value").agg(F.count("*").alias("n"))
    total = own.agg(F.count("*").alias("_all"))
    return counts.crossJoin(F.broadcast(total)).select("kind", "value", "n", F.round(F.col("n") / F.greatest("_all", F.lit(1)), 4).alias("share"))


#: Documents a phase must have, and its limits.
PHASE_TARGETS = {"A": 30, "B": 100, "C": 300, "D": 1000}
GATE = {"extraction_success_rate": 0.85, "rights_known_rate": 0.60, "relevance_rate": 0.80, "duplicate_rate": 0.20, "noise_rate": 0.20, "publisher_share": 0.40, "topic_share": 0.45}


def phase_gate(rows: DataFrame, target: int, limits: dict[str, float] = GATE) -> DataFrame:
    """One row: counts, rates and the reasons to stop, PASS without any.

    rows: duplicate_status, extraction_status, rights_status, relevance, noise,
    review_status, publisher_family, publisher, topics.
    """
    unique = F.coalesce("duplicate_status", F.lit("")) != "confirmed"
    n = lambda test: F.count_if(F.coalesce(test, F.lit(False)))
    counts = rows.agg(
        F.count("*").alias("fetched"),
        n(unique).alias("unique_candidates"),
        n(F.col("extraction_status") == "success").alias("_ok"),
        n(unique & ~F.coalesce("rights_status", F.lit("")).isin("", "unknown", "unconfirmed")).alias("_known"),
        n(unique & (F.col("relevance") > 0)).alias("_relevant"),
        n(F.col("noise")).alias("_noise"),
        *[n(unique & (F.col("review_status") == s)).alias(s) for s in ("auto_candidate", "needs_human_review", "auto_rejected")],
    )
    shares = balance(rows).agg(F.coalesce(F.max(F.when(F.col("kind") == "publisher", F.col("share"))), F.lit(0.0)).alias("publisher_share"), F.coalesce(F.max(F.when(F.col("kind") == "topic", F.col("share"))), F.lit(0.0)).alias("topic_share"))
    some, own = F.greatest("fetched", F.lit(1)), F.greatest("unique_candidates", F.lit(1))
    rates = counts.crossJoin(F.broadcast(shares)).withColumns(
        {
            "duplicate_count": F.col("fetched") - F.col("unique_candidates"),
            "extraction_success_rate": F.round(F.col("_ok") / some, 4),
            "rights_known_rate": F.round(F.col("_known") / own, 4),
            "relevance_rate": F.round(F.col("_relevant") / own, 4),
            "duplicate_rate": F.round((F.col("fetched") - F.col("unique_candidates")) / some, 4),
            "noise_rate": F.round(F.col("_noise") / some, 4),
        }
    )
    low = [(F.col(k) < limits[k], k) for k in ("extraction_success_rate", "rights_known_rate", "relevance_rate")]
    high = [(F.col(k) > limits[k], k) for k in ("duplicate_rate", "noise_rate", "publisher_share", "topic_share")]
    out = rates.withColumn("stop_reasons", X.reasons((F.col("unique_candidates") < target, "target_unique_not_met"), *low, *high))
    return out.withColumn("gate_status", F.when(F.size("stop_reasons") > 0, "STOP").otherwise("PASS")).drop("_ok", "_known", "_relevant", "_noise")


def rejection_histogram(rows: DataFrame) -> DataFrame:
    return rows.select(F.explode("rejection_reasons").alias("reason")).groupBy("reason").agg(F.count("*").alias("n"))


def missing_counts(rows: DataFrame, fields: dict[str, Sequence[str]]) -> DataFrame:
    """(field, n_missing): rows in which no alias of the field has a value; 0 and false are values."""
    filled = lambda a: F.col(a).isNotNull() & (F.col(a).cast("string") != "") & (F.col(a).cast("string") != "[]")

    def gone(aliases: Sequence[str]) -> Column:
        test = F.lit(True)
        for a in aliases:
            test = test & ~filled(a)
        return test

    one = rows.agg(*[F.count_if(gone(aliases)).alias(f) for f, aliases in fields.items()])
    return one.select(F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).alias("n_missing")) for f in fields])).alias("x")).select("x.*")


def duplicate_groups(rows: DataFrame, key: Column, id_col: str) -> DataFrame:
    """(value, n, least_id, greatest_id) of keys that several rows share.

    Members of a group are found by joining the value back; a list of them is not kept,
    since a group may hold a large part of the table.
    """
    keyed = rows.select(key.alias("value"), id_col).where((F.col("value").isNotNull()) & (F.col("value") != ""))
    return keyed.groupBy("value").agg(F.count("*").alias("n"), F.min(id_col).alias("least_id"), F.max(id_col).alias("greatest_id")).where("n > 1")


def zero_filled(rows: DataFrame, value: Column, categories: Sequence[str]) -> DataFrame:
    """(category, n) for all categories and whatever else occurs."""
    counts = rows.groupBy(value.alias("category")).agg(F.count("*").alias("n"))
    listed = rows.sparkSession.createDataFrame([(x,) for x in categories], "category string")
    return counts.unionByName(listed.select("category", F.lit(0).cast("long").alias("n"))).groupBy("category").agg(F.sum("n").alias("n"))


def topic_coverage(docs: DataFrame, topics: dict[str, Sequence[str]], id_col: str = "doc_id") -> DataFrame:
    """Per topic: documents, institutions, the largest institution's share, and how many more documents are wanted.

    docs: id, title, text, institution, cleared (rights known).
    """
    title, body = F.lower(F.coalesce("title", F.lit(""))), F.lower(F.coalesce("text", F.lit("")))
    hits = F.array(*[F.struct(F.lit(t).alias("topic"), X.any_of(title, [w.lower() for w in ws]).alias("meta"), X.any_of(body, [w.lower() for w in ws]).alias("body")) for t, ws in topics.items()])
    matched = docs.select("institution", "cleared", F.explode(F.filter(hits, lambda h: h["meta"] | h["body"])).alias("h"))
    by_house = matched.groupBy("h.topic", F.coalesce(F.nullif("institution", F.lit("")), F.lit("(missing)")).alias("house")).agg(F.count("*").alias("n"), F.count_if("cleared").alias("ok"), F.count_if(F.col("h.meta") & F.col("h.body")).alias("high"))
    found = by_house.groupBy("topic").agg(F.sum("n").alias("documents"), F.count_if(F.col("house") != "(missing)").alias("institutions"), F.max("n").alias("dominant"), F.sum("ok").alias("cleared"), F.sum("high").alias("high_confidence"))
    named = docs.sparkSession.createDataFrame([(t,) for t in topics], "topic string")
    all_ = named.join(F.broadcast(found), "topic", "left").na.fill(0)
    base = F.greatest(F.lit(0), F.when(F.col("documents") < 5, 5).otherwise(10) - F.col("documents"))
    wanted = F.when(F.col("institutions") < 2, F.greatest(F.lit(5), base)).otherwise(base)
    wanted = F.when((F.col("documents") > 0) & (F.col("cleared") == 0), F.greatest(F.lit(3), wanted)).otherwise(wanted)
    wanted = F.when((F.col("documents") > 0) & (F.col("dominant") / F.col("documents") > 0.75), F.greatest(F.lit(3), wanted)).otherwise(wanted)
    return all_.withColumn("recommended", wanted.cast("long"))


def vector_integrity(vectors: DataFrame, dimension: int) -> DataFrame:
    """One row of counts: vectors, wrong dimensions, not finite, zero norms, ids that occur again."""
    bad = F.exists("vector", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    zero = F.forall("vector", lambda x: x == 0)
    counts = vectors.agg(F.count("*").alias("vectors"), F.count_if(F.size("vector") != dimension).alias("wrong_dimension"), F.count_if(bad).alias("not_finite"), F.count_if(zero).alias("zero_norm"))
    again = vectors.groupBy("chunk_id").agg(F.count("*").alias("n")).agg(F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("repeated_ids"))
    return counts.crossJoin(F.broadcast(again))
