"""Evaluation of retrieval and conversations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lamplight.functions import text as X


def retrieval_metrics(cases: DataFrame, results: DataFrame, latencies: DataFrame | None = None) -> DataFrame:
    """One row of recall at 1, 3 and 5, reciprocal rank over all results, refusals, counts.

    cases: case_id, expected (array of chunk ids), should_answer, should_refuse, topic;
    results: case_id, chunk_id, rank.  Recall looks at the first five results only.
    """
    wanted = cases.select("case_id", F.explode("expected").alias("chunk_id")).distinct()
    hits = results.join(wanted, ["case_id", "chunk_id"]).groupBy("case_id").agg(F.min("rank").alias("first"))
    any_ = results.groupBy("case_id").agg(F.count("*").alias("returned"))
    rows = cases.join(hits, "case_id", "left").join(any_, "case_id", "left").na.fill(0, ["returned"])
    answer, refuse = F.col("should_answer"), F.col("should_refuse")
    share = lambda test, among: F.round(F.coalesce(F.count_if(among & F.coalesce(test, F.lit(False))) / F.nullif(F.count_if(among), F.lit(0)), F.lit(0.0)), 4)
    mrr = F.coalesce(F.sum(F.when(answer, F.coalesce(1 / F.col("first"), F.lit(0.0)))) / F.nullif(F.count_if(answer), F.lit(0)), F.lit(0.0))
    out = rows.agg(
        *[share(F.col("first") <= k, answer).alias(f"recall_at_{k}") for k in (1, 3, 5)],
        F.round(mrr, 4).alias("mrr"),
        share(F.col("returned") == 0, refuse).alias("no_evidence_precision"),
        F.count_if(answer).alias("answerable_cases"),
        F.count_if(refuse).alias("refusal_cases"),
    )
    return out.crossJoin(F.broadcast(latency_summary(latencies))) if latencies is not None else out


def nearest_rank(value: Column, share: float = 0.95) -> Column:
    """The value at the rounded-up share of the sorted values; 0 without any."""
    return F.coalesce(F.expr(f"percentile_disc({share}) WITHIN GROUP (ORDER BY {value._jc.toString()})"), F.lit(0.0))


def latency_summary(latencies: DataFrame) -> DataFrame:
    """Mean and 95th percentile by nearest rank of latency_ms."""
    return latencies.agg(F.round(F.avg("latency_ms"), 3).alias("average_latency_ms"), F.round(nearest_rank(F.col("latency_ms")), 3).alias("p95_latency_ms"))


def split_leaks(rows: DataFrame, keys: list[str], split: str = "split") -> DataFrame:
    """(kind, key, splits): scenario, topic and document ids that occur in more than one split."""
    long = rows.select(F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), F.col(k).cast("string").alias("key")) for k in keys])).alias("x"), split)
    # minimum and maximum combine on the map side; equal ones mean a single split
    found = long.groupBy("x.kind", "x.key").agg(F.min(split).alias("first_split"), F.max(split).alias("last_split"))
    return found.where("first_split <> last_split")


def answer_checks(turns: DataFrame) -> DataFrame:
    """(conv_id, turn, complete, repeated, short) of assistant turns."""
    return turns.where("role = 'assistant'").select("conv_id", "turn", X.is_complete(F.col("text")).alias("complete"), X.repeated_sentences(F.col("text")).alias("repeated"))


def conversation_metrics(turns: DataFrame) -> DataFrame:
    """One row: assistant turns, complete ones, those with repeats, answers given again beyond the first."""
    checks = answer_checks(turns).agg(F.count("*").alias("turns"), F.count_if("complete").alias("complete"), F.count_if(F.col("repeated") > 0).alias("with_repeats"))
    again = turns.where("role = 'assistant'").groupBy(F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("h")).agg(F.count("*").alias("n")).agg(F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("answers_given_again"))
    return checks.crossJoin(F.broadcast(again))


def scenario_errors(required: list[str], answerability: Column) -> Column:
    """What is wrong with a scenario turn."""
    kinds = ("answerable", "partially_answerable", "unanswerable", "out_of_scope")
    return X.reasons(*[(X.blank(F.col(f)), f"missing:{f}") for f in required], (~F.coalesce(answerability.isin(*kinds), F.lit(False)), "answerability"), (F.col("training_eligible"), "training_eligible"))


def retrieval_breakdown(cases: DataFrame, results: DataFrame) -> DataFrame:
    """(part, name, ...): recall of chunks and of sources at 1, 3 and 5 and the share of refusals, of all cases, by locale and by topic.

    cases: case_id, locale, topic, expected and expected_sources (arrays), should_answer,
    should_refuse; results: case_id, chunk_id, source_id, rank.
    """

    def first(column: str, wanted: str, name: str) -> DataFrame:
        asked = cases.select("case_id", F.explode(wanted).alias(column)).distinct()
        return results.join(asked, ["case_id", column]).groupBy("case_id").agg(F.min("rank").alias(name))

    answered = results.select("case_id").distinct().withColumn("_any", F.lit(True))
    rows = cases.join(first("chunk_id", "expected", "_chunk"), "case_id", "left").join(first("source_id", "expected_sources", "_source"), "case_id", "left").join(answered, "case_id", "left")
    parts = F.array(*[F.struct(F.lit(p).alias("part"), F.coalesce(n, F.lit("")).alias("name")) for p, n in (("all", F.lit("")), ("locale", F.col("locale")), ("topic", F.col("topic")))])
    each = rows.withColumn("_p", F.explode(parts))
    share = lambda test, among: F.round(F.coalesce(F.count_if(among & F.coalesce(test, F.lit(False))) / F.nullif(F.count_if(among), F.lit(0)), F.lit(0.0)), 4)
    answer, refuse = F.col("should_answer"), F.col("should_refuse")
    return each.groupBy("_p.part", "_p.name").agg(
        F.count_if(answer).alias("answerable_cases"),
        F.count_if(refuse).alias("refusal_cases"),
        *[share(F.col("_chunk") <= k, answer).alias(f"recall_at_{k}") for k in (1, 3, 5)],
        *[share(F.col("_source") <= k, answer).alias(f"source_recall_at_{k}") for k in (1, 3, 5)],
        share(F.col("_any").isNull(), refuse).alias("rejection_rate"),
    )


def failure_counts(turns: DataFrame) -> DataFrame:
    """One row: turns, passes and failures by kind of answered scenario turns.

    turns: answer, status, grounded, n_evidence, n_sources, answerability, expected_query
    (null: none expected), search_query.  Repeated fallbacks are answers without enough
    evidence given again, counted beyond the first of each text.
    """
    complete, grounded = X.is_complete(F.col("answer")), F.col("grounded")
    has, lacks = (F.col("n_evidence") > 0) & (F.col("n_sources") > 0), (F.col("n_evidence") == 0) & (F.col("n_sources") == 0)
    contract = F.when(grounded, has).otherwise(lacks)
    expected = F.col("expected_query").isNotNull()
    context = ~expected | (F.col("expected_query") == F.coalesce("search_query", F.lit("")))
    outside = F.col("answerability") == "out_of_scope"
    counts = turns.agg(
        F.count("*").alias("turns"),
        F.count_if(complete).alias("complete"),
        F.count_if(contract).alias("grounded_contract"),
        F.count_if(expected).alias("context_total"),
        F.count_if(expected & context).alias("context_pass"),
        F.count_if(outside).alias("out_of_scope_total"),
        F.count_if(outside & ~grounded).alias("out_of_scope_pass"),
        F.count_if(~complete).alias("truncation_failure"),
        F.count_if(~contract).alias("hallucination"),
        F.count_if(~context).alias("contextualization_failure"),
        F.count_if(outside & grounded).alias("out_of_scope_failure"),
        F.count_if((F.col("answerability") == "answerable") & ~grounded).alias("retrieval_failure"),
    )
    again = turns.where("status = 'insufficient_evidence'").groupBy(F.sha2(F.coalesce("answer", F.lit("")).cast("binary"), 256).alias("h")).agg(F.count("*").alias("n"))
    return counts.crossJoin(F.broadcast(again.agg(F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("fallback_failure"))))
