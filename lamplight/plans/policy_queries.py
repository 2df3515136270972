"""Dialogue rules, candidate verification and page text over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lamplight.functions import text as X
from lamplight.operators import candidates as cand
from lamplight.operators import dialogue, evidence, lifecycle, policy, session
from lamplight.plans.registry import query
from lamplight.plans.views import CANDIDATES, candidates, sql_reasons
from lamplight.sources.tables import table


@query()
def page_visible_text(spark: SparkSession, folder: str) -> DataFrame:
    """Titles, visible texts and links of pages, whole, in the four readings."""
    pages = table(spark, folder, "pages").select("page_id", cand.visible_page("html").alias("p"))
    return pages.select("page_id", "p.title", F.length("p.text").alias("n_chars"), F.size("p.links").alias("n_links"), "p.text", "p.links", "p.collected", "p.metadata", "p.batch")


@query()
def dialogue_situations(spark: SparkSession, folder: str) -> DataFrame:
    """Situation of each user turn, whether it needs sources, and the length asked for."""
    turns = table(spark, folder, "conversations").where("role = 'user'")
    rows = turns.withColumn("s", dialogue.situation(F.col("text"), F.col("turn") > 1))
    return rows.select("conv_id", "turn", "s.situation", "s.reason", dialogue.needs_retrieval(F.col("s"), F.coalesce("text", F.lit("")), F.col("turn") > 1).alias("needs_retrieval"), dialogue.length_mode(F.coalesce("text", F.lit(""))).alias("length"))


@query()
def answer_guards(spark: SparkSession, folder: str) -> DataFrame:
    """Answers without repeats and cut at their last sentence."""
    rows = table(spark, folder, "conversations").where("role = 'assistant'")
    return rows.select("conv_id", "turn", dialogue.without_repeats("text").alias("answer"), dialogue.complete_part(F.col("text")).alias("complete_part"))


@query()
def answer_echoes(spark: SparkSession, folder: str) -> DataFrame:
    """Answers that give the question back."""
    pairs = session.exchanges(table(spark, folder, "conversations")).where("assistant <> ''")
    return pairs.select("conv_id", "exchange", dialogue.echoes_question("assistant", "user").alias("echo"))


TERMS = ("tion", "ing", "the")


@query()
def candidate_verification(spark: SparkSession, folder: str) -> DataFrame:
    """VALID, INVALID or DUPLICATE with reasons."""
    rows = candidates(spark, folder).withColumns({"core": X.core_lines(F.col("text")), "duplicate_status": F.when(F.col("doc_id") % 50 == 7, "confirmed").otherwise("unique"), "canonical_url": F.col("source_url")})
    found = cand.verification(rows, TERMS, ("ment", "tion", "keit", "ción"), ("captcha", "login required"))
    return found.select("doc_id", "classification", F.array_join("reasons", ",").alias("reasons"))


@query(
    """WITH c AS (SELECT doc_id, left(text, 40) AS title, text AS core, (left(text, 40) || ' ' || text) AS b FROM documents),
    h AS (SELECT *, ((length(b) - length(replace(b, 'tion', ''))) / 4 + (length(b) - length(replace(b, 'ing', ''))) / 3 + (length(b) - length(replace(b, 'ver', ''))) / 3)::BIGINT AS hits,
      contains(b, 'ment')::INT + contains(b, 'tion')::INT + contains(b, 'keit')::INT + contains(b, 'ción')::INT AS hist FROM c)
    SELECT doc_id, CASE WHEN length(core) < 450 THEN 'C_WEAK_CONTEXT' WHEN contains(lower(b), 'captcha') THEN 'D_IRRELEVANT' WHEN contains(title, 'Index of') AND length(core) < 900 THEN 'C_WEAK_CONTEXT' WHEN hist < 2 THEN 'C_WEAK_CONTEXT'
      WHEN contains(title, 'tion') OR contains(title, 'ing') OR contains(title, 'ver') OR hits >= 3 THEN 'A_DIRECT' WHEN contains(b, 'ver') AND hits >= 2 AND length(core) >= 650 THEN 'B_STRONG_CONTEXT' ELSE 'C_WEAK_CONTEXT' END AS tier FROM h"""
)
def candidate_tiers(spark: SparkSession, folder: str) -> DataFrame:
    """Confidence tiers by ordered exits."""
    rows = table(spark, folder, "documents").withColumn("title", F.left("text", F.lit(40)))
    tier = cand.confidence_tier(F.col("title"), F.col("text"), ("tion", "ing", "ver"), ("ment", "tion", "keit", "ción"), ("captcha",), ("Index of",))
    return rows.select("doc_id", tier["tier"].alias("tier"))


@query(
    f"""WITH {CANDIDATES}, m AS (SELECT *, {sql_reasons(*[(f"coalesce({f}, '') = ''", f"'{f}'") for f in ('source_url', 'author', 'record_id', 'reviewed_by')])} AS missing_fields FROM candidates)
    SELECT doc_id, missing_fields, CASE WHEN missing_fields = 'source_url,author,record_id,reviewed_by' THEN 'empty_record' WHEN missing_fields <> '' THEN 'missing_fields' WHEN copyright_status IN ('unknown', 'restricted') THEN 'rights_unclear' WHEN review_status <> 'reviewed' THEN 'needs_review' ELSE 'ready' END AS status FROM m"""
)
def candidate_preflight(spark: SparkSession, folder: str) -> DataFrame:
    """Import preflight."""
    rows = policy.preflight(candidates(spark, folder), ["source_url", "author", "record_id", "reviewed_by"])
    return rows.select("doc_id", F.array_join("missing_fields", ",").alias("missing_fields"), "status")


@query(
    f"""WITH {CANDIDATES} SELECT doc_id, {sql_reasons(("review_status <> 'verified'", "'not_verified'"), ("source_tier = 'tier_4'", "'tier_4'"), ("n_chars % 100 < 75", "'below_75'"),
    ("rights_status NOT IN ('public_domain', 'open_license', 'permission_granted')", "'rights'"), ("human_review_required", "'rights_review_open'"), ("reviewed_by = '' OR verification_notes = ''", "'no_reviewer'"))} AS errors FROM candidates"""
)
def candidate_promotion(spark: SparkSession, folder: str) -> DataFrame:
    """What is against promoting candidates."""
    rows = candidates(spark, folder).withColumns({"total_score": F.col("n_chars") % 100, "rejection_reasons": F.array().cast("array<string>"), "duplicate_status": F.lit("unique"), "verified_by": F.col("reviewed_by")})
    return rows.select("doc_id", F.array_join(policy.promotion_errors(), ",").alias("errors"))


@query(
    f"""WITH {CANDIDATES} SELECT doc_id, CASE WHEN doc_id % 23 = 0 THEN 'forced' WHEN extraction_status = 'failed' THEN 'previous_failed' WHEN record_id = '' THEN 'missing_raw' WHEN author = '' OR published_date < '2024-01-01' THEN 'hash_mismatch' WHEN citation = '' THEN 'missing_raw' WHEN doc_id % 5 = 0 THEN 'hash_mismatch' ELSE 'reused' END AS decision FROM candidates"""
)
def collection_reuse(spark: SparkSession, folder: str) -> DataFrame:
    """Whether stored pages are used again."""
    rows = candidates(spark, folder).withColumns(
        {
            "force": F.col("doc_id") % 23 == 0,
            "collection_status": F.when(F.col("extraction_status") == "failed", "failed").when(F.col("record_id") == "", "new").otherwise("collected"),
            "canonical_url": F.col("source_url"),
            "expected_url": F.col("source_url"),
            "content_hash": F.when(F.col("author") == "", "").otherwise("h"),
            "review_after": F.col("published_date"),
            "stored_hash": F.when(F.col("citation") == "", None).when(F.col("doc_id") % 5 == 0, "other").otherwise("h"),
        }
    )
    return rows.select("doc_id", policy.reuse_decision(F.lit("2024-01-01")).alias("decision"))


@query(f"WITH {CANDIDATES} SELECT doc_id, source_url <> '' AND source IN ('src1', 'src2') AS allowed FROM candidates")
def url_allowed(spark: SparkSession, folder: str) -> DataFrame:
    """Allowed hosts (C17)."""
    rows = candidates(spark, folder).withColumn("u", F.when(F.col("source_url") == "", "").otherwise(F.concat(F.lit("https://www."), F.col("source"), F.lit(".example.org/x"))))
    return rows.select("doc_id", policy.allowed_url(F.col("u"), ("src1.example.org", "src2.example.org")).alias("allowed"))


@query(f"WITH {CANDIDATES} SELECT doc_id, NOT (published_date < '2024-01-01') AS active FROM candidates")
def lifecycle_expire(spark: SparkSession, folder: str) -> DataFrame:
    """Rows past their review date become inactive (K5, K6)."""
    rows = candidates(spark, folder).withColumns({"review_after": F.col("published_date"), "active": F.lit(True)})
    return lifecycle.expire(rows, "2024-01-01").select("doc_id", "active")


@query(
    """SELECT conv_id, turn, CASE WHEN contains(text, 'the') THEN 'the' END AS place, CASE WHEN contains(text, 'the') THEN text ELSE concat_ws(' ', 'the', text) END AS query FROM conversations WHERE role = 'user'"""
)
def contextual_queries(spark: SparkSession, folder: str) -> DataFrame:
    """Questions with the active place that they don't name."""
    rows = table(spark, folder, "conversations").where("role = 'user'")
    return rows.select("conv_id", "turn", F.when(F.contains("text", F.lit("the")), "the").alias("place"), session.contextual_query(F.col("text"), F.lit("the"), F.lit(None).cast("string")).alias("query"))


@query("SELECT conv_id, role AS slot, arg_max(text, turn) AS value FROM conversations GROUP BY conv_id, role")
def session_slots(spark: SparkSession, folder: str) -> DataFrame:
    """Latest value of each slot (L4)."""
    return session.latest_slots(table(spark, folder, "conversations").select("conv_id", "turn", F.col("role").alias("slot"), F.col("text").alias("value")))


@query("WITH m AS (SELECT conv_id, turn, contains(text, 'tion') AS hit FROM conversations) SELECT conv_id, turn FROM (SELECT *, bool_or(hit) OVER (PARTITION BY conv_id) AS any_hit FROM m) WHERE hit OR NOT any_hit")
def evidence_narrowed(spark: SparkSession, folder: str) -> DataFrame:
    """Matching rows where there are any, else all."""
    rows = table(spark, folder, "conversations").withColumnRenamed("conv_id", "query_id")
    return evidence.keep_matching_if_any(rows, F.contains("text", F.lit("tion"))).select(F.col("query_id").alias("conv_id"), "turn")


@query()
def prompts(spark: SparkSession, folder: str) -> DataFrame:
    """Labelled prompts with redacted parts."""
    pairs = session.exchanges(table(spark, folder, "conversations"))
    made = dialogue.prompt(F.lit("Answer from the records."), F.lit(""), F.array("assistant"), F.col("user"))
    return pairs.select("conv_id", "exchange", F.length(made).alias("n_chars"), F.sha2(made.cast("binary"), 256).alias("prompt_sha256"))
