"""Catalogue, evaluation by part, failures of scenario turns, relevance and mismatches over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lamplight.functions import text as X
from lamplight.operators import collection, dedup, evaluation, lifecycle, policy
from lamplight.plans.corpus_queries import BM25, bm25_results, expected_documents, passage_tokens
from lamplight.plans.registry import query
from lamplight.plans.views import sql_collapse
from lamplight.sources.tables import table


@query()
def catalogue_accepted(spark: SparkSession, folder: str) -> DataFrame:
    """Pages in order of id, each a duplicate of an accepted one by url, content or title words, or accepted."""
    title = F.regexp_extract(F.coalesce("html", F.lit("")), r"(?is)<title>(.*?)</title>", 1)
    rows = table(spark, folder, "pages").select("page_id", "url", F.sha2(F.col("html").cast("binary"), 256).alias("sha"), title.alias("title"))
    return dedup.catalogue_accepted(rows, "page_id", X.plain_url(F.col("url")), F.col("sha"), F.col("title")).select("page_id", "dup_method", "dup_of")


def _share(test: str, among: str) -> str:
    return f"round(coalesce(count(*) FILTER ({among} AND {test}) / nullif(count(*) FILTER ({among}), 0), 0.0), 4)"


@query(
    f"""WITH {BM25}, e AS (SELECT item_id, min(doc_id) AS expected FROM benchmark b JOIN documents d ON contains(d.text, b.text) GROUP BY item_id),
    c AS (SELECT b.item_id, e.expected, d.source AS src, CASE WHEN b.item_id % 3 = 0 THEN 'ko' ELSE 'zh-CN' END AS locale, CASE WHEN b.item_id % 2 = 0 THEN 'unrelated' ELSE 'insufficient' END AS topic FROM benchmark b LEFT JOIN e USING (item_id) LEFT JOIN documents d ON d.doc_id = e.expected),
    r AS (SELECT s.item_id, s.doc_id, s.rank, d.source FROM sp s JOIN documents d USING (doc_id) WHERE s.rank <= 12),
    h AS (SELECT c.item_id, c.locale, c.topic, c.expected, min(r.rank) FILTER (r.doc_id = c.expected) AS f, min(r.rank) FILTER (r.source = c.src) AS g, count(r.rank) AS n FROM c LEFT JOIN r USING (item_id) GROUP BY 1, 2, 3, 4),
    p AS (SELECT 'all' AS part, '' AS name, h.* FROM h UNION ALL SELECT 'locale', locale, h.* FROM h UNION ALL SELECT 'topic', topic, h.* FROM h)
    SELECT part, name, count(*) FILTER (expected IS NOT NULL) AS answerable_cases, count(*) FILTER (expected IS NULL) AS refusal_cases,
      {", ".join(f"{_share(f'f <= {k}', 'expected IS NOT NULL')} AS recall_at_{k}, {_share(f'g <= {k}', 'expected IS NOT NULL')} AS source_recall_at_{k}" for k in (1, 3, 5))},
      {_share('n = 0', 'expected IS NULL')} AS rejection_rate FROM p GROUP BY part, name"""
)
def evaluate_breakdown(spark: SparkSession, folder: str) -> DataFrame:
    """Recall of passages and of their sources, and refusals, of all cases, by locale and by topic."""
    sources = table(spark, folder, "documents").select("doc_id", F.col("source").alias("source_id"))
    tokens = passage_tokens(spark, folder)
    found = expected_documents(spark, folder, tokens).join(sources, F.col("d") == F.col("doc_id")).select("item_id", F.array("d").alias("expected"), F.array("source_id").alias("expected_sources"))
    cases = table(spark, folder, "benchmark").select("item_id").join(found, "item_id", "left").select(
        F.col("item_id").alias("case_id"),
        F.when(F.col("item_id") % 3 == 0, "ko").otherwise("zh-CN").alias("locale"),
        F.when(F.col("item_id") % 2 == 0, "unrelated").otherwise("insufficient").alias("topic"),
        "expected",
        "expected_sources",
        F.col("expected").isNotNull().alias("should_answer"),
        F.col("expected").isNull().alias("should_refuse"),
    )
    results = bm25_results(spark, folder, 12, tokens).join(sources.withColumnRenamed("doc_id", "chunk_id"), "chunk_id").select(F.col("query_id").alias("case_id"), "chunk_id", "source_id", "rank")
    return evaluation.retrieval_breakdown(cases, results)


# Answers here have no brackets, so the SQL needs no stack; a test runs those by hand.
@query(
    r"""WITH t AS (SELECT text AS answer, conv_id % 4 <> 0 AS grounded, turn % 3 AS ev, CASE WHEN conv_id % 8 = 0 THEN turn % 3 ELSE (turn + conv_id) % 3 END AS so, ['answerable', 'unanswerable', 'out_of_scope'][turn % 3 + 1] AS kind,
      CASE WHEN turn % 2 = 1 THEN 'q' || conv_id END AS expected, 'q' || (conv_id - conv_id % 5) AS asked, conv_id % 4 = 0 AS fallback FROM conversations WHERE role = 'assistant'),
    v AS (SELECT *, NOT (coalesce(trim(answer), '') = '' OR regexp_matches(answer, '[(\[{]') OR regexp_matches(answer, '([,;:]|[A-Za-z]\.)\s*$')) AS complete, CASE WHEN grounded THEN ev > 0 AND so > 0 ELSE ev = 0 AND so = 0 END AS contract, expected IS NULL OR expected = asked AS context FROM t)
    SELECT count(*) AS turns, count(*) FILTER (complete) AS complete, count(*) FILTER (contract) AS grounded_contract, count(expected) AS context_total, count(*) FILTER (expected IS NOT NULL AND context) AS context_pass, count(*) FILTER (kind = 'out_of_scope') AS out_of_scope_total,
      count(*) FILTER (kind = 'out_of_scope' AND NOT grounded) AS out_of_scope_pass, count(*) FILTER (NOT complete) AS truncation_failure, count(*) FILTER (NOT contract) AS hallucination, count(*) FILTER (NOT context) AS contextualization_failure,
      count(*) FILTER (kind = 'out_of_scope' AND grounded) AS out_of_scope_failure, count(*) FILTER (kind = 'answerable' AND NOT grounded) AS retrieval_failure, (SELECT coalesce(sum(n - 1), 0)::BIGINT FROM (SELECT count(*) AS n FROM t WHERE fallback GROUP BY coalesce(answer, ''))) AS fallback_failure FROM v"""
)
def evaluate_failures(spark: SparkSession, folder: str) -> DataFrame:
    """Passes and failures by kind of assistant turns."""
    sources = F.when(F.col("conv_id") % 8 == 0, F.col("turn") % 3).otherwise((F.col("turn") + F.col("conv_id")) % 3)
    kinds = F.array(*map(F.lit, ("answerable", "unanswerable", "out_of_scope")))
    turns = table(spark, folder, "conversations").where("role = 'assistant'").select(
        F.col("text").alias("answer"),
        F.when(F.col("conv_id") % 4 == 0, "insufficient_evidence").otherwise("answered").alias("status"),
        (F.col("conv_id") % 4 != 0).alias("grounded"),
        (F.col("turn") % 3).alias("n_evidence"),
        sources.alias("n_sources"),
        F.get(kinds, (F.col("turn") % 3).cast("int")).alias("answerability"),
        F.when(F.col("turn") % 2 == 1, F.concat(F.lit("q"), F.col("conv_id").cast("string"))).alias("expected_query"),
        F.concat(F.lit("q"), (F.col("conv_id") - F.col("conv_id") % 5).cast("string")).alias("search_query"),
    )
    return evaluation.failure_counts(turns)


WHOLE = sql_collapse("source || ' ' || coalesce(text, '')")


@query(f"SELECT doc_id, length({WHOLE}) >= 400 AND NOT contains(lower({WHOLE}), 'captcha') AND (contains({WHOLE}, 'the') OR contains({WHOLE}, 'der')) AND (contains({WHOLE}, 'tion') OR contains({WHOLE}, 'ung')) AS relevant FROM documents")
def policy_campaign(spark: SparkSession, folder: str) -> DataFrame:
    """Documents that a campaign takes: length, barriers, places and history (C11)."""
    return table(spark, folder, "documents").select("doc_id", policy.campaign_relevant(F.col("source"), F.col("text"), ("the", "der"), ("tion", "ung"), ("CAPTCHA",)).alias("relevant"))


@query(
    r"""WITH w AS (SELECT conv_id, role, unnest(list_filter(regexp_extract_all(lower(coalesce(text, '')), '[0-9A-Za-z가-힣]+'), lambda x: length(x) > 1)) AS word FROM conversations)
    SELECT c.conv_id, NOT EXISTS (SELECT 1 FROM w u WHERE u.conv_id = c.conv_id AND u.role = 'user' AND u.word NOT IN (SELECT a.word FROM w a WHERE a.conv_id = c.conv_id AND a.role = 'assistant')) AS covered FROM (SELECT DISTINCT conv_id FROM conversations) c"""
)
def session_covered(spark: SparkSession, folder: str) -> DataFrame:
    """Conversations whose answers use every word of the questions."""
    said = lambda role: F.array_distinct(F.flatten(F.collect_list(F.when(F.col("role") == role, F.col("_w")))))
    rows = table(spark, folder, "conversations").select("conv_id", "role", X.keyword_tokens(F.coalesce("text", F.lit(""))).alias("_w"))
    return rows.groupBy("conv_id").agg(said("user").alias("asked"), said("assistant").alias("answered")).select("conv_id", policy.covers(F.col("answered"), F.col("asked")).alias("covered"))


@query(
    """WITH m AS (SELECT doc_id AS id, CASE WHEN doc_id % 6 = 0 THEN '' ELSE 'raw/' || doc_id END AS path FROM documents), f AS (SELECT 'raw/' || page_id AS path FROM pages), x AS (SELECT doc_id AS id FROM labels)
    SELECT 'raw_without_manifest' AS kind, path AS key FROM f WHERE path NOT IN (SELECT path FROM m) UNION ALL SELECT 'manifest_missing_raw_file', path FROM m WHERE path <> '' AND path NOT IN (SELECT path FROM f)
    UNION ALL SELECT 'manifest_without_raw_path', id::VARCHAR FROM m WHERE path = '' UNION ALL SELECT 'manifest_without_extracted_text', id::VARCHAR FROM m WHERE id NOT IN (SELECT id FROM x)"""
)
def index_raw_mismatches(spark: SparkSession, folder: str) -> DataFrame:
    """Raw files and extracted texts that a manifest lacks, or that lack it."""
    raw = lambda key: F.concat(F.lit("raw/"), F.col(key).cast("string"))
    manifest = table(spark, folder, "documents").select(F.col("doc_id").alias("document_id"), F.when(F.col("doc_id") % 6 == 0, "").otherwise(raw("doc_id")).alias("local_path"))
    return lifecycle.raw_mismatches(manifest, table(spark, folder, "pages").select(raw("page_id").alias("local_path")), table(spark, folder, "labels").select(F.col("doc_id").alias("document_id")))


@query(
    """WITH r AS (SELECT doc_id, source, doc_id % 13 = 5 AS blocked, doc_id % 13 <> 5 AND doc_id % 11 = 3 AS failed, doc_id % 13 <> 5 AND doc_id % 11 <> 3 AND length(text) >= 400 AS good, CASE WHEN source LIKE '%1' THEN 6 ELSE 15 END AS top FROM documents),
    c AS (SELECT *, coalesce(sum(good::INT) OVER w, 0) AS taken, coalesce(sum(failed::INT) OVER w, 0) AS errors FROM r WINDOW w AS (PARTITION BY source ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
    e AS (SELECT source, min(doc_id) AS since, arg_min(CASE WHEN taken >= top THEN 'over_limit' ELSE 'source_stopped' END, doc_id) AS why FROM c WHERE taken >= top OR errors >= 2 GROUP BY source),
    o AS (SELECT doc_id, c.source, CASE WHEN doc_id >= since THEN why WHEN blocked THEN 'blocked' WHEN failed THEN 'failed' WHEN good THEN 'accepted' ELSE 'rejected' END AS outcome FROM c LEFT JOIN e ON e.source IS NOT DISTINCT FROM c.source)
    SELECT doc_id, source, CASE WHEN coalesce(sum((outcome = 'accepted')::INT) OVER (ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) >= 60 THEN 'not_reached' ELSE outcome END AS outcome FROM o"""
)
def collection_batch(spark: SparkSession, folder: str) -> DataFrame:
    """What a batch of collection makes of documents in order: access and failures by id, sources under limits."""
    docs = table(spark, folder, "documents").select("doc_id", "source", "text")
    top = F.when(F.col("source").endswith("1"), 6).otherwise(15)
    tests = {"good": F.length("text") >= 400, "failed": F.col("doc_id") % 11 == 3, "blocked": F.col("doc_id") % 13 == 5}
    return collection.batch_outcomes(docs.select("doc_id", "source", top.alias("_top"), *[t.alias(n) for n, t in tests.items()]), "doc_id", "source", *map(F.col, tests), F.col("_top"), 60).select("doc_id", "source", "outcome")
