"""Text functions, chunkers and sources over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lamplight.functions import text as X
from lamplight.functions import udfs
from lamplight.operators import chunking
from lamplight.plans.registry import query
from lamplight.plans.views import CANDIDATES, candidates, sql_collapse, sql_reasons
from lamplight.sources.tables import table

C = sql_collapse("text")
WORDS = f"""w AS (SELECT doc_id, unnest(regexp_extract_all(lower({C}), '[0-9A-Za-z가-힣]+')) AS w, generate_subscripts(regexp_extract_all(lower({C}), '[0-9A-Za-z가-힣]+'), 1) AS n FROM documents),
u AS (SELECT doc_id, w, min(n) AS n FROM w WHERE length(w) > 1 GROUP BY doc_id, w)"""


@query(f"SELECT doc_id, length({C}) AS n_chars, sha256({C}) AS text_sha256 FROM documents")
def text_collapse(spark: SparkSession, folder: str) -> DataFrame:
    """White space collapsed and stripped (B1, B2)."""
    clean = X.collapse(F.col("text"))
    return table(spark, folder, "documents").select("doc_id", F.length(clean).cast("long").alias("n_chars"), F.sha2(clean.cast("binary"), 256).alias("text_sha256"))


@query(f"WITH {WORDS} SELECT d.doc_id, count(u.w) AS n_tokens, md5(coalesce(string_agg(u.w, ' ' ORDER BY u.n), '')) AS tokens_md5 FROM documents d LEFT JOIN u USING (doc_id) GROUP BY d.doc_id")
def text_tokenize(spark: SparkSession, folder: str) -> DataFrame:
    """Distinct ordered features."""
    t = X.tokenize(F.col("text"))
    return table(spark, folder, "documents").select("doc_id", F.size(t).cast("long").alias("n_tokens"), F.md5(F.array_join(t, " ").cast("binary")).alias("tokens_md5"))


@query(
    f"""WITH {WORDS}, s AS (SELECT doc_id, n, CASE WHEN w LIKE '%ing' AND length(w) > 4 THEN left(w, length(w) - 3) WHEN w LIKE '%ed' AND length(w) > 3 THEN left(w, length(w) - 2)
    WHEN w LIKE '%ly' AND length(w) > 3 THEN left(w, length(w) - 2) WHEN w LIKE '%s' AND length(w) > 2 THEN left(w, length(w) - 1) ELSE w END AS w FROM u),
    k AS (SELECT doc_id, w FROM s WHERE length(w) > 1 AND w NOT IN ('the','of','and','to','in','is','by','on','at','an') GROUP BY doc_id, w)
    SELECT d.doc_id, count(k.w) AS n_words, md5(coalesce(string_agg(k.w, ' ' ORDER BY k.w), '')) AS words_md5 FROM documents d LEFT JOIN k USING (doc_id) GROUP BY d.doc_id"""
)
def text_content_words(spark: SparkSession, folder: str) -> DataFrame:
    """Words without suffixes and stop words."""
    w = X.content_words(F.col("text"), X.SAMPLE)
    return table(spark, folder, "documents").select("doc_id", F.size(w).cast("long").alias("n_words"), F.md5(F.array_join(F.sort_array(w), " ").cast("binary")).alias("words_md5"))


SENTENCES = "list_filter(list_transform(string_split_regex(regexp_replace(regexp_replace(regexp_replace(text, '\\b([A-Z])\\.(\\s*[A-Z][a-z])', '\\1' || chr(1) || '\\2', 'g'), '([.!?。！？])\\s+', '\\1' || chr(2), 'g'), '\\n+', chr(2), 'g'), chr(2)), lambda s: replace(trim(s, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), chr(1), '.')), lambda s: s <> '')"


@query(f"SELECT doc_id, len({SENTENCES})::BIGINT AS n_sentences, md5(array_to_string({SENTENCES}, '|')) AS sentences_md5 FROM documents")
def text_sentences(spark: SparkSession, folder: str) -> DataFrame:
    """Sentences."""
    s = X.sentences(F.col("text"))
    return table(spark, folder, "documents").select("doc_id", F.size(s).cast("long").alias("n_sentences"), F.md5(F.array_join(s, "|").cast("binary")).alias("sentences_md5"))


REPEATS = f"list_filter(list_transform(string_split(regexp_replace(text, '([.!?。！？])\\s+', '\\1' || chr(2), 'g'), chr(2)), lambda s: {sql_collapse('s')}), lambda s: s <> '')"


@query(f"SELECT doc_id, (len({REPEATS}) - len(list_distinct({REPEATS})))::BIGINT AS n_repeated FROM documents")
def text_repeated_sentences(spark: SparkSession, folder: str) -> DataFrame:
    """Sentences that repeat another."""
    return table(spark, folder, "documents").select("doc_id", X.repeated_sentences(F.col("text")).cast("long").alias("n_repeated"))


@query()
def text_redact(spark: SparkSession, folder: str) -> DataFrame:
    """Addresses, numbers and secrets redacted (B17); DuckDB's patterns have no look-around."""
    clean = X.redact(F.col("text"))
    return table(spark, folder, "documents").select("doc_id", F.length(clean).alias("n_chars"), F.regexp_count(clean, F.lit(r"\[[^\[\]]* 제거\]")).alias("n_redacted"))


@query("SELECT doc_id, CASE WHEN length(text) <= 80 THEN text ELSE regexp_replace(left(text, 79), '\\s+$', '') || '…' END AS short FROM documents")
def text_truncate(spark: SparkSession, folder: str) -> DataFrame:
    """At most 80 characters with an ellipsis."""
    return table(spark, folder, "documents").select("doc_id", X.truncate(F.col("text"), 80).alias("short"))


@query(f"SELECT doc_id, left(array_to_string(list_filter({SENTENCES}, lambda s: contains(s, 'tion') AND length(s) BETWEEN 20 AND 400), ' '), 1000) AS excerpt FROM documents")
def text_excerpt(spark: SparkSession, folder: str) -> DataFrame:
    """Sentences with a term."""
    return table(spark, folder, "documents").select("doc_id", X.relevant_excerpt(F.col("text"), "tion").alias("excerpt"))


@query()
def text_keyword_windows(spark: SparkSession, folder: str) -> DataFrame:
    """Windows around a term, three distinct ones at most."""
    return table(spark, folder, "documents").select("doc_id", F.array_join(X.keyword_windows(F.col("text"), "tion"), "|").alias("windows"))


@query(
    f"""WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS n FROM documents),
    c AS (SELECT doc_id, n, {sql_collapse("regexp_replace(line, 'https?://[^ \\t\\n\\r\\f\\x0B]+', ' ', 'g')")} AS line FROM l),
    u AS (SELECT doc_id, line, min(n) AS n FROM c WHERE line <> '' GROUP BY doc_id, line)
    SELECT d.doc_id, md5({sql_collapse("coalesce(string_agg(u.line, ' ' ORDER BY u.n), '')")}) AS core_md5, count(u.line) AS n_lines FROM documents d LEFT JOIN u USING (doc_id) GROUP BY d.doc_id"""
)
def text_core_lines(spark: SparkSession, folder: str) -> DataFrame:
    """Distinct lines without URLs."""
    core = X.core_lines(F.col("text"))
    lines = F.array_distinct(F.filter(F.transform(F.split("text", "\n"), lambda s: X.collapse(F.regexp_replace(s, r"https?://\S+", " "))), lambda s: s != ""))
    return table(spark, folder, "documents").select("doc_id", F.md5(core.cast("binary")).alias("core_md5"), F.size(lines).cast("long").alias("n_lines"))


@query(
    "WITH p AS (SELECT page_id, trim(url) AS u FROM pages) SELECT page_id, lower(regexp_replace(u, '/+$', '')) AS plain, left(sha256('web' || chr(0) || u), 20) AS id FROM p"
)
def url_plain_and_id(spark: SparkSession, folder: str) -> DataFrame:
    """Audit form of URLs and ids derived from them."""
    return table(spark, folder, "pages").select("page_id", X.plain_url(F.col("url")).alias("plain"), X.derived_id(F.lit("web"), F.trim("url")).alias("id"))


@query()
def url_canonical(spark: SparkSession, folder: str) -> DataFrame:
    """Both canonical forms of URLs."""
    return table(spark, folder, "pages").select("page_id", udfs.canonical_url("url").alias("canonical"), udfs.canonical_url_with_port("url").alias("canonical_with_port"))


@query()
def json_stable_hash(spark: SparkSession, folder: str) -> DataFrame:
    """Order-independent hash, values and URLs of JSON text."""
    return table(spark, folder, "events").select("event_id", udfs.stable_json_hash("props").alias("props_sha256"), F.md5(udfs.flattened_json("props").cast("binary")).alias("values_md5"))


@query(f"WITH {CANDIDATES} SELECT doc_id, CASE WHEN k IN ('KOGL1','KOGL2','KOGL3','KOGL4') THEN 'KOGL-' || right(k, 1) ELSE k END AS code FROM (SELECT doc_id, replace(replace(replace(replace(replace(upper(trim(kogl_type)), '공공누리', 'KOGL'), '제', ''), '유형', ''), ' ', ''), '_', '-') AS k FROM candidates)")
def licence_codes(spark: SparkSession, folder: str) -> DataFrame:
    """Licence codes."""
    return candidates(spark, folder).select("doc_id", X.licence_code(F.col("kogl_type")).alias("code"))


@query(
    f"""SELECT doc_id, {sql_reasons(*[(' OR '.join(f"contains(lower({C}), '{t}')" for t in [w.lower() for w in words]), f"'{name}'") for name, words in X.SAMPLE.topics.items()]).replace(C, 'c')} AS topics
    FROM (SELECT doc_id, {C} AS c FROM documents)"""
)
def text_topics(spark: SparkSession, folder: str) -> DataFrame:
    """Topics by dictionary."""
    return table(spark, folder, "documents").select("doc_id", F.array_join(X.topics_of(F.col("text"), X.SAMPLE.topics), ",").alias("topics"))


@query(
    """WITH s AS (SELECT doc_id, text, CASE WHEN length(text) <= 500 THEN 0 ELSE ceil((length(text) - 500) / 450.0)::INT END AS last FROM documents),
    r AS (SELECT doc_id, text, unnest(range(0, last + 1)) AS i FROM s)
    SELECT doc_id, i::INT AS chunk_index, CASE WHEN length(text) <= 500 THEN doc_id::VARCHAR ELSE doc_id || '::chunk-' || i END AS chunk_id, md5(substr(text, i * 450 + 1, 500)) AS text_md5 FROM r"""
)
def chunk_fixed(spark: SparkSession, folder: str) -> DataFrame:
    """Fixed windows (H1)."""
    rows = chunking.fixed_chunks(table(spark, folder, "documents"))
    return rows.select("doc_id", "chunk_index", "chunk_id", F.md5(F.col("text").cast("binary")).alias("text_md5"))


@query()
def chunk_paragraphs(spark: SparkSession, folder: str) -> DataFrame:
    """Paragraph and sentence chunks (H2)."""
    return chunking.paragraph_chunks(table(spark, folder, "documents"))


@query()
def chunk_sliding(spark: SparkSession, folder: str) -> DataFrame:
    """Overlapping chunks that end at sentences (H3)."""
    return chunking.sliding_chunks(table(spark, folder, "documents"))


@query()
def chunk_packed(spark: SparkSession, folder: str) -> DataFrame:
    """Paragraphs packed into passages (H4, H5)."""
    docs = table(spark, folder, "documents")
    parts = F.filter(F.split("text", "\n"), lambda p: F.trim(p) != "")
    rows = docs.select("doc_id", F.posexplode(chunking.packed_paragraphs(parts)).alias("sequence", "value"))
    return rows.select("doc_id", "sequence", F.sha2(F.col("value").cast("binary"), 256).alias("content_sha256"), F.length("value").alias("n_chars"))


@query(
    """WITH b AS (SELECT conv_id, turn, regexp_replace(text, '^[ \\t\\n\\r\\f\\x0B]+|[ \\t\\n\\r\\f\\x0B]+$', '', 'g') AS v FROM conversations WHERE role = 'assistant')
    SELECT conv_id, turn, v <> '' AND NOT regexp_matches(v, '[()\\[\\]{}]') AND NOT regexp_matches(v, '([,;:]|[A-Za-z]\\.)\\s*$') AS complete FROM b"""
)
def answers_complete(spark: SparkSession, folder: str) -> DataFrame:
    """Whether answers end properly (B31, B33); the answers of this table have no brackets, which is what the SQL tests."""
    return table(spark, folder, "conversations").where("role = 'assistant'").select("conv_id", "turn", X.is_complete(F.col("text")).alias("complete"))
