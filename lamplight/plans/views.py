"""Views over the synthetic tables in the shapes that the operators take.

The tables have no policy metadata, so candidates get it from their ids and sources by
fixed rules, over all rows.  Each view has its SQL twin for the oracles.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lamplight.sources.tables import table


def _pick(values: list[str], number: Column) -> Column:
    # Not element_at, which Spark takes for never null over such an array, also with a null number.
    return F.get(F.array(*map(F.lit, values)), (number % len(values)).cast("int"))


def _sql_pick(values: list[str], number: str) -> str:
    listed = ", ".join(f"'{v}'" for v in values)
    return f"([{listed}])[({number}) % {len(values)} + 1]"


#: column -> (values, divisor): the value is chosen by doc_id // divisor.
RULES = {
    "robots_status": (["allowed", "verified_allowed", "blocked", "allowed", "allowed"], 1),
    "policy_status": (["allowed", "allowed", "allowed", "blocked"], 5),
    "access_status": (["public", "allowed", "public", "login", "captcha", "paywall", "public", "strange"], 3),
    "rights_status": (["public_domain", "open_license", "unknown", "restricted", "permission_granted"], 7),
    "kogl_type": (["공공누리 제1유형", "KOGL_2", "kogl3", "", "KOGL-1"], 2),
    "license_text": (["", "free to use", ""], 4),
    "document_rights_url": (["https://example.org/rights", ""], 11),
    "checked_at": (["2025-01-01", "", "2025-02-03"], 13),
    "review_status": (["reviewed", "draft", "reviewed", "cleaned"], 2),
    "copyright_status": (["public_domain", "unknown", "open_license", "restricted", "permission_granted"], 3),
    "source_reliability": (["A", "B", "C", ""], 1),
    "reviewed_by": (["kim", "", "lee"], 5),
    "reviewed_at": (["2025-03-01", "2025-13-01", ""], 6),
    "verification_notes": (["checked", "", "checked"], 7),
    "attribution_text": (["", "by the author"], 9),
    "source_tier": (["tier_1", "tier_2", "tier_3", "tier_4"], 1),
    "document_type": (["article", "article", "article", "search_result", "seo", "metadata_document"], 17),
    "extraction_status": (["success", "success", "success", "failed"], 19),
    "published_date": (["2024-05-06", "2024-5-6", "", "2023-12-31"], 3),
    "author": (["", "a writer"], 2),
    "record_id": (["", "r1", "r2"], 3),
    "citation": (["", "cited"], 6),
    "location": (["", "harbour"], 8),
    "historical_period": (["", "modern"], 10),
    "subject": (["harbour", "station", "school", "bank", "mill"], 40),
    "predicate": (["opened", "built"], 8),
    "fact_value": (["1897", "1910", "1921"], 3),
}
FLAGS = {"allowed_for_rag": 3, "allowed_for_training": 4, "attribution_required": 5, "human_review_required": 6}


def candidates(spark: SparkSession, folder: str) -> DataFrame:
    """documents with the metadata of candidates."""
    docs = table(spark, folder, "documents")
    number = lambda d: F.floor(F.col("doc_id") / d)
    made = {name: _pick(values, number(d)) for name, (values, d) in RULES.items()}
    flags = {name: F.col("doc_id") % d != 0 for name, d in FLAGS.items()}
    made |= flags | {
        "document_id": F.concat(F.lit("doc-"), F.col("doc_id").cast("string")),
        "title": F.left("text", F.lit(40)),
        "publisher": F.col("source"),
        "publisher_family": F.upper("source"),
        "source_url": F.when(F.col("doc_id") % 9 == 0, "").otherwise(F.concat(F.lit("https://example.org/"), F.col("source"), F.lit("/"), F.col("doc_id").cast("string"))),
        "policy_url": F.lit(""),
        "local_path": F.concat(F.lit("raw/"), F.col("doc_id").cast("string")),
        "source_type": F.lit("web"),
        "language": F.col("lang"),
        "accessed_date": F.lit("2025-01-01"),
        "place": F.col("lang"),
    }
    return docs.withColumns(made)


CANDIDATES = (
    "candidates AS (SELECT *, "
    + ", ".join(f"{_sql_pick(values, f'doc_id // {d}')} AS {name}" for name, (values, d) in RULES.items())
    + ", "
    + ", ".join(f"doc_id % {d} <> 0 AS {name}" for name, d in FLAGS.items())
    + ", 'doc-' || doc_id AS document_id, left(text, 40) AS title, source AS publisher, upper(source) AS publisher_family, "
    "CASE WHEN doc_id % 9 = 0 THEN '' ELSE 'https://example.org/' || source || '/' || doc_id END AS source_url, '' AS policy_url, "
    "'raw/' || doc_id AS local_path, 'web' AS source_type, lang AS language, '2025-01-01' AS accessed_date, lang AS place FROM documents)"
)
#: The SQL twins of text functions, as DuckDB macros would have them.
SPACE = "[ \\t\\n\\r\\f\\x0B]+"


def sql_collapse(x: str) -> str:
    return f"trim(regexp_replace(coalesce({x}, ''), '{SPACE}', ' ', 'g'))"


def sql_reasons(*pairs: tuple[str, str]) -> str:
    """Codes of the tests that hold, joined by commas in the order given."""
    return "array_to_string(list_filter([" + ", ".join(f"CASE WHEN {test} THEN {code} END" for test, code in pairs) + "], lambda x: x IS NOT NULL), ',')"
