"""Content quality, scores and statuses of candidate documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lamplight.functions import text as X
from lamplight.operators import policy

DATE = r"(?:18|19|20)\d{2}(?:[.년/-]\s*\d{1,2})?"


def content_quality(docs: DataFrame, profile: X.Profile) -> DataFrame:
    """docs (title, text, extraction_status) with thirteen diagnostics, a score of ten points and whether it is noise."""
    compact, title = X.collapse(F.col("text")), X.collapse(F.col("title"))
    lines = F.filter(F.transform(F.split(F.coalesce("text", F.lit("")), r"\r\n|[\n\r]"), X.collapse), lambda s: s != "")
    base = docs.withColumns({"_c": compact, "_t": title, "_lines": lines}).withColumns({"body_length": F.length("_c"), "_sorted": F.sort_array("_lines")})
    # All copies of a line count: in sorted order a repeated line equals a neighbour.
    n = F.size("_sorted")
    places = F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))
    at = lambda i: F.get(F.col("_sorted"), i)
    twin = lambda i: F.coalesce((at(i) == at(i - 1)) & (i > 0), F.lit(False)) | F.coalesce((at(i) == at(i + 1)) & (i < n - 1), F.lit(False))
    repeated = F.aggregate(F.filter(places, twin), F.lit(0), lambda s, i: s + F.length(at(i)))
    total = F.aggregate(F.col("_sorted"), F.lit(0), lambda s, x: s + F.length(x))
    most1 = lambda x: F.least(F.lit(1.0), x)
    long1 = F.greatest(F.col("body_length"), F.lit(1))
    dates = F.regexp_count("_c", F.lit(DATE))
    entities = F.regexp_count("_c", F.lit(profile.entity_pattern)) if profile.entity_pattern else F.lit(0)
    tokens = F.regexp_count("_c", F.lit(X.WORD))
    labels = X.occurrences(F.col("_c"), profile.metadata_labels)
    rows = base.withColumns(
        {
            "_nav": most1(X.occurrences(F.col("_c"), profile.navigation_terms) * 8 / long1),
            "_rep": most1(repeated / F.greatest(total, F.lit(1))),
            "_ocr": most1(F.regexp_count("_c", F.lit("[�□■]{2,}")) * 2 / long1),
            "_density": most1((dates + entities) / F.greatest(tokens, F.lit(1))),
            "title_only": (F.col("_c") != "") & ((F.col("_c") == F.col("_t")) | (F.col("body_length") <= F.length("_t") + 20)),
            "metadata_only": (F.col("body_length") < 300) & (labels >= 3) & (dates <= 1),
            "suspicious_repeats": F.col("_c").rlike(r"(.)\1{9,}"),
            "extraction_success": (F.col("extraction_status") == "success") & (F.col("_c") != ""),
        }
    ).withColumn("_semantic", F.greatest(F.lit(0.0), 1.0 - F.col("_nav") - F.col("_rep")))
    points = (
        F.when(F.col("body_length") >= 500, 3).when(F.col("body_length") >= 300, 2).when(F.col("body_length") >= 120, 1).otherwise(0)
        + F.when(F.col("_semantic") >= 0.8, 2).when(F.col("_semantic") >= 0.6, 1).otherwise(0)
        + (F.col("_nav") <= 0.1).cast("int")
        + (F.col("_rep") <= 0.15).cast("int")
        + ((F.col("_ocr") <= 0.01) & ~F.col("suspicious_repeats")).cast("int")
        + F.col("extraction_success").cast("int")
        + (F.col("_density") >= 0.01).cast("int")
    )
    capped = F.when(F.col("title_only") | F.col("metadata_only"), F.least(points, F.lit(3))).otherwise(points)
    rounded = {name: F.round(col, 4) for name, col in {"navigation_ratio": F.col("_nav"), "repeated_ratio": F.col("_rep"), "ocr_ratio": F.col("_ocr"), "density": F.col("_density"), "semantic_ratio": F.col("_semantic")}.items()}
    noise = (F.col("_nav") > 0.35) | (F.col("_rep") > 0.5) | F.col("suspicious_repeats") | (F.col("_ocr") > 0.05)
    return rows.withColumns(rounded | {"quality_score": F.least(capped, F.lit(10)), "noise": noise}).drop("_c", "_t", "_lines", "_sorted", "_nav", "_rep", "_ocr", "_density", "_semantic")


def candidate_scores(rows: DataFrame, profile: X.Profile, corroboration: Column | int = 0, body: Column | None = None) -> DataFrame:
    """rows with eight sub-scores and their sum of at most 100.

    Needs source_tier, canonical_url, publisher, publisher_family, record_id, citation,
    author, title, text, quality_score and rights (of rights_decision); body is the text
    without repeated white space, if the rows have it already.
    """
    body = X.collapse(F.col("text")) if body is None else body
    both = F.trim(F.concat_ws(" ", X.collapse(F.col("title")), body))
    some = lambda name: (~X.blank(F.col(name))).cast("int")
    objective = 6 + F.least(F.regexp_count(body, F.lit(profile.attribution)), F.lit(4)) - F.least(F.regexp_count(body, F.lit(profile.sensational)) * 3, F.lit(6)) + F.greatest(some("author"), some("publisher"))
    place = X.occurrences(both, [profile.places[0]])
    scores = {
        "authority_score": policy.tier_reliability(F.col("source_tier")),
        "provenance_score": 4 * some("canonical_url") + 4 * some("publisher") * some("publisher_family") + 4 * some("record_id") + 3 * some("citation"),
        "historical_relevance_score": F.least(F.lit(10), 2 * X.present(both, profile.history_terms)),
        "place_relevance_score": F.least(F.lit(10).cast("long"), place * 3).cast("int"),
        "corroboration_score": F.greatest(F.lit(0), F.least(corroboration if isinstance(corroboration, Column) else F.lit(corroboration), F.lit(15))),
        "content_quality_score": F.col("quality_score"),
        "objectivity_score": F.greatest(F.lit(0), F.least(objective, F.lit(10))),
        "rights_score": F.col("rights.score"),
    }
    out = rows.withColumns(scores)
    total = F.lit(0)
    for name in scores:
        total = total + F.col(name)
    return out.withColumn("total_score", total)


def about(profile: X.Profile, body: Column) -> dict[str, Column]:
    """Whether a text names the first place, and terms of history; body is the text without repeated white space."""
    return {"about_place": X.any_of(F.concat_ws(" ", "title", "text"), profile.places[:1]), "about_history": X.any_of(body, profile.history_terms)}


def hard_rejections(profile: X.Profile, body: Column | None = None, known: dict[str, Column] | None = None) -> Column:
    """Codes that no score outweighs; needs the columns of content_quality, candidate_scores and dup_method.

    known: the columns of about(), if the rows have them already.
    """
    c, body = F.col, X.collapse(F.col("text")) if body is None else body
    known = known or about(profile, body)
    own = X.reasons(
        (X.blank(c("canonical_url")), "no_provenance"),
        (X.blank(c("publisher")) | X.blank(c("publisher_family")), "no_publisher"),
        (~known["about_place"] & X.blank(c("location")), "not_place_relevant"),
        (~known["about_history"] & X.blank(c("historical_period")), "no_historical_body"),
        (c("title_only"), "title_only"),
        (c("metadata_only") & (c("body_length") < 120), "no_historical_body"),
        (c("document_type").isin("search_result", "navigation"), "search_result_only"),
        (c("document_type").isin("seo", "autogenerated"), "seo_autogenerated"),
        (c("extraction_status") != "success", "extraction_failed"),
        ((c("ocr_ratio") > 0.05) | c("suspicious_repeats"), "ocr_corruption"),
        (c("duplicate_status") == "confirmed", F.when(c("dup_method") == "mirror", "duplicate_mirror").otherwise("duplicate_exact")),
        (c("source_tier") == "tier_4", "tier4_discovery_only"),
    )
    return F.array_distinct(F.concat(F.col("rights.hard"), own))


def score_status() -> Column:
    """Review status from hard rejections, total and rights."""
    c = F.col
    return (
        F.when(F.size("rejection_reasons") > 0, "auto_rejected")
        .when((c("total_score") >= 75) & c("rights.usable") & ~c("rights.needs_review"), "auto_candidate")
        .when(c("total_score") >= 60, "needs_human_review")
        .otherwise("auto_rejected")
    )


def row_warnings() -> Column:
    """Codes of what a reviewer should look at in a row with title and text."""
    c, clean, raw = F.col, X.collapse(F.col("text")), F.coalesce(F.col("text"), F.lit(""))
    n = F.length(clean)
    marks = n - F.length(F.replace(clean, F.lit("?"), F.lit("")))
    paragraphs = F.filter(F.transform(F.split(raw, r"\n\s*\n"), lambda p: F.trim(p)), lambda p: p != "")
    title_words = F.regexp_extract_all(F.coalesce(c("title"), F.lit("")), F.lit("([가-힣A-Za-z0-9]{2,})"))
    return X.reasons(
        (n == 0, "empty_body"),
        ((n > 0) & (n < 120), "short_body"),
        (F.contains(clean, F.lit("�")) | (marks > F.greatest(F.lit(10), F.floor(n / 20))), "encoding_or_ocr_review_required"),
        (clean.rlike(r"(.)\1{7,}"), "repeated_characters_review_required"),
        (F.size(paragraphs) != F.size(F.array_distinct(paragraphs)), "repeated_paragraph_review_required"),
        (raw.rlike(r"(?i)<(script|style|nav|footer|header)\b|javascript:"), "html_or_script_residue"),
        ((n > 0) & (F.size(title_words) > 0) & ~F.exists(title_words, lambda w: F.contains(clean, w)), "title_body_mismatch_review_required"),
        (X.blank(c("source_url")), "missing_source_url"),
        (X.blank(c("institution")), "missing_institution"),
        (X.blank(c("license_status")), "missing_license_status"),
    )


def top_per_group(rows: DataFrame, group: str, order: list[Column], limit: int) -> DataFrame:
    """The first rows of each group; Spark keeps only `limit` per group before the shuffle."""
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(group).orderBy(*order))).where(F.col("_n") <= limit).drop("_n")
