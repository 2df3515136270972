"""Policies over rows of metadata: each gives an array of reason codes, empty where nothing is against a row.

Everything is fail-closed: an unknown right, robots rule, lane or review state is a reason.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lamplight.functions import text as X
from lamplight.functions.text import blank, reasons

c = F.col

#: States of rights, robots and access.
RIGHTS_ALLOWED = ("public_domain", "open_license", "permission_granted")
RIGHTS_RESTRICTED = ("restricted", "prohibited")
NOT_CLEARED = ("unknown", "restricted")


def licence_errors() -> Column:
    """Unknown or restricted material may be used for nothing; a required attribution needs its text."""
    locked = c("copyright_status").isin(*NOT_CLEARED)
    return reasons(
        (locked & c("allowed_for_rag"), "rag_not_permitted"),
        (locked & c("allowed_for_training"), "training_not_permitted"),
        (c("attribution_required") & blank(c("attribution_text")), "attribution_text_required"),
    )


def document_errors() -> Column:
    """Required fields, ISO dates, ordered periods, reviewer of a reviewed document, and the licence errors."""
    required = [(blank(c(f)), f"missing:{f}") for f in ("document_id", "title", "source_type", "publisher", "local_path", "language")]
    dated = [(~blank(c(f)) & F.try_to_date(c(f), "yyyy-MM-dd").isNull(), f"bad_date:{f}") for f in ("published_date", "accessed_date")]
    reviewed = c("review_status") == "reviewed"
    own = reasons(
        *required,
        (blank(c("source_url")) & blank(c("publisher")), "no_source"),
        *dated,
        (c("period_start") > c("period_end"), "period_order"),
        (reviewed & blank(c("reviewed_by")), "missing:reviewed_by"),
        (reviewed & blank(c("reviewed_at")), "missing:reviewed_at"),
        (reviewed & ~blank(c("reviewed_at")) & F.try_to_timestamp(c("reviewed_at")).isNull(), "bad_date:reviewed_at"),
    )
    return F.array_distinct(F.concat(own, licence_errors()))


def eligibility_reasons() -> Column:
    """What is against serving a document: review, permission, reliability, provenance, rights, review record."""
    url = c("source_url")
    first = reasons(
        (c("review_status") != "reviewed", F.concat(F.lit("review_status="), c("review_status"))),
        (~c("allowed_for_rag"), "allowed_for_rag=false"),
        (~F.coalesce(c("source_reliability").isin("A", "B"), F.lit(False)), F.concat(F.lit("source_reliability="), F.coalesce(F.nullif(c("source_reliability"), F.lit("")), F.lit("missing")))),
        *[(blank(c(f)), f"missing:{f}") for f in ("document_id", "title", "publisher", "source_url")],
        (~blank(url) & ~url.rlike(r"(?i)^https?://[^/\s?#]+"), "invalid:source_url"),
        (c("copyright_status").isin(*NOT_CLEARED), F.concat(F.lit("copyright_status="), c("copyright_status"))),
    )
    last = reasons(
        (c("attribution_required") & blank(c("attribution_text")), "missing:attribution_text"),
        *[(blank(c(f)), f"missing:{f}") for f in ("reviewed_by", "reviewed_at", "verification_notes")],
    )
    return F.array_distinct(F.concat(first, licence_errors(), last))


def service_ready() -> Column:
    """The looser gate for a service index."""
    return (c("review_status") == "reviewed") & c("allowed_for_rag") & F.coalesce(c("source_reliability"), F.lit("")).isin("", "A", "B") & (F.size(document_errors()) == 0)


def rights_decision() -> Column:
    """(score, usable, needs_review, hard): robots, source policy, access and rights evidence of a document."""
    hard = reasons(
        (~F.coalesce(c("robots_status").isin("allowed", "verified_allowed"), F.lit(False)), "robots_blocked"),
        (F.coalesce(c("policy_status"), F.lit("")) != "allowed", "policy_blocked"),
        (c("access_status").isin("login_required", "login"), "login_required"),
        (c("access_status") == "captcha", "captcha"),
        (c("access_status") == "paywall", "paywall"),
        (~F.coalesce(c("access_status").isin("login_required", "login", "captcha", "paywall", "public", "allowed"), F.lit(False)), "policy_blocked"),
        (c("rights_status").isin(*RIGHTS_RESTRICTED), "rights_restricted"),
    )
    kogl = X.licence_code(F.coalesce(c("kogl_type"), F.lit("")))
    explicit = F.coalesce(c("rights_status").isin(*RIGHTS_ALLOWED), F.lit(False))
    complete = ~blank(c("checked_at")) & (~blank(c("document_rights_url")) | ~blank(c("policy_url")))
    usable = explicit & complete & ((kogl == "KOGL-1") | ~blank(c("license_text"))) & (F.size(hard) == 0)
    review = c("human_review_required") | ~usable | kogl.isin("KOGL-2", "KOGL-3", "KOGL-4")
    score = F.when(usable & ~review, 10).when(explicit & complete, 7).when(complete, 3).otherwise(0)
    return F.struct(score.alias("score"), usable.alias("usable"), review.alias("needs_review"), hard.alias("hard"))


def preflight(rows: DataFrame, required: Sequence[str], flags: Sequence[str] = ("allowed_for_rag",)) -> DataFrame:
    """rows with the missing fields, flags that are no booleans, and a status for importing them."""
    missing = reasons(*[(blank(c(f)), f) for f in required])
    invalid = reasons(*[(~F.coalesce(c(f).cast("string"), F.lit("")).isin("true", "false"), f) for f in flags])
    status = (
        F.when(F.size("missing_fields") == len(required), "empty_record")
        .when(F.size("missing_fields") > 0, "missing_fields")
        .when(F.size("invalid_fields") > 0, "invalid_fields")
        .when(c("copyright_status").isin(*NOT_CLEARED), "rights_unclear")
        .when(c("review_status") != "reviewed", "needs_review")
        .otherwise("ready")
    )
    return rows.withColumns({"missing_fields": missing, "invalid_fields": invalid}).withColumn("status", status)


def quality_decision(profile: X.Profile, barrier: str, error: str, search: str) -> Column:
    """The first that holds: empty, access barrier, error page, short search page, irrelevant, too short, metadata only, short, accepted."""
    text = X.collapse(c("text"))
    n = F.length(text)
    return (
        F.when(text == "", "rejected_empty")
        .when(text.rlike(barrier), "rejected_access_barrier")
        .when(text.rlike(error), "rejected_quality")
        .when(text.rlike(search) & (n < 300), "rejected_quality")
        .when(F.size(relevance(profile)) == 0, "rejected_irrelevant")
        .when(n < 50, "rejected_quality")
        .when(c("document_type") == "metadata_document", "accepted_metadata_only")
        .when(n < 300, "needs_review")
        .otherwise("accepted")
    )


def relevance(profile: X.Profile, place_hits: int = 2) -> Column:
    """Reasons why a text is about the places and history of the profile; none if it isn't."""
    both = X.collapse(F.concat_ws(" ", "title", "text"))
    first, others = profile.places[0], profile.places[1:]
    hits = X.occurrences(both, [first])
    return reasons(
        (X.any_of(c("title"), profile.places), "title_place_match"),
        (X.any_of(both, others), "specific_place"),
        (hits >= place_hits, "place_repeated"),
        ((hits >= 1) & X.any_of(both, profile.history_terms), "place_history_link"),
    )


def tier_reliability(tier: Column) -> Column:
    return F.when(tier == "tier_1", 20).when(tier == "tier_2", 16).when(tier == "tier_3", 11).when(tier == "tier_4", 3)


def access_barrier() -> Column:
    """Whether a fetched page is a login, captcha or paywall page, by its address and markup."""
    path = F.lower(F.coalesce(F.parse_url(c("url"), F.lit("PATH")), F.lit("")))
    return path.rlike(r"(?:^|[/_.-])(?:login|signin|captcha|paywall)(?:$|[/_.-])") | F.lower(c("html")).rlike(r"<input[^>]+type=[\"']?password|g-recaptcha|class=[\"'][^\"']*paywall")


def allowed_url(url: Column, hosts: Sequence[str]) -> Column:
    """https, no credentials, and a listed host or one below it."""
    host = F.lower(F.regexp_extract(url, r"^[a-zA-Z]+://(?:[^@/]*@)?([^/:?#]+)", 1))
    listed = F.lit(False)
    for h in hosts:
        listed = listed | (host == h) | F.endswith(host, F.lit(f".{h}"))
    return url.rlike(r"(?i)^https://") & ~url.rlike(r"^[a-zA-Z]+://[^/]*@") & listed


def development_errors(opted_in: Sequence[str] = ()) -> Column:
    """What is against a row in the development lane; a pending one needs its id listed."""
    tier = c("approval_tier")
    pending = tier == "development_pending_review"
    return reasons(
        (~F.coalesce(tier.isin("development_approved", "development_pending_review"), F.lit(False)), "approval_tier"),
        (c("data_classification") != "real_historical_source", "data_classification"),
        (c("is_fixture"), "is_fixture"),
        (~c("development_only"), "development_only"),
        (c("production_approved"), "production_approved"),
        (c("public_release_allowed"), "public_release_allowed"),
        (blank(c("citation_url")), "citation_url"),
        (blank(c("content_sha256")), "content_sha256"),
        ((tier == "development_approved") & (blank(c("development_approved_by")) | blank(c("development_approved_at"))), "approval_record"),
        (pending & ~c("document_id").isin(*(opted_in or [""])), "pending_without_opt_in"),
    )


def lane_violations(rows: DataFrame, lane: str) -> DataFrame:
    """Rows of other lanes; a caller must find none before mixing."""
    return rows.where(~c("lane").eqNullSafe(F.lit(lane)))


def reuse_decision(today: Column) -> Column:
    """Whether a stored page can be used again: forced, failed before, missing, changed or past its review date, or reused."""
    changed = ~c("canonical_url").eqNullSafe(c("expected_url")) | blank(c("content_hash")) | (F.coalesce(c("review_after"), F.lit("")) < today)
    return (
        F.when(c("force"), "forced")
        .when(c("collection_status") == "failed", "previous_failed")
        .when(~F.coalesce(c("collection_status").isin("collected", "reused", "skipped_existing"), F.lit(False)), "missing_raw")
        .when(changed, "hash_mismatch")
        .when(c("stored_hash").isNull(), "missing_raw")
        .when(c("stored_hash") == c("content_hash"), "reused")
        .otherwise("hash_mismatch")
    )


def promotion_errors() -> Column:
    """What is against making a candidate a verified document."""
    return reasons(
        (c("review_status") != "verified", "not_verified"),
        (c("source_tier") == "tier_4", "tier_4"),
        (c("total_score") < 75, "below_75"),
        (~F.coalesce(c("rights_status").isin(*RIGHTS_ALLOWED), F.lit(False)), "rights"),
        (c("human_review_required"), "rights_review_open"),
        ((F.size("rejection_reasons") > 0) | (c("duplicate_status") == "confirmed"), "rejected_or_duplicate"),
        (blank(c("verified_by")) | blank(c("verification_notes")), "no_reviewer"),
    )


def training_eligible() -> Column:
    """A conversation may be trained on if it says so, all its evidence allows it, and the assistant speaks last."""
    return c("training_eligible") & F.forall(c("source_evidence"), lambda e: F.coalesce(e["allowed_for_training"], F.lit(False))) & (F.element_at(c("messages"), -1)["role"] == "assistant")


def intent(question: Column, patterns: Sequence[tuple[str, str]]) -> Column:
    """The first intent whose pattern occurs, else overview."""
    out = None
    for name, pattern in patterns:
        out = F.when(question.rlike(pattern), name) if out is None else out.when(question.rlike(pattern), name)
    return out.otherwise("overview")


#: Intents of questions, in this order.
INTENTS = (
    ("current", r"지금|현재|오늘날"),
    ("time", r"언제|시기|연도|날짜|건립|설립|개통|준공"),
    ("cause", r"왜|이유|원인|배경|계기"),
    ("role", r"무슨\s*일|무엇을\s*했|뭘\s*했|어떤\s*활동|활동을\s*했|역할|어디에\s*쓰"),
    ("people", r"누구|누가|인물|사람"),
    ("place", r"어디|장소|지역"),
    ("result", r"그\s*뒤|이후|다음|결과|영향|변했|달라졌"),
)


def first_case(text: Column, cases: Sequence[tuple[str, Sequence[str]]], default: str) -> Column:
    """The label of the first case of which any term occurs; the order of cases is their priority."""
    out = None
    for label, terms in cases:
        out = F.when(X.any_of(text, terms), label) if out is None else out.when(X.any_of(text, terms), label)
    return out.otherwise(default)


def campaign_relevant(title: Column, text: Column, places: Sequence[str], history: Sequence[str], barriers: Sequence[str], least: int = 400) -> Column:
    """Long enough once collapsed, no barrier term in any case, at least one place and one term of history."""
    whole = X.collapse(F.concat_ws(" ", F.coalesce(title, F.lit("")), F.coalesce(text, F.lit(""))))
    barred = X.present(F.lower(whole), [b.lower() for b in barriers]) > 0
    return (F.length(whole) >= least) & ~barred & (X.present(whole, places) > 0) & (X.present(whole, history) > 0)


def covers(supported: Column, requested: Column) -> Column:
    """Every requested item is a supported one; none requested is covered."""
    return F.size(F.array_except(requested, supported)) == 0
