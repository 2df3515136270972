"""From registered sources to reviewed, indexable chunks."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lamplight.functions import text as X
from lamplight.functions.udfs import nfc
from lamplight.operators import chunking, lifecycle, policy

Remover = Callable[[Column], Column]


def cleaned(docs: DataFrame, text_col: str = "text", drop_page_numbers: bool = True, removers: Sequence[tuple[str, Remover]] = ()) -> DataFrame:
    """docs with text_clean and cleaning_log, the names of the steps that changed something, in order.

    Steps: normal form C, one kind of line end, single spaces and no space at line ends,
    no lines of one to four digits alone, the given removers, one empty line at most.
    """
    spaces = lambda t: F.array_join(F.transform(F.split(t, "\n"), lambda s: F.regexp_replace(F.regexp_replace(s, r"[ \t]+", " "), r"(?U)^[\s\x1C-\x1F]+|[\s\x1C-\x1F]+$", "")), "\n")
    steps: list[tuple[str, Remover]] = [("nfc", nfc), ("line_ends", lambda t: F.regexp_replace(t, "\r\n|\r", "\n")), ("spaces", spaces)]
    if drop_page_numbers:
        steps.append(("page_numbers", lambda t: F.array_join(F.filter(F.split(t, "\n"), lambda s: ~s.rlike(r"^(?U)\d{1,4}$")), "\n")))
    steps += list(removers)
    steps.append(("blank_lines", lambda t: F.regexp_replace(F.regexp_replace(t, r"\n{3,}", "\n\n"), r"(?U)^\s+|\s+$", "")))
    out, before = docs.withColumn("_0", F.coalesce(text_col, F.lit(""))), "_0"
    for i, (_, step) in enumerate(steps, 1):  # each step is a column, read by the next and by the log
        out = out.withColumn(f"_{i}", step(F.col(before)))
        before = f"_{i}"
    log = X.reasons(*[(F.col(f"_{i}") != F.col(f"_{i - 1}"), name) for i, (name, _) in enumerate(steps, 1)])
    return out.withColumns({"text_clean": F.col(before), "cleaning_log": log}).drop(*[f"_{i}" for i in range(len(steps) + 1)])


#: State of a source after each step of its way.
STATES = ("draft", "extracted", "cleaned", "metadata_added", "reviewed", "rejected")


def processed(sources: DataFrame, texts: DataFrame, most: int = 800, overlap: int = 80) -> DataFrame:
    """Chunks of the valid sources: source metadata with chunk_index, chunk_id, text and offsets.

    sources: document_id and the fields of policy.document_errors; texts: document_id, text.
    """
    valid = sources.where(F.size(policy.document_errors()) == 0)
    clean = cleaned(texts.join(valid.select("document_id"), "document_id", "left_semi")).select("document_id", F.col("text_clean").alias("text"))
    chunks = chunking.paragraph_chunks(clean, "document_id", "text", most, overlap)
    return chunks.withColumn("content_sha256", F.sha2(F.col("text").cast("binary"), 256)).join(valid, "document_id")


def reviewed(sources: DataFrame, decisions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(sources with the decisions taken, audit rows).

    decisions: document_id, decision (approve or reject), reviewer, decided_at, notes.
    Only a source that has been processed can be decided on; without reviewer none is.
    """
    named = decisions.where(~X.blank(F.col("reviewer")) & F.col("decision").isin("approve", "reject"))
    rows = sources.join(named, "document_id", "left")
    ready = F.col("review_status").isin("metadata_added", "reviewed", "rejected") & F.col("decision").isNotNull()
    state = F.when(ready, F.when(F.col("decision") == "approve", "reviewed").otherwise("rejected")).otherwise(F.col("review_status"))
    keep = lambda new, old: F.when(ready, F.col(new)).otherwise(F.col(old))
    decided = {"reviewed_by": keep("reviewer", "reviewed_by"), "reviewed_at": keep("decided_at", "reviewed_at"), "verification_notes": keep("notes", "verification_notes")}
    after = rows.withColumns(decided | {"_state": state}).withColumn("review_status", F.col("_state")).select(*sources.columns)
    audit = rows.where(ready).select("document_id", "decision", "reviewer", "decided_at", "notes", F.col("review_status").alias("previous_status"))
    return after, audit


def eligible(chunks: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(chunks that may be served, documents that may not with their reasons)."""
    marked = chunks.withColumn("reasons", policy.eligibility_reasons())
    rejected = marked.where(F.size("reasons") > 0).select("document_id", "reasons").distinct()
    return marked.where(F.size("reasons") == 0).drop("reasons"), rejected


def prepared(chunks: DataFrame, before: DataFrame, prior_tombstones: DataFrame, at: str) -> dict[str, DataFrame]:
    """The next index: its chunks, document states, changes and tombstones.  before: the states of the last one."""
    kept = lifecycle.build_dedup(eligible(chunks)[0])
    state = lifecycle.document_state(kept)
    changes = lifecycle.state_changes(before, state)
    return {"chunks": kept, "state": state, "changes": changes, "tombstones": lifecycle.tombstones(prior_tombstones, changes, at)}


def lane_errors(lane: str, notice: str = "", opted_in: Sequence[str] = ()) -> Column:
    """What is against a row in a lane; rows of different lanes never mix.

    index_ready needs review, permission, rights and reliability; fixture rows say that
    they are; provisional and verified rows are allowed for nothing else; development has
    rules of its own.
    """
    c = F.col
    not_ = lambda test: ~F.coalesce(test, F.lit(False))
    if lane == "index_ready":
        return X.reasons(
            (not_(c("active")), "inactive"),
            (not_(c("review_status") == "reviewed"), "not_reviewed"),
            (not_(c("allowed_for_rag")), "not_allowed"),
            (not_(~c("copyright_status").isin("unknown", "restricted")), "rights"),
            (not_(c("source_reliability").isin("A", "B")), "reliability"),
            (X.blank(c("reviewed_by")) | X.blank(c("reviewed_at")), "no_review_record"),
            (c("data_classification") == "fictional_fixture", "fixture"),
            (c("development_only"), "development"),
        )
    if lane == "fixture":
        return X.reasons((not_(c("data_classification") == "fictional_fixture"), "no_fixture"), (not_(F.contains(c("text"), F.lit(notice))), "no_notice"))
    if lane in ("provisional", "verified_hackathon"):
        usage = "provisional_hackathon" if lane == "provisional" else "verified_hackathon"
        return X.reasons(
            (not_(c("usage_status") == usage), "usage_status"),
            (X.blank(c("rights_status")), "rights_status"),
            (not_(~c("allowed_for_training")), "training"),
            (not_(~c("production_approved")) if lane == "verified_hackathon" else not_(~c("allowed_for_rag")), "production"),
        )
    if lane == "development_real":
        return policy.development_errors(opted_in)
    raise ValueError(f"no lane {lane}")
