"""Catalogue acceptance against a loop over rows; failures and relevance on hand-made rows."""

import hashlib
import random
import re

from pyspark.sql import functions as F

from lamplight.operators import dedup, evaluation, policy
from lamplight.plans import audit_queries, registry  # noqa: F401


def accepted(rows):
    """[(id, duplicate)] of (id, url, content, title) in order."""
    kept, out = [], []
    for i, url, content, title in rows:
        words = set(re.findall(r"[0-9A-Za-z가-힣]+", (title or "").lower()))
        dup = any((url and url == u) or (content and content == c) or (words | w and len(words & w) / len(words | w) >= 0.9) for u, c, w in kept)
        out.append((i, dup))
        if not dup:
            kept.append((url, content, words))
    return out


def test_catalogue_against_a_loop(spark):
    draw = random.Random(4)
    words = [f"w{i}" for i in range(14)]
    rows = [(0, None, None, None), (1, "", "", "")]
    for i in range(2, 90):
        title = [w for w in words if draw.random() < 0.9]
        draw.shuffle(title)
        rows.append((i, f"u{draw.randrange(60)}" if draw.random() < 0.5 else "", f"c{draw.randrange(60)}" if draw.random() < 0.5 else None, " ".join(title)))
    df = spark.createDataFrame(rows, "id long, url string, content string, title string")
    got = dedup.catalogue_accepted(df, "id", F.col("url"), F.col("content"), F.col("title")).collect()
    assert sorted((r.id, r.dup_of is not None) for r in got) == accepted(rows)
    assert all(r.dup_of is None or r.dup_of < r.id for r in got) and {r.dup_method for r in got} > {"title"}


def test_catalogue_query(spark, folder):
    pages = spark.read.parquet(f"{folder}/pages.parquet").orderBy("page_id").collect()
    title = lambda html: m.group(1) if (m := re.search(r"(?is)<title>(.*?)</title>", html or "")) else ""
    rows = [(p.page_id, p.url, p.html is not None and hashlib.sha256(p.html.encode()).hexdigest(), title(p.html)) for p in pages]
    got = registry.QUERIES["catalogue_accepted"](spark, folder).collect()
    assert sorted((r.page_id, r.dup_of is not None) for r in got) == accepted(rows)


def test_failures(spark):
    # A Latin letter before the last full stop counts as a cut, so these end otherwise.
    turns = [
        ("All is well!", "answered", True, 1, 1, "answerable", None, ""),
        ("Cut (off", "answered", True, 1, 0, "out_of_scope", "a", "b"),
        ("근거가 없습니다.", "insufficient_evidence", False, 0, 0, "answerable", "a", "a"),
        ("근거가 없습니다.", "insufficient_evidence", False, 0, 0, "out_of_scope", None, None),
    ]
    names = "answer string, status string, grounded boolean, n_evidence int, n_sources int, answerability string, expected_query string, search_query string"
    got = evaluation.failure_counts(spark.createDataFrame(turns, names)).first().asDict()
    assert got == dict(
        turns=4, complete=3, grounded_contract=3, context_total=2, context_pass=1, out_of_scope_total=2, out_of_scope_pass=1, truncation_failure=1,
        hallucination=1, contextualization_failure=1, out_of_scope_failure=1, retrieval_failure=1, fallback_failure=1,
    )
    none = evaluation.failure_counts(spark.createDataFrame([], names)).first()
    assert none.turns == none.fallback_failure == 0


def test_relevance_and_subsets(spark):
    df = spark.createDataFrame([("t", "harbour opened " + "x" * 400), ("t", "harbour opened"), ("t", "harbour opened log IN " + "x" * 400), (None, None)], "title string, text string")
    assert [r[0] for r in df.select(policy.campaign_relevant(F.col("title"), F.col("text"), ["harbour"], ["opened"], ["Log in"])).collect()] == [True, False, False, False]
    sets = spark.createDataFrame([(["a", "b"], ["a"]), (["a"], ["a", "b"]), (["a"], [])], "have array<string>, want array<string>")
    assert [r[0] for r in sets.select(policy.covers(F.col("have"), F.col("want"))).collect()] == [True, False, True]
