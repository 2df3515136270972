"""Operators on small rows whose results are known by hand."""

import json
import math
from difflib import SequenceMatcher

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lamplight.functions import text as X
from lamplight.functions import udfs
from lamplight.functions import vectors as V
from lamplight.operators import aggregates, chunking, dedup, evaluation, evidence, lifecycle, policy, quality, search, session
from lamplight.sources import tables


def one(spark, expression, **columns):
    df = spark.createDataFrame([tuple(columns.values())], list(columns)) if columns else spark.range(1)
    return df.select(expression.alias("x")).first().x


def test_white_space_is_unicode(spark):
    assert one(spark, X.collapse(F.col("t")), t="\u00a0 a\u3000\x1cb \t\n") == "a b"


def test_features_of_hangul_have_two_and_three_grams(spark):
    assert one(spark, X.tokenize(F.col("t")), t="목포항 Port a 목포항 x1") == ["목포항", "목포", "포항", "port", "x1"]
    assert one(spark, X.tokenize(F.col("t")), t="가 é") == []


def test_content_words_lose_the_first_listed_suffix(spark):
    assert one(spark, X.content_words(F.col("t"), X.KOREAN), t="목포에서는 건물을 학교으로 지은 누구야") == ["목포에서", "학교"]
    assert one(spark, X.content_words(F.col("t"), X.Profile(suffixes=("ab", "b"), stop_words=("zz",))), t="xxab xab yb zz") == ["xx", "xa", "yb"]


def test_sentences_keep_initials(spark):
    assert one(spark, X.sentences(F.col("t")), t="J. Smith came. He left!\n\nWhy?  ") == ["J. Smith came.", "He left!", "Why?"]


def test_redaction_order(spark):
    text = "see https://a.b/c?x=me@h.com, mail x.y@mail.com, 010-1234-5678, 192.168.0.1, C:\\dir\\f, key api_key=abc " + "a" * 32
    out = one(spark, X.redact(F.col("t")), t=text)
    assert out.count("[URL 제거]") == 1 and "[이메일 제거]" in out and "[전화번호 제거]" in out and "[내부 주소 제거]" in out and "[경로 제거]" in out and "[비밀정보 제거]" in out and out.endswith("[세션 식별자 제거]")


def test_truncation(spark):
    assert one(spark, X.truncate(F.col("t"), 5), t="abc def") == "abc…" and one(spark, X.truncate(F.col("t"), 7), t="abc def") == "abc def"


def test_windows(spark):
    text = "x" * 150 + " key " + "y" * 300 + ". Other key here."
    got = one(spark, X.keyword_windows(F.col("t"), "key"), t=text)
    assert len(got) == 2 and got[0].startswith("…") and got[0].endswith("…") and len(got[0]) == 262 and got[1] == "Other key here."


def test_core_text(spark):
    assert one(spark, X.core_lines(F.col("t"), ["MENU"]), t="a\nb https://x.y/z\na\nMENU c") == "a b c"
    assert one(spark, X.core_between(F.col("t"), "START", ["END"], 5), t="junk START text END more") == "START text"


def test_fields(spark):
    assert one(spark, X.labelled_field(F.col("t"), "Author", ["Date"]), t="Title: A | Author: Kim Date: 2024") == "Kim"
    assert one(spark, X.table_field(F.col("t"), "단체"), t="<table><th>단체</th><td><b>모임</b> 하나</td></table>") == "모임 하나"


@pytest.mark.parametrize(("text", "whole"), [("Done!", True), ("Latin end.", False), ("끝났다.", True), ("Open (bracket", False), ("(a [b] c)", True), ("ends,", False), ("by J.", False), ("", False), ("a) b", True), ("(a]", False)])
def test_completeness(spark, text, whole):
    assert one(spark, X.is_complete(F.col("t")), t=text) is whole


def test_repeats_and_numbers(spark):
    assert one(spark, X.repeated_sentences(F.col("t")), t="A b.  A  b. C.") == 1
    assert one(spark, X.unsupported_numbers(F.col("a"), F.col("e")), a="in 1897 and 1910", e="1897 only") == ["1910"]


def test_urls(spark):
    url = "HTTPS://User@Example.ORG:8080/a?b=2&utm_source=x&a=1+2&a=%C3%A9#f"
    assert one(spark, udfs.canonical_url(F.col("u")), u=url) == "https://example.org:8080/a?a=1+2&a=%C3%A9&b=2"
    assert one(spark, udfs.canonical_url_with_port(F.col("u")), u=url).startswith("https://user@example.org:8080/a?")
    assert one(spark, udfs.canonical_url(F.col("u")), u="http://h:443") == "http://h/" and one(spark, udfs.canonical_url_with_port(F.col("u")), u="http://h:443") == "http://h:443/"
    assert one(spark, X.plain_url(F.col("u")), u=" Http://A/B// ") == "http://a/b"


def test_helpers_on_values(spark):
    assert one(spark, udfs.nfc(F.col("t")), t="e\u0301") == "é"
    assert one(spark, udfs.stable_json_hash(F.col("t")), t='{"b":1,"a":"é"}') == one(spark, udfs.stable_json_hash(F.col("t")), t='{ "a": "é", "b": 1 }')
    assert one(spark, udfs.flattened_json(F.col("t")), t='{"a":[1,{"b":" x "}],"c":""}') == "1\nx"
    assert one(spark, udfs.urls_in_json(F.col("t")), t='{"a":["http://x","y","http://x"]}') == ["http://x"]
    assert one(spark, udfs.decoded_body(F.col("t")), t="목포".encode("cp949")) == "목포"
    long = ("ab" * 150, "ba" * 150)
    assert one(spark, udfs.similarity_ratio(F.col("a"), F.col("b")), a=long[0], b=long[1]) == SequenceMatcher(None, *long).ratio()
    assert one(spark, udfs.strict_similarity_ratio(F.col("a"), F.col("b")), a=long[0], b=long[1]) == SequenceMatcher(None, *long, autojunk=False).ratio()


def test_licence_codes_and_ids(spark):
    assert [one(spark, X.licence_code(F.col("t")), t=t) for t in ("공공누리 제1유형", "kogl_2", "CC BY")] == ["KOGL-1", "KOGL-2", "CCBY"]
    assert len(one(spark, X.derived_id(F.lit("a"), F.lit("b")))) == 20


def test_chunkers(spark):
    df = spark.createDataFrame([(1, "x" * 1000), (2, "short"), (3, "")], "doc_id long, text string")
    fixed = {(r.doc_id, r.chunk_id): len(r.text) for r in chunking.fixed_chunks(df).collect()}
    assert fixed == {(1, "1::chunk-0"): 500, (1, "1::chunk-1"): 500, (1, "1::chunk-2"): 100, (2, "2"): 5, (3, "3"): 0}
    with pytest.raises(ValueError):
        chunking.fixed_chunks(df, size=10, overlap=10)
    assert chunking.paragraph_spans("aa bb\n\ncc", 100, 0) == [(0, 5), (7, 9)]
    text = "One two three. Four five six seven eight nine."
    assert [text[a:b] for a, b in chunking.paragraph_spans(text, 20, 0)] == ["One two three. ", "Four five six seven ", "eight nine."]
    assert chunking.paragraph_spans("aaaa bbbb\n\ncccc", 100, 6)[1][0] == 5
    assert chunking.sliding_spans("a" * 30, 20, 5) == [(0, 20), (15, 30)] and chunking.sliding_spans("abc. " * 8, 22, 2)[0] == (0, 20)
    rows = chunking.paragraph_chunks(df).collect()
    assert [(r.doc_id, r.chunk_id) for r in rows if r.doc_id == 2] == [(2, "2::chunk-0000")] and sum(r.doc_id == 1 for r in rows) == 2


def test_packed_paragraphs(spark):
    got = one(spark, chunking.packed_paragraphs(F.col("p"), 10, 4), p=["aaaa", "bbbb", "cccc", "dd", "e. f. gggggg", "h"])
    assert got == ["aaaa\nbbbb", "cccc\ndd\ne.", "f.\ngggggg\nh"]


def test_bm25_and_fusion(spark):
    docs = {1: ["a", "b", "c"], 2: ["a"], 3: ["d", "e"]}
    chunks = spark.createDataFrame(list(docs.items()), "chunk_id long, tokens array<string>")
    asked = spark.createDataFrame([(9, ["a", "c", "zz"]), (8, [])], "query_id long, tokens array<string>")
    got = {r.chunk_id: r.score for r in search.bm25(chunks, asked, 5).collect()}
    idf = {t: math.log(1 + (3 - n + 0.5) / (n + 0.5)) for t, n in (("a", 2), ("c", 1))}
    part = lambda n: 2.5 / (1 + 1.5 * (0.25 + 0.75 * n / 2))
    assert got == {1: pytest.approx((idf["a"] + idf["c"]) * part(3)), 2: pytest.approx(idf["a"] * part(1))}
    ranked = spark.createDataFrame([(9, 1, 0.9, 1), (9, 2, 0.8, 2)], "query_id long, chunk_id long, score double, rank int")
    fused = {r.chunk_id: r for r in search.reciprocal_rank_fusion(ranked, ranked.where("chunk_id = 1")).collect()}
    assert fused[1].score == pytest.approx(1.0) and fused[2].score == pytest.approx(11 / 24) and fused[1].methods == ["dense", "sparse"] and fused[2].sparse_score == 0


def test_thresholds(spark):
    rows = [(1, 10, i, s, d) for i, (s, d) in enumerate([(0.9, 0.0), (0.8, 0.0), (0.7, 0.0), (0.1, 0.9)])] + [(1, 20, 9, 0.5, 0.8)]
    df = spark.createDataFrame(rows, "query_id long, document_id long, chunk_id long, score double, dense_score double")
    kept = search.thresholds(df, F.lit(True), per_document=2, limit=3).orderBy("rank").collect()
    assert [r.chunk_id for r in kept] == [0, 1, 9] and [r.chunk_id for r in search.thresholds(df, F.lit(False)).collect()] == [9]


def test_coverage(spark):
    asked = spark.createDataFrame([(1, ["a", "b", "c"]), (2, ["a", "b"])], "query_id long, words array<string>")
    found = spark.createDataFrame([(1, ["a"]), (1, ["b"]), (2, ["b"])], "query_id long, words array<string>")
    assert search.coverage_gate(found, asked).count() == 3
    assert search.coverage_gate(found.where("words[0] = 'b'"), asked).select("query_id").distinct().collect()[0].query_id == 2


def test_vectors(spark):
    assert one(spark, V.cosine(F.array(F.lit(1.0), F.lit(0.0)), F.array(F.lit(0.0), F.lit(0.0)))) == 0.0
    with pytest.raises(Exception, match="different dimensions"):
        one(spark, V.cosine(F.array(F.lit(1.0)), F.array(F.lit(1.0), F.lit(2.0))))
    df = spark.createDataFrame([(1, "목포항 port"), (2, "!")], "chunk_id long, text string")
    rows = search.hashed_vectors(df).collect()
    assert {r.chunk_id for r in rows} == {1} and sum(r.weight**2 for r in rows) == pytest.approx(1)


def test_blocks_of_queries_find_the_same(spark, folder, monkeypatch):
    docs = spark.read.parquet(f"{folder}/documents.parquet").select(F.col("doc_id").alias("chunk_id"), "text")
    asked = spark.read.parquet(f"{folder}/benchmark.parquet").select(F.col("item_id").alias("query_id"), "text")
    a, b = search.hashed_vectors(docs).cache(), search.hashed_vectors(asked, id_col="query_id").cache()
    take = lambda: {(r.query_id, r.rank): (r.chunk_id, round(r.score, 9)) for r in search.hashed_search(a, b, 7).collect()}
    by_matrix = take()
    monkeypatch.setattr(search, "BROADCAST_ROWS", 300)
    assert by_matrix == take() and len(by_matrix) == 7 * asked.count()
    assert search.hashed_search(a, b.where("query_id < 0"), 3).count() == 0


def test_chunks_without_a_common_slot_are_results(spark, monkeypatch):
    chunks = spark.createDataFrame([(f"c{i}", i % 3, 1.0 if i < 6 else -1.0) for i in range(9)], "chunk_id string, slot long, weight double")
    asked = spark.createDataFrame([(1, 0, -1.0), (2, 1, 1.0)], "query_id long, slot long, weight double")
    for rows in (100, 1):
        monkeypatch.setattr(search, "BROADCAST_ROWS", rows)
        got = {(r.query_id, r.rank): (r.chunk_id, r.score) for r in search.hashed_search(chunks, asked, 3).collect()}
        assert got == {(1, 1): ("c6", 1.0), (1, 2): ("c1", 0.0), (1, 3): ("c2", 0.0), (2, 1): ("c1", 1.0), (2, 2): ("c4", 1.0), (2, 3): ("c0", 0.0)}


def test_upsert_keeps_the_newest_row_of_each_key(spark, tmp_path):
    from lamplight.streaming.memory import upsert_sink

    path = f"file://{tmp_path}/table"
    write = upsert_sink(path, "k", order="at", buckets=4)
    batch = lambda *rows: spark.createDataFrame(rows, "k string, at long, v string")
    now = lambda: sorted((r.k or "", r.at, r.v) for r in spark.read.parquet(path).collect())
    write(batch(("a", 1, "x"), ("a", 2, "y"), ("b", 1, "z"), (None, 1, "n")), 0)
    assert now() == [("", 1, "n"), ("a", 2, "y"), ("b", 1, "z")]
    files = {f.path for f in spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path").collect()}
    write(batch(("a", 3, "new"), (None, 2, "m")), 1)
    expected = [("", 2, "m"), ("a", 3, "new"), ("b", 1, "z")]
    assert now() == expected
    write(batch(("a", 3, "new"), (None, 2, "m")), 1)  # the same batch again
    assert now() == expected
    bucket = {r.bucket for r in spark.read.parquet(path).where("k = 'b'").collect()}
    others = {r.bucket for r in spark.read.parquet(path).where("k <> 'b' or k is null").collect()}
    if bucket - others:
        after = {f.path for f in spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path").collect()}
        assert any(f"bucket={b}" in f for b in bucket for f in files & after)
    write(batch(), 2)
    assert now() == expected


def test_greedy_retention(spark):
    rows = [(1, "u1", "b1"), (2, "u1", "b2"), (3, "u3", "b2"), (4, "u3", "b9"), (5, "", ""), (6, "", "")]
    df = spark.createDataFrame(rows, "id long, url string, body string")
    got = {r.id: (r.dup_method, r.dup_of) for r in dedup.retained_in_order(df, ["url", "body"], "id").collect()}
    assert got == {1: (None, None), 2: ("url", 1), 3: (None, None), 4: ("url", 3), 5: (None, None), 6: (None, None)}
    first = {r.id: r.dup_of for r in dedup.first_by_key(df, ["url", "body"], "id").collect()}
    assert first == {1: None, 2: 1, 3: 2, 4: 3, 5: None, 6: None}


def test_greedy_retention_of_a_long_chain(spark):
    rows = [(i, f"u{i // 2}", f"b{(i + 1) // 2}") for i in range(48)]
    got = {r.id: r.dup_of for r in dedup.retained_in_order(spark.createDataFrame(rows, "id long, url string, body string"), ["url", "body"], "id").collect()}
    assert got == {i: i - 1 if i % 2 else None for i in range(48)}


def plain_simhash(words):
    import hashlib

    votes = [0] * 64
    for i in range(max(1, len(words) - 2)):
        h = int.from_bytes(hashlib.sha256(" ".join(words[i : i + 3]).encode()).digest()[:8], "big")
        votes = [v + (1 if h >> b & 1 else -1) for b, v in enumerate(votes)]
    return sum(1 << b for b, v in enumerate(votes) if v >= 0)


def test_simhash(spark):
    texts = ["one two three four five", "a b", "", "One, two; three"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.fingerprint % (1 << 64) for r in dedup.simhash_rows(df, "doc_id", "text").collect()}
    assert got == {i: plain_simhash("".join(c if c.isalnum() else " " for c in t.lower()).split()) for i, t in enumerate(texts)}
    prints = spark.createDataFrame([(1, 0), (2, 0xFF), (3, 0x1FF), (4, -1), (5, 0)], "doc_id long, fingerprint long")
    near = {r.doc_id: (r.near_id, r.distance) for r in dedup.near_pairs(prints).collect()}
    assert near == {2: (1, 8), 3: (2, 1), 5: (1, 0)}


def test_similar_titles_against_all_pairs(spark):
    import random

    draw = random.Random(6)
    titles = ["a", "a", "b", "ab", "ba", "aaaaaaaaaa", "aaaaaaaaaab", "internationalisation", "internationalization", "목포항의옛모습과기록", "목포항의옛모습과기럭"]
    for _ in range(40):
        base = "".join(draw.choice("abcde ") for _ in range(draw.randint(3, 60))).strip()
        edited = list(base)
        for _ in range(max(1, len(base) // 12)):
            edited[draw.randrange(len(edited))] = draw.choice("abcdexyz")
        titles += [base, "".join(edited)]
    titles = [" ".join(t.split()) for t in titles]
    df = spark.createDataFrame(list(enumerate(titles)), "id long, title string")
    first = {t: i for i, t in reversed(list(enumerate(titles)))}
    alike = [(i, j) for j, b in enumerate(titles) for i, a in enumerate(titles[:j]) if a and b and a != b and SequenceMatcher(None, a, b).ratio() >= 0.88]
    want = {tuple(sorted((first[titles[i]], first[titles[j]]))) for i, j in alike} | {(first[t], i) for i, t in enumerate(titles) if t and first[t] < i}
    got = [(r.left_id, r.right_id) for r in dedup.similar_titles(df, "id", "title").collect()]
    assert len(got) == len(set(got)) and set(got) == want


def test_similar_titles_and_tokens(spark):
    df = spark.createDataFrame([(1, "the old harbour of the town"), (2, "The old harbour of the towns"), (3, "something else")], "id long, title string")
    assert [(r.left_id, r.right_id) for r in dedup.similar_titles(df, "id", "title").collect()] == [(1, 2)]
    sets = spark.createDataFrame([(1, list("abcdefghij")), (2, list("abcdefghij")), (3, list("abcdefghxy"))], "id long, t array<string>")
    assert [(r.left_id, r.right_id, r.jaccard) for r in dedup.token_jaccard(sets, "id", "t").collect()] == [(1, 2, 1.0)]


def test_many_equal_titles_give_as_many_links(spark):
    same = spark.range(20_000).select("id", F.when(F.col("id") % 2 == 0, "a title of the town").otherwise("A title of the towns").alias("title"))
    got = dedup.similar_titles(same, "id", "title")
    assert got.count() == 20_000 - 1 and got.where("left_id = 0 and right_id = 1").count() == 1
    sets = dedup.token_jaccard(same.select("id", F.split("title", " ").alias("t")), "id", "t")
    assert sets.count() == 20_000 - 2


GOOD = dict(
    document_id="d", title="t", source_type="web", publisher="p", local_path="l", language="ko", source_url="https://h/x", published_date="2024-01-02", accessed_date="", period_start=1, period_end=2, review_status="reviewed",
    reviewed_by="k", reviewed_at="2024-01-02", verification_notes="n", copyright_status="public_domain", allowed_for_rag=True, allowed_for_training=False, attribution_required=False, attribution_text="", source_reliability="A",
)


def policy_row(spark, expression, **changes):
    df = spark.createDataFrame([T.Row(**(GOOD | changes))])
    return df.select(expression.alias("x")).first().x


def test_policies(spark):
    assert policy_row(spark, policy.eligibility_reasons()) == [] and policy_row(spark, policy.document_errors()) == [] and policy_row(spark, policy.service_ready())
    bad = policy_row(spark, policy.eligibility_reasons(), review_status="draft", allowed_for_rag=False, source_reliability="", source_url="ftp://x", copyright_status="unknown", attribution_required=True, reviewed_by=" ")
    assert bad == ["review_status=draft", "allowed_for_rag=false", "source_reliability=missing", "invalid:source_url", "copyright_status=unknown", "attribution_text_required", "missing:attribution_text", "missing:reviewed_by"]
    assert policy_row(spark, policy.document_errors(), published_date="2024-13-01", period_start=5, reviewed_at="x") == ["bad_date:published_date", "period_order", "bad_date:reviewed_at"]
    assert policy_row(spark, policy.licence_errors(), copyright_status="restricted", allowed_for_training=True) == ["rag_not_permitted", "training_not_permitted"]
    assert policy_row(spark, policy.service_ready(), source_reliability="") and not policy_row(spark, policy.service_ready(), source_reliability="C")


RIGHTS = dict(robots_status="allowed", policy_status="allowed", access_status="public", rights_status="open_license", kogl_type="KOGL-1", checked_at="2024", document_rights_url="u", policy_url="", license_text="", human_review_required=False)


@pytest.mark.parametrize(("changes", "score", "hard"), [({}, 10, []), ({"kogl_type": "KOGL 2", "license_text": "x"}, 7, []), ({"rights_status": "unknown"}, 3, []), ({"checked_at": ""}, 0, []), ({"robots_status": None, "access_status": "odd"}, 7, ["robots_blocked", "policy_blocked"]), ({"rights_status": "restricted", "access_status": "captcha"}, 3, ["captcha", "rights_restricted"])])
def test_rights(spark, changes, score, hard):
    df = spark.createDataFrame([T.Row(**(RIGHTS | changes))], ", ".join(f"{k} {'boolean' if k == 'human_review_required' else 'string'}" for k in RIGHTS))
    got = df.select(policy.rights_decision().alias("x")).first().x
    assert (got.score, got.hard) == (score, hard)


def test_quality(spark):
    rows = [("t", "a\nb\na\nlong line that is repeated\nlong line that is repeated", "success"), ("title", "title", "success"), ("t", "x" * 12, "success"), ("t", None, "failed")]
    got = quality.content_quality(spark.createDataFrame(rows, "title string, text string, extraction_status string"), X.KOREAN).collect()
    assert got[0].repeated_ratio == round((2 + 52) / (3 + 52), 4) and got[1].title_only and got[1].quality_score <= 3 and got[2].suspicious_repeats and got[2].noise
    assert not got[3].extraction_success and got[3].body_length == 0


def test_status_boundaries(spark):
    rights = "struct<score:int,usable:boolean,needs_review:boolean,hard:array<string>>"
    rows = [(75, [], (10, True, False, [])), (74, [], (10, True, False, [])), (60, [], (0, False, True, [])), (59, [], (0, False, True, [])), (90, ["x"], (10, True, False, ["x"])), (90, [], (7, True, True, []))]
    df = spark.createDataFrame(rows, f"total_score int, rejection_reasons array<string>, rights {rights}")
    assert [r.s for r in df.select(quality.score_status().alias("s")).collect()] == ["auto_candidate", "needs_human_review", "needs_human_review", "auto_rejected", "auto_rejected", "needs_human_review"]


def test_corroboration(spark):
    rows = [("s", "p", "x", "1897", "A"), (" s ", "p", "x", "1897", "B"), ("s", "q", "x", "1", "A"), ("s", "r", "x", "1", "A"), ("s", "r", "x", "2", "B"), ("s", "r", "x", "2", "C")]
    got = {r.predicate: r for r in aggregates.corroboration(spark.createDataFrame(rows, "subject string, predicate string, place string, normalized_value string, publisher_family string")).collect()}
    assert (got["p"].status, got["q"].status, got["r"].status) == ("corroborated", "single_source", "conflict")
    assert got["r"].supporting_sources == ["A", "B", "C"] and [x.value for x in got["r"].conflicting_values] == ["1", "2"]


GATE_ROW = dict(duplicate_status="", extraction_status="success", rights_status="open_license", relevance=3, noise=False, review_status="auto_candidate", publisher_family="", publisher="", topics=[])


def test_gate(spark):
    schema = "duplicate_status string, extraction_status string, rights_status string, relevance int, noise boolean, review_status string, publisher_family string, publisher string, topics array<string>"
    rows = [tuple((GATE_ROW | {"publisher_family": f"p{i % 4}", "topics": [f"t{i % 3}"]}).values()) for i in range(12)]
    good = aggregates.phase_gate(spark.createDataFrame(rows, schema), 10).first()
    assert good.gate_status == "PASS" and good.publisher_share == 0.25 and good.topic_share == 0.3333
    bad = aggregates.phase_gate(spark.createDataFrame([tuple((GATE_ROW | {"publisher_family": "p", "extraction_status": "failed", "noise": True}).values())] * 3, schema), 10).first()
    assert bad.gate_status == "STOP" and bad.stop_reasons == ["target_unique_not_met", "extraction_success_rate", "noise_rate", "publisher_share"]
    assert aggregates.phase_gate(spark.createDataFrame([], schema), 1).first().gate_status == "STOP"


def test_missing_values(spark):
    df = spark.createDataFrame([("", None, 0), ("x", "", 5), (None, None, None)], "a string, b string, n int")
    assert {r.field: r.n_missing for r in aggregates.missing_counts(df, {"ab": ["a", "b"], "n": ["n"]}).collect()} == {"ab": 2, "n": 1}


def test_index_states(spark):
    a = spark.createDataFrame([(1, "x"), (2, "y"), (3, "z")], "document_id long, h string")
    b = spark.createDataFrame([(1, "x"), (2, "Y"), (4, "w")], "document_id long, h string")
    changes = lifecycle.state_changes(a, b)
    assert {r.document_id: r.change for r in changes.collect()} == {1: "unchanged", 2: "changed", 3: "removed", 4: "added"}
    prior = spark.createDataFrame([(4, "d", "r"), (9, "d", "r"), (3, "d", "r")], "document_id long, removed_at string, reason string")
    assert {r.document_id: r.removed_at for r in lifecycle.tombstones(prior, changes, "now").collect()} == {9: "d", 3: "now"}


def test_index_dedup(spark):
    schema = "document_id long, chunk_index int, chunk_id string, text string, content_sha256 string, ord long"
    rows = [(1, 0, "a", "x  y", "h", 1), (1, 1, "b", "x y", "h", 2), (1, 1, "b", "z", "k", 3), (2, 0, "c", "x y", "h", 4)]
    df = spark.createDataFrame(rows, schema)
    assert [r.chunk_id for r in lifecycle.same_id_conflicts(df).collect()] == ["b"]
    assert sorted(r.ord for r in lifecycle.build_dedup(df.where("ord <> 3")).collect()) == [1, 4]
    # 2 is skipped for its text, and its id, not being kept, doesn't stop 3
    assert sorted(r.ord for r in lifecycle.read_dedup(df).collect()) == [1, 3]


def test_snapshot_hash_ignores_order(spark):
    df = spark.createDataFrame([(1, 'a"é', None), (2, "b", 3)], "chunk_id long, text string, n int")
    names = ["text", "n"]
    first = lifecycle.snapshot_hash(df, names).first()
    assert first == lifecycle.snapshot_hash(df.orderBy(F.desc("chunk_id")).repartition(3), names).first() and first != lifecycle.snapshot_hash(df.where("n is null"), names).first()
    want = json.dumps({"chunk_id": 1, "n": None, "text": 'a"é'}, sort_keys=True, separators=(",", ":"), ensure_ascii=False)
    import hashlib

    assert df.where("n is null").select(lifecycle.record_hash(["chunk_id", *names]).alias("h")).first().h == hashlib.sha256(want.encode()).hexdigest()


def test_support(spark):
    asked = spark.createDataFrame([(1, "old port", "opened"), (2, "old port", "closed"), (3, "old port", "burnt"), (4, "mill", "opened"), (5, "x", "y")], "query_id long, subject string, intent string")
    text = "The oldport opened in 1897. It closed late. Other things. A fire burnt it."
    found = spark.createDataFrame([(q, 1, 1, text) for q in (1, 2, 3, 4)], "query_id long, chunk_id long, rank int, text string")
    assert {r.query_id: r.support for r in evidence.direct_support(found, asked).collect()} == {1: "DIRECT", 2: "PARTIAL", 3: "RELATED_ONLY", 4: "NONE", 5: "NONE"}


def test_budget_skips_what_does_not_fit(spark):
    got = one(spark, evidence.budget(F.lit(10), F.array(F.lit("n" * 10)), F.array(F.lit("a" * 200), F.lit("b" * 20), F.lit("c" * 10)), F.array(F.lit("o" * 90), F.lit("p" * 20)), F.lit(45)))
    assert got.evidence == ["b" * 20, "c" * 10] and got.conversation == ["p" * 20, "n" * 10] and got.used == 40


def test_citations_and_memory(spark):
    found = spark.createDataFrame([(1, "d", "c1", 1, 0.12345678, "t" * 200), (1, "d", "c2", 2, 0.1, "u")], "query_id long, document_id string, chunk_id string, rank int, score double, text string")
    got = evidence.citations(found).collect()
    assert len(got) == 1 and len(got[0].excerpt) == 160 and got[0].retrieval_score == 0.123457
    memory = spark.createDataFrame([(1, "m1", 1), (1, "m2", 2)], "query_id long, chunk_id string, rank int")
    assert [r.chunk_id for r in evidence.remembered_first(found, memory).orderBy("rank").collect()] == ["m1", "c1", "c2", "m2"]


def test_summaries(spark):
    rows = [(1, i, f"u{i}" + "x" * 100, "a" * 100) for i in range(1, 8)]
    pairs = spark.createDataFrame(rows, "conv_id long, exchange long, user string, assistant string")
    summary = session.rolling_summary(pairs, history=2, limit=500).first().summary
    assert summary.count("[USER]") == 2 and summary.index("u4") < summary.index("u5") and len(summary) <= 500


def test_metrics(spark):
    cases = [("a", ["x"], True, False, ""), ("b", ["y"], True, False, ""), ("c", [], False, True, "")]
    df = spark.createDataFrame(cases, "case_id string, expected array<string>, should_answer boolean, should_refuse boolean, topic string")
    found = spark.createDataFrame([("a", "x", 1), ("b", "q", 1), ("b", "y", 6)], "case_id string, chunk_id string, rank int")
    got = evaluation.retrieval_metrics(df, found).first()
    assert (got.recall_at_1, got.recall_at_5, got.mrr, got.no_evidence_precision) == (0.5, 0.5, round((1 + 1 / 6) / 2, 4), 1.0)
    none = evaluation.retrieval_metrics(df.where("should_refuse"), found.where("rank > 9")).first()
    assert none.mrr == 0.0 and none.recall_at_1 == 0.0
    times = spark.createDataFrame([(float(i),) for i in range(1, 31)], "latency_ms double")
    assert evaluation.latency_summary(times).first().p95_latency_ms == sorted(range(1, 31))[math.ceil(0.95 * 30) - 1]


def test_leaks(spark):
    df = spark.createDataFrame([("s1", "t1", "train"), ("s2", "t1", "test"), ("s1", "t2", "train")], "scenario string, topic string, split string")
    assert [(r.kind, r.key) for r in evaluation.split_leaks(df, ["scenario", "topic"]).collect()] == [("topic", "t1")]


def test_sources(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"a": 1}\n\n{"a": 2}\n')
    assert tables.read_jsonl(spark, str(tmp_path / "a.jsonl"), "a int").count() == 2
    (tmp_path / "bad.jsonl").write_text('{"a": 1}\n{"a": \n')
    with pytest.raises(Exception, match="(?i)malformed"):
        tables.read_jsonl(spark, str(tmp_path / "bad.jsonl"), "a int").collect()
    (tmp_path / "bom.jsonl").write_bytes('\ufeff{"a": 7}\n'.encode())
    schema = T.StructType([T.StructField("a", T.IntegerType())])
    assert tables.read_jsonl_with_marks(spark, str(tmp_path / "bom.jsonl"), schema).first().a == 7
    (tmp_path / "d.json").write_text('{"documents": [{"id": "x"}, {"id": "y", "language": "en"}]}')
    rows = tables.read_documents_json(spark, str(tmp_path / "d.json"), T.StructType([T.StructField("id", T.StringType()), T.StructField("language", T.StringType())]))
    assert {(r.id, r.language) for r in rows.collect()} == {("x", "ko"), ("y", "en")}
    (tmp_path / "t").mkdir()
    (tmp_path / "t/n.md").write_text("# 제목")
    assert tables.read_text_files(spark, str(tmp_path / "t")).first().text == "# 제목"
    (tmp_path / "t/p.exe").write_text("x")
    with pytest.raises(Exception, match="no text extractor"):
        tables.read_text_files(spark, str(tmp_path / "t")).collect()
    body = spark.createDataFrame([('{"items": {"id": 1}}',), ('{"items": [{"id": 1}, {"id": 2}]}',)], "b string")
    item = T.StructType([T.StructField("id", T.IntegerType())])
    assert [len(r.x) for r in body.select(tables.json_items(F.col("b"), "$.items", item).alias("x")).collect()] == [1, 2]


def test_versions(spark, tmp_path):
    versions = tables.Versions(spark, f"file://{tmp_path}/index")
    a, b = versions.write(spark.range(3)), versions.write(spark.range(5))
    assert versions.read().count() == 5 and versions.read(a).count() == 3
    versions.rollback(a)
    assert versions.read().count() == 3 and versions.state()["versions"] == [a, b]
    with pytest.raises(ValueError, match="few"):
        versions.write(spark.range(1), check=lambda df: "few" if df.count() < 2 else None)
    assert versions.read().count() == 3


def test_conversation_stream(spark, folder, tmp_path):
    from lamplight.streaming.memory import conversation_memory

    batch = spark.read.parquet(f"{folder}/conversations.parquet")
    batch.write.parquet(str(tmp_path / "in"))
    turns = spark.readStream.schema(batch.schema).parquet(str(tmp_path / "in"))
    run = conversation_memory(turns, history=1).writeStream.format("memory").queryName("memory_out").option("checkpointLocation", str(tmp_path / "c")).start()
    run.processAllAvailable()
    run.stop()
    got = spark.table("memory_out").groupBy("conv_id").agg(F.max_by("summary", "turn").alias("summary"))
    pairs = session.exchanges(batch).where("assistant <> ''")
    want = {r.conv_id: r.summary for r in session.rolling_summary(pairs, history=1).collect()}
    assert {r.conv_id: r.summary for r in got.collect()} == {k: v for k, v in want.items()}


@pytest.mark.parametrize(
    ("message", "context", "kind", "sources"),
    [
        ("왜?", False, "MISSING_SUBJECT", False),
        ("hello", False, "UNINTELLIGIBLE_INPUT", False),
        ("오늘 날씨 어때?", False, "OUT_OF_HISTORY_SCOPE", False),
        ("휠체어로 갈 수 있나요?", False, "SAFETY_CAPABILITY_OVERRIDE", False),
        ("출처 알려줘", False, "SOURCE_REQUEST", True),
        ("그거 말이야", False, "AMBIGUOUS_NO_CONTEXT", False),
        ("쉽게 말해줘", True, "EXPLICIT_STYLE_REQUEST", True),
        ("쉽게 말해줘", False, "EXPLICIT_STYLE_REQUEST", False),
        ("이 건물 구조가 궁금해", False, "ARCHITECTURE_TOPIC", False),
        ("안녕", False, "GREETING", False),
        ("목포역", False, "ENTITY_ONLY_HISTORY_QUERY", True),
        ("1897년에는 무슨 일이 있었지?", False, "FACT_QUESTION", True),
    ],
)
def test_situations(spark, message, context, kind, sources):
    from lamplight.operators import dialogue

    df = spark.createDataFrame([(message, context)], "m string, c boolean").withColumn("s", dialogue.situation(F.col("m"), F.col("c")))
    got = df.select("s.reason", dialogue.needs_retrieval(F.col("s"), F.col("m"), F.col("c")).alias("needs")).first()
    assert (got.reason, got.needs) == (kind, sources)


def test_answer_guards(spark):
    from lamplight.operators import dialogue

    text = "목포항은 1897년 10월에 개항한 항구이다. 목포항은 1897년 10월에 개항한 항구이다. 목포항은 1897년 10월에 개항한 항구였다. 목포항은 1899년 10월에 개항한 항구였다."
    assert one(spark, dialogue.without_repeats("t"), t=text) == "목포항은 1897년 10월에 개항한 항구이다. 목포항은 1899년 10월에 개항한 항구였다."
    assert one(spark, dialogue.echoes_question("a", "q"), a="목포항은 언제 개항했나요.", q="목포항은 언제 개항했나요?") and not one(spark, dialogue.echoes_question("a", "q"), a="1897년이다.", q="왜?")
    assert one(spark, dialogue.complete_part(F.col("t")), t="First. Second! third (open") == "First. Second!"
    assert one(spark, dialogue.style_violations(F.col("t"), F.array(F.lit("a")), {"praise": "완벽해"}), t="완벽해 [출처: b]") == ["praise", "invented_citation"]


def test_page_text(spark):
    from lamplight.operators import candidates

    page = "<title>T</title><nav>no</nav><p>a</p><p>b</p><p>a</p><main><p>x  y</p><script>z</script><a href='/l' title='t'>link</a></main>"
    got = one(spark, candidates.visible_page("h"), h=page)
    assert got.title == "T" and got.text == "x y\nlink" and got.links[0].href == "/l"
    assert candidates.lines_without_near_repeats("a\nb\na\nc\nd\na") == "a\nb\nc\nd\na"


def test_selection_counts(spark):
    from lamplight.operators import candidates

    rows = [("https://a.kr/1", True, "s1", None, "unknown", "not_assessed"), ("https://b.kr/1", True, "s2", None, "unknown", "not_assessed"), ("https://a.kr/2", True, "s3", "s1", "unknown", "not_assessed")]
    df = spark.createDataFrame(rows, "source_url string, body_exists boolean, source_id string, duplicate_of string, kogl_type string, rights_grade string")
    assert [r.source_id for r in candidates.provisional_selection(df, ("a.kr",), 1, 2).where("selected").collect()] == ["s1"]
    with pytest.raises(ValueError):
        candidates.provisional_selection(df, ("a.kr",), 2)


def test_titles_meet_as_matrices_with_bounded_blocks(spark, monkeypatch):
    from difflib import SequenceMatcher

    titles = [f"{'abcdefgh'[i % 8] * 2} harbour of {'mnop'[i % 4]} town {i // 3}" for i in range(60)] + ["x", "y", "목포항의 역사와 인물 이야기", "목포항의 역사와 인물 이야기들"]
    both = {frozenset((a, b)) for a in titles for b in titles if a < b and max(SequenceMatcher(None, a, b).ratio(), SequenceMatcher(None, b, a).ratio()) >= 0.88}
    df = spark.createDataFrame([(t,) for t in dict.fromkeys(titles)], "title string")
    for block in (7, 4096):
        monkeypatch.setattr(dedup, "BLOCK", block)
        found = dedup.title_pairs(df, 0.88)
        assert both <= {frozenset(r) for r in found.collect()}
        plan = found._jdf.queryExecution().executedPlan().toString()
        assert "Join" not in plan and "FlatMapGroupsInArrow" in plan


def test_read_dedup_shuffles_keys_and_not_texts(spark, monkeypatch):
    from lamplight.operators import lifecycle
    from lamplight.sources import tables

    stored, plain = [], tables.written
    for module in (tables, lifecycle):
        monkeypatch.setattr(module, "written", lambda df, label: (stored.append(df.columns), plain(df, label))[1], raising=False)
    rows = spark.createDataFrame([(0, 0, "a"), (1, 0, "b"), (2, 1, "a "), (3, 2, "b"), (4, 3, "c")], "ord long, chunk_id long, text string")
    kept = lifecycle.read_dedup(rows)
    assert sorted(r.ord for r in kept.collect()) == [0, 3, 4] and kept.columns == rows.columns
    assert stored and not any("text" in columns for columns in stored)


def test_simhash_shuffles_no_shingles(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    assert "Exchange" not in dedup.simhash_rows(docs, "doc_id", "text")._jdf.queryExecution().executedPlan().toString()


def test_copies_of_a_kept_candidate_are_decided_together(spark, monkeypatch):
    from lamplight.sources import tables

    rounds, plain = [], tables.written
    monkeypatch.setattr(tables, "written", lambda df, label: (rounds.append(label), plain(df, label))[1])
    rows = [(i, "same", f"t{i}", "", "", i) for i in range(12)] + [(20, "other", "t3", "", "", 99)]
    df = spark.createDataFrame(rows, "id long, url string, raw string, work string, family string, fingerprint long").withColumn("fingerprint", F.col("fingerprint") * 0x0101010101010101)
    got = {r.id: (r.dup_status, r.dup_of) for r in dedup.retained_candidates(df, ["url", "raw"], "id", "work", "family", distance=-1).collect()}
    assert got == {0: ("unique", None)} | {i: ("confirmed", 0) for i in range(1, 12)} | {20: ("unique", None)}
    assert rounds.count("candidates") <= 4


def test_scores_store_no_texts(spark, folder, monkeypatch):
    from lamplight.plans import corpus_queries

    stored, plain = [], corpus_queries.written
    monkeypatch.setattr(corpus_queries, "written", lambda df, label: (stored.append(df.columns), plain(df, label))[1])
    assert corpus_queries.quality_scores(spark, folder).count() == spark.read.parquet(f"{folder}/documents.parquet").count()
    assert stored and not any("text" in columns for columns in stored)


def test_a_task_keeps_the_best_of_equal_scores_by_id(spark):
    kept = search.Best(2, 3)
    import numpy as np

    for ids in ([5, 9, 4], [1, 8, 2], [3, 7, 6]):
        kept.add(np.array([[0.5, i] for i in ids]), np.array(ids, dtype=object))
    kept.prune()
    assert list(zip(kept.query.tolist(), kept.chunk.tolist(), strict=True)) == [(0, 1), (0, 2), (0, 3), (1, 9), (1, 8), (1, 7)]
    rows = [(i, [1.0, 0.0]) for i in range(30)] + [(40, [0.0, 0.0]), (41, None), (42, [0.0, 2.0])]
    vectors = spark.createDataFrame(rows, "chunk_id long, vector array<double>")
    asked = vectors.where("chunk_id in (5, 6, 42)").withColumnRenamed("chunk_id", "query_id")
    found = search.vector_search(vectors, asked, 4)
    assert {(r.query_id, r.rank): (r.chunk_id, r.score) for r in found.collect()} == {(q, k + 1): (k, 1.0) for q in (5, 6) for k in range(4)} | {(42, 1): (42, 1.0), (42, 2): (0, 0.0), (42, 3): (1, 0.0), (42, 4): (2, 0.0)}
    assert "BroadcastNestedLoopJoin" not in found._jdf.queryExecution().executedPlan().toString()


def test_few_shared_tokens_of_many_queries_are_scored_pair_by_pair(spark):
    import random

    import numpy as np

    draw = random.Random(3)
    chunks = {c: sorted({f"w{draw.randrange(400)}" for _ in range(6)}) for c in range(300)}
    asked = {q: sorted({f"w{draw.randrange(400)}" for _ in range(2)}) for q in range(900)}
    weight = {f"w{i}": 1 + i % 7 for i in range(400)}
    rows = spark.createDataFrame([(c, t, 1.0 + c % 2) for c, t in chunks.items()], "chunk_id long, tokens array<string>, factor double").coalesce(1)
    wanted = spark.createDataFrame([(q, w, float(weight[w])) for q, ws in asked.items() for w in ws], "query_id long, token string, weight double")
    got = {(r.query_id, r.rank): (r.chunk_id, r.score) for r in search.scored_by_tokens(rows, wanted, 3).collect()}
    expected = {}
    for q, ws in asked.items():
        scores = sorted((-(1.0 + c % 2) * sum(weight[w] for w in ws if w in t), c) for c, t in chunks.items())
        expected |= {(q, k + 1): (c, -s) for k, (s, c) in enumerate(scores[:3]) if s < 0}
    assert got == expected
    kept = search.Best(4, 2, above=0.0)
    for chunk in (5, 3, 4):
        kept.add_pairs(np.array([0, 3]), np.array([0.5, 0.0]), np.array([chunk, chunk]))
    kept.prune()
    assert kept.chunk.tolist() == [3, 4] and kept.query.tolist() == [0, 0]


def test_passages_are_found_wherever_they_begin_and_end(spark):
    texts = spark.createDataFrame([(1, "Undergoing Major repairs, they said"), (2, "going major repair"), (3, "a b c"), (4, None), (5, "x\n\nGOING  Major repair")], "chunk_id long, text string")
    passages = spark.createDataFrame([(10, "going Major repair"), (11, "b"), (12, "absent major thing"), (13, None), (14, "going major"), (15, ", ")], "query_id long, text string")
    of = lambda df, i: df.select(i, X.tokenize(F.col("text")).alias("tokens"))
    tokens = search.asked_tokens(of(texts, "chunk_id"), of(passages, "query_id"))
    found = sorted((r.query_id, r.chunk_id) for r in search.containing(tokens, texts, passages).collect())
    assert found == [(10, 1), (11, 3), (14, 2), (15, 1)]


def test_pages_are_parsed_a_few_at_a_time(spark):
    import pyarrow as pa

    from lamplight.operators import candidates

    pages = ["<title>t</title><p>a</p><a href='x'>b</a>", None, ""] * 100
    parts = list(candidates.visible_page.func(iter([pa.array(pages), pa.array(pages[:1])])))
    assert sum(map(len, parts)) == 301 and max(map(len, parts)) <= candidates.PAGES_AT_ONCE
    rows = spark.createDataFrame([(i, h) for i, h in enumerate(pages)], "i long, h string").coalesce(1).select("i", candidates.visible_page("h").alias("p")).orderBy("i").collect()
    assert [(r.p.title, r.p.text, len(r.p.links)) for r in rows] == [("t", "t\na\nb", 1), ("", "", 0), ("", "", 0)] * 100


def test_keyword_search_shuffles_only_results(spark):
    chunks = spark.createDataFrame([(i, f"word{i % 7} common text") for i in range(5000)], "chunk_id long, text string").select("chunk_id", X.tokenize(F.col("text")).alias("tokens")).coalesce(1)
    queries = spark.createDataFrame([(1, ["common", "word3"]), (2, ["absent"])], "query_id long, tokens array<string>")
    found = search.keyword_search(chunks, queries, 3)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in plan and "Generate" not in plan and "HashAggregate" not in plan  # no row per word of a text
    assert [(r.query_id, r.rank, r.chunk_id, r.score) for r in found.orderBy("query_id", "rank").collect()] == [(1, 1, 3, 1.0), (1, 2, 10, 1.0), (1, 3, 17, 1.0)]
