"""Subjects, claims and agreement on small rows."""

import pytest
from pyspark.sql import functions as F
from test_operators import one

from lamplight.operators import grounding as G


@pytest.mark.parametrize(
    ("question", "want"),
    [("그때 무슨 일이 있었나요?", []), ("목포항의 역사를 알려줘", ["목포항"]), ("호남선과 목포역을 비교해줘", ["호남선", "목포역"]), ("이범석에 대해 말해줘", ["이범석"]), ("목포역", ["목포역"]), ("언제 생겼어?", [])],
)
def test_subjects(spark, question, want):
    assert one(spark, G.subjects(F.col("q")), q=question) == want


@pytest.mark.parametrize(
    ("question", "evidence", "bad"),
    [("1899년에 개항했지?", "목포항은 1897년에 개항", True), ("목포 개항했지?", "목포는 1897년에 개항했다", False), ("3층 건물인가요", "2층 건물", True), ("2층 건물인가요", "2 층 건물", False), ("2090년 계획", "1990년", True), ("가상의 인물", "x", True), ("3층", "", False)],
)
def test_claims(spark, question, evidence, bad):
    assert one(spark, G.unsupported_claim(F.col("q"), F.col("e"), 2025), q=question, e=evidence) is bad


def test_agreement(spark):
    agrees = G.subject_agrees(F.col("s"), F.col("t"), F.col("x"), {"일본영사관": "근대역사관1관"})
    assert one(spark, agrees, s="목포항", t="목포항", x="") and one(spark, agrees, s="목포항", t="", x="목포항은 1897년") and one(spark, agrees, s="구 일본 영사관", t="근대역사관 1관", x="x")
    assert not one(spark, agrees, s="목포항", t="", x="코스 자세히 보기 목포항") and not one(spark, agrees, s="항", t="", x="목포항 이야기가 길게 이어지는 글")
    assert one(spark, G.boilerplate_only(F.col("x")), x="전체메뉴 비밀번호") and not one(spark, G.boilerplate_only(F.col("x")), x="정의 닫기 전체메뉴 비밀번호")


def test_order_and_gates(spark):
    rows = [(1, "a", 0.9, "다른 글", "전체메뉴 사이드메뉴", "목포항은 언제 개항했나", "목포항"), (1, "b", 0.1, "목포항", "1897년 개항", "목포항은 언제 개항했나", "목포항"), (1, "c", 0.5, "다른 글", "목포항 소개", "목포항은 언제 개항했나", "목포항")]
    df = spark.createDataFrame(rows, "query_id long, chunk_id string, score double, title string, text string, question string, subject string")
    assert [r.chunk_id for r in G.reordered(df).orderBy("rank").collect()] == ["b", "c", "a"]
    chunks = spark.createDataFrame([(1, ["Old Port"]), (2, ["항구", " "]), (3, ["mill"])], "document_id long, retrieval_subjects array<string>")
    asked = spark.createDataFrame([(7, "the old port of"), (8, "목포항구 이야기")], "query_id long, text string")
    assert {(r.query_id, r.document_id) for r in G.named_subject_documents(chunks, asked).collect()} == {(7, 1), (8, 2)}


def test_labels_paths_and_mirrors(spark):
    assert [one(spark, G.context_label(F.col("v"), {"port": "항구"}), v=v) for v in ("port-2", "demo_1", "old_mill", "unknown")] == ["항구", "", "old mill", ""]
    assert one(spark, G.inside_folder(F.col("p"), "data/raw"), p="data/raw/a/b.txt") and not one(spark, G.inside_folder(F.col("p"), "data/raw"), p="data/raw/../x")
    rows = spark.createDataFrame([(1, "w", "A"), (2, "w", "B"), (3, "w", "A")], "id long, work_id string, publisher_family string")
    pairs = spark.createDataFrame([(2, 1), (3, 1)], "id long, near_id long")
    assert {r.id: (r.status, r.method) for r in G.mirrors(pairs, rows).collect()} == {2: ("confirmed", "mirror"), 3: ("suspected", "simhash_near")}
