"""Evidence of turns: each round gives what it should, over one small set of conversations."""

import pytest

from lamplight.functions import text as X
from lamplight.operators import turn_evidence

FIELDS = "conv_id long, turn long, kind string, question string, search_query string, place string, topic string, subject string, intent string, entities array<string>, followup boolean"
DETAIL = "배경 때문에 결과 이후 인물 참석 1949년 과정 진행 " * 10


def row(conv, turn, kind, query, subject, intent="overview", entities=(), question=None):
    return (conv, turn, kind, question or query, query, "", subject, subject, intent, list(entities), kind != "independent")


QUESTIONS = [
    row(1, 0, "independent", "station harbour", "station"),
    row(1, 2, "transform_previous_answer", "station", "station"),
    row(1, 4, "expand_previous_answer", "station", "station", question="더 자세히"),
    row(2, 0, "independent", "bridge", "bridge"),
    row(2, 2, "expand_previous_answer", "bridge tunnel", "bridge", question="배경을 더 알려"),
    row(3, 0, "factual_followup", "nothing here", "mill", "time"),
    row(4, 0, "independent", "quarry", "quarry"),
    row(4, 2, "factual_followup", "unheard", "quarry", "none"),
    row(5, 0, "independent", "나", "가", entities=["station", "bridge"], question="차이가 뭐야"),
    row(6, 0, "transform_previous_answer", "tunnel", "tunnel"),
    row(7, 0, "independent", "", ""),
]
CHUNKS = [("a", "station " + DETAIL), ("b", "station harbour"), ("c", "bridge short"), ("d", "tunnel 언제"), ("e", "mill 창립 시기"), ("f", "quarry"), ("g", None), ("h", "")]


@pytest.fixture(scope="module")
def packets(spark):
    found = turn_evidence.turn_evidence(spark.createDataFrame(QUESTIONS, FIELDS), spark.createDataFrame(CHUNKS, "chunk_id string, text string"), lambda t: X.keyword_tokens(t))
    out = {}
    for r in found.orderBy("conv_id", "turn", "rank").collect():
        out.setdefault((r.conv_id, r.turn), []).append((r.chunk_id, r.round))
    return out


def test_search_and_reuse(packets):
    assert sorted(packets[1, 0]) == [("a", "search"), ("b", "search")]
    assert sorted(packets[1, 2]) == [("a", "reuse"), ("b", "reuse")]  # a rewording asks for nothing new


def test_expansion_with_enough_detail_searches_nothing(packets):
    assert {x for _, x in packets[1, 4]} == {"reuse"}


def test_expansion_without_detail_unites_old_and_new(packets):
    assert packets[2, 2] == [("c", "reuse"), ("d", "search")]


def test_retry_asks_for_subject_and_intent(packets):
    assert packets[3, 0] == [("e", "retry")]


def test_followup_without_results_falls_back(spark, packets):
    assert packets[4, 2] == [("f", "retry")]  # the subject alone is found again
    questions = [row(1, 0, "independent", "quarry", "quarry"), row(1, 2, "factual_followup", "unheard", "quarry", "time")]
    questions[1] = (*questions[1][:7], "absent", *questions[1][8:])
    found = turn_evidence.turn_evidence(spark.createDataFrame(questions, FIELDS), spark.createDataFrame([("f", "quarry")], "chunk_id string, text string"), X.keyword_tokens)
    assert [(r.turn, r.chunk_id, r["round"]) for r in found.orderBy("turn").collect()] == [(0, "f", "search"), (2, "f", "fallback")]


def test_comparison_searches_for_each_subject(packets):
    assert {x for _, x in packets[5, 0]} == {"comparison"} and {c for c, _ in packets[5, 0]} == {"a", "b", "c"}


def test_rewording_with_nothing_remembered_is_searched(packets):
    assert packets[6, 0] == [("d", "search")] and (7, 0) not in packets


def test_nearby_intent(spark):
    chunks = spark.createDataFrame(CHUNKS, "chunk_id string, text string")
    packets = spark.createDataFrame([(1, 0, 1, "d", "search"), (2, 0, 1, "d", "search"), (3, 0, 1, "b", "search")], "conv_id long, turn long, rank int, chunk_id string, round string")
    questions = spark.createDataFrame([(1, 0, "time"), (2, 0, "people"), (3, 0, "cause")], "conv_id long, turn long, intent string")
    found = {r.conv_id: (r.intent, r.nearby) for r in turn_evidence.nearby_intent(packets, questions, chunks).collect()}
    assert found == {1: ("time", False), 2: ("overview", True), 3: ("overview", True)}


def test_nothing(spark):
    none = turn_evidence.turn_evidence(spark.createDataFrame([], FIELDS), spark.createDataFrame([], "chunk_id string, text string"), X.keyword_tokens)
    assert none.count() == 0
