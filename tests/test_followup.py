"""Follow-up questions: cases of Korean conversations, and the stream against the batch."""

import json

import pytest
from pyspark.sql import functions as F

from lamplight.operators import followup, grounding
from lamplight.streaming import conversations

SCHEMA = "conv_id long, turn long, role string, text string, chunk_ids array<string>"


def talk(*exchanges, ids=True, conv=1):
    """Turns of a conversation: (question, answer) pairs, the last one a question alone."""
    rows = []
    for n, (question, answer) in enumerate(exchanges):
        rows.append((conv, 2 * n, "user", question, None))
        if answer is not None:
            rows.append((conv, 2 * n + 1, "assistant", answer, [f"c{n}"] if ids else None))
    return rows


SUBJECTS = {
    "목포역의 역사를 설명해 줘.": ["목포역"],
    "서울 중앙학교의 역사를 알려 줘.": ["서울 중앙학교"],
    "이번에는 목포 시립도서관의 역할을 설명해 줘.": ["목포 시립도서관"],
    "3.18만세운동과 광주학생운동의 날짜를 구분해 줘.": ["3.18만세운동", "광주학생운동"],
    "호남은행과 동양척식주식회사를 비교해 줘.": ["호남은행", "동양척식주식회사"],
    "그때 누가 참여했어?": [],
    "언제 생겼어?": [],
    "다시 고하도로 돌아가서 관련 인물을 알려 줘.": ["고하도"],
    "목포 역": ["목포역"],
}


def test_subjects(spark):
    df = spark.createDataFrame([(q,) for q in SUBJECTS], "q string")
    assert {r.q: r.s for r in df.select("q", grounding.subjects(F.col("q")).alias("s")).collect()} == SUBJECTS


STATION = ("목포역에 대해 알려 줘.", "1913년에 열렸습니다.")
RETURNS = [("다시 목포역으로 돌아가서 개통 시기를 알려 줘.", "목포역", "광주학생운동"), ("다시 고하도로 돌아가서 관련 인물을 알려 줘.", "고하도", "고인돌")]
TALKS = {
    "alone": talk(("목포역에 대해 알려 줘.", None)),
    "followup": talk(STATION, ("그때 누가 참여했어?", None)),
    "transform": talk(STATION, ("쉽게 설명해 줘", None)),
    "expand": talk(STATION, ("더 자세히 알려 줘", None)),
    "correct": talk(STATION, ("아니 내가 묻는 건 개통 시기야", None)),
    "nothing before": talk(("쉽게 설명해 줘", None)),
    "chain": talk(STATION, ("언제?", "1913년"), ("왜?", None)),
    **{expected: talk((f"{expected}에 대해 알려 줘.", "첫"), (f"{between}을 알려 줘.", "둘"), (query, None)) for query, expected, between in RETURNS},
    "first": talk(("세월호 참사를 설명해 줘.", "첫"), ("목포역을 알려 줘.", "둘"), ("다시 첫 사건으로 돌아가서 장소를 알려 줘.", None)),
    "unknown": talk(("가짜사건을 알려 줘.", "자료에서 확인하지 못했습니다."), ("그 사건은?", None), ids=False),
    "parallel": talk(("이범석은 목포에서 무엇을 했어?", "도착했다"), ("그럼 김구는?", None)),
    "pronoun": talk(("이범석은 어떤 사람이야?", "군인"), ("그 사람은 언제 왔어?", None)),
    "numbered": talk(("목포근대역사관 1관을 설명해 줘.", "설명"), ("2관과 차이가 뭐야?", None)),
}


@pytest.fixture(scope="module")
def last(spark):
    """The last question of each conversation, resolved."""
    rows = [(n, *r[1:]) for n, t in enumerate(TALKS.values()) for r in t]
    found = followup.resolved_turns(spark.createDataFrame(rows, SCHEMA)).collect()
    return {name: max((r for r in found if r.conv_id == n), key=lambda r: r.turn) for n, name in enumerate(TALKS)}


def test_kinds_of_questions(last):
    kinds = {"alone": "independent", "followup": "factual_followup", "transform": "transform_previous_answer", "expand": "expand_previous_answer", "correct": "correction", "nothing before": "independent"}
    assert {name: last[name].kind for name in kinds} == kinds


def test_short_followups_keep_the_anchor(last):
    r = last["chain"]
    assert r.anchor == "목포역" and r.subject == "목포역" and r.search_query.startswith("목포역")


def test_return_to_a_named_topic_drops_what_came_between(last):
    for _, expected, between in RETURNS:
        r = last[expected]
        assert expected in r.search_query and between not in r.search_query and r.topic == expected


def test_return_to_the_first_topic(last):
    assert last["first"].search_query == "세월호 참사를 설명해 줘. 장소"


def test_answers_without_evidence_leave_nothing_to_return_to(last):
    assert last["unknown"].anchor == "" and "가짜사건" not in last["unknown"].search_query


def test_parallel_question_carries_the_predicate(last):
    assert "김구은 목포에서 무엇을 했어?" in last["parallel"].question


def test_pronoun_means_the_only_person(last):
    assert "이범석" in last["pronoun"].question and last["pronoun"].person == "이범석"


def test_numbered_places_are_compared(last):
    assert "목포근대역사관 1관" in last["numbered"].question and "목포근대역사관 2관" in last["numbered"].question


def test_reset_forgets(spark):
    rows = [*talk(("목포역에 대해 알려 줘.", "설명")), (1, 5, "reset", None, None), (1, 6, "user", "언제?", None)]
    r = followup.resolved_turns(spark.createDataFrame(rows, SCHEMA)).orderBy(F.col("turn").desc()).first()
    assert r.kind == "independent" and r.subject == "" and r.anchor == ""


def test_odd_rows(spark):
    rows = [(None, 0, "user", None, None), (2, None, "user", "", None), (3, 1, "assistant", "x", ["a"]), (3, 1, "assistant", "x", ["a"]), (4, 0, "system", "x", None), (5, 0, "user", "언제" * 50_000, None)]
    df = spark.createDataFrame(rows, SCHEMA)
    assert followup.resolved_turns(df).count() == 3
    assert followup.resolved_turns(df.where("turn > 99")).count() == 0


def stream(spark, tmp_path, batches, schema, **options):
    """The result of a stream that gets the batches one after the other."""
    source, spark_conf = tmp_path / "in", "spark.sql.streaming.stateStore.providerClass"
    source.mkdir()
    before = spark.conf.get(spark_conf)
    spark.conf.set(spark_conf, conversations.ROCKS)
    try:
        for n, rows in enumerate(batches):
            (source / f"{n}.json").write_text("\n".join(json.dumps(r, ensure_ascii=False) for r in rows))
            turns = spark.readStream.schema(schema).json(str(source))
            found = conversations.resolved_stream(turns, **options)
            q = found.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
            try:
                assert q.awaitTermination(90)
            finally:
                q.stop()
        return spark.read.parquet(str(tmp_path / "out")).collect()
    finally:
        spark.conf.set(spark_conf, before)


def test_stream_gives_what_the_batch_gives_and_forgets_on_reset(spark, tmp_path):
    names = ["conv_id", "turn", "role", "text", "chunk_ids", "mode"]
    told = talk(("목포역에 대해 알려 줘.", "설명"), ("언제?", "1913년"), ("왜?", "까닭"), ("쉽게 설명해 줘", None))
    rows = [dict(zip(names, (*r, "live"), strict=True)) for r in told]
    other = [{**rows[0], "conv_id": 2}, {**rows[2], "conv_id": 2, "mode": "test"}]
    after = [{"conv_id": 1, "turn": 20, "role": "reset", "text": None, "chunk_ids": None, "mode": "live"}, {**rows[2], "turn": 21, "mode": "test"}]
    found = stream(spark, tmp_path, [rows[:3] + other, rows[3:], after], SCHEMA + ", mode string")
    whole = followup.resolved_turns(spark.createDataFrame(told, SCHEMA)).collect()
    by_turn = {r.turn: r for r in found if r.conv_id == 1}
    fields = [f for f, _ in followup.FIELDS]
    for r in whole:
        assert [by_turn[r.turn][f] for f in fields] == [r[f] for f in fields]
    assert by_turn[21].status == "resolved" and by_turn[21].kind == "independent" and by_turn[21].anchor == ""
    assert sorted((r.turn, r.status) for r in found if r.conv_id == 2) == [(0, "resolved"), (2, "refused")]
