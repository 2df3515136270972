"""Persons in Korean sentences, and the rules against plain Python."""

import re

import pytest
from pyspark.sql import functions as F

from lamplight.operators import persons

K = persons.KOREAN
TEXTS = [
    (1, "이범석(李範奭)은 회장을 맡아 활동하였다. 청년회(靑年會)는 활동했다."),
    (2, "김구(金九, 1876~1949)가 독립운동에 참여하였다. 목사 박연세는 만세운동을 주도하였다."),
    (3, "오상록(吳上祿)에게 훈장이 추서되었고 활동이 알려졌다."),
    (4, "이범석(李範奭)은 군인이다."),  # nothing that persons do
    (5, "목포시(木浦市)는 정명여학교(貞明女學校)와 활동했다. 유달산(儒達山) 활동."),
    (6, None),
    (7, ""),
    (8, "김구(金九)와 김구(金九)가 참여했다."),
    (8, "김구(金九)와 김구(金九)가 참여했다."),
    (9, "가" * 100_000 + " 대표 최남선과 만나 활동했다."),
]


def plain(sentence):
    if not re.search(K.context, sentence):
        return []
    found = [(n, s) for n, s in re.findall(K.spelled, sentence)] + [(n, "") for n in re.findall(K.titled, sentence)]
    good = [(n, s) for n, s in found if re.search(K.family, n) and not re.search(K.not_name, n) and not re.search(K.not_spelling, s)]
    return list({n: (n, s) for n, s in reversed(good)}.values())[::-1]


@pytest.fixture(scope="module")
def rows(spark):
    return persons.person_rows(spark.createDataFrame(TEXTS, "doc_id long, text string")).collect()


def test_like_plain_python(rows):
    for i, text in {i: t for i, t in TEXTS}.items():
        expected = sorted((n, p, s) for n, sentence in enumerate(re.split(r"(?<=[.!?。！？])\s+|\n+", text or "")) for p, s in plain(sentence))
        assert sorted({(r.sentence, r.person, r.spelling) for r in rows if r.doc_id == i}) == sorted(set(expected))


def test_relations_and_places(rows):
    got = {(r.doc_id, r.person): (r.place, r.relation, r.value) for r in rows}
    assert got[1, "이범석"] == (0, "role", "회장") and got[3, "오상록"] == (0, "award", "award")
    assert got[2, "박연세"] == (3, "", "") and got[9, "최남선"] == (100_004, "", "")
    assert len([r for r in rows if r.doc_id == 8]) == 2 and not [r for r in rows if r.doc_id in (4, 6, 7)]


def test_subject_is_no_person_found(spark):
    df = spark.createDataFrame([(1, TEXTS[0][1], "이 범석")], "doc_id long, text string, subject string")
    assert persons.person_rows(df, subject_col="subject").count() == 0
    assert persons.person_rows(df.where("doc_id > 5").withColumn("extra", F.lit(1))).count() == 0
