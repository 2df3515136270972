"""Sections of pages, kind by kind, and biographies against a plain loop."""

import random

from pyspark.sql import functions as F

from lamplight.operators import sections

BIOGRAPHY = """닫기
오상록
吳上祿
기본정보
출생
1910
관련 단체
청년회
포상훈격(연도)
애족장(1990)
1929년 목포상업학교 학생운동을 준비하였다.
11월 19일 목포역을 거쳐 시위를 전개하였다.
출옥 이후 일본 나고야에서 노동운동을 전개하였다.
1931년 12월 11일 붙잡혔다.
1935년 풀려났다.
대한민국 정부는 1990년에 애족장을 추서하였다.
⋮누구⋮
참고문헌
잘린 줄"""
HERITAGE = "메뉴\n기본 정보\n국가유산 검색\n이전 문화유산\n구 일본영사관  건물\n다음"
CHRONOLOGY = "머리\n삼국 이전\n옛일\n1895년 개항\n항만\n상수도\n일제강점기\n넓어짐\n철도\n8·15 광복 이후\n오늘\n요약\n고종32년 일\n8·15 광복 이후\n끝\n담당자 누구"
TEXTS = [(1, "biography", BIOGRAPHY), (2, "heritage", HERITAGE), (3, "chronology", CHRONOLOGY), (4, "generic", "프린트\n한 줄\n\n  두  줄 \n|참고문헌|\n셋"), (5, "chronology", "한 줄"), (6, "biography", None), (7, "other", ""), (8, "generic", "줄\n" * 20_000), (8, "generic", "줄\n" * 20_000)]


def found(spark, rows, m=sections.KOREAN):
    df = spark.createDataFrame(rows, "doc_id long, k string, text string")
    out = {}
    for r in sections.sections(df, F.col("k"), m).orderBy("doc_id", "section").collect():
        out.setdefault(r.doc_id, []).append((r.title, r.lines, r.metadata))
    return out


def test_kinds_of_pages(spark):
    got = found(spark, TEXTS)
    assert [t for t, _, _ in got[1]] == ["오상록 기본정보", "오상록 1929년 활동", "오상록 1931년 활동", "오상록 1935년 활동", "오상록 1990년 활동"]
    assert got[1][0][1:] == (["오상록", "吳上祿", "기본정보", "출생", "1910"], ["관련 단체", "청년회", "포상훈격(연도)", "애족장(1990)"])
    assert got[1][2][1] == ["출옥 이후 일본 나고야에서 노동운동을 전개하였다.", "1931년 12월 11일 붙잡혔다."]
    assert got[2] == [("기본 정보", ["기본 정보", "구 일본영사관 건물"], [])]
    assert [(t, x) for t, x, _ in got[3]] == [
        ("전근대 역사", ["삼국 이전", "옛일"]), ("개항·거류·무역", ["1895년 개항"]), ("항만·도로·해상교통", ["항만"]), ("도시 기반시설·상수도", ["상수도"]), ("일제강점기 도시 확장", ["일제강점기", "넓어짐"]),
        ("철도·교통", ["철도"]), ("광복 이후 현대 행정구역 변화", ["8·15 광복 이후", "오늘"]), ("원문 요약 전근대", ["요약"]), ("개항 이후 근대 도시 변화 요약", ["고종32년 일"]), ("원문 요약 광복 이후", ["8·15 광복 이후", "끝"]),
    ]
    assert got[4] == [("본문", ["한 줄", "두 줄"], [])] and got[5] == [("본문", ["한 줄"], [])]
    assert 6 not in got and 7 not in got and len(got[8]) == 1 and len(got[8][0][1]) == 20_000


def plain_activities(lines):
    """The rule for a biography's narrative, line after line."""
    out, now, last = [], [], None
    for year, kind, line in lines:
        if now and (kind != "plain" or (year and last and abs(year - last) >= 2)):
            out.append(now)
            now, last = [], None
        now.append(line)
        last = year or last
        if kind == "award":
            out.append(now)
            now, last = [], None
    return out + [now] if now else out


def test_activities_like_a_loop(spark):
    rng, rows, expected = random.Random(3), [], {}
    for i in range(120):
        lines = []
        for j in range(rng.randrange(1, 12)):
            year, kind = rng.choice([None, None, *range(1919, 1925)]), rng.choice(["plain"] * 5 + ["award", "transition"])
            start = {"plain": "", "award": "대한민국 정부 ", "transition": "출옥 이후 "}[kind]
            lines.append((year, kind, f"{start}{f'{year}년 ' if year else ''}일 {j}"))
        rows.append((i, "biography", "이름\n한자\n기본정보\n포상훈격(연도)\n장\n" + "\n".join(x[2] for x in lines)))
        expected[i] = plain_activities(lines)
    got = found(spark, rows)
    assert {i: [x for _, x, _ in s[1:]] for i, s in got.items()} == expected


def test_nothing(spark):
    assert found(spark, []) == {}


def test_pages_stay_in_their_row(spark):
    long = "이름\n한자\n기본정보\n" + "".join(f"{1900 + i % 2 * 5}년 일 {i}\n" for i in range(20_000))
    heads = CHRONOLOGY.replace("오늘", "\n".join(f"오늘 {i}" for i in range(20_000)))
    rows = [(1, "biography", long), (2, "chronology", heads), (None, "generic", "줄 하나"), (None, "generic", "줄 하나"), (3, "heritage", HERITAGE), (3, "generic", HERITAGE), (3, "generic", "줄")]
    df = spark.createDataFrame(rows, "doc_id long, k string, text string")
    frame = sections.sections(df, F.col("k"))
    got = {}
    for r in frame.collect():
        got.setdefault(r.doc_id, []).append((r.section, r.title, len(r.lines)))
    assert len(got[1]) == 20_001 and got[1][:2] == [(0, "이름 기본정보", 2), (1, "이름 1900년 활동", 2)] and got[1][-1] == (20_000, "이름 1905년 활동", 1)
    assert [n for _, _, n in got[2]][6] == 20_001 and got[None] == [(0, "본문", 1)]
    assert sorted(got[3]) == [(0, "기본 정보", 2), (0, "본문", 1), (0, "본문", 6)]
    plan = sections.sections(df.where("doc_id < 3"), F.col("k"))._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan and "Exchange" not in plan
