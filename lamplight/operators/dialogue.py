"""Dialogue rules over batches of turns: situations, tags, answer guards."""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass
from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lamplight.functions import text as X


@dataclass(frozen=True)
class Case:
    """One branch of the situation cascade: what it is called and when it applies."""

    situation: str
    reason: str
    confidence: float
    terms: tuple[str, ...] = ()
    pattern: str = ""
    also: tuple[str, ...] = ()
    context: str = ""  # "with" or "without" earlier turns
    fact: bool = False
    question: bool | None = None
    tags: tuple[str, ...] = ()

    def test(self, message: Column, has_context: Column) -> Column:
        out = X.any_of(message, self.terms) if self.terms else F.lit(True)
        if self.pattern:
            out = out & message.rlike(self.pattern)
        if self.also:
            out = out & X.any_of(message, self.also)
        if self.context:
            out = out & (has_context if self.context == "with" else ~has_context)
        if self.fact:
            out = out & is_fact_request(message)
        if self.question is False:
            out = out & ~F.endswith(message, F.lit("?"))
        return out


#: The cascade, whose order is its meaning.
CASES = (
    Case("HISTORY_FACT_QUESTION", "MISSING_SUBJECT", 0.72, pattern=r"^\s*(?:왜|언제|어디|누구|누가|무엇|뭐|어떻게)[?.!]*\s*$", context="without"),
    Case("PERSONAL_AND_LIGHT_CHAT", "UNINTELLIGIBLE_INPUT", 0.30, pattern=r"(?s)^(?!.*[가-힣一-龥]).*\S"),
    Case("PERSONAL_AND_LIGHT_CHAT", "OUT_OF_HISTORY_SCOPE", 0.98, pattern=r"(?:오늘|내일|이번\s*주)\s*(?:날씨|기온)|주가|환율|레시피|요리|컴퓨터|코딩|프로그래밍"),
    Case("SAFETY_ACCESSIBILITY", "SAFETY_CAPABILITY_OVERRIDE", 0.99, ("계단", "휠체어", "경사로", "엘리베이터", "쉼터", "안전", "너무 더워", "쉬고 싶")),
    Case("TECHNICAL_HELP", "TECHNICAL_CAPABILITY_REQUEST", 0.98, ("사진이 안 겹", "버튼이 안", "버튼 안", "소리가 안", "오디오가 안", "화면 오류")),
    Case("NAVIGATION_HELP", "NAVIGATION_CAPABILITY_REQUEST", 0.98, ("다음 조각", "길을 잃", "얼마나 걸", "거리", "가는 길", "방향 알려")),
    Case("STRONG_DISSATISFACTION", "DISSATISFACTION_OVERRIDE", 0.99, ("지랄", "개노잼", "뭐래", "ㅈㄴ", "씨발", "꺼져"), tags=("frustration",)),
    Case("RESPONSE_STYLE_REQUEST", "SOURCE_REQUEST", 0.98, ("출처", "자료 어디", "근거 보여"), tags=("asks_source",)),
    Case("EVIDENCE_AND_CORRECTION", "EVIDENCE_RECHECK", 0.96, ("틀린", "아닌 것", "다시 확인", "정확히 무슨", "직접 지은")),
    Case("EVIDENCE_AND_CORRECTION", "AMBIGUOUS_NO_CONTEXT", 0.55, ("그게", "그거", "그런 거"), context="without"),
    Case("JOURNEY_CONTEXT_QUESTION", "JOURNEY_CONTEXT", 0.96, ("이전 조각", "아까 본 조각", "지금까지 본", "세 조각")),
    Case("HISTORY_FACT_QUESTION", "CONTEXTUAL_DETAIL_REQUEST", 0.94, pattern=r"^\s*(?:더|조금\s*더|자세히)[?.!]*\s*$", context="with"),
    Case("RESPONSE_STYLE_REQUEST", "EXPLICIT_STYLE_REQUEST", 0.97, ("쉽게", "간단히", "간단하게", "짧게", "자세히", "요약", "정리해", "풀어", "한 줄", "한 문장", "핵심만", "무슨 말", "초등학생")),
    Case("PERSONAL_AND_LIGHT_CHAT", "PERSONAL_CONTEXT", 0.94, ("피곤", "지쳤", "아무 얘기", "할머니", "할아버지", "처음 목포")),
    Case("CROSS_CULTURAL_COMPARISON", "CROSS_CULTURAL_COMPARE", 0.94, ("중국", "일본", "다른 나라", "우리나라", "해외"), also=("비슷", "다르", "비교"), tags=("interest_cross_cultural",)),
    Case("LOW_ENGAGEMENT", "LOW_ENGAGEMENT_SIGNAL", 0.95, ("재미없", "딱히", "잘 모르겠", "그냥 그랬"), tags=("engagement_low",)),
    Case("EMOTION_NEGATIVE_HISTORY", "NEGATIVE_HISTORY_EMOTION", 0.93, ("슬퍼", "불편", "좋게 느껴지지", "안타까"), tags=("emotion_sadness",)),
    Case("REFLECTION_POSITIVE_GENERAL", "POSITIVE_REFLECTION", 0.91, ("인상 깊", "기억에 남", "괜찮았")),
    Case("EMOTION_POSITIVE", "POSITIVE_EMOTION", 0.90, ("재미있", "신기", "뿌듯", "몰랐"), question=False),
    Case("INTEREST_ARCHITECTURE", "ARCHITECTURE_TOPIC", 0.93, ("건물", "건축", "구조", "외관", "보존"), tags=("interest_architecture",)),
    Case("INTEREST_PEOPLE", "PEOPLE_TOPIC", 0.92, ("사람", "인물", "누구"), tags=("interest_people",)),
    Case("INTEREST_DAILY_CITY", "DAILY_CITY_TOPIC", 0.90, ("생활", "교통", "상업", "주변", "거리", "도시", "기차", "역"), fact=True, tags=("interest_daily_life",)),
    Case("COMPARISON_CONTEXT", "COMPARISON_TOPIC", 0.86, ("달라", "남아 있는", "비교", "연결되는")),
    Case("FREE_CHAT_GREETING", "GREETING", 0.98, pattern=r"^\s*(?:안녕|안녕하세요|반가워)[.!?]*\s*$"),
    Case("PERSONAL_AND_LIGHT_CHAT", "ACKNOWLEDGEMENT", 0.98, pattern=r"^\s*(?:고마워|감사해|감사합니다|알겠어|알겠습니다|그렇구나|응|좋아|오케이)[.!?]*\s*$"),
    Case("HISTORY_FACT_QUESTION", "ENTITY_ONLY_HISTORY_QUERY", 0.78, pattern=r"^\s*[가-힣·]{1,30}(?:\s+[가-힣·]{2,30}){0,3}[?.!]*\s*$"),
    Case("HISTORY_FACT_QUESTION", "FACT_QUESTION", 0.82, fact=True),
    Case("PERSONAL_AND_LIGHT_CHAT", "LOW_CONFIDENCE_LIGHT_CHAT", 0.58),
)
FACT_WORDS = ("왜", "언제", "무엇", "어떤", "알려", "설명", "관계", "확인", "구분", "이야기해줘", "이야기해 줘", "얘기해줘", "얘기 좀 해줘", "什么", "何时", "哪年", "哪里", "多少", "是谁", "为什么")
NEEDS_SOURCES = ("INTEREST_PEOPLE", "INTEREST_DAILY_CITY", "HISTORY_FACT_QUESTION", "EVIDENCE_AND_CORRECTION", "CROSS_CULTURAL_COMPARISON")
MAY_NEED_SOURCES = ("INTEREST_ARCHITECTURE", "JOURNEY_CONTEXT_QUESTION", "COMPARISON_CONTEXT", "EMOTION_NEGATIVE_HISTORY", "PERSONAL_AND_LIGHT_CHAT")


def is_fact_request(message: Column) -> Column:
    asked = message.rlike(r"(?:역사|사건|인물|목포(?:역|항|진)|영사관|주식회사|학생운동|독립운동|건물).*(?:(?:이야기|얘기)(?:해\s*줘|\s*좀\s*해줘)?|넘어가자|돌아가자|살펴보자)")
    return asked | message.rlike("[?？]$") | X.any_of(message, FACT_WORDS)


def situation(message: Column, has_context: Column, cases: tuple[Case, ...] = CASES) -> Column:
    """(situation, reason, confidence, tags) of the first case that applies."""
    text = F.trim(F.coalesce(message, F.lit("")))
    out = None
    for case in cases:
        value = F.struct(
            F.lit(case.situation).alias("situation"), F.lit(case.reason).alias("reason"), F.lit(case.confidence).alias("confidence"), F.array(*map(F.lit, case.tags)).cast("array<string>").alias("tags")
        )
        out = F.when(case.test(text, has_context), value) if out is None else out.when(case.test(text, has_context), value)
    return out


def needs_retrieval(found: Column, message: Column, has_context: Column) -> Column:
    """Whether an answer to a classified message needs sources."""
    kind, reason = found["situation"], found["reason"]
    fact = is_fact_request(message)
    return (
        F.when(reason.isin("OUT_OF_HISTORY_SCOPE", "MISSING_SUBJECT", "UNINTELLIGIBLE_INPUT", "AMBIGUOUS_NO_CONTEXT"), False)
        .when(reason == "EXPLICIT_STYLE_REQUEST", has_context)
        .when((kind == "CROSS_CULTURAL_COMPARISON") & F.contains(message, F.lit("우리나라")), False)
        .when(kind.isin(*NEEDS_SOURCES) | (reason == "SOURCE_REQUEST"), True)
        .when(kind.isin(*MAY_NEED_SOURCES), fact | F.contains(message, F.lit("출처")))
        .otherwise(False)
    )


def length_mode(message: Column) -> Column:
    """How long an answer is asked to be."""
    modes = (("very_short", ("한두 문장",)), ("short", ("짧게", "간단히")), ("simple", ("쉽게",)), ("detailed", ("자세히",)), ("summary", ("요약", "정리")))
    out = None
    for name, terms in modes:
        out = F.when(X.any_of(message, terms), name) if out is None else out.when(X.any_of(message, terms), name)
    return out.otherwise("default")


def tag_scope(tag: Column, session: tuple[str, ...], preference: tuple[str, ...], journey: tuple[str, ...]) -> Column:
    """Whether a tag is about this session, a possible preference or the journey."""
    plain = F.regexp_replace(tag, "(?:_temporarily)?(?:_possible)?$", "")
    return (
        F.when(plain.isin(*session) | tag.startswith("emotion_"), "session_observation")
        .when(plain.isin(*preference), "preference_candidate")
        .when(plain.isin(*journey) | tag.startswith("interest_"), "journey_interest")
    )


def style_violations(answer: Column, citations: Column, rules: dict[str, str]) -> Column:
    """Codes of the patterns that occur, and invented_citation for a cited source that wasn't found."""
    claimed = F.regexp_extract_all(answer, F.lit(r"\[출처:\s*([^\]]+)\]"))
    return X.reasons(*[(answer.rlike(p), code) for code, p in rules.items()], (F.size(F.array_except(claimed, citations)) > 0, "invented_citation"))


def _letters(text: str) -> str:
    return re.sub(r"[\W_]+", "", text).casefold()


def _subject(sentence: str) -> str:
    found = re.match(r"(?:\[답변\]\s*)?([가-힣]{2,10})[은는이가](?=\s|,)", sentence)
    return found[1] if found else ""


def alike(a: str, b: str, least: float = 0.94) -> bool:
    """Two long sentences that say the same: equal numbers, no different subjects, nearly equal letters."""
    subjects = {_subject(a), _subject(b)} - {""}
    numbers = re.compile(r"\d[\d,.]*")
    if min(len(a), len(b)) < 20 or numbers.findall(a) != numbers.findall(b) or len(subjects) > 1 and _subject(a) and _subject(b):
        return False
    x, y = _letters(a), _letters(b)
    return bool(x and y) and SequenceMatcher(None, x, y, autojunk=False).ratio() >= least


def _each(function: Callable[[str], object], kind: T.DataType):
    @F.pandas_udf(kind)
    def run(values: pd.Series) -> pd.Series:
        return values.map(lambda v: function(v or ""))

    return run


def _without_repeats(answer: str) -> str:
    kept: list[str] = []
    seen: set[str] = set()
    for part in re.split(r"(?<=[.!?。！？])\s+", answer.strip()):
        key = " ".join(part.split())
        if key and key not in seen and not any(alike(part, before) for before in kept[-2:]):
            kept.append(part.strip())
            seen.add(key)
    return " ".join(kept)


#: Sentences said before are left out, near repeats if one of the two kept before is alike; the look-back is over kept sentences.
without_repeats = _each(_without_repeats, T.StringType())


@F.pandas_udf(T.BooleanType())
def echoes_question(answer: pd.Series, question: pd.Series) -> pd.Series:
    """Whether a sentence only gives the question back."""

    def one(a: str, q: str) -> bool:
        x, y = _letters(a or ""), _letters(q or "")
        return len(y) >= 6 and bool(x) and (y in x or SequenceMatcher(None, x, y, autojunk=False).ratio() >= 0.92)

    return pd.Series([one(a, q) for a, q in zip(answer, question, strict=True)], dtype=bool)


def complete_part(answer: Column) -> Column:
    """An answer up to its last sentence end."""
    return F.regexp_extract(F.trim(F.coalesce(answer, F.lit(""))), r"(?s)^(.*[.!?。！？])(?=\s|$)", 1)


def prompt(system: Column, summary: Column, evidence: Column, question: Column, limit: int = 6000) -> Column:
    """A labelled prompt with redacted parts; evidence is numbered and cut at the limit."""
    numbered = F.transform(evidence, lambda e, i: F.concat(F.lit("["), (i + 1).cast("string"), F.lit("] "), X.redact(e)))
    parts = F.concat_ws("\n\n", X.redact(system), F.when(F.coalesce(summary, F.lit("")) != "", F.concat(F.lit("[대화 요약]\n"), X.redact(summary))), F.concat(F.lit("[검색 근거]\n"), F.array_join(numbered, "\n")))
    return F.concat(X.truncate(parts, limit), F.lit("\n\n[질문]\n"), X.redact(question))
