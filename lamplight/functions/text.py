"""Text as Column expressions: normalising, features, sentences, redaction, excerpts.

White space follows the Unicode definition ((?U) in Java's patterns) plus the four
separators U+001C to U+001F, which Java leaves out.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F

SPACE = r"(?U)[\s\x1C-\x1F]+"
#: Fixed value: what counts as a word for the lexical features.
WORD = "[0-9A-Za-z가-힣]+"
HANGUL = "^[가-힣]+$"


def collapse(text: Column) -> Column:
    """Runs of white space to one space, none at the ends; null as empty."""
    return F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), SPACE, " "))


def words(text: Column) -> Column:
    """Lower-case words of at least two characters, in order, repeats included."""
    found = F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(WORD), F.lit(0))
    return F.filter(found, lambda w: F.length(w) > 1)


def keyword_tokens(text: Column) -> Column:
    """Distinct words in order of first occurrence."""
    return F.array_distinct(words(text))


def _grams(word: Column, size: int) -> Column:
    places = F.sequence(F.lit(1), F.length(word) - size + 1)
    return F.when(F.length(word) >= size, F.transform(places, lambda i: F.substring(word, i, F.lit(size)))).otherwise(F.array().cast("array<string>"))


def features(found: Column) -> Column:
    """Words and, for words all of Hangul, their 2- and 3-grams; distinct, in order."""
    per_word = F.transform(found, lambda w: F.when(w.rlike(HANGUL), F.concat(F.array(w), _grams(w, 2), _grams(w, 3))).otherwise(F.array(w)))
    return F.array_distinct(F.flatten(per_word))


def tokenize(text: Column) -> Column:
    """Features of a text; words are looked at one by one only where it has Hangul at all."""
    return F.when(text.rlike("[가-힣]"), features(words(text))).otherwise(keyword_tokens(text))


@dataclass(frozen=True)
class Profile:
    """Language-specific lists, which are parameters of the operators and not of the engine."""

    suffixes: Sequence[str] = ()
    stop_words: Sequence[str] = ()
    boilerplate: str = ""
    topics: dict[str, Sequence[str]] = field(default_factory=dict)
    history_terms: Sequence[str] = ()
    navigation_terms: Sequence[str] = ()
    metadata_labels: Sequence[str] = ()
    entity_pattern: str = ""
    places: Sequence[str] = ()
    sensational: str = ""
    attribution: str = ""


#: The Korean lists of the question and corpus policies.
KOREAN = Profile(
    suffixes=(
        "이었나요", "되었나요", "했나요", "인가요", "되는", "으로", "에서", "에는", "에게", "부터", "까지", "처럼", "보다", "이라고", "라고",
        "이며", "이고", "은", "는", "이", "가", "을", "를", "의", "에", "와", "과", "로", "인",
    ),
    stop_words=(
        "목포", "근대", "역사", "자료", "관련", "대해", "알려줘", "알려주세요", "들려줘", "궁금해", "중요했", "다음", "무엇", "어떤", "누구", "현재", "언제", "어떻게", "역할",
        "발전", "방법", "설명", "설명해", "설명해줘", "공간", "사용", "알려", "주세요", "했나요", "됐고", "이야기", "이야기해줘", "명확히", "부분", "얘기", "해줘", "넘어가자",
        "돌아가자", "돌아가서", "돌아와서", "돌아오고", "다시", "거야", "그럼", "그러면", "그렇다면", "처음", "생긴", "지었어", "거지", "설치된", "시기", "사건", "순서", "인물",
        "장소", "사실", "역사적", "확인된", "확인되는", "확인", "관련해", "관련된", "정확한", "정확히", "근거해", "근거로", "이번", "이번에", "돌아", "특징", "관계", "역할",
        "활동", "형성", "변화", "영향", "성격", "정보", "내용", "구분해", "배경", "전개", "결과", "과정", "주요", "무엇이야", "첫", "두", "번째", "단체", "둘", "둘을",
        "같은", "보면", "되는", "이유", "건립", "설립", "개통", "준공", "아까", "말한", "여기", "여기서", "거기서", "이곳에서", "그곳에서", "일어났어", "당시", "내부", "모습",
        "어땠어", "어땐어", "사람들", "이용", "이용했어", "이후", "있던", "지은", "건물", "뒤", "뒤에", "지금", "뭐야",
    ),
    boilerplate=r"^(?:누구(?:야|예요|인가요)?|어때(?:요)?|(?:알려|말해|설명해|이야기해|얘기해)(?:줘|주세요|봐)?|(?:만들|세우|세워|지어|생겨|일어나|했|됐|되었)[가-힣]*)$",
    topics={
        "opening_trade": ("개항", "해관", "세관", "거류지", "조계", "무역", "개항장"),
        "port_maritime": ("목포항", "항만", "부두", "해운", "증기선", "선박", "창고"),
        "rail_transport": ("철도", "호남선", "목포역", "기차", "철길"),
        "urban_infrastructure": ("도시계획", "상수도", "도로망", "공공시설", "하수도", "전기"),
        "colonial_city": ("일제강점기", "식민지", "목포부", "행정구역", "도시 확장", "인구"),
        "economy_finance": ("동양척식", "호남은행", "금융", "은행", "시장", "상업", "미곡", "면화", "토지"),
        "architecture_heritage": ("일본영사관", "근대역사문화공간", "등록문화유산", "건축", "가옥", "교회", "창고"),
        "education_religion": ("학교", "정명여학교", "영흥학교", "목포상업학교", "교육", "선교", "교회", "청년회"),
        "independence_student_movement": ("독립운동", "학생운동", "3·1운동", "삼일운동", "광주학생", "만세운동"),
        "labor_peasant_movement": ("노동운동", "소작쟁의", "농민운동", "파업", "소작인"),
        "person_history": ("인물", "생애", "출생", "사망", "본관", "독립운동인명사전"),
        "post_liberation": ("광복", "해방", "미군정", "한국전쟁", "해방 이후", "광복 이후"),
    },
    navigation_terms=("로그인", "회원가입", "메뉴", "사이트맵", "검색", "이전글", "다음글", "목록", "홈으로"),
    metadata_labels=("제목", "작성자", "등록일", "첨부파일", "분류", "관리번호"),
    entity_pattern=r"[가-힣]{2,}(?:학교|은행|회사|항|역|관|청|부|군|면|동|회|조합|교회)",
    places=("목포",),
    sensational=r"(?:충격|경악|반드시 믿|최고의|숨겨진 진실|!!!)",
    attribution=r"(?:에 따르면|기록|자료|보고서|연구|출처|소장)",
)
#: A profile whose terms occur in the synthetic tables.
SAMPLE = Profile(
    suffixes=("ing", "ed", "ly", "s"),
    stop_words=("the", "of", "and", "to", "in", "is", "by", "on", "at", "an"),
    topics={
        "licence": ("license", "licensed", "copyright"),
        "contact": ("mail", "example.com"),
        "english": ("the ", "tion"),
        "romance": ("ción", "eau", "ment"),
        "german": ("sch", "keit"),
    },
    history_terms=("license", "tion", "ción", "keit", "ment"),
    navigation_terms=("menu", "login", "search", "home"),
    metadata_labels=("title", "author", "date"),
    entity_pattern=r"[A-Z][a-z]{3,}tion",
    places=("the",),
    sensational=r"(?:idiot|pathetic|scum|!!!)",
    attribution=r"(?:License|Copyright|source)",
)


def content_words(text: Column, profile: Profile = KOREAN) -> Column:
    """Distinct words without the first listed suffix that leaves more than one character, without stop words and boilerplate."""

    def stem(w: Column) -> Column:
        out = None
        for s in profile.suffixes:
            hit = F.endswith(w, F.lit(s)) & (F.length(w) > len(s) + 1)
            cut = F.substring(w, F.lit(1), F.length(w) - len(s))
            out = F.when(hit, cut) if out is None else out.when(hit, cut)
        return w if out is None else out.otherwise(w)

    stems = F.filter(F.transform(words(text), stem), lambda w: F.length(w) > 1)
    if profile.stop_words:
        stems = F.array_except(stems, F.array(*map(F.lit, profile.stop_words)))  # also makes distinct, in order
    if profile.boilerplate:
        stems = F.filter(stems, lambda w: ~w.rlike(profile.boilerplate))
    return F.array_distinct(stems)


def informative_tokens(text: Column, profile: Profile = KOREAN) -> Column:
    """Features of the content words."""
    return features(content_words(text, profile))


def sentences(text: Column) -> Column:
    """Trimmed sentences; the point after an initial ends none."""
    kept = F.regexp_replace(F.coalesce(text, F.lit("")), r"\b([A-Z])\.(?=\s*[A-Z][a-z])", "$1\u0001")
    parts = F.transform(F.split(kept, r"(?<=[.!?。！？])\s+|\n+"), lambda s: F.regexp_replace(F.regexp_replace(s, r"^[\s]+|[\s]+$", ""), "\u0001", "."))
    return F.filter(parts, lambda s: s != "")


def clauses(text: Column, boundary: str = r"\s*(?:닫기|펼치기)\s*") -> Column:
    """Sentences cut further after verb endings followed by a comma; section markers end sentences."""
    marked = F.regexp_replace(F.coalesce(text, F.lit("")), boundary, "\n")
    cut = F.flatten(F.transform(sentences(marked), lambda s: F.split(s, r"(?<=다)[,;]\s+")))
    return F.filter(F.transform(cut, lambda s: F.regexp_replace(s, r"^[ \t\r\n\-·]+|[ \t\r\n\-·]+$", "")), lambda s: s != "")


def repeated_sentences(text: Column) -> Column:
    """How many sentences are repeats of another."""
    parts = F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), r"(?<=[.!?。！？])\s+"), collapse), lambda s: s != "")
    return F.size(parts) - F.size(F.array_distinct(parts))


#: What is redacted, in this order; a URL before an e-mail address, an identifier before a secret.
REDACTIONS = (
    (r"(?i)(?<![\w])(?:[a-z]:\\|\\\\)[^\s<>|]+", "[경로 제거]"),
    (r"(?i)(?<![\w])/(?:home|users|var|tmp|opt|srv|mnt|etc)/[^\s]+", "[경로 제거]"),
    (r"(?i)\b(?:https?|ssh|git)://[^\s<>'\"]+", "[URL 제거]"),
    (r"(?i)\bgit@[^\s:]+:[^\s]+", "[Git 주소 제거]"),
    (r"(?<![\w.+-])[\w.+-]+@[\w.-]+\.[A-Za-z]{2,}(?![\w.-])", "[이메일 제거]"),
    (r"(?<!\d)(?:\+?82[- .]?)?0?1[016789](?:[- .]?\d){7,8}(?!\d)", "[전화번호 제거]"),
    (r"(?<!\d)(?:10(?:\.\d{1,3}){3}|127(?:\.\d{1,3}){3}|192\.168(?:\.\d{1,3}){2}|172\.(?:1[6-9]|2\d|3[01])(?:\.\d{1,3}){2})(?!\d)", "[내부 주소 제거]"),
    (r"(?i)(?<![\w:])(?:::1|f[cd][0-9a-f]{2}(?::[0-9a-f]{0,4}){2,}|fe[89ab][0-9a-f](?::[0-9a-f]{0,4}){2,})(?![\w:])", "[내부 주소 제거]"),
    (r"(?i)(?<![0-9a-f])[0-9a-f]{32}(?![0-9a-f])", "[세션 식별자 제거]"),
    (r"(?i)(?<![\w-])(?:[a-z]+_hist_\d+|[\w-]+::\d+|(?:document|chunk|source)[_-]id\s*[:=]\s*[^\s]+)", "[내부 식별자 제거]"),
    (r"(?i)\b(?:api[_-]?key|access[_-]?token|secret|password|ssh[_-]?key|vpn[_-]?key)\s*[:=]\s*[^\s,;]+", "[비밀정보 제거]"),
)


def redact(text: Column) -> Column:
    """Paths, addresses, phone numbers, identifiers and secrets replaced by what they were."""
    out = F.coalesce(text, F.lit(""))
    for pattern, label in REDACTIONS:
        out = F.regexp_replace(out, pattern, label)
    return F.regexp_replace(out, r"(?U)^\s+|\s+$", "")


def truncate(text: Column, limit: int) -> Column:
    """At most limit characters, the last an ellipsis where something is cut."""
    cut = F.concat(F.regexp_replace(F.left(text, F.lit(limit - 1)), r"(?U)\s+$", ""), F.lit("…"))
    return F.when(F.length(text) <= limit, text).otherwise(cut)


def relevant_excerpt(text: Column, term: str, least: int = 20, most: int = 400, limit: int = 1000) -> Column:
    """Sentences with the term and a length in bounds, joined, cut at the limit."""
    hits = F.filter(sentences(text), lambda s: F.contains(s, F.lit(term)) & F.length(s).between(least, most))
    return F.left(F.array_join(hits, " "), F.lit(limit))


def keyword_windows(text: Column, term: str, before: int = 100, width: int = 260, most: int = 3) -> Column:
    """Distinct windows around the first hit in each sentence, ellipses where something is cut."""
    parts = F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), r"(?<=[.!?。])\s+|[\r\n]+"), collapse), lambda s: F.contains(s, F.lit(term)))

    def window(s: Column) -> Column:
        start = F.greatest(F.lit(0), F.instr(s, term) - 1 - before)
        return F.concat(F.when(start > 0, F.lit("…")).otherwise(""), F.substring(s, start + 1, F.lit(width)), F.when(start + width < F.length(s), F.lit("…")).otherwise(""))

    return F.slice(F.array_distinct(F.transform(parts, window)), 1, most)


def core_lines(text: Column, boilerplate: Sequence[str] = ()) -> Column:
    """Distinct lines without URLs, joined by spaces, without boilerplate phrases."""
    lines = F.transform(F.split(F.coalesce(text, F.lit("")), r"\r\n|[\n\r\x0B\x0C\x1C-\x1E\x85  ]"), lambda s: collapse(F.regexp_replace(s, r"https?://\S+", " ")))
    out = collapse(F.array_join(F.array_distinct(F.filter(lines, lambda s: s != "")), " "))
    for phrase in boilerplate:
        out = F.replace(out, F.lit(phrase), F.lit(" "))
    return collapse(out)


def core_between(text: Column, start: str, endings: Sequence[str], least: int = 500) -> Column:
    """From the start marker, if any, to the first of each ending that lies beyond `least` characters."""
    at = F.instr(text, start)
    out = F.when(at > 0, F.substring(text, at, F.length(text))).otherwise(text)
    for e in endings:
        stop = F.instr(out, e)
        out = F.when(stop - 1 > least, F.substring(out, F.lit(1), stop - 1)).otherwise(out)
    return collapse(out)


def labelled_field(text: Column, label: str, labels: Sequence[str] = ()) -> Column:
    """What follows a label and its optional colon, up to a bar, a line end or the next label."""
    rest = F.regexp_extract(F.coalesce(text, F.lit("")), rf"{label}\s*[:：]?\s*([^|\n]*)", 1)
    stop = "|".join(labels)
    return F.trim(F.get(F.split(rest, stop), F.lit(0))) if stop else F.trim(rest)


def table_field(page: Column, label: str) -> Column:
    """The cell that follows a header cell of this label, tags removed."""
    cell = F.regexp_extract(F.coalesce(page, F.lit("")), rf"(?is)<th[^>]*>\s*{label}\s*</th>\s*<td[^>]*>(.*?)</td>", 1)
    return collapse(F.regexp_replace(cell, r"(?s)<[^>]+>", " "))


def plain_url(url: Column) -> Column:
    """Trimmed, without slashes at the end, in lower case."""
    return F.lower(F.regexp_replace(F.trim(F.coalesce(url, F.lit(""))), "/+$", ""))


def licence_code(value: Column) -> Column:
    """Code of an open government licence such as KOGL-1."""
    code = F.upper(F.trim(value))
    for old, new in (("공공누리", "KOGL"), ("제", ""), ("유형", ""), (" ", ""), ("_", "-")):
        code = F.replace(code, F.lit(old), F.lit(new))
    return F.regexp_replace(code, "^KOGL([1-4])$", "KOGL-$1")


def derived_id(*parts: Column, digits: int = 20) -> Column:
    """The first hexadecimal digits of the SHA-256 of the parts, joined by NUL."""
    return F.left(F.sha2(F.concat_ws("\u0000", *parts).cast("binary"), 256), F.lit(digits))


def topics_of(text: Column, topics: dict[str, Sequence[str]]) -> Column:
    """Names of the topics of which any term occurs, in the order given."""
    low = F.lower(collapse(text))
    named = [F.when(_any(low, [t.lower() for t in terms]), F.lit(name)) for name, terms in topics.items()]
    return F.filter(F.array(*named), lambda x: x.isNotNull())


def _any(text: Column, terms: Sequence[str]) -> Column:
    out = F.lit(False)
    for t in terms:
        out = out | F.contains(text, F.lit(t))
    return out


any_of = _any


def occurrences(text: Column, terms: Sequence[str]) -> Column:
    """How often any of the terms occurs, each counted by itself."""
    out = F.lit(0)
    for t in terms:
        out = out + (F.length(text) - F.length(F.replace(text, F.lit(t), F.lit("")))) / len(t)
    return out.cast("long")


def present(text: Column, terms: Sequence[str]) -> Column:
    """How many of the terms occur."""
    out = F.lit(0)
    for t in terms:
        out = out + F.contains(text, F.lit(t)).cast("int")
    return out


def unsupported_numbers(answer: Column, evidence: Column, pattern: str = r"\d{4}") -> Column:
    """Numbers of the answer that the evidence doesn't have."""
    return F.array_except(F.regexp_extract_all(answer, F.lit(f"({pattern})")), F.regexp_extract_all(evidence, F.lit(f"({pattern})")))


def is_complete(answer: Column) -> Column:
    """Brackets opened are closed again, and the end is no open bracket, comma, colon or initial."""
    value = F.regexp_replace(F.coalesce(answer, F.lit("")), r"(?U)^\s+|\s+$", "")
    marks = F.split(F.regexp_replace(value, r"[^()\[\]{}]", ""), "")
    pairs = {")": "(", "]": "[", "}": "{"}

    def step(stack: Column, c: Column) -> Column:
        top = F.right(stack, F.lit(1))
        out = F.when(c.isin("(", "[", "{"), F.concat(stack, c))
        for close, open_ in pairs.items():
            out = out.when((c == close) & (top == open_), F.left(stack, F.length(stack) - 1))
        return out.otherwise(stack)

    stack = F.aggregate(marks, F.lit(""), step)
    return (value != "") & (stack == "") & ~value.rlike(r"(?:\(|\[|\{|[,;:]|[A-Za-z]\.)\s*$")


def reasons(*pairs: tuple[Column, str | Column]) -> Column:
    """Codes of the conditions that hold, distinct, in the order given; a null condition doesn't hold."""
    coded = [F.when(F.coalesce(test, F.lit(False)), code if isinstance(code, Column) else F.lit(code)) for test, code in pairs]
    return F.array_distinct(F.filter(F.array(*coded), lambda x: x.isNotNull()))


def blank(value: Column) -> Column:
    """Null, empty or white space only."""
    return F.coalesce(value.cast("string"), F.lit("")).rlike(r"^(?U)[\s\x1C-\x1F]*$")
