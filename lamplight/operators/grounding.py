"""Whether results are about what was asked, and whether they bear out what a question claims."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lamplight.functions import text as X

#: Questions that name no subject, and the phrases around one, in this order.
NO_SUBJECT = r"^\s*(?:그때|그\s*(?:때|당시|사람|인물|사건|장소|곳|역|단체|노선|뒤|다음|일|내용)|그\s*이후|관련(?:된)?\s*|그럼|그러면|그렇다면|언제|왜|어디|누가|누구|둘\s*중|확실하지|불확실)"
PAIRS = (
    r"^\s*(.{2,35}?)(?:와|과)\s*(.{2,35}?)(?=의\s*(?:날짜|시기|인물|사람)|\s*(?:날짜|시기|인물|사람))",
    r"^\s*(.{2,35}?)(?:와|과)\s*(.{2,35}?)(?=(?:을|를)?\s*(?:각각|구분|비교))",
)
#: Where one phrase is meant: before a facet, unless related things are asked for; before related persons or places.
FACET = r"^\s*(?:먼저|이제|이번에는?)?\s*(.{2,35}?)(?=\s*(?:시기|날짜|인물|사람|장소|활동)(?:만|은|는|을|를))"
RELATED = r"^\s*(.{2,40}?)(?=와\s*관련(?:된)?\s*(?:인물|사람|장소))"
#: Before a possessive and a facet: this phrase stays whole.
POSSESSED = r"^\s*(.{2,40}?)(?=의\s*(?:역사|배경|과정|활동|역할)(?:을|를|은|는))"
DESCRIBED = r"^\s*(.{2,40}?)(?=(?:을|를|에\s*대해)\s*(?:알려|설명|말해|이야기))"
NUMBERED = r"\d+(?:\.\d+)+[가-힣A-Za-z]+"
NAMES = r"구\s*목포\s*일본영사관|목포\s*일본영사관|구\s*일본영사관|동양척식주식회사(?:\s*목포지점)?|목포근대역사관(?:\s*[12]관)?|목포(?:역|항|진|시)|광주학생운동|한국전쟁|이범석"
INSTITUTIONS = r"(?<![0-9A-Za-z가-힣·])([0-9A-Za-z가-힣·]{2,20}(?:\s+[0-9A-Za-z가-힣·]{2,20}){1,2}\s*(?:전시관|역사관|박물관|기념관|지점|학교|건물))(?=(?:은|는|이|가|와|과|을|를|에서|에\s*대해))"
BEFORE_PARTICLE = r"(?<![0-9A-Za-z가-힣·])([0-9A-Za-z가-힣·]{2,30})(?=(?:의|은|는|이|가|와|과|을|를|에서|(?:으)?로\s*(?:돌아|복귀)))"
BEFORE_ABOUT = r"(?<![0-9A-Za-z가-힣·])([0-9A-Za-z가-힣·]{2,30})(?=에\s*대해)"
SWITCHED = r"(?:이번에는?|이제는?)\s+(.{2,40}?)(?=(?:을|를|에\s*대해)\s*(?:알려|설명|말해))"
RETURNED = r"(?:다시|아까)\s+(.{2,30}?)(?=(?:으)?로\s*(?:돌아|복귀))"
ASKING = r"왜|언제|어디|누가|누구|어떻게|무슨|알려|설명|말해|이야기|관계|역할|원인|이유|결과|영향"
#: Compound names and turns of phrase in the spelling of the texts, in this order.
COMPOUNDS = (
    (r"목포\s+(역|항|진)", "목포$1"),
    (r"일본\s+영사관", "일본영사관"),
    (r"동양\s+척식\s*주식회사", "동양척식주식회사"),
    (r"목포\s*근대\s*역사관", "목포근대역사관"),
    (r"커졌(?:는지|는가|어|어요)?", "성장 변천"),
    (r"달라졌(?:는지|는가|어|어요)?", "변화 변천"),
)


def joined_compounds(text: Column) -> Column:
    """Compound names without the blanks that people put into them."""
    for pattern, spelling in COMPOUNDS:
        text = F.regexp_replace(text, pattern, spelling)
    return text


def subjects(question: Column, profile: X.Profile = X.KOREAN) -> Column:
    """What a question is about, by the first rule of its grammar that finds something.

    Two phrases that are compared; one before a facet, before related persons, before a
    possessive (as it stands) or before a word of telling; names of institutions; words
    before particles, those first that are no recognised names; recognised names; a few
    content words alone.
    """
    def phrase(x: Column) -> Column:
        number = F.regexp_replace(F.regexp_extract(x, NUMBERED, 0), "(?:과|와|은|는|이|가|을|를)$", "")
        return F.when(x.rlike(NUMBERED), number).otherwise(F.array_join(F.slice(X.content_words(x, profile), 1, 3), " "))

    def read(text: Column) -> Column:
        one = lambda p, n=1: F.regexp_extract(text, p, n)
        every = lambda p: F.array_distinct(F.regexp_extract_all(text, F.lit(p if "([" in p else f"({p})")))
        captures = F.array_join(F.concat(every(BEFORE_PARTICLE), every(BEFORE_ABOUT), F.array(one(SWITCHED), one(RETURNED))), " ")
        return F.struct(
            text.alias("text"),
            F.transform(F.array(*[one(p, n) for p in PAIRS for n in (1, 2)], one(FACET), one(RELATED), one(DESCRIBED)), phrase).alias("phrases"),
            F.trim(F.regexp_replace(X.collapse(one(POSSESSED)), r"^(?:이번에는?|이제는?)\s+", "")).alias("possessed"),
            every(INSTITUTIONS).alias("institutions"),
            every(NAMES).alias("names"),
            F.transform(F.array(captures, text), lambda x: X.content_words(x, profile)).alias("words"),
        )

    def cascade(r: Column) -> Column:
        phrases = r["phrases"]
        both = lambda n: F.array_distinct(F.filter(F.slice(phrases, n, 2), lambda x: x != ""))
        some = lambda x: F.filter(F.array(x), lambda v: v != "")
        words, few = F.filter(r["words"][0], lambda w: ~w.rlike(r"^\d+(?:년|월|일)?$")), r["words"][1]
        found = [
            *(F.when(F.size(both(n)) == 2, both(n)) for n in (1, 3)),
            F.when(~F.contains(r["text"], F.lit("관련")), some(phrases[4])),
            some(phrases[5]),
            some(r["possessed"]),
            some(phrases[6]),
            r["institutions"],
            F.array_except(words, r["names"]),
            r["names"],
            words,
            F.when((F.size(few) == 1) | (F.size(few).between(2, 3) & ~r["text"].rlike(ASKING)), few),
        ]
        first = F.get(F.filter(F.array(*found), lambda x: F.size(x) > 0), F.lit(0))
        return F.when(r["text"].rlike(NO_SUBJECT) | first.isNull(), F.array().cast("array<string>")).otherwise(first)

    bound = lambda value, f: F.get(F.transform(F.array(value), f), F.lit(0))
    return bound(joined_compounds(X.collapse(question)), lambda text: bound(read(text), cascade))


def squeezed(text: Column) -> Column:
    return F.lower(F.regexp_replace(F.coalesce(text, F.lit("")), X.SPACE, ""))


#: Endings cut from the words of a claim, and words that claim nothing.
CLAIM_ENDINGS = r"(?:이라는|였다는|했다는|한다는|에서만|에게서|으로|에서|까지|부터|에는|에게|라는|다고|이고|이며|했지|됐지|있지|은|는|이|가|을|를|의)$"
CLAIM_STOP = ("자료", "근거", "기록", "확인", "질문", "전제", "사실", "내용", "말", "답", "알려", "맞아", "맞지", "맞는지", "했지", "있지", "년에")
CHECKING = r"전제|(?:말이\s*)?맞(?:아|지|는지)|(?:났|했|였|됐|있)지\?"
INVENTED = r"가상(?:의)?\s*(?:인물|사건|장소)|자료에\s*없|존재하지\s*않"


def unsupported_claim(question: Column, evidence: Column, this_year: int) -> Column:
    """Whether a question asserts what the evidence (title and text of all results) doesn't have: numbers, floors, future years, terms."""
    text, proof = F.coalesce(question, F.lit("")), F.coalesce(evidence, F.lit(""))
    every = lambda t, p: F.regexp_extract_all(t, F.lit(f"({p})"))
    lacking = lambda items: F.exists(items, lambda n: ~F.contains(proof, n))
    checking = text.rlike(CHECKING)
    floors = lambda t: F.transform(every(t, r"\d+\s*층"), lambda x: F.regexp_replace(x, r"\s+", ""))
    future = F.filter(every(text, r"(?<!\d)(?:20|21)\d{2}(?!\d)"), lambda y: y.cast("int") > this_year)
    terms = F.filter(F.transform(every(text, "[가-힣A-Za-z]{2,}"), lambda w: F.lower(F.regexp_replace(w, CLAIM_ENDINGS, ""))), lambda w: (F.length(w) >= 2) & ~w.isin(*CLAIM_STOP))
    compact = squeezed(evidence)
    return (proof != "") & (
        text.rlike(INVENTED)
        | (checking & lacking(every(text, r"(?<!\d)\d{2,4}(?!\d)")))
        | (F.size(F.array_except(floors(text), floors(proof))) > 0)
        | ((F.size(future) > 0) & ~F.exists(future, lambda y: F.contains(proof, y)))
        | (checking & F.exists(terms, lambda w: ~F.contains(compact, w)))
    )


#: Openings of factual articles, and words of navigation.
FACTUAL = ("정의 닫기", "개설 닫기", "내용 닫기", "변천 닫기", "생애 및 활동사항 닫기")
NOISE = ("수정 의견 작성", "비밀번호", "파일선택", "다운로드가 완료", "콘텐츠 이용 안내", "전체메뉴", "사이드메뉴", "미디어 자유이용")
PORTAL = ("코스 자세히 보기", "관련 여행코스", "위치 및 주변정보", "관심콘텐츠 담기", "동그라미")


def boilerplate_only(text: Column) -> Column:
    """No factual opening and at least two words of navigation."""
    return ~X.any_of(F.left(text, F.lit(160)), FACTUAL) & (X.occurrences(text, [*NOISE, *PORTAL]) >= 2)


def subject_agrees(subject: Column, title: Column, text: Column, aliases: dict[str, str] | None = None, profile: X.Profile = X.KOREAN) -> Column:
    """Whether a result is about the subject: in its title, early in its opening, as a word of its own, or all parts of it."""
    opening = F.left(text, F.lit(180))
    quoted = F.concat(F.lit(r"\Q"), subject, F.lit(r"\E"))
    edge = r"(?<![0-9A-Za-z가-힣])"
    early = F.regexp_instr(opening, F.concat(F.lit(edge), quoted)).between(1, 13)
    alone = (F.length(subject) >= 2) & F.regexp_like(text, F.concat(F.lit(edge), quoted, F.lit("(?![0-9A-Za-z가-힣])")))
    parts = X.content_words(subject, profile)
    whole = (F.size(parts) > 1) & F.forall(parts, lambda p: F.contains(opening, p))
    named = F.array_contains(X.content_words(title, profile), subject)
    for name, alias in (aliases or {}).items():
        named = named | (F.contains(squeezed(subject), F.lit(name)) & F.contains(squeezed(title), F.lit(alias)))
    return (subject != "") & (named | (~boilerplate_only(text) & ~X.any_of(opening, PORTAL) & (early | alone | whole)))


#: What a question asks for, and what an answer to it has.
DETAILS = (
    (r"원래|어떤\s*건물|건축", r"고전주의|양식|벽돌|건축|건립|착공|완공"),
    (r"언제|시기|연도|건립|설립|개통|준공|지어|세워|만들|생긴", r"(?:18|19|20)\d{2}년|건립|설립|개통|준공|세워|지어"),
    (r"왜|원인|이유|배경|계기", r"원인|이유|배경|계기|때문|위해|따라"),
    (r"누가|누구|사람|인물", r"참석|인물|사람|주도|대표|장관|교수|교사|학생"),
    (r"결과|영향|이후|그\s*뒤|다음", r"결과|영향|이후|이어|폐지|변경|전환"),
    (r"역할|중요", r"역할|기능|방어|교통|상업|행정|사용"),
)


def detail_matches(question: Column, text: Column) -> Column:
    """How many of the asked details a text has."""
    out = F.lit(0)
    for asked, answered in DETAILS:
        out = out + (question.rlike(asked) & text.rlike(answered)).cast("int")
    return out


def reordered(results: DataFrame, profile: X.Profile = X.KOREAN) -> DataFrame:
    """results (query_id, chunk_id, score, title, text, question, subject) by details, subject, title, noise, score, with rank."""
    c = F.col
    position = F.position(c("subject"), c("text"))
    parts = X.content_words(c("subject"), profile)
    strength = (
        F.when(X.blank(c("subject")), 0)
        .when(F.contains(c("title"), c("subject")), 3)
        .when(position.between(1, 25), 2)
        .when(position > 0, 1)
        .when((F.size(parts) > 1) & F.forall(parts, lambda p: F.contains(c("text"), p)), 2)
        .otherwise(0)
    )
    in_title = F.size(F.array_intersect(X.content_words(c("question"), profile), X.content_words(c("title"), profile)))
    noise = X.occurrences(c("text"), NOISE) - X.any_of(F.left(c("text"), F.lit(160)), FACTUAL).cast("int")
    order = Window.partitionBy("query_id").orderBy(detail_matches(c("question"), c("text")).desc(), strength.desc(), in_title.desc(), noise, c("score").desc(), "chunk_id")
    return results.withColumn("rank", F.row_number().over(order))


def named_subject_documents(chunks: DataFrame, queries: DataFrame) -> DataFrame:
    """(query_id, document_id) of documents of which a listed subject occurs in the query, case aside.

    Subjects meet queries by their first word, then are compared whole.
    """
    word = lambda t: F.regexp_extract(F.lower(t), r"(\S+)", 1)
    listed = chunks.select("document_id", F.explode("retrieval_subjects").alias("s")).select("document_id", F.lower(F.trim("s")).alias("s")).where("s <> ''").distinct()
    asked = queries.select("query_id", F.lower("text").alias("q"))
    # a subject may begin inside a word of the query, so each word offers its endings
    starts = asked.select("query_id", "q", F.explode(F.array_distinct(F.split("q", r"\s+"))).alias("w"))
    ends = starts.select("query_id", "q", F.explode(F.transform(F.sequence(F.lit(1), F.greatest(F.length("w"), F.lit(1))), lambda i: F.substring(F.col("w"), i, F.length("w")))).alias("e"))
    first = listed.select("document_id", "s", word(F.col("s")).alias("f"), F.left(word(F.col("s")), F.lit(2)).alias("k"))
    pairs = ends.withColumn("k", F.left("e", F.lit(2))).join(first, "k").where(F.contains("q", F.col("s")))
    return pairs.select("query_id", "document_id").distinct()


#: Identifiers that stand for no real place.
PLACEHOLDER = r"(?i)^(?:|unknown|(?:test|demo|sample|piece|place)(?:[-_]?\d+)?)$"


def context_label(value: Column, labels: dict[str, str], placeholder: str = PLACEHOLDER) -> Column:
    """The name of a place identifier; empty for placeholders."""
    key = F.lower(F.trim(F.coalesce(value, F.lit(""))))
    out = F.when(key.rlike(placeholder), "")
    for k, label in labels.items():
        out = out.when((key == k) | key.startswith(f"{k}-"), label)
    return out.otherwise(F.regexp_replace(value, "[_-]", " "))


def inside_folder(path: Column, root: str) -> Column:
    """Whether a path with its dots resolved stays below root."""
    plain = F.regexp_replace(path, r"/\./", "/")
    return plain.startswith(root.rstrip("/") + "/") & ~plain.rlike(r"(?:^|/)\.\.(?:/|$)")


def mirrors(pairs: DataFrame, rows: DataFrame) -> DataFrame:
    """pairs (id, near_id) with status and method: confirmed mirrors share a work id and come from different publisher families, others are suspected."""
    of = lambda key: rows.select(F.col("id").alias(key), F.col("work_id").alias(f"{key}_work"), F.col("publisher_family").alias(f"{key}_family"))
    both = pairs.join(of("id"), "id").join(of("near_id"), "near_id")
    mirrored = F.coalesce((F.col("id_work") != "") & (F.col("id_work") == F.col("near_id_work")) & (F.col("id_family") != F.col("near_id_family")), F.lit(False))
    return both.select("id", "near_id", F.when(mirrored, "confirmed").otherwise("suspected").alias("status"), F.when(mirrored, "mirror").otherwise("simhash_near").alias("method"))
