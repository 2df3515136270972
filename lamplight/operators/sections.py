"""Sections of source pages: lines cleaned of the page around them and gathered under titles.

Four kinds of pages: biographies (a profile, then activities that end where the years
jump, at awards and at transitions), heritage records, a chronology with fixed headings,
and all others.  A page is a row with an array of its lines.  Where sections begin is found
by comparing each line with the one before it, and a section is a slice of the array, so
the work grows with a page's length, no text is shuffled, and a task holds one page.

Cases: null and empty texts have no sections; rows of one id are told apart by their
texts, and equal rows are one; a kind that isn't known is generic.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lamplight.operators.search import small
from lamplight.sources.tables import written


def named_year(line: Column) -> Column:
    found = F.regexp_extract(F.substring(line, 1, 100), r"(?<!\d)((?:18|19|20)\d{2})년", 1)
    return F.nullif(found, F.lit("")).cast("int")


@dataclass(frozen=True)
class Markers:
    """Patterns of the lines that mark a page's parts; titles of the sections."""

    ui: str
    heritage_ui: str
    biography_ui: str
    reference: str
    basic: str
    award_field: str
    activity: str
    award: str
    transition: str
    year: Callable[[Column], Column]
    heritage_start: str
    chronology: dict[str, str]
    #: Titles of a chronology: before the opening, the line itself, the next, up to the occupation, two lines, up to the liberation, the rest; then of its summary.
    titles: tuple[str, ...]
    body: str = "본문"
    profile: str = "기본정보"
    record: str = "기본 정보"
    active: str = "활동"
    year_mark: str = "년"


_UI = r"닫기|프린트|페이지 인쇄|QR코드 바로보기|전승자 정보 바로보기|설명 비교하기|목록으로 이동하기|바로가기"
#: The lines of Korean heritage and biography pages.
KOREAN = Markers(
    ui=f"^(?:{_UI})$",
    heritage_ui=rf"^(?:{_UI}|본문|국가유산 검색|페이지|구성|이 페이지의 구성|의견 등록하기|의견처리 결과 확인|이전|다음|(?:이전|다음)\s+(?:문화유산|국가유산|항목|페이지))$",
    biography_ui=f"^(?:{_UI}|독립운동인명사전 - 한국독립운동정보시스템|모바일 메뉴 열기/닫기|⋮.+⋮)$",
    reference=r"^(?:\|참고문헌\||참고문헌)$",
    basic="^기본정보$",
    award_field=r"^포상훈격\(연도\)$",
    activity=r"^(?:운동계열|관련 단체|관련 사건|주요 활동|포상훈격\(연도\))$",
    award="^대한민국 정부",
    transition="^(?:출옥 이후|풀려난 뒤|석방된 뒤)",
    year=named_year,
    heritage_start="^기본 정보$",
    chronology={
        "start": "^삼국 이전$", "end": "^(?:담당자|이 페이지에서 제공하는 정보)", "summary": "^요약$", "opening": "^1895년", "occupation": "^일제강점기$", "liberation": "^8·15 광복 이후$",
        "summary_modern": "^고종32년", "summary_post": "^8·15 광복 이후$",
    },
    titles=("전근대 역사", "개항·거류·무역", "항만·도로·해상교통", "도시 기반시설·상수도", "일제강점기 도시 확장", "철도·교통", "광복 이후 현대 행정구역 변화", "원문 요약 전근대", "개항 이후 근대 도시 변화 요약", "원문 요약 광복 이후", "역사 본문", "원문 요약"),
)
#: Markers that occur in the synthetic texts.
SAMPLE = Markers(
    ui=r"^.{1,12}$",
    heritage_ui=r"^.{1,30}$",
    biography_ui=r"^(?:.{1,12}|.*\|.*)$",
    reference=r"^(?:Licensed|Copyright|SPDX|This program|Permission)",
    basic=r"^[A-Z][a-z]{1,3}[ .]",
    award_field=r"[a-z]tion\.$",
    activity=r"(?:ing|nt|re)\.$",
    award=r"^(?:The|Der|De|Los) ",
    transition=r"^(?:In|Of|En|Zu) ",
    year=lambda line: F.when(F.length(line) % 3 == 0, F.length(line) % 10),
    heritage_start=r"^[A-Z][a-z]+(?:ing|tion)",
    chronology={"start": r"^[A-Z][a-z]{3,5}[ .,]", "end": r"^[A-Z]e", "summary": r"^[A-Z]o", "opening": r"^[A-Z]h", "occupation": r"^[A-Z]n", "liberation": r"^[A-Z]r", "summary_modern": r"^[A-Z]h", "summary_post": r"^[A-Z]n"},
    titles=tuple("abcdefgklmno"),
    body="body", profile="profile", record="record", active="active", year_mark="",
)
LINE_ENDS = r"\r\n|[\n\r\x0B\f\x1C-\x1E\x85  ]"


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with the value made once, however often it is read, also inside lambdas."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def first(lines: Column, pattern: str, since: Column | None = None) -> Column:
    """Place of the first line that matches, at `since` or later; null for none."""
    hits = F.transform(lines, (lambda x: x.rlike(pattern)) if since is None else (lambda x, i: (i >= since) & x.rlike(pattern)))
    return (F.nullif(F.array_position(hits, True), F.lit(0)) - 1).cast("int")


def before(values: Column) -> Column:
    """For each value the one before it; for the first itself."""
    return F.slice(F.concat(F.slice(values, F.lit(1), F.lit(1)), values), F.lit(1), F.size(values))


def after(places: Column, end: Column) -> Column:
    """For each place the one after it; for the last the end."""
    return F.slice(F.concat(places, F.array(end)), F.lit(2), F.size(places))


def part(lines: Column, start: Column, end: Column) -> Column:
    return F.slice(lines, start + 1, end - start)


def section(title: Column, lines: Column, metadata: Column | None = None) -> Column:
    return F.struct(title.alias("title"), lines.alias("lines"), (F.array().cast("array<string>") if metadata is None else metadata).alias("metadata"))


def single(value: Column, test: Column) -> Column:
    """An array of the value if the test holds, else an empty one."""
    return F.filter(F.array(value), lambda _: test)


def distinct_pages(docs: DataFrame, id_col: str, text_col: str, kind: Column) -> DataFrame:
    """(id, kind, text): of equal rows one; only rows that have equal ones are shuffled with their texts."""
    text = F.coalesce(text_col, F.lit(""))
    known = F.when(kind.isin("biography", "heritage", "chronology"), kind).otherwise("generic")
    rows = docs.select(F.col(id_col), known.alias("kind"), F.xxhash64(text).alias("_h"), text.alias("text"))
    keys = [id_col, "_h", "kind"]
    again = written(rows.groupBy(*keys).agg(F.count("*").alias("_n")).where("_n > 1").select(F.col(id_col).alias("_i"), F.col("_h").alias("_g"), F.col("kind").alias("_k")), "equal-pages")
    if again.isEmpty():
        return rows
    again = small(again)
    same = F.col(id_col).eqNullSafe(F.col("_i")) & (F.col("_h") == F.col("_g")) & (F.col("kind") == F.col("_k"))
    return rows.join(again, same, "left_anti").unionByName(rows.join(again, same, "left_semi").dropDuplicates(keys))


def page_lines(text: Column) -> Column:
    """The lines of a text that aren't blank, runs of blanks one."""
    return F.filter(F.transform(F.split(text, LINE_ENDS), lambda x: F.regexp_replace(F.regexp_replace(x, r"[ \t]+", " "), r"^\s+|\s+$", "")), lambda x: x != "")


def story_lines(lines: Column, kind: Column, start: Column, m: Markers) -> Column:
    """The lines without those of the page around them."""

    def told(ui: str) -> Column:
        return let(first(lines, m.reference), lambda ref: F.filter(lines, lambda x, i: (ref.isNull() | (i < ref)) & ~x.rlike(ui)))

    heritage = let(F.coalesce(first(lines, m.heritage_start), F.lit(0)), lambda record: F.filter(lines, lambda x, i: (i >= record) & ~x.rlike(m.heritage_ui)))
    chronology = let(F.coalesce(first(lines, m.chronology["end"], start), F.size(lines)), lambda end: part(lines, start, end))
    return F.when(kind == "heritage", heritage).when(kind == "chronology", chronology).when(kind == "biography", told(m.biography_ui)).otherwise(told(m.ui))


def activities(lines: Column, subject: Column, m: Markers) -> Column:
    """Sections of a biography's narrative: awards and transitions end an activity in any case, and so do years two or more apart between these."""
    marks = F.zip_with(lines, before(lines), lambda x, b: F.struct((x.rlike(m.award) | x.rlike(m.transition) | b.rlike(m.award)).alias("hard"), m.year(x).alias("year")))

    def cut(marked: Column) -> Column:
        placed = F.transform(marked, lambda x, i: F.struct(i.alias("n"), ((i == 0) | x["hard"]).alias("hard"), x["year"].alias("year")))
        jumps = lambda x, b: x["hard"] | F.coalesce(F.abs(x["year"] - b["year"]) >= 2, F.lit(False))
        begun = let(F.filter(placed, lambda x: x["hard"] | x["year"].isNotNull()), lambda e: F.zip_with(e, before(e), lambda x, b: F.struct(x["n"].alias("n"), jumps(x, b).alias("begins"))))
        starts = F.transform(F.filter(begun, lambda x: x["begins"]), lambda x: x["n"])

        def told(a: Column, z: Column) -> Column:
            year = F.get(F.filter(part(marked, a, z), lambda x: x["year"].isNotNull()), F.lit(0))["year"]
            return section(F.concat(subject, F.lit(" "), F.coalesce(F.concat(year.cast("string"), F.lit(f"{m.year_mark} ")), F.lit("")), F.lit(m.active)), part(lines, a, z))

        return let(starts, lambda p: F.zip_with(p, after(p, F.size(lines)), told))

    return let(marks, cut)


def biography(lines: Column, m: Markers) -> Column:
    """The profile, with what it is filed under as metadata, and the activities."""

    def parts(basic: Column) -> Column:
        end = let(first(lines, m.award_field, basic), lambda award: F.when(award.isNotNull(), F.least(F.size(lines), award + 2)).otherwise(basic))
        return let(F.struct(F.greatest(F.lit(0), basic - 2).alias("start"), end.alias("end")), split)

    def split(at: Column) -> Column:
        start, end = at["start"], at["end"]
        subject = F.get(lines, start)
        filed = let(first(part(lines, start, end), m.activity), lambda f: F.coalesce(start + f, end))
        profile = let(filed, lambda f: section(F.concat(subject, F.lit(f" {m.profile}")), part(lines, start, f), part(lines, f, end)))
        return F.concat(single(profile, end > start), let(part(lines, end, F.size(lines)), lambda told: activities(told, subject, m)))

    return let(first(lines, m.basic), lambda basic: F.when(basic.isNull(), whole(lines, m.body)).otherwise(parts(basic)))


def chronology(lines: Column, m: Markers) -> Column:
    """The parts between the headings of a chronology and of its summary."""
    patterns, titles = m.chronology, F.array(*map(F.lit, m.titles))

    def numbered(h: Column) -> Column:
        bare = h["summary_modern"].isNull() | h["summary_post"].isNull()

        def number(n: Column) -> Column:
            summary = F.when(bare, 11).when((n >= h["summary_modern"]) & (n >= h["summary_post"]), 9).when(n >= h["summary_modern"], 8).otherwise(7)
            story = F.when(n >= h["liberation"], 6).when(n >= h["occupation"] + 2, 5).when(n >= h["occupation"], 4).when(n >= h["opening"] + 2, 3)
            return F.when(n >= h["sum"], summary).otherwise(story.when(n == h["opening"] + 1, 2).when(n == h["opening"], 1).otherwise(0))

        numbers = F.transform(lines, lambda _, i: number(i))
        changes = let(numbers, lambda k: F.transform(F.zip_with(k, before(k), lambda a, b: F.struct(a.alias("k"), (a != b).alias("new"))), lambda x, i: F.struct(i.alias("n"), x["k"].alias("k"), (x["new"] | (i == 0)).alias("new"))))
        begun = F.filter(changes, lambda x: x["new"])
        cut = let(begun, lambda p: F.zip_with(p, after(F.transform(p, lambda x: x["n"]), F.size(lines)), lambda a, z: section(F.get(titles, a["k"]), part(lines, a["n"], z))))
        return F.when(h["opening"].isNull() | h["occupation"].isNull() | h["liberation"].isNull(), whole(lines, m.titles[10])).otherwise(cut)

    def heads(at: Column) -> Column:
        told = part(lines, F.lit(0), at)
        return F.struct(
            at.alias("sum"),
            *[first(told, patterns[h]).alias(h) for h in ("opening", "occupation", "liberation")],
            *[first(lines, patterns[h], at).alias(h) for h in ("summary_modern", "summary_post")],
        )

    return let(F.coalesce(first(lines, patterns["summary"]), F.size(lines)), lambda at: let(heads(at), numbered))


def whole(lines: Column, title: str) -> Column:
    return single(section(F.lit(title), lines), F.size(lines) > 0)


def sections(docs: DataFrame, kind: Column, m: Markers = KOREAN, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, section, title, lines, metadata): the sections of each text, numbered from 0.

    metadata holds the lines of a biography's profile that say what it is filed under.
    """

    def cleaned(lines: Column) -> Column:
        start = F.when(F.col("kind") == "chronology", first(lines, m.chronology["start"]))
        return let(start, lambda at: let(F.when((F.col("kind") == "chronology") & at.isNull(), "generic").otherwise(F.col("kind")), lambda k: F.struct(k.alias("kind"), story_lines(lines, k, at, m).alias("lines"))))

    def parted(page: Column) -> Column:
        lines, of = page["lines"], page["kind"]
        return F.when(of == "biography", biography(lines, m)).when(of == "chronology", chronology(lines, m)).when(of == "heritage", whole(lines, m.record)).otherwise(whole(lines, m.body))

    pages = distinct_pages(docs, id_col, text_col, kind)
    found = pages.select(id_col, let(let(page_lines(F.col("text")), cleaned), parted).alias("_sections"))
    return found.select(id_col, F.posexplode_outer("_sections").alias("section", "_s")).where("_s is not null").select(id_col, "section", "_s.title", "_s.lines", "_s.metadata")
