"""Persons that sentences name, with what the same sentence says of them.

A person is a name with its spelling in characters beside it, or a name after a title, in
a sentence about what persons do.  Names that end like places, bodies or offices, whose
spelling does, or that begin with no family name, are none; the subject of a question is
no person found.  A relation (an office held, an award) has to be in the same sentence,
within a distance; sentences and sources are never joined.

Cases: null and empty texts name no one; a name counts once for each sentence; ties are
none; very long texts are cut into sentences first; empty tables give empty results.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lamplight.functions import text as X


@dataclass(frozen=True)
class Rules:
    """Patterns; `spelled` has the groups name and spelling, `titled` the name alone."""

    spelled: str
    titled: str
    family: str
    not_name: str
    not_spelling: str
    context: str
    titles: str
    predicates: str
    award: str
    particles: str = ""
    objects: str = ""
    aside: str = r"(?:\([^)]*\))?"
    stop: str = r"[^.!?。！？]"


#: How Korean sources name persons.
KOREAN = Rules(
    spelled=r"(?<![가-힣])([가-힣]{2,4})\s*\(([㐀-鿿豈-﫿]{2,4})(?:\s*,[^)]*)?\)",
    titled=r"(?:학생이었던|학생인|주도하였던|주도한|참여한|목사|장로|선교사|박사|교수|회장|대표|위원장|간사|총리|장관|대사|학장|총장)\s+([가-힣]{2,4}?)(?=(?:은|는|이|가|을|를|과|와|\s))",
    family="^[김이박최정강조윤장임한오서신권황안송류홍전고문양손배백허유남심노하곽성차주우구]",
    not_name=r"(?:학교|대학교|대학|위원회|협의회|연맹|조합|단체|기관|회사|정부|지회|본부|박물관|전시관|역사관|적인|적|회|군|시|도|면|리|동|역)$",
    not_spelling="[會校院社團黨部局館寺里洞郡市道國驛領洲]$",
    context=r"관계자|발기인|목사|선교사|박사|교수|회장|대표|위원장|간사|총리|장관|대사|학장|총장|참여|활동|주도|조직|결성|역임|선출|취임|태어|연행|구속|독립운동|만세운동|모여|발표",
    titles="회장|지회장|대표|위원장|간사|총리|장관|대사|학장|총장|교수",
    predicates="되|되어|됐|맡|역임|취임",
    award=r"(?:훈장|포장)[^.!?。！？]{0,20}(?:추서|수훈|받)",
    particles="(?:은|는|이|가)?",
    objects="(?:이|가|을|를|으로)?",
)
#: Rules whose marks occur in the synthetic texts.
SAMPLE = Rules(
    spelled=r"([A-Z][a-z]{3,9}) ([a-z]{2,6})[,.]",
    titled=r"(?:of|de|der|du)\s+([a-z]{7,9})(?:,| the| la| les| die)",
    family="^[A-Eo-tT]",
    not_name="(?:ing|tion|ment)$",
    not_spelling="(?:ed|er|eau)$",
    context="that|with|qui|und|los",
    titles="the|les|der|la",
    predicates="is|on|re|e",
    award=r"(?:or|ou|an)[^.!?]{0,20}(?:by|for|ent)",
    aside="(?: [a-z]+[,.])?",
    stop="[^.!?]",
)


def persons_in(sentence: Column, rules: Rules, subject: Column | None = None) -> Column:
    """Distinct names in a sentence, spelled ones first, as structs of name and spelling (empty for titled ones)."""
    spelled = F.arrays_zip(F.regexp_extract_all(sentence, F.lit(rules.spelled), F.lit(1)).alias("name"), F.regexp_extract_all(sentence, F.lit(rules.spelled), F.lit(2)).alias("spelling"))
    titled = F.transform(F.regexp_extract_all(sentence, F.lit(rules.titled), F.lit(1)), lambda n: F.struct(n.alias("name"), F.lit("").alias("spelling")))

    def person(x: Column) -> Column:
        good = x["name"].rlike(rules.family) & ~x["name"].rlike(rules.not_name) & ~x["spelling"].rlike(rules.not_spelling)
        return good if subject is None else good & (F.regexp_replace(x["name"], X.SPACE, "") != F.regexp_replace(F.coalesce(subject, F.lit("")), X.SPACE, ""))

    distinct = lambda every: F.filter(every, lambda x, i: F.array_position(F.transform(every, lambda y: y["name"]), x["name"]) == i + 1)
    # A lambda over an array of one binds what it holds, which is then made once.
    first = F.get(F.transform(F.array(F.filter(F.concat(spelled, titled), person)), distinct), F.lit(0))
    return F.when(sentence.rlike(rules.context), first).otherwise(F.array().cast("array<struct<name:string,spelling:string>>"))


def person_rows(docs: DataFrame, rules: Rules = KOREAN, id_col: str = "doc_id", text_col: str = "text", subject_col: str | None = None) -> DataFrame:
    """(id, sentence, place, person, spelling, relation, value): persons by sentence, counted from 0.

    place is where the name first occurs in its sentence, in characters from 0; relation is
    role (value: the office), award, or empty.
    """
    carried = [id_col, *([subject_col] if subject_col else [])]
    some = docs.where(F.col(text_col).rlike(rules.context)).select(*carried, X.sentences(F.col(text_col)).alias("_all"))
    rows = some.select(*carried, F.posexplode_outer("_all").alias("sentence", "_s")).where("_s is not null")
    # The array is a column of its own before it is exploded, so that it is made once.
    named = rows.withColumn("_persons", persons_in(F.col("_s"), rules, F.col(subject_col) if subject_col else None))
    each = named.select(id_col, "sentence", "_s", F.explode_outer("_persons").alias("p")).where("p is not null").select(id_col, "sentence", "_s", "p.*")
    role = F.concat(F.col("name"), F.lit(f"{rules.aside}{rules.particles}{rules.stop}{{0,35}}?({rules.titles}){rules.objects}\\s*(?:{rules.predicates})"))
    award = F.concat(F.col("name"), F.lit(f"{rules.aside}{rules.stop}{{0,45}}{rules.award}"))
    office = F.call_function("regexp_extract", F.col("_s"), role, F.lit(1))
    found = each.withColumns({"_office": office, "_award": F.regexp_like("_s", award)})
    return found.select(
        id_col,
        "sentence",
        (F.instr("_s", F.col("name")) - 1).alias("place"),
        F.col("name").alias("person"),
        "spelling",
        F.when(F.col("_office") != "", "role").when(F.col("_award"), "award").otherwise("").alias("relation"),
        F.when(F.col("_office") != "", F.col("_office")).when(F.col("_award"), "award").otherwise("").alias("value"),
    )
