"""What a turn of a conversation is about: follow-up questions resolved against the turns before.

A question's grammar is read by expressions, row by row.  What was said before is a small
state, the same in batch and as a stream: slots (place, topic, subject, person and so on),
the last question, and the evidence of at most eight turns, which is a stack of topics to
return to.  Answers' prose is never taken as a fact: of an answer only the ids of the
chunks that it was given count, and whether it owned up to knowing nothing.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator
from dataclasses import asdict, dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from lamplight.functions import text as X
from lamplight.operators import grounding, policy

NEVER = r"(?!)"


@dataclass(frozen=True)
class Grammar:
    """How a language refers back.  Patterns named `whole_` have to match a whole question, the others occur in it."""

    subjects: Callable[[Column], Column]
    followup: str
    whole_elliptical: tuple[str, ...]
    whole_transform: str
    whole_expand: str
    correction: str
    place_reference: str
    person_reference: str = NEVER
    place: str = NEVER
    person: str = NEVER
    not_persons: tuple[str, ...] = ()
    not_subjects: tuple[str, ...] = ()
    no_persons: str = NEVER
    person_question: str = NEVER
    name: str = NEVER
    then: str = NEVER
    whole_then_name: tuple[str, ...] = ()
    whole_bare_name: str = NEVER
    whole_people: str = NEVER
    whole_parallel: str = NEVER
    first_name: str = NEVER
    parallel_joint: str = " "
    anchored: tuple[str, ...] = ()
    event: str = NEVER
    period: str = NEVER
    comparison: str = NEVER
    numbered: str = NEVER
    number: str = NEVER
    originally: str = NEVER
    pointing: str = NEVER
    first_of_both: str = NEVER
    second_of_both: str = NEVER
    both: str = NEVER
    back: str = NEVER
    back_to: str = NEVER
    back_to_first: str = NEVER
    related: str = NEVER
    this_piece: str = NEVER
    unknown: str = NEVER
    #: (word added to a search, pattern) for a return to the first topic.
    details: tuple[tuple[str, str], ...] = ()
    intents: tuple[tuple[str, str], ...] = ()
    place_labels: dict[str, str] = field(default_factory=dict)


#: How Korean questions refer back.
KOREAN = Grammar(
    subjects=grounding.subjects,
    followup=(
        r"그\s*(?:때|당시|사람|사건|학교|건물|역|노선|회사|곳|장소|뒤|과정|자료)|여기|이곳|거기|아까|방금|이후에는?|왜\s*(?:그랬|왔|온)|누가\s*(?:참여|관여|주도)|"
        r"그래서|그건|그게|그\s*(?:일|내용|말)|그\s*사람\s*말고|관련(?:된)?\s*(?:인물|사람)|관련\s*(?:시기|날짜|장소)|첫(?:\s*번째)?\s*단체|두\s*번째\s*단체|둘(?:을|은|이)|"
        r"그\s*(?:이유|결과|영향|의미|배경)|그럼|그러면|그렇다면|이어서|계속해서|그\s*다음|지금(?:은)?|또\s*있어|다른\s*건|원래(?:는)?\s*(?:뭐|무엇|어떤)|"
        r"확실하지\s*않은\s*부분|불확실한\s*부분|돌아가|돌아오"
    ),
    whole_elliptical=(
        r"(?i)(?:(?:그럼|그러면|그렇다면)\s*)?(?:좀\s*)?(?:더\s*)?(?:왜|언제|어디서|누가|누구|어떻게|무슨\s*이유(?:로)?|이유|결과|영향|의미|배경|그다음|다음|"
        r"뭐\s*하는\s*(?:곳|기관|회사)(?:이었어|이야|인가요)?|(?:건립|설립|개통|준공)\s*시기)"
        r"(?:은|는|이|가|부터|까지|였어|였어요|인가요|야|예요|지|요|\s*(?:알려\s*줘|설명해\s*줘|말해\s*줘|지었어|만들었어|왔던\s*거야))?[?.!]*",
        r"(?i)(?:아주\s*)?(?:좀\s*)?(?:더\s*)?(?:쉽게|자세히|짧게|간단히|간단하게|다시)\s*(?:설명해|알려|말해|요약해|정리해|풀어)(?:\s*줘|\s*주세요|요)?[?.!]*",
        r"(?i)(?:원래(?:는)?\s*(?:뭐|무엇)(?:였어|인가요|야)?|또\s*있어|다른\s*건|관련\s*(?:인물|사람|시기|날짜|장소)(?:은|는)?)[?.!]*",
        r"(?:왜|언제|누가|누구|어떻게|그럼|그러면|그렇다면)[^?.!]{0,24}[?.!]?",
    ),
    whole_transform=(
        r"(?i)(?:쉽게|더\s*쉽게|짧게|간단히|간단하게|자세히|다시|한\s*줄로?|핵심만(?:\s*말해\s*줘)?|무슨\s*(?:말|뜻)이야)[?.!]*|"
        r"그(?:거|게|건)(?:\s*(?:무슨|어떤)\s*(?:말|뜻)(?:이야|이야기야|인가요)?)?[?.!]*|그\s*말이\s*(?:뭐야|무슨\s*뜻이야)[?.!]*|"
        r"(?:간단히\s*말하면|좀\s*풀어서\s*말해\s*줘|한\s*문장으로\s*말해\s*줘)[?.!]*|"
        r"(?:아주\s*)?(?:좀\s*)?(?:더\s*)?(?:쉽게|짧게|간단히|간단하게|한\s*문장으로|다시)\s*(?:설명해|알려|말해|요약해|정리해|풀어)(?:\s*줘|\s*주세요|요)?[?.!]*|"
        r"아까\s*답(?:을|변을)?\s*다시\s*(?:설명해|말해)(?:\s*줘|\s*주세요)?[?.!]*|(?:정리해서|요약해서)\s*(?:알려|말해)(?:\s*줘|\s*주세요|요)?[?.!]*|"
        r"(?:초등학생|아이)(?:도|가)?\s*(?:이해할\s*수\s*있게|알게)\s*(?:설명해|알려|말해)?(?:\s*줘|\s*주세요|요)?[?.!]*"
    ),
    whole_expand=(
        r"(?i)(?:더|자세히)[?.!]*|(?:(?:좀|조금)\s*)?더\s*(?:자세히\s*)?(?:설명해|알려|말해)(?:\s*줘|\s*주세요|요)?[?.!]*|"
        r"(?:그\s*(?:사건|행사|내용)|관련\s*내용)(?:에\s*대해|도)?\s*더\s*(?:자세히\s*)?(?:설명해|알려|말해)?(?:\s*줘|\s*주세요|요)?[?.!]*|"
        r"(?:배경|결과|과정|영향)(?:과|와|까지|도|을|를|부터)?[^?.!]{0,24}(?:자세히|구체적으로|더\s*알려)[^?.!]*[?.!]*|"
        r"(?=[^?.!]*(?:배경|결과|과정|영향))[^?.!]*(?:자세히|구체적으로|더\s*알려)[^?.!]*[?.!]*|구체적으로\s*(?:설명해|알려|말해)(?:\s*줘|\s*주세요|요)?[?.!]*"
    ),
    correction=r"(?i)(?:^|\s)(?:아니|그게\s*아니라|내가\s*묻는\s*건|내\s*말은|그\s*사람이\s*아니라|다시\s*확인)",
    place_reference=r"여기|이곳|거기|그곳|그\s*장소|이\s*장소",
    person_reference=r"(?:그|이|저)\s*(?:사람|인물)|그(?:는|가|를)(?=\s|[?.!,]|$)",
    place=r"구\s*목포\s*일본영사관|구\s*일본영사관|목포근대역사관\s*[12]관|목포(?:역|항|부|진|해관|세관)|삼학도|유달산|고하도|무안감리서|동양척식주식회사(?:\s*목포지점)?|호남은행|일본영사관|목포",
    person=r"(?<![가-힣])([가-힣]{2,4})(?=(?:은|는|이|가)[^?.!]{0,40}(?:어떤\s*사람|누구|인물|참석|도착|왔|무슨\s*일|무엇을\s*했|뭘\s*했|온\s*(?:이유|사건)|갔|간\s*이유))",
    not_persons=("사람", "인물", "누구", "당시", "당시에", "그때", "여기", "결과", "언제였어", "왜", "어떻게", "전시관", "건물", "장소", "여기서", "거기서", "이곳", "그곳"),
    not_subjects=("하는", "핵심만", "말해줘", "곳이었어"),
    no_persons=r"관련(?:된)?\s*(?:인물|사람)|인물이나\s*장소",
    person_question=r"누구|사람|인물|그는|무슨\s*일|무엇을\s*했|뭘\s*했",
    name=r"[가-힣]{2,4}",
    then=r"^\s*(?:그럼|그러면|그렇다면)\s+",
    whole_then_name=(r"(?:그럼|그러면|그렇다면)\s+([가-힣]{2,4}?)(?:은|는|이|가)[?.!]?", r"(?:그럼|그러면|그렇다면)\s+([가-힣]{2,4})[?.!]?"),
    whole_bare_name=r"([가-힣]{2,4}?)(?:은|는|이|가)?[?.!]?",
    whole_people=r"(?:.*)관련(?:된)?\s*(?:인물|사람)(?:은|이)?\s*누구(?:인가요|예요|야)?[?.!]?",
    whole_parallel=r"(?:(?:그럼|그러면|그렇다면)\s*)?[가-힣]{2,4}(?:은|는|이|가)?[?.!]?",
    first_name=r"(?<![가-힣])[가-힣]{2,4}(?=(?:은|는|이|가))",
    parallel_joint="에 관해 ",
    anchored=(r"그(?:게|것|일)|거기|그곳", r"왜\s+.+(?:에|에서)\s*(?:있|갔|왔)"),
    event=r"(?:학생운동|독립운동|노동운동|개항|시위|파업|사건)",
    period=r"(?:18|19|20)\d{2}년|일제강점기|대한제국|근대",
    comparison=r"차이|달라|비교",
    numbered=r"(.+?)\s*([12])관",
    number=r"([12])관",
    originally=r"^\s*원래(?:는)?\s*(?:뭐|무엇|어떤)",
    pointing=r"그(?:거|게|건|\s*말)",
    first_of_both=r"첫(?:\s*번째)?\s*단체",
    second_of_both=r"두\s*번째\s*단체",
    both=r"첫(?:\s*번째)?\s*단체|두\s*번째\s*단체|둘(?:을|은|이|\s*중)|두\s*사건|확실하지\s*않은\s*부분|불확실한\s*부분",
    back=r"다시|아까|돌아가|돌아오|복귀",
    back_to=r"(?:다시|아까)\s+([0-9A-Za-z가-힣·]{2,30})(?:으?로|\s*이야기)",
    back_to_first=r"다시\s*(?:첫|처음)\s*(?:사건|주제)",
    related=r"관련|와도|과도",
    this_piece=r"이\s*조각|현재\s*조각|방금\s*본",
    unknown=r"(?i)확인하지\s*못|확인할\s*수\s*없|근거를\s*확인하지\s*못|추측하지\s*않|insufficient[_ ]evidence|llm[_ ]error",
    details=(("장소", r"장소|어디"), ("인물", r"인물|사람|누구"), ("시기", r"언제|시기|연도|날짜")),
    intents=policy.INTENTS,
    place_labels={"mokpo-station": "목포역", "mokpo_station": "목포역", "mokpo-yeok": "목포역", "mokpo-port": "목포항", "mokpo_port": "목포항", "samhakdo": "삼학도", "yudalsan": "유달산"},
)
#: A grammar whose marks occur in the synthetic conversations.
SAMPLE = Grammar(
    subjects=lambda q: F.slice(F.array_distinct(F.regexp_extract_all(q, F.lit(r"([a-z]{11,})"))), 1, 2),
    followup=r"(?:^|[^A-Za-z])(?:that|qui|und|los)(?:[^A-Za-z]|$)",
    whole_elliptical=(r"(?s).{1,60}",),
    whole_transform=r"(?s)(?:In|La|Die) .*",
    whole_expand=r"(?s)(?:Of|The|De|Der) .*",
    correction=r"^(?:An|Re|En|Er)",
    place_reference=r"(?:^|[^A-Za-z])(?:at|sur|auf)(?:[^A-Za-z]|$)",
    place=r"[A-Z][a-z]{2,}tion",
    event=r"[a-z]{5,}tion",
    period=r"[a-z]{4,}ing",
    back=r"(?:^|[^A-Za-z])(?:with|avec|mit)(?:[^A-Za-z]|$)",
    back_to_first=r"(?:^|[^A-Za-z])(?:was|un|ein)(?:[^A-Za-z]|$)",
    unknown=r"(?:^|[^A-Za-z])(?:had|not|nicht)(?:[^A-Za-z]|$)",
    details=(("place", r" at "), ("people", r" by ")),
    intents=(("time", r"(?i)(?:^|[^a-z])when"), ("cause", r"(?i)(?:^|[^a-z])for(?:[^a-z]|$)")),
)


def whole(text: Column, pattern: str) -> Column:
    flags, rest = re.match(r"((?:\(\?[a-z]+\))?)(.*)", pattern, re.DOTALL).groups()
    return text.rlike(rf"{flags}^(?:{rest})$")


def question_features(text: Column, named: Column, g: Grammar) -> Column:
    """What a question's own words say, as a struct; nothing of it depends on other turns.  named: its subjects."""
    asked = F.regexp_replace(text, r"^\s+|\s+$", "")
    found = lambda p: F.array_distinct(F.regexp_extract_all(text, F.lit(p if re.compile(p).groups else f"({p})")))
    then_name = F.lit("")
    for p in reversed(g.whole_then_name):
        then_name = F.when(whole(asked, p), F.regexp_extract(asked, f"^(?:{p})$", 1)).otherwise(then_name)
    persons = F.filter(found(g.person), lambda w: ~w.isin(*g.not_persons)) if g.not_persons else found(g.person)
    subjects = F.filter(named, lambda w: ~w.isin(*g.not_subjects)) if g.not_subjects else named
    transform = whole(asked, g.whole_transform)
    elliptical = F.lit(False)
    for p in g.whole_elliptical:
        elliptical = elliptical | whole(asked, p)
    anchored = F.lit(False)
    for p in g.anchored:
        anchored = anchored | text.rlike(p)
    detail = F.lit("")
    for word, p in reversed(g.details):
        detail = F.when(text.rlike(p), word).otherwise(detail)
    silent = text.rlike(g.originally) | (transform & text.rlike(g.pointing))
    return F.struct(
        found(g.place).alias("places"),
        F.when(text.rlike(g.no_persons) | text.rlike(g.person_reference), F.array().cast("array<string>")).otherwise(persons).alias("persons"),
        F.when(silent, F.array().cast("array<string>")).otherwise(subjects).alias("subjects"),
        named.alias("all_subjects"),
        found(g.event).alias("events"),
        F.regexp_extract_all(text, F.lit(f"({g.period})")).alias("periods"),
        text.rlike(g.followup).alias("followup"),
        elliptical.alias("elliptical"),
        transform.alias("transform"),
        whole(asked, g.whole_expand).alias("expand"),
        text.rlike(g.correction).alias("correct"),
        text.rlike(g.place_reference).alias("place_reference"),
        text.rlike(g.person_reference).alias("person_reference"),
        text.rlike(g.person_question).alias("person_question"),
        text.rlike(g.then).alias("then"),
        then_name.alias("then_name"),
        F.when(whole(asked, g.whole_bare_name), F.regexp_extract(asked, f"^(?:{g.whole_bare_name})$", 1)).otherwise("").alias("bare_name") if re.compile(g.whole_bare_name).groups else F.lit("").alias("bare_name"),
        whole(asked, g.whole_people).alias("people"),
        whole(asked, g.whole_parallel).alias("parallel"),
        anchored.alias("anchored"),
        text.rlike(g.comparison).alias("comparison"),
        (F.regexp_extract(text, g.number, 1) if re.compile(g.number).groups else F.lit("")).alias("number"),
        F.when(~text.rlike(g.both), 0).when(text.rlike(g.first_of_both), 1).when(text.rlike(g.second_of_both), 2).otherwise(3).alias("ordinal"),
        text.rlike(g.back).alias("back"),
        (F.regexp_extract(text, g.back_to, 1) if re.compile(g.back_to).groups else F.lit("")).alias("back_to"),
        text.rlike(g.back_to_first).alias("back_to_first"),
        text.rlike(g.related).alias("related"),
        text.rlike(g.this_piece).alias("this_piece"),
        detail.alias("detail"),
        policy.intent(text, g.intents).alias("intent"),
    )


@dataclass
class Memory:
    """What is known of a conversation before a turn; evidence has (user, place, topic, subjects), the newest last."""

    turns: int = 0
    asked: str = ""
    trusted: bool = False
    place: str = ""
    piece: str = ""
    topic: str = ""
    subject: str = ""
    person: str = ""
    anchor: str = ""
    answered: str = ""
    event: str = ""
    period: str = ""
    entities: list[str] = field(default_factory=list)
    people: list[str] = field(default_factory=list)
    evidence: list[dict] = field(default_factory=list)
    waiting: dict | None = None

    def known(self, slot: str) -> str:
        """A place or topic, if retrieval bore it out or the last answer had something to say."""
        value = getattr(self, slot)
        return value if value and (self.trusted or any(e[slot] == value for e in self.evidence)) else ""

    def anchor_or_question(self) -> str:
        """What the conversation is about by evidence: its anchor, else the newest question on its place or topic, one with a subject first."""
        if self.anchor:
            return self.anchor
        place, topic = self.known("place"), self.known("topic")
        on = [e for e in reversed(self.evidence) if (place and e["place"] == place) or (topic and e["topic"] == topic)]
        return next((e["user"] for e in on if e["subjects"]), on[0]["user"] if on else "")

    def referent(self) -> str:
        """The person that a pronoun means; none if there are several."""
        if self.person:
            return self.person
        if self.topic and self.topic in self.people:
            return self.topic
        return self.people[0] if len(self.people) == 1 else ""


def distinct(*values: str) -> list[str]:
    return list(dict.fromkeys(v for v in values if v))


def named_in(question: str, q: dict, m: Memory, g: Grammar) -> tuple[list[str], list[str], list[str], list[str]]:
    """Places, persons, subjects and all of them together that a question names, by itself or by pointing at earlier ones."""
    places = list(q["places"])
    numbered = re.fullmatch(g.numbered, m.subject) if q["comparison"] and m.subject else None
    if numbered and q["number"]:
        places = distinct(m.subject, f"{numbered[1].strip()} {q['number']}{m.subject[numbered.end(2):]}", *places)
    persons = [p for p in q["persons"] if not any(p in x or x in p for x in places)]
    short = q["then_name"] if q["then"] else q["bare_name"] if m.people else ""
    if short:
        persons = [p for p in distinct(short, *persons) if p not in g.not_persons]
    subjects = list(q["subjects"])
    if not persons and q["person_question"] and not q["place_reference"] and not q["transform"] and len(subjects) == 1 and re.fullmatch(g.name, subjects[0]):
        persons = subjects
    pointed: list[str] = []
    if q["ordinal"]:
        of_two = next((e["subjects"] for e in reversed(m.evidence) if len(e["subjects"]) > 1), [])
        pointed = {1: of_two[:1], 2: of_two[1:2], 3: of_two[:2]}[q["ordinal"]]
    return places, persons, subjects, distinct(*places, *persons, *pointed, *subjects)


def returned_to(question: str, q: dict, m: Memory) -> str:
    """The earlier topic that a question goes back to: the newest one that it names, or whatever it names."""
    if not q["back"]:
        return ""
    squeezed = re.sub(r"\s+", "", question)
    stack = [x for e in reversed(m.evidence) for x in (e["topic"], e["place"], *e["subjects"])]
    return next((x for x in stack if x and re.sub(r"\s+", "", x) in squeezed), q["back_to"])


def resolved(question: str, q: dict, m: Memory, g: Grammar, place: str = "", piece: str = "") -> dict:
    """A question in the light of a conversation: what kind it is, what it is about, and what to search for.

    place and piece are where the asking person is on a journey, empty if unknown.
    """
    later = m.turns > 0
    places, persons, subjects, entities = named_in(question, q, m, g)
    transform, expand, correct = (later and q[x] for x in ("transform", "expand", "correct"))
    elliptical = later and not entities and q["elliptical"]
    followup = later and (q["followup"] or elliptical or transform or expand or correct)
    people = later and q["people"]
    back, first = returned_to(question, q, m), m.evidence[0] if m.evidence and q["back_to_first"] else None
    beside = bool(m.anchor and places and q["anchored"])

    here = places[0] if places else place if place and q["place_reference"] else m.place or place
    if entities and not followup and not places and not q["place_reference"]:
        here = ""
    held = piece or m.piece
    meant = m.referent() if q["person_reference"] else ""
    parallel = ""
    if persons and later and q["parallel"]:
        swapped = re.sub(g.first_name, lambda _: persons[0], m.asked, count=1)
        parallel = swapped if swapped != m.asked else f"{persons[0]}{g.parallel_joint}{m.asked}"

    if first:
        terms = [first["user"]]
    elif back:
        terms = [back]
    elif transform or expand:
        terms = [m.anchor or m.subject or m.topic or here]
    elif parallel:
        terms = [persons[0], m.event, here]
    elif elliptical or people:
        terms = [m.anchor_or_question()]
        if not terms[0]:
            terms = [m.known("place"), m.event, m.known("topic")]
            terms = [*terms, m.period] if any(terms) else [m.asked if m.trusted else ""]
    elif beside:
        terms = [m.anchor, *places]
    elif entities and followup:
        terms = [here if q["place_reference"] else "", *entities, m.event if q["related"] else ""]
    elif here and (followup or q["place_reference"]) and not m.person and (not q["person_reference"] or q["place_reference"]):
        terms = [here]
    else:
        terms = []
    if held and q["this_piece"]:
        terms.append(held)
    if followup and not (entities or people or elliptical or back or first):
        terms += [meant, "" if meant else m.known("topic"), m.event if m.trusted and not meant else "", m.period]
        if not any(terms):
            terms = [m.asked if m.trusted else ""]
    terms = distinct(*terms)

    said = parallel or question
    if q["comparison"] and len(places) > 1:
        said = " ".join([*places[:2], question])
    if expand:
        said = f"{m.evidence[-1]['user'] if m.evidence else m.asked} — {question}"
    if meant:
        said = re.sub(g.person_reference, lambda _: meant, said)
    if (correct or elliptical) and said == question:
        said = " ".join([*terms, question])
    search = " ".join([*(x for x in terms if x not in said or (back and not first and x == back)), said])
    if first:
        search = " ".join(distinct(first["user"], q["detail"]))

    person = persons[0] if persons else meant or m.person
    widest = subjects[0] if subjects else ""
    own = lambda x: "" if widest and x in widest and len(widest) > len(x) else x
    before = m.anchor or m.subject or m.topic
    event = own(q["events"][0]) if q["events"] else ""
    if transform:
        subject = before
    elif beside:
        subject = m.anchor
    elif person and (persons or q["person_reference"]):
        subject = person
    else:
        subject = (own(places[0]) if places else "") or event or widest or before
    topic = first["topic"] if first else back or subject or (q["events"][0] if q["events"] else m.topic)
    kind = "transform_previous_answer" if transform else "expand_previous_answer" if expand else "correction" if correct else "factual_followup" if followup else "independent"
    return {
        "kind": kind,
        "question": said,
        "search_query": search,
        "place": here,
        "piece": held,
        "topic": topic,
        "subject": subject,
        "person": person,
        "anchor": m.anchor,
        "intent": "transform" if transform else q["intent"],
        "entities": distinct(*entities, *m.entities)[:8],
        "people": distinct(*persons, *m.people)[:4],
        "event": q["events"][0] if q["events"] else m.event,
        "period": q["periods"][0] if q["periods"] else m.period,
        "followup": bool(followup),
        "needs_new_evidence": not transform,
    }


def step(row: dict, m: Memory, g: Grammar, history: int) -> dict | None:
    """Take one turn into the memory; a question gives its resolution.

    A question sets the slots; its answer makes it part of the history, and of the evidence if it was given chunks.
    """
    if row["role"] == "user":
        q, question = row["q"], row["text"]
        out = resolved(question, q, m, g, row.get("place") or "", row.get("piece") or "")
        for slot in ("place", "piece", "topic", "subject", "person", "entities", "people", "event", "period"):
            setattr(m, slot, out[slot])
        m.waiting = {"user": question, "place": out["place"], "topic": out["topic"], "subjects": list(q["all_subjects"]), "subject": out["subject"], "intent": out["intent"]}
        return out
    if row["role"] == "assistant" and m.waiting:
        turn, m.waiting = m.waiting, None
        m.turns, m.asked, m.trusted = m.turns + 1, turn["user"], bool(row["trusted"])
        if row["supported"]:
            m.anchor, m.answered = turn.pop("subject"), turn.pop("intent")
            m.evidence = [*m.evidence, turn][-history:]
    return None


#: What a resolved question has.
FIELDS = [
    *((x, T.StringType()) for x in ("kind", "question", "search_query", "place", "piece", "topic", "subject", "person", "anchor", "intent")),
    *((x, T.ArrayType(T.StringType())) for x in ("entities", "people")),
    *((x, T.StringType()) for x in ("event", "period")),
    *((x, T.BooleanType()) for x in ("followup", "needs_new_evidence")),
]


def prepared(turns: DataFrame, g: Grammar, *others: str) -> DataFrame:
    """Turns with what their own words say, and other columns.  chunk_ids, place_id and piece_id are optional columns."""
    has = lambda name, kind: F.col(name) if name in turns.columns else F.lit(None).cast(kind)
    text = F.coalesce("text", F.lit(""))
    label = lambda name: grounding.context_label(has(name, "string"), g.place_labels)
    rows = turns.where(F.col("role").isin("user", "assistant", "reset")).withColumn("_named", F.when(F.col("role") == "user", g.subjects(text)))
    return rows.select(
        "conv_id",
        F.col("turn").cast("long").alias("turn"),
        "role",
        F.when(F.col("role") == "user", text).alias("text"),
        F.when(F.col("role") == "user", question_features(text, F.col("_named"), g)).alias("q"),
        (~text.rlike(g.unknown)).alias("trusted"),
        (F.coalesce(F.size(has("chunk_ids", "array<string>")), F.lit(0)) > 0).alias("supported"),
        label("place_id").alias("place"),
        label("piece_id").alias("piece"),
        *others,
    )


def resolved_turns(turns: DataFrame, g: Grammar = KOREAN, history: int = 8) -> DataFrame:
    """A row per question with what it is about, given the turns before it.

    turns: conv_id, turn, role (user, assistant, or reset, which forgets all before), text
    and, optionally, chunk_ids of an answer, place_id and piece_id.  Conversations are read
    in order, one turn at a time, so a long one costs no memory.
    """
    rows = prepared(turns, g)
    order = ["conv_id", "turn", F.col("role").desc(), "text"]
    schema = T.StructType([turns.schema["conv_id"], T.StructField("turn", T.LongType()), *(T.StructField(*f) for f in FIELDS)])
    arrow = pa.schema([(f.name, to_arrow_type(f.dataType)) for f in schema])

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, memory = object(), Memory()
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                if row["conv_id"] != at or row["role"] == "reset":
                    at, memory = row["conv_id"], Memory()
                if found := step(row, memory, g, history):
                    out.append({"conv_id": at, "turn": row["turn"], **found})
            yield pa.RecordBatch.from_pylist(out, schema=arrow)

    return rows.repartition("conv_id").sortWithinPartitions(*order).mapInArrow(fold, schema)


def as_text(memory: Memory) -> str:
    return json.dumps(asdict(memory), ensure_ascii=False)


def from_text(text: str) -> Memory:
    return Memory(**json.loads(text))
