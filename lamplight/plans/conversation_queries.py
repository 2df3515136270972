"""Queries over conversations as they go on: what a question is about, and the evidence for it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lamplight.functions import text as X
from lamplight.operators import followup, persons, sections, turn_evidence
from lamplight.plans.registry import query
from lamplight.plans.text_queries import SENTENCES
from lamplight.sources.tables import table

#: Answers of this many characters count as given from evidence.
SUPPORTED = 200


def answered_from(turns: DataFrame) -> DataFrame:
    """Conversations with chunk ids of the answers, which the tables don't have: one for each answer of some length."""
    given = (F.col("role") == "assistant") & (F.length("text") >= SUPPORTED)
    return turns.withColumn("chunk_ids", F.when(given, F.array(F.concat_ws("-", "conv_id", "turn"))))


_G = followup.SAMPLE
_WHOLE = lambda p: f"regexp_full_match(asked, '{p}')"
_HAS = lambda p: f"regexp_matches(x, '{p}')"
_SQUEEZED = r"regexp_replace({}, '\s+', '', 'g')"
#: The fold as a recursion over the turns of all conversations at once; m_ is what is known before a turn.
RESOLVED = f"""
WITH RECURSIVE t AS (
  SELECT conv_id, turn, role, coalesce(text, '') AS x, regexp_replace(coalesce(text, ''), '^\\s+|\\s+$', '', 'g') AS asked,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn, role DESC, text) AS n FROM conversations WHERE role IN ('user', 'assistant')),
f AS (
  SELECT *, list_filter(list_distinct([NULL]), lambda z: false)::VARCHAR[] AS none,
    regexp_extract_all(x, '{_G.place}') AS places, list_filter(regexp_extract_all(x, '([a-z]{{11,}})'), lambda z: true) AS long_words,
    regexp_extract_all(x, '{_G.event}') AS events, regexp_extract_all(x, '{_G.period}') AS periods,
    {_HAS(_G.followup)} AS q_followup, {_WHOLE(_G.whole_elliptical[0])} AS q_elliptical, {_WHOLE(_G.whole_transform)} AS q_transform, {_WHOLE(_G.whole_expand)} AS q_expand, {_HAS(_G.correction)} AS q_correct,
    {_HAS(_G.place_reference)} AS q_place, {_HAS(_G.back)} AS q_back, {_HAS(_G.back_to_first)} AS q_first, NOT {_HAS(_G.unknown)} AS trusted, length(x) >= {SUPPORTED} AS supported,
    CASE WHEN {_HAS(_G.details[0][1])} THEN '{_G.details[0][0]}' WHEN {_HAS(_G.details[1][1])} THEN '{_G.details[1][0]}' ELSE '' END AS detail,
    CASE WHEN {_HAS(_G.intents[0][1])} THEN 'time' WHEN {_HAS(_G.intents[1][1])} THEN 'cause' ELSE 'overview' END AS q_intent
  FROM t),
o AS (  -- distinct words in the order they come
  SELECT * REPLACE (list_transform(list_filter(list_zip(places, range(len(places))), lambda p: list_position(places, p[1]) = p[2] + 1), lambda p: p[1]) AS places,
    list_transform(list_filter(list_zip(long_words, range(len(long_words))), lambda p: list_position(long_words, p[1]) = p[2] + 1), lambda p: p[1])[1:2] AS long_words) FROM f),
s AS (
  SELECT conv_id, 0::BIGINT AS n, 0 AS turns, '' AS m_asked, false AS m_trusted, '' AS m_place, '' AS m_topic, '' AS m_subject, '' AS m_anchor, '' AS m_event, '' AS m_period,
    []::STRUCT(u VARCHAR, place VARCHAR, topic VARCHAR, subjects VARCHAR[])[] AS stack, NULL::STRUCT(u VARCHAR, place VARCHAR, topic VARCHAR, subjects VARCHAR[]) AS waiting, '' AS w_subject,
    0::BIGINT AS turn, '' AS kind, '' AS search_query, '' AS question, '' AS intent, false AS is_followup, NULL::VARCHAR AS role
  FROM t GROUP BY conv_id
  UNION ALL
  SELECT conv_id, n,
    CASE WHEN answer THEN turns + 1 ELSE turns END, CASE WHEN answer THEN waiting.u ELSE m_asked END, CASE WHEN answer THEN trusted ELSE m_trusted END,
    CASE WHEN role = 'user' THEN here ELSE m_place END, CASE WHEN role = 'user' THEN topic ELSE m_topic END, CASE WHEN role = 'user' THEN subject ELSE m_subject END,
    CASE WHEN answer AND supported THEN w_subject ELSE m_anchor END,
    CASE WHEN role = 'user' AND len(events) > 0 THEN events[1] ELSE m_event END, CASE WHEN role = 'user' AND len(periods) > 0 THEN periods[1] ELSE m_period END,
    CASE WHEN answer AND supported THEN list_append(stack, waiting)[-8:] ELSE stack END,
    CASE WHEN role = 'user' THEN {{'u': x, 'place': here, 'topic': topic, 'subjects': long_words}} WHEN answer THEN NULL ELSE waiting END, CASE WHEN role = 'user' THEN subject ELSE w_subject END,
    turn, kind, search_query, said, CASE WHEN transform THEN 'transform' ELSE q_intent END, is_followup, role
  FROM (
    SELECT *, CASE WHEN is_first THEN stack[1].u || CASE WHEN detail <> '' AND detail <> stack[1].u THEN ' ' || detail ELSE '' END
        ELSE array_to_string(list_append(list_filter(terms, lambda z: NOT contains(said, z) OR (back <> '' AND NOT is_first AND z = back)), said), ' ') END AS search_query,
      CASE WHEN is_first THEN stack[1].topic WHEN back <> '' THEN back WHEN subject <> '' THEN subject WHEN len(events) > 0 THEN events[1] ELSE m_topic END AS topic
    FROM (
      SELECT *, CASE WHEN expand THEN CASE WHEN len(stack) > 0 THEN stack[-1].u ELSE m_asked END || ' — ' || x WHEN (correct OR elliptical) AND len(terms) > 0 THEN array_to_string(list_append(terms, x), ' ') ELSE x END AS said,
        CASE WHEN transform THEN before WHEN own_place <> '' THEN own_place WHEN own_event <> '' THEN own_event WHEN widest <> '' THEN widest ELSE before END AS subject,
        CASE WHEN transform THEN 'transform_previous_answer' WHEN expand THEN 'expand_previous_answer' WHEN correct THEN 'correction' WHEN is_followup THEN 'factual_followup' ELSE 'independent' END AS kind
      FROM (
        SELECT *, list_transform(list_filter(list_zip(raw_terms, range(len(raw_terms))), lambda p: p[1] <> '' AND list_position(raw_terms, p[1]) = p[2] + 1), lambda p: p[1]) AS terms
        FROM (
          SELECT *, list_concat(first_terms, CASE WHEN is_followup AND NOT (len(entities) > 0 OR elliptical OR back <> '' OR is_first) THEN
              CASE WHEN array_to_string(list_concat(first_terms, [known_topic, CASE WHEN m_trusted THEN m_event ELSE '' END, m_period]), '') <> ''
                THEN [known_topic, CASE WHEN m_trusted THEN m_event ELSE '' END, m_period] ELSE [CASE WHEN m_trusted THEN m_asked ELSE '' END] END ELSE none END) AS raw_terms
          FROM (
            SELECT *, CASE WHEN is_first THEN [stack[1].u] WHEN back <> '' THEN [back]
                WHEN transform OR expand THEN [CASE WHEN m_anchor <> '' THEN m_anchor WHEN m_subject <> '' THEN m_subject WHEN m_topic <> '' THEN m_topic ELSE here END]
                WHEN elliptical THEN CASE WHEN anchor_or_question <> '' THEN [anchor_or_question] WHEN known_place || m_event || known_topic <> '' THEN [known_place, m_event, known_topic, m_period] ELSE [CASE WHEN m_trusted THEN m_asked ELSE '' END] END
                WHEN len(entities) > 0 AND is_followup THEN list_concat([CASE WHEN q_place THEN here ELSE '' END], entities)
                WHEN here <> '' AND (is_followup OR q_place) THEN [here] ELSE none END AS first_terms
            FROM (
              SELECT *, turns > 0 AND (q_followup OR elliptical OR transform OR expand OR correct) AS is_followup,
                CASE WHEN len(places) > 0 THEN places[1] WHEN len(entities) > 0 AND NOT (turns > 0 AND (q_followup OR elliptical OR transform OR expand OR correct)) AND NOT q_place THEN '' ELSE m_place END AS here,
                coalesce(list_filter(list_filter(flatten(list_transform(list_reverse(stack), lambda e: list_concat([e.topic, e.place], e.subjects))), lambda z: z <> '' AND q_back), lambda z: contains({_SQUEEZED.format("x")}, {_SQUEEZED.format("z")}))[1], '') AS back,
                len(stack) > 0 AND q_first AS is_first,
                CASE WHEN m_anchor <> '' THEN m_anchor ELSE coalesce(list_filter(on_it, lambda e: len(e.subjects) > 0)[1].u, on_it[1].u, '') END AS anchor_or_question
              FROM (
                SELECT *, turns > 0 AND len(entities) = 0 AND q_elliptical AS elliptical, turns > 0 AND q_transform AS transform, turns > 0 AND q_expand AS expand, turns > 0 AND q_correct AS correct,
                  list_filter(list_reverse(stack), lambda e: (known_place <> '' AND e.place = known_place) OR (known_topic <> '' AND e.topic = known_topic)) AS on_it
                FROM (
                  SELECT o.*, s.* EXCLUDE (conv_id, n, turn, role, kind, search_query, question, intent, is_followup), o.role = 'assistant' AND s.waiting IS NOT NULL AS answer,
                    list_concat(places, list_filter(long_words, lambda z: NOT list_contains(places, z))) AS entities,
                    CASE WHEN m_trusted OR len(list_filter(stack, lambda e: e.place = m_place)) > 0 THEN m_place ELSE '' END AS known_place,
                    CASE WHEN m_trusted OR len(list_filter(stack, lambda e: e.topic = m_topic)) > 0 THEN m_topic ELSE '' END AS known_topic,
                    CASE WHEN m_anchor <> '' THEN m_anchor WHEN m_subject <> '' THEN m_subject ELSE m_topic END AS before,
                    coalesce(long_words[1], '') AS widest,
                    CASE WHEN len(places) = 0 OR (contains(widest, places[1]) AND length(widest) > length(places[1])) THEN '' ELSE places[1] END AS own_place,
                    CASE WHEN len(events) = 0 OR (contains(widest, events[1]) AND length(widest) > length(events[1])) THEN '' ELSE events[1] END AS own_event
                  FROM s JOIN o ON o.conv_id = s.conv_id AND o.n = s.n + 1)))))))))
SELECT conv_id, turn, kind, search_query, question, m_place AS place, m_topic AS topic, m_subject AS subject, m_anchor AS anchor, m_event AS event, m_period AS period, intent, is_followup AS followup, len(stack) AS n FROM s WHERE role = 'user'
"""


@query(f"SELECT * EXCLUDE (n) FROM ({RESOLVED})")
def conversation_resolved(spark: SparkSession, folder: str) -> DataFrame:
    """What each question of a conversation is about, and what to search for."""
    found = followup.resolved_turns(answered_from(table(spark, folder, "conversations")), followup.SAMPLE)
    return found.select("conv_id", "turn", "kind", "search_query", "question", "place", "topic", "subject", "anchor", "event", "period", "intent", "followup")


def long_words(text):
    """Words of nine letters or more, which few texts share."""
    return F.filter(X.keyword_tokens(text), lambda w: F.length(w) >= 9)


@query()
def conversation_evidence(spark: SparkSession, folder: str) -> DataFrame:
    """The evidence of each question among the documents, and the round that gave it."""
    questions = followup.resolved_turns(answered_from(table(spark, folder, "conversations")), followup.SAMPLE)
    chunks = table(spark, folder, "documents").select(F.col("doc_id").alias("chunk_id"), "text")
    aspects = ((r" by ", r" by "), (r"tion", r"tion"))
    return turn_evidence.turn_evidence(questions, chunks, long_words, retry_terms={"time": "when", "cause": "for"}, comparison=r"(?:^|[^A-Za-z])(?:or|ou|oder)(?:[^A-Za-z]|$)", aspects=aspects)


_M = sections.SAMPLE
_IS = lambda p, x="line": f"regexp_matches({x}, '{p}')"
_FIRST = lambda test: f"min(CASE WHEN {test} THEN n END) OVER (PARTITION BY doc_id)"
_HEADS = ", ".join(f"{_FIRST(_IS(_M.chronology[h]) + ' AND ' + ('NOT ' if h.startswith('summary') else '') + '(s IS NULL OR n < s)')} AS x_{h}" for h in ("opening", "occupation", "liberation", "summary_modern", "summary_post"))
_TITLES = "[" + ", ".join(f"'{t}'" for t in _M.titles) + "]"
SECTIONS = rf"""
WITH raw AS (SELECT doc_id, ['biography', 'heritage', 'chronology', 'generic'][doc_id % 4 + 1] AS kind,
    list_filter(list_transform(regexp_split_to_array(coalesce(text, ''), '\r\n|[\n\r\x0B\f\x1C-\x1E\x85\x{{2028}}\x{{2029}}]'), lambda x: regexp_replace(regexp_replace(x, '[ \t]+', ' ', 'g'), '^\s+|\s+$', '', 'g')), lambda x: x <> '') AS ls FROM documents),
l AS (SELECT doc_id, kind, unnest(range(len(ls))) AS n, unnest(ls) AS line FROM raw),
a AS (SELECT *, {_FIRST(_IS(_M.reference))} AS ref, {_FIRST(_IS(_M.heritage_start))} AS record, {_FIRST(_IS(_M.chronology["start"]))} AS start FROM l),
b AS (SELECT * REPLACE (CASE WHEN kind = 'chronology' AND start IS NULL THEN 'generic' ELSE kind END AS kind), {_FIRST(_IS(_M.chronology["end"]) + " AND n >= start")} AS stop FROM a),
c AS (SELECT doc_id, kind, line, row_number() OVER (PARTITION BY doc_id ORDER BY n) - 1 AS n FROM b WHERE CASE kind WHEN 'heritage' THEN NOT {_IS(_M.heritage_ui)} AND n >= coalesce(record, 0) WHEN 'chronology' THEN n >= start AND (stop IS NULL OR n < stop)
    WHEN 'biography' THEN NOT {_IS(_M.biography_ui)} AND (ref IS NULL OR n < ref) ELSE NOT {_IS(_M.ui)} AND (ref IS NULL OR n < ref) END),
d AS (SELECT *, {_FIRST(_IS(_M.basic))} AS basic, count(*) OVER (PARTITION BY doc_id) AS total, {_FIRST(_IS(_M.chronology["summary"]))} AS s FROM c),
e AS (SELECT *, greatest(0, basic - 2) AS since, {_FIRST(_IS(_M.award_field) + " AND n >= basic")} AS awarded, {_HEADS} FROM d),
f AS (SELECT *, kind = 'biography' AND basic IS NOT NULL AS bio, CASE WHEN awarded IS NOT NULL THEN least(total, awarded + 2) ELSE basic END AS told_at FROM e),
g AS (SELECT *, coalesce(bio AND n >= told_at, false) AS told, {_FIRST(_IS(_M.activity) + " AND n >= since AND n < told_at")} AS filed, max(CASE WHEN n = since THEN line END) OVER (PARTITION BY doc_id) AS subject FROM f),
h AS (SELECT *, told AND {_IS(_M.award)} AS award, CASE WHEN told AND length(line) % 3 = 0 THEN length(line) % 10 END AS year FROM g),
hh AS (SELECT *, coalesce(lag(award) OVER (PARTITION BY doc_id ORDER BY n), false) AS after_award FROM h),
i AS (SELECT *, sum((told AND (award OR {_IS(_M.transition)} OR after_award))::INT) OVER (PARTITION BY doc_id ORDER BY n) AS hard FROM hh),
j AS (SELECT *, last_value(year IGNORE NULLS) OVER (PARTITION BY doc_id, hard ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS last_year, lag(hard) OVER (PARTITION BY doc_id ORDER BY n) AS hard_before FROM i),
k AS (SELECT *, sum((told AND (n = told_at OR coalesce(abs(year - last_year) >= 2, false) OR hard <> coalesce(hard_before, 0)))::INT) OVER (PARTITION BY doc_id ORDER BY n) AS activity FROM j),
m AS (SELECT *, CASE WHEN kind = 'chronology' THEN CASE WHEN x_opening IS NULL OR x_occupation IS NULL OR x_liberation IS NULL THEN 10 WHEN s IS NOT NULL AND n >= s THEN CASE WHEN x_summary_modern IS NULL OR x_summary_post IS NULL THEN 11 WHEN n >= x_summary_modern AND n >= x_summary_post THEN 9 WHEN n >= x_summary_modern THEN 8 ELSE 7 END
    WHEN n >= x_liberation THEN 6 WHEN n >= x_occupation + 2 THEN 5 WHEN n >= x_occupation THEN 4 WHEN n >= x_opening + 2 THEN 3 WHEN n = x_opening + 1 THEN 2 WHEN n = x_opening THEN 1 ELSE 0 END
    WHEN told THEN activity::BIGINT ELSE 0 END AS part FROM k WHERE NOT bio OR n >= since),
o AS (SELECT doc_id, kind, part, string_agg(line, chr(10) ORDER BY n) FILTER (NOT bio OR told OR filed IS NULL OR n < filed) AS text, string_agg(line, chr(10) ORDER BY n) FILTER (bio AND NOT told AND n >= filed) AS metadata,
    arg_min(year, n) FILTER (year IS NOT NULL) AS year, max(subject) AS subject, bool_or(bio) AS bio FROM m GROUP BY doc_id, kind, part)
SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY part) - 1 AS INTEGER) AS section, CASE WHEN kind = 'chronology' THEN {_TITLES}[part + 1] WHEN bio AND part = 0 THEN subject || ' {_M.profile}' WHEN bio THEN subject || ' ' || coalesce(year::VARCHAR || ' ', '') || '{_M.active}'
  WHEN kind = 'heritage' THEN '{_M.record}' ELSE '{_M.body}' END AS title, coalesce(text, '') AS text, coalesce(metadata, '') AS metadata FROM o
"""


@query(SECTIONS)
def document_sections(spark: SparkSession, folder: str) -> DataFrame:
    """Sections of documents taken as pages of four kinds by their ids."""
    kind = F.get(F.array(*map(F.lit, ("biography", "heritage", "chronology", "generic"))), (F.col("doc_id") % 4).cast("int"))
    found = sections.sections(table(spark, folder, "documents"), kind, sections.SAMPLE)
    return found.select("doc_id", "section", "title", F.array_join("lines", "\n").alias("text"), F.array_join("metadata", "\n").alias("metadata"))


_R = persons.SAMPLE
PERSONS = f"""
WITH s AS (SELECT doc_id, unnest(range(len({SENTENCES}))) AS sentence, unnest({SENTENCES}) AS x FROM documents WHERE regexp_matches(text, '{_R.context}')),
f AS (SELECT doc_id, sentence, x, list_concat(list_transform(list_zip(regexp_extract_all(x, '{_R.spelled}', 1), regexp_extract_all(x, '{_R.spelled}', 2)), lambda z: {{'name': z[1], 'spelling': z[2]}}),
    list_transform(regexp_extract_all(x, '{_R.titled}', 1), lambda z: {{'name': z, 'spelling': ''}})) AS every FROM s WHERE regexp_matches(x, '{_R.context}')),
g AS (SELECT doc_id, sentence, x, unnest(every) AS p, generate_subscripts(every, 1) AS n FROM f),
h AS (SELECT doc_id, sentence, x, p.name AS person, arg_min(p.spelling, n) AS spelling FROM g WHERE regexp_matches(p.name, '{_R.family}') AND NOT regexp_matches(p.name, '{_R.not_name}') AND NOT regexp_matches(p.spelling, '{_R.not_spelling}') GROUP BY ALL),
r AS (SELECT *, regexp_extract(x, person || '{_R.aside}{_R.particles}{_R.stop}{{0,35}}?({_R.titles}){_R.objects}\\s*(?:{_R.predicates})', 1) AS office, regexp_matches(x, person || '{_R.aside}{_R.stop}{{0,45}}{_R.award}') AS awarded FROM h)
SELECT doc_id, CAST(sentence AS INTEGER) AS sentence, CAST(strpos(x, person) - 1 AS INTEGER) AS place, person, spelling, CASE WHEN office <> '' THEN 'role' WHEN awarded THEN 'award' ELSE '' END AS relation,
  CASE WHEN office <> '' THEN office WHEN awarded THEN 'award' ELSE '' END AS value FROM r
"""


@query(PERSONS)
def document_persons(spark: SparkSession, folder: str) -> DataFrame:
    """Persons named in the sentences of documents, with offices and awards."""
    return persons.person_rows(table(spark, folder, "documents"), persons.SAMPLE)
