"""The evidence of each turn of a conversation: what is searched, remembered, tried again, compared.

All turns go through the same rounds together, each round over the turns that the ones
before left without evidence:

* search: the resolved search query;
* retry: the subject with a word for what is asked, or the subject alone;
* reuse: for a rewording or an expansion, the chunks of the newest turn that was searched
  for; an expansion whose chunks don't hold enough detail is searched for as well;
* fallback: a follow-up that found nothing gets what was remembered on its topic or place;
* comparison: each of two subjects is searched for by itself.

Turns that reuse are no evidence turns themselves, so what is remembered never depends on
another turn's reuse, and one window over each conversation finds it.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lamplight.operators import policy, search
from lamplight.sources.tables import written

REUSING = ("transform_previous_answer", "expand_previous_answer")
#: What is added to a subject that is searched for again, by intent.
RETRY_TERMS = {"time": "창립 시기", "people": "관련 인물", "place": "관련 장소", "cause": "배경 원인", "result": "결과 영향", "role": "역할", "current": "현재"}
COMPARISON = r"차이|달라|비교|구분|섞지|각각"
#: Fixed values: (what a question asks for, what bears it out in texts).
ASPECTS = (
    (r"배경|이유|원인|계기", r"배경|이유|원인|계기|때문|위해|따라"),
    (r"결과|영향|이후|그\s*뒤", r"결과|영향|이후|이어졌|되었|됐다|남겼"),
    (r"인물|사람|누가|누구|참석자", r"인물|사람|참석|주도|대표|장관|교수"),
    (r"시점|언제|연도|날짜|당시", r"(?:18|19|20)\d{2}년|\d{1,2}월|\d{1,2}일|당시"),
    (r"과정|전개|구체적|어떻게", r"과정|전개|진행|도착|참석|개최|발생"),
)
#: Intents in the order in which a neighbouring one is tried.
NEARBY = ("overview", "time", "people", "place", "role", "current", "result")


def found(tokenized: DataFrame, asked: DataFrame, tokens: Callable[[Column], Column], k: int, label: str) -> DataFrame:
    """(query_id, chunk_id, rank) of the texts asked for, stored."""
    queries = asked.select("query_id", tokens(F.col("query")).alias("tokens"))
    return written(search.bm25(tokenized, queries, k).select("query_id", "chunk_id", "rank"), label)


def detail_enough(remembered: DataFrame, texts: DataFrame, questions: DataFrame, aspects: Sequence[tuple[str, str]]) -> DataFrame:
    """query_ids of those whose remembered chunks hold the detail that is asked for.

    Aspects that the question names have to be borne out, in 160 characters or more; if it
    names none, three aspects in 220 characters are enough, or any two chunks with 350.
    """
    rows = remembered.join(texts, "chunk_id")
    sums = rows.groupBy("query_id").agg((F.sum(F.length("text")) + F.count("*") - 1).alias("_long"), F.count("*").alias("_n"), *[F.bool_or(F.col("text").rlike(e)).alias(f"_e{i}") for i, (_, e) in enumerate(aspects)])
    asked = questions.select("query_id", *[F.col("question").rlike(q).alias(f"_q{i}") for i, (q, _) in enumerate(aspects)])
    both = asked.join(sums, "query_id")
    every = range(len(aspects))
    any_asked, missing, held = F.lit(False), F.lit(False), F.lit(0)
    for i in every:
        any_asked = any_asked | F.col(f"_q{i}")
        missing = missing | (F.col(f"_q{i}") & ~F.col(f"_e{i}"))
        held = held + F.col(f"_e{i}").cast("int")
    enough = F.when(any_asked, ~missing & (F.col("_long") >= 160)).otherwise((F.col("_long") >= 220) & ((held >= 3) | ((F.col("_n") >= 2) & (F.col("_long") >= 350))))
    return both.where(enough).select("query_id")


def turn_evidence(
    questions: DataFrame,
    chunks: DataFrame,
    tokens: Callable[[Column], Column],
    k: int = 5,
    retry_terms: dict[str, str] = RETRY_TERMS,
    comparison: str = COMPARISON,
    aspects: Sequence[tuple[str, str]] = ASPECTS,
) -> DataFrame:
    """(conv_id, turn, rank, chunk_id, round): each question's packet, with the round that gave each chunk.

    questions: conv_id, turn, kind, question, search_query, place, topic, subject, intent,
    entities (as followup.resolved_turns gives them); chunks: chunk_id, text.  Null and
    empty texts find nothing; a question without evidence has no rows; equal scores are
    ordered by chunk_id.
    """
    q = written(questions.withColumn("query_id", F.concat_ws(":", "conv_id", "turn")).dropDuplicates(["query_id"]), "turn-questions")
    tokenized = written(chunks.select("chunk_id", tokens(F.coalesce("text", F.lit(""))).alias("tokens")), "turn-tokens")
    texts = chunks.select("chunk_id", F.coalesce("text", F.lit("")).alias("text"))

    searched = found(tokenized, q.withColumn("query", F.col("search_query")), tokens, k, "turn-search")
    term = F.lit("")
    for intent, word in retry_terms.items():
        term = F.when(F.col("intent") == intent, word).otherwise(term)
    missing = q.join(searched.select("query_id").distinct(), "query_id", "left_anti")
    again = missing.withColumn("query", F.trim(F.when(F.col("kind") == "factual_followup", F.concat_ws(" ", "subject", term)).otherwise(F.col("subject"))))
    retried = found(tokenized, again.where((F.col("query") != "") & (F.col("query") != F.trim("search_query"))), tokens, k, "turn-retry")
    retrieved = searched.withColumn("round", F.lit("search")).unionByName(retried.withColumn("round", F.lit("retry")))

    own = ~F.col("kind").isin(*REUSING)
    has = q.join(retrieved.select("query_id").distinct().withColumn("_has", F.lit(True)), "query_id", "left")
    trace = F.when(F.col("_has") & own, F.struct("query_id", "topic", "place"))
    before = Window.partitionBy("conv_id").orderBy("turn").rowsBetween(Window.unboundedPreceding, -1)
    last = written(has.select("query_id", "kind", "topic", "place", "followup", F.last(trace, True).over(before).alias("_last")), "turn-last")
    same = (F.col("_last.topic") == F.col("topic")) & (F.col("topic") != "") | (F.col("_last.place") == F.col("place")) & (F.col("place") != "")
    wanting = last.where(F.col("kind").isin(*REUSING)).withColumn("round", F.lit("reuse"))
    lost = last.where(own & F.col("followup") & same).join(retrieved, "query_id", "left_anti").withColumn("round", F.lit("fallback"))
    of_last = retrieved.select(F.col("query_id").alias("_of"), "chunk_id", "rank")
    remembered = wanting.unionByName(lost).select("query_id", "kind", "round", F.col("_last.query_id").alias("_of")).join(of_last, "_of")
    remembered = written(remembered.select("query_id", "kind", "chunk_id", "rank", "round"), "turn-remembered")

    expanding = remembered.where("kind = 'expand_previous_answer'")
    enough = detail_enough(expanding, texts, q, aspects)
    content = enough.unionByName(remembered.where("kind = 'transform_previous_answer'").select("query_id").distinct())
    new = retrieved.join(content, "query_id", "left_anti")
    # The newest remembered chunk, what is new, the other remembered ones.
    parts = remembered.select("query_id", "chunk_id", F.when(F.col("rank") == 1, 0).otherwise(2).alias("_part"), "rank", "round")
    parts = parts.unionByName(new.select("query_id", "chunk_id", F.lit(1).alias("_part"), "rank", "round"))
    first = parts.groupBy("query_id", "chunk_id").agg(F.min(F.struct("_part", "rank", "round")).alias("o")).select("query_id", "chunk_id", "o.*")
    order = Window.partitionBy("query_id").orderBy("_part", "rank", "chunk_id")
    kept = first.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= k)

    pairs = q.where(F.col("question").rlike(comparison) & (F.size("entities") >= 2)).select("query_id", F.posexplode(F.slice("entities", 1, 2)).alias("_side", "query"))
    sides = pairs.withColumns({"_of": F.col("query_id"), "query_id": F.concat_ws("#", "query_id", "_side")})
    both = found(tokenized, sides, tokens, k, "turn-comparison").join(sides.select("query_id", "_of", "_side"), "query_id")
    compared = both.select(F.col("_of").alias("query_id"), "chunk_id", (F.lit(3) + F.col("_side")).alias("_part"), "rank", F.lit("comparison").alias("round"))
    every = kept.drop("_n").unionByName(compared).groupBy("query_id", "chunk_id").agg(F.min(F.struct("_part", "rank", "round")).alias("o")).select("query_id", "chunk_id", "o.*")
    ranked = every.withColumn("rank", F.row_number().over(order))
    return ranked.join(q.select("query_id", "conv_id", "turn"), "query_id").select("conv_id", "turn", "rank", "chunk_id", "round")


def nearby_intent(packets: DataFrame, questions: DataFrame, chunks: DataFrame, patterns: Sequence[tuple[str, str]] = policy.INTENTS, order: Sequence[str] = NEARBY) -> DataFrame:
    """(conv_id, turn, intent, nearby): the intent that a packet bears out; nearby where it isn't the one asked for.

    A text bears out an intent that its pattern occurs in, and overview in any case.
    """
    held = packets.join(chunks.select("chunk_id", F.coalesce("text", F.lit("")).alias("text")), "chunk_id")
    facts = held.groupBy("conv_id", "turn").agg(*[F.bool_or(F.col("text").rlike(p)).alias(f"_{name}") for name, p in patterns])
    rows = questions.select("conv_id", "turn", "intent").join(facts, ["conv_id", "turn"])
    asked, first = F.lit(False), F.lit(None).cast("string")
    names = dict(patterns)
    for name in names:
        asked = asked | ((F.col("intent") == name) & F.col(f"_{name}"))
    for name in reversed(order):
        holds = F.col(f"_{name}") if name in names else F.lit(name == "overview")
        first = F.when(holds & (F.col("intent") != name), name).otherwise(first)
    direct = asked | (F.col("intent") == "overview")
    return rows.select("conv_id", "turn", F.when(direct, F.col("intent")).otherwise(first).alias("intent"), (~direct).alias("nearby"))
