"""Personal data by bootstrapped contextual extraction, in Spark functions only.

Base entities (addresses, cards, phones by form and check) are the seeds.  Every identifier
(a group of at least five digits, or a word with an @) occurs between words; the two words
before it, the one before it and the one after it, each with the identifier's class, are
its lexical patterns.  Patterns and identifiers form a graph that is scored in rounds:

* a pattern's confidence in a kind is the weight of its known identifiers of that kind over
  the weight of all its identifiers plus one, unknown ones counting UNKNOWN each, so a
  pattern needs several different seeds and few identifiers of other kinds;
* an unknown identifier's score is one less the product of what its confident patterns lack;
  from PROMOTED on it is known, and counts by its score in the next round.

The identifiers known after the last round that no base form covers are the added spans.
An identifier that has the form of a kind and fails its check (a card number with a wrong
check digit) stands against the patterns it occurs in, and is never added.

Cases: null is an empty text, without spans; texts of any length are worked on whole, by
searches linear in their length; ties between kinds go to the first listed; identifiers
count once however often they occur, so copies of a document add no confidence; equal rows
have equal results, rows of one id are told apart by their texts, rows without an id are
kept; an empty table gives an empty result; columns other than id and text are dropped, so
none can clash.
"""

from __future__ import annotations

from functools import partial

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lamplight.llm.common import written

#: The kinds in their order.
KINDS = ("email", "ip", "card", "phone")
ROUNDS = 3
#: Least confidence of a pattern, and least score of an identifier.
CONFIDENT, PROMOTED = 0.8, 0.8
#: What an unknown identifier weighs against its pattern.
UNKNOWN = 0.25
#: Least digits of a group of digits that counts as an identifier.
LEAST_DIGITS = 5
#: A pattern that many identifiers have is joined in so many parts.
SALTS = 16

LABEL, LOCAL = "A-Za-z0-9-", "A-Za-z0-9._%+-"
SPACE = r"\x20\x09-\x0D"
#: The searched form of a text for a kind, of the same length, and the pattern to search in
#: it.  They find what the kinds' own patterns find, in time linear in the text: a dot that
#: joins no two labels can't be part of a domain, a blank or hyphen between no two digits
#: can't be part of a card, and a run of letters or digits is tried from its start only.
FORMS = {
    "email": (rf"(?<![{LABEL}])\.|\.(?![{LABEL}])", "%", rf"(?:(?<![{LOCAL}])|\G)[{LOCAL}]++@[{LABEL}]++\.[{LABEL}.]++"),
    "ip": (None, None, r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"),
    "card": (r"(?<![0-9])[\x20-]|[\x20-](?![0-9])", "x", r"[0-9][0-9\x20-]++"),
    "phone": (None, None, r"\+[0-9][\x20().0-9-]+[0-9]"),
}
#: An identifier: a group of digits, or a word with an @.
IDENTIFIER = rf"(?<![^{SPACE}])[+(]{{0,2}}[0-9][0-9\x20().-]*[0-9](?![A-Za-z0-9_@])|(?<![^{SPACE}])[^{SPACE}@]*+@[^{SPACE}]*+"


def with_spans(df: DataFrame, text: Column, pattern: str, name: str, chunk: int = 256) -> DataFrame:
    """df with an array of (start, value, left, right): what the pattern matches, from left to right.

    left and right are the text up to the neighbouring matches.  Starts are sums of the
    lengths before: within a chunk of matches, plus the chunks before it.
    """
    t, found, pieces, long, base = (f"_{name}_{x}" for x in ("text", "found", "pieces", "long", "base"))
    df = df.withColumn(t, text)
    df = df.withColumns({found: F.regexp_extract_all(t, F.lit(pattern), F.lit(0)), pieces: F.split(t, pattern, -1)})
    df = df.withColumn(long, F.zip_with(F.slice(pieces, 1, F.size(found)), found, lambda p, v: F.length(p) + F.length(v)))
    n = F.size(long)
    chunks = F.transform(F.sequence(F.lit(0), F.floor((n - 1) / chunk).cast("int")), lambda c: F.aggregate(F.slice(long, c * chunk + 1, F.lit(chunk)), F.lit(0), lambda a, x: a + x))
    sums = F.aggregate(chunks, F.array(F.lit(0)), lambda a, x: F.concat(a, F.array(F.element_at(a, -1) + x)))
    df = df.withColumn(base, F.when(n > 0, sums))

    def placed(value: Column, i: Column) -> Column:
        at = F.floor(i / chunk).cast("int")
        before = F.get(base, at) + F.aggregate(F.slice(long, at * chunk + 1, i % chunk), F.lit(0), lambda a, x: a + x)
        return F.struct((before + F.length(F.get(pieces, i))).alias("start"), value.alias("value"), F.get(pieces, i).alias("left"), F.get(pieces, i + 1).alias("right"))

    none = F.array().cast("array<struct<start:int,value:string,left:string,right:string>>")
    return df.withColumn(name, F.when(F.size(base) > 0, F.transform(found, placed)).otherwise(none)).drop(t, found, pieces, long, base)


def digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def valid(kind: str, value: Column) -> Column:
    """Whether a match of the kind's form passes its check."""
    n = F.length(digits(value))
    if kind == "ip":
        part = lambda p: p.rlike(r"^0*(?:25[0-5]|2[0-4][0-9]|[01]?[0-9]{1,2})$")
        return F.forall(F.split(value, r"\."), part)
    if kind == "card":
        return n.between(14, 19) & F.call_function("luhn_check", digits(value))
    return n.between(10, 15) if kind == "phone" else F.lit(True)


def passes(kind: str, s: Column) -> Column:
    return valid(kind, s["value"])


def span_of(k: int, s: Column) -> Column:
    return F.struct(s["start"].alias("start"), F.lit(k).alias("kind"), (s["start"] + F.length(s["value"])).alias("end"))


def with_base(df: DataFrame, text_col: str) -> DataFrame:
    """df with an array column of base spans (start, kind's number, end) for each kind."""
    for k, kind in enumerate(KINDS):
        odd, filler, pattern = FORMS[kind]
        raw = F.col(text_col)
        may = F.contains(raw, F.lit("@")) if kind == "email" else F.contains(raw, F.lit("+")) if kind == "phone" else raw.rlike(r"[0-9]\.[0-9]" if kind == "ip" else r"[0-9][\x20-]?[0-9]")
        searched = F.regexp_replace(raw, odd, filler) if odd else raw
        df = with_spans(df, F.when(may, searched).otherwise(F.lit("")), pattern, "_all")
        passed = F.filter("_all", partial(passes, kind))
        df = df.withColumn(kind, F.transform(passed, partial(span_of, k))).drop("_all")
    return df


def label(value: Column) -> Column:
    """What an identifier is by itself: a kind's number, -1 for the form of a kind that fails its check, null if unknown."""
    said = F.lit(None).cast("int")
    for k in (2, 1, 3, 0):
        searched = F.regexp_replace(value, FORMS[KINDS[k]][0], FORMS[KINDS[k]][1]) if FORMS[KINDS[k]][0] else value
        form = F.regexp_extract(searched, FORMS[KINDS[k]][2], 0)
        long_enough = F.length(digits(form)) >= 14 if KINDS[k] == "card" else F.lit(True)
        said = F.when((form != "") & long_enough, F.when(valid(KINDS[k], form), k).otherwise(F.coalesce(said, F.lit(-1)))).otherwise(said)
    return said


def occurrences(docs: DataFrame, text_col: str) -> DataFrame:
    """(_i, _h, start, value, label, patterns): identifiers of the texts and the patterns they occur in."""
    some = docs.where(F.col(text_col).rlike("[0-9@]"))
    spans = with_spans(some, F.col(text_col), IDENTIFIER, "_spans").select("_i", "_h", F.explode_outer("_spans").alias("s")).where("s is not null").select("_i", "_h", "s.*")
    edge = r"^[^A-Za-z0-9+(@]+"
    lead = F.length(F.regexp_extract("value", edge, 0))
    tidy = F.regexp_replace(F.regexp_replace("value", edge, ""), r"[^A-Za-z0-9)]+$", "")
    rows = spans.select("_i", "_h", (F.col("start") + lead).alias("start"), tidy.alias("value"), "left", "right")
    rows = rows.withColumn("class", F.when(F.contains("value", F.lit("@")), "address").when(F.length(digits(F.col("value"))) >= LEAST_DIGITS, "number")).where("class is not null and length(value) > 1")
    near = rows.withColumns({"left": F.substring("left", -150, 150), "right": F.substring("right", 1, 80)})
    two = F.lower(F.regexp_extract("left", rf"([^{SPACE}]{{1,64}}[{SPACE}]{{1,8}})?([^{SPACE}]{{1,64}})[{SPACE}]{{0,8}}$", 0))
    words = F.array_remove(F.split(two, rf"[{SPACE}]+"), "")
    after = F.lower(F.regexp_extract("right", rf"^[{SPACE}]{{0,8}}([^{SPACE}]{{1,64}})", 1))
    rows = near.withColumns({"_words": words, "_after": after})
    before = F.element_at("_words", -1)
    made = F.array(
        F.when(F.size("_words") == 2, F.concat_ws(" ", F.lit("2"), "class", F.element_at("_words", 1), before)),
        F.when(F.size("_words") > 0, F.concat_ws(" ", F.lit("1"), "class", before)),
        F.when(F.length("_after") > 0, F.concat_ws(" ", F.lit("+"), "class", "_after")),
    )
    return rows.select("_i", "_h", "start", "value", label(F.col("value")).alias("label"), F.array_compact(made).alias("patterns"))


def salted(df: DataFrame, by: str) -> DataFrame:
    return df.withColumn("_salt", F.pmod(F.xxhash64(by), F.lit(SALTS)))


def every_salt(df: DataFrame) -> DataFrame:
    return df.withColumn("_salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))))


def confident(edges: DataFrame, known: DataFrame | None) -> DataFrame:
    """(pattern, kind, confidence) of the patterns that are confident, given the identifiers known so far."""
    if known is None:
        edges = edges.withColumns({"kind": F.lit(None).cast("int"), "score": F.lit(None).cast("double")})
    else:
        edges = edges.join(known, "value", "left")
    of = lambda k: F.sum(F.when(F.col("label") == k, 1.0).when(F.col("kind") == k, F.col("score")).otherwise(0.0))
    weight = F.when(F.col("label").isNotNull() | F.col("kind").isNotNull(), 1.0).otherwise(UNKNOWN)
    sums = edges.groupBy("pattern").agg(*[of(k).alias(f"_{k}") for k in range(len(KINDS))], F.sum(weight).alias("_all"))
    best = F.greatest(*[F.struct(F.col(f"_{k}").alias("sum"), F.lit(-k).alias("kind")) for k in range(len(KINDS))])
    scored = sums.select("pattern", best.alias("best"), "_all").select("pattern", (-F.col("best.kind")).alias("kind"), (F.col("best.sum") / (F.col("_all") + 1)).alias("confidence"))
    return scored.where(F.col("confidence") >= CONFIDENT)


def promoted(edges: DataFrame, patterns: DataFrame) -> DataFrame:
    """(value, kind, score) of the unknown identifiers that confident patterns make known."""
    met = salted(edges.where("label is null"), "value").join(every_salt(patterns), ["pattern", "_salt"])
    scores = met.groupBy("value", "kind").agg((1 - F.exp(F.sum(F.log(1 - F.col("confidence"))))).alias("score")).where(F.col("score") >= PROMOTED)
    best = scores.groupBy("value").agg(F.max(F.struct("score", (-F.col("kind")).alias("kind"))).alias("best"))
    return best.select("value", (-F.col("best.kind")).alias("kind"), "best.score")


def discovered(found: DataFrame, rounds: int = ROUNDS) -> tuple[DataFrame, DataFrame]:
    """The confident patterns and the identifiers they make known, after the last round."""
    edges = written(found.select("value", "label", F.explode("patterns").alias("pattern")).distinct(), "private-edges")
    known = patterns = None
    for _ in range(rounds):
        patterns = written(confident(edges, known), "private-patterns")
        known = written(promoted(edges, patterns), "private-known")
    return patterns, known


def personal_data(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rounds: int = ROUNDS) -> DataFrame:
    """A row per document: its id, an array of base spans of each kind, and the added ones.

    Spans are (start, kind's number, end) in code points, end exclusive.
    """
    rows = docs.select(F.col(id_col), F.coalesce(F.col(text_col), F.lit("")).alias("_text"))
    rows = rows.withColumns({"_i": F.xxhash64(id_col), "_h": F.xxhash64("_text")})
    found = written(occurrences(rows, "_text"), "private-identifiers")
    _, known = discovered(found, rounds)
    unknown = salted(found.where("label is null").select("_i", "_h", "start", "value"), "start")
    new = unknown.join(every_salt(known.select("value", "kind")), ["value", "_salt"])
    span = F.struct("start", "kind", (F.col("start") + F.length("value")).alias("end"))
    added = new.groupBy("_i", "_h").agg(F.collect_set(span).alias("added"))
    base = with_base(rows, "_text").select(id_col, "_i", "_h", *KINDS)
    both = base.join(added, ["_i", "_h"], "left")
    none = F.array().cast("array<struct<start:int,kind:int,end:int>>")
    return both.select(id_col, *KINDS, F.coalesce("added", none).alias("added"))


def listed(spans: Column) -> Column:
    """Spans as kind:start:end, by start and then kind, joined by commas."""
    name = lambda s: F.get(F.array(*map(F.lit, KINDS)), s["kind"])
    return F.array_join(F.transform(F.array_sort(spans), lambda s: F.concat_ws(":", name(s), s["start"].cast("string"), s["end"].cast("string"))), ",")
