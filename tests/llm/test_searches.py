"""Operators 11 to 13 against brute force: personal data, periodic runs, ranked search."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from lamplight.llm import periodic, private, queries, ranked

PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def plain_base(text):
    out = []
    for k, (kind, pattern) in enumerate(PATTERNS.items()):
        for m in re.finditer(pattern, text or ""):
            digits = re.sub("[^0-9]", "", m[0])
            doubled = [int(c) * (1 + i % 2) for i, c in enumerate(reversed(digits))]
            good = {
                "email": True,
                "ip": kind == "ip" and all(int(x) <= 255 for x in m[0].split(".")),
                "card": 14 <= len(digits) <= 19 and sum(d - 9 * (d > 9) for d in doubled) % 10 == 0,
                "phone": 10 <= len(digits) <= 15,
            }[kind]
            if good:
                out.append((m.start(), k, f"{kind}:{m.start()}:{m.end()}"))
    return [s for _, _, s in sorted(out)]


def listed(df):
    base = F.concat(*private.KINDS)
    return {r[0]: (r[1].split(",") if r[1] else [], r[2].split(",") if r[2] else []) for r in df.select("doc_id", private.listed(base), private.listed(F.concat(base, "added"))).collect()}


def test_base_spans_like_the_patterns(spark):
    rng = random.Random(4)
    parts = ["a", "b.c", "@", ".", "-", " ", "  ", "+", "1", "22", "255", "300", "4845168114407329", "(", ")", "\n", "_", "%", "é", "漢", "x@y.z", "1.2.3.4", "+1 (017) 555-7713", "4845-1681 1440 7329", "..", "--"]
    rows = [(i, "".join(rng.choice(parts) for _ in range(rng.randrange(1, 40)))) for i in range(1500)]
    got = listed(private.personal_data(spark.createDataFrame(rows, "doc_id long, text string"), rounds=1))
    assert {i: b for i, (b, _) in got.items()} == {i: plain_base(t) for i, t in rows}


def test_long_texts_are_searched_in_linear_time(spark):
    rows = [(0, "a" * 300_000), (1, "1" * 300_000), (2, "1 " * 150_000), (3, "a.b" * 100_000 + "@c.d"), (4, "x@y.z " * 40_000), (5, "a@" * 100_000), (6, "+1(" * 100_000)]
    got = listed(private.personal_data(spark.createDataFrame(rows, "doc_id long, text string"), rounds=1))
    assert [len(got[i][0]) for i in range(7)] == [0, 0, 0, 1, 40_000, 0, 0]


def test_contexts_of_seeds_find_new_identifiers(spark):
    rng, rows = random.Random(1), []
    for i in range(40):
        rows.append((i, f"please call +1 (0{i:02d}) 555-{7000 + i} today, mail box{i}@mail.example.com soon"))
    for i in range(40, 60):  # no base form: no plus, no dot in the domain
        rows.append((i, f"please call 0{i} 555-{7000 + i} today and mail box{i}@localhost soon"))
    for i in range(60, 90):  # numbers in contexts of their own, and among other words
        rows.append((i, f"order number {10_000_000 + rng.randrange(10**6)} of batch {rng.randrange(10**6, 10**7)} sent"))
    rows.append((90, "please call 4845168114407328 today"))  # the form of a card, with a wrong check digit
    got = listed(private.personal_data(spark.createDataFrame(rows, "doc_id long, text string")))
    for i, text in rows:
        base, every = got[i]
        assert base == plain_base(text) and set(base) <= set(every)
        added = sorted(set(every) - set(base))
        if 40 <= i < 60:
            assert [text[int(s.split(":")[1]) : int(s.split(":")[2])] for s in added] == [f"box{i}@localhost", f"0{i} 555-{7000 + i}"]
            assert [s.split(":")[0] for s in added] == ["email", "phone"]
        else:
            assert added == []


def plain_runs(words):
    found = {}
    for q in range(1, len(words) // 3 + 1):
        i = 0
        while i + q < len(words):
            j = i
            while j + q < len(words) and words[j] == words[j + q]:
                j += 1
            if j + q - i >= max(24, 3 * q) and j > i:
                found.setdefault((i, j + q), q)
            i = max(j, i + 1)
    return sorted(((s, e - s, q) for (s, e), q in found.items()), key=lambda r: (r[0], r[2]))


def test_runs_like_brute_force():
    rng = random.Random(2)
    for _ in range(400):
        words = []
        while len(words) < 160:
            block = [rng.randrange(rng.choice([1, 2, 3, 50])) for _ in range(rng.randrange(1, 12))]
            words += block * rng.choice([1, 1, 2, 3, 4, 9])
        assert periodic.runs_of(np.array(words)) == plain_runs(words), words


def test_suffix_tree_finds_every_branching_repeat():
    rng = random.Random(3)
    for _ in range(300):
        s = [rng.randrange(2) for _ in range(rng.randrange(2, 40))]
        n = len(s)
        plain = {(i, q) for q in range(1, n // 2 + 1) for i in range(n - 2 * q + 1) if s[i : i + q] == s[i + q : i + 2 * q] and (i + 2 * q == n or s[i + q] != s[i + 2 * q])}
        assert set(periodic.SuffixTree(np.array(s)).branching_repeats()) == plain


def test_query_of_runs(spark, docs, folder):
    got = {r.doc_id: r for r in queries.op12_periodic_runs(spark, folder).collect()}
    some = 0
    for r in docs.collect():
        words = [w for w in re.split(r"[\x20\x09-\x0D]+", r.text or "") if w]
        n, h = len(words), zlib.crc32(str(r.doc_id).encode())
        if h % 10 == 0 and n:
            a = h // 10 % n
            p = 1 + (n - a) // (3 + h // 10 % 8)
            words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
        if n > 2500:
            continue
        runs, x = plain_runs(words), got[r.doc_id]
        some += bool(runs)
        dropped = {i for s, m, q in runs for i in range(s + q, s + m)}
        best = min(runs, key=lambda b: (-Fraction(b[1], b[2]), b[0], b[2]), default=None)
        assert x.n_runs == len(runs)
        assert (x.start, x.length, x.period, x.exponent_milli) == ((*best, 1000 * best[1] // best[2]) if best else (None,) * 4)
        assert x.runs_sha256 == hashlib.sha256("".join(f"{s},{m},{q}\n" for s, m, q in runs).encode()).hexdigest()
        assert x.collapsed_sha256 == hashlib.sha256(" ".join(w for i, w in enumerate(words) if i not in dropped).encode()).hexdigest()
    assert some > 5 and len(got) == docs.count()


def plain_words(text):
    return re.findall("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def plain_ranked(docs, items, k=10):
    counts = [(i, Counter(plain_words(t))) for i, t in docs]
    counts = [(i, c) for i, c in counts if c]
    n_docs, n_words = len(counts), sum(c.total() for _, c in counts)
    df = Counter(w for _, c in counts for w in c)
    out = set()
    for item, text in items:
        scores = []
        for i, c in counts:
            m = 25 + 75 * c.total() * n_docs // n_words
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[w] + 1))) * (10**9 * c[w] // (1000 * c[w] + 8 * m)) for w in plain_words(text) if c[w])
            if score > 0:
                scores.append((-score, i is None, i))
        out |= {(item, r, i, -s) for r, (s, _, i) in enumerate(sorted(scores)[:k], 1)}
    return out


@pytest.mark.parametrize(("segment", "items_at_once"), [(1 << 20, 2000), (60, 2000), (300, 2)])
def test_ranks_like_brute_force(spark, monkeypatch, segment, items_at_once):
    monkeypatch.setattr(ranked, "ITEMS", items_at_once)
    rng = random.Random(5)
    vocabulary = [f"w{i}" for i in range(120)]
    weights = [1 / (i + 1) for i in range(120)]
    text = lambda n: " ".join(rng.choices(vocabulary, weights, k=n))
    docs = [(i, text(rng.randrange(0, 60))) for i in range(400)] + [(500 + i, "Same Words w3-w4") for i in range(30)] + [(None, None), (None, "w0 w119"), (600, "é漢 w1\x1cW2"), (601, "..."), (602, text(4000))]
    items = [(i, text(rng.randrange(1, 15))) for i in range(12)] + [(50, "w3 same w3 words"), (51, None), (52, "missing"), (53, "É漢 W1"), (54, "é漢 W119")]
    rows = rng.sample(docs, len(docs))
    found = ranked.ranked(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), spark.createDataFrame(items, "item_id long, text string"), segment=segment)
    assert {(r.item_id, r.rank, r.doc_id, r.score) for r in found.collect()} == plain_ranked(docs, items)


def test_query_of_ranks(spark, folder, duck):
    got = queries.op13_ranked_search(spark, folder)
    assert got.columns == ["item_id", "rank", "doc_id", "score"]
    assert sorted(tuple(r) for r in got.collect()) == sorted(duck.sql(ranked.ORACLE).fetchall())


def test_numbers_of_seven_bits():
    values = np.array([0, 1, 127, 128, 16383, 16384, 2_097_151, 2_097_152, 268_435_455, 268_435_456, 5])
    data, ends = ranked.seven_bits(values)
    assert ranked.numbers(data.tobytes()).tolist() == values.tolist() and ends[-1] == len(data)


def test_odd_rows_and_nothing(spark, odd, nothing):
    clash = odd.withColumns({"runs": F.lit(1), "collapsed": F.lit(2), "score": F.lit(3), "rank": F.lit(4), "email": F.lit(5), "added": F.lit(6), "_h": F.lit(7)})
    assert private.personal_data(clash).count() == odd.count() and private.personal_data(nothing).count() == 0
    runs = periodic.with_runs(periodic.with_planted_runs(clash)).select("doc_id", "runs", "collapsed").collect()
    assert len(runs) == odd.count() and {r.collapsed for r in runs if r.doc_id in (3, 4, 5)} == {""}
    assert periodic.with_runs(nothing).count() == 0
    items = spark.createDataFrame([(1, "quick fox"), (1, "quick fox"), (2, "")], "item_id long, text string")
    assert [r.doc_id for r in ranked.ranked(clash, items).orderBy("rank").collect()] == [1, 7, 7]
    assert ranked.ranked(nothing, items).count() == 0 and ranked.ranked(clash, items.where("item_id > 5")).count() == 0
