"""Each stage of the pipeline against a brute-force version on its own input."""

import hashlib
from collections import Counter

import corpus_pipeline as p
import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F
from test_tokens import check_packing

from lamplight.llm import line_dedup, mixing, simhash_wide
from lamplight.llm.common import written


@pytest.fixture(scope="module")
def stages(spark, folder):
    """Input and output of each stage."""
    at, out = spark.read.parquet(f"{folder}/documents.parquet"), {}
    columns = at.columns
    for name, stage in p.STAGES:
        then = written(stage(spark, at, folder), "test-stage")
        if name != p.STAGES[-1][0]:
            assert then.columns == columns, name
        out[name], at = (at, then), then
    return out


def as_table(df):
    con = duckdb.connect()
    con.register("documents", df.toPandas())
    return con


def test_names():
    assert [name for name, _ in p.STAGES] == ["language", "lines", "near copies", "mix", "pack"] and p.ORACLE_SQL is None


def test_language(stages):
    before, after = stages["language"]
    want = {r.doc_id for r in before.collect() if any(c.isalpha() for c in r.text or "")}
    assert {r.doc_id for r in after.collect()} == want


def test_lines(stages):
    before, after = stages["lines"]
    want = {doc: digest for doc, _, _, digest in as_table(before).sql(line_dedup.ORACLE).fetchall()}
    rows = after.collect()
    assert {r.doc_id: hashlib.sha256((r.text or "").encode()).hexdigest() for r in rows} == want
    assert all(r.n_chars == len(r.text or "") for r in rows)


def test_near_copies(stages):
    before, after = stages["near copies"]
    texts = {r.doc_id: (r.text or "").encode().lower().split() for r in before.collect()}
    sets = {i: {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} for i, w in texts.items()}
    least = {i: i for i in sets}
    changed = True
    linked = [(a, b) for a in sets for b in sets if a < b and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])]
    while changed:
        changed = False
        for a, b in linked:
            m = min(least[a], least[b])
            if least[a] != m or least[b] != m:
                least[a] = least[b] = m
                changed = True
    want, got = {i for i, m in least.items() if i == m}, {r.doc_id for r in after.collect()}
    assert want <= got and len(got - want) <= 0.05 * len(linked) + 1
    assert after.count() == len(got)


def test_mix(stages):
    before, after = stages["mix"]
    want = {doc: taken // size for doc, size, _, _, taken in as_table(before).sql(mixing.ORACLE).fetchall() if taken}
    assert Counter(r.doc_id for r in after.collect()) == want


def test_pack(stages):
    before, after = stages["pack"]
    check_packing(before, after.drop("ids").toPandas())


def test_run(spark, folder, stages):
    assert p.run(spark, folder).count() == stages["pack"][1].count()


def test_near_copies_without_ids_or_with_repeated_ones(spark, odd, folder):
    other = [(None, "a text without an id that nothing else repeats here", "en", "a", 1), (None, "another text without an id and also of its own", "en", "a", 1), (9, "the second text of an id that is there twice", "en", "c", 1)]
    after = p.one_of_each(spark, odd.unionByName(spark.createDataFrame(other, odd.schema)), folder).collect()
    assert Counter(r.doc_id for r in after) == {1: 1, 2: 1, 3: 1, 6: 1, 8: 1, 9: 2, None: 2}
    assert {r.text for r in after} >= {x[1] for x in other}


def family(n, seed, words=160, changed=6):
    """Texts of one template, of which each has some words changed."""
    rng = np.random.default_rng(seed)
    template = [f"w{seed}x{k}" for k in range(words)]
    out = []
    for i in range(n):
        t = list(template)
        for at in rng.choice(words, rng.integers(1, changed), replace=False):
            t[at] = f"v{seed}x{i}x{at}"
        out.append(" ".join(t))
    return out


def brute_classes(texts, similarity=0.8):
    sets = [{tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} for w in map(str.split, texts)]
    top = list(range(len(texts)))

    def find(x):
        while top[x] != x:
            x = top[x]
        return x

    linked = 0
    for i, a in enumerate(sets):
        for j in range(i):
            common = len(a & sets[j])
            if common >= similarity * (len(a) + len(sets[j]) - common):
                linked += 1
                x, y = find(i), find(j)
                top[max(x, y)] = min(x, y)
    return [find(i) for i in range(len(texts))], linked


@pytest.mark.parametrize("limit", [4096, 16])
def test_families_of_a_template(spark, limit):
    """Copies among documents that are alike by less than the similarity, also where shards are divided."""
    texts = [t for seed in range(3) for t in family(70, seed)]
    want, linked = brute_classes(texts)
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r["class"] for r in simhash_wide.similar_classes(rows, ["doc_id"], limit=limit).collect()}
    firsts = {}
    for i in range(len(texts)):
        firsts.setdefault(got[i], i)
    wrong = sum(firsts[got[i]] != want[i] for i in range(len(texts)))
    assert linked > 100 and len(set(want)) > 20 and wrong <= 0.03 * len(texts)
    # never too much: a class holds no two of different brute-force classes
    assert all(want[firsts[got[i]]] == want[i] for i in range(len(texts)))


def test_odd_and_empty_tables(spark, odd, nothing, folder):
    wide = odd.withColumn("lang_pred", F.lit("clash")).withColumn("size", F.lit(0)).withColumn("class", F.lit("clash")).withColumn("_row", F.lit(1))
    for name, stage in p.STAGES:
        assert stage(spark, nothing, folder).count() == 0, name
        out = stage(spark, wide, folder)
        if name != "pack":
            assert out.columns == odd.columns, name
    assert {r.doc_id for r in p.known_language(spark, wide, folder).collect()} == {1, 2, 6, 7, 8}
    assert p.unique_lines(spark, wide, folder).count() == odd.count()
