"""SimHash against brute force over all pairs."""

import numpy as np
import xxhash

from lamplight.llm import simhash, simhash_wide


def closure(ids, linked):
    label = list(ids)
    while True:
        then = [min(label[j] for j in np.flatnonzero(linked[i])) for i in range(len(ids))]
        if then == label:
            return label
        label = then


def plain_simhash(text):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    parts = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(p, seed=42) for p in parts]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_components(docs, odd):
    for df in (docs, odd):
        found = simhash.near_duplicates(df, limit=4).collect()
        texts = {}
        for r in df.collect():
            texts[r.doc_id] = r.text
        ids = sorted(texts)
        prints = np.array([plain_simhash(texts[i]) for i in ids], dtype=np.uint64)
        label = dict(zip(ids, closure(ids, np.bitwise_count(prints[:, None] ^ prints) <= 2), strict=True))
        assert len(found) == df.count()
        for r in found:
            assert r._fp % (1 << 64) == int(prints[ids.index(r.doc_id)]) and r.component_id == label[r.doc_id]


def test_dense_groups_are_divided_without_losing_links(spark):
    rng, values = np.random.default_rng(5), set()
    for base in rng.integers(0, 2**63, 3, dtype=np.uint64).tolist():
        for _ in range(400):
            v = base
            for b in rng.integers(0, 64, rng.integers(0, 4)):
                v ^= 1 << int(b)
            values.add(v)
    values = np.array(sorted(values), dtype=np.uint64)
    label = closure(values.view(np.int64).tolist(), np.bitwise_count(values[:, None] ^ values) <= 2)
    df = spark.createDataFrame([(int(x),) for x in values.view(np.int64)], "_fp long")
    root = {r.node: r.root for r in simhash.components(simhash.links(df, limit=20)).collect()}
    assert [root.get(v, v) for v in values.view(np.int64).tolist()] == label


def test_bk_tree_finds_all_within_the_radius():
    rng = np.random.default_rng(1)
    values = [int(x) for x in rng.integers(0, 1 << 12, 500)]
    tree = simhash.BKTree()
    for i, v in enumerate(values):
        tree.add(v, i)
    for v in values[:50]:
        assert sorted(tree.near(v, 2)) == [i for i, w in enumerate(values) if (v ^ w).bit_count() <= 2]


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(100, 160)] + [(7, k) for k in range(200, 260)] + [(5, 3), (3, 1)]
    df = spark.createDataFrame(edges, "a long, b long")
    root = {r.node: r.root for r in simhash.components(df).collect()}
    assert {root[i] for i in range(101, 161)} == {100} and {root[k] for k in range(200, 260)} == {7} and root[5] == root[3] == 1
    assert simhash.components(df.where("a < 0")).count() == 0


def test_similar_documents(spark, nothing):
    rng = np.random.default_rng(2)
    words = [f"w{i}" for i in range(3000)]
    rows, near = [], []
    for g in range(40):
        base = rng.choice(words, 300).tolist()
        rows.append((10 * g, " ".join(base)))
        edited = list(base)
        for k in rng.choice(300, 3, replace=False):
            edited[k] = "new"
        rows.append((10 * g + 1, " ".join(edited)))
        near.append(10 * g + 1)
        rows.append((10 * g + 2, " ".join(rng.choice(words, 300).tolist())))
    rows += [(1001, None), (1002, ""), (1003, "one two"), (1004, "one two")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in simhash_wide.similar_documents(df).collect()}
    assert sum(got[i] == i - 1 for i in near) >= 38
    assert all(got[10 * g + 2] == 10 * g + 2 for g in range(40))
    assert got[1002] == 1001 and got[1004] == 1003
    assert simhash_wide.similar_documents(nothing).count() == 0


def test_copies_inside_a_family_of_similar_documents_are_found(spark):
    rng = np.random.default_rng(3)
    word = lambda n: [f"v{x}" for x in rng.integers(0, 10**9, n)]
    template, rows = word(330), []
    for g in range(300):
        base = template + word(70)
        rows.append((2 * g, " ".join(base)))
        if g < 60:
            edited = list(base)
            edited[335:362] = word(27)
            rows.append((2 * g + 1, " ".join(edited)))
    got = {r.doc_id: r.component_id for r in simhash_wide.similar_documents(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    found = sum(got[2 * g + 1] == 2 * g for g in range(60))
    assert found >= 57, found
    assert all(got[2 * g] == 2 * g for g in range(300))


def test_sets_decide_and_not_repeats(spark):
    rng = np.random.default_rng(4)
    word = lambda n: [f"v{x}" for x in rng.integers(0, 10**9, n)]
    filler, own = "0 " * 900, word(100)
    rows = [(1, filler + " ".join(word(100))), (2, filler + " ".join(word(100))), (3, " ".join(own)), (4, " ".join(own + own[:60] * 5))]
    got = {r.doc_id: r.component_id for r in simhash_wide.similar_documents(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: 1, 2: 2, 3: 3, 4: 3}
