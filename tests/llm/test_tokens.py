"""Token counts, packing and the token store against the library itself."""

import zlib
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from lamplight.llm import bpe_count, chunk_store, packing, token_units
from lamplight.llm.common import fresh_path

BYTES, WORDS = token_units.vocabulary("byte_bpe_50k.json"), token_units.vocabulary("word_bpe_49k.json")
SIGNS = "abzAZ01'’.,!<|> \n\t\r\x0b\x0c\x1c\x1f\x85\xa0　éÉßİıΣ漢가́​²½😀_-"
LIBRARY = {p: Tokenizer.from_file(p) for p in (BYTES, WORDS)}
MEMO = {BYTES: token_units.UnitIds(BYTES, "<u4", most=50), WORDS: token_units.UnitIds(WORDS, "<u4", most=50)}
COUNTS = bpe_count.UnitCounts(BYTES, most=50)


def ids(path, text):
    return LIBRARY[path].encode(text or "", add_special_tokens=False).ids


@settings(max_examples=400, deadline=None)
@given(st.one_of(st.text(SIGNS, max_size=60), st.text(max_size=40), st.sampled_from(["<|endoftext|>x", "a <|startoftext|>", "it's we'LL don't", "a" * 300])))
def test_units_give_the_library_s_ids(text):
    text = text.encode("utf-8", "ignore").decode()
    for path, encode in ((BYTES, token_units.byte_level_ids), (WORDS, token_units.word_level_ids)):
        assert np.frombuffer(encode(MEMO[path], text), "<u4").tolist() == ids(path, text)
    assert COUNTS.of(text) == len(ids(BYTES, text))


def test_counts(docs, odd):
    for df in (docs, odd.withColumn("n_tokens", F.lit("clash"))):
        out = bpe_count.token_counts(df).toPandas()
        texts = df.select("text").toPandas()["text"]
        want = sorted((len((t or "").encode()), len(ids(BYTES, t)), len(ids(BYTES, t)) > 512) for t in texts)
        assert sorted(zip(out.n_bytes, out.n_tokens, out.over_limit, strict=True)) == want


def check_packing(df, out, capacity=1024):
    want = Counter()
    for r in df.collect():
        stream = [*ids(BYTES, r.text), 2]
        start = 0
        for i, n in enumerate(packing.cut_lengths(len(stream), capacity)):
            want[(r.doc_id, i, start, n, zlib.crc32(np.array(stream[start : start + n], "<u4").tobytes()))] += 1
            start += n
    assert Counter(zip(out.doc_id, out.piece, out.start, out.length, out.ids_crc32, strict=True)) == want
    for _, g in out.sort_values("offset").groupby("sequence_id"):
        assert (g.offset == g.length.cumsum() - g.length).all() and g.length.sum() <= capacity


def test_packing(docs, odd):
    for df in (docs, odd):
        out = packing.pack(df).toPandas()
        check_packing(df, out)
        if df is docs:
            assert out.sequence_id.nunique() <= 1.08 * -(-out.length.sum() // 1024)


def test_kept_ids(odd):
    for r in packing.pack(odd, keep_ids=True).collect():
        assert len(r.ids) == r.length and zlib.crc32(np.array(r.ids, "<u4").tobytes()) == r.ids_crc32


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.integers(1, 64), st.integers(1, 50), max_size=20))
def test_plan_uses_every_piece_once(counts):
    plan, used = packing.packing_plan(counts, 64).patterns, Counter()
    for parts, n in plan:
        assert sum(parts) <= 64 and n > 0
        for x in parts:
            used[x] += n
    assert used == Counter(counts)
    assert len(plan) <= 64 * 12


def test_exact_fills_come_first():
    assert packing.packing_plan({600: 10, 424: 10}, 1024) == ([((600, 424), 10)], 10)
    plan = packing.packing_plan({500: 4, 300: 4, 200: 4, 24: 4}, 1024)
    assert plan.sequences() == 4 and plan.exact >= 9
    assert packing.packing_plan({}, 1024) == ([], 0)


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.integers(1, 30), st.integers(1, 4), max_size=8), st.integers(1, 31))
def test_index_finds_every_exact_sum(counts, gap):
    left = np.array([counts.get(k, 0) for k in range(33)])
    index = packing.ComplementIndex(left, 32)
    usable = [k for k, n in counts.items() if n >= packing.SPARE]
    fits = lambda c: all(n <= counts[x] for x, n in Counter(c).items())
    pairs = {tuple(sorted((a, b))) for a in usable for b in usable if a + b == gap and fits((a, b))}
    found = index.pair(gap)
    assert (found is not None) == bool(pairs) and (found is None or tuple(sorted(found)) in pairs)
    found = index.triple(gap)
    assert found is None or sum(found) == gap and fits(found)
    many = [k for k, n in counts.items() if n >= 4]
    assert found is not None or not any(a + b + c == gap for a in many for b in many for c in many)


def packed_best_fit(counts, capacity):
    """Sequences that best fit by decreasing length needs."""
    gaps = []
    for x in sorted(Counter(counts).elements(), reverse=True):
        fit = [i for i, g in enumerate(gaps) if g >= x]
        if fit:
            i = min(fit, key=gaps.__getitem__)
            gaps[i] -= x
        else:
            gaps.append(capacity - x)
    return len(gaps)


def test_exact_fills_need_no_more_sequences_than_best_fit(docs):
    lengths = Counter(n for r in docs.collect() for n in packing.cut_lengths(len(ids(BYTES, r.text)) + 1, 1024))
    plan = packing.packing_plan(lengths, 1024)
    assert plan.sequences() <= packed_best_fit(lengths, 1024) and plan.exact > 0
    lengths = Counter(np.random.default_rng(5).integers(1, 400, 4000).tolist())
    plan = packing.packing_plan(lengths, 1024)
    assert plan.sequences() <= packed_best_fit(lengths, 1024) + 1 and plan.exact > 1000


def store_rows(spark, df):
    store = chunk_store.write_store(df)
    return store, chunk_store.read_store(spark, store, keep_ids=True)


def test_store(spark, docs, odd):
    for df in (docs, odd):
        store, out = store_rows(spark, df)
        rows = sorted(out.collect(), key=lambda r: (r.doc, r.start))
        start, texts = 0, {}
        for r in df.collect():
            texts.setdefault(r.doc_id, Counter())[r.text] += 1
        for r in rows:
            streams = {tuple([*ids(WORDS, t), 2]) for t in texts[r.doc]}
            assert tuple(r.ids) in streams and r.start == start and r.n_tokens == len(r.ids)
            assert r.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4").tobytes())
            start += r.n_tokens
        assert len(rows) == df.count()
        files = chunk_store.chunks(spark, store)
        kept = files.where("data is not null")
        assert kept.count() == kept.select("digest").distinct().count() == files.select("digest").distinct().count()
        total = spark.read.parquet(store.manifest).agg(F.sum("documents"), F.sum("ids")).first()
        assert tuple(total) == (len(rows), start)
        assert len(chunk_store.manifest_root(spark, store)) == 16


def test_hot_chunks_are_spread(spark, odd, monkeypatch):
    monkeypatch.setattr(chunk_store, "HOT_USES", 1)
    store, out = store_rows(spark, odd)
    plain = chunk_store.read_store(spark, store._replace(), keep_ids=True)
    assert sorted(map(tuple, out.collect()), key=repr) == sorted(map(tuple, plain.collect()), key=repr)
    assert out.count() == odd.count()


def test_changed_chunk_is_noticed(spark, odd):
    store, _ = store_rows(spark, odd)
    broken = chunk_store.chunks(spark, store).withColumn("data", F.when(F.col("data").isNotNull(), F.concat("data", F.lit(b"\x01\x00"))))
    other = fresh_path(spark, "broken")
    chunk_store.save_chunks(broken, other, store.buckets)
    for part in ("recipes", "manifest"):
        spark.read.parquet(f"{store.folder}/{part}").write.parquet(f"{other}/{part}")
    with pytest.raises(Exception, match="its bytes have changed"):
        chunk_store.read_store(spark, store._replace(folder=other)).collect()


def test_another_session_opens_a_store(spark, odd):
    store, out = store_rows(spark, odd)
    session = spark.newSession()
    again = chunk_store.open_store(session, store.folder)
    assert again == store
    assert sorted(map(tuple, chunk_store.read_store(session, again, keep_ids=True).collect()), key=repr) == sorted(map(tuple, out.collect()), key=repr)
    assert not [t.name for t in spark.catalog.listTables() if t.name.startswith("chunks_")]


def test_cuts_depend_on_content():
    rng = np.random.default_rng(0)
    common = rng.integers(0, 49000, 20000).astype("<u2")
    a, b = np.concatenate([rng.integers(0, 49000, 777).astype("<u2"), common]), np.concatenate([rng.integers(0, 49000, 1234).astype("<u2"), common])
    parts = lambda x: {x[i:j].tobytes() for i, j in zip([0, *chunk_store.cut_points(x)], chunk_store.cut_points(x), strict=False)}
    assert len(parts(a) & parts(b)) > 20
    assert chunk_store.cut_points(common)[-1] == len(common)


def test_empty(spark, nothing):
    assert bpe_count.token_counts(nothing).count() == packing.pack(nothing).count() == 0
    assert store_rows(spark, nothing)[1].count() == 0
