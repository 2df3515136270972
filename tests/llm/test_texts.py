"""HTML, sketches, language, line dedup and media against plain versions."""

import hashlib
import html
import re
import struct
import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest
from compare import rows
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lamplight.llm import html_text, jpeg, langid, line_dedup, media, sketch


def test_pages(spark, folder):
    pages = spark.read.parquet(f"{folder}/pages.parquet")
    got = {r.page_id: r for r in html_text.extract_main_text(pages).collect()}
    for r in pages.collect():
        article = re.search(r"<article>(.*?)(?:</article>|$)", r.html, re.S)[1].replace("<br>", " ")
        blocks = [re.sub(r"\s+", " ", html.unescape(re.sub(r"<[^>]*(?:>|$)", "", b))).strip() for b in re.split(r"</?(?:p|h1)(?:>|$)", article)]
        assert got[r.page_id].text == "\n\n".join(filter(None, blocks)) and got[r.page_id].n_chars == len(got[r.page_id].text)


WORDY = "Plain words that make a paragraph long enough to count as text. " * 4


def test_page_parts():
    page = f"""<body><div id=menu><a href=/>Home</a></div><header>Site</header><div class="post"><h1>Title &eacute;</h1><p>{WORDY}<p>Short one.</p><p>{WORDY}</p>
    <div class="comments-list"><p>{WORDY}</p></div></div><aside>{WORDY}</aside><form>{WORDY}</form><footer>{WORDY}</footer><script>var a = "<p>{WORDY}</p>";</script><div style="display:none">{WORDY}</div>"""
    assert html_text.main_text(page).split("\n\n") == ["Title é", WORDY.strip(), "Short one.", WORDY.strip()]
    assert html_text.main_text("<article><header><h1>A</h1></header>one<br>two<ul><li>x<li>y</ul><nav>no</nav></article><p>out") == "A\n\none two\n\nx\n\ny"
    assert html_text.main_text("") == "" and html_text.main_text("<p>cut off &am") == "cut off &am"


NAV = "".join(f"<li><a href=/{i}>Menu entry {i}</a></li>" for i in range(10))


def test_story_without_tags_or_names():
    story = f"<h1>A title</h1><p>By someone</p><p>Monday</p><p>{WORDY}</p><p>Short.</p><div>Buy this now</div><p>{WORDY}</p><p>The end.</p>"
    lines = ["A title", "By someone", "Monday", WORDY.strip(), "Short.", "Buy this now", WORDY.strip(), "The end."]
    page = f"<html><body><div><ul>{NAV}</ul></div><div>Buy that now</div><div>{story}</div><div><ul>{NAV}</ul><p>Copyright 2020</p></div></body></html>"
    assert html_text.main_text(page).split("\n\n") == lines
    # an advert that is named ends nothing, also before a short last line and where the body holds the story
    named = story.replace("<div>Buy", "<div class=ad-box>Buy").replace(f"<p>{WORDY}</p><p>The end", "<p>The end")
    for wrap in ("<div>{}</div>", "{}"):
        page = f"<body><ul>{NAV}</ul>{wrap.format(named)}<ul>{NAV}</ul><p>Copyright 2020</p></body>"
        assert html_text.main_text(page).split("\n\n") == [*lines[:5], lines[-1]]
    # a menu in the middle of a container loses none of what follows
    page = f"<body><div><p>{WORDY}</p><ul>{NAV}</ul><p>The end.</p></div></body>"
    assert html_text.main_text(page).split("\n\n") == [WORDY.strip(), "The end."]
    assert html_text.main_text(f"<div>{''.join(f'<p>line {i} of a verse</p>' for i in range(9))}</div>").count("\n\n") == 8


def test_names_are_read_by_whole_words():
    for name in ("search results", "side-by-side", "alert-levels", "header-story"):
        assert html_text.main_text(f'<body><div class="{name}"><p>{WORDY}</p></div></body>') == WORDY.strip(), name
    article = f"<article><p>{WORDY}</p><p class='alert-levels'>Level two.</p><div class='sidebarBox'>No</div><ul>{NAV}</ul><div id=comment-list><p>{WORDY}</p></div><p>The end.</p></article>"
    assert html_text.main_text(f"<p>{WORDY}</p>{article}").split("\n\n") == [WORDY.strip(), "Level two.", "The end."]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.tuples(st.sampled_from([-40, 5, 20, 90, 400]), st.sampled_from([(), (1,), (1, 2), (1, 3), (4,)])), max_size=14), st.integers(1, 4))
def test_distribution_by_brute_force(lines, window):
    """A line is kept if it surges, or if nothing but lines without a dive stands between it and a run of surging lines that shares its container."""
    weights, within, n = np.array([w for w, _ in lines], dtype=float), [p for _, p in lines], len(lines)
    near = lambda i: [j for j in range(i - window // 2, i - window // 2 + window) if 0 <= j < n]
    sums = [sum(weights[j] for j in near(i) if weights[j] < 0 or (within[j][-2:-1] or (0,)) == (within[i][-2:-1] or (0,))) for i in range(n)]
    surge = [weights[i] > 0 and sums[i] >= 80 for i in range(n)]
    want = [weights[i] > 0 for i in range(n)]
    if any(surge):
        want = list(surge)
        for i in range(n):
            for a in range(n):
                for b in range(a, n):
                    run = all(surge[a : b + 1]) and not (a and surge[a - 1]) and not (b + 1 < n and surge[b + 1])
                    if run and weights[i] > 0 and not surge[i]:
                        paths = [within[k] for k in range(a, b + 1)]
                        shared = next(paths[0][:k] for k in range(len(paths[0]), -1, -1) if all(p[:k] == paths[0][:k] for p in paths))
                        shared = shared[:-1] if a == b else shared
                        between = range(b + 1, i) if i > b else range(i + 1, a)
                        dive = not shared and any(all(k in between and weights[k] <= 0 for k in range(j, j + window)) for j in between)
                        if not dive and not any(surge[k] for k in between) and within[i][: len(shared)] == shared:
                            want[i] = True
    assert html_text.story_lines(weights, within, window, 80.0).tolist() == want


def test_odd_pages(spark):
    df = spark.createDataFrame([(1, "u", None), (2, None, ""), (3, "u", "<p>x" * 3)], "page_id long, url string, html string").withColumn("text", F.lit("clash"))
    assert {r.page_id: (r.text, r.n_chars) for r in html_text.extract_main_text(df).collect()} == {1: ("", 0), 2: ("", 0), 3: ("x\n\nx\n\nx", 7)}


def test_edits(docs):
    order = sorted(docs.collect(), key=lambda r: -r.doc_id)
    got = {r.doc_id: r for r in sketch.fingerprint_edits(docs).collect()}
    sets = lambda t: {tuple(t.split()[i : i + 5]) for i in range(max(1, len(t.split()) - 4))}
    errors = []
    for i, r in enumerate(order):
        after = order[(i + 1) % len(order)].text
        m = len(r.text) // 3
        edited = r.text[: len(r.text) - m] + after[:m]
        assert got[r.doc_id].edited_sha256 == hashlib.sha256(edited.encode()).hexdigest() and got[r.doc_id].n_chars == len(r.text)
        a, b = sets(r.text), sets(edited)
        errors.append(got[r.doc_id].near_edited - len(a & b) / len(a | b))
    assert abs(np.mean(errors)) < 0.01 and np.std(errors) < 0.06
    same = docs.groupBy("text").agg(F.collect_list("doc_id").alias("ids")).where("size(ids) > 1").collect()
    assert all(len({got[i].fingerprint for i in r.ids}) == 1 for r in same)


def test_odd_edits(odd, nothing):
    got = sketch.fingerprint_edits(odd).collect()
    assert len(got) == odd.count() and all(0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1 for r in got)
    assert len({r.fingerprint for r in got if r.doc_id in (3, 4, 5)}) == 1
    assert len({tuple(r) for r in got if r.doc_id == 7}) == 1
    assert sketch.fingerprint_edits(nothing).count() == 0


def test_sketches_merge(spark):
    words = [f"w{i}" for i in range(4000)]
    df = spark.createDataFrame([(1, " ".join(words[:3000])), (2, " ".join(words[1000:])), (3, " ".join(words))], "id int, text string")
    s = sketch.with_sketch(df, F.col("text"), "s")
    merged = sketch.merge_groups(s.where("id < 3").select(F.lit("k").alias("k"), "s"), "k", "s").first().s
    assert merged == s.where("id = 3").first().s
    a, b = s.where("id = 1").select(F.col("s").alias("a")), s.where("id = 3").select(F.col("s").alias("b"))
    r = a.crossJoin(b).select(sketch.resemblance(F.col("a"), F.col("b")).alias("r"), sketch.containment(F.col("a"), F.col("b")).alias("c"), sketch.distinct_count(F.col("b")).alias("n")).first()
    assert abs(r.r - 0.75) < 0.12 and r.c > 0.85 and 3000 < r.n < 5200


def test_languages(docs):
    model = langid.fit(docs.where(~langid.held_out()))
    out = langid.predict(docs, model).where(langid.held_out()).toPandas()
    assert (out.lang == out.lang_pred).mean() > 0.97 and out.score.between(0, 1).all()
    again = langid.predict(docs.withColumn("lang", F.lit("xx")).withColumn("source", F.lit("yy")), model).where(langid.held_out()).toPandas()
    assert (again.set_index("doc_id").lang_pred == out.set_index("doc_id").lang_pred).all()


def test_odd_languages(odd, docs, nothing):
    model = langid.fit(docs)
    got = {r.doc_id: r.lang_pred for r in langid.predict(odd.withColumn("score", F.lit("clash")), model).collect()}
    assert [got[i] for i in (3, 4, 5, 9)] == ["und"] * 4 and got[6] == "de"
    assert {r.lang_pred for r in langid.predict(odd, langid.fit(nothing)).collect()} == {"und"}
    assert langid.predict(nothing, model).count() == 0


def test_codewords_are_apart():
    for n in (2, 3, 5, 8, 40):
        code = langid.codewords(n)
        apart = (code.shape[1] - (code @ code.T)) / 2
        assert (apart[~np.eye(n, dtype=bool)] >= (1 if n == 2 else 2)).all()


def test_one_failing_bit_is_corrected(docs):
    model = langid.fit(docs)
    wrong = model._replace(weights=model.weights * np.where(np.arange(model.weights.shape[1]) == 2, -1, 1).astype(np.float32))
    out = langid.predict(docs, wrong).toPandas()
    assert (out.lang == out.lang_pred).mean() > 0.95


def test_lines_like_sql(docs, odd, duck):
    digest = F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256")
    take = lambda df, bits: line_dedup.dedup_lines(df, bits=bits).select("doc_id", "n_lines", "n_dropped", digest).toPandas()
    # also with a filter so small that it suspects almost every line
    for bits in (1 << 12, 1 << 22):
        assert rows(take(docs, bits)) == rows(duck.sql(line_dedup.ORACLE).df())
    con = duckdb.connect()
    con.register("documents", odd.toPandas().drop_duplicates())
    assert rows(take(odd.distinct().withColumn("n_lines", F.lit("clash")), 1 << 16)) == rows(con.sql(line_dedup.ORACLE).df())


def test_rows_of_one_document_keep_their_lines(odd, nothing):
    got = line_dedup.dedup_lines(odd, bits=1 << 16).where("doc_id = 7").collect()
    assert [r.n_dropped for r in got] == [2, 2]
    assert line_dedup.dedup_lines(nothing, bits=1 << 16).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.binary(max_size=3000))
def test_media_keep_bytes(data):
    payload = media.padded(data)
    assert len(payload) % 576 == 0 and len(payload)
    file = media.avi_file(payload)
    video = media.parse_avi(file)
    assert b"".join(x.tobytes() for x in media.decoded(video)) == payload
    assert jpeg.decode(bytes(video.frames[0])).tobytes() == payload[:576]


class Bits:
    def __init__(self):
        self.text = ""

    def put(self, codes, symbol, value=0, size=0):
        n, code = codes[symbol]
        self.text += f"{code:0{n}b}" + (f"{value if value >= 0 else value + (1 << size) - 1:0{size}b}" if size else "")

    def bytes(self):
        self.text += "1" * (-len(self.text) % 8)
        return int(self.text or "0", 2).to_bytes(len(self.text) // 8, "big").replace(b"\xff", b"\xff\x00")


def codes_of(table):
    return {s: k for k, s in jpeg.huffman_codes(*table).items()}


def put_block(bits, block, first, others, before):
    """Write one block of quantised coefficients in the order of the stream."""
    d = int(block[0]) - before
    bits.put(first, abs(d).bit_length(), d, abs(d).bit_length())
    run = 0
    for k in range(1, 64):
        v = int(block[k])
        if not v:
            run += 1
            continue
        while run > 15:
            bits.put(others, 0xF0)
            run -= 16
        bits.put(others, run << 4 | abs(v).bit_length(), v, abs(v).bit_length())
        run = 0
    if run:
        bits.put(others, 0)
    return int(block[0])


def baseline(planes, sampling, size, restart=0, one_scan=True, with_tables=False):
    """A baseline frame: planes are padded to whole blocks of each MCU; all quantisers are 2."""
    width, height = size
    grids = []
    for p in planes:
        blocks = p.reshape(p.shape[0] // 8, 8, p.shape[1] // 8, 8).swapaxes(1, 2).astype(float) - 128
        grids.append(np.rint((jpeg.COSINES @ blocks @ jpeg.COSINES.T).reshape(*blocks.shape[:2], 64)[..., jpeg.ZIGZAG] / 2).astype(int))
    most = [max(s[k] for s in sampling) for k in (0, 1)]
    out = b"\xff\xd8" + media.segment(0xE0, b"AVI1\x00") + media.segment(0xDB, b"\x00" + bytes([2] * 64))
    if with_tables:
        out += media.segment(0xC4, b"".join(bytes([c << 4 | t]) + table[0] + table[1] for (c, t), table in jpeg.USUAL.items()))
    out += media.segment(0xC0, struct.pack(">BHHB", 8, height, width, len(planes)) + b"".join(bytes([i + 1, a << 4 | d, 0]) for i, (a, d) in enumerate(sampling)))
    if restart:
        out += media.segment(0xDD, struct.pack(">H", restart))
    tables = [[codes_of(jpeg.USUAL[c, min(i, 1)]) for c in (0, 1)] for i in range(len(planes))]
    for chosen in [list(range(len(planes)))] if one_scan else [[i] for i in range(len(planes))]:
        out += media.segment(0xDA, bytes([len(chosen)]) + b"".join(bytes([i + 1, min(i, 1) * 17]) for i in chosen) + b"\x00\x3f\x00")
        if len(chosen) == 1:
            a, d = sampling[chosen[0]]
            mcus = [[(chosen[0], y, x)] for y in range(-(-height * d // (8 * most[1]))) for x in range(-(-width * a // (8 * most[0])))]
        else:
            mcus = [
                [(i, y * sampling[i][1] + v, x * sampling[i][0] + u) for i in chosen for v in range(sampling[i][1]) for u in range(sampling[i][0])]
                for y in range(-(-height // (8 * most[1])))
                for x in range(-(-width // (8 * most[0])))
            ]
        step = restart or len(mcus)
        for n, at in enumerate(range(0, len(mcus), step)):
            bits, before = Bits(), Counter()
            for i, y, x in (b for m in mcus[at : at + step] for b in m):
                before[i] = put_block(bits, grids[i][y, x], *tables[i], before[i])
            out += (bytes([0xFF, 0xD0 + (n - 1) % 8]) if n else b"") + bits.bytes()
    return out + b"\xff\xd9"


def smooth(rows, columns, seed):
    y, x = np.mgrid[:rows, :columns]
    noise = np.random.default_rng(seed).integers(-20, 20, (rows, columns))
    return np.clip(128 + 80 * np.sin(y / 9 + seed) * np.cos(x / 7) + noise, 0, 255).astype(np.uint8)


def test_baseline_frames():
    grey = smooth(24, 40, 1)
    for restart, with_tables in ((0, True), (2, False), (1, True)):
        got = jpeg.decode(baseline([grey], [(1, 1)], (37, 21), restart, with_tables=with_tables))
        assert got.shape == (21, 37, 1) and np.abs(got[..., 0].astype(int) - grey[:21, :37]).max() <= 5
    luma, blue, red = smooth(32, 48, 2), smooth(16, 24, 3), smooth(16, 24, 4)
    for restart, one_scan in ((0, True), (3, True), (0, False), (2, False)):
        got = jpeg.decode(baseline([luma, blue, red], [(2, 2), (1, 1), (1, 1)], (45, 30), restart, one_scan))
        assert got.shape == (30, 45, 3) and np.abs(got[..., 0].astype(int) - luma[:30, :45]).max() <= 5
        assert np.abs(got[..., 2].astype(int) - red.repeat(2, 0).repeat(2, 1)[:30, :45]).max() <= 5
    grey = np.full((1, 1, 3), 128, np.uint8)
    assert (jpeg.to_rgb(grey) == 128).all()
    assert jpeg.to_rgb(np.array([[[76, 85, 255]]], np.uint8))[0, 0].tolist() == [254, 0, 0]


def test_frames_that_are_refused():
    frame = baseline([smooth(8, 8, 1)], [(1, 1)], (8, 8))
    for bad in (frame.replace(b"\xff\xc0", b"\xff\xc2"), frame[:-12], b"GIF", b"\xff\xd8\xff\xd9"):
        with pytest.raises(ValueError):
            jpeg.decode(bad)


def avi_with_sound(frames, index="file", records=False):
    """An AVI file whose first stream is sound."""
    head = media.chunk(b"avih", struct.pack("<14I", 40000, *[0] * 13))
    sound = media.chunk(b"LIST", b"strl" + media.chunk(b"strh", b"auds" + bytes(52)))
    video = media.chunk(b"LIST", b"strl" + media.chunk(b"strh", b"vidsMJPG" + struct.pack("<IHHIII", 0, 0, 0, 0, 1, 10) + bytes(28)))
    start = b"RIFF    AVI " + media.chunk(b"LIST", b"hdrl" + head + sound + video) + media.chunk(b"JUNK", b"odd")
    movi, entries = b"movi", b""
    for f in frames:
        for name, body in ((b"00wb", b"noise"), (b"01dc", f)):
            at = len(movi) + (len(start) + 8 if index == "file" else 0)
            entries += name + struct.pack("<III", 16, at, len(body))
            movi += media.chunk(b"LIST", b"rec " + media.chunk(name, body)) if records else media.chunk(name, body)
    out = start + media.chunk(b"LIST", movi) + (media.chunk(b"idx1", entries) if index else b"")
    return out[:4] + struct.pack("<I", len(out) - 8) + out[8:]


def test_avi_files_of_others(spark):
    dark, light = (baseline([np.full((16, 16), v, np.uint8)], [(1, 1)], (16, 16)) for v in (20, 220))
    frames = [dark] * 12 + [b""] + [light] * 9
    for index, records in (("file", False), ("movi", False), (None, False), (None, True)):
        data = avi_with_sound(frames, index, records)
        video = media.parse_avi(data)
        assert video.fps == 10 and len(video.frames) == 22
        assert media.facts(data)[-1] == [(0.0, 1.3, 13), (1.3, 2.2, 9)]
    df = spark.createDataFrame([(1, bytearray(avi_with_sound(frames))), (2, None)], "doc_id long, media binary")
    rows_ = media.clip_rows(media.media_facts(df)).orderBy("clip").collect()
    assert [(r.doc_id, r.clip, r.start_s, r.frames) for r in rows_] == [(1, 0, 0.0, 13), (1, 1, 1.3, 9)]


def test_other_huffman_tables_are_read():
    lengths, symbols = bytes([0, 0, 7, 2] + [0] * 12), bytes([0, 1, 2, 3, 4, 5, 6, 7, 8])
    codes, bits = codes_of((lengths, symbols)), Bits()
    frame = np.arange(576, dtype=np.uint8).reshape(1, 24, 24)
    for d in media.differences(frame).ravel().tolist():
        bits.put(codes, abs(d).bit_length(), d, abs(d).bit_length())
    head = media.FRAME_HEAD.replace(media.LENGTHS + media.SYMBOLS, lengths + symbols)
    assert (jpeg.decode(head + bits.bytes() + b"\xff\xd9")[..., 0] == frame[0]).all()


def test_shots():
    dark, light = np.full((20, 24, 24), 10, np.uint8), np.full((15, 24, 24), 200, np.uint8)
    file = media.avi_file(np.concatenate([dark, light, dark]).tobytes())
    clips = media.facts(file)[-1]
    assert [c[2] for c in clips] == [20, 15, 20] and clips[1][0] == 20 / 25


def test_media_rows(odd, nothing):
    files = media.stored_media(odd, rows=3)
    got = media.media_facts(files)
    texts = {r.doc_id: (r.text or "").encode() for r in odd.collect()}
    for r in got.collect():
        data = texts[r.doc_id]
        payload = data + b"\xff" * ((-len(data)) % 576 or (0 if data else 576))
        assert (r.n_bytes, r.payload_bytes) == (len(data), len(payload))
        assert r.payload_sha256 == hashlib.sha256(payload).hexdigest() and r.tail_crc32 == zlib.crc32(payload[-32:])
    assert media.clip_rows(got).groupBy("doc_id").agg(F.sum("frames").alias("n")).where("doc_id = 6").first().n == -(-len(texts[6]) // 576)
    assert media.media_facts(media.stored_media(nothing)).count() == 0
