"""Ranked lexical search by Block-Max WAND over an index in compressed blocks.

Documents are cut into segments of a bounded number of words; a segment is indexed by the
task that reads it, so no posting is shuffled and a frequent word is spread like the
documents are.  A word's postings in a segment are blocks of 64: gaps between document
numbers and counts as bytes of seven bits.  With each block lie its last document, the
greatest impact in it and where its bytes end, so that blocks are passed over without
being unpacked.

A search looks at a segment's cursors in order of their documents.  The first document
where the greatest impacts of the words so far reach the score of the item's last kept
hit is the pivot.  Then the shallow pointers move to the blocks that hold it: if the
blocks' own greatest impacts don't reach that score, all documents up to the nearest end
of these blocks are skipped; else the blocks are unpacked and the pivot is scored.  Before
that, the documents of the blocks of most impact are scored to begin with a high bar.
Each segment gives its best hits, of which the best are taken for each item.  An eighth of
the segments is searched first, and the others need the scores found there at least.

Scores are whole numbers: a word's weight, floor(1000 ln((2N + 2) / (2 df + 1))), times
its impact, 1000000000 tf div (1000 tf + 8 m), with m = 25 + 75 n N div L for a document of n
words, N documents with words and L words in all.

Cases: a null or empty text has no words, and neither is found nor finds anything; texts
of any length are indexed whole, a very long one as a segment of its own; documents of
equal score are ordered by id, nulls last; rows of one id are documents of their own;
equal items are one, items of one id and several texts share one list of ranks; an empty
table gives an empty result; columns other than ids and texts are dropped, so none can clash.
"""

from __future__ import annotations

import heapq
import math
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from lamplight.llm.common import written
from lamplight.llm.periodic import Numbers

#: Postings in a block, and words in a segment.
BLOCK, SEGMENT = 64, 1 << 20
#: Items searched at once, and bytes of their texts.
ITEMS, ITEM_BYTES = 2000, 4 << 20
#: Words whose best blocks are scored first.
FIRST = 4
#: A word that more than one in so many documents have is taken to be everywhere.
DENSE = 4
#: Rows of an Arrow batch.
ROWS = 20_000
#: One of so many groups of segments is searched before the others.
AHEAD = 8
#: Bytes of a text to bytes of its words: letters in lower case, blanks between.
WORD_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))


def words_of(text: bytes | None) -> list[bytes]:
    """The words of a text in UTF-8: letters and digits of ASCII and all else beyond it, only A-Z lower-cased."""
    return text.translate(WORD_BYTES).split() if text else []


def impact(tf, m):
    """What a word that a document has tf times adds to its score, for a weight of one."""
    return 1_000_000_000 * tf // (1000 * tf + 8 * m)


def seven_bits(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Numbers as bytes of seven bits, the last of each below 128, and where each number ends."""
    size = np.ones(len(values), dtype=np.int64)
    for bits in (7, 14, 21, 28):
        size += values >= (1 << bits)
    ends = np.cumsum(size)
    out = np.empty(int(ends[-1]) if len(ends) else 0, dtype=np.uint8)
    for k in range(5):
        some = size > k
        if not some.any():
            break
        more = (size[some] > k + 1).astype(np.int64) << 7
        out[(ends - size)[some] + k] = (values[some] >> (7 * k)) & 127 | more
    return out, ends


def numbers(data: bytes) -> np.ndarray:
    """What seven_bits made these bytes of."""
    b = np.frombuffer(data, dtype=np.uint8).astype(np.int64)
    last = np.flatnonzero(b < 128)
    if len(last) == len(b):
        return b
    starts = np.concatenate(([0], last[:-1] + 1))
    place = np.arange(len(b)) - np.repeat(starts, last - starts + 1)
    return np.add.reduceat((b & 127) << (7 * place), starts)


def statistics(docs: DataFrame, text_col: str = "text") -> tuple[int, int]:
    """Documents with words, and words in all."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = [len(words_of(text.as_py())) for text in batch.column(0).cast(pa.binary())]
            yield pa.RecordBatch.from_pydict({"docs": [sum(n > 0 for n in sizes)], "words": [sum(sizes)]})

    total = docs.select(text_col).mapInArrow(count, "docs long, words long").agg(F.coalesce(F.sum("docs"), F.lit(0)), F.coalesce(F.sum("words"), F.lit(0))).first()
    return int(total[0]), int(total[1])


def index_schema(id_type: T.DataType) -> T.StructType:
    """Rows of an index: one of the documents of a segment (term null), one for each of its words."""
    longs = T.ArrayType(T.LongType())
    fields = [("segment", T.LongType()), ("term", T.StringType()), ("n", T.LongType()), ("last", longs), ("top", longs), ("ends", longs), ("data", T.BinaryType()), ("docs", T.ArrayType(id_type)), ("m", longs)]
    return T.StructType([T.StructField(*f) for f in fields])


def indexed(docs: DataFrame, total: tuple[int, int], id_col: str = "doc_id", text_col: str = "text", segment: int = SEGMENT) -> DataFrame:
    """The index of docs, given statistics(docs)."""
    n_docs, n_words = total
    schema = index_schema(docs.schema[id_col].dataType)
    arrow = pa.schema([(f.name, to_arrow_type(f.dataType)) for f in schema])

    def lists(values: np.ndarray, ends: np.ndarray) -> pa.Array:
        return pa.ListArray.from_arrays(pa.array(np.concatenate(([0], ends)), pa.int32()), pa.array(values, pa.int64()))

    def packed(number: int, vocabulary: Numbers, terms: list[np.ndarray], ids: list) -> Iterator[pa.RecordBatch]:
        lengths = np.array([len(t) for t in terms], dtype=np.int64)
        m = 25 + 75 * lengths * n_docs // n_words
        one = lambda name, x: pa.array([x], arrow.field(name).type)
        yield pa.RecordBatch.from_arrays([one("segment", number), one("term", None), one("n", len(ids)), *[one(x, None) for x in ("last", "top", "ends", "data")], one("docs", ids), one("m", m.tolist())], schema=arrow)
        keys = np.concatenate(terms).astype(np.int64) * len(ids) + np.repeat(np.arange(len(ids)), lengths)
        keys.sort()
        first = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
        tf = np.diff(np.concatenate((first, [len(keys)])))
        term, doc = np.divmod(keys[first], len(ids))
        begins = np.flatnonzero(np.concatenate(([True], term[1:] != term[:-1])))
        count = np.diff(np.concatenate((begins, [len(term)])))
        inside = np.arange(len(term)) - np.repeat(begins, count)
        block = np.flatnonzero(inside % BLOCK == 0)
        gap = doc - np.where(inside == 0, -1, np.concatenate(([0], doc[:-1])))
        tops = np.maximum.reduceat(impact(tf, m[doc]), block)
        block_end = np.concatenate((block[1:], [len(term)]))
        data, ends = seven_bits(np.stack((gap, tf), axis=1).ravel())
        byte_end = ends[2 * block_end - 1]
        blocks = np.cumsum((count + BLOCK - 1) // BLOCK)
        term_end = byte_end[blocks - 1]
        relative = byte_end - np.repeat(np.concatenate(([0], term_end[:-1])), np.diff(np.concatenate(([0], blocks))))
        names = list(vocabulary)
        for lo in range(0, len(begins), ROWS):
            hi = min(lo + ROWS, len(begins))
            b0, d0 = (blocks[lo - 1], term_end[lo - 1]) if lo else (0, 0)
            b1, d1 = blocks[hi - 1], term_end[hi - 1]
            per = blocks[lo:hi] - b0
            bounds = np.concatenate(([0], term_end[lo:hi] - d0)).astype(np.int32)
            binary = pa.BinaryArray.from_buffers(pa.binary(), hi - lo, [None, pa.py_buffer(bounds.tobytes()), pa.py_buffer(data[d0:d1].tobytes())])
            texts = pa.array([names[t] for t in term[begins[lo:hi]].tolist()], pa.binary()).cast(pa.string())
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.full(hi - lo, number), pa.int64()),
                    texts,
                    pa.array(count[lo:hi], pa.int64()),
                    lists(doc[block_end[b0:b1] - 1], per),
                    lists(tops[b0:b1], per),
                    lists(relative[b0:b1], per),
                    binary,
                    pa.nulls(hi - lo, arrow.field("docs").type),
                    pa.nulls(hi - lo, arrow.field("m").type),
                ],
                schema=arrow,
            )

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        vocabulary, terms, ids, held = Numbers(), [], [], 0
        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()), strict=True):
                if not (words := words_of(text.as_py())):
                    continue
                if held and held + len(words) > segment:
                    yield from packed(number, vocabulary, terms, ids)
                    vocabulary, terms, ids, held, number = Numbers(), [], [], 0, number + 1
                terms.append(np.fromiter(map(vocabulary.__getitem__, words), dtype=np.int32, count=len(words)))
                ids.append(doc_id)
                held += len(words)
        if ids:
            yield from packed(number, vocabulary, terms, ids)

    return docs.select(id_col, text_col).mapInArrow(build, schema)


class Cursor:
    """A word's place in a segment, for one item: at document doc or before the next one it has."""

    __slots__ = ("postings", "weight", "bound", "doc", "block", "shallow", "docs", "impacts", "at")

    def __init__(self, postings: Postings, weight: int):
        self.postings, self.weight, self.bound = postings, weight, weight * postings.greatest
        self.doc, self.block, self.shallow, self.at = 0, -1, 0, 0

    def taken(self, doc: int) -> int:
        """The word's impact in a document; the cursor moves on to the next one, unpacking the block that holds this one."""
        p, b = self.postings, self.shallow
        if b == len(p.last):
            self.doc = END
            return 0
        if b != self.block:
            self.block, self.at = b, 0
            self.docs, self.impacts = p.unpacked(b)
        at = bisect_left(self.docs, doc, self.at)
        found = 0
        if self.docs[at] == doc:
            found = self.impacts[at]
            at += 1
        self.at = at
        self.doc = self.docs[at] if at < len(self.docs) else doc + 1
        return found


END = 1 << 62


class Postings:
    """A word's blocks in a segment; unpacked ones are kept for the items to come."""

    __slots__ = ("last", "top", "ends", "data", "m", "greatest", "dense", "kept", "maps")

    def __init__(self, last: list[int], top: list[int], ends: list[int], data: bytes, m: np.ndarray):
        self.last, self.top, self.ends, self.data, self.m = last, top, ends, data, m
        self.greatest, self.kept, self.maps = max(top), {}, {}
        self.dense = DENSE * BLOCK * len(last) > len(m)

    def unpacked(self, block: int) -> tuple[list[int], list[int]]:
        """Documents and impacts of a block."""
        if (found := self.kept.get(block)) is None:
            pairs = numbers(self.data[self.ends[block - 1] if block else 0 : self.ends[block]]).reshape(-1, 2)
            docs = np.cumsum(pairs[:, 0]) + (self.last[block - 1] if block else -1)
            found = self.kept[block] = (docs.tolist(), impact(pairs[:, 1], self.m[docs]).tolist())
        return found

    def impact_of(self, block: int, doc: int) -> int:
        if (found := self.maps.get(block)) is None:
            found = self.maps[block] = dict(zip(*self.unpacked(block), strict=True))
        return found.get(doc, 0)


class Best:
    """The k best (score, document) of a segment so far, and the score that the next one has to reach."""

    def __init__(self, tie: list[int], k: int, bar: int):
        self.tie, self.k, self.bar = tie, k, bar
        self.heap: list[tuple[int, int, int]] = []

    def offer(self, score: int, doc: int) -> None:
        if score < self.bar:
            return
        if len(self.heap) < self.k:
            heapq.heappush(self.heap, (score, -self.tie[doc], doc))
        else:
            heapq.heappushpop(self.heap, (score, -self.tie[doc], doc))
        if len(self.heap) == self.k:
            self.bar = max(self.bar, self.heap[0][0])


def scored_first(words: list[tuple[Postings, int]], best: Best) -> set[int]:
    """Score the documents of the blocks of most impact, of the words of most weight."""
    top = sorted(words, key=lambda x: -x[0].greatest * x[1])[:FIRST]
    some = sorted({doc for p, _ in top for doc in p.unpacked(p.top.index(p.greatest))[0]})
    sums = [0] * len(some)
    for p, w in words:
        b = 0
        for i, doc in enumerate(some):
            b = bisect_left(p.last, doc, b)
            if b == len(p.last):
                break
            sums[i] += w * p.impact_of(b, doc)
    for score, doc in zip(sums, some, strict=True):
        best.offer(score, doc)
    return set(some)


def segment_hits(words: list[tuple[Postings, int]], tie: list[int], k: int, bar: int = 1) -> list[tuple[int, int]]:
    """The k best (score, document) of a segment, of those that reach bar, for words with weights.

    tie ranks documents of equal score, the least first.  Words that more than one in DENSE
    documents have are taken to be at every document, so their cursors needn't be ordered.
    """
    best = Best(tie, k, bar)
    early = scored_first(words, best) if bar <= 1 else ()
    dense = [(p, w) for p, w in words if p.dense]
    dense_bound = sum(w * p.greatest for p, w in dense)
    dense_blocks: list[int] = [0] * len(dense)
    dense_reach, dense_end = 0, -1
    cursors = [Cursor(p, w) for p, w in words if not p.dense]
    by_doc, least, stop = (lambda c: c.doc), 0, len(tie)
    while least < stop:
        cursors.sort(key=by_doc)
        while cursors and cursors[-1].doc >= stop:
            cursors.pop()
        bar, reach, upto, pivot = best.bar, dense_bound, 0, least
        if reach < bar:
            for upto, c in enumerate(cursors, 1):
                reach += c.bound
                if reach >= bar:
                    pivot = c.doc
                    break
            else:
                break
        while upto < len(cursors) and cursors[upto].doc <= pivot:
            upto += 1
        # Shallow moves: only the lists of the blocks' last documents are read.
        if pivot > dense_end:
            dense_reach, dense_end = 0, END
            for i, (p, w) in enumerate(dense):
                dense_blocks[i] = b = bisect_left(p.last, pivot, dense_blocks[i])
                if b < len(p.last):
                    dense_reach += w * p.top[b]
                    dense_end = min(dense_end, p.last[b])
        reach, skip = dense_reach, dense_end
        for c in cursors[:upto]:
            last = c.postings.last
            c.shallow = b = bisect_left(last, pivot, c.shallow)
            if b < len(last):
                reach += c.weight * c.postings.top[b]
                if last[b] < skip:
                    skip = last[b]
        if reach < bar:
            least = skip + 1
            if upto < len(cursors) and cursors[upto].doc < least:
                least = cursors[upto].doc
            # Where the cursors go is a bound as yet; blocks are unpacked only for a pivot that is scored.
            for c in cursors[:upto]:
                c.doc = least
            continue
        score, least = 0, pivot + 1
        for c in cursors[:upto]:
            score += c.weight * c.taken(pivot)
        if score + dense_reach >= bar and pivot not in early:
            for (p, w), b in zip(dense, dense_blocks, strict=True):
                if b < len(p.last):
                    score += w * p.impact_of(b, pivot)
            best.offer(score, pivot)
    return [(score, doc) for score, _, doc in best.heap]


def found_in_block(index: DataFrame, total: tuple[int, int], items: list[tuple[int, str]], k: int, id_type: T.DataType, segment: int) -> DataFrame:
    """(number, doc, score): the best hits of each segment for numbered items, which are a bounded block of all."""
    spark = index.sparkSession
    asked = {number: Counter(words_of((text or "").encode())) for number, text in items}
    terms = sorted({w.decode() for words in asked.values() for w in words})
    wanted = spark.createDataFrame([(w,) for w in terms], "term string")
    hits = written(index.join(F.broadcast(wanted), "term", "left_semi").select(*index.columns), "ranked-postings")
    frequent = hits.groupBy("term").agg(F.sum("n").alias("df")).collect()
    weight = {r.term.encode(): math.floor(1000 * math.log((2 * total[0] + 2) / (2 * r.df + 1))) for r in frequent}
    queries = {number: [(w, weight[w] * n) for w, n in words.items() if weight.get(w, 0) > 0] for number, words in asked.items()}
    schema = T.StructType([T.StructField("number", T.LongType()), T.StructField("doc", id_type), T.StructField("score", T.LongType())])
    arrow = pa.schema([(f.name, to_arrow_type(f.dataType)) for f in schema])

    def searched(rows: DataFrame, bars: dict[int, int]) -> DataFrame:
        def search(table: pa.Table) -> pa.Table:
            out, scores = [], {number: [bar] * k for number, bar in bars.items()}
            table = table.sort_by("segment")
            names = table["segment"].combine_chunks()
            bounds = [*np.unique(names.to_numpy(), return_index=True)[1].tolist(), len(names)]
            for lo, hi in zip(bounds, bounds[1:], strict=False):
                segment = table.slice(lo, hi - lo)
                head = segment.filter(pc.is_null(segment["term"]))
                ids, m = head["docs"][0].as_py(), np.array(head["m"][0].as_py(), dtype=np.int64)
                tie = [0] * len(ids)
                for place, i in enumerate(sorted(range(len(ids)), key=lambda i: (True,) if ids[i] is None else (False, ids[i]))):
                    tie[i] = place
                words = segment.filter(pc.is_valid(segment["term"])).select(["term", "last", "top", "ends", "data"]).to_pydict()
                postings = {w.encode(): Postings(*rest, m) for w, *rest in zip(*words.values(), strict=True)}
                for number, asks in queries.items():
                    kept = scores.setdefault(number, [])
                    found = segment_hits([(postings[w], x) for w, x in asks if w in postings], tie, k, kept[k - 1] if len(kept) >= k else 1)
                    out += [(number, ids[doc], score) for score, doc in found]
                    scores[number] = heapq.nlargest(k, kept + [score for score, _ in found])
            return pa.Table.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*out, strict=True) if out else [(), (), ()], arrow, strict=True)], schema=arrow)

        return rows.groupBy("_group").applyInArrow(search, schema)

    # Segments are searched in groups of about two full ones, which share what was found.
    groups = math.ceil(total[1] / (2 * segment))
    rows = hits.unionByName(index.where("term is null")).withColumn("_group", F.pmod(F.xxhash64("segment"), F.lit(groups)))
    ahead = F.col("_group") < math.ceil(groups / AHEAD)
    first = written(searched(rows.where(ahead), {}), "ranked-first")
    best = first.withColumn("_n", F.row_number().over(Window.partitionBy("number").orderBy(F.col("score").desc()))).where(F.col("_n") == k)
    bars = {r.number: r.score for r in best.select("number", "score").collect()}
    return first.unionByName(searched(rows.where(~ahead), bars))


def ranked(docs: DataFrame, items: DataFrame, k: int = 10, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", segment: int = SEGMENT) -> DataFrame:
    """(item, rank, id, score): the k documents of highest score for each item.

    Items are searched in blocks, each small enough to be sent to all tasks.
    """
    spark = docs.sparkSession
    id_type = docs.schema[id_col].dataType
    asked = items.select(F.col(item_col).alias("_item"), F.coalesce(F.col(item_text_col), F.lit("")).alias("_asked")).distinct()
    size = asked.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("_asked")), F.lit(0))).first()
    blocks = max(math.ceil(size[0] / ITEMS), math.ceil(size[1] / ITEM_BYTES))
    total = statistics(docs, text_col)
    hit_type = f"_item {items.schema[item_col].dataType.simpleString()}, _doc {id_type.simpleString()}, score long"
    found = spark.createDataFrame([], hit_type)
    if total[0] and blocks:
        index = written(indexed(docs, total, id_col, text_col, segment), "ranked-index")
        for block in range(blocks):
            rows = asked.where(F.pmod(F.xxhash64("_item", "_asked"), F.lit(blocks)) == block).collect()
            numbered = [(i, r._asked) for i, r in enumerate(rows)]
            names = spark.createDataFrame([(i, r._item) for i, r in enumerate(rows)], T.StructType([T.StructField("number", T.LongType()), T.StructField("_item", items.schema[item_col].dataType)]))
            hits = found_in_block(index, total, numbered, k, id_type, segment)
            found = found.unionByName(hits.join(F.broadcast(names), "number").select("_item", F.col("doc").alias("_doc"), "score"))
    order = Window.partitionBy("_item").orderBy(F.col("score").desc(), F.col("_doc").asc_nulls_last())
    best = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return best.select(F.col("_item").alias(item_col), "rank", F.col("_doc").alias(id_col), "score")


TERMS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"
ORACLE = f"""
WITH terms AS (SELECT doc_id, unnest({TERMS}) AS term FROM documents),
sizes AS (SELECT doc_id, count(*) AS n FROM terms GROUP BY doc_id),
total AS (SELECT count(*) AS n_docs, CAST(sum(n) AS BIGINT) AS n_words FROM sizes),
tfs AS (SELECT doc_id, term, count(*) AS tf FROM terms GROUP BY doc_id, term),
weights AS (SELECT term, CAST(floor(1000 * ln(CAST(2 * n_docs + 2 AS DOUBLE) / (2 * count(*) + 1))) AS BIGINT) AS w FROM tfs, total GROUP BY term, n_docs),
asked AS (SELECT item_id, unnest({TERMS}) AS term FROM benchmark),
counted AS (SELECT item_id, term, count(*) AS times FROM asked GROUP BY item_id, term),
scores AS (
  SELECT item_id, doc_id, CAST(sum(times * w * ((1000000000 * tf) // (1000 * tf + 8 * (25 + (75 * n * n_docs) // n_words)))) AS BIGINT) AS score
  FROM counted JOIN tfs USING (term) JOIN weights USING (term) JOIN sizes USING (doc_id), total GROUP BY item_id, doc_id)
SELECT item_id, rank, doc_id, score FROM (SELECT *, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank FROM scores WHERE score > 0) WHERE rank <= 10
"""
