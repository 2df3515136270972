"""Line dedup with two Bloom filters: hashes seen once and hashes seen twice.

Every task notes the hashes of its documents' line keys in a filter of those seen, and in
a second one those seen again in another document.  Merging filters over tasks is a union
of each, and bits that both tasks have seen once join the second: a key of two documents
is always in the merged second filter.  Filters travel as slices, so that no task merges
more than one slice.  Their size follows the counted lines up to a bound (64 MB), so the
second one can be broadcast.

Only lines found in it, the suspected repeats, are shuffled; grouping them by their whole
key confirms repeats exactly and finds each key's first document.  Documents without a
suspected line pass through where they are; only the others meet their drops.  When the
data outgrow the filters they only suspect more lines; the result stays exact.

Cases: a null or empty text is one empty line; very long texts are read whole; keys shorter than min_chars are never
dropped; a key repeated only within one document stays; rows of one id are one document,
and each gets its own result; extra columns are kept, clashing ones replaced; an empty
table gives an empty result; rows without an id are kept as they are.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lamplight.llm.common import written

#: Bits of a filter for each line, and the least and the most of them: 64 MB for the one that is broadcast.
BITS_A_LINE, LEAST_BITS, MOST_BITS = 8, 1 << 20, 1 << 29
SLICES = 256
LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))
BLANK = b" \t\n\x0b\x0c\r"


def line_keys(text: str | None) -> list[bytes]:
    """Keys of all lines: stripped of ASCII white space, A to Z in lower case."""
    return [line.strip(BLANK) for line in (text or "").encode().translate(LOWER).split(b"\n")]


def long_enough(key: bytes, least: int) -> bool:
    """Whether a key has at least so many code points."""
    return len(key) >= least and (len(key) >= 4 * least or len(key.decode()) >= least)


def key_hashes(keys: list[bytes]) -> np.ndarray:
    import xxhash

    return np.array([xxhash.xxh64_intdigest(k) for k in keys], dtype=np.uint64)


def filter_places(hashes: np.ndarray, bits: int) -> np.ndarray:
    """Two places in the filter for each hash, a row per hash."""
    return np.stack([hashes % np.uint64(bits), (hashes >> np.uint64(20)) * np.uint64(0x9E3779B97F4A7C15) % np.uint64(bits)], axis=1).astype(np.int64)


def has_bits(filter_: np.ndarray, places: np.ndarray) -> np.ndarray:
    return (filter_[places >> 3] >> (places & 7).astype(np.uint8) & 1).astype(bool)


def set_bits(filter_: np.ndarray, places: np.ndarray) -> None:
    np.bitwise_or.at(filter_, places >> 3, (1 << (places & 7)).astype(np.uint8))


def filter_bits(docs: DataFrame, text_col: str) -> int:
    """The power of two that gives each line of docs its bits, within the bounds."""
    lines = F.length(text_col) - F.length(F.replace(text_col, F.lit("\n"), F.lit(""))) + 1
    wanted = BITS_A_LINE * (docs.agg(F.sum(lines)).first()[0] or 1)
    return min(max(1 << int(wanted - 1).bit_length(), LEAST_BITS), MOST_BITS)


def repeat_filter(docs: DataFrame, text_col: str, min_chars: int, bits: int) -> np.ndarray:
    """The merged filter of hashes seen twice; bits / 8 bytes."""
    spark = docs.sparkSession
    step = bits // 8 // SLICES
    schema = T.StructType([T.StructField("slice", T.IntegerType()), T.StructField("once", T.BinaryType()), T.StructField("twice", T.BinaryType())])

    def note(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        once, twice = np.zeros(bits // 8, dtype=np.uint8), np.zeros(bits // 8, dtype=np.uint8)
        for batch in batches:
            of_docs = []
            for x in batch.column(text_col):
                keys = {k for k in line_keys(x.as_py()) if long_enough(k, min_chars)}
                if keys:
                    of_docs.append(key_hashes(list(keys)))
            if not of_docs:
                continue
            # Each document's keys are distinct, so a hash that occurs again belongs to another document.
            hashes, n = np.unique(np.concatenate(of_docs), return_counts=True)
            places = filter_places(hashes, bits)
            again = (n > 1) | (has_bits(once, places).all(axis=1))
            set_bits(twice, places[again].ravel())
            set_bits(once, places.ravel())
        rows = []
        for s in range(SLICES):
            part = slice(s * step, (s + 1) * step)
            if once[part].any():
                rows.append((s, zlib.compress(once[part].tobytes(), 1), zlib.compress(twice[part].tobytes(), 1)))
        yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.binary()), pa.array([r[2] for r in rows], pa.binary())], names=schema.fieldNames())

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, once, twice = None, np.zeros(0), np.zeros(0)

        def row() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([at], pa.int32()), pa.array([b""], pa.binary()), pa.array([zlib.compress(twice.tobytes(), 1)], pa.binary())], names=schema.fieldNames())

        for batch in batches:
            for s, a, b in zip(*(batch.column(c) for c in schema.fieldNames()), strict=True):
                a, b = (np.frombuffer(zlib.decompress(x.as_py()), dtype=np.uint8) for x in (a, b))
                if s.as_py() != at:
                    if at is not None:
                        yield row()
                    at, once, twice = s.as_py(), np.zeros(step, dtype=np.uint8), np.zeros(step, dtype=np.uint8)
                twice |= b | once & a
                once |= a
        if at is not None:
            yield row()

    noted = docs.select(text_col).mapInArrow(note, schema)
    merged = noted.repartition("slice").sortWithinPartitions("slice").mapInArrow(merge, schema)
    out = np.zeros(bits // 8, dtype=np.uint8)
    for r in merged.select("slice", "twice").toLocalIterator():  # SLICES rows at most
        out[r["slice"] * step : (r["slice"] + 1) * step] = np.frombuffer(zlib.decompress(r["twice"]), dtype=np.uint8)
    return out


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 10, bits: int | None = None) -> DataFrame:
    """docs whose text has lost repeated lines, with n_lines (before) and n_dropped."""
    spark, bits = docs.sparkSession, bits or filter_bits(docs, text_col)
    kept = docs.drop(*({"n_lines", "n_dropped"} - {id_col, text_col}))
    twice = spark.sparkContext.broadcast(repeat_filter(kept.where(F.col(id_col).isNotNull()), text_col, min_chars, bits))
    suspect_schema = T.StructType([kept.schema[id_col], T.StructField("_key", T.BinaryType())])

    def suspected(text: str | None) -> list[bytes]:
        """Keys of a text that the filter holds."""
        own = list({k for k in line_keys(text) if long_enough(k, min_chars)})
        if not own:
            return own
        hit = has_bits(twice.value, filter_places(key_hashes(own), bits)).all(axis=1)
        return [k for k, h in zip(own, hit.tolist(), strict=True) if h]

    def suspect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, keys = [], []
            for i, x in zip(batch.column(id_col), batch.column(text_col), strict=True):
                found = suspected(x.as_py())
                ids += [i.as_py()] * len(found)
                keys += found
            yield pa.RecordBatch.from_arrays([pa.array(ids, batch.schema.field(id_col).type), pa.array(keys, pa.binary())], names=suspect_schema.fieldNames())

    suspects = written(kept.where(F.col(id_col).isNotNull()).select(id_col, text_col).mapInArrow(suspect, suspect_schema), "line-suspects")
    # Minimum and maximum combine on the map side, so a line in a third of all documents is one row per task.
    repeats = suspects.groupBy("_key").agg(F.min(id_col).alias("_first"), F.max(id_col).alias("_last")).where(F.col("_first") < F.col("_last"))
    # Written, so that the join below deals both sides anew and Spark can split a line that many documents share.
    repeats = written(repeats, "line-repeats")
    dropped = suspects.join(repeats.select("_key", "_first"), "_key").where(F.col(id_col) > F.col("_first"))
    drops = dropped.groupBy(id_col).agg(F.collect_set("_key").alias("_drop"))
    names = kept.columns
    schema = T.StructType([*kept.schema.fields, T.StructField("n_lines", T.LongType()), T.StructField("n_dropped", T.LongType())])

    def drop(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, counts, gone = [], [], []
            for x, d in zip(batch.column(text_col), batch.column("_drop"), strict=True):
                text, out = x.as_py(), set(d.as_py() or ())
                lines = (text or "").split("\n")
                left = [line for line, k in zip(lines, line_keys(text), strict=True) if k not in out] if out else lines
                texts.append("\n".join(left) if out else text)
                counts.append(len(lines))
                gone.append(len(lines) - len(left))
            columns = [pa.array(texts, batch.schema.field(text_col).type) if c == text_col else batch.column(c) for c in names]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(counts, pa.int64()), pa.array(gone, pa.int64())], names=schema.fieldNames())

    def is_suspect(batch: pa.RecordBatch) -> np.ndarray:
        return np.array([i.is_valid and bool(suspected(x.as_py())) for i, x in zip(batch.column(id_col), batch.column(text_col), strict=True)], dtype=bool)

    def untouched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            left = batch.filter(pa.array(~is_suspect(batch)))
            counts = [(x.as_py() or "").count("\n") + 1 for x in left.column(text_col)]
            yield pa.RecordBatch.from_arrays([*left.columns, pa.array(counts, pa.int64()), pa.array(np.zeros(len(counts), dtype=np.int64))], names=schema.fieldNames())

    def touched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(is_suspect(batch)))

    both = kept.mapInArrow(touched, kept.schema).join(drops, id_col, "left").select(*names, "_drop")
    return kept.mapInArrow(untouched, schema).unionByName(both.mapInArrow(drop, schema))


#: DuckDB SQL for the result of op10.
ORACLE = r"""
WITH d AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
l AS (SELECT doc_id, unnest(lines) AS line, generate_subscripts(lines, 1) AS n FROM d),
k AS (SELECT *, translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
r AS (SELECT key, min(doc_id) AS first FROM k WHERE length(key) >= 10 GROUP BY key HAVING count(DISTINCT doc_id) > 1),
s AS (SELECT k.doc_id, k.n, k.line, coalesce(r.first < k.doc_id, false) AS gone FROM k LEFT JOIN r ON k.key = r.key)
SELECT doc_id, count(*)::BIGINT AS n_lines, (count(*) FILTER (gone))::BIGINT AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY n) FILTER (NOT gone), '')) AS kept_sha256
FROM s GROUP BY doc_id
"""
