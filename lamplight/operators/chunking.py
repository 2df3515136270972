"""Chunkers: documents to rows of passages.

Fixed windows are plain expressions.  The others carry a cursor through a text, each cut
depending on the one before, so a helper gives the spans of one text in an Arrow-batched
UDF and Spark explodes them.
"""

from __future__ import annotations

import re
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

SPANS = T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())]))
PARAGRAPH_END = re.compile(r"\n{2,}")
SENTENCE_END = re.compile(r"[.!?。！？]\s+|\n")


def fixed_chunks(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 500, overlap: int = 50) -> DataFrame:
    """(id, chunk_index, chunk_id, text): windows of `size` characters every size - overlap; a short text is one, under its own id."""
    if size <= 0 or not 0 <= overlap < size:
        raise ValueError("overlap must lie between 0 and size")
    step = size - overlap
    n = F.length(text_col)
    last = F.when(n <= size, 0).otherwise(F.ceil((n - size) / step)).cast("int")
    rows = docs.withColumn("_i", F.explode(F.sequence(F.lit(0), last)))
    name = F.when(n <= size, F.col(id_col).cast("string")).otherwise(F.concat(F.col(id_col).cast("string"), F.lit("::chunk-"), F.col("_i").cast("string")))
    return rows.select(id_col, F.col("_i").alias("chunk_index"), name.alias("chunk_id"), F.substring(F.col(text_col), F.col("_i") * step + 1, F.lit(size)).alias("text"))


def _paragraphs(text: str) -> list[tuple[int, int]]:
    """Spans between empty lines, without the white space around them."""
    spans, at = [], 0
    for m in [*PARAGRAPH_END.finditer(text), None]:
        end = m.start() if m else len(text)
        part = text[at:end]
        if part.strip():
            spans.append((at + len(part) - len(part.lstrip()), at + len(part.rstrip())))
        at = m.end() if m else end
    return spans


def paragraph_spans(text: str, most: int, overlap: int) -> list[tuple[int, int]]:
    """Paragraphs, long ones cut at the last sentence end in the window's second half, each begun by the end of the one before."""
    bounded: list[tuple[int, int]] = []
    for at, end in _paragraphs(text):
        while end - at > most:
            ends = [m.end() for m in SENTENCE_END.finditer(text[at : at + most]) if m.end() >= most // 2]
            cut = at + (ends[-1] if ends else most)
            bounded.append((at, cut))
            at = cut
            while at < end and text[at].isspace():
                at += 1
        if at < end:
            bounded.append((at, end))
    out: list[tuple[int, int]] = []
    for i, (start, end) in enumerate(bounded):
        begin = start
        if overlap and i:
            begin = max(bounded[i - 1][0], start - overlap)
            while begin < start and begin > 0 and not text[begin - 1].isspace():
                begin += 1
        out.append((begin, end))
    return out


def sliding_spans(text: str, size: int, overlap: int) -> list[tuple[int, int]]:
    """Windows that end after the last sentence point of their second half, if it has one."""
    out, at = [], 0
    while at < len(text):
        end = min(len(text), at + size)
        if end < len(text):
            point = text.rfind(". ", at, end)
            if point > at + size // 2:
                end = point + 2
        out.append((at, end))
        if end >= len(text):
            break
        at = max(at + 1, end - overlap)
    return out


def _chunks(docs: DataFrame, spans: Callable[[str], list[tuple[int, int]]], id_col: str, text_col: str, name: str, strip: bool) -> DataFrame:
    @F.pandas_udf(SPANS)
    def found(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: [{"start": a, "end": b} for a, b in spans(t or "")])

    rows = docs.select(id_col, text_col, F.posexplode(found(text_col)).alias("chunk_index", "_s"))
    text = F.substring(F.col(text_col), F.col("_s.start") + 1, F.col("_s.end") - F.col("_s.start"))
    text = F.regexp_replace(text, r"(?U)^\s+|\s+$", "") if strip else text
    out = rows.select(id_col, "chunk_index", F.format_string(f"%s::{name}%04d", F.col(id_col).cast("string"), F.col("chunk_index")).alias("chunk_id"), F.col("_s.start").alias("start_char"), F.col("_s.end").alias("end_char"), text.alias("text"))
    return out.where(F.trim("text") != "")


def paragraph_chunks(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", most: int = 800, overlap: int = 80) -> DataFrame:
    """Chunks by paragraphs and sentences of at most `most` characters before the overlap."""
    if most <= 0 or not 0 <= overlap < most:
        raise ValueError("overlap must lie between 0 and most")
    return _chunks(docs, lambda t: paragraph_spans(t, most, overlap), id_col, text_col, "chunk-", False)


def sliding_chunks(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 950, overlap: int = 120) -> DataFrame:
    """Overlapping chunks that prefer to end at a sentence point."""
    return _chunks(docs, lambda t: sliding_spans(t, size, overlap), id_col, text_col, "chunk-", True)


def packed_paragraphs(paragraphs: Column, most: int = 900, least: int = 120) -> Column:
    """An array of passages: paragraphs packed in order up to `most` characters, long ones by sentence, a short tail joined to the passage before."""
    cut = F.flatten(
        F.transform(
            paragraphs,
            lambda p: F.when(F.length(p) <= most, F.array(p)).otherwise(F.filter(F.transform(F.split(p, r"(?<=[.!?。])\s+"), lambda s: F.trim(s)), lambda s: s != "")),
        )
    )
    empty = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("open"))

    def step(acc: Column, p: Column) -> Column:
        full = (acc["open"] != "") & (F.length(acc["open"]) + F.length(p) + 1 > most)
        joined = F.when(acc["open"] == "", p).otherwise(F.concat(acc["open"], F.lit("\n"), p))
        return F.struct(
            F.when(full, F.concat(acc["done"], F.array(acc["open"]))).otherwise(acc["done"]).alias("done"),
            F.when(full, p).otherwise(joined).alias("open"),
        )

    def finish(acc: Column) -> Column:
        n = F.size(acc["done"])
        tail = F.concat(F.slice(acc["done"], 1, n - 1), F.array(F.concat(F.element_at(acc["done"], -1), F.lit("\n"), acc["open"])))
        return F.when(acc["open"] == "", acc["done"]).when((n > 0) & (F.length(acc["open"]) < least), tail).otherwise(F.concat(acc["done"], F.array(acc["open"])))

    return F.aggregate(cut, empty, step, finish)
