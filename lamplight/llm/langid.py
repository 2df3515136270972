"""Language identification with error-correcting output codes.

Each language has a codeword of bits; a binary classifier of character n-grams predicts
each bit, so that several must fail before a document lands at another language.  A
classifier is multinomial naive Bayes over hashed n-grams of one to three letters: its
weights follow from the n-gram counts of the languages on either side of its bit, which
Spark sums over all labelled documents with map-side combining.  No row is sampled, and
what reaches the driver is one count per language and hash slot.

Decoding is loss-weighted: a codeword's loss is the sum over bits of the logistic loss of
its predicted margin, weighted by how well the two sides of that bit can be told apart on
the labelled documents.  The nearest codeword wins; where the second is hardly farther the
document is flagged as ambiguous.

Cases: a null text or one without letters is `und`, score 0; without any labelled row all
are; ties go to the first language by code point; languages are the learned values only;
extra columns are kept, clashing ones replaced; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

SLOTS = 1 << 14
ORDERS = 3
#: Languages at most; more values than that are no language column.
MAX_LANGUAGES = 512


@lru_cache(maxsize=1)
def folded_letters() -> np.ndarray:
    """For each code point of the basic plane: its lower-case letter, or a space for anything but a letter."""
    table = np.full(1 << 16, 32, dtype=np.uint32)
    for i in range(1 << 16):
        c = chr(i)
        if c.isalpha():
            low = c.lower()
            table[i] = ord(low[0]) if len(low) else i
    return table


def letters(text: str) -> np.ndarray:
    """Code points of a text in lower case; runs of other characters become one space, also at both ends."""
    points = np.frombuffer(text.encode("utf-32-le", "replace"), dtype=np.uint32)
    table = folded_letters()
    low = table[np.minimum(points, 0xFFFF)]
    if len(points) and points.max() > 0xFFFF:
        for p in np.unique(points[points > 0xFFFF]):
            c = chr(int(p))
            low[points == p] = ord(c.lower()[0]) if c.isalpha() else 32
    low = np.concatenate([[np.uint32(32)], low, [np.uint32(32)]]).astype(np.uint32)
    return low[np.concatenate([[True], (low[1:] != 32) | (low[:-1] != 32)])]


def ngram_counts(text: str | None) -> np.ndarray | None:
    """Counts of the hashed n-grams of a whole text; None without letters."""
    if not text:
        return None
    points = letters(text)
    if len(points) < 3:
        return None
    out = np.zeros(SLOTS, dtype=np.int64)
    h = np.zeros(len(points), dtype=np.uint32)
    for n in range(ORDERS):
        h = (h[: len(points) - n] * np.uint32(0x01000193) ^ points[n:]) * np.uint32(0x9E3779B1)
        out += np.bincount(((h + np.uint32(n * 0x85EBCA6B & 0xFFFFFFFF)) >> np.uint32(18)).astype(np.int64), minlength=SLOTS)
    return out


def codewords(n: int) -> np.ndarray:
    """A codeword of +1 and -1 for each of n classes: all ways to part them where these are few, else those of a fixed pseudo-random code."""
    if n <= 2:
        return np.array([[1.0], [-1.0]])[: max(n, 1)]
    if n <= 5:
        columns = [[1.0 if k >> i & 1 else -1.0 for i in range(n - 1)] + [-1.0] for k in range(1, 1 << (n - 1))]
        return np.array(columns).T
    bits = int(np.ceil(10 * np.log2(n)))
    rng, best, apart = np.random.default_rng(n), None, -1.0
    for _ in range(50):
        code = rng.choice([-1.0, 1.0], size=(n, bits))
        near = (bits - (code @ code.T - np.eye(n) * 3 * bits).max()) / 2
        if near > apart and (abs(code.sum(axis=0)) < n).all():
            best, apart = code, near
    return best


class Model(NamedTuple):
    languages: list[str]
    code: np.ndarray  # language x bit
    weights: np.ndarray  # slot x bit, log ratios
    trust: np.ndarray  # of each bit


def fit(labelled: DataFrame, text_col: str = "text", lang_col: str = "lang") -> Model:
    """A model from all rows with a label."""
    schema = T.StructType([T.StructField("lang", T.StringType()), T.StructField("slot", T.IntegerType()), T.StructField("n", T.LongType())])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            for x, lang in zip(batch.column("_text"), batch.column("_lang"), strict=True):
                if (c := ngram_counts(x.as_py())) is not None:
                    sums[lang.as_py()] = sums.get(lang.as_py(), 0) + c
        for lang, total in sorted(sums.items()):
            slots = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(slots), pa.string()), pa.array(slots, pa.int32()), pa.array(total[slots], pa.int64())], names=schema.fieldNames())

    rows = labelled.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(text_col).alias("_text"), F.col(lang_col).alias("_lang"))
    summed = rows.mapInArrow(count, schema).groupBy("lang", "slot").agg(F.sum("n").alias("n"))
    # languages x slots numbers at most
    got = summed.toPandas()
    languages = sorted(got["lang"].unique())
    if len(languages) > MAX_LANGUAGES:
        raise ValueError(f"{len(languages)} languages; {MAX_LANGUAGES} at most")
    counts = np.zeros((len(languages), SLOTS))
    if languages:
        counts[[languages.index(x) for x in got["lang"]], got["slot"].to_numpy()] = got["n"].to_numpy()
    code = codewords(len(languages))
    share = (counts + 0.5) / (counts + 0.5).sum(axis=1, keepdims=True) if len(languages) else counts
    weights = np.zeros((SLOTS, code.shape[1]))
    trust = np.ones(code.shape[1])
    for b in range(code.shape[1] if len(languages) > 1 else 0):
        one, other = share[code[:, b] > 0].mean(axis=0), share[code[:, b] < 0].mean(axis=0)
        weights[:, b] = np.log(one) - np.log(other)
        # the margin by which the worst language lies on its side
        trust[b] = max(0.05, min(float(s * c) for s, c in zip(share @ weights[:, b], code[:, b], strict=True)))
    return Model(languages, code, weights.astype(np.float32), trust / trust.sum())


def decode(model: Model, counts: np.ndarray) -> tuple[str, float, bool]:
    """Language, score (0 to 1) and whether another is hardly farther."""
    total = counts.sum()
    margins = counts.astype(np.float32) @ model.weights / total * np.sqrt(min(total, 400.0))
    loss = (np.logaddexp(0.0, -model.code * margins) * model.trust).sum(axis=1)
    order = np.argsort(loss, kind="stable")
    odds = np.exp(-4 * (loss - loss[order[0]]))
    score = float(odds[order[0]] / odds.sum())
    return model.languages[order[0]], score, bool(len(order) > 1 and loss[order[1]] - loss[order[0]] < 0.02)


def predict(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """docs with lang_pred, score and ambiguous.  The model's size is fixed by slots and languages, so it is broadcast."""
    kept = docs.drop(*({"lang_pred", "score", "ambiguous"} - {text_col}))
    shared = docs.sparkSession.sparkContext.broadcast(model)
    schema = T.StructType([*kept.schema.fields, T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("ambiguous", T.BooleanType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for x in batch.column(text_col):
                c = ngram_counts(x.as_py()) if shared.value.languages else None
                found.append(("und", 0.0, False) if c is None else decode(shared.value, c))
            columns = [pa.array(v, t) for v, t in zip(zip(*found, strict=True) if found else ([], [], []), (pa.string(), pa.float64(), pa.bool_()), strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *columns], names=schema.fieldNames())

    return kept.mapInArrow(run, schema)


def held_out(id_col: str = "doc_id"):
    """Whether a document is kept from learning: crc32 of its id as text, modulo 3, is 1."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 3 == 1, F.lit(False))
