"""Vectors as arrays of doubles: cosine, and an encoder by feature hashing."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lamplight.functions.text import tokenize


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    """0 where a norm is 0; an error where lengths differ."""
    same = F.when(F.size(a) != F.size(b), F.raise_error(F.lit("vectors of different dimensions")).cast("double"))
    length = norm(a) * norm(b)
    return F.coalesce(same, F.when(length == 0, 0.0).otherwise(dot(a, b) / length))


def with_hashed_features(df: DataFrame, text: Column, name: str) -> DataFrame:
    """df with an array of a text's features and the character trigrams of all of them joined.

    The joined characters are a column of their own, read by index: cutting substrings
    from a long text would walk through it anew for each trigram.
    """
    tokens, chars = f"_{name}_tokens", f"_{name}_chars"
    step = df.withColumn(tokens, tokenize(text)).withColumn(chars, F.filter(F.split(F.array_join(tokens, ""), ""), lambda c: c != ""))
    n = F.size(chars)
    at = lambda i: F.get(F.col(chars), i)
    grams = F.transform(F.sequence(F.lit(0), n - 3), lambda i: F.concat(at(i), at(i + 1), at(i + 2)))
    listed = F.concat(F.col(tokens), F.when(n >= 3, grams).otherwise(F.array().cast("array<string>")))
    return step.withColumn(name, listed).drop(tokens, chars)


def feature_slot(feature: Column, dimension: int) -> Column:
    """(slot, sign) of a feature by the first five bytes of its SHA-256."""
    digest = F.sha2(feature.cast("binary"), 256)
    slot = F.conv(F.substring(digest, 1, 8), 16, 10).cast("long") % dimension
    sign = F.when(F.conv(F.substring(digest, 9, 2), 16, 10).cast("int") % 2 == 1, 1.0).otherwise(-1.0)
    return F.struct(slot.alias("slot"), sign.alias("sign"))


def unit_rows(listed: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(which rows are vectors without nulls, a matrix of them scaled to norm 1); a norm of 0 stays 0."""
    listed = listed.cast(pa.list_(pa.float64()))
    sizes = pc.list_value_length(listed).fill_null(-1).to_numpy()
    flat = listed.flatten()
    row = np.repeat(np.arange(len(listed)), np.maximum(sizes, 0))
    has = sizes >= 0
    has[row[flat.is_null().to_numpy(zero_copy_only=False)]] = False
    dimensions = np.unique(sizes[sizes >= 0])
    if len(dimensions) > 1:
        raise ValueError("vectors of different dimensions")
    matrix = np.zeros((len(listed), int(dimensions[0]) if len(dimensions) else 0))
    matrix[sizes >= 0] = flat.fill_null(0.0).to_numpy(zero_copy_only=False).reshape(-1, matrix.shape[1]) if matrix.shape[1] else 0.0
    with np.errstate(invalid="ignore", divide="ignore"):
        norm = np.sqrt((matrix * matrix).sum(axis=1, keepdims=True))
        return has, np.where(norm == 0, 0.0, matrix / norm)


def _hashed(features: list[str], dimension: int) -> tuple[np.ndarray, np.ndarray]:
    """Slots and signs of features, as feature_slot has them."""
    digests = [hashlib.sha256(f.encode()).digest() for f in features]
    slot = np.array([int.from_bytes(d[:4], "big") % dimension for d in digests], dtype=np.int64)
    return slot, np.array([1.0 if d[4] % 2 == 1 else -1.0 for d in digests])


def hashed_counts(tokens: pa.Array, dimension: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, slot, weight) of the unit vectors of lists of tokens, by row and slot: their features are tokens and trigrams of all joined."""
    flat = tokens.flatten()
    row = np.repeat(np.arange(len(tokens)), pc.list_value_length(tokens).fill_null(0).to_numpy())
    words = flat.dictionary_encode()
    slot, sign = _hashed(words.dictionary.to_pylist(), dimension)
    number = words.indices.to_numpy()
    keys, signs = [row * dimension + slot[number]], [sign[number]]
    chars = np.frombuffer("".join(flat.to_pylist()).encode("utf-32-le"), np.uint32)
    of = np.repeat(row, pc.utf8_length(flat).to_numpy())
    if len(chars) >= 3:
        # Letters by number, so that a trigram is one number; where a table of all would be large, distinct ones are sorted.
        letters = np.flatnonzero(np.bincount(chars))
        by_letter = np.zeros(int(letters[-1]) + 1, np.int64)
        by_letter[letters] = np.arange(len(letters))
        short, a = by_letter[chars], len(letters)
        gram = (short[:-2] * a + short[1:-1]) * a + short[2:]
        inside = of[:-2] == of[2:]
        gram, of = gram[inside], of[:-2][inside]
        if a**3 <= 4_000_000:
            distinct = np.flatnonzero(np.bincount(gram, minlength=1))
            table = np.zeros(a**3, np.int64)
            table[distinct] = np.arange(len(distinct))
            number = table[gram]
        else:
            distinct, number = np.unique(gram, return_inverse=True)
        text = [chr(letters[g // a // a]) + chr(letters[g // a % a]) + chr(letters[g % a]) for g in distinct.tolist()]
        slot, sign = _hashed(text, dimension)
        keys.append(of * dimension + slot[number])
        signs.append(sign[number])
    key, sign = np.concatenate(keys), np.concatenate(signs)
    cells = len(tokens) * dimension
    sums, held = np.bincount(key, weights=sign, minlength=cells), np.flatnonzero(np.bincount(key, minlength=cells))
    norm = np.sqrt((sums.reshape(-1, dimension) ** 2).sum(axis=1))
    held = held[norm[held // dimension] > 0]
    return held // dimension, held % dimension, sums[held] / norm[held // dimension]
