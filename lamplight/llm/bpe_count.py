"""Token counts without ids: heap-and-linked-list byte-pair merging.

Symbols of a word form a linked list.  A heap holds adjacent pairs by merge rank and
position; the lowest is popped again and again, stale entries are skipped, and each
merge pushes at most two new pairs.  The count is the initial symbols minus the merges.
Counts of distinct words are kept per task in a bounded table.

Cases: null and empty texts have 0 bytes and 0 tokens; equal rows have equal counts;
an empty table gives an empty result; a clashing column is replaced by the result.
"""

from __future__ import annotations

import heapq
import json
import re
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lamplight.llm.token_units import BYTE_UNIT, Recent, byte_symbols, vocabulary

#: Fixed value: the pattern that cuts text into words before the byte-level merges.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


class PairMerges:
    """Merge ranks of a byte-level vocabulary file; symbols are small numbers."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.specials = [t["content"] for t in spec["added_tokens"]]
        number = dict(byte_symbols())
        self.merges: dict[tuple[int, int], tuple[int, int]] = {}
        for rank, pair in enumerate(spec["model"]["merges"]):
            left, right = pair.split(" ") if isinstance(pair, str) else pair
            made = number.setdefault(left + right, len(number))
            self.merges.setdefault((number[left], number[right]), (rank, made))

    def count(self, word: bytes) -> int:
        """Symbols of word minus merges."""
        n = len(word)
        if n < 2:
            return n
        merges, symbol = self.merges, list(word)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(m[0], i, m[1], symbol[i], symbol[i + 1]) for i in range(n - 1) if (m := merges.get((symbol[i], symbol[i + 1])))]
        heapq.heapify(heap)
        merged = 0
        while heap:
            _, i, made, left, right = heapq.heappop(heap)
            j = after[i] if symbol[i] == left else n
            if j >= n or symbol[j] != right:
                continue  # one of the two has merged with another meanwhile
            merged += 1
            symbol[i], symbol[j] = made, -1
            after[i] = k = after[j]
            if k < n:
                before[k] = i
                if m := merges.get((made, symbol[k])):
                    heapq.heappush(heap, (m[0], i, m[1], made, symbol[k]))
            if (h := before[i]) >= 0 and (m := merges.get((symbol[h], made))):
                heapq.heappush(heap, (m[0], h, m[1], symbol[h], made))
        return n - merged


class UnitCounts(Recent):
    """unit -> token count."""

    def __init__(self, path: str, most: int = 400_000):
        import regex

        super().__init__(most)
        self.pairs, self.words = PairMerges(path), regex.compile(PATTERN)
        # These four are no white space to the vocabulary's pattern.
        self.odd = re.compile("[\x1c-\x1f]")
        self.odd_words = regex.compile(PATTERN.replace(r"[^\s\p{L}\p{N}]", r"(?:[^\s\p{L}\p{N}]|[\x1c-\x1f])").replace(r"\S", r"[\S\x1c-\x1f]").replace(r"\s+", r"[^\S\x1c-\x1f]+"))
        self.special = re.compile("|".join(map(re.escape, self.pairs.specials))) if self.pairs.specials else None

    def compute(self, unit: str) -> int:
        return sum(self.pairs.count(w.encode("utf-8", "replace")) for w in self.words.findall(unit))

    def of(self, text: str) -> int:
        """Tokens of a whole text; a special string inside it is one token, as the library has it."""
        n, parts = 0, [text]
        if self.special and "<|" in text:
            parts = self.special.split(text)
            n = len(parts) - 1
        for part in parts:
            if self.odd.search(part):
                n += sum(self.pairs.count(w.encode("utf-8", "replace")) for w in self.odd_words.findall(part))
            else:
                n += sum(map(self.__getitem__, BYTE_UNIT.findall(part)))
        return n


@lru_cache(maxsize=1)
def unit_counts(path: str) -> UnitCounts:
    """One table of counts for each worker process, which serves many tasks."""
    return UnitCounts(path)


def token_counts(docs: DataFrame, text_col: str = "text", limit: int = 512, vocab: str = "byte_bpe_50k.json", vocab_dir: str | None = None) -> DataFrame:
    """docs with n_bytes (UTF-8), n_tokens and over_limit (n_tokens > limit); texts stay whole."""
    results = {"n_bytes": T.LongType(), "n_tokens": T.LongType(), "over_limit": T.BooleanType()}
    kept = docs.drop(*results)
    others = [c for c in kept.columns if c != text_col]
    schema = T.StructType([kept.schema[c] for c in others] + [T.StructField(k, t) for k, t in results.items()])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = unit_counts(vocabulary(vocab, vocab_dir))
        for batch in batches:
            n_tokens = pa.array([counts.of(x.as_py() or "") for x in batch.column(text_col)], pa.int64())
            n_bytes = pa.array([len((x.as_py() or "").encode()) for x in batch.column(text_col)], pa.int64())
            over = pa.array([x.as_py() > limit for x in n_tokens], pa.bool_())
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in others), n_bytes, n_tokens, over], names=schema.fieldNames())

    return kept.select(*others, F.col(text_col)).mapInArrow(count, schema)
