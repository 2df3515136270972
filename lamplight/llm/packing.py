"""Best-fit packing of token sequences by exact-complement hashing.

How pieces are combined depends only on how many there are of each length, so the plan
is made on that histogram, which has at most `capacity` entries however many pieces
there are.  Sums of one, two and three of the lengths present are indexed by hashing.
The largest piece left opens a sequence; if its gap is in the index, a combination that
fills it exactly is taken, else the largest piece that fits goes in and the new gap is
looked up in turn.  A pattern is repeated as often as the counts allow.  Pairs and triples
are only made of lengths of which at least two pieces are left: a length's last piece is
kept as a single complement or best fit, without which small tables need more sequences.

Spark does the rest: pieces are numbered within their length by (task, place in task)
plus prefix sums over the small table of counts by task and length, and a piece's number
falls into one slot of the plan, which names its sequence and offset.  No window orders
all pieces of a length.  Texts are never shuffled.

Cases: a null text is an empty one; an empty one is the end id alone; a very long one is
cut like any other and held once; equal rows are packed separately; an empty table gives an empty result; only texts of more than
`capacity` ids are cut, from their end, so that the first piece may be shorter; ties (equal
lengths) are dealt by task and place; extra columns, clashing ones among them, are left out.
"""

from __future__ import annotations

import zlib
from collections import defaultdict
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lamplight.llm.common import written
from lamplight.llm.token_units import byte_level_ids, unit_ids, vocabulary

Pattern = tuple[tuple[int, ...], int]
#: Pieces of a length that must be left for it to be used in pairs and triples.
SPARE = 2
#: Texts that a task encodes at a time.
ROWS = 1024


class ComplementIndex:
    """Sums of one, two and three of the lengths present, hashed by sum.

    A triple is kept as one length and the sum of a pair, whose pairs the index of pairs
    holds: at most capacity squared entries in all.  Counts change while pieces are used
    up, so an entry is only a candidate; the counts decide when it is looked up.
    """

    def __init__(self, left: np.ndarray, capacity: int):
        self.left = left
        lengths = np.flatnonzero(left[:capacity])
        large, small = (x.ravel() for x in np.meshgrid(lengths, lengths, indexing="ij"))
        fits = (large >= small) & (large + small <= capacity)
        self.pairs = by_sum(large[fits], small[fits])
        first, two = (x.ravel() for x in np.meshgrid(lengths, np.array(sorted(self.pairs), dtype=np.int64), indexing="ij"))
        fits = first + two <= capacity
        self.triples = by_sum(first[fits], two[fits])

    def single(self, gap: int) -> tuple[int, ...] | None:
        return (gap,) if self.left[gap] > 0 else None

    def pair(self, gap: int) -> tuple[int, ...] | None:
        """The pair of which there are most."""
        if gap not in self.pairs:
            return None
        large, small = self.pairs[gap]
        have = np.minimum(self.left[large], self.left[small])
        have[large == small] //= 2
        have[(self.left[large] < SPARE) | (self.left[small] < SPARE)] = 0
        best = int(have.argmax())
        return (int(large[best]), int(small[best])) if have[best] > 0 else None

    def triple(self, gap: int) -> tuple[int, ...] | None:
        """The triple with the largest piece that counts allow."""
        if gap not in self.triples:
            return None
        first, two = self.triples[gap]
        for x, rest in zip(first.tolist(), two.tolist(), strict=True):
            if self.left[x] >= SPARE:
                self.left[x] -= 1
                found = self.pair(rest)
                self.left[x] += 1
                if found:
                    return (x, *found)
        return None

    def exact(self, gap: int) -> tuple[int, ...] | None:
        return self.single(gap) or self.pair(gap) or self.triple(gap)


def by_sum(large: np.ndarray, other: np.ndarray) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """sum -> the two columns of terms that have it, larger first terms first."""
    order = np.lexsort((-large, large + other))
    large, other = large[order], other[order]
    sums, starts = np.unique(large + other, return_index=True)
    if not len(sums):
        return {}
    ends = [*starts[1:].tolist(), len(large)]
    return {int(s): (large[a:b], other[a:b]) for s, a, b in zip(sums, starts.tolist(), ends, strict=True)}


def times(parts: tuple[int, ...], left: np.ndarray) -> int:
    """How often parts can be taken together."""
    need: dict[int, int] = defaultdict(int)
    for x in parts:
        need[x] += 1
    return min(int(left[x]) // n for x, n in need.items())


class Plan(NamedTuple):
    """Patterns, and how many pieces came into their sequence by an exact fill."""

    patterns: list[Pattern]
    exact: int

    def sequences(self) -> int:
        return sum(n for _, n in self.patterns)


def packing_plan(counts: dict[int, int], capacity: int) -> Plan:
    """Patterns (lengths of a sequence, how many such sequences) that use every piece once.

    Each step uses up all but a few pieces of some length, so the plan's size depends on
    capacity alone.
    """
    left = np.zeros(capacity + 1, dtype=np.int64)
    for length, n in counts.items():
        left[length] = n
    index, plan, exact = ComplementIndex(left, capacity), [], 0
    for length in range(capacity, 0, -1):
        while left[length] > 0:
            parts, gap, filled = [length], capacity - length, 0
            left[length] -= 1
            while gap > 0:
                found = index.exact(gap)
                if found:
                    filled = len(found)
                elif len(fit := np.flatnonzero(left[:gap])):
                    found = (int(fit[-1]),)
                else:
                    break
                for x in found:
                    left[x] -= 1
                    gap -= x
                parts += found
            for x in parts:
                left[x] += 1
            n = times(tuple(parts), left)
            for x in parts:
                left[x] -= n
            plan.append((tuple(parts), n))
            exact += filled * n
    return Plan(plan, exact)


def plan_slots(plan: list[Pattern]) -> dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """length -> (first piece number, first sequence, offset) of each slot that takes this length, by piece number."""
    used: dict[int, int] = defaultdict(int)
    slots: dict[int, list[tuple[int, int, int]]] = defaultdict(list)
    sequence = 0
    for parts, n in plan:
        offset = 0
        for x in parts:
            slots[x].append((used[x], sequence, offset))
            used[x] += n
            offset += x
        sequence += n
    return {x: tuple(np.array(c, dtype=np.int64) for c in zip(*rows, strict=True)) for x, rows in slots.items()}


PIECES = T.StructType(
    [
        T.StructField("piece", T.IntegerType()),
        T.StructField("start", T.LongType()),
        T.StructField("length", T.LongType()),
        T.StructField("ids_crc32", T.LongType()),
        T.StructField("_task", T.IntegerType()),
        T.StructField("_nth", T.LongType()),
    ]
)


def cut_lengths(n: int, capacity: int) -> list[int]:
    """Lengths of a text's pieces: full ones from its end, the first may be shorter."""
    head = n % capacity
    return ([head] if head else []) + [capacity] * (n // capacity)


def pieces(docs: DataFrame, id_col: str, text_col: str, capacity: int, end_id: int, vocab: str, vocab_dir: str | None, keep_ids: bool) -> DataFrame:
    """A row per piece, numbered within its length and task."""
    schema = T.StructType([docs.schema[id_col], *PIECES.fields, *([T.StructField("ids", T.ArrayType(T.IntegerType()))] if keep_ids else [])])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo, task, seen = unit_ids(vocabulary(vocab, vocab_dir), "<u4"), TaskContext.get().partitionId(), np.zeros(capacity + 1, dtype=np.int64)
        end = np.array([end_id], dtype="<u4").tobytes()
        columns = ("piece", "start", "length", "ids_crc32", "_task", "_nth")
        types = (pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64())
        for whole in batches:
            for at in range(0, whole.num_rows, ROWS):
                batch = whole.slice(at, ROWS)
                keys, rows, parts = [], [], []
                for key, text in zip(batch.column(id_col), batch.column(text_col), strict=True):
                    data, start = byte_level_ids(memo, text.as_py() or "") + end, 0
                    for i, n in enumerate(cut_lengths(len(data) // 4, capacity)):
                        part = data[4 * start : 4 * (start + n)]
                        keys.append(key)
                        rows.append((i, start, n, zlib.crc32(part), task, int(seen[n])))
                        if keep_ids:
                            parts.append(part)
                        seen[n] += 1
                        start += n
                made = [pa.array([k.as_py() for k in keys], batch.schema.field(id_col).type)]
                made += [pa.array([r[k] for r in rows], t) for k, t in enumerate(types)]
                if keep_ids:
                    # ids stay in one buffer; as Python lists they would take ten times the memory
                    ends = np.concatenate([[0], np.cumsum([len(x) // 4 for x in parts])]).astype(np.int32)
                    made.append(pa.ListArray.from_arrays(pa.array(ends), pa.array(np.frombuffer(b"".join(parts), dtype="<i4"))))
                yield pa.RecordBatch.from_arrays(made, names=[id_col, *columns, *(["ids"] if keep_ids else [])])

    return docs.select(id_col, text_col).mapInArrow(cut, schema)


def pack(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    capacity: int = 1024,
    end_id: int = 2,
    vocab: str = "byte_bpe_50k.json",
    vocab_dir: str | None = None,
    keep_ids: bool = False,
) -> DataFrame:
    """A row per piece: id, piece, start, length, ids_crc32, sequence_id, offset, and ids if kept."""
    cut = written(pieces(docs, id_col, text_col, capacity, end_id, vocab, vocab_dir, keep_ids), "pack-pieces")
    by_task = cut.groupBy("length", "_task").agg(F.count("*").alias("_n"))
    by_task = written(by_task, "pack-counts")
    # At most `capacity` rows reach the driver.
    counts = {r["length"]: r["n"] for r in by_task.groupBy("length").agg(F.sum("_n").alias("n")).collect()}
    slots = docs.sparkSession.sparkContext.broadcast(plan_slots(packing_plan(counts, capacity).patterns))
    earlier = Window.partitionBy("length").orderBy("_task").rowsBetween(Window.unboundedPreceding, -1)
    first = by_task.withColumn("_first", F.coalesce(F.sum("_n").over(earlier), F.lit(0))).drop("_n")
    numbered = cut.join(first, ["length", "_task"]).withColumn("_number", F.col("_first") + F.col("_nth")).drop("_first", "_nth", "_task")
    order = [id_col, "piece", "start", "length", "ids_crc32", *(["ids"] if keep_ids else [])]
    schema = T.StructType([*(cut.schema[c] for c in order), T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())])

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, number = batch.column("length").to_numpy(), batch.column("_number").to_numpy()
            sequence, offset = np.zeros(len(length), dtype=np.int64), np.zeros(len(length), dtype=np.int64)
            for x in np.unique(length):
                at = length == x
                firsts, sequences, offsets = slots.value[int(x)]
                slot = np.searchsorted(firsts, number[at], side="right") - 1
                sequence[at], offset[at] = sequences[slot] + number[at] - firsts[slot], offsets[slot]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in order), pa.array(sequence), pa.array(offset)], names=schema.fieldNames())

    return numbered.select(*order, "_number").mapInArrow(place, schema)
