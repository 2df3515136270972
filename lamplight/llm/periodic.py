"""Runs: maximal periodic stretches of words, by Stoye and Gusfield's suffix tree method.

A run of period q is a stretch in which words q apart are identical, q is the least such
number, and no neighbouring word extends it.  Wherever a run of period q and at least two
turns ends, a tandem repeat of two times q words ends that can't be rotated to the right,
a branching one.  These are found in the suffix tree: below a node of depth q, a leaf i
and a leaf i + q in different children.  Only the leaf lists of the smaller children are
walked, so a text of n words costs n log n steps at most.  A branching repeat is then
rotated to the left as far as it goes, and the rotations merge into one run.

Most words of most texts are in no run.  A stretch of at least 24 words and three turns
consists of eight-word sequences that occur in it at least twice; trees are built of the
stretches that consist of such sequences only, which is exact: no run is outside of them.

Cases: null is an empty text, which has no runs and no words; a text of any length is
worked on whole, with about 150 bytes for each word of a stretch; equal texts have equal
results, repeated rows each have theirs; ties are none, as runs of equal start and end
are one, of their least period; an empty table gives an empty result; extra columns are
kept, but those named like the result are replaced.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Least words of a run, and least turns.
LEAST, TURNS = 24, 3
GRAM = 8
#: Leaves that are looked at together.
TOGETHER = 1 << 20
MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)


def repeated_stretches(ids: np.ndarray, least: int = LEAST) -> list[tuple[int, int]]:
    """(begin, end) of the stretches that consist of eight-word sequences occurring in them more than once."""
    found, todo = [], [(0, len(ids))]
    while todo:
        begin, end = todo.pop()
        n = end - begin - GRAM + 1
        if end - begin < least:
            continue
        part = ids[begin:end].astype(np.uint64) + np.uint64(1)
        grams = np.zeros(n, dtype=np.uint64)
        for j in range(GRAM):
            grams = grams * MULTIPLIER + part[j : j + n]
        ordered = np.sort(grams)
        twice = ordered[1:][ordered[1:] == ordered[:-1]]
        if not len(twice):
            continue
        place = np.minimum(np.searchsorted(twice, grams), len(twice) - 1)
        marked = np.concatenate(([0], (twice[place] == grams).astype(np.int8), [0]))
        steps = np.diff(marked)
        parts = [(begin + b, begin + e + GRAM - 1) for b, e in zip(np.flatnonzero(steps == 1).tolist(), np.flatnonzero(steps == -1).tolist(), strict=True) if e - b + GRAM - 1 >= least]
        if parts == [(begin, end)]:
            found.append((begin, end))
        else:
            todo += parts
    return sorted(found)


class SuffixTree:
    """The inner nodes of the suffix tree of a sequence, as intervals of the leaves in order.

    Node k has depth[k] and the leaves left[k] to right[k]; small lists, for each child but
    the largest of its node, (node, first leaf, last leaf).
    """

    def __init__(self, ids: np.ndarray):
        self.ids = ids
        self.leaves, self.rank = self._ordered(ids)
        self._nodes(self._common())

    @staticmethod
    def _ordered(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The suffixes in order, and each one's place: ranks by one symbol, two, four and so on."""
        n, width = len(ids), 1
        rank = np.unique(ids, return_inverse=True)[1].astype(np.int64)
        while True:
            then = np.zeros(n, dtype=np.int64)
            then[: max(0, n - width)] = rank[width:] + 1
            key = rank * (n + 1) + then
            order = np.argsort(key, kind="stable")
            ranked = np.concatenate(([0], np.cumsum(np.diff(key[order]) != 0)))
            rank = np.empty(n, dtype=np.int64)
            rank[order] = ranked
            if ranked[-1] == n - 1:
                return order, rank
            width *= 2

    def _common(self) -> list[int]:
        """Length of the common prefix of each leaf and the one before it (the first: 0)."""
        s, order, rank = self.ids.tolist(), self.leaves.tolist(), self.rank.tolist()
        n, h, common = len(s), 0, [0] * len(s)
        for i in range(n):
            r = rank[i]
            if not r:
                h = 0
                continue
            j = order[r - 1]
            end = n - max(i, j)
            while h < end and s[i + h] == s[j + h]:
                h += 1
            common[r] = h
            if h:
                h -= 1
        return common

    def _nodes(self, common: list[int]) -> None:
        depth, left, right, small = [], [], [], []
        # An open node: depth, first leaf, its children's first leaves.
        opened: list[tuple[int, int, list[int]]] = [(0, 0, [0])]
        for i in range(1, len(common) + 1):
            d = common[i] if i < len(common) else 0
            first = i - 1
            while opened[-1][0] > d:
                at, first, starts = opened.pop()
                k = len(depth)
                depth.append(at)
                left.append(first)
                right.append(i - 1)
                ends = [*(x - 1 for x in starts[1:]), i - 1]
                largest = max(range(len(starts)), key=lambda c: ends[c] - starts[c])
                small += [(k, starts[c], ends[c]) for c in range(len(starts)) if c != largest]
            if opened[-1][0] < d:
                opened.append((d, first, [first, i]))
            else:
                opened[-1][2].append(i)
        self.depth, self.left, self.right = (np.array(x, dtype=np.int64) for x in (depth, left, right))
        self.small = np.array(small, dtype=np.int64).reshape(-1, 3)

    def branching_repeats(self) -> list[tuple[int, int]]:
        """(start, period) of the tandem repeats of two turns that can't be rotated to the right."""
        n, found = len(self.ids), []
        padded = np.concatenate((self.ids, np.array([-1], dtype=self.ids.dtype)))
        sizes = self.small[:, 2] - self.small[:, 1] + 1
        cuts = np.searchsorted(np.cumsum(sizes), np.arange(TOGETHER, sizes.sum() + TOGETHER, TOGETHER)) if len(sizes) else []
        before = 0
        for cut in (min(len(sizes), c + 1) for c in cuts):
            node, first, _ = self.small[before:cut].T
            some, before = sizes[before:cut], cut
            row = np.repeat(np.arange(len(some)), some)
            inside = np.arange(len(row)) - np.repeat(np.cumsum(some) - some, some)
            leaf, node = self.leaves[first[row] + inside], node[row]
            q, lo, hi = self.depth[node], self.left[node], self.right[node]
            for start in (leaf, leaf - q):
                other = np.where(start == leaf, leaf + q, start)
                ok = (start >= 0) & (start + 2 * q <= n)
                at = self.rank[np.clip(other, 0, n - 1)]
                ok &= (at >= lo) & (at <= hi)
                ok &= padded[np.clip(start + q, 0, n)] != padded[np.clip(start + 2 * q, 0, n)]
                found += zip(start[ok].tolist(), q[ok].tolist(), strict=True)
        return sorted(set(found))


def rotated(ids: np.ndarray, start: int, period: int) -> int:
    """Where the rotations to the left of the repeat at start begin."""
    step = 64
    while start:
        low = max(0, start - step)
        differ = np.flatnonzero(ids[low:start] != ids[low + period : start + period])
        if len(differ):
            return low + int(differ[-1]) + 1
        start, step = low, step * 2
    return 0


def runs_of(ids: np.ndarray, least: int = LEAST, turns: int = TURNS) -> list[tuple[int, int, int]]:
    """(start, length, period) of the runs of a sequence, by start and then period."""
    if min(least, turns * GRAM) < 3 * GRAM:
        raise ValueError(f"runs of less than {3 * GRAM} words or three turns may be without repeated sequences of {GRAM}")
    found = []
    for begin, end in repeated_stretches(ids, least):
        part, periods = ids[begin:end], {}
        for start, q in SuffixTree(part).branching_repeats():
            stretch = (rotated(part, start, q), start + 2 * q)
            periods[stretch] = min(q, periods.get(stretch, q))
        found += [(begin + s, e - s, q) for (s, e), q in periods.items() if e - s >= max(least, turns * q)]
    return sorted(found, key=lambda r: (r[0], r[2]))


class Numbers(dict):
    """Numbers words in the order they come."""

    def __missing__(self, word: bytes) -> int:
        self[word] = n = len(self)
        return n


def found_in(text: bytes | None) -> tuple[list[tuple[int, int, int]], bytes]:
    """The runs of a text, and the text without the turns after each run's first, words joined by one space."""
    words = (text or b"").split()
    if len(words) < LEAST:
        return [], b" ".join(words)
    runs = runs_of(np.fromiter(map(Numbers().__getitem__, words), dtype=np.int64, count=len(words)))
    if runs:
        kept = np.ones(len(words), dtype=bool)
        for start, length, q in runs:
            kept[start + q : start + length] = False
        words = [words[i] for i in np.flatnonzero(kept).tolist()]
    return runs, b" ".join(words)


RESULT = T.StructType([T.StructField("runs", T.ArrayType(T.StructType([T.StructField(x, T.LongType()) for x in ("start", "length", "period")]))), T.StructField("collapsed", T.StringType())])
RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])


@F.arrow_udf(RESULT)
def found(texts: pa.Array) -> pa.Array:
    each = [found_in(t.as_py()) for t in texts.cast(pa.binary())]
    runs = pa.array([[dict(zip(("start", "length", "period"), r, strict=True)) for r in runs] for runs, _ in each], type=pa.list_(RUN))
    collapsed = pa.array([c for _, c in each], type=pa.binary()).cast(pa.string())
    return pa.StructArray.from_arrays([runs, collapsed], names=["runs", "collapsed"])


def with_runs(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """docs with runs, an array of (start, length, period) in words, and collapsed, the text with one turn of each run."""
    return docs.withColumn("_found", found(F.col(text_col))).withColumns({"runs": F.col("_found.runs"), "collapsed": F.col("_found.collapsed")}).drop("_found")


def strongest(runs: Column) -> Column:
    """The run of most turns, ties by start and then period; null if there is none."""

    def order(a: Column, b: Column) -> Column:
        turns = b["length"] * a["period"] - a["length"] * b["period"]
        by = F.when(turns != 0, turns).when(a["start"] != b["start"], a["start"] - b["start"]).otherwise(a["period"] - b["period"])
        return F.signum(by).cast("int")

    return F.get(F.array_sort(runs, order), 0)


def described(runs: Column) -> Column:
    """A line `start,length,period` for each run."""
    return F.array_join(F.transform(runs, lambda r: F.concat(F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), r["period"].cast("string")), F.lit("\n"))), "")


def with_planted_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with the texts of a tenth of the ids made periodic from some word on.

    With h the crc32 of the id and g a tenth of it: if h ends in 0, each word from number
    g % n on is taken from the first (n - a) / (3 + g % 8) words after it, plus one, again
    and again.  Documents without an id stay as they are.
    """
    h = F.crc32(F.col(id_col).cast("string").cast("binary"))
    split = F.array_remove(F.split(F.coalesce(text_col, F.lit("")), r"[\x20\x09-\x0D]+"), "")
    docs = docs.withColumns({"_g": F.floor(h / 10), "_words": F.when(h % 10 == 0, split)})
    n = F.size("_words")
    docs = docs.withColumn("_a", F.when(n > 0, F.col("_g") % n)).withColumn("_p", F.when(n > 0, 1 + F.floor((n - F.col("_a")) / (3 + F.col("_g") % 8))))
    turn = lambda i: F.when(i < F.col("_a"), i).otherwise(F.col("_a") + (i - F.col("_a")) % F.col("_p")).cast("int")
    made = F.array_join(F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.get("_words", turn(i))), " ")
    return docs.withColumn(text_col, F.when(n > 0, made).otherwise(F.col(text_col))).drop("_g", "_words", "_a", "_p")
