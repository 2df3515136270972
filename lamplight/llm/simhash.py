"""SimHash near-duplicates: fingerprints, links by BK-trees, connected components.

A fingerprint bit is the majority of that bit over the hashes of a text's word shingles.
Fingerprints that differ in at most `radius` bits link.  A BK-tree keeps fingerprints by
their integer Hamming distance to the parent; a search follows only edges within the
radius of the distance found.

One tree over everything would have to be broadcast and grow with the data, so the trees
are built per shard instead and shards are chosen so that every link lies inside one:
of four bands of 16 bits two must agree when at most two bits differ, which makes six
shards per fingerprint, each keyed by 32 bits.  A shard with more than `limit` distinct
fingerprints is divided in the same way by its free 32 bits, and once more by the free 16
that remain, where at most 256 fingerprints can differ: no tree has an unbounded shard,
and no link is lost.  A tree's task emits a star of links per connected group in its
shard, not pairs.  Components then follow by large-star and small-star rounds.

Cases: null and empty texts have fingerprint zero, which links like any other; fewer
words than a shingle form one; equal rows have equal fingerprints and one component; an
empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lamplight.llm.common import location, remove, written

#: Distinct fingerprints in a shard beyond which it is divided.
SHARD_LIMIT = 256
#: Keys of divided shards are broadcast up to this many (20 bytes each), else joined by shuffle.
BROADCAST_KEYS = 200_000


def simhash64(text: str | None, width: int = 3) -> int:
    """The fingerprint of a whole text."""
    import xxhash

    words = (text or "").encode().translate(LOWER).split()
    if not words:
        return 0
    if len(words) <= width:
        return xxhash.xxh64_intdigest(b" ".join(words), 42)
    line = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]).tolist()
    starts = [0, *ends[: len(words) - width]]
    digest = xxhash.xxh64_intdigest
    hashes = np.array([digest(line[a : b - 1], 42) for a, b in zip(starts, ends[width - 1 :], strict=True)], dtype="<u8")
    ones = np.zeros(64, dtype=np.int64)
    for at in range(0, len(hashes), 65536):  # bounded memory for long texts
        part = hashes[at : at + 65536]
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > len(hashes), bitorder="little").view("<u8")[0])


LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))


def with_fingerprint(docs: DataFrame, text_col: str = "text", width: int = 3, keep: list[str] | None = None) -> DataFrame:
    """The kept columns of docs and _fp, the fingerprint as a signed long."""
    keep = list(docs.columns) if keep is None else keep
    schema = T.StructType([*(docs.schema[c] for c in keep), T.StructField("_fp", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = np.array([simhash64(x.as_py(), width) for x in batch.column(text_col)], dtype=np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), pa.array(fps)], names=schema.fieldNames())

    return docs.select(*dict.fromkeys([*keep, text_col])).mapInArrow(run, schema)


class BKTree:
    """Children of a node are keyed by their Hamming distance to it."""

    def __init__(self) -> None:
        self.root: tuple[int, int, dict] | None = None

    def near(self, value: int, radius: int) -> list[int]:
        """Places of all values within the radius; only edges within the radius of a node's distance are followed."""
        found, todo = [], [self.root] if self.root else []
        while todo:
            node, place, children = todo.pop()
            d = (node ^ value).bit_count()
            if d <= radius:
                found.append(place)
            todo.extend(children[e] for e in range(d - radius, d + radius + 1) if e in children)
        return found

    def first(self, value: int, radius: int) -> int | None:
        """The place of some value within the radius, if there is one."""
        todo = [self.root] if self.root else []
        while todo:
            node, place, children = todo.pop()
            d = (node ^ value).bit_count()
            if d <= radius:
                return place
            todo.extend(x for e, x in children.items() if d - radius <= e <= d + radius)
        return None

    def add(self, value: int, place: int) -> None:
        if not self.root:
            self.root = (value, place, {})
            return
        node, _, children = self.root
        while True:
            d = (node ^ value).bit_count()
            if d not in children:
                children[d] = (value, place, {})
                return
            node, _, children = children[d]


def shard_stars(values: list[int], radius: int) -> list[tuple[int, int]]:
    """(value, root) for every value that is connected to another one in its shard; a group's root is its smallest."""
    parent = list(range(len(values)))

    def top(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    tree = BKTree()
    for i, v in enumerate(values):  # ascending, so the smaller place is the smaller value
        for j in tree.near(v, radius):
            a, b = top(i), top(j)
            parent[max(a, b)] = min(a, b)
        tree.add(v, i)
    return [(values[i], values[r]) for i in range(len(values)) if (r := top(i)) != i]


def band_masks(free: int, bands: int, radius: int) -> list[int]:
    """Masks that fix all but `radius` of the bands into which the free bits are cut, lowest first."""
    bits = [i for i in range(64) if free >> i & 1]
    step = len(bits) // bands
    parts = [sum(1 << b for b in bits[k * step : (k + 1) * step]) for k in range(bands)]
    return [sum(c) for c in combinations(parts, bands - radius)]


def mask_tree(radius: int) -> list[list[tuple[int, list[int]]]]:
    """Per level: (mask, numbers of its children in the next level).  Children fix more bits of what their parent leaves free."""
    everything = (1 << 64) - 1
    bands = radius + 2
    levels: list[list[tuple[int, list[int]]]] = [[(m, []) for m in band_masks(everything, bands, radius)]]
    for _ in range(2):
        below: list[tuple[int, list[int]]] = []
        for mask, children in levels[-1]:
            free = everything & ~mask
            if bin(free).count("1") < bands:
                continue
            for m in band_masks(free, bands, radius):
                children.append(len(below))
                below.append((mask | m, []))
        levels.append(below)
    return levels


def signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def shard_rows(fps: DataFrame, radius: int, limit: int) -> DataFrame:
    """(_shard, _value, _fp): the shards of each fingerprint, large ones divided."""
    levels = mask_tree(radius)
    spark = fps.sparkSession

    def keyed(df: DataFrame, level: int, numbers) -> DataFrame:
        masks = F.array(*[F.lit(signed(m)) for m, _ in levels[level]])
        df = df.withColumn("_m", F.explode(numbers))
        return df.select((F.lit(level * 10_000) + F.col("_m")).alias("_shard"), F.col("_fp").bitwiseAND(F.element_at(masks, F.col("_m") + 1)).alias("_value"), "_fp")

    rows = keyed(fps, 0, F.array(*[F.lit(i) for i in range(len(levels[0]))]))
    done = []
    for level in range(len(levels)):
        last = level == len(levels) - 1
        counts = rows.groupBy("_shard", "_value").agg(F.count("*").alias("_n")).where("_n > 1")
        counts = written(counts, "simhash-shards")
        large = counts.where(F.col("_n") > (limit if not last else 1 << 62)).select("_shard", "_value")
        small = counts.where(F.col("_n") <= (limit if not last else 1 << 62)).select("_shard", "_value")
        n_large = large.count()
        # A shard of one fingerprint has no link; the semi join drops it before the shuffle to the trees.
        done.append(rows.join(small, ["_shard", "_value"], "left_semi"))
        if not n_large or last:
            break
        hot = rows.join(F.broadcast(large) if n_large <= BROADCAST_KEYS else large, ["_shard", "_value"], "left_semi")
        children = F.array(*[F.array(*[F.lit(c) for c in cs]) for _, cs in levels[level]])
        rows = written(keyed(hot.select("_fp", F.element_at(children, F.col("_shard") - level * 10_000 + 1).alias("_c")), level + 1, F.col("_c")).distinct(), "simhash-divided")
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return out


def links(fps: DataFrame, radius: int = 2, limit: int = SHARD_LIMIT) -> DataFrame:
    """(a, b) stars over distinct fingerprints fps (_fp) that connect whatever links within the radius connect."""
    rows = shard_rows(fps, radius, limit)
    schema = T.StructType([T.StructField("a", T.LongType()), T.StructField("b", T.LongType())])

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        carried: list[np.ndarray] = []
        open_key: tuple[int, int] | None = None

        def stars(members: list[np.ndarray]) -> list[tuple[int, int]]:
            values = np.unique(np.concatenate(members).view(np.uint64))
            return shard_stars(values.tolist(), radius) if len(values) > 1 else []

        def as_batch(pairs: list[tuple[int, int]]) -> pa.RecordBatch:
            both = np.array(pairs, dtype=np.uint64).reshape(-1, 2).view(np.int64)
            return pa.RecordBatch.from_arrays([pa.array(both[:, 0]), pa.array(both[:, 1])], names=["a", "b"])

        for batch in batches:
            if not batch.num_rows:
                continue
            shard, value, fp = (batch.column(c).to_numpy() for c in ("_shard", "_value", "_fp"))
            edges = np.flatnonzero((shard[1:] != shard[:-1]) | (value[1:] != value[:-1])) + 1
            found: list[tuple[int, int]] = []
            for a, b in zip([0, *edges], [*edges, len(fp)], strict=True):
                key = (int(shard[a]), int(value[a]))
                if key != open_key:
                    if carried:
                        found += stars(carried)
                    open_key, carried = key, []
                carried.append(fp[a:b])
            yield as_batch(found)
        if carried:
            yield as_batch(stars(carried))

    return rows.repartition("_shard", "_value").sortWithinPartitions("_shard", "_value").mapInArrow(search, schema).distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, root): the smallest node reachable from each node of the edges (a, b).

    Rounds of large-star (larger neighbours move to the smallest) and small-star (smaller
    ones do), each with a minimum per node and one join on the node; every round is
    written to the shared folder, and the rounds end when nothing moves, which the number of
    edges and the sum of their hashes show.
    """
    spark = edges.sparkSession
    mark = None
    now = written(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "components")
    while True:
        # large-star
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("_low"))
        large = now.join(low.withColumnRenamed("a", "b"), "b").select("a", F.col("_low").alias("b"))
        large = large.where("a <> b").distinct()
        # small-star
        least = large.groupBy("a").agg(F.min("b").alias("_low"))
        small = large.join(least, "a").select(F.explode(F.array(F.struct(F.col("a"), F.col("_low").alias("b")), F.struct(F.col("b").alias("a"), F.col("_low").alias("b")))).alias("e"))
        then = written(small.select("e.a", "e.b").where("a <> b").distinct(), "components")
        last, mark = mark, tuple(then.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        old = location(now)
        now = then
        if old:
            remove(spark, old)
        if mark == last:
            return now.select(F.col("a").alias("node"), F.col("b").alias("root"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3, radius: int = 2, limit: int = SHARD_LIMIT) -> DataFrame:
    """(id, _fp, component_id): component_id is the smallest id that links reach, its own included."""
    prints = written(with_fingerprint(docs, text_col, width, [id_col]), "simhash-prints")
    smallest = written(prints.groupBy("_fp").agg(F.min(id_col).alias("_id")), "simhash-distinct")
    roots = components(links(smallest.select("_fp"), radius, limit))
    grouped = smallest.join(roots, smallest["_fp"] == roots["node"], "left").select("_fp", "_id", F.coalesce("root", "_fp").alias("_root"))
    ids = grouped.groupBy("_root").agg(F.min("_id").alias("component_id"))
    of_print = grouped.join(ids, "_root").select("_fp", "component_id")
    return prints.join(of_print, "_fp").select(id_col, "_fp", "component_id")
