"""SimHash near-duplicates at a given similarity of word shingles.

Two texts of similarity 0.8 differ in about a seventh of their fingerprint bits, far more
than the few bits that bands can guarantee.  Here fingerprints have 256 bits and shards
are keyed by bits drawn at random, so that a similar pair falls into one shard in at
least one of several tables with the wanted probability (0.95 at the similarity itself,
rising quickly above).  A shard holds some 64 unrelated fingerprints at any number of
documents: the key has the logarithm of their number less six bits.

Candidates come in three rounds, and an exact comparison of shingle sets decides on them:

1. A BK-tree per shard holds its leaders.  A fingerprint within the expected distance of a
   leader is a candidate with it; any other becomes a leader.  That is one pair for each
   fingerprint and shard, and joins nearly all of a group of copies however large it is.
   Shards over `SHARD_LIMIT` are salted, by table, so that their parts meet in other tables.
2. Each fingerprint outside the largest class of its shard with the nearest one of another
   class: one pair for each fingerprint, which joins most of what the leaders left apart.
3. All pairs within the wide radius whose documents are still in different classes, of those
   fingerprints alone that had a neighbour in the second round or are in a class of several.
   In a shard these are the members outside its largest class against all; shards over
   `SHARD_LIMIT` are cut into blocks, to which only those members are copied.  A second
   fingerprint of 2048 bits tells similar from nearly similar pairs three times as sharply,
   and a pair is given in the first table that it shares, so once.

Candidates of the third round grow with the square of a family of documents that are
alike by somewhat less than the similarity, but not of a group of copies.

Fingerprints are of shingle sets, as the comparison is: repeats count once, and different
sets with equal fingerprints are candidates like others.

Cases: null and empty texts are one group, fewer words than a shingle form one shingle,
equal rows share a class, documents without an id are told apart by their texts, an empty
table gives an empty result; very long texts are hashed in blocks; ties (equal distances)
don't matter, since classes are connected components; extra columns are dropped unless
kept, columns whose names start with an underscore may not be kept.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lamplight.llm.common import written
from lamplight.llm.simhash import LOWER, BKTree, components

BITS = 256
#: Bits of the fingerprint that the last round compares as well.
LONG_BITS = 2048
RECALL = 0.95
#: In place of the largest class: none has two members; not known, since the shard is in one block.
NO_CLASS, COLD = -2, -1
#: Members beyond which a shard is divided.
SHARD_LIMIT = 4096
#: Keys of divided shards (20 bytes each) are broadcast up to this many, else joined by shuffle.
BROADCAST_SHARDS = 200_000


def shingle_hashes(text: str | None, width: int) -> np.ndarray:
    """Hashes of the word shingles of a whole text, repeats included."""
    import xxhash

    words = (text or "").encode().translate(LOWER).split()
    if not words:
        return np.zeros(0, dtype="<u8")
    line, width = b" ".join(words), min(width, len(words))
    ends = np.cumsum([len(w) + 1 for w in words]).tolist()
    starts = [0, *ends[: len(words) - width]]
    return np.array([xxhash.xxh64_intdigest(line[a : b - 1], 42) for a, b in zip(starts, ends[width - 1 :], strict=True)], dtype="<u8")


def majority_bits(hashes: np.ndarray, bits: int = BITS, block: int = 4096) -> bytes:
    """Majority bits of as many mixes as it takes of the hashes of a shingle set."""
    ones = np.zeros(bits, dtype=np.int64)
    for at in range(0, len(hashes), block):
        part = hashes[at : at + block, None] + np.arange(1, bits // 64 + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        part = (part ^ part >> np.uint64(30)) * np.uint64(0xBF58476D1CE4E5B9)
        part = (part ^ part >> np.uint64(27)) * np.uint64(0x94D049BB133111EB)
        part ^= part >> np.uint64(31)
        ones += np.unpackbits(np.ascontiguousarray(part).view(np.uint8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return np.packbits(ones * 2 > len(hashes), bitorder="little").tobytes()


def differing_share(similarity: float) -> float:
    """Expected share of differing fingerprint bits of two shingle sets of this Jaccard similarity."""
    return math.acos(2 * similarity / (1 + similarity)) / math.pi


def table_count(similarity: float, key_bits: int, recall: float = RECALL) -> int:
    """Tables until a pair of the similarity shares a key in one of them with the wanted probability."""
    return math.ceil(math.log(1 - recall) / math.log(1 - (1 - differing_share(similarity)) ** key_bits))


class Shape(NamedTuple):
    """How fingerprints are dealt to shards, and the radii of the two rounds."""

    key_bits: int
    tables: int
    near: int
    wide: int
    long: int

    def drawn(self) -> list[np.ndarray]:
        """The key bits of each table."""
        return [np.random.default_rng(t).choice(BITS, self.key_bits, replace=False) for t in range(self.tables)]


def shape(n: int, similarity: float) -> Shape:
    key_bits = max(10, math.ceil(math.log2(max(n, 1))) - 6)
    share = differing_share(similarity)
    most = lambda bits, spread: math.floor(bits * share + spread * math.sqrt(bits * share * (1 - share)))
    return Shape(key_bits, table_count(similarity, key_bits), round(BITS * share), most(BITS, 2), most(LONG_BITS, 3))


PAIR = T.StructType([T.StructField("a", T.LongType()), T.StructField("b", T.LongType())])
FAR_PAIR = T.StructType([*PAIR.fields, T.StructField("far", T.LongType())])


def in_shards(items: DataFrame, carried: list[str], of: Shape) -> DataFrame:
    """(table, key, *carried): a row per item and table."""
    schema = T.StructType([T.StructField("table", T.IntegerType()), T.StructField("key", T.LongType()), *(items.schema[c] for c in carried)])

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        drawn = of.drawn()
        powers = 1 << np.arange(of.key_bits, dtype=np.int64)
        for whole in batches:
            for at in range(0, whole.num_rows, 2048):
                batch = whole.slice(at, 2048)
                size = batch.num_rows
                bits = np.unpackbits(np.frombuffer(b"".join(batch.column("fp").to_pylist()), dtype=np.uint8).reshape(size, -1), axis=1, bitorder="little")
                for t, places in enumerate(drawn):
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(size, t, dtype=np.int32)), pa.array(bits[:, places] @ powers), *(batch.column(c) for c in carried)], names=schema.fieldNames())

    return items.select(*dict.fromkeys([*carried, "fp"])).mapInArrow(keys, schema)


def joined_small(rows: DataFrame, few: DataFrame, on: list[str], how: str) -> DataFrame:
    """A join that broadcasts the written frame `few` while it has no more than BROADCAST_SHARDS rows."""
    return rows.join(F.broadcast(few) if few.count() <= BROADCAST_SHARDS else few, on, how)


def by_shard(rows: DataFrame, pairs: Callable[[list], Iterator[np.ndarray]], keys: list[str], prints: list[str], carried: list[str]) -> DataFrame:
    """(a, b, far): what `pairs` yields (arrays of three columns) for the members of each shard, given as a list of arrays."""

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_key, members, found, size = None, [], [], 0

        def as_batch() -> pa.RecordBatch:
            rows = np.concatenate(found)
            found.clear()
            return pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(c)) for c in rows.T], names=FAR_PAIR.fieldNames())

        def close() -> Iterator[pa.RecordBatch]:
            nonlocal size
            if members and sum(len(m[0]) for m in members) > 1:
                for more in pairs([np.concatenate(c) for c in zip(*members, strict=True)]):
                    found.append(more)
                    size += len(more)
                    if size > 65536:
                        yield as_batch()
                        size = 0

        for batch in batches:
            if not batch.num_rows:
                continue
            key = np.stack([batch.column(c).to_numpy() for c in keys]).astype(np.int64)
            fps = [np.frombuffer(b"".join(batch.column(c).to_pylist()), dtype="<u8").reshape(batch.num_rows, -1) for c in prints]
            columns = [*fps, *(batch.column(c).to_numpy() for c in carried)]
            edges = np.flatnonzero((key[:, 1:] != key[:, :-1]).any(axis=0)) + 1
            for x, y in zip([0, *edges.tolist()], [*edges.tolist(), batch.num_rows], strict=True):
                this = tuple(key[:, x].tolist())
                if this != open_key:
                    yield from close()
                    open_key, members = this, []
                members.append([c[x:y] for c in columns])
        yield from close()
        if found:
            yield as_batch()

    return rows.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(search, FAR_PAIR)


def leader_pairs(items: DataFrame, of: Shape, limit: int) -> DataFrame:
    """(a, b): each item (n, fp) with a leader of its shard."""
    rows = in_shards(items, ["n", "fp"], of)
    hot = written(rows.groupBy("table", "key").agg(F.count("*").alias("_n")).where(F.col("_n") > limit), "similar-hot")
    # The salt differs between tables, so that parts of a shard in one meet in another.
    salt = F.pmod(F.xxhash64("n", "table"), F.coalesce(F.ceil(F.col("_n") / limit), F.lit(1))).alias("salt")
    salted = joined_small(rows, hot, ["table", "key"], "left").select("table", "key", salt, "n", "fp")

    def pairs(members: list[np.ndarray]) -> Iterator[np.ndarray]:
        fps, names = members
        names, raw, tree, found = names.tolist(), fps.tobytes(), BKTree(), []
        for i in range(len(names)):
            v = int.from_bytes(raw[i * BITS // 8 : (i + 1) * BITS // 8], "little")
            j = tree.first(v, of.near)
            if j is None:
                tree.add(v, i)
            else:
                found.append((names[i], names[j], 0))
        if found:
            yield np.array(found, dtype=np.int64)

    # One leader for each item over all tables keeps the exact comparisons in proportion to the items.
    every = by_shard(salted, pairs, ["table", "key", "salt"], ["fp"], ["n"])
    return every.groupBy("a").agg(F.min("b").alias("b"))


def rest_pairs(items: DataFrame, of: Shape, limit: int, nearest: bool = False) -> DataFrame:
    """(a, b): pairs of items (n, fp, root) of different roots that share a shard and lie within the wide radius.

    With `nearest` one for each item outside its shard's largest class; else all of them, for
    which the items' long fingerprints (long) are compared as well.
    """
    prints = ["fp"] if nearest else ["fp", "long"]
    columns = ["n", "root", *prints]
    rows = in_shards(items, columns, of)
    hot = written(rows.groupBy("table", "key").agg(F.count("*").alias("_n")).where(F.col("_n") > limit), "similar-hot")
    # The largest class of a hot shard; everything else in the shard is copied to each of its blocks.
    sizes = joined_small(rows, hot, ["table", "key"], "inner").groupBy("table", "key", "root", "_n").agg(F.count("*").alias("_of"))
    most = F.max(F.struct("_of", "root"))
    hot = written(sizes.groupBy("table", "key", "_n").agg(F.when(most["_of"] > 1, most["root"]).otherwise(NO_CLASS).alias("_most")), "similar-hot-classes")
    blocks = F.ceil(F.col("_n") / limit)
    own = F.pmod(F.xxhash64("n"), blocks)
    where = F.when(F.col("_n").isNull(), F.array(F.lit(0).cast("long"))).when(F.col("root") == F.col("_most"), F.array(own)).otherwise(F.sequence(F.lit(0).cast("long"), blocks - 1))
    home = F.when(F.col("_n").isNull(), F.lit(0).cast("long")).otherwise(own)
    dealt = joined_small(rows, hot, ["table", "key"], "left").select("table", "key", *columns, home.alias("home"), F.coalesce("_most", F.lit(COLD)).alias("most"), F.explode(where).alias("block"))

    def pairs(members: list[np.ndarray]) -> Iterator[np.ndarray]:
        fps, (names, roots, home, most, block, table) = members[0], members[len(prints) :]
        kinds, n = np.unique(roots, return_counts=True)
        if len(kinds) == 1:
            return
        major = most[0] if most[0] != COLD else kinds[n.argmax()] if n.max() > 1 else NO_CLASS
        minor, mine, drawn = roots != major, home == block[0], of.drawn()[: table[0]]
        # Members outside the largest class against that class, and against each other once, in the block where the row is at home.
        for at in range(0, len(names), 256):
            i = at + np.flatnonzero(minor[at : at + 256])
            if not len(i):
                continue
            far = np.zeros((len(i), len(names)), dtype=np.uint16)
            for k in range(fps.shape[1]):
                far += np.bitwise_count(fps[i, k, None] ^ fps[None, :, k])
            far[roots[i, None] == roots[None]] = BITS + 1
            if nearest:
                y = far.argmin(axis=1)
                x = np.flatnonzero(far[np.arange(len(i)), y] <= of.wide)
                y = y[x]
            else:
                x, y = np.nonzero((far <= of.wide) & (~minor[None] | (mine[i, None] & (names[i, None] > names[None]))))
                keep = np.bitwise_count(members[1][i[x]] ^ members[1][y]).sum(axis=1) <= of.long
                apart = np.unpackbits((fps[i[x]] ^ fps[y]).view(np.uint8), axis=1, bitorder="little").astype(bool)
                for places in drawn:  # an earlier table that the pair shares has it already
                    keep &= apart[:, places].any(axis=1)
                x, y = x[keep], y[keep]
            if len(x):
                yield np.stack([names[i[x]], names[y], far[x, y]], axis=1).astype(np.int64)

    found = by_shard(dealt.withColumn("_table", F.col("table")), pairs, ["table", "key", "block"], prints, ["n", "root", "home", "most", "block", "_table"])
    if nearest:
        found = found.groupBy("a").agg(F.min_by("b", F.struct("far", "b")).alias("b"))
    return found.select("a", "b")


def set_digest(hashes: np.ndarray) -> bytes:
    """128 bits that name a shingle set."""
    return hashlib.blake2b(hashes.tobytes(), digest_size=16).digest()


def similar_classes(docs: DataFrame, keep: list[str], text_col: str = "text", width: int = 5, similarity: float = 0.8, limit: int = SHARD_LIMIT) -> DataFrame:
    """(*keep, class): a row per document; documents that similar shingle sets connect have the same class.

    Documents are told apart by their texts alone, so ids may be null or repeated.
    """
    print_schema = T.StructType([*(docs.schema[c] for c in keep), T.StructField("_of", T.StringType()), T.StructField("set", T.BinaryType()), T.StructField("size", T.LongType()), T.StructField("fp", T.BinaryType())])
    set_schema = T.StructType([T.StructField("_of", T.StringType()), T.StructField("hashes", T.BinaryType())])
    long_schema = T.StructType([T.StructField("_of", T.StringType()), T.StructField("long", T.BinaryType())])
    text_hash = F.sha2(F.coalesce(text_col, F.lit("")).cast("binary"), 256)

    def fingerprint(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            digests, sizes, fps = [], [], []
            for x in batch.column(text_col):
                hashes = np.unique(shingle_hashes(x.as_py(), width))
                digests.append(set_digest(hashes))
                sizes.append(len(hashes))
                fps.append(majority_bits(hashes))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in [*keep, "_of"]), pa.array(digests, pa.binary()), pa.array(sizes, pa.int64()), pa.array(fps, pa.binary())], names=print_schema.fieldNames())

    def shingles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [np.unique(shingle_hashes(x.as_py(), width)).tobytes() for x in batch.column(text_col)]
            yield pa.RecordBatch.from_arrays([batch.column("_of"), pa.array(sets, pa.binary())], names=set_schema.fieldNames())

    def long_print(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [majority_bits(np.unique(shingle_hashes(x.as_py(), width)), LONG_BITS, 1024) for x in batch.column(text_col)]
            yield pa.RecordBatch.from_arrays([batch.column("_of"), pa.array(found, pa.binary())], names=long_schema.fieldNames())

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column("_a"), batch.column("_b"), strict=True):
                p, q = (np.frombuffer(v.as_py(), dtype="<u8") for v in (x, y))
                common = len(np.intersect1d(p, q, assume_unique=True))
                keep.append(common >= similarity * (len(p) + len(q) - common))
            yield batch.filter(pa.array(keep, pa.bool_())).select(["a", "b"])

    def texts_of(members: DataFrame) -> DataFrame:
        """(_of, text) of items, each text once."""
        return keyed.select("_of", text_col).join(members.select("_of"), "_of", "left_semi").groupBy("_of").agg(F.first(text_col).alias(text_col))

    def confirmed(pairs: DataFrame) -> DataFrame:
        """The pairs whose whole shingle sets have the similarity."""
        of = lambda c: items.select(F.col("n").alias(c), F.col("size").alias(f"{c}_size"))
        # Sets of too different sizes can't have it.
        fits = F.least("a_size", "b_size") >= similarity * F.greatest("a_size", "b_size")
        named = written(pairs.join(of("a"), "a").join(of("b"), "b").where(fits).select("a", "b"), "similar-pairs")
        members = items.join(named.select(F.explode(F.array("a", "b")).alias("n")).distinct(), "n", "left_semi")
        sets = written(texts_of(members).mapInArrow(shingles, set_schema).join(members.select("_of", "n"), "_of").select("n", "hashes"), "similar-sets")
        with_a = named.join(sets.select(F.col("n").alias("a"), F.col("hashes").alias("_a")), "a")
        both = with_a.join(sets.select(F.col("n").alias("b"), F.col("hashes").alias("_b")), "b").select("a", "b", "_a", "_b")
        return written(both.mapInArrow(compare, PAIR), "similar-confirmed")

    def with_roots(links: DataFrame) -> DataFrame:
        roots = components(links)
        return items.join(roots, items["n"] == roots["node"], "left").select("n", "set", "_of", "fp", F.coalesce("root", "n").alias("root"))

    def with_long_prints(rooted: DataFrame, near: DataFrame) -> DataFrame:
        """Items that may still have a neighbour of another class, with their long fingerprints."""
        several = rooted.groupBy("root").agg(F.count("*").alias("_n")).where("_n > 1").select("root", F.lit(True).alias("_several"))
        close = near.select(F.col("a").alias("n"), F.lit(True).alias("_close"))
        chosen = written(rooted.join(close, "n", "left").join(several, "root", "left").where("_close or _several").select("n", "_of", "fp", "root"), "similar-chosen")
        return written(chosen.join(texts_of(chosen).mapInArrow(long_print, long_schema), "_of").select("n", "fp", "root", "long"), "similar-long")

    keyed = docs.select(*dict.fromkeys([*keep, text_col])).withColumn("_of", text_hash)
    prints = written(keyed.mapInArrow(fingerprint, print_schema), "similar-prints")
    distinct = prints.groupBy("set").agg(F.min("_of").alias("_of"), F.min("size").alias("size"), F.min("fp").alias("fp"))
    items = written(distinct.select(F.monotonically_increasing_id().alias("n"), "set", "_of", "size", "fp"), "similar-items")
    of = shape(items.count(), similarity)
    found = confirmed(leader_pairs(items, of, limit))
    near = written(rest_pairs(written(with_roots(found), "similar-roots"), of, limit, nearest=True), "similar-near")
    found = found.unionByName(confirmed(near))
    rooted = written(with_roots(found), "similar-roots")
    found = found.unionByName(confirmed(rest_pairs(with_long_prints(rooted, near), of, limit)))
    return prints.select(*keep, "set").join(with_roots(found).select("set", F.col("root").alias("class")), "set").select(*keep, "class")


def similar_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, similarity: float = 0.8) -> DataFrame:
    """(id, component_id): components of documents whose shingle sets have the similarity; the smallest id names one."""
    classes = written(similar_classes(docs, [id_col], text_col, width, similarity), "similar-classes")
    return classes.join(classes.groupBy("class").agg(F.min(id_col).alias("component_id")), "class").select(id_col, "component_id")
