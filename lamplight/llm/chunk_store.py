"""Content-addressed store of token-id streams.

Ids of a document are cut where a rolling hash over the last sixteen ids says so, so equal
passages are cut alike wherever they stand.  A chunk's address is a hash of its bytes;
each distinct chunk is kept once.  A recipe lists a document's chunks; its Merkle root and
the roots of the manifest prove that what is read back is what was written.

Files, all Parquet in one folder, written by Spark's own commit protocol:

    chunks/    a row per use of a chunk (row, doc, seq, n, digest); for one row of each
               digest the ids as little-endian bytes.  Bucketed by key, which is the digest
               where there are bytes and else the document's row, so that the uses of a
               chunk that very many documents share don't meet in one task
    recipes/   documents in ascending order of id: digests, Merkle root, number of ids,
               and the ids before the document within its part
    manifest/  per part of recipes: first and last id, documents, ids, root over their roots
    format/    one row: how ids are stored, the number of buckets and the kind of document ids

A store is a folder: any session opens it with `open_store`, which gives Spark the buckets
again; no table stays in the catalogue.  The number of buckets follows the bytes of text.

Reading back joins recipes with the bucketed chunks, which needs no shuffle of the chunks,
brings a document's chunks together and checks digests and roots.

Cases: null and empty texts hold the end id alone; rows of equal id are documents of their
own, in the order in which they were read, equal rows (ties) too; very long texts are cut
like others; extra columns, clashing ones among them, are left out; an empty table gives an
empty store.
"""

from __future__ import annotations

import hashlib
import uuid
import zlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lamplight.llm.common import fresh_path, written
from lamplight.llm.token_units import unit_ids, vocabulary, word_level_ids

#: Distinct words that a worker keeps.
UNITS = 1_000_000
WINDOW = 16
#: Ids per chunk: mean (a power of two) and bounds.
MEAN, LEAST, MOST = 512, 64, 4096
#: Digests that a task remembers in order to leave out chunk bytes it has already sent.
REMEMBERED = 200_000
#: Characters of text per bucket, and the least number of buckets.
BUCKET_CHARS, MIN_BUCKETS = 16_000_000, 8
#: Uses beyond which a chunk's bytes are read back in several tasks, and in how many.
HOT_USES = 1000
SALTS = 64
#: Digests of such chunks (16 bytes each) are broadcast up to this many, else joined by shuffle.
BROADCAST_DIGESTS = 200_000


def digest(data: bytes) -> bytes:
    return hashlib.blake2b(data, digest_size=16).digest()


def cut_points(ids: np.ndarray) -> list[int]:
    """Ends of the chunks of an id stream."""
    n = len(ids)
    gear = ids.astype(np.uint32) * np.uint32(0x9E3779B1)
    gear ^= gear >> np.uint32(15)
    h = np.zeros(n, dtype=np.uint32)
    for j in range(min(WINDOW, n)):
        h[j:] += gear[: n - j] << np.uint32(2 * j)
    ends, last = [], 0
    for e in (np.flatnonzero(h >> np.uint32(23) == 0) + 1).tolist():
        while e - last > MOST:
            last += MOST
            ends.append(last)
        if e - last >= LEAST:
            ends.append(e)
            last = e
    while n - last > MOST:
        last += MOST
        ends.append(last)
    if last < n:
        ends.append(n)
    return ends


class Merkle:
    """Root over a stream of leaves: like a binary counter, equal subtrees are joined as soon as there are two."""

    def __init__(self) -> None:
        self.stack: list[tuple[int, bytes]] = []

    def add(self, leaf: bytes) -> None:
        level = 0
        while self.stack and self.stack[-1][0] == level:
            leaf = digest(self.stack.pop()[1] + leaf)
            level += 1
        self.stack.append((level, leaf))

    def root(self) -> bytes:
        out = b""
        for _, h in reversed(self.stack):
            out = digest(h + out) if out else h
        return out


def merkle_root(leaves: list[bytes]) -> bytes:
    tree = Merkle()
    for leaf in leaves:
        tree.add(leaf)
    return tree.root()


class Store(NamedTuple):
    """A store's folder and format; `doc` is the type of document ids."""

    folder: str
    dtype: str
    buckets: int
    doc: str

    @property
    def recipes(self) -> str:
        return f"{self.folder}/recipes"

    @property
    def manifest(self) -> str:
        return f"{self.folder}/manifest"


def open_store(spark: SparkSession, folder: str) -> Store:
    """The store in a folder."""
    return Store(folder, *spark.read.schema("dtype string, buckets int, doc string").json(f"{folder}/format").first())


def save_chunks(rows: DataFrame, folder: str, buckets: int) -> None:
    """Write rows as bucketed files; the table that Spark needs for it is dropped, its files stay."""
    name = f"chunks_{uuid.uuid4().hex}"
    rows.write.bucketBy(buckets, "key").option("path", f"{folder}/chunks").saveAsTable(name)
    rows.sparkSession.sql(f"DROP TABLE {name}")


def chunks(spark: SparkSession, store: Store) -> DataFrame:
    """The chunk files with their buckets, by a table that is dropped as soon as the frame knows them."""
    name = f"chunks_{uuid.uuid4().hex}"
    columns = f"row BIGINT, doc {store.doc}, seq INT, n INT, digest BINARY, data BINARY, key BINARY"
    spark.sql(f"CREATE TABLE {name} ({columns}) USING parquet CLUSTERED BY (key) INTO {store.buckets} BUCKETS LOCATION '{store.folder}/chunks'")
    found = spark.table(name)
    spark.sql(f"DROP TABLE {name}")
    return found


def chunk_uses(docs: DataFrame, id_col: str, text_col: str, end_id: int, vocab: str, vocab_dir: str | None, dtype: str) -> DataFrame:
    """A row per chunk of each document; a task leaves out the bytes of chunks that it has sent before."""
    schema = T.StructType(
        [
            T.StructField("row", T.LongType()),
            T.StructField("doc", docs.schema[id_col].dataType),
            T.StructField("seq", T.IntegerType()),
            T.StructField("n", T.IntegerType()),
            T.StructField("digest", T.BinaryType()),
            T.StructField("data", T.BinaryType()),
            T.StructField("key", T.BinaryType()),
        ]
    )

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo, task, k = unit_ids(vocabulary(vocab, vocab_dir), dtype, UNITS), TaskContext.get().partitionId(), 0
        end, width = np.array([end_id], dtype=dtype).tobytes(), np.dtype(dtype).itemsize
        sent: set[bytes] = set()
        for batch in batches:
            rows, keys, seqs, ns, digests, datas, places = [], [], [], [], [], [], []
            for key, text in zip(batch.column(id_col), batch.column(text_col), strict=True):
                data, last, key = word_level_ids(memo, text.as_py() or "") + end, 0, key.as_py()
                for seq, e in enumerate(cut_points(np.frombuffer(data, dtype=dtype))):
                    part = data[width * last : width * e]
                    d = digest(part)
                    rows.append(task << 40 | k)
                    keys.append(key)
                    seqs.append(seq)
                    ns.append(e - last)
                    digests.append(d)
                    datas.append(None if d in sent else part)
                    places.append((task << 40 | k).to_bytes(8, "big") if d in sent else d)
                    if len(sent) >= REMEMBERED:
                        sent.clear()
                    sent.add(d)
                    last = e
                k += 1
            types = [pa.int64(), batch.schema.field(id_col).type, pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip((rows, keys, seqs, ns, digests, datas, places), types, strict=True)], names=schema.fieldNames())

    return docs.select(id_col, text_col).mapInArrow(cut, schema)


def kept_once(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows ordered by key: all, but bytes for the first row of each digest only."""
    last = None
    for batch in batches:
        datas = []
        for k, data in zip(batch.column("key").to_pylist(), batch.column("data"), strict=True):
            datas.append(None if k == last else data.as_py())
            last = k
        columns = [pa.array(datas, pa.binary()) if name == "data" else batch.column(name) for name in batch.schema.names]
        yield pa.RecordBatch.from_arrays(columns, names=batch.schema.names)


def with_roots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Recipes in order, with roots and the ids before each within the part."""
    before = 0
    for batch in batches:
        parts = batch.column("parts")
        flat = parts.flatten()
        ends = np.cumsum(pc.list_value_length(parts).to_numpy())
        leaves, sizes = flat.field("digest").to_pylist(), np.concatenate([[0], np.cumsum(flat.field("n").to_numpy())])
        bounds = [0, *ends.tolist()]
        roots = [merkle_root(leaves[a:b]) for a, b in zip(bounds, bounds[1:], strict=False)]
        ns = sizes[ends] - sizes[np.array(bounds[:-1], dtype=np.int64)]
        starts = before + np.cumsum(ns) - ns
        before += int(ns.sum())
        digests = pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), flat.field("digest"))
        columns = [batch.column("part"), batch.column("doc"), batch.column("row"), digests, pa.array(roots, pa.binary()), pa.array(ns, pa.int64()), pa.array(starts, pa.int64())]
        yield pa.RecordBatch.from_arrays(columns, names=["part", "doc", "row", "digests", "root", "n_tokens", "before"])


def write_store(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", end_id: int = 2, vocab: str = "word_bpe_49k.json", vocab_dir: str | None = None, dtype: str = "<u2"
) -> Store:
    """Encode all documents and write them into a new store in the shared folder."""
    spark, folder = docs.sparkSession, fresh_path(docs.sparkSession, "store")
    size = docs.agg(F.sum(F.length(text_col))).first()[0] or 0
    buckets = max(MIN_BUCKETS, -(-size // BUCKET_CHARS))
    store = Store(folder, dtype, buckets, docs.schema[id_col].dataType.simpleString())
    uses = chunk_uses(docs, id_col, text_col, end_id, vocab, vocab_dir, dtype)
    ordered = uses.repartition(buckets, "key").sortWithinPartitions("key")
    save_chunks(ordered.mapInArrow(kept_once, uses.schema), folder, buckets)

    uses = chunks(spark, store).select("doc", "row", F.struct("seq", "digest", "n").alias("part")).groupBy("doc", "row").agg(F.sort_array(F.collect_list("part")).alias("parts"))
    placed = uses.repartitionByRange("doc", "row").sortWithinPartitions("doc", "row").select(F.spark_partition_id().alias("part"), "doc", "row", "parts")
    schema = T.StructType(
        [
            T.StructField("part", T.IntegerType()),
            uses.schema["doc"],
            T.StructField("row", T.LongType()),
            T.StructField("digests", T.ArrayType(T.BinaryType())),
            T.StructField("root", T.BinaryType()),
            T.StructField("n_tokens", T.LongType()),
            T.StructField("before", T.LongType()),
        ]
    )
    placed.mapInArrow(with_roots, schema).write.parquet(store.recipes)
    manifest(spark.read.schema(schema).parquet(store.recipes)).write.parquet(store.manifest)
    spark.createDataFrame([store[1:]], "dtype string, buckets int, doc string").write.json(f"{folder}/format")
    return store


def manifest(recipes: DataFrame) -> DataFrame:
    """A row per part of the recipes: documents, ids, first and last id, and the root over its documents' roots."""
    schema = T.StructType(
        [T.StructField("part", T.IntegerType()), T.StructField("documents", T.LongType()), T.StructField("ids", T.LongType()), T.StructField("first", recipes.schema["doc"].dataType), T.StructField("last", recipes.schema["doc"].dataType), T.StructField("root", T.BinaryType())]
    )

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, n, ids, first, last, tree = None, 0, 0, None, None, Merkle()

        def row(kind: pa.DataType) -> pa.RecordBatch:
            types = [pa.int32(), pa.int64(), pa.int64(), kind, kind, pa.binary()]
            return pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip((part, n, ids, first, last, tree.root()), types, strict=True)], names=schema.fieldNames())

        for batch in batches:
            kind = batch.schema.field("doc").type
            for p, doc, root, k in zip(*(batch.column(c).to_pylist() for c in ("part", "doc", "root", "n_tokens")), strict=True):
                if p != part:
                    if n:
                        yield row(kind)
                    part, n, ids, first, tree = p, 0, 0, doc, Merkle()
                tree.add(root)
                n, ids, last = n + 1, ids + k, doc
        if n:
            yield row(kind)

    return recipes.select("part", "doc", "row", "root", "n_tokens").repartition("part").sortWithinPartitions("part", "doc", "row").mapInArrow(fold, schema)


def read_store(spark: SparkSession, store: Store, keep_ids: bool = False) -> DataFrame:
    """Documents of a store: doc, start (ids of all before it), n_tokens, ids_crc32, and ids if kept.

    A chunk whose bytes don't have its digest, or a document whose chunks don't have its
    root, ends the job with an error.
    """
    recipes = spark.read.parquet(store.recipes)
    parts = spark.read.parquet(store.manifest).select("part", "ids")
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = parts.select("part", F.coalesce(F.sum("ids").over(earlier), F.lit(0)).alias("offset"))
    wanted = recipes.select("part", "doc", "row", "root", "before", F.posexplode("digests").alias("seq", "digest"))
    wanted = wanted.join(offsets, "part").select("doc", "row", "seq", "digest", F.when(F.col("seq") == 0, F.col("root")).alias("root"), (F.col("before") + F.col("offset")).alias("start"))
    wanted = wanted.withColumn("salt", F.pmod(F.xxhash64("row"), F.lit(SALTS)))
    files = chunks(spark, store)
    stored = files.where("data is not null").select(F.col("key").alias("digest"), "data")
    # Chunks with very many uses are few; their bytes go to every salt, and each use to one.
    uses = files.groupBy("digest").agg(F.count("*").alias("n")).where(F.col("n") > HOT_USES).select("digest")
    hot = written(uses, "store-hot")
    many = hot.count()
    if many:
        side = F.broadcast(hot) if many <= BROADCAST_DIGESTS else hot
        spread = stored.join(side, "digest", "left_semi").withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))))
        shared = wanted.join(side, "digest", "left_semi").join(spread, ["digest", "salt"])
        pieces = wanted.join(side, "digest", "left_anti").join(stored.hint("merge"), "digest").unionByName(shared)
    else:
        pieces = wanted.join(stored.hint("merge"), "digest")
    pieces = pieces.repartition("row").sortWithinPartitions("row", "seq")
    fields = [wanted.schema["doc"], T.StructField("start", T.LongType()), T.StructField("n_tokens", T.LongType()), T.StructField("ids_crc32", T.LongType())]
    schema = T.StructType(fields + [T.StructField("ids", T.ArrayType(T.IntegerType()))] * keep_ids)
    dtype = store.dtype

    def rebuild(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[list] = [[] for _ in schema.fields]
        kind = None
        at, doc, start, root, n, crc, tree, ids = None, None, 0, b"", 0, 0, Merkle(), []

        def close() -> None:
            if at is not None:
                if tree.root() != root:
                    raise ValueError(f"document {doc}: its chunks don't have its Merkle root")
                for column, x in zip(out, (doc, start, n, crc, np.concatenate(ids).tolist() if keep_ids else None), strict=False):
                    column.append(x)

        def batch_of() -> pa.RecordBatch:
            types = [kind, pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int32())]
            made = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, types, strict=False)], names=schema.fieldNames())
            for column in out:
                column.clear()
            return made

        for batch in batches:
            kind = batch.schema.field("doc").type
            for row, d, s, r, address, data in zip(*(batch.column(c).to_pylist() for c in ("row", "doc", "start", "root", "digest", "data")), strict=True):
                if row != at:
                    close()
                    at, doc, start, root, n, crc, tree, ids = row, d, s, r, 0, 0, Merkle(), []
                if digest(data) != address:
                    raise ValueError(f"chunk {address.hex()}: its bytes have changed")
                part = np.frombuffer(data, dtype=dtype).astype("<u4")
                n, crc = n + len(part), zlib.crc32(part.tobytes(), crc)
                tree.add(address)
                if keep_ids:
                    ids.append(part)
            if len(out[0]) >= 4096:
                yield batch_of()
        close()
        if kind is not None:
            yield batch_of()

    return pieces.select("row", "doc", "seq", "start", "root", "digest", "data").mapInArrow(rebuild, schema)


def manifest_root(spark: SparkSession, store: Store) -> bytes:
    """Root over the manifest's parts in order; a row per part reaches the driver, one at a time."""
    tree = Merkle()
    for r in spark.read.parquet(store.manifest).orderBy("part").select("root").toLocalIterator():
        tree.add(bytes(r["root"]))
    return tree.root()
