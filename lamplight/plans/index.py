"""A searchable index in a folder: built once, searched by batches of queries.

Chunks and vectors are released together by one manifest; a search reads what it names.
Features and vectors are stored, so that a search starts from them and not from texts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lamplight.functions import text as X
from lamplight.operators import chunking, evidence, lifecycle, search
from lamplight.sources.tables import Releases


class CorpusIndex:
    """chunks, sparse vectors and their settings under one folder."""

    def __init__(self, spark: SparkSession, folder: str, profile: X.Profile = X.KOREAN, dimension: int = 384, model: str = "hashing-v1"):
        self.spark, self.profile, self.dimension, self.model = spark, profile, dimension, model
        self.releases = Releases(spark, folder)

    def build(self, docs: DataFrame, size: int = 500, overlap: int = 50) -> dict:
        """Chunk (document_id, title, text), keep each text once per document, encode what isn't stored yet, and publish both tables."""
        cut = chunking.fixed_chunks(docs, "document_id", "text", size, overlap)
        rows = cut.join(docs.select("document_id", "title"), "document_id").withColumn("content_sha256", F.sha2(F.col("text").cast("binary"), 256))
        rows = lifecycle.build_dedup(rows)
        body = F.concat_ws(" ", "title", "text")
        rows = rows.withColumns({"tokens": X.tokenize(body), "body": body})
        chunks = self.releases.write("chunks", rows.drop("body"))
        current = self.releases.at(chunks)
        keys = ["chunk_id", "content_sha256"]
        stored = self.releases.read("vectors") if self.releases.current() else None
        pending = current.select(*keys, body.alias("text"))
        if stored is not None:
            pending = pending.join(stored.where((F.col("model") == self.model) & (F.col("dimension") == self.dimension)).select(*keys).distinct(), keys, "left_anti")
        made = search.hashed_vectors(pending, self.dimension).join(pending.select(*keys), "chunk_id").select(*keys, "slot", "weight", F.lit(self.model).alias("model"), F.lit(self.dimension).alias("dimension"))
        if stored is not None:
            made = made.unionByName(stored.join(current.select(*keys), keys, "left_semi").where((F.col("model") == self.model) & (F.col("dimension") == self.dimension)))
        vectors = self.releases.write("vectors", made)
        self.releases.publish({"chunks": chunks, "vectors": vectors}, self.faults, documents=current.select("document_id").distinct().count(), model=self.model, dimension=self.dimension)
        return self.status()

    def faults(self, tables: dict[str, DataFrame]) -> list[str]:
        """What keeps chunks and vectors from being searched together."""
        chunks, vectors = tables["chunks"], tables["vectors"]
        keys = ["chunk_id", "content_sha256"]
        found = {
            "no_chunks": chunks.limit(1).count() == 0,
            "repeated_chunk_id": chunks.groupBy("chunk_id").count().where("count > 1").limit(1).count() > 0,
            "model_or_dimension": vectors.where((F.col("model") != self.model) | (F.col("dimension") != self.dimension) | (F.col("slot") >= self.dimension)).limit(1).count() > 0,
            "vectors_of_other_chunks": vectors.select(*keys).distinct().join(chunks, keys, "left_anti").limit(1).count() > 0,
            "vector_not_finite": vectors.where(F.col("weight").isNull() | F.isnan("weight") | (F.abs("weight") > 1.000001)).limit(1).count() > 0,
        }
        return [name for name, bad in found.items() if bad]

    def status(self, verify: bool = False) -> dict:
        """What the manifest says; `errors` names what keeps the index from being searched.

        With verify, the tables are read and compared with the manifest, and checked again.
        """
        release = self.releases.current()
        if release is None:
            return {"ready": False, "errors": ["no_index"]}
        errors = [] if (release["model"], release["dimension"]) == (self.model, self.dimension) else ["model_or_dimension"]
        if verify:
            errors += [f"{name}_differ" for name in self.releases.differences()]
            errors += [e for e in self.faults({name: self.releases.read(name) for name in ("chunks", "vectors")}) if e not in errors]
        return {"ready": not errors, "errors": errors, "release": self.releases.state()["current"], "chunks": release["tables"]["chunks"]["rows"], "documents": release["documents"]}

    def search(self, queries: DataFrame, candidates: int = 12, **limits) -> DataFrame:
        """(query_id, document_id, chunk_id, score, rank, text) of queries (query_id, text); nothing from an index that isn't ready."""
        if not self.status()["ready"]:
            return self.spark.createDataFrame([], "query_id long, document_id long, chunk_id string, score double, rank int, text string")
        asked = queries.select("query_id", F.when(X.blank(F.col("text")), F.raise_error(F.lit("an empty query")).cast("string")).otherwise(F.col("text")).alias("text"))
        chunks = self.releases.read("chunks")
        wanted = asked.select("query_id", X.informative_tokens(F.col("text"), self.profile).alias("tokens"))
        sparse = search.bm25(chunks.select("chunk_id", "tokens"), wanted, candidates)
        dense = search.hashed_search(self.releases.read("vectors").select("chunk_id", "slot", "weight"), search.hashed_vectors(asked, self.dimension, "query_id"), candidates)
        fused = search.reciprocal_rank_fusion(dense, sparse).join(chunks.select("chunk_id", "document_id", "tokens", "text"), "chunk_id")
        known = fused.join(search.small(wanted.withColumnRenamed("tokens", "_asked")), "query_id")
        found = search.thresholds(known, F.arrays_overlap("tokens", "_asked"), **limits)
        return found.select("query_id", "document_id", "chunk_id", "score", "rank", "text")

    def cite(self, found: DataFrame) -> DataFrame:
        return evidence.citations(found)

    def rollback(self, release: int) -> None:
        """Put an older release in force, both tables at once."""
        self.releases.rollback(release)
