"""Raw documents to packed training sequences, stage by stage.

Each stage reads what the one before it wrote; the folders of a stage's own work are removed
once its result is written, and the result once the next stage has read it.

Cases, in every stage: a null text is an empty one; texts of any length are worked on whole;
rows without an id are kept like others, and rows that share an id are told apart by all
their columns; columns beyond those of documents are dropped, so none can clash; ties are
decided by id and then by a hash of the row; an empty table gives an empty result.  Rows
without any letter, and so all rows without a text, end at the first stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lamplight.llm import langid, line_dedup, mixing, packing, simhash_wide
from lamplight.llm.common import fresh_path, remove, scratch, table

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that have a language: the nearest of the learned ones; texts without letters, which have none, are rejected."""
    model = langid.fit(docs.where(~langid.held_out()))
    found = langid.predict(docs.select(*COLUMNS), model)
    return found.where("lang_pred <> 'und'").select(*COLUMNS)


def unique_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that an earlier document has; n_chars follows the text."""
    return line_dedup.dedup_lines(docs.select(*COLUMNS)).select("doc_id", "text", "lang", "source", F.length("text").cast("long").alias("n_chars"))


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group whose five-word shingles are similar by 0.8 or more.

    It is that of the smallest id.  Documents without an id come after those with one, and
    rows of one id are told apart by a hash of all their columns; equal rows are one.
    """
    rows = docs.select(*COLUMNS).withColumn("_row", F.sha2(F.to_json(F.struct(*COLUMNS)).cast("binary"), 256))
    classes = simhash_wide.similar_classes(rows, ["doc_id", "_row"], width=5, similarity=0.8)
    first = classes.groupBy("class").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "_row")).alias("first"))
    return rows.join(first.select("first._row"), "_row", "left_semi").dropDuplicates(["_row"]).select(*COLUMNS)


def target_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them."""
    return mixing.replicated(mixing.mix(docs.select(*COLUMNS))).select(*COLUMNS)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in sequences of 1024 tokens, with their ids."""
    return packing.pack(docs, keep_ids=True)


STAGES = [
    ("language", known_language),
    ("lines", unique_lines),
    ("near copies", one_of_each),
    ("mix", target_mix),
    ("pack", packed),
]

#: Language identification and SimHash can't be said in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each but the last written and read again."""
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        path = fresh_path(spark, f"pipeline-{name.replace(' ', '-')}")
        with scratch(spark):
            kept = stage(spark, docs, sf_dir)
            kept.write.parquet(path)
        if before:
            remove(spark, before)
        docs, before = spark.read.schema(kept.schema).parquet(path), path
    return STAGES[-1][1](spark, docs, sf_dir)
