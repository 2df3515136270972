"""One query for each operator over its whole table, with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lamplight.llm import bpe_count, chunk_store, html_text, langid, line_dedup, media, mixing, packing, periodic, private, ranked, simhash, sketch
from lamplight.llm.common import table


def op1_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(table(spark, sf_dir, "documents").select("doc_id", "text", "source"))
    return mixed.select("doc_id", "size", "source_size", "target", "taken")


def op2_pack_sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), capacity=1024, end_id=2)


def op3_count_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe_count.token_counts(table(spark, sf_dir, "documents").select("doc_id", "text"), limit=512)


def op4_extract_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract_main_text(table(spark, sf_dir, "pages").select("page_id", "url", "html"))


def op5_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sketch.fingerprint_edits(table(spark, sf_dir, "documents"))


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = langid.fit(docs.where(~langid.held_out()))
    found = langid.predict(docs.select("doc_id", "text"), model)
    return found.select("doc_id", langid.held_out().alias("held_out"), "lang_pred", "score", "ambiguous")


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"), width=3, radius=2)
    return found.select("doc_id", F.lower(F.lpad(F.hex("_fp"), 16, "0")).alias("fingerprint"), "component_id")


def op8_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = media.stored_media(table(spark, sf_dir, "documents"))
    return media.media_facts(files)


def op9_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    store = chunk_store.write_store(table(spark, sf_dir, "documents"))
    return chunk_store.read_store(spark, store).withColumnRenamed("doc", "doc_id")


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = line_dedup.dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return docs.select("doc_id", "n_lines", "n_dropped", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


def op11_private_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = private.personal_data(table(spark, sf_dir, "documents"))
    base = F.concat(*private.KINDS)
    counts = [F.size(kind).cast("long").alias(f"n_{kind}") for kind in private.KINDS]
    return found.select("doc_id", *counts, F.sha2(private.listed(base).cast("binary"), 256).alias("base_sha256"), private.listed(F.concat(base, "added")).alias("spans"))


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = periodic.with_planted_runs(table(spark, sf_dir, "documents").select("doc_id", "text"))
    found = periodic.with_runs(docs).withColumn("_best", periodic.strongest(F.col("runs")))
    return found.select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        "_best.*",
        F.expr("1000 * _best.length div _best.period").alias("exponent_milli"),
        F.sha2(periodic.described(F.col("runs")).cast("binary"), 256).alias("runs_sha256"),
        F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"),
    )


def op13_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked.ranked(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), k=10)


QUERIES = {f.__name__: f for f in (op1_mix_sources, op2_pack_sequences, op3_count_tokens, op4_extract_html, op5_fingerprints, op6_language_id, op7_simhash, op8_media, op9_token_store, op10_line_dedup, op11_private_data, op12_periodic_runs, op13_ranked_search)}
ORACLE_SQL = {"op1_mix_sources": mixing.ORACLE, "op10_line_dedup": line_dedup.ORACLE, "op13_ranked_search": ranked.ORACLE}
