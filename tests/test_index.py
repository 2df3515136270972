"""Ingestion and the stored index from end to end."""

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T
from test_operators import GOOD

from lamplight.functions import text as X
from lamplight.operators import ingestion
from lamplight.plans.index import CorpusIndex


def test_cleaning_logs_what_it_did(spark):
    df = spark.createDataFrame([(1, "é  x \r\n12\n\n\n\nend"), (2, "clean")], "id int, text string")
    got = {r.id: (r.text_clean, r.cleaning_log) for r in ingestion.cleaned(df).collect()}
    assert got[1] == ("é x\n\nend", ["nfc", "line_ends", "spaces", "page_numbers", "blank_lines"]) and got[2] == ("clean", [])
    shout = ingestion.cleaned(df, removers=[("end", lambda t: F.replace(t, F.lit("end"), F.lit("")))]).where("id = 1").first()
    assert "end" in shout.cleaning_log and shout.text_clean == "é x"


def sources(spark, *changes):
    return spark.createDataFrame([T.Row(**(GOOD | {"document_id": f"d{i}"} | c)) for i, c in enumerate(changes)])


def test_from_registration_to_index(spark):
    rows = sources(spark, {}, {"copyright_status": "unknown", "allowed_for_rag": False}, {"title": ""}, {"review_status": "metadata_added", "reviewed_by": "", "reviewed_at": "", "verification_notes": ""})
    texts = spark.createDataFrame([(f"d{i}", f"Body of document {i}.\n\nBody of document {i}.\n\nSecond.") for i in range(4)], "document_id string, text string")
    decisions = spark.createDataFrame([("d3", "approve", "kim", "2024-05-05", "read"), ("d0", "reject", "", "", "")], "document_id string, decision string, reviewer string, decided_at string, notes string")
    after, audit = ingestion.reviewed(rows, decisions)
    assert {r.document_id: r.review_status for r in after.collect()}["d3"] == "reviewed" and [r.document_id for r in audit.collect()] == ["d3"]
    chunks = ingestion.processed(after, texts, 40, 0)
    assert {r.document_id for r in chunks.select("document_id").distinct().collect()} == {"d0", "d1", "d3"}
    good, bad = ingestion.eligible(chunks)
    assert {r.document_id: r.reasons for r in bad.collect()} == {"d1": ["allowed_for_rag=false", "copyright_status=unknown"]}
    empty = spark.createDataFrame([], "document_id string, chunk_count long, state_hash string")
    none = spark.createDataFrame([], "document_id string, removed_at string, reason string")
    made = ingestion.prepared(chunks, empty, none, "now")
    assert {r.document_id: r.chunk_count for r in made["state"].collect()} == {"d0": 2, "d3": 2}
    again = ingestion.prepared(chunks.where("document_id <> 'd3'"), made["state"], none, "later")
    assert {r.document_id: r.change for r in again["changes"].collect()} == {"d0": "unchanged", "d3": "removed"} and [r.document_id for r in again["tombstones"].collect()] == ["d3"]


def test_lanes(spark):
    row = GOOD | dict(active=True, data_classification="real", development_only=False, text="x")
    df = spark.createDataFrame([T.Row(**row), T.Row(**(row | {"data_classification": "fictional_fixture", "active": False}))])
    assert [r.e for r in df.select(ingestion.lane_errors("index_ready").alias("e")).collect()] == [[], ["inactive", "fixture"]]
    assert df.select(ingestion.lane_errors("fixture", "NOTICE").alias("e")).first().e == ["no_fixture", "no_notice"]
    with pytest.raises(ValueError):
        ingestion.lane_errors("other")


def test_index(spark, folder, tmp_path):
    docs = spark.read.parquet(f"{folder}/documents.parquet").where("doc_id < 60").select(F.col("doc_id").alias("document_id"), F.lit("").alias("title"), "text")
    index = CorpusIndex(spark, f"file://{tmp_path}/index", X.SAMPLE)
    assert index.status() == {"ready": False, "errors": ["no_index"]}
    assert index.search(spark.createDataFrame([(1, "x")], "query_id long, text string")).count() == 0
    first = index.build(docs.where("document_id < 40"))
    assert first["ready"] and first["documents"] == 40
    wanted = docs.where("document_id = 50").first().text[:200]
    asked = spark.createDataFrame([(1, wanted)], "query_id long, text string")
    before = {r.document_id for r in index.search(asked).collect()}
    assert 50 not in before
    second = index.build(docs)
    assert second["documents"] == docs.count()
    found = index.search(asked).orderBy("rank").collect()
    assert found[0].document_id == 50 and len(found) <= 5 and index.cite(index.search(asked)).count() == len({r.document_id for r in found})
    assert second["release"] == 1 and index.status(verify=True)["errors"] == []
    index.rollback(0)
    assert index.status()["documents"] == 40 and 50 not in {r.document_id for r in index.search(asked).collect()}
    assert CorpusIndex(spark, f"file://{tmp_path}/index", X.SAMPLE, dimension=64).status()["errors"] == ["model_or_dimension"]
    with pytest.raises(Exception, match="an empty query"):
        index.search(spark.createDataFrame([(1, " ")], "query_id long, text string")).collect()


def test_a_build_that_fails_between_its_tables_leaves_the_old_release(spark, folder, tmp_path, monkeypatch):
    docs = spark.read.parquet(f"{folder}/documents.parquet").where("doc_id < 30").select(F.col("doc_id").alias("document_id"), F.lit("").alias("title"), "text")
    index = CorpusIndex(spark, f"file://{tmp_path}/index", X.SAMPLE)
    index.build(docs.where("document_id < 10"))
    write = index.releases.write

    def broken(name, df):
        if name == "vectors":
            raise OSError("no space")
        return write(name, df)

    monkeypatch.setattr(index.releases, "write", broken)
    with pytest.raises(OSError, match="no space"):
        index.build(docs)
    monkeypatch.undo()
    again = CorpusIndex(spark, f"file://{tmp_path}/index", X.SAMPLE)
    assert again.status(verify=True) == {"ready": True, "errors": [], "release": 0, "chunks": again.releases.read("chunks").count(), "documents": 10}
    with pytest.raises(ValueError, match="no_chunks"):
        again.build(docs.where("document_id < 0"))
    assert again.status()["documents"] == 10
    with pytest.raises(ValueError):
        again.rollback(7)
    # Rows that aren't those of the manifest are noticed.
    place = again.releases.current()["tables"]["vectors"]["place"]
    again.releases.at(place).limit(1).write.mode("append").parquet(f"{again.releases.folder}/{place}")
    assert "vectors_differ" in again.status(verify=True)["errors"]
