"""Reading tables and files, and writing them so that readers never see half of it."""

from __future__ import annotations

import json
import tempfile
import uuid
from collections.abc import Sequence
from functools import lru_cache

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lamplight.functions.udfs import decoded_body, flattened_json


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def scratch_folder(spark: SparkSession) -> str:
    """The shared folder that spark.checkpoint.dir names; a temporary one only for a local master without the setting."""
    sc = spark.sparkContext
    named = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    return own_folder(sc.applicationId)


@lru_cache
def own_folder(application: str) -> str:
    """One temporary folder for each local application."""
    return f"file://{tempfile.mkdtemp(prefix=f'lamplight-{application}-')}"


def written(df: DataFrame, label: str) -> DataFrame:
    """df, written to the shared folder and read again, which cuts its lineage."""
    path = f"{scratch_folder(df.sparkSession)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def removed(df: DataFrame) -> None:
    """Delete the folder that a frame made by written() reads; nothing may read it any more."""
    files = df.inputFiles()
    if files:
        path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(files[0].rsplit("/", 1)[0])
        path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def read_jsonl(spark: SparkSession, path: str | Sequence[str], schema: T.StructType | str, strict: bool = True) -> DataFrame:
    """A row per JSON line; blank lines are skipped, a malformed one ends the read if strict, else it is left out."""
    return spark.read.schema(schema).option("mode", "FAILFAST" if strict else "DROPMALFORMED").json(path)


def read_jsonl_with_marks(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """JSON lines that may begin with a byte order mark; lines that are no objects end the read."""
    lines = spark.read.text(path).select(F.regexp_replace("value", "^﻿", "").alias("value")).where(F.trim("value") != "")
    checked = F.when(F.ltrim("value").startswith("{"), F.col("value")).otherwise(F.raise_error(F.lit("a line is no JSON object")))
    return lines.select(F.from_json(checked, schema, {"mode": "FAILFAST"}).alias("r")).select("r.*")


def read_documents_json(spark: SparkSession, path: str, schema: T.StructType, language: str = "ko") -> DataFrame:
    """Documents of whole JSON files, a list or an object with a list `documents`; a missing language gets the default."""
    texts = spark.read.text(path, wholetext=True)
    listed = F.coalesce(F.get_json_object("value", "$.documents"), F.col("value"))
    rows = texts.select(F.explode(F.from_json(listed, T.ArrayType(schema))).alias("d")).select("d.*")
    return rows.withColumn("language", F.coalesce(F.nullif("language", F.lit("")), F.lit(language))) if "language" in schema.fieldNames() else rows


#: Suffixes of plain text files.
PLAIN = ("txt", "md", "markdown")


def read_text_files(spark: SparkSession, path: str) -> DataFrame:
    """(path, text) of plain text files in UTF-8; other suffixes and encodings end the read."""
    files = spark.read.format("binaryFile").load(path).select("path", "content")
    suffix = F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1))
    text = F.when(~suffix.isin(*PLAIN), F.raise_error(F.concat(F.lit("no text extractor for "), suffix))).when(
        ~F.is_valid_utf8(F.decode("content", "UTF-8")) | F.contains(F.decode("content", "UTF-8"), F.lit("�")), F.raise_error(F.lit("a file is not UTF-8"))
    )
    return files.select("path", text.otherwise(F.decode("content", "UTF-8")).alias("text"))


def read_pdf_files(spark: SparkSession, path: str) -> DataFrame:
    """(path, text) of PDF files, pages joined by an empty line; needs the optional pypdf."""
    try:
        import pypdf  # noqa: F401
    except ImportError as e:
        raise RuntimeError("reading PDF files needs pypdf") from e
    import pandas as pd

    @F.pandas_udf(T.StringType())
    def text(content: pd.Series) -> pd.Series:
        import io

        from pypdf import PdfReader

        return content.map(lambda b: "\n\n".join(p.extract_text() or "" for p in PdfReader(io.BytesIO(b)).pages))

    return spark.read.format("binaryFile").load(path).select("path", text("content").alias("text"))


def read_xml_records(spark: SparkSession, path: str, row_tag: str, schema: T.StructType, choices: dict[str, Sequence[str]]) -> DataFrame:
    """Records of XML files; each output column is the first non-empty of the listed fields."""
    rows = spark.read.format("xml").option("rowTag", row_tag).schema(schema).load(path)
    return rows.select(*[F.coalesce(*[F.nullif(F.trim(F.col(c)), F.lit("")) for c in names]).alias(out) for out, names in choices.items()])


def json_items(body: Column, path: str, item: T.StructType) -> Column:
    """Items of an API response, where a single one comes as an object and several as a list."""
    found = F.get_json_object(body, path)
    return F.when(F.ltrim(found).startswith("["), F.from_json(found, T.ArrayType(item))).otherwise(F.array(F.from_json(found, item)))


def payload_text(content: Column, media_type: Column) -> Column:
    """Plain text of an HTML, XML, JSON or CSV body, decoded as UTF-8 or else CP949."""
    body = decoded_body(content)
    tags = F.regexp_replace(F.regexp_replace(body, r"(?is)<(script|style)\b.*?</\1\s*>", " "), r"(?s)<[^>]+>", "\n")
    plain = F.trim(F.regexp_replace(tags, r"\s*\n\s*", "\n"))
    return F.when(media_type.contains("json"), flattened_json(body)).when(media_type.rlike("html|xml"), plain).when(media_type.contains("csv"), F.regexp_replace(body, r"[,\t]", "\n")).otherwise(body)


def append_rows(df: DataFrame, path: str) -> None:
    """Add audit rows; Spark's commit makes them visible all at once."""
    df.write.mode("append").parquet(path)


def write_report(df: DataFrame, path: str) -> None:
    """Write a report that must not exist yet."""
    df.coalesce(1).write.mode("errorifexists").json(path)


class Versions:
    """Versioned snapshots of a table in a folder, with a pointer to the current one.

    A snapshot is written whole, checked, and then pointed to; readers follow the pointer,
    so they see the old or the new version and nothing between.  Rollback moves the pointer.
    """

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")
        self._path = spark._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.folder).getFileSystem(spark._jsc.hadoopConfiguration())

    def _pointers(self) -> list[str]:
        found = self._fs.globStatus(self._path(f"{self.folder}/pointer-*.json")) or []
        return sorted(x.getPath().getName() for x in found)

    def state(self) -> dict:
        """What the newest pointer says."""
        names = self._pointers()
        if not names:
            return {"current": None, "versions": []}
        return json.loads(self.spark.read.text(f"{self.folder}/{names[-1]}", wholetext=True).first()["value"])

    def _point(self, state: dict) -> None:
        """Add a pointer: written aside, then renamed to a name that doesn't exist yet."""
        aside = self._path(f"{self.folder}/.aside-{uuid.uuid4().hex}")
        out = self._fs.create(aside, False)
        out.write(bytearray(json.dumps(state).encode()))
        out.close()
        if not self._fs.rename(aside, self._path(f"{self.folder}/pointer-{len(self._pointers()):08d}.json")):
            raise OSError("another writer has moved the pointer")

    def write(self, df: DataFrame, check=None) -> str:
        """Write a version and make it current, unless check(its frame) returns errors."""
        state = self.state()
        name = f"version={len(state['versions']) + 1:05d}"
        df.write.mode("errorifexists").parquet(f"{self.folder}/{name}")
        if check and (errors := check(self.spark.read.parquet(f"{self.folder}/{name}"))):
            raise ValueError(f"{name}: {errors}")
        self._point({"current": name, "versions": [*state["versions"], name]})
        return name

    def read(self, version: str | None = None) -> DataFrame:
        name = version or self.state()["current"]
        if not name:
            raise FileNotFoundError(f"{self.folder} has no version")
        return self.spark.read.parquet(f"{self.folder}/{name}")

    def rollback(self, version: str) -> None:
        state = self.state()
        if version not in state["versions"]:
            raise ValueError(f"no version {version}")
        self._point(state | {"current": version})


class Releases:
    """Several tables that change together, in a folder, with one manifest for all of them.

    Tables are written first, each to a folder of its own that nothing names yet; a release
    is one manifest with the folder of each table, its number of rows and a hash of them,
    moved to its place by one rename.  A writer that fails before that leaves the old
    release as it was.  Rollback is a new manifest that names an old release.
    """

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder, self.pointer = spark, folder.rstrip("/"), Versions(spark, folder)

    def state(self) -> dict:
        """The release in force (None before the first) and all there are, by their numbers."""
        found = self.pointer.state()
        return {"current": found["current"], "releases": found["versions"]}

    def current(self) -> dict | None:
        found = self.state()
        return None if found["current"] is None else found["releases"][found["current"]]

    def write(self, table_name: str, df: DataFrame) -> str:
        """Write a table's next content; no reader sees it before it is published."""
        place = f"{table_name}/{uuid.uuid4().hex}"
        df.write.mode("errorifexists").parquet(f"{self.folder}/{place}")
        return place

    def at(self, place: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{place}")

    def facts(self, place: str) -> dict:
        """Rows of a table and a hash that doesn't depend on their order."""
        df = self.at(place)
        row = F.xxhash64(F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false"}))
        n, total = df.agg(F.count("*"), F.coalesce(F.sum(row.cast("decimal(38,0)")), F.lit(0))).first()
        return {"place": place, "rows": n, "hash": str(total)}

    def publish(self, places: dict[str, str], check=None, **notes) -> dict:
        """Make the tables at these places the release in force, unless check(frames by name) returns errors."""
        if check and (errors := check({name: self.at(place) for name, place in places.items()})):
            raise ValueError(f"not published: {errors}")
        state = self.state()
        release = {"tables": {name: self.facts(place) for name, place in places.items()}, **notes}
        self.pointer._point({"current": len(state["releases"]), "versions": [*state["releases"], release]})
        return release

    def read(self, table_name: str) -> DataFrame:
        if (release := self.current()) is None:
            raise FileNotFoundError(f"{self.folder} has no release")
        return self.at(release["tables"][table_name]["place"])

    def differences(self) -> list[str]:
        """Names of the tables whose rows aren't those that the manifest describes."""
        release = self.current() or {"tables": {}}
        return [name for name, facts in release["tables"].items() if self.facts(facts["place"]) != facts]

    def rollback(self, number: int) -> None:
        state = self.state()
        if not 0 <= number < len(state["releases"]):
            raise ValueError(f"no release {number}")
        self.pointer._point({"current": number, "versions": state["releases"]})
