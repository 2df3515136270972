"""Shared helpers: reading tables, the cluster's shared folder, cutting lineage."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar
from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the input tables; the path may be in any store that Spark reads."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir, which driver and executors share.

    Only a local master may lack the setting (tests); it then gets a temporary
    folder of its own.  A cluster without the setting is an error.
    """
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


#: Folders named since the innermost scratch() began; None outside of one.
NAMED: ContextVar[list[str] | None] = ContextVar("named", default=None)


def fresh_path(spark: SparkSession, label: str) -> str:
    """A path in the shared folder that nothing has used."""
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    if (named := NAMED.get()) is not None:
        named.append(path)
    return path


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Remove the folders that fresh_path named inside the block when it ends; whatever reads them has to be written by then."""
    named: list[str] = []
    token = NAMED.set(named)
    try:
        yield
    finally:
        NAMED.reset(token)
        for path in named:
            remove(spark, path)


def written(df: DataFrame, label: str) -> DataFrame:
    """Write df to the shared folder and read it again: a lineage cut that survives lost executors."""
    spark = df.sparkSession
    path = fresh_path(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder that fresh_path named, in whichever store it is."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def location(df: DataFrame) -> str:
    """The folder that a frame made by written() reads."""
    return df.inputFiles()[0].rsplit("/", 1)[0] if df.inputFiles() else ""
