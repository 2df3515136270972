"""Conversation memory as a stream: state per conversation, bounded history and summary."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from lamplight.sources import tables

STATE = T.StructType(
    [
        T.StructField("users", T.ArrayType(T.StringType())),
        T.StructField("answers", T.ArrayType(T.StringType())),
        T.StructField("summary", T.StringType()),
        T.StructField("evidence", T.ArrayType(T.StringType())),
        T.StructField("open", T.StringType()),
    ]
)
OUT = T.StructType([T.StructField("conv_id", T.LongType()), T.StructField("turn", T.LongType()), T.StructField("history", T.IntegerType()), T.StructField("summary", T.StringType()), T.StructField("evidence", T.ArrayType(T.StringType()))])
JOINT = "\n---\n"


def shortened(entries: list[str], limit: int) -> str:
    """Entries joined, the oldest dropped until they fit."""
    while entries and len(JOINT.join(entries)) > limit:
        entries.pop(0)
    return JOINT.join(entries)


def conversation_memory(turns: DataFrame, history: int = 8, limit: int = 800) -> DataFrame:
    """A row per finished exchange with the state after it.

    turns: conv_id, turn, role, text and, optionally, chunk_ids (those that retrieval gave).
    An exchange that leaves the history goes into the summary; only chunk ids are kept of
    evidence, never an answer's prose.  Turns of one batch are taken in order.
    """
    has_ids = "chunk_ids" in turns.columns
    rows = turns.select("conv_id", "turn", "role", "text", (F.col("chunk_ids") if has_ids else F.lit(None).cast("array<string>")).alias("chunk_ids"))

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        users, answers, summary, evidence, open_ = state.get if state.exists else ([], [], "", [], None)
        users, answers, evidence, out = list(users), list(answers), list(evidence), []
        for r in pd.concat(list(batches)).sort_values("turn").itertuples(index=False):
            if r.role == "user":
                open_ = r.text or ""
            elif r.role == "assistant" and open_ is not None:
                users.append(open_)
                answers.append(r.text or "")
                open_ = None
                if r.chunk_ids is not None and len(r.chunk_ids):
                    evidence = [*evidence, ",".join(r.chunk_ids)][-history:]
                if len(users) > history:
                    entry = f"[USER]\n{users.pop(0)}\n[ASSISTANT]\n{answers.pop(0)}"
                    summary = shortened([*filter(None, summary.split(JOINT)), entry], limit)
                out.append((key[0], r.turn, len(users), summary, evidence))
        state.update((users, answers, summary, evidence, open_))
        yield pd.DataFrame(out, columns=OUT.fieldNames())

    return rows.groupBy("conv_id").applyInPandasWithState(step, OUT, STATE, "append", GroupStateTimeout.NoTimeout)


def new_documents(spark: SparkSession, folder: str, schema: T.StructType, id_col: str = "document_id", delay: str = "1 day", time_col: str = "collected_at") -> DataFrame:
    """Documents that arrive as Parquet files, each id once within the delay, which bounds the state."""
    arriving = spark.readStream.schema(schema).option("maxFilesPerTrigger", 64).parquet(folder)
    return arriving.withWatermark(time_col, delay).dropDuplicatesWithinWatermark([id_col])


def upsert_sink(path: str, key: str, order: str | None = None, buckets: int = 64):
    """A foreachBatch writer of the newest row of each key; a repeated batch changes nothing.

    Keys are dealt to buckets, each a folder.  A batch rewrites the buckets that it touches
    and no others: their rows without the batch's keys, and the batch's rows, are written
    aside and then put in place of the old ones.  Of several rows of a key in a batch the
    last by `order` stays; without one, any.  A null key is a key like others.
    """

    def write(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        rows = batch.withColumn("bucket", F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int"))
        if order:
            carried = [c for c in rows.columns if c != key]
            newest = rows.groupBy(key).agg(F.max(F.struct(F.col(order).alias("_order"), F.struct(*carried).alias("_row"))).alias("_m"))
            rows = newest.select(key, "_m._row.*").select(*rows.columns)
        else:
            rows = rows.dropDuplicates([key])
        rows = tables.written(rows, "upsert-batch")
        touched = [r.bucket for r in rows.select("bucket").distinct().collect()]  # as many as buckets at most
        if not touched:
            return
        merged = rows
        folder = spark._jvm.org.apache.hadoop.fs.Path(path)
        if folder.getFileSystem(spark._jsc.hadoopConfiguration()).exists(folder):
            old = spark.read.schema(rows.schema).parquet(path).where(F.col("bucket").isin(touched)).select(*rows.columns)
            new_keys = rows.select(F.struct(key).alias("_key"))
            merged = old.join(new_keys, F.struct(F.col(key)).eqNullSafe(F.col("_key")), "left_anti").unionByName(rows)
        staged = tables.written(merged, "upsert-merged")
        staged.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(path)
        tables.removed(rows)
        tables.removed(staged)

    return write
