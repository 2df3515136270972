"""Mixing against the SQL of one order per source, and its edge cases."""

import duckdb
import pytest
from compare import rows
from pyspark.sql import functions as F

from lamplight.llm import mixing

COLUMNS = ["doc_id", "size", "source_size", "target", "taken"]


def test_same_rows_as_sql(docs, duck):
    assert rows(mixing.mix(docs).select(*COLUMNS).toPandas()) == rows(duck.sql(mixing.ORACLE).df())


def test_odd_rows(odd):
    clash = odd.withColumn("size", F.lit("x")).withColumn("target", F.lit(1))
    out = mixing.mix(clash).toPandas()
    con = duckdb.connect()
    con.register("documents", odd.toPandas())
    assert rows(out[COLUMNS]) == rows(con.sql(mixing.ORACLE).df())
    assert (out.taken <= 3 * out["size"]).all() and (out[out["size"] == 0].taken == 0).all()


def water_filling(sizes, weights, cap):
    """Shares by weight, the excess over the caps shared again until none is above."""
    total, target, free = sum(sizes.values()), dict.fromkeys(sizes, 0.0), set(sizes)
    left = float(total)
    while left > 1e-9 and free:
        w = sum(weights[s] for s in free)
        share = {s: left * weights[s] / w for s in free}
        left = 0.0
        for s in list(free):
            target[s] += share[s]
            if target[s] >= cap * sizes[s]:
                left += target[s] - cap * sizes[s]
                target[s] = float(cap * sizes[s])
                free.discard(s)
    return target


@pytest.mark.parametrize("sizes", [{"a": 10, "b": 1000, "c": 1}, {"x": 5}, {"p": 0, "q": 7}, {"a": 1, "b": 2, "c": 3, "d": 4000, "e": 5}])
def test_targets_are_those_of_repeated_sharing(spark, sizes):
    found = mixing.source_targets(spark.createDataFrame(list(sizes.items()), "source string, source_size long"), (1.0, 2.0, 3.0), 3)
    weights = {s: float(i % 3 + 1) for i, s in enumerate(sorted(sizes))}
    want = water_filling(sizes, weights, 3)
    assert {r.source: pytest.approx(r.target) for r in found.collect()} == want


def test_targets_are_met(docs):
    out = mixing.mix(docs).groupBy("source").agg(F.first("target").alias("t"), F.sum("taken").alias("k"), F.max("size").alias("m")).collect()
    assert all(abs(r.k - r.t) <= r.m for r in out)


def test_rows_are_repeated_as_taken(docs):
    mixed = mixing.mix(docs)
    assert mixing.replicated(mixed).count() == mixed.agg(F.sum("copies")).first()[0]


def test_importance_favours_rows(docs):
    odds = F.when(F.col("doc_id") % 2 == 0, 50.0).otherwise(1.0)
    taken = {r.even: r.share for r in mixing.mix(docs, weights=(1.0, 1.0, 4.0), importance=odds).where("target < source_size").groupBy((F.col("doc_id") % 2 == 0).alias("even")).agg((F.sum("taken") / F.sum("size")).alias("share")).collect()}
    assert taken[True] > taken[False]


def test_empty(nothing):
    assert mixing.mix(nothing).count() == 0
