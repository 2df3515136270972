"""Batches under limits, against a loop over the candidates."""

import random

from pyspark.sql import functions as F

from lamplight.operators import collection

SCHEMA = "id long, source string, good boolean, failed boolean, blocked boolean, top int"


def loop(rows, most):
    out, taken, errors, accepted = {}, {}, {}, 0
    for i, source, good, failed, blocked, top in sorted(rows):
        if accepted >= most:
            out[i] = "not_reached"
        elif taken.get(source, 0) >= top:
            out[i] = "over_limit"
        elif errors.get(source, 0) >= 2:
            out[i] = "source_stopped"
        elif blocked:
            out[i] = "blocked"
        elif failed:
            out[i], errors[source] = "failed", errors.get(source, 0) + 1
        elif good:
            out[i], taken[source], accepted = "accepted", taken.get(source, 0) + 1, accepted + 1
        else:
            out[i] = "rejected"
    return out


def test_like_a_loop(spark):
    rng = random.Random(8)
    for n, most in ((40, 5), (400, 60), (400, 10_000)):
        tops = {s: rng.randrange(1, 30) for s in ("a", "b", "c", None)}
        rows = []
        for i in range(n):
            s = rng.choice(["a", "a", "a", "b", "c", None])
            rows.append((i, s, rng.random() < 0.6, rng.choice([None, False, rng.random() < 0.1]), rng.random() < 0.1, tops[s]))
        df = spark.createDataFrame(rng.sample(rows, n), SCHEMA).withColumn("outcome", F.lit("clash"))
        found = collection.batch_outcomes(df, "id", "source", F.col("good"), F.col("failed"), F.col("blocked"), F.col("top"), most)
        assert {r.id: r.outcome for r in found.collect()} == loop(rows, most)


def test_nothing(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert collection.batch_outcomes(df, "id", "source", F.col("good"), F.col("failed"), F.col("blocked"), F.col("top"), 5).count() == 0
