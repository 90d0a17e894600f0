"""Spans that overlap and neighbours of many queries, against plain loops."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusmill.operators import ranges
from corpusmill.operators import vectors as V

SPAN = "id int, file string, start_line int, end_line int"


def spans(rng, n, far):
    return [(i, rng.choice(["f", "g", "hot"]), s := rng.randrange(-far, far), s + int(2 ** rng.uniform(0, math.log2(far))) - rng.choice([0, 1, 3])) for i in range(n)]


@pytest.mark.parametrize("far", [8, 500, 100_000])
def test_overlaps(spark, far):
    rng = random.Random(far)
    a = spans(rng, 150, far) + [(900, None, 1, 2), (901, "f", None, 3), (902, "f", 3, None), (903, "f", 5, 4), (904, "f", 4, 4)]
    b = spans(rng, 120, far) + [(900, None, 1, 2), (904, "f", 4, 4), (905, "f", -(2**31), 2**31 - 1)]
    fit = lambda rows: [r for r in rows if None not in r and r[2] <= r[3]]
    want = sorted((x[0], y[0]) for x in fit(a) for y in fit(b) if x[1] == y[1] and x[2] <= y[3] and y[2] <= x[3])
    got = ranges.overlapping(spark.createDataFrame(a, SPAN), spark.createDataFrame(b, SPAN), ["file"]).select("a.id", F.col("b.id").alias("other")).collect()
    assert sorted(map(tuple, got)) == want


def test_rows_of_a_span_are_few(spark):
    """However long a span is, it goes to no more bins than twice the levels; and a file of many spans has many keys."""
    df = spark.range(3000).selectExpr("id", "'one' AS file", "id * 10 AS start_line", "id * 10 + CASE WHEN id % 100 = 0 THEN 20000 ELSE 5 END AS end_line")
    binned = ranges._binned(df, ["file"], "start_line", "end_line", [3, 15], "a")
    assert binned.groupBy("a.id").count().agg(F.max("count")).first()[0] <= 4
    assert binned.select("_on0", "level", "bin").distinct().count() > 1000
    assert ranges.overlapping(df.limit(0), df, ["file"]).count() == 0


@pytest.mark.parametrize("int8", [False, True])
def test_knn_many(spark, int8):
    rng = np.random.default_rng(4)
    base = [(i, rng.uniform(-1, 1, 6).round(2).tolist()) for i in range(200)]
    base += [(300, None), (301, [1.0]), (302, [math.nan] * 6), (None, base[0][1]), (303, base[0][1]), (304, base[0][1])]
    asking = [(i, v) for i, v in base[:20]] + [(77, [1.0]), (78, None), (79, [1.0, 2.0])]
    quant = lambda v: [max(-127, min(127, math.floor(abs(x) * 127 + 0.5) * (1 if x >= 0 else -1))) for x in v] if int8 else v
    want = []
    for q, v in asking:
        near = sorted((sum((x - y) ** 2 for x, y in zip(quant(v), quant(w), strict=True)), i) for i, w in base if v and w and i is not None and len(v) == len(w) and not any(map(math.isnan, w)))[:7] if v else []
        want += [(q, r + 1, i, round(math.sqrt(d) / (127 if int8 else 1), 9)) for r, (d, i) in enumerate(near)]
    df = spark.createDataFrame(base, "id long, embedding array<double>").repartition(5)
    queries = spark.createDataFrame(asking, "query_id int, embedding array<double>")
    got = V.knn_many(df, queries, 7, "id", int8=int8).collect()
    assert sorted((r["query_id"], r["rank"], r["id"], round(r["distance"], 9)) for r in got) == sorted(want)
    if int8:
        one = V.knn_int8(df.filter("id < 200").withColumn("embedding", V.quantise(F.col("embedding"))), base[3][1], 5, ["id"]).collect()
        many = V.knn_many(df.filter("id < 200"), queries.filter("query_id = 3"), 5, "id", int8=True).collect()
        assert [(r["id"], r["distance"]) for r in one] == [(r["id"], r["distance"]) for r in many]


def test_knn_many_bounds(spark, monkeypatch):
    monkeypatch.setattr(V, "MAX_QUERIES", 3)
    df = spark.createDataFrame([(i, [1.0]) for i in range(4)], "id long, embedding array<double>")
    with pytest.raises(ValueError):
        V.knn_many(df, df.withColumnRenamed("id", "query_id"), 2, "id")
    assert V.knn_many(df, df.withColumnRenamed("id", "query_id").limit(0), 2, "id").count() == 0
