"""Places over many partitions."""

from pyspark.sql import functions as F

from corpusmill.operators.places import placed


def test_places_follow_the_order(spark):
    rows = spark.range(0, 5_000, 1, 16).select(((F.col("id") * 7919) % 5_000).alias("k"), F.lit("x").alias("_before"))
    adaptive = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")  # so that small partitions stay apart
    try:
        kept = placed(rows.orderBy("k"))
        assert rows.orderBy("k").rdd.getNumPartitions() > 1
        assert kept.filter("place != k + 1").count() == 0 and kept.count() == 5_000 and kept.columns == ["k", "_before", "place"]
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", adaptive)


def test_ties_and_no_rows(spark):
    ties = spark.createDataFrame([(1, "b"), (1, "a"), (None, "c")], "k int, v string").orderBy("k", "v")
    assert [(r.v, r.place) for r in placed(ties, "place").orderBy("place").collect()] == [("c", 1), ("a", 2), ("b", 3)]
    assert placed(ties.filter("k > 5")).count() == 0
