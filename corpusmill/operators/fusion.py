"""Fusing ranked lists. All of these work on limited lists."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

RRF_K, FETCH, LEAST_FETCH = 60, 3, 20


def candidates(limit: int) -> int:
    """How many of each list go into a fusion."""
    return max(FETCH * limit, LEAST_FETCH)


def reciprocal_ranks(lists: list[DataFrame], id_col: str) -> DataFrame:
    """(id, score) from lists of (id, rank): the sum of 1 / (60 + rank)."""
    every = reduce(DataFrame.union, [x.select(id_col, (F.lit(1.0) / (RRF_K + F.col("rank"))).alias("s")) for x in lists])
    return every.groupBy(id_col).agg(F.sum("s").alias("score"))


def hybrid(lists: list[DataFrame], rows: DataFrame, id_col: str, limit: int, order: list[str]) -> DataFrame:
    """rows in the order of their fused score, with score and distance = 1 / score; ties by order."""
    fused = reciprocal_ranks(lists, id_col).withColumn("distance", 1 / F.col("score"))
    return rows.join(fused, id_col).orderBy(F.desc("score"), *order).limit(limit)


def interleave(code: DataFrame, memory: DataFrame, limit: int) -> DataFrame:
    """Two lists with corpus_rank as one: by rank, code before memory; fused_rank, fused_score and type are added."""
    both = code.withColumn("type", F.lit("code")).unionByName(memory.withColumn("type", F.lit("memory")), allowMissingColumns=True)
    both = both.withColumn("fused_score", F.lit(1.0) / (RRF_K + F.col("corpus_rank"))).withColumn("fused_rank", F.row_number().over(Window.orderBy("corpus_rank", "type")))
    return both.filter(F.col("fused_rank") <= limit)


def merge_indexes(lists: list[DataFrame], key: list[str], limit: int, order: list[str]) -> DataFrame:
    """Results of several indexes, nearest first, one for each key; each list was fetched at merge_fetch(limit)."""
    every = reduce(lambda a, b: a.unionByName(b), [x.withColumn("_source", F.lit(i)) for i, x in enumerate(lists)])
    first = F.row_number().over(Window.partitionBy(*key).orderBy("distance", "_source", *order))
    return every.withColumn("_n", first).filter("_n = 1").drop("_n").orderBy("distance", "_source", *order).limit(limit).drop("_source")


def merge_fetch(limit: int) -> int:
    return max(2 * limit, limit + 10)


def appendix(fused: DataFrame, more: DataFrame, id_col: str, limit: int, order: list[str], type_name: str) -> DataFrame:
    """Unranked rows, not among the fused ones, for the end of a list."""
    unseen = more.join(fused.select(id_col), id_col, "left_anti").orderBy(*order).limit(limit)
    return unseen.withColumns({"type": F.lit(type_name), "fused_rank": F.lit(None).cast("int"), "fused_score": F.lit(None).cast("double"), "corpus_rank": F.lit(None).cast("int")})


def similarity(distance: Column, window) -> Column:
    """1 for the least distance of the window down to 0 for the greatest."""
    low, high = F.min(distance).over(window), F.max(distance).over(window)
    return 1 - (distance - low) / F.greatest(high - low, F.lit(1e-6))
