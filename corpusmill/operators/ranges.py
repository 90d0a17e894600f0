"""Joins of spans by overlap, dealt into bins of many widths.

A span of n places has the level k with 2^k >= n, and lies in one or two bins of that width. Of two spans that overlap the shorter one lies in one or two bins of the longer one's width too, so a span goes to its bins at its own level and at each higher level
that the other side has, of which there are as many as lengths double, and not more however long a span is. A pair is reported in the one bin where the later of the two starts at that level. The key is the group, the level and the bin, so
a group with a million spans is many tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def level_of(start: Column, end: Column) -> Column:
    """The least k with 2^k >= end - start + 1."""
    last = end.cast("long") - start.cast("long")
    return F.when(last == 0, 0).otherwise(F.length(F.bin(last))).cast("int")


def _binned(spans: DataFrame, on: list[str], start: str, end: str, levels: list[int], name: str) -> DataFrame:
    s, e = F.col(start).cast("long"), F.col(end).cast("long")
    rows = spans.filter((s <= e) & F.expr(" and ".join(f"`{c}` is not null" for c in on))).select(F.struct("*").alias(name), *[F.col(c).alias(f"_on{i}") for i, c in enumerate(on)], s.alias("s"), e.alias("e"), level_of(s, e).alias("own"))
    # its own level and all higher ones of the other side, the bins from its start's to its end's
    at = F.array_union(F.array(F.col("own")), F.filter(F.array(*[F.lit(x) for x in levels]).cast("array<int>"), lambda x: x > F.col("own")))
    each = rows.withColumn("level", F.explode(at)).withColumn("first", F.call_function("shiftright", F.col("s"), F.col("level"))).withColumn("last", F.call_function("shiftright", F.col("e"), F.col("level")))
    return each.withColumn("bin", F.explode(F.sequence("first", "last"))).select(name, *[f"_on{i}" for i in range(len(on))], "level", "bin", F.col("s").alias(f"{name}_s"), F.col("e").alias(f"{name}_e"), (F.col("own") == F.col("level")).alias(f"{name}_own"), F.col("first").alias(f"{name}_first"))


def overlapping(a: DataFrame, b: DataFrame, on: list[str], start: str = "start_line", end: str = "end_line") -> DataFrame:
    """(a, b): every pair of rows, as structs, with equal non-null ``on`` whose spans (ends included) share a place; each pair once. Spans with a null, or that end before they start, have no partner."""
    levels = [sorted(r[0] for r in x.filter(F.col(start) <= F.col(end)).select(level_of(F.col(start), F.col(end))).distinct().collect()) for x in (a, b)]  # 64 at most
    left, right = _binned(a, on, start, end, levels[1], "a"), _binned(b, on, start, end, levels[0], "b")
    met = left.join(right, [*[f"_on{i}" for i in range(len(on))], "level", "bin"])
    one = (F.col("a_own") | F.col("b_own")) & (F.col("bin") == F.greatest("a_first", "b_first")) & (F.col("a_s") <= F.col("b_e")) & (F.col("b_s") <= F.col("a_e"))
    return met.filter(one).select("a", "b")
