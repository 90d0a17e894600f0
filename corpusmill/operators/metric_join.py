"""Similarity join of vectors by Euclidean distance, pruned by pivots and exact.

Vectors are partitioned by their nearest pivot, a vector of a bounded sample. By the triangle inequality an asking vector has partners only in cells whose pivot is no further than the cell's radius and the
distance asked for, and no further than twice that distance beyond its own nearest pivot; it is sent to these. In a cell, only those are compared whose distances to the pivot differ by no more than the
distance asked for. Cells are cut into parts of bounded size, so a block (a project, say) or a cell with a great share of the rows is many tasks; each task gives the best few of each asking vector, and those are merged.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

PART, CELL, MAX_PIVOTS, PIVOT_BYTES, STRIP = 4096, 1024, 1024, 8 << 20, 128
#: Allowance for rounding: what distances leave open may be too much by it, never too little.
SLACK = 1e-6


def choose_pivots(sample: np.ndarray, most: int, apart: float) -> np.ndarray:
    """Up to so many vectors of the sample, in its order, at least so far apart."""
    chosen = np.empty((0, sample.shape[1]))
    for x in sample:
        if len(chosen) == most:
            break
        if not len(chosen) or ((chosen - x) ** 2).sum(1).min() >= apart * apart:
            chosen = np.vstack([chosen, x])
    return chosen


def distances(x: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    """Of each vector to each pivot; squares come from the products, so they err by rounding, which SLACK covers."""
    squares = (x * x).sum(1)[:, None] + (pivots * pivots).sum(1)[None] - 2 * x @ pivots.T
    return np.sqrt(np.maximum(squares, 0))


def _matrix(column: pa.Array, rows: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(rows, -1)


def best_in_part(asking: np.ndarray, asking_at: np.ndarray, x: np.ndarray, x_at: np.ndarray, ids: np.ndarray, asking_ids: np.ndarray, radius: float, k: int) -> tuple[list[tuple[int, int, float]], int]:
    """((asking row, row, distance) of the k nearest within the radius for each asking row, ties by id, but not those with its own id; how many pairs were compared).

    *_at are distances to the pivot.
    """
    order, found, compared = np.argsort(x_at, kind="stable"), [], 0
    x, x_at, ids, rows = x[order], x_at[order], ids[order], order
    slack = SLACK * (1 + radius)
    by_at = np.argsort(asking_at, kind="stable")
    for s in range(0, len(by_at), STRIP):
        strip = by_at[s : s + STRIP]
        lo = np.searchsorted(x_at, asking_at[strip[0]] - radius - slack)
        hi = np.searchsorted(x_at, asking_at[strip[-1]] + radius + slack, side="right")
        if lo == hi:
            continue
        near = distances(asking[strip], x[lo:hi])
        compared += near.size
        for i, q in enumerate(strip.tolist()):
            at = np.flatnonzero(near[i] <= radius + slack)
            at = at[ids[lo + at] != asking_ids[q]]
            if len(at) > k:
                at = at[near[i][at] <= np.partition(near[i][at], k - 1)[k - 1] + slack]
            if len(at):
                exact = np.sqrt(((x[lo + at] - asking[q]) ** 2).sum(1))
                for j in sorted(np.flatnonzero(exact <= radius).tolist(), key=lambda j: (exact[j], ids[lo + at[j]]))[:k]:
                    found.append((q, int(rows[lo + at[j]]), float(exact[j])))
    return found, compared


def joined(asking: DataFrame, notes: DataFrame, id_col: str, vector_col: str, block: str, radius: float, k: int, part: int = PART, cell: int = CELL) -> DataFrame:
    """(asking, other, distance, compared): for each asking row up to k nearest of each part it was sent to; rows without an id say how many pairs a task compared."""
    kind, key = notes.schema[id_col].dataType, notes.schema[block].dataType
    shaped = lambda df: df.select(F.col(block).alias("block"), F.col(id_col).alias("id"), F.col(vector_col).cast("array<double>").alias("v")).filter("block is not null and id is not null and v is not null and size(v) > 0 and not exists(v, x -> x is null or isnan(x))")
    rows, asks = shaped(notes), shaped(asking)
    width = rows.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").first()
    if width is None:
        return notes.sparkSession.createDataFrame([], f"asking {kind.simpleString()}, other {kind.simpleString()}, distance double, compared long")
    most = max(1, min(-(-width["count"] // cell), MAX_PIVOTS, PIVOT_BYTES // (8 * width["n"])))
    share = min(1.0, 8 * most / width["count"])
    sample = rows.filter(F.size("v") == width["n"]).select("v", F.xxhash64("v").alias("h")).filter(F.pmod("h", F.lit(1 << 30)) <= int(share * (1 << 30))).orderBy("h").limit(4 * most).select("v").collect()
    pivots = choose_pivots(np.array([r["v"] for r in sample]), most, radius)

    def by_length(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, pa.RecordBatch]]:
        for batch in batches:
            lengths = batch.column(2).value_lengths().to_numpy()
            for n in np.unique(lengths).tolist():
                few = batch.filter(pa.array(lengths == n)) if (lengths != n).any() else batch
                yield from ((n, few.slice(s, 1024)) for s in range(0, few.num_rows, 1024))

    def placed_in(few: pa.RecordBatch, i: np.ndarray, cell: np.ndarray, at: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([*(c.take(pa.array(i)) for c in few.columns), pa.array(cell.astype(np.int32)), pa.array(at)], ["block", "id", "v", "cell", "at"])

    def home(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Each row in the cell of its nearest pivot; vectors of another length than the pivots' are a cell of their own, minus the length."""
        for n, few in by_length(batches):
            every = np.arange(few.num_rows)
            d = distances(_matrix(few.column(2), few.num_rows), pivots) if n == width["n"] else np.zeros((few.num_rows, 1))
            at = d.argmin(1)
            yield placed_in(few, every, at if n == width["n"] else np.full(few.num_rows, -n), d[every, at])

    def visits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Each asking row once for each cell that its distances to the pivots leave open."""
        for n, few in by_length(batches):
            d = distances(_matrix(few.column(2), few.num_rows), pivots) if n == width["n"] else np.zeros((few.num_rows, 1))
            i, j = np.nonzero(d <= d.min(1, keepdims=True) + 2 * radius + SLACK * (1 + radius))
            yield placed_in(few, i, j if n == width["n"] else np.full(len(i), -n), d[i, j])

    schema = f"block {key.simpleString()}, id {kind.simpleString()}, v array<double>, cell int, at double"
    placed = rows.mapInArrow(home, schema)
    cells = placed.groupBy("block", "cell").agg(F.count("*").alias("n"), F.max("at").alias("extent"))
    sent = asks.mapInArrow(visits, schema).join(cells, ["block", "cell"]).filter(F.col("at") <= F.col("extent") + radius + SLACK * (1 + radius))
    asked = sent.groupBy("block", "cell").agg(F.count("*").alias("m"))
    sizes = cells.join(asked, ["block", "cell"]).select("block", "cell", F.ceil(F.col("n") / part).cast("int").alias("parts"), F.ceil(F.col("m") / part).cast("int").alias("asked"))
    own = lambda c: F.pmod(F.xxhash64("id"), F.col(c)).cast("int")
    every = lambda c: F.explode(F.sequence(F.lit(0), F.col(c) - 1))
    columns = ["block", "cell", "id", "v", "at"]
    here = placed.join(sizes, ["block", "cell"]).select(*columns, F.lit(False).alias("asks"), own("parts").alias("part"), every("asked").alias("turn"))
    there = sent.select(*columns).join(sizes, ["block", "cell"]).select(*columns, F.lit(True).alias("asks"), own("asked").alias("turn"), every("parts").alias("part"))

    def join(table: pa.Table) -> pa.Table:
        asks, at, ids = table.column("asks").to_numpy(), table.column("at").to_numpy(), np.array(table.column("id").to_pylist())
        v = _matrix(table.column("v").combine_chunks(), table.num_rows)
        a, b = np.flatnonzero(asks), np.flatnonzero(~asks)
        found, compared = best_in_part(v[a], at[a], v[b], at[b], ids[b], ids[a], radius, k) if len(a) and len(b) else ([], 0)
        of = table.column("id").combine_chunks()
        take = lambda places: of.take(pa.array(places, pa.int64()))
        left, right = take([*(a[q] for q, _, _ in found), None]), take([*(b[r] for _, r, _ in found), None])
        return pa.table({"asking": left, "other": right, "distance": pa.array([*(d for *_, d in found), None], pa.float64()), "compared": pa.array([*([0] * len(found)), compared], pa.int64())})

    return here.unionByName(there).groupBy("block", "cell", "part", "turn").applyInArrow(join, f"asking {kind.simpleString()}, other {kind.simpleString()}, distance double, compared long")


def nearest_within(asking: DataFrame, notes: DataFrame, id_col: str, vector_col: str, block: str, radius: float, k: int, **options) -> DataFrame:
    """(id_col, other, distance): for each asking row up to k rows of its block within the radius, nearest first, ties by id; rows with its own id are not its partners."""
    found = joined(asking, notes, id_col, vector_col, block, radius, k, **options).filter("asking is not null")
    best = F.row_number().over(Window.partitionBy("asking").orderBy("distance", "other"))
    return found.withColumn("n", best).filter(F.col("n") <= k).select(F.col("asking").alias(id_col), "other", "distance")
