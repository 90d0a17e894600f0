"""Vector functions and exact nearest-neighbour queries for one query vector, as expressions over arrays."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from corpusmill.operators.metric_join import nearest_within

MAX_CHUNKS, MAX_NOTES, MAX_QUERIES = 1000, 100, 4096
#: Most queries and rows that a task compares.
QUERY_BLOCK, ROW_BLOCK = 4096, 1 << 16


def quantise(v: Column) -> Column:
    """int8 of x * 127, half away from zero, within -127 and 127."""
    return F.transform(v, lambda x: F.greatest(F.lit(-127), F.least(F.lit(127), F.round(x.cast("double") * 127))).cast("tinyint"))


def dequantise(v: Column) -> Column:
    return F.transform(v, lambda x: x.cast("double") / 127)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """0 for a zero vector or different lengths."""
    n = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when((F.size(a) != F.size(b)) | (n == 0), F.lit(0.0)).otherwise(dot(a, b) / n)


def squared_int(a: Column, b: Column) -> Column:
    """Squared distance of int8 vectors, exact."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x.cast("long") - y.cast("long")) * (x.cast("long") - y.cast("long"))), F.lit(0).cast("long"), lambda s, x: s + x)


def l2(a: Column, b: Column) -> Column:
    return F.sqrt(F.aggregate(F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double"))), F.lit(0.0), lambda s, x: s + x))


def vector(values: list[float]) -> Column:
    return F.split(F.lit(",".join(map(repr, map(float, values)))), ",").cast("array<double>")


def knn_int8(chunks: DataFrame, query: list[float], k: int, order: list[str], vector_col: str = "embedding") -> DataFrame:
    """The k chunks nearest to a query by int8 L2: columns and ``sq_dist``, ``distance``; ties by ``order``. vector_col holds int8 arrays."""
    near = squared_int(F.col(vector_col), quantise(vector(query)))
    return chunks.withColumn("sq_dist", near).withColumn("distance", F.sqrt(F.col("sq_dist").cast("double")) / 127).orderBy("sq_dist", *order).limit(min(k, MAX_CHUNKS))


def knn(notes: DataFrame, query: list[float], k: int, order: list[str], where: Column | None = None, before: bool = False, vector_col: str = "embedding") -> DataFrame:
    """The k notes nearest by L2; the filter comes after the limit, so fewer may be left, unless ``before``."""
    rows = notes.filter(where) if before and where is not None else notes
    out = rows.withColumn("distance", l2(F.col(vector_col), vector(query))).orderBy("distance", *order).limit(min(k, MAX_NOTES))
    return out if before or where is None else out.filter(where)


def _nearest(rows: DataFrame, queries: DataFrame, k: int, others: bool, inner: bool) -> DataFrame:
    """(query, id, score, rank): for each of queries (query, v) the k rows (id, v) of the least score, ties by id; others leaves the query's own id out. Vectors are double[] without nulls.

    The score is the squared distance, or with inner the inner product's negative, in double precision, summed up in the order of the components. Blocks of queries meet blocks of rows, each pair in a task of its own that
    keeps k rows for each query: what it can't exclude by a matrix product, with a margin for rounding, it computes exactly. Row blocks grow with the table up to ROW_BLOCK, so that lists are few.
    """
    kind, query_kind = rows.schema["id"].dataType, queries.schema["query"].dataType
    total, asked = rows.count(), queries.count()
    n_rows, n_queries = max(1, -(-total // max(QUERY_BLOCK, min(ROW_BLOCK, -(-total // 16))))), max(1, -(-asked // QUERY_BLOCK))
    deal = lambda c, n: F.pmod(F.xxhash64(c, F.lit(1)), F.lit(n)).cast("int")
    spread = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    length = F.size("v").alias("n")
    here = queries.select(length, spread(n_rows).alias("r"), deal("query", n_queries).alias("q"), "query", "v")
    there = rows.select(length, deal("id", n_rows).alias("r"), spread(n_queries).alias("q"), "id", "v")
    types = [to_arrow_type(query_kind), to_arrow_type(kind), pa.float64()]

    def exact(x: np.ndarray, q: np.ndarray) -> np.ndarray:
        out = np.zeros(len(x))
        for d in range(x.shape[1]):
            out += -x[:, d] * q[d] if inner else (x[:, d] - q[d]) ** 2
        return out

    def best(asking: pa.Table, there: pa.Table) -> pa.Table:
        found: tuple[list, list, list] = ([], [], [])
        if asking.num_rows and there.num_rows:
            matrix = lambda t: t.column("v").combine_chunks().flatten().to_numpy().reshape(t.num_rows, -1)
            q, x, own, ids = matrix(asking), matrix(there), asking.column("query").to_pylist(), there.column("id").to_pylist()
            norms = np.einsum("ij,ij->i", x, x)
            with np.errstate(all="ignore"):
                for at in range(0, len(q), 64):
                    some = q[at : at + 64]
                    rough = -(some @ x.T) if inner else norms - 2 * (some @ x.T) + np.einsum("ij,ij->i", some, some)[:, None]
                    # rounding of either sum is far below this part of the lengths
                    margin = 1e-12 * max(1, x.shape[1]) * (1 + np.abs(norms).max() + np.abs(some * some).sum(1))
                    for i, row in enumerate(rough):
                        most = k + others
                        if len(row) > most and np.isfinite(row).all():
                            near = np.flatnonzero(row <= np.partition(row, most - 1)[most - 1] + 2 * margin[i])
                        else:
                            near = np.arange(len(row))
                        scores = exact(x[near], some[i])
                        kept = sorted((s, ids[j]) for s, j in zip(scores.tolist(), near.tolist(), strict=True) if not others or ids[j] != own[at + i])[:k]
                        for s, j in kept:
                            found[0].append(own[at + i])
                            found[1].append(j)
                            found[2].append(s)
        return pa.table([pa.array(f, t) for f, t in zip(found, types, strict=True)], names=["query", "id", "score"])

    keys = ("n", "r", "q")
    lists = here.groupBy(*keys).cogroup(there.groupBy(*keys)).applyInArrow(best, f"query {query_kind.simpleString()}, id {kind.simpleString()}, score double")
    rank = F.row_number().over(Window.partitionBy("query").orderBy("score", "id"))
    return lists.withColumn("rank", rank).filter(F.col("rank") <= k)


def _prepared(df: DataFrame, id_col: str, name: str, vector: Column) -> DataFrame:
    return df.select(F.col(id_col).alias(name), vector.cast("array<double>").alias("v")).filter(f"{name} is not null and v is not null and not exists(v, x -> x is null or isnan(x))")


def knn_many(rows: DataFrame, queries: DataFrame, k: int, id_col: str, query_col: str = "query_id", vector_col: str = "embedding", int8: bool = False) -> DataFrame:
    """(query_col, rank, id_col, distance): for each query vector the k nearest rows by L2, ties by id.

    Queries are requests of up to MAX_QUERIES, which go along with the tasks of one pass over the rows, or as many as there are: see knn_table().
    Vectors of another length than the query's, and null ones, are not near it. With int8 vectors are quantised first and distances are exact whole numbers under the root.
    """
    if queries.limit(MAX_QUERIES + 1).count() > MAX_QUERIES:
        raise ValueError(f"more than {MAX_QUERIES} queries in a request")
    return knn_table(rows, queries, k, id_col, query_col, vector_col, int8)


def knn_table(rows: DataFrame, queries: DataFrame, k: int, id_col: str, query_col: str = "query_id", vector_col: str = "embedding", int8: bool = False) -> DataFrame:
    """As knn_many(), for a table of queries of any size; their ids are distinct. No distance beyond each task's k best is sorted or sent."""
    vector = quantise(F.col(vector_col)) if int8 else F.col(vector_col)
    found = _nearest(_prepared(rows, id_col, "id", vector), _prepared(queries, query_col, "query", vector), k, others=False, inner=False)
    root = F.sqrt("score") / 127 if int8 else F.sqrt("score")
    return found.select(F.col("query").alias(query_col), "rank", F.col("id").alias(id_col), root.alias("distance"))


def largest_products(rows: DataFrame, queries: DataFrame, k: int, id_col: str, query_col: str = "query", vector_col: str = "embedding") -> DataFrame:
    """(query_col, rank, id_col): for each query the k rows with another id of the largest inner product, ties by id."""
    found = _nearest(_prepared(rows, id_col, "id", F.col(vector_col)), _prepared(queries, query_col, "query", F.col(vector_col)), k, others=True, inner=True)
    return found.select(F.col("query").alias(query_col), "rank", F.col("id").alias(id_col))


def blend_rank(distance: Column, rank: Column) -> Column:
    """Reported distance with the graph rank; the order stays that of the plain distance."""
    return distance * 0.85 - rank * 0.15


def by_similarity(rows: DataFrame, query: list[float], order: list[str], vector_col: str = "embedding") -> DataFrame:
    """All rows with ``similarity`` by dot product, highest first."""
    return rows.withColumn("similarity", dot(F.col(vector_col), vector(query))).orderBy(F.desc("similarity"), *order)


def min_score(hits: DataFrame, score: float, limit: int, order: list[str], keep: Column | None = None) -> DataFrame:
    """Hits of a wider fetch (limit + 20) with 1 - distance of score or more, and what else holds, cut to limit."""
    good = hits.filter((1 - F.col("distance")) >= score)
    return (good if keep is None else good.filter(keep)).orderBy(*order).limit(limit)


def conflicts(notes: DataFrame, asking: DataFrame, id_col: str, max_distance: float, block: str, per_note: int = 5, vector_col: str = "embedding") -> DataFrame:
    """For each asking note up to per_note others within max_distance and of its ``block`` (a project, say): (id_col, other, distance), by a join that is pruned by pivots."""
    return nearest_within(asking, notes, id_col, vector_col, block, max_distance, per_note)
