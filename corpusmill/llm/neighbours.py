"""Approximate nearest neighbours by multi-index hashing.

Vectors are rotated by a learned rotation (alternating sign codes and the orthogonal map that fits them best, on a bounded sample) and reduced to
their signs, a code of one bit a dimension. Codes are cut into substrings, each with an index from its values to rows. Codes within
radius r of a query agree with it in one of m substrings up to r // m bits, so probing all values that near in every substring
index retrieves every code within the radius; these are verified on the whole code and reranked by the inner product of the floats in double precision.

The radius is the least that finds ``TARGET`` of the true neighbours between sampled queries and sampled rows. A block that has too few codes in the radius widens it.

Equal vectors are searched once, as a class with its smallest ids (no more can be among the results). Classes and query classes
are dealt into blocks of bounded size, and every block of queries meets every block of classes.

Defined results: vectors null, zero, holding a null or non-finite component, or of another length than the smallest usual one take no part,
nor do rows with a null id; ties go to the smaller id; equal rows (same id and vector) are one; fewer candidates than asked for are all returned; an empty table gives an
empty result; other columns are not read.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpusmill.lineage import cut

SUBSTRING_BITS = 8
FIT_ROWS, FIT_QUERIES, TARGET, ROUNDS, SEED = 20_000, 256, 0.97, 30, 5
CLASS_BLOCK, QUERY_BLOCK = 16_384, 4_096


def learn_rotation(x: np.ndarray, rounds: int = ROUNDS, seed: int = SEED) -> np.ndarray:
    """Orthogonal matrix whose signs of x @ R lose least: from a random one, alternate codes and best fit."""
    r, _ = np.linalg.qr(np.random.default_rng(seed).normal(size=(x.shape[1], x.shape[1])))
    for _ in range(rounds):
        u, _, v = np.linalg.svd(x.T @ np.sign(x @ r))
        r = u @ v
    return r


def codes_of(x: np.ndarray, rotation: np.ndarray) -> np.ndarray:
    """(rows, bytes) of sign bits, padded to whole bytes."""
    return np.packbits(x @ rotation > 0, axis=1)


def differing(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.bitwise_count(a ^ b).sum(-1, dtype=np.int32)


def learn_radius(x: np.ndarray, rotation: np.ndarray, k: int, target: float = TARGET, queries: int = FIT_QUERIES) -> int:
    """Least radius that holds the target share of the k nearest, by inner product of the vectors as they are, of sampled queries among the sample."""
    codes, found = codes_of(x, rotation), []
    for i in range(min(queries, len(x))):
        score = x @ x[i]
        score[i] = -np.inf
        best = np.argpartition(-score, min(k, len(x) - 1) - 1)[:k] if len(x) > 1 else np.zeros(0, int)
        found.append(differing(codes[best], codes[i]))
    every = np.sort(np.concatenate(found)) if found else np.zeros(0, int)
    return int(every[min(len(every) - 1, int(np.ceil(target * len(every))))]) if len(every) else 0


class Index:
    """Substring indexes of one block: for each substring the rows sorted by value, and where each value starts."""

    def __init__(self, codes: np.ndarray):
        self.codes, self.m = codes, codes.shape[1]
        self.rows = [np.argsort(codes[:, j], kind="stable") for j in range(self.m)]
        self.starts = [np.searchsorted(codes[:, j][self.rows[j]], np.arange(257)) for j in range(self.m)]
        self.patterns = [np.array([sum(1 << b for b in bits) for n in range(t + 1) for bits in combinations(range(SUBSTRING_BITS), n)], dtype=np.uint8) for t in range(SUBSTRING_BITS + 1)]

    def within(self, code: np.ndarray, radius: int) -> np.ndarray:
        """Rows whose codes differ from the code in at most radius bits."""
        seen = np.zeros(len(self.codes), dtype=bool)
        probes = self.patterns[min(radius // self.m, SUBSTRING_BITS)]
        for j in range(self.m):
            for value in (probes ^ code[j]).tolist():
                a, b = self.starts[j][value], self.starts[j][value + 1]
                if a < b:
                    seen[self.rows[j][a:b]] = True
        rows = np.flatnonzero(seen)
        return rows[differing(self.codes[rows], code) <= radius]


def usable(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(id, v): rows that take part, vectors as arrays of doubles."""
    v = F.col(vector_col).cast("array<double>")
    df = vectors.select(F.col(id_col).alias("id"), v.alias("v")).filter("id is not null and v is not null and size(v) > 0")
    sound = ~F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return df.filter(sound & F.exists("v", lambda x: x != 0))


def nearest(vectors: DataFrame, is_query, id_col: str = "vec_id", vector_col: str = "embedding", k: int = 20) -> DataFrame:
    """(query_id, rank, <id_col>, score) for the rows where is_query(id column) holds, against all rows but the query's own id."""
    rows = usable(vectors, id_col, vector_col)
    width = rows.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").first()
    empty = vectors.sparkSession.createDataFrame([], f"query_id bigint, rank int, {id_col} bigint, score double")
    if width is None:
        return empty
    rows = rows.filter(F.size("v") == width["n"])
    # the k + 1 smallest ids of a class are all that can be among the k nearest of any query; a class is salted, so that no task ranks all of it, and what is collected is bounded
    salted = rows.distinct().withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(64))).withColumn("asks", is_query(F.col("id")))
    least = salted.withColumn("at", F.row_number().over(Window.partitionBy("v", "salt").orderBy("id"))).filter(F.col("at") <= k + 1)
    asking = salted.filter("asks").groupBy("v", "salt").agg(F.min("id").alias("id")).select("v", "id", F.lit(True).alias("asks"))
    few = least.select("v", "id", F.lit(False).alias("asks")).union(asking)
    classes = few.groupBy("v").agg(F.slice(F.array_sort(F.collect_set("id")), 1, k + 1).alias("ids"), F.max("asks").alias("asks"))
    classes = cut(classes.select(F.col("ids")[0].alias("class"), "ids", "v", "asks"))
    total, asking = classes.agg(F.count("*"), F.count_if("asks")).first()
    if not asking:
        return empty
    share = min(1.0, FIT_ROWS / total)
    sample = classes.filter(F.pmod(F.xxhash64("class"), F.lit(1 << 30)) < int(share * (1 << 30))).orderBy("class").limit(FIT_ROWS * 2).select("v").collect()
    x = np.array([r["v"] for r in sample] or [[1.0] * width["n"]])
    rotation = learn_rotation(x / np.linalg.norm(x, axis=1, keepdims=True))
    radius = learn_radius(x, rotation, k)
    n_classes, n_queries = -(-total // CLASS_BLOCK), -(-asking // QUERY_BLOCK)
    block = lambda n: F.pmod(F.xxhash64("class"), F.lit(n)).cast("int")
    spread = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    there = classes.select(F.lit(False).alias("asks"), "class", "v", block(n_classes).alias("c"), spread(n_queries).alias("q"))
    here = classes.filter("asks").select(F.lit(True).alias("asks"), "class", "v", spread(n_classes).alias("c"), block(n_queries).alias("q"))

    def search(table: pa.Table) -> pa.Table:
        ids = table.column("class").to_numpy()
        v = np.array(table.column("v").combine_chunks().flatten()).reshape(len(ids), -1)
        asks = np.array(table.column("asks"))
        base_ids, base, queries = ids[~asks], v[~asks], np.flatnonzero(asks)
        out_q, out_c, out_s = [], [], []
        if len(base_ids):
            order = np.argsort(base_ids)
            base_ids, base = base_ids[order], base[order]
            index, codes = Index(codes_of(base, rotation)), codes_of(v[queries], rotation)
            bits = 8 * index.m
            for i, q in enumerate(queries):
                r = radius
                while True:
                    near = index.within(codes[i], r)
                    if len(near) > k or r >= bits:
                        break
                    r = min(bits, r + index.m)
                score = base[near] @ v[q]
                if len(near) > k + 1:
                    least = np.partition(score, len(near) - k - 1)[len(near) - k - 1]
                    keep = score >= least
                    near, score = near[keep], score[keep]
                best = np.lexsort((near, -score))[: k + 1]
                out_q += [ids[q]] * len(best)
                out_c += base_ids[near[best]].tolist()
                out_s += score[best].tolist()
        return pa.table({"query": pa.array(out_q, pa.int64()), "class": pa.array(out_c, pa.int64()), "score": pa.array(out_s, pa.float64())})

    found = here.unionByName(there).groupBy("c", "q").applyInArrow(search, "query long, class long, score double")
    best = found.withColumn("at", F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "class"))).filter(F.col("at") <= k + 1).drop("at")
    # back from classes to ids: of the classes found their ids, for every asking id of the query's class
    hits = best.join(classes.select("class", "ids"), "class").groupBy("query").agg(F.flatten(F.collect_list(F.transform("ids", lambda i: F.struct((-F.col("score")).alias("s"), i.alias("id"))))).alias("hits"))
    hits = hits.select("query", F.slice(F.array_sort("hits"), 1, k + 1).alias("hits"))
    asking_ids = rows.filter(is_query(F.col("id"))).distinct().join(classes.select("v", F.col("class").alias("query")), "v").select("id", "query")
    own = asking_ids.join(hits, "query").select(F.col("id").alias("query_id"), F.slice(F.filter("hits", lambda h: h["id"] != F.col("id")), 1, k).alias("hits"))
    return own.select("query_id", F.posexplode("hits").alias("at", "h")).select("query_id", (F.col("at") + 1).cast("int").alias("rank"), F.col("h.id").alias(id_col), (-F.col("h.s")).alias("score"))


def op10(spark, sf_dir: str) -> DataFrame:
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding")
    return nearest(vectors, lambda i: i % 20 == 0)
