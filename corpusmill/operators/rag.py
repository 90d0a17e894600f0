"""Graph-personalised re-ranking of a candidate pool, and diversity selection. The pool of a request is bounded, so its graph fits one task."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpusmill.operators.fusion import similarity
from corpusmill.operators.graph import personalised_pagerank

POOL_FACTOR, POOL_MIN, POOL_MAX = 5, 50, 300
ACTIVE, TOP_SYMBOLS, PER_SYMBOL, MAX_EXPANDED = 0.25, 150, 50, 500


def pool_size(limit: int) -> int:
    return max(POOL_MIN, min(POOL_FACTOR * limit, POOL_MAX))


def linear_rag(pool: DataFrame, symbols: DataFrame, chunks: DataFrame, limit: int, order: list[str]) -> DataFrame:
    """The pool's and its graph neighbours' chunks by 0.5 similarity + 0.5 normalised personalised PageRank.

    pool: (chunk_id, distance); symbols: (chunk_id, symbol, kind), one row for each edge, never distinct, for degrees count; chunks: chunk_id and the order columns.
    """
    sim = pool.withColumn("similarity", similarity(F.col("distance"), Window.partitionBy())).select("chunk_id", "similarity")
    lit = sim.filter(F.col("similarity") > ACTIVE)
    active = symbols.join(lit, "chunk_id").groupBy("symbol").agg(F.max("similarity").alias("activation"))
    top = active.orderBy(F.desc("activation"), "symbol").limit(TOP_SYMBOLS)
    inside = symbols.join(sim.select("chunk_id"), "chunk_id").join(active.select("symbol"), "symbol").select("chunk_id", "symbol", F.lit(0).alias("part"))
    reached = symbols.join(top.select("symbol"), "symbol").select("symbol", "chunk_id")
    per = F.dense_rank().over(Window.partitionBy("symbol").orderBy("chunk_id"))
    bounded = reached.withColumn("_n", per).filter(F.col("_n") <= PER_SYMBOL).drop("_n")
    bounded = bounded.withColumn("_at", F.row_number().over(Window.orderBy("symbol", "chunk_id"))).filter(F.col("_at") <= MAX_EXPANDED).select("chunk_id", "symbol", F.lit(1).alias("part"))
    edges = inside.unionByName(bounded).withColumn("start", F.lit(None).cast("double"))
    starts = sim.select("chunk_id", F.lit(None).cast("string").alias("symbol"), F.lit(2).alias("part"), F.col("similarity").alias("start")).unionByName(active.select(F.lit(None).cast("long").alias("chunk_id"), "symbol", F.lit(3).alias("part"), F.col("activation").alias("start")))

    def walk(frame: pd.DataFrame) -> pd.DataFrame:
        links = frame[frame["part"] < 2]
        pairs = [(f"c{int(c):020d}", f"s{s}") for c, s in zip(links["chunk_id"], links["symbol"], strict=True)]
        start = {f"c{int(r.chunk_id):020d}" if r.part == 2 else f"s{r.symbol}": float(r.start) for r in frame[frame["part"] >= 2].itertuples()}
        ranks = personalised_pagerank(pairs + [(b, a) for a, b in pairs], start)
        mine = sorted((int(k[1:]), v) for k, v in ranks.items() if k[0] == "c")
        return pd.DataFrame({"chunk_id": np.array([c for c, _ in mine], dtype=np.int64), "ppr": [v for _, v in mine]})

    everything = edges.unionByName(starts).withColumn("_all", F.lit(0))
    ranks = everything.groupBy("_all").applyInPandas(walk, "chunk_id long, ppr double")
    scored = ranks.join(sim, "chunk_id", "left").withColumn("similarity", F.coalesce("similarity", F.lit(0.0)))
    score = 0.5 * F.col("similarity") + 0.5 * F.col("ppr") / F.greatest(F.max("ppr").over(Window.partitionBy()), F.lit(1e-12))
    return chunks.join(scored.withColumn("score", score).select("chunk_id", "score"), "chunk_id").withColumn("distance", 1 - F.col("score")).orderBy(F.desc("score"), *order).limit(limit)


def mmr_order(vectors: np.ndarray, centroid: np.ndarray, weight: float = 0.5) -> list[int]:
    """All indices by maximal marginal relevance: relevance less likeness to what is chosen, not below 0; ties to the first."""
    unit = lambda a: a / np.where((n := np.linalg.norm(a, axis=-1, keepdims=True)) == 0, 1, n)
    v, relevance = unit(vectors), unit(vectors) @ unit(centroid)
    order, like, free = [], np.zeros(len(v)), np.ones(len(v), dtype=bool)
    for _ in range(len(v)):
        value = np.where(free, weight * relevance - (1 - weight) * like, -np.inf)
        i = int(value.argmax())
        order.append(i)
        free[i] = False
        like = np.maximum(like, v @ v[i])
    return order


def mmr(rows: DataFrame, group: str, id_col: str, vector_col: str, weight: float = 0.5) -> DataFrame:
    """(group, id, place) of each group's vectors against their mean; a group is the units of one chunk, which are at most 64."""

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(id_col)
        v = np.array(frame[vector_col].tolist(), dtype=np.float64)
        order = mmr_order(v, v.mean(0), weight)
        return pd.DataFrame({group: frame[group].iloc[order].to_numpy(), id_col: frame[id_col].iloc[order].to_numpy(), "place": np.arange(len(order), dtype=np.int32)})

    kinds = {f.name: f.dataType.simpleString() for f in rows.schema.fields}
    return rows.select(group, id_col, vector_col).groupBy(group).applyInPandas(run, f"`{group}` {kinds[group]}, `{id_col}` {kinds[id_col]}, place int")
