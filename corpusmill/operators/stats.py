"""Counts and summaries of an index, and retrieval metrics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

DAY, WEEK = 86_400, 7 * 86_400


def index_stats(files: DataFrame, chunks: DataFrame, embeddings: DataFrame) -> DataFrame:
    """One row: files, chunks, embeddings, last_indexed."""
    f = files.agg(F.count("*").alias("files"), F.max("indexed_at").alias("last_indexed"))
    return f.withColumn("chunks", chunks.agg(F.count("*")).scalar()).withColumn("embeddings", embeddings.agg(F.count("*")).scalar())


def token_stats(chunks: DataFrame, embeddings: DataFrame) -> DataFrame:
    """One row: total_tokens, and pending_tokens of chunks without a vector."""
    marked = chunks.join(embeddings.select("chunk_id", F.lit(True).alias("_has")), "chunk_id", "left")
    return marked.agg(F.coalesce(F.sum("token_count"), F.lit(0)).alias("total_tokens"), F.coalesce(F.sum(F.when(F.col("_has").isNull(), F.col("token_count"))), F.lit(0)).alias("pending_tokens"))


def pending(chunks: DataFrame) -> DataFrame:
    return chunks.agg(F.count_if("embed_pending").alias("pending"))


def language_counts(files: DataFrame) -> DataFrame:
    """Files by language, null as unknown; most first, ties by name."""
    return files.groupBy(F.coalesce("language", F.lit("unknown")).alias("language")).count().orderBy(F.desc("count"), "language")


def recent_usage(usage: DataFrame, now: int | Column) -> DataFrame:
    """Calls of each command in the week before now (epoch seconds), most first, ties by name."""
    now = F.lit(now) if isinstance(now, int) else now
    return usage.filter(F.col("called_at") > now - WEEK).groupBy("command").count().orderBy(F.desc("count"), "command")


def caller_counts(files: DataFrame, chunks: DataFrame, edges: DataFrame) -> DataFrame:
    """(path, caller_count): other files that refer to a name of the file's chunks; 0 without any."""
    named = chunks.filter("name is not null").select("path", F.col("name").alias("target_name")).distinct()
    callers = named.join(edges.select("source_file", "target_name").distinct(), "target_name").filter("source_file != path").groupBy("path").agg(F.countDistinct("source_file").alias("caller_count"))
    return files.select("path").join(callers, "path", "left").withColumn("caller_count", F.coalesce("caller_count", F.lit(0)))


def drift(files: DataFrame, callers: DataFrame, min_days: int, limit: int) -> DataFrame:
    """Files indexed min_days or more before the newest, most behind first, ties by callers and path. indexed_at in epoch seconds."""
    newest = files.agg(F.max("indexed_at")).scalar()
    behind = files.withColumn("days_behind", F.floor((newest - F.col("indexed_at")) / DAY).cast("long")).filter(F.col("days_behind") >= min_days)
    return behind.join(callers, "path").select("path", "days_behind", "caller_count").orderBy(F.desc("days_behind"), F.desc("caller_count"), "path").limit(limit)


def staleness(sample: DataFrame) -> DataFrame:
    """One row from a sample with boolean ``stale``: sampled, stale, percent (0 if empty)."""
    out = sample.agg(F.count("*").alias("sampled"), F.count_if("stale").alias("stale"))
    return out.withColumn("percent", F.when(F.col("sampled") > 0, F.col("stale") * 100.0 / F.col("sampled")).otherwise(F.lit(0.0)))


def project_stats(notes: DataFrame, by: str) -> DataFrame:
    return notes.groupBy(by).agg(F.count("*").alias("total"), F.count_if(F.col("status") == "active").alias("active"))


def last_cursor(notes: DataFrame) -> DataFrame:
    return notes.agg(F.max("remote_id").alias("cursor"))


def pending_sync(notes: DataFrame) -> DataFrame:
    return notes.agg(F.count_if((F.col("status") == "active") & F.col("remote_id").isNull()).alias("pending"))


def smoothed(rows: DataFrame, key: str, order: list[str], value: str) -> DataFrame:
    """A running mean of each key's values: the first, then 0.1 old + 0.9 new, then halves.

    As a sum: the last value weighs a half, the one before a quarter and so on, the first two share what is left; so no key's values are collected.
    """
    w = Window.partitionBy(key)
    placed = rows.select(key, F.col(value).cast("double").alias("_v"), F.row_number().over(w.orderBy(*order)).alias("_k"), F.count("*").over(w).alias("_n"))
    half = F.pow(F.lit(0.5), F.greatest(F.col("_n") - 2, F.lit(0)))
    weight = F.when(F.col("_n") == 1, F.lit(1.0)).when(F.col("_k") == 1, 0.1 * half).when(F.col("_k") == 2, 0.9 * half).otherwise(F.pow(F.lit(0.5), F.col("_n") - F.col("_k") + 1))
    return placed.groupBy(key).agg(F.sum(F.col("_v") * weight).alias("ema"))


def retrieval_metrics(ranked: DataFrame, relevant: DataFrame, k: int, token_budget: int | None = None) -> DataFrame:
    """(query, mrr, recall, ndcg and, with a budget, recall_in_budget) from ranked (query, rank, item, tokens) and relevant (query, item).

    mrr and ndcg look at the first k ranks; recall is the share of relevant items there; the last, of those whose tokens fit in the budget from the top.
    """
    marked = ranked.join(relevant.withColumn("relevant", F.lit(True)), ["query", "item"], "left").withColumn("relevant", F.coalesce("relevant", F.lit(False)))
    return metrics_of_hits(marked, relevant.groupBy("query").agg(F.count("*").alias("n")), k, token_budget)


def metrics_of_hits(ranked: DataFrame, sizes: DataFrame, k: int, token_budget: int | None = None) -> DataFrame:
    """As retrieval_metrics(), from ranked (query, rank, tokens, relevant) and sizes (query, n), the number of relevant items: ranks beyond the first k and the budget have no part in it and may be left out."""
    hits = ranked.withColumn("_rel", F.coalesce(F.col("relevant"), F.lit(False)).cast("int"))
    if token_budget is not None:
        used = F.sum("tokens").over(Window.partitionBy("query").orderBy("rank").rowsBetween(Window.unboundedPreceding, 0))
        hits = hits.withColumn("_in", F.when(used <= token_budget, F.col("_rel")).otherwise(0))
    top = F.col("rank") <= k
    got = hits.groupBy("query").agg(
        F.coalesce(F.max(F.when(top & (F.col("_rel") == 1), 1.0 / F.col("rank"))), F.lit(0.0)).alias("mrr"),
        F.sum(F.when(top, F.col("_rel")).otherwise(0)).alias("_found"),
        F.sum(F.when(top, F.col("_rel") / F.log2(F.col("rank") + 1.0)).otherwise(F.lit(0.0))).alias("_dcg"),
        *([F.sum("_in").alias("_inside")] if token_budget is not None else []),
    )
    size = sizes.select("query", F.col("n").alias("_n"))
    ideal = F.aggregate(F.sequence(F.lit(1), F.least(F.col("_n"), F.lit(k)).cast("int")), F.lit(0.0), lambda s, i: s + 1.0 / F.log2(i + 1.0))
    more = [(F.col("_inside") / F.col("_n")).alias("recall_in_budget")] if token_budget is not None else []
    return got.join(size, "query").select("query", "mrr", (F.col("_found") / F.col("_n")).alias("recall"), (F.col("_dcg") / ideal).alias("ndcg"), *more)
