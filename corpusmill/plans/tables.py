"""The test tables as the library's relations, and the same as SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


NOTES_SQL = """notes AS (
  SELECT lpad(conv_id::VARCHAR, 8, '0') || '-' || lpad(turn::VARCHAR, 4, '0') AS uuid, conv_id, turn, role,
    CASE turn % 5 WHEN 0 THEN 'decision' WHEN 1 THEN 'requirement' WHEN 2 THEN 'handoff' WHEN 3 THEN 'question' ELSE 'intent' END AS kind,
    substr(text, 1, 24) AS title, text AS body,
    CASE WHEN conv_id % 5 = 0 THEN [role, 'c' || (conv_id % 7), 'locked'] ELSE [role, 'c' || (conv_id % 7)] END AS tags,
    ['src/' || (conv_id % 11) || '.py'] AS linked_files,
    1700000000 + conv_id * 600 + turn * 60 AS created_at,
    CASE WHEN turn % 4 = 3 THEN 'archived' ELSE 'active' END AS status,
    CASE WHEN turn % 3 = 0 THEN 1700000000 + conv_id * 600 + turn * 60 - 100 END AS valid_at,
    CASE WHEN turn % 4 = 3 THEN 1700000000 + conv_id * 600 + turn * 60 + 5000 END AS invalid_at,
    CASE WHEN turn % 4 = 3 THEN lpad(conv_id::VARCHAR, 8, '0') || '-' || lpad((turn + 1)::VARCHAR, 4, '0') END AS superseded_by,
    CASE WHEN turn % 2 = 0 THEN 'git:' || substr(md5(text), 1, 8) END AS source_ref,
    CASE WHEN conv_id % 3 = 0 THEN 'r' || lpad(conv_id::VARCHAR, 8, '0') || '-' || lpad(turn::VARCHAR, 4, '0') END AS remote_id,
    md5(lower(substr(text, 1, 6))) AS entity_id
  FROM conversations)"""


def notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns of conversations as notes."""
    return table(spark, sf_dir, "conversations").selectExpr(
        "concat(lpad(cast(conv_id as string), 8, '0'), '-', lpad(cast(turn as string), 4, '0')) AS uuid", "conv_id", "turn", "role",
        "CASE turn % 5 WHEN 0 THEN 'decision' WHEN 1 THEN 'requirement' WHEN 2 THEN 'handoff' WHEN 3 THEN 'question' ELSE 'intent' END AS kind",
        "substr(text, 1, 24) AS title", "text AS body",
        "CASE WHEN conv_id % 5 = 0 THEN array(role, concat('c', conv_id % 7), 'locked') ELSE array(role, concat('c', conv_id % 7)) END AS tags",
        "array(concat('src/', conv_id % 11, '.py')) AS linked_files",
        "1700000000 + conv_id * 600 + turn * 60 AS created_at",
        "CASE WHEN turn % 4 = 3 THEN 'archived' ELSE 'active' END AS status",
        "CASE WHEN turn % 3 = 0 THEN 1700000000 + conv_id * 600 + turn * 60 - 100 END AS valid_at",
        "CASE WHEN turn % 4 = 3 THEN 1700000000 + conv_id * 600 + turn * 60 + 5000 END AS invalid_at",
        "CASE WHEN turn % 4 = 3 THEN concat(lpad(cast(conv_id as string), 8, '0'), '-', lpad(cast(turn + 1 as string), 4, '0')) END AS superseded_by",
        "CASE WHEN turn % 2 = 0 THEN concat('git:', substr(md5(text), 1, 8)) END AS source_ref",
        "CASE WHEN conv_id % 3 = 0 THEN concat('r', lpad(cast(conv_id as string), 8, '0'), '-', lpad(cast(turn as string), 4, '0')) END AS remote_id",
        "md5(lower(substr(text, 1, 6))) AS entity_id",
    )


CHUNKS_SQL = """chunks AS (
  SELECT doc_id AS chunk_id, doc_id AS file_id, source || '/' || doc_id || '.txt' AS path, lang AS language,
    CASE WHEN doc_id % 4 = 0 THEN 'section' ELSE 'function' END AS node_type,
    CASE WHEN doc_id % 5 > 0 THEN split_part(text, ' ', 1) END AS name, text AS content,
    1 + doc_id % 3 AS start_line, 10 + doc_id % 7 AS end_line, greatest(1, length(text) // 4)::INTEGER AS token_count,
    round((doc_id * 37 % 101) / 101.0, 6)::DOUBLE AS graph_rank, doc_id % 9 = 0 AS embed_pending, 1700000000 + doc_id * 911 % 400000 AS indexed_at
  FROM documents)"""


def chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as one chunk each of a file of their source."""
    return table(spark, sf_dir, "documents").selectExpr(
        "doc_id AS chunk_id", "doc_id AS file_id", "concat(source, '/', doc_id, '.txt') AS path", "lang AS language",
        "CASE WHEN doc_id % 4 = 0 THEN 'section' ELSE 'function' END AS node_type",
        "CASE WHEN doc_id % 5 > 0 THEN split_part(text, ' ', 1) END AS name", "text AS content",
        "1 + doc_id % 3 AS start_line", "10 + doc_id % 7 AS end_line", "cast(greatest(1, length(text) div 4) as int) AS token_count",
        "round((doc_id * 37 % 101) / 101D, 6) AS graph_rank", "doc_id % 9 = 0 AS embed_pending", "1700000000 + doc_id * 911 % 400000 AS indexed_at",
    )


EDGES_SQL = """edges AS (
  SELECT 'f' || (l_orderkey % 97) AS source_file, CASE WHEN l_linenumber < 6 THEN 's' || (l_suppkey % 61) END AS source_name, 's' || (l_partkey % 83) AS target_name,
    CASE l_linenumber % 3 WHEN 0 THEN 'calls' WHEN 1 THEN 'imports' ELSE 'mentions' END AS kind, (l_orderkey % 500)::INTEGER AS line
  FROM lineitem)"""


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as edges between symbols."""
    return table(spark, sf_dir, "lineitem").selectExpr(
        "concat('f', l_orderkey % 97) AS source_file", "CASE WHEN l_linenumber < 6 THEN concat('s', l_suppkey % 61) END AS source_name", "concat('s', l_partkey % 83) AS target_name",
        "CASE l_linenumber % 3 WHEN 0 THEN 'calls' WHEN 1 THEN 'imports' ELSE 'mentions' END AS kind", "cast(l_orderkey % 500 as int) AS line",
    )


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings")


def query_vector(spark: SparkSession, sf_dir: str, vec_id: int = 0) -> list[float]:
    """One stored vector as the query."""
    return list(vectors(spark, sf_dir).filter(F.col("vec_id") == vec_id).select("embedding").first()[0])
