"""Mixing sources to target weights by systematic sampling, in DataFrame operations only.

Each source gets a target size; a document's expected copies are target / source size. Within a
source the documents are laid out by size class, hash bucket, size and id; the prefix sum of the
expected copies is their rank times that rate, one random offset per source is added, and a document
is emitted once for each integer that its stretch crosses. Laying them out by size makes the words
taken, and not only the documents taken, come out near the target.

Ranks are three prefix sums (classes of a source, buckets of a class, rows of a bucket), so a source
or a size with a third of all rows is spread over many tasks.

Defined results: a null text has size 0; a null source is a source of its own, last in order; a source
of size 0 gets target 0 and no copies; a null id sorts first in its bucket; equal rows are separate rows; an empty
table gives an empty result. Other columns are ignored by ``plan_copies`` and kept by ``mix``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusmill.lineage import cut

WORD = r"[^\x20\x09-\x0D]+"


def word_count(text: Column) -> Column:
    """Number of words of text; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_key(source: Column) -> Column:
    """A non-null join key that keeps null apart from every string; its order is the source's, nulls last."""
    return F.when(source.isNull(), F.lit("n")).otherwise(F.concat(F.lit("b"), source))


def size_class(size: Column) -> Column:
    """Classes of about 6 % width, increasing with size; exact for sizes below 32."""
    bits = F.length(F.bin(size))
    shift = F.greatest(bits - 5, F.lit(0))
    return (shift * 64 + F.call_function("shiftright", size, shift)).cast("long")


def hash32(value: Column) -> Column:
    """First 32 bits of an MD5 digest as a number."""
    return F.conv(F.substring(F.md5(value), 1, 8), 16, 10).cast("long")


def source_targets(sources: DataFrame, weights: tuple[float, ...] = (3, 1, 2), share: float = 1.5, cap: float = 2.0) -> DataFrame:
    """(key, source_size) to (key, source_size, target): weights cycle over the sources in code-point order.

    The targets add up to share times all sizes and none is above cap times its source's size: the sources are ordered by
    cap / weight and filled one after another, which is where resharing the excess by weight ends. One
    row per source, already aggregated, so the windows without partitions hold as many rows as there are sources.
    """
    cycle = F.array(*[F.lit(float(w)) for w in weights])
    by_name, all_rows = Window.orderBy("key"), Window.partitionBy()
    full = cap * F.col("source_size")
    before = Window.orderBy("ratio", "key").rowsBetween(Window.unboundedPreceding, -1)
    left = share * F.sum("source_size").over(all_rows) - F.coalesce(F.sum("full").over(before), F.lit(0.0))
    weight_left = F.sum("weight").over(Window.orderBy("ratio", "key").rowsBetween(0, Window.unboundedFollowing))
    level = F.max(F.when(F.col("rate") <= F.col("ratio"), F.col("rate"))).over(all_rows)
    return (
        sources.withColumn("weight", F.get(cycle, (F.row_number().over(by_name) - 1) % len(weights)))
        .withColumn("full", full)
        .withColumn("ratio", F.col("full") / F.col("weight"))
        .withColumn("rate", left / weight_left)
        .withColumn("level", level)
        .select("key", "source_size", F.when(F.col("rate") > F.col("ratio"), F.col("full")).otherwise(F.col("level") * F.col("weight")).alias("target"))
    )


def plan_copies(rows: DataFrame, id_col: str, source_col: str, size_col: str, weights: tuple[float, ...] = (3, 1, 2), share: float = 1.5, cap: float = 2.0, seed: int = 17, bucket_rows: int = 20_000) -> DataFrame:
    """Adds struct column ``mix``(source_size, target, copies) to rows, packed in struct ``row``."""
    packed = rows.select(F.struct("*").alias("row"), source_key(F.col(source_col)).alias("key"), F.col(id_col).alias("id"), F.col(size_col).alias("size")).withColumn("class", size_class(F.col("size")))
    classes = cut(packed.groupBy("key", "class").agg(F.count("*").alias("n"), F.sum("size").alias("words")))
    targets = source_targets(classes.groupBy("key").agg(F.sum("words").alias("source_size")), weights, share, cap)
    milli = targets.select("key", "source_size", "target", F.round(F.col("target") * 1000).cast("decimal(18,0)").alias("t"), (F.col("source_size") * 1000).cast("decimal(18,0)").alias("s"))
    milli = milli.withColumn("u", F.expr(f"(conv(substring(md5(concat('{int(seed)}:', key)), 1, 8), 16, 10)::decimal(10,0) * s) div 4294967296").cast("decimal(18,0)"))
    running = Window.partitionBy("key").orderBy("class").rowsBetween(Window.unboundedPreceding, -1)
    classes = classes.select("key", "class", F.ceil(F.col("n") / bucket_rows).alias("buckets"), F.coalesce(F.sum("n").over(running), F.lit(0)).alias("class_start"))
    dealt = packed.join(classes.select("key", "class", "buckets"), ["key", "class"]).withColumn("bucket", F.pmod(hash32(F.coalesce(F.col("id").cast("string"), F.lit("null"))), F.col("buckets"))).drop("buckets").repartition("key", "class", "bucket")
    rank = F.row_number().over(Window.partitionBy("key", "class", "bucket").orderBy("size", "id"))
    in_class = Window.partitionBy("key", "class").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    counted = dealt.groupBy("key", "class", "bucket").count()
    starts = counted.withColumn("bucket_start", F.coalesce(F.sum("count").over(in_class), F.lit(0)))
    starts = starts.join(classes.select("key", "class", "class_start"), ["key", "class"]).join(milli, "key").select("key", "class", "bucket", (F.col("class_start") + F.col("bucket_start")).alias("start"), "source_size", "target", "t", "s", "u")
    ranked = dealt.withColumn("rank", rank).join(starts, ["key", "class", "bucket"]).withColumn("rank", (F.col("start") + F.col("rank")).cast("decimal(18,0)"))
    copies = F.expr("case when s > 0 then (u + rank * t) div s - (u + (rank - 1) * t) div s else 0L end").cast("long")
    return ranked.select("row", F.struct(F.col("source_size").cast("long").alias("source_size"), F.col("target"), copies.alias("copies")).alias("mix"))


def mix(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", **options) -> DataFrame:
    """docs with every row repeated as often as the mix takes it, in docs' columns."""
    size = "_words"
    while size in docs.columns:
        size += "_"
    planned = plan_copies(docs.withColumn(size, word_count(F.col(text_col))), id_col, source_col, size, **options)
    emitted = planned.filter("mix.copies > 0").select("row", F.explode(F.expr("sequence(1L, mix.copies)")).alias("copy"))
    return emitted.select("row.*").drop(size)


def op1(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    sizes = cut(docs.select("doc_id", "source", word_count(F.col("text")).alias("size")))
    planned = plan_copies(sizes, "doc_id", "source", "size")
    return planned.select("row.doc_id", "row.size", "mix.source_size", "mix.target", (F.col("row.size") * F.col("mix.copies")).alias("taken"), F.col("mix.copies").alias("copies"))


SQL = r"""
WITH docs AS (
  SELECT doc_id, CASE WHEN source IS NULL THEN 'n' ELSE 'b' || source END AS key,
         coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size FROM documents),
classed AS (
  SELECT *, greatest(length(bin(size)) - 5, 0) AS shift,
         ('0x' || substr(md5(coalesce(doc_id::VARCHAR, 'null')), 1, 8))::BIGINT AS h FROM docs),
c2 AS (SELECT *, shift * 64 + (size >> shift::BIGINT) AS class FROM classed),
c3 AS (SELECT *, h % ceil(count(*) OVER (PARTITION BY key, class) / 20000.0)::BIGINT AS bucket FROM c2),
ranked AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY class, bucket, size, doc_id NULLS FIRST)::HUGEINT AS rank FROM c3),
sources AS (SELECT key, sum(size)::BIGINT AS source_size FROM docs GROUP BY key),
weighed AS (SELECT *, [3.0, 1.0, 2.0][(row_number() OVER (ORDER BY key) - 1) % 3 + 1]::DOUBLE AS weight FROM sources),
ratios AS (SELECT *, 2.0::DOUBLE * source_size AS full_size, 2.0::DOUBLE * source_size / weight AS ratio FROM weighed),
rates AS (
  SELECT *, (1.5::DOUBLE * sum(source_size) OVER () - coalesce(sum(full_size) OVER (ORDER BY ratio, key ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0))
         / sum(weight) OVER (ORDER BY ratio, key ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS rate FROM ratios),
levels AS (SELECT *, max(CASE WHEN rate <= ratio THEN rate END) OVER () AS level FROM rates),
targets AS (SELECT key, source_size, CASE WHEN rate > ratio THEN full_size ELSE level * weight END AS target FROM levels),
milli AS (
  SELECT *, round(target * 1000)::HUGEINT AS t, source_size::HUGEINT * 1000 AS s,
         (('0x' || substr(md5('17:' || key), 1, 8))::BIGINT::HUGEINT * source_size::HUGEINT * 1000) // 4294967296 AS u FROM targets),
taken AS (
  SELECT doc_id, size, source_size, target,
         CASE WHEN s > 0 THEN (u + rank * t) // s - (u + (rank - 1) * t) // s ELSE 0 END::BIGINT AS copies
  FROM ranked JOIN milli USING (key))
SELECT doc_id, size, source_size, target, size * copies AS taken, copies FROM taken
"""
