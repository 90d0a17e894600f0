"""Importance resampling towards a target distribution, in two passes over the texts.

Texts are bags of hashed word n-grams. The first pass gives each partition's counts of all buckets as one vector, and a tree of sums merges the vectors; from the corpus's and the target's vectors
each bucket gets a gain, the logarithm of how much likelier it is in the target. The second pass sums the broadcast gains over each document. A document's score is that weight and Gumbel noise
from a hash of its id, so that the highest scores are a draw without replacement in proportion to exp(weight), the same one at every run.

What reaches the driver is one vector a subtree, of as many numbers as there are buckets; what is broadcast is one such vector. A text is read in slices of a megabyte, so a long one takes
no more memory than its slice. Ranks come from a sort by ranges and the sizes of the ranges, not from one task.

Defined results: a null or wordless text has no features, weight 0 and isn't drawn; ties go to the smaller id (null ids first); a null id hashes as an empty string; equal rows are drawn as separate rows;
an empty target gives every bucket the gain of a count of zero; an empty table gives an empty result; other columns are kept, those of the result's names are replaced.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpusmill.lineage import cut
from corpusmill.llm.memory import give_back

BUCKETS, NGRAM, MIN_WORDS, PERCENT, SEED, SLICE = 10_000, 1, 20, 10, "2024", 1 << 20

#: Words are 0-9, letters and what is beyond ASCII; A-Z become a-z, all else ends a word.
_FOLD = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def _slices(text: pa.Buffer) -> Iterator[list[bytes]]:
    """Words of a text, a slice after another; no word is cut."""
    data, at, held = memoryview(text), 0, b""
    while at < len(data):
        part = held + bytes(data[at : at + SLICE]).translate(_FOLD)
        at += SLICE
        end = len(part) if at >= len(data) else part.rfind(b" ") + 1
        held = part[end:]
        if words := part[:end].split():
            yield words


def buckets_of(text: pa.Buffer, ngram: int = NGRAM, buckets: int = BUCKETS) -> Iterator[tuple[int, np.ndarray]]:
    """(words, buckets of the features that end in it) of each slice of a text: all runs of 1 to ngram words, joined by a space, by their CRC-32."""
    last: deque[bytes] = deque(maxlen=ngram - 1)
    for words in _slices(text):
        run = [*last, *words]
        grams = [words] + [[b" ".join(run[i : i + n]) for i in range(max(0, len(last) + 1 - n), len(run) - n + 1)] for n in range(2, ngram + 1)]
        yield len(words), np.fromiter((crc32(g) for some in grams for g in some), np.uint32, sum(map(len, grams))) % np.uint32(buckets)
        last.extend(words[-ngram:])


def bucket_counts(texts: DataFrame, text_col: str = "text", ngram: int = NGRAM, buckets: int = BUCKETS) -> np.ndarray:
    """Counts of all features of all texts by bucket: a vector of each partition, merged by a tree of sums."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for text in batch.column(0):
                if text.is_valid:
                    for _, found in buckets_of(text.as_buffer(), ngram, buckets):
                        total += np.bincount(found, minlength=buckets)
        give_back()
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], ["counts"])

    vectors = texts.select(F.col(text_col).cast("string")).mapInArrow(count, "counts binary").rdd.map(lambda r: np.frombuffer(r[0], np.int64))
    return vectors.treeReduce(np.add, 3) if vectors.getNumPartitions() else np.zeros(buckets, np.int64)


def gains(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 ln((t + 1)(S + buckets) / ((s + 1)(T + buckets)))) of each bucket, in doubles."""
    s, t, n = corpus.astype(np.float64), target.astype(np.float64), float(len(corpus))
    return np.floor(1000 * np.log(((t + 1) * (s.sum() + n)) / ((s + 1) * (t.sum() + n)))).astype(np.int64)


def weigh(docs: DataFrame, gain: np.ndarray, text_col: str = "text", ngram: int = NGRAM) -> DataFrame:
    """docs with n_words, n_features and weight, the sum of the gains of a text's features; text_col goes."""
    spark, buckets = docs.sparkSession, len(gain)
    held = spark.sparkContext.broadcast(gain)
    rest = [c for c in docs.columns if c not in (text_col, "n_words", "n_features", "weight")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by_bucket = held.value.astype(np.float64)
        for batch in batches:
            words, features, weight = (np.zeros(batch.num_rows, np.int64) for _ in range(3))
            owner, found, waiting = [], [], 0

            def add() -> None:
                """Sums of the slices that wait, by document; whole numbers below 2^53 are exact in doubles."""
                if found:
                    each = np.concatenate(found)
                    weight[:] += np.bincount(np.repeat(owner, [len(f) for f in found]), weights=by_bucket[each], minlength=len(weight)).astype(np.int64)
                    owner.clear(), found.clear()

            for i, text in enumerate(batch.column(len(rest))):
                for n, got in buckets_of(text.as_buffer(), ngram, buckets) if text.is_valid else ():
                    words[i] += n
                    features[i] += len(got)
                    owner.append(i)
                    found.append(got)
                    waiting += len(got)
                    if waiting > SLICE:
                        add()
                        waiting = 0
            add()
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(rest)], pa.array(words), pa.array(features), pa.array(weight)], [*rest, "n_words", "n_features", "weight"])
        give_back()

    given = docs.select(*rest, F.col(text_col).cast("string").alias(text_col))
    schema = given.drop(text_col).schema
    for c in ("n_words", "n_features", "weight"):
        schema = schema.add(c, "long")
    return given.mapInArrow(run, schema)


def ranked(rows: DataFrame, *order) -> DataFrame:
    """rows with rank (long, from 1) in this order: sorted by ranges, each row's place in its range and the sizes of the ranges before it.

    rows are written first: the ranges are chosen from a sample of them, which would compute them twice.
    """
    placed = cut(cut(rows).repartitionByRange(*order).sortWithinPartitions(*order).withColumn("place", F.monotonically_increasing_id()))
    part = F.shiftright("place", 33).cast("int")
    sizes = placed.groupBy(part.alias("part")).agg(F.count("*").alias("size"))  # a row for each partition
    starts = sizes.select("part", F.coalesce(F.sum("size").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("start"))
    return placed.withColumn("part", part).join(F.broadcast(starts), "part").withColumn("rank", F.col("start") + F.col("place").bitwiseAND(F.lit((1 << 33) - 1)) + 1).drop("part", "place", "start")


def resample(docs: DataFrame, target: DataFrame, id_col: str = "doc_id", text_col: str = "text", target_col: str = "text", percent: int = PERCENT, min_words: int = MIN_WORDS, ngram: int = NGRAM, buckets: int = BUCKETS, seed: str = SEED) -> DataFrame:
    """docs without the text, with n_words, n_features, weight, score and rank: of the N documents with min_words words the percent * N / 100 with the highest scores are ranked from 1, others have null."""
    gain = gains(bucket_counts(docs, text_col, ngram, buckets), bucket_counts(target, target_col, ngram, buckets))
    given = docs.drop("n_words", "n_features", "weight", "score", "rank")
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit(""))).cast("binary"), 256), 1, 8), 16, 10).cast("double")
    noise = F.floor(F.lit(-1000.0) * F.log(-F.log((h + 0.5) / F.lit(4294967296.0))))
    scored = weigh(given, gain, text_col, ngram).withColumn("score", F.col("weight") + noise)
    long_enough = F.col("n_words") >= min_words
    out = ranked(scored, long_enough.desc(), F.col("score").desc(), F.col(id_col).asc())
    drawn = out.agg(F.count_if(long_enough)).first()[0] * percent // 100
    return out.withColumn("rank", F.when(F.col("rank") <= drawn, F.col("rank")))


def op12(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return resample(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("text")).select("doc_id", "n_features", "weight", "score", "rank")


#: CRC-32 bit by bit, over distinct words.
SQL = r"""
WITH texts AS (SELECT 'd' AS side, doc_id AS id, text FROM documents UNION ALL SELECT 'b', item_id, text FROM benchmark),
split AS (SELECT side, id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words FROM texts),
counted AS (SELECT side, id, word, count(*) AS n FROM (SELECT side, id, unnest(words) AS word FROM split) GROUP BY ALL),
bytes AS (SELECT word, hex(word) AS h FROM (SELECT DISTINCT word FROM counted)),
hashed AS (
  SELECT word, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(1, len(h)::BIGINT, 2), lambda i: ('0x' || h[i:i + 1])::BIGINT)),
      lambda c, b: list_reduce(list_prepend(xor(c, b), range(8)), lambda r, k: xor(r >> 1, CASE WHEN r % 2 = 1 THEN 3988292384 ELSE 0 END))), 4294967295) % 10000 AS bucket
  FROM bytes),
sums AS (SELECT bucket, coalesce(sum(n) FILTER (side = 'd'), 0)::DOUBLE AS s, coalesce(sum(n) FILTER (side = 'b'), 0)::DOUBLE AS t FROM counted JOIN hashed USING (word) GROUP BY bucket),
totals AS (SELECT coalesce(sum(s), 0) AS ss, coalesce(sum(t), 0) AS tt FROM sums),
gain AS (SELECT bucket, floor(1000 * ln(((t + 1) * (ss + 10000)) / ((s + 1) * (tt + 10000))))::BIGINT AS gain FROM sums, totals),
weights AS (SELECT id, sum(n * gain)::BIGINT AS weight FROM counted JOIN hashed USING (word) JOIN gain USING (bucket) WHERE side = 'd' GROUP BY id),
scored AS (
  SELECT id AS doc_id, len(words)::BIGINT AS n_features, coalesce(weight, 0)::BIGINT AS weight,
         (coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || sha256('2024:' || id)[1:8])::BIGINT + 0.5::DOUBLE) / 4294967296))))::BIGINT AS score
  FROM split LEFT JOIN weights USING (id) WHERE side = 'd'),
placed AS (SELECT *, row_number() OVER (ORDER BY n_features >= 20 DESC, score DESC, doc_id) AS place, count(*) FILTER (n_features >= 20) OVER () AS n FROM scored)
SELECT doc_id, n_features, weight, score, CASE WHEN place <= n * 10 // 100 THEN place END::BIGINT AS rank FROM placed
"""
