"""The pipeline over documents: language ID, SimHash near-dedup, substring dedup, mixing to target weights, byte-level BPE.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again as the next one's docs.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusmill.lineage import shared_folder
from corpusmill.llm import bpe, langid, mixing, simhash, substrings
from corpusmill.session import importable

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a letter go; the predicted language replaces a missing one. Learns from the documents that are not held out.

    A null, empty or letterless text goes; rows with a null id, source or lang stay and a null id is never held out; ties go to the language first in order; equal rows stay together;
    if nothing could be learned every text goes; an empty table gives an empty table; columns beside those of documents are dropped.
    """
    prototypes = langid.train(docs.filter(~langid.held_out()).select("doc_id", "text", "lang"))
    known = langid.identify(docs.select(COLUMNS), prototypes).filter("language.lang_pred != 'und'")
    return known.withColumn("lang", F.coalesce("lang", "language.lang_pred")).select(COLUMNS)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-copies (five-word shingles, similarity 0.8 by the fingerprints) one row stays, that with the smallest id.

    Null ids come last, then the text's hash and the other columns decide, so of equal rows one stays; null and empty texts are copies of each other; texts of fewer than five words
    are near-copies if they have the same words; an empty table gives an empty table; columns beside those of documents are dropped.
    """
    return simhash.keep_one(docs.select(COLUMNS)).select(COLUMNS)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of 35 words and more that are found again go from all documents that have them; what is left keeps its white space, and n_chars is its length.

    A null text becomes an empty one; a document that loses all its words stays, with what white space it had before them; equal rows are copies of each other and lose all their words if they have
    35; an empty table gives an empty table; columns beside those of documents are dropped.
    """
    return substrings.remove_repeats(docs.select(COLUMNS)).withColumn("n_chars", F.length("text").cast("long")).select(COLUMNS)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them: none, one or two times.

    A null source is a source of its own, last in order; a text without words has size 0 and is taken like its source's others; null ids come first; equal rows are separate
    rows; an empty table gives an empty table; columns beside those of documents are dropped.
    """
    return mixing.mix(docs.select(COLUMNS)).select(COLUMNS)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids of each document, and digests of the ids and of what they decode to: a row for each row.

    A null text is encoded as an empty one; null ids and sources stay null; an empty table gives an empty table; columns beside doc_id, source and text are dropped.
    """
    encoded = bpe.encode(docs.select("doc_id", "source", "text"), decoded="decoded").drop("text")
    return bpe.digests(encoded, "source")


STAGES = [("language", language), ("near_dedup", near_dedup), ("substring_dedup", substring_dedup), ("mixing", mixing_stage), ("tokens", tokens)]

#: SQL can express neither the learned language profiles nor the ranks' merges.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents."""
    importable(spark)
    docs, folder = spark.read.parquet(f"{sf_dir}/documents.parquet"), f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return docs
