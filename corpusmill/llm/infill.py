"""Fill-in-middle transformation in SQL functions only.

A text is cut into units (words of letters, and every other character alone). Digits of a hash of the document's id give two cuts, the form and so the arrangement: the same document is always
arranged alike, on any cluster and in any order of rows. ``restore`` finds the sentinels in an output and puts the parts together again.

Sentinels may not overlap each other or themselves and a text that contains one stays plain, so every sentinel in an arranged output is one that was put there.

Defined results: a null text is an empty one, and an empty one stays plain; a null id hashes as an empty string; equal rows are arranged alike; cuts at a text's ends give empty parts;
an empty table gives an empty result; other columns are kept, one named as the result is replaced.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

UNIT = "[A-Za-z]+|[^A-Za-z]"
#: Per cent of the texts that are arranged, and of these the share with the suffix first.
ARRANGED, SUFFIX_FIRST, SEED = 90, 20, "1"


class Sentinels(NamedTuple):
    prefix: str = "<P>"
    suffix: str = "<S>"
    middle: str = "<M>"


def check_sentinels(marks: Sentinels) -> None:
    """Refuses sentinels that could be read in two ways: empty, one within another, or the end of one the start of another or of itself."""
    for i, a in enumerate(marks):
        for j, b in enumerate(marks):
            if not a or (i != j and a in b) or any(a[-n:] == b[:n] for n in range(1, min(len(a), len(b)))):
                raise ValueError(f"sentinels {a!r} and {b!r} overlap")


def hash_number(digest: Column, n: int) -> Column:
    """The n-th group of eight hexadecimal digits (from 0) as a number."""
    return F.conv(F.substring(digest, 8 * n + 1, 8), 16, 10).cast("long")


def arrange(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", marks: Sentinels = Sentinels(), arranged: int = ARRANGED, suffix_first: int = SUFFIX_FIRST, seed: str = SEED, unit: str = UNIT, out: str = "infill") -> DataFrame:
    """docs with a struct column (n, form, prefix_chars, middle_chars, output): n units, form plain, psm or spm, lengths in code points (null if plain)."""
    check_sentinels(marks)
    text = F.coalesce(F.col(text_col), F.lit(""))
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit(""))).cast("binary"), 256)
    row = F.struct(*[F.col(c) for c in docs.columns if c != out])
    # one step a select: what a later step uses twice is computed once
    cut = docs.select(row.alias("row"), text.alias("text"), digest.alias("digest"), F.regexp_extract_all(text, F.lit(unit), F.lit(0)).alias("units"))
    cut = cut.withColumn("n", F.size("units").cast("long"))
    first, second = (F.pmod(hash_number(F.col("digest"), i), F.col("n") + 1).cast("int") for i in (0, 1))
    plain = (F.col("n") == 0) | (hash_number(F.col("digest"), 2) % 100 >= arranged)
    for mark in marks:
        plain |= F.contains(F.col("text"), F.lit(mark))
    form = F.when(plain, "plain").when(hash_number(F.col("digest"), 3) % 100 < suffix_first, "spm").otherwise("psm")
    cut = cut.select("row", "text", "units", "n", F.least(first, second).alias("a"), F.greatest(first, second).alias("b"), form.alias("form"))
    part = lambda start, length: F.array_join(F.slice("units", start, length), "")
    # a plain text's units aren't joined again
    parts = F.when(F.col("form") != "plain", F.struct(part(F.lit(1), F.col("a")).alias("p"), part(F.col("a") + 1, F.col("b") - F.col("a")).alias("m"), part(F.col("b") + 1, F.col("n").cast("int") - F.col("b")).alias("s")))
    joined = cut.select("row", "text", "n", "form", parts.alias("parts"))
    p, s, m = F.lit(marks.prefix), F.lit(marks.suffix), F.lit(marks.middle)
    psm = F.concat(p, "parts.p", s, "parts.s", m, "parts.m")
    spm = F.concat(s, "parts.s", p, "parts.p", m, "parts.m")
    output = F.when(F.col("form") == "psm", psm).when(F.col("form") == "spm", spm).otherwise(F.col("text"))
    found = F.struct("n", "form", F.length("parts.p").cast("long").alias("prefix_chars"), F.length("parts.m").cast("long").alias("middle_chars"), output.alias("output"))
    return joined.select("row.*", found.alias(out))


def restore(output: Column, form: Column, marks: Sentinels = Sentinels()) -> Column:
    """The text of an output and its form: the parts between the sentinels, in the order of the text."""
    head, middle = F.split_part(output, F.lit(marks.middle), F.lit(1)), F.split_part(output, F.lit(marks.middle), F.lit(2))
    # what comes first starts with its sentinel, so its part is the second
    inner = lambda first, second: F.split_part(F.split_part(head, F.lit(second), F.lit(1)), F.lit(first), F.lit(2))
    psm = F.concat(inner(marks.prefix, marks.suffix), middle, F.split_part(head, F.lit(marks.suffix), F.lit(2)))
    spm = F.concat(F.split_part(head, F.lit(marks.prefix), F.lit(2)), middle, inner(marks.suffix, marks.prefix))
    return F.when(form == "psm", psm).when(form == "spm", spm).otherwise(output)


def op11(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    found = arrange(docs).select("doc_id", "infill.*")
    digest = lambda c: F.sha2(c.cast("binary"), 256)
    return found.select("doc_id", "n", "form", "prefix_chars", "middle_chars", digest(F.col("output")).alias("output_sha256"), digest(restore(F.col("output"), F.col("form"))).alias("restored_sha256"))


SQL = r"""
WITH docs AS (
  SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[A-Za-z]+|[^A-Za-z]') AS units,
         sha256('1:' || coalesce(doc_id::VARCHAR, '')) AS hash FROM documents),
numbers AS (
  SELECT *, len(units)::BIGINT AS n, ('0x' || hash[1:8])::BIGINT AS h1, ('0x' || hash[9:16])::BIGINT AS h2,
         ('0x' || hash[17:24])::BIGINT AS h3, ('0x' || hash[25:32])::BIGINT AS h4 FROM docs),
cuts AS (
  SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
         CASE WHEN n = 0 OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h3 % 100 >= 90 THEN 'plain'
              WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM numbers),
parts AS (
  SELECT *, coalesce(array_to_string(units[1:a], ''), '') AS p, coalesce(array_to_string(units[a + 1:b], ''), '') AS m, coalesce(array_to_string(units[b + 1:n], ''), '') AS s FROM cuts)
SELECT doc_id, n, form, CASE WHEN form != 'plain' THEN length(p) END AS prefix_chars, CASE WHEN form != 'plain' THEN length(m) END AS middle_chars,
       sha256(CASE form WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m WHEN 'spm' THEN '<S>' || s || '<P>' || p || '<M>' || m ELSE text END) AS output_sha256,
       sha256(text) AS restored_sha256
FROM parts
"""
