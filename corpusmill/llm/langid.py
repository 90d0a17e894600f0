"""Language identification by hyperdimensional profiles.

Every letter has a random vector of +1 and -1 for each place in an n-gram (the place's permutation of the
letter's base vector); an n-gram's vector is their elementwise product, a text's vector the sum over
its n-grams, a language's prototype the sum over its training texts' unit vectors. A text gets the
language of the prototype nearest by cosine; the score is that cosine, not below 0.

Letters are lower-cased; a run of anything else is one blank. a-z and the blank have codes of their
own, other letters share ``OTHER`` codes by code point.

Training reads a bounded sample: of each language about ``per_language`` documents at most, those with the
smallest hash of their id as a share of the language's count. Prototypes are one vector for each language;
languages beyond ``max_languages`` are refused, so what reaches the driver is bounded.

Defined results: a null text or one without a letter is ``und`` with score 0, as is every text if nothing
could be learned; rows with a null text or language train nothing; ties go to the language first in
order; equal rows get equal results; other columns aren't read; texts are read whole, and memory
for a text grows with its length by a few numbers a character.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusmill.llm.memory import give_back, short_batches

WIDTH, OTHER, GRAM, SEED = 512, 29, 3, 9
#: n-gram vectors kept and used at once, and the n-grams from which counting beats sorting.
KEPT, CHUNK, MANY = 32_768, 4_096, 30_000
CODES = 27 + OTHER


@lru_cache(1)
def letter_vectors() -> np.ndarray:
    """(place, code, WIDTH): place k holds the base vectors permuted k times."""
    rng = np.random.default_rng(SEED)
    base = rng.choice(np.array([-1, 1], dtype=np.int8), size=(CODES, WIDTH))
    order, out = rng.permutation(WIDTH), [base]
    for _ in range(GRAM - 1):
        out.append(out[-1][:, order])
    return np.stack(out)


class GramStore:
    """Vectors of the n-grams met last, as int8; when KEPT are held the store starts anew, so a worker keeps 16 MB at most."""

    def __init__(self):
        self.place = np.full(CODES**GRAM, -1, dtype=np.int32)
        self.vectors, self.used = np.zeros((KEPT, WIDTH), dtype=np.int8), 0

    def rows(self, grams: np.ndarray) -> np.ndarray:
        """Vectors of KEPT different n-gram codes or fewer."""
        new = grams[self.place[grams] < 0]
        if self.used + len(new) > KEPT:
            self.place[:], self.used, new = -1, 0, grams
        letters, to = letter_vectors(), self.used + len(new)
        self.vectors[self.used : to] = letters[2, new // CODES**2] * letters[1, new // CODES % CODES] * letters[0, new % CODES]
        self.place[new] = np.arange(self.used, to)
        self.used = to
        return self.vectors[self.place[grams]]


@lru_cache(1)
def gram_store() -> GramStore:
    return GramStore()


@lru_cache(1)
def code_table() -> np.ndarray:
    table = np.zeros(0x110000, dtype=np.uint8)
    for start in range(0, 0x110000, 0x1000):
        for c in range(start, start + 0x1000):
            if not 0xD800 <= c < 0xE000 and (x := chr(c)).isalpha():
                table[c] = c - 96 if "a" <= x <= "z" else 27 + c % OTHER
    return table


def codes_of(text: str) -> np.ndarray:
    """Codes of the letters, with one 0 for each run of others and one at either end."""
    points = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    codes = code_table()[points]
    keep = np.ones(len(codes), dtype=bool)
    keep[1:] = (codes[1:] != 0) | (codes[:-1] != 0)
    codes = codes[keep]
    return np.concatenate([np.zeros(1, np.uint8), codes[int(len(codes) > 0 and codes[0] == 0) :], np.zeros(int(len(codes) > 0 and codes[-1] != 0), np.uint8)])


def text_vector(text: str | None) -> np.ndarray | None:
    """The text's bundle, or None if it has no letter."""
    if not text:
        return None
    codes = codes_of(text).astype(np.int64)
    if len(codes) < GRAM or not codes.any():
        return None
    grams = (codes[:-2] * CODES + codes[1:-1]) * CODES + codes[2:]
    if len(grams) < MANY:
        found, counts = np.unique(grams, return_counts=True)
    else:
        counts = np.bincount(grams)
        found = np.flatnonzero(counts)
        counts = counts[found]
    out, counts = np.zeros(WIDTH, dtype=np.float32), counts.astype(np.float32)
    for at in range(0, len(found), CHUNK):
        out += counts[at : at + CHUNK] @ gram_store().rows(found[at : at + CHUNK]).astype(np.float32)
    return out


def _bundles(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """(lang, text) to one sum of unit vectors for each language of the partition."""
    sums: dict[str, np.ndarray] = {}
    for frame in frames:
        for lang, text in zip(frame["lang"], frame["text"], strict=True):
            if (v := text_vector(text)) is not None and (n := float(np.linalg.norm(v))) > 0:
                sums[lang] = sums.get(lang, 0) + v.astype(np.float64) / n
    if sums:
        yield pd.DataFrame({"lang": list(sums), "bundle": [v.tolist() for v in sums.values()]})


def train(labelled: DataFrame, id_col: str = "doc_id", per_language: int = 2000, max_languages: int = 500) -> dict[str, np.ndarray]:
    """Prototypes from columns id_col, text, lang. The sample is drawn on ids and languages alone; texts are read for it only."""
    rows = short_batches(labelled.filter("text is not null and lang is not null"))
    counts = rows.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(max_languages + 1).collect()
    if len(counts) > max_languages:
        raise ValueError(f"more than {max_languages} languages to learn")
    if not counts:
        return {}
    share = F.element_at(F.create_map(*[x for r in counts for x in (F.lit(r["lang"]), F.lit(min(1.0, per_language / r["count"])))]), F.col("lang"))
    at = F.pmod(F.xxhash64(F.lit("sample"), F.coalesce(F.col(id_col).cast("string"), F.lit(""))), F.lit(1 << 30)) / float(1 << 30)
    parts = rows.filter(at < share).select("lang", "text").mapInPandas(_bundles, "lang string, bundle array<double>")
    total = parts.select("lang", F.posexplode("bundle").alias("i", "v")).groupBy("lang", "i").agg(F.sum(F.round("v", 9)).alias("v"))
    found = total.groupBy("lang").agg(F.array_sort(F.collect_list(F.struct("i", "v"))).alias("b")).select("lang", "b.v").collect()
    return {r["lang"]: np.array(r["v"]) for r in sorted(found, key=lambda r: r["lang"])}


def identify(docs: DataFrame, prototypes: dict[str, np.ndarray], text_col: str = "text") -> DataFrame:
    """docs with struct column ``language``(lang_pred, score); replaces a column of that name."""
    names = sorted(prototypes)
    matrix = np.array([prototypes[x] / (np.linalg.norm(prototypes[x]) or 1) for x in names], dtype=np.float32)

    @F.pandas_udf("lang_pred string, score double")
    def predict(texts: pd.Series) -> pd.DataFrame:
        out = []
        for text in texts:
            v = text_vector(text)
            if v is None or not names:
                out.append(("und", 0.0))
                continue
            cos = matrix @ v / (float(np.linalg.norm(v)) or 1.0)
            best = int(cos.argmax())
            out.append((names[best], float(np.clip(cos[best], 0, 1))))
        give_back()
        return pd.DataFrame(out, columns=["lang_pred", "score"])

    # else a filter on the result would have the function run once more for each use
    return short_batches(docs).withColumn("language", predict.asNondeterministic()(F.col(text_col)))


def held_out(id_col: str = "doc_id"):
    """True for the third of the documents that is kept for testing."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 3 == 1, F.lit(False))


def op9(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")
    prototypes = train(docs.filter(~held_out()))
    return identify(docs.select("doc_id", "text"), prototypes).select("doc_id", held_out().alias("held_out"), "language.lang_pred", "language.score")
