"""Byte-level BPE encoding and decoding by longest matches and backtracking.

A rank file's tokens, their bytes mapped to Latin-1, and all beginnings of tokens are the words of a pyahocorasick trie; a beginning's value is the longest
token that begins it, so the longest prefix of a piece that the trie knows gives the longest token there. The encoder takes longest matches from the left. A token
may follow another only if merging their bytes yields just these two again, which is looked up in a memo; a sequence whose neighbours
are all compatible is the one that merging by rank gives. Where no shorter token fits either, the place is marked and the encoder steps back,
so every place is tried a bounded number of times and the time is linear in the piece.

Whether two tokens are compatible follows from undoing their last merges, the later one first: none of the pairs that so come to touch may be
a token that merging by rank would have made earlier.

Defined results: a null text is encoded as an empty one; no ids decode to no bytes; an unknown id raises; equal rows get equal results; other columns are kept,
a column of the result's name is replaced. Texts are encoded whole; memory for a text grows by about one number a byte.
"""

from __future__ import annotations

import base64
from array import array
from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import numpy as np
import pandas as pd
import pyarrow as pa
from public_tokenizers import path
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusmill.llm.memory import give_back, short_batches
from corpusmill.llm.pieces import Memo, matches_of, pieces

RANKS = "byte_bpe_50k.tiktoken"
#: Compatible pairs kept, and bytes of pieces and matches kept in each of two generations.
KEPT_PAIRS, KEPT_BYTES = 150_000, 48 << 20


class Codec:
    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.tokens: list[bytes | None] = [None] * (max(ranks.values(), default=-1) + 1)
        for t, i in ranks.items():
            self.tokens[i] = t
        self.sizes = [len(t or b"") for t in self.tokens]
        self.most = max(self.sizes, default=1)
        self.trie = ahocorasick.Automaton()
        for t in sorted(ranks, key=len):
            name = t.decode("latin-1")
            for n in range(1, len(name)):
                if name[:n] not in self.trie:
                    self.trie.add_word(name[:n], self.trie.get(name[: n - 1], -1))
            self.trie.add_word(name, ranks[t])
        self.pairs: dict[int, bool] = {}
        self.halves: dict[int, tuple[int, int] | None] = {}
        self.known = Memo(KEPT_BYTES)

    def merged(self, data: bytes, below: int | None = None) -> list[bytes]:
        """Merging by rank, plainly; for the bytes of a token or two. Ranks from ``below`` on are left out."""
        parts = [data[i : i + 1] for i in range(len(data))]
        none = len(self.tokens) if below is None else below
        while len(parts) > 1:
            rank, at = min((self.ranks.get(a + b, none), i) for i, (a, b) in enumerate(zip(parts, parts[1:], strict=False)))
            if rank >= none:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def halves_of(self, token: int) -> tuple[int, int]:
        """The two tokens whose merge makes this one; itself twice if it is a byte, (-1, -1) if merging never makes it."""
        if (found := self.halves.get(token)) is None:
            data = self.tokens[token]
            parts = [self.ranks.get(p, -1) for p in self.merged(data, token)]
            found = self.halves[token] = (token, token) if len(data) == 1 else tuple(parts) if len(parts) == 2 else (-1, -1)
        return found

    def fits(self, left: int, right: int) -> bool:
        """Whether the two tokens may stand side by side."""
        key = left << 32 | right
        if (found := self.pairs.get(key)) is None:
            if len(self.pairs) >= KEPT_PAIRS:
                self.pairs.clear()
            found = self.pairs[key] = self._fits(left, right)
        return found

    def _fits(self, left: int, right: int) -> bool:
        tokens, ranks, first, second = self.tokens, self.ranks, left, right
        earliest = len(tokens)
        while True:
            made = ranks.get(tokens[left] + tokens[right])
            if made is not None and made < earliest:
                return False
            # a merge on the left side wins over an equal one further right
            if left > right or self.sizes[right] == 1:
                if self.sizes[left] == 1:
                    return True
                earliest, left = left, self.halves_of(left)[1]
            else:
                earliest, right = right + 1, self.halves_of(right)[0]
            if left < 0 or right < 0:
                return self.merged(tokens[first] + tokens[second]) == [tokens[first], tokens[second]]

    def encode_match(self, piece: bytes) -> list[int]:
        """Ids of one match of the split pattern."""
        if (whole := self.ranks.get(piece)) is not None:
            return [whole]
        text, n, sizes, pairs, most = piece.decode("latin-1"), len(piece), self.sizes, self.pairs, self.most
        reach, value = self.trie.longest_prefix, self.trie.get
        open_places, ids, at, last = None, [], 0, -1
        rest = text[:most]
        token = value(rest[: reach(rest)])
        while at < n:
            end = at + sizes[token]
            if (open_places is None or open_places[end]) and (last < 0 or (fit if (fit := pairs.get(last << 32 | token)) is not None else self.fits(last, token))):
                ids.append(token)
                at, last = end, token
                if at < n:
                    rest = text[at : at + most]
                    token = value(rest[: reach(rest)])
            elif sizes[token] > 1 and (shorter := value(text[at : end - 1])) >= 0:
                token = shorter
            else:
                if open_places is None:
                    open_places = bytearray(b"\1") * (n + 1)
                open_places[at] = 0
                token = ids.pop()
                at -= sizes[token]
                last = ids[-1] if ids else -1
        return ids

    def encode(self, text: str) -> np.ndarray:
        """Ids of a text."""
        return np.frombuffer(self.known.encode(pieces(text), self._pieces) if text else b"", dtype=np.int32)

    def _pieces(self, parts: list[str]) -> list[bytes]:
        out = []
        for p in parts:
            matches = matches_of(p)
            out.append(self._match(p) if len(matches) == 1 else b"".join([found if (found := self.known.get(m)) is not None else self._kept(m) for m in matches]))
        return out

    def _kept(self, match: str) -> bytes:
        found = self._match(match)
        self.known.keep(match, found)
        return found

    def _match(self, match: str) -> bytes:
        return array("i", self.encode_match(match.encode("utf-8", "surrogatepass"))).tobytes()

    def decode(self, ids: np.ndarray) -> bytes:
        return b"".join(map(self.tokens.__getitem__, np.asarray(ids).tolist()))


@lru_cache(4)
def codec(name: str) -> Codec:
    """Of a rank file of public_tokenizers or at a path; kept for the worker's life."""
    with open(name if "/" in name else path(name), "rb") as lines:
        return Codec({base64.b64decode(t): int(i) for t, i in map(bytes.split, filter(bytes.strip, lines))})


def lists(values: list[np.ndarray]) -> pa.Array:
    ends = np.concatenate([[0], np.cumsum([len(v) for v in values])]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(values) if values else np.zeros(0, np.int32), pa.int32()))


SLICE_CHARS = 1 << 21


def slices(texts: Iterator[str | None]) -> Iterator[list[str]]:
    """Texts in order, in lists of bounded size; null as an empty text."""
    held, size = [], 0
    for t in texts:
        held.append(t or "")
        size += len(held[-1])
        if size >= SLICE_CHARS:
            yield held
            held, size = [], 0
    if held:
        yield held


def encode(docs: DataFrame, text_col: str = "text", out: str = "ids", ranks: str = RANKS, decoded: str | None = None) -> DataFrame:
    """docs with an array of ids and, if named, a column of the bytes that these ids decode to."""
    docs = short_batches(docs.drop(*{out, decoded or out} - {text_col}))
    at, names = docs.columns.index(text_col), docs.columns
    more = [T.StructField(out, T.ArrayType(T.IntegerType()))] + ([T.StructField(decoded, T.BinaryType())] if decoded else [])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(ranks)
        for batch in batches:
            row = 0
            for texts in slices(x.as_py() for x in batch.column(at)):
                ids = [c.encode(t) for t in texts]
                made = [lists(ids)] + ([pa.array([c.decode(x) for x in ids], pa.binary())] if decoded else [])
                yield pa.RecordBatch.from_arrays([*batch.slice(row, len(texts)).columns, *made], [*names, *(f.name for f in more)])
                row += len(texts)
        give_back()

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, *more]))


def decode(docs: DataFrame, ids_col: str = "ids", out: str = "decoded", ranks: str = RANKS) -> DataFrame:
    """docs with the bytes that an array of ids stands for; null for null."""

    @F.pandas_udf("binary")
    def run(ids: pd.Series) -> pd.Series:
        c = codec(ranks)
        return pd.Series([None if x is None else c.decode(np.asarray(x)) for x in ids])

    return docs.withColumn(out, run(F.col(ids_col)))


def digests(encoded: DataFrame, *more: str) -> DataFrame:
    """doc_id, the columns named and the digests of the contract, from columns ids and decoded."""
    numbers = F.array_join(F.col("ids").cast("array<string>"), " ")
    return encoded.select("doc_id", *more, F.size("ids").cast("long").alias("n_tokens"), F.sha2(numbers, 256).alias("ids_sha256"), F.sha2(F.col("decoded"), 256).alias("decoded_sha256"))


def op6(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return digests(encode(docs, decoded="decoded").drop("text"))
