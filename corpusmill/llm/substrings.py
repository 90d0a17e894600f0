"""Substring dedup: Rabin-Karp hashes of every fixed-length token window, counted over the whole corpus.

Documents are dealt into blocks of bounded size by a hash of id and text. A block hashes all its windows at once
(a rolling polynomial over the words' XXH3, then mixed) and sends its distinct hashes, sorted and
packed, to the ranges of the hash space, so a window that many documents share travels once a block. A range
finds the hashes that occur in two blocks or twice in one and sends each block a bit for each of its
hashes. The block, whose documents are still where the same exchange put them, hashes its windows again and sends the marked ones
once more, now with a second hash of other words' hashes (XXH64) and another base; the range confirms the pairs that occur twice. In a third
pass the block marks the confirmed windows, merges them into maximal intervals and cuts these out.

A window repeats if both 64-bit hashes do, which two different windows share by chance with a probability of 2**-128. A block sends to the ranges that it has hashes
for, so there is at most one message for each window, however many ranges and blocks there are.

Defined results: words are maximal runs without the bytes 9-13 and 32; a null or empty text has none and its kept text is empty;
a document shorter than a window loses nothing and its text stays as it is, byte for byte; a removed interval goes with the white space after it; equal rows (same id, same text)
count as separate documents and share a block; an empty table gives an empty result; other columns are kept, columns of the result's names are replaced. A text of any length is
hashed in pieces.
"""

from __future__ import annotations

import re
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusmill.llm.memory import give_back, short_batches

WINDOW = 35
BLOCK_BYTES = 4 << 20
RANGE_WORDS = 1 << 21
PIECE = 1 << 20
#: Word hash and base of the first and of the second hash of a window.
FIRST, SECOND = (xxhash.xxh3_64_intdigest, 0xD6E8FEB86659FD93), (xxhash.xxh64_intdigest, 0x9E3779B97F4A7C15)
SPACE = re.compile(rb"[\x20\x09-\x0D]")


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, dtype=np.uint64)
    if n:
        out[0] = 1
        np.multiply.accumulate(out, out=out)
    return out


def pieces_of(text: bytes) -> list[bytes]:
    """The text cut at white space into pieces of about PIECE bytes, or of a longer word."""
    if len(text) <= PIECE:
        return [text]
    out, at = [], 0
    while at < len(text):
        found = SPACE.search(text, at + PIECE)
        to = found.start() if found else len(text)
        out.append(text[at:to])
        at = to
    return out


def word_hashes(text: bytes, digest=FIRST[0]) -> np.ndarray:
    """Hash of each word of a text."""
    return np.concatenate([np.fromiter(map(digest, piece.split(), repeat(42)), dtype=np.uint64) for piece in pieces_of(text)])


class Windows:
    """All windows of a block's texts: words of each text, and the place of each window's first word among the words of all texts."""

    def __init__(self, texts: list[bytes], window: int):
        self.texts, self.window = texts, window
        words = [word_hashes(t, FIRST[0]) for t in texts]
        self.n_words = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
        words = np.concatenate(words) if words else np.zeros(0, np.uint64)
        owner = np.repeat(np.arange(len(texts)), self.n_words)
        n = max(0, len(words) - window + 1)
        self.at = np.flatnonzero(owner[:n] == owner[window - 1 :]) if n else np.zeros(0, np.int64)
        self.first = self._rolled(words, FIRST[1], self.at)
        self.found, self.inverse, counts = np.unique(self.first, return_inverse=True, return_counts=True)
        self.twice = counts > 1

    def _rolled(self, words: np.ndarray, base: int, at: np.ndarray) -> np.ndarray:
        sums = np.zeros(len(words) + 1, dtype=np.uint64)
        np.cumsum(words * _powers(base, len(words)), out=sums[1:])
        return _mixed((sums[at + self.window] - sums[at]) * _powers(pow(base, -1, 1 << 64), len(words))[at])

    def pairs(self, marked: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """For the windows whose distinct first hash is marked: (distinct pairs as first hashes and as second hashes, whether a pair occurs twice, each window's pair); unmarked windows have pair -1."""
        hit = np.flatnonzero(marked[self.inverse]) if len(self.found) else np.zeros(0, np.int64)
        owner = np.searchsorted(np.cumsum(self.n_words), self.at[hit], "right")
        mine, second = np.unique(owner), np.zeros(len(hit), np.uint64)
        # only texts with a marked window are hashed a second time
        starts = np.concatenate([[0], np.cumsum(self.n_words)])
        cuts = np.searchsorted(owner, np.append(mine, len(self.texts)))
        for k, t in enumerate(mine.tolist()):
            a, b = cuts[k], cuts[k + 1]
            second[a:b] = self._rolled(word_hashes(self.texts[t], SECOND[0]), SECOND[1], self.at[hit[a:b]] - starts[t])
        order = np.lexsort((second, self.first[hit]))
        one, two = self.first[hit][order], second[order]
        new = np.ones(len(hit), dtype=bool)
        new[1:] = (one[1:] != one[:-1]) | (two[1:] != two[:-1])
        group = np.cumsum(new) - 1
        of = np.full(len(self.at), -1, dtype=np.int64)
        of[hit[order]] = group
        return one[new], two[new], np.bincount(group, minlength=int(new.sum())) > 1, of


def _pack(hashes: np.ndarray, twice: np.ndarray) -> bytes:
    """Sorted distinct hashes: low halves as they are, high halves as differences by byte plane, and the flags."""
    high = (hashes >> np.uint64(32)).astype(np.uint32)
    steps = np.diff(high, prepend=np.uint32(0)).view(np.uint8).reshape(-1, 4)
    low = hashes.astype(np.uint32).view(np.uint8)
    rest = zstandard.ZstdCompressor(level=1).compress(steps.T.tobytes() + np.packbits(twice).tobytes())
    return len(hashes).to_bytes(4, "little") + low.tobytes() + rest


def _unpack(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    n = int.from_bytes(data[:4], "little")
    low = np.frombuffer(data, dtype=np.uint32, count=n, offset=4)
    rest = np.frombuffer(zstandard.ZstdDecompressor().decompress(data[4 + 4 * n :]), dtype=np.uint8)
    steps = np.ascontiguousarray(rest[: 4 * n].reshape(4, n).T).view(np.uint32).ravel()
    high = np.cumsum(steps, dtype=np.uint32).astype(np.uint64)
    return (high << np.uint64(32)) | low, np.unpackbits(rest[4 * n :], count=n).astype(bool)


def _bytes_of(column) -> list[bytes]:
    return [b"" if v is None else v for v in column.cast(pa.large_binary()).to_pylist()]


def _compressed(data: bytes) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(data)


def _bits(mask: np.ndarray) -> bytes:
    return _compressed(np.packbits(mask).tobytes())


def _unbits(data: bytes, n: int) -> np.ndarray:
    return np.unpackbits(np.frombuffer(zstandard.ZstdDecompressor().decompress(data), dtype=np.uint8), count=n).astype(bool)


def _cuts(hashes: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted hashes to the ranges they fall into, and where each range's hashes start and the last ones end."""
    ranges = (hashes >> np.uint64(64 - bits)).astype(np.int64)
    starts = np.flatnonzero(np.diff(ranges, prepend=-1))
    return ranges[starts], np.append(starts, len(hashes))


def _marks(found: np.ndarray, table: pa.Table, column: str, bits: int) -> np.ndarray:
    """Bits of all of a block's sorted hashes, from the masks that the ranges have sent."""
    out, (ranges, cuts) = np.zeros(len(found), dtype=bool), _cuts(found, bits)
    for r, data in zip(table.column("range").to_pylist(), table.column(column).to_pylist(), strict=True):
        i = int(np.searchsorted(ranges, r))
        out[cuts[i] : cuts[i + 1]] = _unbits(data, int(cuts[i + 1] - cuts[i]))
    return out


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, block_bytes: int = BLOCK_BYTES, range_words: int = RANGE_WORDS) -> DataFrame:
    """docs with the repeated passages cut out of the text and columns n_words, n_removed, spans (first and last word of each removed interval)."""
    docs = docs.drop("n_words", "n_removed", "spans")
    block_col = "_block"
    while block_col in docs.columns:
        block_col += "_"
    total = docs.agg(F.coalesce(F.sum(F.octet_length(text_col)), F.lit(0)).alias("bytes")).first()["bytes"]
    n_blocks, bits = max(1, -(-total // block_bytes)), max(1, (total // 6 // range_words).bit_length())
    blocked = docs.withColumn(block_col, F.pmod(F.xxhash64(F.col(id_col), F.col(text_col)), F.lit(n_blocks)))
    blocked = short_batches(blocked).withColumn(text_col, F.col(text_col).cast("string"))

    def send(table: pa.Table) -> pa.Table:
        block, mine = table.column(block_col)[0].as_py(), Windows(_bytes_of(table.column(text_col)), window)
        ranges, cuts = _cuts(mine.found, bits)
        data = [_pack(mine.found[a:b], mine.twice[a:b]) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
        return pa.table({"range": pa.array(ranges, pa.int64()), "block": pa.array([block] * len(ranges), pa.int64()), "data": pa.array(data, pa.binary())})

    def count(table: pa.Table) -> pa.Table:
        parts = [_unpack(d) for d in table.column("data").to_pylist()]
        every = np.sort(np.concatenate([p[0] for p in parts]))
        again = np.unique(np.concatenate([every[1:][every[1:] == every[:-1]], *[p[0][p[1]] for p in parts]]))
        blocks, masks = [], []
        for block, (found, _) in zip(table.column("block").to_pylist(), parts, strict=True):
            if len(again) and (mask := again[np.minimum(np.searchsorted(again, found), len(again) - 1)] == found).any():
                blocks.append(block)
                masks.append(_bits(mask))
        return pa.table({"block": pa.array(blocks, pa.int64()), "range": pa.array([table.column("range")[0].as_py()] * len(blocks), pa.int64()), "mask": pa.array(masks, pa.binary())})

    def send_pairs(table: pa.Table, masks: pa.Table) -> pa.Table:
        if not (table.num_rows and masks.num_rows):
            return pa.table({"range": pa.array([], pa.int64()), "block": pa.array([], pa.int64()), "mask": pa.array([], pa.binary()), "data": pa.array([], pa.binary()), "second": pa.array([], pa.binary())})
        block, mine = table.column(block_col)[0].as_py(), Windows(_bytes_of(table.column(text_col)), window)
        one, two, twice, _ = mine.pairs(_marks(mine.found, masks, "mask", bits))
        ranges, cuts = _cuts(one, bits)
        sent = dict(zip(masks.column("range").to_pylist(), masks.column("mask").to_pylist(), strict=True))
        data = [_pack(one[a:b], twice[a:b]) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
        second = [two[a:b].tobytes() for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
        return pa.table({"range": pa.array(ranges, pa.int64()), "block": pa.array([block] * len(ranges), pa.int64()), "mask": pa.array([sent[r] for r in ranges.tolist()], pa.binary()), "data": pa.array(data, pa.binary()), "second": pa.array(second, pa.binary())})

    def confirm(table: pa.Table) -> pa.Table:
        parts = [(*_unpack(d), np.frombuffer(s, np.uint64)) for d, s in zip(table.column("data").to_pylist(), table.column("second").to_pylist(), strict=True)]
        one, two, twice = (np.concatenate([p[i] for p in parts]) for i in (0, 2, 1))
        order = np.lexsort((two, one))
        same = np.zeros(len(order) + 1, dtype=bool)
        same[1:-1] = (one[order[1:]] == one[order[:-1]]) & (two[order[1:]] == two[order[:-1]])
        # within a block pairs are distinct, so an equal neighbour is another block's
        marked = np.zeros(len(order), dtype=bool)
        marked[order] = same[1:] | same[:-1]
        marked |= twice
        ends = np.cumsum([len(p[0]) for p in parts])
        masks = [_bits(marked[e - len(p[0]) : e]) for e, p in zip(ends, parts, strict=True)]
        return pa.table({"block": table.column("block"), "range": table.column("range"), "mask": table.column("mask"), "confirmed": pa.array(masks, pa.binary())})

    span = T.ArrayType(T.StructType([T.StructField("first", T.LongType()), T.StructField("last", T.LongType())]))
    names = docs.columns
    added = [T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType()), T.StructField("spans", span)]
    out_schema = T.StructType([f if f.name != text_col else T.StructField(text_col, T.StringType()) for f in docs.schema.fields] + added)

    def cut_out(table: pa.Table, masks: pa.Table) -> pa.Table:
        if not table.num_rows:
            return _nothing(out_schema)
        texts = _bytes_of(table.column(text_col))
        mine = Windows(texts, window)
        one, _, _, of = mine.pairs(_marks(mine.found, masks, "mask", bits))
        first = mine.at[(of >= 0) & np.append(_marks(one, masks, "confirmed", bits), False)[of]]
        change = np.zeros(int(mine.n_words.sum()) + 1, dtype=np.int64)
        np.add.at(change, first, 1)
        np.add.at(change, first + window, -1)
        gone = np.cumsum(change[:-1]) > 0
        kept, removed, spans, begin = [], [], [], 0
        for text, n in zip(texts, mine.n_words.tolist(), strict=True):
            lost = gone[begin : begin + n]
            begin += n
            removed.append(int(lost.sum()))
            edge = np.flatnonzero(np.diff(np.concatenate([[False], lost, [False]]).astype(np.int8))).tolist() if removed[-1] else []
            found = list(zip(edge[::2], edge[1::2], strict=True))
            kept.append(without(text, found) if found else text)
            spans.append([{"first": a, "last": b - 1} for a, b in found])
        columns = {c: table.column(c) for c in names}
        columns[text_col] = pa.array(kept, pa.large_binary()).cast(pa.large_string())
        columns |= {"n_words": pa.array(mine.n_words, pa.int64()), "n_removed": pa.array(removed, pa.int64()), "spans": pa.array(spans, pa.list_(pa.struct([("first", pa.int64()), ("last", pa.int64())])))}
        give_back()
        return pa.table(columns).cast(_nothing(out_schema).schema)

    sent = blocked.groupBy(block_col).applyInArrow(send, "range long, block long, data binary")
    marked = sent.groupBy("range").applyInArrow(count, "block long, range long, mask binary")
    to_block = lambda df: df.withColumnRenamed("block", block_col).groupBy(block_col)
    pairs = blocked.groupBy(block_col).cogroup(to_block(marked)).applyInArrow(send_pairs, "range long, block long, mask binary, data binary, second binary")
    confirmed = pairs.groupBy("range").applyInArrow(confirm, "block long, range long, mask binary, confirmed binary")
    return blocked.groupBy(block_col).cogroup(to_block(confirmed)).applyInArrow(cut_out, out_schema)


def without(text: bytes, spans: list[tuple[int, int]]) -> bytes:
    """The text without the words of these spans (first, end), each with the white space after it."""
    data = np.frombuffer(text, dtype=np.uint8)
    inside = np.zeros(len(data) + 1, dtype=np.int8)
    inside[1:] = (data != 32) & ((data < 9) | (data > 13))
    starts = np.append(np.flatnonzero(np.diff(inside) == 1), len(text))
    edges = [0, *chain.from_iterable((int(starts[a]), int(starts[b])) for a, b in spans), len(text)]
    return b"".join(text[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True))


def _nothing(schema: T.StructType) -> pa.Table:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(schema).empty_table()


SPACES = r"[\x20\x09-\x0D]+"


def op4(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    words = F.trim(F.regexp_replace("text", SPACES, " "))
    return remove_repeats(docs).select("doc_id", "n_words", "n_removed", F.sha2(F.coalesce(words, F.lit("")), 256).alias("kept_sha256"))


SQL = r"""
WITH docs AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
windows AS (SELECT r, i, array_to_string(w[i : i + 34], ' ') AS s FROM docs, unnest(range(1, len(w) - 33)) AS u(i)),
repeated AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY s) AS n FROM windows) WHERE n > 1),
gone AS (SELECT DISTINCT r, unnest(range(i, i + 35)) AS k FROM repeated),
words AS (SELECT r, k, w[k] AS word FROM docs, unnest(range(1, len(w) + 1)) AS u(k)),
kept AS (SELECT r, count(*) AS n, string_agg(word, ' ' ORDER BY k) AS t FROM words ANTI JOIN gone USING (r, k) GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, (len(w) - coalesce(n, 0))::BIGINT AS n_removed, sha256(coalesce(t, '')) AS kept_sha256 FROM docs LEFT JOIN kept USING (r)
"""
