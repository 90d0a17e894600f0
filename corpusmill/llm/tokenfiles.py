"""Token ids as files of range-coded images, in ascending order of the documents' ids.

Texts are dealt by ranges of the id and of the text's hash and sorted; each task encodes its texts with the tokenizers library, appends the end id to each document and writes images of
some four million ids (see ``coder``), each a row with its part, place, ids before it in the part, document ids and lengths. Spark's writer puts them into the
shared folder, so a lost task is written anew and none twice. A file is read for itself; only the parts' lengths are added up over all files to say where a document starts.

Defined results: a null text is encoded as an empty one, which is its end id alone; a null id comes first; rows with the same id stand side by side in the order of
their texts' hashes, so they may be many; an empty table gives no rows; other columns are not written. Texts are encoded whole. A special token's literal in a text gives that token's id, as
the library has it by itself.
"""

from __future__ import annotations

import json
import os
import uuid
import zlib
from array import array
from collections.abc import Iterator
from functools import lru_cache
from itertools import pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from public_tokenizers import path
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpusmill.lineage import cut, shared_folder
from corpusmill.llm.coder import pack, unpack
from corpusmill.llm.memory import give_back, short_batches
from corpusmill.llm.pieces import SPACES, Memo, all_matches, pieces

TOKENIZER, END, IMAGE_IDS, KEPT_BYTES = "byte_bpe_50k.json", 2, 1 << 22, 32 << 20
#: Bytes of texts that are encoded together; new matches in one call of the model; bytes of a word and its ids that are kept at most.
SLICE_BYTES, TOGETHER, LONGEST = 20 << 20, 10_000, 1024
BEFORE_BLANK_RE = f"[{''.join(f'\\x{{{ord(c):x}}}' for c in SPACES)}] "


class Encoder:
    """The tokenizers library's encoding of whole texts; matches of the split pattern that were seen before are not encoded again.

    The library's own settings hold, so an added token's literal in a text gives that token's id; such texts go to the library whole.
    A byte-level tokenizer whose pieces are the matches of public_tokenizers.PATTERN is encoded piece by piece through its model, any other as a whole.
    The model gets the new matches of many texts in one call, set apart by a line's end, which no byte is named. As its tokens cover a match's bytes, their lengths tell where a match's ids end.
    """

    def __init__(self, name: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import CharDelimiterSplit

        self.library = Tokenizer.from_file(name if "/" in name else path(name))
        self.known = Memo()
        self.words, self.coded, self.used, self.turn = pa.array([], pa.large_string()), pa.array([], pa.large_binary()), np.zeros(0, np.int64), 0
        self.added = [t.content for t in self.library.get_added_tokens_decoder().values()]
        settings = json.loads(self.library.to_str())
        split, model = settings["pre_tokenizer"] or {}, settings["model"]
        plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
        shifted = [b for b in range(256) if b not in plain]
        names = {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(shifted)}
        usual = split.get("type") == "ByteLevel" and split.get("use_regex", True) and not split.get("add_prefix_space") and not settings["normalizer"]
        bare = model.get("type") == "BPE" and not any(model.get(k) for k in ("dropout", "continuing_subword_prefix", "end_of_word_suffix")) and model["vocab"].keys() >= set(names.values())
        self.by_piece = usual and bare
        if self.by_piece:
            bare = self.library.model
            if hasattr(bare, "_resize_cache"):
                bare._resize_cache(0)  # what it gets is new; looking it up takes a fifth of the time
            self.model = Tokenizer(bare)
            self.model.pre_tokenizer = CharDelimiterSplit("\n")
            self.names = np.array([ord(names[b]) for b in range(256)], np.uint16)
            self.widths = np.zeros(max(model["vocab"].values()) + 1, np.int64)
            self.widths[list(model["vocab"].values())] = list(map(len, model["vocab"]))

    def _matches(self, matches: pa.Array) -> pa.Array:
        """Ids of matches through the model, as unsigned 32-bit integers."""
        ends, data = np.frombuffer(matches.buffers()[1], np.int64, len(matches) + 1), self.names[np.frombuffer(matches.buffers()[2] or b"", np.uint8)]
        ids, bounds = [], [np.zeros(1, np.int64)]
        for i in range(0, len(matches), TOGETHER):
            some = ends[i : i + TOGETHER + 1]
            named = np.insert(data[some[0] : some[-1]], some[1:-1] - some[0], ord("\n")).astype("<u2").tobytes().decode("utf-16-le")
            ids.append(np.array(self.model.encode_batch_fast([named], add_special_tokens=False)[0].ids, np.uint32))
            covered = np.cumsum(self.widths[ids[-1]])
            last = np.searchsorted(covered, some[1:] - some[0])
            if (covered[last] != some[1:] - some[0]).any():
                raise ValueError("the model's tokens do not cover a text")
            bounds.append(bounds[-1][-1] + (last + 1) * 4)
        return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(matches), [None, pa.py_buffer(np.concatenate(bounds)), pa.py_buffer(np.concatenate(ids))])

    def _coded(self, parts: list[str]) -> pa.Array:
        """Ids of pieces."""
        if not parts:
            return pa.array([], pa.large_binary())
        cuts = all_matches(parts)
        ends = np.append(0, np.cumsum(list(map(len, cuts))))
        matches = pa.array([m for c in cuts for m in c], pa.large_string()).dictionary_encode()
        ids = self._matches(matches.dictionary).take(matches.indices)
        bounds = np.frombuffer(ids.buffers()[1], np.int64, len(ids) + 1)[ends]
        return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(parts), [None, pa.py_buffer(bounds), ids.buffers()[2]])

    def _pieces(self, parts: list[str]) -> list[bytes]:
        return self._coded(parts).to_pylist()

    def encode(self, text: str) -> bytes:
        """Ids as unsigned 32-bit integers."""
        if not text:
            return b""
        if not self.by_piece or any(t in text for t in self.added):
            return array("I", self.library.encode(text, add_special_tokens=False).ids).tobytes()
        return self.known.encode(pieces(text), self._pieces)

    def encode_all(self, texts: pa.Array, end: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in order, each text's followed by the end id, and where each text's begin, with the end of all. A null text is an empty one.

        Texts are cut at blanks and each different word is looked up once; a text that pieces() cuts in another way, or that has an added token's literal, is encoded by itself.
        """
        n, texts = len(texts), texts.fill_null("")
        if self.by_piece:
            apart = pc.match_substring_regex(texts, BEFORE_BLANK_RE)
            for t in self.added:
                apart = pc.or_(apart, pc.match_substring(texts, t))
        else:
            apart = pa.array(np.ones(n, bool))
        words = pc.split_pattern(pc.if_else(apart, "", texts), " ")
        starts, words = words.offsets.to_numpy().astype(np.int64), words.values
        heads = pc.if_else(apart, texts, words.take(pa.array(starts[:-1]))).to_pylist()
        firsts = list({h for h, x in zip(heads, apart.to_pylist(), strict=True) if h and not x})
        firsts = dict(zip(firsts, self.known.each(firsts, self._pieces), strict=True))
        heads = [firsts[h] if h in firsts and not x else self.encode(h) for h, x in zip(heads, apart.to_pylist(), strict=True)]
        coded, index = self._words(words)
        index[starts[:-1]] = len(coded) + np.arange(n)
        index = np.insert(index, starts[1:], len(coded) + n)
        taken = pa.concat_arrays([coded, pa.array([*heads, int(end).to_bytes(4, "little")], pa.large_binary())]).take(pa.array(index))
        offsets = np.frombuffer(taken.buffers()[1], np.int64, len(index) + 1) // 4
        return np.frombuffer(taken.buffers()[2], np.uint32, offsets[-1]), offsets[starts + np.arange(n + 1)]

    def _words(self, words: pa.Array) -> tuple[pa.Array, np.ndarray]:
        """Ids of different words with a blank before each, and each word's place among them; those not used of late are forgotten when there are too many."""
        words, coded = words.cast(pa.large_string()), self.coded
        last = pa.chunked_array([self.words, words]).dictionary_encode().chunks[-1]
        index, different = last.indices.to_numpy().astype(np.int64), last.dictionary
        new = different[len(coded) :].to_numpy(zero_copy_only=False).tolist()
        coded = pa.concat_arrays([coded, self._coded([" " + w for w in new])])
        self.turn += 1
        used = np.concatenate([self.used, np.zeros(len(new), np.int64)])
        used[index] = self.turn
        self.words, self.coded, self.used = different, coded, used
        if different.nbytes + coded.nbytes > KEPT_BYTES:
            sizes = (pc.binary_length(different).to_numpy() + pc.binary_length(coded).to_numpy()).astype(np.int64) + 16
            order = np.argsort(-used, kind="stable")
            order = order[sizes[order] <= LONGEST]
            kept = pa.array(order[np.cumsum(sizes[order]) <= KEPT_BYTES // 2])
            self.words, self.coded, self.used = different.take(kept), coded.take(kept), used[kept.to_numpy()]
        return coded, index


@lru_cache(2)
def _tokenizer(name: str) -> Encoder:
    return Encoder(name)


def encode_text(text: str, tokenizer: str = TOKENIZER) -> np.ndarray:
    """Ids of a text."""
    return np.frombuffer(_tokenizer(tokenizer).encode(text), dtype=np.uint32)


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[list[pa.Array]]:
    """The columns of many rows together, in order, of SLICE_BYTES of texts at most or of one text."""
    held, size = [], 0
    for batch in batches:
        ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(1)), 0).to_numpy().astype(np.int64))
        at = 0
        while at < len(ends):
            begun = int(ends[at - 1]) if at else 0
            stop = int(np.searchsorted(ends, begun + SLICE_BYTES - size, "right"))
            if stop <= at and not held:
                stop = at + 1
            if stop > at:
                held.append(batch.slice(at, stop - at))
                size, at = size + int(ends[stop - 1]) - begun, stop
            if at < len(ends):
                yield [pa.concat_arrays(c) for c in zip(*(b.columns for b in held), strict=True)]
                held, size = [], 0
    if held:
        yield [pa.concat_arrays(c) for c in zip(*(b.columns for b in held), strict=True)]


IMAGES = "part int, place int, before bigint, n_ids bigint, doc_ids array<bigint>, lengths array<bigint>, image binary"
#: Parts whose starts are broadcast, 12 bytes each; more are joined.
MAX_PARTS = 1_000_000


def write_ids(docs: DataFrame, folder: str, id_col: str = "doc_id", text_col: str = "text", tokenizer: str = TOKENIZER, end: int = END, image_ids: int = IMAGE_IDS) -> None:
    """Writes the ids of all texts to folder."""
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    rows = short_batches(rows).withColumn("hash", F.xxhash64("text")).repartitionByRange("id", "hash").sortWithinPartitions("id", "hash", "text").select("id", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = _tokenizer(tokenizer).encode_all
        part, place, before, doc_ids, held, size = TaskContext.get().partitionId(), 0, 0, [], [], 0

        def image() -> pa.RecordBatch:
            numbers = [pa.array([part], pa.int32()), pa.array([place], pa.int32()), pa.array([before], pa.int64()), pa.array([size], pa.int64())]
            lists = [pa.array([doc_ids], pa.list_(pa.int64())), pa.array([list(map(len, held))], pa.list_(pa.int64()))]
            packed = pa.array([pack(np.concatenate(held))], pa.binary())
            return pa.RecordBatch.from_arrays([*numbers, *lists, packed], ["part", "place", "before", "n_ids", "doc_ids", "lengths", "image"])

        for doc_ids_of, texts in _slices(batches):
            found, bounds = encode(texts, end)
            for doc_id, (first, stop) in zip(doc_ids_of.to_pylist(), pairwise(bounds.tolist()), strict=True):
                held.append(found[first:stop])
                doc_ids.append(doc_id)
                size += stop - first
                if size >= image_ids:
                    yield image()
                    place, before, doc_ids, held, size = place + 1, before + size, [], [], 0
        if held:
            yield image()
        give_back()

    rows.mapInArrow(run, IMAGES).write.parquet(folder)


def read_ids(spark: SparkSession, folder: str, ids: bool = True) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32 and, if asked for, ids) of all documents in folder; checks every block."""
    images = spark.read.schema(IMAGES).parquet(folder)
    parts = images.groupBy("part").agg(F.sum("n_ids").alias("n")).select("part", F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("part_start"))
    parts = cut(parts)
    few = parts.count() <= MAX_PARTS
    rows = images.join(F.broadcast(parts) if few else parts, "part").select((F.col("part_start") + F.col("before")).alias("start"), "doc_ids", "lengths", "image")
    more = ", ids array<bigint>" if ids else ""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, doc_ids, lengths, image in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                values, sizes = unpack(image), np.array(lengths, dtype=np.int64)
                ends = np.cumsum(sizes)
                firsts = ends - sizes
                sums = [zlib.crc32(values[a:b].tobytes()) for a, b in zip(firsts.tolist(), ends.tolist(), strict=True)]
                out = [pa.array(doc_ids, pa.int64()), pa.array(start + firsts), pa.array(sizes), pa.array(sums, pa.int64())]
                if ids:
                    out.append(pa.ListArray.from_arrays(pa.array(np.append(firsts, ends[-1]).astype(np.int32)), pa.array(values.astype(np.int64))))
                yield pa.RecordBatch.from_arrays(out, ["doc_id", "start", "n_tokens", "ids_crc32", "ids"][: len(out)])

    return rows.mapInArrow(run, f"doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint{more}")


def op5(spark, sf_dir: str) -> DataFrame:
    folder = f"{shared_folder(spark)}/token-files-{uuid.uuid4().hex}"
    write_ids(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"), folder)
    return read_ids(spark, folder, ids=False)
