"""SimHash near-duplicates through an inverted index over byte positions.

A fingerprint is a number of words ("lanes") of 8 bytes. For one lane and 3 differing bits, two fingerprints share at least 5 positional bytes. A posting list of one
position and value would hold a 256th of all fingerprints, so postings are kept for the 14 sets of four positions
{a, b, c, d} with a ^ b ^ c ^ d = 0: any five positions contain one of these sets, so a pair that reaches the minimum
of 5 shared bytes meets in a list of 32 equal bits. In a list the shared bytes of a pair are tallied; pairs that reach the minimum are verified by their differing bits.

For a similarity (``by_similarity``) the differing bits that it makes likely, 78 of 512 for 0.8, are too many for a guaranteed minimum of shared bytes, so nothing is tallied there. Fingerprints then have eight lanes and
postings 128 sets of three of their 64 positions: two texts of similarity 0.8 share the three bytes of at least one set with a probability of 92 %, of 0.85 with 99 %. Postings carry two lanes, which tell nearly all chance
meetings in a list from near-copies: two random fingerprints agree that well in one list of two thousand. What two lanes leave of a list falls into groups. A pair is verified by its whole fingerprints. A group of three or
more is a family, named by its members, so that one which many lists give is one; its members' whole fingerprints are brought together, and it gives the links of a spanning forest of those that hold, so no pair that met in a list is lost to
a third fingerprint between the two, whatever the length of the list. Similarity is that of the sets of shingles as the bits tell it, with a standard deviation's allowance; the README has the measured recall.

Equal fingerprints are one entry, lists hold fingerprints only, and a list gives the links of a spanning forest, not all pairs:
links join the same documents. Every entry of a forest is compared with those that nothing has reached yet, so a list or family of near-copies takes time in proportion to its length. For 3 bits a list over ``DENSE`` entries is split by a fifth position (one of the other four bytes is equal), which is the tally by another name, and if that isn't enough,
its 24 open bits are probed with all patterns of up to 3 bits, in time linear in the list; the links join the same entries as without.

A fingerprint or component with a great share of the rows is one key of the last joins: AQE's skew join, on by default in Spark, must stay on.

Defined results: A-Z are lower-cased; fewer words than a shingle make one shingle of all; no words (or a null text) give fingerprint
zero, which links like any other; a document without links is its own component; equal rows and equal texts share a component; a component
without any non-null id has a null id; an empty table gives an empty result; other columns are kept, those of the result's names are replaced.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import accumulate, combinations
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusmill.llm.components import connected_components
from corpusmill.llm.memory import give_back, short_batches
from corpusmill.lineage import cut

MAX_BITS, MIN_BYTES, DENSE, POSTING_LANES = 3, 5, 4096, 2
SETS = [s for s in combinations(range(8), 4) if s[0] ^ s[1] ^ s[2] ^ s[3] == 0]


class Scheme(NamedTuple):
    """Lanes of a fingerprint, the sets of byte positions that have posting lists, and how many bits a pair may differ in: whole, and in the lanes that postings carry."""

    lanes: int
    sets: list[tuple[int, ...]]
    max_bits: int
    posting_bits: int


BY_BITS = Scheme(1, SETS, MAX_BITS, MAX_BITS)


def by_similarity(similarity: float = 0.8, lanes: int = 8) -> Scheme:
    """For sets of equal size with this Jaccard similarity: the bits expected to differ and a standard deviation more, in the two lanes of a posting four of them."""
    n, share = 8 * lanes, math.acos(2 * similarity / (1 + similarity)) / math.pi
    bits = lambda m, allowance: int(m * share + allowance * math.sqrt(m * share * (1 - share)))
    sets = [(i, (i + a) % n, (i + b) % n) for a, b in ((1, 7), (2, 13)) for i in range(n)]
    return Scheme(lanes, sets, bits(64 * lanes, 1), bits(64 * POSTING_LANES, 4))


def fingerprint(text: str | None, words: int = 3, lanes: int = 1) -> int | list[int]:
    """Unsigned 64-bit SimHash of the word shingles' XXH64 with seed 42; a list of as many as there are lanes, the others from mixes of the same hashes."""
    parts = text.encode("utf-8", "surrogatepass").lower().split() if text else []
    if not parts:
        return 0 if lanes == 1 else [0] * lanes
    joined = b" ".join(parts)
    ends = list(accumulate(parts, lambda s, p: s + 1 + len(p), initial=-1))
    n = max(1, len(parts) - words + 1)
    last = ends[words:] if len(parts) >= words else ends[-1:]
    digest = xxhash.xxh64_intdigest
    ones = np.zeros((lanes, 64), dtype=np.int64)
    for at in range(0, n, 1 << 16):
        hashes = np.array([digest(joined[s + 1 : e], 42) for s, e in zip(ends[at : at + (1 << 16)], last[at : at + (1 << 16)], strict=False)], dtype=np.uint64)
        for lane in range(lanes):
            ones[lane] += np.unpackbits(_mix(hashes, lane).astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(0, dtype=np.int64)
    found = [int.from_bytes(np.packbits(o * 2 > n).tobytes(), "big") for o in ones]
    return found[0] if lanes == 1 else found


def _mix(h: np.ndarray, lane: int) -> np.ndarray:
    if not lane:
        return h
    h = h + np.uint64(lane * 0x9E3779B97F4A7C15 & (1 << 64) - 1)
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def with_fingerprint(docs: DataFrame, text_col: str = "text", words: int = 3, out: str = "fingerprint", lanes: int = 1) -> DataFrame:
    """docs with the fingerprint as a signed long, or an array of them for more lanes than one."""

    @F.pandas_udf("long" if lanes == 1 else "array<long>")
    def run(texts: pd.Series) -> pd.Series:
        found = np.array([fingerprint(t, words, lanes) for t in texts], dtype=np.uint64).view(np.int64)
        give_back()
        return pd.Series(found if lanes == 1 else list(found.reshape(len(texts), lanes)))

    return short_batches(docs).withColumn(out, run(F.col(text_col)))


def _tally(x: np.ndarray, at: int, rest: np.ndarray) -> np.ndarray:
    """Places in rest of the entries with MIN_BYTES bytes equal to those of x[at], and then no more than MAX_BITS other bits."""
    diff = x[rest] ^ x[at]
    shared = np.flatnonzero((diff.view(np.uint8).reshape(-1, 8) == 0).sum(1) >= MIN_BYTES)
    return shared[np.bitwise_count(diff[shared]) <= MAX_BITS]


def _within(max_bits: int):
    """Nearness of whole rows of lanes by their differing bits."""
    return lambda x, at, rest: np.flatnonzero(np.bitwise_count(x[rest] ^ x[at]).sum(1, dtype=np.int64) <= max_bits)


def _forest(x: np.ndarray, near=_tally) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Links (places in the list) of a spanning forest of one list, searched in breadth: each entry is compared with those not yet reached."""
    rest = np.arange(len(x))
    while len(rest) > 1:
        front, rest = [rest[0]], rest[1:]
        while front and len(rest):
            at = front.pop()
            found = near(x, at, rest)
            if len(found):
                reached = rest[found]
                yield np.full(len(reached), at), reached
                front.extend(reached.tolist())
                rest = np.delete(rest, found)


def _groups(x: np.ndarray, max_bits: int) -> list[np.ndarray]:
    """Places of the entries that links of up to max_bits join, for each group of two and more."""
    root = np.arange(len(x))
    for u, v in _forest(x, _within(max_bits)):
        root[v] = root[u]
    order = np.argsort(root, kind="stable")
    parts = np.split(order, np.flatnonzero(np.diff(root[order])) + 1)
    return [part for part in parts if len(part) > 1]


def _links(x: np.ndarray, fixed: tuple[int, ...]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Links that connect what is within 3 bits in a list of one lane whose entries share the bytes at ``fixed`` positions."""
    if len(x) <= DENSE:
        for u, v in _forest(x):
            yield x[u], x[v]
    elif len(fixed) < 5:
        for p in set(range(8)) - set(fixed):
            value = (x >> np.uint64(8 * p)) & np.uint64(255)
            order = np.argsort(value, kind="stable")
            for part in np.split(x[order], np.flatnonzero(np.diff(value[order])) + 1):
                yield from _links(part, (*fixed, p))
    else:
        x = np.sort(x)
        open_bits = [8 * p + b for p in set(range(8)) - set(fixed) for b in range(8)]
        label = np.arange(len(x))
        pairs = []
        for n in range(1, MAX_BITS + 1):
            for bits in combinations(open_bits, n):
                other = x ^ np.uint64(sum(1 << b for b in bits))
                at = np.minimum(np.searchsorted(x, other), len(x) - 1)
                here = np.flatnonzero((x[at] == other) & (x < other))
                if len(here) and (new := here[label[here] != label[at[here]]]).size:
                    pairs.append((new, at[new]))
                    np.minimum.at(label, at[new], label[new])
                    label = label[label]
        for a, b in pairs:
            yield x[a], x[b]


def _postings(batches: Iterator[pa.RecordBatch], scheme: Scheme) -> Iterator[pa.RecordBatch]:
    """(node, fingerprint) to (key, node, two lanes), a row for each set; a key is the set's number and its three bytes."""
    sets = np.array(scheme.sets)
    for batch in batches:
        for part in (batch.slice(at, 4096) for at in range(0, batch.num_rows, 4096)):
            nodes, x = part.column(0).to_numpy(), part.column(1).flatten().to_numpy().reshape(part.num_rows, scheme.lanes)
            data = np.ascontiguousarray(x.astype("<i8")).view(np.uint8).astype(np.int64)
            keys = np.arange(len(sets), dtype=np.int64) << 24 | data[:, sets[:, 0]] << 16 | data[:, sets[:, 1]] << 8 | data[:, sets[:, 2]]
            yield pa.RecordBatch.from_arrays([pa.array(keys.ravel()), *(pa.array(np.repeat(c, len(sets))) for c in (nodes, x[:, 0], x[:, 1]))], ["key", "node", "first", "second"])


def _runs(batches: Iterator[pa.RecordBatch], act) -> Iterator[pa.RecordBatch]:
    """act(columns as arrays) for rows sorted by the first column, so that no value of it is cut; a run over many batches is put together once."""
    held: list[list[np.ndarray]] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        columns = [c.flatten() if pa.types.is_list(c.type) else c for c in batch.columns]
        columns = [c.to_numpy().reshape(batch.num_rows, -1) if len(c) != batch.num_rows else c.to_numpy() for c in columns]
        # the last value's run may go on in the next batch
        at = int(np.searchsorted(columns[0], columns[0][-1]))
        if at or (held and held[-1][0][-1] != columns[0][0]):
            yield from act(*[np.concatenate(c) for c in zip(*held, [c[:at] for c in columns], strict=True)])
            held = []
        held.append([c[at:] for c in columns])
    if held:
        yield from act(*[np.concatenate(c) for c in zip(*held, strict=True)])
    give_back()


def _bounds(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    ends = np.append(np.flatnonzero(np.diff(keys)) + 1, len(keys))
    return np.concatenate([[0], ends[:-1]]), ends


def _table(**columns: list[np.ndarray]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.concatenate([np.empty(0, np.int64), *c]).astype(np.int64)) for c in columns.values()], list(columns))


def near_by_bits(fingerprints: DataFrame, col: str = "fingerprint", scheme: Scheme = BY_BITS) -> DataFrame:
    """Distinct fingerprints of one lane to links (u, v) of fingerprints that connect those within the scheme's bits of each other."""
    postings = []
    for i, s in enumerate(scheme.sets):
        key = F.lit(i).cast("long")
        for p in s:
            key = F.shiftleft(key, 8).bitwiseOR(F.shiftright(F.col(col), 8 * p).bitwiseAND(F.lit(255)))
        postings.append(key)
    lists = fingerprints.select(F.explode(F.array(*postings)).alias("key"), F.col(col).alias("first"))
    width = 8 * len(scheme.sets[0])

    def links(keys: np.ndarray, first: np.ndarray) -> Iterator[pa.RecordBatch]:
        x = first.view(np.uint64)
        starts, ends = _bounds(keys)
        # lists of two, by far the most, at once: the tally, then the bits
        two = starts[ends - starts == 2]
        diff = x[two] ^ x[two + 1]
        near = two[((diff.view(np.uint8).reshape(-1, 8) == 0).sum(1) >= MIN_BYTES) & (np.bitwise_count(diff) <= scheme.max_bits)]
        us, vs = [first[near]], [first[near + 1]]
        many = ends - starts > 2
        for a, b in zip(starts[many].tolist(), ends[many].tolist(), strict=True):
            for u, v in _links(x[a:b], scheme.sets[int(keys[a]) >> width]):
                us.append(u.view(np.int64))
                vs.append(v.view(np.int64))
        yield _table(u=us, v=vs)

    sorted_lists = lists.repartition("key").sortWithinPartitions("key", "first")
    return sorted_lists.mapInArrow(lambda batches: _runs(batches, links), "u long, v long").distinct()


def near_by_similarity(fingerprints: DataFrame, scheme: Scheme, node_col: str = "node", col: str = "fingerprint") -> DataFrame:
    """Distinct fingerprints of several lanes to links (u, v) of their nodes, each between fingerprints that differ in no more than the scheme's bits."""
    lists = fingerprints.select(node_col, col).mapInArrow(lambda batches: _postings(batches, scheme), "key long, node long, first long, second long")

    def meet(keys: np.ndarray, nodes: np.ndarray, first: np.ndarray, second: np.ndarray) -> Iterator[pa.RecordBatch]:
        """Pairs (family 0), and members (v 0) of families, by the lanes of the postings."""
        x = np.stack([first, second], axis=1).view(np.uint64)
        starts, ends = _bounds(keys)
        two = starts[ends - starts == 2]
        near = two[np.bitwise_count(x[two] ^ x[two + 1]).sum(1, dtype=np.int64) <= scheme.posting_bits]
        us, vs, families = [nodes[near]], [nodes[near + 1]], [np.zeros(len(near), np.int64)]
        many = ends - starts > 2
        for a, b in zip(starts[many].tolist(), ends[many].tolist(), strict=True):
            for group in _groups(x[a:b], scheme.posting_bits):
                members = np.sort(nodes[a + group])
                pair = len(members) == 2
                us.append(members[:1] if pair else members)
                vs.append(members[1:] if pair else np.zeros(len(members), np.int64))
                name = 0 if pair else xxhash.xxh64_intdigest(members.tobytes()) >> 1 or 1
                families.append(np.full(len(us[-1]), name, np.int64))
        yield _table(u=us, v=vs, family=families)

    met = cut(lists.repartition("key").sortWithinPartitions("key", "node").mapInArrow(lambda batches: _runs(batches, meet), "u long, v long, family long").distinct())
    side = lambda node, out: fingerprints.select(F.col(node_col).alias(node), F.col(col).alias(out))
    bits = F.aggregate(F.zip_with("a", "b", lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda s, x: s + x)
    pairs = met.filter("family = 0").join(side("u", "a"), "u").join(side("v", "b"), "v").filter(bits <= scheme.max_bits).select("u", "v")

    def forests(families: np.ndarray, nodes: np.ndarray, x: np.ndarray) -> Iterator[pa.RecordBatch]:
        us, vs, x = [], [], np.ascontiguousarray(x).view(np.uint64)
        for a, b in zip(*(side.tolist() for side in _bounds(families)), strict=True):
            for u, v in _forest(x[a:b], _within(scheme.max_bits)):
                us.append(nodes[a + u])
                vs.append(nodes[a + v])
        yield _table(u=us, v=vs)

    members = met.filter("family != 0").select("family", "u").join(side("u", "x"), "u").select("family", "u", "x")
    held = members.repartition("family").sortWithinPartitions("family", "u").mapInArrow(lambda batches: _runs(batches, forests), "u long, v long")
    return pairs.union(held).distinct()


def near_duplicates(marked: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Documents with a fingerprint column (see ``with_fingerprint``) to the same with component_id: the smallest id that links reach."""
    marked = marked.drop("component_id")
    prints = cut(marked.groupBy("fingerprint").agg(F.min(id_col).alias("component_id")))
    found = connected_components(near_by_bits(prints))
    roots = prints.join(found, prints["fingerprint"] == found["node"], "left").select("fingerprint", F.coalesce("component", "fingerprint").alias("root"), "component_id")
    least = roots.groupBy("root").agg(F.min("component_id").alias("component_id"))
    reached = roots.select("fingerprint", "root").join(least, "root").select("fingerprint", "component_id")
    return marked.join(reached, "fingerprint").select(*marked.columns, "component_id")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, scheme: Scheme | None = None) -> DataFrame:
    """docs without the near-copies: of each component one row stays, that with the smallest id (null ids last), then text hash, then other columns as JSON.

    By default near-copies have a similarity of 0.8 in five-word shingles. Components without an id keep a row each; rows of different components stay though they share an id.
    """
    scheme = scheme or by_similarity()
    key = F.sha2(F.col(text_col).cast("binary"), 256)
    # one string without nulls, so that the join and the sum after it are dealt alike and texts are moved once
    row_key = F.concat(F.coalesce(F.col(id_col).cast("string"), F.lit("")), F.lit(":"), F.coalesce(key, F.lit("")))
    order = F.struct(F.col(id_col).isNull().alias("no_id"), F.col(id_col).alias("id"), key.alias("key"), row_key.alias("row_key"))
    marked = with_fingerprint(docs.select(order.alias("least"), F.col(text_col).alias("text")), "text", words, lanes=scheme.lanes)
    # nodes are numbered once, as the table is written
    prints = cut(marked.groupBy("fingerprint").agg(F.min("least").alias("least")).withColumn("node", F.monotonically_increasing_id()))
    at = "node" if scheme.lanes > 1 else "fingerprint"
    links = near_by_similarity(prints, scheme) if scheme.lanes > 1 else near_by_bits(prints, scheme=scheme)
    found = connected_components(links).withColumnRenamed("node", "of")
    roots = prints.join(found, prints[at] == found["of"], "left").select(F.coalesce("component", at).alias("root"), "least")
    stays = roots.groupBy("root").agg(F.min("least").alias("least")).select(F.col("least.row_key").alias("row_key"))
    packed = docs.select(row_key.alias("row_key"), F.struct("*").alias("row"))
    kept = packed.join(stays, "row_key", "left_semi")
    rest = F.to_json(F.struct(*[F.col("row")[c].alias(c) for c in docs.columns if c != text_col]))
    return kept.groupBy("row_key").agg(F.min_by("row", rest).alias("row")).select("row.*")


def op8(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    prints = cut(with_fingerprint(docs).select("doc_id", "fingerprint"))
    return near_duplicates(prints).select("doc_id", F.lower(F.lpad(F.hex("fingerprint"), 16, "0")).alias("fingerprint"), "component_id")
