"""Context-mixing range coder for token ids, in independently reset and checksummed blocks.

An image is a header (magic, tokens, block length, alphabet), a directory (different ids, bytes and CRC-32 of each block's ids), the ids that each block holds with their counts, and the
blocks. Blocks of an image are coded in step, one lane each, so that a step is a few array operations for all of them, without branches for some; a lane starts from an empty model
and reads nothing of the others. Within a lane an id goes by its place among the block's different ids, so the model's tables grow with a block and not with the alphabet.

A token's probability mixes three predictions: order 2 names the id last seen after the two ids before, order 1 the id last seen after the
one before, and order 0 spreads over the block's ids by their counts. The weights of orders 1 and 2 follow how often they have been right in the lane.
A block's different ids are kept as rising numbers, in low bits and a unary high part, and their counts in unary: a block in order has a bit for each token, set where a new id begins.
A token takes one step of a 48-bit range coder with 16-bit digits; carries are added up at the end.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np

MAGIC, BLOCK, LANES, HASHED, NONE = b"TKC3", 2048, 4096, 1024, 65535
LEAST, MASK, TOTAL = 1 << 32, (1 << 32) - 1, 1 << 16
HIT, RATE, PLACE_BITS = 30000, 5, 12


class Model:
    """Order 0 to 2 predictions of all lanes over the places of ids. ``new`` tells where a new id begins in each lane's ids in order; a cell is one of a lane's ids."""

    def __init__(self, new: np.ndarray):
        (lanes, self.steps), starts = new.shape, np.flatnonzero(new)
        self.base = np.append(0, np.cumsum(new.sum(axis=1))[:-1])
        self.cells, lane = len(starts), np.arange(lanes)
        self.spread = ((starts % self.steps) | np.diff(starts, append=new.size) << PLACE_BITS).astype(np.int32)
        #: By the one id before, with a cell for none, and by the two before.
        self.after = np.full(self.cells + lanes * (1 + HASHED), NONE, np.uint16)
        self.row = self.cells + lanes + lane * HASHED
        self.at = np.stack([self.cells + lane, self.row])
        self.weights, self.before = np.full((2, lanes), 4000, np.int32), np.zeros(lanes, np.int64)

    def predict(self) -> tuple[np.ndarray, ...]:
        """(places of orders 1 and 2, whether they count, their weights, both weights' sum and the weight of order 0)."""
        places = self.after.take(self.at)
        counts = places != NONE
        counts[0] &= places[0] != places[1]
        weights = self.weights * counts
        both = weights[0] + weights[1]
        return places, counts, weights, both, TOTAL - both

    def share(self, cell: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where the part of a cell begins in order 0's, and its width."""
        spread = self.spread.take(cell)
        first = spread & ((1 << PLACE_BITS) - 1)
        end = (first + (spread >> PLACE_BITS)) * weight
        first *= weight
        if self.steps & (self.steps - 1):
            first //= self.steps
            end //= self.steps
        else:
            shift = self.steps.bit_length() - 1
            first >>= shift
            end >>= shift
        end -= first
        return first, end

    def learn(self, x: np.ndarray, cell: np.ndarray, hits: np.ndarray, counts: np.ndarray) -> None:
        moved = hits * np.int32(HIT)
        moved -= self.weights
        moved *= counts
        moved >>= RATE
        self.weights += moved
        np.maximum(self.weights, 32, out=self.weights)
        self.after[self.at] = x
        x = x.astype(np.int64)
        two = self.at[1]
        np.multiply(x, 30103, out=two)
        two += self.before
        two &= HASHED - 1
        two += self.row
        self.at[0] = cell
        np.multiply(x, 40503, out=self.before)


class Encoder:
    """The interval's low end is kept without its carries, which go into the digits' 17th bits."""

    def __init__(self, lanes: int, steps: int):
        self.low, self.range = np.zeros(lanes, np.int64), np.full(lanes, 1 << 48, np.int64)
        self.digits, self.sent = np.empty((steps + 3, lanes), np.uint32), np.ones((steps + 3, lanes), bool)

    def step(self, t: int, first: np.ndarray, freq: np.ndarray) -> None:
        low, part = self.low, self.range >> 16
        low += first * part
        part *= freq
        full = np.less(part, LEAST, out=self.sent[t])
        digit = low >> 32
        self.digits[t] = digit
        digit <<= 32
        shift = full.astype(np.int64)
        digit *= shift
        low -= digit
        shift <<= 4
        low <<= shift
        part <<= shift
        self.range = part

    def finish(self) -> tuple[bytes, list[int]]:
        """The lanes' bytes, one after the other, and how many each has."""
        for t in range(-3, 0):
            self.digits[t] = self.low >> 32
            self.low = (self.low & MASK) << 16
        digits = np.ascontiguousarray(self.digits.T)[np.ascontiguousarray(self.sent.T)]
        while (carry := digits >> 16).any():
            digits &= 0xFFFF
            digits[:-1] += carry[1:]
        return digits.astype("<u2").tobytes(), (2 * self.sent.sum(axis=0)).tolist()


class Decoder:
    """Follows the lanes' bytes, one after the other, of these sizes."""

    def __init__(self, data: bytes, sizes: np.ndarray):
        self.digits = np.append(np.frombuffer(data, "<u2"), np.zeros(4, np.uint16))
        self.at = (np.cumsum(sizes) - sizes) // 2
        self.range, self.code = np.full(len(sizes), 1 << 48, np.int64), np.zeros(len(sizes), np.int64)
        for _ in range(3):
            self.code = (self.code << 16) | self.digits.take(self.at, mode="clip")
            self.at += 1

    def value(self) -> np.ndarray:
        """Quotients of 48 by 32 bits, of 16 bits: in double precision none is rounded up to the next."""
        self.part = self.range >> 16
        return np.minimum(self.code / self.part, TOTAL - 1).astype(np.int32)

    def step(self, first: np.ndarray, freq: np.ndarray) -> None:
        """Follows value()."""
        part = self.part
        self.code -= first * part
        part *= freq
        shift = (part < LEAST).astype(np.int64)
        digit = self.digits.take(self.at, mode="clip") * shift
        self.at += shift
        shift <<= 4
        self.code <<= shift
        self.code += digit
        part <<= shift
        self.range = part


def _order(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each number's place among its row's different numbers, where a new one begins in the row in order, and the different ones, row after row."""
    lanes, steps = rows.shape
    kind = np.uint32 if int(rows.max()) < 1 << 32 - PLACE_BITS else np.uint64
    keys = rows.astype(kind) << kind(PLACE_BITS)
    keys |= np.arange(steps, dtype=kind)
    keys.sort(axis=1)
    at, ids = (keys & kind((1 << PLACE_BITS) - 1)).astype(np.int64), keys >> kind(PLACE_BITS)
    new = np.ones(rows.shape, bool)
    np.not_equal(ids[:, 1:], ids[:, :-1], out=new[:, 1:])
    at += (np.arange(lanes) * steps)[:, None]
    places = np.empty(rows.size, np.uint16)
    places[at.ravel()] = _slots(new).ravel()
    return places.reshape(rows.shape), new, ids[new].astype(np.uint32)


def _slots(new: np.ndarray) -> np.ndarray:
    """The places of each row's numbers, in order."""
    slots = np.cumsum(new, axis=1, dtype=np.uint16)
    slots -= 1
    return slots


def _encode_lanes(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, bytes, list[int]]:
    (lanes, steps), (places, new, different) = rows.shape, _order(rows)
    model, coder, places = Model(new), Encoder(lanes, steps), np.ascontiguousarray(places.T)
    for t in range(steps):
        x = places[t]
        named, counts, weights, both, rest = model.predict()
        hits = named == x
        hits[0] &= counts[0]
        cell = model.base + x
        first, width = model.share(cell, rest)
        first += both
        coder.step(t, np.where(hits[1], 0, np.where(hits[0], weights[1], first)), np.where(hits[1], weights[1], np.where(hits[0], weights[0], width)))
        model.learn(x, cell, hits, counts)
    return new, different, *coder.finish()


def _decode_lanes(new: np.ndarray, data: bytes, sizes: np.ndarray) -> np.ndarray:
    """The cells of all lanes' tokens."""
    (lanes, steps), slots = new.shape, _slots(new).ravel()
    model, coder, out = Model(new), Decoder(data, sizes), np.empty((new.shape[1], len(new)), np.int32)
    table = np.arange(lanes) * steps
    for t in range(steps):
        named, counts, weights, both, rest = model.predict()
        v = coder.value()
        hits = np.stack([v < both, v < weights[1]])
        hits[0] &= ~hits[1]
        v -= both
        v *= steps
        v += steps - 1
        slot = (v / rest).astype(np.int64)
        slot += table
        x = np.where(hits[1], named[1], np.where(hits[0], named[0], slots.take(slot, mode="clip")))  # no slot where orders 1 and 2 are right
        cell = model.base + x
        first, width = model.share(cell, rest)
        first += both
        coder.step(np.where(hits[1], 0, np.where(hits[0], weights[1], first)), np.where(hits[1], weights[1], np.where(hits[0], weights[0], width)))
        out[t] = cell
        model.learn(x, cell, hits, counts)
    return out.T


def _low_bits(n: int, blocks: int, below: int) -> int:
    return max(0, (below * blocks // max(n, 1)).bit_length() - 1)


def _pack_rising(values: np.ndarray, counts: np.ndarray, below: int) -> bytes:
    """Each block's rising numbers, so many, all less than ``below``."""
    low = _low_bits(len(values), len(counts), below)
    span = (below - 1 >> low) + 1
    high = np.zeros(len(values) + span * len(counts), bool)
    high[(values >> low) + np.arange(len(values)) + np.repeat(np.arange(len(counts)) * span, counts)] = True
    return b"".join(np.packbits(bits.astype(bool)).tobytes() for bits in [high, *((values >> j) & 1 for j in range(low))])


def _unpack_rising(image: bytes, at: int, counts: np.ndarray, below: int) -> tuple[np.ndarray, int]:
    """The numbers, and where they end in the image."""
    n = int(counts.sum())
    low = _low_bits(n, len(counts), below)
    span = (below - 1 >> low) + 1
    size = n + span * len(counts)
    found = np.flatnonzero(np.unpackbits(np.frombuffer(image, np.uint8, -(-size // 8), at), count=size))
    if len(found) != n:
        raise ValueError("the image is damaged")
    values, at = (found - np.arange(n) - np.repeat(np.arange(len(counts)) * span, counts)) << low, at + -(-size // 8)
    for j in range(low):
        values |= np.unpackbits(np.frombuffer(image, np.uint8, -(-n // 8), at), count=n).astype(np.int64) << j
        at += -(-n // 8)
    return values, at


def _dense(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The different ids in order and each id's place among them; ids of a usual vocabulary are counted and not sorted."""
    if len(ids) and int(ids.max()) < 4 * TOTAL:
        found = np.bincount(ids) > 0
        return np.flatnonzero(found).astype(np.uint32), (np.cumsum(found, dtype=np.int64) - 1)[ids]
    return np.unique(ids, return_inverse=True)


def pack(ids: np.ndarray, block: int = BLOCK) -> bytes:
    """Image of unsigned 32-bit ids, in blocks of at most 4,000."""
    ids = np.ascontiguousarray(ids, dtype=np.uint32)
    alphabet, dense = _dense(ids)
    n_blocks = -(-len(ids) // block)
    head = MAGIC + struct.pack("<QIII", len(ids), block, len(alphabet), n_blocks) + alphabet.tobytes()
    if not len(ids):
        return head
    steps = min(block, len(ids))
    rows = np.zeros(n_blocks * steps, np.uint32)
    rows[: len(ids)] = dense
    rows = rows.reshape(n_blocks, steps)
    new, different, data, sizes = zip(*(_encode_lanes(rows[i : i + LANES]) for i in range(0, n_blocks, LANES)), strict=True)
    new, counts = np.concatenate(new), np.concatenate([x.sum(axis=1) for x in new])
    sums = [zlib.crc32(ids[i : i + block]) for i in range(0, len(ids), block)]
    directory = np.array([counts, sum(sizes, []), sums], "<u4").tobytes()
    return b"".join([head, directory, np.packbits(new).tobytes(), _pack_rising(np.concatenate(different), counts, len(alphabet)), *data])


def unpack(image: bytes) -> np.ndarray:
    """The ids of an image; raises ValueError if a block's checksum or the header doesn't fit."""
    if image[:4] != MAGIC:
        raise ValueError("not an image of token ids")
    n, block, letters, n_blocks = struct.unpack_from("<QIII", image, 4)
    alphabet = np.frombuffer(image, np.uint32, letters, 24)
    if not n:
        return np.zeros(0, np.uint32)
    at, steps = 24 + 4 * letters, min(block, n)
    counts, sizes, sums = np.frombuffer(image, "<u4", 3 * n_blocks, at).astype(np.int64).reshape(3, -1)
    at, size = at + 12 * n_blocks, n_blocks * steps
    new = np.unpackbits(np.frombuffer(image, np.uint8, -(-size // 8), at), count=size).astype(bool).reshape(n_blocks, steps)
    if not new[:, 0].all() or (new.sum(axis=1) != counts).any():
        raise ValueError("the image is damaged")
    different, at = _unpack_rising(image, at + -(-size // 8), counts, letters)
    cells, ends, dense = np.append(0, np.cumsum(counts)), at + np.append(0, np.cumsum(sizes)), []
    for i in range(0, n_blocks, LANES):
        j = min(i + LANES, n_blocks)
        try:
            dense.append(different[cells[i] : cells[j]].take(_decode_lanes(new[i:j], image[ends[i] : ends[j]], sizes[i:j])))
        except (IndexError, ZeroDivisionError) as e:
            raise ValueError("the image is damaged") from e
    ids = alphabet.take(np.concatenate(dense).ravel()[:n], mode="clip")
    for i, crc in enumerate(sums.tolist()):
        if zlib.crc32(ids[i * block : (i + 1) * block]) != crc:
            raise ValueError(f"block {i} of the image is damaged")
    return ids
