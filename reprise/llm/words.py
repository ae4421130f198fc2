"""Words of many texts as flat arrays, so that no Python object is made for a word.

A word's hash is a polynomial over its bytes' random values modulo 2**64, taken for all words at once from sums along the
text. Two different words share it with a probability of about 2**-58; windows of words mix the hashes of their words.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
CHUNK = 1 << 20  #: bytes of texts that are looked at together; a longer text is a chunk of its own
PIECE = 1 << 17  #: bytes whose words are hashed together
MULTIPLIER = 0x9E3779B97F4A7C15
_VALUES = np.random.default_rng(42).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_INVERSE = pow(MULTIPLIER, -1, 1 << 64)


def _powers(r: int, n: int) -> np.ndarray:
    out = np.full(n, r, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


_UP, _DOWN = _powers(MULTIPLIER, 2 * PIECE), _powers(_INVERSE, 2 * PIECE)


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


@dataclass
class Words:
    rows: slice  #: rows of the batch
    data: np.ndarray  #: bytes of their texts
    offsets: np.ndarray  #: where each text begins, and the end of the last
    starts: np.ndarray  #: of each word
    ends: np.ndarray
    first: np.ndarray  #: number of the first word of each text, and the number of all

    def __len__(self) -> int:
        return len(self.starts)

    def text_of(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))

    def left(self) -> np.ndarray:
        """Words of its text from each word on."""
        return np.repeat(self.first[1:], np.diff(self.first)) - np.arange(len(self))

    def text(self, i: int) -> bytes:
        return self.data[self.offsets[i] : self.offsets[i + 1]].tobytes()

    def sums(self) -> np.ndarray:
        """Sum of the bytes of each word, and its length above that: a check of the hash."""
        total = np.zeros(len(self.data) + 1, np.uint32)
        np.cumsum(self.data, dtype=np.uint32, out=total[1:])
        return ((total[self.ends] - total[self.starts]) ^ ((self.ends - self.starts).astype(np.uint32) << np.uint32(11))).astype(np.uint64)

    def hashes(self) -> np.ndarray:
        import xxhash

        out, at = np.empty(len(self), np.uint64), 0
        while at < len(self):
            base = int(self.starts[at])
            to = max(at + 1, int(np.searchsorted(self.ends, base + PIECE, "right")))
            size = int(self.ends[to - 1]) - base
            if size > len(_UP) - 1:  # one word longer than a piece
                out[at] = xxhash.xxh3_64_intdigest(self.data[base : base + size].tobytes())
            else:
                sums = np.zeros(size + 1, np.uint64)
                np.cumsum(_VALUES[self.data[base : base + size]] * _UP[:size], out=sums[1:])
                s, e = self.starts[at:to] - base, self.ends[at:to] - base
                out[at:to] = (sums[e] - sums[s]) * _DOWN[s]
            at = to
        return mix(out)


def words_of(data: np.ndarray, offsets: np.ndarray, rows: slice) -> Words:
    """data: bytes; offsets: of texts in it."""
    inside = ~SPACE[data]
    before = np.concatenate([[False], inside[:-1]])
    begins = offsets[:-1][offsets[:-1] < len(data)]
    before[begins] = False  # a text ends the word of the one before
    starts = np.flatnonzero(inside & ~before)
    after = np.concatenate([inside[1:], [False]])
    last = offsets[1:] - 1
    after[last[last >= 0]] = False
    ends = np.flatnonzero(inside & ~after) + 1
    return Words(rows, data, offsets, starts, ends, np.searchsorted(starts, offsets))


def chunks(column: pa.Array, size: int = CHUNK) -> Iterator[Words]:
    """The words of a column of texts without nulls, rows of size bytes at a time."""
    _, where, raw = column.buffers()
    wide = np.int64 if pa.types.is_large_string(column.type) else np.int32
    offsets = np.frombuffer(where, wide)[column.offset : column.offset + len(column) + 1].astype(np.int64) if len(column) else np.zeros(1, np.int64)
    data = np.frombuffer(raw, np.uint8) if raw is not None and raw.size else np.empty(0, np.uint8)
    at = 0
    while at < len(column):
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + size, "right")) - 1)
        yield words_of(data[offsets[at] : offsets[to]], offsets[at : to + 1] - offsets[at], slice(at, to))
        at = to


def grams(h: np.ndarray, n: int, r: int = MULTIPLIER) -> np.ndarray:
    """Polynomial hashes of all runs of n values, by doubling."""
    power = lambda k: np.uint64(pow(r, k, 1 << 64))
    if len(h) < n:
        return np.empty(0, np.uint64)
    out, have = None, 0  # runs of `have` values, from the highest bit of n down
    for bit in bin(n)[2:]:
        if have:
            m = len(h) - 2 * have + 1
            out = out[:m] + power(have) * out[have : have + m]
            have *= 2
        if bit == "1":
            m = len(h) - have
            out = h if not have else out[:m] + power(have) * h[have : have + m]
            have += 1
    return out


def least(x: np.ndarray, width: int, of=np.minimum) -> np.ndarray:
    """Smallest (or what `of` chooses) of each width successive values."""
    out, have = x, 1
    while have < width:
        step = min(have, width - have)
        out = of(out[: len(x) - have - step + 1], out[step : step + len(x) - have - step + 1])
        have += step
    return out


class Slots:
    """80 bits of a hash -> a number, in an array with open addressing."""

    def __init__(self, bits: int = 16):
        self.bits, self.count = bits, 0
        self.slots = np.zeros((1 << bits, 2), np.uint64)  # 64 bits of hash; 16 more, 48 of the number

    def find(self, h: np.ndarray, c: np.ndarray) -> np.ndarray:
        """The number of each, or 0."""
        out, todo, mask = np.zeros(len(h), np.uint64), np.arange(len(h)), len(self.slots) - 1
        slot, want, check = (h >> np.uint64(64 - self.bits)).astype(np.int64), h, c
        while len(todo):
            found = self.slots[slot]
            key, rest = found[:, 0], found[:, 1]
            hit = (key == want) & (rest >> np.uint64(48) == check)
            out[todo[hit]] = rest[hit] & np.uint64((1 << 48) - 1)
            more = ~hit & (key != 0)
            todo, slot, want, check = todo[more], (slot[more] + 1) & mask, want[more], check[more]
        return out

    def _put(self, h: np.ndarray, rest: np.ndarray) -> None:
        slot, todo, mask, owner = (h >> np.uint64(64 - self.bits)).astype(np.int64), np.arange(len(h)), len(self.slots) - 1, np.full(len(self.slots), -1, np.int32)
        while len(todo):
            free = self.slots[slot, 0] == 0
            owner[slot[free]] = todo[free]
            mine = free & (owner[slot] == todo)
            self.slots[slot[mine], 0], self.slots[slot[mine], 1] = h[todo[mine]], rest[todo[mine]]
            todo, slot = todo[~mine], (slot[~mine] + 1) & mask
        self.count += len(h)

    def add(self, h: np.ndarray, c: np.ndarray, numbers: np.ndarray) -> None:
        """New ones, each once."""
        if 2 * (self.count + len(h)) > len(self.slots):
            old = self.slots[self.slots[:, 0] != 0]
            self.__init__((2 * (self.count + len(h))).bit_length())
            self._put(old[:, 0], old[:, 1])
        self._put(h, (c << np.uint64(48)) | numbers)
