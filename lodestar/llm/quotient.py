"""Counting quotient filters of packed n-grams, as arrays.

The k word numbers of an n-gram are packed into lanes of 64 bits and permuted invertibly, so keys spread evenly. The top
bits of the first lane are the quotient, everything else is the remainder, and all of it is kept: the filter is lossless
and gives the words back. In memory a filter is its keys in order and their counts. As bytes it is what the slots of a
counting quotient filter hold: per quotient the length of its run in unary, the remainders in the bytes that
they need, and the counts in one byte each, the large ones beside them.
"""

from __future__ import annotations

import struct
from dataclasses import dataclass

import numpy as np

WORD = 64
ALL = (1 << WORD) - 1

#: Odd multipliers of the permutation.
FACTORS = (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9)

#: A count of this or more stands beside the bytes.
LARGE = 255

HEADER = struct.Struct("<QQB")


@dataclass(frozen=True)
class Packing:
    """How k words below ``2 ** bits`` lie in lanes."""

    k: int
    bits: int

    @property
    def widths(self) -> list[int]:
        """Bits in use of each lane."""
        per_lane = WORD // self.bits
        return [min(per_lane, self.k - at) * self.bits for at in range(0, self.k, per_lane)]

    def pack(self, words: list[np.ndarray]) -> list[np.ndarray]:
        lanes, per_lane = [], WORD // self.bits
        for at in range(0, self.k, per_lane):
            lane = np.zeros(len(words[0]), np.uint64)
            for word in words[at : at + per_lane]:
                lane = lane << np.uint64(self.bits) | word.astype(np.uint64)
            lanes.append(lane)
        return lanes

    def unpack(self, lanes: list[np.ndarray]) -> list[np.ndarray]:
        words, mask = [], np.uint64((1 << self.bits) - 1)
        for lane, width in zip(lanes, self.widths, strict=True):
            words += [lane >> np.uint64(width - at) & mask for at in range(self.bits, width + 1, self.bits)]
        return words

    def permute(self, lanes: list[np.ndarray]) -> list[np.ndarray]:
        """An invertible shuffle of the keys: every lane is scrambled, and mixed with what the lane before has become."""
        lanes = list(lanes)
        for _ in range(2 if len(lanes) > 1 else 1):
            for i, width in enumerate(self.widths):
                if len(lanes) > 1:
                    lanes[i] = lanes[i] ^ _mixed(lanes[i - 1], width)
                lanes[i] = _scrambled(lanes[i], width)
        return lanes

    def restore(self, lanes: list[np.ndarray]) -> list[np.ndarray]:
        lanes = list(lanes)
        for _ in range(2 if len(lanes) > 1 else 1):
            for i, width in reversed(list(enumerate(self.widths))):
                lanes[i] = _unscrambled(lanes[i], width)
                if len(lanes) > 1:
                    lanes[i] = lanes[i] ^ _mixed(lanes[i - 1], width)
        return lanes


def _scrambled(x: np.ndarray, width: int) -> np.ndarray:
    mask, half = np.uint64((1 << width) - 1), np.uint64((width + 1) // 2)
    for factor in FACTORS:
        x = x * np.uint64(factor) & mask
        x = x ^ x >> half
    return x


def _unscrambled(x: np.ndarray, width: int) -> np.ndarray:
    mask, half = np.uint64((1 << width) - 1), np.uint64((width + 1) // 2)
    for factor in reversed(FACTORS):
        x = x ^ x >> half
        x = x * np.uint64(pow(factor, -1, 1 << width)) & mask
    return x


def _mixed(x: np.ndarray, width: int) -> np.ndarray:
    x = (x ^ x >> np.uint64(29)) * np.uint64(FACTORS[1])
    return (x ^ x >> np.uint64(32)) >> np.uint64(WORD - width)


def in_order(lanes: list[np.ndarray]) -> np.ndarray:
    """Order of the keys. Runs that are in order already are merged, not sorted anew."""
    return np.argsort(lanes[0], kind="stable") if len(lanes) == 1 else np.lexsort(lanes[::-1])


def run_starts(lanes: list[np.ndarray]) -> np.ndarray:
    """Where runs of equal keys begin."""
    fresh = np.ones(len(lanes[0]), bool)
    if len(fresh):
        fresh[1:] = np.logical_or.reduce([lane[1:] != lane[:-1] for lane in lanes])
    return np.flatnonzero(fresh)


@dataclass
class CountingQuotientFilter:
    """Distinct permuted keys in order, and how often each was inserted."""

    packing: Packing
    lanes: list[np.ndarray]
    counts: np.ndarray

    @classmethod
    def of(cls, words: list[np.ndarray], packing: Packing) -> tuple[CountingQuotientFilter, np.ndarray]:
        """The filter of some n-grams, and which of its entries each n-gram is."""
        lanes = packing.permute(packing.pack(words))
        order = in_order(lanes)
        lanes = [lane[order] for lane in lanes]
        starts = run_starts(lanes)
        sizes = np.diff(np.append(starts, len(order)))
        entry = np.empty(len(order), np.int64)
        entry[order] = np.repeat(np.arange(len(starts)), sizes)
        return cls(packing, [lane[starts] for lane in lanes], sizes), entry

    def words(self) -> list[np.ndarray]:
        return self.packing.unpack(self.packing.restore(self.lanes))

    def cuts(self, parts: int) -> np.ndarray:
        """Where each of so many equal ranges of the first lane ends among the entries."""
        edges = [(part << self.packing.widths[0]) // parts for part in range(1, parts)]
        return np.append(np.searchsorted(self.lanes[0], np.array(edges, np.uint64)), len(self.counts))

    def to_bytes(self, first: int, last: int) -> bytes:
        """Entries from ``first`` to before ``last``."""
        n, lanes = last - first, [lane[first:last] for lane in self.lanes]
        width = self.packing.widths[0]
        low = int(lanes[0][0])
        spread = max(1, (int(lanes[0][-1]) - low + 1) // n)  # about as many quotients as entries
        rest = min(width, spread.bit_length() - 1)
        quotient = ((lanes[0] >> np.uint64(rest)) - np.uint64(low >> rest)).astype(np.int64)
        unary = np.zeros(int(quotient[-1]) + 1 + n, np.uint8)
        unary[quotient + np.arange(n)] = 1
        counts = self.counts[first:last]
        large = np.flatnonzero(counts >= LARGE)
        parts = [HEADER.pack(n, low >> rest, rest), np.packbits(unary).tobytes()]
        for lane, bits in zip(lanes, [rest, *self.packing.widths[1:]], strict=True):
            size = -(-bits // 8)
            kept = lane & np.uint64((1 << bits) - 1)
            parts.append(np.ascontiguousarray(kept.astype("<u8").view(np.uint8).reshape(n, 8)[:, :size]).tobytes())
        parts += [np.minimum(counts, LARGE).astype(np.uint8).tobytes(), counts[large].astype("<i8").tobytes()]
        return struct.pack("<Q", len(unary)) + b"".join(parts)

    @classmethod
    def from_bytes(cls, data: bytes, packing: Packing) -> CountingQuotientFilter:
        (slots,), at = struct.unpack_from("<Q", data), 8
        n, low, rest = HEADER.unpack_from(data, at)
        at += HEADER.size
        unary = np.unpackbits(np.frombuffer(data, np.uint8, -(-slots // 8), at), count=slots)
        at += -(-slots // 8)
        quotient = (np.flatnonzero(unary) - np.arange(n)).astype(np.uint64) + np.uint64(low)
        lanes = []
        for bits in [rest, *packing.widths[1:]]:
            size = -(-bits // 8)
            lane = np.zeros((n, 8), np.uint8)
            lane[:, :size] = np.frombuffer(data, np.uint8, n * size, at).reshape(n, size)
            at += n * size
            lanes.append(lane.reshape(-1).view("<u8").astype(np.uint64))
        lanes[0] = lanes[0] | quotient << np.uint64(rest)
        counts = np.frombuffer(data, np.uint8, n, at).astype(np.int64)
        counts[counts == LARGE] = np.frombuffer(data, "<i8", -1, at + n)
        return cls(packing, lanes, counts)


def merged(filters: list[CountingQuotientFilter]) -> tuple[CountingQuotientFilter, np.ndarray]:
    """One filter with the sums of all counts, and for each entry of each filter, one after the other, its entry there."""
    packing = filters[0].packing
    lanes = [np.concatenate(own) for own in zip(*[f.lanes for f in filters], strict=True)]
    order = in_order(lanes)
    lanes = [lane[order] for lane in lanes]
    starts = run_starts(lanes)
    sums = np.add.reduceat(np.concatenate([f.counts for f in filters])[order], starts)
    entry = np.empty(len(order), np.int64)
    entry[order] = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, len(order))))
    return CountingQuotientFilter(packing, [lane[starts] for lane in lanes], sums), entry
