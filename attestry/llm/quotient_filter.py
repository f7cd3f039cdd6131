"""Lossless counting quotient filters over fixed-width keys, as sorted NumPy arrays and as compact bytes."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

from attestry.llm.common import mix

#: Fixed round constants of the permutation.
ROUNDS = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5)
#: Largest count held in one byte; from it on, eight bytes follow.
ESCAPE = 255


def _mask(bits: int) -> np.uint64:
    return np.uint64((1 << bits) - 1)


def permute(high: np.ndarray, low: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Scramble keys of two halves of ``bits`` bits each (32 at most for single words, 64 in all), one to one."""
    mask = _mask(bits)
    for i in range(0, len(ROUNDS), 2):
        high = high ^ (mix(low + np.uint64(ROUNDS[i])) & mask)
        low = low ^ (mix(high + np.uint64(ROUNDS[i + 1])) & mask)
    return high, low


def restore(high: np.ndarray, low: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """The keys that :func:`permute` scrambled."""
    mask = _mask(bits)
    for i in reversed(range(0, len(ROUNDS), 2)):
        low = low ^ (mix(high + np.uint64(ROUNDS[i + 1])) & mask)
        high = high ^ (mix(low + np.uint64(ROUNDS[i])) & mask)
    return high, low


@dataclass
class Counts:
    """Distinct permuted keys in order, each with its count: a filter laid out as arrays."""

    high: np.ndarray
    low: np.ndarray
    count: np.ndarray

    def __len__(self) -> int:
        return len(self.count)

    def cut(self, start: int, end: int) -> Counts:
        return Counts(self.high[start:end], self.low[start:end], self.count[start:end])


def empty() -> Counts:
    return Counts(np.zeros(0, np.uint64), np.zeros(0, np.uint64), np.zeros(0, np.int64))


def count_keys(high: np.ndarray, low: np.ndarray, bits: int) -> Counts:
    """The filter of these keys, repeats counted."""
    return _summed(*permute(high, low, bits), None, bits)


def merge(parts: list[Counts], bits: int) -> Counts:
    """One filter for several; equal keys meet because all use the same permutation.

    Keys of 64 bits at most are put together before they are joined: one lane is sorted, half the memory.
    """
    if len(parts) == 1:
        return parts[0]
    if not any(len(p) for p in parts):
        return empty()
    count = np.concatenate([p.count for p in parts])
    if bits <= 32:
        return _summed_whole(np.concatenate([(p.high << np.uint64(bits)) | p.low for p in parts]), count, bits)
    return _summed(*(np.concatenate([getattr(p, f) for p in parts]) for f in ("high", "low")), count, bits)


def _summed_whole(whole: np.ndarray, count: np.ndarray, bits: int) -> Counts:
    """The filter of keys whose halves are put together, each with a count."""
    order = np.argsort(whole, kind="stable")
    whole = whole[order]
    first = np.flatnonzero(np.concatenate([[True], whole[1:] != whole[:-1]]))
    whole, total = whole[first], np.add.reduceat(count[order], first)
    return Counts(whole >> np.uint64(bits), whole & _mask(bits), total)


def _summed(high: np.ndarray, low: np.ndarray, count: np.ndarray | None, bits: int) -> Counts:
    if not len(high):
        return empty()
    if bits <= 32:
        whole = (high << np.uint64(bits)) | low
        whole, count = np.unique(whole, return_counts=True)
        return Counts(whole >> np.uint64(bits), whole & _mask(bits), count.astype(np.int64))
    order = np.lexsort((low, high))
    a, b = high[order], low[order]
    fresh = np.concatenate([[True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])])
    del a, b
    first = np.flatnonzero(fresh)
    total = np.diff(np.append(first, len(order))) if count is None else np.add.reduceat(count[order], first)
    return Counts(high[order[first]], low[order[first]], total.astype(np.int64))


def segments(counts: Counts, bits: int, segment_bits: int) -> list[tuple[int, Counts]]:
    """The filter cut by the leading bits of its keys, empty segments left out."""
    if not len(counts):
        return []
    number = (counts.high >> np.uint64(bits - segment_bits)).astype(np.int64) if segment_bits else np.zeros(len(counts), np.int64)
    first = np.flatnonzero(np.concatenate([[True], number[1:] != number[:-1]]))
    ends = np.append(first[1:], len(number))
    return [(int(number[i]), counts.cut(i, j)) for i, j in zip(first, ends, strict=True)]


def pack(counts: Counts, bits: int, segment_bits: int) -> bytes:
    """Bytes of one segment.

    After the segment's bits, a key splits into a quotient, as long as the
    number of entries asks for, and the whole remainder. Quotients are kept as
    one bit for each possible one (occupied) and one for each entry (last of its
    run); remainders take as many bytes as they need; counts one byte each, larger ones eight more.
    """
    n = len(counts)
    quotient_bits = min(max(n - 1, 1).bit_length(), bits - segment_bits)
    rest = bits - segment_bits - quotient_bits
    quotient = (counts.high >> np.uint64(rest)) & _mask(quotient_bits)
    last = np.concatenate([quotient[1:] != quotient[:-1], [True]])
    occupied = np.zeros(1 << quotient_bits, np.uint8)
    occupied[quotient] = 1
    parts = [np.array([n, quotient_bits], "<u8").tobytes(), np.packbits(occupied).tobytes(), np.packbits(last).tobytes()]
    for lane, width in ((counts.high & _mask(rest), rest), (counts.low, bits)):
        parts.append(np.ascontiguousarray(lane.astype("<u8").view(np.uint8).reshape(n, 8)[:, : -(-width // 8)]).tobytes())
    large = counts.count >= ESCAPE
    parts += [np.where(large, ESCAPE, counts.count).astype(np.uint8).tobytes(), counts.count[large].astype("<i8").tobytes()]
    return b"".join(parts)


def unpack(blob: bytes, segment: int, bits: int, segment_bits: int) -> Counts:
    """The entries that :func:`pack` wrote."""
    n, quotient_bits = (int(x) for x in np.frombuffer(blob, "<u8", 2))
    rest, at = bits - segment_bits - quotient_bits, 16

    def take(length: int) -> np.ndarray:
        nonlocal at
        at += length
        return np.frombuffer(blob, np.uint8, length, at - length)

    occupied = np.flatnonzero(np.unpackbits(take(-(-(1 << quotient_bits) // 8)), count=1 << quotient_bits))
    last = np.unpackbits(take(-(-n // 8)), count=n)
    run = np.cumsum(last) - last
    lanes = []
    for width in (rest, bits):
        size = -(-width // 8)
        lane = np.zeros((n, 8), np.uint8)
        lane[:, :size] = take(n * size).reshape(n, size)
        lanes.append(lane.reshape(-1).view("<u8").astype(np.uint64))
    high = (np.uint64(segment) << np.uint64(quotient_bits + rest)) | (occupied[run].astype(np.uint64) << np.uint64(rest)) | lanes[0]
    count = take(n).astype(np.int64)
    large = count == ESCAPE
    count[large] = np.frombuffer(blob, "<i8", int(large.sum()), at)
    return Counts(high, lanes[1], count)
