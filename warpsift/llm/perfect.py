"""Minimal perfect hashes over byte strings, with the keys stored beside them.

Keys are placed level by level. A level is a table somewhat larger than the keys that are left;
a key whose place no other key wants stays there, all others go on to the next level. The keys
that stay are numbered through, so n keys get the slots 0 to n - 1. A lookup goes to the first
level where the place of the word is taken, and compares the word with the key stored there:
words that were never stored are told from stored ones exactly.

Words are stretches of one byte array, so that hashes, places and comparisons are worked out for
many words at once, eight bytes at a time.
"""

from __future__ import annotations

import numpy as np
import xxhash

SPACE = 1.6
LEVELS = 40
#: Words beyond so many bytes are hashed and compared one by one.
LONG = 64
_STEP = 0x9E3779B97F4A7C15
_ODD = np.uint64(0xD6E8FEB86659FD93)
_HALF = np.uint64(32)


def _mix(x: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = (x ^ (x >> _HALF)) * _ODD
        x = (x ^ (x >> _HALF)) * _ODD
        return x ^ (x >> _HALF)


#: Bytes behind the last word of an array, so that eight can be read anywhere.
PAD = b"\0" * 8
_MASKS = np.array([(1 << 8 * i) - 1 for i in range(9)], np.uint64)


def _eight(data: np.ndarray, starts: np.ndarray, lengths: np.ndarray, at: int) -> np.ndarray:
    """The bytes `at` to `at + 7` of each word as one number; bytes behind its end are 0."""
    anywhere = np.ndarray((len(data) - 7,), "<u8", data, 0, (1,))
    read = anywhere[np.minimum(starts + at, len(data) - 8)]
    return read & _MASKS[np.clip(lengths - at, 0, 8)]


def hashes_of(data: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """64-bit hashes of words that lie in `data`, which ends in `PAD`."""
    with np.errstate(over="ignore"):
        out = lengths.astype(np.uint64) * np.uint64(_STEP)
    most = min(LONG, int(lengths.max(initial=0)))
    for at in range(0, max(most, 1), 8):
        some = slice(None) if at == 0 else np.flatnonzero(lengths > at)
        out[some] = _mix(out[some] ^ _eight(data, starts[some], lengths[some], at))
    for i in np.flatnonzero(lengths > LONG).tolist():
        word = data[starts[i]:starts[i] + lengths[i]].tobytes()
        out[i] = xxhash.xxh3_64_intdigest(word)
    return out


def laid_out(words: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words in one array: the bytes, where each begins, how long it is."""
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    return np.frombuffer(b"".join([*words, PAD]), np.uint8), np.cumsum(lengths) - lengths, lengths


def hashed(words: list[bytes]) -> np.ndarray:
    return hashes_of(*laid_out(words))


def _places(hashes: np.ndarray, level: int) -> np.ndarray:
    return _mix(hashes ^ np.uint64((level + 1) * _STEP & 0xFFFFFFFFFFFFFFFF))


class PerfectHash:
    """`sizes` of the levels, their `table` of slots (-1: free), and the keys by slot.

    Keys with equal 64-bit hashes, which no level can part, stand at the end: `spare` of them.
    """

    def __init__(self, sizes: list[int], table: np.ndarray, keys: list[bytes], spare: int):
        self.sizes, self.table, self.keys, self.spare = sizes, table, keys, spare

    def __len__(self) -> int:
        return len(self.keys)

    def slots(self, words: list[bytes]) -> np.ndarray:
        """The slot of each word; -1 where it is no key."""
        return Shards([self]).find(*laid_out(words))


def build(keys: list[bytes]) -> PerfectHash:
    """The hash of distinct keys, in whatever order they come."""
    keys = sorted(keys)
    hashes, left = hashed(keys), np.arange(len(keys))
    sizes, tables, order, n = [], [], [], 0
    while len(left) and len(sizes) < LEVELS:
        size = int(SPACE * len(left)) + 1
        at = (_places(hashes[left], len(sizes)) % np.uint64(size)).astype(np.int64)
        alone = np.bincount(at, minlength=size)[at] == 1
        table = np.full(size, -1, np.int32)
        table[at[alone]] = n + np.arange(alone.sum())
        order.append(left[alone])
        n += int(alone.sum())
        left = left[~alone]
        sizes.append(size)
        tables.append(table)
    named = [keys[i] for part in [*order, left] for i in part.tolist()]
    return PerfectHash(sizes, np.concatenate(tables) if tables else np.empty(0, np.int32), named,
                       len(left))


class Shards:
    """Several perfect hashes side by side; a word belongs to the shard of its hash. Slots count
    through all shards: those of shard s begin at `starts[s]`."""

    def __init__(self, shards: list[PerfectHash]):
        self.n = len(shards)
        self.starts = np.concatenate([[0], np.cumsum([len(s) for s in shards])]).astype(np.int64)
        levels = max([len(s.sizes) for s in shards], default=0)
        self.sizes = np.zeros((levels, self.n), np.uint64)
        self.offsets = np.zeros((levels, self.n), np.int64)
        tables, at = [], 0
        for i, s in enumerate(shards):
            for level, size in enumerate(s.sizes):
                self.sizes[level, i], self.offsets[level, i] = size, at
                at += size
            tables.append(np.where(s.table < 0, -1, s.table + self.starts[i]))
        self.table = np.concatenate([*tables, [-1]]).astype(np.int64)
        keys = [k for s in shards for k in s.keys]
        self.data, self.begins, self.lengths = laid_out(keys)
        self.spare = {}
        for i, s in enumerate(shards):
            for slot in range(len(s) - s.spare, len(s)):
                self.spare[s.keys[slot]] = int(self.starts[i]) + slot

    def shard_of(self, hashes: np.ndarray) -> np.ndarray:
        return (hashes % np.uint64(self.n)).astype(np.int64)

    def find(self, data: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """The slot of each word of `data`; -1 where it is no key."""
        out = np.full(len(starts), -1, np.int64)
        if not self.n or not len(starts):
            return out
        hashes = hashes_of(data, starts, lengths)
        shard = self.shard_of(hashes)
        open_ = np.arange(len(starts))
        for level in range(len(self.sizes)):
            size = self.sizes[level][shard[open_]]
            more = size > 0
            if not more.all():
                open_, size = open_[more], size[more]
            if not len(open_):
                break
            at = (_places(hashes[open_], level) % size).astype(np.int64)
            found = self.table[self.offsets[level][shard[open_]] + at]
            out[open_] = found
            open_ = open_[found < 0]
        there = np.flatnonzero(out >= 0)
        same = self._same(out[there], data, starts[there], lengths[there])
        out[there[~same]] = -1
        if self.spare:
            for i in np.flatnonzero(out < 0).tolist():
                word = data[starts[i]:starts[i] + lengths[i]].tobytes()
                out[i] = self.spare.get(word, -1)
        return out

    def _same(self, slots, data, starts, lengths) -> np.ndarray:
        """Whether each word is the key stored at its slot, byte for byte."""
        begins = self.begins[slots]
        same = self.lengths[slots] == lengths
        most = min(LONG, int(lengths.max(initial=0)))
        for at in range(0, most, 8):
            some = np.flatnonzero(same & (lengths > at))
            a = _eight(self.data, begins[some], lengths[some], at)
            b = _eight(data, starts[some], lengths[some], at)
            same[some[a != b]] = False
        for i in np.flatnonzero(same & (lengths > LONG)).tolist():
            n = lengths[i]
            same[i] = self.data[begins[i]:begins[i] + n].tobytes() == \
                data[starts[i]:starts[i] + n].tobytes()
        return same
