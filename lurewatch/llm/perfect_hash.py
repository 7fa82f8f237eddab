"""Minimal perfect hashes of byte strings, with the keys beside them."""

import numpy as np
import xxhash

from lurewatch.llm.words import mixed

GAMMA = 2.0
STEP = 0x9E3779B97F4A7C15


def _hashes(keys, seed):
    return np.fromiter((xxhash.xxh64_intdigest(k, seed) for k in keys), np.uint64, len(keys))


def _places(hashes, level, size):
    with np.errstate(over="ignore"):
        return mixed(hashes + np.uint64((level + 1) * STEP & 0xFFFFFFFFFFFFFFFF)) % np.uint64(size)


class PerfectHash:
    """Gives each of n distinct keys its own slot from 0 to n - 1, and every other key none.

    Levels of bits: a key is settled on the first level where no other unsettled key has its place; the slot
    is the rank of that bit among all bits. A string that is not a key may meet a set bit, so the key stored
    in the slot is compared byte by byte.
    """

    def __init__(self, seed, levels, ranks, blob, ends):
        self.seed, self.levels, self.ranks, self.blob, self.ends = seed, levels, ranks, blob, ends

    @classmethod
    def build(cls, keys):
        """``keys``: distinct byte strings."""
        seed = 0
        while len(np.unique(hashes := _hashes(keys, seed))) < len(keys):
            seed += 1  # two keys share a 64-bit hash: no level could part them
        levels, rest = [], hashes
        while len(rest):
            size = 64 * int(np.ceil(GAMMA * len(rest) / 64))
            places = _places(rest, len(levels), size)
            alone = np.bincount(places.astype(np.int64), minlength=size) == 1
            levels.append(np.packbits(alone, bitorder="little").view(np.uint64))
            rest = rest[~alone[places.astype(np.int64)]]
        ranks, seen = [], 0
        for words in levels:
            counts = np.bitwise_count(words).astype(np.int64)
            ranks.append(seen + np.cumsum(counts) - counts)
            seen += int(counts.sum())
        made = cls(seed, levels, ranks, b"", np.zeros(0, np.int64))
        ordered = [b""] * len(keys)
        for key, slot in zip(keys, made._slots(hashes).tolist()):
            ordered[slot] = key
        made.blob = b"".join(ordered)
        made.ends = np.cumsum([len(k) for k in ordered], dtype=np.int64)
        return made

    def state(self):
        """What the constructor takes, in a form that can be written to a table."""
        return self.seed, self.levels, self.ranks, self.blob, self.ends

    def __len__(self):
        return len(self.ends)

    def _slots(self, hashes):
        out, rest = np.full(len(hashes), -1, np.int64), np.arange(len(hashes))
        for level, (words, ranks) in enumerate(zip(self.levels, self.ranks)):
            places = _places(hashes[rest], level, 64 * len(words))
            at, bit = (places >> np.uint64(6)).astype(np.int64), places & np.uint64(63)
            held = (words[at] >> bit) & np.uint64(1) == 1
            below = words[at] & ((np.uint64(1) << bit) - np.uint64(1))
            out[rest[held]] = (ranks[at] + np.bitwise_count(below))[held]
            rest = rest[~held]
        return out

    def key(self, slot):
        return self.blob[self.ends[slot - 1] if slot else 0 : self.ends[slot]]

    def keys(self):
        return [self.key(i) for i in range(len(self))]

    def slots(self, keys):
        """The slot of each of ``keys``, or -1 where it is not among the stored ones."""
        found = self._slots(_hashes(keys, self.seed))
        for i in np.flatnonzero(found >= 0):
            if self.key(found[i]) != keys[i]:
                found[i] = -1
        return found
