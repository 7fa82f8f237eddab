"""Words of a text as bytes, and 64-bit hashes of words and word runs, for use inside Arrow tasks."""

import numpy as np
import xxhash

# 0-9, a-z and every byte of a non-ASCII character stay, A-Z become a-z, all else separates.
ALNUM_TABLE = bytes(
    b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256)
)


def alnum_words(text):
    """Runs of ASCII letters and digits and of non-ASCII characters, A-Z lower-cased; none for null."""
    return text.encode("utf-8", "surrogatepass").translate(ALNUM_TABLE).split() if text else []


def space_words(text):
    """Runs of characters other than ASCII white space (20, 09-0D), A-Z lower-cased; none for null."""
    return text.encode("utf-8", "surrogatepass").lower().split() if text else []


def word_hashes(words):
    return np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))


def mixed(x):
    """A bijection of 64-bit numbers that spreads every input bit over the output (in place)."""
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    return x


BASE = 0x9E3779B97F4A7C15


def gram_hashes(hashes, k):
    """Hashes of all runs of ``k`` consecutive words; one hash of the whole if there are fewer, but not none."""
    n = len(hashes)
    if n == 0:
        return np.empty(0, np.uint64)
    size = min(n, k)
    out = np.full(n - size + 1, size, np.uint64)
    for i in range(size):
        out *= np.uint64(BASE)
        out += hashes[i : n - size + 1 + i]
    return mixed(out)
