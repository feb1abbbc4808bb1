"""Word shingles of whole texts and HyperMinHash sketches of their sets."""

from __future__ import annotations

import hashlib

import numpy as np
import xxhash

from notewright.llm.words import MIX, STEP, WordTable

WIDTH = 5
#: Buckets of a sketch; a register has the leading zeros of the least hash of its bucket and the
#: ``MANTISSA`` bits after its first one.
BUCKETS, MANTISSA, ZEROS_MOST = 256, 10, 62
#: Words are cheap to hash, so few are remembered.
REMEMBERED_CHARS = 2 << 20
U = np.uint64


def word_rows(words: list[bytes]) -> np.ndarray:
    h = np.fromiter((xxhash.xxh3_64_intdigest(w) for w in words), np.uint64, len(words))
    return h.view(np.float64)[:, None]


class Shingler:
    """Distinct shingles of texts as sorted 64-bit hashes; words are hashed once for each worker."""

    def __init__(self, width: int = WIDTH):
        self.words, self.width = WordTable(word_rows, 1, REMEMBERED_CHARS), width

    def sets(self, texts: list[str]) -> list[np.ndarray]:
        """A-Z in lower case, words between ASCII white space; fewer words than a shingle has are one
        shingle, no word is none."""
        ids = self.words.ids([t.encode("utf-8", "surrogatepass").lower().split() for t in texts])
        hashes = np.ascontiguousarray(self.words.rows[:, 0]).view(np.uint64)
        return [self.of(hashes[i]) for i in ids]

    def of(self, h: np.ndarray) -> np.ndarray:
        if not len(h):
            return h
        n = min(self.width, len(h))
        out = np.full(len(h) - n + 1, n, np.uint64)
        for k in range(n):
            out = (out ^ h[k : k + len(out)]) * MIX
            out ^= out >> U(29)
        out = (out ^ (out >> U(32))) * STEP
        return np.unique(out ^ (out >> U(32)))


def set_digest(shingles: np.ndarray) -> bytes:
    return hashlib.blake2b(shingles.tobytes(), digest_size=16).digest()


def registers(shingles: np.ndarray, buckets: int = BUCKETS) -> np.ndarray:
    """The HyperMinHash registers of a set: 16 bits for each bucket, leading zeros and mantissa.

    A shingle's high bits choose its bucket, the rest its rank there.  Buckets without a shingle
    borrow the register of the first bucket with one along a pseudo-random walk that is the same for
    all sets, so equal sets still agree everywhere and each register agrees with about the
    probability of the Jaccard similarity.
    """
    bits = int(buckets).bit_length() - 1
    bucket = (shingles >> U(64 - bits)).astype(np.int64)
    rest = (shingles << U(bits)) | U((1 << bits) - 1)
    # Sorted by hash, so the first of each bucket is its least.
    first = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]])
    least = rest[first]
    zeros = np.minimum(63 - np.floor(np.log2(np.maximum(least.astype(np.float64), 1))).astype(np.int64), ZEROS_MOST)
    zeros = np.maximum(zeros, 0)
    mantissa = ((least << zeros.astype(np.uint64)) << U(1)) >> U(64 - MANTISSA)
    out = np.full(buckets, -1, np.int64)
    out[bucket[first]] = (zeros << MANTISSA) | mantissa.astype(np.int64)
    empty = np.flatnonzero(out < 0)
    filled = out.copy()
    k = 0
    while len(empty):
        at = _walk(buckets, k)[empty]
        got = out[at]
        hit = got >= 0
        # The borrowed register is mixed with nothing: where both sets lack the bucket they walk alike.
        filled[empty[hit]] = got[hit]
        empty = empty[~hit]
        k += 1
    return filled.astype(np.uint16)


_walks: dict[tuple[int, int], np.ndarray] = {}


def _walk(buckets: int, step: int) -> np.ndarray:
    if (buckets, step) not in _walks:
        _walks[buckets, step] = np.random.default_rng(1_000_003 * step + buckets).integers(0, buckets, buckets)
    return _walks[buckets, step]


def band_keys(regs: np.ndarray, rows: int) -> np.ndarray:
    """One 64-bit key for each band of ``rows`` registers."""
    bands = len(regs) // rows
    h = np.arange(1, bands + 1, dtype=np.uint64) * STEP
    for k in range(rows):
        h = (h ^ regs[k : bands * rows : rows].astype(np.uint64)) * MIX
        h ^= h >> U(31)
    return h


def estimate(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Jaccard similarity from the share of registers that agree, less what agrees by chance.

    Two different least hashes give the same register when they have the same leading zeros (with a
    chance of about one in three) and the same mantissa.
    """
    agree = (a == b).mean(axis=-1)
    chance = (1 / 3) / (1 << MANTISSA)
    return np.clip((agree - chance) / (1 - chance), 0, 1)
