"""Word shingles and MinHash values of whole batches of texts, in numpy.

Words are runs of ``[^\\x20\\x09-\\x0D]`` in lower case.  A text of ``size``
words or more has the shingles of ``size`` neighbouring words; a shorter one
has a single shingle of all its words; a text without words has none.  Words
and shingles are 64-bit hashes.
"""

from __future__ import annotations

import numpy as np

SIZE = 5
_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))
_STEP = np.uint64(0xD6E8FEB86659FD93)
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True


def mix(x: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit values."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_hashes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words, and how many each text has."""
    raw = [t.lower().encode("utf-8", "surrogatepass") for t in texts]
    data = np.frombuffer(b" ".join([*raw, b""]), np.uint8)
    if not len(data):
        return np.zeros(0, np.uint64), np.zeros(len(texts), np.int64)
    space = _SPACE[data]
    starts = np.flatnonzero(~space & np.concatenate([[True], space[:-1]]))
    ends = np.cumsum([len(r) + 1 for r in raw])
    per_text = np.diff(np.searchsorted(starts, ends), prepend=0)
    if not len(starts):
        return np.zeros(0, np.uint64), per_text
    powers = np.full(len(data), _BASE)
    powers[0] = 1
    np.multiply.accumulate(powers, out=powers)
    value = np.where(space, np.uint64(0), data.astype(np.uint64) + np.uint64(1)) * powers
    back = np.full(len(data), _INVERSE)
    back[0] = 1
    np.multiply.accumulate(back, out=back)
    return mix(np.add.reduceat(value, starts) * back[starts]), per_text


def shingle_sets(texts: list[str], size: int = SIZE) -> list[np.ndarray]:
    """The sorted distinct shingles of each text."""
    words, per_text = word_hashes(texts)
    weights = np.multiply.accumulate(np.full(size, _STEP))
    n = len(words)
    if n >= size:
        sums = np.zeros(n - size + 1, np.uint64)
        for j in range(size):
            sums += words[j:n - size + 1 + j] * weights[j]
        sums = mix(sums)
    out, at = [], 0
    for k in per_text.tolist():
        if k >= size:
            out.append(np.unique(sums[at:at + k - size + 1]))
        elif k:
            short = (words[at:at + k] * weights[:k]).sum(dtype=np.uint64) + np.uint64(k)
            out.append(mix(np.array([short], np.uint64)))
        else:
            out.append(np.zeros(0, np.uint64))
        at += k
    return out


class MinHasher:
    """``count`` MinHash values (32 bits each) per set."""

    def __init__(self, count: int, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.factors = rng.integers(0, 1 << 63, count, np.uint64) * np.uint64(2) + np.uint64(1)
        self.masks = rng.integers(0, 1 << 63, count, np.uint64)

    def signatures(self, sets: list[np.ndarray]) -> np.ndarray:
        """One row per set; an empty set has the largest value throughout."""
        out = np.full((len(sets), len(self.factors)), 0xFFFFFFFF, np.uint32)
        full = [i for i, s in enumerate(sets) if len(s)]
        if not full:
            return out
        joined = np.concatenate([sets[i] for i in full])
        starts = np.cumsum([0] + [len(sets[i]) for i in full[:-1]])
        for j, (a, b) in enumerate(zip(self.factors, self.masks, strict=True)):
            low = np.minimum.reduceat((joined ^ b) * a, starts)
            out[full, j] = (low >> np.uint64(32)).astype(np.uint32)
        return out
