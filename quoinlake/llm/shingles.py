"""Word shingles of many texts at once, as 64-bit hashes in numpy.

A word is a maximal run without the six ASCII blanks, A-Z lower-cased; nothing else is
folded. A shingle is five words in a row; a text of fewer words is one shingle of its own.
Hashes stand for shingles: two different ones agree with a chance of 2^-64 a pair.
"""

import numpy as np

WORDS = 5
U64 = np.uint64
#: Fixed values of the hash: an odd base, its inverse modulo 2^64 and odd multipliers.
BASE = 0x9E3779B97F4A7C15
INVERSE = pow(BASE, -1, 2**64)
LANES = np.array([0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB], U64)
_BLANK = np.zeros(256, bool)
_BLANK[[32, 9, 10, 11, 12, 13]] = True
_FOLD = np.arange(256, dtype=np.uint64) + U64(1)
_FOLD[65:91] += U64(32)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def _powers_of(base: int, n: int) -> np.ndarray:
    grown = np.full(n, base, U64)
    grown[0] = 1
    return np.multiply.accumulate(grown)


#: Powers of the base and of its inverse for one batch of texts; longer batches make their own.
BATCH_BYTES = 1 << 18
_POWERS = _powers_of(BASE, 2 * BATCH_BYTES), _powers_of(INVERSE, 2 * BATCH_BYTES)


def word_hashes(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Hash and start of each word of UTF-8 bytes."""
    raw = np.frombuffer(data, np.uint8)
    solid = np.empty(len(raw) + 2, bool)
    solid[0] = solid[-1] = False
    np.logical_not(_BLANK[raw], out=solid[1:-1])
    edges = np.flatnonzero(solid[1:] != solid[:-1])
    starts, ends = edges[::2], edges[1::2]
    power, inverse = _POWERS if len(raw) <= 2 * BATCH_BYTES else (_powers_of(BASE, len(raw)), _powers_of(INVERSE, len(raw)))
    sums = np.zeros(len(raw) + 1, U64)
    np.cumsum(_FOLD[raw] * power[: len(raw)], out=sums[1:])
    return mix((sums[ends] - sums[starts]) * inverse[starts] + (ends - starts).astype(U64)), starts


def shingle_sets(texts: list) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text; empty for NULL and for texts without words."""
    out: list[np.ndarray] = []
    batch, size = [], 0
    for t in texts:
        batch.append((t or "").encode())
        size += len(batch[-1])
        if size > BATCH_BYTES:
            out += _sets(batch)
            batch, size = [], 0
    return out + _sets(batch) if batch else out


def _sets(parts: list[bytes]) -> list[np.ndarray]:
    words, starts = word_hashes(b" ".join(parts))
    ends = np.cumsum([len(p) + 1 for p in parts])
    bounds = np.concatenate([[0], np.searchsorted(starts, ends)])
    n = len(words) - WORDS + 1
    rolled = np.zeros(max(n, 0), U64)
    for j in range(WORDS):
        rolled += words[j : j + len(rolled)] * LANES[j]
    rolled = mix(rolled)
    out = []
    for a, b in zip(bounds[:-1], bounds[1:]):
        if b - a >= WORDS:
            out.append(np.unique(rolled[a : b - WORDS + 1]))
        elif b > a:
            short = (words[a:b] * LANES[: b - a]).sum(dtype=U64) + U64(int(b - a))
            out.append(mix(mix(np.array([short], U64))))
        else:
            out.append(np.zeros(0, U64))
    return out
