"""Word scan of many texts at once in numpy: runs of letters, runs of digits, and what surrounds them.

Letters are A-Z, a-z and every byte of a character outside ASCII; A-Z and the capitals of
Latin-1 are folded. A point or comma between two digits belongs to the number.
"""

from dataclasses import dataclass

import numpy as np

from quoinlake.llm.shingles import _FOLD, _POWERS, BASE, BATCH_BYTES, INVERSE, U64, _powers_of, mix

_DIGIT, _LETTER, _UPPER, _STOP = (np.zeros(256, bool) for _ in range(4))
_DIGIT[48:58] = True
_UPPER[65:91] = True
_LETTER[65:91] = _LETTER[97:123] = _LETTER[128:] = True
_STOP[[33, 46, 58, 59, 63, 10, 34]] = True  # ! . : ; ? line end and quote


@dataclass
class Scan:
    """Words of joined texts: `bounds[i]:bounds[i + 1]` are those of text i."""

    raw: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    bounds: np.ndarray
    hashes: np.ndarray
    number: np.ndarray
    capital: np.ndarray  # starts with a capital
    opens: np.ndarray  # first of its sentence, line or text
    spoken: np.ndarray  # raw bytes summed up to each place, for prefixes
    inverse: np.ndarray

    def prefix(self, n: int) -> np.ndarray:
        """Hash of the first n bytes of each word, or 0 for shorter ones."""
        long = self.ends - self.starts >= n
        h = (self.spoken[np.minimum(self.starts + n, len(self.spoken) - 1)] - self.spoken[self.starts]) * self.inverse[self.starts]
        return np.where(long, mix(h + U64(n << 32)), U64(0))


def scan(texts: list) -> Scan:
    parts = [(t or "").encode() for t in texts]
    data = b"\n".join(parts) + b"\n"
    raw = np.frombuffer(data, np.uint8)
    power, inverse = _POWERS if len(raw) <= 2 * BATCH_BYTES else (_powers_of(BASE, len(raw)), _powers_of(INVERSE, len(raw)))
    digit, letter = _DIGIT[raw], _LETTER[raw]
    inside = np.zeros(len(raw), bool)
    if len(raw) > 2:
        inside[1:-1] = ((raw[1:-1] == 46) | (raw[1:-1] == 44)) & digit[:-2] & digit[2:]
    kind = np.zeros(len(raw) + 2, np.int8)
    kind[1:-1] = letter + 2 * (digit | inside)
    change = np.flatnonzero(kind[1:] != kind[:-1])
    runs = kind[change + 1]
    solid = runs > 0
    starts = change[solid]
    ends = np.append(change, len(raw))[1:][solid[: len(change)]] if len(change) else change
    number = runs[solid] == 2

    folded = _FOLD[raw]
    if len(raw) > 1:
        latin = (raw[:-1] == 0xC3) & (raw[1:] >= 0x80) & (raw[1:] <= 0x9E) & (raw[1:] != 0x97)
        folded[1:][latin] += U64(32)
    spoken = np.zeros(len(raw) + 1, U64)
    np.cumsum(folded * power[: len(raw)], out=spoken[1:])
    hashes = mix((spoken[ends] - spoken[starts]) * inverse[starts] + (ends - starts).astype(U64))

    capital = _UPPER[raw[starts]]
    second = raw[np.minimum(starts + 1, len(raw) - 1)]
    capital |= (raw[starts] == 0xC3) & (second >= 0x80) & (second <= 0x9E) & (second != 0x97)
    stops = np.concatenate([[0], np.cumsum(_STOP[raw])])
    before = np.concatenate([[0], ends[:-1]]) if len(ends) else ends
    opens = stops[starts] > stops[before]
    if len(opens):
        opens[0] = True
    bounds = np.concatenate([[0], np.searchsorted(starts, np.cumsum([len(p) + 1 for p in parts]))])
    return Scan(raw, starts, ends, bounds, hashes, number, capital, opens, spoken, inverse)


def in_batches(texts: list, most: int = BATCH_BYTES):
    """(first index, texts) of at most about `most` characters, or one text."""
    at, size = 0, 0
    for i, t in enumerate(texts):
        size += len(t or "")
        if size > most or i == len(texts) - 1:
            yield at, texts[at : i + 1]
            at, size = i + 1, 0
