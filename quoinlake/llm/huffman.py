"""Canonical Huffman codes of bounded length, packed and unpacked in numpy.

Codes are at most 16 bits long, so that one table of 2^16 entries decodes. Runs of
`RUN` ids start at known bit offsets and are decoded side by side.
"""

import numpy as np

MAX_BITS = 16
RUN = 1024


def code_lengths(counts: np.ndarray, most: int = MAX_BITS) -> np.ndarray:
    """Length of each symbol's code by package-merge: the shortest total with no code over `most`.

    Symbols with count 0 get length 0. A single symbol gets length 1.
    """
    used = np.flatnonzero(counts > 0)
    lengths = np.zeros(len(counts), np.uint8)
    if len(used) > 1 << most:
        raise ValueError(f"{len(used)} symbols do not fit codes of {most} bits")
    if len(used) < 2:
        lengths[used] = 1
        return lengths
    order = used[np.argsort(counts[used], kind="stable")]
    weight = counts[order].astype(np.int64)
    n, levels, row = len(order), [], weight
    single = np.ones(n, bool)
    for _ in range(most - 1):
        levels.append(single)
        pairs = row[: len(row) // 2 * 2].reshape(-1, 2).sum(axis=1)
        both = np.concatenate([weight, pairs])
        place = np.argsort(both, kind="stable")
        row, single = both[place], place < n
    levels.append(single)
    take, depth = 2 * n - 2, np.zeros(n + 1, np.int64)
    for single in reversed(levels):
        leaves = int(single[:take].sum())
        depth[:leaves] += 1
        take = 2 * (take - leaves)
    lengths[order] = depth[:n]
    return lengths


def canonical_codes(lengths: np.ndarray) -> np.ndarray:
    """Codes in order of length and symbol."""
    codes = np.zeros(len(lengths), np.uint32)
    order = np.lexsort((np.arange(len(lengths)), lengths))
    order = order[lengths[order] > 0]
    size = lengths[order].astype(np.int64)
    if len(order):
        # A code is the sum of the room that those before it take, in units of its own length.
        room = np.concatenate([[0], np.cumsum(1 << (MAX_BITS - size))[:-1]])
        codes[order] = (room >> (MAX_BITS - size)).astype(np.uint32)
    return codes


def decode_table(lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Symbol and code length for each 16 bits that may come next."""
    order = np.lexsort((np.arange(len(lengths)), lengths))
    order = order[lengths[order] > 0]
    span = 1 << (MAX_BITS - lengths[order].astype(np.int64))
    symbols, sizes = np.zeros(1 << MAX_BITS, np.uint32), np.ones(1 << MAX_BITS, np.uint8)
    symbols[: span.sum()] = np.repeat(order, span)
    sizes[: span.sum()] = np.repeat(lengths[order], span)
    return symbols, sizes


def pack(ids: np.ndarray, codes: np.ndarray, lengths: np.ndarray) -> tuple[bytes, np.ndarray]:
    """Bit string of the ids and the bit offset of every RUN-th of them."""
    return pack_all(ids, np.array([len(ids)]), codes, lengths)[0]


def pack_all(ids: np.ndarray, counts: np.ndarray, codes: np.ndarray, lengths: np.ndarray) -> list[tuple[bytes, np.ndarray]]:
    """What `pack` makes of each of several texts, of `counts` ids each, one after another."""
    if not len(ids):
        return [(b"", np.zeros(0, np.int64)) for _ in counts]
    size = lengths[ids].astype(np.int64)
    end = np.concatenate([[0], np.cumsum(size)])
    last = np.cumsum(counts)
    before = end[last - counts]
    bits_of = end[last] - before
    base = np.concatenate([[0], np.cumsum((bits_of + 31) // 32 + 1)])  # each text starts at a word of its own
    start = end[:-1] + np.repeat(32 * base[:-1] - before, counts)
    word, low = start >> 5, 64 - (start & 31) - size  # a code lies in 64 bits from its word on
    bits = codes[ids].astype(np.uint64) << low.astype(np.uint64)
    first = np.flatnonzero(np.diff(word, prepend=-1))
    sums = np.bitwise_or.reduceat(bits, first)
    out = np.zeros(base[-1] + 1, np.uint32)
    out[word[first]] |= (sums >> np.uint64(32)).astype(np.uint32)
    out[word[first] + 1] |= (sums & np.uint64(0xFFFFFFFF)).astype(np.uint32)
    data = out.astype(">u4").tobytes()
    return [
        (data[4 * at : 4 * at + (n + 7) // 8], start[b - c : b : RUN] - 32 * at)
        for at, n, b, c in zip(base.tolist(), bits_of.tolist(), last.tolist(), counts.tolist())]


def unpack(data: bytes, offsets: np.ndarray, counts: np.ndarray, table: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """Ids of runs that start at bit `offsets` and hold `counts` ids each, one after the other."""
    symbols, sizes = table
    raw = np.frombuffer(data + b"\0\0\0\0", np.uint8).astype(np.uint32)
    window = (raw[:-3] << 24) | (raw[1:-2] << 16) | (raw[2:-1] << 8) | raw[3:]
    ends = np.cumsum(counts)
    out = np.zeros(int(ends[-1]) if len(ends) else 0, np.uint32)
    order = np.argsort(-counts, kind="stable")
    at, to, left = offsets[order].astype(np.int64), (ends - counts)[order], counts[order]
    alive = len(order)
    for step in range(int(left[0]) if alive else 0):
        while alive and left[alive - 1] <= step:
            alive -= 1
        p = at[:alive]
        peek = ((window[p >> 3] << (p & 7).astype(np.uint32)) >> np.uint32(16)) & np.uint32(0xFFFF)
        out[to[:alive] + step] = symbols[peek]
        at[:alive] += sizes[peek]
    return out
