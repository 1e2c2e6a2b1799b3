"""Byte-pair merges of many pieces at once, in numpy.

Pieces are divided into words by tables of character classes. The words lie in matrices by
their number of symbols: a step does the first of the lowest merges of every word of n
symbols, which joins those of n - 1, and a word without a merge is done. That is the order
of the merges of a single word, so the ids are the same.
"""

import unicodedata

import numpy as np

_EMPTY = np.uint64(2**64 - 1)
_SPREAD = np.uint64(0x9E3779B97F4A7C15)
LAST = 0x24F  # last character with a class

_LETTER, _NUMBER, _MARK, _SPACE = 1, 2, 3, 4
_KINDS = {"L": _LETTER, "N": _NUMBER, "Z": _SPACE}
_CLASS = np.array([_KINDS.get(unicodedata.category(chr(c))[0], _MARK) for c in range(LAST + 1)], np.int8)
_CLASS[[9, 10, 13]] = _SPACE


def word_starts(characters: np.ndarray, begins: np.ndarray) -> np.ndarray:
    """Where words of the byte-level splitting pattern start; `begins` are the pieces' first blanks, the only ones."""
    kind = _CLASS[characters]
    starts = np.ones(len(kind), bool)
    np.not_equal(kind[1:], kind[:-1], out=starts[1:])
    space = kind == _SPACE
    starts[1:-1] |= space[1:-1] & space[:-2] & ~space[2:]  # the last of several white spaces before a word
    starts[begins] = True
    blank = np.zeros(len(kind) + 3, bool)
    blank[begins] = True
    starts[begins + 1] = False

    # 's 't 'm 'd 're 've 'll where a word may start
    quote = np.flatnonzero(characters == 39)
    quote = quote[(kind[quote - 1] != _MARK) & ~blank[quote - 1]]
    after = np.concatenate([characters, [32, 32, 32]])
    one, two = after[quote + 1], after[quote + 2]
    short = np.isin(one, [ord(c) for c in "stmd"])
    long = np.zeros(len(quote), bool)
    for a, b in ("re", "ve", "ll"):
        long |= (one == ord(a)) & (two == ord(b))
    taken = np.concatenate([starts, [True, True, True]])
    taken[quote[short | long] + 1] = False
    taken[quote[short] + 2] = True
    taken[quote[long] + 2] = False
    taken[quote[long] + 3] = True
    return taken[: len(starts)]


class WordMerge:
    """Merges as an open hash table from two ids to a rank."""

    def __init__(self, merges: list[tuple[int, int, int]], letters: list[int]):
        """`merges` gives the two ids and the id that they make, lowest first; `letters` the id of each byte."""
        pairs = np.array(merges, np.uint64).reshape(-1, 3)
        keys = pairs[:, 0] << np.uint64(16) | pairs[:, 1]
        kind = np.uint16 if max(len(pairs), int(pairs.max(initial=0)), max(letters)) < 2**16 - 1 else np.int32  # narrow matrices are quicker
        self.none, self.made = kind(np.iinfo(kind).max), np.append(pairs[:, 2], 0).astype(kind)
        bits = max(4, (4 * len(keys)).bit_length())
        self.shift, self.mask = np.uint64(64 - bits), 2**bits - 1
        self.keys, self.ranks = np.full(2**bits, _EMPTY, np.uint64), np.full(2**bits, self.none, kind)
        left, at = np.arange(len(keys)), self._slots(keys)
        while len(left):
            free = self.keys[at] == _EMPTY
            slots, taken = np.unique(at[free], return_index=True)
            won = np.flatnonzero(free)[taken]
            self.keys[slots], self.ranks[slots] = keys[left[won]], left[won]
            rest = np.ones(len(left), bool)
            rest[won] = False
            left, at = left[rest], (at[rest] + 1) & self.mask
        self.letters = np.array(letters, kind)
        self.first = self.rank(np.repeat(self.letters, 256), np.tile(self.letters, 256))  # of two bytes

    def _slots(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * _SPREAD) >> self.shift).astype(np.int64)

    def rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Ranks of the merges of ids a and b, or `none`."""
        keys = a.astype(np.uint64) << np.uint64(16) | b.astype(np.uint64)
        at = self._slots(keys)
        seen = self.keys[at]
        out = np.where(seen == keys, self.ranks[at], self.none)
        open_ = np.flatnonzero((seen != keys) & (seen != _EMPTY))
        while len(open_):
            at[open_] = (at[open_] + 1) & self.mask
            seen, wanted = self.keys[at[open_]], keys[open_]
            found = open_[seen == wanted]
            out[found] = self.ranks[at[found]]
            open_ = open_[(seen != wanted) & (seen != _EMPTY)]
        return out

    def words(self, raw: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the words that start at `starts`, one after another, and how many each has."""
        sizes = np.diff(starts, append=len(raw))
        counts, done = np.zeros(len(starts), np.int64), []
        order = np.argsort(sizes, kind="stable")
        upto = np.searchsorted(sizes[order], np.arange(sizes.max() + 2))
        word, ids, ranks = np.zeros(0, np.int64), None, None
        for n in range(sizes.max(), 0, -1):
            new = order[upto[n] : upto[n + 1]]
            if len(new):
                bytes_ = raw[starts[new][:, None] + np.arange(n)]
                new_ids = self.letters[bytes_]
                new_ranks = self.first[bytes_[:, :-1].astype(np.int32) << 8 | bytes_[:, 1:]]
                word = np.concatenate([word, new])
                ids = new_ids if ids is None else np.concatenate([ids, new_ids])
                ranks = new_ranks if ranks is None else np.concatenate([ranks, new_ranks])
            if not len(word):
                ids = ranks = None
                continue
            if n == 1:
                counts[word] = 1
                done.append((word, ids))
                break
            at = ranks.argmin(1)
            rows = np.arange(len(word))
            lowest = ranks[rows, at]
            going = lowest != self.none
            if not going.all():
                ended = ~going
                counts[word[ended]] = n
                done.append((word[ended], ids[ended]))
                word, ids, ranks, at, lowest = word[going], ids[going], ranks[going], at[going], lowest[going]
                rows = rows[: len(word)]
            # The two symbols become one: all after it move by one place.
            ids[rows, at] = self.made[lowest]
            moved = np.arange(n - 1) > at[:, None]
            ids = np.where(moved, ids[:, 1:], ids[:, :-1])
            ranks = np.where(moved[:, 1:], ranks[:, 1:], ranks[:, :-1])
            if n > 2:  # the pairs on both sides of the new symbol
                some = np.flatnonzero(at < n - 2)
                ranks[some, at[some]] = self.rank(ids[some, at[some]], ids[some, at[some] + 1])
                some = np.flatnonzero(at > 0)
                ranks[some, at[some] - 1] = self.rank(ids[some, at[some] - 1], ids[some, at[some]])
        begin = np.cumsum(counts) - counts
        out = np.zeros(int(counts.sum()), "<u2")
        for of, found in done:
            out[begin[of][:, None] + np.arange(found.shape[1])] = found
        return out, counts

    def pieces(self, pieces: list[str]) -> list[bytes]:
        """Ids of each piece after a blank, as 16-bit numbers. Pieces hold no blank and no character beyond LAST."""
        text = " " + " ".join(pieces)
        characters = np.frombuffer(text.encode("utf-32-le"), np.uint32)
        begins = np.flatnonzero(characters == 32)
        raw = np.frombuffer(text.encode(), np.uint8)
        at = np.flatnonzero((raw & 0xC0) != 0x80)  # the first byte of each character
        starts = np.flatnonzero(word_starts(characters, begins))
        ids, counts = self.words(raw, at[starts])
        stops = 2 * np.add.reduceat(counts, np.searchsorted(starts, begins)).cumsum()
        found = ids.tobytes()
        return [found[a:b] for a, b in zip([0, *stops[:-1].tolist()], stops.tolist())]
