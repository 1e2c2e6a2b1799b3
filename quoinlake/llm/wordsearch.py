"""Best segmentations of many words at once, in numpy.

All places of all words walk the pieces' trie together, one character further a step, which
lists every piece that fits anywhere. The best sums then move from place to place of all
words together. Scores are compared first, then the sums over the places of cuts.
"""

import numpy as np

_CHARACTER_BITS = np.uint64(21)
_SPREAD = np.uint64(0x9E3779B97F4A7C15)
_EMPTY = np.uint64(2**64 - 1)
BLOCK = 10_240  # words that are searched together


class WordSearch:
    """Pieces as a trie whose edges lie in one open hash table."""

    def __init__(self, pieces: dict[str, tuple[int, int]], unknown: int, cuts: list[int]):
        """`pieces` gives id and score of each piece, `cuts` the weight of a cut at each place."""
        number = {p: i for i, p in enumerate({"": 0} | {p[:n]: 0 for p in pieces for n in range(1, len(p) + 1)})}
        self.piece = np.full(len(number), -1, np.int32)
        self.score = np.full(len(number), unknown, np.int64)
        for p, (i, score) in pieces.items():
            self.piece[number[p]], self.score[number[p]] = i, score
        self.unknown, self.longest = unknown, max(map(len, pieces))
        self.cuts = np.array(cuts, np.int64)
        nodes = list(number)[1:]
        keys = np.array([number[p[:-1]] << 21 | ord(p[-1]) for p in nodes], np.uint64)
        bits = max(4, (4 * len(keys)).bit_length())
        self.shift, self.mask = np.uint64(64 - bits), 2**bits - 1
        self.keys, self.nodes = np.full(2**bits, _EMPTY, np.uint64), np.zeros(2**bits, np.int32)
        left, at = np.arange(len(keys)), self._slots(keys)
        while len(left):
            free = self.keys[at] == _EMPTY
            slots, taken = np.unique(at[free], return_index=True)
            won = np.flatnonzero(free)[taken]
            self.keys[slots], self.nodes[slots] = keys[left[won]], left[won] + 1
            rest = np.ones(len(left), bool)
            rest[won] = False
            left, at = left[rest], (at[rest] + 1) & self.mask

    def _slots(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * _SPREAD) >> self.shift).astype(np.int64)

    def _follow(self, node: np.ndarray, character: np.ndarray) -> np.ndarray:
        """The nodes that follow, or -1."""
        keys = (node.astype(np.uint64) << _CHARACTER_BITS) | character
        at = self._slots(keys)
        seen = self.keys[at]
        out = np.where(seen == keys, self.nodes[at], -1)
        open_ = np.flatnonzero((seen != keys) & (seen != _EMPTY))
        while len(open_):
            at[open_] = (at[open_] + 1) & self.mask
            seen, wanted = self.keys[at[open_]], keys[open_]
            found = open_[seen == wanted]
            out[found] = self.nodes[at[found]]
            open_ = open_[(seen != wanted) & (seen != _EMPTY)]
        return out

    def _edges(self, characters: np.ndarray, left: np.ndarray):
        """(place, length, score, piece) of all pieces, and of single characters without a piece as piece -1."""
        at, node, found = np.arange(len(characters), dtype=np.int32), np.zeros(len(characters), np.int32), []
        for n in range(1, self.longest + 1):
            going = (node >= 0) & (left[at] >= n)
            at, node = at[going], node[going]
            if not len(at):
                break
            node = self._follow(node, characters[at + n - 1])
            piece = np.where(node >= 0, self.piece[node], -1)
            score = np.where(piece >= 0, self.score[node], self.unknown)
            kept = slice(None) if n == 1 else piece >= 0
            found.append((at[kept], np.full(len(at[kept]), n, np.int16), score[kept], piece[kept]))
        return [np.concatenate(x) for x in zip(*found)]

    def search(self, words: list[str], spelled: list[int]) -> tuple[list[bytes], np.ndarray, np.ndarray]:
        """Ids in 16 bits, scores and sums of cuts; no word is empty. `spelled` holds the ids of bytes."""
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        characters = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
        ends = np.cumsum(sizes)
        word = np.repeat(np.arange(len(words), dtype=np.int32), sizes)
        place = (np.arange(len(characters)) - (ends - sizes)[word]).astype(np.int32)
        at, length, score, piece = self._edges(characters, sizes[word] - place)
        rank = place[at] * (self.longest + 1) + length
        order = np.argsort(rank.astype(np.uint16) if rank.max() < 1 << 16 else rank, kind="stable")  # short keys sort in one pass
        state = (at + word[at])[order]  # a word has a state more than characters
        rank, length, score, piece = rank[order], length[order], score[order], piece[order]

        first, last = ends - sizes + np.arange(len(words)), ends + np.arange(len(words))
        best = np.full(len(characters) + len(words), np.iinfo(np.int64).min)
        cut, back, by = np.zeros(len(best), np.int64), np.zeros(len(best), np.int64), np.zeros(len(best), np.int32)
        best[first] = 0
        steps = np.concatenate([[0], np.flatnonzero(np.diff(rank)) + 1, [len(rank)]])
        for a, b in zip(steps[:-1], steps[1:]):
            here = state[a:b]
            there = here + length[a]
            total = best[here] + score[a:b]
            cuts = cut[here] + self.cuts[rank[a] // (self.longest + 1) + length[a]]
            better = (total > best[there]) | ((total == best[there]) & (cuts < cut[there]))
            there = there[better]
            best[there], cut[there], back[there], by[there] = total[better], cuts[better], here[better], piece[a:b][better]

        going, now, parts = np.arange(len(words)), last, []
        while len(going):
            parts.append((going, by[now], back[now] - first[going]))
            now = back[now]
            more = now > first[going]
            going, now = going[more], now[more]
        of, ids, begin = (np.concatenate(x) for x in zip(*parts[::-1]))
        order = np.argsort(of, kind="stable")
        of, ids, begin = of[order], ids[order], begin[order]
        raw = ids.astype("<u2").tobytes()
        stops = np.concatenate([[0], np.cumsum(np.bincount(of, minlength=len(words)))])
        out = [raw[a:b] for a, b in zip((2 * stops[:-1]).tolist(), (2 * stops[1:]).tolist())]
        for w in np.unique(of[ids < 0]).tolist():  # characters without a piece become bytes
            a, b, full = stops[w], stops[w + 1], []
            for i, at in zip(ids[a:b].tolist(), begin[a:b].tolist()):
                full += [i] if i >= 0 else [spelled[x] for x in words[w][at].encode()]
            out[w] = np.array(full, "<u2").tobytes()
        return out, best[last], cut[last]
