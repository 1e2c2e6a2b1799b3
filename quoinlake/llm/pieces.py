"""Best segmentation of texts into the pieces of a SentencePiece vocabulary, and back.

The score of a segmentation is the sum of its pieces' scores. Files of BPE models store
ranks; their logarithm stands for the log probability (`log_ranks`), so that frequent
pieces are likely and whole words beat their letters. Scores are integers, so sums do not
depend on how they are grouped, and equal scores are told apart by a sum over the places
of cuts: the best segmentation is unique however the text is divided.

A text of at most `CHUNK` characters is one chunk. A longer one is cut every `CHUNK`
characters, wherever that falls. A piece may lie across a cut, so a chunk's state at either
end is by how many characters the piece at the cut overhangs it, and a chunk is a matrix of
best scores from each entry state to each exit state. Matrices multiply in the (max, +)
semiring, which is associative; the running products give the entry state of each chunk on
the best path, and every chunk then traces its own part back by itself.

No piece of these vocabularies holds a blank after another character, so a blank between
words is always a cut: the new words of many texts are searched together (`wordsearch`) and
kept in the task's bounded memory, and a chunk's matrix is a column times a row unless one
word fills it. The words between a chunk's first and last sure cut do not depend on its
states: their ids are stored with its matrix, and only what lies outside them is traced.
With a vocabulary of another kind every chunk takes its full matrix.

Spaces are kept one by one, nothing is normalised, characters without a piece (and the
space mark itself) become bytes: decoding gives the text back exactly. Defined results:
NULL and empty texts have no ids and decode to an empty text; rows that repeat an id are
encoded by their own texts; an empty table gives no rows; other columns are ignored, or
kept where named.
"""

import hashlib
import json
import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property
from itertools import islice

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quoinlake.llm.carried import carried
from quoinlake.llm.wordsearch import BLOCK, WordSearch
from quoinlake.workspace import stored

CHUNK = 16_384
SHIFT = 96
MEMORY_ENTRIES = 200_000
MEMORY_LENGTH = 40  # longer words are not kept
SLICE = 1_000_000  # characters whose new words are searched together
MARK = " "  # the file writes it as U+2581, which as a character of a text has no piece
_SURE = re.compile(f"[^{MARK}](?={MARK})")
_SEGMENT = re.compile(f"{MARK}*[^{MARK}]+|{MARK}+")


def _cut_weight(at: int) -> int:
    """A number of 44 bits that depends on a cut's place in its word."""
    x = (at + 1) * 0x9E3779B97F4A7C15 % 2**64
    x = (x ^ (x >> 30)) * 0xBF58476D1CE4E5B9 % 2**64
    return (x ^ (x >> 27)) * 0x94D049BB133111EB % 2**64 >> 20


_CUTS = [_cut_weight(i) for i in range(256)]


def cut_weight(at: int) -> int:
    return _CUTS[at] if at < 256 else _cut_weight(at)


@dataclass(frozen=True)
class Matrix:
    """Best scores from entry to exit states: a full table, or a column plus a row."""

    column: list
    row: list
    full: "list | None" = None

    def at(self, i: int, j: int):
        if self.full is not None:
            return self.full[i][j]
        return None if self.column[i] is None or self.row[j] is None else self.column[i] + self.row[j]

    def then(self, other: "Matrix") -> "Matrix":
        """Product in (max, +)."""
        n = range(len(self.column) if self.full is None else len(self.full))
        if self.full is None and other.full is None:
            inner = _most(_plus(self.row[k], other.column[k]) for k in n)
            return Matrix([_plus(c, inner) for c in self.column], other.row)
        return Matrix([], [], [[_most(_plus(self.at(i, k), other.at(k, j)) for k in n) for j in n] for i in n])

    def dump(self) -> str:
        return json.dumps([self.column, self.row, self.full])


def _plus(a, b):
    return None if a is None or b is None else a + b


def _most(values):
    return max((v for v in values if v is not None), default=None)


class PieceEncoder:
    """Pieces, scores and the work on one chunk."""

    def __init__(self, path: str, log_ranks: bool = True):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.bytes = [0] * 256
        self.text = [b""] * model.get_piece_size()
        self.pieces: dict[str, tuple[int, int]] = {}
        scores = []
        for i in range(model.get_piece_size()):
            piece = model.id_to_piece(i)
            if model.is_byte(i):
                self.bytes[int(piece[3:5], 16)] = i
                self.text[i] = bytes([int(piece[3:5], 16)])
            elif not (model.is_control(i) or model.is_unknown(i) or model.is_unused(i)):
                s = model.get_score(i)
                score = -round(1e6 * float(np.log1p(-s))) if log_ranks else round(1e6 * s)
                piece = piece.replace("\u2581", MARK)
                self.pieces[piece] = (i, score << SHIFT)
                self.text[i] = piece.encode()
                scores.append(score)
        self.unknown = (min(scores) - 10_000_000) << SHIFT
        self.longest = max(map(len, self.pieces))
        self.cut_at_blanks = not any(MARK in p.lstrip(MARK) for p in self.pieces)
        self.memory: dict[str, bytes] = {}
        self.scores: dict[str, int] = {}

    # Made when first used, as a worker that only decodes has no need of them.
    @cached_property
    def starts(self) -> dict[str, tuple[int, int]]:
        """Pieces and all that a piece begins with, so that a search ends where no piece goes on."""
        return {p[:n]: (-1, 0) for p in self.pieces for n in range(1, len(p))} | self.pieces

    @cached_property
    def search(self) -> WordSearch:
        plain = {p: (i, s >> SHIFT) for p, (i, s) in self.pieces.items()}
        return WordSearch(plain, self.unknown >> SHIFT, _CUTS[:MEMORY_LENGTH])

    def inner(self, text: str) -> str:
        """The text with a blank before it."""
        return MARK + text

    def ahead(self, s: str, begin: int, stop: int, end: int, offset: int):
        """Best scores and last edges from `begin` to every place up to `end`; pieces start before `stop`.

        `offset` is the place of s[0] in its word.
        """
        best: list = [None] * (end + 1)
        back: list = [None] * (end + 1)
        best[begin] = 0
        known, longest = self.starts.get, self.longest
        cuts = _CUTS if offset == 0 and end < len(_CUTS) else [cut_weight(offset + j) for j in range(end + 1)]
        for i in range(begin, stop):
            here = best[i]
            if here is None:
                continue
            for j in range(i + 1, min(i + longest, end) + 1):
                hit = known(s[i:j])
                if hit is None or hit[0] < 0:
                    if j == i + 1:  # a character without a piece
                        total = here + self.unknown - cuts[j]
                        if best[j] is None or total > best[j]:
                            best[j], back[j] = total, (i, -1)
                    if hit is None:
                        break
                    continue
                total = here + hit[1] - cuts[j]
                if best[j] is None or total > best[j]:
                    best[j], back[j] = total, (i, hit[0])
        return best, back

    def trace(self, s: str, back: list, begin: int, end: int) -> list[int]:
        out: list[int] = []
        while end > begin:
            i, piece = back[end]
            out += [piece] if piece >= 0 else [self.bytes[b] for b in reversed(s[i].encode())]
            end = i
        return out[::-1]

    def word(self, w: str) -> bytes:
        """Ids of a word that lies between two sure cuts."""
        found = self.memory.get(w)
        if found is None:
            best, back = self.ahead(w, 0, len(w), len(w), 0)
            found = np.array(self.trace(w, back, 0, len(w)), "<u2").tobytes()
            if len(w) < MEMORY_LENGTH:
                self.memory[w], self.scores[w] = found, best[-1]
        return found

    def learn(self, texts: list[list[str]], scored: bool = False) -> None:
        """Put the new words of many texts into the memory, with their scores where asked for."""
        self.forget()
        new = [w for w in set().union(*texts).difference(self.scores if scored else self.memory) if len(w) < MEMORY_LENGTH]
        for a in range(0, len(new), BLOCK):
            words = new[a : a + BLOCK]
            ids, scores, cuts = self.search.search(words, self.bytes)
            self.memory.update(zip(words, ids))
            if scored:
                self.scores.update({w: (s << SHIFT) - c for w, s, c in zip(words, scores.tolist(), cuts.tolist())})

    def forget(self) -> None:
        """Keep the memory of words bounded."""
        if len(self.memory) > MEMORY_ENTRIES:
            self.give_back()

    def give_back(self) -> None:
        self.memory.clear()
        self.scores.clear()

    def word_score(self, w: str) -> int:
        score = self.scores.get(w)
        if score is None:
            score = self.ahead(w, 0, len(w), len(w), 0)[0][-1]
            if len(w) < MEMORY_LENGTH:
                self.scores[w] = score
        return score

    def words(self, s: str) -> list[str]:
        if not self.cut_at_blanks:
            return [s] if s else []
        if MARK + MARK in s or not s.startswith(MARK):
            return _SEGMENT.findall(s)
        return [MARK + w for w in s[1:].split(MARK)] if len(s) > 1 else [s]

    def encode(self, s: str) -> bytes:
        """Ids of one chunk that is a whole text, or a part between two sure cuts."""
        self.forget()
        return self.joined(self.words(s))

    def joined(self, words: list[str]) -> bytes:
        try:
            return b"".join(map(self.memory.__getitem__, words))
        except KeyError:
            known = self.memory.get
            return b"".join([known(w) or self.word(w) for w in words])

    def encode_all(self, texts: list[str]) -> Iterator[np.ndarray]:
        """Ids of each of many whole texts."""
        return (np.frombuffer(x, "<u2").astype(np.int32) for x in self.raw_all(texts))

    def raw_all(self, texts: list[str]) -> Iterator[bytes]:
        """The same as 16-bit numbers."""
        for some in slices(texts, SLICE):
            words = [self.words(self.inner(t)) if t else [] for t in some]
            self.learn(words)
            for w in words:
                yield self.joined(w)

    def sure_cuts(self, s: str, before: str, size: int) -> tuple[int, int]:
        """First and last place in 0..size where a word begins, or (-1, -1)."""
        if not self.cut_at_blanks:
            return -1, -1
        shown = before + s[: size + 1]
        first = _SURE.search(shown)
        if first is None:
            return -1, -1
        last = len(shown[: shown.rindex(MARK)].rstrip(MARK))
        return first.end() - len(before), last - len(before)

    def matrix(self, s: str, size: int, offset: int, first: int, last: int, words: list[str]) -> Matrix:
        """Chunk s[:size] with up to longest - 1 characters after it, its sure cuts and the words between them."""
        n = self.longest
        if first < 0:
            full = []
            for i in range(n):
                if i >= size:
                    full.append([0 if j == i - size else None for j in range(n)])
                    continue
                best = self.ahead(s, i, size, len(s), offset)[0]
                full.append([best[size + j] if size + j < len(best) else None for j in range(n)])
            return Matrix([], [], full)
        # Entries reach the first sure cut; their scores come from one pass for each short way there.
        column: list = [None] * n
        for i in range(min(n - 1, first) + 1):
            column[i] = self.ahead(s, i, first, first, offset)[0][first]
        middle = sum(map(self.word_score, words))
        best = self.ahead(s[last:], 0, size - last, len(s) - last, 0)[0]
        at = size - last
        return Matrix(column, [None if at + j >= len(best) or best[at + j] is None else middle + best[at + j] for j in range(n)])

    def ends(self, head: str, tail: "str | None", size: int, offset: int, entry: int, leave: int) -> tuple[bytes, bytes]:
        """Ids of the pieces that start in the chunk, from its entry state to its exit state, before and after its middle.

        `size` is that of the chunk without what it holds before `tail`. No piece crosses a
        sure cut, so the entry state lies before the first.
        """
        if tail is None:
            return self.traced(head, entry, size, size + leave, offset) if entry < size else b"", b""
        return self.traced(head, entry, len(head), len(head), offset), self.traced(tail, 0, size, size + leave, 0)

    def part(self, head: str, middle: bytes, tail: "str | None", size: int, offset: int, entry: int, leave: int) -> bytes:
        """All ids of the pieces that start in the chunk."""
        before, after = self.ends(head, tail, size, offset, entry, leave)
        return before + middle + after

    def traced(self, s: str, begin: int, stop: int, end: int, offset: int) -> bytes:
        return np.array(self.trace(s, self.ahead(s, begin, stop, end, offset)[1], begin, end), "<u2").tobytes()

    def scored_all(self, chunks: list[tuple]) -> Iterator[tuple]:
        """What is stored of each chunk: head, middle, tail, size of the tail (or of all), offset, matrix.

        Head is the text up to the first sure cut, middle the ids between the sure cuts, tail
        the text from the last one; a chunk without a sure cut is all head.
        """
        cuts = [self.sure_cuts(s, before, size) for s, before, size, _ in chunks]
        words = [self.words(c[0][first:last]) if last > first else [] for c, (first, last) in zip(chunks, cuts)]
        self.learn(words, scored=True)
        for (s, _, size, offset), (first, last), between in zip(chunks, cuts, words):
            matrix = self.matrix(s, size, offset, first, last, between).dump()
            if first < 0:
                yield s, b"", None, size, offset, matrix
            else:
                yield s[:first], self.joined(between), s[last:], size - last, offset, matrix

    def chunks(self, s: str, size: int) -> Iterator[tuple[int, str, str, int, int]]:
        """(number, text with what follows, character before, size, place of its start in its word)."""
        for k, at in enumerate(range(0, len(s), size)):
            begin = at
            if self.cut_at_blanks:
                while begin > 0 and not (s[begin] == MARK and s[begin - 1] != MARK):
                    begin -= 1
            else:
                begin = 0
            yield k, s[at : at + size + self.longest - 1], s[at - 1 : at] if at else "", min(size, len(s) - at), at - begin

    def decode(self, ids) -> str:
        numbers = ids.tolist() if isinstance(ids, np.ndarray) else ids
        return b"".join(map(self.text.__getitem__, numbers))[1:].decode(errors="replace")


def boundary_states(matrices: list[Matrix]) -> list[int]:
    """Entry state of each chunk on the best path, and the state at the end (0)."""
    n = range(len(matrices[0].column) or len(matrices[0].full))
    so_far = [Matrix([0 if i == 0 else None for i in n], [0 if j == 0 else None for j in n])]
    for m in matrices[:-1]:
        so_far.append(so_far[-1].then(m))
    states = [0]
    for m, before in zip(reversed(matrices), reversed(so_far)):
        scores = [_plus(before.at(0, i), m.at(i, states[-1])) for i in n]
        states.append(max((i for i in n if scores[i] is not None), key=lambda i: scores[i]))
    return states[::-1]


def slices(texts: list[str], most: int) -> Iterator[list[str]]:
    """The texts in lists of about `most` characters, or of one text."""
    at = size = 0
    for i, t in enumerate(texts):
        size += len(t)
        if size > most or i == len(texts) - 1:
            yield texts[at : i + 1]
            at, size = i + 1, 0


def few(batches: Iterator[pd.DataFrame], rows: int = 500) -> Iterator[pd.DataFrame]:
    """The same rows in small frames, so that the ids of only a few are held at a time."""
    for pdf in batches:
        for at in range(0, len(pdf), rows):
            yield pdf.iloc[at : at + rows]


def few_arrow(batches: Iterator[pa.RecordBatch], rows: int = 500) -> Iterator[pa.RecordBatch]:
    """The same for batches of Arrow."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def id_lists(raw: list[bytes]) -> pa.ListArray:
    """16-bit numbers of each text as a list."""
    ends = np.cumsum([0, *(len(x) // 2 for x in raw)])
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.frombuffer(b"".join(raw), "<u2").astype(np.int32)))


_ENCODERS: dict[tuple, PieceEncoder] = {}


def encoder(path: str, log_ranks: bool = True) -> PieceEncoder:
    """One encoder for each worker process."""
    if (path, log_ranks) not in _ENCODERS:
        _ENCODERS[path, log_ranks] = PieceEncoder(path, log_ranks)
    return _ENCODERS[path, log_ranks]


def encode(docs: DataFrame, key: str, text: str, path: str, chunk: int = CHUNK, log_ranks: bool = True) -> DataFrame:
    """(doc_id, ids) of every row of `docs`."""
    rows = docs.select(F.col(key).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    chunk_fields = "name string, k int, head string, middle binary, tail string, size int, offset long, matrix string"

    def short(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = encoder(path, log_ranks)
        for batch in few_arrow(batches):
            ids = id_lists(list(e.raw_all(batch["text"].to_pylist())))
            yield pa.RecordBatch.from_arrays([batch["doc_id"], ids], ["doc_id", "ids"])
        e.give_back()

    def transfer(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        e = encoder(path, log_ranks)
        columns = [x.split()[0] for x in chunk_fields.split(", ")]
        for pdf in few(batches, 50):
            chunks = ((name, c) for name, t in zip(pdf["name"], pdf["text"]) for c in e.chunks(e.inner(t), chunk))
            while some := list(islice(chunks, max(1, SLICE // chunk))):
                out = e.scored_all([c[1:] for _, c in some])
                yield pd.DataFrame([(name, c[0], *x) for (name, c), x in zip(some, out)], columns=columns)
        e.give_back()

    def join(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.drop_duplicates("k").sort_values("k")
        states = boundary_states([Matrix(*json.loads(x)) for x in pdf["matrix"]])
        return pd.DataFrame({"name": pdf["name"], "k": pdf["k"], "entry": states[:-1], "leave": states[1:]})

    def trace(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        e = encoder(path, log_ranks)
        for pdf in few(batches):
            columns = [pdf[c] for c in ("head", "tail", "size", "offset", "entry", "leave")]
            ids = [x for row in zip(*columns) for x in e.ends(*row)]
            yield pd.DataFrame({"name": np.repeat(pdf["name"].to_numpy(), 2), "at": (3 * pdf["k"].to_numpy()[:, None] + [0, 2]).ravel(), "ids": ids})

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in few_arrow(batches, 50):
            yield pa.RecordBatch.from_arrays([batch["doc_id"], id_lists([b"".join(p) for p in batch["p"].to_pylist()])], ["doc_id", "ids"])

    is_long = F.char_length("text") > chunk
    fields = f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, ids array<int>"
    out = rows.where(~is_long).mapInArrow(short, fields)
    named = rows.where(is_long).withColumn("name", F.sha2("text", 256))
    texts = named.groupBy("name").agg(F.first("text").alias("text"))
    chunks = stored(texts.mapInPandas(transfer, chunk_fields), "chunks")
    matrices = chunks.select("name", "k", "matrix")
    # What lies between sure cuts is most of a text; it moves once, to its text, and never to the states.
    states = stored(matrices.groupBy("name").applyInPandas(join, "name string, k int, entry int, leave int"), "states")
    parts = chunks.drop("matrix", "middle").join(states, ["name", "k"]).mapInPandas(trace, "name string, at long, ids binary")
    middle = chunks.select("name", (F.col("k") * 3 + 1).cast("long").alias("at"), F.col("middle").alias("ids"))
    whole = parts.unionByName(middle).where(F.length("ids") > 0).groupBy("name").agg(
        F.sort_array(F.collect_list(F.struct("at", "ids"))).alias("p"))
    found = named.select("doc_id", "name").join(whole, "name").select("doc_id", F.col("p.ids").alias("p"))
    return out.unionByName(found.mapInArrow(joined, fields))


def decode(encoded: DataFrame, path: str, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """(*keep, text) from ids."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        e = encoder(path)
        for pdf in few(batches):
            yield pdf.drop(columns="ids").assign(text=[e.decode(x) if x is not None else "" for x in pdf["ids"]])

    chosen, fields, back = carried(encoded.select(*keep, "ids"), list(keep))
    return back(chosen.mapInPandas(run, f"{fields}, text string"))


def vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def pieces_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of every document and the digest of the text decoded from them."""
    path = vocabulary()
    encoded = encode(spark.read.parquet(f"{sf_dir}/documents.parquet"), "doc_id", "text", path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = encoder(path)
        for batch in few_arrow(batches):
            n = batch["ids"].value_lengths()
            flat, ends = batch["ids"].flatten().to_numpy().tolist(), np.cumsum(n.to_numpy()).tolist()
            texts = (e.decode(flat[a:b]) for a, b in zip([0, *ends], ends))
            digests = [hashlib.sha256(t.encode()).hexdigest() for t in texts]
            yield pa.RecordBatch.from_arrays([*batch.columns, n.cast(pa.int64()), pa.array(digests, pa.string())], [*batch.schema.names, "n_tokens", "decoded_sha256"])

    key = encoded.schema["doc_id"].dataType.simpleString()
    return encoded.mapInArrow(run, f"doc_id {key}, ids array<int>, n_tokens long, decoded_sha256 string")


def pieces_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline: the ids of each document."""
    encoded = encode(docs, "doc_id", "text", vocabulary())
    return encoded.select("doc_id", "ids", F.size("ids").cast("bigint").alias("n_tokens"))
