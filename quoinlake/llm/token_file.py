"""Token ids of a corpus as one ordered, compressed binary table.

Format: a folder of Parquet files whose rows are documents in ascending id, row by row and
file by file: `doc_id`, `start` (ids before it in the corpus), `n_tokens`, `checkpoints`
(bit offset of every 1024th id) and `payload` (canonical Huffman codes). The code lengths
come from the counts of all ids and lie beside the files in `lengths`; they are all a
reader needs. Any document, and any run within it, decodes by itself.

Words are encoded once for each worker as long as its bounded memory holds them; the new
ones of many texts are merged together (`wordmerge`). Texts are cut only at single blanks
between two other characters, where the vocabulary's own splitting always cuts; anything
unusual goes through the tokenizer as it is.

Defined results: NULL and empty texts hold the end id only; rows without an id come first;
rows that repeat an id follow each other in order of their ids' bytes; an empty table gives
an empty folder that reads back as no rows; other columns are ignored.
"""

import json
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quoinlake.llm.carried import carried
from quoinlake.llm.huffman import RUN, canonical_codes, code_lengths, decode_table, pack_all, unpack
from quoinlake.llm.pieces import slices
from quoinlake.llm.wordmerge import WordMerge
from quoinlake.workspace import new_folder

END_ID = 2
MEMORY_ENTRIES = 200_000
SLICE = 2_000_000  # characters whose new pieces are encoded together
BLOCK = 32_768  # pieces that are merged together
PACKED = 200_000  # ids that are packed together
BUCKET_TOKENS = 20_000_000
CODED = "doc_id long, bucket int, n_tokens long, checkpoints array<int>, payload binary"

_GAP = re.compile(r"(?<=\S) (?=\S)")
_WIDE_GAP = re.compile(r"^ | $| \s|\s ")
_RARE_SPACE = re.compile(r"[^\S \n]")
_UNUSUAL = re.compile("[^\t\n\r\x20-\x7e\xa0-ɏ]")
_PLAIN = re.compile("\0([!-~¡-ɏ][\t\n\r!-~¡-ɏ]{0,38})(?=\0)").findall  # of pieces with NUL around each


class WordEncoder:
    """Ids of texts as little-endian 16-bit numbers, equal to the tokenizer's own."""

    def __init__(self, path: str):
        import regex
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        spec = json.loads(open(path, encoding="utf-8").read())
        split = spec.get("pre_tokenizer") or {}
        self.by_words = (
            split.get("type") == "ByteLevel" and not split.get("add_prefix_space") and split.get("use_regex", True)
            and not spec.get("normalizer") and spec["model"]["type"] == "BPE"
        )
        self.special = [t["content"] for t in spec.get("added_tokens", [])]
        if self.tokenizer.get_vocab_size() > 1 << 16:
            raise ValueError("ids of more than 16 bits")
        # The splitting pattern and the byte alphabet of byte-level vocabularies.
        self.words = regex.compile(
            r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
        ).findall
        seen = [*range(33, 127), *range(161, 173), *range(174, 256)]
        rest = [b for b in range(256) if b not in seen]
        self.letters = {**{b: chr(b) for b in seen}, **{b: chr(256 + i) for i, b in enumerate(rest)}}
        self.tails: dict[str, bytes] = {}  # pieces after a blank, without it
        self.spelled: dict[str, bytes] = {}  # words with their blank
        self.merge = self._merges(spec["model"]) if self.by_words else None

    def _merges(self, model: dict) -> "WordMerge | None":
        """The vocabulary's merges, where its words are made by them alone."""
        if any(model.get(x) for x in ("dropout", "continuing_subword_prefix", "end_of_word_suffix", "ignore_merges")):
            return None
        number = model["vocab"]
        if any(x not in number for x in self.letters.values()):
            return None
        pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        return WordMerge([(number[a], number[b], number[a + b]) for a, b in pairs], [number[self.letters[b]] for b in range(256)])

    def _whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u2").tobytes()

    def _word(self, word: str) -> bytes:
        found = self.spelled.get(word)
        if found is None:
            spelled = word.encode().decode("latin-1").translate(self.letters)
            found = np.array([t.id for t in self.tokenizer.model.tokenize(spelled)], "<u2").tobytes()
            if len(word) < 40:
                self.spelled[word] = found
        return found

    def _piece(self, piece: str) -> bytes:
        """Ids of a piece; its first character may be the blank before it."""
        if not piece.isascii() or not piece.isprintable():
            if _UNUSUAL.search(piece):
                return self._whole(piece)
        letters = piece[1:-1] if piece[-1:] in ",." else piece[1:]
        if piece[:1] == " " and letters.isalpha():  # a word, perhaps with one mark after it
            n = len(letters) + 1
            return self._word(piece[:n]) + self._word(piece[n:]) if n < len(piece) else self._word(piece)
        return b"".join([self._word(w) for w in self.words(piece)])

    def _pieces(self, text: str) -> list[str]:
        """The text cut where the vocabulary's own splitting always cuts; nothing for one that goes through it whole."""
        if not self.by_words or any(s in text for s in self.special):
            return []
        if _RARE_SPACE.search(text):
            wide = _WIDE_GAP.search(text)
        else:
            wide = "  " in text or " \n" in text or "\n " in text or text[:1] == " " or text[-1:] == " "
        return _GAP.split(text) if wide else text.split(" ")

    def _learn(self, texts: list[list[str]]) -> None:
        """Put the new pieces of many texts into the memory."""
        if len(self.tails) > MEMORY_ENTRIES:
            self.tails.clear()
        if len(self.spelled) > MEMORY_ENTRIES:
            self.spelled.clear()
        if self.merge is not None:
            unknown = set().union(*[x[1:] for x in texts]).difference(self.tails)
            new = _PLAIN("\0".join(["", *unknown, ""]))
            for a in range(0, len(new), BLOCK):
                some = new[a : a + BLOCK]
                self.tails.update(zip(some, self.merge.pieces(some)))

    def encode_all(self, texts: list[str]) -> Iterator[bytes]:
        """Ids of each of many texts."""
        for some in slices(texts, SLICE):
            pieces = [self._pieces(t) for t in some]
            self._learn(pieces)
            yield from map(self._joined, some, pieces)

    def __call__(self, text: str) -> bytes:
        return next(self.encode_all([text]))

    def _joined(self, text: str, pieces: list[str]) -> bytes:
        if not pieces:
            return self._whole(text)
        first = self._piece(pieces[0]) if pieces[0] else b""
        try:
            return first + b"".join(map(self.tails.__getitem__, pieces[1:]))
        except KeyError:
            return first + b"".join(map(self._tail, pieces[1:]))

    def _tail(self, piece: str) -> bytes:
        found = self.tails.get(piece)
        if found is None:
            found = self._piece(" " + piece)
            if len(piece) < 40:
                self.tails[piece] = found
        return found


_ENCODERS: dict[str, WordEncoder] = {}


def encoder(path: str) -> WordEncoder:
    """One encoder for each worker process."""
    if path not in _ENCODERS:
        _ENCODERS[path] = WordEncoder(path)
    return _ENCODERS[path]


def encode(docs: DataFrame, key: str, text: str, path: str, end_id: int = END_ID) -> DataFrame:
    """kind 0: (doc_id, n, ids as 16-bit numbers) of each document; kind 1: (n times the id in doc_id)."""
    end = np.array([end_id], "<u2").tobytes()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        to_ids, counts = encoder(path), np.zeros(1 << 16, np.int64)
        for pdf in batches:
            ids = [x + end for x in to_ids.encode_all(pdf["text"].where(pdf["text"].notna(), "").tolist())]
            counts += np.bincount(np.frombuffer(b"".join(ids), "<u2"), minlength=1 << 16)
            yield pd.DataFrame({"kind": 0, "doc_id": pdf["doc_id"], "n": [len(x) // 2 for x in ids], "ids": ids})
        met = np.flatnonzero(counts)
        yield pd.DataFrame({"kind": 1, "doc_id": met.astype(str), "n": counts[met], "ids": None})

    rows = docs.select(F.col(key).cast("bigint").alias("doc_id"), F.col(text).cast("string").alias("text"))
    rows, fields, back = carried(rows, ["doc_id"])
    return back(rows.mapInPandas(run, f"kind int, {fields}, n long, ids binary"))


def write_token_file(docs: DataFrame, key: str, text: str, folder: str, path: str) -> None:
    """Encode `docs` and write the ordered token file below `folder`."""
    spark = docs.sparkSession
    raw = new_folder(spark, "ids")
    encode(docs, key, text, path).write.option("compression", "zstd").parquet(raw)
    found = spark.read.parquet(raw)
    counts = np.zeros(1 << 16, np.int64)
    for row in found.where("kind = 1").groupBy("doc_id").agg(F.sum("n").alias("n")).collect():  # at most 2^16 rows
        counts[row["doc_id"]] = row["n"]
    lengths = code_lengths(counts)
    spark.createDataFrame([(lengths.tobytes(),)], "lengths binary").coalesce(1).write.parquet(f"{folder}/lengths")

    ids = found.where("kind = 0")
    parts = int(counts.sum() // BUCKET_TOKENS) + 1 if counts.sum() < 64 * BUCKET_TOKENS else 64 + int(counts.sum() // (8 * BUCKET_TOKENS))
    found_cuts = ids.approxQuantile("doc_id", [i / parts for i in range(1, parts)], max(0.2 / parts, 1e-5)) if parts > 1 else []
    cuts = np.array(sorted({int(c) for c in found_cuts}), np.int64)
    coder = spark.sparkContext.broadcast((lengths, canonical_codes(lengths), cuts))
    first = -(2**63)  # documents without an id come first

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        size, codes, bounds = coder.value
        for batch in batches:
            packed = []
            for some in slices(batch["ids"].to_pylist(), 2 * PACKED):
                n = np.array([len(x) // 2 for x in some])
                packed += pack_all(np.frombuffer(b"".join(some), "<u2"), n, codes, size)
            bucket = np.searchsorted(bounds, batch["doc_id"].fill_null(first).to_numpy(), side="right")
            yield pa.RecordBatch.from_arrays(
                [batch["doc_id"], pa.array(bucket, pa.int32()), batch["n"], pa.array([x[1] for x in packed], pa.list_(pa.int32())),
                 pa.array([x[0] for x in packed], pa.binary())], ["doc_id", "bucket", "n_tokens", "checkpoints", "payload"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bounds = coder.value[2]
        n = np.zeros(len(bounds) + 1, np.int64)
        for batch in batches:
            np.add.at(n, np.searchsorted(bounds, batch["doc_id"].fill_null(first).to_numpy(), side="right"), batch["n"].to_numpy())
        met = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(met, pa.int32()), pa.array(n[met], pa.int64())], ["b", "n"])

    summed = ids.select("doc_id", "n").mapInArrow(count, "b int, n long").groupBy("b").agg(F.sum("n").alias("n"))
    totals = dict(map(tuple, summed.collect()))  # a row a bucket
    before, so_far = {}, 0
    for b in range(len(cuts) + 1):
        before[b] = so_far
        so_far += totals.get(b, 0)

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bucket, start = None, 0
        for batch in batches:
            starts = []
            for b, n in zip(batch["bucket"].to_pylist(), batch["n_tokens"].to_pylist()):
                if b != bucket:
                    bucket, start = b, before[b]
                starts.append(start)
                start += n
            yield pa.RecordBatch.from_arrays(
                [batch["doc_id"], pa.array(starts, pa.int64()), batch["n_tokens"], batch["checkpoints"], batch["payload"]],
                ["doc_id", "start", "n_tokens", "checkpoints", "payload"])

    coded = ids.select("doc_id", "n", "ids").mapInArrow(code, CODED).repartitionById(len(cuts) + 1, F.col("bucket"))
    ordered = coded.sortWithinPartitions("bucket", F.asc_nulls_first("doc_id"), "payload")
    ordered.mapInArrow(
        number, "doc_id long, start long, n_tokens long, checkpoints array<int>, payload binary"
    ).write.option("compression", "none").parquet(f"{folder}/docs")


def read_token_file(spark: SparkSession, folder: str, ids: bool = True) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32[, ids]) decoded from the files."""
    lengths = np.frombuffer(spark.read.parquet(f"{folder}/lengths").first()["lengths"], np.uint8)
    shared = spark.sparkContext.broadcast(lengths)

    def decode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        table = decode_table(shared.value)
        for pdf in batches:
            # Runs of all documents of a batch are decoded side by side, a few MB at a time.
            size = pdf["payload"].map(len).to_numpy()
            for _, part in pdf.groupby(np.cumsum(size) // 4_000_000, sort=False):
                base = np.concatenate([[0], np.cumsum(part["payload"].map(len).to_numpy())])
                n = part["n_tokens"].to_numpy()
                offsets = [8 * b + np.asarray(c, np.int64) for b, c in zip(base, part["checkpoints"])]
                counts = [np.minimum(RUN, x - np.arange(0, x, RUN)) for x in n]
                flat = unpack(b"".join(part["payload"]), np.concatenate(offsets), np.concatenate(counts), table)
                pieces = np.split(flat.astype("<u4"), np.cumsum(n)[:-1])
                out = part[["doc_id", "start", "n_tokens"]].assign(ids_crc32=[zlib.crc32(x.tobytes()) for x in pieces])
                yield out.assign(ids=[x.astype(np.int64) for x in pieces]) if ids else out

    schema = "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids array<long>" * ids
    rows, _, back = carried(spark.read.parquet(f"{folder}/docs"), ["doc_id"])
    return back(rows.mapInPandas(decode, schema.replace("doc_id long", "doc_id string")))


def token_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    folder = new_folder(spark, "tokens")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    write_token_file(docs, "doc_id", "text", folder, public_tokenizers.path("byte_bpe_50k.json"))
    return read_token_file(spark, folder, ids=False)
