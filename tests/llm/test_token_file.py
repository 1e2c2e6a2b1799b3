"""Token files against the tokenizer itself and an exact round trip."""

import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from quoinlake.llm.huffman import canonical_codes, code_lengths, decode_table, pack, pack_all, unpack
from quoinlake.llm.token_file import WordEncoder, read_token_file, token_query, write_token_file
from quoinlake.llm.wordmerge import WordMerge
from quoinlake.workspace import new_folder

PATH = public_tokenizers.path("byte_bpe_50k.json")
SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def plain():
    return Tokenizer.from_file(PATH)


def ids_of(raw):
    return np.frombuffer(raw, "<u2").tolist()


HAND = ["", " ", "  a  b", "a b", " a", "a ", "a\n b", "a \nb", "it's don't", "x  y", "é è ê", "日本 語", "a\x1c b",
        "<|endoftext|> x", "x <|endoftext|>", "1 2 3", "a" * 5000, "😀 😀", "a  b", "ʼ x", "\t\t a", "a  　 b"]


@pytest.mark.parametrize("text", HAND)
def test_words_equal_the_tokenizer(plain, text):
    assert ids_of(WordEncoder(PATH)(text)) == plain.encode(text, add_special_tokens=False).ids


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.sampled_from(" \n\tab'sé1.! 日 \x1f😀ǅ"), max_size=30))
def test_random_texts_equal_the_tokenizer(text):
    encode = test_random_texts_equal_the_tokenizer.__dict__.setdefault("e", WordEncoder(PATH))
    assert ids_of(encode(text)) == encode.tokenizer.encode(text, add_special_tokens=False).ids


def test_texts_packed_together_are_those_packed_alone():
    rng = np.random.default_rng(5)
    counts = np.array([0, 1, 3000, 0, 2, 1024, 1025, 1, 0])
    ids = rng.integers(0, 400, counts.sum()) ** 2 // 400
    lengths = code_lengths(np.bincount(ids, minlength=400))
    codes, table = canonical_codes(lengths), decode_table(lengths)
    parts = np.split(ids, np.cumsum(counts)[:-1])
    for part, (data, offsets) in zip(parts, pack_all(ids, counts, codes, lengths), strict=True):
        alone, places = pack(part, codes, lengths)
        assert data == alone and offsets.tolist() == places.tolist()
        runs = np.minimum(1024, len(part) - np.arange(0, len(part), 1024))
        assert unpack(data, offsets, runs, table).tolist() == part.tolist()


def test_new_words_of_many_texts_are_merged_together(plain, monkeypatch):
    parts = ["a", "s", "t", "re", "ve", "ll", "d", "'", "'s", "\n", "\r", "\t", "1", "2½", "é", "ß", "ñ", ".", ",", '"', "²", "ª", "×",
             "the", "ing", "Ab", "ŋ", "ǅ", "«"]
    rng = np.random.default_rng(3)
    texts = [" ".join("".join(rng.choice(parts, rng.integers(1, 9))) for _ in range(50)) for _ in range(200)]
    texts = [t + end for t, end in zip(texts, ["", " ", "\n", "  x"] * 50)]
    encode, one_by_one = WordEncoder(PATH), []
    piece = encode._piece
    monkeypatch.setattr(encode, "_piece", lambda p: one_by_one.append(p) or piece(p))
    for t, found in zip(texts, encode.encode_all(texts), strict=True):
        assert ids_of(found) == plain.encode(t, add_special_tokens=False).ids
    one_by_one.clear()
    plain_text = " ".join(f"{w}{i}" for i in range(5000) for w in ("word", "ñuño's"))
    assert ids_of(encode(plain_text)) == plain.encode(plain_text, add_special_tokens=False).ids
    assert len(one_by_one) == 1  # the first word has no blank before it


def test_merges_are_narrow_where_ids_allow_it():
    for last, kind in ((400, np.uint16), (65535, np.int32)):
        merge = WordMerge([(ord("t"), ord("h"), 300), (300, ord("e"), last)], list(range(256)))
        assert merge.made.dtype == merge.ranks.dtype == merge.first.dtype == kind
        assert [ids_of(x) for x in merge.pieces(["the", "hat", "th"])] == [[32, last], [32, 104, 97, 116], [32, 300]]


def test_new_pieces_with_nul_or_of_any_length(plain):
    encode = WordEncoder(PATH)
    for text in ("x a\0b \0 \0\0c a b", "x " + "y" * 39 + " " + "z" * 40 + " " + "w" * 41, "x \tq q\t é\0é ŋ"):
        assert ids_of(encode(text)) == plain.encode(text, add_special_tokens=False).ids
        assert not any(len(p) >= 40 for p in encode.tails)


def test_query_equals_the_tokenizer_on_whole_texts(spark, plain):
    docs = sorted(spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect())
    got = {r["doc_id"]: r for r in token_query(spark, SF).collect()}
    start = 0
    for doc_id, text in docs:
        ids = plain.encode(text or "", add_special_tokens=False).ids + [2]
        r = got[doc_id]
        assert (r["start"], r["n_tokens"]) == (start, len(ids))
        assert r["ids_crc32"] == zlib.crc32(np.array(ids, "<u4").tobytes())
        start += len(ids)


def test_nulls_repeats_and_clashing_columns(spark):
    rows = [(3, "b", 1), (1, None, 2), (None, "a", 3), (1, "", 4), (2, "word " * 3000, 5), (2, "x", 6)]
    df = spark.createDataFrame(rows, "doc_id long, text string, n int")
    folder = new_folder(spark, "t")
    write_token_file(df, "doc_id", "text", folder, PATH)
    got = sorted(read_token_file(spark, folder).collect(), key=lambda r: r["start"])
    assert [r["doc_id"] for r in got] == [None, 1, 1, 2, 2, 3]
    assert [r["start"] for r in got] == np.concatenate([[0], np.cumsum([r["n_tokens"] for r in got])[:-1]]).tolist()
    assert [list(r["ids"]) for r in got][1:3] == [[2], [2]]


def test_empty_table(spark):
    folder = new_folder(spark, "t")
    write_token_file(spark.createDataFrame([], "doc_id long, text string"), "doc_id", "text", folder, PATH)
    assert read_token_file(spark, folder).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 300), min_size=1, max_size=4000), st.integers(0, 3))
def test_huffman_round_trip(ids, skew):
    ids = np.array(ids) ** (1 + skew) % 301
    counts = np.bincount(ids, minlength=302)
    lengths = code_lengths(counts)
    assert sum(2.0 ** -int(x) for x in lengths if x) <= 1
    data, offsets = pack(ids, canonical_codes(lengths), lengths)
    runs = np.minimum(1024, len(ids) - np.arange(0, len(ids), 1024))
    assert unpack(data, offsets, runs, decode_table(lengths)).tolist() == ids.tolist()


def test_lengths_are_bounded_and_cost_least():
    fib = [1, 1]
    while len(fib) < 40:
        fib.append(fib[-1] + fib[-2])
    lengths = code_lengths(np.array(fib))
    assert lengths.max() == 16 and sum(2.0 ** -int(x) for x in lengths) <= 1
    small = np.array([5, 9, 12, 13, 16, 45])
    assert (code_lengths(small) * small).sum() == 224
