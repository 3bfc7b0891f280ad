import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from equiframe.llm import token_files as R

MODEL = public_tokenizers.path("byte_bpe_50k.json")
ENCODER = R.Encoder(MODEL)
TEXTS = [
    "", None, " ", "a", "plain words and plain words", "don't  do\tthat \n\n again", " lead", "trail ", "a \n b  c", "naïve 漢字 und ÄÖ",
    "before <|endoftext|> after", "x" * 5000, "  odd space \x1c here", "1 22 333 a1b2 ... !!", "same same " * 400,
]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(MODEL)


def test_words_encode_like_whole_texts(library):
    encoder = R.Encoder(MODEL)
    assert encoder.splits
    for _ in range(2):  # the second time from what is known
        for text, ids in zip(TEXTS, encoder.encode(pa.array([t or "" for t in TEXTS]))):
            assert ids.tolist() == library.encode(text or "", add_special_tokens=False).ids
    encoder.most_bytes = 0
    assert encoder.encode(pa.array(["new words"]))[0].tolist() == library.encode("new words", add_special_tokens=False).ids


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(alphabet="ab ,.\n\t'é1 ", max_size=40), max_size=4))
def test_words_encode_like_whole_texts_made(texts):
    assert [f.tolist() for f in ENCODER.encode(pa.array(texts, pa.string()))] == [
        ENCODER.model.encode(t, add_special_tokens=False).ids for t in texts]


@settings(max_examples=400, deadline=None)
@given(st.lists(st.text(alphabet="aZ é\u00d7\u00f7ßÿ\u024f\u0250ж漢\u0301²½٣sltrevmd19''--.,$\n\n\r\t\x0b\x1c\x85\xa0\u2003\x7f\x01", max_size=24), max_size=6))
def test_pieces_encode_like_whole_texts(texts):
    texts = [*texts, *[f"w {t} w" for t in texts]]
    assert [f.tolist() for f in ENCODER.encode(pa.array(texts, pa.string()))] == [
        ENCODER.model.encode(t, add_special_tokens=False).ids for t in texts]


def test_words_are_cut_into_pieces():
    words = ["don't", "a1b2...!!", "über,\nDie", "a\n\nb", "x-y's", "3×4", "ж.a"]
    pieces, first = R._pieces(pa.array(["skipped", *words]).slice(1))
    cut = []
    for piece, begins in zip(pieces.to_pylist(), first):
        cut = [*cut, [piece]] if begins else [*cut[:-1], [*cut[-1], piece]]
    assert cut == [["don", "'t"], ["a", "1", "b", "2", "...!!"], ["über", ",", "\n", "Die"], ["a", "\n\nb"], ["x", "-", "y", "'s"],
                   ["3×4"], ["ж.", "a"]]
    assert len(R._pieces(pa.array([], pa.string()))[0]) == 0


def test_each_piece_is_encoded_once(monkeypatch):
    """Words that differ only in the signs and line breaks around them cost the library no more than the word alone."""
    encoder, told = R.Encoder(MODEL), []
    monkeypatch.setattr(encoder, "_learn", lambda pieces, *a, real=encoder._learn: told.extend(pieces.to_pylist()) or real(pieces, *a))
    text = " ".join(["w", *[f"word{end}" for end in ("", ",", ".", "!", ".\nword", ",\nword", "-word", "'s", "##")] * 3])
    for _ in range(2):
        assert encoder.encode(pa.array([text]))[0].tolist() == encoder.model.encode(text, add_special_tokens=False).ids
    assert [t for t in told if "word" in t] == ["word", "word"]  # with and without a space in front


@settings(max_examples=150, deadline=None)
@given(st.lists(st.lists(st.integers(0, 3), max_size=60), max_size=6), st.integers(0, 200), st.integers(0, 60))
def test_shards_read_back(documents, start, count):
    documents = [np.array(d, dtype=np.uint32) for d in documents]
    shard = R.Shard(R.pack_shard(pa.array(range(len(documents)), pa.int64()), documents))
    flat = np.concatenate([np.empty(0, np.uint32), *documents])
    assert (shard.all_ids() == flat).all()
    assert (shard.ids(start, count) == flat[start:start + count]).all()
    for i, d in enumerate(documents):
        assert (shard.document(i) == d).all()
    assert (shard.grammar.lengths <= R.MOST_EXPANSION).all()


def test_grammar_shortens_and_stays_shallow():
    ids = np.array(list(range(100)) * 300, dtype=np.uint32)
    grammar, symbols, held = R.compress(ids, np.array([len(ids)]))
    assert len(symbols) < len(ids) / 50 and held.tolist() == [len(symbols)]
    for i, n in enumerate(grammar.lengths):
        grown = grammar.expand(np.array([grammar.base + i])).tolist()
        assert grown == (list(range(100)) * 60)[grown[0]:grown[0] + n]
    flat = np.zeros(200_000, dtype=np.uint32)
    grammar, symbols, _ = R.compress(flat, np.array([len(flat)]))
    assert len(symbols) < 100 and (grammar.expand_all(symbols) == flat).all()


def expected(library, rows, end=2):
    out, start = [], 0
    for i, t in rows:
        ids = [*library.encode(t or "", add_special_tokens=False).ids, end]
        out.append((i, start, len(ids), zlib.crc32(np.array(ids, dtype="<u4").tobytes())))
        start += len(ids)
    return out


@pytest.mark.parametrize("shard_ids,range_bytes", [(64, 1000), (1 << 20, 1 << 24)])
def test_files_read_back(spark, library, shard_ids, range_bytes):
    rows = list(enumerate(TEXTS * 3))
    docs = spark.createDataFrame([(i, t, 7) for i, t in rows], "doc_id bigint, text string, start int").repartition(5)
    got = R.token_files(docs, MODEL, 2, shard_ids=shard_ids, range_bytes=range_bytes)
    assert sorted(map(tuple, got.collect())) == expected(library, rows)


def test_repeated_and_null_keys(spark, library):
    rows = [(None, "b"), (None, "a a"), (3, "x y"), (3, "x y"), (3, "z"), (1, None)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = R.token_files(docs, MODEL, 2, shard_ids=2).collect()
    assert sorted((r.doc_id is not None, r.doc_id or 0, r.n_tokens, r.ids_crc32) for r in got) == sorted(
        (i is not None, i or 0, n, c) for i, _, n, c in expected(library, rows))
    placed = sorted(got, key=lambda r: r.start)
    assert [r.start for r in placed] == [sum(r.n_tokens for r in placed[:i]) for i in range(len(placed))]
    assert [r.doc_id for r in placed] == [None, None, 1, 3, 3, 3]


def test_empty_and_chosen_shards(spark, library):
    none = spark.createDataFrame([], "doc_id bigint, text string")
    assert R.token_files(none, MODEL, 2).count() == 0
    rows = [(i, f"document number {i}") for i in range(50)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    index = R.write_token_files(docs, MODEL, 2, shard_ids=20, range_bytes=200)
    assert index.count() > 5
    some = R.read_token_files(index.filter(F.col("start_id") >= 100), docs.schema["doc_id"], ids=True).collect()
    told = {r[0]: r for r in expected(library, rows)}
    assert some and all((r.doc_id, r.start, r.n_tokens, r.ids_crc32) == told[r.doc_id] for r in some)
    assert all(r.ids == [*library.encode(rows[r.doc_id][1], add_special_tokens=False).ids, 2] for r in some)
