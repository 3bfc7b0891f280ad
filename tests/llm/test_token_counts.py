import random

import pytest

from equiframe.llm import token_counts

public_tokenizers = pytest.importorskip("public_tokenizers")
MODEL = public_tokenizers.path("piece_bpe_32k.model")
PARTS = ["a", "b", " ", "  ", "\t", "\n", "▁", "漢", "é", "</s>", "<s>", "the ", "ing ", "🙂", "<0x41>", "\x00", "ﬁ", "the quick fox "]


@pytest.fixture(scope="module")
def counter():
    return token_counts.Counter(MODEL)


@pytest.mark.parametrize("chunk, overlap", [(16, 1), (64, 4), (300, 32)])
def test_splices_are_exact(counter, chunk, overlap):
    rng = random.Random(chunk)
    counter.chunk, counter.overlap = chunk, overlap
    assert counter.splits
    for _ in range(150):
        text = "".join(rng.choice(PARTS) for _ in range(rng.choice((5, 200, 900))))
        assert counter.count(text) == len(counter.model.encode(text)), repr(text[:80])


@pytest.mark.parametrize("text", ["", " ", "a" * 5000, " " * 5000, "漢" * 5000, "a b" * 3000, "x" * 3000 + " y" + "z" * 3000])
def test_overlaps_widen(counter, text):
    counter.chunk, counter.overlap = 100, 3
    assert counter.count(text) == len(counter.model.encode(text))


def test_table(docs_of, counter):
    texts = ["Hello wörld", None, "", "</s> [INST]", "word " * 40_000, "same", "same"]
    got = {tuple(r) for r in token_counts.count_tokens(docs_of(texts), MODEL, chunk=1000, overlap=20).collect()}
    counts = [len(counter.model.encode(t or "")) for t in texts]
    assert got == {(i, len((t or "").encode()), n, n > 4096) for i, (t, n) in enumerate(zip(texts, counts))}
    assert token_counts.count_tokens(docs_of([]), MODEL).count() == 0
