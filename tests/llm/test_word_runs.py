import hashlib
import random
import re
import zlib
from fractions import Fraction

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from equiframe.llm import queries as Q
from equiframe.llm import word_runs as W

DATA = "/root/testdata/sf0.001"


def longest_lyndon(symbols, descending):
    s = [-x for x in symbols] if descending else symbols
    return [max(e - i for e in range(i + 1, len(s) + 1) if all(s[i:e] < s[k:e] for k in range(i + 1, e)))
            for i in range(len(s))]


def plain_runs(c):
    """All maximal stretches of each period, of which only those with no smaller period stay."""
    found = []
    for q in range(1, len(c) // 4 + 1):
        i = 0
        while i + q < len(c):
            j = i
            while j + q < len(c) and c[j] == c[j + q]:
                j += 1
            if j - i + q >= max(6, 4 * q):
                stretch = c[i:j + q]
                if not any(all(stretch[k] == stretch[k + d] for k in range(len(stretch) - d)) for d in range(1, q)):
                    found.append((i, j - i + q, q))
            i = max(j, i + 1)
    return sorted(found, key=lambda r: (r[0], r[2]))


def planted(doc_id, text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    h = None if doc_id is None else zlib.crc32(str(doc_id).encode())
    if h is None or h % 10 or not words:
        return words
    g, n = h // 10, len(words)
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]


def row_of(words):
    runs = plain_runs(words)
    out = {i for s, n, q in runs for i in range(s + q, s + n)}
    best = min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=(None,) * 3)
    return (len(runs), *best, best[0] if best[0] is None else 1000 * best[1] // best[2],
            hashlib.sha256("".join(f"{s},{n},{q}\n" for s, n, q in runs).encode()).hexdigest(),
            hashlib.sha256(" ".join(w for i, w in enumerate(words) if i not in out).encode()).hexdigest())


@settings(max_examples=300, deadline=None)
@given(st.lists(st.integers(0, 3), max_size=14), st.booleans())
def test_grouping_gives_the_lyndon_array(symbols, descending):
    assert W.lyndon_lengths(symbols, descending) == longest_lyndon(symbols, descending)


def test_runs_against_all_periods():
    rng = random.Random(3)
    for _ in range(800):
        kinds, made = rng.randint(1, 4), []
        for _ in range(rng.randint(0, 5)):
            piece = [rng.randrange(kinds) for _ in range(rng.randint(1, 5))]
            made += (piece * rng.randint(1, 8))[:rng.randint(1, 32)]
        assert W.runs_of(np.array(made, dtype=np.int64)) == plain_runs(made), made


def test_rare_words_cut():
    codes = np.array([0] * 10 + [1] + [2, 3] * 5 + [4, 5, 6, 7] * 3)
    assert sorted(W.segments(codes)) == [(0, 10), (11, 21)]


def test_columns_and_edge_cases(spark):
    texts = [None, "", " \t\n", "one", "a " * 6, "a " * 5, "x\va\x0ca\ra\na\ta a y", "A a A a a a a a a", "é " * 7, "a b c " * 4 + "a",
             "  " * 6, "p q " * 4 + "p q r " * 4]
    docs = spark.createDataFrame([(i, t, "old") for i, t in enumerate(texts)] * 2, "doc_id bigint, text string, runs string")
    got = W.find_runs(docs.withColumnRenamed("runs", "period")).collect()
    assert len(got) == 2 * len(texts) and "text" in got[0].asDict()
    for r in got:
        words = re.findall(r"[^\x20\x09-\x0D]+", texts[r.doc_id] or "")
        assert (r.n_runs, r.start, r.length, r.period, r.exponent_milli, r.runs_sha256, r.collapsed_sha256) == row_of(words)
    shown = {r.doc_id: r for r in W.find_runs(docs, texts=True).collect()}
    assert shown[6].collapsed == "x a y" and [tuple(x) for x in shown[6].runs] == [(1, 6, 1)]
    assert W.find_runs(docs.limit(0)).count() == 0
    with pytest.raises(ValueError):
        W.find_runs(docs, times=3)


def test_long_texts(spark):
    rng = random.Random(5)
    noise = [f"w{rng.randrange(400)}" for _ in range(60_000)]
    phrase = [f"v{i % 700}" for i in range(3000)]
    words = noise + phrase * 5 + ["z"] * 20_000 + noise[:50]
    row = W.find_runs(spark.createDataFrame([(1, " ".join(words))], "doc_id bigint, text string"), texts=True).first()
    assert [tuple(r) for r in row.runs if r.length > 1000] == [
        (60_000, 3000, 700), (60_000, 15_000, 3000), *[(60_000 + 3000 * i, 3000, 700) for i in range(1, 5)], (75_000, 20_000, 1)]
    assert (row.length, row.period, row.exponent_milli) == (20_000, 1, 20_000_000)


def test_query(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text").collect()
    got = {r.doc_id: tuple(r)[1:] for r in Q.QUERIES["op13_word_runs"](spark, DATA).collect()}
    assert len(got) == len(docs)
    assert sum(v[0] > 0 for v in got.values()) >= len(docs) / 50
    for doc_id, text in docs:
        words = planted(doc_id, text)
        if len(words) < 3000 or zlib.crc32(str(doc_id).encode()) % 10 == 0:
            assert got[doc_id] == row_of(words), doc_id
