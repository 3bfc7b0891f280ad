import itertools
import random
import zlib

import numpy as np

from equiframe.llm import language as L

SOUNDS = {"aa": "ka lo mi ta", "bb": "sch ung ver ich", "cc": "eau oux que ille", "ru": "ова ный что при"}


def sentence(rng, lang, n):
    parts = SOUNDS[lang].split()
    return " ".join("".join(rng.choice(parts) for _ in range(rng.randrange(1, 4))) for _ in range(n))


def corpus(n=300):
    rng = random.Random(11)
    return [(i, sentence(rng, lang, rng.randrange(5, 40)), lang, "s") for i in range(n) for lang in [list(SOUNDS)[i % 4]]]


def test_viterbi_against_all_paths():
    rng = np.random.default_rng(1)
    sizes = np.array([5, 0, 1, 6, 3])
    starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    scores = rng.normal(size=(sizes.sum(), 3)).astype(np.float32)
    labels = L.viterbi(scores, starts, sizes, 1.2)
    for start, size in zip(starts, sizes):
        def worth(path):
            return sum(scores[start + t, k] for t, k in enumerate(path)) - 1.2 * sum(a != b for a, b in zip(path, path[1:]))
        best = max((worth(p) for p in itertools.product(range(3), repeat=int(size))), default=0)
        assert abs(worth(labels[start:start + size]) - best) < 1e-4


def test_held_out(docs_of):
    rows = corpus(50) + [(None, "x", None, "s")]
    got = {r.doc_id: r.h for r in docs_of(rows).select("doc_id", L.held_out(L.F.col("doc_id")).alias("h")).collect()}
    assert got == {i: i is not None and zlib.crc32(str(i).encode()) % 4 == 2 for i, *_ in rows}


def test_accuracy_and_spans(docs_of):
    docs = docs_of(corpus())
    model = L.train(docs)
    assert model.languages == sorted(SOUNDS)
    held = L.identify(docs.filter(L.held_out(L.F.col("doc_id"))), model).collect()
    assert sum(r.lang_pred == r.lang for r in held) >= 0.97 * len(held) > 0
    rng = random.Random(12)
    first, second = sentence(rng, "aa", 30), sentence(rng, "cc", 10)
    mixed = L.identify(docs_of([f"{first}. {second}"]), model, spans=True).first()
    assert mixed.lang_pred == "aa" and 0.5 < mixed.score < 1
    assert [s.lang for s in mixed.spans] == ["aa", "cc"]
    assert abs(mixed.spans[1].start - len(first)) < 25


def test_texts_in_several_languages_fit(docs_of):
    import corpus_pipeline

    model, rng = L.train(docs_of(corpus())), random.Random(13)
    mixed = [" ".join(sentence(rng, lang, n) for lang, n in (("aa", 40), ("bb", 30), ("cc", 30))) for _ in range(10)]
    got = L.identify(docs_of([*mixed, "漢字 仮名", "kalo 漢字漢字漢字漢字"]), model).orderBy("doc_id").collect()
    assert all(r.fits == 1.0 and r.score < 0.7 for r in got[:10])
    assert got[10].fits == 0.0 and abs(got[11].fits - 4 / 12) < 1e-9
    rows = corpus() + [(1000 + i, t, None, "s") for i, t in enumerate([*mixed, "漢字 仮名", None, "123"])]
    kept = {r.doc_id for r in corpus_pipeline.identify_language(None, docs_of(rows), "").collect()}
    assert kept == {i for i, *_ in rows if i < 1010}


def test_lang_is_no_input(docs_of):
    rows = corpus()
    model = L.train(docs_of(rows))
    other = [(i, t, "zz", "other") for i, t, _, _ in rows]
    plain = [(r.doc_id, r.lang_pred, r.score) for r in L.identify(docs_of(rows), model).collect()]
    assert plain == [(r.doc_id, r.lang_pred, r.score) for r in L.identify(docs_of(other), model).collect()]


def test_edge_rows(spark, docs_of):
    model = L.train(docs_of(corpus()))
    texts = [None, "", "123 !?", "kalo " * 30_000, "漢字", "kalo", "kalo"]
    got = {r.doc_id: (r.lang_pred, r.score) for r in L.identify(docs_of(texts).withColumnRenamed("lang", "score"), model).collect()}
    assert [got[i] for i in range(3)] == [("und", 0.0)] * 3
    assert got[3] == ("aa", 1.0) and got[5] == got[6] == ("aa", 1.0)
    assert got[4][0] in model.languages and got[4][1] == 0.0
    assert L.identify(docs_of([]), model).count() == 0
    clash = L.identify(docs_of(["kalo"]).selectExpr("*", "'x' as _text", "1 as spans"), model, spans=True).first()
    assert clash._text == "x" and clash.lang_pred == "aa"
    nothing = L.train(docs_of([(1, "some text", None, "s")]))
    assert L.identify(docs_of(["text"]), nothing).first().lang_pred == "und"
