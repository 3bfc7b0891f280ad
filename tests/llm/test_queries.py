"""Registered queries against SQL, or against plain Python where SQL cannot express them."""

import math
import os
import struct
import zlib

import duckdb
import pytest

import corpus_pipeline
from equiframe.llm import queries as Q

DATA = "/root/testdata/sf0.001"
TABLES = ("documents", "embeddings", "pages", "benchmark", "labels", "conversations")
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", list(Q.ORACLES))
def test_against_sql(spark, db, name):
    df = Q.QUERIES[name](spark, DATA)
    answer = db.execute(Q.ORACLES[name])
    names = [d[0] for d in answer.description]
    assert sorted(names) == sorted(df.columns)
    place = [names.index(c) for c in df.columns]
    assert sorted(map(tuple, df.collect()), key=repr) == sorted((tuple(r[i] for i in place) for r in answer.fetchall()), key=repr)


@pytest.mark.parametrize("name", ["op3_decontaminate", "op4_secrets", "op5_language", "op7_simhash", "op9_licenses", "op10_token_counts"])
def test_one_row_per_document(spark, db, name):
    got = [r.doc_id for r in Q.QUERIES[name](spark, DATA).select("doc_id").collect()]
    assert sorted(got) == [r[0] for r in db.execute("SELECT doc_id FROM documents ORDER BY 1").fetchall()]


def test_decontamination_query(spark, db):
    from tests.llm.test_decontaminate import plain
    items = [(i, plain(t)) for i, t in db.execute("SELECT item_id, text FROM benchmark").fetchall()]
    docs = {i: plain(t) for i, t in db.execute("SELECT doc_id, text FROM documents").fetchall()}
    exact = {(d, i) for d, t in docs.items() for i, x in items if x in t}
    got = {(r.doc_id, i) for r in Q.QUERIES["op3_decontaminate"](spark, DATA).collect() for i in r.item_ids}
    assert exact <= got


def test_language_query(spark, db):
    lang = dict(db.execute("SELECT doc_id, lang FROM documents").fetchall())
    rows = Q.QUERIES["op5_language"](spark, DATA).collect()
    held = [r for r in rows if r.held_out]
    assert sum(r.lang_pred == lang[r.doc_id] for r in held) >= 0.95 * len(held)
    assert all(0 <= r.score <= 1 and not math.isnan(r.score) for r in rows)


def test_warc_query(spark, db):
    from tests.llm.test_warc import expected
    rows = Q.QUERIES["op6_warc"](spark, DATA).collect()
    assert all(r.digest_holds in (True, None) for r in rows)
    assert sorted(tuple(r)[:5] for r in rows) == sorted(expected(db.execute("SELECT page_id, url, html FROM pages").fetchall()))


def test_simhash_query(spark, db):
    from tests.llm.conftest import components
    from tests.llm.test_simhash import fingerprint
    docs = db.execute("SELECT doc_id, text FROM documents").fetchall()
    prints = {i: fingerprint(t) for i, t in docs}
    links = [(a, b) for a in prints for b in prints if b < a and bin(prints[a] ^ prints[b]).count("1") <= 3]
    root = components(prints, links)
    assert {tuple(r) for r in Q.QUERIES["op7_simhash"](spark, DATA).collect()} == {(i, f"{p:016x}", root[i]) for i, p in prints.items()}


def test_license_query(spark, db):
    from tests.llm.test_license_scan import brute
    docs = db.execute("SELECT doc_id, text FROM documents").fetchall()
    rows = Q.QUERIES["op9_licenses"](spark, DATA).collect()
    names = ("n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score")
    assert {r.doc_id: plain_row(r, names) for r in rows} == {i: tuple(
        round(x, 9) if isinstance(x, float) else x for x in brute(t)) for i, t in docs}


def test_token_count_query(spark, db):
    sentencepiece = pytest.importorskip("sentencepiece")
    public_tokenizers = pytest.importorskip("public_tokenizers")
    library = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    want = set()
    for i, t in db.execute("SELECT doc_id, text FROM documents").fetchall():
        n = len(library.encode(t or ""))
        want.add((i, len((t or "").encode()), n, n > 4096))
    rows = Q.QUERIES["op10_token_counts"](spark, DATA).collect()
    assert {plain_row(r, ("doc_id", "n_bytes", "n_tokens", "over_limit")) for r in rows} == want


def test_token_file_query(spark, db):
    tokenizers = pytest.importorskip("tokenizers")
    public_tokenizers = pytest.importorskip("public_tokenizers")
    library = tokenizers.Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want, start = [], 0
    for i, t in db.execute("SELECT doc_id, text FROM documents ORDER BY 1").fetchall():
        ids = [*library.encode(t or "", add_special_tokens=False).ids, 2]
        want.append((i, start, len(ids), zlib.crc32(struct.pack(f"<{len(ids)}I", *ids))))
        start += len(ids)
    rows = Q.QUERIES["op12_token_files"](spark, DATA).collect()
    assert sorted(plain_row(r, ("doc_id", "start", "n_tokens", "ids_crc32")) for r in rows) == want


def plain_row(row, names):
    return tuple(round(row[n], 9) if isinstance(row[n], float) else row[n] for n in names)


def test_pipeline(spark, db):
    """Each stage against a plain version of its rule, on its own input."""
    from tests.llm.conftest import components
    from tests.llm.test_simhash import fingerprint
    from tests.llm.test_decontaminate import plain
    docs, kept = spark.read.parquet(f"{DATA}/documents.parquet"), []
    for name, stage in corpus_pipeline.STAGES:
        out = corpus_pipeline.Stored(stage(spark, docs, DATA), name.replace(" ", "-")).frame
        assert tuple(out.columns) == corpus_pipeline.COLUMNS and out.schema == docs.schema
        kept.append((name, {r.doc_id: r for r in docs.collect()}, out.collect()))
        docs = out
    stages = {name: (before, after) for name, before, after in kept}
    before, after = stages["language"]
    assert {r.doc_id for r in after} == {i for i, r in before.items() if any(c.isalpha() for c in r.text or "")}
    before, after = stages["near copies"]
    prints = {i: fingerprint(r.text) for i, r in before.items()}
    links = [(a, b) for a in prints for b in prints if b < a and bin(prints[a] ^ prints[b]).count("1") <= 3]
    assert {r.doc_id for r in after} == set(components(prints, links).values())
    before, after = stages["benchmark"]
    items = [plain(t) for _, t in db.execute("SELECT item_id, text FROM benchmark").fetchall()]
    clean = {i for i, r in before.items() if not any(x in plain(r.text) for x in items)}
    assert {r.doc_id for r in after} == clean
    before, after = stages["secrets"]
    assert {r.doc_id for r in after} == set(before)
    assert all(r.text == before[r.doc_id].text or "[SECRET]" in r.text for r in after)
    assert all(r.n_chars == len(r.text) for r in after if "[SECRET]" in r.text)
    before, after = stages["mixture"]
    assert {r.doc_id for r in after} <= set(before)
    assert max([sum(1 for r in after if r.doc_id == i) for i in {r.doc_id for r in after}]) <= 3
