import random
import re

import numpy as np
import xxhash

from tests.llm.conftest import components
from equiframe.llm import simhash


def fingerprint(text, width=3):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    runs = [" ".join(words[i:i + width]) for i in range(len(words) - width + 1)] or ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(r.encode(), 42) for r in runs]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def variants(rng, n):
    vocabulary = [f"w{i}" for i in range(300)] + ["Ärger", "ÄRGER", "été"]
    texts = []
    for _ in range(n):
        base = [rng.choice(vocabulary) for _ in range(rng.choice((5, 60, 200)))]
        texts.append(" ".join(base))
        for _ in range(rng.choice((0, 0, 2, 8))):
            other = list(base)
            for _ in range(rng.choice((0, 1, 2, 6))):
                other[rng.randrange(len(other))] = rng.choice(vocabulary)
            texts.append((" ", "\n", "\t ")[rng.randrange(3)].join(other))
    return texts


def test_groups_against_brute_force(docs_of):
    texts = variants(random.Random(3), 60) + [None, "", " \n\t", "one", "ONE", "one two", "x " * 30_000, "no break"] + ["same text here"] * 50
    prints = [fingerprint(t) for t in texts]
    links = [(a, b) for a in range(len(texts)) for b in range(a) if bin(prints[a] ^ prints[b]).count("1") <= 3]
    root = components(range(len(texts)), links)
    got = {tuple(r) for r in simhash.simhash_groups(docs_of(texts)).collect()}
    assert got == {(i, f"{prints[i]:016x}", root[i]) for i in range(len(texts))}


def test_every_near_pair_meets(spark):
    """Fingerprints at all distances up to the limit, in any place."""
    rng = random.Random(4)
    values = []
    for _ in range(150):
        base = rng.getrandbits(64)
        values.append(base)
        for d in (1, 2, 3, 4):
            values.append(base ^ sum(1 << b for b in rng.sample(range(64), d)))
    values = sorted(set(values))
    signed = np.array(values, dtype="u8").view("i8").tolist()
    frame = spark.createDataFrame(list(enumerate(signed)), "vertex bigint, f0 bigint")
    links = [(a, b) for a in range(len(values)) for b in range(a) if bin(values[a] ^ values[b]).count("1") <= 3]
    root = components(range(len(values)), links)
    got = {r.vertex: r.component for r in simhash.components_of(frame, 1, 3).collect()}
    assert {v: got.get(v, v) for v in root} == root


def test_dense_group_of_fingerprints(spark):
    base = 0x0123456789ABCDEF
    values = sorted({base ^ (1 << a) ^ (1 << b) for a in range(64) for b in range(0, 64, 7)})
    signed = np.array(values, dtype="u8").view("i8").tolist()
    frame = spark.createDataFrame(list(enumerate(signed)), "vertex bigint, f0 bigint")
    got = simhash.components_of(frame, 1, 3).collect()
    assert {r.component for r in got} == {0} and len(got) == len(values)


def test_one_of_each_group_stays(docs_of):
    texts = variants(random.Random(5), 50) + ["", None, " ", "alone here"] + ["copy of a text"] * 20
    prints = [fingerprint(t) for t in texts]
    links = [(a, b) for a in range(len(texts)) for b in range(a) if bin(prints[a] ^ prints[b]).count("1") <= 3]
    root = components(range(len(texts)), links)
    assert sum(root[i] != i for i in root) > 30
    assert {r.doc_id for r in simhash.drop_near_copies(docs_of(texts)).collect()} == set(root.values())


def test_a_key_with_several_texts(docs_of):
    a, b, c = "the first of these texts", "quite another one of them", "nothing like either of both"
    def left(*rows):
        return sorted((r.doc_id, r.text) for r in simhash.drop_near_copies(docs_of([(*r, "en", "s") for r in rows])).collect())
    assert left((7, a), (7, b), (9, a)) == sorted([(7, a), (7, b)])
    assert left((7, a), (7, b), (3, b), (9, a)) == sorted([(3, b), (7, a)])
    assert left((7, a), (7, b), (5, b), (5, c), (6, c)) == sorted([(5, b), (5, c), (7, a)])
    assert left((7, a), (7, a), (8, a)) == [(7, a), (7, a)]
    assert left((None, a), (None, a)) == [(None, a), (None, a)]
    assert left((None, a), (4, a)) == [(4, a)]


def test_edge_rows(spark, docs_of):
    assert simhash.simhash_groups(docs_of([])).count() == 0
    assert simhash.drop_near_copies(docs_of([])).count() == 0
    rows = [(None, "a b c", "en", "s"), (7, "a b c", "en", "s"), (7, "a b c", "en", "s"), (7, "other", "en", "s")]
    got = simhash.simhash_groups(docs_of(rows).withColumnRenamed("lang", "f0")).collect()
    assert sorted((r.doc_id is None, r.doc_id or 0, r.component_id) for r in got) == [(False, 7, 7), (False, 7, 7), (True, 0, 7)]
    assert simhash.drop_near_copies(docs_of(rows)).count() == 3  # the row without a key is a copy
    clash = docs_of(["a b c d e f", "a b c d e f"]).selectExpr("*", "1 as _mark", "2 as _gone", "3 as text_key", "4 as f0", "5 as vertex")
    assert [r._mark for r in simhash.drop_near_copies(clash).collect()] == [1]
