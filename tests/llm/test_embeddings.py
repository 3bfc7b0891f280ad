import math
import random

from tests.llm.conftest import components
from equiframe.llm.embeddings import _hashed, _meetings, embedding_groups

SCHEMA = "vec_id bigint, embedding array<float>, label int"


def cosine(a, b):
    return sum(x * y for x, y in zip(a, b)) / math.sqrt(sum(x * x for x in a) * sum(y * y for y in b))


def usable(v):
    return bool(v) and all(x is not None and math.isfinite(x) for x in v) and any(v)


def brute(rows, threshold=0.9):
    good = {i: v for i, v, _ in rows if usable(v)}
    links = [(a, b) for a in good for b in good if a < b and len(good[a]) == len(good[b]) and cosine(good[a], good[b]) >= threshold]
    root = components([i for i, _, _ in rows], links)
    degree = dict.fromkeys(root, 0)
    for a, b in links:
        degree[a] += 1
        degree[b] += 1
    return {(i, degree[i], root[i], root[i] == i) for i in root}


def float32(v):
    import numpy as np
    return [None if x is None else float(np.float32(x)) for x in v]


def test_against_brute_force(spark):
    random.seed(1)
    rows, i = [], 0
    for _ in range(60):
        base = [random.gauss(0, 1) for _ in range(16)]
        for _ in range(random.choice((1, 1, 3, 6))):
            rows.append((i, float32([x + random.gauss(0, 0.25) for x in base]), 0))
            i += 1
    rows += [(1000 + k, rows[0][1], 1) for k in range(40)]  # copies
    rows += [(2000, [2 * x for x in rows[0][1]], 1), (2001, [-x for x in rows[0][1]], 1)]
    rows += [(3000, None, 1), (3001, [], 1), (3002, [0.0] * 16, 1), (3003, [float("nan")] * 16, 1),
             (3004, [float("inf")] + [0.0] * 15, 1), (3005, [None] + [1.0] * 15, 1), (3006, [1.0], 1), (3007, [2.0], 1)]
    got = {tuple(r) for r in embedding_groups(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == brute(rows)


def test_recall_at_the_threshold(spark):
    """Pairs that lie just above the threshold, where hashing misses most."""
    random.seed(2)
    rows = []
    for i in range(150):
        a = [random.gauss(0, 1) for _ in range(32)]
        b = [random.gauss(0, 1) for _ in range(32)]
        n, m = (math.sqrt(sum(x * x for x in v)) for v in (a, b))
        dot = sum(x * y for x, y in zip(a, b)) / (n * m)
        side = [y / m - dot * x / n for x, y in zip(a, b)]
        s = math.sqrt(sum(x * x for x in side))
        angle = math.acos(0.905)
        rows += [(2 * i, float32([x / n for x in a]), 0),
                 (2 * i + 1, float32([math.cos(angle) * x / n + math.sin(angle) * y / s for x, y in zip(a, side)]), 0)]
    got = embedding_groups(spark.createDataFrame(rows, SCHEMA)).collect()
    assert sum(r.n_links for r in got) >= 0.97 * 300


def test_empty_and_repeated(spark):
    assert embedding_groups(spark.createDataFrame([], SCHEMA)).count() == 0
    rows = [(1, [1.0, 0.0], 0), (1, [1.0, 0.0], 0), (None, [1.0, 0.0], 0), (2, [1.0, 0.1], 0)]
    got = {tuple(r) for r in embedding_groups(spark.createDataFrame(rows, SCHEMA).withColumnRenamed("label", "class")).collect()}
    assert got == {(1, 1, 1, True), (2, 1, 1, False), (None, 0, None, False)}


def test_meetings_are_those_of_all_tables(spark):
    """The carried hash values drop repeats and no pair."""
    random.seed(3)
    base = [[random.gauss(0, 1) for _ in range(8)] for _ in range(6)]
    rows = [(i, [x + random.gauss(0, 0.15) for x in base[i % 6]]) for i in range(90)]
    hashed = _hashed(spark.createDataFrame(rows, "class bigint, vector array<double>"), 10, 20, 7).cache()
    by_key = {}
    for r in hashed.collect():
        by_key.setdefault(r.key, set()).add(r["class"])
    want = {(a, b) for g in by_key.values() for a in g for b in g if a < b}
    got = [tuple(r) for r in _meetings(hashed).collect()]
    assert len(got) == len(want) and set(got) == want
    hashed.unpersist()
