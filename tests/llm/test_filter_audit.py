import hashlib
from itertools import permutations

import numpy as np
import pyarrow as pa
import pytest

from equiframe.llm import filter_audit as A
from equiframe.llm.shared import Stored

LABELS = "doc_id bigint, quality int, toxic int"


def failing(text):
    words = [w for w in text.translate({i: " " for i in (9, 10, 11, 12, 13)}).split(" ") if w]
    return "".join(c for c, f in zip("ABCD", (
        len(words) < 100, 100 * len(set(words)) < 80 * len(words),
        100 * sum("A" <= c <= "Z" for c in text) > 10 * len(text), any(c in "#$%&*|" for c in text))) if f)


def audit(docs, labels):
    """Every order filter by filter, over ``(doc_id, text, part)``."""
    rows = [(i, t or "", p or "") for i, t, p in docs]
    good = {i for i, q, _ in labels if q == 1 and i is not None}
    toxic = {i for i, _, x in labels if x == 1 and i is not None}
    fails = []
    for i, t, p in rows:
        earlier = any(t == u and i is not None and j is not None and j < i for j, u, _ in rows)
        fails.append((i, p, failing(t) + "E" * earlier))
    out, removed_in_all = {}, {}
    for order in map("".join, permutations("ABCDE")):
        for part in {p for _, p, _ in fails}:
            left = [r for r in fails if r[1] == part]
            for step, c in enumerate(order, 1):
                here = [r for r in left if c in r[2]]
                left = [r for r in left if c not in r[2]]
                every = [r for r in fails if r[1] == part]
                failed = [r for r in every if c in r[2]]
                out[part, order, step] = [
                    len(left), len(here), len(failed) - len(here), sum(r[2] == c for r in failed),
                    sum(r[0] in good for r in here), sum(r[0] in toxic for r in here)]
                removed_in_all[part, c] = removed_in_all.get((part, c), 0) + len(here)
    return {(*k, *v, removed_in_all[k[0], k[1][k[2] - 1]]) for k, v in out.items()}


LONG = " ".join(f"w{i}" for i in range(120))
ROWS = [
    (1, LONG, "en"), (2, LONG, "de"), (2, LONG, "de"), (3, LONG + " #", "en"), (4, None, None), (5, "", "en"), (6, "A B C", ""),
    (None, LONG, "en"), (7, "x " * 150, "en"), (8, "x " * 150, "en"), (0, "x " * 150, "fr"), (9, LONG.upper() + "\v|", "en"),
    (10, "É" * 9 + "A", "en"), (10, "É" * 8 + "AB", "en"), (None, None, "en"),
]
SAID = [(1, 1, 0), (1, 0, 1), (2, 1, 1), (4, 0, 1), (8, 1, None), (None, 1, 1), (99, 1, 1)]


def test_against_every_order_run_by_itself(spark):
    docs = spark.createDataFrame([(*r, 1, True) for r in ROWS], "doc_id bigint, text string, lang string, mask int, may_repeat boolean")
    got = A.filter_audit(docs, spark.createDataFrame(SAID, LABELS))
    assert {tuple(r) for r in got.collect()} == audit(ROWS, SAID)
    assert got.count() == 600 * len({p or "" for _, _, p in ROWS})


def test_empty(spark):
    docs = spark.createDataFrame([], "doc_id bigint, text string, lang string")
    assert A.filter_audit(docs, spark.createDataFrame([], LABELS)).count() == 0
    some = spark.createDataFrame(ROWS, "doc_id bigint, text string, lang string")
    assert {tuple(r) for r in A.filter_audit(some, spark.createDataFrame([], LABELS)).collect()} == audit(ROWS, [])


@pytest.mark.parametrize("parts", [1, 7])
def test_sketch_clears_unique_texts_only(spark, parts):
    rows = [(i, "", 0, hashlib.sha256(str(i % 700 if i < 1400 else i).encode()).digest()) for i in range(4000)]
    frame = spark.createDataFrame(rows, "doc_id bigint, part string, mask int, digest binary").repartition(parts)
    cells = A.cell_count(4000)
    often = A.repeated_cells(frame.select("digest"), cells)
    at = A.cells_of(pa.array([r[3] for r in rows], pa.binary()), cells)
    expected = np.bincount(at.ravel(), minlength=cells) >= 2
    assert (np.unpackbits(often, bitorder="little").astype(bool) == expected).all()
    may = expected[at].all(axis=1)
    assert may[:1400].all() and may[1400:].mean() < 0.1


def test_a_full_sketch_changes_nothing(spark):
    docs = spark.createDataFrame([(i, f"{LONG} {i // 2}", "en") for i in range(500)], "doc_id bigint, text string, lang string")
    rows = Stored(A.marked(docs, "doc_id", "text", "lang"), "marked").frame
    for most in (A.MOST_CELLS, A.SECTION):
        assert {(r.doc_id, r["mask"]) for r in A.with_repeats(rows, most).collect()} == {(i, 16 * (i % 2)) for i in range(500)}


def test_long_texts_are_cut_at_spaces():
    text = (" ".join(f"é{i % 90_000}" for i in range(300_000))).encode()
    assert len(text) > 2 * A.PIECE_BYTES
    assert A.own_mask(text) == 0b0010 and b"".join(A._pieces(text)) == text
    assert A.own_mask(b"x" * (3 << 20)) == 0b0001
