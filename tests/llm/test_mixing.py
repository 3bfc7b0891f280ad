import re

import pytest

from equiframe.llm import mixing


def targets(sizes, weights=(5, 2, 1), most=3):
    """Share by weight, stop at the cap, share the excess again."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    total, capped = sum(sizes.values()), set()
    while True:
        free = [s for s in names if s not in capped]
        rest = total - sum(most * sizes[s] for s in capped)
        share = {s: rest * weight[s] / (sum(weight[f] for f in free) or 1) for s in free}
        above = {s for s in free if share[s] > most * sizes[s]}
        if not above:
            return {s: most * sizes[s] if s in capped else share[s] for s in names}
        capped |= above


@pytest.mark.parametrize("sizes", [
    {"a": 100, "b": 10, "c": 5, None: 3}, {"a": 0, "b": 0}, {"a": 1, "b": 1000}, {"ä": 7, "z": 7, "Z": 7, "é": 1}])
def test_targets(spark, sizes):
    frame = spark.createDataFrame(list(sizes.items()), "s string, source_size bigint")
    got = {r.s: r.target for r in mixing.source_targets(frame, "s").collect()}
    want = targets(sizes)
    assert got.keys() == want.keys()
    assert all(got[s] == pytest.approx(want[s]) for s in want)
    assert sum(got.values()) == pytest.approx(sum(sizes.values()))


def test_mix(spark, docs_of):
    rows = [(i, "w " * (i % 40 + 1), "en", f"s{i % 3}") for i in range(3000)]
    rows += [(5000, None, "en", None), (5001, " \n", "en", None), (5002, "x y", "en", None), (5002, "x y", "en", None)]
    got = mixing.mix(docs_of(rows)).collect()
    again = mixing.mix(docs_of(rows[::-1]).repartition(3)).collect()
    assert sorted((r.doc_id, r.taken) for r in got) == sorted((r.doc_id, r.taken) for r in again)
    by = {}
    for r in got:
        assert r["size"] == len(re.findall(r"[^\x20\x09-\x0D]+", r.text or ""))
        assert 0 <= r.copies <= 3 and r.taken == r.copies * r["size"]
        assert r.copies in (int(r.rate), int(r.rate) + 1)
        by.setdefault(r.source, [0, r.target])[0] += r.taken
    assert all(abs(taken - target) <= 0.1 * target + 6 for taken, target in by.values())
    emitted = mixing.emit(docs_of(rows)).groupBy("doc_id").count().collect()
    assert sum(r["count"] for r in emitted) == sum(r.copies for r in got)


def test_empty_and_clashing_names(spark, docs_of):
    assert mixing.mix(docs_of([])).count() == 0
    clash = docs_of(["a b", None]).selectExpr("*", "1 as size", "2 as target", "3 as copies", "4 as weight", "5 as _mark", "6 as _copy", "7 as _MARK_", "8 as _source")
    assert {(r["size"], r["_mark"]) for r in mixing.mix(clash).collect()} == {(0, 5), (2, 5)}
    assert {r["_copy"] for r in mixing.emit(clash).collect()} <= {6}
