import random

from tests.llm.conftest import components
from equiframe.llm.components import connected_components


def test_against_union_find(spark):
    rng = random.Random(6)
    links = [(rng.randrange(400), rng.randrange(400)) for _ in range(300)]
    links += [(1000 + i, 1001 + i) for i in range(120)] + [(5000, 5000 + i) for i in range(1, 200)] + [(7, 7), (None, 3)]
    real = [(a, b) for a, b in links if a is not None and a != b]
    root = components({v for link in real for v in link}, real)
    got = {r.vertex: r.component for r in connected_components(spark.createDataFrame(links, "a bigint, b bigint")).collect()}
    assert got == root


def test_empty(spark):
    assert connected_components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0
