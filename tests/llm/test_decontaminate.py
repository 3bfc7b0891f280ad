import random
import re

from equiframe.llm import decontaminate as D

ITEMS = "item_id bigint, text string"


def edits(pattern, text):
    """Smallest edit distance of ``pattern`` and any passage of ``text``."""
    row = [0] * (len(text) + 1)
    for i, p in enumerate(pattern, 1):
        last, row = row, [i]
        for j, t in enumerate(text, 1):
            row.append(min(last[j] + 1, row[j - 1] + 1, last[j - 1] + (p != t)))
    return min(row)


def plain(text):
    return " ".join(re.findall(r"[^\W_]+", (text or "").lower()))


def test_distance():
    rng = random.Random(9)
    for _ in range(300):
        p = "".join(rng.choice("ab c") for _ in range(rng.randrange(1, 90)))
        t = "".join(rng.choice("ab c") for _ in range(rng.randrange(0, 120)))
        distance, end = D.best_distance(p, t)
        assert distance == edits(p, t)
        assert edits(p, t[:end]) == distance


def test_against_brute_force(spark, docs_of):
    rng = random.Random(10)
    letters = "abcdefghij"
    word = lambda: "".join(rng.choice(letters) for _ in range(rng.randrange(1, 8)))
    items = [(i, " ".join(word() for _ in range(rng.choice((2, 8, 30, 50))))) for i in range(25)]
    items += [(100, None), (101, "..."), (102, ""), (103, "a b"), (104, items[3][1]), (None, "xylophone zebra quartz jumping vixen")]
    texts = [None, "", "a b", "xa b", "XYLOPHONE, zebra; quartz -- jumping_vixen"]
    for _ in range(80):
        _, item = rng.choice(items[:25])
        chars = list(item)
        for _ in range(rng.choice((0, 0, 1, 3, 6, 12))):
            at = rng.randrange(len(chars))
            chars[at:at + 1] = rng.choice(("", rng.choice(letters), chars[at] + rng.choice(letters)))
        around = [" ".join(word() for _ in range(rng.choice((0, 10, 60)))) for _ in range(2)]
        texts.append(f"{around[0]}, {''.join(chars).upper()}!\n{around[1]}")

    def holds(text, item):
        text, item = plain(text), plain(item)
        if not item:
            return False
        most = int(len(item) * D.EDIT_RATE) if len(item) >= D.LEAST_CHARS else 0
        return edits(item, text) <= most if most else f" {item} " in f" {text} "

    want = {i: sorted((k for k, item in items if holds(t, item)), key=lambda k: (k is None, k)) for i, t in enumerate(texts)}
    for block in (D.BLOCK_CHARS, 700):
        frame = D.find_items(docs_of(texts), spark.createDataFrame(items + items[:2], ITEMS), block=block)
        got = {r.doc_id: sorted((m.item_id for m in r.matches), key=lambda k: (k is None, k)) for r in frame.collect()}
        assert got == want
    left = {r.doc_id for r in D.decontaminate(docs_of(texts), spark.createDataFrame(items, ITEMS)).collect()}
    assert left == {i for i, found in want.items() if not found}


def test_empty(spark, docs_of):
    none = spark.createDataFrame([], ITEMS)
    assert D.decontaminate(docs_of(["a", None]), none).count() == 2
    assert D.decontaminate(docs_of([]), spark.createDataFrame([(1, "some text to find here please")], ITEMS)).count() == 0
    long = "filler " * 50_000 + "the needle that we look for in the hay"
    found = D.find_items(docs_of([long]).withColumnRenamed("lang", "matches"), spark.createDataFrame([(1, "The needle that we look for in the hay.")], ITEMS))
    assert found.first().matches[0].distance == 0


def test_many_blocks_are_no_deeper_plan(spark, docs_of):
    items = spark.createDataFrame([(i, f"item number {i} of a long benchmark with words {i * 7919}") for i in range(60)], ITEMS)
    found = D.find_items(docs_of(["x", "Item number 31 of a long benchmark, with words 245489!"]), items, block=200)
    assert found._jdf.queryExecution().executedPlan().toString().count("MapInArrow") == 1
    none, some = found.orderBy("doc_id").collect()
    assert not none.matches and [m.distance for m in some.matches if m.item_id == 31] == [0]
