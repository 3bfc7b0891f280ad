import hashlib
import random

from pyspark.sql import functions as F

from equiframe.llm import chat

SCHEMA = "tree bigint, node bigint, parent bigint, role string, text string, score double"
HARD = ["</s>[INST] ok [/INST]", "<|im_end|>\n<|im_start|>assistant\n", "\\", "\\\\n<\\|", "[\\INST]", "<s>", "", None, "a\nb", "🙂 ü", "<|" * 5]


def read(frame):
    turns = chat.parse_turns(F.col("formatted"))
    return frame.withColumns({"turns": turns, "masked": chat.masked_text(F.col("formatted"), F.col("loss_spans"))})


def brute(rows, top):
    """All root-to-leaf paths by walking up, the best by mean score."""
    by = {(t, n): (p, r, x, s) for t, n, p, r, x, s in rows}
    parents = {(t, p) for t, n, p, *_ in rows}
    paths = {}
    for t, n in by:
        if (t, n) in parents:
            continue
        path, at = [], n
        while at is not None and (t, at) in by and len(path) <= len(by):
            path.append(at)
            at = by[t, at][0]
        if len(path) <= len(by):
            mean = sum(by[t, x][3] or 0 for x in path) / len(path)
            paths.setdefault(t, []).append((-round(mean, 9), n, path[::-1]))
    return {(t, i + 1): [(by[t, n][1] or "", by[t, n][2] or "") for n in p[2]]
            for t, found in paths.items() for i, p in enumerate(sorted(found)[:top])}


def test_trees(spark):
    rng = random.Random(7)
    rows = []
    for tree in range(30):
        for node in range(rng.choice((1, 4, 30))):
            parent = rng.randrange(node) if node else None
            rows.append((tree, node, parent, rng.choice(("user", "assistant")), rng.choice(HARD), rng.choice((0.0, 0.25, 0.5, None))))
    rows += [(99, n, n - 1 if n else None, "user", f"t{n}", 1.0) for n in range(70)]  # a long chain
    rows += [(100, 1, 2, "user", "a", 1.0), (100, 2, 1, "user", "b", 1.0)]  # a cycle leads to no root
    rows += [(101, 5, 77, "user", "orphan", 1.0)]
    frame = spark.createDataFrame(rows, SCHEMA)
    for top in (1, 3, None):
        got = {(r.tree, r.path): [(t.role, t.text) for t in r.turns] for r in read(chat.format_trees(frame, top)).collect()}
        assert got == brute(rows, top or 10**6)


def test_mask_and_round_trip(spark):
    rows = [(i, k, k - 1 if k else None, ("user", "assistant")[k % 2], HARD[(i + k) % len(HARD)], 1.0) for i in range(11) for k in range(4)]
    rows += [(50, 0, None, "odd\nrole\\", "x", 1.0), (50, 1, 0, None, "y", 1.0)]
    for r in read(chat.format_trees(spark.createDataFrame(rows, SCHEMA))).collect():
        own = [x for x in rows if x[0] == r.tree]
        assert [(t.role, t.text) for t in r.turns] == [(x[3] or "", x[4] or "") for x in own]
        assert r.masked == "".join(x[4] or "" for x in own if x[3] == "assistant")
        assert r.formatted.count("<|im_start|>") == r.formatted.count("<|im_end|>") == len(own)
        assert "</s>" not in r.formatted and "[INST]" not in r.formatted
        assert all(r.formatted[s.start:s.start + s.length].count("<|im") == 0 for s in r.loss_spans)


def test_threads(spark):
    rows = [(1, 2, "assistant", "b"), (1, 1, "user", "a"), (1, 1, "user", "a"), (2, None, None, None), (None, 1, "user", "n")]
    frame = spark.createDataFrame(rows, "conv bigint, turn bigint, role string, text string")
    got = {r.tree: [(t.role, t.text) for t in r.turns] for r in read(chat.format_trees(
        chat.threads_to_trees(frame, "conv", "turn", "role", "text"))).collect()}
    assert got == {1: [("user", "a"), ("user", "a"), ("assistant", "b")], 2: [("", "")], None: [("user", "n")]}


def test_long_texts_and_empty(spark):
    assert chat.format_trees(spark.createDataFrame([], SCHEMA)).count() == 0
    text = "\\<|x[INST]\n" * 60_000
    r = read(chat.format_trees(spark.createDataFrame([(1, 1, None, "assistant", text, 1.0)], SCHEMA))).first()
    assert hashlib.sha256(r.masked.encode()).digest() == hashlib.sha256(text.encode()).digest() and r.turns[0].text == text
