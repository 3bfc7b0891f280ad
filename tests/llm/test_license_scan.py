import random
import re
from collections import Counter

from equiframe.llm import license_scan as L

FILL = "the of and to a in is this copy any code file work for with or under license software notice".split()


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute(text, containment=0.9):
    w, base = words(text), []
    for phrase, label in L.PHRASES:
        p = phrase.split()
        base += [(i, label) for i in range(len(w) - len(p) + 1) if w[i:i + len(p)] == p]
    sets = [(label, set(words(t))) for label, t in L.TEMPLATES]
    half, best, labels = max(len(words(t)) for _, t in L.TEMPLATES), 0.0, {label for _, label in base}
    for start in range(0, max(1, len(w) - half), half):
        block = set(w[start:start + 2 * half])
        for label, t in sets:
            share = len(block & t) / len(t)
            if share >= containment - 1e-9:
                labels.add(label)
                best = max(best, share)
    starts = [i for i, _ in base]
    return (len(w), len(base), min(starts, default=None), max(starts, default=None), ",".join(sorted({x for _, x in base})),
            ",".join(sorted(labels)), 1.0 if base else best)


def test_against_brute_force(docs_of):
    rng = random.Random(8)
    texts = [None, "", "...", "Released under the MIT License.", "apache-license Version 2.0 CC-BY-NC cc by nc by nc", "CC BY\n\nNC",
             "under the mit licenses", "ünder the MIT license", "under the mit license under the MIT\tlicense", "same", "same"]
    for _ in range(60):
        _, template = rng.choice(L.TEMPLATES)
        notice = template.split()
        for _ in range(rng.choice((0, 1, 3, 8))):
            notice[rng.randrange(len(notice))] = rng.choice(FILL)
        lead = [rng.choice(FILL) for _ in range(rng.choice((0, 5, 70, 400)))]
        texts.append(" ".join(lead + notice + lead[::-1]))
    texts += [" ".join(rng.choice(FILL) for _ in range(20_000))]
    got = {r.doc_id: tuple(r)[1:-1] for r in L.scan_licenses(docs_of(texts)).collect()}
    assert got == {i: brute(t) for i, t in enumerate(texts)}
    assert len(Counter(v[5] for v in got.values())) > 6


def test_rows_stay_apart(spark, docs_of):
    rows = [(1, "Licensed under the MIT license", "en", "s"), (1, "nothing", "en", "s"), (None, L.TEMPLATES[3][1], "en", "s")]
    got = sorted((str(r.doc_id), r.labels) for r in L.scan_licenses(docs_of(rows).withColumnRenamed("lang", "labels")).collect())
    assert got == [("1", ""), ("1", "mit"), ("None", "gpl-3")]
    assert L.scan_licenses(docs_of([])).count() == 0
    assert L.scan_licenses(docs_of(["cc by nc"]), templates=()).first().labels == "cc-by-nc"
