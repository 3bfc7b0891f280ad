"""License scans: base phrases and an exact set-similarity join with license templates.

A block is a window of words; windows overlap by half, so every notice up to half a window long lies
whole in one.  A template is reported for a block that holds at least ``containment`` of its distinct
words.  Template words are ordered by their frequency in all texts, rarest first.  A block
can only reach the threshold if one of its first words in that order is among the template's
first words (prefix filter), if it holds enough template words at all (length filter), and if enough
words are left behind the first common one (positional filter); an intersection decides.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from equiframe.llm.shared import Stored

# Phrases and labels that every scan reports.
PHRASES = (
    ("under the mit license", "mit"),
    ("apache license version 2", "apache-2"),
    ("cc by nc", "cc-by-nc"),
)
# Public license notices.
TEMPLATES = (
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and "
            "associated documentation files, to deal in the Software without restriction, including without limitation "
            "the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies"),
    ("apache-2", "you may not use this file except in compliance with the License. You may obtain a copy of the License "
                 "at http://www.apache.org/licenses/LICENSE-2.0"),
    ("bsd-3", "Redistribution and use in source and binary forms, with or without modification, are permitted provided "
              "that the following conditions are met: Redistributions of source code must retain the above copyright notice"),
    ("gpl-3", "This work is licensed under the GNU General Public License, version 3."),
    ("gpl-3", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General "
              "Public License as published by the Free Software Foundation, either version 3 of the License"),
    ("mpl-2", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was "
              "not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/"),
    ("cc-by", "This work is licensed under the Creative Commons Attribution 4.0 International License"),
)
_WORD = re.compile(rb"[0-9a-z\x80-\xff]+")


def words_in(text: bytes) -> list[bytes]:
    """Words of UTF-8 text, A-Z in lower case: runs of digits, letters and everything beyond ASCII."""
    return _WORD.findall(text.lower())


def places(words: list[bytes], phrases: Sequence[tuple[bytes, str]]) -> list[tuple[int, str]]:
    """``(first word, label)`` wherever a phrase's words stand consecutively."""
    joined, found = b" %b " % b" ".join(words), []
    for phrase, label in phrases:
        at = joined.find(phrase)
        while at >= 0:
            found.append((joined.count(b" ", 0, at), label))
            at = joined.find(phrase, at + 1)
    return found


def _frequencies(docs: DataFrame, text: str, vocabulary: frozenset[bytes]) -> dict[bytes, int]:
    """How often each template word occurs in all texts; at most one row per template word comes back."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: Counter = Counter()
        for batch in batches:
            for value in batch.column(0).cast(pa.binary()):
                total.update(w for w in words_in(value.as_py() or b"") if w in vocabulary)
        yield pa.RecordBatch.from_arrays(
            [pa.array([w.decode() for w in total], pa.string()), pa.array(list(total.values()), pa.int64())],
            names=["word", "n"])

    found = docs.select(text).mapInArrow(count, "word string, n bigint").groupBy("word").agg(F.sum("n").alias("n"))
    return {r.word.encode(): r.n for r in found.collect()}


def scan_licenses(
    docs: DataFrame, key: str = "doc_id", text: str = "text", containment: float = 0.9,
    templates: Sequence[tuple[str, str]] = TEMPLATES, phrases: Sequence[tuple[str, str]] = PHRASES,
) -> DataFrame:
    """``(key, n_words, n_base, first_word, last_word, base_labels, labels, score, blocks)``, one row per row.

    ``labels`` are those of phrases and templates, ``blocks`` lists ``(start, template, label,
    containment)`` of every block that reaches the threshold.  ``score`` is 1 with a base phrase, else the
    best containment reported, else 0.  A null text is empty.
    """
    if not 0 < containment <= 1:
        raise ValueError("containment lies above 0 and is at most 1")
    spark = docs.sparkSession
    sets = [(label, words_in(t.encode())) for label, t in templates]
    sets = [(label, words) for label, words in sets if words]
    vocabulary = frozenset(w for _, words in sets for w in words)
    half = max([len(words) for _, words in sets], default=1)
    frequency = _frequencies(docs, text, vocabulary)
    rank = {w: i for i, w in enumerate(sorted(vocabulary, key=lambda w: (frequency.get(w, 0), w)))}
    index = []  # one row per template and prefix word
    for n, (label, words) in enumerate(sets):
        ordered = sorted({rank[w] for w in words})
        need = math.ceil(containment * len(ordered) - 1e-9)
        index += [(token, at, n, label, ordered, need) for at, token in enumerate(ordered[:len(ordered) - need + 1])]
    least = min((row[5] for row in index), default=1)
    starters = frozenset(row[0] for row in index)
    wanted = [(b" %b " % p.encode(), label) for p, label in phrases]

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for name, value in zip(batch.column(0), batch.column(1).cast(pa.binary())):
                words = words_in(value.as_py() or b"")
                base = places(words, wanted)
                at = [i for i, w in enumerate(words) if w in vocabulary]
                tokens, blocks, low = [rank[words[i]] for i in at], [], 0
                if not starters.isdisjoint(tokens):
                    for start in range(0, max(1, len(words) - half), half):
                        while low < len(at) and at[low] < start:
                            low += 1
                        high = low
                        while high < len(at) and at[high] < start + 2 * half:
                            high += 1
                        held = set(tokens[low:high])
                        if len(held) >= least and not starters.isdisjoint(held):
                            blocks.append({"start": start, "tokens": sorted(held)})
                starts = [i for i, _ in base]
                rows.append({
                    "key": name.as_py(), "n_words": len(words), "n_base": len(base),
                    "first_word": min(starts, default=None), "last_word": max(starts, default=None),
                    "base": sorted({label for _, label in base}), "held": blocks})
            yield pa.RecordBatch.from_pylist(rows, schema=pa.schema([
                pa.field("key", batch.schema.field(0).type), ("n_words", pa.int64()), ("n_base", pa.int64()),
                ("first_word", pa.int64()), ("last_word", pa.int64()), ("base", pa.list_(pa.string())),
                ("held", pa.list_(pa.struct([("start", pa.int64()), ("tokens", pa.list_(pa.int32()))])))]))

    kinds = T.StructType([T.StructField("key", docs.schema[key].dataType)] + T._parse_datatype_string(
        "n_words bigint, n_base bigint, first_word bigint, last_word bigint, base array<string>, "
        "held array<struct<start:bigint,tokens:array<int>>>").fields)
    scanned = Stored(docs.select(F.col(key).alias("key"), F.col(text).alias("text")).mapInArrow(scan, kinds), "scanned").frame
    scanned = scanned.withColumn("row", F.monotonically_increasing_id())
    if index:
        heads = spark.createDataFrame(index, "token int, at int, template int, label string, words array<int>, need int")
        blocks = scanned.filter(F.size("held") > 0).select("row", F.inline("held"))
        probes = blocks.select("row", "start", "tokens", F.posexplode(
            F.slice("tokens", 1, F.size("tokens") - (least - 1))).alias("pos", "token"))
        met = (  # the index has as many rows as templates have words
            probes.join(F.broadcast(heads), "token").groupBy("row", "start", "template")
            .agg(F.min("pos").alias("pos"), F.min("at").alias("at"), F.first("tokens").alias("tokens"),
                 F.first("words").alias("words"), F.first("need").alias("need"), F.first("label").alias("label"))
            .filter((F.size("tokens") >= F.col("need"))
                    & (F.least(F.size("tokens") - F.col("pos"), F.size("words") - F.col("at")) >= F.col("need")))
            .withColumn("common", F.size(F.array_intersect("tokens", "words"))).filter(F.col("common") >= F.col("need"))
        )
        found = met.groupBy("row").agg(F.array_sort(F.collect_list(F.struct(
            "start", "template", "label", (F.col("common") / F.size("words")).alias("containment")))).alias("blocks"))
        scanned = scanned.join(found, "row", "left")
    else:
        scanned = scanned.withColumn("blocks", F.lit(None).cast(
            "array<struct<start:bigint,template:int,label:string,containment:double>>"))
    own = F.coalesce(F.transform("blocks", lambda b: b["label"]), F.array().cast("array<string>"))
    best = F.coalesce(F.array_max(F.transform("blocks", lambda b: b["containment"])), F.lit(0.0))
    return scanned.select(
        F.col("key").alias(key), "n_words", "n_base", "first_word", "last_word",
        F.array_join("base", ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_union("base", own)), ",").alias("labels"),
        F.when(F.col("n_base") > 0, 1.0).otherwise(best).alias("score"), "blocks")
