"""Periodic runs of words, found by Baier's grouping.

The first phase of Baier's suffix sorter groups the suffixes of a sequence by their longest Lyndon
prefix, from the highest group down.  A suffix joins a new group when the group to its right is
finished, and its prefix grows by that group's prefix.  The lengths at the end are the Lyndon array.  Done under
an order of the words and under its reverse, one of the two arrays holds the Lyndon root of every run at
each place where the root stands.  Roots that stand twice in a row are extended to both sides as far as
words a period apart agree, which gives the run.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from equiframe.llm.shared import free_name, slices

LEAST_LENGTH, LEAST_EXPONENT = 6, 4
SLICE_BYTES = 4 << 20
FOUND = ("n_runs bigint, start bigint, length bigint, period bigint, exponent_milli bigint, "
         "runs_sha256 string, collapsed_sha256 string")


def lyndon_lengths(symbols: list[int], descending: bool = False) -> list[int]:
    """Length of the longest Lyndon word that starts at each place, by phase one of Baier's sorter."""
    n = len(symbols)
    lengths, group = [1] * n, list(symbols)
    members: dict[int, list[int]] = {}
    for i, s in enumerate(symbols):
        if s in members:
            members[s].append(i)
        else:
            members[s] = [i]
    ranked = sorted(members, reverse=descending)
    size = {s: len(m) for s, m in members.items()}
    lower = dict(zip(ranked[1:], ranked))
    upper = dict(zip(ranked, ranked[1:]))
    fresh = max(ranked, default=0) + 1
    near = [*range(n), -1]  # the nearest place to the left, itself included, whose group is not finished
    at = ranked[-1] if ranked else None
    while at is not None:
        own = [i for i in members.pop(at) if group[i] == at]
        if own:
            grown, hits = lengths[own[0]], {}
            for i in own:
                near[i] = i - 1
            for i in own:
                j = i - 1
                while near[j] != j:
                    near[j] = near[near[j]]
                    j = near[j]
                if j >= 0:
                    hits[j] = hits.get(j, 0) + 1
            moved: dict[tuple[int, int], list[int]] = {}
            for j, times in hits.items():
                lengths[j] += times * grown
                where = (times, group[j])
                if where in moved:
                    moved[where].append(j)
                else:
                    moved[where] = [j]
            # Those hit most often become the highest: they are put right above their old group first.
            for times, old in sorted(moved, reverse=True) if len(moved) > 1 else moved:
                places = moved[times, old]
                if len(places) == size[old]:
                    continue  # the whole group moves on together
                size[old] -= len(places)
                size[fresh], members[fresh] = len(places), places
                for j in places:
                    group[j] = fresh
                above = upper.get(old)
                lower[fresh], upper[old] = old, fresh
                if above is not None:
                    upper[fresh], lower[above] = above, fresh
                fresh += 1
        at = lower.get(at)
    return lengths


def segments(codes: np.ndarray, times: int = LEAST_EXPONENT, least: int = LEAST_LENGTH) -> Iterator[tuple[int, int]]:
    """Stretches ``(start, end)`` in which runs lie: a run holds each of its words as often as its period fits into it,
    so words that a stretch holds less often cut it."""
    open_parts = [(0, len(codes))]
    while open_parts:
        start, end = open_parts.pop()
        if end - start < least:
            continue
        part = codes[start:end]
        _, place, counts = np.unique(part, return_inverse=True, return_counts=True)
        rare = counts[place] < times
        if not rare.any():
            yield start, end
            continue
        cuts = np.concatenate([[-1], np.flatnonzero(rare), [len(part)]])
        open_parts += [(start + int(a) + 1, start + int(b)) for a, b in zip(cuts, cuts[1:]) if b - a > least]


def runs_of(codes: np.ndarray, times: int = LEAST_EXPONENT, least: int = LEAST_LENGTH) -> list[tuple[int, int, int]]:
    """``(start, length, period)`` of all maximal runs of ``times`` periods and ``least`` places at least, sorted.

    The period is the smallest one.  ``times`` has to be 4 or more, so that a root stands three times in its run.
    """
    found = set()
    for offset, end in segments(codes, times, least):
        part = codes[offset:end].tolist()
        n = len(part)
        for descending in (False, True):
            roots = np.array(lyndon_lengths(part, descending))
            following = np.arange(n) + roots
            twice = following < n
            twice[twice] = roots[following[twice]] == roots[twice]
            reached: dict[int, int] = {}
            for i in np.flatnonzero(twice & (roots * times <= n)).tolist():
                q = int(roots[i])
                if i + q <= reached.get(q, 0):
                    continue  # this root lies in the stretch that the one before was extended to
                low, high = i, i + q
                while high < n and part[high] == part[high - q]:
                    high += 1
                while low and part[low - 1] == part[low - 1 + q]:
                    low -= 1
                reached[q] = high
                if high - low >= max(least, times * q):
                    found.add((offset + low, high - low, q))
    return sorted(found, key=lambda r: (r[0], r[2]))


def _described(raw: bytes, times: int, least: int) -> dict:
    words = raw.split()  # bytes are split at space and 0x09 to 0x0D
    known: dict[bytes, int] = {}
    codes = np.fromiter((known.setdefault(w, len(known)) for w in words), dtype=np.int64, count=len(words))
    runs = runs_of(codes, times, least)
    kept = words
    if runs:
        stays = np.ones(len(words), bool)
        for start, length, period in runs:
            stays[start + period:start + length] = False
        kept = [w for w, s in zip(words, stays.tolist()) if s]
    start, length, period = min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=(None, None, None))
    return {
        "runs": [{"start": s, "length": n, "period": q} for s, n, q in runs],
        "n_runs": len(runs), "start": start, "length": length, "period": period,
        "exponent_milli": None if start is None else 1000 * length // period,
        "runs_sha256": hashlib.sha256("".join(f"{s},{n},{q}\n" for s, n, q in runs).encode()).hexdigest(),
        "collapsed_sha256": hashlib.sha256(b" ".join(kept)).hexdigest(), "collapsed": b" ".join(kept)}


def find_runs(
    docs: DataFrame, text: str = "text", times: int = LEAST_EXPONENT, least: int = LEAST_LENGTH, texts: bool = False,
) -> DataFrame:
    """All columns of ``docs`` and the runs of its whole texts, one row per row.

    A run is a stretch of consecutive words (between space and 0x09 to 0x0D) with smallest period q, of at least
    ``least`` words and ``times`` periods (4 or more), that no neighbouring word extends.  ``n_runs`` counts
    them; ``start, length, period, exponent_milli`` describe the one with the greatest length over
    period, the smallest start and then the smallest period of equals, and are null without one.
    ``collapsed_sha256`` digests the words that lie in no run behind its first period, joined by a space, and
    ``runs_sha256`` a line ``start,length,period`` per run.  With ``texts`` the columns ``runs`` and
    ``collapsed`` hold both.  Null text has no words.  Columns of these names in ``docs`` are replaced.
    """
    if times < 4:
        raise ValueError("runs of fewer than four periods are not supported")
    added = T.StructType.fromDDL(FOUND + (", runs array<struct<start:bigint,length:bigint,period:bigint>>, collapsed string" if texts else ""))
    kept = docs.drop(*added.names)
    whole = free_name(kept, "_text")
    at = len(kept.columns)

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        schema = to_arrow_schema(added)
        for batch in slices(batches, whole, SLICE_BYTES):
            rows = []
            for value in batch.column(at).cast(pa.binary()):
                row = _described(value.as_py() or b"", times, least)
                if texts:
                    row["collapsed"] = row["collapsed"].decode()
                rows.append({name: row[name] for name in added.names})
            new = pa.RecordBatch.from_pylist(rows, schema=schema)
            yield pa.RecordBatch.from_arrays([*batch.columns[:at], *new.columns], names=[*batch.schema.names[:at], *added.names])

    return kept.withColumn(whole, F.col(text)).mapInArrow(fold, T.StructType([*kept.schema.fields, *added.fields]))
