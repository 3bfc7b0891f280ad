"""Benchmark decontamination by pigeonhole edit matching.

A text contains a test item if some passage of it lies within the item's error budget in edits.  Each
item is split into one piece more than its budget, so at least one piece of a passage within budget
is untouched.  An automaton over all pieces finds exact hits in one pass over a text, and
Myers' bit-parallel distance verifies the passage around each hit.

Items and texts are compared as lower-case words of letters and digits with one space between, so
case, punctuation and line breaks cost no edits.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from equiframe.llm.shared import Stored, slices

EDIT_RATE = 0.08
LEAST_CHARS = 24
BLOCK_CHARS = 1_000_000
SLICE_BYTES = 4 << 20
_WORD = re.compile(r"[^\W_]+")
MATCHES = "array<struct<item_id:bigint,distance:int,start:bigint,end:bigint>>"


def normalised(text: str | None) -> str:
    return " ".join(_WORD.findall((text or "").lower()))


def budget(length: int, rate: float) -> int:
    return int(length * rate)


def pieces(item: str, parts: int) -> list[tuple[int, str]]:
    """``(offset, piece)`` of ``parts`` pieces of nearly equal length."""
    cuts = [len(item) * i // parts for i in range(parts + 1)]
    return [(i, item[i:j]) for i, j in zip(cuts, cuts[1:])]


def best_distance(pattern: str, text: str, masks: dict[str, int] | None = None) -> tuple[int, int]:
    """``(distance, end)`` of the passage of ``text`` that is nearest to ``pattern``, the first of equals.

    Myers' algorithm: the column of edit distances is held as bits of vertical differences.
    """
    n = len(pattern)
    if masks is None:
        masks = {}
        for i, c in enumerate(pattern):
            masks[c] = masks.get(c, 0) | 1 << i
    full, top = (1 << n) - 1, 1 << (n - 1)
    up, down, score, best, end = full, 0, n, n, 0
    for at, c in enumerate(text):
        eq = masks.get(c, 0)
        xv = eq | down
        xh = (((eq & up) + up) ^ up) | eq
        ph = down | (full & ~(xh | up))
        mh = up & xh
        if ph & top:
            score += 1
        elif mh & top:
            score -= 1
        ph = (ph << 1) & full  # a passage may start anywhere: no cost above the first row
        mh = (mh << 1) & full
        up = mh | (full & ~(xv | ph))
        down = ph & xv
        if score < best:
            best, end = score, at + 1
    return best, end


class Matcher:
    """The automaton of one block of items ``(item_id, text)``."""

    def __init__(self, items: list[tuple[int, str]], rate: float, least: int) -> None:
        self.automaton = ahocorasick.Automaton()
        self.items = []
        held: dict[str, list[tuple[int, int]]] = {}
        for item_id, text in items:
            text = normalised(text)
            if not text:
                continue
            edits = budget(len(text), rate) if len(text) >= least else 0
            if edits == 0:
                text = f" {text} "  # a short item counts at the borders of words only
            number = len(self.items)
            self.items.append((item_id, text, edits))
            for offset, piece in pieces(text, edits + 1):
                held.setdefault(piece, []).append((number, offset))
        for piece, uses in held.items():
            self.automaton.add_word(piece, (len(piece), uses))
        if held:
            self.automaton.make_automaton()
        self.masks: dict[int, dict[str, int]] = {}

    def find(self, raw: str | None) -> list[dict]:
        """The nearest passage of each item that the text contains, by places in the normalised text."""
        if not self.items or not raw:
            return []
        text = f" {normalised(raw)} "
        windows: dict[int, list[list[int]]] = {}
        for last, (length, uses) in self.automaton.iter(text):
            for number, offset in uses:
                _, item, edits = self.items[number]
                start = last + 1 - length - offset - edits
                span = [max(0, start), min(len(text), start + len(item) + 2 * edits)]
                runs = windows.setdefault(number, [])
                if runs and span[0] <= runs[-1][1]:  # hits come in order, so windows that overlap are neighbours
                    runs[-1] = [min(span[0], runs[-1][0]), max(span[1], runs[-1][1])]
                else:
                    runs.append(span)
        found = []
        for number, runs in windows.items():
            item_id, item, edits = self.items[number]
            if number not in self.masks:
                self.masks[number] = {c: sum(1 << i for i, x in enumerate(item) if x == c) for c in set(item)}
            best = None
            for low, high in runs:
                distance, end = (0, high - low) if edits == 0 else best_distance(item, text[low:high], self.masks[number])
                if distance <= edits and (best is None or distance < best["distance"]):
                    best = {"item_id": item_id, "distance": distance, "start": max(0, low + end - len(item) - 1), "end": low + end - 1}
            if best:
                found.append(best)
        return sorted(found, key=lambda m: (m["item_id"] is None, m["item_id"]))


def blocks_of(benchmark: DataFrame, item: str, text: str, most: int = BLOCK_CHARS) -> Iterator[list[tuple[int, str]]]:
    """The items in blocks of about ``most`` characters, so that what a task holds is bounded.

    Blocks follow from a hash of the item; each is read by a job of its own.
    """
    items = benchmark.select(F.col(item).alias("item"), F.col(text).alias("text")).filter(F.col("text").isNotNull()).distinct()
    total = items.agg(F.sum(F.length("text"))).first()[0] or 0
    count = -(-total // most)
    for i in range(count):
        part = items.filter(F.pmod(F.xxhash64("item", "text"), F.lit(count)) == i)
        yield sorted(((r["item"], r["text"]) for r in part.collect()), key=repr)


def find_items(
    docs: DataFrame, benchmark: DataFrame, text: str = "text", item: str = "item_id", item_text: str = "text",
    rate: float = EDIT_RATE, least: int = LEAST_CHARS, block: int = BLOCK_CHARS,
) -> DataFrame:
    """All columns of ``docs`` and ``matches``, one row per row.

    ``matches`` lists ``(item_id, distance, start, end)`` of every item that the whole text contains within
    ``rate`` edits per character, the nearest passage each, in places of the normalised text.  Items of
    fewer than ``least`` characters have to occur exactly, at borders of words; items without letters or
    digits never match, nor do null texts.  Repeated items are one.
    A column ``matches`` of ``docs`` is replaced.  Items come in blocks, and a block is one
    pass over the texts that appends its matches to those before.  Between two blocks the rows are written, so a
    task holds one automaton at a time, however many items there are.
    """
    done = docs.drop("matches").withColumn("matches", F.array().cast(MATCHES))
    held = None
    for number, items in enumerate(blocks_of(benchmark, item, item_text, block)):
        if number:
            last, held = held, Stored(done, "matched")
            done = held.frame
            if last:
                last.drop()
        done = _with_block(done, text, items, rate, least)
    return done


def _with_block(docs: DataFrame, text: str, items: list[tuple[int, str]], rate: float, least: int) -> DataFrame:
    names = docs.columns
    at, held = names.index(text), names.index("matches")

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = None
        for batch in slices(batches, text, SLICE_BYTES):
            matcher = matcher or Matcher(items, rate, least)
            old = batch.column(held)
            found = [matcher.find(value.as_py()) for value in batch.column(at)]
            joined = pa.array([[*(was.as_py() or []), *new] for was, new in zip(old, found)], old.type)
            yield pa.RecordBatch.from_arrays(
                [joined if i == held else c for i, c in enumerate(batch.columns)], names=names)

    return docs.mapInArrow(find, T.StructType(docs.schema.fields))


def decontaminate(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """``docs`` without the rows that contain a test item."""
    return find_items(docs, benchmark, **options).filter(F.size("matches") == 0).drop("matches")
