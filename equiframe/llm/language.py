"""Language identification of mixed texts.

Every word gets a score per language from a model of letter pairs and triples.  The ranges of the
word's script leave out languages that are not written in it.  Viterbi over the words, with a
penalty for each switch, labels spans; the language that labels most letters is the text's.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from equiframe.llm.shared import free_name, slices

# First and last code points of letters by script; what lies in none is script 0.
SCRIPTS = (
    (0x0041, 0x024F), (0x0370, 0x03FF), (0x0400, 0x052F), (0x0530, 0x058F), (0x0590, 0x05FF), (0x0600, 0x06FF),
    (0x0900, 0x097F), (0x0980, 0x09FF), (0x0A00, 0x0A7F), (0x0A80, 0x0AFF), (0x0B80, 0x0BFF), (0x0C00, 0x0C7F),
    (0x0E00, 0x0E7F), (0x10A0, 0x10FF), (0x1100, 0x11FF), (0x1E00, 0x1EFF), (0x3040, 0x30FF), (0x3400, 0x9FFF),
    (0xAC00, 0xD7AF),
)
BUCKETS = 1 << 15
MOST_LANGUAGES = 500
UNDETERMINED = "und"
SLICE_BYTES = 4 << 20
_WORD = re.compile(r"[^\W\d_]+")


def held_out(key: Column) -> Column:
    """A quarter of all rows by their key, which no model has seen; null keys are not held out."""
    return F.coalesce(F.crc32(F.encode(key.cast("string"), "UTF-8")) % 4 == 2, F.lit(False))


def grams(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """``(word number, bucket)`` of each pair and triple of letters; a word's ends count as letters."""
    text = np.frombuffer(f"\0{'\0'.join(words)}\0".encode("utf-32-le"), dtype=np.uint32).astype(np.uint64)
    number = np.cumsum(text == 0) - 1
    inside = text != 0
    pair = (text[:-1] * np.uint64(2654435761) + text[1:] * np.uint64(40503)) >> np.uint64(3)
    kept = inside[1:] | inside[:-1]
    triple = (text[:-2] * np.uint64(2654435761) + text[1:-1] * np.uint64(2246822519) + text[2:] * np.uint64(3266489917)) >> np.uint64(5)
    owner = np.where(inside[1:], number[1:], number[:-1])
    buckets = np.concatenate([(pair[kept] * np.uint64(2)) % np.uint64(BUCKETS),
                              (triple[inside[1:-1]] * np.uint64(2) + np.uint64(1)) % np.uint64(BUCKETS)])
    return np.concatenate([owner[kept], number[1:-1][inside[1:-1]]]), buckets.astype(np.int64)


def scripts_of(words: list[str]) -> np.ndarray:
    """The script of each word's first letter, 0 for one of none."""
    first = np.array([ord(w[0]) for w in words], dtype=np.int64)
    starts = np.array([s for s, _ in SCRIPTS])
    at = np.searchsorted(starts, first, side="right") - 1
    ends = np.array([e for _, e in SCRIPTS])
    return np.where((at >= 0) & (first <= ends[np.maximum(at, 0)]), at + 1, 0)


class Model:
    """Log-probabilities of gram buckets per language, and the scripts of each language."""

    def __init__(self, languages: list[str], counts: np.ndarray, scripts: np.ndarray) -> None:
        self.languages = languages
        smooth = counts + 0.5
        self.logs = np.log(smooth / smooth.sum(axis=0)).astype(np.float32)  # (BUCKETS, languages)
        share = scripts / np.maximum(1, scripts.sum(axis=0))
        self.written = (share >= 0.01).T if len(languages) else np.zeros((0, len(SCRIPTS) + 1), bool)  # (languages, scripts)

    def scores(self, words: list[str]) -> np.ndarray:
        """``(words, languages)``: half the summed logarithms, as each letter counts in pairs and in triples."""
        owner, buckets = grams(words)
        found = np.stack([np.bincount(owner, self.logs[buckets, k], minlength=len(words))
                          for k in range(len(self.languages))], axis=1) / 2
        fits = self.written[:, scripts_of(words)].T
        nobody = ~fits.any(axis=1)
        found[nobody] = 0.0
        return np.where(fits | nobody[:, None], found, found - 1e4).astype(np.float32)


def viterbi(scores: np.ndarray, starts: np.ndarray, sizes: np.ndarray, penalty: float) -> np.ndarray:
    """The best label of each word; texts are runs ``starts, sizes`` of the rows of ``scores``.

    All texts advance together, the longest first, so a step is one operation on arrays.
    """
    order = np.argsort(-sizes, kind="stable")
    starts, sizes = starts[order], sizes[order]
    total, kinds = scores.shape
    back = np.zeros((total, kinds), dtype=np.int16)
    labels = np.zeros(total, dtype=np.int16)
    longest = int(sizes[0]) if len(sizes) else 0
    active = np.searchsorted(-sizes, -np.arange(longest), side="left")  # texts longer than t
    current, own = np.zeros((len(sizes), kinds), dtype=np.float64), np.arange(kinds, dtype=np.int16)
    for t in range(longest):
        m = active[t]
        now = current[:m]
        rows = starts[:m] + t
        if t:
            best = now.argmax(axis=1)
            switched = now[np.arange(m), best] - penalty
            stays = now >= switched[:, None]
            back[rows] = np.where(stays, own, best[:, None])
            now = np.where(stays, now, switched[:, None])
        current[:m] = now + scores[rows]
    state = current.argmax(axis=1) if kinds else np.zeros(len(sizes), dtype=np.int64)
    for t in range(longest - 1, -1, -1):
        m = active[t]
        rows = starts[:m] + t
        labels[rows] = state[:m]
        if t:
            state[:m] = back[rows, state[:m]]
    return labels


def train(
    docs: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang", sample: int = 4_000,
) -> Model:
    """A model from rows with a language that are not held out.

    About ``sample`` rows of each language are used, chosen by a hash of the key: a bounded sample,
    whatever the table's size.  What reaches the driver is the model, a table of fixed size
    per language; over ``MOST_LANGUAGES`` labels are refused.
    """
    known = docs.filter(F.col(lang).isNotNull() & F.col(text).isNotNull() & F.col(key).isNotNull() & ~held_out(F.col(key)))
    known = known.select(F.col(key).alias("key"), F.col(text).alias("text"), F.col(lang).alias("lang"))
    sizes = known.groupBy("lang").count().limit(MOST_LANGUAGES + 1).collect()
    if len(sizes) > MOST_LANGUAGES:
        raise ValueError(f"over {MOST_LANGUAGES} languages")
    languages = sorted(r["lang"] for r in sizes)
    if not languages:
        return Model([], np.zeros((BUCKETS, 0)), np.zeros((len(SCRIPTS) + 1, 0)))
    place = {name: i for i, name in enumerate(languages)}
    share = F.create_map(*[F.lit(x) for r in sizes for x in (r["lang"], min(1.0, sample / r["count"]))])
    chosen = known.filter(F.pmod(F.xxhash64("key"), F.lit(1 << 20)) < F.element_at(share, F.col("lang")) * (1 << 20))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        width = BUCKETS + len(SCRIPTS) + 1
        total = np.zeros((len(languages), width), dtype=np.int64)
        for batch in slices(batches, "text", SLICE_BYTES):
            for name, value in zip(batch.column(1).to_pylist(), batch.column(0).to_pylist()):
                if words := _WORD.findall(value.lower()):
                    total[place[name], :BUCKETS] += np.bincount(grams(words)[1], minlength=BUCKETS)
                    total[place[name], BUCKETS:] += np.bincount(scripts_of(words), minlength=len(SCRIPTS) + 1)
        which, at = np.nonzero(total)
        yield pa.RecordBatch.from_arrays(
            [pa.array(which.astype(np.int32)), pa.array(at.astype(np.int32)), pa.array(total[which, at])],
            names=["which", "at", "n"])

    summed = chosen.select("text", "lang").mapInArrow(count, "which int, at int, n bigint").groupBy("which", "at").agg(
        F.sum("n").alias("n")).toArrow()
    table = np.zeros((BUCKETS + len(SCRIPTS) + 1, len(languages)))
    table[summed["at"].to_numpy(), summed["which"].to_numpy()] = summed["n"].to_numpy()
    return Model(languages, table[:BUCKETS], table[BUCKETS:])


def identify(
    docs: DataFrame, model: Model, key: str = "doc_id", text: str = "text", penalty: float = 12.0,
    spans: bool = False,
) -> DataFrame:
    """All columns of ``docs`` and ``lang_pred, score, fits`` (and ``spans``), one row per row.

    ``lang_pred`` is the language that labels most letters of the whole text, ``und`` for a text that is
    null or has no letter, and for every text if nothing could be learned.  ``score`` is the share of letters
    that it labels and whose script it is written in, ``fits`` that share over all languages of a mixed text.  ``spans`` lists ``(start, end, lang)`` in
    characters.  Columns of these names in ``docs`` are replaced.
    """
    added = ["lang_pred", "score", "fits", *["spans"] * spans]
    kept = docs.drop(*added)
    names, whole = kept.columns, free_name(kept, "_text")
    at = len(names)

    def label(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, whole, SLICE_BYTES):
            seen: dict[str, int] = {}
            ids, sizes, offsets = [], [], []
            for value in batch.column(at).to_pylist():
                lowered = (value or "")
                if spans:
                    found = [(m.start(), m.end()) for m in _WORD.finditer(lowered)]
                    offsets.append(found)
                    words = [lowered[i:j].lower() for i, j in found]
                else:
                    words = _WORD.findall(lowered.lower())
                ids.append(np.fromiter((seen.setdefault(w, len(seen)) for w in words), dtype=np.int64, count=len(words)))
                sizes.append(len(words))
            predicted, shares, fits, pieces = _label(list(seen), ids, np.array(sizes, dtype=np.int64), offsets)
            columns = [*batch.columns[:at], pa.array(predicted, pa.string()), pa.array(shares, pa.float64()), pa.array(fits, pa.float64())]
            if spans:
                columns.append(pa.array(pieces, pa.list_(pa.struct(
                    [("start", pa.int64()), ("end", pa.int64()), ("lang", pa.string())]))))
            yield pa.RecordBatch.from_arrays(columns, names=[*names, *added])

    def _label(unique: list[str], ids: list[np.ndarray], sizes: np.ndarray, offsets: list) -> tuple[list, list, list, list]:
        known = model.languages
        if not unique or not known:
            return [UNDETERMINED] * len(ids), [0.0] * len(ids), [0.0] * len(ids), [[] for _ in ids]
        flat = np.concatenate(ids)
        table = model.scores(unique)
        starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
        labels = viterbi(table[flat], starts, sizes, penalty)
        length = np.array([len(w) for w in unique])[flat]
        fits = model.written[:, scripts_of(unique)].T[flat, labels]
        text_of = np.repeat(np.arange(len(ids)), sizes)
        held = np.bincount(text_of * len(known) + labels, length, minlength=len(ids) * len(known)).reshape(len(ids), -1)
        sure = np.bincount(text_of * len(known) + labels, length * fits, minlength=len(ids) * len(known)).reshape(len(ids), -1)
        best = held.argmax(axis=1)
        letters = np.maximum(1, held.sum(axis=1))
        share, fitting = sure[np.arange(len(ids)), best] / letters, sure.sum(axis=1) / letters
        predicted = [known[b] if n else UNDETERMINED for b, n in zip(best, sizes)]
        pieces = []
        if spans:
            for start, places in zip(starts, offsets):
                runs: list[dict] = []
                for (i, j), k in zip(places, labels[start:start + len(places)]):
                    if runs and runs[-1]["lang"] == known[k]:
                        runs[-1]["end"] = j
                    else:
                        runs.append({"start": i, "end": j, "lang": known[k]})
                pieces.append(runs)
        return predicted, [float(s) if n else 0.0 for s, n in zip(share, sizes)], fitting.tolist(), pieces

    kinds = [*kept.schema.fields, T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()),
             T.StructField("fits", T.DoubleType())]
    if spans:
        kinds.append(T.StructField("spans", T._parse_datatype_string("array<struct<start:bigint,end:bigint,lang:string>>")))
    return kept.withColumn(whole, F.col(text)).mapInArrow(label, T.StructType(kinds))
