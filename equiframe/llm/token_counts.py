"""Exact token counts of texts of any length.

Short texts are encoded as they are.  A huge text is encoded in chunks that overlap.  Two
neighbouring chunks are spliced where both put a token boundary at the same byte and the vocabulary
proves that no token can cross it; if the overlap holds no such place, it is widened.

The proof: the model marks a space by U+2581, and, if no piece of the vocabulary has that mark behind
another character, no merge ever joins a space to what stands before it.  So a space that follows a
character other than white space splits the encoding, and the part behind the space, encoded alone,
gets the same mark as its prefix.  Where the vocabulary or the normaliser does not allow this
argument, whole texts are encoded.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

MARK = "▁"
_BYTE = re.compile(r"<0x[0-9A-F]{2}>")
_CUT = re.compile(r"(?<=[^\s▁]) (?=[^\s▁])")


class Counter:
    """Token counts by one model; ``path`` is a sentencepiece ``.model`` file that every executor has."""

    def __init__(self, path: str, chunk: int = 32_768, overlap: int = 256) -> None:
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.chunk, self.overlap = chunk, overlap
        pieces = [self.model.id_to_piece(i) for i in range(self.model.get_piece_size())]
        plain = self.model.encode(f"a  {MARK}bﬁ  ", out_type=str)
        self.splits = (
            not any(MARK in p.lstrip(MARK) for p in pieces)
            and "".join(plain) == f"{MARK}a{MARK * 3}bﬁ {MARK}"  # spaces kept, nothing rewritten
        )

    def count(self, text: str) -> int:
        if len(text) <= self.chunk + self.overlap or not self.splits:
            return len(self.model.encode(text))
        total, start = 0, 0
        while True:
            end = start + self.chunk
            if end + self.overlap >= len(text):
                return total + len(self.model.encode(text[start:]))
            tokens, start = self._spliced(text, start, end)
            total += tokens

    def _spliced(self, text: str, start: int, end: int) -> tuple[int, int]:
        """Tokens of ``text[start:]`` up to the first stable boundary behind ``end``, and where the rest begins."""
        width = self.overlap
        while True:
            stop = end + width
            if stop >= len(text):
                return len(self.model.encode(text[start:])), len(text)
            left = self._starts(text[start:stop], start)
            cuts = {m.start() for m in _CUT.finditer(text, end, stop)}
            first = min((p for p in cuts if p in left), default=None)
            if first is not None:
                # The neighbour starts a little before the cut and must show the same boundary.
                back = max((m.start() for m in _CUT.finditer(text, max(start, first - width), first)), default=None)
                right = self._starts(text[back + 1:stop], back + 1) if back is not None else {first: 0}
                if first in right:
                    return left[first], first + 1
            width *= 2

    def _starts(self, part: str, offset: int) -> dict[int, int]:
        """Where tokens start, in characters of the whole text, and how many tokens stand before."""
        found, at, run = {}, offset - 1, 0  # the prefix mark stands before the first character
        for n, piece in enumerate(self.model.encode(part, out_type=str)):
            if _BYTE.fullmatch(piece):
                byte = int(piece[3:5], 16)
                if run == 0:
                    found[at] = n
                    run = 1 if byte < 0x80 else 2 if byte < 0xE0 else 3 if byte < 0xF0 else 4
                run -= 1
                at += run == 0
            else:
                found[at] = n
                at += len(piece)
        return found


def count_tokens(
    docs: DataFrame, model: str, key: str = "doc_id", text: str = "text", limit: int = 4096,
    chunk: int = 32_768, overlap: int = 256,
) -> DataFrame:
    """``(key, n_bytes, n_tokens, over_limit)`` of every row's whole text.

    Counts are those of the library's plain encoding: no begin, end or added special tokens.  A null
    text counts as an empty one.  Every row gives one row, repeated and null keys too.
    """
    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = None
        for batch in batches:
            counter = counter or Counter(model, chunk, overlap)
            sizes, counts = [], []
            for value in batch.column(1).to_pylist():
                value = value or ""
                sizes.append(len(value.encode()))
                counts.append(counter.count(value))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(sizes, pa.int64()), pa.array(counts, pa.int64()),
                 pa.array([n > limit for n in counts], pa.bool_())],
                names=[key, "n_bytes", "n_tokens", "over_limit"])

    kinds = T.StructType([
        docs.schema[key], T.StructField("n_bytes", T.LongType()), T.StructField("n_tokens", T.LongType()),
        T.StructField("over_limit", T.BooleanType())])
    return docs.select(key, text).mapInArrow(fold, kinds)
