"""Token ids in files, compressed by a Re-Pair grammar per shard.

Texts are encoded in the order of their keys and cut into shards of whole documents.  In a shard frequent
pairs of neighbouring ids are replaced by new symbols, round after round, until no pair is
frequent.  The shard stores the pairs, the length each symbol expands to, and the symbols that are left, so a
reader finds the symbols behind any range of ids from the lengths and expands only these.

A task writes one file of shards and returns an index row for each.  Only index rows of tasks that
Spark has committed count; files of lost attempts are never read.
"""

from __future__ import annotations

import json
import math
import os
import struct
import uuid
import zlib
from collections.abc import Iterator
from itertools import chain, pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyarrow import fs
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from equiframe.functions.scale import shared_path
from equiframe.llm.shared import Stored, slices

SHARD_IDS = 1 << 20
RANGE_BYTES = 32 << 20  # texts that a task gets
MOST_RANGES = 50_000
SLICE_BYTES = 8 << 20  # texts encoded at once; their distinct words are cut and looked up once
LEAST_USES = 8
LEAST_GAIN = 0.02
SLOT_BITS = 18  # pairs are counted by hash first; only those in a slot that is frequent are sorted
_MIXER = np.uint64(0x9E3779B97F4A7C15)
MOST_EXPANSION = 1 << 12
MAGIC, HEAD = b"RPG1", "<4sIIIIQB"  # mark, bytes of the table, rounds, rules, first rule, symbols, bits of a symbol
SPACE_MARK = "Ġ"  # how byte-level vocabularies write a space
JOINED = 64  # pieces in one string for the library
# A space beside white space, at the start or at the end; all that Unicode, or Python, calls white space.
_WHITE = r"\s\x{0b}\x{1c}-\x{1f}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
ODD_SPACES = f"[{_WHITE}] | [{_WHITE}]|^ | $|^$"
# What a byte is to the byte-level pattern, where its character alone tells: Latin letters, digits, white space, other ASCII.
OTHER, LETTER, DIGIT, SIGN, WHITE = range(5)
_KINDS = np.zeros(256, dtype=np.uint8)
_KINDS[0x21:0x7F] = SIGN
_KINDS[[*range(0x41, 0x5B), *range(0x61, 0x7B)]] = LETTER
_KINDS[0x30:0x3A] = DIGIT
_KINDS[[0x09, 0x0A, 0x0D]] = WHITE
_NOT_LETTERS = (0x97, 0xB7)  # after 0xC3: the signs of multiplication and division
# A piece that is one match of the pattern: all letters, all digits or all signs of those kinds.
ONE_MATCH = r"^(?:[A-Za-z\x{c0}-\x{d6}\x{d8}-\x{f6}\x{f8}-\x{24f}]+|[0-9]+|[!-/:-@\[-`{-~]+)$"
# The character that byte-level vocabularies write for each byte: printable Latin-1 as it is, the others from U+0100 on.
_CHARS = np.arange(256, dtype="<u4")
_HIDDEN = np.array([*range(0x21), *range(0x7F, 0xA1), 0xAD])
_CHARS[_HIDDEN] = 0x100 + np.arange(len(_HIDDEN))


class Encoder:
    """Ids of whole texts by a byte-level BPE file of the tokenizers library.

    The file's pattern starts a new token at a space between two characters that are no white space, and where
    letters, digits, signs or a single line break or tab meet (:func:`_pieces`).  So the pieces of each distinct word are encoded once and
    looked up afterwards.  A piece that is one match goes to the file's model alone; of the others those with the space before
    them go many in one string, where the tokens that begin with a space tell them apart.  Where the file has another pattern, or a text has other spaces or the
    string of a special token, whole texts are encoded.
    """

    def __init__(self, path: str, most_bytes: int = 8 << 20) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        from tokenizers import Tokenizer

        self.model = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as file:
            told = json.load(file)
        first = told.get("pre_tokenizer") or {}
        self.splits = (
            first.get("type") == "ByteLevel" and not first.get("add_prefix_space") and first.get("use_regex", True)
            and not told.get("normalizer") and not told.get("truncation") and not told.get("padding"))
        self.special = [t["content"] for t in told.get("added_tokens") or []]
        words = self.model.get_vocab()
        self.begins = np.zeros(max(words.values(), default=0) + 1, dtype=bool)
        self.begins[[i for w, i in words.items() if w.startswith(SPACE_MARK)]] = True
        self.most_bytes = most_bytes
        self._forget()

    def _forget(self) -> None:
        self.known = [pa.array([], pa.string())] * 2  # pieces inside a word, and pieces with the space before them
        self.number = [np.empty(0, np.int64)] * 2
        self.flat, self.starts, self.sizes = np.empty(0, np.uint32), np.empty(0, np.int64), np.empty(0, np.int64)

    def _encode(self, texts: list[str]) -> list[list[int]]:
        fast = getattr(self.model, "encode_batch_fast", self.model.encode_batch)
        return [e.ids for e in fast(texts, add_special_tokens=False)]

    def _learn(self, pieces: pa.Array, spaced: bool) -> None:
        single = pa.compute.match_substring_regex(pieces, ONE_MATCH).to_numpy(zero_copy_only=False)
        self.known[spaced] = pa.concat_arrays([self.known[spaced], pieces])
        number = np.empty(len(pieces), dtype=np.int64)
        for chosen, learn in ((single, self._learn_single), (~single, self._learn_spaced if spaced else self._learn_inner)):
            some = pieces.filter(pa.array(chosen))
            if not len(some):
                continue
            flat, sizes = learn(some, SPACE_MARK if spaced else "")
            number[chosen] = len(self.starts) + np.arange(len(some))
            self.starts = np.concatenate([self.starts, len(self.flat) + np.cumsum(sizes) - sizes])
            self.sizes = np.concatenate([self.sizes, sizes])
            self.flat = np.concatenate([self.flat, flat])
        self.number[spaced] = np.concatenate([self.number[spaced], number])

    def _learn_single(self, pieces: pa.Array, mark: str) -> tuple[np.ndarray, np.ndarray]:
        """Ids of pieces that are one match each, and how many each has: what the model makes of the match's bytes."""
        data, offsets = _bytes_of(pieces)
        written = _CHARS[data].tobytes().decode("utf-32-le")
        tokenize = self.model.model.tokenize
        found = [[t.id for t in tokenize(mark + written[a:b])] for a, b in pairwise(offsets.tolist())]
        return _flat(found), np.array([len(f) for f in found], dtype=np.int64)

    def _learn_inner(self, pieces: pa.Array, mark: str) -> tuple[np.ndarray, np.ndarray]:
        found = self._encode(pieces.to_pylist())
        return _flat(found), np.array([len(f) for f in found], dtype=np.int64)

    def _learn_spaced(self, pieces: pa.Array, mark: str) -> tuple[np.ndarray, np.ndarray]:
        cuts = pa.array([*range(0, len(pieces), JOINED), len(pieces)], pa.int32())
        lines = [f" {line}" for line in pa.compute.binary_join(pa.ListArray.from_arrays(cuts, pieces), " ").to_pylist()]
        flat = _flat(self._encode(lines))
        starts = np.flatnonzero(self.begins[flat])
        if len(starts) != len(pieces):
            raise ValueError("the tokenizer does not begin a token at the space before a word")
        return flat, np.diff(np.append(starts, len(flat)))

    def _numbers(self, pieces: pa.Array, spaced: bool) -> np.ndarray:
        """The number of each piece; pieces that are not known are learned."""
        cut = pieces.dictionary_encode()
        place = pa.compute.index_in(cut.dictionary, value_set=self.known[spaced])
        new = cut.dictionary.filter(place.is_null())
        at = place.fill_null(0).to_numpy().astype(np.int64)
        at[place.is_null().to_numpy(zero_copy_only=False)] = len(self.known[spaced]) + np.arange(len(new))
        if len(new):
            self._learn(new, spaced)
        return self.number[spaced][at[cut.indices.to_numpy()]]

    def _words(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of distinct words with the space before them, one after another, and where each begins and how many it has."""
        pieces, first = _pieces(words)
        number = np.empty(len(pieces), dtype=np.int64)
        for spaced in (False, True):
            number[first == spaced] = self._numbers(pieces.filter(pa.array(first == spaced)), spaced)
        sizes = self.sizes[number]
        flat = _follow(self.flat, self.starts[number], sizes)
        starts = (np.cumsum(sizes) - sizes)[first]
        return flat, starts, np.diff(np.append(starts, len(flat)))

    def encode(self, texts: pa.StringArray) -> list[np.ndarray]:
        """The ids of each text; texts are not null."""
        if sum(known.nbytes for known in self.known) > self.most_bytes:
            self._forget()
        odd = pa.compute.match_substring_regex(texts, ODD_SPACES).to_numpy(zero_copy_only=False)
        for special in self.special:
            odd = odd | pa.compute.match_substring(texts, special).to_numpy(zero_copy_only=False)
        if not self.splits:
            odd[:] = True
        cut = pa.compute.split_pattern(texts.filter(pa.array(~odd)), " ")
        words, offsets = cut.flatten().dictionary_encode(), cut.offsets.to_numpy()
        flat, starts, sizes = self._words(words.dictionary)
        number = words.indices.to_numpy()
        begin = iter(self._encode(words.take(pa.array(offsets[:-1])).cast(pa.string()).to_pylist()))  # no space before these
        whole = iter(self._encode(texts.filter(pa.array(odd)).to_pylist()))
        parts = iter(zip(offsets, offsets[1:]))
        out = []
        for apart in odd:
            if apart:
                out.append(np.array(next(whole), dtype=np.uint32))
                continue
            low, high = next(parts)
            at = number[low + 1:high]
            out.append(np.concatenate([np.array(next(begin), dtype=np.uint32), _follow(flat, starts[at], sizes[at])]))
        return out


def _flat(found: list[list[int]]) -> np.ndarray:
    return np.array(list(chain.from_iterable(found)), dtype=np.uint32)


def _bytes_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of some texts, one after another, and where each begins, with the end of the last."""
    offsets = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset:texts.offset + len(texts) + 1]
    return np.frombuffer(texts.buffers()[2] or b"", np.uint8)[offsets[0]:offsets[-1]], offsets - offsets[0]


def _pieces(words: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """Words, none of them empty, cut where the byte-level pattern ends one match and begins the next, and which pieces begin a word.

    No match goes from one of letters, digits, signs and white space other than the space to another, but for contractions,
    which an apostrophe begins.  Of several white spaces in a row the last is a match of its own only in front of something else, so what
    follows them stays with them; and characters whose kind is not known here stay with both neighbours.
    """
    if not len(words):
        return words, np.empty(0, dtype=bool)
    data, offsets = _bytes_of(words)
    kind = _KINDS[data]
    lead = np.flatnonzero((data >= 0xC3) & (data <= 0xC9))  # U+00C0 to U+024F, two bytes each
    lead = lead[(data[lead] != 0xC3) | ~np.isin(data[lead + 1], _NOT_LETTERS)]
    kind[lead] = kind[lead + 1] = LETTER
    cut = np.zeros(len(data) + 1, dtype=bool)
    left, right = kind[:-1], kind[1:]
    cut[1:-1] = (left != right) & (left != OTHER) & (right != OTHER) & ~((data[:-1] == 0x27) & (right == LETTER))
    run = np.flatnonzero(cut[1:-1] & (left == WHITE)) + 1  # behind a white space that another, or what may be one, stands before
    cut[run[(run > 1) & np.isin(kind[run - 2], (WHITE, OTHER))]] = False
    cut[offsets[:-1]] = True
    begins = np.flatnonzero(cut[:-1])
    first = np.zeros(len(data) + 1, dtype=bool)
    first[offsets[:-1]] = True
    ends = np.append(begins, len(data)).astype(np.int32)
    return pa.StringArray.from_buffers(len(begins), pa.py_buffer(ends), pa.py_buffer(data)), first[begins]


def _follow(flat: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The pieces ``flat[start:start + size]`` one after another."""
    ends = np.cumsum(sizes)
    total = int(ends[-1]) if len(ends) else 0
    return flat[np.repeat(starts - (ends - sizes), sizes) + np.arange(total)]


class Grammar:
    """Rules of one shard: symbol ``base + i`` stands for the pair ``rules[i]``, rules of a round for symbols before it."""

    def __init__(self, base: int, rounds: np.ndarray, rules: np.ndarray, lengths: np.ndarray) -> None:
        self.base, self.rounds, self.rules, self.lengths = base, rounds, rules, lengths

    def sizes(self, symbols: np.ndarray) -> np.ndarray:
        """How many ids each symbol expands to."""
        out = np.ones(len(symbols), dtype=np.int64)
        made = symbols >= self.base
        out[made] = self.lengths[symbols[made] - self.base]
        return out

    def expand(self, symbols: np.ndarray) -> np.ndarray:
        """The ids of a run of symbols: the symbols of the last round first become pairs, then those of the round before."""
        out = symbols
        for first, last in reversed(list(zip(self.rounds, self.rounds[1:]))):
            made = (out >= self.base + first) & (out < self.base + last)
            if made.any():
                at = np.arange(len(out)) + np.concatenate([[0], np.cumsum(made)[:-1]])
                grown = np.empty(len(out) + int(made.sum()), dtype=np.int64)
                pairs = self.rules[out[made] - self.base]
                grown[at] = out
                grown[at[made]], grown[at[made] + 1] = pairs[:, 0], pairs[:, 1]
                out = grown
        return out

    def expand_all(self, symbols: np.ndarray) -> np.ndarray:
        """The same for many symbols: each rule is expanded once and copied to where it stands."""
        if not len(self.rules):
            return symbols
        starts, flat = np.empty(0, dtype=np.int64), np.empty(0, dtype=np.int64)

        def copied(some: np.ndarray) -> np.ndarray:
            made = some >= self.base
            place = np.where(made, 0, len(flat) + np.cumsum(~made) - 1)
            place[made] = starts[some[made] - self.base]
            return _follow(np.concatenate([flat, some[~made]]), place, self.sizes(some))

        for first, last in zip(self.rounds, self.rounds[1:]):
            grown = copied(self.rules[first:last].ravel())
            sizes = self.lengths[first:last]
            starts = np.concatenate([starts, len(flat) + np.cumsum(sizes) - sizes])
            flat = np.concatenate([flat, grown])
        return copied(symbols)


def compress(ids: np.ndarray, sizes: np.ndarray, least: int = LEAST_USES) -> tuple[Grammar, np.ndarray, np.ndarray]:
    """``(grammar, symbols, symbols per document)`` of documents of ``sizes`` ids each.

    A round counts all pairs of neighbours inside documents and replaces the frequent ones, the most frequent first
    where two overlap.  What counts as frequent falls fourfold from round to round down to ``least`` uses; the
    rounds end when one shortens the sequence by under ``LEAST_GAIN``.  No rule expands to over ``MOST_EXPANSION`` ids,
    so that a step into the middle of a symbol stays short.
    """
    sequence = ids.astype(np.int64)
    base = int(sequence.max()) + 1 if len(sequence) else 1
    last = np.zeros(len(sequence), dtype=bool)
    last[np.cumsum(sizes)[sizes > 0] - 1] = True
    rules, lengths, rounds = [np.empty((0, 2), dtype=np.int64)], np.empty(0, dtype=np.int64), [0]
    floor, ended = None, False
    while len(sequence) > 1 and not ended:
        keys = sequence[:-1] << 32 | sequence[1:]
        slot = _slots(keys)
        slot[last[:-1]] = 1 << SLOT_BITS  # no pair: its second symbol is of the next document
        counted = np.bincount(slot, minlength=(1 << SLOT_BITS) + 1)
        counted[-1] = 0
        top = int(counted.max())
        floor = max(least, min(top, floor or top) // 4)
        ended = floor == least
        near = np.flatnonzero((counted >= floor)[slot])
        keys, slot = keys[near], slot[near]
        pairs, counts = np.unique(keys, return_counts=True)
        made = Grammar(base, np.array(rounds), rules[-1], lengths)
        grown = made.sizes(pairs >> 32) + made.sizes(pairs & 0xFFFFFFFF)
        fit = (counts >= floor) & (grown <= MOST_EXPANSION)
        pairs, grown, counts = pairs[fit], grown[fit], counts[fit]
        # Equally frequent pairs in the order of a hash: in that of their symbols most of a chain would stand back each round.
        by_count = np.lexsort((pairs.view(np.uint64) * _MIXER, counts))
        at, rule_of = _chosen(near, keys, slot, pairs[by_count])
        uses = np.bincount(rule_of, minlength=len(pairs))
        worth = uses >= least
        taken = worth[rule_of]
        at, rule_of = at[taken], rule_of[taken]
        sequence[at] = base + rounds[-1] + (np.cumsum(worth) - 1)[rule_of]
        last[at] = last[at + 1]
        stays = np.ones(len(sequence), dtype=bool)
        stays[at + 1] = False
        ended = ended and len(at) < LEAST_GAIN * len(sequence)
        sequence, last = sequence[stays], last[stays]
        if len(at):
            new = pairs[by_count][worth]
            rules.append(np.stack([new >> 32, new & 0xFFFFFFFF], axis=1))
            lengths = np.concatenate([lengths, grown[by_count][worth]])
            rounds.append(rounds[-1] + len(new))
    ends = np.flatnonzero(last) + 1
    held = np.zeros(len(sizes), dtype=np.int64)
    held[sizes > 0] = np.diff(np.concatenate([[0], ends]))
    return Grammar(base, np.array(rounds), np.concatenate(rules), lengths), sequence, held


def _slots(keys: np.ndarray) -> np.ndarray:
    return (keys.view(np.uint64) * _MIXER >> np.uint64(64 - SLOT_BITS)).view(np.int64)


def _chosen(near: np.ndarray, keys: np.ndarray, slot: np.ndarray, pairs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Those of the places ``near``, with pairs ``keys``, whose pair is replaced, and its number in ``pairs``, which rise in count.

    Of pairs that overlap the one with the higher number is taken.  In a run of one symbol every other pair stands back.
    Of pairs that share a slot only the most frequent one is looked for; a later round finds the others.
    """
    holder = np.zeros(1 << SLOT_BITS, dtype=np.int64)
    np.maximum.at(holder, _slots(pairs), np.arange(1, len(pairs) + 1))
    number = holder[slot]
    wanted = np.flatnonzero(np.concatenate([[-1], pairs])[number] == keys)
    hit, number = near[wanted], number[wanted]
    rank = 2 * number
    close = np.diff(hit, prepend=-2) == 1  # the pair of the place before is one of those as well
    same = close & (np.diff(rank, prepend=0) == 0)
    where = np.arange(len(hit))
    rank += (where - np.maximum.accumulate(np.where(same, 0, where))) % 2 == 0
    over_left = ~close | (rank > np.concatenate([[0], rank[:-1]]))
    over_right = ~np.concatenate([close[1:], [False]]) | (rank > np.concatenate([rank[1:], [0]]))
    taken = over_left & over_right
    return hit[taken], number[taken] - 1


def _packed(values: np.ndarray, width: int) -> bytes:
    """``width`` bits of each value, the lowest first."""
    bits = np.unpackbits(values.astype("<u4").view(np.uint8).reshape(-1, 4), axis=1, bitorder="little")
    return np.packbits(bits[:, :width], bitorder="little").tobytes()


def _unpacked(raw: bytes | memoryview, width: int, start: int, count: int) -> np.ndarray:
    """``count`` values from number ``start`` on; only their bytes are looked at."""
    low, high = start * width, (start + count) * width
    bits = np.unpackbits(np.frombuffer(raw, np.uint8)[low // 8:-(-high // 8)], bitorder="little")[low % 8:low % 8 + high - low]
    full = np.zeros((count, 32), dtype=np.uint8)
    full[:, :width] = bits.reshape(count, width)
    return np.packbits(full, axis=1, bitorder="little").view("<u4").ravel().astype(np.int64)


def pack_shard(keys: pa.Array, documents: list[np.ndarray]) -> bytes:
    """The bytes of a shard: head, table of documents, rules, their lengths, symbols."""
    sizes = np.array([len(d) for d in documents], dtype=np.int64)
    grammar, symbols, held = compress(np.concatenate(documents) if documents else np.empty(0, np.uint32), sizes)
    table = pa.record_batch([keys, pa.array(sizes), pa.array(held)], names=["key", "n_ids", "n_symbols"])
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema) as out:
        out.write_batch(table)
    listed = sink.getvalue().to_pybytes()
    width = max(1, int(symbols.max()).bit_length()) if len(symbols) else 1
    head = struct.pack(HEAD, MAGIC, len(listed), len(grammar.rounds), len(grammar.rules), grammar.base, len(symbols), width)
    return b"".join([head, listed, grammar.rounds.astype("<u4").tobytes(), grammar.rules.astype("<u4").tobytes(),
                     grammar.lengths.astype("<u4").tobytes(), _packed(symbols, width)])


class Shard:
    """A shard's bytes, read at random: documents and ranges of ids."""

    def __init__(self, raw: bytes) -> None:
        magic, listed, rounds, rules, base, self.n_symbols, self.width = struct.unpack_from(HEAD, raw)
        if magic != MAGIC:
            raise ValueError(f"no shard: {magic!r}")
        at = struct.calcsize(HEAD)
        table = pa.ipc.open_stream(pa.py_buffer(raw)[at:at + listed]).read_all()
        at += listed
        parts = []
        for n in (rounds, 2 * rules, rules):
            parts.append(np.frombuffer(raw, "<u4", n, at).astype(np.int64))
            at += 4 * n
        self.grammar = Grammar(base, parts[0], parts[1].reshape(-1, 2), parts[2])
        self.packed = memoryview(raw)[at:]
        self.keys = table.column("key").combine_chunks()
        self.n_ids, self.held = table.column("n_ids").to_numpy(), table.column("n_symbols").to_numpy()
        self.first_id = np.cumsum(self.n_ids) - self.n_ids
        self.first_symbol = np.cumsum(self.held) - self.held

    def document(self, i: int) -> np.ndarray:
        """All ids of a document; no other document is expanded."""
        return self.grammar.expand(_unpacked(self.packed, self.width, int(self.first_symbol[i]), int(self.held[i])))

    def ids(self, start: int, count: int) -> np.ndarray:
        """Ids ``start`` to ``start + count`` of the shard: the symbols that they lie in are found by their lengths."""
        some = np.flatnonzero((self.first_id < start + count) & (self.first_id + self.n_ids > start))
        if not len(some) or count <= 0:
            return np.empty(0, dtype=np.int64)
        first, last = some[0], some[-1]
        low = int(self.first_symbol[first])
        symbols = _unpacked(self.packed, self.width, low, int(self.first_symbol[last] + self.held[last]) - low)
        ends = int(self.first_id[first]) + np.cumsum(self.grammar.sizes(symbols))
        a, b = np.searchsorted(ends, start, side="right"), np.searchsorted(ends, start + count, side="left") + 1
        skip = start - (int(ends[a - 1]) if a else int(self.first_id[first]))
        return self.grammar.expand(symbols[a:b])[skip:skip + count]

    def all_ids(self) -> np.ndarray:
        return self.grammar.expand_all(_unpacked(self.packed, self.width, 0, self.n_symbols))


INDEX = "file string, offset bigint, bytes bigint, dealt int, first_id bigint, n_ids bigint, n_docs bigint"


def _ranges(total: int, size: int) -> int:
    return max(1, min(MOST_RANGES, math.ceil(total / size)))


def write_token_files(
    docs: DataFrame, tokenizer: str, end_id: int, key: str = "doc_id", text: str = "text", folder: str | None = None,
    shard_ids: int = SHARD_IDS, range_bytes: int = RANGE_BYTES,
) -> DataFrame:
    """Encode every whole text, append ``end_id``, write shards, and return the stored index, a row per shard.

    Documents lie in ascending order of the key, null keys first, rows that repeat a key by the hash of their text.  Null text is
    empty text.  ``tokenizer`` is a file of the tokenizers library that every executor has.  A task holds one
    shard of about ``shard_ids`` ids, or one document if that is longer.  ``start_id`` is where a shard begins
    in the ids of all documents.
    """
    spark = docs.sparkSession
    folder = folder or shared_path(spark, "token-files")
    place = spark._jvm.org.apache.hadoop.fs.Path(folder)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).mkdirs(place)
    rows = docs.select(F.col(key).alias("key"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    total = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    tie = F.xxhash64("text")
    dealt = (
        rows.withColumn("tie", tie).repartitionByRange(_ranges(total, range_bytes), F.col("key").asc_nulls_first(), "tie")
        .sortWithinPartitions(F.col("key").asc_nulls_first(), "tie").select("key", "text", F.spark_partition_id().alias("dealt")))

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = file = name = None
        keys: list[pa.Array] = []
        documents: list[np.ndarray] = []
        offset = first = held = number = 0

        def shard() -> pa.RecordBatch:
            nonlocal offset, first, held, keys, documents
            raw = pack_shard(pa.concat_arrays(keys), documents)
            file.write(raw)
            row = {"file": name, "offset": offset, "bytes": len(raw), "dealt": number, "first_id": first,
                   "n_ids": held, "n_docs": len(documents)}
            offset, first, held, keys, documents = offset + len(raw), first + held, 0, [], []
            return pa.RecordBatch.from_pylist([row], schema=_INDEX_ARROW)

        try:
            for batch in slices(batches, "text", SLICE_BYTES):
                if file is None:
                    encoder, number = Encoder(tokenizer), batch.column(2)[0].as_py()
                    name = f"{folder}/{uuid.uuid4().hex}.repair"
                    store, path = fs.FileSystem.from_uri(name)
                    file = store.open_output_stream(path, compression=None)
                for i, ids in enumerate(encoder.encode(batch.column(1))):
                    keys.append(batch.column(0).slice(i, 1))
                    documents.append(np.append(ids, np.uint32(end_id)))
                    held += len(ids) + 1
                    if held >= shard_ids:
                        yield shard()
            if documents:
                yield shard()
        finally:
            if file is not None:
                file.close()

    index = Stored(dealt.mapInArrow(write, INDEX), "token-index").frame
    # One row per task: what the tasks before have written is added up in order.
    before = index.groupBy("dealt").agg(F.sum("n_ids").alias("n")).select("dealt", F.coalesce(F.sum("n").over(
        Window.orderBy("dealt").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    return Stored(index.join(before, "dealt").select(
        "file", "offset", "bytes", (F.col("before") + F.col("first_id")).alias("start_id"), "n_ids", "n_docs"), "token-index").frame


_INDEX_ARROW = pa.schema([
    ("file", pa.string()), ("offset", pa.int64()), ("bytes", pa.int64()), ("dealt", pa.int32()), ("first_id", pa.int64()),
    ("n_ids", pa.int64()), ("n_docs", pa.int64())])


def read_token_files(index: DataFrame, key: T.StructField, ids: bool = False, read_bytes: int = RANGE_BYTES) -> DataFrame:
    """``(key, start, n_tokens, ids_crc32)`` of every document in the shards that ``index`` names, read from their files.

    ``start`` counts the ids of all documents before; ``ids_crc32`` is taken over the ids as little-endian unsigned
    32-bit integers.  With ``ids`` the ids themselves come as well.  Tasks are as many as the shards' bytes ask for.
    """
    total = index.agg(F.sum("bytes")).first()[0] or 0
    dealt = index.repartition(_ranges(4 * total, read_bytes), "file", "offset").sortWithinPartitions("file", "offset")
    kinds = [key, T.StructField("start", T.LongType()), T.StructField("n_tokens", T.LongType()),
             T.StructField("ids_crc32", T.LongType()), *([T.StructField("ids", T.ArrayType(T.LongType()))] if ids else [])]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name = stream = None
        try:
            for batch in batches:
                for row in batch.to_pylist():
                    if row["file"] != name:
                        if stream is not None:
                            stream.close()
                        name = row["file"]
                        store, path = fs.FileSystem.from_uri(name)
                        stream = store.open_input_file(path)
                    shard = Shard(stream.read_at(row["bytes"], row["offset"]))
                    flat = shard.all_ids().astype("<u4")
                    documents = [flat[a:a + n] for a, n in zip(shard.first_id.tolist(), shard.n_ids.tolist())]
                    yield pa.RecordBatch.from_arrays(
                        [shard.keys, pa.array(row["start_id"] + shard.first_id), pa.array(shard.n_ids),
                         pa.array([zlib.crc32(d.tobytes()) for d in documents], pa.int64()),
                         *([pa.array([d.astype(np.int64) for d in documents], pa.list_(pa.int64()))] if ids else [])],
                        names=[k.name for k in kinds])
        finally:
            if stream is not None:
                stream.close()

    return dealt.mapInArrow(read, T.StructType(kinds))


def token_files(docs: DataFrame, tokenizer: str, end_id: int, key: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """``(key, start, n_tokens, ids_crc32)`` of every row of ``docs``, written by :func:`write_token_files` and read back.

    ``n_tokens`` includes the end id.  An empty table gives no rows and no files.
    """
    return read_token_files(write_token_files(docs, tokenizer, end_id, key, text, **options), docs.schema[key])
