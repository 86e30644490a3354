"""Byte-level BPE encoding and decoding with a hierarchical-bitmap rank queue.

A pre-token's bytes form a linked list. An adjacent pair that is in the vocabulary, and whose turn comes
before that of both pairs it overlaps, waits in the bucket of its merge rank; two levels of 256-bit words say which buckets hold anything, so that
find-first-set gives the lowest rank in two steps, whatever the pre-token's length. An entry whose
pair has changed since is stale and is skipped. Equal ranks merge from the left.

Results are remembered by pre-token and by stretch of text between single spaces or line feeds, in two
generations of bounded bytes; a string of over ``LONGEST`` characters is not remembered. Null text: as the
empty text, no ids. Very long texts and very long pre-tokens are encoded whole. Repeated rows are each
encoded; other columns pass through; an input column of the result's name is replaced. An empty table
gives an empty table.
"""

from __future__ import annotations

import base64
import gc
import hashlib
import re
from array import array
from collections.abc import Callable, Iterator
from heapq import heappop, heappush

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, IntegerType, LongType, StringType, StructField, StructType

from orrery.llm import common

#: Stands for a pair that is not in the vocabulary.
NONE = 1 << 40
#: -1, 0, 1, ... to copy from.
COUNT = list(range(-1, 256))

#: Bytes, about, of the stretches after a space, pre-tokens and line starts whose ids are remembered, in one generation each.
STRETCHES, PIECES, STARTS = 40_000_000, 12_000_000, 6_000_000
#: Characters of a string that is remembered, at most; bytes of an entry besides its characters and ids.
LONGEST, ENTRY = 64, 170


def load_ranks(raw: bytes) -> dict[bytes, int]:
    """A rank file: on each line a token in base64 and its rank."""
    return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in raw.splitlines() if line)}


class RankQueue:
    """Buckets of positions by rank, under a bitmap of two levels of 256-bit words.

    A bucket of one position is that position; of more, a heap.
    """

    def __init__(self, ranks: int) -> None:
        self.low = [0] * ((ranks >> 8) + 1)
        self.top = 0
        self.buckets: dict[int, int | list[int]] = {}

    def push(self, rank: int, position: int) -> None:
        held = self.buckets.get(rank)
        if held is None:
            self.buckets[rank] = position
            a = rank >> 8
            self.low[a] |= 1 << (rank & 255)
            self.top |= 1 << a
        elif type(held) is int:
            self.buckets[rank] = [held, position] if held < position else [position, held]
        else:
            heappush(held, position)

    def drain(self) -> Iterator[tuple[int, int]]:
        """(rank, position), lowest rank first and leftmost within it, until nothing waits; pushes meanwhile count."""
        low, buckets = self.low, self.buckets
        while top := self.top:
            a = (top & -top).bit_length() - 1
            word = low[a]
            rank = (a << 8) + (word & -word).bit_length() - 1
            held = buckets[rank]
            if type(held) is not int:
                first = heappop(held)
                if held:
                    yield rank, first
                    continue
                held = first
            del buckets[rank]
            low[a] = word = word & (word - 1)
            if not word:
                self.top = top & (top - 1)
            yield rank, held


class Memory(dict):
    """Remembers what ``make`` gives for a string, in two generations of about ``room`` bytes."""

    def __init__(self, make: Callable[[str], bytes], room: int) -> None:
        self.make, self.room, self.held = make, room, 0
        self.old: dict[str, bytes] = {}

    def __missing__(self, key: str) -> bytes:
        if len(key) > LONGEST:
            return self.make(key)
        found = self.old.get(key)
        if found is None:
            found = self.make(key)
        if self.held > self.room:
            self.old, self.held = dict(self), 0
            self.clear()
        self.held += ENTRY + len(key) + len(found)
        self[key] = found
        return found


class Encoder:
    """ids of a text, as little-endian int32; remembers pre-tokens and stretches that follow a space."""

    #: No pre-token crosses a space or line feed that stands alone; the line feed is one of its own.
    SPACE = re.compile(r"(?<=\S) (?=\S)")
    LINE = re.compile(r"(?<=\S)\n(?=\S)")

    def __init__(self, ranks: dict[bytes, int], pattern: str) -> None:
        self.ranks = ranks
        self.pattern = regex.compile(pattern)
        self.pairs = [ranks.get(bytes(divmod(x, 256)), NONE) for x in range(1 << 16)]
        self.queue = RankQueue(max(ranks.values(), default=0) + 1)
        self.pieces = Memory(self.piece, PIECES)
        self.stretches = Memory(self.after_space, STRETCHES)
        self.lines = Memory(self.stretch, STARTS)

    def piece(self, text: str) -> bytes:
        return array("i", self.merged(text.encode("utf-8"))).tobytes()

    def merged(self, piece: bytes) -> list[int]:
        """The ids of one pre-token."""
        ranks = self.ranks
        whole = ranks.get(piece)
        if whole is not None:
            return [whole]
        n = len(piece)
        after = COUNT[2 : n + 2] if n < len(COUNT) - 2 else list(range(1, n + 1))
        before = COUNT[:n] if n < len(COUNT) - 2 else list(range(-1, n - 1))
        push, get, pairs = self.queue.push, ranks.get, self.pairs
        # the rank of the pair that begins at each byte; the ends stand for "no pair" (rank[-1], rank[n])
        rank = [pairs[a << 8 | b] for a, b in zip(piece, piece[1:], strict=False)]
        rank += (NONE, NONE)
        waits = [NONE] * n  # the rank under which each position was last queued
        p = NONE
        for i, r in enumerate(rank):
            if p > r < NONE and r <= rank[i + 1]:
                waits[i] = r
                push(r, i)
            p = r
        for r, i in self.queue.drain():
            if rank[i] != r:
                continue
            j = after[i]
            after[i] = k = after[j]
            rank[j] = NONE
            rank[i] = r = NONE
            if k < n:
                before[k] = i
                rank[i] = r = get(piece[i : after[k]], NONE)
            h = before[i]
            if h >= 0:
                g = before[h]
                rank[h] = q = get(piece[h:k], NONE)
                if q < NONE and rank[g] > q <= r:
                    waits[h] = q
                    push(q, h)
                if r < NONE and q > r <= rank[k]:
                    waits[i] = r
                    push(r, i)
                if g >= 0 and (p := rank[g]) < NONE and waits[g] != p and rank[before[g]] > p <= q:
                    waits[g] = p
                    push(p, g)
            elif r < NONE and r <= rank[k]:
                waits[i] = r
                push(r, i)
            if k < n and (s := rank[k]) < NONE and waits[k] != s and r > s <= rank[after[k]]:
                waits[k] = s
                push(s, k)
        ids, i = [], 0
        while i < n:
            ids.append(ranks[piece[i : after[i]]])
            i = after[i]
        return ids

    def stretch(self, text: str) -> bytes:
        return b"".join(map(self.pieces.__getitem__, self.pattern.findall(text)))

    def after_space(self, rest: str) -> bytes:
        """The ids of a space and what follows it; Latin letters, with or without one mark after them, need no pattern."""
        if rest.isalpha():
            if rest.isascii() or max(rest) < "\u0250":
                return self.piece(" " + rest)
        elif rest[-1] in ".,;:!?" and (word := rest[:-1]).isalpha() and (word.isascii() or max(word) < "\u0250"):
            return self.stretches[word] + self.pieces[rest[-1]]
        return self.stretch(" " + rest)

    def encoded(self, text: str) -> bytes:
        """The ids of a whole text, as little-endian int32."""
        out = []
        for line in self.LINE.split(text):
            parts = line.split(" ")
            if parts != line.split():  # spaces that do not stand alone
                parts = self.SPACE.split(line)
            first, *rest = parts
            out.append(self.lines[first] + b"".join(map(self.stretches.__getitem__, rest)))
        return (self.pieces["\n"] if len(out) > 1 else b"").join(out)


class Decoder:
    """The bytes and the decimal digits of lists of ids, all lists of a batch at once."""

    def __init__(self, ranks: dict[bytes, int]) -> None:
        table = [b""] * (max(ranks.values(), default=0) + 1)
        for token, rank in ranks.items():
            table[rank] = token
        self.tokens = pa.array(table, pa.large_binary())
        self.numbers = pa.array([b"%d " % i for i in range(len(table))], pa.large_binary())

    @staticmethod
    def _joined(vocabulary: pa.Array, flat: pa.Array, ends: np.ndarray, less: int) -> Iterator[memoryview]:
        if not len(flat):
            yield from (memoryview(b"") for _ in ends[1:])
            return
        taken = vocabulary.take(flat)
        offsets = np.frombuffer(taken.buffers()[1], np.int64)[taken.offset : taken.offset + len(taken) + 1]
        data = memoryview(taken.buffers()[2])
        for lo, hi in zip(offsets[ends].tolist(), offsets[ends[1:]].tolist(), strict=False):
            yield data[lo : max(lo, hi - less)]

    def decoded(self, flat: pa.Array, ends: np.ndarray) -> Iterator[memoryview]:
        """Of each list, from one of ``ends`` to the next: the tokens' bytes."""
        return self._joined(self.tokens, flat, ends, 0)

    def digits(self, flat: pa.Array, ends: np.ndarray) -> Iterator[memoryview]:
        """Of each list: its ids as decimal numbers, joined by one space."""
        return self._joined(self.numbers, flat, ends, 1)


def shared_ranks(spark: SparkSession, ranks_path: str):
    """The rank file, read by the driver; its size is that of a vocabulary, whatever the corpus."""
    with open(ranks_path, "rb") as f:
        return spark.sparkContext.broadcast(f.read())


#: What a worker has made of a rank file and pattern, for all its tasks.
_MADE: dict[tuple, Encoder | Decoder] = {}


def _encoder(raw, name: tuple[str, str]) -> Encoder:
    if name not in _MADE:
        _MADE[name] = Encoder(load_ranks(raw.value), name[1])
    return _MADE[name]


def _decoder(raw, ranks_path: str) -> Decoder:
    if (ranks_path,) not in _MADE:
        _MADE[ranks_path,] = Decoder(load_ranks(raw.value))
    return _MADE[ranks_path,]


def _encoded(encoder: Encoder, texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """(ids of all texts, where each text's end, with 0 before)."""
    gc.disable()  # what is made here has no cycles
    try:
        found = [encoder.encoded(t or "") for t in texts.to_pylist()]
    finally:
        gc.enable()
    ends = np.cumsum([0, *map(len, found)]) // 4
    return pa.array(np.frombuffer(b"".join(found), "<i4"), pa.int32()), ends


def encode(docs: DataFrame, ranks_path: str, pattern: str, text: str = "text", ids: str = "token_ids", passing: tuple[str, ...] | None = None) -> DataFrame:
    """The columns ``passing`` (default: all) and ``ids``: array<int> of the whole text."""
    common.text_batches(docs.sparkSession)
    raw = shared_ranks(docs.sparkSession, ranks_path)
    keep = [c for c in (docs.columns if passing is None else passing) if c != ids]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(raw, (ranks_path, pattern))
        for b in batches:
            flat, ends = _encoded(encoder, b.column(0))
            lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), flat)
            yield pa.RecordBatch.from_arrays([*b.columns[1:], lists], [*b.schema.names[1:], ids])

    schema = StructType([*docs.select(*keep).schema.fields, StructField(ids, ArrayType(IntegerType()))])
    return docs.select(F.col(text).alias("_text_to_encode"), *keep).mapInArrow(run, schema)


def decode(rows: DataFrame, ranks_path: str, ids: str = "token_ids", out: str = "decoded", passing: tuple[str, ...] | None = None) -> DataFrame:
    """The columns ``passing`` (default: all) and ``out``: the bytes that ``ids`` stand for (null ids: no bytes)."""
    raw = shared_ranks(rows.sparkSession, ranks_path)
    keep = [c for c in (rows.columns if passing is None else passing) if c != out]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decoder = _decoder(raw, ranks_path)
        for b in batches:
            lists = b.column(0)
            ends = np.append(0, np.cumsum(pc.list_value_length(lists).fill_null(0)))
            whole = pa.array(list(map(bytes, decoder.decoded(lists.flatten(), ends))), pa.binary())
            yield pa.RecordBatch.from_arrays([*b.columns[1:], whole], [*b.schema.names[1:], out])

    schema = StructType([*rows.select(*keep).schema.fields, StructField(out, BinaryType())])
    return rows.select(F.col(ids).alias("_ids_to_decode"), *keep).mapInArrow(run, schema)


def digests(docs: DataFrame, ranks_path: str, pattern: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key``, n_tokens, ids_sha256, decoded_sha256 of every row: encoded, then decoded from the ids, without leaving the batch."""
    common.text_batches(docs.sparkSession)
    raw = shared_ranks(docs.sparkSession, ranks_path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, decoder = _encoder(raw, (ranks_path, pattern)), _decoder(raw, ranks_path)
        for b in batches:
            flat, ends = _encoded(encoder, b.column(0))
            hashes = ([hashlib.sha256(x).hexdigest() for x in f(flat, ends)] for f in (decoder.digits, decoder.decoded))
            yield pa.RecordBatch.from_arrays([b.column(1), pa.array(np.diff(ends), pa.int64()), *map(pa.array, hashes)], [key, "n_tokens", "ids_sha256", "decoded_sha256"])

    names = ("ids_sha256", "decoded_sha256")
    schema = StructType([docs.schema[key], StructField("n_tokens", LongType()), *(StructField(n, StringType()) for n in names)])
    return docs.select(F.col(text).alias("_text_to_encode"), key).mapInArrow(run, schema)


def op6_byte_bpe(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = common.table(spark, sf_dir, "documents")
    return digests(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


QUERIES = {"op6_byte_bpe": op6_byte_bpe}
ORACLE_SQL = {}
