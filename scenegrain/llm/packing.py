"""Packing: cut points of token windows by order-preserving dynamic programming."""

from __future__ import annotations

import base64
from array import array
from collections import deque
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._common import named, table, text_of

WINDOW = 1024
SENTENCE_CUT = 2
HARD_CUT = 5
#: Without a sentence end for this many tokens, hard cuts become candidates every HARD_STEP tokens.
HARD_GAP, HARD_STEP = 10, 8
#: Tokens gathered before windows are settled; two windows stay open for what follows.
HORIZON = 1 << 17
#: Fixed value: the vocabulary's one special token, whose text it reads as that token.
SPECIAL = "<|endoftext|>"
#: The type code of unsigned 32-bit numbers.
UNSIGNED = "I" if array("I").itemsize == 4 else "L"

PIECES = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("start", T.LongType()),
        T.StructField("length", T.LongType()),
        T.StructField("ids", T.BinaryType()),
        T.StructField("doc_tokens", T.LongType()),
        T.StructField("sequence_id", T.LongType()),
        T.StructField("offset", T.LongType()),
    ]
)

_loaded: dict = {}


class ByteBpe:
    """Ids of the byte-level BPE vocabulary, equal to Tokenizer.encode(add_special_tokens=False).

    The vocabulary's pattern looks ahead only where white space stands side by side. Texts without
    that are cut by the pattern without its look-ahead, which gives the same pieces for less time.
    """

    LOOK_AHEAD = r"|\s+(?!\S)"
    #: White space side by side, and white space other than spaces and line ends.
    BESIDE = ("  ", " \n", "\n ", "\n\n", *(chr(c) for c in range(0x3001) if chr(c).isspace() and chr(c) not in " \n"))

    def __init__(self, json_path: str, ranks_path: str, pattern: str):
        import tiktoken
        from tokenizers import Tokenizer

        with open(ranks_path, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self.exact, self.fast = (tiktoken.Encoding("ranks", pat_str=p, mergeable_ranks=ranks, special_tokens={}) for p in (pattern, pattern.replace(self.LOOK_AHEAD, "")))
        self.slow = lru_cache(1)(lambda: Tokenizer.from_file(json_path))  # large: only where it is needed
        self.sentence_end = np.zeros(max(ranks.values()) + 64, bool)
        for token, rank in ranks.items():
            self.sentence_end[rank] = token.rstrip(b"\"')")[-1:] in (b".", b"!", b"?", b"\n")

    def encode(self, text: str) -> bytes:
        if SPECIAL in text:
            ids = self.slow().encode(text, add_special_tokens=False).ids
        else:
            ids = (self.exact if any(map(text.__contains__, self.BESIDE)) else self.fast).encode_ordinary(text)
        return array(UNSIGNED, ids).tobytes()


def loaded(json_path: str, ranks_path: str, pattern: str) -> ByteBpe:
    key = (json_path, ranks_path)
    if key not in _loaded:
        _loaded[key] = ByteBpe(json_path, ranks_path, pattern)
    return _loaded[key]


def best_cuts(pos: list[int], penalty: list[int], window: int) -> tuple[list[int], int]:
    """Indices of the cut points, first and last included, of the cheapest windows, and their cost.

    pos: candidate positions, ascending from 0, no gap above window. A window from i to j costs the
    padding window - (pos[j] - pos[i]) plus penalty[j]. With cost(j) = penalty[j] + window - pos[j]
    + min(cost(i) + pos[i]), the minimum over the sliding range of i is the head of a monotone queue.
    """
    cost, back, queue = [0] * len(pos), [0] * len(pos), deque([(0, 0)])
    left = 0
    for j in range(1, len(pos)):
        p = pos[j]
        while pos[queue[0][1]] < p - window:
            queue.popleft()
        key, left = queue[0]
        cost[j] = c = penalty[j] + window - p + key
        back[j] = left
        k = c + p
        while queue and queue[-1][0] >= k:
            queue.pop()
        queue.append((k, j))
    out, j = [len(pos) - 1], len(pos) - 1
    while j:
        j = back[j]
        out.append(j)
    return out[::-1], cost[-1]


def candidates(ids: np.ndarray, doc_ends: np.ndarray, sentence_end: np.ndarray, window: int) -> tuple[list[int], list[int]]:
    """Candidate cut positions in a run of tokens with their penalties; both ends are in it, and no gap is above window."""
    kind = np.zeros(len(ids) + 1, np.int8)
    kind[1:][sentence_end[ids]] = SENTENCE_CUT
    kind[[0, len(ids)]] = SENTENCE_CUT
    free = np.zeros(len(ids) + 1, bool)
    free[doc_ends] = True
    at = np.flatnonzero((kind > 0) | free)
    gaps, step = np.diff(at), min(HARD_STEP, window)
    more = np.where(gaps > min(HARD_GAP, window), (gaps - 1) // step, 0)  # hard cuts in each gap
    ordinal = np.arange(more.sum()) - np.repeat(np.cumsum(more) - more, more)
    kind[np.repeat(at[:-1], more) + step * (ordinal + 1)] = HARD_CUT
    every = np.flatnonzero((kind > 0) | free)
    return every.tolist(), np.where(free, 0, kind)[every].tolist()


def tail_lengths(length: int, window: int) -> list[int]:
    """How the last, short window is stored: padded, or as powers of two, which need no padding."""
    parts = [1 << b for b in range(length.bit_length() - 1, -1, -1) if length >> b & 1]
    return parts if (len(parts) - 1) * HARD_CUT < window - length else [length]


class Packer:
    """Takes documents in order and gives pieces; sequence numbers count on from first."""

    def __init__(self, bpe: ByteBpe, window: int, first: int):
        self.bpe, self.window, self.next = bpe, window, first
        self.docs: list[tuple] = []  # doc_id, ids before the first one here, ids of the whole document
        self.bytes: list[bytes] = []
        self.tokens = 0

    def add(self, doc_id, text: str) -> list[tuple]:
        data = self.bpe.encode(text) + b"\0\0\0\0"
        self.docs.append((doc_id, 0, len(data) // 4))
        self.bytes.append(data)
        self.tokens += len(data) // 4
        return self.settle(False) if self.tokens >= HORIZON else []

    def settle(self, final: bool) -> list[tuple]:
        if not self.docs:
            return []
        data = b"".join(self.bytes)
        ids = np.frombuffer(data, "<u4")
        ends = np.cumsum([len(b) // 4 for b in self.bytes])
        pos, penalty = candidates(ids, ends, self.bpe.sentence_end, self.window)
        cuts = [pos[i] for i in best_cuts(pos, penalty, self.window)[0]]
        if final:
            last = cuts.pop()
            for part in tail_lengths(last - cuts[-1], self.window):
                cuts.append(cuts[-1] + part)
        else:
            cuts = cuts[:-2] if len(cuts) > 3 else cuts[:1]
        out, doc, begin = [], 0, 0
        for a, b in zip(cuts, cuts[1:], strict=False):
            at = a
            while at < b:
                while ends[doc] <= at:
                    begin, doc = int(ends[doc]), doc + 1
                stop = min(b, int(ends[doc]))
                doc_id, before, total = self.docs[doc]
                out.append((doc_id, before + at - begin, stop - at, data[4 * at : 4 * stop], total, self.next, at - a))
                at = stop
            self.next += 1
        done = cuts[-1]
        docs, rest, begin = [], [], 0
        for (doc_id, before, total), own, end in zip(self.docs, self.bytes, ends.tolist(), strict=True):
            if end > done:
                cut = max(0, done - begin)
                docs.append((doc_id, before + cut, total))
                rest.append(own[4 * cut :])
            begin = end
        self.docs, self.bytes, self.tokens = docs, rest, len(ids) - done
        return out


def pack(df: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, tokenizer: str | None = None, ranks: str | None = None) -> DataFrame:
    """Packs documents, in the order in which they are stored, into sequences of at most window ids.

    One row per piece: doc_id, start, length, ids (little-endian unsigned 32-bit), doc_tokens,
    sequence_id, offset. Within a partition of the input the windows are cut at document ends
    (free), sentence ends (SENTENCE_CUT) or, where no sentence ends for HARD_GAP ids, at hard cuts
    (HARD_CUT), so that padding plus penalties is least. No shuffle: a partition is packed by one
    task in bounded memory and only its last window is short; that one is kept as powers of two
    where this is cheaper. Sequence numbers start at the partition's number times 2**32.

    Null and empty texts are one id, the closing 0. Repeated rows and null ids are rows like any
    other; an empty table gives no rows; other columns are ignored, whatever their names.
    """
    import public_tokenizers

    json_path = tokenizer or public_tokenizers.path("byte_bpe_50k.json")
    ranks_path, pattern = ranks or public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
    names = [f.name for f in PIECES]
    schema = pa.schema([pa.field(n, pa.binary() if n == "ids" else pa.int64()) for n in names])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer = Packer(loaded(json_path, ranks_path, pattern), window, TaskContext.get().partitionId() << 32)

        def rows(found):
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*found, strict=True), schema, strict=True)], schema=schema)

        for batch in batches:
            for lo in range(0, batch.num_rows, 512):
                part, found = batch.slice(lo, 512), []
                for doc_id, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                    found += packer.add(doc_id, text)
                if found:
                    yield rows(found)
        if found := packer.settle(True):
            yield rows(found)

    return df.select(named(id_col).cast("long").alias("doc_id"), text_of(text_col).alias("text")).mapInArrow(run, PIECES)


def digested(docs: DataFrame) -> DataFrame:
    """Pieces with a checksum of their ids instead of the ids."""
    return pack(docs).select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digested(table(spark, sf_dir, "documents"))
