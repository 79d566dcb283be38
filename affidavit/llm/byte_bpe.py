"""Byte-level BPE by the ranks of a tiktoken file, in padded numpy matrices.

Texts are cut by the pattern; pieces that are tokens are done.  The others are
put into matrices by length, one row for each piece, padded on the right.  In
each round every row merges its leftmost pair of least rank: pairs are found in
a hash table of two arrays, the merged column is closed up, and only the two
pairs beside a merge are looked up again.  Rows without a pair leave the matrix.  A
piece of more than ``LONGEST`` bytes, where closing up would cost the square of
its length, is merged in the same order over linked places and a heap of pairs.

Each Python worker keeps a bounded cache of pieces.  Texts are handled in
runs of a few MB; a longer one goes piece by piece, so memory doesn't grow with it.

Defined cases: a null text is encoded as an empty one, which has no ids; a very
long text goes in parts, and a very long piece costs its length times the
logarithm of it; lone or repeated rows, ties and null keys are rows like any
other; an empty table gives an empty result.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
import itertools
from collections.abc import Callable, Iterator
from functools import cached_property, lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Pieces that a worker's cache holds besides the vocabulary, and characters and pieces handled at once.
CACHED, RUN, LONG, PIECES = 400_000, 1 << 20, 1 << 22, 1 << 18
#: Cells of one matrix, and the rank of a pair that doesn't merge.
CELLS, NONE = 1 << 20, np.iinfo(np.int32).max
WIDTHS = (4, 6, 8, 10, 12, 16, 20, 24, 32, 48, 64, 128, 256)
#: Bytes up to which a piece is a row of a matrix.
LONGEST = WIDTHS[-1]


class PairTable:
    """Hash table from pairs of ids to the rank of their merge: open addressing over numpy arrays."""

    def __init__(self, left: np.ndarray, right: np.ndarray, rank: np.ndarray) -> None:
        self.bits = max(4, int(np.ceil(np.log2(max(1, len(rank)) * 4))))
        self.keys = np.full(1 << self.bits, -1, np.int64)
        self.ranks = np.full(1 << self.bits, NONE, np.int32)
        key, rank = (left.astype(np.int64) << 32) | right, rank.astype(np.int32)
        at = self._slot(key)
        while len(key):
            free = np.flatnonzero(self.keys[at] < 0)
            _, first = np.unique(at[free], return_index=True)  # of those that want a slot one gets it
            got = free[first]
            self.keys[at[got]], self.ranks[at[got]] = key[got], rank[got]
            rest = np.ones(len(key), bool)
            rest[got] = False
            key, rank, at = key[rest], rank[rest], (at[rest] + 1) & ((1 << self.bits) - 1)

    def _slot(self, key: np.ndarray) -> np.ndarray:
        mixed = key.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        return (mixed >> np.uint64(64 - self.bits)).astype(np.int64)

    def __call__(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = (left.astype(np.int64) << 32) | right
        shape, key = key.shape, key.ravel()
        at = self._slot(key)
        seen = self.keys[at]
        out = np.where(seen == key, self.ranks[at], NONE)
        open_ = np.flatnonzero((seen != key) & (seen >= 0))
        while len(open_):
            at[open_] = (at[open_] + 1) & ((1 << self.bits) - 1)
            seen = self.keys[at[open_]]
            hit = seen == key[open_]
            out[open_[hit]] = self.ranks[at[open_[hit]]]
            open_ = open_[~hit & (seen >= 0)]
        return out.reshape(shape)


class ByteBpe:
    def __init__(self, ranks: dict[bytes, int], pattern: str) -> None:
        self.ranks, self.pattern = ranks, regex.compile(pattern)
        self.tokens = {i: t for t, i in ranks.items()}
        self.start = np.array([ranks[bytes([b])] for b in range(256)], np.int32)
        pairs = [
            (ranks[t[:k]], ranks[t[k:]], i)
            for t, i in ranks.items()
            for k in range(1, len(t))
            if t[:k] in ranks and t[k:] in ranks
        ]
        self.pair = PairTable(*np.array(pairs or np.zeros((0, 3)), np.int64).reshape(-1, 3).T)
        self.known = {}
        for t, i in ranks.items():
            try:
                self.known[t.decode()] = i.to_bytes(4, "little")
            except UnicodeDecodeError:
                pass
        self.cache = dict(self.known)

    def merge(self, pieces: list[bytes], width: int) -> list[bytes]:
        """Packed ids of pieces that have at most ``width`` bytes."""
        n = np.fromiter(map(len, pieces), np.int64, len(pieces))
        ids = np.zeros((len(pieces), width), np.int32)
        ids[np.arange(width) < n[:, None]] = self.start[np.frombuffer(b"".join(pieces), np.uint8)]
        rank = np.where(np.arange(1, width) < n[:, None], self.pair(ids[:, :-1], ids[:, 1:]), NONE)
        out: list[bytes] = [b""] * len(pieces)
        row = np.arange(len(pieces))
        while len(row):
            width = int(n.max())
            ids, rank = ids[:, :width], rank[:, : max(width - 1, 0)]
            at = rank.argmin(axis=1) if width > 1 else np.zeros(len(row), np.int64)
            best = rank[np.arange(len(row)), at] if width > 1 else np.full(len(row), NONE)
            done = best == NONE
            if done.any():
                for r, x, k in zip(row[done].tolist(), ids[done], n[done].tolist(), strict=True):
                    out[r] = x[:k].astype("<u4").tobytes()
                keep = ~done
                row, ids, rank, n, at, best = row[keep], ids[keep], rank[keep], n[keep], at[keep], best[keep]
                if not len(row):
                    break
            every, place = np.arange(len(row)), np.arange(width - 1)
            ids[every, at] = best
            ids = np.take_along_axis(ids, place + (place > at[:, None]), 1)  # drops the column after the merge
            n -= 1
            place = place[:-1]
            rank = np.take_along_axis(rank, place + (place >= at[:, None]), 1)  # drops the merged pair
            for side in (at - 1, at):
                r = np.flatnonzero((side >= 0) & (side < n - 1))
                rank[r, side[r]] = self.pair(ids[r, side[r]], ids[r, side[r] + 1])
        return out

    def merge_long(self, piece: bytes) -> bytes:
        """Packed ids of one long piece: the leftmost pair of least rank is merged until none is left."""
        ids = self.start[np.frombuffer(piece, np.uint8)]
        first = self.pair(ids[:-1], ids[1:])
        at = np.flatnonzero(first != NONE)
        heap = list(zip(first[at].tolist(), at.tolist(), strict=True))
        heapq.heapify(heap)
        ids, rank, n = ids.tolist(), first.tolist() + [NONE], len(ids)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        while heap:
            best, k = heapq.heappop(heap)
            if rank[k] != best:  # the pair is gone or another by now
                continue
            gone = after[k]
            ids[k], rank[gone], after[k] = best, NONE, after[gone]
            if after[k] < n:
                before[after[k]] = k
            for left in (k, before[k]):
                if left >= 0:
                    right = after[left]
                    rank[left] = self.pairs.get((ids[left], ids[right]), NONE) if right < n else NONE
                    if rank[left] != NONE:
                        heapq.heappush(heap, (rank[left], left))
        out, k = [], 0
        while k < n:
            out.append(ids[k])
            k = after[k]
        return np.array(out, "<u4").tobytes()

    @cached_property
    def pairs(self) -> dict[tuple[int, int], int]:
        """The pair table as a dictionary, made when a long piece needs it."""
        full = np.flatnonzero(self.pair.keys >= 0)
        keys = self.pair.keys[full]
        return dict(zip(zip((keys >> 32).tolist(), (keys & 0xFFFFFFFF).tolist(), strict=True), self.pair.ranks[full].tolist(), strict=True))

    def learn(self, pieces: set[str]) -> None:
        """Puts the ids of the pieces into the cache."""
        if len(self.cache) > len(self.known) + CACHED:
            self.cache = dict(self.known)
        new = sorted(((p, p.encode("utf-8", "surrogatepass")) for p in pieces - self.cache.keys()), key=lambda x: len(x[1]))
        while new and len(new[-1][1]) > LONGEST:
            name, data = new.pop()
            self.cache[name] = self.merge_long(data)
        k = 0
        while k < len(new):
            width = next(w for w in WIDTHS if w >= len(new[k][1]))
            end, most = k, max(1, CELLS // width)
            while end < len(new) and len(new[end][1]) <= width and end - k < most:
                end += 1
            names, data = zip(*new[k:end], strict=True)
            self.cache.update(zip(names, self.merge(list(data), width), strict=True))
            k = end

    def encode(self, texts: list[str]) -> Iterator[list[bytes]]:
        """For each text its packed ids (unsigned 32 bits, little-endian), in parts."""
        k = 0
        while k < len(texts):
            end, size = k, 0
            while end < len(texts) and (end == k or size + len(texts[end]) <= RUN) and len(texts[end]) <= LONG:
                size += len(texts[end])
                end += 1
            if end == k:
                yield self._long(texts[k])
                k += 1
                continue
            found = [self.pattern.findall(t) for t in texts[k:end]]
            self.learn(set(itertools.chain.from_iterable(found)))
            get = self.cache.__getitem__
            for pieces in found:
                yield [b"".join(map(get, pieces))]
            k = end

    def _long(self, text: str) -> Iterator[bytes]:
        pieces = (m.group() for m in self.pattern.finditer(text))
        while some := list(itertools.islice(pieces, PIECES)):
            self.learn(set(some))
            yield b"".join(map(self.cache.__getitem__, some))

    def decode(self, packed: bytes) -> bytes:
        return b"".join(map(self.tokens.__getitem__, np.frombuffer(packed, "<u4").tolist()))


@lru_cache(maxsize=4)
def bpe_of(path: str, pattern: str) -> ByteBpe:
    """The encoder of a rank file, once in each worker."""
    with open(path, "rb") as f:
        return ByteBpe({base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}, pattern)


def _mapped(docs: DataFrame, key: str, value: str, schema: list[tuple[str, T.DataType]], row: Callable) -> DataFrame:
    """(key, ...): ``row`` turns the values of a batch into the other columns."""
    of = docs.select(F.col(f"`{key}`").alias("key"), F.col(f"`{value}`").alias("value"))
    names = [n for n, _ in schema]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), *row(b.column(1))], ["key", *names])

    fields = [T.StructField("key", of.schema["key"].dataType), *[T.StructField(n, t) for n, t in schema]]
    return of.mapInArrow(run, T.StructType(fields)).withColumnRenamed("key", key)


def encode(docs: DataFrame, path: str, pattern: str, key: str = "doc_id", text: str = "text", decoded: bool = False) -> DataFrame:
    """(key, n_tokens, ids) with ids packed as unsigned 32-bit little-endian integers.

    With ``decoded`` the ids are decoded again, and decoded_sha256 is the hash of the bytes.
    """

    def row(values: pa.Array) -> list[pa.Array]:
        bpe = bpe_of(path, pattern)
        packed = [b"".join(x) for x in bpe.encode([t or "" for t in values.to_pylist()])]
        columns = [pa.array([len(x) // 4 for x in packed], pa.int64()), pa.array(packed, pa.binary())]
        return columns + ([pa.array([hashlib.sha256(bpe.decode(x)).hexdigest() for x in packed], pa.string())] if decoded else [])

    names = [("n_tokens", T.LongType()), ("ids", T.BinaryType()), ("decoded_sha256", T.StringType())]
    return _mapped(docs, key, text, names if decoded else names[:2], row)


def decode(encoded: DataFrame, path: str, pattern: str, key: str = "doc_id", ids: str = "ids") -> DataFrame:
    """(key, data): the bytes behind packed ids; null ids give no bytes."""

    def row(values: pa.Array) -> list[pa.Array]:
        return [pa.array([bpe_of(path, pattern).decode(x or b"") for x in values.to_pylist()], pa.binary())]

    return _mapped(encoded, key, ids, [("data", T.BinaryType())], row)


def digests(docs: DataFrame, path: str, pattern: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_tokens, ids_sha256, decoded_sha256): encodes, decodes the ids, keeps no more than hashes."""

    def row(values: pa.Array) -> list[pa.Array]:
        bpe = bpe_of(path, pattern)
        out: tuple[list, list, list] = ([], [], [])
        for parts in bpe.encode([t or "" for t in values.to_pylist()]):
            n, ids, data = 0, hashlib.sha256(), hashlib.sha256()
            for part in parts:
                n += len(part) // 4
                ids.update(part)
                data.update(bpe.decode(part))
            for column, value in zip(out, (n, ids.hexdigest(), data.hexdigest()), strict=True):
                column.append(value)
        return [pa.array(out[0], pa.int64()), pa.array(out[1], pa.string()), pa.array(out[2], pa.string())]

    names = [("n_tokens", T.LongType()), ("ids_sha256", T.StringType()), ("decoded_sha256", T.StringType())]
    return _mapped(docs, key, text, names, row)
