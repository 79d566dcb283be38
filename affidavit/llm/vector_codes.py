"""Short codes for vectors: the nearest entries of a codebook for each part, found in whole numbers.

1. Components become integers ``floor(256 x)``; a vector is cut into ``PARTS`` equal
   consecutive parts.  Each part position has a codebook that starts as that part
   of the first vectors by id.
2. Parts and entries, padded with zeros to a power of two m, go through the
   integer Walsh-Hadamard transform (additions alone), which scales squared
   distances by m.  Coefficients are in sequency order, by their number of sign
   changes, so the first ones hold most of a part.
3. Scaled squared differences are added up coefficient by coefficient.  After the
   first one the entry that is nearest so far gives each part an upper bound: the
   whole of its distance.  From then on an entry is dropped as soon as its partial
   sum is above the bound.  Sums are whole numbers, so nothing is rounded, an entry
   is never dropped wrongly, and ties go to the lower index.
4. A round assigns all parts and replaces entries by the floor of their parts' mean.
   Tasks send sums for each entry and position, so what is shuffled and what
   reaches the driver, which holds the codebooks, depends on these alone.

Defined cases: vectors that are null, empty or hold null or non-finite components
are dropped; vectors of different lengths, or of one that the parts don't divide,
are an error; null ids come last when the codebooks are started, and rows that
repeat an id stand in the order of their vectors; fewer rows than entries give a
shorter codebook; repeated rows and ties are rows like any other; further columns
play no part, whatever their names; an empty table gives an empty result.  Values
whose sums pass 63 bits are handled as Python integers; a distance that doesn't
fit a long is an error.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import stored
from .integers import IN_LONG, decimals, finite_vectors, floors, largest

FACTOR, PARTS, ENTRIES, ROUNDS = 256, 16, 64, 2
#: Cells of the first step handled at once.
CELLS = 1 << 21


def walsh_rows(m: int) -> np.ndarray:
    """For each row of the Hadamard matrix of a power of two m its place in sequency order, as a permutation."""
    h = np.ones((1, 1), np.int64)
    while len(h) < m:
        h = np.block([[h, h], [h, -h]])
    return np.argsort((h[:, 1:] != h[:, :-1]).sum(1), kind="stable")


def transformed(x: np.ndarray) -> np.ndarray:
    """Walsh-Hadamard transform of the last axis, padded to a power of two, in sequency order."""
    size = x.shape[-1]
    m = 1 << max(0, size - 1).bit_length()
    y = np.concatenate([x, np.zeros((*x.shape[:-1], m - size), x.dtype)], -1)
    half = 1
    while half < m:
        pairs = y.reshape(*y.shape[:-1], m // (2 * half), 2, half)
        top, bottom = pairs[..., 0, :], pairs[..., 1, :]
        y = np.stack([top + bottom, top - bottom], -2).reshape(y.shape)
        half *= 2
    return y[..., walsh_rows(m)]


def nearest(x: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each row of ``x`` the index of the nearest entry and m times its squared distance; both transformed."""
    every = np.arange(len(x))
    total = (x[:, None, 0] - entries[None, :, 0]) ** 2
    guess = total.argmin(1)
    bound = ((x - entries[guess]) ** 2).sum(1)
    row, entry = np.nonzero(total <= bound[:, None])
    total = total[row, entry]
    for k in range(1, x.shape[1]):
        total = total + (x[row, k] - entries[entry, k]) ** 2
        left = total <= bound[row]
        row, entry, total = row[left], entry[left], total[left]
    starts = np.searchsorted(row, every)  # the guess is always left, so every row has an entry
    best = np.minimum.reduceat(total, starts) if len(x) else total
    hits = np.flatnonzero(total == best[row])
    return entry[hits[np.searchsorted(row[hits], every)]], best


def assigned(y: np.ndarray, codebooks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(codes, error): for each row of integers its entries' indexes by part, and the sum of squared distances."""
    parts, entries, size = codebooks.shape
    m = 1 << max(0, size - 1).bit_length()
    if (2 * m * largest(y, codebooks)) ** 2 * m * parts >= IN_LONG:
        y, codebooks = y.astype(object), codebooks.astype(object)
    elif y.dtype == object or codebooks.dtype == object:
        y, codebooks = y.astype(np.int64), codebooks.astype(np.int64)
    books = transformed(codebooks)
    codes, error = np.zeros((len(y), parts), np.int64), np.zeros(len(y), y.dtype)
    step = max(1, CELLS // entries)
    for start in range(0, len(y), step):
        x = transformed(y[start : start + step].reshape(-1, parts, size))
        for p in range(parts):
            found, best = nearest(x[:, p], books[p])
            codes[start : start + step, p] = found
            error[start : start + step] += best // m
    return codes, error


def integers(vectors: np.ndarray, parts: int, factor: int) -> np.ndarray:
    """Whole components of vectors whose length the parts divide."""
    if vectors.shape[1] % parts:
        raise ValueError(f"{parts} parts don't divide a vector of {vectors.shape[1]} components")
    return floors(vectors, factor)


def first_entries(vectors: DataFrame, key: str, vector: str, parts: int, entries: int, factor: int) -> np.ndarray:
    """The codebooks at the start: (part, entry, position)."""
    of = vectors.select(F.col(f"`{key}`").alias("key"), F.col(f"`{vector}`").cast("array<double>").alias("v"))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield b.take(pa.array(finite_vectors(b.column(1))[0]))

    rows = of.mapInArrow(work, of.schema).orderBy(F.col("key").asc_nulls_last(), "v").limit(entries).collect()
    if len({len(r.v) for r in rows}) > 1:
        raise ValueError("vectors of different lengths")
    if not rows:
        return np.zeros((parts, 0, 0), np.int64)
    y = integers(np.array([r.v for r in rows]), parts, factor)
    return y.reshape(len(rows), parts, -1).transpose(1, 0, 2)


def improved(vectors: DataFrame, vector: str, codebooks: np.ndarray, factor: int) -> np.ndarray:
    """The codebooks after one round: floors of the means of the parts that each entry is nearest to."""
    parts, entries, size = codebooks.shape

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros((parts, entries), np.int64)
        sums = np.zeros((parts, entries, size), object)
        for b in batches:
            _, x = finite_vectors(b.column(0))
            if not len(x):
                continue
            y = fitting(integers(x, parts, factor), codebooks)
            codes, _ = assigned(y, codebooks)
            y = y.reshape(len(y), parts, size)
            if largest(y) * len(y) >= IN_LONG:
                y = y.astype(object)
            for p in range(parts):
                counts[p] += np.bincount(codes[:, p], minlength=entries)
                some = np.zeros((entries, size), y.dtype)
                np.add.at(some, codes[:, p], y[:, p])
                sums[p] += some.astype(object)
        p, e = np.nonzero(counts)
        p, e, at = np.repeat(p, size), np.repeat(e, size), np.tile(np.arange(size), len(p))
        yield pa.RecordBatch.from_arrays(
            [*(pa.array(c, pa.int32()) for c in (p, e, at)), pa.array(counts[p, e]), decimals(sums[p, e, at])], ["part", "entry", "place", "n", "total"]
        )

    found = vectors.select(F.col(f"`{vector}`").alias("v")).mapInArrow(work, "part int, entry int, place int, n long, total decimal(38,0)")
    new = codebooks.astype(object)
    for r in found.groupBy("part", "entry", "place").agg(F.sum("n").alias("n"), F.sum("total").alias("total")).collect():
        new[r.part, r.entry, r.place] = int(r.total) // r.n
    return new.astype(np.int64) if largest(new) < IN_LONG else new


def fitting(y: np.ndarray, codebooks: np.ndarray) -> np.ndarray:
    parts, _, size = codebooks.shape
    if y.shape[1] != parts * size:
        raise ValueError(f"vectors of different lengths: {sorted((y.shape[1], parts * size))}")
    return y


def train(
    vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, factor: int = FACTOR
) -> np.ndarray:
    """Codebooks (part, entry, position) after some rounds over all vectors."""
    codebooks = first_entries(vectors, key, vector, parts, entries, factor)
    for _ in range(rounds if codebooks.size else 0):
        codebooks = improved(vectors, vector, codebooks, factor)
    return codebooks


def digest(codebooks: np.ndarray) -> str:
    """SHA-256 of all components in decimal, by part, entry and position, with commas between."""
    return hashlib.sha256(",".join(map(str, codebooks.ravel().tolist())).encode()).hexdigest()


def encode(vectors: DataFrame, codebooks: np.ndarray, key: str = "vec_id", vector: str = "embedding", keep: str | None = None, factor: int = FACTOR) -> DataFrame:
    """(key, keep, codes, error): each vector's codes in the order of its parts, and its squared distance from them.

    Codes are one byte each, or two (low byte first) for codebooks of more than 256 entries.
    """
    parts, entries, _ = codebooks.shape
    names = [key, *([keep] if keep else [])]
    of = vectors.select(*[F.col(f"`{c}`").alias(f"k{i}") for i, c in enumerate(names)], F.col(f"`{vector}`").alias("v"))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows, x = finite_vectors(b.column(len(names)))
            if len(rows):
                codes, error = assigned(fitting(integers(x, parts, factor), codebooks), codebooks)
                packed = [c.tobytes() for c in codes.astype("u1" if entries <= 256 else "<u2")]
                rows = pa.array(rows)
                yield pa.RecordBatch.from_arrays(
                    [*(b.column(i).take(rows) for i in range(len(names))), pa.array(packed, pa.binary()), pa.array(error.tolist(), pa.int64())],
                    [*(f"k{i}" for i in range(len(names))), "codes", "error"],
                )

    fields = [*of.schema.fields[: len(names)], T.StructField("codes", T.BinaryType()), T.StructField("error", T.LongType())]
    found = of.mapInArrow(work, T.StructType(fields))
    return found.select(*[F.col(f"k{i}").alias(c) for i, c in enumerate(names)], "codes", "error")


def compress(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", label: str = "label") -> tuple[DataFrame, np.ndarray]:
    """((key, label, codes, error, label_error), codebooks): label_error sums error over equal labels, nulls together.

    The codes are stored before they are summed, so each vector is encoded once.
    """
    codebooks = train(vectors, key, vector)
    coded = encode(vectors, codebooks, key, vector, label) if codebooks.size else encode(vectors.limit(0), codebooks, key, vector, label)
    found = stored(coded.toDF("key", "label", "codes", "error"), "codes")
    sums = found.groupBy(F.col("label").alias("of")).agg(F.sum("error").alias("label_error"))
    joined = found.join(sums, found["label"].eqNullSafe(sums["of"]))
    return joined.select(F.col("key").alias(key), F.col("label").alias(label), "codes", "error", "label_error"), codebooks
