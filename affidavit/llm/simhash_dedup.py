"""SimHash near-duplicates: fingerprints, tiled exact comparison, components.

Every text gives a 64-bit fingerprint from the hashes of its word shingles.
Equal texts (with ``least``: equal sets of shingles; without: equal
fingerprints) collapse first, so exact copies of any number are one row.  The
rest are compared exactly by numpy exclusive-or and bit counts in tiles, whose
rows are in the order of their population counts: rows whose counts differ by
more than the radius can't link and are never compared.

* Without a similarity (radius up to 3) a tile holds fingerprints that agree on
  a mask of bits.  The masks are all choices of 2 of ``radius + 2`` equal blocks:
  two fingerprints within the radius agree on one of them, so no link is lost.
* With a similarity ``least`` a tile holds texts that agree on ROWS min-hashes
  of their shingles, one of BANDS such choices.  Bits of a fingerprint would
  serve badly: two texts of similarity 0.8 agree on a bit with probability 0.85,
  unrelated ones with 0.5, so tables would grow in number with the corpus; on a
  min-hash they agree with 0.8, unrelated ones hardly ever.
* A tile of more than ``TILE`` rows is cut by population count, and a large
  count again by hash.  Each pair of such parts is a task of its own, but pairs
  whose counts differ by more than the radius are skipped: they can't link.
* With a similarity, sketches prune a tile's candidates; the rows that are left
  meet again with their sets of shingle hashes, and every candidate pair's Jaccard
  similarity is computed exactly.  A pair is looked at in the first of the bands
  that it shares, so a set is sent to few tiles.
* A tile reports a minimum spanning forest of its exact links, never all pairs, so
  a group of m near copies costs less than m rows for each pair of parts.

Chances to lose a pair of similarity exactly 0.8, from the binomial
distribution: 2.2 in 10,000 in no common band, 1.4 in 10,000 by equal digests of
an earlier band's different keys, 2 in 100,000 by the sketch, 3 in 100,000 by the
radius of 22; a higher similarity has lower ones.

Defined cases: a null or empty text, or one of white space, has fingerprint
zero and links like any other; fewer words than a shingle give one shingle of
all; a very long text is hashed in chunks (with ``least`` its set of shingle
hashes is in memory, 8 bytes for each); rows that repeat an id are one document;
a null id is never a component's name unless all ids of it are null; further
columns pass through; an empty table gives an empty result.
"""

from __future__ import annotations

import itertools
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import forget, partitions, stored
from .components import connected_components

SEED = 42
TILE = 1024
#: Places of 16 in which the sketches of candidates agree at least: by the binomial distribution
#: all but 2 in 100,000 pairs of similarity 0.8 do, and 3 in 10,000 unrelated ones.
ALIKE = 6
#: Min-hashes that name a tile, and choices of them: a pair of similarity 0.8 is in a common tile
#: with probability 1 - (1 - 0.8 ** ROWS) ** BANDS = 0.9998.
ROWS, BANDS = 4, 16
#: Shingle hashes of a row in which a set is sent.
SENT = 1024
#: Shingles that are hashed at once, so that a very long text needs little memory.
CHUNK = 1 << 16
_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1).astype(np.int64)
_PLACE = (np.arange(8) * 256).astype(np.int64)
_MULTIPLIERS = np.random.default_rng(SEED).integers(1 << 62, 1 << 63, ROWS * BANDS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def shingle_digests(text: bytes, span: int) -> Iterator[np.ndarray]:
    """XXH64 of the shingles in order, repeats included, as rows of 8 big-endian bytes."""
    words = text.lower().split()  # bytes: only A-Z change, only ASCII white space splits
    if not words:
        return
    joined, digest = b" ".join(words), xxhash.xxh64_digest
    if len(words) <= span:
        yield np.frombuffer(digest(joined, SEED), np.uint8).reshape(1, 8)
        return
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(lengths + 1) - 1
    first, last = (ends - lengths)[: len(words) - span + 1], ends[span - 1 :]
    for k in range(0, len(first), CHUNK):
        spans = zip(first[k : k + CHUNK].tolist(), last[k : k + CHUNK].tolist(), strict=True)
        yield np.frombuffer(b"".join([digest(joined[i:j], SEED) for i, j in spans]), np.uint8).reshape(-1, 8)


def fingerprint(text: bytes, span: int, sets: bool = False) -> tuple[int, np.ndarray]:
    """Unsigned fingerprint, where a bit is 1 if set in over half the hashes, and with ``sets`` the different hashes in order."""
    counts, n, different = np.zeros((8, 256), np.int64), 0, []
    for rows in shingle_digests(text, span):
        counts += np.bincount((rows + _PLACE).ravel(), minlength=2048).reshape(8, 256)
        n += len(rows)
        if sets:
            different.append(np.unique(rows.view("<u8").ravel()))
    whole = np.unique(np.concatenate(different)) if len(different) > 1 else different[0] if different else np.zeros(0, np.uint64)
    return int.from_bytes(np.packbits((counts @ _BITS).ravel() * 2 > n).tobytes(), "big"), whole


def shingle_set(text: bytes, span: int) -> np.ndarray:
    """The different hashes of a text's shingles, in ascending order."""
    rows = [np.unique(x.view("<u8").ravel()) for x in shingle_digests(text, span)]
    return np.unique(np.concatenate(rows)) if len(rows) > 1 else rows[0] if rows else np.zeros(0, np.uint64)


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = (x ^ x >> np.uint64(30)) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ x >> np.uint64(27)) * np.uint64(0x94D049BB133111EB)
    return x ^ x >> np.uint64(31)


def traits(hashes: np.ndarray) -> tuple[int, int, np.ndarray]:
    """Of a set of hashes: a name that only an equal set has, a sketch and the keys of its BANDS tiles.

    The sketch has four bits of each of the first 16 min-hashes.
    """
    least = np.full(ROWS * BANDS, np.iinfo(np.uint64).max, np.uint64)
    for k in range(0, len(hashes), CHUNK // 16):
        least = np.minimum(least, (hashes[k : k + CHUNK // 16, None] * _MULTIPLIERS).min(0))
    sketch = ((least[:16] >> np.uint64(20) & np.uint64(15)) << np.arange(0, 64, 4, dtype=np.uint64)).sum(dtype=np.uint64)
    keys = np.zeros(BANDS, np.uint64)
    for row in least.reshape(BANDS, ROWS).T:
        keys = mixed(keys ^ row)
    name = mixed(mixed(hashes).sum(dtype=np.uint64, keepdims=True) + np.uint64(len(hashes)))
    return int(name[0]), int(sketch), keys


def fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text", span: int = 3, sets: bool = False) -> DataFrame:
    """(key, fp), and with ``sets`` also node, sketch and keys of the set of shingles and a hash h of the text.

    All numbers are signed longs.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        signed64 = lambda xs: pa.array(np.array(xs, np.uint64).view(np.int64))
        for b in batches:
            texts = [t.as_py() or b"" for t in b.column(1).cast(pa.binary())]
            found = [(f, *traits(hashes)) if sets else (f,) for f, hashes in (fingerprint(t, span, sets) for t in texts)]
            columns = [b.column(0), signed64([x[0] for x in found])]  # key, fp
            if sets:
                keys = np.array([x[3] for x in found], np.uint64).reshape(-1).view(np.int64)
                lists = pa.ListArray.from_arrays(np.arange(0, len(keys) + 1, BANDS, np.int32), keys)
                columns += [signed64([x[1] for x in found]), signed64([x[2] for x in found]), lists, b.column(2)]
            yield pa.RecordBatch.from_arrays(columns, names)

    of = docs.select(F.col(f"`{key}`").alias("key"), F.col(f"`{text}`").alias("text"), *([F.xxhash64(f"`{text}`").alias("h")] if sets else []))
    names = ["key", "fp", "node", "sketch", "keys", "h"] if sets else ["key", "fp"]
    kinds = [of.schema["key"].dataType, T.LongType(), T.LongType(), T.LongType(), T.ArrayType(T.LongType()), T.LongType()]
    return of.mapInArrow(run, T.StructType([T.StructField(n, k) for n, k in zip(names, kinds, strict=False)]))


def signed(mask: int) -> int:
    return mask - (1 << 64) if mask >> 63 else mask


def masks(radius: int) -> list[int]:
    """Bit masks such that fingerprints within ``radius`` agree on one of them."""
    cuts = [64 * i // (radius + 2) for i in range(radius + 3)]
    blocks = [((1 << (hi - lo)) - 1) << lo for lo, hi in itertools.pairwise(cuts)]
    return [a | b for a, b in itertools.combinations(blocks, 2)]


def spanning_forest(a: np.ndarray, b: np.ndarray, w: np.ndarray, n: int) -> np.ndarray:
    """Places of the edges of a minimum spanning forest (Boruvka's rounds over arrays)."""
    order = np.argsort(w, kind="stable")
    a, b, label, kept = a[order], b[order], np.arange(n), []
    while len(a):
        la, lb = label[a], label[b]
        open_ = la != lb
        a, b, la, lb, order = a[open_], b[open_], la[open_], lb[open_], order[open_]
        if not len(a):
            break
        first = np.full(n, len(a))
        np.minimum.at(first, la, np.arange(len(a)))
        np.minimum.at(first, lb, np.arange(len(a)))
        at = np.flatnonzero(first < len(a))
        kept.append(order[np.unique(first[at])])
        parent = np.arange(n)
        parent[at] = np.where(la[first[at]] == at, lb[first[at]], la[first[at]])
        mutual = (parent[parent] == np.arange(n)) & (np.arange(n) < parent)
        parent[mutual] = np.flatnonzero(mutual)
        while not np.array_equal(parent, up := parent[parent]):
            parent = up
        label = parent[label]
    return np.concatenate(kept) if kept else np.zeros(0, np.int64)


def sketches_differ(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Number of the 16 places in which sketches differ."""
    x = a ^ b
    x |= x >> np.uint64(2)
    x |= x >> np.uint64(1)
    return np.bitwise_count(x & np.uint64(0x1111111111111111))


def unit_links(
    unit: np.ndarray, fp: np.ndarray, radius: int, sketch: np.ndarray | None = None, met: Callable[[np.ndarray, np.ndarray], np.ndarray] | None = None
) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Places and distance of all links between rows of the same unit; rows are sorted by unit, then by population count.

    Rows whose counts differ by more than the radius are never compared.
    Sketches have to agree in ALIKE places where there are any, and pairs that have ``met`` elsewhere are left out.
    """
    at, ones = np.arange(len(fp)), np.bitwise_count(fp).astype(np.int16)
    for step in range(1, len(fp)):
        at = at[at + step < len(fp)]
        at = at[(unit[at] == unit[at + step]) & (ones[at + step] - ones[at] <= radius)]
        if not len(at):
            return
        far = np.bitwise_count(fp[at] ^ fp[at + step])
        near = np.flatnonzero(far <= radius)
        if sketch is not None and len(near):
            near = near[sketches_differ(sketch[at[near]], sketch[at[near] + step]) <= 16 - ALIKE]
        if met is not None and len(near):
            near = near[~met(at[near], at[near] + step)]
        if len(near):
            yield at[near], at[near] + step, far[near]


def met_before(band: np.ndarray, digests: list[np.ndarray]) -> Callable[[np.ndarray, np.ndarray], np.ndarray]:
    """Whether two places agree in the digest of an earlier band than the one that they meet in."""

    def met(i: np.ndarray, j: np.ndarray) -> np.ndarray:
        out = np.zeros(len(i), bool)
        for b in range(BANDS - 1):
            lane = np.uint64(0xFFFF << 16 * (b % 4))
            out |= (b < band[i]) & ((digests[b // 4][i] ^ digests[b // 4][j]) & lane == 0)
        return out

    return met


def forest(unit: np.ndarray, node: np.ndarray, fp: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Ends of a spanning forest of the links between rows of the same unit; rows are sorted as for :func:`unit_links`."""
    found = list(unit_links(unit, fp, radius))
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    i, j, d = (np.concatenate(x) for x in zip(*found, strict=True))
    keep = spanning_forest(i, j, d, len(fp))
    return node[i[keep]], node[j[keep]]


def shared_counts(i: np.ndarray, j: np.ndarray, sets: list[np.ndarray]) -> np.ndarray:
    """Sizes of the intersections of ``sets`` (ascending) at places ``i`` and ``j``."""
    every = np.concatenate(sets)
    values, column, count = np.unique(every, return_inverse=True, return_counts=True)
    width = int((count > 1).sum())
    if width / 64 > 8 * len(every) / len(sets):  # long sets with little in common
        return np.array([len(np.intersect1d(sets[a], sets[b], assume_unique=True)) for a, b in zip(i.tolist(), j.tolist(), strict=True)], np.int64)
    place = np.cumsum(count > 1) - 1
    row, held = np.repeat(np.arange(len(sets)), list(map(len, sets))), count[column] > 1
    row, column = row[held], place[column[held]]
    bits = np.zeros((len(sets), -(-max(width, 1) // 64)), np.uint64)
    np.bitwise_or.at(bits, (row, column // 64), np.uint64(1) << (column % 64).astype(np.uint64))
    out, some = np.zeros(len(i), np.int64), max(1, (1 << 20) // bits.shape[1])
    for k in range(0, len(i), some):
        out[k : k + some] = np.bitwise_count(bits[i[k : k + some]] & bits[j[k : k + some]]).sum(1)
    return out


def by_unit(dealt: DataFrame, links: Callable[..., Iterator[pa.RecordBatch]], schema: str, order: list) -> DataFrame:
    """``links`` of the columns of whole units of ``dealt`` (unit and further ones), in the given order."""
    names = dealt.columns
    rows_of = dealt.repartition(partitions(dealt.sparkSession), "unit").sortWithinPartitions("unit", *order)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for b in batches:
            if not len(b):
                continue
            unit = b.column("unit").to_numpy()
            k = int(np.searchsorted(unit, unit[-1]))  # the last unit may go on in the next batch
            if k or held and held[-1].column("unit")[0].as_py() != unit[0]:
                if k or held:
                    yield from call([*held, *([b.slice(0, k)] if k else [])])
                held = []
            held.append(b.slice(k))
        if held:
            yield from call(held)

    def call(parts: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = pa.Table.from_batches(parts).combine_chunks()
        arrays = {c: rows.column(c).combine_chunks() for c in names}
        flat = {c: x.chunk(0) if isinstance(x, pa.ChunkedArray) else x for c, x in arrays.items()}
        return links(**{c: x if pa.types.is_list(x.type) else x.to_numpy() for c, x in flat.items()})

    return rows_of.mapInArrow(run, schema)


def dealt_to_tiles(classes: DataFrame, radius: int, by_sets: bool = False) -> DataFrame:
    """(unit, node, fp): rows that meet; ``by_sets`` also sketch, band and digests d0 to d3, with tiles from the column keys."""
    more = ["sketch", "band", "d0", "d1", "d2", "d3"] if by_sets else []
    keys = F.col("keys") if by_sets else F.array(*[F.col("fp").bitwiseAND(F.lit(signed(m))) for m in masks(radius)])
    lane = lambda k: F.shiftleft(F.get("keys", F.lit(k)).bitwiseAND(F.lit(0xFFFF)), 16 * (k % 4))
    four = lambda k: lane(k).bitwiseOR(lane(k + 1)).bitwiseOR(lane(k + 2)).bitwiseOR(lane(k + 3))
    digests = [four(4 * k).alias(f"d{k}") for k in range(4)] if by_sets else []
    rest = ["sketch"] if by_sets else []
    keyed = classes.select("node", "fp", *rest, *digests, F.bit_count("fp").alias("p"), F.posexplode(keys).alias("band", "key"))
    groups = (
        keyed.groupBy("band", "key", "p")
        .agg(F.count("*").alias("n"))
        .groupBy("band", "key")
        .agg(F.sum("n").alias("m"), F.collect_list(F.struct("p", "n")).alias("parts"))  # at most 65 parts
        .where("m > 1")
    )
    cuts = lambda size: F.ceil(size / TILE).cast("int")
    own = F.filter("parts", lambda x: x["p"] == F.col("p"))[0]["n"]
    part = F.struct(F.col("p").alias("p"), F.pmod(F.xxhash64("node"), cuts(own)).cast("int").alias("i"))
    other = lambda x, j: F.struct(x["p"].alias("p"), j.alias("i"))
    units = F.flatten(
        F.transform(
            F.filter("parts", lambda x: F.abs(x["p"] - F.col("p")) <= radius),
            lambda x: F.transform(
                F.sequence(F.lit(0), cuts(x["n"]) - 1),
                lambda j: F.xxhash64("band", "key", F.least(F.col("part"), other(x, j)), F.greatest(F.col("part"), other(x, j))),
            ),
        )
    )
    whole = F.array(F.xxhash64("band", "key"))
    return (
        keyed.join(groups, ["band", "key"])
        .withColumn("part", part)
        .select(F.explode(F.when(F.col("m") <= TILE, whole).otherwise(units)).alias("unit"), "node", "fp", *more)
    )


def near_pairs(classes: DataFrame, radius: int) -> DataFrame:
    """(a, b): links between the nodes of ``classes`` (node, fp), enough to connect all that link."""

    def links(unit: np.ndarray, node: np.ndarray, fp: np.ndarray) -> Iterator[pa.RecordBatch]:
        a, b = forest(unit, node, fp.view(np.uint64), radius)
        yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])

    return by_unit(dealt_to_tiles(classes, radius), links, "a long, b long", [F.bit_count("fp")])


_ROW = "unit long, node long, fp long, sketch long, band int, d0 long, d1 long, d2 long, d3 long"


def _candidates(radius: int, unit, fp, sketch, band, d0, d1, d2, d3) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    met = met_before(band, [d.view(np.uint64) for d in (d0, d1, d2, d3)])
    return unit_links(unit, fp.view(np.uint64), radius, sketch.view(np.uint64), met)


def candidates(classes: DataFrame, radius: int) -> DataFrame:
    """The rows of tiles that are a candidate of another row of their tile."""

    def links(**rows: np.ndarray) -> Iterator[pa.RecordBatch]:
        kept = np.zeros(len(rows["unit"]), bool)
        for i, j, _ in _candidates(radius, **{c: x for c, x in rows.items() if c != "node"}):
            kept[i] = kept[j] = True
        yield pa.RecordBatch.from_arrays([pa.array(x[kept]) for x in rows.values()], list(rows))

    return by_unit(dealt_to_tiles(classes, radius, True), links, _ROW, [F.bit_count("fp")])


def similar(
    docs: DataFrame, rows: DataFrame, classes: DataFrame, key: str, text: str, span: int, least: float, radius: int
) -> DataFrame:
    """(a, b): candidate pairs of the tiles ``rows`` with a Jaccard similarity of ``least`` or more, enough to connect all of them."""

    def sent(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Sets of hashes in rows of at most SENT."""
        for b in batches:
            for node, t in zip(b.column(0), b.column(1).cast(pa.binary()), strict=True):
                s = shingle_set(t.as_py() or b"", span).view(np.int64)
                cut = np.r_[np.arange(0, max(1, len(s)), SENT), len(s)].astype(np.int32)
                yield pa.RecordBatch.from_arrays([pa.array([node.as_py()] * (len(cut) - 1), pa.int64()), pa.ListArray.from_arrays(cut, s)], ["node", "s"])

    own = classes.join(rows.select("node").distinct(), "node", "left_semi").select("node", "id", F.col("h").alias("of_h"))
    texts = docs.select(F.col(f"`{key}`").alias("of_id"), F.col(f"`{text}`").alias("text"), F.xxhash64(f"`{text}`").alias("h"))
    one = texts.join(own, (F.col("h") == F.col("of_h")) & F.col("id").eqNullSafe(F.col("of_id"))).select("node", "text")
    sets = one.mapInArrow(in_one_batch(sent), "node long, s array<long>")
    sets = sets.groupBy("node", F.get("s", F.lit(0)).alias("first")).agg(F.min("s").alias("s")).drop("first")

    def links(s: pa.ListArray, **given: np.ndarray) -> Iterator[pa.RecordBatch]:
        start = np.flatnonzero(np.r_[True, (given["node"][1:] != given["node"][:-1]) | (given["unit"][1:] != given["unit"][:-1])])
        row = {c: x[start] for c, x in given.items()}
        ends = s.offsets.to_numpy()[np.r_[start, len(s)]]
        hashes = s.values.to_numpy()
        found = list(_candidates(radius, **{c: x for c, x in row.items() if c != "node"}))
        a, b = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        if found:
            i, j, d = (np.concatenate(x) for x in zip(*found, strict=True))
            order = np.argsort(row["unit"][i], kind="stable")
            i, j, d = i[order], j[order], d[order]
            cut = np.flatnonzero(np.r_[True, row["unit"][i][1:] != row["unit"][i][:-1], True])
            for lo, hi in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True):
                at, where = np.unique(np.concatenate([i[lo:hi], j[lo:hi]]), return_inverse=True)
                x, y = where[: hi - lo], where[hi - lo :]
                sets_ = [np.sort(hashes[ends[k] : ends[k + 1]]) for k in at.tolist()]
                size = np.array(list(map(len, sets_)))
                both = shared_counts(x, y, sets_)
                good = np.flatnonzero(both >= least * (size[x] + size[y] - both))
                keep = good[spanning_forest(x[good], y[good], d[lo:hi][good], len(at))]
                a.append(row["node"][at[x[keep]]])
                b.append(row["node"][at[y[keep]]])
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(a)), pa.array(np.concatenate(b))], ["a", "b"])

    return by_unit(rows.join(sets, "node").select(*rows.columns, "s"), links, "a long, b long", [F.bit_count("fp"), "node"])


def in_one_batch(run: Callable) -> Callable:
    """``run`` with its small batches joined to larger ones."""

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for b in run(batches):
            held.append(b)
            size += b.nbytes
            if size >= 1 << 22:
                yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
                held, size = [], 0
        if held:
            yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]

    return joined


def simhash_components(
    docs: DataFrame, key: str = "doc_id", text: str = "text", span: int = 5, radius: int = 22, least: float | None = 0.8
) -> DataFrame:
    """(key, fp, component_id) for every row: the least key reachable over links.

    Fingerprints link at ``radius`` or fewer differing bits; unless ``least`` is
    None, such a link also needs that Jaccard similarity of the shingle sets, and
    candidates are texts with a common band of min-hashes and sketches that agree.
    Without ``least`` the radius is at most 3.  The result reads intermediate tables,
    which stay in the shared folder.
    """
    if least is None and radius > 3:
        raise ValueError("a radius above 3 needs a similarity")
    by_sets = least is not None
    fps = stored(fingerprints(docs, key, text, span, by_sets), "fingerprints")
    if by_sets:
        first = F.min_by(F.struct("key", "fp", "sketch", "keys", "h"), F.struct(F.col("key").isNull(), "key", "fp", "h"))
        classes = fps.groupBy("node").agg(first.alias("c")).select("node", F.col("c.key").alias("id"), "c.fp", "c.sketch", "c.keys", "c.h")
    else:
        fps = fps.withColumn("node", F.col("fp"))
        classes = fps.groupBy("node").agg(F.min("key").alias("id")).withColumn("fp", F.col("node"))
    classes = stored(classes, "classes")
    if by_sets:
        rows = stored(candidates(classes, radius), "candidates")
        pairs = similar(docs, rows, classes, key, text, span, least, radius)
    else:
        pairs = near_pairs(classes, radius)
    parts = connected_components(pairs)
    named = (
        classes.select("node", "id").join(parts, "node", "left")
        .withColumn("component", F.coalesce("component", "node"))
    )
    least_id = named.groupBy("component").agg(F.min("id").alias("component_id"))
    ids = stored(named.join(least_id, "component").select("node", "component_id"), "ids")
    forget(classes, *([rows] if by_sets else []))
    return fps.join(ids, "node").select(F.col("key").alias(key), "fp", "component_id")


def simhash_dedup(docs: DataFrame, key: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """``docs`` with one document left of each component, the one with the least key."""
    ids, tag = simhash_components(docs, key, text, **options), f"_{uuid.uuid4().hex[:8]}"
    kept = stored(
        ids.where(F.col(f"`{key}`").eqNullSafe(F.col("component_id"))).groupBy(F.col(f"`{key}`").alias(tag)).agg(F.count("*").alias("n")),
        "kept",
    )
    match = F.col(f"`{key}`").eqNullSafe(F.col(tag))
    once = docs.join(kept.where("n = 1").select(tag), match, "left_semi")
    if kept.where("n > 1").isEmpty():
        return once
    return once.unionByName(docs.join(kept.where("n > 1").select(tag), match, "left_semi").dropDuplicates([key]))
