"""Near-duplicate vectors by NN-descent, with exact links inside what it connects.

1. Equal vectors collapse to one with a weight, so any number of exact copies
   is one row.
2. A first neighbour graph comes from tiles of vectors on the same side of some
   random hyperplanes; there are as many tables of tiles as find a pair at the
   very threshold with probability ``RECALL``.  Vectors are centred before sides
   are chosen, as a common direction would put all on the same side.  A large tile
   is cut by a hash, and its parts are compared with each other.
3. NN-descent: every vector introduces its neighbours (its list, and a bounded
   sample of those that list it) to each other, and lists keep the best.  Two
   vectors that link with a third have a cosine of ``2 * least ** 2 - 1`` or more,
   so lists hold no others; a vector whose neighbours are all known from the round
   before introduces nobody.  A list that is saturated, all of it at the threshold
   or above, is doubled.  Rounds end when hardly any link is new.
4. Links at the threshold give components.  Inside a component links are counted
   exactly, pair of parts by pair of parts, so lists that stay saturated (a
   group of thousands of near copies) lose no link; only counts leave a task.
5. Recall is audited in two ways.  A bounded sample of vectors is compared by brute
   force with all vectors in blocks; it is the mean over vectors that have links, so
   one large group doesn't outweigh the rest.  And as a sample may have no link at
   all, copies of some vectors, turned away to just above the threshold, are planted
   before the tables are drawn; they go through seeds and rounds like any vector, and
   the share that found its original's component is the recall of the hardest links.
   They take no part in components and counts.  Below the target more tables are drawn,
   and if that doesn't help an error is raised.

Cosines are computed in double precision from the vectors as they are stored,
and vectors are sent as they are stored, single precision as 4 bytes a component.

Defined cases: vectors that are null, empty, zero or hold null or non-finite
components link with nothing, nor do vectors of different lengths or rows
without an id: such a row has no links, is its own component and is kept; equal
rows link by their cosine of one; rows that repeat an id are vectors of their
own under that id; further columns play no part; an empty table gives an empty
result.
"""

from __future__ import annotations

import logging
import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import forget, partitions, stored
from .components import connected_components

LEAST, RECALL, AUDITED, PLANTED, TRIES = 0.95, 0.99, 1000, 500, 3
#: Rows of a tile on average and at most, of a part of a component, neighbours of a list at first and at most, rounds.
MEAN_TILE, TILE, PART, K, MOST_K, ROUNDS, NEW = 256, 1024, 256, 6, 24, 4, 0.001
#: Least cosine, once the vectors are centred, for which tables are counted.
LOWEST = 0.5
#: Rows of a result batch.
SENT = 8192
log = logging.getLogger(__name__)


def matrix(rows: pa.Array, kind: str) -> np.ndarray:
    """Unit vectors in double precision from packed numbers of one length and ``kind``."""
    x = np.frombuffer(b"".join(rows.to_pylist()), kind).reshape(len(rows), -1).astype(float)
    x = x / np.abs(x).max(1, keepdims=True)  # neither overflow nor underflow of the norms
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def kind_of(vectors: DataFrame, vector: str) -> str:
    """How components are packed: 4 bytes each if they are stored so, else 8."""
    return "<f4" if vectors.schema[vector].dataType == T.ArrayType(T.FloatType()) else "<f8"


def usable(key: str, vector: str) -> Column:
    """Whether a row has an id and a vector that can link; never null."""
    x = F.col(f"`{vector}`").cast("array<double>")
    finite = lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf")))
    good = F.forall(x, finite) & F.exists(x, lambda c: F.coalesce(c != 0, F.lit(False)))
    return F.col(f"`{key}`").isNotNull() & F.coalesce(good, F.lit(False))


def packed(vectors: DataFrame, key: str, vector: str, kind: str) -> DataFrame:
    """(id, x): usable vectors as packed numbers."""
    of = vectors.where(usable(key, vector)).select(
        F.col(f"`{key}`").cast("long").alias("id"), F.col(f"`{vector}`").cast("array<float>" if kind == "<f4" else "array<double>").alias("x")
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = [np.array(v, kind) + np.zeros(1, kind) for v in b.column(1).to_pylist()]  # -0.0 becomes 0.0
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([v.tobytes() for v in x], pa.binary())], ["id", "x"])

    return of.mapInArrow(run, "id long, x binary")


def by_unit(df: DataFrame, work: Callable[[pa.Table], dict | None], schema: str) -> DataFrame:
    """Deals rows out by the column unit and applies ``work`` to the rows of each unit."""
    dealt = df.repartition(partitions(df.sparkSession), "unit").sortWithinPartitions("unit")

    def units(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
        rest: list[pa.RecordBatch] = []
        for b in batches:
            unit = b.column("unit").to_numpy()
            if not len(unit):
                continue
            if rest and rest[-1].column("unit")[0].as_py() != unit[0]:
                yield pa.Table.from_batches(rest)
                rest = []
            cuts = [0, *(np.flatnonzero(unit[1:] != unit[:-1]) + 1).tolist(), len(unit)]
            for i, j in zip(cuts[:-1], cuts[1:], strict=True):
                rest.append(b.slice(i, j - i))
                if j < len(unit):
                    yield pa.Table.from_batches(rest)
                    rest = []
        if rest:
            yield pa.Table.from_batches(rest)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Results go out in batches of many units: a batch for each would cost more than the work."""
        out: list[dict] = []
        size = 0
        for rows in units(batches):
            if found := work(rows.combine_chunks()):
                out.append(found)
                size += len(next(iter(found.values())))
            if size >= SENT:
                yield joined(out)
                out, size = [], 0
        if out:
            yield joined(out)

    def joined(parts: list[dict]) -> pa.RecordBatch:
        return pa.RecordBatch.from_pydict({c: pa.concat_arrays([p[c] for p in parts]) for c in parts[0]})

    return dealt.mapInArrow(run, schema)


def column(rows: pa.Table, name: str) -> pa.Array:
    c = rows.column(name).combine_chunks()
    return c.chunk(0) if isinstance(c, pa.ChunkedArray) else c


def tree(near: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ends of a spanning forest of a symmetric matrix of links."""
    left, a, b = near.any(1), [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for root in np.flatnonzero(left).tolist():
        if left[root]:
            left[root], stack = False, [root]
            while stack:
                k = stack.pop()
                new = np.flatnonzero(near[k] & left)
                left[new] = False
                a.append(np.full(len(new), k))
                b.append(new)
                stack += new.tolist()
    return np.concatenate(a), np.concatenate(b)


def introduced(rows: pa.Table, best: int, least: float, kind: str) -> dict | None:
    """Of the vectors of a unit: each one's ``best`` others that may share a link with it, and a spanning forest of the links."""
    if len(rows) < 2:
        return None
    v, x = column(rows, "v").to_numpy(), matrix(column(rows, "x"), kind)
    v, first = np.unique(v, return_index=True)
    if len(v) < 2:
        return None
    x = x[first]
    s = x @ x.T
    np.fill_diagonal(s, -2)
    k = min(best, len(v) - 1)
    near = np.argpartition(-s, k - 1, axis=1)[:, :k]
    a, b = np.repeat(np.arange(len(v)), k), near.ravel()
    close = s[a, b] >= 2 * least * least - 1
    i, j = tree(s >= least)
    a, b = np.concatenate([a[close], j]), np.concatenate([b[close], i])  # one way only: a root may have very many
    return {"v": pa.array(v[a]), "u": pa.array(v[b]), "s": pa.array(s[a, b])} if len(a) else None


def centres(classes: DataFrame, kind: str) -> dict[int, np.ndarray]:
    """Mean of the unit vectors of each length in bytes; a task sends one sum for each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        counts: dict[int, int] = {}
        for b in batches:
            sizes = np.array([len(x) for x in b.column("x").to_pylist()], np.int64)
            for size in np.unique(sizes).tolist():
                rows = np.flatnonzero(sizes == size)
                sums[size] = sums.get(size, 0) + matrix(b.column("x").take(pa.array(rows)), kind).sum(0)
                counts[size] = counts.get(size, 0) + len(rows)
        if sums:
            names = [pa.array(list(counts), pa.int64()), pa.array(list(counts.values()), pa.int64())]
            yield pa.RecordBatch.from_arrays([*names, pa.array([x.tobytes() for x in sums.values()], pa.binary())], ["size", "n", "total"])

    out: dict[int, list] = {}
    for r in classes.select("x").mapInArrow(run, "size long, n long, total binary").collect():
        total, n = out.get(r["size"], (0.0, 0))
        out[r["size"]] = (total + np.frombuffer(bytes(r["total"]), "<f8"), n + r["n"])
    return {size: total / n for size, (total, n) in out.items()}


def seeds(classes: DataFrame, n: int, least: float, turn: int, centre: dict[int, np.ndarray], kind: str) -> DataFrame:
    """(v, u, s) from tiles of vectors on the same side of random hyperplanes."""
    bits = max(1, math.ceil(math.log2(max(n, 2) / MEAN_TILE)))
    common = max((float(c @ c) for c in centre.values()), default=0.0)
    # a pair's cosine once the common direction is gone; below LOWEST the audit decides
    cosine = max(LOWEST, (least - common) / (1 - common)) if common < least else LOWEST
    agree = (1 - math.acos(cosine) / math.pi) ** bits
    tables = math.ceil(math.log(1 - RECALL) / math.log(1 - agree))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sizes = np.array([len(x) for x in b.column("x").to_pylist()], np.int64)
            keys = np.zeros((len(b), tables), np.int64)
            for size in np.unique(sizes):
                rows = np.flatnonzero(sizes == size)
                planes = np.random.default_rng([turn, int(size)]).normal(size=(len(centre[int(size)]), tables * bits))
                x = matrix(b.column("x").take(pa.array(rows)), kind) - centre[int(size)]
                side = (x @ planes > 0).reshape(len(rows), tables, bits)
                keys[rows] = side @ (1 << np.arange(bits)) * 4096 + size // 4 % 4096
            lists = pa.ListArray.from_arrays(np.arange(0, keys.size + 1, tables, np.int32), keys.ravel())
            yield pa.RecordBatch.from_arrays([b.column("v"), b.column("x"), lists], ["v", "x", "keys"])

    keyed = classes.select("v", "x").mapInArrow(run, "v long, x binary, keys array<long>")
    rows = keyed.select("v", "x", F.posexplode("keys").alias("t", "key"))
    # few tiles are large; written first, their table shows its size, so that vectors need not move to meet it
    large = stored(
        rows.groupBy("t", "key", F.length("x").alias("size")).agg(F.count("*").alias("m")).where(F.col("m") > TILE)
        .select("t", "key", "size", F.ceil(F.col("m") / TILE).cast("int").alias("cut")),
        "tiles",
    )
    cut = F.coalesce("cut", F.lit(1))
    dealt = (
        rows.withColumn("size", F.length("x")).join(large, ["t", "key", "size"], "left")
        .withColumns({"i": F.pmod(F.xxhash64("v", "t"), cut).cast("int"), "j": F.explode(F.sequence(F.lit(0), cut - 1))})
        .select("v", "x", F.xxhash64("t", "key", "size", F.least("i", "j"), F.greatest("i", "j")).alias("unit"))
    )
    return by_unit(dealt, lambda rows: introduced(rows, 2, least, kind), "v long, u long, s double")


def merged(edges: DataFrame, wide: DataFrame | None) -> DataFrame:
    """The best of each list of ``edges`` (v, u, s, fresh): K, or what ``wide`` (v, k) says; an edge that was known isn't fresh."""
    order = Window.partitionBy("v").orderBy(F.desc("s"), "u")
    top = (
        edges.groupBy("v", "u").agg(F.max("s").alias("s"), F.min("fresh").alias("fresh"))
        .withColumn("r", F.row_number().over(order))
        .where(F.col("r") <= (K if wide is None else MOST_K))
    )
    if wide is not None:
        top = top.join(wide, "v", "left").where(F.col("r") <= F.coalesce("k", F.lit(K))).drop("k")
    return top.drop("r")


def descend(graph: DataFrame, classes: DataFrame, least: float, kind: str) -> DataFrame:
    """One round: neighbours of neighbours meet, and (v, u, s) of the best pairs comes out."""
    order = Window.partitionBy("unit").orderBy(F.xxhash64("v", "unit"))
    back = (
        graph.select(F.col("u").alias("unit"), "v", "fresh")
        .withColumn("r", F.row_number().over(order))
        .where(F.col("r") <= K)
        .select("unit", "v", "fresh")
    )
    members = graph.select(F.col("v").alias("unit"), F.col("u").alias("v"), "fresh").unionAll(back)
    news = members.where("fresh").select("unit").distinct()
    met = members.select("unit", "v").distinct().join(news, "unit", "left_semi").join(classes.select("v", "x"), "v").select("unit", "v", "x")
    return by_unit(met, lambda rows: introduced(rows, 2, least, kind), "v long, u long, s double")


def exact_counts(parts: DataFrame, classes: DataFrame, least: float, kind: str) -> DataFrame:
    """(v, links): of each vector of a component the weight of the others that it links with."""
    sizes = parts.groupBy("component").agg(F.count("*").alias("m"))
    cut = F.ceil(F.col("m") / PART).cast("int")
    own = F.pmod(F.xxhash64("v"), cut).cast("int")
    dealt = (
        parts.withColumnRenamed("node", "v").join(sizes, "component").withColumns({"cut": cut}).withColumn("i", own)
        .join(classes, "v")
        .select("v", "n", "x", "i", "component", F.explode(F.sequence(F.lit(0), F.col("cut") - 1)).alias("j"))
        .select("v", "n", "x", "i", F.least("i", "j").alias("lo"), F.greatest("i", "j").alias("hi"), F.xxhash64("component", F.least("i", "j"), F.greatest("i", "j")).alias("unit"))
    )

    def count(rows: pa.Table) -> dict | None:
        v, n, i = (column(rows, c).to_numpy() for c in ("v", "n", "i"))
        lo, hi, n = column(rows, "lo").to_numpy(), column(rows, "hi").to_numpy(), n.astype(float)
        x, out = matrix(column(rows, "x"), kind), np.zeros(len(v))
        if lo[0] == hi[0]:
            near = (x @ x.T >= least).astype(float)
            np.fill_diagonal(near, 0)
            out = near @ n
        else:
            a, b = np.flatnonzero(i == lo), np.flatnonzero(i == hi)
            near = (x[a] @ x[b].T >= least).astype(float)
            out[a], out[b] = near @ n[b], n[a] @ near
        return {"v": pa.array(v), "links": pa.array(out.astype(np.int64))}

    return by_unit(dealt, count, "v long, links long").groupBy("v").agg(F.sum("links").alias("links"))


def audit(found: DataFrame, classes: DataFrame, least: float, kind: str) -> float | None:
    """Mean share of the links of each of a bounded sample of vectors, found by brute force over all, that ``found`` has.

    None if no vector of the sample has a link.
    """
    sample = classes.select("v", "x").orderBy(F.xxhash64("v")).limit(AUDITED).collect()  # at most AUDITED rows
    by_size: dict[int, list] = {}
    for r in sample:
        by_size.setdefault(len(r.x), []).append((r.v, bytes(r.x)))
    asked = {s: (np.array([v for v, _ in rows]), matrix(pa.array([x for _, x in rows], pa.binary()), kind)) for s, rows in by_size.items()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[int, int] = {}
        for b in batches:
            xs = b.column("x").to_pylist()
            sizes, n, ids = np.array([len(x) for x in xs]), b.column("n").to_numpy(), b.column("v").to_numpy()
            for size in np.unique(sizes):
                if int(size) not in asked:
                    continue
                names, q = asked[int(size)]
                rows = np.flatnonzero(sizes == size)
                for k in range(0, len(rows), 2048):
                    some = rows[k : k + 2048]
                    near = q @ matrix(pa.array([xs[i] for i in some], pa.binary()), kind).T >= least
                    near &= names[:, None] != ids[some]
                    for v, t in zip(names.tolist(), (near @ n[some]).tolist(), strict=True):
                        totals[v] = totals.get(v, 0) + t
        if totals:
            yield pa.RecordBatch.from_pydict({"v": pa.array(list(totals), pa.int64()), "all": pa.array(list(totals.values()), pa.int64())})

    true = classes.mapInArrow(run, "v long, all long").groupBy("v").agg(F.sum("all").alias("all"))
    share = F.least(F.coalesce("links", F.lit(0)), "all") / F.col("all")
    return true.where("all > 0").join(found, "v", "left").agg(F.avg(share)).first()[0]


def planted(classes: DataFrame, least: float, kind: str) -> tuple[DataFrame, list[tuple[int, int]]]:
    """Rows (v, x) of copies of at most PLANTED vectors just above the threshold, and which is whose."""
    sample = classes.select("v", "x").orderBy(F.xxhash64("v", F.lit(1))).limit(PLANTED).collect()  # at most PLANTED rows
    first = -(1 << 62)
    while not classes.where(F.col("v").between(first, first + PLANTED)).isEmpty():
        first += 1 << 20
    rng, rows, whose = np.random.default_rng(0), [], []
    for k, r in enumerate(sample):
        x = matrix(pa.array([bytes(r.x)], pa.binary()), kind)[0]
        if len(x) > 1:
            turn = rng.normal(size=len(x))
            turn -= (turn @ x) * x
            cosine = least + (1 - least) * rng.uniform(0.002, 0.05)
            copy = cosine * x + np.sqrt(1 - cosine**2) * turn / np.linalg.norm(turn)
            rows.append((first + k, bytearray(copy.astype(kind).tobytes())))
            whose.append((first + k, r.v))
    return classes.sparkSession.createDataFrame(rows, "v long, x binary"), whose


def planted_recall(links: DataFrame, parts: DataFrame, whose: list[tuple[int, int]]) -> float | None:
    """Share of the planted copies that were linked with their original or with one of its component."""
    if not whose:
        return None
    one = links.sparkSession.createDataFrame(whose, "p long, o long")
    both = links.unionAll(links.select("u", "v").toDF("v", "u"))
    met = both.join(F.broadcast(one), F.col("v") == F.col("p")).select("p", "o", "u").distinct()
    of = lambda c: parts.select(F.col("node").alias(c), F.col("component").alias(f"{c}_in"))
    joined = met.join(of("u"), "u", "left").join(of("o"), "o", "left")
    found = joined.where((F.col("u") == F.col("o")) | (F.col("u_in") == F.col("o_in"))).select("p").distinct().count()
    return found / len(whose)


def news(graph: DataFrame, least: float) -> float:
    """Mean share of the links in a vector's list that are fresh."""
    return graph.where(F.col("s") >= least).groupBy("v").agg(F.avg(F.col("fresh").cast("int")).alias("a")).agg(F.avg("a")).first()[0] or 0.0


def near_vectors(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", least: float = LEAST) -> DataFrame:
    """(key, n_links, component_id, kept) for every row."""
    kind = kind_of(vectors, vector)
    rows = stored(packed(vectors, key, vector, kind), "rows")
    same = rows.groupBy("x").agg(F.min("id").alias("id"), F.count("*").alias("n"))
    # a vector goes by its least id, or by a hash where an id names several vectors
    several = same.groupBy("id").count().where("count > 1").select("id", F.lit(True).alias("several"))
    classes = stored(
        same.join(several, "id", "left").select("x", "id", "n", F.when(F.col("several"), F.xxhash64("x")).otherwise(F.col("id")).alias("v")),
        "classes",
    )
    n = classes.count()
    centre = centres(classes, kind)
    copies, whose = planted(classes, least, kind)
    every = classes.select("v", "x").unionAll(copies)
    real = ~F.col("v").isin([p for p, _ in whose]) & ~F.col("u").isin([p for p, _ in whose])
    edges, old = None, []
    for turn in range(TRIES):
        new = stored(seeds(every, n, least, turn, centre, kind).withColumn("fresh", F.lit(True)), "edges")
        edges = new if edges is None else edges.unionAll(new)
        graph = stored(merged(edges, None), "graph")
        links, used = edges.where(F.col("s") >= least).select("v", "u"), [graph]
        for _ in range(ROUNDS):
            full = graph.groupBy("v").agg(F.min("s").alias("s"), F.count("*").alias("k"))
            full = full.where((F.col("s") >= least) & (F.col("k") >= K)).select("v", F.least(F.col("k") * 2, F.lit(MOST_K)).alias("k"))
            met = stored(descend(graph, every, least, kind).withColumn("fresh", F.lit(True)), "met")
            links = links.unionAll(met.where(F.col("s") >= least).select("v", "u"))
            after = stored(merged(graph.withColumn("fresh", F.lit(False)).unionByName(met), full), "graph")
            forget(graph)
            graph = after
            used += [met, graph]
            if news(graph, least) <= NEW:
                break
        parts = stored(connected_components(links.where(real).select(F.col("v").alias("a"), F.col("u").alias("b"))), "parts")
        counts = stored(exact_counts(parts, classes, least, kind), "counts")
        hardest = planted_recall(links, parts, whose)
        forget(*used)
        old.append(new)
        recall = audit(counts, classes, least, kind)
        log.info("recall: %s of audited vectors, %s of planted copies", recall, hardest)
        if all(x is None or x >= RECALL for x in (recall, hardest)):
            break
        if turn < TRIES - 1:
            forget(parts, counts)
    else:
        raise RuntimeError(f"after {TRIES} tries the recall is {recall} of audited vectors and {hardest} of planted copies, below {RECALL}")
    least_id = classes.join(parts.withColumnRenamed("node", "v"), "v").groupBy("component").agg(F.min("id").alias("component_id"))
    of_node = parts.join(least_id, "component").select(F.col("node").alias("v"), "component_id")
    named = stored(
        classes.join(of_node, "v", "left").join(counts, "v", "left").select(
            "x",
            (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"),
            F.coalesce("component_id", "id").alias("component_id"),
        ),
        "named",
    )
    forget(parts, counts, classes, *old)
    linked = rows.join(named, "x").select("id", "n_links", "component_id")
    alone = vectors.where(~usable(key, vector)).select(F.col(f"`{key}`").cast("long").alias("id"))
    return (
        linked.unionByName(alone.select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id")))
        .withColumn("kept", F.col("id").eqNullSafe(F.col("component_id")))
        .withColumnRenamed("id", key)
    )
