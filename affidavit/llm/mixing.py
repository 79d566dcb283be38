"""Mixing sources to target weights by Poisson replication, in DataFrame functions only.

A source's mean repetition rate is its target share of the output divided by
its share of the input.  Every document gets a number of copies from a Poisson
distribution with that mean, by inverting it at a uniform number that is hashed
from seed and document id; copies get a second hashed number, and the output is
ordered by it over all partitions.

A mean above ``MOST_RATE`` is cut into equal parts of at most that, each with a
hashed number of its own; their sum has the Poisson distribution with the whole mean.

Shares are in characters, so that one source of long texts doesn't take over.
Sizes are summed by partial aggregates, the table of rates has a row for each
source and is broadcast only behind a check of its size, and rows are dealt by a
hash, so a source with a third of all rows is no hot partition.

Defined cases: a null source is a source of its own; an unlisted one gets
``other`` (by default an equal share); a null or empty text counts one
character; a very long text is one row like any other; rows that repeat an id get the same number of copies each; an empty
input, or weights that are all zero, give an empty result; columns named as one
of the added ones are replaced.
"""

from __future__ import annotations

import math
import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import partitions

#: Rates above this are split into equal parts, so that the inversion stays short and exact.
MOST_RATE = 16.0
#: Steps of the inversion: beyond 80 the probability left is below 2^-52 for every mean up to MOST_RATE.
STEPS = 80
#: Up to so many sources the table of rates is sent to every task.
MOST_SENT = 100_000
ADDED = ("n_copies", "copy", "place")


def uniform(*parts: Column) -> Column:
    """A number in [0, 1) from the first 52 bits of the MD5 of the parts."""
    digest = F.md5(F.concat_ws(":", *parts))
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") / F.lit(2.0**52)


def poisson(u: Column, mean: Column) -> Column:
    """The least k with P(X <= k) > u for X Poisson with ``mean`` (at most MOST_RATE)."""
    start = F.struct(F.exp(-mean).alias("p"), F.exp(-mean).alias("c"), F.lit(0).alias("k"))
    step = lambda s, i: F.when(s["c"] > u, s).otherwise(
        F.struct(
            (s["p"] * mean / i).alias("p"), (s["c"] + s["p"] * mean / i).alias("c"), i.alias("k")
        )
    )
    return F.aggregate(F.sequence(F.lit(1), F.lit(STEPS)), start, step)["k"]


def rates(
    docs: DataFrame, weights: dict[str, float] | None = None, other: float = 1.0, by: str = "source",
    text: str = "text", total: float | None = None,
) -> DataFrame:
    """(source, n_chars, rate), where sum(rate * n_chars) is ``total`` (by default the input's size)."""
    size = F.greatest(F.length(F.coalesce(text, F.lit(""))), F.lit(1)).cast("long")
    sizes = docs.groupBy(F.col(f"`{by}`").alias("source")).agg(F.sum(size).alias("n_chars"))
    weight = F.lit(float(other))
    for name, w in (weights or {}).items():
        weight = F.when(F.col("source") == name, F.lit(float(w))).otherwise(weight)
    sums = sizes.agg(F.sum(weight).alias("all_weight"), F.sum("n_chars").alias("all_chars"))
    goal = F.lit(float(total)) if total is not None else F.col("all_chars").cast("double")
    return sizes.crossJoin(F.broadcast(sums)).select(  # one row
        "source", "n_chars", (F.coalesce(F.try_divide(weight, F.col("all_weight")), F.lit(0.0)) * goal / F.col("n_chars")).alias("rate")
    )


def mix(
    docs: DataFrame, weights: dict[str, float] | None = None, other: float = 1.0, seed: int = 42,
    by: str = "source", key: str = "doc_id", text: str = "text", total: float | None = None,
) -> DataFrame:
    """``docs`` repeated to the target weights, with ``n_copies``, ``copy`` (from 0) and ``place``.

    Partitions hold consecutive ranges of ``place``, each in its order.
    """
    if not all(math.isfinite(w) and w >= 0 for w in [*(weights or {}).values(), other]):
        raise ValueError("weights are finite and not negative")
    spark, tag = docs.sparkSession, uuid.uuid4().hex[:8]
    source, rate = f"source_{tag}", f"rate_{tag}"
    table = rates(docs, weights, other, by, text, total).select(
        F.col("source").alias(source), F.col("rate").alias(rate)
    )
    if docs.select(f"`{by}`").distinct().limit(MOST_SENT + 1).count() <= MOST_SENT:
        table = F.broadcast(table)
    columns = [c for c in docs.columns if c not in ADDED]
    identity = F.coalesce(F.col(f"`{key}`").cast("string"), F.lit("null"))
    parts = F.ceil(F.col(rate) / MOST_RATE).cast("int")
    drawn = lambda k: poisson(uniform(F.lit(seed), F.lit("part"), identity, k), F.col(rate) / parts)
    copies = F.when(parts <= 1, poisson(uniform(F.lit(seed), identity), F.col(rate))).otherwise(
        F.aggregate(F.transform(F.sequence(F.lit(1), F.greatest(parts, F.lit(1))), drawn), F.lit(0), lambda n, k: n + k)
    )
    n = partitions(spark)
    return (
        docs.join(table, F.col(f"`{by}`").eqNullSafe(F.col(source)))
        .select(*[F.col(f"`{c}`") for c in columns], copies.cast("int").alias("n_copies"))
        .where("n_copies > 0")
        .withColumn("copy", F.explode(F.sequence(F.lit(0), F.col("n_copies") - 1)))
        .withColumn("place", uniform(F.lit(seed), F.lit("place"), identity, F.col("copy")))
        .repartitionById(n, F.floor(F.col("place") * n).cast("int"))
        .sortWithinPartitions("place", f"`{key}`", "copy")
    )
