"""Connected components by repeated contraction of edges, as DataFrame joins.

Every round sends each node to the neighbour (or itself) whose salted hash is
least, renames the edges' ends and drops loops and repeats.  A connected part
shrinks by a constant factor in expectation whatever its shape, so a chain of
n nodes takes O(log n) rounds.  Minima are partial aggregates and renaming is a
join that adaptive execution can split, so a node with very many edges doesn't
meet in one task.  Once at most ``FEW`` edges are left, one task finishes them
in a few MB of memory, as rounds over so little would be all overhead; the
result is the same either way.  No edge, label or component reaches the driver.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import forget, stored

#: Edges that one task finishes.
FEW = 1 << 18


def groups_of(i: np.ndarray, j: np.ndarray, n: int) -> np.ndarray:
    """The least place that each of ``n`` places is connected with."""
    label = np.arange(n)
    while True:
        least = np.minimum(label[i], label[j])
        new = label.copy()
        np.minimum.at(new, label[i], least)
        np.minimum.at(new, label[j], least)
        while not np.array_equal(new, up := new[new]):
            new = up
        if np.array_equal(new, label):
            return label
        label = new


def finished(live: DataFrame) -> DataFrame:
    """(node, to) of at most FEW edges: the least node reachable."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = [(b.column(0).to_numpy(), b.column(1).to_numpy()) for b in batches]
        if parts:
            a, b = (np.concatenate(x) for x in zip(*parts, strict=True))
            node, at = np.unique(np.concatenate([a, b]), return_inverse=True)
            group = groups_of(at[: len(a)], at[len(a) :], len(node))
            yield pa.RecordBatch.from_arrays([pa.array(node), pa.array(node[group])], ["node", "to"])

    return live.select("a", "b").coalesce(1).mapInArrow(run, "node long, to long")


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, component): component is the least node reachable.

    ``edges`` has long columns ``a`` and ``b``; nulls and loops are ignored.
    Only nodes with an edge to another node are returned; an empty input gives
    an empty result.
    """
    live = stored(
        edges.where("a is not null and b is not null and a <> b")
        .select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
        .distinct(),
        "edges",
    )
    labels: DataFrame | None = None
    for turn in range(max_rounds):
        if live.count() <= FEW:
            break
        rank = lambda c: F.struct(F.xxhash64(F.col(c), F.lit(turn)).alias("h"), F.col(c).alias("n"))
        both = live.select(F.col("a").alias("node"), rank("b").alias("r")).unionAll(
            live.select(F.col("b").alias("node"), rank("a").alias("r"))
        )
        best = both.groupBy("node").agg(F.min("r").alias("r"))
        step = stored(best.select("node", F.least(F.col("r"), rank("node"))["n"].alias("to")), "step")
        moved = (
            live.join(step.select(F.col("node").alias("a"), F.col("to").alias("ta")), "a")
            .join(step.select(F.col("node").alias("b"), F.col("to").alias("tb")), "b")
            .where("ta <> tb")
            .select(F.least("ta", "tb").alias("a"), F.greatest("ta", "tb").alias("b"))
            .distinct()
        )
        rest = stored(moved, "edges")
        forget(live)
        live = rest
        labels = relabelled(labels, step)
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    last = stored(finished(live), "step")
    forget(live)
    if labels is None:
        return last.select("node", F.col("to").alias("component"))
    labels = relabelled(labels, last)
    least = labels.groupBy("label").agg(F.min("node").alias("component"))
    return labels.join(least, "label").select("node", "component")


def relabelled(labels: DataFrame | None, step: DataFrame) -> DataFrame:
    """``labels`` (node, label) after the labels have moved by ``step`` (node, to); replaces the files of both."""
    if labels is None:
        return step.withColumnRenamed("to", "label")
    new = stored(
        labels.join(step.select(F.col("node").alias("label"), "to"), "label", "left").select("node", F.coalesce("to", "label").alias("label")),
        "labels",
    )
    forget(labels, step)
    return new
