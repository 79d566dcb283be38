"""Statements stitched over interruptions, by a parallel prefix scan over chunks of a transcript.

An open utterance goes on in the next one of its speaker that is no backchannel, at
most ``max_ahead`` places and ``max_gap`` seconds later; what stands between is an
interruption.  Read in order, that is a machine with few states: either no
statement is open (the next utterance starts one), or its next member is 0 to
``max_ahead - 1`` places away.  So whatever stands before it, a chunk of a transcript is a
map from those states to the state after it, together with the start of the
statement that is open then: one of the chunk's own utterances, or the one that came
in.  Such maps compose, and composition is associative.

1. Utterances are dealt out by chunk, each with the ``max_ahead`` places after it.
2. Of transcripts of more than one chunk every chunk but the last becomes its map.
3. Maps are composed in groups of ``FAN``, whose totals are composed in turn; that
   gives each chunk the state and the open statement that it begins with.
4. Every chunk is scanned from there.

So an endless open statement runs in as many tasks as it has chunks.  No task holds
more than a chunk of text, ``FAN`` maps, or one total for ``CHUNK * FAN`` utterances.

Cases: a null speaker's utterances never go on; a null text is neither open nor
goes on another; times may be null, which is never too late; further columns pass.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import is_backchannel, is_open

MAX_GAP, MAX_AHEAD = 120, 8
#: Utterances of a chunk, and maps that are composed in one task.
CHUNK, FAN = 4096, 4096
#: No statement is open.
NONE = -1


def changes(table: pa.Table, names: list[str]) -> np.ndarray:
    """Whether each row differs from the one before in any of some columns; null is a value."""
    new = np.zeros(len(table), bool)
    for name in names:
        codes = pc.dictionary_encode(table.column(name).combine_chunks(), null_encoding="encode").indices.to_numpy()
        new[1:] |= codes[1:] != codes[:-1]
    new[:1] = True
    return new


def whole_groups(batches: Iterator[pa.RecordBatch], names: list[str]) -> Iterator[pa.Table]:
    """Batches that are cut where a group of rows ends, not within one."""
    rest = None
    for b in batches:
        rest = pa.Table.from_batches([b]) if rest is None else pa.concat_tables([rest, pa.Table.from_batches([b])])
        if starts := np.flatnonzero(changes(rest, names))[1:].tolist():
            yield rest.slice(0, starts[-1])
            rest = rest.slice(starts[-1])
    if rest is not None and len(rest):
        yield rest


def continuations(table: pa.Table, first: np.ndarray, max_gap: int, max_ahead: int) -> np.ndarray:
    """How many rows ahead each utterance goes on; 0 for nowhere."""
    n = len(table)
    group = np.cumsum(first)
    t = table.column("_t").cast(pa.float64()).to_numpy()
    speaker = pc.fill_null(pc.dictionary_encode(table.column("_speaker").combine_chunks()).indices, NONE).to_numpy()
    filler, left = table.column("_filler").to_numpy(), table.column("_open").to_numpy()
    ahead, late = np.zeros(n, np.int64), np.zeros(n, bool)
    for k in range(1, min(max_ahead, n - 1) + 1):
        with np.errstate(invalid="ignore"):
            late[:-k] |= t[k:] - t[:-k] > max_gap
        good = (group[k:] == group[:-k]) & (speaker[k:] == speaker[:-k]) & (speaker[k:] != NONE) & ~filler[k:]
        hit = left[:-k] & good & ~late[:-k] & (ahead[:-k] == 0)
        ahead[:-k][hit] = k
    return ahead


def scanned(idx: list[int], ahead: list[int], state: int, start: int | None) -> tuple[list, list[bool], int, int | None]:
    """(segments, members, state after, start after) of utterances in order, from a state and an open statement's start."""
    segments, members = [], []
    for i, k in zip(idx, ahead, strict=True):
        member = state <= 0
        if member:
            start = i if state < 0 else start
            state = k - 1 if k else NONE
        else:
            state -= 1
        segments.append(start)
        members.append(member)
    return segments, members, state, start


def composed(first: tuple[list[int], list], then: tuple[list[int], list]) -> tuple[list[int], list]:
    """The map of two stretches: for each state what it is after both, and the start that is open then (None: the one that came in)."""
    (a, s), (b, t) = first, then
    return [b[x + 1] for x in a], [u if (u := t[x + 1]) is not None else own for x, own in zip(a, s, strict=True)]


def by_groups(df: DataFrame, names: list[str], order: str, work: Callable[[pa.Table, np.ndarray], Iterator[dict]], schema: str) -> DataFrame:
    """Deals rows out by ``names``, in order of ``order``, and hands whole groups with their first rows to ``work``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_groups(batches, names):
            yield from work(table, changes(table, names))

    return df.repartition(*names).sortWithinPartitions(*names, order).mapInArrow(run, schema)


def stitch(utterances: DataFrame, max_gap: int = MAX_GAP, max_ahead: int = MAX_AHEAD) -> DataFrame:
    """``utterances`` (doc_id, idx, speaker_raw, t, text, ...) with ``segment``, the idx of its statement's first, and ``member`` (false: an interruption).

    ``idx`` counts from 0 in each document.
    """
    size = max(CHUNK, max_ahead)
    chunk = lambda d: F.floor((F.col("idx") + d) / size)
    told = {
        "_t": F.col("t").cast("long"), "_speaker": F.col("speaker_raw"), "_own": chunk(0),
        "_filler": F.coalesce(is_backchannel(F.col("text")), F.lit(True)), "_open": F.coalesce(is_open(F.col("text")), F.lit(False)),
    }

    def dealt(rows: DataFrame) -> DataFrame:
        both = F.array_distinct(F.array(chunk(0), F.greatest(chunk(-max_ahead), F.lit(0))))
        return rows.withColumns(told).withColumn("_chunk", F.explode(both))

    kind = utterances.schema["doc_id"].dataType
    doc = kind.simpleString()
    states, names = max_ahead + 1, utterances.columns

    def maps(table: pa.Table, first: np.ndarray) -> Iterator[pa.RecordBatch]:
        """A chunk that is followed by another one becomes its map."""
        ahead = continuations(table, first, max_gap, max_ahead)
        own = table.column("_own").to_numpy() == table.column("_chunk").to_numpy()
        starts = np.flatnonzero(first).tolist()
        rows: list[tuple] = []
        for i, j in zip(starts, [*starts[1:], len(table)], strict=True):
            if not own[i:j].all():
                end = i + int(own[i:j].sum())
                idx, steps = table.column("idx").slice(i, end - i).to_pylist(), ahead[i:end].tolist()
                ends = [scanned(idx, steps, s, None)[2:] for s in range(NONE, max_ahead)]
                rows.append((table.column("doc_id")[i].as_py(), table.column("_chunk")[i].as_py(), [e for e, _ in ends], [s for _, s in ends]))
        yield batch(rows, kind)

    later = utterances.where(F.col("idx") >= size).select(F.col("doc_id").alias("_doc")).distinct()
    long = utterances.join(later, F.col("doc_id").eqNullSafe(F.col("_doc")), "left_semi").select("doc_id", "idx", "t", "speaker_raw", "text")
    narrow = dealt(long).select("doc_id", "_chunk", "idx", *told)
    found = by_groups(narrow, ["doc_id", "_chunk"], "idx", maps, MAPS.format(doc=doc))
    begun = beginnings(found, kind, states)

    def scan(table: pa.Table, first: np.ndarray) -> Iterator[pa.RecordBatch]:
        ahead = continuations(table, first, max_gap, max_ahead).tolist()
        idx, state, start = (table.column(c).to_pylist() for c in ("idx", "_state", "_start"))
        starts, segments, members = np.flatnonzero(first).tolist(), [], []
        for i, j in zip(starts, [*starts[1:], len(table)], strict=True):
            s, m, _, _ = scanned(idx[i:j], ahead[i:j], NONE if state[i] is None else state[i], start[i])
            segments += s
            members += m
        own = pc.equal(table.column("_own"), table.column("_chunk"))
        out = table.select(names).append_column("segment", pa.array(segments, pa.int32())).append_column("member", pa.array(members, pa.bool_()))
        yield from out.filter(own).to_batches()

    side = begun.select(F.col("doc_id").alias("_doc"), F.col("chunk").alias("_of"), F.col("state").alias("_state"), F.col("start").alias("_start"))
    rows = dealt(utterances).join(side, F.col("doc_id").eqNullSafe(F.col("_doc")) & (F.col("_chunk") == F.col("_of")), "left").drop("_doc", "_of")
    schema = T.StructType([*utterances.schema.fields, T.StructField("segment", T.IntegerType()), T.StructField("member", T.BooleanType())])
    return by_groups(rows, ["doc_id", "_chunk"], "idx", scan, schema)


MAPS = "doc_id {doc}, chunk long, states array<int>, starts array<int>"


def batch(rows: list[tuple], kind: T.DataType) -> pa.RecordBatch:
    """Rows (doc_id, chunk, states, starts) for Spark."""
    from pyspark.sql.pandas.types import to_arrow_type

    columns = list(zip(*rows, strict=True)) or [[]] * 4
    types = [to_arrow_type(kind), pa.int64(), pa.list_(pa.int32()), pa.list_(pa.int32())]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], ["doc_id", "chunk", "states", "starts"])


def beginnings(maps: DataFrame, kind: T.DataType, states: int) -> DataFrame:
    """(doc_id, chunk, state, start) that each chunk after the first begins with, from the maps of those before."""
    doc = kind.simpleString()
    grouped = maps.withColumn("part", F.floor(F.col("chunk") / FAN))
    same = (list(range(NONE, states - 1)), [None] * states)

    def prefixes(table: pa.Table, first: np.ndarray) -> Iterator[pa.RecordBatch]:
        """For each chunk the map of those before it in its group, and under -1 - group that of the whole group."""
        rows: list[tuple] = []
        docs, chunks, ends, starts = (table.column(c).to_pylist() for c in ("doc_id", "chunk", "states", "starts"))
        so_far = same
        for k in range(len(table)):
            if first[k]:
                so_far = same
            else:
                rows.append((docs[k], chunks[k], *so_far))
            so_far = composed(so_far, (ends[k], starts[k]))
            if k + 1 == len(table) or first[k + 1]:
                rows.append((docs[k], chunks[k] + 1, *so_far))  # what the chunk after the last one begins with
                rows.append((docs[k], -1 - chunks[k] // FAN, *so_far))
        yield batch(rows, kind)

    found = by_groups(grouped, ["doc_id", "part"], "chunk", prefixes, MAPS.format(doc=doc))
    inside = found.where("chunk >= 0").withColumn("part", F.floor((F.col("chunk") - 1) / FAN))
    totals = found.where("chunk < 0").withColumn("chunk", -1 - F.col("chunk"))

    def walk(table: pa.Table, first: np.ndarray) -> Iterator[pa.RecordBatch]:
        """The state and start that each group of chunks begins with."""
        rows: list[tuple] = []
        docs, parts, ends, starts = (table.column(c).to_pylist() for c in ("doc_id", "chunk", "states", "starts"))
        for k in range(len(table)):
            state, start = (NONE, None) if first[k] else (state, start)
            rows.append((docs[k], parts[k], [state], [start]))
            start = own if (own := starts[k][state + 1]) is not None else start
            state = ends[k][state + 1]
        yield batch(rows, kind)

    at = by_groups(totals, ["doc_id"], "chunk", walk, MAPS.format(doc=doc)).select(
        F.col("doc_id").alias("_doc"), F.col("chunk").alias("_part"), F.col("states")[0].alias("_state"), F.col("starts")[0].alias("_start")
    )
    joined = inside.join(at, F.col("doc_id").eqNullSafe(F.col("_doc")) & (F.col("part") == F.col("_part")))
    of = lambda c: F.get(c, F.col("_state") + 1)
    return joined.select("doc_id", "chunk", of(F.col("states")).alias("state"), F.coalesce(of(F.col("starts")), "_start").alias("start"))
