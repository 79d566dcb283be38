"""BPE with word ends, encoded through a table of distinct words and decoded through a join with the vocabulary.

1. Texts are split into words where they are read: at white space, and words of
   Latin letters, digits and common punctuation also where the tokenizer's own
   pattern cuts them.  A *run* is some documents of a task (``RUN`` characters):
   it keeps each of its words once, and each document as the numbers of its words
   in order, so text itself never moves.
2. The runs' words meet in buckets by their hash, those of a run and bucket packed
   in one frame.  A bucket's words are made distinct, and each is encoded once, by
   the tokenizers library.
3. The distinct words' ids are joined with the vocabulary (id, piece), a broadcast
   of at most ``BROADCAST`` entries, which decodes each word once.
4. Ids and pieces come back to their run by its number and the words' places in it,
   and the run's documents take theirs by position.

:func:`decode` takes lists of ids from anywhere in the same way: runs of them keep
each id once, these are joined with the vocabulary, and pieces come back by position.

A frequent word is one word of each run that has it, so no bucket is hot; runs are
of about equal size, and there are more buckets where there are more partitions.
Runs are stored in the shared folder, in buckets by their number, before they are
used twice: only words, ids and pieces are shuffled to them, and documents stay
where they are.

The vocabulary file has to be of a kind where white space ends a word and is
dropped, and whose library decoder is none (pieces joined by one space); others
are refused.  Strings of added tokens inside a text are those tokens, as in the
library.

Defined cases: a null text is encoded as an empty one, which has no ids and
decodes to an empty text, and so do null ids; a very long text is a run of its
own; null keys, repeated rows and ties are rows like any other; further columns
play no part, whatever their names; an empty table gives an empty result.
"""

from __future__ import annotations

import json
import os
import re
import uuid
import zlib
from array import array
from collections import defaultdict
from collections.abc import Callable, Iterator
from functools import lru_cache
from itertools import count

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import freed, new_folder, partitions

#: Characters and ids of a run, words that the library gets at once, entries up to which a vocabulary is broadcast, and buckets at most.
RUN, RUN_IDS, TOGETHER, BROADCAST, MOST_BUCKETS = 10 << 20, 3 << 20, 4096, 1 << 20, 100_000
#: Codes that are expanded and pieces that are packed at once.
STEP, PACKED_AT_ONCE = 1 << 20, 1 << 18
#: Letters of Latin-1 and Latin Extended-A whose lower case is one such letter, and marks that stand for themselves.
LETTERS, MARKS = "A-Za-zÀ-ÖØ-öø-įı-ſ", "¡¿«»“”‘’–—…€"
#: Words that can be cut here: their parts are encoded as the library would within the word.
PLAIN = re.compile(rf"[!-~{LETTERS}{MARKS}]+")
PARTS = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|[{LETTERS}]+|[0-9]|[^\s0-9{LETTERS}]+")
#: What Python alone takes for white space.
NOT_SPACE = re.compile("[\x1c-\x1f]")
SPACE = re.compile("[^\\S\x1c-\x1f]+")
#: How added tokens begin.
OPEN = "<|"


@lru_cache(maxsize=4)
def tokenizer_of(path: str):
    """The library's tokenizer, once in each worker."""
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    from tokenizers import Tokenizer

    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    cut = spec["pre_tokenizer"]["pretokenizers"][0]
    if not (cut["type"] == "Split" and cut["invert"] and cut["behavior"] == "Removed"):
        raise ValueError("this vocabulary may keep white space in its tokens")
    if spec["decoder"] is not None or not all(t["content"].startswith(OPEN) for t in spec["added_tokens"]):
        raise ValueError("this vocabulary decodes otherwise, or has added tokens of another form")
    tokenizer = Tokenizer.from_file(path)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    return tokenizer


def words_of(text: str) -> list[str]:
    """The words of a text between white space."""
    return [w for w in SPACE.split(text) if w] if NOT_SPACE.search(text) else text.split()


def parts_of(word: str) -> list[str]:
    """The parts of a word that are encoded apart; in lower case where that is the library's own."""
    return PARTS.findall(word.lower()) if OPEN not in word and PLAIN.fullmatch(word) else [word]


def ragged(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """All of ``start, start + 1, ...`` for each start and size, in order."""
    return np.repeat(starts - (np.cumsum(sizes) - sizes), sizes) + np.arange(int(sizes.sum()))


def expanded(codes: np.ndarray, lengths: np.ndarray, flat: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows of codes, each code replaced by its stretch of ``flat``: the rows' new lengths, and the stretches; some at a time."""
    starts = np.cumsum(sizes) - sizes
    out = [flat[ragged(starts[codes[k : k + STEP]], sizes[codes[k : k + STEP]])] for k in range(0, len(codes), STEP)]
    bounds = np.concatenate([[0], np.cumsum(lengths)])
    total = np.concatenate([[0], np.cumsum(sizes[codes], dtype=np.int64)])
    return np.diff(total[bounds]), np.concatenate([*out, np.zeros(0, flat.dtype)])


def pack(numbers: np.ndarray) -> bytes:
    """Whole numbers below 2 ** 32 in a frame: their lower halves, then the upper ones if any number has one."""
    high = (numbers >> 16).astype("<u2").tobytes() if int(numbers.max(initial=0)) >> 16 else b""
    return zstandard.ZstdCompressor(1).compress((numbers & 0xFFFF).astype("<u2").tobytes() + high)


def unpack(frame: bytes, n: int) -> np.ndarray:
    halves = np.frombuffer(zstandard.ZstdDecompressor().decompress(frame), "<u2")
    low = halves[:n].astype(np.int64)
    return low | (halves[n:].astype(np.int64) << 16) if len(halves) > n else low


def squeeze(data: bytes) -> bytes:
    return zstandard.ZstdCompressor(1).compress(data)


def copied(keys: pa.Array) -> pa.Array:
    """Keys in memory of their own: a slice of a batch would keep all of it, texts too."""
    return keys.take(pa.array(np.arange(len(keys))))


def by_frequency(codes: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Codes renumbered so that frequent ones are small, and the old code of each new one."""
    order = np.argsort(-np.bincount(codes, minlength=n), kind="stable")
    place = np.empty(n, np.uint32)
    place[order] = np.arange(n)
    return place[codes], order


class Words:
    """Texts of a run, each the numbers of its words."""

    def __init__(self) -> None:
        self.number: defaultdict = defaultdict(count().__next__)
        self.codes: list[np.ndarray] = []

    def add(self, text: str | None) -> None:
        found = words_of(text) if text else []
        self.codes.append(np.fromiter(map(self.number.__getitem__, found), np.uint32, len(found)))

    def closed(self, buckets: int) -> tuple[list[dict], np.ndarray, np.ndarray]:
        """Frames of the words by bucket, the texts' lengths in words, and their codes, which are places."""
        lengths = np.array([len(c) for c in self.codes], np.int64)
        codes = np.concatenate([*self.codes, np.zeros(0, np.uint32)])
        known, self.codes = list(self.number), []
        self.number.clear()
        number: defaultdict = defaultdict(count().__next__)
        flat, sizes = array("I"), array("I")
        for w in known:
            found = parts_of(w)
            sizes.append(len(found))
            flat.extend(map(number.__getitem__, found))
        lengths, codes = expanded(codes, lengths, np.frombuffer(flat, np.uint32), np.frombuffer(sizes, np.uint32).astype(np.int64))
        words = list(number)
        codes, order = by_frequency(codes, len(words))
        by: defaultdict = defaultdict(list)
        for place, k in enumerate(order.tolist()):
            by[zlib.crc32(words[k].encode()) % buckets].append((words[k], place))
        frames = []
        for bucket, some in by.items():
            some.sort()
            text, places = zip(*some, strict=True)
            frames.append({"bucket": bucket, "n": len(some), "words": squeeze("\n".join(text).encode()), "places": pack(np.array(places, np.uint32))})
        return frames, lengths, codes


class Ids:
    """Lists of ids of a run, each id numbered."""

    def __init__(self) -> None:
        self.ids: list[np.ndarray] = []

    def add(self, ids: list[int] | None) -> None:
        self.ids.append(np.array(ids or [], np.uint32))

    def closed(self, buckets: int) -> tuple[list[int], np.ndarray, np.ndarray]:
        lengths = np.array([len(c) for c in self.ids], np.int64)
        ids, codes = np.unique(np.concatenate([*self.ids, np.zeros(0, np.uint32)]), return_inverse=True)
        codes, order = by_frequency(codes, len(ids))
        return ids[order].tolist(), lengths, codes


NAMES = ["run", "items", "keys", "lengths", "codes"]
FRAME = T.StructType([T.StructField("bucket", T.IntegerType()), T.StructField("n", T.IntegerType()), T.StructField("words", T.BinaryType()), T.StructField("places", T.BinaryType())])


def runs(rows: DataFrame, key: str, value: str, of_text: bool) -> DataFrame:
    """(run, items, keys, lengths, codes), a run in a row: texts by their words, in frames, or lists of ids by their ids.

    Stored in buckets and read again; the catalog forgets the table, its files stay in the shared folder.
    """
    spark = rows.sparkSession
    of = rows.select(F.col(f"`{key}`").alias("key"), F.col(f"`{value}`").alias("value"))
    kind, item, most = (Words, FRAME, RUN) if of_text else (Ids, T.IntegerType(), RUN_IDS)
    buckets = min(2 * partitions(spark), MOST_BUCKETS)
    from pyspark.sql.pandas.types import to_arrow_schema

    schema = T.StructType(
        [T.StructField(n, t) for n, t in zip(NAMES, [T.LongType(), T.ArrayType(item), T.ArrayType(of.schema["key"].dataType), T.ArrayType(T.LongType()), T.BinaryType()], strict=True)]
    )
    arrow = to_arrow_schema(schema)

    def row(run: int, found: Words | Ids, keys: list[pa.Array]) -> pa.RecordBatch:
        items, lengths, codes = found.closed(buckets)
        one = lambda a: pa.ListArray.from_arrays(pa.array([0, len(a)], pa.int32()), a)
        columns = [
            pa.array([run], pa.int64()), pa.array([items], arrow.field("items").type), one(pa.concat_arrays(keys)), one(pa.array(lengths)), pa.array([pack(codes)], pa.binary())
        ]
        return pa.RecordBatch.from_arrays(columns, NAMES)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, numbers, found, size = TaskContext.get().partitionId() << 32, count(), kind(), 0
        keys: list[pa.Array] = []
        for b in batches:
            begun = 0
            for k, v in enumerate(b.column(1)):
                v = v.as_py()
                n = len(v or ()) + 1
                if size and size + n > most:
                    keys.append(copied(b.column(0).slice(begun, k - begun)))
                    yield row(first | next(numbers), found, keys)
                    begun, found, size, keys = k, kind(), 0, []
                    pa.default_memory_pool().release_unused()
                found.add(v)
                size += n
            keys.append(copied(b.column(0).slice(begun)))
        if size:
            yield row(first | next(numbers), found, keys)

    name, path = f"runs_{uuid.uuid4().hex}", new_folder(spark, "runs")
    with freed(spark):
        of.mapInArrow(work, schema).write.format("parquet").bucketBy(min(partitions(spark), MOST_BUCKETS), "run").option("path", path).saveAsTable(name)
    back = spark.table(name)
    spark.sql(f"DROP TABLE {name}")
    return back


def gathered(found: DataFrame, frames: DataFrame, finish: Callable, fields: list[T.StructField]) -> DataFrame:
    """(key, ...) of every row of the runs: ``finish`` gets a run's frames (of, ...) in any order, and its rows' codes and lengths."""
    schema = T.StructType([T.StructField("key", found.schema["keys"].dataType.elementType), *fields])

    def work(rows: pa.Table, frames: pa.Table) -> pa.Table:
        if not rows.num_rows:
            raise ValueError("a run without documents")
        keys, lengths = rows.column("keys").combine_chunks().flatten(), rows.column("lengths").combine_chunks().flatten().to_numpy()
        codes = unpack(rows.column("codes")[0].as_py(), int(lengths.sum()))
        out = pa.Table.from_arrays([keys, *finish(frames, codes, lengths)], schema.names)
        pa.default_memory_pool().release_unused()
        return out

    return found.select("run", "keys", "lengths", "codes").groupBy("run").cogroup(frames.groupBy("of")).applyInArrow(work, schema)


def in_places(places: list[np.ndarray], codes: np.ndarray) -> np.ndarray:
    """The order that puts items into their places, of which none may be missing."""
    at = np.concatenate([*places, np.zeros(0, np.int64)])
    order = np.argsort(at)
    if not np.array_equal(at[order], np.arange(len(at))) or len(codes) and int(codes.max()) >= len(at):
        raise ValueError("an item is not in the table")
    return order


SIZES, IDS, FRAMES = 0, 1, 2


def encoded_words(found: DataFrame, path: str) -> DataFrame:
    """(of, n, places, sizes, ids, lengths, text): for each run and bucket the ids of its words and what they decode to.

    A bucket's distinct words are a table: first the numbers of their ids, then the
    ids, which are joined with the vocabulary row by row, then the runs' frames, as
    numbers of its words.  The join is a broadcast one, so rows stay in their order, and
    each distinct word is encoded and decoded once.
    """

    def table(rows: pa.Table) -> pa.Table:
        number: defaultdict = defaultdict(count().__next__)
        codes = []
        for data in rows.column("words"):
            words = zstandard.ZstdDecompressor().decompress(data.as_py()).decode().split("\n")
            codes.append(pack(np.fromiter(map(number.__getitem__, words), np.uint32, len(words))))
        tokenizer, words, flat, sizes = tokenizer_of(path), list(number), array("I"), array("I")
        for k in range(0, len(words), TOGETHER):
            for e in tokenizer.encode_batch_fast(words[k : k + TOGETHER], add_special_tokens=False):
                sizes.append(len(e.ids))
                flat.extend(e.ids)
        lists = [flat[k : k + TOGETHER].tolist() for k in range(0, len(flat), TOGETHER)]
        m, runs_, ns, places = len(lists), rows.column("run").to_pylist(), rows.column("n").to_pylist(), rows.column("places").to_pylist()
        return pa.table(
            {
                "kind": pa.array([SIZES, *[IDS] * m, *[FRAMES] * len(codes)], pa.int32()), "of": pa.array([None] * (m + 1) + runs_, pa.int64()),
                "n": pa.array([len(words), *[None] * m, *ns], pa.int32()), "places": pa.array([None] * (m + 1) + places, pa.binary()),
                "numbers": pa.array([pack(np.frombuffer(sizes, np.uint32)), *[None] * m, *codes], pa.binary()),
                "list": pa.array([None, *lists, *[None] * len(codes)], pa.list_(pa.int32())),
            }
        )

    def frames(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sizes, ids, pieces = np.zeros(0, np.int64), [], []
        texts: list[bytes] | None = None
        for b in batches:
            kind = b.column("kind").to_numpy()
            cuts = [0, *(np.flatnonzero(kind[1:] != kind[:-1]) + 1).tolist(), len(kind)]
            out: list[tuple] = []
            for i, j in zip(cuts[:-1], cuts[1:], strict=True):
                part = b.slice(i, j - i)
                if not j - i:
                    continue
                if kind[i] == SIZES:
                    sizes, ids, pieces, texts = unpack(part.column("numbers")[-1].as_py(), part.column("n")[-1].as_py()), [], [], None
                elif kind[i] == IDS:
                    ids.append(part.column("id").to_numpy())
                    pieces += part.column("piece").to_pylist()
                else:
                    if texts is None:
                        flat, ends = np.concatenate([*ids, np.zeros(0, np.int32)]), np.cumsum(sizes).tolist()
                        texts = [" ".join(pieces[x:y]).encode() for x, y in zip([0, *ends[:-1]], ends, strict=True)]
                    for of, n, places, numbers in zip(*(part.column(c).to_pylist() for c in ("of", "n", "places", "numbers")), strict=True):
                        codes = unpack(numbers, n)
                        per, own = expanded(codes, np.ones(n, np.int64), flat, sizes)
                        words = [texts[k] for k in codes.tolist()]
                        out.append((of, n, places, pack(per), pack(own), pack(np.fromiter(map(len, words), np.int64, n)), squeeze(b"".join(words))))
            if out:
                types = [pa.int64(), pa.int32(), *[pa.binary()] * 5]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], ENCODED)

    rows = found.select("run", F.inline("items")).groupBy("bucket").applyInArrow(table, "kind int, of long, n int, places binary, numbers binary, list array<int>")
    each = rows.select("kind", "of", "n", "places", "numbers", F.explode_outer("list").alias("id"))
    known = vocabulary(found.sparkSession, path).withColumnRenamed("item", "id")
    joined = each.join(F.broadcast(known), "id", "left").select("kind", "of", "n", "places", "numbers", "id", "piece")
    return joined.mapInArrow(frames, "of long, n int, places binary, sizes binary, ids binary, lengths binary, text binary")


ENCODED = ["of", "n", "places", "sizes", "ids", "lengths", "text"]


def texts_of(frame: dict) -> list[str]:
    """The texts of a packed row, by their lengths in bytes."""
    ends = np.cumsum(unpack(frame["lengths"], frame["n"])).tolist()
    data = zstandard.ZstdDecompressor().decompress(frame["text"])
    return [data[i:j].decode() for i, j in zip([0, *ends[:-1]], ends, strict=True)]


def joined_texts(table: list[str], codes: np.ndarray, lengths: np.ndarray) -> pa.Array:
    """For each row its items' texts, joined by one space."""
    ends = np.cumsum(lengths)
    return pa.array([" ".join(map(table.__getitem__, codes[i:j].tolist())) for i, j in zip((ends - lengths).tolist(), ends.tolist(), strict=True)], pa.string())


def encode(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_tokens, ids, decoded): the ids of every text, and the text that they decode to."""

    def finish(frames: pa.Table, codes: np.ndarray, lengths: np.ndarray) -> list[pa.Array]:
        places, sizes, ids, texts = [], [], [], []
        for r in frames.to_pylist():
            places.append(unpack(r["places"], r["n"]))
            sizes.append(unpack(r["sizes"], r["n"]))
            ids.append(unpack(r["ids"], int(sizes[-1].sum())).astype(np.int32))
            texts += texts_of(r)
        order, size = in_places(places, codes), np.concatenate([*sizes, np.zeros(0, np.int64)])
        flat = np.concatenate([*ids, np.zeros(0, np.int32)])[ragged((np.cumsum(size) - size)[order], size[order])]
        size = size[order]
        if not size.all():  # a word without ids has no piece to be joined either
            kept = size[codes] > 0
            lengths = np.diff(np.concatenate([[0], np.cumsum(kept)])[np.cumsum(lengths)], prepend=0)
            codes = codes[kept]
        n, own = expanded(codes, lengths, flat, size)
        lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(n)]), pa.int32()), pa.array(own, pa.int32()))
        return [pa.array(n, pa.int64()), lists, joined_texts([texts[k] for k in order.tolist()], codes, lengths)]

    found = runs(docs, key, text, True)
    fields = [T.StructField("n_tokens", T.LongType()), T.StructField("ids", T.ArrayType(T.IntegerType())), T.StructField("decoded", T.StringType())]
    return gathered(found, encoded_words(found, path), finish, fields).withColumnRenamed("key", key)


def vocabulary(spark: SparkSession, path: str) -> DataFrame:
    """(item, piece): the vocabulary, to be broadcast; of more than ``BROADCAST`` entries it is refused."""
    known = sorted((i, p) for p, i in tokenizer_of(path).get_vocab(with_added_tokens=True).items())
    if len(known) > BROADCAST:
        raise ValueError(f"{len(known)} entries are too many to be broadcast")
    return spark.createDataFrame(pa.table({"item": pa.array([i for i, _ in known], pa.int32()), "piece": [p for _, p in known]}))


def packed_pieces(pieces: DataFrame) -> DataFrame:
    """(of, n, places, items, lengths, text): the rows (of, place, item, piece) of a task, those of a run together and packed."""

    def frames(rows: pa.Table) -> pa.RecordBatch:
        rows = rows.sort_by([("of", "ascending"), ("place", "ascending")]).combine_chunks()
        run, place, item, text = (rows.column(c).combine_chunks() for c in ("of", "place", "item", "piece"))
        run, place, item = run.to_numpy(), place.to_numpy(), item.to_numpy()
        cuts = [0, *(np.flatnonzero(run[1:] != run[:-1]) + 1).tolist(), len(run)]
        out: list[tuple] = []
        for i, j in zip(cuts[:-1], cuts[1:], strict=True):
            words = [t.encode() for t in text.slice(i, j - i).to_pylist()]
            out.append((int(run[i]), j - i, pack(place[i:j]), pack(item[i:j]), pack(np.fromiter(map(len, words), np.int64, len(words))), squeeze(b"".join(words))))
        types = [pa.int64(), pa.int32(), *[pa.binary()] * 4]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], ["of", "n", "places", "items", "lengths", "text"])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        some: list[pa.RecordBatch] = []
        for b in batches:
            some += [b] if len(b) else []
            if sum(map(len, some)) >= PACKED_AT_ONCE:
                yield frames(pa.Table.from_batches(some))
                some = []
        if some:
            yield frames(pa.Table.from_batches(some))

    return pieces.mapInArrow(work, "of long, n int, places binary, items binary, lengths binary, text binary")


def decode(encoded: DataFrame, path: str, key: str = "doc_id", ids: str = "ids") -> DataFrame:
    """(key, ids, decoded): the text behind lists of ids from anywhere, special tokens included; an unknown id is an error."""

    def finish(frames: pa.Table, codes: np.ndarray, lengths: np.ndarray) -> list[pa.Array]:
        places, texts, items = [], [], []
        for r in frames.to_pylist():
            places.append(unpack(r["places"], r["n"]))
            texts += texts_of(r)
            items.append(unpack(r["items"], r["n"]).astype(np.int32))
        order = in_places(places, codes)
        own = np.concatenate([*items, np.zeros(0, np.int32)])[order][codes] if len(codes) else np.zeros(0, np.int32)
        lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(lengths)]), pa.int32()), pa.array(own, pa.int32()))
        return [lists, joined_texts([texts[k] for k in order.tolist()], codes, lengths)]

    found = runs(encoded, key, ids, False)
    each = found.select(F.col("run").alias("of"), F.posexplode("items").alias("place", "item"))
    joined = each.join(F.broadcast(vocabulary(encoded.sparkSession, path)), "item").select("of", "place", "item", "piece")
    fields = [T.StructField("ids", T.ArrayType(T.IntegerType())), T.StructField("decoded", T.StringType())]
    return gathered(found, packed_pieces(joined), finish, fields).withColumnRenamed("key", key)
