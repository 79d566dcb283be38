"""Token files: separately compressed documents that share a zstandard dictionary.

A folder holds the dictionary, and for every shard a data file and an index.

* ``dictionary`` is trained on the serialized id arrays of a bounded sample of
  documents; a shard's index names its SHA-256, and reading checks it.
* ``tokens-N.bin`` has one zstandard frame for each document: its ids as
  little-endian integers of 2 bytes, or 4 where the vocabulary needs it.
* ``tokens-N.idx`` is an Arrow file with key, offset, length and n_tokens for
  each document, in the data file's order: a short document is read by one seek.

Shards hold consecutive ranges of the key, each in ascending order, so the
folder's order is the key's.  Texts are encoded where they are read and only
frames cross the network.  A task writes under a name of its own and moves its
files into place when they are whole, so a task that is lost and run again
leaves the same files.

The encoder takes the runs between white space, each different run once while a
worker's bounded cache holds it, and gives many new ones to the library at once,
with a token between them; the vocabulary file is of a kind where white space
always ends a token and is dropped, which is checked.

Defined cases: a null text counts as empty and has the end id alone; a very long
text is one frame, and its ids are in memory at once; null keys come first; rows
that repeat a key stay, in the order of their frames; further columns play no
part; a key that is no number is an error; an empty table gives a folder without shards.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
import struct
import uuid
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
import zstandard
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import partitions

#: Documents that the dictionary is trained on at most, bytes of their ids after which no further
#: document is taken (each is taken whole, in samples of PIECE bytes), and the dictionary's bytes.
SAMPLE, SAMPLE_BYTES, PIECE, DICTIONARY = 2000, 16 << 20, 16 << 10, 64 << 10
#: What stands between words that are encoded together, and how many these are.
BETWEEN, TOGETHER = "|", 512
CACHED, RUN, LEVEL, FLUSH = 600_000, 1 << 20, 1, 4 << 20
#: Characters that only one of Python and the tokenizer's patterns takes for white space.
_UNSURE = re.compile("[\x1c-\x1f\x85\u180e\u200b\ufeff]")


class WordEncoder:
    """Encodes texts by a tokenizers file, run of non-space characters by run."""

    def __init__(self, path: str) -> None:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        pieces = spec["pre_tokenizer"]["pretokenizers"]
        specials = [t["content"] for t in spec["added_tokens"]]
        self.lower = any(n["type"] == "Lowercase" for n in spec["normalizer"]["normalizers"]) and specials == [t.lower() for t in specials]
        if not (pieces[0]["type"] == "Split" and pieces[0]["invert"] and pieces[0]["behavior"] == "Removed"):
            raise ValueError("this vocabulary may keep white space in its tokens")
        self.width = 2 if self.tokenizer.get_vocab_size() <= 1 << 16 else 4
        between = self.tokenizer.encode(BETWEEN, add_special_tokens=False).ids
        self.between = between[0] if len(between) == 1 else None
        self.cache: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    def pack(self, ids: list[int]) -> bytes:
        return struct.pack(f"<{len(ids)}{'H' if self.width == 2 else 'I'}", *ids)

    def learn(self, words: set[str]) -> None:
        """Puts the ids of the words into the cache; what a full cache held stays until the next one is full."""
        if len(self.cache) > CACHED:
            self.cache, self.older = {}, self.cache
        cache, older, new = self.cache, self.older, []
        for w in words:
            if w not in cache:
                if w in older:
                    cache[w] = older[w]
                else:
                    new.append(w)
        # the vocabulary is of lower case; beyond ASCII the tokenizer's own rules may differ from Python's
        plain = [w.lower() if w.isascii() else w for w in new] if self.lower else new
        once = dict.fromkeys(plain)
        together = [w for w in once if self.between is not None and BETWEEN not in w]
        ids = dict(zip(together, self.separated(together), strict=True))
        alone = [w for w in once if w not in ids]
        ids.update(zip(alone, self.whole(alone), strict=True))
        self.cache.update(zip(new, map(ids.__getitem__, plain), strict=True))

    def separated(self, words: list[str]) -> Iterator[bytes]:
        """The packed ids of words without BETWEEN, from few calls of the library."""
        space = f" {BETWEEN} "
        lines = [space.join(words[k : k + TOGETHER]) for k in range(0, len(words), TOGETHER)]
        for k, e in enumerate(self.tokenizer.encode_batch_fast(lines, add_special_tokens=False)):
            ids = np.array(e.ids, f"<u{self.width}")
            data, cut = ids.tobytes(), np.flatnonzero(ids == self.between) * self.width
            starts, ends = [0, *(cut + self.width).tolist()], [*cut.tolist(), len(data)]
            if len(ends) != len(words[k * TOGETHER : (k + 1) * TOGETHER]):
                raise ValueError("the vocabulary does not keep words apart")
            yield from (data[i:j] for i, j in zip(starts, ends, strict=True))

    def whole(self, texts: list[str]) -> list[bytes]:
        return [self.pack(e.ids) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def encode(self, texts: list[str]) -> Iterator[bytes]:
        """The packed ids of every text."""
        k = 0
        while k < len(texts):
            end, size = k, 0
            while end < len(texts) and (end == k or size + len(texts[end]) <= RUN):
                size += len(texts[end])
                end += 1
            runs = [None if _UNSURE.search(t) else t.split() for t in texts[k:end]]
            self.learn(set().union(*[r for r in runs if r is not None]))
            get = self.cache.__getitem__
            for text, words in zip(texts[k:end], runs, strict=True):
                yield self.whole([text])[0] if words is None else b"".join(map(get, words))
            k = end


@lru_cache(maxsize=4)
def encoder_of(path: str) -> WordEncoder:
    return WordEncoder(path)


def file_system(folder: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a folder that Spark names, and the path in it."""
    if re.match("file:/|/", folder):
        return pafs.LocalFileSystem(), re.sub("^file:/+", "/", folder)
    return pafs.FileSystem.from_uri(folder)


def put(folder: str, name: str, write: Callable) -> None:
    """Writes a file under a name of its own, then moves it into place."""
    fs, at = file_system(folder)
    fs.create_dir(at)
    own = f"{at}/.{name}-{uuid.uuid4().hex}"
    with fs.open_output_stream(own) as f:
        write(f)
    fs.move(own, f"{at}/{name}")


def get(folder: str, name: str) -> bytes:
    fs, at = file_system(folder)
    with fs.open_input_stream(f"{at}/{name}") as f:
        return f.read()


def train(docs: DataFrame, path: str, key: str, text: str, end_id: int) -> bytes:
    """The dictionary from the sampled documents, which are those of least hash."""
    named = docs.select(
        F.xxhash64(F.col(f"`{key}`").cast("string")).alias("h"), F.xxhash64(f"`{text}`").alias("g"), F.col(f"`{text}`").alias("text")
    )
    # the hashes are drawn first and the texts fetched then, so that only sampled texts leave their tasks
    drawn = named.where("text is not null").select("h", "g").distinct().orderBy("h", "g").limit(SAMPLE)
    sample = named.join(F.broadcast(drawn), ["h", "g"], "left_semi").dropDuplicates(["h", "g"]).orderBy("h", "g")
    found, size = [], 0
    for r in sample.mapInArrow(_sampled(path, end_id), "ids binary").toLocalIterator():
        ids = bytes(r.ids)
        found += [ids[k : k + PIECE] for k in range(0, len(ids), PIECE)]
        size += len(ids)
        if size >= SAMPLE_BYTES:
            break
    try:
        return zstandard.train_dictionary(DICTIONARY, found).as_bytes()
    except zstandard.ZstdError:  # too little to train on: the samples serve as they are
        return b"".join(found)[:DICTIONARY]


def _sampled(path: str, end_id: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            e = encoder_of(path)
            for x in e.encode(b.column("text").to_pylist()):
                yield pa.RecordBatch.from_arrays([pa.array([x + e.pack([end_id])], pa.binary())], ["ids"])

    return run


def _dictionary(data: bytes) -> zstandard.ZstdCompressionDict | None:
    return zstandard.ZstdCompressionDict(data) if data else None


def write_tokens(
    docs: DataFrame, folder: str, path: str, end_id: int, key: str = "doc_id", text: str = "text", shards: int | None = None
) -> DataFrame:
    """Writes the folder; returns its shards (shard, n_docs, n_tokens, n_bytes).

    ``path`` is the tokenizers file, at the same place on every machine.
    """
    spark = docs.sparkSession
    if not isinstance(docs.schema[key].dataType, T.NumericType):
        raise TypeError(f"shards are ranges of a numeric key, and {key} is none")
    data = train(docs, path, key, text, end_id)
    put(folder, "dictionary", lambda f: f.write(data))
    digest = hashlib.sha256(data).hexdigest()
    shards = shards or partitions(spark)
    # where the ranges of the key are cut: from all keys, a numeric column only
    at = F.percentile_approx(F.col(f"`{key}`"), F.array(*[F.lit(i / shards) for i in range(1, shards)] or [F.lit(0.5)]))
    cuts = np.unique(np.array(docs.select(at.alias("at")).first()["at"] or [0])) if shards > 1 else np.zeros(0, np.int64)
    of = docs.select(F.col(f"`{key}`").alias("key"), F.col(f"`{text}`").alias("text"))
    key_type = of.schema["key"].dataType

    def frames(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e, d = encoder_of(path), _dictionary(data)
        press, end = zstandard.ZstdCompressor(LEVEL, dict_data=d), e.pack([end_id])
        for b in batches:
            keys = b.column(0)
            shard = np.searchsorted(cuts, keys.fill_null(0).to_numpy(zero_copy_only=False), "left").astype(np.int32)
            shard[keys.is_null().to_numpy(zero_copy_only=False)] = 0
            n, out, size, first = [], [], 0, 0
            for x in e.encode([t or "" for t in b.column(1).to_pylist()]):
                out.append(press.compress(x + end))
                n.append(len(x) // e.width + 1)
                size += len(out[-1])
                if size >= FLUSH or first + len(out) == len(b):
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(shard[first : first + len(out)]), keys.slice(first, len(out)), pa.array(n, pa.int64()), pa.array(out, pa.binary())],
                        ["shard", "key", "n", "frame"],
                    )
                    first, n, out, size = first + len(out), [], [], 0

    def save(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Writes each shard of the partition from its sorted rows."""
        fs, at = file_system(folder)
        fs.create_dir(at)
        shard, stream, own, rows, done = None, None, "", [], []

        def close() -> None:
            stream.close()
            name = f"tokens-{shard:06d}"
            index = pa.Table.from_batches(rows).replace_schema_metadata(
                {"dictionary": digest, "width": str(encoder_of(path).width), "end_id": str(end_id)}
            )

            def write(f) -> None:
                with pa.ipc.new_file(f, index.schema) as w:
                    w.write_table(index)

            fs.move(own, f"{at}/{name}.bin")
            put(folder, f"{name}.idx", write)
            n = index.column("n_tokens").to_numpy()
            done.append((shard, len(n), int(n.sum()), offset))

        for b in batches:
            numbers = b.column("shard").to_numpy()
            for s in np.unique(numbers):
                i, j = np.searchsorted(numbers, [s, s + 1])
                part = b.slice(int(i), int(j - i))
                if s != shard:
                    if stream:
                        close()
                    shard, offset, rows = int(s), 0, []
                    own = f"{at}/.tokens-{s:06d}-{uuid.uuid4().hex}"
                    stream = fs.open_output_stream(own)
                sizes = np.array([len(x) for x in part.column("frame").to_pylist()], np.int64)
                stream.write(b"".join(part.column("frame").to_pylist()))
                starts = offset + np.cumsum(sizes) - sizes
                rows.append(pa.RecordBatch.from_arrays(
                    [part.column("key"), pa.array(starts), pa.array(sizes), part.column("n")], ["key", "offset", "length", "n_tokens"]
                ))
                offset += int(sizes.sum())
        if stream:
            close()
        if done:
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*done, strict=True), _SHARD, strict=True)], list(_SHARD_NAMES))

    frame_type = T.StructType(
        [T.StructField("shard", T.IntegerType()), T.StructField("key", key_type), T.StructField("n", T.LongType()), T.StructField("frame", T.BinaryType())]
    )
    dealt = (
        of.mapInArrow(frames, frame_type)
        .repartitionById(shards, F.col("shard"))
        .sortWithinPartitions("shard", "key", "n", "frame")
    )
    dealt.mapInArrow(save, "shard int, n_docs long, n_tokens long, n_bytes long").write.parquet(f"{folder}/shards")
    return spark.read.schema("shard int, n_docs long, n_tokens long, n_bytes long").parquet(f"{folder}/shards")


_SHARD, _SHARD_NAMES = (pa.int32(), pa.int64(), pa.int64(), pa.int64()), ("shard", "n_docs", "n_tokens", "n_bytes")


class ShardReader:
    """One shard, document by document or at a place."""

    def __init__(self, folder: str, shard: int) -> None:
        fs, at = file_system(folder)
        name = f"{at}/tokens-{shard:06d}"
        with fs.open_input_file(f"{name}.idx") as f:
            self.index = pa.ipc.open_file(f).read_all()
        meta = {k.decode(): v.decode() for k, v in self.index.schema.metadata.items()}
        data = get(folder, "dictionary")
        if hashlib.sha256(data).hexdigest() != meta["dictionary"]:
            raise ValueError(f"{name}: written with another dictionary")
        self.width = int(meta["width"])
        self.expand = zstandard.ZstdDecompressor(dict_data=_dictionary(data))
        self.file = fs.open_input_file(f"{name}.bin")

    def ids(self, place: int) -> np.ndarray:
        """The ids of the document at a place of the index, by one seek."""
        row = self.index.slice(place, 1)
        frame = self.file.read_at(row.column("length")[0].as_py(), row.column("offset")[0].as_py())
        return np.frombuffer(self.expand.decompress(frame), f"<u{self.width}").astype("<u4")

    def __iter__(self) -> Iterator[tuple]:
        for b in self.index.to_batches(max_chunksize=1024):
            offset, length = b.column("offset").to_numpy(), b.column("length").to_numpy()
            for k, name, n in zip(range(len(b)), b.column("key").to_pylist(), b.column("n_tokens").to_pylist(), strict=True):
                frame = self.file.read_at(int(length[k]), int(offset[k]))
                yield name, n, np.frombuffer(self.expand.decompress(frame), f"<u{self.width}").astype("<u4")


def read_tokens(
    spark: SparkSession, folder: str, key: str = "doc_id", key_type: T.DataType | None = None,
    value: tuple[str, str, Callable] = ("ids", "binary", lambda ids: ids.tobytes()),
) -> DataFrame:
    """(key, start, n_tokens, value) of every document of a folder.

    ``start`` counts the ids of all documents before; ``value`` gives name, type
    and function of what is made of the ids, by default the packed ids.
    """
    shards = spark.read.schema("shard int, n_docs long, n_tokens long, n_bytes long").parquet(f"{folder}/shards")
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)  # a row for each shard
    dealt = shards.select(
        "shard", F.coalesce(F.sum("n_tokens").over(before), F.lit(0).cast("long")).alias("base")
    ).repartition(partitions(spark), "shard")
    name, kind, make = value
    key_type = key_type or T.LongType()
    schema = T.StructType([T.StructField(key, key_type), T.StructField("start", T.LongType()), T.StructField("n_tokens", T.LongType())])
    schema = T.StructType([*schema.fields, T.StructField(name, T._parse_datatype_string(kind))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for shard, start in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                rows: list[tuple] = []
                size = 0
                for name_, n, ids in ShardReader(folder, shard):
                    if n != len(ids):
                        raise ValueError(f"shard {shard}: the index tells {n} ids, the frame has {len(ids)}")
                    rows.append((name_, start, n, make(ids)))
                    start, size = start + n, size + n
                    if size >= FLUSH or len(rows) >= 10_000:
                        yield _batch(rows, schema)
                        rows, size = [], 0
                if rows:
                    yield _batch(rows, schema)

    return dealt.mapInArrow(run, schema)


def _batch(rows: list[tuple], schema: T.StructType) -> pa.RecordBatch:
    from pyspark.sql.pandas.types import to_arrow_type

    columns = zip(*rows, strict=True)
    return pa.RecordBatch.from_arrays(
        [pa.array(list(c), to_arrow_type(f.dataType)) for c, f in zip(columns, schema.fields, strict=True)], schema.names
    )
