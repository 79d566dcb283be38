"""BM25 from a stored inverted index: built once, read by the buckets of a query's words, block by block.

A folder holds

* ``units``: key, place, tokens and length of every live unit, in the order they were read;
* ``terms``: (bucket, token, df, cf);
* ``postings``: for each token and block of ``SPAN`` consecutive places one row with
  places, counts and lengths of the units that hold it, and the greatest weight among them;
* ``meta``: numbers of the corpus, parameters, and the mark of the source.

Postings and terms are partitioned by ``bucket``, a hash of the token, so a query
reads the folders of its own words only, and sorted by token inside, so of their
files only a few row groups.  A block's greatest weights bound the score of each
unit in it.  For the best k the blocks of greatest bounds are scored first, which
gives a score that k units reach; then only blocks whose bound reaches it are read
(block-max skipping).  No text is read or cut into tokens by a query.

A token of every unit is one row for each block, dealt out by bucket and a slice
of the blocks, so a frequent one meets in no task; no list is longer than SPAN.

Cases: units that repeat a key are units of their own; null and empty texts are
units without tokens, of which the empty ones count for the mean length; an empty table gives an
index without hits.  An erasure is a new source, and so another mark: the old
folder is the caller's to delete.
"""

from __future__ import annotations

import json
import math
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import tokens_of
from ..sources.store import exists, mark_of
from .search import ORDER, live

K1, B = 1.5, 0.75
#: Places of a block, parts of a folder while it is built, and blocks that are scored first.
SPAN, SLICES, FIRST = 512, 8, 16
#: Bytes of texts that are cut into tokens at a time; a longer text is one such piece.
AT_ONCE = 1 << 20
#: Columns of folders that have no file if there is no token.
SCHEMAS = {
    "postings": "token string, block long, most double, places array<long>, counts array<int>, lengths array<int>, bucket int",
    "terms": "token string, df long, cf long, bucket int",
}
#: Units for each folder of tokens, and folders at least and at most.
FOLDER, LEAST_FOLDERS, MOST_FOLDERS = 1 << 16, 8, 4096


def bucket_of(token: Column, buckets: int) -> Column:
    """The folder of a token, by a hash that the driver knows too."""
    return F.pmod(F.crc32(token.cast("binary")), F.lit(buckets)).cast("int")


def read(spark: SparkSession, folder: str, name: str) -> DataFrame:
    reader = spark.read.schema(SCHEMAS[name]) if name in SCHEMAS else spark.read
    return reader.parquet(f"{folder}/{name}")


def pieces(batch: pa.RecordBatch, column: int) -> Iterator[pa.RecordBatch]:
    """The rows of a batch in stretches of at most AT_ONCE bytes in a column of texts, or of one row."""
    first, held = 0, 0
    for k, n in enumerate(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_pylist()):
        if k > first and held + n > AT_ONCE:
            yield batch.slice(first, k - first)
            first, held = k, 0
        held += n
    if first < batch.num_rows:
        yield batch.slice(first)


def counted(batches: Iterator[pa.RecordBatch], names: list[str], trimmed: bool = False) -> Iterator[pa.RecordBatch]:
    """Rows whose fourth column is a text, with its tokens, their counts and its length instead; no more than a piece is in work."""
    for batch in batches:
        for piece in pieces(batch, 3):
            tokens, counts, lengths = [], [], []
            for t in piece.column(3).to_pylist():
                c = Counter(tokens_of(t or "", trimmed))
                tokens.append(list(c))
                counts.append(list(c.values()))
                lengths.append(None if t is None else c.total())
            lists = [pa.array(tokens, pa.list_(pa.string())), pa.array(counts, pa.list_(pa.int32())), pa.array(lengths, pa.int32())]
            yield pa.RecordBatch.from_arrays([*piece.columns[:3], *lists], names)


@dataclass(frozen=True)
class Meta:
    n: int
    avgdl: float
    k1: float
    b: float
    trimmed: bool
    buckets: int
    mark: str


@dataclass(frozen=True)
class TextIndex:
    spark: SparkSession
    folder: str
    meta: Meta

    def table(self, name: str) -> DataFrame:
        return read(self.spark, self.folder, name)

    def terms(self) -> DataFrame:
        """(token, df, cf): every token, the units that hold it and how often they do."""
        return self.table("terms").select("token", "df", "cf")

    def asked(self, query: str) -> dict[str, float]:
        """The query's tokens that the corpus holds, with their idf times their number in the query."""
        times = Counter(tokens_of(query, self.meta.trimmed))
        if not times:
            return {}
        found = self.of(self.table("terms"), times).select("token", "df").collect()
        return {r.token: times[r.token] * math.log(1 + (self.meta.n - r.df + 0.5) / (r.df + 0.5)) for r in found}

    def of(self, table: DataFrame, tokens: dict[str, float] | Counter) -> DataFrame:
        """The rows of some tokens: their buckets are the only folders that are read."""
        buckets = {zlib.crc32(t.encode()) % self.meta.buckets for t in tokens}
        return table.where(F.col("bucket").isin(*buckets) & F.col("token").isin(*tokens))

    def scores(self, rows: DataFrame) -> DataFrame:
        """(place, score) of the units in rows of postings with a weight w."""
        m = self.meta
        each = rows.select("w", F.explode(F.arrays_zip("places", "counts", "lengths")).alias("x"))
        norm = m.k1 * (1 - m.b + m.b * F.col("x.lengths") / (m.avgdl or 1.0))
        part = F.col("w") * F.col("x.counts") * (m.k1 + 1) / (F.col("x.counts") + norm)
        scored = each.select(F.col("x.places").alias("place"), part.alias("part")).groupBy("place").agg(F.round(F.sum("part"), 4).alias("score"))
        return scored.where("score > 0")

    def weighted(self, query: str) -> DataFrame | None:
        """The query's postings with the weight w of their token; None if the corpus has none of its tokens."""
        asked = self.asked(query)
        if not asked:
            return None
        w = F.element_at(F.create_map(*[F.lit(x) for pair in asked.items() for x in pair]), F.col("token"))
        return self.of(self.table("postings"), asked).withColumn("w", w)

    def reaching(self, rows: DataFrame, top_k: int, slack: float) -> tuple[DataFrame, float]:
        """The rows of blocks whose bound reaches a score that ``top_k`` units have, and that score, both less the slack of rounding."""
        bounds = rows.groupBy("block").agg(F.sum(F.col("w") * F.col("most")).alias("bound"))
        first = [r.block for r in bounds.orderBy(F.desc("bound"), "block").limit(FIRST).collect()]
        best = self.scores(rows.where(F.col("block").isin(*first))).orderBy(F.desc("score")).limit(top_k)
        reached = best.agg(F.count("*").alias("n"), F.min("score").alias("least")).first()
        if reached.n < top_k:
            return rows, 0.0
        least = reached.least - slack
        return rows.join(bounds.where(F.col("bound") >= least).select("block"), "block", "left_semi"), least

    def search(self, query: str, top_k: int | None = 40, digits: int = 4) -> DataFrame:
        """(unit_id, doc_id, seq, score) by score, ties in archive order; with ``top_k`` None all hits, in no order.

        Scores that are equal to ``digits`` places (at most 4) are ties.
        """
        units = self.table("units").select("place", "unit_id", *ORDER)
        rows = self.weighted(query)
        if rows is None or top_k == 0:
            return units.limit(0).select("unit_id", *ORDER, F.lit(0.0).alias("score"))
        least = 0.0
        if top_k is not None:
            rows, least = self.reaching(rows, top_k, 10.0**-digits)
        best = self.scores(rows).where(F.col("score") >= least)
        hits = units.join(best, "place").select("unit_id", *ORDER, F.round("score", digits).alias("score")).where("score > 0")
        return hits if top_k is None else hits.orderBy(F.desc("score"), *ORDER).limit(top_k)


def build(
    units: DataFrame, folder: str, k1: float = K1, b: float = B, trimmed: bool = False, buckets: int | None = None, mark: str = ""
) -> TextIndex:
    """Writes the index of the live units; ``meta`` comes last, so a folder without it is not whole.

    ``buckets`` are the folders of tokens; None takes one for every FOLDER units.
    """
    spark = units.sparkSession
    of = live(units).select("unit_id", *ORDER, "text")
    if of.rdd.getNumPartitions() < spark.sparkContext.defaultParallelism:  # a table of few files, as a small one is
        of = of.repartition(spark.sparkContext.defaultParallelism)

    names = ["unit_id", *ORDER, "tokens", "counts", "length"]
    extra = [("tokens", T.ArrayType(T.StringType())), ("counts", T.ArrayType(T.IntegerType())), ("length", T.IntegerType())]
    cut = of.mapInArrow(lambda batches: counted(batches, names, trimmed), T.StructType([*of.schema.fields[:3], *[T.StructField(n, t) for n, t in extra]]))
    cut.withColumn("place", F.monotonically_increasing_id()).write.mode("overwrite").parquet(f"{folder}/units")
    stored = spark.read.parquet(f"{folder}/units")
    n, avgdl = stored.agg(F.count("*"), F.coalesce(F.avg("length"), F.lit(0.0))).first()
    buckets = buckets or min(max(n // FOLDER, LEAST_FOLDERS), MOST_FOLDERS)
    each = stored.select("place", "length", F.explode(F.arrays_zip("tokens", "counts")).alias("x")).select(
        bucket_of(F.col("x.tokens"), buckets).alias("bucket"), F.col("x.tokens").alias("token"), F.floor(F.col("place") / SPAN).alias("block"),
        F.struct("place", F.col("x.counts").alias("count"), "length").alias("p"),
    )
    weight = F.col("p.count") * (k1 + 1) / (F.col("p.count") + k1 * (1 - b + b * F.col("p.length") / (avgdl or 1.0)))
    dealt = each.withColumn("slice", F.pmod(F.col("block"), F.lit(SLICES))).repartition("bucket", "slice")
    rows = dealt.groupBy("bucket", "slice", "token", "block").agg(F.sort_array(F.collect_list("p")).alias("p"), F.max(weight).alias("most"))
    postings = rows.select(
        "token", "block", "most", F.col("p.place").alias("places"), F.col("p.count").alias("counts"), F.col("p.length").alias("lengths"), "bucket"
    )
    postings.sortWithinPartitions("bucket", "token", "block").write.mode("overwrite").partitionBy("bucket").parquet(f"{folder}/postings")
    sums = read(spark, folder, "postings").select(
        "bucket", "token", F.size("places").cast("long").alias("df"), F.aggregate("counts", F.lit(0).cast("long"), lambda t, c: t + c).alias("cf")
    )
    terms = sums.groupBy("bucket", "token").agg(F.sum("df").alias("df"), F.sum("cf").alias("cf"))
    terms.repartition("bucket").sortWithinPartitions("bucket", "token").write.mode("overwrite").partitionBy("bucket").parquet(f"{folder}/terms")
    meta = Meta(n, float(avgdl), k1, b, trimmed, buckets, mark)
    spark.createDataFrame([(json.dumps(meta.__dict__),)], "value string").coalesce(1).write.mode("overwrite").text(f"{folder}/meta")
    return TextIndex(spark, folder, meta)


def load(spark: SparkSession, folder: str) -> TextIndex:
    return TextIndex(spark, folder, Meta(**json.loads(spark.read.text(f"{folder}/meta").first().value)))


def load_or_build(units: DataFrame, folder: str, *sources: DataFrame, **options: float) -> TextIndex:
    """The index at ``folder`` if it was built from the same files as ``sources`` have now; else it is built anew."""
    mark = mark_of(*sources) if sources else ""
    if exists(units.sparkSession, f"{folder}/meta/_SUCCESS"):
        found = load(units.sparkSession, folder)
        if found.meta.mark == mark:
            return found
    return build(units, folder, mark=mark, **options)
