"""Reading a folder of texts, building the archive's tables, storing and loading them."""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schemas
from ..operators import people as P
from ..operators import threads, transcripts

TABLES = ("units", "documents", "people")
VERSION = 1


@dataclass
class Archive:
    units: DataFrame
    documents: DataFrame
    people: DataFrame
    fingerprint: str | None = None

    def save(self, folder: str) -> None:
        """Writes all tables; ``meta`` holds version and fingerprint."""
        for name in TABLES:
            getattr(self, name).write.mode("overwrite").parquet(f"{folder}/{name}")
        spark = self.units.sparkSession
        spark.createDataFrame([(VERSION, self.fingerprint)], "version int, fingerprint string").coalesce(1).write.mode("overwrite").parquet(f"{folder}/meta")

    def export_json(self, folder: str) -> None:
        """The same tables as lines of JSON; letters beyond ASCII stay as they are."""
        for name in TABLES:
            getattr(self, name).write.mode("overwrite").json(f"{folder}/{name}")


def scan_corpus(spark: SparkSession, folder: str) -> DataFrame:
    """(path, content) of every ``kind/name.txt`` below a folder."""
    files = spark.read.text(f"{folder.rstrip('/')}/*/*.txt", wholetext=True)
    path = F.regexp_extract(F.url_decode(F.col("_metadata.file_path")), "([^/]*/[^/]*)$", 1)
    return files.select(path.alias("path"), F.col("value").alias("content"))


def fingerprint(files: DataFrame) -> str:
    """The first 16 hex digits of the hash over the files' names and hashes in order of their paths.

    Contents are hashed where they are; the names and hashes stream by in their order.
    """
    total = hashlib.sha256()
    rows = files.select("path", F.substring_index("path", "/", -1).alias("name"), F.unhex(F.sha2(F.encode("content", "utf-8"), 256)).alias("h"))
    for r in rows.orderBy("path", "h").toLocalIterator():
        total.update(r["name"].encode() + bytes(r["h"]))
    return total.hexdigest()[:16]


def range_fingerprints(rows: DataFrame, by: str, key: str, text: str, step: int = 1000, levels: int = 4) -> DataFrame:
    """(by, fingerprint) for groups of any size: hashes of texts, of ranges of ``step`` keys, of ranges of those, and so on.

    There are ``levels`` of them or as many more as it takes until keys as far from zero as
    the table's lie in ``step`` ranges; the last takes all ranges of a group.  No task
    holds more than twice ``step`` hashes of a group, as keys may lie on both sides of zero.
    """
    out = rows.select(F.col(by).alias("by"), F.col(key).cast("long").alias("k"), F.sha2(F.coalesce(F.col(text), F.lit("")), 256).alias("h"))
    farthest = out.agg(F.max(F.greatest(F.col("k"), -1 - F.col("k")))).first()[0] or 0
    while farthest >= step**levels:
        levels += 1
    for level in range(1, levels + 1):
        up = F.lit(0) if level == levels else F.floor(F.col("k") / step)
        out = out.groupBy("by", up.alias("up")).agg(F.array_sort(F.collect_list(F.struct("k", "h"))).alias("a"))
        out = out.select("by", F.col("up").alias("k"), F.sha2(F.array_join(F.transform("a", lambda x: x["h"]), ""), 256).alias("h"))
    return out.select(F.col("by").alias(by), F.substring("h", 1, 16).alias("fingerprint"))


def build(spark: SparkSession, files: DataFrame, roster: DataFrame, orgs: dict[str, str] | None = None, phrases: tuple[str, ...] = ()) -> Archive:
    """All tables from files (path, content) and a roster (pid, display, org, role, emails).

    ``phrases`` are lines of mails that say nothing (see ``threads.clean_bodies``).  People come first, from the whole corpus, so that a name resolves wherever it stands.
    """
    texts = files.select(F.col("content").alias("text"), "path")
    people = P.build_registry(roster.withColumn("mention_only", F.lit(False)), texts, orgs, order="path")
    aliases = P.alias_table(people)
    people = people.select(*[f.name for f in schemas.PEOPLE.fields])
    said = transcripts.transcript_units(files, people, aliases)
    mailed = threads.thread_units(files, people, aliases, phrases)
    units = said.unionByName(mailed).select(*[F.col(f.name).cast(f.dataType) for f in schemas.UNITS.fields])
    counts = said.groupBy("doc_id").agg(F.count("*").cast("int").alias("n_units"))
    none = F.lit(None)
    meetings = transcripts.transcript_documents(files).join(counts, "doc_id", "left").select(
        "doc_id", "kind", "path", "title", "date_text", "phase", "participants", "subject",
        F.coalesce("n_units", F.lit(0)).alias("n_units"), "internal",
        F.struct("short", "dialect", none.cast("int").alias("declared_messages"), none.cast("int").alias("parsed_messages"), none.cast("string").alias("first_date")).alias("meta"),
    )
    documents = meetings.unionByName(threads.thread_documents(files, mailed))
    return Archive(units, documents.select(*[F.col(f.name).cast(f.dataType) for f in schemas.DOCUMENTS.fields]), people, fingerprint(files))


def load(spark: SparkSession, folder: str) -> Archive:
    read = lambda name, schema: spark.read.schema(schema).parquet(f"{folder}/{name}")
    meta = spark.read.parquet(f"{folder}/meta").first()
    if meta.version != VERSION:
        raise ValueError(f"the archive has version {meta.version}, not {VERSION}")
    return Archive(read("units", schemas.UNITS), read("documents", schemas.DOCUMENTS), read("people", schemas.PEOPLE), meta.fingerprint)


def load_or_build(spark: SparkSession, folder: str, corpus: str, roster: DataFrame, orgs: dict[str, str] | None = None) -> Archive:
    """The stored archive; where there is none it is built and stored first."""
    at = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/meta/_SUCCESS")
    if not at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at):
        build(spark, scan_corpus(spark, corpus), roster, orgs).save(folder)
    return load(spark, folder)
