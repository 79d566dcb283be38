"""Where derived tables are kept, and whether the files behind a table are still the same."""

from __future__ import annotations

import hashlib
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """The folder that the driver and all executors share (``spark.checkpoint.dir``); in local mode a temporary one stands in."""
    sc = spark.sparkContext
    found = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not found:
        if not sc.master.startswith("local[") and sc.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="affidavit-"))
        found = sc.getCheckpointDir()
    return found.rstrip("/")


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the shared folder and read again, which cuts its lineage and survives lost executors."""
    path = f"{shared_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def exists(spark: SparkSession, path: str) -> bool:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at)


def mark_of(*sources: DataFrame) -> str:
    """A hash over path, size and time of every file behind the tables; no content is read."""
    parts = []
    for s in sources:
        # a row for each file, summed where they are; a file that is read in splits counts once
        files = s.select("_metadata.file_path", "_metadata.file_size", "_metadata.file_modification_time").distinct()
        h = F.xxhash64("file_path", "file_size", "file_modification_time")
        parts.append(files.agg(F.count("*"), F.bit_xor(h), F.sum(F.pmod(h, F.lit(1 << 31)))).first())
    return hashlib.sha256(repr([tuple(p) for p in parts]).encode()).hexdigest()[:16]
