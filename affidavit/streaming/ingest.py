"""Texts that arrive over time, appended to a unit table (an addition of this engine).

Every text file of a watched folder becomes units of one paragraph each; units
of a file that comes again under another name are appended again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def paragraphs(files: DataFrame) -> DataFrame:
    """(unit_id, doc_id, seq, text) of texts (path, content)."""
    doc = F.regexp_extract("path", r"([^/]*/[^/]*)\.[^./]*$", 1)
    parts = F.filter(F.split("content", r"\n\s*\n"), lambda p: F.trim(p) != "")
    each = files.select(doc.alias("doc_id"), F.posexplode(parts).alias("seq", "text"))
    return each.select(F.format_string("%s.p%04d", "doc_id", "seq").alias("unit_id"), "doc_id", "seq", F.trim("text").alias("text"))


def watch(spark: SparkSession, folder: str, table: str, checkpoint: str) -> StreamingQuery:
    """Appends the units of new files below ``folder`` to the Parquet table, and ends when all are taken."""
    files = spark.readStream.format("text").option("wholetext", True).load(f"{folder}/*/*.txt")
    named = files.select(F.url_decode(F.col("_metadata.file_path")).alias("path"), F.col("value").alias("content"))

    def append(batch: DataFrame, number: int) -> None:
        # a folder for each batch: a batch that is run again overwrites itself
        paragraphs(batch).write.mode("overwrite").parquet(f"{table}/batch={number}")

    return named.writeStream.foreachBatch(append).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
