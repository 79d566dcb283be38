"""From raw documents to token ids in five stages.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written
as Parquet and read again as the next one's ``docs``.  All but the last return
the columns of documents.

Defined cases, in every stage: an empty table gives an empty one; repeated rows and
ids are rows of their own, but for the near-dedup, where an id is one document;
further columns of any name pass through all stages but the last; texts are taken
whole, however long.  A null or empty text fails the quality rules; in the other
stages it is an empty text: scored as one, one of the near copies of all empty
texts, counted as one character when sources are mixed, and without tokens.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from affidavit.llm.byte_bpe import encode
from affidavit.llm.common import stored, table
from affidavit.llm.mixing import mix
from affidavit.llm.quality_classifier import score, train
from affidavit.llm.quality_rules import quality_rules, without_lines
from affidavit.llm.queries import MIX_WEIGHTS
from affidavit.llm.simhash_dedup import simhash_dedup


#: The columns that stages read.
READ = ("doc_id", "text", "lang", "source", "n_chars")


def through(operator: Callable[[DataFrame], DataFrame], docs: DataFrame) -> DataFrame:
    """``operator``'s rows with the columns of ``docs``; those that no stage reads go by under names that no operator uses."""
    own = {c: c if c in READ else f"_of_the_caller_{k}" for k, c in enumerate(docs.columns)}
    found = operator(docs.select(*[F.col(f"`{c}`").alias(name) for c, name in own.items()]))
    return found.select(*[F.col(name).alias(c) for c, name in own.items()])


def apply_quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejected documents go (null and empty texts among them), and lines above the limit go from those that stay."""

    def judged(docs: DataFrame) -> DataFrame:
        kept = quality_rules(docs).where("rules.kept")
        kept = kept.withColumn("text", without_lines(F.col("text"), F.col("rules.removed")))
        return kept.withColumn("n_chars", F.length("text").cast("long"))

    return through(judged, docs)


def classify_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose score is below the threshold go."""
    model = train(docs, table(spark, sf_dir, "labels"))
    return through(lambda docs: score(docs, model).where("predicted = 1"), docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (five words, similarity 0.8) stays."""
    return through(lambda docs: simhash_dedup(docs, span=5, least=0.8), docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents repeat to the sources' target weights, in a global random order."""
    return through(lambda docs: mix(docs, MIX_WEIGHTS), docs)


def encode_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, n_tokens, ids, decoded_sha256) of every row; the last is the hash of the bytes that the ids decode to."""
    return encode(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, decoded=True)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality rules", apply_quality_rules),
    ("quality classifier", classify_quality),
    ("simhash near-dedup", drop_near_copies),
    ("mixing", mix_sources),
    ("byte-level BPE", encode_tokens),
]

#: SQL can't express the classifier, the fingerprints' candidate search and the encoder.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
