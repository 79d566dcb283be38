"""Document rules and cross-document line frequency, in DataFrame functions only.

Base rules look at one text.  Line frequency then looks across documents: each
text's lines are normalised (trimmed, white space to one space, lower case) and
hashed; for every host the different documents that hold a line are counted,
where exact copies of a text count as one document, so that copying a document
does not turn its lines into boilerplate.  Lines in more than
``max(min_docs, max_share * the host's different documents)`` documents are
removed, and a document that loses more than half of its words is rejected.  The
share is low, 2 %, so that what a large host repeats on one page in fifty goes too;
it bounds a host's removed lines at fifty times the lines of one document.

Texts never cross the network: they give one (host, line, copy) row per
different line, counted in two partial aggregates, and only the lines above the
limit go back to documents.

Defined cases: a null or empty text has no words and fails the base rules; a
null host is a host of its own; a very long text is counted whole; an empty table
gives an empty result; repeated rows stay repeated, and count as copies;
ties cannot arise; further columns of the input pass through untouched, but for one
named ``rules``, which the result replaces.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WORD_GAP, bind, stored, words_of

MIN_WORDS, REPEAT_PERCENT = 50, 50
MIN_DOCS, MAX_SHARE, MAX_LOSS = 20, 0.02, 0.5
#: Up to so many different repeated windows they are looked up one by one; beyond, by sorting.
FEW = 32
#: Up to so many lines above the limit are sent to every task (12 bytes each); beyond, documents are joined by host.
MOST_SENT = 200_000


def repeated_words(words: Column, span: int = 3) -> Column:
    """Number of words inside a ``span``-word window that occurs twice or more in ``words``."""

    def covered(at: Column) -> Column:
        """Words below windows that start at the ascending places ``at``."""
        gaps = F.transform(at, lambda p, k: F.least(F.lit(span), F.coalesce(F.get(at, k + 1) - p, F.lit(span))))
        return F.aggregate(gaps, F.lit(0), lambda total, g: total + g).cast("long")

    def by_lookup(keys: Column, twice: Column) -> Column:
        at = F.filter(F.transform(keys, lambda h, k: F.when(F.array_contains(twice, h), k)), lambda p: p.isNotNull())
        return bind(at, covered)

    def by_sorting(keys: Column) -> Column:
        pairs = F.sort_array(F.transform(keys, lambda h, k: F.struct(h.alias("h"), k.alias("k"))))
        same = lambda s, k, h: (k >= 0) & (k < F.size(s)) & (F.get(s, k)["h"] == h)
        at = lambda s: F.transform(
            F.filter(s, lambda x, k: same(s, k - 1, x["h"]) | same(s, k + 1, x["h"])), lambda x: x["k"]
        )
        return bind(bind(pairs, lambda s: F.sort_array(at(s))), covered)

    def of_keys(keys: Column) -> Column:
        twice = lambda s: F.array_distinct(F.filter(s, lambda h, k: (k > 0) & (F.get(s, k - 1) == h)))
        return F.when(F.size(F.array_distinct(keys)) == F.size(keys), F.lit(0).cast("long")).otherwise(
            bind(
                bind(F.sort_array(keys), twice),
                lambda t: F.when(F.size(t) <= FEW, by_lookup(keys, t)).otherwise(by_sorting(keys)),
            )
        )

    keys = F.transform(
        F.sequence(F.lit(0), F.size(words) - span), lambda k: F.xxhash64(*[F.get(words, k + i) for i in range(span)])
    )
    return F.when(F.size(words) <= span, F.lit(0).cast("long")).otherwise(bind(keys, of_keys))


def base_rules(text: Column) -> Column:
    """Struct of the counts that the base rules use."""
    whole = F.coalesce(text, F.lit(""))

    def counts(words: Column) -> Column:
        lines = F.filter(F.split(whole, "\n"), lambda s: s.rlike("[^\\x20\\x09-\\x0D]"))
        return F.struct(
            F.size(words).cast("long").alias("n_words"),
            F.length(F.array_join(words, "")).cast("long").alias("word_chars"),
            F.regexp_count(whole, F.lit("[#*$%&|<>]")).cast("long").alias("n_symbols"),
            bind(lines, lambda s: (F.size(s) - F.size(F.array_distinct(s))).cast("long")).alias("n_dup_lines"),
            repeated_words(words).alias("n_repeat_words"),
        )

    return bind(words_of(text), counts)


def normal_line(line: Column) -> Column:
    return F.trim(F.lower(F.regexp_replace(line, WORD_GAP, " ")))


def line_hashes(text: Column) -> Column:
    """(h, n) for every line with a word in order: hash of the normalised line, number of its words."""
    lines = F.transform(F.split(F.coalesce(text, F.lit("")), "\n"), normal_line)
    return F.transform(
        F.filter(lines, lambda s: s != ""),
        lambda s: F.struct(F.xxhash64(s).alias("h"), (F.length(s) - F.length(F.replace(s, F.lit(" "))) + 1).alias("n")),
    )


def frequent_lines(
    docs: DataFrame, text: str, host: str, min_docs: int = MIN_DOCS, max_share: float = MAX_SHARE
) -> DataFrame:
    """(host, h, n_docs, host_docs) of the lines above the limit."""
    lines = docs.select(
        F.col(host).alias("host"),
        F.xxhash64(F.coalesce(text, F.lit(""))).alias("copy"),
        F.array_distinct(F.transform(line_hashes(F.col(text)), lambda s: s["h"])).alias("hs"),
    )
    sizes = lines.select("host", "copy").distinct().groupBy("host").agg(F.count("*").alias("host_docs"))
    counts = (
        lines.select("host", "copy", F.explode("hs").alias("h"))
        .distinct()
        .groupBy("host", "h")
        .agg(F.count("*").alias("n_docs"))
        .where(F.col("n_docs") > min_docs)
    )
    return (
        counts.join(sizes.withColumnRenamed("host", "host_2"), F.col("host").eqNullSafe(F.col("host_2")))
        .where(F.col("n_docs") > F.col("host_docs") * max_share)
        .select("host", "h", "n_docs", "host_docs")
    )


def quality_rules(
    docs: DataFrame,
    text: str = "text",
    host: str = "source",
    min_docs: int = MIN_DOCS,
    max_share: float = MAX_SHARE,
    max_loss: float = MAX_LOSS,
) -> DataFrame:
    """``docs`` with the struct ``rules`` added.

    Its fields: the base counts, ``base_failed``, ``n_removed_lines``,
    ``n_removed_words``, ``removed`` (hashes of the removed lines, null if none)
    and ``kept``.
    """
    tag = uuid.uuid4().hex[:8]
    row, hs, base = f"row_{tag}", f"hs_{tag}", f"base_{tag}"
    found = stored(frequent_lines(docs, text, host, min_docs, max_share), "lines")
    # a line is in over max_share of the documents, so a host has at most 1 / max_share times the lines of one
    by_host = found.groupBy(F.col("host").alias(row)).agg(F.collect_set("h").alias(hs))
    if found.count() <= MOST_SENT:
        by_host = F.broadcast(by_host)
    rules = (
        docs.withColumn(base, base_rules(F.col(text)))
        .join(by_host, F.col(host).eqNullSafe(F.col(row)), "left")
        .withColumn(
            row,
            F.when(
                F.col(hs).isNotNull(),
                F.filter(line_hashes(F.col(text)), lambda s: F.array_contains(F.col(hs), s["h"])),
            ),
        )
    )
    lost = F.coalesce(F.aggregate(row, F.lit(0).cast("long"), lambda t, s: t + s["n"]), F.lit(0).cast("long"))
    b = F.col(base)
    failed = (b["n_words"] < MIN_WORDS) | (100 * b["n_repeat_words"] > REPEAT_PERCENT * b["n_words"])
    out = F.struct(
        *[b[k].alias(k) for k in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")],
        failed.alias("base_failed"),
        F.coalesce(F.size(row), F.lit(0)).cast("long").alias("n_removed_lines"),
        lost.alias("n_removed_words"),
        F.array_distinct(F.transform(row, lambda s: s["h"])).alias("removed"),
        (~failed & (lost <= b["n_words"] * max_loss)).alias("kept"),
    )
    return rules.select(*[F.col(f"`{c}`") for c in docs.columns if c != "rules"], out.alias("rules"))


def without_lines(text: Column, removed: Column) -> Column:
    """The text without the lines whose hashes are in ``removed``; untouched where that is null or empty."""
    left = F.filter(F.split(text, "\n"), lambda s: ~F.array_contains(removed, F.xxhash64(normal_line(s))))
    return F.when(F.coalesce(F.size(removed), F.lit(0)) > 0, F.array_join(left, "\n")).otherwise(text)
