"""Lookups, exact search, BM25 ranking, figures, timelines and context over the unit table.

``units`` has unit_id, doc_id, seq, text, date_text and redacted; the order of
the archive is (doc_id, seq), which breaks every tie.
"""

from __future__ import annotations

import re
from typing import TYPE_CHECKING

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import FIGURE, figures, shares_token, tokenize

if TYPE_CHECKING:
    from .index import TextIndex

ORDER = ("doc_id", "seq")
#: Values of a place that one task numbers.
SPAN = 65536


def live(units: DataFrame) -> DataFrame:
    """Units that aren't withheld."""
    return units.where(~F.coalesce("redacted", F.lit(False)))


def chronological() -> list[Column]:
    return [F.col("date_text").asc_nulls_last(), F.col("doc_id"), F.col("seq")]


def places(units: DataFrame, by: str = "seq", dated: bool = False) -> DataFrame:
    """``units`` with ``place``, from 1, in their document: by ``by``, or if ``dated`` by ``date_text`` first, undated last.

    A row is numbered among SPAN values of ``by`` (of its date); what stands before
    them is a sum of counts, so of a document only one row for each such stretch
    meets in a task.  Most documents are one stretch, and the sums name only later ones.
    """
    low = F.lit(-(2**62))
    cut = {"_s": F.coalesce(F.floor(F.col(by) / SPAN), low)}
    if dated:
        cut |= {"_u": F.col("date_text").isNull(), "_d": F.coalesce("date_text", F.lit(""))}
    order = ["_u", "_d", "_s"] if dated else ["_s"]
    at = units.withColumns(cut)
    before = F.sum("_n").over(Window.partitionBy("doc_id").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1))
    sums = at.groupBy("doc_id", *order).agg(F.count("*").alias("_n")).withColumn("_before", before).where("_before > 0")
    sums = sums.select(F.col("doc_id").alias("_doc"), *[F.col(c).alias(c + "k") for c in order], "_before")
    numbered = at.withColumn("_r", F.row_number().over(Window.partitionBy("doc_id", *order).orderBy(by)))
    same = F.col("doc_id").eqNullSafe(F.col("_doc"))
    for c in order:
        same &= F.col(c) == F.col(c + "k")
    place = F.col("_r") + F.coalesce("_before", F.lit(0))
    return numbered.join(sums, same, "left").select(*[F.col(f"`{c}`") for c in units.columns], place.alias("place"))


def get_units(units: DataFrame, wanted: DataFrame) -> DataFrame:
    """``wanted`` (place, unit_id) with a status: found, withheld or missing."""
    state = F.when(F.col("u.unit_id").isNull(), "missing").when(F.col("u.redacted"), "withheld").otherwise("found")
    joined = wanted.alias("w").join(units.alias("u"), F.col("w.unit_id") == F.col("u.unit_id"), "left")
    text = F.when(state == "found", F.col("u.text"))
    return joined.select("w.place", "w.unit_id", state.alias("status"), text.alias("text"))


def document_units(units: DataFrame, doc_id: str, withheld: bool = False) -> DataFrame:
    """The units of a document in stored order, live ones unless ``withheld``."""
    return (units if withheld else live(units)).where(F.col("doc_id") == doc_id).orderBy("seq")


def resolve_doc(documents: DataFrame, ref: str) -> DataFrame:
    """The document that ``ref`` names: by id, else by short code, end of path or part of the id; an empty one names none."""
    rank = F.when(F.col("doc_id") == ref, 0).when(
        (F.col("meta.short") == ref) | F.endswith("path", F.lit(ref)) | F.contains("doc_id", F.lit(ref)), 1
    )
    if not ref:
        return documents.limit(0)
    return documents.withColumn("rank", rank).where("rank is not null").orderBy("rank", "doc_id").limit(1).drop("rank")


def grep(
    units: DataFrame, pattern: str, regex: bool = False, ignore_case: bool = True, limit: int | None = 100, context: int = 90
) -> DataFrame:
    """First match of each live unit: (unit_id, doc_id, seq, start, matched, excerpt), in archive order."""
    java = ("(?iu)" if ignore_case else "") + "(" + (pattern if regex else re.escape(pattern)) + ")"
    start = F.regexp_instr("text", F.lit(java))
    found = live(units).where(F.rlike("text", F.lit(java))).withColumn("start", start - 1)
    found = found.withColumn("matched", F.regexp_extract("text", java, 1))
    first = F.greatest(F.col("start") - context, F.lit(0))
    length = F.col("start") - first + F.length("matched") + context
    cut = F.replace(F.substring(F.col("text"), first + 1, length), F.lit("\n"), F.lit(" "))
    found = found.select("unit_id", *ORDER, "start", "matched", F.concat(F.lit("…"), cut, F.lit("…")).alias("excerpt"))
    return found.orderBy(*ORDER).limit(limit) if limit is not None else found


def search_exact(units: DataFrame, pattern: str, regex: bool = False, limit: int = 100) -> DataFrame:
    """(unit_id, doc_id, seq, excerpt, note): the first matches, or one row that says in how many units there is none."""
    hits = grep(units, pattern, regex, limit=limit).select("unit_id", *ORDER, "excerpt", F.lit(None).cast("string").alias("note"))
    n = live(units).agg(F.count("*").alias("n"), F.count_if(F.rlike("text", F.lit("(?iu)" + (pattern if regex else re.escape(pattern))))).alias("k"))
    none = n.where("k = 0").select(
        *[F.lit(None).cast(dict(hits.dtypes)[c]).alias(c) for c in ("unit_id", *ORDER, "excerpt")], F.format_string("no hit in %d units", "n").alias("note")
    )
    return hits.unionByName(none)


def list_figures(units: DataFrame, topic: str | None = None, most: int | None = 60) -> DataFrame:
    """One line for each figure, oldest first: date, figure, source and context."""
    found = find_figures(units, topic)
    if most is None:  # a sort of all rows looks at them twice, so they are dealt out first and their figures found once
        found = found.repartition("unit_id")
    found = found.orderBy(*chronological(), "n")
    line = F.concat_ws(" | ", F.coalesce(F.substring("date_text", 1, 10), F.lit("undated")), "figure", F.concat(F.lit("["), "unit_id", F.lit("]")), "context")
    shown = found.select("unit_id", "n", line.alias("line"))
    return shown.limit(most) if most is not None else shown


def of_speakers(hits: DataFrame, units: DataFrame, people: DataFrame, org: str) -> DataFrame:
    """The hits whose speaker belongs to an organisation (a left semi join)."""
    theirs = units.join(people.where(F.col("org") == org).select(F.col("pid").alias("speaker")), "speaker", "left_semi").select("unit_id")
    return hits.join(theirs, "unit_id", "left_semi")


def documents_with(units: DataFrame, pid: str, pattern: str) -> DataFrame:
    """(doc_id) of the documents that a person wrote in or that mention a form of theirs (see ``erase.form_pattern``)."""
    shown = live(units)
    said = shown.where(F.col("speaker") == pid).select("doc_id")
    return said.unionAll(shown.where(F.rlike("text", F.lit(pattern))).select("doc_id")).distinct()


def postings(units: DataFrame, key: str = "unit_id", trimmed: bool = False) -> DataFrame:
    """(key, token, tf, length) of every live unit."""
    tokens = live(units).select(key, tokenize(F.col("text"), trimmed).alias("tokens"))
    return (
        tokens.select(key, F.size("tokens").alias("length"), F.explode_outer("tokens").alias("token"))  # outer: no filter that makes the tokens again
        .where("token is not null")
        .groupBy(key, "length", "token")
        .agg(F.count("*").alias("tf"))
    )


def bm25(
    units: DataFrame, query: str, top_k: int | None = 40, k1: float = 1.5, b: float = 0.75, trimmed: bool = False
) -> DataFrame:
    """(unit_id, doc_id, seq, score) by score, ties in archive order; a token that the query repeats counts as often.

    Only units that hold a query token are shuffled; corpus sizes are one row.
    """
    spark = units.sparkSession
    asked = spark.range(1).select(F.explode(tokenize(F.lit(query), trimmed)).alias("token")).groupBy("token").agg(
        F.count("*").alias("times")
    )
    words = [r["token"] for r in asked.collect()]  # the query's own words
    tokens = live(units).select("unit_id", *ORDER, tokenize(F.col("text"), trimmed).alias("tokens"))
    sizes = tokens.agg(F.count("*").alias("n"), F.avg(F.size("tokens")).alias("avgdl"))
    wanted = F.array(*[F.lit(w) for w in words]).cast("array<string>")
    held = (
        tokens.select(
            "unit_id", *ORDER, F.size("tokens").alias("length"),
            F.explode_outer(F.filter("tokens", lambda t: F.array_contains(wanted, t))).alias("token"),
        )
        .where("token is not null")
        .groupBy("unit_id", *ORDER, "length", "token")
        .agg(F.count("*").alias("f"))
    )
    df = held.groupBy("token").agg(F.count("*").alias("df"))  # a row for each word of the query
    idf = F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    norm = k1 * (1 - b + b * F.col("length") / F.when(F.col("avgdl") == 0, 1.0).otherwise(F.col("avgdl")))
    part = F.col("times") * idf * F.col("f") * (k1 + 1) / (F.col("f") + norm)
    scored = (
        held.join(F.broadcast(df), "token")
        .join(F.broadcast(asked), "token")
        .crossJoin(F.broadcast(sizes))
        .groupBy("unit_id", *ORDER)
        .agg(F.round(F.sum(part), 4).alias("score"))
        .where("score > 0")
    )
    return scored.orderBy(F.desc("score"), *ORDER).limit(top_k) if top_k is not None else scored


def search_text(units: DataFrame, query: str, top_k: int | None = 12, index: TextIndex | None = None) -> DataFrame:
    """BM25 hits with snippets of 420 characters; ``top_k`` is held to 1..40, and nothing means 12."""
    most = min(max(top_k or 12, 1), 40)
    return with_snippets(index.search(query, most) if index else bm25(units, query, most), units)


def with_snippets(hits: DataFrame, units: DataFrame) -> DataFrame:
    """Ranked hits with the first 420 characters of their units, best first."""
    return hits.join(units.select("unit_id", F.substring("text", 1, 420).alias("snippet")), "unit_id").orderBy(
        F.desc("score"), *ORDER
    )


def find_figures(units: DataFrame, topic: str | None = None, context: int = 110) -> DataFrame:
    """One row for each figure of the live units, with date, source and context; oldest first when ordered.

    A topic keeps the units that share a token with it.  There is no cap on the rows.
    """
    at = live(units)
    if topic:
        at = at.where(shares_token(F.col("text"), topic))
    found = at.where(F.rlike("text", F.lit(FIGURE))).select("*", F.posexplode_outer(figures(F.col("text"))).alias("n", "f")).where("f is not null")
    first = F.greatest(F.col("f.start") - context, F.lit(0))
    cut = F.substring(F.col("text"), first + 1, F.col("f.stop") - first + context)
    more = [c for c in ("speaker_display", "locator", "truncated") if c in units.columns]
    return found.select(
        "unit_id", *ORDER, "date_text", "n", F.col("f.figure").alias("figure"), F.col("f.start").alias("start"),
        F.trim(F.regexp_replace(cut, r"(?U)\s+", " ")).alias("context"), *more,
    )


def latest_figures(found: DataFrame) -> DataFrame:
    """``find_figures`` rows with ``latest``: whether the mention has the last date of its figure."""
    newest = found.groupBy(F.lower("figure").alias("k")).agg(F.max("date_text").alias("newest"))
    return found.join(newest, F.lower(found["figure"]) == F.col("k")).withColumn(
        "latest", F.coalesce(F.col("date_text") == F.col("newest"), F.lit(False))
    ).drop("k", "newest")


def timeline(
    units: DataFrame, topic: str, since: str | None = None, until: str | None = None, pool: int | None = 60, show: int | None = 50,
    index: TextIndex | None = None,
) -> DataFrame:
    """The units nearest to a topic between two days, oldest first; ranked by a stored index if there is one.

    The ``pool`` best are taken before the dates are looked at; None takes all.
    Dates compare by their days, so ``until`` includes its whole day.
    """
    ranked = index.search(topic, pool) if index else bm25(units, topic, pool)
    hits = ranked.join(units.select("unit_id", "date_text", F.substring("text", 1, 300).alias("text")), "unit_id")
    day = F.substring("date_text", 1, 10)
    if since:
        hits = hits.where(day >= since[:10])
    if until:
        hits = hits.where(day <= until[:10])
    return hits.orderBy(*chronological()).limit(show) if show is not None else hits


def context_window(units: DataFrame, anchors: DataFrame, width: int = 3, most: int = 60) -> DataFrame:
    """Live units within ``width`` places of an anchor (anchor: unit_id) of the same document, with their distance."""
    ranked = places(live(units).select("unit_id", *ORDER, "text")).withColumnRenamed("place", "rn")
    at = ranked.join(anchors.select(F.col("unit_id")).distinct(), "unit_id").select(
        F.col("unit_id").alias("anchor"), F.explode(F.sequence(F.col("rn") - max(width, 1), F.col("rn") + max(width, 1))).alias("rn"),
        "doc_id", F.col("rn").alias("anchor_rn"),
    )
    near = ranked.join(at, ["doc_id", "rn"]).select(
        "anchor", "unit_id", "doc_id", "seq", (F.col("rn") - F.col("anchor_rn")).cast("int").alias("offset"), "text"
    )
    place = F.row_number().over(Window.partitionBy("anchor").orderBy("offset"))
    return near.withColumn("place", place).where(F.col("place") <= most).drop("place")
