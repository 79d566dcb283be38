"""Counts and summaries over the archive's tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

MONTH_MS = 2_629_800_000


def stats(units: DataFrame, documents: DataFrame, people: DataFrame | None = None) -> DataFrame:
    """One row: numbers of documents, units and people, units by state, first and last date."""
    u = units.agg(
        F.count("*").alias("units"), F.count_if(F.coalesce("redacted", F.lit(False))).alias("redacted"),
        F.count_if(F.coalesce("truncated", F.lit(False))).alias("truncated"), F.min("date_text").alias("first_date"),
        F.max("date_text").alias("last_date"),
    )
    out = u.crossJoin(documents.agg(F.count("*").alias("documents")))  # single rows
    return out if people is None else out.crossJoin(people.agg(F.count("*").alias("people")))


def units_by_kind(units: DataFrame) -> DataFrame:
    return units.groupBy("doc_kind").agg(F.count("*").alias("n"))


def inventory(documents: DataFrame, units: DataFrame) -> DataFrame:
    """A row for each document with its span of dates and number of live units."""
    n = units.where(~F.coalesce("redacted", F.lit(False))).groupBy("doc_id").agg(F.count("*").alias("n_units"))
    first = F.substring(F.coalesce("meta.first_date", "date_text"), 1, 10)
    last = F.substring("date_text", 1, 10)
    span = F.when(first.isNull(), "?").when(last.isNotNull() & (last != first), F.concat(first, F.lit(".."), last)).otherwise(first)
    docs = documents.select("doc_id", F.col("meta.short").alias("short"), "kind", span.alias("span"), "internal")
    return docs.join(n, "doc_id", "left").withColumn("n_units", F.coalesce("n_units", F.lit(0)))


def participation(documents: DataFrame, top: int | None = 8) -> DataFrame:
    """(name, n): in how many documents each participant is named, without what stands in brackets."""
    name = F.trim(F.regexp_replace("p", r"\s*\(.*$", ""))
    counts = documents.select(F.explode("participants").alias("p")).select(name.alias("name")).groupBy("name").agg(F.count("*").alias("n"))
    return counts.orderBy(F.desc("n"), "name").limit(top) if top is not None else counts


def phase_rollup(documents: DataFrame, phase: str = "phase", date: str = "date_text") -> DataFrame:
    """(phase, n, first_date, last_date) of the phases that have a name."""
    return documents.where(F.col(phase).isNotNull()).groupBy(F.col(phase).alias("phase")).agg(
        F.count("*").alias("n"), F.min(date).alias("first_date"), F.max(date).alias("last_date")
    )


def silences(dates: DataFrame, date: str = "date", top: int = 3) -> DataFrame:
    """The longest stretches of days between one dated document and the next.

    The different days are few whatever the archive's size, so one ordered window holds them.
    """
    days = dates.select(F.to_date(date).alias("until")).where("until is not null").distinct()
    gaps = days.withColumn("since", F.lag("until").over(Window.orderBy("until"))).withColumn("days", F.datediff("until", "since"))
    return gaps.where("days > 0").select("since", "until", "days").orderBy(F.desc("days"), "since").limit(top)


def span_months(dates: DataFrame, date: str = "date") -> DataFrame:
    ms = (F.unix_millis(F.max(F.col(date).cast("timestamp"))) - F.unix_millis(F.min(F.col(date).cast("timestamp")))) / MONTH_MS
    return dates.agg(F.round(ms).cast("int").alias("months"))


def usage_rollup(usage: DataFrame, rates: DataFrame | None = None) -> DataFrame:
    """(view, model, calls, free, input, cached, output[, cost]) of usage events; rates are per million tokens.

    Free requests are counted but have no tokens.
    """
    paid = ~F.coalesce("free", F.lit(False))
    total = lambda c: F.coalesce(F.sum(F.when(paid, F.col(c))), F.lit(0)).alias(c)
    sums = usage.groupBy("view", "model").agg(
        F.count_if(paid).alias("calls"), F.count_if(~paid).alias("free"), *[total(c) for c in ("input", "cached", "output")]
    )
    if rates is None:
        return sums
    cost = ((F.col("input") - F.col("cached")) * F.col("input_rate") + F.col("cached") * F.col("cached_rate") + F.col("output") * F.col("output_rate")) / 1e6
    return sums.join(rates, "model", "left").withColumn("cost", cost).drop("input_rate", "cached_rate", "output_rate")


def short_number(n: Column) -> Column:
    """1234 as 1.2k, 1234567 as 1.23M."""
    return F.when(n >= 1_000_000, F.concat(F.format_string("%.2f", n / 1e6), F.lit("M"))).when(
        n >= 1000, F.concat(F.format_string("%.1f", n / 1e3), F.lit("k"))
    ).otherwise(n.cast("string"))


def latest_activity(documents: DataFrame, top: int = 6) -> DataFrame:
    return documents.where("date_text is not null").orderBy(F.desc("date_text"), "doc_id").limit(top)


def story_arc(documents: DataFrame, chapters: list[tuple[str, str]]) -> DataFrame:
    """(chapter, doc_id): for each (name, pattern) the first dated document whose id fits, and the last document of all."""
    key = F.struct("date_text", "doc_id")
    first = [F.min_by("doc_id", F.when(F.rlike("doc_id", F.lit(p)), key)).alias(f"c{k}") for k, (_, p) in enumerate(chapters)]
    row = documents.where("date_text is not null").agg(*first, F.max_by("doc_id", key).alias("last"))
    each = [F.struct(F.lit(name).alias("chapter"), F.col(f"c{k}").alias("doc_id")) for k, (name, _) in enumerate(chapters)]
    both = F.array(*each, F.struct(F.lit("last").alias("chapter"), F.col("last").alias("doc_id")))
    return row.select(F.explode(both).alias("x")).select("x.*").where("doc_id is not null")


def digest(triage: DataFrame, documents: DataFrame, facts: DataFrame, most_docs: int = 24, most_facts: int = 6) -> DataFrame:
    """The documents of relevance 1 or more, the most relevant and then oldest first, with their first facts."""
    chosen = (
        triage.where("relevance >= 1").join(documents.select("doc_id", "title", "date_text"), "doc_id")
        .orderBy(F.desc("relevance"), F.col("date_text").asc_nulls_last(), "doc_id").limit(most_docs)
    )
    place = F.row_number().over(Window.partitionBy("doc_id").orderBy("k"))
    few = facts.join(chosen.select("doc_id"), "doc_id", "left_semi").withColumn("r", place).where(F.col("r") <= most_facts)
    lists = few.groupBy("doc_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "fact"))), lambda x: x["fact"]).alias("facts"))
    return chosen.join(lists, "doc_id", "left")


def bundle_usage(usage: DataFrame, by: str = "answer_id") -> DataFrame:
    """(by, calls, input, cached, output): usage summed over all responses that one answer took."""
    total = lambda c: F.coalesce(F.sum(c), F.lit(0)).alias(c)
    return usage.groupBy(by).agg(F.count("*").alias("calls"), *[total(c) for c in ("input", "cached", "output")])
