"""Texts for readers and models, made of table columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def render_unit() -> Column:
    """A unit with its provenance and what to beware of, for rows of ``schemas.UNITS``."""
    who = F.concat("speaker_display", F.coalesce(F.concat(F.lit("/"), "speaker_org"), F.lit("")))
    bits = F.concat_ws(" | ", "date_text", who, "locator")
    head = F.concat(F.lit("["), "unit_id", F.lit("]"), F.when(bits != "", F.concat(F.lit(" ("), bits, F.lit(")"))).otherwise(""))
    lost = F.coalesce("meta.attachments_stripped", F.lit(0))
    flags = F.array_compact(
        F.array(
            F.when(F.col("truncated"), F.lit("!! CUT OFF in mid-sentence and never resumed: do NOT complete it")),
            F.when(lost > 0, F.concat(F.lit("!! "), lost, F.lit(" attachment(s) mentioned but NOT in the archive"))),
            F.when(F.col("meta.unattributed_dialect"), F.lit("!! speakers are only 'Me' and 'Them': who they are is unknown")),
            F.when(F.size("interrupted_by") > 0, F.concat(F.lit("interrupted by: "), F.array_join(F.slice("interrupted_by", 1, 3), " / "))),
        )
    )
    tail = F.when(F.size(flags) > 0, F.concat(F.lit("\n    "), F.array_join(flags, "\n    "))).otherwise("")
    return F.concat(head, F.lit("\n"), F.coalesce("text", F.lit("")), tail)


def render_documents(documents: DataFrame, units: DataFrame, include_redacted: bool = False) -> DataFrame:
    """(doc_id, rendered): a head with what is known of the document, then its units in stored order."""
    shown = units.withColumn("_hidden", F.coalesce("redacted", F.lit(False)))
    kept = F.lit(True) if include_redacted else ~F.col("_hidden")
    body = shown.groupBy("doc_id").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.when(kept, F.struct("seq", render_unit().alias("r"))))), lambda x: x["r"]), "\n\n").alias("body"),
        F.count_if("_hidden").alias("hidden"),
    )
    line = lambda label, c: F.concat(F.lit(label), c)
    people = F.array_join("participants", ", ")
    d = documents.join(body, "doc_id", "left")
    head = F.array_compact(
        F.array(
            line("DOCUMENT: ", F.col("doc_id")), line("kind: ", F.col("kind")), line("title: ", F.col("title")),
            line("latest date in document: ", F.col("date_text")), line("earliest date in document: ", F.col("meta.first_date")),
            line("phase: ", F.col("phase")),
            F.when(F.col("internal"), F.lit("NOTE: internal recording; the customer was not present")),
            F.when(people != "", line("participants: ", people)),
            F.when(F.col("kind").isin("email", "report"), F.lit("NOTE: the thread is stored newest first; each message has its OWN date")),
            F.when((F.col("hidden") > 0) & F.lit(not include_redacted), F.concat(F.lit("NOTE: "), "hidden", F.lit(" unit(s) withheld under an erasure request"))),
        )
    )
    return d.select("doc_id", F.concat(F.array_join(head, "\n"), F.lit("\n\n"), F.coalesce("body", F.lit(""))).alias("rendered"))


def render_evidence(units: DataFrame, documents: DataFrame) -> DataFrame:
    """(place columns, rendered) of units with their source, to be ordered by date_text (nulls last), doc_id and seq."""
    d = documents.select("doc_id", F.col("title").alias("_title"), F.coalesce("internal", F.lit(False)).alias("_internal"))
    source = F.concat(F.lit("  <source: "), F.coalesce("_title", "doc_id"), F.when(F.col("_internal"), "; INTERNAL recording").otherwise(""), F.lit(">"))
    return units.join(d, "doc_id", "left").select("date_text", "doc_id", "seq", F.concat(render_unit(), source).alias("rendered"))


def render_overview(inventory: DataFrame, stats: DataFrame) -> str:
    """The inventory as a text; a line for each document, as it is printed whole."""
    rows = inventory.orderBy("kind", "doc_id").toLocalIterator()
    lines = [
        f"  {r.short or '?':5s} {r.doc_id:60s} {r.kind:10s} {r.span:24s} {r.n_units:4d} units{' [INTERNAL]' if r.internal else ''}" for r in rows
    ]
    s = stats.first()
    total = f"totals: {s.documents} documents, {s.units} units, range {s.first_date} to {s.last_date}"
    return "\n".join(["ARCHIVE INVENTORY", "", *lines, "", total])


def answers_to_json(verified: dict[str, DataFrame]) -> DataFrame:
    """(answer_id, json): summary, citations, unsupported claims and warnings of verified answers."""
    lists = {
        "citations": verified["citations"].groupBy("answer_id").agg(F.array_sort(F.collect_list(F.struct("c", "k", "unit_id", "quote", "match", "ok", "reference"))).alias("citations")),
        "unsupported_claims": verified["unsupported"].groupBy("answer_id").agg(F.array_sort(F.collect_list("statement")).alias("unsupported_claims")),
        "warnings": verified["warnings"].groupBy("answer_id").agg(F.array_sort(F.collect_list("warning")).alias("warnings")),
    }
    out = verified["summary"]
    for df in lists.values():
        out = out.join(df, "answer_id", "left")
    return out.select("answer_id", F.to_json(F.struct(*[c for c in out.columns if c != "answer_id"])).alias("json"))


def answers_to_markdown(answers: DataFrame, verified: dict[str, DataFrame]) -> DataFrame:
    """(answer_id, markdown): answer, claims with their quotes and references, gaps, what is unsupported, warnings and the count.

    A quote's reference is found by unit and quote, so the same unit may be quoted twice.
    """
    cited = verified["citations"].select(
        "answer_id", "c", "k", F.concat(F.when(F.col("ok"), "").otherwise("**FAILED** "), F.lit("> “"), "quote", F.lit("” — "), "reference").alias("line")
    )
    quotes = cited.groupBy("answer_id", "c").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("k", "line"))), lambda x: x["line"]), "\n").alias("quotes"))
    claims = answers.select("answer_id", F.posexplode("claims").alias("c", "claim")).join(quotes, ["answer_id", "c"], "left")
    claim = F.concat(F.lit("- "), "claim.statement", F.coalesce(F.concat(F.lit(" ("), "claim.status", F.lit(")")), F.lit("")), F.coalesce(F.concat(F.lit("\n"), "quotes"), F.lit("")))
    listed = lambda df, by, line, name: df.groupBy("answer_id").agg(F.transform(F.array_sort(F.collect_list(F.struct(by, line.alias("l")))), lambda x: x["l"]).alias(name))
    bullets = lambda df, c, name: listed(df, F.col(c).alias("o"), F.concat(F.lit("- "), c), name)
    out = answers.select("answer_id", "answer").join(listed(claims, F.col("c"), claim, "claims"), "answer_id", "left")
    out = out.join(bullets(verified["unsupported"], "statement", "unsupported"), "answer_id", "left").join(bullets(verified["warnings"], "warning", "warnings"), "answer_id", "left")
    out = out.join(verified["summary"].select("answer_id", "total", "verified"), "answer_id", "left")
    part = lambda title, c: F.when(F.size(c) > 0, F.concat(F.lit(f"## {title}\n\n"), F.array_join(c, "\n")))
    count = F.format_string("%d of %d citations verified.", "verified", "total")
    return out.select(
        "answer_id",
        F.concat_ws("\n\n", "answer", part("Claims", F.col("claims")), part("Without citation", F.col("unsupported")), part("Warnings", F.col("warnings")), count).alias("markdown"),
    )


def render_brief(question: str, stats: DataFrame, digest: DataFrame, evidence: DataFrame) -> str:
    """What a model is given: the archive's numbers, the digest's documents with their facts, the evidence in order, the question.

    ``digest`` and ``evidence`` are bounded by their own limits (``rollups.digest``, ``sweep.kept_units``).
    """
    s = stats.first()
    docs = digest.orderBy(F.desc("relevance"), F.col("date_text").asc_nulls_last(), "doc_id").toLocalIterator()
    lines = [f"ARCHIVE: {s.documents} documents, {s.units} units, {s.first_date} to {s.last_date}", "", "DIGEST"]
    for d in docs:
        lines += [f"* {d.title} ({d.date_text or 'undated'}; relevance {d.relevance})", *[f"  - {f}" for f in d.facts or []]]
    shown = evidence.orderBy(F.col("date_text").asc_nulls_last(), "doc_id", "seq").toLocalIterator()
    return "\n".join([*lines, "", "EVIDENCE", *[r.rendered for r in shown], "", f"QUESTION: {question}"])
