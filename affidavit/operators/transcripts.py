"""Meeting transcripts: headers, utterances, and statements stitched over interruptions.

``files`` has path (``kind/NN_slug.txt``) and content.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import TRAILS_OFF, clock, is_open, n_words
from .people import resolve
from .stitching import stitch

# The lines of a transcript's head, of an utterance's head and of the preamble before it.
META_KEYS = ("Meeting", "Customer", "Date", "Phase", "Attendees", "Recording", "Present")
HEAD = r"^(.{2,60}?) (?:(\d+) minutes?(?: (\d+) seconds?)?|(\d+) seconds?)$"
STAMP = r"^\d+:\d{2}(?::\d{2})?\d+:\d{2}(?::\d{2})?$"
CAPITALS = "^[A-ZÅÄÖØÆ]{2,3}$"
UNKNOWN = "Unknown Speaker"
HEAD_LINES = 30


def stem(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/]*)\.[^./]*$", 1)


def kind_dir(path: Column) -> Column:
    return F.regexp_extract(path, "([^/]*)/[^/]*$", 1)


def short_code(path: Column) -> Column:
    letter = F.element_at(F.create_map(*[F.lit(x) for x in ("transcripts", "T", "emails", "E", "reports", "R")]), kind_dir(path))
    return F.concat(letter, F.substring_index(stem(path), "_", 1))


def doc_id(path: Column) -> Column:
    return F.concat_ws("/", kind_dir(path), stem(path))


def transcript_documents(files: DataFrame) -> DataFrame:
    """One row for each transcript with what its head says; the last of equal keys counts."""
    head = F.slice(F.split("content", "\n"), 1, HEAD_LINES)

    def value(key: str) -> Column:
        found = F.filter(F.transform(head, lambda s: F.trim(s)), lambda s: F.startswith(s, F.lit(key + ":")))
        return F.when(F.size(found) > 0, F.trim(F.substring(F.element_at(found, -1), len(key) + 2, 10_000)))

    people = F.filter(F.transform(F.split(F.coalesce(value("Attendees"), F.lit("")), "[;,]"), lambda s: F.trim(s)), lambda p: p != "")
    return files.where(kind_dir(F.col("path")) == "transcripts").select(
        doc_id(F.col("path")).alias("doc_id"), F.lit("transcript").alias("kind"), "path",
        F.coalesce(value("Meeting"), stem(F.col("path"))).alias("title"), value("Date").alias("date_text"),
        value("Phase").alias("phase"), people.alias("participants"), F.lit(None).cast("string").alias("subject"),
        F.contains(stem(F.col("path")), F.lit("INTERNAL")).alias("internal"), short_code(F.col("path")).alias("short"),
        F.when(F.contains("content", F.lit("Me:")), "internal").otherwise("timed").alias("dialect"), "content",
    )


def lines_of(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", F.posexplode(F.split("content", "\n")).alias("line", "raw")).withColumn("s", F.trim("raw"))


def timed_utterances(docs: DataFrame, aliases: DataFrame) -> DataFrame:
    """(doc_id, idx, speaker_raw, t, text, line) of transcripts whose utterances start with a name and a time."""
    lines = lines_of(docs).withColumn("name", F.trim(F.regexp_extract("s", HEAD, 1)))
    number = lambda k: F.coalesce(F.regexp_extract("s", HEAD, k).try_cast("int"), F.lit(0))
    lines = lines.withColumn("secs", number(2) * 60 + number(3) + number(4))
    lines = resolve(resolve(lines, "name", aliases, "head_pid"), "s", aliases, "line_pid")
    head = (F.col("name") != "") & (F.col("head_pid").isNotNull() | (F.col("name") == UNKNOWN))
    junk = (
        (F.col("s") == "") | F.rlike("s", F.lit(STAMP)) | F.rlike("s", F.lit(CAPITALS)) | (F.col("s") == UNKNOWN)
        | (F.col("line_pid").isNotNull() & (n_words(F.col("s")) <= 4))
    )
    order = Window.partitionBy("doc_id").orderBy("line")
    marked = lines.withColumns({"head": head, "junk": junk}).withColumn("block", F.sum(F.col("head").cast("int")).over(order))
    # what stands after a block's last line of speech is the next block's preamble
    after = Window.partitionBy("doc_id", "block").orderBy(F.desc("line"))
    body = (
        marked.where("block > 0")
        .withColumn("last", F.max(F.when(~F.col("head") & ~F.col("junk"), F.col("line"))).over(after.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
        .groupBy("doc_id", "block")
        .agg(
            F.max(F.when(F.col("head"), F.struct("name", "secs", "line"))).alias("h"),
            F.array_sort(F.collect_list(F.when(~F.col("head") & (F.col("s") != "") & (F.col("line") <= F.col("last")), F.struct("line", "s")))).alias("b"),
        )
        .where(F.size("b") > 0)
    )
    idx = F.row_number().over(Window.partitionBy("doc_id").orderBy("block")) - 1
    return body.select(
        "doc_id", idx.alias("idx"), F.col("h.name").alias("speaker_raw"), F.col("h.secs").alias("t"),
        F.array_join(F.transform("b", lambda x: x["s"]), " ").alias("text"), (F.col("h.line") + 1).alias("line"),
    )


def untimed_utterances(docs: DataFrame) -> DataFrame:
    """The same of transcripts that only know Me and Them."""
    pattern = r"^(Me|Them):\s*(.*)$"
    lines = lines_of(docs).where(F.rlike("s", F.lit(pattern)) & (F.trim(F.regexp_extract("s", pattern, 2)) != ""))
    idx = F.row_number().over(Window.partitionBy("doc_id").orderBy("line")) - 1
    return lines.select(
        "doc_id", idx.alias("idx"), F.regexp_extract("s", pattern, 1).alias("speaker_raw"), F.lit(None).cast("int").alias("t"),
        F.trim(F.regexp_extract("s", pattern, 2)).alias("text"), (F.col("line") + 1).alias("line"),
    )


def statements(stitched: DataFrame) -> DataFrame:
    """(doc_id, seq, segment, ...): one row for each statement, its members' text joined."""
    row = F.struct("idx", "text", "t", "line", "speaker_raw", "member")
    grouped = stitched.groupBy("doc_id", "segment").agg(F.array_sort(F.collect_list(row)).alias("rows"))
    members = F.filter("rows", lambda r: r["member"])
    aside = F.filter("rows", lambda r: ~r["member"])
    said = lambda r: F.when(
        r["t"].isNotNull(), F.concat(r["speaker_raw"], F.lit(" at "), clock(r["t"]), F.lit(": "), r["text"])
    ).otherwise(F.concat(r["speaker_raw"], F.lit(": "), r["text"]))
    text = F.trim(F.regexp_replace(F.array_join(F.transform("m", lambda r: F.trim(r["text"])), " "), r"(?U)\s+", " "))
    first, last = F.get("m", F.lit(0)), F.element_at("m", -1)
    place = lambda word, one, a, b: F.when(F.size("m") == 1, F.concat(F.lit(one), a)).otherwise(F.concat(F.lit(word), a, F.lit("–"), b))
    locator = F.when(first["t"].isNotNull(), place("", "at ", clock(first["t"]), clock(last["t"]))).otherwise(
        place("lines ", "line ", first["line"].cast("string"), last["line"].cast("string"))
    )
    seq = F.row_number().over(Window.partitionBy("doc_id").orderBy("segment")) - 1
    return grouped.withColumns({"m": members, "x": aside}).select(
        "doc_id", seq.alias("seq"), "segment", text.alias("text"), first["speaker_raw"].alias("speaker_raw"),
        first["t"].alias("t_start"), last["t"].alias("t_end"), locator.alias("locator"), is_open(text).alias("truncated"),
        F.rlike(text, F.lit(TRAILS_OFF)).alias("trails_off"), F.transform("x", said).alias("interrupted_by"),
        F.transform("m", lambda r: r["idx"]).alias("members"),
    )


def interruptions(stitched: DataFrame) -> DataFrame:
    """Utterances that became interruptions, which are no units of their own."""
    return stitched.where(~F.col("member"))


def transcript_units(files: DataFrame, people: DataFrame, aliases: DataFrame) -> DataFrame:
    """Unit rows of all transcripts."""
    docs = transcript_documents(files)
    timed, untimed = docs.where("dialect = 'timed'"), docs.where("dialect = 'internal'")
    spoken = timed_utterances(timed, aliases).unionByName(untimed_utterances(untimed))
    said = statements(stitch(spoken)).join(docs.drop("content"), "doc_id")
    said = resolve(said, "speaker_raw", aliases, "who")
    said = said.join(people.select(F.col("pid").alias("who"), F.col("display").alias("who_display"), F.col("org").alias("who_org")), "who", "left")
    unsure = F.col("dialect") == "internal"
    known = ~unsure & F.col("who").isNotNull()
    none = lambda t: F.lit(None).cast(t)
    return said.select(
        F.format_string("%s.s%04d", "short", "seq").alias("unit_id"), "doc_id", F.lit("transcript").alias("doc_kind"), "seq", "text",
        "date_text", F.col("date_text").try_cast("timestamp_ntz").alias("ts"), F.when(known, F.col("who")).alias("speaker"),
        F.when(known, F.col("who_display")).otherwise(F.col("speaker_raw")).alias("speaker_display"),
        F.when(known, F.col("who_org")).alias("speaker_org"), F.array().cast("array<string>").alias("recipients"), "locator",
        "truncated", "interrupted_by",
        F.transform("members", lambda k: F.format_string("%s.u%04d", F.col("short"), k)).alias("spans_units"),
        F.lit(False).alias("redacted"), none("string").alias("redaction_note"),
        F.struct(
            "t_start", "t_end", F.col("title").alias("meeting"), "phase", "internal", unsure.alias("unattributed_dialect"), "trails_off",
            none("string").alias("subject"), none("string").alias("from_raw"), none("int").alias("attachments_stripped"),
            none("int").alias("thread_position"), none("int").alias("thread_total"), none("string").alias("header_language"),
        ).alias("meta"),
    )
