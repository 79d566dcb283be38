"""E-mail threads and reports: messages, headers in three languages, cleaned bodies, units.

Messages are found as islands of header lines that hold a boundary line; all of
it is windows over lines.  Cleaning a body is text surgery in a fixed order and
runs as an Arrow UDF over one message's lines.
"""

from __future__ import annotations

import re
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import header_date, n_words
from .people import resolve
from .transcripts import doc_id, kind_dir, lines_of, short_code, stem

# Header names and the keys that they stand for, and the languages that names tell.
KEYS = {
    "From": "from", "Von": "from", "Från": "from", "Sent": "sent", "Gesendet": "sent", "Skickat": "sent", "Date": "sent",
    "To": "to", "An": "to", "Till": "to", "Cc": "cc", "CC": "cc", "Kopia": "cc",
    "Subject": "subject", "Betreff": "subject", "Ämne": "subject",
}
GERMAN, SWEDISH = ("Von", "Gesendet", "An", "Betreff"), ("Från", "Skickat", "Till", "Ämne", "Kopia")
HEADER = "^(Subject|Gesendet|Skickat|Betreff|Kopia|From|Sent|Date|Från|Till|Ämne|Von|To|An|Cc|CC):\\s*(.*)$"
BOUNDARY = r"^(Sent|Gesendet|Skickat|Date):\s*(.+)$"
# What stands for a lost attachment, what opens a signature, and what a signature holds.
IMAGE = r"(?im)\[Image removed by sender\]|\[cid:[^\]]*\]|Bild borttagen av avsändaren|^Image$"
BANNER = r"(?im)^This email originated from outside of .*?report button\.\s*$"
THREAD_META = r"(?m)^\s*(Messages in thread:\s*\d+|\*\*\*.*)$"
SIGNATURE = (
    r"(?i)^\s*(Kind regards|Best regards|Mit freundlichen Grüßen|Med vänliga hälsningar|Venliga hälsningar|Regards|Thanks|"
    r"Thank you|BR|Br|Best|Cheers|Hälsningar|Viele Grüße|Beste Grüße)[,.!]?\s*$"
)
ROLES = (
    r"Head of|Chief|Project Manager|Account (?:Executive|Director)|Solution (?:Consultant|Architect)|Technical Consultant|"
    r"Service Delivery|IT Integration Lead|Category Manager|Data Protection Officer|Principal Consultant|Consultant"
)
CONTACT = (
    r"\+\d[\d\s\-()]{6,}|[\w.\-]+@[\w.\-]+|.*\b(?:GmbH|AB|Oy|Ltd|BV)\b.*|(?:https?://|www\.).*|Connect with me|LinkedIn\w*|(?:"
    + ROLES + r")\b.*"
)
NOISE = re.compile(
    r"^(?:" + CONTACT + r"|Image|\[image\]|UTC [+\-].*|.*\|\s*UTC.*|[A-ZÅÄÖ][\w\s.\-]*\d{3,}[\w\s.\-]*)$", re.I
)
FOLLOWER = re.compile(r"^(?:" + CONTACT + r"|.*\b\d{3}\s?\d{2}\b.*|.*\|.*UTC.*)$", re.I)
TAIL, MOST_BELOW, SHARE_BELOW = 14, 10, 0.6


def message_lines(docs: DataFrame) -> DataFrame:
    """(doc_id, msg, line, raw, s, role): role is header or body; lines above the first message are left out.

    Header lines next to each other are an island; an island with a boundary
    line opens a message, and any other is text of the body it stands in.
    """
    order = Window.partitionBy("doc_id").orderBy("line")
    lines = lines_of(docs).withColumn("h", F.rlike("s", F.lit(HEADER)))
    lines = lines.withColumn("new", F.col("h") & ~F.coalesce(F.lag("h").over(order), F.lit(False)))
    lines = lines.withColumn("island", F.when(F.col("h"), F.sum(F.col("new").cast("int")).over(order)))
    opens = F.max(F.when(F.col("h"), F.rlike("s", F.lit(BOUNDARY)))).over(Window.partitionBy("doc_id", "island"))
    lines = lines.withColumn("head", F.col("h") & opens).withColumn(
        "msg", F.sum((F.col("new") & F.col("head")).cast("int")).over(order)
    )
    role = F.when(F.col("head"), "header").otherwise("body")
    return lines.where("msg > 0").select("doc_id", "msg", "line", "raw", "s", role.alias("role"))


def header_map(lines: DataFrame) -> DataFrame:
    """(doc_id, msg, from, sent, to, cc, subject, language): the first value of a key counts, and the last language."""
    name = F.regexp_extract("s", HEADER, 1)
    key = F.element_at(F.create_map(*[F.lit(x) for pair in KEYS.items() for x in pair]), name)
    heads = lines.where("role = 'header'").select(
        "doc_id", "msg", "line", key.alias("key"), F.trim(F.regexp_extract("s", HEADER, 2)).alias("value"),
        F.when(name.isin(*GERMAN), "de").when(name.isin(*SWEDISH), "sv").alias("lang"),
    )
    first = lambda k: F.min_by(F.when(F.col("key") == k, F.col("value")), F.when(F.col("key") == k, F.col("line"))).alias(k)
    return heads.groupBy("doc_id", "msg").agg(
        *[first(k) for k in ("from", "sent", "to", "cc", "subject")],
        F.coalesce(F.max_by("lang", F.when(F.col("lang").isNotNull(), F.col("line"))), F.lit("en")).alias("language"),
    )


def split_people(text: Column) -> Column:
    """Names of an address line: cut at ; and , outside of angle brackets."""
    parts = F.split(F.coalesce(text, F.lit("")), r"[;,](?![^<]*>)")
    return F.filter(F.transform(parts, lambda s: F.trim(s)), lambda p: p != "")


def cut_signature(lines: list[str], names: list[bool], phrases: re.Pattern | None = None) -> list[str]:
    """The lines of a body without salutation, signature and what trails; ``names`` tells lines that are a known name.

    ``phrases`` are further lines that count as noise at the end, as an organisation's slogan.
    """
    noise = lambda s: NOISE.match(s) or phrases and phrases.match(s)
    end = next((k for k, s in enumerate(lines) if re.match(SIGNATURE, s)), len(lines))

    def trimmed(end: int) -> int:
        while end and (not lines[end - 1].strip() or names[end - 1] or noise(lines[end - 1].strip())):
            end -= 1
        return end

    end = trimmed(end)
    for k in range(max(0, end - TAIL), end):
        below = [s.strip() for s in lines[k + 1 : end] if s.strip()]
        if names[k] and 0 < len(below) <= MOST_BELOW:
            if sum(bool(FOLLOWER.match(s)) for s in below) >= max(1, int(len(below) * SHARE_BELOW)):
                end = trimmed(k)
                break
    start = next((k for k, s in enumerate(lines[:end]) if s.strip()), end)
    return lines[start:end]


def _cut(phrases: tuple[str, ...]) -> Callable:
    more = re.compile(f"^(?:{'|'.join(phrases)})$", re.I) if phrases else None

    @F.arrow_udf(T.StringType())
    def cut(lines: pa.Array, names: pa.Array) -> pa.Array:
        # lists are made one by one, as a batch has thousands of messages
        each = zip((a.as_py() for a in lines), (b.as_py() for b in names), strict=True)
        return pa.array(["\n".join(cut_signature(a, b, more)).strip() for a, b in each], pa.string())

    return cut


def clean_bodies(lines: DataFrame, aliases: DataFrame, phrases: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, msg, text, n_images) of every message, empty ones too.

    ``phrases`` are patterns of whole lines that say nothing, as slogans and stock phrases of one corpus; such lines are emptied.
    """
    bodies = lines.groupBy("doc_id", "msg").agg(
        F.array_sort(F.collect_list(F.when(F.col("role") == "body", F.struct("line", "raw")))).alias("rows")
    )
    raw = F.array_join(F.transform("rows", lambda r: r["raw"]), "\n")
    bodies = bodies.select("doc_id", "msg", raw.alias("raw"))
    bare = F.col("raw")
    for pattern in (BANNER, IMAGE, THREAD_META):
        bare = F.regexp_replace(bare, pattern, "")
    bodies = bodies.select("doc_id", "msg", F.regexp_count("raw", F.lit(IMAGE)).alias("n_images"), F.split(bare, "\n").alias("lines"))
    each = bodies.select("doc_id", "msg", F.posexplode("lines").alias("k", "s")).withColumn("t", F.trim("s"))
    named = resolve(each, "t", aliases, "who").groupBy("doc_id", "msg").agg(
        F.array_sort(F.collect_list(F.struct("k", (F.col("who").isNotNull() & (F.col("t") != "") & (n_words(F.col("t")) <= 4)).alias("is_name")))).alias("f")
    )
    joined = bodies.join(named, ["doc_id", "msg"]).withColumn("cut", _cut(phrases)("lines", F.transform("f", lambda x: x["is_name"])))
    stock = rf"(?im)^\s*({'|'.join(phrases) or '(?!)'})$"
    text = F.regexp_replace(F.regexp_replace("cut", stock, ""), r"\n{3,}", "\n\n")
    return joined.select("doc_id", "msg", F.regexp_replace(text, r"^\s+|\s+$", "").alias("text"), "n_images")


def threads(files: DataFrame) -> DataFrame:
    path = F.col("path")
    kind = F.when(kind_dir(path) == "reports", "report").otherwise("email")
    declared = F.regexp_extract("content", r"(?m)^Messages in thread:\s*(\d+)", 1).try_cast("int")
    return files.where(kind_dir(path).isin("emails", "reports")).select(
        doc_id(path).alias("doc_id"), kind.alias("kind"), "path", short_code(path).alias("short"), stem(path).alias("stem"),
        declared.alias("declared"), "content",
    )


def thread_units(files: DataFrame, people: DataFrame, aliases: DataFrame, phrases: tuple[str, ...] = ()) -> DataFrame:
    """Unit rows of all threads: stored newest first, numbered from the oldest; empty bodies are counted and left out."""
    docs = threads(files)
    lines = message_lines(docs)
    heads = header_map(lines)
    total = Window.partitionBy("doc_id")
    heads = heads.withColumn("total", F.max("msg").over(total)).withColumn("position", F.col("total") - F.col("msg") + 1)
    sent = header_date(F.coalesce("sent", F.lit("")))
    msgs = heads.join(clean_bodies(lines, aliases, phrases), ["doc_id", "msg"]).where("text <> ''").withColumn("ts", sent)
    msgs = resolve(msgs, "from", aliases, "who").join(
        people.select(F.col("pid").alias("who"), F.col("display").alias("who_display"), F.col("org").alias("who_org")), "who", "left"
    )
    asked = msgs.select("doc_id", "msg", F.posexplode(F.concat(split_people(F.col("to")), split_people(F.col("cc")))).alias("k", "r"))
    found = resolve(asked, "r", aliases, "rid").groupBy("doc_id", "msg").agg(
        F.array_sort(F.collect_list(F.struct("k", F.coalesce("rid", "r").alias("r")))).alias("rs")
    )
    msgs = msgs.join(found, ["doc_id", "msg"], "left").join(docs.drop("content"), "doc_id")
    seq = F.row_number().over(Window.partitionBy("doc_id").orderBy("msg")) - 1
    none = lambda t: F.lit(None).cast(t)
    return msgs.select(
        F.format_string("%s.m%02d", "short", "position").alias("unit_id"), "doc_id", F.col("kind").alias("doc_kind"), seq.alias("seq"),
        "text", F.date_format("ts", "yyyy-MM-dd'T'HH:mm").alias("date_text"), "ts", F.col("who").alias("speaker"),
        F.coalesce("who_display", F.nullif("from", F.lit(""))).alias("speaker_display"), F.col("who_org").alias("speaker_org"),
        F.coalesce(F.transform("rs", lambda x: x["r"]), F.array().cast("array<string>")).alias("recipients"),
        F.concat(
            F.format_string("message %d of %d", "position", "total"),
            F.coalesce(F.concat(F.lit(", "), F.date_format("ts", "yyyy-MM-dd")), F.lit(", date unparsed")),
        ).alias("locator"),
        F.lit(False).alias("truncated"), F.array().cast("array<string>").alias("interrupted_by"),
        F.array().cast("array<string>").alias("spans_units"), F.lit(False).alias("redacted"), none("string").alias("redaction_note"),
        F.struct(
            none("int").alias("t_start"), none("int").alias("t_end"), none("string").alias("meeting"), none("string").alias("phase"),
            none("boolean").alias("internal"), none("boolean").alias("unattributed_dialect"), none("boolean").alias("trails_off"),
            "subject", F.coalesce("from", F.lit("")).alias("from_raw"), F.col("n_images").cast("int").alias("attachments_stripped"),
            F.col("position").cast("int").alias("thread_position"), F.col("total").cast("int").alias("thread_total"),
            F.col("language").alias("header_language"),
        ).alias("meta"),
    )


def thread_documents(files: DataFrame, units: DataFrame) -> DataFrame:
    """Document rows of the threads with the dates of their messages and the numbers declared and parsed."""
    docs = threads(files)
    parsed = message_lines(docs).groupBy("doc_id").agg(F.max("msg").cast("int").alias("parsed"))
    sums = units.groupBy("doc_id").agg(
        F.max("date_text").alias("date_text"), F.min("date_text").alias("first_date"),
        F.array_sort(F.collect_set("speaker_display")).alias("participants"), F.count("*").cast("int").alias("n_units"),
        F.min_by("meta.subject", "seq").alias("subject"),
    )
    return docs.join(parsed, "doc_id", "left").join(sums, "doc_id", "left").select(
        "doc_id", "kind", "path", F.coalesce("subject", "stem").alias("title"), "date_text", F.lit(None).cast("string").alias("phase"),
        F.coalesce("participants", F.array().cast("array<string>")).alias("participants"), "subject",
        F.coalesce("n_units", F.lit(0)).alias("n_units"), F.lit(False).alias("internal"),
        F.struct(
            "short", F.lit(None).cast("string").alias("dialect"), F.col("declared").alias("declared_messages"),
            F.coalesce("parsed", F.lit(0)).alias("parsed_messages"), "first_date",
        ).alias("meta"),
    )
