"""Registered queries of the archive operators over the driver's tables, and SQL for the same rows.

The tables stand in for an archive: a document is a unit of the document
``source``, dated by its id, and withheld if it is labelled toxic; turns of a
conversation, orders, events and line items stand in for what has dates,
speakers and counts.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import erase, index, people, rollups, search, sweep, threads, transcripts, verify
from ..sources import corpus, store
from . import sample


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def units_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    toxic = table(spark, sf_dir, "labels").groupBy("doc_id").agg(F.max("toxic").alias("toxic")).where("toxic = 1")
    docs = table(spark, sf_dir, "documents").join(toxic.withColumnRenamed("doc_id", "k"), F.col("doc_id") == F.col("k"), "left")
    date = F.date_format(F.date_add(F.lit("2024-01-01").cast("date"), F.col("doc_id").cast("int")), "yyyy-MM-dd")
    return docs.select(
        F.col("doc_id").alias("unit_id"), F.col("source").alias("doc_id"), F.col("doc_id").cast("int").alias("seq"), "text", "lang",
        date.alias("date_text"), F.col("k").isNotNull().alias("redacted"),
    )


def text_index(spark: SparkSession, sf_dir: str) -> index.TextIndex:
    """The stored index of the units, built by the first query that asks for it and again once a file of its tables has changed."""
    sources = [table(spark, sf_dir, n) for n in ("documents", "labels")]
    folder = f"{store.shared_folder(spark)}/index-{hashlib.sha256(sf_dir.encode()).hexdigest()[:16]}"
    return index.load_or_build(units_of(spark, sf_dir), folder, *sources)


UNITS_SQL = """
with toxic as (select doc_id from labels group by doc_id having max(toxic) = 1),
units as (
    select d.doc_id as unit_id, d.source as doc_id, cast(d.doc_id as int) as seq, d.text, d.lang,
           strftime(date '2024-01-01' + cast(d.doc_id as int), '%Y-%m-%d') as date_text, t.doc_id is not null as redacted
    from documents d left join toxic t on t.doc_id = d.doc_id
)"""
TOKENS_SQL = (
    "list_filter(list_transform(regexp_extract_all(text, '[A-Za-zÀ-ÿ0-9][A-Za-zÀ-ÿ0-9_.%-]*', 0), lambda t: lower(t)), "
    "lambda t: length(t) > 1 and not list_contains([" + ", ".join(f"'{w}'" for w in X.STOP_WORDS) + "], t))"
)
Q, SQL = {}, {}


def query(sql: str | None = None) -> Callable:
    """Registers a query under its function's name, with SQL where it can be expressed."""

    def put(f: Callable[[SparkSession, str], DataFrame]) -> Callable:
        Q[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return put


@query(UNITS_SQL + """
select count(*) as units, count(*) filter (redacted) as redacted, cast(0 as bigint) as truncated, min(date_text) as first_date,
       max(date_text) as last_date, (select count(distinct source) from documents) as documents
from units""")
def archive_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    units = units_of(spark, sf_dir).withColumn("truncated", F.lit(False))
    return rollups.stats(units, units.select("doc_id").distinct())


@query(UNITS_SQL + """
select doc_id, min(lang) as short, 'source' as kind,
       case when min(date_text) = max(date_text) then min(date_text) else min(date_text) || '..' || max(date_text) end as span,
       false as internal, count(*) filter (not redacted) as n_units
from units group by doc_id""")
def inventory(spark: SparkSession, sf_dir: str) -> DataFrame:
    units = units_of(spark, sf_dir)
    docs = units.groupBy("doc_id").agg(
        F.lit("source").alias("kind"), F.max("date_text").alias("date_text"), F.lit(False).alias("internal"),
        F.struct(F.min("lang").alias("short"), F.min("date_text").alias("first_date")).alias("meta"),
    )
    return rollups.inventory(docs, units)


@query(UNITS_SQL + """
select unit_id, doc_id, seq, cast(strpos(lower(text), 'license') - 1 as int) as start,
       substr(text, strpos(lower(text), 'license'), 7) as matched,
       '…' || replace(substr(text, greatest(strpos(lower(text), 'license') - 91, 0) + 1,
              strpos(lower(text), 'license') - 1 - greatest(strpos(lower(text), 'license') - 91, 0) + 97), chr(10), ' ') || '…' as excerpt
from units where not redacted and contains(lower(text), 'license') order by doc_id, seq limit 100""")
def grep_literal(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.grep(units_of(spark, sf_dir), "license")


@query(r"""
with m as (select page_id, url, regexp_extract(url, '(?i)(/[a-z]{2}/[0-9]+[05]([?#/]|$))', 1) as matched from pages)
select page_id as unit_id, 'pages' as doc_id, cast(page_id as int) as seq, cast(strpos(url, matched) - 1 as int) as start, matched,
       '…' || substr(url, greatest(strpos(url, matched) - 91, 0) + 1,
              strpos(url, matched) - 1 - greatest(strpos(url, matched) - 91, 0) + length(matched) + 90) || '…' as excerpt
from m where matched <> ''""")
def grep_regex(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select(
        F.col("page_id").alias("unit_id"), F.lit("pages").alias("doc_id"), F.col("page_id").cast("int").alias("seq"),
        F.col("url").alias("text"), F.lit(False).alias("redacted"),
    )
    return search.grep(pages, "/[a-z]{2}/[0-9]+[05]([?#/]|$)", regex=True, limit=None)


@query(UNITS_SQL + f""",
t as (select unit_id, unnest({TOKENS_SQL}) as token from units where not redacted)
select token, count(*) as n, count(distinct unit_id) as df from t group by token order by n desc, token limit 50""")
def tokens_top(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = text_index(spark, sf_dir).terms().select("token", F.col("cf").alias("n"), "df")
    return counts.orderBy(F.desc("n"), "token").limit(50)


BM25_SQL = f""",
tok as (select unit_id, doc_id, seq, {TOKENS_SQL} as ts from units where not redacted),
size as (select count(*) as n, avg(len(ts)) as avgdl from tok),
asked as (select token, count(*) as times from (values ('license'), ('version'), ('work'), ('license')) q(token) group by token),
held as (select unit_id, doc_id, seq, len(ts) as length, token, count(*) as f from (select *, unnest(ts) as token from tok) join asked using (token) group by all),
df as (select token, count(*) as df from held group by token),
hits as (
    select unit_id, doc_id, seq,
           round(round(sum(times * ln(1 + (n - df + 0.5) / (df + 0.5)) * f * 2.5 / (f + 1.5 * (1 - 0.75 + 0.75 * length / avgdl))), 4), 3) as score
    from held join df using (token) join asked using (token) cross join size group by unit_id, doc_id, seq
)"""


@query(UNITS_SQL + BM25_SQL + " select * from hits where score > 0")
def bm25_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return text_index(spark, sf_dir).search("License version work, license", top_k=None, digits=3)


@query(UNITS_SQL + BM25_SQL + " select unit_id, doc_id, seq from hits where score > 0 order by score desc, doc_id, seq limit 40")
def bm25_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return text_index(spark, sf_dir).search("License version work, license", top_k=40, digits=3).select("unit_id", "doc_id", "seq")


@query(UNITS_SQL + BM25_SQL + " select * from hits where score > 0")
def bm25_unindexed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same scores from the units alone, in one pass over their texts."""
    hits = search.bm25(units_of(spark, sf_dir), "License version work, license", top_k=None)
    return hits.withColumn("score", F.round("score", 3)).where("score > 0")


FIGURES_SQL = (
    "m as (select unit_id, doc_id, seq, date_text, regexp_extract_all(text, '{p}', 0) as f, regexp_split_to_array(text, '{p}') as g "
    "from units where not redacted),\n"
    "found as (select unit_id, doc_id, seq, date_text, k - 1 as n, f[k] as raw, "
    "list_sum(list_transform(g[1:k], lambda x: length(x))) + coalesce(list_sum(list_transform(f[1:k - 1], lambda x: length(x))), 0) as start "
    "from (select *, unnest(range(1, len(f) + 1)) as k from m))"
).replace("{p}", X.FIGURE.replace("'", "''"))


@query(UNITS_SQL + ", " + FIGURES_SQL + """
select unit_id, doc_id, seq, date_text, cast(n as int) as n, trim(raw) as figure, cast(start as int) as start from found""")
def figures(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.find_figures(units_of(spark, sf_dir)).drop("context")


KINDS = "sales rose 12.5 % and EUR 3,000k or $5m, 40k of 1.250.000; twenty-five percent of 30 days, not 48 percent nor fourteen percent"


@query("""
select * from (values (0, '12.5 %', 11), (1, 'EUR 3,000k', 22), (2, '$5m', 36), (3, '40k', 41), (4, '1.250.000', 48), (5, 'twenty-five percent', 59), (6, '30 days', 82))
t(n, figure, start)""")
def figure_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    one = spark.range(1).select(F.posexplode(X.figures(F.lit(KINDS))).alias("n", "f"))
    return one.select("n", "f.figure", "f.start")


@query(UNITS_SQL + ", " + FIGURES_SQL + """
select unit_id, doc_id, seq, date_text, cast(n as int) as n, trim(raw) as figure, cast(start as int) as start,
       date_text = max(date_text) over (partition by lower(trim(raw))) as latest
from found""")
def figure_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.latest_figures(figures(spark, sf_dir))


@query(UNITS_SQL + BM25_SQL + """
select p.unit_id, p.doc_id, p.seq, u.date_text, substr(u.text, 1, 300) as text
from hits p join units u using (unit_id) where score > 0 and u.date_text between '2024-02-01' and '2026-06-30'""")
def timeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = search.timeline(units_of(spark, sf_dir), "License version work, license", "2024-02-01", "2026-06-30", pool=None, show=None, index=text_index(spark, sf_dir))
    return found.select("unit_id", "doc_id", "seq", "date_text", "text")


@query("""
select o_orderkey as unit_id, o_orderpriority as doc_id, case when o_orderkey % 7 = 0 then null else strftime(o_orderdate, '%Y-%m-%d') end as date_text,
       row_number() over (partition by o_orderpriority order by case when o_orderkey % 7 = 0 then null else strftime(o_orderdate, '%Y-%m-%d') end nulls last, o_orderkey) as place
from orders""")
def chronological(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as units of their priority, every seventh undated, in each one's order of time."""
    day = F.when(F.col("o_orderkey") % 7 != 0, F.date_format("o_orderdate", "yyyy-MM-dd"))
    orders = table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("unit_id"), F.col("o_orderpriority").alias("doc_id"), day.alias("date_text"), F.col("o_orderkey").alias("seq")
    )
    return search.places(orders, dated=True).select("unit_id", "doc_id", "date_text", "place")


def turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").select(
        F.concat_ws(".", "conv_id", "turn").alias("unit_id"), F.col("conv_id").alias("doc_id"), F.col("turn").alias("seq"), "role", "text",
        F.lit(False).alias("redacted"),
    )


@query("""
with r as (select conv_id || '.' || turn as unit_id, conv_id, turn, text, row_number() over (partition by conv_id order by turn) as rn from conversations)
select a.unit_id as anchor, b.unit_id, b.conv_id as doc_id, b.turn as seq, cast(b.rn - a.rn as int) as offset, b.text
from r a join r b on a.conv_id = b.conv_id and abs(a.rn - b.rn) <= 2""")
def context_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    units = turns(spark, sf_dir)
    return search.context_window(units, units, width=2)


def line_utterances(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of documents as utterances of two speakers, 30 seconds apart; blank lines are left out."""
    lines = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("line", "text"))
    lines = lines.where(F.trim("text") != "")
    idx = F.row_number().over(Window.partitionBy("doc_id").orderBy("line")) - 1
    return lines.select(
        "doc_id", idx.alias("idx"), F.when(F.col("line") % 3 == 0, "A").otherwise("B").alias("speaker_raw"), (F.col("line") * 30).alias("t"),
        "text", "line",
    )


@query(r"""
with recursive l as (select doc_id, unnest(string_split(text, chr(10))) as text, generate_subscripts(string_split(text, chr(10)), 1) - 1 as line from documents),
u as (
    select doc_id, cast(row_number() over (partition by doc_id order by line) - 1 as int) as idx, case when line % 3 = 0 then 'A' else 'B' end as sp, line * 30 as t,
           regexp_replace(text, '^\s+|\s+$', '', 'g') as x,
           regexp_matches(trim(text), '(?i)^(mm+|mm-hm+|uh+|um+|hmm+|yeah|yep|yes|no|ok|okay|right|sure|exactly|true|got it|i see|of course|indeed|sorry)[.,!?…]*$') as bc
    from l where trim(text) <> ''
),
o as (
    select *, x <> '' and (regexp_matches(x, '(\.\.\.|…)\s*$') or not regexp_matches(x, '[.!?…"'')\]]\s*$')) as open from u
),
n as (
    select a.doc_id, a.idx, min(b.idx) as nxt from o a join o b on b.doc_id = a.doc_id and b.idx between a.idx + 1 and a.idx + 8 and b.sp = a.sp and not b.bc and b.t - a.t <= 120
    where a.open group by a.doc_id, a.idx
),
s as (select o.doc_id, o.idx, n.nxt from o left join n on n.doc_id = o.doc_id and n.idx = o.idx),
walk as (
    select doc_id, idx, idx as segment, true as member, nxt as expected from s where idx = 0
    union all
    select s.doc_id, s.idx, case when w.expected is null then s.idx else w.segment end, w.expected is null or s.idx = w.expected,
           case when w.expected is null or s.idx = w.expected then s.nxt else w.expected end
    from walk w join s on s.doc_id = w.doc_id and s.idx = w.idx + 1
)
select doc_id, idx, segment, member from walk""")
def utterance_stitch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return transcripts.stitch(line_utterances(spark, sf_dir)).select("doc_id", "idx", "segment", "member")


HEADER_LINES = [
    "Subject: Plan", "From: A", "Date: Monday, March 3, 2025 4:05 PM", "To: B", "", "First body", "To: be honest", "more", "Von: C",
    "Gesendet: Montag, 3. März 2025 09:15", "An: D", "Betreff: AW: Plan", "Zweiter Text", "Från: E", "Skickat: den 2 mars 2025 08:00", "tredje",
]


@query("with t(line, s) as (values " + ", ".join(f"({k}, '{s}')" for k, s in enumerate(HEADER_LINES)) + r"""),
h as (select *, regexp_matches(s, '^(Subject|Gesendet|Skickat|Betreff|Kopia|From|Sent|Date|Från|Till|Ämne|Von|To|An|Cc|CC):\s*(.*)$') as h,
             regexp_matches(s, '^(Sent|Gesendet|Skickat|Date):\s*(.+)$') as b from t),
n as (select *, h and not coalesce(lag(h) over (order by line), false) as new from h),
i as (select *, case when h then sum(new::int) over (order by line) end as island from n),
o as (select *, h and bool_or(b) over (partition by island) as head from i),
m as (select line, s, head, sum((new and head)::int) over (order by line) as msg from o)
select cast(msg as bigint) as msg, line, case when head then 'header' else 'body' end as role from m where msg > 0""")
def header_islands(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.createDataFrame([("d", "\n".join(HEADER_LINES))], "doc_id string, content string")
    return threads.message_lines(docs).select("msg", "line", "role")


DATES = [
    ("Monday, March 3, 2025 16:05", "2025-03-03T16:05"), ("Monday, March 3, 2025 9:05 AM", "2025-03-03T09:05"),
    ("Monday, March 3, 2025 4:05 PM", "2025-03-03T16:05"), ("Monday, March 3, 2025 12:05 AM", "2025-03-03T00:05"),
    ("Monday, March 3, 2025 12:05 PM", "2025-03-03T12:05"), ("Montag, 3. März 2025 09:15", "2025-03-03T09:15"),
    ("Freitag, 12. Dezember 2025 23:59", "2025-12-12T23:59"), ("den 2 mars 2025 08:00", "2025-03-02T08:00"),
    ("söndag den 12 augusti 2024 18:30", "2024-08-12T18:30"), ("Monday, Floreal 3, 2025 4:05 PM", None), ("", None), ("yesterday", None),
]


@query("select * from (values " + ", ".join(f"('{a}', {repr(b) if b else 'null'})" for a, b in DATES) + ") t(raw, parsed)")
def date_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = spark.createDataFrame([(a,) for a, _ in DATES], "raw string")
    return raw.select("raw", F.date_format(X.header_date(F.col("raw")), "yyyy-MM-dd'T'HH:mm").alias("parsed"))


@query("""
with p as (select 'c' || c_custkey as pid, c_name as display, 0 as prio from customer union all select 's' || s_suppkey, s_name, 1 from supplier),
a as (
    select pid, prio, lower(display) as alias from p
    union select pid, prio, lower(string_split(display, '#')[2]) from p
    union select pid, prio, lower(substr(display, 1, 1)) from p
)
select alias, arg_min(pid, (prio, pid)) as pid from a group by alias""")
def alias_first_writer(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer").select(F.concat(F.lit("c"), "c_custkey").alias("pid"), F.col("c_name").alias("display"), F.lit(0).alias("prio"))
    s = table(spark, sf_dir, "supplier").select(F.concat(F.lit("s"), "s_suppkey").alias("pid"), F.col("s_name").alias("display"), F.lit(1).alias("prio"))
    named = c.unionAll(s).withColumns({"aliases": F.array(F.substring_index("display", "#", -1)), "emails": F.array().cast("array<string>")})
    return people.alias_table(named)


@query(r"""
with m as (select unnest(regexp_extract_all(text, '[A-Za-z0-9_.\-]+@[A-Za-z0-9_.\-]+\.[A-Za-z]{2,}', 0)) as raw from documents),
e as (select distinct lower(regexp_replace(raw, '\.+$', '')) as email from m)
select email, split_part(email, '@', 1) as local from e where split_part(email, '@', 1) not in ('datenschutz', 'info', 'support', 'noreply')""")
def discover_emails(spark: SparkSession, sf_dir: str) -> DataFrame:
    nobody = spark.createDataFrame([], "pid string, display string, emails array<string>")
    return people.discover_emails(table(spark, sf_dir, "documents").select("text"), nobody).select("email", "local")


@query(r"""
with m as (select doc_id, unnest(regexp_extract_all(text, '[A-Za-z0-9_.\-]+@[A-Za-z0-9_.\-]+\.[A-Za-z]{2,}', 0)) as raw from documents)
select distinct doc_id, lower(regexp_replace(raw, '\.+$', '')) as email, 'p_' || lower(regexp_replace(raw, '\.+$', '')) as pid from m""")
def resolve_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The people behind every address that a document holds."""
    docs = table(spark, sf_dir, "documents")
    named = docs.select("doc_id", F.explode_outer(F.regexp_extract_all("text", F.lit(X.EMAIL), F.lit(0))).alias("raw")).where("raw is not null").distinct()
    email = F.lower(F.regexp_replace("raw", r"\.+$", ""))
    aliases = named.select(email.alias("alias")).distinct().withColumn("pid", F.concat(F.lit("p_"), "alias"))
    asked = named.withColumn("asked", F.concat(F.lit("Someone <"), "raw", F.lit(">")))
    return people.resolve(asked, "asked", aliases).select("doc_id", email.alias("email"), "pid").distinct()


@query(r"""
select doc_id, regexp_replace(regexp_replace(text, '(^|[^A-Za-z0-9_.@À-ɏ-])(idiot|moron)([^A-Za-z0-9_@À-ɏ-]|$)', '\1[erased]\3', 'gi'),
                              '(^|[^A-Za-z0-9_.@À-ɏ-])(idiot|moron)([^A-Za-z0-9_@À-ɏ-]|$)', '\1[erased]\3', 'gi') as text
from documents where regexp_matches(text, '(^|[^A-Za-z0-9_.@À-ɏ-])(?i:idiot|moron)([^A-Za-z0-9_@À-ɏ-]|$)')""")
def redact_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    pattern = erase.form_pattern(["moron", "idiot"])
    docs = table(spark, sf_dir, "documents").where(F.rlike("text", F.lit(pattern)))
    return docs.select("doc_id", erase.redact(F.col("text"), pattern).alias("text"))


@query(UNITS_SQL + ", all_" + FIGURES_SQL.replace("where not redacted", "").replace("from m)", "from all_m)").replace("found as", "all_found as") + """,
f as (select lower(trim(raw)) as figure, bool_or(doc_id <> 'src0') as survived from all_found group by 1 having bool_or(doc_id = 'src0'))
select coalesce(list_sort(list(figure) filter (survived)), []) as survived, coalesce(list_sort(list(figure) filter (not survived)), []) as did_not_survive from f""")
def erase_survival(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Figures of one source, and whether any other source states them."""
    units = units_of(spark, sf_dir).withColumn("_mine", F.col("doc_id") == "src0")
    return erase.figure_survival(units, units.withColumn("redacted", F.col("_mine")))


def norm_sql(c: str) -> str:
    return rf"lower(trim(regexp_replace({c}, '\s+', ' ', 'g')))"


@query(f"""
select item_id, d.doc_id from benchmark b join documents d on contains({norm_sql('d.text')}, {norm_sql('b.text')})""")
def verify_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents that hold a benchmark passage word for word, found by its rarest run of words and then compared whole."""
    return verify.exact_hits(table(spark, sf_dir, "benchmark").select("item_id", "text"), table(spark, sf_dir, "documents").select("doc_id", "text"))


@query("""
with asked(place, unit_id) as (select cast(range as int), case when range % 5 = 4 then 900000000 + range else range * 3 end from range(40)),
toxic as (select doc_id from labels group by doc_id having max(toxic) = 1)
select a.place, a.unit_id, case when d.doc_id is null then 'missing' when t.doc_id is not null then 'withheld' else 'found' end as status,
       case when d.doc_id is not null and t.doc_id is null then d.text end as text
from asked a left join documents d on d.doc_id = a.unit_id left join toxic t on t.doc_id = a.unit_id""")
def get_units_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    wanted = spark.range(40).select(
        F.col("id").cast("int").alias("place"), F.when(F.col("id") % 5 == 4, F.col("id") + 900_000_000).otherwise(F.col("id") * 3).alias("unit_id")
    )
    return search.get_units(units_of(spark, sf_dir), wanted)


@query("select role as name, count(distinct conv_id) as n from conversations group by role")
def participation(spark: SparkSession, sf_dir: str) -> DataFrame:
    named = turns(spark, sf_dir).groupBy("doc_id").agg(F.collect_set(F.concat("role", F.lit(" (chat)"))).alias("participants"))
    return rollups.participation(named, top=None)


@query("select o_orderpriority as phase, count(*) as n, min(o_orderdate) as first_date, max(o_orderdate) as last_date from orders where o_orderpriority is not null group by 1")
def phase_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rollups.phase_rollup(table(spark, sf_dir, "orders"), "o_orderpriority", "o_orderdate")


@query("""
with d as (select distinct o_orderdate::date as until from orders), g as (select lag(until) over (order by until) as since, until from d)
select since, until, cast(until - since as int) as days from g where since is not null order by days desc, since limit 3""")
def silences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rollups.silences(table(spark, sf_dir, "orders"), "o_orderdate")


@query("""
select event_type as view, 'k' || (user_id % 3) as model, count(*) filter (k % 10 <> 0) as calls, count(*) filter (k % 10 = 0) as free,
       coalesce(sum(k) filter (k % 10 <> 0), 0)::bigint as input, coalesce(sum(k // 2) filter (k % 10 <> 0), 0)::bigint as cached,
       coalesce(sum(k + 1) filter (k % 10 <> 0), 0)::bigint as output
from (select *, cast(json_extract(props, '$.k') as bigint) as k from events) group by 1, 2""")
def usage_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.get_json_object("props", "$.k").cast("long")
    used = table(spark, sf_dir, "events").select(
        F.col("event_type").alias("view"), F.concat(F.lit("k"), F.col("user_id") % 3).alias("model"), k.alias("input"),
        F.floor(k / 2).alias("cached"), (k + 1).alias("output"), (k % 10 == 0).alias("free"),
    )
    return rollups.usage_rollup(used)


@query("""
with l0 as (select source, cast(doc_id as bigint) as k, sha256(coalesce(text, '')) as h from documents),
l1 as (select source, cast(floor(k / 1000) as bigint) as k, sha256(string_agg(h, '' order by k)) as h from l0 group by source, cast(floor(k / 1000) as bigint)),
l2 as (select source, cast(floor(k / 1000) as bigint) as k, sha256(string_agg(h, '' order by k)) as h from l1 group by source, cast(floor(k / 1000) as bigint)),
l3 as (select source, cast(floor(k / 1000) as bigint) as k, sha256(string_agg(h, '' order by k)) as h from l2 group by source, cast(floor(k / 1000) as bigint))
select source, substr(sha256(string_agg(h, '' order by k)), 1, 16) as fingerprint from l3 group by source""")
def fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.range_fingerprints(table(spark, sf_dir, "documents"), "source", "doc_id", "text")


@query("""
with t as (select l.doc_id, l.quality + l.toxic as relevance, d.source as title, strftime(date '2024-01-01' + cast(l.doc_id as int), '%Y-%m-%d') as date_text, d.text
           from labels l join documents d using (doc_id) where l.quality + l.toxic >= 1 order by relevance desc, date_text, l.doc_id limit 24)
select doc_id, relevance, title, date_text, list_slice(string_split(text, chr(10)), 1, 6) as facts from t""")
def digest_topn(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = units_of(spark, sf_dir).select(F.col("unit_id").alias("doc_id"), F.col("doc_id").alias("title"), "date_text", "text")
    triage = table(spark, sf_dir, "labels").select("doc_id", (F.col("quality") + F.col("toxic")).alias("relevance"))
    facts = docs.select("doc_id", F.posexplode(F.split("text", "\n")).alias("k", "fact"))
    return rollups.digest(triage, docs.drop("text"), facts)


@query(r"""
with w as (select doc_id, list_distinct(regexp_extract_all(lower(text), '[a-zà-ÿ0-9]+', 0)) as ws from documents),
s as (select doc_id, len(list_filter(['license', 'version', 'terms'], lambda x: list_contains(ws, x))) as n from w)
select doc_id, cast(case when n = 0 then 0 when n = 1 then 1 when n = 2 then 2 else 3 end as bigint) as relevance, cast(null as varchar) as error from s""")
def sweep_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sweep.sweep(table(spark, sf_dir, "documents"), "which license, version and terms?").select("doc_id", "relevance", "error")


@query("""
with l as (select doc_id, unnest(string_split(text, chr(10))) as quote, generate_subscripts(string_split(text, chr(10)), 1) - 1 as k from documents),
n as (select *, lower(trim(regexp_replace(quote, '\\s+', ' ', 'g'))) as q from l)
select unit_id, k, quote from (select doc_id as unit_id, cast(k as int) as k, quote, row_number() over (partition by doc_id, q order by k) as r from n) where r = 1""".replace("\\\\s", "\\s"))
def dedup_citations(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("unit_id"), F.posexplode(F.split("text", "\n")).alias("k", "quote"))
    return verify.first_citations(lines, "k")


@query()
def verify_fuzzy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark passages with a changed word, cited from the documents that hold the passage."""
    held = verify_exact(spark, sf_dir).join(table(spark, sf_dir, "benchmark"), "item_id")
    quote = F.regexp_replace("text", r"(\w+)(\W+\w+)$", "changed$2")
    cited = held.select("item_id", F.col("doc_id").alias("unit_id"), quote.alias("quote"))
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("unit_id"), "text", F.lit(False).alias("redacted"))
    return verify.verify_citations(cited, docs).select("item_id", "unit_id", "match", "ok", F.round("ratio", 6).alias("ratio"))


@query(r"""
select n_name as name, lower(n_name) as folded, trim(regexp_replace(lower(n_name), '[^a-z0-9]+', '_', 'g'), '_') as slug,
       upper(substr(list_aggregate(list_transform(list_filter(regexp_split_to_array(n_name, '\s+'), lambda w: w <> ''), lambda w: substr(w, 1, 1)), 'string_agg', ''), 1, 3)) as initials,
       cast(n_nationkey * 37 // 60 as varchar) || ':' || lpad(cast(n_nationkey * 37 % 60 as varchar), 2, '0') as clock
from nation""")
def name_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = F.col("n_name")
    return table(spark, sf_dir, "nation").select(
        name.alias("name"), X.fold(name).alias("folded"), X.slug(name).alias("slug"), X.initials(name).alias("initials"), X.clock(F.col("n_nationkey") * 37).alias("clock")
    )


def order_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("doc_id"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("date_text"), "o_orderdate")


@query("select o_orderkey as doc_id, strftime(o_orderdate, '%Y-%m-%d') as date_text from orders order by date_text desc, doc_id limit 6")
def latest_activity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rollups.latest_activity(order_documents(spark, sf_dir)).select("doc_id", "date_text")


@query("select cast(round((epoch_ms(max(o_orderdate)) - epoch_ms(min(o_orderdate))) / 2629800000.0) as int) as months from orders")
def span_months(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rollups.span_months(order_documents(spark, sf_dir), "o_orderdate")


@query("""
select user_id % 100 as answer_id, count(*) as calls, coalesce(sum(k), 0)::bigint as input, coalesce(sum(k // 2), 0)::bigint as cached,
       coalesce(sum(k + 1), 0)::bigint as output
from (select *, cast(json_extract(props, '$.k') as bigint) as k from events) group by 1""")
def bundle_usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.get_json_object("props", "$.k").cast("long")
    used = table(spark, sf_dir, "events").select((F.col("user_id") % 100).alias("answer_id"), k.alias("input"), F.floor(k / 2).alias("cached"), (k + 1).alias("output"))
    return rollups.bundle_usage(used)


@query(UNITS_SQL + """,
f as (select doc_id as from_doc, quality + 2 * toxic as relevance, doc_id % 7 as k, doc_id - doc_id % 2 as unit_id from labels),
one as (select *, row_number() over (partition by unit_id order by from_doc, k) as r from f where relevance >= 2)
select u.unit_id, u.doc_id, u.seq from one join units u on u.unit_id = one.unit_id where r = 1 and not u.redacted order by from_doc, k, u.unit_id limit 160""")
def evidence_cap(spark: SparkSession, sf_dir: str) -> DataFrame:
    facts = table(spark, sf_dir, "labels").select(
        "doc_id", (F.col("quality") + 2 * F.col("toxic")).alias("relevance"), (F.col("doc_id") % 7).alias("k"), (F.col("doc_id") - F.col("doc_id") % 2).alias("unit_id")
    )
    return sweep.kept_units(facts, units_of(spark, sf_dir)).select("unit_id", "doc_id", "seq")


@query(UNITS_SQL + """
select null::bigint as unit_id, null as doc_id, null::int as seq, null as excerpt, 'no hit in ' || count(*) || ' units' as note from units where not redacted""")
def search_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A word that no unit holds gives one row that says so."""
    return search.search_exact(units_of(spark, sf_dir), "Zzyzx+Qwvk")


@query(UNITS_SQL + """
select distinct doc_id from units where not redacted and (lang = 'fr' or regexp_matches(text, '(^|[^A-Za-z0-9_.@À-ɏ-])(?i:moron)([^A-Za-z0-9_@À-ɏ-]|$)'))""")
def documents_with(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that French wrote in or that hold a word."""
    return search.documents_with(units_of(spark, sf_dir).withColumn("speaker", F.col("lang")), "fr", erase.form_pattern(["moron"]))


@query("select conv_id || '.' || turn as unit_id from conversations where turn % 2 = 0 and role = 'user'")
def hits_of_customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    units = turns(spark, sf_dir).withColumn("speaker", F.col("role"))
    who = spark.createDataFrame([("user", "Buyer"), ("assistant", "Vendor")], "pid string, org string")
    return search.of_speakers(units.where("seq % 2 = 0").select("unit_id"), units, who, "Buyer")


def sample_archive(spark: SparkSession) -> corpus.Archive:
    files = spark.createDataFrame(sample.FILES, "path string, content string")
    return corpus.build(spark, files, spark.createDataFrame(sample.ROSTER, sample.ROSTER_SCHEMA))


def values(columns: str, rows: list[tuple]) -> str:
    """SQL for rows that were worked out by hand."""
    word = lambda v: "null" if v is None else str(v).lower() if isinstance(v, bool) else str(v) if isinstance(v, int) else "'" + v.replace("'", "''") + "'"
    return f"select * from (values {', '.join('(' + ', '.join(map(word, r)) + ')' for r in rows)}) t({columns})"


@query(values("unit_id, seq, speaker, locator, date_text, truncated, text", [
    ("E01.m03", 0, "mia_holt", "message 3 of 3, 2024-06-03", "2024-06-03T16:15", False, "Thank you for the 12 % discount."),
    ("E01.m02", 1, "tom_reed", "message 2 of 3, 2024-06-03", "2024-06-03T09:15", False, "Der Rabatt ist 12 %.\nMia, bitte antworten."),
    ("E01.m01", 2, "jörn_ås", "message 1 of 3, 2024-06-02", "2024-06-02T08:00", False, "Nils Lund said hello. Nils Lund will call."),
    ("T01.s0000", 0, "mia_holt", "0:05–0:12", "2024-05-02", False, "We need the forecast for about 40% of the articles."),
    ("T01.s0001", 1, None, "at 1:02", "2024-05-02", False, "Could you repeat that?"),
    ("T01.s0002", 2, "jörn_ås", "at 1:10", "2024-05-02", True, "The delay was 30 days, I think..."),
    ("T01.s0003", 3, "tom_reed", "at 5:01", "2024-05-02", False, "That is all."),
    ("T02.s0000", 0, None, "lines 3–5", "2024-06-01", False, "Is the price 5m or six million?"),
    ("T02.s0001", 1, None, "line 6", "2024-06-01", False, "Ask Tom Reed."),
]))
def sample_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Meetings with and without times and a thread in three languages, parsed, stitched and resolved to people."""
    return sample_archive(spark).units.select("unit_id", "seq", "speaker", "locator", "date_text", "truncated", "text")


@query(values("doc_id, kind, title, internal, n_units, short, declared, parsed", [
    ("emails/01_offer", "email", "Offer", False, 3, "E01", 3, 3), ("transcripts/01_kick-off", "transcript", "Kick-off", False, 4, "T01", None, None),
    ("transcripts/02_INTERNAL-review", "transcript", "Review", True, 2, "T02", None, None),
]))
def sample_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sample_archive(spark).documents.select(
        "doc_id", "kind", "title", "internal", "n_units", F.col("meta.short").alias("short"), F.col("meta.declared_messages").alias("declared"), F.col("meta.parsed_messages").alias("parsed")
    )
