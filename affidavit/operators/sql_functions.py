"""The archive's lookups for SQL: views of its tables and functions with parameters, all planned by Catalyst.

    select * from grep_units('forecast')
    select * from unit_window('T01.s0001', 3)
    select * from figures_near('discount')
    select * from units_between('2024-05-01', '2024-05-31')
    select * from units_of('Mia Holt')
    select * from rank_units('forecast error', 10)     -- by a stored index, if one is given

Withheld units are in no result; patterns are regular expressions and ignore case.
An unknown unit, name or pattern gives no row, and a null argument matches nothing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import TOKEN_PATTERN, fold, token_letters
from .index import TextIndex
from .search import find_figures, live

_UNIT = "unit_id STRING, doc_id STRING, seq INT, date_text STRING, text STRING"
FUNCTIONS = {
    "grep_units(pattern STRING)": (_UNIT, "SELECT unit_id, doc_id, seq, date_text, text FROM archive_units WHERE text RLIKE concat('(?iu)', pattern)"),
    "unit_window(unit STRING, width INT)": (
        _UNIT + ", offset INT",
        "SELECT n.unit_id, n.doc_id, n.seq, n.date_text, n.text, n.place - a.place FROM archive_units n JOIN archive_units a ON n.doc_id = a.doc_id "
        "WHERE a.unit_id = unit AND n.place BETWEEN a.place - width AND a.place + width",
    ),
    "figures_near(pattern STRING)": (
        "unit_id STRING, date_text STRING, figure STRING, context STRING",
        "SELECT unit_id, date_text, figure, context FROM archive_figures WHERE context RLIKE concat('(?iu)', pattern)",
    ),
    "units_between(since STRING, until STRING)": (
        _UNIT,
        "SELECT unit_id, doc_id, seq, date_text, text FROM archive_units WHERE substring(date_text, 1, 10) BETWEEN substring(since, 1, 10) AND substring(until, 1, 10)",
    ),
    "units_of(name STRING)": (
        _UNIT,
        "SELECT u.unit_id, u.doc_id, u.seq, u.date_text, u.text FROM archive_units u LEFT SEMI JOIN archive_names n "
        "ON u.speaker = n.pid AND (n.form = lower(name) OR n.folded = lower(name))",
    ),
}


def ranking(index: TextIndex) -> tuple[str, str]:
    """Columns and body of rank_units: BM25 over the index's views; the join on buckets prunes their folders."""
    m = index.meta
    if m.trimmed:
        raise ValueError("this index has trimmed tokens, which the SQL function doesn't make")
    capitals, small = token_letters()
    tokens = f"array_remove(regexp_extract_all(translate(query, '{capitals}', '{small}'), r'{TOKEN_PATTERN}', 1), '')"
    body = f"""
        SELECT unit_id, doc_id, seq, score FROM (
            SELECT u.unit_id, u.doc_id, u.seq, h.score, row_number() OVER (ORDER BY h.score DESC, u.doc_id, u.seq) AS place_of FROM (
                SELECT x.places AS place, round(sum(w * x.counts * {m.k1 + 1} / (x.counts + {m.k1} * (1 - {m.b} + {m.b} * x.lengths / {m.avgdl or 1.0}))), 4) AS score FROM (
                    SELECT q.times * ln(1 + ({m.n} - t.df + 0.5D) / (t.df + 0.5D)) AS w, explode(arrays_zip(p.places, p.counts, p.lengths)) AS x
                    FROM (SELECT token, pmod(crc32(CAST(token AS BINARY)), {m.buckets}) AS bucket, count(*) AS times FROM (SELECT explode({tokens}) AS token) GROUP BY token) q
                    JOIN index_terms t ON t.bucket = q.bucket AND t.token = q.token JOIN index_postings p ON p.bucket = q.bucket AND p.token = q.token
                ) GROUP BY x.places
            ) h JOIN index_units u ON u.place = h.place WHERE h.score > 0
        ) WHERE place_of <= most ORDER BY score DESC, doc_id, seq"""
    return "unit_id STRING, doc_id STRING, seq INT, score DOUBLE", body


def register(units: DataFrame, documents: DataFrame, people: DataFrame, index: TextIndex | None = None) -> list[str]:
    """Names of the temporary functions, made in the session of ``units`` beside the views archive_units, _documents, _people, _names and _figures."""
    spark = units.sparkSession
    shown = live(units)
    place = F.expr("cast(row_number() OVER (PARTITION BY doc_id ORDER BY seq) AS INT)")
    shown.withColumn("place", place).createOrReplaceTempView("archive_units")
    documents.createOrReplaceTempView("archive_documents")
    people.createOrReplaceTempView("archive_people")
    forms = people.select("pid", F.explode(F.array_distinct(F.concat(F.array("display"), "aliases", "emails"))).alias("form"))
    forms.select("pid", F.lower("form").alias("form"), fold(F.col("form")).alias("folded")).createOrReplaceTempView("archive_names")
    find_figures(units).createOrReplaceTempView("archive_figures")
    functions = dict(FUNCTIONS)
    if index:
        for name in ("units", "terms", "postings"):
            index.table(name).createOrReplaceTempView(f"index_{name}")
        functions["rank_units(query STRING, most INT)"] = ranking(index)
    for head, (columns, body) in functions.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {head} RETURNS TABLE ({columns}) RETURN {body}")
    return [head.partition("(")[0] for head in functions]
