"""Registered queries against their SQL on tables that are made for a case."""

from __future__ import annotations

import duckdb
import pytest

from affidavit.plans import archive_queries  # noqa: F401
from affidavit.plans import queries as A

from test_queries import rows_of


def same(spark, folder, name, **tables):
    """The rows of a query, which are those of its SQL over the same tables."""
    con = duckdb.connect()
    for t, df in tables.items():
        df.write.parquet(f"{folder}/{t}.parquet")
        con.sql(f"create view {t} as select * from '{folder}/{t}.parquet/*.parquet'")
    df, want = A.Q[name](spark, str(folder)), con.sql(A.SQL[name])
    got = df.collect()
    assert sorted(df.columns) == sorted(want.columns)
    assert rows_of(df.columns, got) == rows_of(want.columns, want.fetchall())
    return got


@pytest.mark.parametrize("name", ["mail_units", "mail_documents", "stored_archive"])
def test_a_thread_goes_on_over_midnight(spark, tmp_path, name):
    roles = ("user", "assistant", "system")
    rows = [(7, k, roles[k % 3], "Something is said here.") for k in range(300)] + [(8, k, roles[k % 2], "A short one.") for k in range(3)]
    rows += [(9, k, "user", "Weeks later.") for k in (0, 6000, 6001, 6002)]
    got = same(spark, tmp_path, name, conversations=spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    assert name != "mail_units" or {r.date_text[:10] for r in got} == {"2025-03-03", "2025-03-04", "2025-04-01"}


DOCS, LABELS = "doc_id long, text string, lang string, source string, n_chars long", "doc_id long, quality long, toxic long"


@pytest.mark.parametrize("text, toxic, verdict", [
    ("Die Größe der Straße hieß Fuß\nund Maß, aber ŉ ﬁ stehen weiter hinten im Text dieses Falles", 0, "VERIFIED"),
    ("This one is withheld but its words are asked for alone", 1, "VERIFIED"), ("Too short", 0, "FAILED"), (None, 0, "FAILED"),
])
def test_a_quote_in_capitals(spark, tmp_path, text, toxic, verdict):
    docs = spark.createDataFrame([(8, text, "de", "src1", 0), (18, "Another text", "en", "src2", 0)], DOCS)
    labels = spark.createDataFrame([(8, 1, toxic)], LABELS)
    assert [r.verdict for r in same(spark, tmp_path, "verify_quote", documents=docs, labels=labels)] == [verdict]


def test_topics_are_told_as_tokens_are(spark):
    from affidavit.functions import text as X

    texts = ["the tion", "tions", "station", "tion.", ".tion", "_-%tion, so", "a.tion", "é.tion", "étion", "TION", "ÉTÉ", "été.", "x-tion", "1tion", "tion%", "", None, "a b", "ing…", "…ing", "\ning\n", "5%", "C++", "a.b", "axb", "(a.b)"]
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    for topic in ("Tion ing erst", "été", "the a", "", "5% a.b", "tion."):
        want = X.F.arrays_overlap(X.tokenize(X.F.col("text")), X.tokenize(X.F.lit(topic)))
        rows = df.select("text", X.F.coalesce(want, X.F.lit(False)), X.F.coalesce(X.shares_token(X.F.col("text"), topic), X.F.lit(False))).collect()
        assert [r for r in rows if r[1] != r[2]] == []


def test_figures_are_found_once_for_a_sorted_list(spark, tmp_path):
    import re

    from affidavit.operators import search

    units = spark.createDataFrame([(k, "d", k, f"{k} days and {k} %", None, False) for k in range(200)], "unit_id long, doc_id string, seq int, text string, date_text string, redacted boolean")
    units.write.parquet(f"{tmp_path}/units")
    lines = search.list_figures(spark.read.parquet(f"{tmp_path}/units"), None, None)
    assert [r.unit_id for r in lines.collect()] == [k for k in range(200) for _ in range(2)]
    plan = lines._jdf.queryExecution().executedPlan().toString()
    above = plan[: plan.index("Generate")]  # a plan is printed from its root on
    assert "rangepartitioning" in above and re.search("hashpartitioning|Exchange hash", above)


def test_a_repeated_citation_meets_its_text_once(spark, monkeypatch):
    from affidavit.operators import verify

    seen, check = [], verify.verify_citations

    def counted(citations, *more):
        seen.append(citations)
        return check(citations, *more)

    monkeypatch.setattr(verify, "verify_citations", counted)
    text = "As said, how long the shop was open on that day, as it seems."
    kinds = "unit_id string, doc_id string, seq int, text string, date_text string, redacted boolean, truncated boolean"
    units = spark.createDataFrame([("u1", "d", 0, text, None, False, False)], kinds)
    docs = spark.createDataFrame([("d", "Title", False)], "doc_id string, title string, internal boolean")
    near, far = "how long the shop was open on this day", "qqqq zzzz xxxx jjjj vvvv"
    claims = [("c", "current", None, [("u1", q) for q in (near, near, " HOW long the shop was open on this day", far, far)])]
    kinds = "answer_id long, claims array<struct<statement:string,status:string,superseded_by:string,citations:array<struct<unit_id:string,quote:string>>>>, gaps array<struct<nearest_evidence:string>>, abstentions array<struct<unit_id:string>>"
    found = verify.verify_answers(spark.createDataFrame([(1, claims, [], [])], kinds), units, docs)
    row = found["summary"].first()
    assert (row.total, row.verified, row.exact, row.approximate, row.failed, row.ok) == (2, 1, 0, 1, ["u1"], False)
    assert found["citations"].count() == 2 and min(s.count() for s in seen) == 2
    ratios = {r.quote: r.ratio for r in found["citations"].collect()}
    assert ratios == {q: verify.window_ratio(q, text.lower()) for q in (near, far)}


def test_far_quotes_are_not_compared_letter_by_letter(monkeypatch):
    import difflib

    from affidavit.operators.verify import CLOSE, window_ratio

    made, whole = [], difflib.SequenceMatcher.ratio
    monkeypatch.setattr(difflib.SequenceMatcher, "ratio", lambda self: made.append(1) or whole(self))
    text = "some prose of a few words that goes on and on " * 50
    assert window_ratio("qqqq zzzz xxxx jjjj vvvv", text, CLOSE) < CLOSE and not made
    assert window_ratio("of a few words that goes of", text, CLOSE) == window_ratio("of a few words that goes of", text)


def test_signatures_are_cut_without_a_second_copy_of_a_batch():
    import tracemalloc

    import pyarrow as pa

    from affidavit.operators import threads

    lines = pa.array([[f"line {k} of message {i} that says something" for k in range(20)] + ["Best regards,", "Ursula Quist"] for i in range(3000)])
    names = pa.array([[False] * 22] * 3000)
    tracemalloc.start()
    out = threads._cut(()).func(lines, names)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert out[7].as_py().endswith("line 19 of message 7 that says something") and peak < 15e6
