"""Registered queries against their SQL in DuckDB."""

from __future__ import annotations

import duckdb
import pytest
from pyspark.sql import functions as F

from affidavit.plans import archive_queries  # noqa: F401
from affidavit.plans import queries as A

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def canon(v):
    if isinstance(v, (list, tuple)):
        return tuple(map(canon, v))
    return round(v, 9) if isinstance(v, float) else v


def rows_of(columns, rows):
    at = sorted(range(len(columns)), key=lambda k: columns[k])
    return sorted(repr(tuple(canon(r[k]) for k in at)) for r in rows)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


def compare(spark, duck, f, sql):
    df, want = f(spark, SF), duck.sql(sql)
    assert sorted(df.columns) == sorted(want.columns)
    assert rows_of(df.columns, df.collect()) == rows_of(want.columns, want.fetchall())


@pytest.mark.parametrize("name", sorted(A.SQL))
def test_archive_query(spark, duck, name):
    compare(spark, duck, A.Q[name], A.SQL[name])


def test_window_ratio_is_the_best_of_all_windows():
    import difflib
    import random

    from affidavit.operators.verify import window_ratio

    rng = random.Random(3)
    for _ in range(200):
        hay = "".join(rng.choice("abcde ") for _ in range(rng.randint(0, 80)))
        needle = "".join(rng.choice("abcde ") for _ in range(rng.randint(0, 30)))
        if hay and rng.random() < 0.5:
            k = rng.randrange(len(hay))
            needle = hay[k : k + 20]
        n = len(needle)
        parts = [hay] if n >= len(hay) else [hay[k : k + n] for k in range(0, len(hay) - n + 1, max(1, n // 4))]
        want = max((difflib.SequenceMatcher(None, needle, p).ratio() for p in parts), default=0.0) if needle and hay else 0.0
        assert window_ratio(needle, hay) == want


def test_erased_forms_fit_whatever_the_marks(spark):

    from affidavit.operators.erase import form_pattern, redact

    texts = ["Šimek called", "Jose\u0301 Ruiz and José RUIZ", "Strauss, Strauß", "Simeks stays, x.Simek too", "Łukasz Żak", "Bæk"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    pattern = form_pattern(["Simek", "Jose Ruiz", "Strauß", "Lukasz Zak", "Baek"])
    got = [r[0] for r in df.select(redact(F.col("t"), pattern)).collect()]
    assert got == ["[erased] called", "[erased] and [erased]", "[erased], [erased]", "Simeks stays, x.Simek too", "[erased]", "[erased]"]


def test_fuzzy_citations(spark, duck):
    import difflib
    import re

    texts = dict(duck.sql("select doc_id, text from documents").fetchall())
    norm = lambda t: re.sub(r"\s+", " ", t).strip().lower()
    want = set()
    for item, quote in duck.sql("select item_id, text from benchmark").fetchall():
        q = norm(re.sub(r"(\w+)(\W+\w+)$", r"changed\2", quote))
        for doc, text in texts.items():
            t = norm(text or "")
            if norm(quote) in t:
                parts = [t] if len(q) >= len(t) else [t[k : k + len(q)] for k in range(0, len(t) - len(q) + 1, max(1, len(q) // 4))]
                ratio = 1.0 if q in t else max(difflib.SequenceMatcher(None, q, p).ratio() for p in parts)
                kind = "exact" if q in t else "approximate" if ratio >= 0.9 else "none"
                want.add((item, doc, kind, kind != "none", round(ratio, 6)))
    assert want and {tuple(r) for r in A.Q["verify_fuzzy"](spark, SF).collect()} == want


def test_places_do_not_depend_on_the_stretches(spark, monkeypatch):
    import random

    from affidavit.operators import search

    rng = random.Random(5)
    seqs = rng.sample(range(-40, 400), 300)
    rows = [("a" if k < 200 else "b" if k < 299 else None, s, rng.choice([None, "2024-01-02", "2024-01-01T10:00", "2023"])) for k, s in enumerate(seqs)]
    units = spark.createDataFrame(rows, "doc_id string, seq int, date_text string")
    monkeypatch.setattr(search, "SPAN", 16)
    for dated in (False, True):
        got = {(r.doc_id, r.seq): r.place for r in search.places(units, dated=dated).collect()}
        want = {}
        for d in ("a", "b", None):
            mine = sorted((r for r in rows if r[0] == d), key=lambda r: (r[2] is None, r[2] or "", r[1]) if dated else r[1])
            want |= {(d, r[1]): k for k, r in enumerate(mine, 1)}
        assert got == want


def stitched_in_order(rows, max_gap=120, max_ahead=8):
    """(doc_id, idx, segment, member) by walking through each transcript."""
    docs = {}
    for r in rows:
        docs.setdefault(r[0], []).append(r)
    out = []
    for d, lines in docs.items():
        lines.sort(key=lambda r: r[1])
        segment = expected = None
        for k, (_, i, speaker, t, text) in enumerate(lines):
            if member := expected in (None, i):
                segment = i if expected is None else segment
                expected = None
                if text and not (text.rstrip()[-1:] in ".!?" and not text.rstrip().endswith("...")):
                    for other in lines[k + 1 : k + 1 + max_ahead]:
                        if None not in (t, other[3]) and other[3] - t > max_gap:
                            break
                        if other[2] == speaker and speaker is not None and other[4] not in (None, "yeah", "yeah."):
                            expected = other[1]
                            break
            out.append((d, i, segment, member))
    return sorted(map(repr, out))


def test_stitching_does_not_depend_on_the_chunks(spark, monkeypatch):
    import random

    from affidavit.operators import stitching

    rng = random.Random(7)
    said = ["We think that", "so it goes on", "Done.", "yeah", "wait", "It ends...", None, ""]
    sizes = (("open", 300), ("mixed", 200), ("short", 5), (None, 90))
    rows = [(d, k, rng.choice(["A", "B", "B", None] if d == "mixed" else "AB"), rng.choice([k * 20, None, k * 40]), rng.choice(said[: 3 if d == "open" else 8])) for d, n in sizes for k in range(n)]
    rows += [("never", k, "A", k, "and so") for k in range(90)]  # no place to cut at
    rows += [("relay", k, "AB"[k % 2], 0, "and so") for k in range(120)]  # in every other place
    lines = spark.createDataFrame(rows, "doc_id string, idx int, speaker_raw string, t int, text string").withColumn("line", F.lit("more"))
    want = stitched_in_order(rows)
    for size, fan in ((4096, 4096), (9, 2), (16, 3)):
        monkeypatch.setattr(stitching, "CHUNK", size)
        monkeypatch.setattr(stitching, "FAN", fan)
        got = stitching.stitch(lines.repartition(3))
        assert got.columns == [*lines.columns, "segment", "member"]
        assert sorted(map(repr, map(tuple, got.select("doc_id", "idx", "segment", "member").collect()))) == want, size
    assert stitching.stitch(lines.limit(0)).collect() == []


def test_an_endless_statement_runs_in_many_tasks(spark, monkeypatch):
    from affidavit.operators import stitching

    lines = spark.range(100_000).select(
        F.lit("d").alias("doc_id"), F.col("id").cast("int").alias("idx"), F.lit("A").alias("speaker_raw"), F.lit(0).alias("t"), F.lit("and so").alias("text")
    )
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # so small a table would end in one task
    got = stitching.stitch(lines)
    assert got.where("segment <> 0 or not member").count() == 0 and got.count() == 100_000
    rows = got.groupBy(F.spark_partition_id()).count().collect()
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len(rows) > 1 and max(r["count"] for r in rows) < 60_000


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).columns == ["unit_id", "doc_id", "seq"]
    assert set(A.Q) <= set(e.queries()) and set(e.oracle_sql()) <= set(e.queries())


def test_names_are_taken_one_after_the_other(spark):
    import random

    from affidavit.operators import people

    rng = random.Random(4)
    words = ["Anna", "Berg", "Carla", "Dorn", "Emil", "Falk", "Gerd", "Holm", "Ines", "Jung", "Karl", "Lund"]
    pairs = [f"{rng.choice(words)} {rng.choice(words)}" for _ in range(400)]
    texts = [", ".join(pairs[k : k + 5]) for k in range(0, 400, 5)]
    known = spark.createDataFrame([("x", "Karl X")], "pid string, display string")
    df = spark.createDataFrame(list(enumerate(texts)), "k int, text string").repartition(4)
    counts = {}
    for p in pairs:
        counts[p] = counts.get(p, 0) + 1

    def one_by_one(names):
        taken, out = {"karl", "x"}, {}
        for name in names:
            own = set(name.lower().split())
            if counts[name] >= 2 and not own & taken:
                taken |= own
                out[name] = counts[name]
        return out

    got = {r.name: r.n for r in people.discover_names(df, known, order="k").collect()}
    assert got == one_by_one(counts) and len(got) >= 4
    got = {r.name: r.n for r in people.discover_names(df, known).collect()}
    assert got == one_by_one(sorted(counts, key=lambda x: (-counts[x], x)))


def test_fingerprints_of_keys_far_apart(spark):
    from affidavit.sources import corpus

    rows = [("a", k * 10**13, f"t{k}") for k in range(-2, 3)] + [("b", 7, "x"), ("b", 8, None), (None, -1, "y"), (None, 0, "z")]
    df = spark.createDataFrame(rows, "by string, k long, t string")
    first = {r["by"]: r.fingerprint for r in corpus.range_fingerprints(df, "by", "k", "t").collect()}
    again = {r["by"]: r.fingerprint for r in corpus.range_fingerprints(df.repartition(3), "by", "k", "t").collect()}
    assert len(first) == 3 and first == again and corpus.range_fingerprints(df, "by", "k", "t").count() == 3
    other = df.where("t is null or t <> 't1'")
    assert corpus.range_fingerprints(other, "by", "k", "t").where("by = 'a'").first().fingerprint != first["a"]


def test_stock_phrases_of_a_corpus_are_its_callers(spark):
    from affidavit.operators import people, threads

    body = "From: A B\nSent: Monday, March 3, 2025 9:05 AM\nTo: C\n\nBuy more today.\nThe price is 5.\nBuy more today.\n"
    files = spark.createDataFrame([("emails/01_x.txt", body)], "path string, content string")
    nobody = people.with_aliases(spark.createDataFrame([], "pid string, display string, org string, role string, emails array<string>, mention_only boolean"))
    text = lambda *phrases: threads.thread_units(files, nobody, people.alias_table(nobody), phrases).first().text
    assert text() == "Buy more today.\nThe price is 5.\nBuy more today." and text(r"Buy more.*") == "The price is 5."
