"""The stored index against BM25 over the texts, and what a query reads."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from affidavit.functions import text as X
from affidavit.operators import index, search
from affidavit.operators.index import build, load, load_or_build

UNITS = "unit_id string, doc_id string, seq int, text string, date_text string, redacted boolean"


def made(spark, n=600, seed=1):
    """Units of words with very different frequencies; one rare word is often in a few units of the end."""
    rng = random.Random(seed)
    words = [f"w{k}" for k in range(200)]
    rows = []
    for k in range(n):
        text = " ".join(rng.choice(words[: rng.choice([3, 20, 200])]) for _ in range(rng.randint(0, 40)))
        if k % 97 == 5:
            text += " Rare" * (k // 97 + 1)
        rows.append((f"u{k}", f"d{k % 7}", k, text, f"2024-01-{k % 28 + 1:02d}", k % 50 == 3))
    rows += [("u1", "d9", 1, "rare w1", None, False), ("null", "d9", 2, None, None, False), (None, "d9", 3, "", None, None)]
    return spark.createDataFrame(rows, UNITS)


def listed(df):
    return [(r.unit_id, r.doc_id, r.seq, r.score) for r in df.collect()]


@pytest.mark.parametrize("span", [8, 512])
def test_rows_are_those_of_the_texts(spark, tmp_path, monkeypatch, span):
    monkeypatch.setattr(index, "SPAN", span)
    monkeypatch.setattr(index, "FIRST", 2)
    units = made(spark).repartition(3, "doc_id").cache()
    found = build(units, f"{tmp_path}/index", buckets=8)
    for query in ("rare", "w0 w1, w0 rare nowhere", "the and nowhere", ""):
        for k in (3, 40, None):
            want = listed(search.bm25(units, query, k))
            got = listed(found.search(query, k))
            assert (got == want) if k else (sorted(map(repr, got)) == sorted(map(repr, want))), (query, k)
    terms = {r.token: (r.df, r.cf) for r in found.terms().collect()}
    posted = search.postings(units.where("unit_id is not null")).groupBy("token").agg(F.count("*").alias("df"), F.sum("tf").alias("cf"))
    assert terms == {r.token: (r.df, r.cf) for r in posted.collect()}
    assert found.search("rare", 0).collect() == []


def test_blocks_below_the_best_are_skipped(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(index, "SPAN", 8)
    monkeypatch.setattr(index, "FIRST", 8)
    rows = [(f"u{k:04d}", "d", k, "apple " * (9 if 400 <= k < 404 else 1) + "pear " * (k % 30 + 1), None, False) for k in range(1000)]
    units = spark.createDataFrame(rows, UNITS)
    found = build(units, f"{tmp_path}/index")
    all_rows = found.weighted("apple")
    kept, least = found.reaching(all_rows, 3, 1e-4)
    blocks = {r.block for r in kept.collect()}
    assert all_rows.count() >= 125 and 1 <= len(blocks) <= 4 and least > 0  # four units stand out
    assert listed(found.search("apple", 3)) == listed(search.bm25(units, "apple", 3))


def test_a_query_reads_its_buckets_and_no_text(spark, tmp_path):
    units = made(spark)
    found = build(units, f"{tmp_path}/index", buckets=64)
    plan = found.search("rare w7", None)._jdf.queryExecution().toString()
    assert "text" not in plan.split("== Physical Plan ==")[1] and "PartitionFilters: [bucket" in plan
    files = found.of(found.table("postings"), {"rare": 1.0}).inputFiles()
    rows = found.of(found.table("postings"), {"rare": 1.0})
    read = {r[0].rsplit("/", 2)[1] for r in rows.select("_metadata.file_path").distinct().collect()}
    assert len(read) == 1 and len(files) > 1


def test_the_index_is_kept_until_its_source_changes(spark, tmp_path):
    at = f"{tmp_path}/units"
    made(spark, 50).where("doc_id <> 'd9'").write.parquet(at)
    units = spark.read.parquet(at)
    first = load_or_build(units, f"{tmp_path}/index", units)
    again = load_or_build(units, f"{tmp_path}/index", units)
    stamp = lambda x: sorted(x.table("units").inputFiles())
    files = stamp(first)
    assert again.meta == first.meta == load(spark, f"{tmp_path}/index").meta and stamp(again) == files
    made(spark, 20, 2).withColumn("unit_id", F.concat(F.lit("more"), "unit_id", "doc_id")).where("unit_id is not null").write.mode("append").parquet(at)
    units = spark.read.parquet(at)
    changed = load_or_build(units, f"{tmp_path}/index", units)
    assert changed.meta.mark != first.meta.mark and stamp(changed) != files
    assert sorted(map(repr, listed(changed.search("w1", None)))) == sorted(map(repr, listed(search.bm25(units, "w1", None))))


def test_an_empty_table(spark, tmp_path):
    found = build(made(spark).limit(0), f"{tmp_path}/index")
    assert found.search("rare").collect() == [] and found.terms().collect() == []


def test_timeline_and_snippets_by_the_index(spark, tmp_path):
    units = made(spark).where("unit_id is not null and doc_id <> 'd9'")
    found = build(units, f"{tmp_path}/index")
    for options in ({}, {"since": "2024-01-05", "until": "2024-01-20"}, {"pool": None, "show": None}):
        assert sorted(search.timeline(units, "rare w1", index=found, **options).collect()) == sorted(search.timeline(units, "rare w1", **options).collect())
    assert search.search_text(units, "rare w9", 5, found).collect() == search.search_text(units, "rare w9", 5).collect()


TEXTS = ["The A.the _the the. x y1 ÄÖ ×÷× ß Ünïcode THE-END it's 12.5%", "i I of OF Offset there The", "", None, "No do doing don't a_b -a .b %c", "İstanbul Kelvin K ǅ Œuvre ÿŸ"]


def test_tokens_are_cut_alike_in_both_languages(spark):
    rng = random.Random(5)
    texts = TEXTS + ["".join(rng.choice("thea ofTHE.-_%×÷ÀßÿŸ1 \n") for _ in range(60)) for _ in range(300)]
    df = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k int, t string")
    for trimmed in (False, True):
        got = {r.k: r.x for r in df.select("k", X.tokenize(F.col("t"), trimmed).alias("x")).collect()}
        assert got == {k: None if t is None else X.tokens_of(t, trimmed) for k, t in enumerate(texts)}
    plain = lambda t: [x.lower() for x in X._TOKEN.findall(t) if len(x) > 1 and x.lower() not in X.STOP_WORDS]
    assert all(X.tokens_of(t) == plain(t) for t in texts if t is not None)


def test_figures_of_a_text_that_is_full_of_them(spark):
    text = " and ".join(f"{k % 100} % of {k}k" for k in range(3000))
    found = spark.createDataFrame([(text,), ("none",), (None,)], "t string").select(F.explode(X.figures(F.col("t"))).alias("f")).select("f.*").collect()
    assert len(found) == 6000 and all(text[r.start : r.stop].strip() == r.figure for r in found)


def test_ranking_from_sql(spark, tmp_path):
    from affidavit.operators import sql_functions

    units = made(spark, 120).where("unit_id is not null").withColumns({"speaker": F.lit("p"), "ts": F.lit(None).cast("timestamp_ntz")})
    people = spark.createDataFrame([("p", "P Q", ["P"], ["p@x.example"])], "pid string, display string, aliases array<string>, emails array<string>")
    found = build(units, f"{tmp_path}/index")
    assert "rank_units" in sql_functions.register(units, units.select("doc_id").distinct(), people, found)
    for query, k in (("Rare w1", 5), ("w0 w0 the nowhere", 12), ("nowhere", 3)):
        assert listed(spark.sql(f"select * from rank_units('{query}', {k})")) == listed(found.search(query, k))


def test_a_batch_of_texts_is_never_counted_whole():
    import random
    import tracemalloc

    import pyarrow as pa

    from affidavit.operators.index import counted

    rng = random.Random(5)
    texts = [" ".join(f"w{rng.randrange(10**9)}" for _ in range(300)) if k % 7 else None for k in range(4000)]
    keys = pa.array(range(len(texts)))
    names = ["unit_id", "doc_id", "seq", "tokens", "counts", "length"]
    tracemalloc.start()
    n = 0
    for out in counted(iter([pa.RecordBatch.from_arrays([keys, keys, keys, pa.array(texts)], [*names[:3], "text"])]), names):
        for row in out.slice(0, 1).to_pylist():
            text = texts[row["unit_id"]]
            assert row["tokens"] == (text or "").split() and row["length"] == (text and 300)
        n += out.num_rows
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert n == len(texts) and peak < 40e6  # at once it is above 150 MB
