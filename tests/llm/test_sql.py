"""Registered queries of this subpackage against their SQL in DuckDB."""

from __future__ import annotations

import duckdb
import pytest

from affidavit.llm import queries as Q

SF = "/root/testdata/sf0.001"


def canon(rows, columns):
    at = sorted(range(len(columns)), key=lambda k: columns[k])
    return sorted(repr(tuple(round(r[k], 9) if isinstance(r[k], float) else r[k] for k in at)) for r in rows)


@pytest.mark.parametrize("name", sorted(Q.oracle_sql()))
def test_query(spark, name):
    con = duckdb.connect()
    for t in ("documents", "pages", "embeddings"):
        con.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    df, want = Q.queries()[name](spark, SF), con.sql(Q.oracle_sql()[name])
    assert sorted(df.columns) == sorted(want.columns)
    assert canon(df.collect(), df.columns) == canon(want.fetchall(), want.columns)


def test_op1_where_lines_and_documents_go(spark, tmp_path):
    common, word = "Accept all cookies of this fine site", lambda k, i: f"w{k}x{i}"
    rows = [(k, common + "\n" + " ".join(word(k, i) for i in range(60)), "en", "s", 0) for k in range(60)]
    rows += [(100, "\n".join([common] * 3 + [" ".join(word(100, i) for i in range(15))] + [f"{common}"] * 3), "en", "s", 0)]
    rows += [(101, "\n".join([" ".join(f"f{i}" for i in range(40)), " ".join(word(101, i) for i in range(30))]), "en", "s", 0)]
    rows += [(200 + k, " ".join(f"f{i}" for i in range(40)) + "\n" + " ".join(word(200 + k, i) for i in range(60)), "en", "s", 0) for k in range(30)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    large = [(1000 + k, ("Share this on our pages\n" if k % 20 == 0 else "") + " ".join(word(1000 + k, i) for i in range(55)), "en", "large", 0) for k in range(1500)]
    docs = docs.union(spark.createDataFrame(large, docs.schema))
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.sql(f"create view documents as select * from '{tmp_path}/documents.parquet/*.parquet'")
    df, want = Q.queries()["op1_quality_rules"](spark, str(tmp_path)), con.sql(Q.oracle_sql()["op1_quality_rules"])
    got = df.collect()
    assert canon(got, df.columns) == canon(want.fetchall(), want.columns)
    assert all(r.n_removed_lines == (r.doc_id % 20 == 0) for r in got if r.doc_id >= 1000)  # a line in 5 % of a large host
    assert any(r.n_removed_lines for r in got) and any(not r.kept and not r.base_failed for r in got)
