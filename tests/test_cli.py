from __future__ import annotations

import json
import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).parent))
from archive import FILES, ROSTER, ROSTER_SCHEMA  # noqa: E402

from affidavit import cli  # noqa: E402
from affidavit.config import Config, settings  # noqa: E402
from affidavit.operators import sql_functions  # noqa: E402
from affidavit.sources import corpus  # noqa: E402


@pytest.fixture(scope="module")
def at(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("cli")
    for path, content in FILES:
        (folder / "texts" / path).parent.mkdir(parents=True, exist_ok=True)
        (folder / "texts" / path).write_text(content, encoding="utf-8")
    spark.createDataFrame(ROSTER, ROSTER_SCHEMA).write.json(str(folder / "roster"))
    config = Config(str(folder / "texts"), str(folder / "archive"), str(folder / "roster"))
    assert cli.main(["build"], spark, config) == 0
    return config


def said(capsys) -> list[dict]:
    return [json.loads(line) for line in capsys.readouterr().out.splitlines()]


def test_settings(tmp_path):
    (tmp_path / ".env").write_text("# limits\nAFFIDAVIT_HITS = 7\nAFFIDAVIT_CORPUS='texts'\nAFFIDAVIT_ROSTER=\n\nOTHER=1\n")
    got = settings(str(tmp_path / ".env"), {"AFFIDAVIT_EVIDENCE": "3", "AFFIDAVIT_ARCHIVE": "/abs/a"})
    assert (got.hits, got.evidence, got.roster, got.archive, got.corpus) == (7, 3, None, "/abs/a", str(tmp_path / "texts"))
    assert settings(str(tmp_path / "none"), {}).hits == Config().hits
    with pytest.raises(ValueError):
        settings(None, {"AFFIDAVIT_HITS": "many"})


def test_lookups(spark, at, capsys):
    capsys.readouterr()
    assert cli.main(["stats"], spark, at) == 0
    assert said(capsys)[0]["documents"] == len(FILES)
    assert cli.main(["grep", "about 40%"], spark, at) == 0
    assert [r["unit_id"] for r in said(capsys)] == ["T01.s0000"]
    assert cli.main(["grep", "zzz"], spark, at) == 0
    assert said(capsys)[0]["note"].startswith("no hit in ")
    assert cli.main(["figures"], spark, at) == 0
    assert any("40%" in r["line"] for r in said(capsys))
    assert cli.main(["who", "Holt"], spark, at) == 0
    assert [r["pid"] for r in said(capsys)] == ["mia_holt"]
    assert cli.main(["timeline", "forecast articles", "--until", "2024-05-31"], spark, at) == 0
    assert [r["unit_id"] for r in said(capsys)] == ["T01.s0000"]


def test_erase(spark, at, tmp_path, capsys):
    capsys.readouterr()
    new = str(tmp_path / "without")
    assert cli.main(["erase", "Mia Holt", "--to", new], spark, at) == 0
    receipt = said(capsys)[0]
    assert receipt["units_authored"] >= 1 and receipt["person_removed"]
    (tmp_path / "receipt.json").write_text(json.dumps(receipt))
    look = ["verify-erasure", str(tmp_path / "receipt.json")]
    assert cli.main(look, spark, Config(archive=new)) == 0
    assert cli.main(look, spark, at) == 2  # the old archive still names the person


def test_practice(spark, at, tmp_path):
    (tmp_path / "q.tsv").write_text("Q1\tWhat is the forecast for the articles?\nQ2\tWhich discount was offered?\n")
    run = ["practice", str(tmp_path / "q.tsv"), "--out", str(tmp_path / "out")]
    assert cli.main(run, spark, at) == 0
    first = (tmp_path / "out" / "Q1.md").read_text()
    assert "DIGEST" in first and "about 40% of the articles" in first.partition("EVIDENCE")[2]
    assert first.endswith("QUESTION: What is the forecast for the articles?\n")
    every = (tmp_path / "out" / "ALL.md").read_text()
    assert every.index("# Q1") < every.index("# Q2")
    assert json.loads((tmp_path / "out" / "Q2.json").read_text())["question"] == "Which discount was offered?"


def test_sql_functions(spark, at):
    a = corpus.load(spark, at.archive)
    assert len(sql_functions.register(a.units, a.documents, a.people)) == 5
    ids = lambda q: [r[0] for r in spark.sql(q).collect()]
    assert ids("select unit_id from grep_units('ABOUT 40%')") == ["T01.s0000"]
    assert ids("select unit_id from unit_window('T01.s0001', 1) order by offset") == ["T01.s0000", "T01.s0001", "T01.s0002"]
    assert "40%" in ids("select figure from figures_near('articles')")
    assert set(ids("select doc_id from units_between('2024-05-01', '2024-05-31')")) == set(ids("select doc_id from archive_units where unit_id = 'T01.s0000'"))
    assert "T01.s0000" in ids("select unit_id from units_of('Mia Holt')")
    for none in ("grep_units('zzz')", "grep_units(null)", "unit_window('x', 2)", "figures_near(null)", "units_between(null, '2024-05-31')", "units_of(null)", "units_of('Nobody')"):
        assert ids(f"select unit_id from {none}") == []
