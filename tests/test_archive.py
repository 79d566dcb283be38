from __future__ import annotations

import hashlib
import sys
from pathlib import Path

import pytest
from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).parent))
from archive import FILES, INTERNAL, MEETING, ROSTER, ROSTER_SCHEMA, THREAD  # noqa: E402

from affidavit import schemas  # noqa: E402
from affidavit.operators import erase, people, render, rollups, search, sweep, threads, transcripts, verify  # noqa: E402
from affidavit.sources import corpus  # noqa: E402


@pytest.fixture(scope="module")
def archive(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("corpus")
    for path, content in FILES:
        (folder / path).parent.mkdir(exist_ok=True)
        (folder / path).write_text(content, encoding="utf-8")
    stored = str(tmp_path_factory.mktemp("archive") / "a")
    roster = spark.createDataFrame(ROSTER, ROSTER_SCHEMA)
    built = corpus.load_or_build(spark, stored, str(folder), roster, {"buyer": "Buyer Ltd"})
    again = corpus.load_or_build(spark, stored, "/nowhere", roster)
    assert built.fingerprint == again.fingerprint
    return again


@pytest.fixture(scope="module")
def units(archive):
    return {r.unit_id: r for r in archive.units.collect()}


def test_fingerprint(archive):
    h = hashlib.sha256()
    for path, content in sorted(FILES):
        h.update(path.split("/")[1].encode() + hashlib.sha256(content.encode()).digest())
    assert archive.fingerprint == h.hexdigest()[:16]


def test_statements_are_stitched(units):
    first = units["T01.s0000"]
    assert first.text == "We need the forecast for about 40% of the articles."
    assert first.interrupted_by == ["Tom Reed at 0:08: Mm-hm."] and first.spans_units == ["T01.u0000", "T01.u0002"]
    assert (first.locator, first.truncated, first.speaker, first.speaker_org) == ("0:05–0:12", False, "mia_holt", "Buyer Ltd")
    assert (first.date_text, first.meta.phase, first.meta.meeting) == ("2024-05-02", "Design", "Kick-off")
    assert units["T01.s0001"].speaker is None and units["T01.s0001"].speaker_display == "Unknown Speaker"
    assert units["T01.s0002"].truncated and units["T01.s0002"].meta.trails_off and units["T01.s0002"].locator == "at 1:10"
    assert units["T01.s0003"].text == "That is all."


def test_untimed_dialect(units):
    assert units["T02.s0000"].text == "Is the price 5m or six million?" and units["T02.s0000"].locator == "lines 3–5"
    assert units["T02.s0000"].speaker is None and units["T02.s0000"].speaker_display == "Me" and units["T02.s0000"].meta.unattributed_dialect


def test_threads(archive, units):
    doc = archive.documents.where("doc_id = 'emails/01_offer'").first()
    assert (doc.meta.declared_messages, doc.meta.parsed_messages, doc.n_units) == (3, 3, 3)
    assert (doc.date_text, doc.meta.first_date, doc.title) == ("2024-06-03T16:15", "2024-06-02T08:00", "Offer")
    new, mid, old = units["E01.m03"], units["E01.m02"], units["E01.m01"]
    assert new.text == "Thank you for the 12 % discount." and new.meta.attachments_stripped == 1 and new.seq == 0
    assert new.recipients == ["tom_reed", "jörn_ås", "someone else"] and new.locator == "message 3 of 3, 2024-06-03"
    assert mid.text == "Der Rabatt ist 12 %.\nMia, bitte antworten." and mid.meta.header_language == "de" and mid.speaker == "tom_reed"
    assert old.date_text == "2024-06-02T08:00" and old.meta.header_language == "sv" and old.text.startswith("Nils Lund") and old.meta.attachments_stripped == 1


def test_every_utterance_is_in_one_statement(spark):
    docs = transcripts.transcript_documents(spark.createDataFrame(FILES, "path string, content string"))
    stitched = transcripts.stitch(transcripts.untimed_utterances(docs.where("dialect = 'internal'")))
    rows = sorted((r.idx, r.segment, r.member) for r in stitched.collect())
    assert rows == [(0, 0, True), (1, 0, False), (2, 0, True), (3, 3, True)]
    assert transcripts.interruptions(stitched).count() == 1


@pytest.mark.parametrize(
    ("gap", "ahead", "joined"), [(120, 1, True), (121, 1, False), (10, 8, True), (10, 9, False)]
)
def test_stitch_limits(spark, gap, ahead, joined):
    rows = [("d", 0, "A", 0, "it is", 0)] + [("d", k, "B", 1, "Yes.", k) for k in range(1, ahead)] + [("d", ahead, "A", gap, "done.", ahead)]
    got = transcripts.stitch(spark.createDataFrame(rows, "doc_id string, idx int, speaker_raw string, t int, text string, line int"))
    assert got.where(f"idx = {ahead}").first().segment == (0 if joined else ahead)


def test_people(spark, archive):
    aliases = people.alias_table(archive.people)
    forms = {
        "Mia Holt": "mia_holt", "Mia": "mia_holt", "Holt": "mia_holt", "MIA.HOLT@buyer.example": "mia_holt", "MH": "mia_holt",
        "Jørn Åstrand": "jörn_ås", "Jorn Astrand": "jörn_ås", "Astrand": "jörn_ås", "Tom Reed (Vendor)": "tom_reed", "X <tom.reed@vendor.example>": "tom_reed",
        "Nils Lund": "nils_lund", "Unknown Speaker": None, "junk of prose": None, "": None,
    }
    df = spark.createDataFrame([(f,) for f in forms], "surface string")
    assert {r.surface: r.pid for r in people.resolve(df, "surface", aliases).collect()} == forms
    card = people.who_is(archive.people, archive.units, "Mia Holt").first()
    assert (card.pid, card.n_units, card.org) == ("mia_holt", 2, "Buyer Ltd")
    assert people.alias_patterns(archive.people).where("pid = 'tom_reed'").first().forms[0] == "tom.reed@vendor.example"


def test_search(archive):
    u = archive.units
    assert [r.unit_id for r in search.grep(u, "12 %").collect()] == ["E01.m03", "E01.m02"]
    assert search.grep(u, r"\d+ days", regex=True).first().matched == "30 days" and search.grep(u, "nothing like it").collect() == []
    assert search.search_text(u, "forecast articles").first().unit_id == "T01.s0000"
    figures = {(r.unit_id, r.figure) for r in search.find_figures(u).collect()}
    assert {("T01.s0000", "40%"), ("T01.s0002", "30 days"), ("T02.s0000", "5m"), ("E01.m03", "12 %"), ("E01.m02", "12 %")} == figures
    latest = {r.unit_id: r.latest for r in search.latest_figures(search.find_figures(u)).where("figure = '12 %'").collect()}
    assert latest == {"E01.m03": True, "E01.m02": False}
    assert [r.unit_id for r in search.timeline(u, "Rabatt thank delay", until="2024-06-03").collect()] == ["T01.s0002", "E01.m02", "E01.m03"]
    assert [r.offset for r in search.context_window(u, u.where("unit_id = 'T01.s0001'"), 1).orderBy("offset").collect()] == [-1, 0, 1]
    assert search.resolve_doc(archive.documents, "E01").first().doc_id == "emails/01_offer" and search.resolve_doc(archive.documents, "").collect() == []


def test_bm25_does_not_depend_on_partitions(archive):
    one, many = archive.units.coalesce(1), archive.units.repartition(7)
    assert search.bm25(one, "the offer discount").collect() == search.bm25(many, "the offer discount").collect()


def test_citations(spark, archive):
    cases = [
        ("E01.m03", "Thank you for the 12 % discount.", "exact"), ("E01.m03", "thank  YOU for\nthe 12 %", "exact"),
        ("E01.m03", "Thank you for the 12 % discounts.", "approximate"), ("E01.m03", "The discount was a third of it all.", "none"),
        ("E01.m99", "Thank you", "none"), ("E01.m03", "", "none"), ("E01.m03", None, "none"),
    ]
    df = spark.createDataFrame([(k, *c) for k, c in enumerate(cases)], "k int, unit_id string, quote string, want string")
    got = verify.verify_citations(df, archive.units, archive.documents).orderBy("k").collect()
    assert [r.match for r in got] == [c[2] for c in cases] and [r.ok for r in got] == [c[2] != "none" for c in cases]
    assert "fabricated" in got[4].problem and "does not appear" in got[3].problem and got[4].reference == "[UNVERIFIED E01.m99]"
    assert got[0].reference == "emails/01_offer — message 3 of 3, 2024-06-03 — Mia Holt (Buyer Ltd) — 2024-06-03 16:15"


def test_answers(spark, archive):
    cite = "array<struct<unit_id:string,quote:string>>"
    schema = (
        f"answer_id int, claims array<struct<statement:string,citations:{cite},status:string,superseded_by:string>>,"
        "gaps array<struct<nearest_evidence:string>>, abstentions array<struct<unit_id:string>>"
    )
    good = ("It is 12 %", [("E01.m03", "12 % discount"), ("E01.m03", "12 %  DISCOUNT")], "current", None)
    rows = [
        (1, [good], [], []),
        (2, [("No source", [], "current", None), ("Not there", [], "not_in_archive", None), ("Cut", [("T01.s0002", "30 days")], "current", "E01.m03"),
             ("Inside", [("T02.s0001", "Ask Tom Reed.")], "past", "X9")], [("X8",)], [("X7",), ("E01.m03",)]),
    ]
    out = verify.verify_answers(spark.createDataFrame(rows, schema), archive.units, archive.documents)
    summary = {r.answer_id: r for r in out["summary"].collect()}
    assert summary[1].ok and summary[1].total == 1 and not summary[2].ok and summary[2].unsupported == 1
    warnings = sorted(r.warning for r in out["warnings"].where("answer_id = 2").collect())
    assert len(warnings) == 7 and sum("does not exist" in w for w in warnings) == 3 and any("internal" in w for w in warnings)
    assert render.answers_to_json(out).count() == 2


@pytest.mark.parametrize("mode", ["redact", "purge"])
def test_erasure(archive, mode):
    _, forms = erase.subject(archive.people, "Tom Reed")
    u, d, p, receipt = erase.erase_person(archive.units, archive.documents, archive.people, "Tom Reed", mode)
    r = receipt.first()
    assert (r.units_authored, r.person_removed, r.mode) == (2, True, mode)
    assert r.survived == ["12 %"] and r.did_not_survive == []
    assert erase.verify_erasure(u, d, p, forms).collect() == [] and erase.verify_erasure(archive.units, archive.documents, archive.people, forms).count() > 0
    gone = u.where("unit_id = 'E01.m02'").first()
    assert gone.redacted and gone.text == ("" if mode == "purge" else erase.TOMBSTONE) and gone.speaker is None and gone.meta.thread_position == 2
    assert u.where("unit_id = 'T02.s0001'").first().text == "Ask [erased]." and "tom_reed" not in u.where("unit_id = 'E01.m03'").first().recipients
    again = erase.erase_person(u, d, p, "Tom Reed", mode)
    assert sorted(map(str, again[0].collect())) == sorted(map(str, u.collect()))
    assert u.dtypes == archive.units.dtypes


def test_erasing_a_stranger_and_an_ambiguous_name(spark, archive):
    u, _, _, receipt = erase.erase_person(archive.units, archive.documents, archive.people.where("pid <> 'nils_lund'"), "Nils Lund")
    assert receipt.first().mentions == 2 and u.where("unit_id = 'E01.m01'").first().text == "[erased] said hello. [erased] will call."
    two = archive.people.unionByName(archive.people.where("pid = 'mia_holt'").withColumns({"pid": F.lit("mia_two"), "display": F.lit("Mia Holter"), "aliases": F.array(F.lit("z")), "emails": F.array(F.lit("y@z.example"))}))
    with pytest.raises(ValueError, match="ambiguous"):
        erase.subject(two, "olt")
    pattern = erase.form_pattern(["Kwamé Bo", "KB"])
    got = spark.createDataFrame([("Kwame  Bo, KB and KwaméBo", )], "t string").select(erase.redact(F.col("t"), pattern)).first()[0]
    assert got == "[erased], KB and KwaméBo"


def test_rollups(spark, archive):
    s = rollups.stats(archive.units, archive.documents, archive.people).first()
    assert (s.documents, s.units, s.redacted) == (3, 9, 0) and s.last_date == "2024-06-03T16:15"
    assert {r.doc_kind: r.n for r in rollups.units_by_kind(archive.units).collect()} == {"transcript": 6, "email": 3}
    inv = {r.doc_id: r for r in rollups.inventory(archive.documents, archive.units).collect()}
    assert inv["emails/01_offer"].span == "2024-06-02..2024-06-03" and inv["transcripts/01_kick-off"].n_units == 4
    assert rollups.participation(archive.documents).first().name == "Jørn Åstrand"
    arc = {r.chapter: r.doc_id for r in rollups.story_arc(archive.documents, [("start", "kick"), ("none", "zzz")]).collect()}
    assert arc == {"start": "transcripts/01_kick-off", "last": "emails/01_offer"}
    assert rollups.latest_activity(archive.documents, 1).first().doc_id == "emails/01_offer"
    assert rollups.span_months(spark.sql("select explode(array(date'2024-01-01', date'2024-07-01')) as date")).first().months == 6
    numbers = spark.sql("select explode(array(5L, 1234L, 1234567L)) as n").select(rollups.short_number(F.col("n"))).collect()
    assert [r[0] for r in numbers] == ["5", "1.2k", "1.23M"]
    rates = spark.createDataFrame([("m", 2.0, 1.0, 4.0)], "model string, input_rate double, cached_rate double, output_rate double")
    used = spark.createDataFrame([("v", "m", 1000, 400, 10, False), ("v", "m", 9, 9, 9, True)], "view string, model string, input long, cached long, output long, free boolean")
    row = rollups.usage_rollup(used, rates).first()
    assert (row.calls, row.free, row.input) == (1, 1, 1000) and abs(row.cost - (600 * 2 + 400 + 40) / 1e6) < 1e-12


def test_sweep(spark, archive):
    docs = render.render_documents(archive.documents, archive.units).select("doc_id", F.col("rendered").alias("text"))
    got = {r.doc_id: r for r in sweep.sweep(docs, "forecast of the articles", parallel=2).collect()}
    assert got["transcripts/01_kick-off"].relevance == 3 and got["emails/01_offer"].relevance == 0

    def broken(text, question):
        raise RuntimeError("no model")

    assert {r.error for r in sweep.sweep(docs, "x", broken).collect()} == {"RuntimeError: no model"}
    facts = spark.createDataFrame([("d", 3, 0, "T01.s0000"), ("e", 2, 0, "T01.s0000"), ("e", 2, 1, "made up"), ("e", 1, 2, "T01.s0001")], "doc_id string, relevance int, k int, unit_id string")
    assert [r.unit_id for r in sweep.kept_units(facts, archive.units).collect()] == ["T01.s0000"]


def test_render(archive):
    texts = {r.doc_id: r.rendered for r in render.render_documents(archive.documents, archive.units).collect()}
    assert "[T01.s0000] (2024-05-02 | Mia Holt/Buyer Ltd | 0:05–0:12)" in texts["transcripts/01_kick-off"]
    assert "!! CUT OFF" in texts["transcripts/01_kick-off"] and "newest first" in texts["emails/01_offer"] and "internal recording" in texts["transcripts/02_INTERNAL-review"]
    first = render.render_evidence(archive.units, archive.documents).orderBy(*search.chronological()).first().rendered
    assert first.endswith("<source: Kick-off>")
    text = render.render_overview(rollups.inventory(archive.documents, archive.units), rollups.stats(archive.units, archive.documents))
    assert "totals: 3 documents, 9 units" in text and "[INTERNAL]" in text


def test_schemas(archive, tmp_path):
    assert [f.name for f in archive.units.schema] == [f.name for f in schemas.UNITS]
    archive.export_json(str(tmp_path / "j"))
    assert any("Jørn" in f.read_text(encoding="utf-8") for f in (tmp_path / "j" / "people").glob("*.json"))


def test_message_lines_ignore_what_looks_like_a_header(spark):
    docs = spark.createDataFrame([("d", THREAD.replace("Mia, bitte", "An: alle\nMia, bitte"))], "doc_id string, content string")
    assert threads.message_lines(docs).agg(F.max("msg")).first()[0] == 3
    assert MEETING and INTERNAL


def test_streaming(spark, tmp_path):
    from affidavit.streaming.ingest import watch

    folder = tmp_path / "in" / "notes"
    folder.mkdir(parents=True)
    args = (spark, str(tmp_path / "in"), str(tmp_path / "units"), str(tmp_path / "state"))
    (folder / "a.txt").write_text("one\n\ntwo\n")
    watch(*args).awaitTermination()
    (folder / "b.txt").write_text("three")
    watch(*args).awaitTermination()
    assert sorted(r.unit_id for r in spark.read.parquet(str(tmp_path / "units")).collect()) == ["notes/a.p0000", "notes/a.p0001", "notes/b.p0000"]
