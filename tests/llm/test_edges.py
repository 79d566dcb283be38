"""Every operator and stage over nulls, empty and very long texts, ties, repeated rows, empty tables and clashing names."""

from __future__ import annotations

import hashlib
import random
import re

import public_tokenizers as P
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from affidavit.llm import byte_bpe, embedding_dedup, html_extract, license_scan, mixing, quality_classifier, quality_rules, simhash_dedup, token_store, url_filter
from affidavit.llm.common import new_folder

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
BPE, WORDS = P.path("byte_bpe_50k.tiktoken"), P.path("word_bpe_49k.json")
rng = random.Random(7)
WORD = [f"w{rng.randrange(10**6):06d}" for _ in range(4000)]
prose = lambda n: " ".join(rng.choice(WORD) for _ in range(n))


def documents(spark):
    same, long = prose(120), prose(60_000)
    rows = [
        (1, same, "en", "a", 1), (2, same, "en", "a", 1), (2, same, "en", "a", 1), (3, None, None, None, None), (4, "", "en", "a", 0),
        (5, " \n\t ", "en", "b", 4), (6, long, "en", "b", len(long)), (7, "a " * 5000, "en", None, 10_000), (None, prose(80), "en", "a", 2),
        (8, same + "\nÉté 日本 \U0001f600 <|endoftext|>", "fr", "c", 3), (9, "one", "de", "c", 3),
    ]
    return spark.createDataFrame(rows, DOCS)


@pytest.fixture(scope="module")
def docs(spark):
    return documents(spark).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


def test_quality_rules(docs, empty):
    clash = docs.withColumns({"rules": F.lit(1), "host": F.lit("x"), "h": F.lit(2), "hs": F.lit(3), "row": F.lit(4)})
    got = {(r.doc_id, r.text): r.rules for r in quality_rules.quality_rules(clash).collect()}
    assert len(quality_rules.quality_rules(docs).collect()) == 11
    assert got[(3, None)].n_words == 0 and got[(3, None)].base_failed and not got[(3, None)].kept
    assert got[(7, "a " * 5000)].n_repeat_words == 5000 and not got[(7, "a " * 5000)].kept
    assert [r.kept for k, r in got.items() if k[0] in (1, 2, 8)] == [True] * 3
    assert quality_rules.quality_rules(empty).collect() == []


def test_repeated_words_by_both_ways(spark, monkeypatch):
    texts = [" ".join(rng.choice("abcdefgh") for _ in range(n)) for n in (0, 1, 2, 3, 4, 30, 400, 3000)] * 3

    def brute(t):
        w, at = t.split(), {}
        for k in range(len(w) - 2):
            at.setdefault(tuple(w[k : k + 3]), []).append(k)
        return len({p + i for ks in at.values() if len(ks) > 1 for p in ks for i in range(3)})

    df = spark.createDataFrame([(t,) for t in texts], "text string")
    for few in (0, 32, 10**6):
        monkeypatch.setattr(quality_rules, "FEW", few)
        got = df.select(quality_rules.base_rules(F.col("text"))["n_repeat_words"]).collect()
        assert [r[0] for r in got] == [brute(t) for t in texts]


def test_frequent_lines_go_and_depleted_documents_too(spark):
    rows = [(k, f"Accept all cookies of this fine site\n{prose(60)}", "en", "s", 0) for k in range(60)]
    rows += [(100, "Accept  all COOKIES of this fine site\n" * 12 + "short rest of ten words or so in a line", "en", "s", 0)]
    rows += [(200 + k, rows[0][1], "en", "s", 0) for k in range(300)]
    judged = quality_rules.quality_rules(spark.createDataFrame(rows, DOCS), min_docs=20)
    got = {r.doc_id: r.rules for r in judged.collect()}
    assert all(got[k].kept and got[k].n_removed_lines == 1 for k in range(60))
    assert not got[100].kept and got[100].n_removed_lines == 12
    assert all(got[200 + k].kept for k in range(300))  # copies don't make their lines frequent
    text = judged.where("doc_id = 1").select(quality_rules.without_lines(F.col("text"), F.col("rules.removed"))).first()[0]
    assert text == rows[1][1].split("\n")[1]


def test_simhash(docs, empty):
    got = {r.doc_id: (r.fp, r.component_id) for r in simhash_dedup.simhash_components(docs, span=3, radius=2, least=None).collect()}
    assert got[3] == got[4] == got[5] == (0, 3) and got[1] == got[2] and got[2][1] == 1 and got[9][1] == 9
    clash = docs.withColumns({"fp": F.lit(1), "a": F.lit(2), "b": F.lit(3), "component": F.lit(4), "_n": F.lit("x"), "_key": F.lit(5)})
    left = simhash_dedup.simhash_dedup(clash)
    assert sorted(r.doc_id or 0 for r in left.collect()) == [0, 1, 3, 6, 7, 9] and left.columns == clash.columns
    assert simhash_dedup.simhash_dedup(empty).collect() == []
    assert simhash_dedup.simhash_components(empty).collect() == []


def test_url_filter(spark):
    rows = [
        (1, "https://X.example.NET/en/1?q"), (2, None), (3, "no scheme"), (4, "http://www.adult-x.example.org/fr/1"), (5, "http://spam-farm.example.org/en"),
        (6, "http://example.com/de/#a"), (6, "http://example.com/de/#a"), (7, "://"), (8, "http://notexample.net"), (9, "http://free-bets.org/de/1"),
    ]
    pages = spark.createDataFrame(rows, "page_id long, url string").withColumns({"host": F.lit(1), "rule": F.lit(2), "token": F.lit(3), "id": F.lit(4), "n": F.lit(5)})
    got = url_filter.url_filter(pages)
    seen = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in got.collect()}
    assert got.count() == len(rows)
    assert seen[1] == ("x.example.net", "/en/1", "example.net/en/", "allow") and seen[2] == seen[3] == ("", "", None, "allow")
    assert seen[4][2:] == ("org/fr/", "allow") and seen[5][2:] == (None, "block") and seen[6][2:] == ("example.com/de/", "block")
    assert seen[7] == ("", "", None, "allow") and seen[8][2:] == (None, "allow") and seen[9][2:] == (None, "block")
    assert url_filter.url_filter(pages.limit(0)).collect() == []
    long = spark.createDataFrame([(1, "http://www.example.net/en/deeper/x" + "/y" * 100_000), (2, "http://www.example.net/en")], "page_id long, url string")
    rules = [("example.net/", "block"), ("net/en/deeper/", "allow")]  # the longer rule wins, though its host is shorter
    assert {r.page_id: r.rule for r in url_filter.url_filter(long, host_rules=rules).collect()} == {1: "net/en/deeper/", 2: "example.net/"}


def test_license_scan(spark):
    apache = "Licensed under the Apache License, Version 2.0."
    rows = [
        ("r/LICENSE", "Released under the MIT License."), ("r/a.txt", None), ("r/b/c/d.txt", ""), ("r/b/LICENSE.txt", apache), ("r/b/e.txt", prose(50) + "\n" + apache),
        (None, "All rights reserved."), ("top.txt", "x " * 200_000), ("r/a.txt", None), ("s/LICENSE", "All rights reserved."), ("s/COPYING", apache),
    ]
    files = spark.createDataFrame(rows, "path string, text string").withColumns({"licence": F.lit(1), "line": F.lit(2), "dir": F.lit("z"), "token": F.lit(3)})
    scanned = license_scan.license_scan(files)
    got = {r.path: (r.own_licence, r.licence, r.licence_of) for r in scanned.collect()}
    assert scanned.count() == len(rows)
    assert got["r/a.txt"] == (None, "MIT", "r") and got["r/b/c/d.txt"] == (None, "Apache-2.0", "r/b")
    assert got["r/b/e.txt"] == ("Apache-2.0", "Apache-2.0", None) and got["top.txt"] == (None, None, None) and got[None] == (None, None, None)
    assert license_scan.license_scan(files.limit(0)).collect() == []


def test_headers_and_licence_files(spark):
    """Full texts with other names, comment headers, wrapped notices and tags; a nearer directory goes first."""
    full = {name: text for name, text in license_scan.TEMPLATES if len(text) > 200}
    wrap = lambda t, n, mark: "\n".join(mark + " ".join(t.split()[k : k + n]) for k in range(0, len(t.split()), n))
    rows = [
        ("m/LICENSE", "MIT License\n\nCopyright (c) 2020 Acme Inc.\n\n" + wrap(full["MIT"], 12, "")), ("m/src/a.py", "import os\n" + prose(40)),
        ("m/vendor/COPYING", wrap(full["BSD-3-Clause"], 9, "")), ("m/vendor/x/y/b.c", prose(30)), ("m/c.java", wrap(full["Apache-2.0"], 8, "// ") + "\nclass C {}\n" + prose(300)),
        ("n/d.sh", "#!/bin/sh\n# SPDX-License-Identifier: GPL-2.0\n" + prose(200)), ("n/e.txt", prose(20) + "\nLicensed under the Apache\nLicense, Version 2.0.\n" + prose(20)),
        ("n/f.h", "/*\n" + wrap(full["LGPL-3.0"], 10, " * ") + "\n */\n" + prose(100)), ("n/g.txt", prose(100)), ("g.txt", prose(50) + " license of the river"),
    ]
    got = {r.path: (r.own_licence, r.licence, r.licence_of) for r in license_scan.license_scan(spark.createDataFrame(rows, "path string, text string")).collect()}
    assert got["m/LICENSE"][0] == "MIT" and got["m/src/a.py"] == (None, "MIT", "m")
    assert got["m/vendor/COPYING"][0] == "BSD-3-Clause" and got["m/vendor/x/y/b.c"] == (None, "BSD-3-Clause", "m/vendor")
    assert got["m/c.java"][0] == "Apache-2.0" and got["n/d.sh"][0] == "GPL-2.0" and got["n/e.txt"][0] == "Apache-2.0" and got["n/f.h"][0] == "LGPL-3.0"
    assert got["n/g.txt"] == (None, None, None) and got["g.txt"] == (None, None, None)


def labels(spark):
    rows = [(1, 1), (2, 1), (8, 1), (7, 0), (None, 1), (4, None), (999, 0), (6, 1), (9, 0), (1, 1)]
    return spark.createDataFrame(rows, "doc_id long, quality int")


def test_classifier(spark, docs, empty):
    model = quality_classifier.train(docs, labels(spark))
    clash = docs.withColumns({"score": F.lit("x"), "predicted": F.lit("y"), "key": F.lit(1), "h": F.lit(2), "x": F.lit(3), "label": F.lit(9)})
    scored = quality_classifier.score(clash, model)
    assert scored.count() == 11 and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in scored.collect())
    assert quality_classifier.score(empty, model).collect() == []
    none = quality_classifier.train(empty, labels(spark))
    assert {r.score for r in quality_classifier.score(docs, none).collect()} == {0.5}
    one = quality_classifier.train(docs, labels(spark).where("quality = 1"))
    assert {r.score for r in quality_classifier.score(docs, one).collect()} == {1.0}


def test_token_store(spark, docs, empty):
    folder = new_folder(spark, "t")
    token_store.write_tokens(docs.withColumns({"key": F.lit(1), "shard": F.lit(2), "frame": F.lit(3)}), folder, WORDS, end_id=1)
    got = sorted(token_store.read_tokens(spark, folder).collect(), key=lambda r: r.start)
    assert len(got) == 11 and [r.doc_id for r in got] == [None, 1, 2, 2, 3, 4, 5, 6, 7, 8, 9]
    assert got[0].start == 0 and all(b.start == a.start + a.n_tokens for a, b in zip(got, got[1:], strict=False))
    assert [r.n_tokens for r in got if r.doc_id in (3, 4, 5)] == [1, 1, 1]
    assert spark.sparkContext.parallelize([0]).map(lambda _: 1).count() == 1
    reader = token_store.ShardReader(folder, spark.read.parquet(f"{folder}/shards").orderBy("shard").first()["shard"])
    assert list(reader)[0][2].tolist() == reader.ids(0).tolist()
    folder = new_folder(spark, "t")
    assert token_store.write_tokens(empty, folder, WORDS, end_id=1).collect() == []
    assert token_store.read_tokens(spark, folder).collect() == []


def test_a_key_that_is_no_number_is_refused(spark, docs):
    with pytest.raises(TypeError, match="numeric key"):
        token_store.write_tokens(docs.withColumn("doc_id", F.col("doc_id").cast("string")), new_folder(spark, "tokens"), WORDS, end_id=1)


def test_another_dictionary_is_refused(spark, docs):
    folder = new_folder(spark, "t")
    token_store.write_tokens(docs, folder, WORDS, end_id=1)
    token_store.put(folder, "dictionary", lambda f: f.write(b"other"))
    with pytest.raises(Exception, match="another dictionary"):
        token_store.read_tokens(spark, folder).collect()


def test_html(spark):
    page = "<html><nav>Menu a</nav><article><h1>T &amp; U</h1><p>First\n  para<br>graph one<p>Second</article><footer>foot</footer>"
    rows = [(1, page), (2, None), (3, ""), (4, "<p>"), (5, "no tags at all"), (6, "<div>" * 3000 + "deep text here</div>"), (1, page), (7, "<p>" + "long " * 100_000)]
    pages = spark.createDataFrame(rows, "page_id long, html string").withColumns({"text": F.lit(1), "n_chars": F.lit(2), "url": F.lit("u")})
    out = html_extract.extract(pages)
    got = {r.page_id: r.text for r in out.collect()}
    assert out.count() == 8 and got[1] == "T & U\n\nFirst para graph one\n\nSecond"
    assert got[2] == got[3] == got[4] == "" and got[5] == "no tags at all" and got[6] == "deep text here" and len(got[7]) == 499_999
    assert html_extract.extract(pages.limit(0)).collect() == []


def test_html_without_article():
    side = '<div class="sidebar"><p>Other things to read are here, see them all.</p></div><div id="comments"><p>A reader says that this is all wrong.</p></div>'
    body = "".join(f"<p>Paragraph {k} tells a rather long story about number {k} and more of it.</p>" for k in range(6)) + "<p>Short.</p>"
    form = '<form><label>Name</label><input><button>Send</button></form><div class="cookie-notice">We use cookies here.</div>'
    text = html_extract.main_text(f"<body><header>Site</header>{side}<div><h2>Title</h2>{body}</div>{form}<aside>x</aside></body>")
    assert text.startswith("Title\n\nParagraph 0") and text.endswith("Short.") and text.count("\n\n") == 7


def test_embeddings(spark):
    near = [1.0, 0.01, 0.0]
    rows = [
        (1, [1.0, 0.0, 0.0], 0), (2, near, 0), (2, near, 0), (3, None, 0), (4, [0.0, 0.0, 0.0], 0), (5, [float("nan"), 1.0, 0.0], 0), (6, [None, 1.0, 0.0], 0),
        (7, [float("inf"), 1.0, 0.0], 0), (8, [0.0, 1.0], 0), (9, [0.0, 1.0], 0), (10, [], 0), (None, [1.0, 0.0, 0.0], 0), (11, [0.0, 0.0, 5.0], 0), (11, [0.0, 7.0, 0.0], 0),
        (12, [1e-30, 0.0, 0.0], 1),
    ]
    v = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").withColumns({"x": F.lit(1), "v": F.lit(2), "n": F.lit(3), "id": F.lit(4)})
    got = {}
    for r in embedding_dedup.near_vectors(v).collect():
        got.setdefault(r.vec_id, []).append((r.n_links, r.component_id, r.kept))
    assert got[1] == [(3, 1, True)] and got[2] == [(3, 1, False)] * 2 and got[12] == [(3, 1, False)]
    assert all(got[k] == [(0, k, True)] for k in (3, 4, 5, 6, 7, 10)) and got[8] == [(1, 8, True)] and got[9] == [(1, 8, False)]
    assert got[11] == [(0, 11, True)] * 2 and got[None] == [(0, None, True)]
    assert embedding_dedup.near_vectors(v.limit(0)).collect() == []


def test_byte_bpe(docs, empty):
    clash = docs.withColumns({"key": F.lit(1), "value": F.lit(2), "ids": F.lit(3), "n_tokens": F.lit(4)})
    encoded = byte_bpe.encode(clash, BPE, P.PATTERN)
    back = {(r.doc_id, bytes(r.data)) for r in byte_bpe.decode(encoded, BPE, P.PATTERN).collect()}
    assert back == {(r.doc_id, (r.text or "").encode()) for r in docs.collect()}
    for r in byte_bpe.digests(docs, BPE, P.PATTERN).collect():
        if r.doc_id in (3, 4):
            assert (r.n_tokens, r.ids_sha256) == (0, hashlib.sha256().hexdigest())
    assert byte_bpe.encode(empty, BPE, P.PATTERN).collect() == []


def test_mixing(spark, docs, empty):
    clash = docs.withColumns({"copy": F.lit("x"), "place": F.lit("y"), "n_copies": F.lit("z"), "rate": F.lit(9)})
    out = mixing.mix(clash, {"a": 5.0})
    assert set(out.columns) == set(clash.columns) and out.count() == out.select("doc_id", "copy", "text").count()
    assert mixing.mix(empty).collect() == [] and mixing.mix(docs, {"a": 0.0, "b": 0.0, "c": 0.0}, other=0.0).count() == 0
    with pytest.raises(ValueError):
        mixing.mix(docs, {"a": -1.0})


def test_mixing_reaches_its_weights(spark):
    rows = [(k, "x" * (10 + k % 7), "en", ["big", "big", "big", "small"][k % 4], 0) for k in range(20_000)]
    df = spark.createDataFrame(rows, DOCS)
    got = dict(mixing.mix(df, {"big": 1.0, "small": 4.0}).groupBy("source").agg(F.sum(F.length("text"))).collect())
    total = sum(len(r[1]) for r in rows)
    assert abs(got["small"] / total - 0.8) < 0.02 and abs(got["big"] / total - 0.2) < 0.01
    few = df.where("doc_id % 2000 = 3").unionByName(df.where("source = 'big'"))
    high = mixing.mix(few, {"big": 1.0, "small": 1.0})
    rate = mixing.rates(few, {"big": 1.0, "small": 1.0}).where("source = 'small'").first().rate
    assert rate > mixing.MOST_RATE and abs(high.where("source = 'small'").count() / 10 / rate - 1) < 0.05


def test_poisson_against_its_sums(spark):
    import math

    grid = [(m, (k + 0.5) / 200) for m in (0.0, 0.1, 1.0, 3.7, 16.0) for k in range(200)]

    def brute(m, u):
        k, c = 0, math.exp(-m)
        p = c
        while c <= u:
            k += 1
            p *= m / k
            c += p
        return k

    got = spark.createDataFrame(grid, "m double, u double").select(mixing.poisson(F.col("u"), F.col("m"))).collect()
    assert [r[0] for r in got] == [brute(m, u) for m, u in grid]


def test_stages(spark, docs, empty, tmp_path):
    """Every stage keeps the caller's further columns as they are, whatever the operators call their own."""
    labels(spark).write.parquet(str(tmp_path / "labels.parquet"))
    more = {"rules": F.col("doc_id") * 2, "score": F.concat(F.lit("s"), "doc_id"), "predicted": F.lit("p"), "n_copies": F.lit(2.5), "copy": F.array("doc_id"), "place": F.lit("here"), "Row 1": F.lit(7)}
    clash = docs.withColumns(more)
    model = quality_classifier.train(docs, labels(spark))
    good = [r.doc_id for r in quality_classifier.score(docs, model).collect() if r.predicted == 1]
    copies = {(r.doc_id, r.text): r.n_copies for r in mixing.mix(docs, corpus_pipeline.MIX_WEIGHTS).collect()}
    expected = {
        "quality rules": [1, 2, 2, 6, 8, None],
        "quality classifier": good,
        "simhash near-dedup": [1, 3, 6, 7, 9, None],  # 2 is 1, 4 and 5 are 3, 8 adds few words to 1
        "mixing": [r.doc_id for r in docs.collect() for _ in range(copies.get((r.doc_id, r.text), 0))],
        "byte-level BPE": [r.doc_id for r in docs.collect()],
    }
    for name, stage in corpus_pipeline.STAGES:
        for table in (docs, empty, clash):
            out = stage(spark, table, str(tmp_path))
            rows = out.collect()
            assert sorted(str(r.doc_id) for r in rows) == sorted(map(str, [] if table is empty else expected[name]))
            if name != "byte-level BPE":
                assert out.dtypes == table.dtypes
                if table is clash:
                    id_ = lambda r: r.doc_id
                    assert all((r.rules, r.copy) == (id_(r) and 2 * id_(r), [id_(r)]) and r["Row 1"] == 7 for r in rows)
                    assert all((r.score, r.predicted, r.n_copies, r.place) == (id_(r) and f"s{id_(r)}", "p", 2.5, "here") for r in rows)


def test_words_of_the_contract(spark):
    text = "a b  c\x0bd e\x1cf\r\ng"
    got = spark.createDataFrame([(text,)], "t string").select(quality_rules.base_rules(F.col("t")).alias("r")).first().r
    assert got.n_words == len(re.findall(r"[^\x20\x09-\x0D]+", text))
