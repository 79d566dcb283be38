"""Whitening, vector codes and word BPE against brute force, and over nulls, ties, repeated rows and clashing names."""

from __future__ import annotations

import hashlib
import random
import sys
from decimal import Decimal
from fractions import Fraction

import numpy as np
import pandas as pd
import public_tokenizers as P
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from affidavit.llm import integers, vector_codes, whitening, word_bpe
from affidavit.llm import queries as Q

SF, WORDS = "/root/testdata/sf0.001", P.path("word_bpe_49k.json")
VECTORS = "vec_id long, embedding array<double>, label int"
nan, inf = float("nan"), float("inf")


def polynomial(a):
    """Coefficients of det(t - a) by traces of powers, in whole numbers."""
    n = len(a)
    one = np.array([[int(i == j) for j in range(n)] for i in range(n)], object)
    m, c = np.zeros((n, n), object), [0] * n + [1]
    for k in range(1, n + 1):
        m = a @ m + c[n - k + 1] * one
        c[n - k] = -sum((a @ m)[i, i] for i in range(n)) // k
    return c


def scatter(rng, d, rank=None):
    b = rng.integers(-(10**6), 10**6, (rank or d + 3, d)).astype(object)
    return b.T @ b


@pytest.mark.parametrize(("d", "rank"), [(1, None), (2, None), (3, 1), (6, 4), (9, None)])
def test_polynomial_and_components(spark, d, rank):
    a = scatter(np.random.default_rng(d), d, rank)
    assert whitening.characteristic_polynomial(spark, a) == polynomial(a)
    v, values = whitening.components(spark, a, 8)
    want = np.sort(np.linalg.eigvalsh(a.astype(float)))[::-1][:8]
    assert np.allclose([float(x) for x in values], want, rtol=1e-9, atol=want[0] * 1e-12)
    assert np.allclose(v.T @ v, np.eye(min(d, 8)), atol=1e-14)
    assert all(x > 0 for x in values[: rank or d]) and all(x == 0 for x in values[rank or d :])
    norm = abs(a.astype(float)).max()
    assert np.abs(a.astype(float) @ v - v * want).max() < 1e-10 * norm


def test_roots_that_are_equal_or_nearly(spark):
    turn = np.array([[1, 1, 1, 1], [1, -1, 1, -1], [1, 1, -1, -1], [1, -1, -1, 1]], object)
    for values in ([9, 9, 9, 4], [7, 7, 2, 2], [5, 5, 5, 5], [10**20 + 1, 10**20, 3, 0]):
        a = turn.T @ np.diag(np.array(values, object)) @ turn  # eigenvalues are four times these
        v, found = whitening.components(spark, a, 8)
        assert [round(x) for x in found] == [4 * x for x in values]
        assert np.allclose(v.T @ v, np.eye(4), atol=1e-14)
        exact = np.array([[Fraction(x) for x in row] for row in v.tolist()], object)
        rest = a @ exact - exact * np.array([4 * x for x in values], object)
        assert max(abs(float(x)) for x in rest.ravel()) < 1e-15 * 8 * values[0]


def test_hessenberg_meets_zero_pivots():
    p = next(whitening.primes_below(1 << 31))
    a = np.array([[2, 0, 1, 0], [0, 3, 0, 1], [1, 0, 2, 0], [0, 1, 0, 3]], object)
    assert p == (1 << 31) - 1 and whitening.polynomial_modulo(a, p).tolist() == [c % p for c in polynomial(a)]
    some = list(zip(range(200), whitening.primes_below(100_000), strict=False))
    assert len({q for _, q in some}) == 200 and all(q % k for _, q in some for k in range(2, 317))


def whitened(x):
    """Whitened rows, shares and deviations by numpy."""
    x = np.floor(np.array(x, float) * 1024).astype(np.int64) + 100_000
    c = x - x.mean(0)
    cov = c.T @ c / len(x)
    e, v = np.linalg.eigh(cov)
    e, v = e[::-1][:8], v[:, ::-1][:, :8]
    return c @ v / np.sqrt(e), e / np.trace(cov), ((len(x) * x - x.sum(0)) ** 2).sum(1)


def test_op11(spark):
    table = pd.read_parquet(f"{SF}/embeddings.parquet").sort_values("vec_id")
    want, shares, deviations = whitened(table.embedding.tolist())
    got = Q.queries()["op11_whitening"](spark, SF).toPandas().sort_values(["vec_id", "component"])
    assert len(got) == 8 * len(table) and got.vec_id.tolist() == np.repeat(table.vec_id, 8).tolist()
    w = got.whitened.to_numpy().reshape(-1, 8)
    signs = np.sign((w * want).sum(0))
    assert np.abs(w * signs - want).max() < 1e-9 and set(got.n) == {len(table)}
    assert got.deviation[got.component == 1].tolist() == deviations.tolist()
    assert np.allclose(got.explained.to_numpy().reshape(-1, 8), shares, rtol=1e-9)
    assert got.identity_error.nunique() == 1
    assert abs(np.abs(np.cov(w.T, bias=True) - np.eye(8)).max() - got.identity_error.iloc[0]) < 1e-9 and got.identity_error.iloc[0] < 1e-9


def test_whitening_of_odd_rows(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(40, 3)).tolist()
    rows = [(k, v, 1) for k, v in enumerate(x)] + [(3, x[3], 2), (None, x[4], None)]
    odd = [(50, None, 1), (51, [], 1), (52, [1.0, None, 2.0], 1), (53, [nan, 1.0, 1.0], 1), (54, [1.0, inf, 1.0], 1)]
    df = spark.createDataFrame(rows + odd, VECTORS).withColumns({"n": F.lit("x"), "component": F.lit(1), "v": F.lit(2), "key": F.lit(3)})
    got = whitening.whiten(df).toPandas()
    want, _, deviations = whitened([r[1] for r in rows])
    assert len(got) == 3 * 42 and set(got.n) == {42} and sorted(got.deviation[got.component == 2].astype(int)) == sorted(deviations.tolist())
    assert sorted(got.vec_id.dropna().unique()) == list(range(40)) and got.vec_id.isna().sum() == 3
    assert np.allclose(np.sort(np.abs(got.whitened[got.component == 1])), np.sort(np.abs(want[:, 0])))
    assert whitening.whiten(df.limit(0)).collect() == []
    with pytest.raises(Exception, match="different lengths"):
        whitening.whiten(spark.createDataFrame([(1, [1.0], 1), (2, [1.0, 2.0], 1)], VECTORS).coalesce(1)).collect()


def test_whitening_where_there_are_fewer_dimensions(spark):
    flat = spark.createDataFrame([(k, [float(k), 2.0 * k, 5.0], 1) for k in range(9)], VECTORS)
    got = {(r.vec_id, r.component): r for r in whitening.whiten(flat).collect()}
    assert len(got) == 27 and all(got[k, 2].whitened is None and got[k, 3].explained == 0 for k in range(9))
    assert abs(got[0, 1].explained - 1) < 1e-12 and got[0, 1].identity_error < 1e-9 and got[4, 1].whitened == 0
    one = whitening.whiten(spark.createDataFrame([(7, [1.0, 2.0], 1)] * 2, VECTORS)).collect()
    assert len(one) == 4 and all(r.whitened is None and r.explained is None and r.identity_error is None and r.deviation == 0 for r in one)


def test_whitening_of_great_numbers_is_exact(spark):
    rows = [(k, [float((k * 7919 + i * 31) % 1000) * 1e9, float(k), 1e-9 * k], 1) for i, k in enumerate(range(60))]
    got = whitening.whiten(spark.createDataFrame(rows, VECTORS)).collect()
    y = [[int(Fraction(c) * 1024 // 1) for c in r[1]] for r in rows]
    sums = [sum(c) for c in zip(*y, strict=True)]
    want = {k: sum((60 * c - s) ** 2 for c, s in zip(v, sums, strict=True)) for k, v in enumerate(y)}
    assert {r.vec_id: int(r.deviation) for r in got} == want and all(r.identity_error < 1e-6 for r in got)


def test_nearest_is_exact_with_ties():
    rng = np.random.default_rng(2)
    for size, high, kind in ((4, 3, np.int64), (1, 5, np.int64), (7, 300, np.int64), (8, 10**15, object), (4, 2, object)):
        x = rng.integers(-high, high, (300, 2 * size)).astype(kind)
        books = rng.integers(-high, high, (2, 20, size)).astype(kind)
        books[:, 7] = books[:, 3]
        codes, error = vector_codes.assigned(x, books)
        parts = x.reshape(-1, 2, size).astype(object)
        want = [[min(range(20), key=lambda e: (int(((parts[r, p] - books[p, e].astype(object)) ** 2).sum()), e)) for p in range(2)] for r in range(300)]
        assert codes.tolist() == want
        assert [int(e) for e in error] == [sum(int(((parts[r, p] - books[p, want[r][p]].astype(object)) ** 2).sum()) for p in range(2)) for r in range(300)]


def test_transform_is_in_sequency_order_and_scales_distances():
    for size in (1, 2, 3, 4, 5, 8, 16):
        m = 1 << (size - 1).bit_length()
        h = vector_codes.transformed(np.eye(m, dtype=np.int64)).T  # a row for each coefficient
        assert [int((r[1:] != r[:-1]).sum()) for r in h] == list(range(m)) and (h @ h.T == m * np.eye(m)).all()
        x = np.random.default_rng(size).integers(-99, 99, (2, size))
        t = vector_codes.transformed(x)
        assert ((t[0] - t[1]) ** 2).sum() == m * ((x[0] - x[1]) ** 2).sum()


def test_op12_of_odd_rows(spark, tmp_path):
    """Against plain loops: fewer rows than entries, ties, repeated rows and ids, values far out."""
    rng = random.Random(4)
    vector = lambda: [float(rng.randrange(-3, 3)) / 8 for _ in range(32)]
    rows = [(k, vector(), rng.choice([None, 1, 2])) for k in range(200)] + [(5, vector(), 1), (None, vector(), 2), (300, [1e7] * 32, 2)]
    rows += [rows[9]] * 30
    odd = [(-1, None, 1), (-2, [], 1), (-3, [None] * 32, 1), (-4, [nan] + [0.0] * 31, 1), (-5, [-inf] + [0.0] * 31, 1)]
    for some in (rows, rows[:20]):
        table = spark.createDataFrame(some + odd, VECTORS).withColumns({"codes": F.lit(1), "key": F.lit(2), "of": F.lit(3), "v": F.lit(4)})
        table.repartition(3).write.mode("overwrite").parquet(f"{tmp_path}/embeddings.parquet")
        got = Q.queries()["op12_vector_codes"](spark, str(tmp_path)).collect()
        order = sorted(some, key=lambda r: (r[0] is None, r[0] or 0, r[1]))
        parts = [[[int(x * 256 // 1) for x in r[1][2 * p : 2 * p + 2]] for p in range(16)] for r in order]
        books = [[list(r[p]) for r in parts[:64]] for p in range(16)]
        distance = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))
        assign = lambda: [[min(range(len(books[p])), key=lambda e: (distance(r[p], books[p][e]), e)) for p in range(16)] for r in parts]  # noqa: B023, E731
        for _ in range(2):
            codes = assign()
            for p in range(16):
                for e in range(len(books[p])):
                    if own := [r[p] for r, c in zip(parts, codes, strict=True) if c[p] == e]:
                        books[p][e] = [sum(v) // len(own) for v in zip(*own, strict=True)]
        codes = assign()
        errors = [sum(distance(r[p], books[p][c[p]]) for p in range(16)) for r, c in zip(parts, codes, strict=True)]
        by_label = {label: sum(e for e, r in zip(errors, order, strict=True) if r[2] == label) for label in (None, 1, 2)}
        sha = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
        want = [(str(r[0]), "".join(f"{x:02x}" for x in c), e, by_label[r[2]], sha) for r, c, e in zip(order, codes, errors, strict=True)]
        assert sorted((str(r.vec_id), r.code, r.error, r.label_error, r.codebooks_sha256) for r in got) == sorted(want)
    assert vector_codes.compress(table.limit(0))[0].collect() == []


def test_integers_at_any_size():
    x = np.array([[1e300, -0.3], [2.0**-40, -(2.0**60)]])
    assert integers.floors(x, 256).tolist() == [[int(1e300) * 256, -77], [0, -(2**68)]]
    assert integers.floors(np.array([[-0.001]]), 1024).tolist() == [[-2]]
    assert integers.decimals([3, -(10**30)]).to_pylist() == [Decimal(3), Decimal(-(10**30))]


TEXTS = [
    None, "", " \n\t ", "Hello  WORLD, it's <|endoftext|>x<|ENDOFTEXT|> 12.5%", "ÀÉ größe, İstanbul ŉ ſ Ÿ ẞ ΑΣ Σας", "éa ́, x́́.ý̧,",
    "a\x1cb\x85c​d﻿e᠎f　g h", "日本語のテキスト。 한국어 한 ไทย", "\U0001f600\U0001f468‍\U0001f469 x'S DON'T we'LL''S 's", "½²³ªº ① Ⅷ 𝟙 ",
    "<|startoftext|><|endoftext|>", "<| endoftext|> a<|b", "“q” ‘r’ — … €5 ¡no! ¿sí?", "a" * 5000 + " " + "1" * 300 + "!" * 500, "x" * 30 + "\n" * 9 + "y", "\x00\x01 a\x00b",
]


def by_library(texts):
    t = Tokenizer.from_file(WORDS)
    ids = [t.encode(x or "", add_special_tokens=False).ids for x in texts]
    return [(i, t.decode(i, skip_special_tokens=False)) for i in ids]


@pytest.mark.parametrize("run", [1, 700, 10 << 20])
def test_word_bpe_is_the_library(spark, monkeypatch, run):
    monkeypatch.setattr(word_bpe, "RUN", run)
    monkeypatch.setattr(word_bpe, "RUN_IDS", run)
    rows = [(k, t) for k, t in enumerate(TEXTS)] + [(3, TEXTS[3]), (None, TEXTS[4]), (3, "other")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({n: F.lit(1) for n in ("key", "value", "ids", "item", "run", "n_tokens", "decoded")})
    got = word_bpe.encode(df.repartition(3), WORDS).collect()
    want = [(k, len(i), i, d) for (k, _), (i, d) in zip(rows, by_library([t for _, t in rows]), strict=True)]
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, want))
    assert word_bpe.encode(df.limit(0), WORDS).collect() == []
    again = word_bpe.decode(spark.createDataFrame([(r.doc_id, r.ids) for r in got], "doc_id long, ids array<int>"), WORDS)
    assert sorted(map(repr, map(tuple, again.collect()))) == sorted(repr((k, i, d)) for k, _, i, d in want)


def test_numbers_are_packed():
    for numbers in ([], [0], [65_535, 1], [65_536, 3, 2**32 - 1]):
        assert word_bpe.unpack(word_bpe.pack(np.array(numbers, np.uint32)), len(numbers)).tolist() == numbers


def test_ids_are_decoded_by_themselves(spark):
    rows = [("a", [3306, 49407, 3306]), ("a", [3306, 49407, 3306]), (None, []), ("b", None), ("c", list(range(0, 49_408, 7)) * 3)]
    got = word_bpe.decode(spark.createDataFrame(rows, "k string, ids array<int>"), WORDS, key="k").collect()
    t = Tokenizer.from_file(WORDS)
    assert sorted(map(repr, map(tuple, got))) == sorted(repr((k, i or [], t.decode(i or [], skip_special_tokens=False))) for k, i in rows)
    with pytest.raises(Exception, match="not in the table"):
        word_bpe.decode(spark.createDataFrame([("a", [60_000])], "k string, ids array<int>"), WORDS, key="k").collect()


def test_what_separates_words():
    """Every character that Python takes for white space, but for four, is so to the library; words are cut as it cuts them."""
    t = Tokenizer.from_file(WORDS)
    space = [c for c in map(chr, range(sys.maxunicode + 1)) if c.isspace() and not word_bpe.NOT_SPACE.match(c)]
    apart = t.encode("a b", add_special_tokens=False).ids
    assert all(t.encode(f"a{c}b", add_special_tokens=False).ids == apart for c in space)
    rng = random.Random(3)
    plain = [c for c in map(chr, range(33, 0x2100)) if word_bpe.PLAIN.fullmatch(c)]
    for _ in range(3000):
        w = "".join(rng.choice(plain if rng.random() < 0.4 else "abcst'lr.9,é") for _ in range(rng.randrange(1, 12)))
        parts = [i for p in word_bpe.parts_of(w) for i in t.encode(p, add_special_tokens=False).ids]
        assert parts == t.encode(w, add_special_tokens=False).ids, w


def test_op13(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").collect()
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    want = {(d.doc_id, len(i), sha(" ".join(map(str, i))), sha(t)) for d, (i, t) in zip(docs, by_library([d.text for d in docs]), strict=True)}
    got = Q.queries()["op13_word_bpe"](spark, SF).collect()
    assert len(got) == len(docs) and {tuple(r) for r in got} == want
