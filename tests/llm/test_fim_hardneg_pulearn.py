"""Fill-in-the-middle, hard negatives and positive-unlabelled quality against brute force, and on odd rows."""

import hashlib
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from bookspark.llm import fim, hardneg, pulearn
from bookspark.llm._shared import prepare
from bookspark.llm.queries import held_out

TOKEN = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")


def test_wavelet_matrix_against_counting():
    rng = np.random.default_rng(1)
    for n in (0, 1, 63, 64, 65, 1000):
        codes = rng.integers(0, 8, n).astype(np.uint8)
        matrix, at = fim.WaveletMatrix(codes), np.arange(n + 1)
        for c in range(8):
            assert matrix.rank(c, at).tolist() == [int((codes[:k] == c).sum()) for k in at]
            places = np.flatnonzero(codes == c)
            assert matrix.select(c, np.arange(1, len(places) + 2)).tolist() == [*places.tolist(), n]


def test_boundaries_against_units():
    rng = np.random.default_rng(2)
    texts = ["", " ", "a", "\n", "a\n", "  x \ny  "] + ["".join(rng.choice(list("ab é\U0001f600 \n\t\r"), n)) for n in rng.integers(0, 90, 60)]
    units = {"word": TOKEN.findall, "line": lambda t: re.findall(r"[^\n]*\n|[^\n]+", t), "char": list}
    for unit, split in units.items():
        b = fim.Boundaries(texts, unit)
        own = [split(t) for t in texts]
        assert b.units.tolist() == [len(u) for u in own]
        for share in (0, 0.3, 0.5, 1):
            k = np.array([int(share * len(u)) for u in own])
            assert b.place(k).tolist() == [len("".join(u[:j])) for u, j in zip(own, k)]


def test_cuts_at_the_very_start_beside_long_texts():
    # places found early are not asked again before the first text
    texts = ["a b", *["word " * 300] * 50]
    b = fim.Boundaries(texts, "word")
    zero = np.zeros(len(texts), np.int64)
    assert not b.place(zero).any() and b.place(b.units).tolist() == [len(t) for t in texts]


FIM_ROWS = [(1, None, "x"), (2, "", None), (None, "some words here ", "y"), (4, "has a <S> mark in it", "z"), (5, " lead and trail \n\n", "z"), (5, " lead and trail \n\n", "z"), (6, "x" * 100_000 + " é\U0001f600" * 50_000, None), *[(k, f"row {k} of é words\nand lines with \U0001f600", "w") for k in range(7, 80)]]


def test_fill_in_middle_against_brute_force(spark):
    docs = prepare(spark).createDataFrame(FIM_ROWS, "doc_id long, text string, form string")
    out = fim.transform(docs).withColumn("back", fim.restored(F.col("output"), F.col("form")))
    assert out.columns == ["doc_id", "text", "n_units", "form", "cut_1", "cut_2", "output", "back"]
    rows = out.collect()
    assert len(rows) == len(FIM_ROWS) and len({r["form"] for r in rows}) == 3
    for r in rows:
        t = r["text"] or ""
        h = hashlib.sha256(f"42:{'' if r['doc_id'] is None else r['doc_id']}".encode()).hexdigest()
        h1, h2, h3, h4 = (int(h[8 * k : 8 * k + 8], 16) for k in range(4))
        units = TOKEN.findall(t)
        a, z = sorted((h1 % (len(units) + 1), h2 % (len(units) + 1)))
        pre, mid, suf = "".join(units[:a]), "".join(units[a:z]), "".join(units[z:])
        form = "plain" if not t or any(m in t for m in ("<P>", "<S>", "<M>")) or h3 % 100 >= 50 else "spm" if h4 % 100 < 80 else "psm"
        want = {"plain": t, "psm": f"<P>{pre}<S>{suf}<M>{mid}", "spm": f"<S>{suf}<P>{pre}<M>{mid}"}[form]
        assert (r["n_units"], r["form"], r["cut_1"], r["cut_2"], r["output"], r["back"]) == (len(units), form, len(pre), len(pre + mid), want, t)
    assert fim.transform(docs.limit(0)).count() == 0
    for unit in ("line", "char"):
        assert fim.transform(docs, unit=unit, rate=100).where(~fim.restored(F.col("output"), F.col("form")).eqNullSafe(F.coalesce("text", F.lit("")))).count() == 0


def brute_negatives(rows, every, positives, negatives, least, most):
    good = [(i, tuple(int(np.floor(256 * float(x))) for x in v), y) for i, v, y in rows if i is not None and v is not None and y is not None and all(x is not None and np.isfinite(x) for x in v)]
    out = []
    for i, v, y in good:
        if i % every:
            continue
        scored = sorted(((-sum(a * b for a, b in zip(v, w)), j, y2 == y) for j, w, y2 in good if j != i and len(w) == len(v)))
        for p, j, _ in [s for s in scored if s[2]][:positives]:
            inside = [(s, k) for s, k, same in scored if not same and least * -p <= 100 * -s <= most * -p][:negatives]
            out += [(i, j, n + 1, k, -p, -s) for n, (s, k) in enumerate(inside)]
    return sorted(out)


def vectors(n, seed, dims=12):
    rng = np.random.default_rng(seed)
    rows = [(int(k), rng.normal(size=dims).astype(np.float32).tolist(), int(rng.integers(0, 3))) for k in range(n)]
    rows += [(n + k, rows[3][1], k % 3) for k in range(40)]  # a very common vector: ties
    rows += [(n + 100, rows[3][1], 1)] * 2 + [(50, rows[5][1], 2)]  # repeated rows, and an anchor's id again
    rows += [(None, rows[0][1], 1), (n + 200, None, 1), (n + 201, rows[0][1], None), (n + 202, [None] + rows[0][1][1:], 1), (n + 203, [float("nan")] + rows[0][1][1:], 1), (n + 204, [float("inf")] + rows[0][1][1:], 1)]
    return rows + [(1000, [], 1), (1001, [], 1), (1002, [], 2), (1050, [0.5, 0.25], 1), (1051, [0.5, 0.3], 1), (1052, [0.3, 0.2], 0), (1100, [0.0] * dims, 1)]


@pytest.mark.parametrize("seed,block,group", [(0, 262_144, 2_000_000), (1, 120, 300)])
def test_hard_negatives_against_brute_force(spark, monkeypatch, seed, block, group):
    monkeypatch.setattr(hardneg, "BLOCK", block)
    monkeypatch.setattr(hardneg, "GROUP", group)
    rows = vectors(400, seed)
    table = prepare(spark).createDataFrame([(*r, "extra") for r in rows], "vec_id long, embedding array<float>, label int, rank string").repartition(3)
    got = hardneg.mine(table, every=25)
    assert got.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    want = brute_negatives(rows, 25, 5, 3, 50, 95)
    assert sorted(map(tuple, got.collect())) == want and len(want) > 100
    assert hardneg.mine(table.limit(0)).count() == 0


def test_scan_leaves_dimensions_unread_and_loses_nothing():
    rng = np.random.default_rng(4)
    values = np.floor(256 * rng.normal(scale=0.125, size=(64, 4000))).astype(np.int64)
    # an anchor whose weight lies in few dimensions, as magnitudes of real embeddings do
    vector = np.floor(256 * rng.normal(scale=0.125, size=64) * np.exp(-np.arange(64) / 8)).astype(np.int64)
    order = np.argsort(-np.abs(vector), kind="stable")
    low, high = (x[0] for x in hardneg.remaining(vector[None], order[None], values.min(axis=1), values.max(axis=1)))
    scores = vector @ values
    floor = int(np.sort(scores)[-5])
    rows, found, read = hardneg.scan(values, vector, order, low, high, None, lambda part, least, most: part + most >= floor)
    assert sorted(rows.tolist()) == np.flatnonzero(scores >= floor).tolist() and (found == scores[rows]).all()
    assert read < 0.5 * values.size


def texts_of(n, seed):
    rng = np.random.default_rng(seed)
    words = ["lane", "river", "of", "the", "stone", "walks", "and", "bright", "over", "fields", "quietly", "a", "house", "winter"]
    good = lambda: " ".join(rng.choice(words, 40)).capitalize() + "."
    bad = [lambda: " | ".join(rng.choice(words, 30)), lambda: " ".join(f"{w.upper()}!!" for w in rng.choice(words, 30)), lambda: "stone " * 40]
    quality = rng.random(n) < 0.7
    return [(k, good() if q else bad[k % 3](), int(q)) for k, q in enumerate(quality)]


def test_positive_unlabelled_learning(spark):
    rows = texts_of(1500, 0)
    docs = prepare(spark).createDataFrame([(k, t) for k, t, _ in rows], "doc_id long, text string").withColumn("held_out", held_out(5, 0))
    featured = pulearn.featurize(docs).drop("text").cache()
    trusted = spark.createDataFrame([(k, True) for k, _, q in rows if q and k % 2], "doc_id long, positive boolean")
    model = pulearn.train(featured.where("not held_out").join(trusted, "doc_id", "left"))
    assert abs(model["prior"] - 0.7) < 0.06
    out = {r["doc_id"]: r for r in pulearn.score(featured, model).where("held_out").collect()}
    right = [out[k]["predicted"] == q for k, _, q in rows if k in out]
    assert len(right) > 200 and np.mean(right) >= 0.95


def test_risk_against_its_definition():
    rng = np.random.default_rng(3)
    x, positive, w = rng.normal(size=(300, 4)), rng.random(300) < 0.3, rng.normal(size=4)
    loss = lambda z: np.log1p(np.exp(-z))

    def defined(w, prior):
        as_bad = loss(-x @ w).mean() - prior * loss(-x[positive] @ w).mean()
        return prior * loss(x[positive] @ w).mean() + max(0, as_bad) + pulearn.PENALTY / 2 * w @ w

    for prior in (0.1, 0.99):  # the second makes the part of bad text negative somewhere
        for v in (w, 3 * x[positive].mean(axis=0)):
            value, g, h, others = pulearn.risk(pulearn._sums(x, positive, v, np.array([w / 2])), v, np.array([w / 2]), prior)
            assert np.isclose(value, defined(v, prior)) and np.isclose(others[0], defined(w / 2, prior))
            e = 1e-5 * np.eye(4)
            assert np.allclose(g, [(defined(v + d, prior) - defined(v - d, prior)) / 2e-5 for d in e], atol=1e-5)


def test_prior_of_counts():
    web, trusted = np.zeros(10), np.zeros(10)
    trusted[6:9] = 10_000
    web[6:9], web[:3] = 6_000, 4_000
    assert abs(pulearn.prior_of(web, trusted) - 0.6) < 0.01
    assert pulearn.prior_of(web, np.zeros(10)) == 0.5


def test_quality_of_odd_rows(spark):
    rows = [(1, None, "x"), (2, "", "y"), (None, "some words", None), (5, "same", "z"), (5, "same", "z"), (6, "x " * 50_000, "z"), (7, "no end " + "\n" * 1000, "z")]
    docs = prepare(spark).createDataFrame(rows, "doc_id long, text string, score string")
    featured = pulearn.featurize(docs)
    for positive in (F.lit(False), F.col("doc_id") == 5, F.lit(None).cast("boolean")):
        out = pulearn.score(featured, pulearn.train(featured.withColumn("positive", positive)))
        got = out.collect()
        assert len(got) == len(rows) and all(0 <= r["score"] <= 1 for r in got) and out.columns.count("score") == 1
        assert len({r["score"] for r in got if not r["text"]}) == 1
    assert pulearn.score(pulearn.featurize(docs.limit(0)), pulearn.train(featured.limit(0).withColumn("positive", F.lit(True)))).count() == 0
