"""The line field, whitening and hard negatives: against brute force, numpy and SQL, on clustered and odd tables."""

import itertools
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.llm import hardneg, linecrf, whitening

KIND = "vec_id long, embedding array<float>, label int, x int, block int, key int, index long, part int"


def vectors(spark, rows):
    return spark.createDataFrame([(*r, 1, 1, 1, 1, 1) for r in rows], KIND)


def odd_vectors(spark):
    r = np.random.default_rng(3)
    rows = [(k, [float(v) for v in r.normal(size=5)], k % 3) for k in range(120)]
    same = [0.25, 0.5, -1.0, 0.0, 0.125]
    rows += [(200 + k, same, 1) for k in range(60)] + [(250, same, 2), (250, same, 2), (50, [1.0, 0.0, 0.0], 0)]
    rows += [(300, None, 1), (350, [1.0, None, 0.0, 0.0, 0.0], 1), (400, [1.0, float("nan"), 0.0, 0.0, 0.0], 1), (450, [float("inf")] * 5, 0), (None, same, 1), (500, same, None), (550, [], 1)]
    return vectors(spark, rows)


# 11


def test_marginals_and_gradient_equal_enumeration():
    texts = ["Hello there.\n\nFoo bar ##\nfoo bar baz foo bar baz", "", "one", "a b c\n" * 6, None]
    some, w = linecrf.lines(texts), np.random.default_rng(1).normal(size=linecrf.SIZE)
    good, _, total = linecrf.marginals(some, w)
    u, pairs, edges = linecrf.potentials(some, w), w[-4:].reshape(2, 2), np.append(some.starts, len(some.words))
    for t, (a, b) in enumerate(itertools.pairwise(edges)):
        whole, each = 0.0, np.zeros(b - a)
        for labels in itertools.product((0, 1), repeat=b - a):
            s = np.exp(np.dot(labels, u[a:b]) + sum(pairs[i, j] for i, j in itertools.pairwise(labels)))
            whole, each = whole + s, each + s * np.array(labels)
        assert np.allclose(each / whole, good[a:b], atol=1e-12) and abs(np.log(whole) - total[t]) < 1e-9
    y, weight = np.array([1, 0, 1, 0, 1]), np.array([1, 0.5, 0.3, 0.2, 0.1])
    grad = linecrf.likelihood(some, y, weight, w)[1]
    near = [(linecrf.likelihood(some, y, weight, w + e)[0] - linecrf.likelihood(some, y, weight, w - e)[0]) / 2e-5 for e in 1e-5 * np.eye(linecrf.SIZE)]
    assert np.abs(grad - near).max() < 1e-7


def test_line_features_by_hand():
    some = linecrf.lines(["Ab cd EF12!\n \nx # x x\nx # x x\n", "ü", "\n\n"])
    at = {n: k for k, n in enumerate(linecrf.NAMES)}
    f = some.features
    assert some.words.tolist() == [3, 4, 4, 1, 0] and some.number.tolist() == [0, 2, 3, 0, 0] and some.starts.tolist() == [0, 3, 4]
    assert f[:, at["seen line"]].tolist() == [0, 0, 1, 0, 0] and f[:, at["no word"]].tolist() == [0, 0, 0, 0, 1] and f[:, at["capital first"]].tolist() == [1, 0, 0, 0, 0]
    assert f[0, at["share upper"]] == 0.5 and np.isclose(f[0, at["share digit"]], 2 / 9) and f[0, at["stops"]] == 1 and f[1, at["same as word before"]] == 0.25
    assert f[1, at["repeated windows"]] == 1 and f[0, at["repeated windows"]] == 0 and f[1, at["distinct words"]] == 0.5 and f[1, at["words with signs"]] == 0.25 and f[3, at["share high"]] == 1


def test_a_text_scores_alike_alone_and_among_others():
    texts = ["Some words here.\nMore of them $$ now\n" * 3, "some words here.", None, "", "UPPER!! CASE!!\n" * 300, "Some words here.\nMore of them $$ now\n" * 3]
    model = linecrf.Model(np.random.default_rng(2).normal(size=linecrf.SIZE), 1.0, 0.2)
    both = model.scores(texts)
    assert np.allclose(both, [model.scores([t])[0] for t in texts], atol=1e-5) and both[0] == pytest.approx(both[5]) and both[2] == pytest.approx(both[3])


def test_held_out_quality(spark):
    sf = "/root/testdata/sf0.01"
    rows = linecrf.op11_line_crf(spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").filter("held_out").collect()
    assert np.mean([r.predicted == r.quality for r in rows]) >= 0.95 and np.mean([r.predicted for r in rows if r.quality]) >= 0.98


def test_quality_model_on_odd_rows(spark, odd, none):
    labels = spark.createDataFrame([(5, 1), (8, 0), (8, 0), (9, 1), (9, 0), (None, 1), (4, None), (3, 7)], "doc_id long, quality int")
    docs = odd.drop("quality")
    model = linecrf.train(docs, labels)
    got = linecrf.scored(docs, model).collect()
    assert len(got) == 11 and all(0 <= r.quality <= 1 for r in got) and linecrf.scored(none.drop("quality"), model).count() == 0
    assert len({r.quality for r in linecrf.scored(docs, linecrf.train(docs, labels.filter("quality = 1"))).collect()}) == 1
    assert {r.quality for r in linecrf.scored(docs, linecrf.train(docs, labels.filter("false"))).collect()} == {0.5}
    assert linecrf.scored(docs, linecrf.train(none, labels)).count() == 11
    found = Counter(r.doc_id for r in linecrf.line_labels(odd, model).collect())
    assert found == {4: 1, 5: 2, 6: 1, None: 1, 8: 1, 9: 1, 10: 3}


def test_good_and_bad_lines_of_one_text_are_told_apart(spark):
    sf = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    model = linecrf.train(docs, labels)
    held = docs.join(labels, "doc_id").filter("crc32(cast(cast(doc_id as string) as binary)) % 4 = 2 and text like '%\n%\n%'").orderBy("doc_id").collect()
    right = []
    for good, bad in zip([r.text for r in held if r.quality == 1], [r.text for r in held if r.quality == 0], strict=False):
        for first, second, good_first in ((good, bad, True), (bad, good, False)):
            some, p = model.lines([first + "\n" + second])
            right += (((some.number <= first.count("\n")) == good_first) == (p > 0.5)).tolist()
    assert len(right) > 40 and np.mean(right) > 0.85


# 12


def test_whitening_equals_numpy(spark, sf):
    for table in (spark.read.parquet(f"{sf}/embeddings.parquet"), odd_vectors(spark)):
        rows = [r for r in table.collect() if r.embedding is not None and all(v is not None and np.isfinite(v) for v in r.embedding)]
        d = max(len(r.embedding) for r in rows)
        x = np.array([[int(np.floor(256 * v)) for v in r.embedding] + [0] * (d - len(r.embedding)) for r in rows], np.int64)
        fit = np.unique(x, axis=0)
        n, s = len(fit), fit.sum(0)
        e, v = np.linalg.eigh(np.cov(fit.T, bias=True))
        e, v = e[::-1][:4], v[:, ::-1][:, :4]
        want = (x - s / n) @ v / np.sqrt(e)
        want *= np.sign(v[np.abs(v).argmax(0), range(4)])
        got = whitening.whiten(table).collect()
        assert {(r.n, r.identity_error < 1e-9) for r in got} == {(n, True)}
        assert sorted((str(r.vec_id), r.component, r.deviation, round(r.whitened, 7), round(r.explained, 9)) for r in got) == sorted(
            (str(r.vec_id), k + 1, int(((n * a - s) ** 2).sum()), round(float(w[k]) + 0.0, 7), round(float(e[k] / np.trace(np.cov(fit.T, bias=True))), 9)) for r, a, w in zip(rows, x, want, strict=True) for k in range(4)
        )


def test_whitening_of_flat_large_and_empty_tables(spark):
    one = vectors(spark, [(1, [1.0, 2.0], 0), (2, [1.0, 2.0], 0)])
    got = whitening.whiten(one).collect()
    assert [(r.whitened, r.explained, r.identity_error, r.deviation, r.n) for r in got] == [(0.0, 0.0, 0.0, 0, 1)] * 4
    line = whitening.whiten(vectors(spark, [(k, [float(k), 0.0], 0) for k in range(5)])).filter("component = 2").collect()
    assert all(r.whitened == 0 and r.identity_error < 1e-9 for r in line)
    huge = {r.vec_id: r.deviation for r in whitening.whiten(vectors(spark, [(k, [k * 1e8, 0.0], 0) for k in (-1, 0, 1, 2)])).collect()}
    assert huge[2] is None and whitening.whiten(one.filter("false")).count() == 0 and whitening.whiten(vectors(spark, [(1, [], 0), (2, None, 0)])).count() == 0


def test_scatter_is_the_same_in_many_splits(spark, monkeypatch):
    monkeypatch.setattr(whitening, "_ROWS", 7)
    monkeypatch.setattr(whitening, "_COLUMNS", 3)
    monkeypatch.setattr(whitening, "_BLOCKS", 2)
    table = vectors(spark, [(k, [float(v) for v in np.random.default_rng(k).normal(size=8)], 0) for k in range(100)])
    got = whitening.whiten(table)
    assert got.count() == 400 and got.first().identity_error < 1e-9


# 13


def brute(rows, every=50, most=5, first=3):
    rows = [r for r in rows if r.vec_id is not None and r.label is not None and r.embedding is not None and all(v is not None and np.isfinite(v) for v in r.embedding)]
    d = max((len(r.embedding) for r in rows), default=0)
    x = np.array([[int(np.floor(256 * v)) for v in r.embedding] + [0] * (d - len(r.embedding)) for r in rows], np.int64).reshape(len(rows), d)
    ids = [r.vec_id for r in rows]
    label = [(r.label + 1) % 10 if r.vec_id % 7 == 0 else r.label for r in rows]
    out = Counter()
    for i in (i for i, k in enumerate(ids) if k % every == 0):
        s = (x @ x[i]).tolist()
        order = sorted(range(len(ids)), key=lambda j: (-s[j], ids[j]))
        for p in [j for j in order if j != i and label[j] == label[i]][:most]:
            fits = [j for j in order if label[j] != label[i] and 50 * s[p] <= 100 * s[j] <= 95 * s[p]][:first]
            out.update((ids[i], ids[p], k + 1, ids[j], s[p], s[j]) for k, j in enumerate(fits))
    return out


def mined(df):
    return Counter((r.anchor_id, r.positive_id, r.rank, r.negative_id, r.positive_score, r.negative_score) for r in df.collect())


def test_curve_visits_all_cells_step_by_step():
    for d, bits in ((2, 3), (3, 2), (4, 2), (1, 4)):
        cells = np.array(list(itertools.product(range(2**bits), repeat=d)))
        keys = hardneg.curve_keys(cells, bits)
        assert sorted(keys) == list(range(2 ** (bits * d))) and (np.abs(np.diff(cells[np.argsort(keys)], axis=0)).sum(1) == 1).all()


def test_hard_negatives_equal_brute_force(spark, monkeypatch):
    small = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet")
    odd = odd_vectors(spark)
    assert mined(hardneg.hard_negatives(odd)) == brute(odd.collect()) and mined(hardneg.hard_negatives(odd.filter("false"))) == Counter()
    for name, value in {"BLOCK": 16, "RANGE": 64, "PACK": 4, "_CHUNK": 3}.items():
        monkeypatch.setattr(hardneg, name, value)
    for table, every in ((odd, 10), (small, 50)):
        assert mined(hardneg.hard_negatives(table, every)) == brute(table.collect(), every)


def test_bounds_hold_and_skip_blocks_of_clustered_vectors(spark, monkeypatch):
    r = np.random.default_rng(5)
    a = r.integers(-300, 300, (40, 6))
    b = r.integers(-300, 300, (30, 10, 6))
    least, most = hardneg.bounds(a, b.min(1), b.max(1))
    scores = np.einsum("ad,bnd->abn", a, b)
    assert (least <= scores.min(2)).all() and (scores.max(2) <= most).all()
    monkeypatch.setattr(hardneg, "BLOCK", 32)
    centres = r.normal(size=(24, 4)) * 3
    rows = [(k, [float(v) for v in centres[k % 24] + r.normal(size=4) * 0.05], (k % 24) // 6) for k in range(2400)]
    table = vectors(spark, rows)
    met = []
    inner = hardneg.needed
    monkeypatch.setattr(hardneg, "needed", lambda *args: met.append((inner(*args), args[1].count(), args[0])) or met[-1][0])
    assert mined(hardneg.hard_negatives(table)) == brute(table.collect())
    for needs, blocks, packs in met:
        anchors = packs.agg(F.sum("n")).first()[0]
        read = sum(bin(int.from_bytes(bytes(x.who), "big")).count("1") for x in needs.collect())
        assert read < 0.6 * anchors * blocks


def test_large_products_are_exact_or_raise(spark):
    big = vectors(spark, [(k * 50, [1e5 + k, -1e5, 3.5], k % 2) for k in range(8)])
    assert mined(hardneg.hard_negatives(big)) == brute(big.collect())
    with pytest.raises(Exception, match="beyond 32 bits"):
        hardneg.hard_negatives(vectors(spark, [(0, [1e9], 1), (1, [1.0], 1)])).collect()
