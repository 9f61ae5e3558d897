"""Whitening against a plain twin, and eigenvectors of hard matrices."""

import numpy as np
import pytest
from fractions import Fraction

from tests.llm.helpers import read
from tillscope.llm import whitening
from tillscope.llm.queries import QUERIES

SCHEMA = "vec_id long, embedding array<float>, label int, w string, d string, component string, n string"


def vectors(spark, rows):
    return spark.createDataFrame([(i, v, 0, "w", "d", "c", "n") for i, v in rows], SCHEMA).repartition(3)


def twin(rows):
    """n, S, exact deviations and the covariance by plain rational numbers."""
    x = [[int(np.floor(1024 * float(np.float32(c)))) + 100000 for c in v] for _, v in rows]
    n, d = len(x), len(x[0])
    s = [sum(r[i] for r in x) for i in range(d)]
    dev = [sum((n * r[i] - s[i]) ** 2 for i in range(d)) for r in x]
    cov = [[float(Fraction(sum((n * r[i] - s[i]) * (n * r[j] - s[j]) for r in x), n**3)) for j in range(d)] for i in range(d)]
    return n, s, dev, np.array(cov), np.array([[float(Fraction(n * r[i] - s[i], n)) for i in range(d)] for r in x])


def test_whitening_equals_plain_twin(spark):
    r = np.random.default_rng(3)
    mix = r.normal(size=(10, 10))
    rows = [(i, [float(c) for c in (r.normal(size=10) @ mix).astype(np.float32)]) for i in range(200)]
    rows += [(7, rows[7][1]), (None, rows[9][1])]
    junk = [(900, None), (901, [1.0, None] * 5), (902, [float("nan")] * 10), (903, [float("inf")] * 10), (904, []), (905, [1e37] * 10)]
    got = whitening.whiten(spark, vectors(spark, rows + junk)).collect()
    n, s, dev, cov, centred = twin(rows)
    assert len(got) == 8 * n and {g.n for g in got} == {n}
    value, vec = np.linalg.eigh(cov)
    value, vec = value[::-1], vec[:, ::-1]
    want = {}
    for (i, _), t, z in zip(rows, dev, centred):
        want.setdefault(i, []).append((t, z))
    signs = {}
    for g in got:
        j = g.component - 1
        assert g.deviation in [t for t, _ in want[g.vec_id]] and int(g.deviation_exact) == g.deviation
        options = [z @ vec[:, j] / np.sqrt(value[j]) for t, z in want[g.vec_id] if t == g.deviation]
        assert any(abs(abs(g.whitened) - abs(o)) < 1e-8 for o in options)
        signs.setdefault(j, set()).update(np.sign(g.whitened * o) for o in options[:1] if abs(o) > 1e-6)
        assert abs(g.explained / (value[j] / value.sum()) - 1) < 1e-9 and g.identity_error < 1e-9
    assert all(len(x) == 1 for x in signs.values())


def test_lengths_apart_and_odd_tables(spark):
    r = np.random.default_rng(4)
    two = [(i, [float(a), float(b)]) for i, (a, b) in enumerate(r.normal(size=(30, 2)))]
    flat = [(100 + i, [1.0, 2.0, 3.0]) for i in range(5)]
    line = [(200 + i, [float(i), 2.0 * i, 0.0, 0.0]) for i in range(9)]
    got = whitening.whiten(spark, vectors(spark, two + flat + line)).collect()
    by = {}
    for g in got:
        by.setdefault(g.vec_id, []).append(g)
    assert all(len(by[i]) == 2 and by[i][0].n == 30 for i, _ in two)
    assert all(g.whitened is None and g.explained is None and g.deviation == 0 and g.identity_error is None for i, _ in flat for g in by[i])
    for i, _ in line:
        assert sorted((g.component, g.whitened is None) for g in by[i]) == [(1, False), (2, True), (3, True), (4, True)]
        assert abs(by[i][0].identity_error) < 1e-9
    assert whitening.whiten(spark, vectors(spark, [])).count() == 0
    assert whitening.whiten(spark, vectors(spark, [(1, None)])).count() == 0


def test_wide_numbers_stay_exact(spark):
    rows = [(i, [float(np.float32(2.0**40 * i)), float(i), -float(np.float32(3e15))]) for i in range(12)]
    got = whitening.whiten(spark, vectors(spark, rows), k=2).collect()
    n, s, dev, _, _ = twin(rows)
    want = dict(zip((i for i, _ in rows), dev))
    assert all(int(g.deviation_exact) == want[g.vec_id] for g in got)
    assert all((g.deviation is None) == (want[g.vec_id] >= 2**63) for g in got)


@pytest.mark.parametrize("gaps", [[1e-1, 1e-2], [1e-6, 1e-9], [1e-12, 1e-13], [0.0, 0.0]])
def test_refinement_separates_clusters(gaps):
    """Values 1, 1 + g, 1 + g + h, 2, 2 + g, 5: residual, orthonormality, and the
    subspace of each value that double precision can tell apart."""
    r = np.random.default_rng(8)
    q = np.linalg.qr(r.normal(size=(24, 24)))[0].astype(np.longdouble)
    for _ in range(3):  # orthonormal in extended precision
        q = q + q @ ((np.eye(24) - q.T @ q) / 2)
    g, h = gaps
    value = np.array([1, 1 + g, 1 + g + h, 2, 2 + g, 5, *np.linspace(6, 60, 18)], np.longdouble)
    a = (q * value) @ q.T
    a = (a + a.T) / 2
    got, x = whitening.eigen(a)
    assert float(np.abs(x.T @ x - np.eye(24)).max()) < 1e-16
    assert float(np.abs(a @ x - x * got).max()) < 1e-15 * 60
    assert float(np.abs(np.sort(got) - np.sort(value)).max()) < 1e-15 * 60
    back = x[:, ::-1]
    for j in range(24):
        near = np.abs(value - value[j])
        if np.sort(near)[1] > 1e-10:
            assert abs(abs(float(back[:, j] @ q[:, j])) - 1) < 1e-12
            assert min(float(np.abs(back[:, j] - q[:, j]).max()), float(np.abs(back[:, j] + q[:, j]).max())) < 1e-15 / float(np.sort(near)[1]) * 10 + 1e-15


def test_single_precision_start_is_corrected():
    r = np.random.default_rng(9)
    b = r.normal(size=(64, 200))
    a = (b @ b.T).astype(np.longdouble)
    start = np.linalg.eigh(a.astype(np.float32))[1]
    value, x = whitening.refine(a.astype(np.float64), start)
    assert np.abs(x.T @ x - np.eye(64)).max() < 1e-14
    assert np.abs(start.T.astype(float) @ start - np.eye(64)).max() > 1e-8
    assert np.abs(a @ x - x * value).max() < 1e-11


def test_whole_table(spark):
    folder = "/root/testdata/sf0.01"
    rows = [(r.vec_id, list(r.embedding)) for r in read(spark, folder, "embeddings").collect()]
    n, s, dev, cov, centred = twin(rows)
    value, vec = np.linalg.eigh(cov)
    got = QUERIES["op11_mixed_precision_whitening"](spark, folder).toPandas()
    assert len(got) == 8 * n and got.identity_error.max() < 1e-4 and got.identity_error.nunique() == 1
    wide = got.pivot(index="vec_id", columns="component", values="whitened").loc[[i for i, _ in rows]].to_numpy()
    want = centred @ vec[:, ::-1][:, :8] / np.sqrt(value[::-1][:8])
    sign = np.sign((wide * want).sum(0))
    assert np.abs(wide * sign - want).max() < 1e-7
    assert dict(zip(got.vec_id, got.deviation)) == dict(zip((i for i, _ in rows), dev))
