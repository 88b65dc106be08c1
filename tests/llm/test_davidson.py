import math

import numpy as np
import pytest

from tabloom.llm import davidson

SCHEMA = "vec_id long, embedding array<float>, id string, component int, n string, x binary"


def brute(rows, components=16):
    """Eigenvectors of the covariance formed in full, from exact whole numbers."""
    kept = [(i, [math.floor(64 * float(np.float32(c))) + 1_000_000 for c in v]) for i, v in rows if v and all(c is not None and math.isfinite(c) for c in v)]
    fit = sorted({tuple(x) for _, x in kept})
    n, sums = len(fit), [sum(c) for c in zip(*fit)]
    centred = np.array([[(n * c - s) / n for c, s in zip(x, sums)] for x in fit])
    values, vectors = np.linalg.eigh(centred.T @ centred / n)
    values, vectors = values[::-1][:components], vectors[:, ::-1][:, :components]
    rows_ = {}
    for i, x in kept:
        apart = [n * c - s for c, s in zip(x, sums)]
        rows_[i] = (sum(a * a for a in apart), np.array(apart) / n @ vectors / np.sqrt(values))
    return n, values, np.trace(centred.T @ centred / n), rows_


def check(spark, rows):
    table = spark.createDataFrame([(i, v, "a", 7, "b", b"c") for i, v in rows], SCHEMA).repartition(3)
    got = davidson.whiten(table).collect()
    n, values, trace, want = brute(rows)
    components = min(16, len(values))
    assert len(got) == components * len([1 for i, _ in rows if i in want])
    sign = {}
    for r in got:
        deviation, white = want[r.vec_id]
        w = white[r.component - 1]
        if abs(w) > 0.3:
            assert sign.setdefault(r.component, w * r.whitened > 0) == (w * r.whitened > 0)
        assert (r.n, r.deviation) == (n, deviation)
        assert abs(r.whitened) == pytest.approx(abs(w), rel=1e-7, abs=1e-7)
        assert r.explained == pytest.approx(values[r.component - 1] / trace, rel=1e-10)
        assert r.identity_error < 1e-9
    assert len({r.identity_error for r in got}) == 1


def test_against_the_whole_covariance(spark):
    random = np.random.default_rng(8)
    mix = random.normal(size=(24, 24)) * np.linspace(3, 0.2, 24)
    rows = [(i, (random.normal(size=24) @ mix + 5).tolist()) for i in range(300)]
    rows += [(1000 + i, rows[i][1]) for i in range(60)]
    odd = [(-1, None), (-2, []), (-3, [None] + [1.0] * 23), (-4, [math.nan] * 24), (-5, [1.0] * 23 + [-math.inf]), (-6, [0.0] * 24), (None, [2.0] * 24)]
    check(spark, rows + odd)


def test_given_embeddings(spark):
    table = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet")
    check(spark, [(r.vec_id, r.embedding) for r in table.collect()])


def test_few_dimensions_and_equal_vectors(spark):
    random = np.random.default_rng(2)
    check(spark, [(i, random.normal(size=3).tolist()) for i in range(30)])
    for rows in ([], [(1, [1.0, 2.0])], [(1, [1.0, 2.0]), (2, [1.0, 2.0])], [(1, None)]):
        out = davidson.whiten(spark.createDataFrame([(i, v, "a", 7, "b", b"c") for i, v in rows], SCHEMA))
        assert out.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
        assert out.count() == 0


def test_lengths_ranks_and_large_values(spark):
    rows = [(1, [1.0, 2.0, 0.0]), (2, [2.0, 4.0, 0.0]), (3, [4.0, 8.0, 0.0]), (4, [1.0, 2.0]), (5, [1e30, 0.0, 0.0])]
    got = davidson.whiten(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    # One direction only; another length and what is too large for whole numbers are left out.
    assert sorted((r.vec_id, r.component) for r in got) == [(1, 1), (2, 1), (3, 1)]
    assert got[0].explained == pytest.approx(1.0)


@pytest.mark.parametrize("values", [np.geomspace(1e6, 1, 200), np.repeat([9.0, 8.999999, 1.0], [3, 3, 150]), np.linspace(2, 1, 120)])
def test_eigenpairs_of_wide_and_crowded_spectra(values):
    turn, _ = np.linalg.qr(np.random.default_rng(3).normal(size=(len(values), len(values))))
    v = (turn * values) @ turn.T
    calls = []

    def product(block):
        calls.append(block.shape[1])
        return v @ block

    found, vectors = davidson.leading(product, len(values))
    assert found == pytest.approx(np.sort(values)[::-1][:16], rel=1e-12)
    assert np.linalg.norm(v @ vectors - vectors * found, axis=0).max() < 1e-12 * values.max()
    assert np.abs(vectors.T @ vectors - np.eye(16)).max() < 1e-12


def test_minres_solves():
    random = np.random.default_rng(6)
    a = random.normal(size=(12, 12))
    a = a + a.T
    b = random.normal(size=(12, 4))
    b[:, 2] = 0
    x = davidson.minres(lambda t: a @ t, b, 40)
    assert np.abs(a @ x - b).max() < 1e-6
