"""Eigenvectors and layouts of neighbour graphs against plain versions and planted groups."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from cytoloom.operators import layouts as L
from cytoloom.operators.vectors import nearest_vectors


def points(groups=3, size=40, seed=1, spread=8.0):
    rng = np.random.default_rng(seed)
    of = np.repeat(np.arange(groups), size)
    return of, spread * rng.normal(size=(groups, 10))[of] / 3 + rng.normal(size=(len(of), 10))


def near(spark, x, k):
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "cell_id long, v array<double>")
    return nearest_vectors(df, k).select("src", "dst", "rank", F.sqrt("d2").alias("dist")).cache()


def plain_near(x, k):
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(axis=2))
    np.fill_diagonal(d, np.inf)
    order = np.argsort(d, axis=1, kind="stable")[:, :k]
    return order, np.take_along_axis(d, order, axis=1)


def test_eigenvectors(spark):
    _, x = points(spread=2.0)
    order, dist = plain_near(x, 8)
    w = np.zeros((len(x), len(x)))
    w[np.arange(len(x))[:, None], order] = np.exp(-dist / dist[:, -1:])
    w = (w + w.T) / 2
    a = w / np.sqrt(np.outer(w.sum(axis=1), w.sum(axis=1)))
    values, vectors = np.linalg.eigh(a)
    lead = np.argsort(-np.abs(values))[:3]
    edges = near(spark, x, 8)
    found, lam, residuals = L.spectral_vectors(L.distance_weights(edges), 3, degree=16)
    assert np.allclose(lam, values[lead], atol=1e-9) and max(residuals) < 1e-6
    ours = np.array([r["vector"] for r in found.orderBy("node").collect()])
    assert np.abs(a @ ours - ours * lam).max() < 1e-6
    for k in range(3):
        assert abs(ours[:, k] @ vectors[:, lead[k]]) == pytest.approx(1, abs=1e-6)
    assert np.allclose(np.abs(ours[:, 0]), np.sqrt(w.sum(axis=1) / w.sum()), atol=1e-6)


def test_fuzzy_weights(spark):
    _, x = points(2, 25)
    x[7] = x[8]  # a distance of 0
    order, dist = plain_near(x, 6)
    w = np.zeros((50, 50))
    for i in range(50):
        rho = dist[i][dist[i] > 0].min()
        lo, hi = 1e-9, 1e9
        for _ in range(200):
            mid = (lo + hi) / 2
            lo, hi = (lo, mid) if np.exp(-np.maximum(0, dist[i] - rho) / mid).sum() > np.log2(6) else (mid, hi)
        w[i, order[i]] = np.exp(-np.maximum(0, dist[i] - rho) / mid)
    w = w + w.T - w * w.T
    found = {(r["src"], r["dst"]): r["w"] for r in L.fuzzy_weights(near(spark, x, 6), 6).collect()}
    assert set(found) == {(i, j) for i in range(50) for j in range(i + 1, 50) if w[i, j] > 0}
    assert all(v == pytest.approx(w[k], abs=1e-6) for k, v in found.items())


def test_layout_keeps_planted_groups(spark):
    of, x = points(3, 30)
    edges = near(spark, x, 8)
    rng = np.random.default_rng(4)
    start = spark.createDataFrame([(i, *map(float, p)) for i, p in enumerate(x[:, :2] + 0.1 * rng.normal(size=(90, 2)))], "node long, x double, y double")
    run = lambda rounds: np.array([[r["x"], r["y"]] for r in L.neighbour_layout(edges, 8, rounds=rounds, start=start).orderBy("node").collect()])
    assert np.allclose(run(2), run(2), atol=1e-6)
    places = run(20)
    middle = np.array([places[of == g].mean(axis=0) for g in range(3)])
    assert (((places[:, None] - middle[None]) ** 2).sum(axis=2).argmin(axis=1) == of).mean() > 0.95
    ranked = lambda z: spark.createDataFrame([(i, int(j), r) for i, row in enumerate(plain_near(z, 89)[0]) for r, j in enumerate(row, 1)], "src long, dst long, rank int")
    assert L.trustworthiness(ranked(x), ranked(places), 90, 8).first()["trust"] > 0.85


def test_curve_of_distances():
    d = np.linspace(0.01, 3, 300)
    for low in (0.1, 0.3, 0.5):
        a, b = L.curve_of(low)
        assert np.abs(1 / (1 + a * d ** (2 * b)) - np.where(d < low, 1, np.exp(-(d - low)))).max() < 0.15


def test_numbers_are_dense(spark):
    assert sorted(r["number"] for r in L.numbered(spark.range(500).withColumnRenamed("id", "node")).collect()) == list(range(500))


def test_rounds_carry_two_blocks_of_the_basis(spark, monkeypatch):
    """The basis is written once in a cycle, not once in a round, so what is written and sent grows with the degree, not its square."""
    _, x = points(2, 20)
    written, real = [], L.materialize
    monkeypatch.setattr(L, "materialize", lambda df: written.append(df.columns) or real(df))
    L.spectral_vectors(L.distance_weights(near(spark, x, 5)), 3, degree=5, cycles=1)
    assert sum("basis" in c for c in written) == 1
    assert sum(c == ["node", "cur", "prev"] for c in written) == 6


def test_rounds_send_pieces_not_edges(spark, monkeypatch):
    """A round's rows are pieces of many nodes; a search is read from a table, once; squares of the matrix give what the whole one gives."""
    _, x = points(3, 40, spread=2.0)
    edges = near(spark, x, 8)
    written, real = [], L.materialize
    monkeypatch.setattr(L, "materialize", lambda df: written.append((df.columns, real(df))) or written[-1][1])
    whole = L.spectral_layout(edges, degree=16).orderBy("node").collect()
    assert written[0][0] == edges.columns
    rounds = lambda: [df.count() for c, df in written if c == ["node", "cur", "prev"]]
    assert set(rounds()) == {1}
    written.clear()
    cut = L.spectral_layout(edges, degree=16, piece=8, most=24).orderBy("node").collect()
    assert set(rounds()) == {15} and max(df.count() for c, df in written if "columns" in c) == 25
    assert [r["node"] for r in cut] == [r["node"] for r in whole] == list(range(120))
    assert np.allclose([r[1:] for r in cut], [r[1:] for r in whole], atol=1e-6)
