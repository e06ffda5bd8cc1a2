"""Operators against plain versions on small tables."""

import math
import random

import pytest

from cytoloom.operators import gates as G
from cytoloom.operators import interactions as I
from cytoloom.operators import neighbors as N

SCHEMA = "cell_id long, sample_id int, x double, y double, celltype string"


def some_cells(n=150):
    rng = random.Random(8)
    return [(i, i % 2, rng.uniform(0, 50), rng.uniform(-20, 20), rng.choice("abc")) for i in range(n)]


def test_ring_correlation(spark):
    rows = some_cells()
    out = I.ring_correlation(spark.createDataFrame(rows, SCHEMA), 6.0, 5).collect()
    assert len(out) == 2 * 9 * 5
    for r in out:
        own = [c for c in rows if c[1] == r["sample_id"]]
        w, h = (max(c[k] for c in own) - min(c[k] for c in own) for k in (2, 3))
        a, b = ([c for c in own if c[4] == t] for t in (r["ref"], r["query"]))
        seen = sum(p[0] != q[0] and math.floor(math.dist(p[2:4], q[2:4]) / 1.2) == r["step"] for p in a for q in b)
        mid, pi = (r["step"] + 0.5) * 1.2, math.pi
        overlap = w * h - 2 * mid * (w + h) / pi + mid * mid / pi
        partners = len(b) - (r["ref"] == r["query"])
        expected = len(a) * partners * pi * 1.44 * (2 * r["step"] + 1) * overlap / (w * h) ** 2
        assert r["g"] == pytest.approx(seen / expected)


def test_radius_is_inclusive_and_annulus_is_not(spark):
    cells = spark.createDataFrame([(1, 0, 0.0, 0.0, "a"), (2, 0, 3.0, 4.0, "b"), (3, 0, None, 1.0, "b")], SCHEMA)
    assert sorted((r["src"], r["dst"]) for r in N.neighbors_within(cells, 5.0).collect()) == [(1, 1), (1, 2), (2, 1), (2, 2)]
    assert N.neighbors_within(cells, 5.0, 1.0).count() == 0 and N.neighbors_within(cells, 5.1, 5.0).count() == 0
    assert N.neighbors_within(cells, 5.1, 4.9).count() == 2


def test_gates_refuse_unknown_columns(spark):
    cells = spark.createDataFrame(some_cells(5), SCHEMA)
    with pytest.raises(ValueError, match="nothing"):
        G.replay_gates(cells, G.gates_from_json('{"g": {"x_var": "nothing", "y_var": "y", "threshold_xmin": 0, "threshold_xmax": 1}}'))
    with pytest.raises(ValueError):
        G.in_polygon(cells["x"], cells["y"], [(0, 0), (1, 1)])
