"""Near-duplicate vectors against all pairs."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from cytoloom.llm.embedding_dedup import Quantised, least_members, near_duplicates, units


def plain(rows, threshold):
    """(vec_id, n_links, component_id, kept) by comparing all pairs."""
    ok = lambda v: v is not None and len(v) and all(x is not None and np.isfinite(x) for x in v) and any(v)
    links = {k: set() for k in range(len(rows))}
    for a, (_, u, la) in enumerate(rows):
        for b, (_, w, lb) in enumerate(rows[:a]):
            if la is not None and la == lb and ok(u) and ok(w) and len(u) == len(w):
                u_, w_ = np.array(u, float), np.array(w, float)
                if u_ @ w_ / np.sqrt((u_ @ u_) * (w_ @ w_)) >= threshold:
                    links[a].add(b)
                    links[b].add(a)
    out = []
    for k, (i, _, _) in enumerate(rows):
        seen, todo = {k}, [k]
        while todo:
            new = links[todo.pop()] - seen
            seen |= new
            todo += new
        ids = [rows[j][0] for j in seen if rows[j][0] is not None]
        low = min(ids) if ids else None
        out.append((i, len(links[k]), low, low is None or i == low))
    return sorted(map(str, out))


def ours(df, **options):
    return sorted(str(tuple(r)) for r in near_duplicates(df, **options).select("vec_id", "n_links", "component_id", "kept").collect())


@pytest.mark.parametrize("kind", ["double", "float"])
@pytest.mark.parametrize("options", [{}, {"block_rows": 7, "cells": 6}, {"block_rows": 20, "cells": 40, "sample": 50}])
def test_agrees_with_all_pairs(spark, kind, options):
    rng = np.random.default_rng(3)
    centers = rng.normal(size=(25, 12))
    at = centers[rng.integers(0, 25, 260)] + rng.choice([0, 0.05, 0.12, 0.2], 260)[:, None] * rng.normal(size=(260, 12))
    at[200:230] = at[5]  # copies
    at[230:240] *= 1e-3
    vectors = at.astype(np.float32).astype(float).tolist()
    rows = [(k * 7 % 1000, v, k % 3 if k % 40 else None) for k, v in enumerate(vectors)]
    df = spark.createDataFrame(rows, f"vec_id long, embedding array<{kind}>, label int").repartition(3)
    assert ours(df, threshold=0.98, **options) == plain(rows, 0.98)


def test_edge_rows(spark):
    rows = [
        (1, [1.0, 0.0], "a"), (2, [1.0, 0.01], "a"), (2, [1.0, 0.01], "a"), (2, [0.0, 1.0], "a"), (None, [1.0, 0.02], "a"), (None, [-1.0, 0.0], "a"), (None, [5.0, 5.0], "a"), (None, [5.0, 5.0], "a"),
        (3, [1.0, 0.0], "b"), (4, None, "a"), (5, [], "a"), (6, [0.0, 0.0], "a"), (7, [float("nan"), 1.0], "a"), (8, [float("inf"), 1.0], "a"), (9, [1.0, None], "a"),
        (10, [1.0, 0.0, 0.0], "a"), (11, [1e300, 1e298], "a"), (12, [1e-300, 0.0], "a"), (13, [1.0, 0.0], None), (14, [-0.0, 2.0], "a"), (-5, [0.0, 2.0], "a"),
    ]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label string").withColumns({c: F.lit("own") for c in ("id", "tie", "m", "dim", "n_links")})
    rows = [(i, [x and x * (1e-150 if abs(x) > 1e200 else 1e150 if abs(x) < 1e-200 else 1) for x in v] if v else v, lab) for i, v, lab in rows]
    assert ours(df) == plain(rows, 0.98)
    assert near_duplicates(df.limit(0)).isEmpty()


def test_bounds_hold():
    rng = np.random.default_rng(1)
    for dim in (1, 3, 64, 2500):
        x = units(rng.normal(size=(50, dim)) * rng.exponential(size=(50, dim)) ** 4)
        q = Quantised(x)
        assert (q.bounds(q) >= x @ x.T).all()
        assert dim != 64 or (q.bounds(q) - x @ x.T).max() < 0.1


def test_least_members():
    rng = np.random.default_rng(2)
    i, j = rng.integers(0, 300, (2, 200))
    root = least_members(300, i, j)
    assert (root[i] == root[j]).all() and (root[root] == root).all()
    chain = np.arange(299)
    assert (least_members(300, chain, chain + 1) == 0).all()
