import numpy as np
from pyspark.sql import functions as F

from cytoloom.llm.topk_search import top_k_search


def brute(rows, k):
    good = [(i, np.floor(256 * np.array(v, float)).astype(int)) for i, v in rows if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    out = []
    for q, a in good:
        if q % 50 == 0:
            best = sorted((-int(a @ b), i) for i, b in good if i != q)[:k]
            out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(best)]
    return sorted(out)


def run(spark, rows, **how):
    df = spark.createDataFrame([(i, None if v is None else [None if x is None else float(x) for x in v], "x") for i, v in rows], "vec_id long, embedding array<float>, rank string")
    return sorted(tuple(r) for r in top_k_search(df, F.col("vec_id") % 50 == 0, k=5, **how).collect())


def test_against_brute_force_with_ties_and_bad_vectors(spark):
    rng = np.random.default_rng(5)
    rows = [(i, rng.normal(size=8).astype(np.float32)) for i in range(900)]
    rows += [(1000 + i, np.float32(rows[0][1])) for i in range(400)]  # a third of all are equal
    rows += [(2000, None), (2001, [float("nan")] * 8), (2002, [None] + [0.1] * 7), (2003, [float("inf")] * 8), (None, rows[3][1])]
    assert run(spark, rows, cells=8, block_rows=100, sample=64) == brute(rows, 5)


def test_fewer_candidates_than_k(spark):
    rows = [(0, [1.0, 2.0]), (1, [0.5, 0.5]), (50, [0.5, 0.5])]
    assert run(spark, rows) == brute(rows, 5)


def test_empty_and_repeated_rows(spark):
    assert run(spark, []) == [] and run(spark, [(0, None)]) == []
    assert [r[:3] for r in run(spark, [(0, [1.0]), (1, [1.0]), (1, [1.0])])] == [(0, 1, 1), (0, 2, 1)]
