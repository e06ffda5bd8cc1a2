"""Right answers, and work that stays bounded, on skewed values, far cells, mixed files and split files."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from cytoloom.functions import percentiles as P
from cytoloom.functions import stats as S
from cytoloom.operators import neighbors as N
from cytoloom.sources import tables as T


def test_ranges_hold_their_share_of_skewed_values(spark):
    rng = random.Random(4)
    values = [rng.lognormvariate(0, 3) for _ in range(5000)] + [1e9]
    df = spark.createDataFrame([("k", v) for v in values], "key string, v double")
    counts = df.groupBy("key", "v").agg(F.count("*").alias("n"))
    cuts = counts.agg(F.percentile_approx("v", [k / 64 for k in range(1, 64)], 3200)).first()[0]
    sizes = np.histogram(values, [-math.inf, *[np.nextafter(c, math.inf) for c in sorted(set(cuts))], math.inf])[0]
    assert sizes.max() < 2 * len(values) / 64
    below = {r["v"]: r["below"] for r in P.placed_values(counts, ["key"], 64).collect()}
    assert [below[v] for v in sorted(values)] == list(range(len(values)))
    r = P.percentiles(df, ["key"], "v", {"mid": 0.5, "high": 0.99}).first()
    assert r["mid"] == pytest.approx(np.percentile(values, 50)) and r["high"] == pytest.approx(np.percentile(values, 99))
    whole = P.percentiles(df, [], "v", {"low": 0.1}).first()
    assert whole["low"] == pytest.approx(np.percentile(values, 10))


def test_a_far_cell_and_dense_clusters_leave_squares_small(spark, monkeypatch):
    rng = random.Random(6)
    rows = [(k, rng.uniform(0, 1000), rng.uniform(0, 1000), "t") for k in range(800)]
    rows += [(1000 + k, 5e6 + rng.uniform(0, 1), rng.uniform(0, 1), "t") for k in range(400)]
    rows += [(9000, 1e9, -1e9, "t")]
    cells = spark.createDataFrame(rows, "cell_id long, x double, y double, celltype string")
    seen, real = [], N._squares
    monkeypatch.setattr(N, "_squares", lambda *a: seen.append(real(*a)) or seen[-1])
    found = {}
    for r in N.knn_edges(cells, 3).collect():
        found.setdefault(r["src"], []).append((r["rank"], r["dst"]))
    at = {r[0]: r[1:3] for r in rows}
    for i, (x, y) in at.items():
        near = sorted((math.dist((x, y), at[j]), j) for j in at if j != i)[:3]
        assert [j for _, j in sorted(found[i])] == [j for _, j in near]
    full = seen[-1].groupBy("gx", "gy").count().agg(F.max("count")).first()[0]
    assert full <= 100


@pytest.mark.parametrize("c, w, n, d", [(250_000_400, 500_000_000, 10**9, 500_000_000), (249_990_000, 500_000_000, 10**9, 500_000_000), (30, 1000, 10**9, 10**7), (0, 5, 10**9, 10**9)])
def test_hypergeometric_tail_of_large_numbers(spark, c, w, n, d):
    r = spark.createDataFrame([(c, w, n, d)], "c long, w long, n long, d long").select(S.upper_hypergeometric("c", "w", "n", "d").alias("p")).first()["p"]
    mean, var = d * w / n, d * w / n * (1 - w / n) * (n - d) / (n - 1)
    if var > 100:  # the normal tail with continuity correction
        assert r == pytest.approx(0.5 * math.erfc((c - 0.5 - mean) / math.sqrt(2 * var)), rel=1e-2)
    elif c:  # nearly binomial
        assert r == pytest.approx(sum(math.comb(w, k) * (d / n) ** k * (1 - d / n) ** (w - k) for k in range(c, 60)), rel=1e-3)
    else:
        assert r == 1


def test_folders_of_mixed_files(spark, tmp_path):
    (tmp_path / "a b").mkdir()
    (tmp_path / "a b" / "one.csv").write_text("name,k\nx,1\n")
    (tmp_path / "two.csv").write_text("k,name\n2,y\n")
    (tmp_path / "three.csv").write_text("﻿name;k;more\nz;2.5;q\n")
    (tmp_path / "empty.csv").write_text("")
    rows = T.read_folder(spark, f"file://{tmp_path}")
    assert sorted((r["name"], r["k"], r["more"], r["file_name"]) for r in rows.collect()) == [("x", 1.0, None, "one"), ("y", 2.0, None, "two"), ("z", 2.5, "q", "three")]
    assert T.read_folder(spark, f"file://{tmp_path}", columns=["k"]).columns == ["k", "file_name", "file_path", "changed"]
    with pytest.raises(ValueError):
        T.read_folder(spark, f"file://{tmp_path}", most_headers=2)


def test_companions_are_met_by_what_a_path_holds(spark, tmp_path):
    for name in ("S1_score_data.txt", "scan S22 b/x_score_data.txt", "other/y_score_data.txt"):
        path = tmp_path / name
        path.parent.mkdir(exist_ok=True)
        path.write_text(f"Sample Name\tv\nn\t{len(name)}\n")
    samples = spark.createDataFrame([("S1",), ("S2",), ("S22",), ("",), (None,)], "sample string")
    rows = T.read_companions(spark, f"file://{tmp_path}", samples)
    assert sorted((r["sample"], r["v"]) for r in rows.collect()) == [("S1", 17), ("S2", 27), ("S22", 27)]
    assert T.companions(rows.select("file_path"), samples.limit(0)).isEmpty()


def test_row_ids_do_not_depend_on_splits(spark, tmp_path):
    for k in (1, 2):
        (tmp_path / f"f{k}.csv").write_text("a,b\n" + "".join(f"{1000 * k + j},{'x' * 50}\n" for j in range(400)))
    want = {1000 * k + j: 400 * (k - 1) + j + 1 for k in (1, 2) for j in range(400)}
    for size in ("128m", "3k"):
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
        try:
            rows = T.with_row_ids(spark.read.csv(f"file://{tmp_path}", header=True, inferSchema=True))
            assert {r["a"]: r["row_id"] for r in rows.collect()} == want and rows.columns == ["a", "b", "row_id"]
            found = T.with_cell_ids(spark.read.csv(f"file://{tmp_path}", header=True, inferSchema=True), source=None)
            assert {r["a"]: int(r["cell_id"]) for r in found.collect()} == want
        finally:
            spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert T.with_row_ids(spark.range(5)).select("row_id").distinct().count() == 5


def test_rows_without_an_id_share_no_window(spark):
    df = spark.createDataFrame([(None, k) for k in range(50)] + [("c", 1), ("c", 2)], "id string, k int")
    out = T.with_cell_ids(df, "id", ["k"])
    assert out.where("cell_id IS NULL").count() == 50
    assert sorted(r["cell_id"] for r in out.where("cell_id IS NOT NULL").collect()) == ["c", "c.1"]
    base = F.col("id")
    apart = df.withColumn("n", F.count("*").over(W.partitionBy(base, F.when(base.isNull(), F.xxhash64("id", "k")))))
    assert apart.where("id IS NULL").agg(F.max("n")).first()[0] == 1
