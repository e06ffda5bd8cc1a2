"""Probabilities and rank statistics against plain versions and known values."""

import itertools
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from cytoloom.functions import stats as S
from cytoloom.operators import interactions as I
from cytoloom.operators import neighbors as N
from cytoloom.sources import tables as T


def test_probabilities(spark):
    row = spark.range(1).select(
        S.two_sided_normal(F.lit(1.959963984540054)).alias("z"), S.two_sided_t(F.lit(2.2281388519649385), F.lit(10.0)).alias("t"),
        S.upper_f(F.lit(3.0983912121407794), F.lit(3.0), F.lit(20.0)).alias("f"), S.two_sided_t(F.lit(12.706204736432095), F.lit(1.0)).alias("t1"),
    ).first()
    assert row["z"] == pytest.approx(0.05) and row["t"] == pytest.approx(0.05) and row["f"] == pytest.approx(0.05) and row["t1"] == pytest.approx(0.05)


def test_hypergeometric(spark):
    rows = [(c, 7, 20, 9) for c in range(8)]
    df = spark.createDataFrame(rows, "c long, w long, n long, d long")
    for r in df.withColumn("p", S.upper_hypergeometric("c", "w", "n", "d")).collect():
        want = sum(math.comb(7, k) * math.comb(13, 9 - k) for k in range(r["c"], 8) if 0 <= 9 - k <= 13) / math.comb(20, 9)
        assert r["p"] == pytest.approx(want)


def test_exact_rank_sum(spark):
    one, two = [1.5, 2.5, 9.0, 4.0], [3.0, 5.0, 6.0, 8.0, 10.0]
    rows = [("f", v, True) for v in one] + [("f", v, False) for v in two]
    (r,) = S.rank_sum(spark.createDataFrame(rows, "feature string, value double, first boolean"), F.col("first"), ["feature"]).collect()
    u = sum(a > b for a in one for b in two)
    every = [sum(a > b for a in c for b in set(one + two) - set(c)) for c in itertools.combinations(one + two, 4)]
    low = sum(x <= u for x in every) / len(every)
    assert r["u"] == u and r["p"] == pytest.approx(min(1, 2 * low))


def test_constant_features_have_p_one(spark):
    rows = [("f", 2.0, k % 2 == 0) for k in range(10)]
    (r,) = S.rank_sum(spark.createDataFrame(rows, "feature string, value double, first boolean"), F.col("first"), ["feature"]).collect()
    assert r["z"] == 0 and r["p"] == 1


def test_adjustment(spark):
    rng = random.Random(4)
    p = [rng.choice([rng.random(), 0.03, None]) for _ in range(60)]
    df = spark.createDataFrame(list(enumerate(p)), "k long, p double")
    got = {r["k"]: r["p_adj"] for r in S.bh_adjust(df).collect()}
    known = sorted((v, k) for k, v in enumerate(p) if v is not None)
    least, want = 1.0, {}
    for i in range(len(known) - 1, -1, -1):
        least = min(least, known[i][0] * len(known) / (i + 1))
        want[known[i][1]] = least
    assert all(got[k] == pytest.approx(want[k]) if k in want else got[k] is None for k in got)


def test_demo_tissue(spark):
    """The demonstration tissue's own truth: markers of a cluster lead its tests, genes that follow the place lead autocorrelation."""
    cells = T.demo_cells(spark.range(500))
    expr = T.demo_expression(cells, 60)
    found = S.differential_expression(expr, cells, F.col("celltype") == "C0", F.col("celltype") != "C0").orderBy("p_adj", F.desc("log2fc")).limit(10).collect()
    assert {r["feature"] for r in found} == {f"Gene_{k:03}" for k in range(1, 11)}
    moran = S.morans_i(N.knn_edges(cells, 10), expr.where("feature >= 'Gene_051'").select("cell_id", "feature", "value")).collect()
    lead = sorted(moran, key=lambda r: -r["i"])[:3]
    assert {r["feature"] for r in lead} == {"Gene_051", "Gene_052", "Gene_053"} and all(r["p_adj"] < 0.01 for r in lead)


def test_label_permutation(spark):
    """Members that always stand together score above every shuffle; labels at random don't."""
    rng = random.Random(1)
    schema = "cell_id long, sample_id int, x double, y double, celltype string"
    rows = []
    for k in range(60):
        x, y = rng.uniform(0, 1000), rng.uniform(0, 1000)
        rows += [(3 * k, 0, x, y, "a"), (3 * k + 1, 0, x + 1, y, "b"), (3 * k + 2, 0, 5000.0 + 9 * k, y, "c")]
    r = I.circuit_permutation(spark.createDataFrame(rows, schema), 3.0, ["a", "b"], 12, keys=("sample_id",)).first()
    assert r["p"] == 0 and r["z"] > 3 and r["observed"] > r["null_mean"]


def test_bootstrap_band(spark):
    rows = [("k", float(v)) for v in range(1, 12)]
    a, b = (S.bootstrap_median(spark.createDataFrame(rows, "key string, value double"), ["key"]).first() for _ in range(2))
    assert a == b and a["middle"] == 6 and 1 <= a["low"] <= 6 <= a["high"] <= 11


@pytest.mark.parametrize("k", [1, 4])
def test_nearest_with_keys_outliers_and_repeats(spark, k):
    """Ids that repeat across samples, a far outlier, points on one place, a sample with a single cell, coordinates that are missing."""
    rng = random.Random(9)
    schema = "cell_id long, sample_id int, x double, y double, celltype string"
    rows = [(i, s, rng.gauss(0, 1), rng.gauss(0, 3), "t") for s in (0, 1) for i in range(40)]
    rows += [(90, 0, 1e5, -1e5, "t"), (91, 0, 5.0, 5.0, "t"), (92, 0, 5.0, 5.0, "t"), (1, 2, 0.0, 0.0, "t"), (93, 0, None, 1.0, "t")]
    got = {}
    for r in N.knn_edges(spark.createDataFrame(rows, schema), k, ("sample_id",)).collect():
        got.setdefault((r["sample_id"], r["src"]), []).append((r["rank"], r["dst"]))
    for i, s, x, y, _ in rows:
        near = sorted(((x - a) * (x - a) + (y - b) * (y - b), j) for j, t, a, b, _ in rows if t == s and j != i and a is not None) if x is not None else []
        assert sorted(got.get((s, i), [])) == [(n + 1, j) for n, (_, j) in enumerate(near[:k])]


def test_plans_do_not_grow(spark):
    """The number of scans of kNN is the same for few and many cells, and that of gates grows with the depth only."""
    def scans(df):
        return df._jdf.queryExecution().optimizedPlan().toString().count("Range (")

    cells = lambda n: spark.range(n).selectExpr("id AS cell_id", "rand(1) * 99 AS x", "rand(2) * 99 AS y", "'t' AS celltype")
    assert scans(N.knn_edges(cells(50), 3)) == scans(N.knn_edges(cells(200_000), 3))
    from cytoloom.operators import gates as G

    gates = [{"id": f"g{k}", "parent": f"g{k - 1}" if k else None, "x_var": "x", "x_transform": "ln", "x_operator": "gt", "x_lo": 0.1, "y_var": None} for k in range(10)]
    assert scans(G.replay_gates(cells(50), gates)) == 1


def test_composition_keeps_samples_apart(spark):
    schema = "cell_id long, sample_id int, x double, y double, celltype string"
    rows = [(1, 0, 0.0, 0.0, "a"), (2, 0, 1.0, 0.0, "b"), (1, 1, 0.0, 0.0, "a"), (2, 1, 90.0, 0.0, "b")]
    got = {(r["sample_id"], r["cell_id"]): (r["a"], r["b"]) for r in I.composition(spark.createDataFrame(rows, schema), 3.0, ["a", "b"], ("sample_id",)).collect()}
    assert got == {(0, 1): (1, 1), (0, 2): (1, 1), (1, 1): (1, 0), (1, 2): (0, 1)}


def test_rank_sums_against_one_group_equal_single_tests(spark):
    rng = random.Random(3)
    rows = [(g, float(rng.randrange(30 * k, 30 * k + 60))) for k, g in enumerate("abc") for _ in range(40 + 30 * k)] + [("d", 1000.0), ("a", None), (None, 3.0)]
    rows += [("e", x + 0.123 * x) for x in (3.5, 7.5, 200.5)]
    df = spark.createDataFrame(rows, "kind string, value double")
    found = {r["kind"]: r for r in S.rank_sum_against_first(df, "kind", "a").collect()}
    assert set(found) == {"b", "c", "d", "e"}
    for g, r in found.items():
        two = df.where(F.col("kind").isin("a", g)).withColumn("key", F.lit(1))
        one = S.rank_sum(two, F.col("kind") == "a", ["key"]).first()
        assert (r["n1"], r["n2"], r["u"]) == (one["n1"], one["n2"], one["u"]) and r["z"] == pytest.approx(one["z"]) and r["p"] == pytest.approx(one["p"])
        assert r["stars"] == ("***" if r["p"] < 0.001 else "**" if r["p"] < 0.01 else "*" if r["p"] < 0.05 else "n.s.")


def test_distance_effect_crosses_written_draws(spark):
    """Draws are read from a table, so no product has the square of the partitions of all cells as tasks."""
    cells = spark.range(3000).selectExpr("id AS cell_id", "rand(1) * 99 AS x", "rand(2) * 99 AS y", "concat('t', id % 3) AS celltype").repartition(40)
    found = S.distance_effect(cells, 20)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "Range (" not in plan and "Exchange" not in plan
    assert found.count() == 9 and all(0 <= r["d"] <= 1 for r in found.collect())


def test_label_permutation_joins_places_once(spark, monkeypatch):
    """Copies at the same places join as many pairs as one copy; all shuffles count, also those beyond one row of sums."""
    schema = "cell_id long, sample_id int, x double, y double, celltype string"
    rng = random.Random(2)
    spots = [(rng.uniform(0, 9), rng.uniform(0, 9), rng.choice("abc")) for _ in range(40)]
    rows = [(100 * c + k, 0, x, y, t) for c in range(5) for k, (x, y, t) in enumerate(spots)]
    seen, real = [], I.place_pairs
    monkeypatch.setattr(I, "place_pairs", lambda *a, **k: seen.append(real(*a, **k)) or seen[-1])
    r = I.circuit_permutation(spark.createDataFrame(rows, schema), 3.0, ["a", "b"], 15, keys=("sample_id",)).first()
    near = [[t for a, b, t in spots if (a - x) ** 2 + (b - y) ** 2 <= 9] for x, y, _ in spots]
    scores = [min(n.count("a"), n.count("b")) / max(1, n.count("a") + n.count("b")) for n in near]
    assert r["observed"] == pytest.approx(sum(scores) / len(scores)) and 0 < r["null_mean"] < 0.5 and r["null_sd"] > 0
    assert seen[0].count() == sum(map(len, near))


def test_percentile_ranges_are_fixed_before_they_are_read(spark):
    """Approximate quantiles of a large group depend on the order of arrival; both readers of the ranges must see the same ones."""
    from cytoloom.functions.percentiles import percentiles

    df = spark.range(40_000).selectExpr("id % 2 AS k", "pow(double(id * 7919 % 40009), 3) AS v")
    found = percentiles(df, ["k"], "v", {"a": 0.0, "b": 0.37, "c": 0.5, "d": 1.0})
    assert "percentile_approx" not in found._jdf.queryExecution().toString()
    for k in (0, 1):
        values = np.array([(i * 7919 % 40009) ** 3 for i in range(k, 40_000, 2)], float)
        row = found.where(f"k = {k}").first()
        assert [row[c] for c in "abcd"] == pytest.approx(list(np.quantile(values, [0, 0.37, 0.5, 1])), rel=1e-12)


def test_shuffles_deal_labels_by_ranges(spark):
    """Many parts and ranges give the same labels as one sort of all digests; each cell is a row once, not once for each shuffle."""
    from hashlib import md5

    from cytoloom.functions.draws import counts_of, shuffled_codes

    rng = random.Random(7)
    rows = [(s, str(1000 * s + i), float(rng.randrange(40)), rng.randrange(90) / 3 if i % 50 else None, rng.randrange(4)) for s in (0, 1) for i in range(600 - 550 * s)]
    cells = spark.createDataFrame([*rows, (None, "x", 1.0, 1.0, 0)], "s int, id string, x double, y double, code int")
    wanted = {}
    for s in (0, 1):
        own = [r for r in rows if r[0] == s]
        sort = lambda *head: sorted(own, key=lambda r: md5(":".join([*head, r[1]]).encode()).hexdigest())
        labels = [r[4] for r in sort("42")]
        for turn in range(6):
            for r, code in ((r, r[4]) for r in own) if turn == 0 else zip(sort("42", str(turn)), labels):
                if r[3] is not None:
                    n, counts = wanted.setdefault((s, r[2], r[3]), [0, np.zeros(18, int)])
                    wanted[(s, r[2], r[3])][0] += turn == 0
                    counts[3 * turn : 3 * turn + 3] += np.arange(3) == code
    for size, block in ((40, 16), (2**15, 2**14)):
        found = shuffled_codes(cells, ["s"], 3, 5, 42, size, block).collect()
        assert len(found) == len(wanted)
        for r in found:
            n, counts = wanted[(r["s"], r["x"], r["y"])]
            assert r["n"] == n and (counts_of([r["given"]], 18)[0] == counts).all()


@pytest.mark.parametrize("method", ["min_fraction", "geometric_mean"])
def test_label_permutation_makes_no_rows_for_pairs(spark, monkeypatch, method):
    """Places summed inside tasks give what joined pairs give, also where a square is cut."""
    cells = spark.range(1500).selectExpr("id AS cell_id", "id % 2 AS sample_id", "(id * 7919 % 3001) / 100D AS x", "(id * 1013 % 90) / 3D AS y", "substr('abcd', int(id * 31 % 4) + 1, 1) AS celltype")
    joined = I.circuit_permutation(cells, 5.0, ["a", "b", "c"], 4, method, keys=("sample_id",), few=2**30).first()
    monkeypatch.setattr(I, "place_pairs", None)
    real = I.sums_near
    for most in (131_072, 60):
        monkeypatch.setattr(I, "sums_near", lambda *a, most=most: real(*a, most))
        summed = I.circuit_permutation(cells, 5.0, ["a", "b", "c"], 4, method, keys=("sample_id",), few=0).first()
        assert tuple(summed) == pytest.approx(tuple(joined), rel=1e-9)
