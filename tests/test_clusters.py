"""Neighbours of vectors, communities, components, batch correction and mixtures against plain versions, invariants and planted truth."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from cytoloom.functions.mixtures import high_share, two_normals
from cytoloom.operators import communities as C
from cytoloom.operators import vectors as V
from cytoloom.operators.decompositions import harmony, pca


def cells_of(spark, x, **columns):
    rows = [(k, v.tolist(), *[c[k] for c in columns.values()]) for k, v in enumerate(x)]
    return spark.createDataFrame(rows, ["cell_id", "v", *columns]).repartition(3)


def plain_nearest(x, k, group=None):
    d = ((x[:, None] - x[None]) ** 2).sum(axis=2)
    out = set()
    for i in range(len(x)):
        others = [j for j in np.lexsort((np.arange(len(x)), d[i])) if j != i and (group is None or group[i] == group[j])]
        out |= {(i, int(j), r) for r, j in enumerate(others[:k], 1)}
    return out


@pytest.mark.parametrize("options", [{}, {"block_rows": 15}, {"block_rows": 8, "sample": 20, "cells": 4}])
def test_nearest_vectors(spark, options):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(6, 9))[rng.integers(0, 6, 120)] + rng.choice([0.05, 1.0], 120)[:, None] * rng.normal(size=(120, 9))
    x[70:95] = x[70]  # copies tie
    x[3] *= 1e6
    found = V.nearest_vectors(cells_of(spark, x), 7, **options).collect()
    assert {(r["src"], r["dst"], r["rank"]) for r in found} == plain_nearest(x, 7) and len(found) == 120 * 7
    assert max(abs(r["d2"] - ((x[r["src"]] - x[r["dst"]]) ** 2).sum()) / (1 + r["d2"]) for r in found) < 1e-12


def test_nearest_vectors_with_keys_and_bad_rows(spark):
    rng = np.random.default_rng(2)
    x, group = rng.normal(size=(60, 4)), rng.choice(["a", "b", "c"], 60).tolist()
    group[0] = "alone"
    df = cells_of(spark, x, sample=group)
    bad = spark.createDataFrame([(900, None, "a"), (901, [1.0, None, 0.0, 0.0], "a"), (902, [float("nan")] * 4, "a")], "cell_id long, v array<double>, sample string")
    found = V.nearest_vectors(df.unionByName(bad), 5, ("sample",), block_rows=6).collect()
    assert {(r["src"], r["dst"], r["rank"]) for r in found} == plain_nearest(x, 5, group)
    assert V.nearest_vectors(df.limit(0), 5).isEmpty()


def test_visits_are_pruned(spark, monkeypatch):
    """Of well separated groups no vector visits another group's cell: what is compared across blocks stays inside a group."""
    rng = np.random.default_rng(3)
    x = 100 * np.eye(8)[np.arange(400) % 8] + rng.normal(size=(400, 8))
    asked, real = [], V.visits
    monkeypatch.setattr(V, "visits", lambda *args: asked.append(real(*args)) or asked[-1])
    found = V.nearest_vectors(cells_of(spark, x), 5, block_rows=50)
    assert {(r["src"], r["dst"], r["rank"]) for r in found.collect()} == plain_nearest(x, 5)
    assert asked[0].isEmpty()
    x = rng.uniform(size=(2000, 2))
    V.nearest_vectors(cells_of(spark, x), 5, block_rows=50)
    assert 0 < asked[1].count() < 2000 * 8  # of forty cells


def planted(groups, size, inside, between, seed=1, shift=0):
    rng = np.random.default_rng(seed)
    of = np.repeat(np.arange(groups), size)
    pairs = [(i, j) for i in range(len(of)) for j in range(i) if rng.random() < (inside if of[i] == of[j] else between)]
    return of, [(i + shift, j + shift, 1.0) for i, j in pairs]


def graph(spark, rows, schema="src long, dst long, weight double"):
    return spark.createDataFrame(rows, schema)


def test_communities_find_planted_groups_in_many_graphs(spark):
    """Two graphs in one job: labels, connected parts, isolated nodes, and an edgeless graph as one community."""
    of, a = planted(4, 12, 0.8, 0.02)
    _, b = planted(2, 10, 0.9, 0.02, seed=2)
    edges = graph(spark, [("a", *e) for e in a] + [("b", *e) for e in b], "g string, src long, dst long, weight double")
    nodes = spark.createDataFrame([("a", k) for k in range(49)] + [("b", k) for k in range(20)] + [("c", k) for k in range(3)], "g string, node long")
    found = C.communities(edges, nodes.withColumn("extra", F.lit(1)), ("g",))
    by = {(r["g"], r["node"]): r["community"] for r in found.collect()}
    assert [by["a", k] for k in range(48)] == (of * 12).tolist() and by["a", 48] == 48
    assert [by["b", k] for k in range(20)] == [0] * 10 + [10] * 10
    assert {by["c", k] for k in range(3)} == {0}
    names = {r["cluster"] for r in C.named_by_size(found, ("g",)).where("g = 'a'").collect()}
    assert names == {"C01", "C02", "C03", "C04", "C05"}


def test_modularity_never_falls(spark, monkeypatch):
    rng = np.random.default_rng(5)
    edges = graph(spark, [(int(i), int(j), float(w)) for i, j, w in zip(*rng.integers(0, 60, (2, 150)), rng.integers(1, 5, 150)) if i < j])
    nodes = spark.range(60).withColumnRenamed("id", "node")
    values, real = [], C._round

    def watched(inner, level, seed):
        after, gains = real(inner, level, seed)
        internal = inner.join(after.select("g", F.col("node").alias("a"), F.col("comm").alias("ca")), ["g", "a"]).join(after.select("g", F.col("node").alias("b"), F.col("comm").alias("cb")), ["g", "b"])
        weight = internal.where("ca = cb").agg(F.sum("w")).first()[0] or 0
        squares = after.groupBy("g", "comm").agg(F.sum("s").alias("s"), F.first("lam").alias("lam")).agg(F.sum(F.col("lam") * F.col("s") * F.col("s"))).first()[0]
        values.append((id(inner), weight / 2 - squares / 2))
        return after, gains

    monkeypatch.setattr(C, "_round", watched)
    found = C.communities(edges, nodes)
    for (i, a), (j, b) in zip(values, values[1:]):
        assert i != j or b >= a - 1e-3
    monkeypatch.undo()
    assert sorted(C.communities(edges, nodes, passes=1).collect()) == sorted(C.communities(edges.repartition(7), nodes, passes=1).collect())
    inside = edges.join(found.select(F.col("node").alias("src"), F.col("community").alias("c")), "src").join(found.select(F.col("node").alias("dst"), F.col("community").alias("d")), "dst").where("c = d")
    roots = {r["node"]: r["root"] for r in C.components(inside).collect()}
    assert all(roots.get(r["node"], r["node"]) == r["community"] for r in found.collect())
    plain = {r["node"]: r["community"] for r in found.collect()}
    rows, m = edges.collect(), edges.agg(F.sum("weight")).first()[0]
    degree = np.zeros(60)
    for r in rows:
        degree[r["src"]] += r["weight"]
        degree[r["dst"]] += r["weight"]
    q = sum(r["weight"] for r in rows if plain[r["src"]] == plain[r["dst"]]) / m - sum(sum(degree[k] for k in plain if plain[k] == c) ** 2 for c in set(plain.values())) / (4 * m * m)
    assert C.modularity(edges, found).first()["modularity"] == pytest.approx(q) and q > 0.25


def test_a_sweep_equals_single_runs(spark):
    _, a = planted(4, 10, 0.7, 0.1, seed=3)
    edges, nodes = graph(spark, a), spark.range(40).withColumnRenamed("id", "node")
    rates = spark.createDataFrame([(0.4,), (1.0,), (2.5,)], "resolution double")
    both = C.communities(edges.crossJoin(rates), nodes.crossJoin(rates), ("resolution",), "resolution", passes=1)
    found = {(r["resolution"], r["node"]): r["community"] for r in both.collect()}
    single = {r["node"]: r["community"] for r in C.communities(edges, nodes, (), 2.5, passes=1).collect()}
    assert single == {k: found[2.5, k] for k in range(40)}
    counts = {r: len({found[r, k] for k in range(40)}) for r in (0.4, 1.0, 2.5)}
    assert counts[0.4] <= counts[1.0] <= counts[2.5] and counts[0.4] < counts[2.5]


def test_joint_clusters(spark):
    rng = np.random.default_rng(6)
    rows = [(k, 100.0 * (k % 3) + rng.normal(), rng.normal(), "t") for k in range(60)]
    found = {r["cell_id"]: r["cluster"] for r in C.joint_clusters(spark.createDataFrame(rows, "cell_id long, x double, y double, celltype string"), k=12, resolution=0.05).collect()}
    assert len(set(found.values())) == 3 and all(found[k] == found[k % 3] for k in range(60))


def test_sub_clusters(spark):
    rng = np.random.default_rng(7)
    centres = 20 * np.eye(6)[:4]
    x = np.concatenate([c + rng.normal(size=(25, 6)) for c in centres])
    label = ["t"] * 50 + ["u"] * 25 + [None] * 25
    df = cells_of(spark, x, label=label)
    got = {(r["resolution"], r["cell_id"]): r["cluster"] for r in C.sub_clusters(df.select("cell_id", "v"), df.select("cell_id", "label"), ["t"], [0.3], k=8).collect()}
    assert len(got) == 100 and [got[0.3, k] for k in range(50)] == ["t_1"] * 25 + ["t_2"] * 25
    assert {got[0.3, k] for k in range(50, 75)} == {"u"} and got[0.3, 80] is None


def test_pca(spark):
    rng = np.random.default_rng(8)
    x = rng.normal(size=(80, 6)) @ rng.normal(size=(6, 6)) + 100
    x[:, 5] = 3
    for scale in (False, True):
        z = x - x.mean(axis=0)
        z = z / np.where(z.std(axis=0, ddof=1) > 0, z.std(axis=0, ddof=1), np.inf) if scale else z
        _, s, vt = np.linalg.svd(z, full_matrices=False)
        scores, parts = pca(cells_of(spark, x), 3, scale)
        for r in parts.collect():
            k = r["pc"] - 1
            assert r["deviation"] == pytest.approx(s[k] / np.sqrt(79)) and r["share"] == pytest.approx(s[k] ** 2 / (s**2).sum())
            sign = np.sign(np.array(r["loadings"]) @ vt[k])
            ours = {q["cell_id"]: q["score"] for q in scores.where(F.col("pc") == r["pc"]).collect()}
            assert np.allclose([ours[i] for i in range(80)], sign * (z @ vt[k]), atol=1e-8)
            assert max(r["loadings"], key=abs) > 0
    assert pca(cells_of(spark, x).limit(0), 2)[0].isEmpty()
    scores, parts = pca(cells_of(spark, x[:2]).repartition(9, "cell_id"), 2)  # most partitions are empty
    assert scores.count() == 4 and parts.first()["share"] == pytest.approx(1)
    assert V.nearest_vectors(cells_of(spark, x[:3]).repartition(9, "cell_id"), 1).count() == 3


def test_harmony_mixes_batches_and_keeps_types(spark):
    rng = np.random.default_rng(9)
    kind, batch = np.arange(240) % 3, rng.integers(0, 2, 240)
    x = 6 * np.eye(8)[kind] + 2.5 * np.eye(8)[3 + batch] + 0.4 * rng.normal(size=(240, 8))
    df = cells_of(spark, x, batch=[f"b{b}" for b in batch])
    moved, objectives = harmony(df, clusters=6)
    y = np.array([r["v"] for r in moved.orderBy("cell_id").collect()])
    gap = lambda z: np.mean([np.linalg.norm(z[(kind == t) & (batch == 0)].mean(axis=0) - z[(kind == t) & (batch == 1)].mean(axis=0)) for t in range(3)])
    assert gap(y) < 0.15 * gap(x)
    middle = np.array([y[kind == t].mean(axis=0) for t in range(3)])
    assert (((y[:, None] - middle[None]) ** 2).sum(axis=2).argmin(axis=1) == kind).all()
    assert all(a >= b for h in objectives for a, b in zip(h, h[1:]))
    assert harmony(df.limit(0))[0].isEmpty()


def plain_mixture(v, rounds):
    """(share, mean, sd) of two components, and the likelihoods of all rounds."""
    low = v <= v.mean()
    w, m, s = np.array([low.mean(), 1 - low.mean()]), np.array([v[low].mean(), v[~low].mean()]), np.full(2, v.std() / 2)
    seen = []
    for _ in range(rounds):
        p = w * np.exp(-(((v[:, None] - m) / s) ** 2) / 2) / s / np.sqrt(2 * np.pi)
        seen.append(np.log(p.sum(axis=1)).sum())
        if len(seen) > 1 and seen[-1] - seen[-2] <= 1e-6 * len(v):
            break
        r = p / p.sum(axis=1, keepdims=True)
        w, m = r.mean(axis=0), (r * v[:, None]).sum(axis=0) / r.sum(axis=0)
        s = np.maximum(np.sqrt((r * (v[:, None] - m) ** 2).sum(axis=0) / r.sum(axis=0)), 1e-3 * v.std())
    return w, m, s, seen


def test_mixtures(spark):
    rng = np.random.default_rng(10)
    values = {"far": np.concatenate([rng.normal(0, 1, 150), rng.normal(8, 2, 50)]), "near": np.round(rng.normal(5, 1, 120), 1), "same": np.full(9, 4.0)}
    rows = [(f, float(x)) for f, v in values.items() for x in v] + [("far", None), ("near", float("nan"))]
    df = spark.createDataFrame(rows, "feature string, value double")
    found = {r["feature"]: r for r in two_normals(df, ["feature"], "value", rounds=12).collect()}
    for f in ("far", "near"):
        w, m, s, seen = plain_mixture(values[f], 12)
        order, r = np.argsort(m), found[f]
        assert np.allclose([r["mean1"], r["mean2"], r["sd1"], r["sd2"], r["share1"], r["share2"]], [*m[order], *s[order], *w[order]], atol=1e-6)
        assert r["likelihood"] == pytest.approx(seen[-1]) and all(b >= a - 1e-9 for a, b in zip(seen, seen[1:])) and r["round"] == len(seen)
    assert abs(found["far"]["mean2"] - 8) < 1 and found["same"]["share2"] == 0
    high = high_share(spark.createDataFrame([("far", 9.0), ("far", -1.0), ("same", 4.0)], "feature string, value double"), two_normals(df, ["feature"], "value", rounds=12), ["feature"], "value")
    assert [round(r["high"]) for r in high.orderBy("feature", F.desc("value")).collect()] == [1, 0, 0]


def test_visits_leave_a_batch_in_short_frames():
    """Without bounds every vector visits every cell; a frame of visits stays short all the same, and none is lost."""
    rng = np.random.default_rng(3)
    x, pivots = rng.normal(size=(300, 4)), rng.normal(size=(40, 4))
    home = V.distances(x, pivots).argmin(axis=1)
    frame = pd.DataFrame({"src": np.arange(300), "v": list(x), "cell": home, "bound": np.inf})
    frames = list(V.visits_of([frame, frame.iloc[:0]], pivots, rows=64, most=500))
    assert max(map(len, frames)) <= 500
    every = pd.concat(frames)
    assert len(every) == 300 * 40 == len(every[["src", "cell"]].drop_duplicates())


def test_mixture_rounds_do_not_sort_a_groups_values(spark):
    """A model is one row per group: joined by keys, all values of a group would meet in one task, whatever their number."""
    from cytoloom.functions import mixtures

    counts = spark.range(100).selectExpr("'f' AS feature", "double(id) AS v", "1L AS n")
    fields = ", ".join(f"double({x}) AS {c}" for c, x in zip(mixtures.FIELDS, (0.5, 20, 5, 0.5, 80, 5)))
    state = spark.range(1).selectExpr("'f' AS feature", "100L AS rows", "30D AS spread", *fields.split(", "), "double('-inf') AS likelihood", "0 AS round", "false AS done")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)  # as for a state that Spark takes for large
    try:
        out = mixtures._step(counts, mixtures._step(counts, state, ["feature"], 1e-6, 1e-3), ["feature"], 1e-6, 1e-3)
        assert "SortMergeJoin" not in out._jdf.queryExecution().executedPlan().toString()
        assert out.first()["round"] == 2
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_packed_vectors_are_what_they_were():
    rng = np.random.default_rng(4)
    x = rng.normal(size=(40, 5))
    x[::2] = x[::2].astype("f4")
    x[3], x[5] = 1e300, 0
    for rows in (x, x[::2], x[1::2]):
        assert (V.matrix(V.packed(rows)) == rows).all()
    short, long = (len(b[0]) for b in (V.packed(x[:1]), V.packed(x[1:2])))
    assert short == 21 and long == 41


def test_what_is_sent_grows_no_faster_than_the_table(spark, monkeypatch):
    """Vectors that no bound keeps apart: the blocks of a larger table are larger, so each vector visits as many; each meets a block once."""
    rng, seen, real = np.random.default_rng(5), [], V.visits
    monkeypatch.setattr(V, "visits", lambda *args: seen.append(real(*args)) or seen[-1])
    for n in (5000, 10_000):
        x = rng.normal(size=(n, 40)).astype("f4")
        V.nearest_vectors(cells_of(spark, x.astype(float)), 3, block_rows=n // 4).count()
    few, many = (s.count() for s in seen)
    assert seen[0].select("v").first()[0][0] == 1 and many <= 2.6 * few
    plan = V.nearest_vectors(cells_of(spark, x.astype(float)), 3, block_rows=2500)._jdf.queryExecution().optimizedPlan().toString()
    assert "FlatMapCoGroupsInPandas" in plan and "chunk" not in plan
    doubled = spark.range(110_000).selectExpr("id AS cell_id", "array(double(id % 331), double(id % 337)) AS v")
    asked = []
    monkeypatch.setattr(V, "pivots_of", lambda sample, cells: asked.append(cells) or sample[:1])
    monkeypatch.setattr(V, "visits", lambda *args: 1 / 0)
    with pytest.raises(ZeroDivisionError):
        V.nearest_vectors(doubled, 3)
    assert asked == [24]  # 27 of 4096 rows each
