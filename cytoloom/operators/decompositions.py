"""Principal components and batch correction of vectors, from sums over all cells; what reaches the driver grows with features, not cells."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cytoloom.operators.vectors import matrix

FAN = 512


def array_sums(df: DataFrame, part: Callable[[pd.DataFrame], dict[int, np.ndarray]]) -> dict[int, np.ndarray]:
    """Sums over all rows of df of the arrays that part() makes of a batch, by their number.

    A task adds up its own batches; up to 512 tasks' arrays are added in one group, and then the groups', so no task sees them all.
    """

    def partial(frames):
        held: dict[int, np.ndarray] = {}
        for f in frames:
            for k, x in part(f).items() if len(f) else ():
                held[k] = held[k] + x if k in held else x
        if held:
            yield pd.DataFrame({"k": list(held), "x": [x.tolist() for x in held.values()]})

    def add(f: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"k": f["k"].iloc[:1], "x": [np.sum(matrix(f["x"]), axis=0).tolist()]})

    rows = df.mapInPandas(partial, "k int, x array<double>").withColumn("part", F.floor(F.spark_partition_id() / FAN))
    rows = rows.groupBy("part", "k").applyInPandas(add, "k int, x array<double>").groupBy("k").applyInPandas(add, "k int, x array<double>")
    return {r["k"]: np.array(r["x"]) for r in rows.collect()}


def pca(vectors: DataFrame, components: int, scale: bool = False) -> tuple[DataFrame, DataFrame]:
    """(scores, parts): scores (cell_id, pc, score) of each (cell_id, v), pc from 1; parts (pc, deviation, share, loadings).

    Vectors are centred and, with scale, divided by their features' sample deviations (constant features are 0). Two passes: sums, then the
    centred products of features, whose eigenvectors are found on the driver. Features, and their squares, must fit there; as a rule that is
    a few thousand variable features. A component's loading of largest size is positive. All vectors must have one length, without nulls.
    share is the share of the whole variance; without variance it is null.
    """
    rows = vectors.select("cell_id", F.col("v").cast("array<double>").alias("v"))
    sums = array_sums(rows.select("v"), lambda f: {0: np.concatenate([[len(f)], matrix(f["v"]).sum(axis=0)])})
    if not sums:
        none = rows.sparkSession.createDataFrame
        return none([], "cell_id long, pc int, score double"), none([], "pc int, deviation double, share double, loadings array<double>")
    n, mean = sums[0][0], sums[0][1:] / sums[0][0]

    def products(f: pd.DataFrame) -> dict[int, np.ndarray]:
        x = matrix(f["v"]) - mean
        return dict(enumerate(x.T @ x))

    gram = array_sums(rows.select("v"), products)
    cov = np.array([gram[k] for k in range(len(mean))]) / max(n - 1, 1)
    size = np.sqrt(np.diag(cov))
    unit = np.where(size > 0, size, np.inf) if scale else np.ones(len(mean))
    values, loadings = np.linalg.eigh(cov / np.outer(unit, unit))
    values, loadings = np.maximum(values[::-1], 0)[:components], loadings[:, ::-1][:, :components]
    largest = np.abs(loadings).argmax(axis=0)
    loadings = loadings * np.sign(loadings[largest, np.arange(loadings.shape[1])])
    whole = float((np.diag(cov) / unit**2).sum())

    def project(frames):
        for f in filter(len, frames):
            score = ((matrix(f["v"]) - mean) / unit) @ loadings
            k = score.shape[1]
            yield pd.DataFrame({"cell_id": np.repeat(f["cell_id"].to_numpy(), k), "pc": np.tile(np.arange(1, k + 1, dtype=np.int32), len(f)), "score": score.ravel()})

    kind = rows.schema["cell_id"].dataType.simpleString()
    parts = [(k + 1, float(np.sqrt(v)), float(v / whole) if whole > 0 else None, loadings[:, k].tolist()) for k, v in enumerate(values)]
    return rows.mapInPandas(project, f"cell_id {kind}, pc int, score double"), rows.sparkSession.createDataFrame(parts, "pc int, deviation double, share double, loadings array<double>")


class Harmony:
    """Soft clusters of cells that are penalised where a batch is over-represented, and a correction of every cell by cluster and batch.

    A round of the clusters is one aggregation: memberships follow from a cell's vector, the centres and the penalties, so none are stored. After
    the clusters, each cluster's shift of each batch is a ridge regression from the sums of memberships and vectors; again one aggregation.
    A round that doesn't lower the objective isn't taken. What the model holds, and what reaches the driver, grows with clusters, batches and
    components, not with cells.
    """

    def __init__(self, batches: list[str], centres: np.ndarray, theta: float, sigma: float, ridge: float):
        self.theta, self.sigma, self.ridge = theta, sigma, ridge
        self.batches, self.centres = batches, centres
        self.memory: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []  # centres, penalties and shifts of each correction so far
        self.penalty = np.zeros((len(self.batches), len(self.centres)))
        self.objectives: list[list[float]] = []

    @staticmethod
    def unit(x: np.ndarray) -> np.ndarray:
        size = np.sqrt((x * x).sum(axis=1, keepdims=True))
        return x / np.where(size > 0, size, 1)

    @classmethod
    def start(cls, sample: np.ndarray, clusters: int) -> np.ndarray:
        """Farthest-first centres of the sample, moved to their members' means a few times."""
        x = cls.unit(sample)
        chosen, near = [0], 1 - x @ x[0]
        while len(chosen) < min(clusters, len(x)) and near.max() > 1e-9:
            chosen.append(int(near.argmax()))
            near = np.minimum(near, 1 - x @ x[chosen[-1]])
        centres = x[chosen]
        for _ in range(10):
            of = (x @ centres.T).argmax(axis=1)
            centres = cls.unit(np.array([x[of == k].sum(axis=0) if (of == k).any() else c for k, c in enumerate(centres)]))
        return centres

    def corrected(self, f: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
        """(vectors after the last correction, place of each row's batch)."""
        x, at = matrix(f["v"]), np.searchsorted(self.batches, f["batch"].to_numpy(object))
        z = x
        for centres, penalty, shift in self.memory:
            r = self.memberships(z, at, centres, penalty)
            z = x - np.einsum("ik,ikd->id", r, shift[at])
        return z, at

    def memberships(self, z: np.ndarray, at: np.ndarray, centres: np.ndarray, penalty: np.ndarray) -> np.ndarray:
        log = -2 * (1 - self.unit(z) @ centres.T) / self.sigma - penalty[at]
        r = np.exp(log - log.max(axis=1, keepdims=True))
        return r / r.sum(axis=1, keepdims=True)

    def sums(self, rows: DataFrame, centres: np.ndarray, penalty: np.ndarray, whole: bool) -> tuple[np.ndarray, np.ndarray, float]:
        """By batch and cluster: memberships, and members' vectors (corrected ones at length 1, or the given ones); and the fit's cost."""

        def part(f: pd.DataFrame) -> dict[int, np.ndarray]:
            z, at = self.corrected(f)
            r = self.memberships(z, at, centres, penalty)
            cost = (r * 2 * (1 - self.unit(z) @ centres.T)).sum(axis=1) + self.sigma * (r * np.log(np.maximum(r, 1e-300))).sum(axis=1)
            v = matrix(f["v"]) if whole else self.unit(z)
            return {int(b): np.concatenate([[cost[at == b].sum()], r[at == b].sum(axis=0), (r[at == b].T @ v[at == b]).ravel()]) for b in np.unique(at)}

        k = len(centres)
        found = array_sums(rows.select("batch", "v"), part)
        held = np.array([found[b] for b in range(len(self.batches))])
        return held[:, 1 : 1 + k], held[:, 1 + k :].reshape(len(held), k, -1), float(held[:, 0].sum())

    def expected(self, count: np.ndarray) -> np.ndarray:
        return count.sum(axis=1, keepdims=True) / count.sum() * count.sum(axis=0, keepdims=True)

    def cluster(self, rows: DataFrame, rounds: int, tolerance: float) -> None:
        """Centres and penalties, round by round, as long as the objective falls."""
        history: list[float] = []
        centres, penalty = self.centres, self.penalty
        for _ in range(rounds):
            count, vectors, cost = self.sums(rows, centres, penalty, False)
            ratio = np.log((count + 1) / (self.expected(count) + 1))
            objective = cost + self.sigma * self.theta * float((count * ratio).sum())
            if history and objective > history[-1] - tolerance * abs(history[-1]):
                break
            history.append(objective)
            self.centres, self.penalty = centres, penalty
            centres, penalty = self.unit(vectors.sum(axis=0)), (self.theta * ratio + penalty) / 2  # half a step, so that penalties don't swing
        self.objectives.append(history)

    def correct(self, rows: DataFrame) -> None:
        """Each cluster's shift of each batch, by ridge regression on the given vectors."""
        count, vectors, _ = self.sums(rows, self.centres, self.penalty, True)
        shift = np.zeros(vectors.shape)
        for k in range(count.shape[1]):
            own = count[:, k]
            design = np.zeros((len(own) + 1, len(own) + 1))
            design[0, 0], design[0, 1:], design[1:, 0] = own.sum(), own, own
            design[1:, 1:] = np.diag(own + self.ridge)
            target = np.vstack([vectors[:, k].sum(axis=0), vectors[:, k]])
            shift[:, k] = np.linalg.lstsq(design, target, rcond=None)[0][1:]
        self.memory.append((self.centres, self.penalty, shift))


def harmony(
    vectors: DataFrame, clusters: int = 20, theta: float = 2.0, sigma: float = 0.1, ridge: float = 1.0, steps: int = 4, rounds: int = 10, tolerance: float = 1e-4, seed: int = 1
) -> tuple[DataFrame, list[list[float]]]:
    """((cell_id, batch, v) with corrected vectors, the objectives of each step): batches are moved together cluster by cluster.

    vectors: (cell_id, batch, v), v as a rule the scores of principal components. Steps end early when a step's clusters cost as much as the
    last step's. A null batch is a batch of its own. An empty table comes back as it is.
    """
    rows = vectors.select("cell_id", F.coalesce(F.col("batch").cast("string"), F.lit("")).alias("batch"), F.col("v").cast("array<double>").alias("v"))
    if rows.isEmpty():
        return rows, []
    sample = rows.orderBy(F.xxhash64(F.lit(seed), "cell_id"), "cell_id").select("v").limit(64 * clusters).toPandas()
    batches = sorted(r["batch"] for r in rows.select("batch").distinct().collect())
    model = Harmony(batches, Harmony.start(matrix(sample["v"]), clusters), theta, sigma, ridge)
    for _ in range(steps):
        model.cluster(rows, rounds, tolerance)
        model.correct(rows)
        last = [h[-1] for h in model.objectives]
        if len(last) > 1 and abs(last[-2] - last[-1]) <= tolerance * abs(last[-2]):
            break

    def move(frames):
        for f in filter(len, frames):
            yield f.assign(v=list(model.corrected(f)[0]))

    kind = rows.schema["cell_id"].dataType.simpleString()
    return rows.mapInPandas(move, f"cell_id {kind}, batch string, v array<double>"), model.objectives
