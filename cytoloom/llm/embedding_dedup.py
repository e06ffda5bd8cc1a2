"""Near-duplicate vectors by cosine, from int8 tile products with rigorous bounds of their error.

Each vector u of length 1 is quantised on its own scale: q = round(127 u / max|u|), so u = s q + e with a known |e|. For two vectors
|u.w - s t (q.r)| <= |e| |t r| + |u| |f|, and q.r is a whole number that a product of float32 matrices gives exactly (slices of at most 1024
components). A pair whose upper bound is below the threshold is settled; the others are computed again from the full vectors.

On Spark: rows of one label and one vector are a class, counted before anything else, so copies are never compared. Farthest-first pivots
of a bounded sample deal the classes into cells. Of two vectors nearest to pivots a and b, at a distance of at most d = sqrt(2 - 2 threshold),
the one at a lies within d of the plane between a and b; so a vector is a guest in every later cell whose plane is that near, and a pair
meets once, where its later vector is at home. Cells are cut into blocks of about ``block_rows``, and one task compares two blocks. It
returns each vector's number of links and, for every component inside the tile, edges to its smallest member: pairs don't leave the task.

Bounds: the sample (``sample`` vectors) and the pivots (``cells`` for each length of a vector in it) reach the driver; nothing else does.

Defined results
---------------
* Vectors that are null, empty or zero, or hold a null or non-finite component, and those with a null label, link with nothing. Vectors
  of different lengths don't link. Nothing is dropped: one row per row of the table, with further columns ignored.
* Copies of a vector under one label link with each other and are counted in n_links. Rows with one id are told apart by label and vector.
* component_id is the smallest id that is reachable, null only if no row of the component has an id. kept holds for a row with that id; a
  component without ids keeps all its rows.
* An empty table gives an empty result.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize
from .components import connected_components

NO_ID = 2**63 - 1
SLICE = 1024


def units(vectors) -> np.ndarray:
    """The vectors at length 1, in double precision."""
    x = np.array(list(vectors), np.float64)
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


class Quantised:
    """Vectors of length 1 as bytes: codes, scale, and what the rounding leaves."""

    def __init__(self, unit: np.ndarray):
        self.unit = unit
        self.scale = np.abs(unit).max(axis=1) / 127
        self.codes = np.rint(unit / self.scale[:, None]).astype(np.int8)
        held = self.codes * self.scale[:, None]
        self.held = np.sqrt((held * held).sum(axis=1))
        left = unit - held
        self.error = np.sqrt((left * left).sum(axis=1))

    def bounds(self, other: Quantised) -> np.ndarray:
        """Upper bounds of all cosines."""
        whole = np.zeros((len(self.codes), len(other.codes)))
        for at in range(0, self.codes.shape[1], SLICE):  # 1024 products of at most 127 * 127 stay below 2 ** 24
            whole += self.codes[:, at : at + SLICE].astype(np.float32) @ other.codes[:, at : at + SLICE].astype(np.float32).T
        whole *= self.scale[:, None] * other.scale[None, :]
        return whole + self.error[:, None] * other.held[None, :] + other.error[None, :] * (1 + 1e-12) + 1e-12


def linked(a: Quantised, b: Quantised, threshold: float, chunk: int = 65_536) -> tuple[np.ndarray, np.ndarray]:
    """The pairs with a cosine of at least the threshold."""
    i, j = np.nonzero(a.bounds(b) >= threshold)
    sure = [np.einsum("ij,ij->i", a.unit[i[k : k + chunk]], b.unit[j[k : k + chunk]]) >= threshold for k in range(0, len(i), chunk)]
    keep = np.concatenate(sure) if sure else np.zeros(0, bool)
    return i[keep], j[keep]


def least_members(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """For each of n nodes the first one of its component, by links i, j."""
    root = np.arange(n)
    while True:
        low = np.minimum(root[i], root[j])
        new = root.copy()
        for side in (i, j, root[i], root[j]):
            np.minimum.at(new, side, low)
        new = new[new]
        if (new == root).all():
            return root
        root = new


def pivots_of(sample: pd.DataFrame, cells: int, reach: float) -> dict[int, np.ndarray]:
    """By length of vector: farthest-first pivots, until the farthest vector is too near for a plane to divide anything."""
    out = {}
    for dim, rows in sample.groupby("dim"):
        x = units(rows["v"])
        chosen, near = [0], np.full(len(x), np.inf)
        while len(chosen) < cells:
            near = np.minimum(near, ((x - x[chosen[-1]]) ** 2).sum(axis=1))
            if near.max() <= (2 * reach) ** 2:
                break
            chosen.append(int(near.argmax()))
        out[int(dim)] = x[chosen]
    return out


def in_cells(classes: DataFrame, pivots: dict[int, np.ndarray], reach: float) -> DataFrame:
    """(label, dim, id, tie, v, m, cell, home): each class in its own cell, and as a guest in later ones that its links may reach."""

    def assign(frames):
        for f in frames:
            for dim, rows in f.groupby("dim"):
                p = pivots.get(int(dim), np.zeros((1, int(dim))))
                x = units(rows["v"])
                at = x @ p.T
                home = at.argmax(axis=1)
                apart = np.sqrt(((p[:, None, :] - p[None, :, :]) ** 2).sum(axis=2))
                near = at[np.arange(len(x)), home][:, None] - at <= reach * apart[home] + 1e-9
                near &= np.arange(len(p))[None, :] > home[:, None]
                near[np.arange(len(x)), home] = True
                row, cell = np.nonzero(near)
                yield rows.iloc[row].assign(cell=cell.astype(np.int32), home=cell == home[row])

    schema = ", ".join(f"{c.name} {c.dataType.simpleString()}" for c in classes.schema)
    return classes.mapInPandas(assign, f"{schema}, cell int, home boolean")


def in_tiles(placed: DataFrame, block_rows: int, salts: int = 64) -> DataFrame:
    """placed with its block and one row for each pair of blocks (a, b) that its block takes part in. Blocks of vectors at home come first."""
    keys = ["label", "dim", "cell"]
    sizes = placed.groupBy(*keys).agg(*[F.ceil(F.count_if(c) / block_rows).alias(n) for c, n in ((F.col("home"), "homes"), (~F.col("home"), "guests"))])
    # Only cells of several blocks need their numbers; those are few, and as one may hold a third of all rows, its row is copied.
    large = sizes.where("homes > 1 OR guests > 1").withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    rows = placed.withColumn("salt", F.pmod(F.xxhash64("tie"), F.lit(salts)).cast("int")).join(large, [*keys, "salt"], "left").na.fill(1, ["homes", "guests"])
    rows = rows.withColumn("block", F.expr("IF(home, pmod(xxhash64(tie, 7), greatest(1, homes)), homes + pmod(xxhash64(tie, 7), greatest(1, guests)))"))
    rows = rows.withColumn("o", F.explode(F.expr("IF(home, sequence(0L, homes + guests - 1), IF(homes > 0, sequence(0L, homes - 1), array()))")))
    return rows.select(*keys, "id", "tie", "v", "m", "block", F.least("block", "o").alias("a"), F.greatest("block", "o").alias("b"))


def compare(f: pd.DataFrame, threshold: float) -> pd.DataFrame:
    """Of one tile: (id, tie, links) of linked vectors, and (id, tie, to_id, to_tie) edges to the smallest of their component in it."""
    a, b = int(f["a"].iloc[0]), int(f["b"].iloc[0])
    f = f.sort_values(["id", "tie"], ignore_index=True)
    block = f["block"].to_numpy()
    one, two = np.flatnonzero(block == a), np.flatnonzero(block == b)
    if not len(one) or not len(two) or a == b and len(one) < 2:
        return pd.DataFrame()
    codes = Quantised(units(f["v"]))
    left, right = ((codes, codes) if a == b else (Quantised(codes.unit[one]), Quantised(codes.unit[two])))
    i, j = linked(left, right, threshold)
    if a == b:
        i, j = i[i < j], j[i < j]
    else:
        i, j = one[i], two[j]
    if not len(i):
        return pd.DataFrame()
    m, links = f["m"].to_numpy(np.int64), np.zeros(len(f), np.int64)
    np.add.at(links, i, m[j])
    np.add.at(links, j, m[i])
    root = least_members(len(f), i, j)
    ids, ties = f["id"].to_numpy(np.int64), f["tie"].to_numpy(object)
    some, hang = np.flatnonzero(links), np.flatnonzero(root != np.arange(len(f)))
    at = np.concatenate([some, hang])
    to = np.concatenate([np.full(len(some), -1), root[hang]])
    return pd.DataFrame(
        {
            "id": ids[at],
            "tie": pd.Series(ties[at], dtype=object),
            "to_id": pd.Series([int(ids[k]) if k >= 0 else None for k in to], dtype=object),
            "to_tie": pd.Series([ties[k] if k >= 0 else None for k in to], dtype=object),
            "links": np.where(to < 0, links[at], 0),
        }
    )


def near_duplicates(
    df: DataFrame, id_col: str = "vec_id", vector: str = "embedding", label: str = "label", threshold: float = 0.98, sample: int = 2048, cells: int = 64, block_rows: int = 1024
) -> DataFrame:
    """(vec_id, n_links, component_id, kept): for each row how many others it links with, and the smallest id that links reach."""
    reach = math.sqrt(max(0.0, 2 - 2 * threshold))
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    takes = F.coalesce(F.col(label).isNotNull() & ~bad & F.exists(vector, lambda x: x != 0), F.lit(False))
    own = F.col(label).cast("string")
    rows = df.select(F.col(id_col).cast("long").alias("vec_id"), takes.alias("takes"), own.alias("label"), F.col(vector).alias("v"))
    # Numbers print as the shortest text that gives them back, so the digest stands for label and vector.
    rows = rows.withColumn("tie", F.sha2(F.concat_ws(",", "label", F.col("v").cast("array<string>")), 256))
    classes = rows.where("takes").groupBy("label", "tie", "v").agg(F.coalesce(F.min("vec_id"), F.lit(NO_ID)).alias("id"), F.count("*").alias("m"))
    classes = materialize(classes.withColumn("dim", F.size("v")))
    seen = classes.orderBy(F.xxhash64("tie"), "tie").select("dim", "v").limit(sample).toPandas()
    tiles = in_tiles(in_cells(classes, pivots_of(seen, cells, reach), reach), block_rows)
    schema = "id long, tie string, to_id long, to_tie string, links long"
    found = materialize(tiles.groupBy("label", "dim", "cell", "a", "b").applyInPandas(lambda f: compare(f, threshold), schema))
    links = found.where("links > 0").groupBy("tie").agg(F.sum("links").alias("links"))
    edges = found.where("to_tie IS NOT NULL").select(F.struct("id", "tie").alias("u"), F.struct(F.col("to_id").alias("id"), F.col("to_tie").alias("tie")).alias("v"))
    roots = connected_components(edges.distinct()).select("node.tie", F.col("root.id").alias("least"))
    judged = classes.select("tie", "id", "m").join(links, "tie", "left").join(roots, "tie", "left")
    judged = judged.select("tie", (F.col("m") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.nullif(F.coalesce("least", "id"), F.lit(NO_ID)).alias("component_id"))
    linked_rows = rows.where("takes").select("vec_id", "tie").join(judged, "tie").drop("tie")
    others = rows.where("NOT takes").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    kept = F.coalesce(F.col("vec_id") == F.col("component_id"), F.col("component_id").isNull())
    return linked_rows.union(others).withColumn("kept", kept)
