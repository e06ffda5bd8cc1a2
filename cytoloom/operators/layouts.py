"""Coordinates for display from neighbour graphs: eigenvectors of the graph, and layouts by attraction and repulsion. Rounds are joins over edge tables."""

from __future__ import annotations

import math
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W
from pyspark.storagelevel import StorageLevel

from cytoloom.lineage import materialize
from cytoloom.operators.decompositions import array_sums
from cytoloom.operators.vectors import matrix


def uniform(*key: Column) -> Column:
    """A number from 0 to 1, 1 excluded, by the hash of its key."""
    return F.shiftrightunsigned(F.xxhash64(*key), 11) / float(1 << 53)


def both_ways(edges: DataFrame, weight: Column) -> DataFrame:
    """(src, dst, w): the mean of an edge's weight and that of its reverse, 0 where there is none, in both directions."""
    half = edges.where("src <> dst").select("src", "dst", (weight / 2).alias("w"))
    return half.unionByName(half.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "w")).groupBy("src", "dst").agg(F.sum("w").alias("w"))


def distance_weights(edges: DataFrame) -> DataFrame:
    """(src, dst, w) of (src, dst, dist): exp(-distance over the distance of the farthest neighbour), the mean of both directions."""
    far = edges.groupBy("src").agg(F.greatest(F.max("dist"), F.lit(1e-8)).alias("_far"))
    return both_ways(edges.join(far, "src"), F.exp(-F.col("dist") / F.col("_far")))


class Chebyshev:
    """A basis of Chebyshev polynomials of a symmetric matrix with eigenvalues from -1 to 1, applied to a block of vectors.

    The products of the basis' vectors, summed over all nodes, are all that the driver needs to find the best approximations of eigenvectors in
    the space they span, and how far these are from being eigenvectors.
    """

    def __init__(self, gram: np.ndarray, width: int):
        """gram: products of all vectors of the basis, block by block of the given width; the last block is only a product's part."""
        self.gram, n = gram, len(gram) - width
        self.times = np.zeros((len(gram), n))  # the matrix times a vector of the basis, in the basis
        for c in range(n):
            if c < width:
                self.times[c + width, c] = 1
            else:
                self.times[c + width, c] = self.times[c - width, c] = 0.5
        own, applied = gram[:n, :n], gram[:n] @ self.times
        size, turn = np.linalg.eigh(own)
        keep = size > 1e-13 * size.max()
        white = turn[:, keep] / np.sqrt(size[keep])
        values, vectors = np.linalg.eigh(white.T @ ((applied + applied.T) / 2) @ white)
        order = np.argsort(-np.abs(values), kind="stable")
        self.values, self.coefficients = values[order], (white @ vectors)[:, order]

    def residuals(self, k: int) -> np.ndarray:
        """The size of Ax - lambda x for the first k vectors x of length 1."""
        c = self.coefficients[:, :k]
        left = self.times @ c
        left[: len(c)] -= c * self.values[:k]
        return np.sqrt(np.maximum(np.einsum("ij,ik,kj->j", left, self.gram, left), 0))


def spectral_vectors(weights: DataFrame, k: int = 3, degree: int = 24, tolerance: float = 1e-6, cycles: int = 6, seed: int = 42, piece: int = 4096, most: int = 2**17) -> tuple[DataFrame, list[float], list[float]]:
    """((node, vector), eigenvalues, residuals): the k eigenvectors, of length 1, of the largest eigenvalues by size of D^-1/2 W D^-1/2.

    weights: (src, dst, w) in both directions; nodes without edges have no row. A cycle multiplies a block of k + 2 vectors ``degree`` times
    and takes the best vectors of the space that these span; cycles end when the residuals are below the tolerance. Only sums of products reach
    the driver. A vector's sign is that of its product with a vector of hashes.

    Nodes are numbered; the numbers of ``piece`` nodes that follow each other are one row, as bytes. The matrix is cut into squares of some ``most``
    nodes a side and 2^20 edges, which stay where they are; a round sends each square the pieces of its columns, and back come sums for its rows.
    """
    weights = materialize(weights)
    degrees = weights.groupBy("src").agg(F.sum("w").alias("d"))
    width = k + 2
    drawn = [uniform(F.lit(seed), F.lit(i), F.col("node")) - 0.5 for i in range(width - 1)]
    nodes = numbered(degrees.select(F.col("src").alias("node"), F.sqrt("d").alias("root")))
    nodes = materialize(nodes.withColumn("first", F.col("number") - F.col("number") % piece))
    n, total = nodes.count(), weights.count()
    squares = max(1, -(-n // most), math.ceil(math.sqrt(total / 2**20)))
    size = piece * max(1, -(-n // (squares * piece)))
    squares = max(1, -(-n // size))
    length = lambda first: min(piece, n - int(first))
    opened = lambda data, first: np.frombuffer(data, np.float64).reshape(length(first), -1)

    def pack(f: pd.DataFrame) -> pd.DataFrame:
        data = {"rows": f["row"].to_numpy(np.int32), "columns": f["column"].to_numpy(np.int32), "w": f["w"].to_numpy(np.float64)}
        return f[["i", "j"]].iloc[:1].assign(**{c: [x.tobytes()] for c, x in data.items()})

    ends = lambda c: nodes.select(F.col("node").alias(c), F.col("root").alias(f"root_{c}"), F.col("number").alias(f"at_{c}"))
    edges = weights.join(ends("src"), "src").join(ends("dst"), "dst")
    edges = edges.selectExpr(f"int(at_src div {size}) AS i", f"int(at_dst div {size}) AS j", f"int(at_src % {size}) AS row", f"int(at_dst % {size}) AS column", "w / root_src / root_dst AS w")
    edges = materialize(edges.groupBy("i", "j").applyInPandas(pack, "i int, j int, rows binary, columns binary, w binary"))
    edges = edges.repartition(squares * squares, "i", "j").persist(StorageLevel.DISK_ONLY)

    def multiply(e: pd.DataFrame, x: pd.DataFrame) -> pd.DataFrame:
        if not len(e) or not len(x):
            return pd.DataFrame()
        x = x.sort_values("node")
        x = np.concatenate([opened(v, at) for v, at in zip(x["cur"], x["node"])])
        rows, columns, w = (np.frombuffer(e[c].iloc[0], kind) for c, kind in (("rows", np.int32), ("columns", np.int32), ("w", np.float64)))
        low = int(e["i"].iloc[0]) * size
        sums = np.stack([np.bincount(rows, w * x[columns, c], min(size, n - low)) for c in range(x.shape[1])], axis=1)
        firsts = range(0, len(sums), piece)
        return pd.DataFrame({"node": [low + at for at in firsts], "j": e["j"].iloc[0], "sums": [sums[at : at + piece].tobytes() for at in firsts]})

    def stepped(factor: float):
        def step(f: pd.DataFrame, sums: pd.DataFrame) -> pd.DataFrame:
            cur, prev = (np.frombuffer(f[c].iloc[0], np.float64) for c in ("cur", "prev"))
            new = -prev if len(prev) else np.zeros(len(cur))  # none before the first round
            for part in sums.sort_values("j")["sums"]:
                new = new + factor * np.frombuffer(part, np.float64)
            return pd.DataFrame({"node": f["node"], "cur": [new.tobytes()], "prev": f["cur"]})

        return step

    def start(f: pd.DataFrame) -> pd.DataFrame:
        v = f.sort_values("number")[["root", *[f"_{i}" for i in range(width - 1)]]].to_numpy(np.float64)
        return pd.DataFrame({"node": f["first"].iloc[:1], "v": [v.tobytes()]})

    def together(f: pd.DataFrame) -> pd.DataFrame:
        f = f.sort_values("j")
        return f[["node"]].iloc[:1].assign(basis=[np.hstack([opened(v, at) for v, at in zip(f["v"], f["node"])]).tobytes()])

    block = nodes.select("first", "number", "root", *[d.alias(f"_{i}") for i, d in enumerate(drawn)]).groupBy("first").applyInPandas(start, "node long, v binary")
    for cycle in range(cycles):
        state, parts = materialize(block.select("node", F.col("v").alias("cur"), F.lit(b"").alias("prev"))), []
        for j in range(degree):
            parts.append(state.select("node", F.lit(j).alias("j"), F.col("cur").alias("v")))
            sent = state.select("node", "cur", F.expr(f"int(node div {size})").alias("j"), F.explode(F.expr(f"sequence(0, {squares - 1})")).alias("i"))
            sums = edges.groupBy("i", "j").cogroup(sent.repartition(squares * squares, "i", "j").groupBy("i", "j")).applyInPandas(multiply, "node long, j int, sums binary")
            state = materialize(state.groupBy("node").cogroup(sums.groupBy("node")).applyInPandas(stepped(1.0 if j == 0 else 2.0), "node long, cur binary, prev binary"))
        parts.append(state.select("node", F.lit(degree).alias("j"), F.col("cur").alias("v")))
        # The basis is put together once in a cycle; a round carries only the last two blocks of it.
        state = materialize(reduce(DataFrame.unionByName, parts).groupBy("node").applyInPandas(together, "node long, basis binary"))
        found = Chebyshev(products(state, width * (degree + 1)), width)
        take = found.coefficients[:, :width]

        def combine(frames, take=take):
            for f in filter(len, frames):
                yield pd.DataFrame({"node": f["node"], "v": [(opened(b, at)[:, : len(take)] @ take).tobytes() for b, at in zip(f["basis"], f["node"])]})

        block = materialize(state.mapInPandas(combine, "node long, v binary"))
        residuals = found.residuals(k)
        if (residuals <= tolerance).all() or take.shape[1] < width:
            break
    edges.unpersist()

    def named(f: pd.DataFrame, v: pd.DataFrame) -> pd.DataFrame:
        return f.sort_values("number")[["node", "mark"]].assign(v=list(opened(v["v"].iloc[0], v["node"].iloc[0])))

    kind = nodes.schema["node"].dataType.simpleString()
    marked = nodes.select("first", "number", "node", drawn[0].alias("mark")).groupBy("first")
    block = materialize(marked.cogroup(block.groupBy("node")).applyInPandas(named, f"node {kind}, mark double, v array<double>"))
    side = block.agg(*[F.sum(F.col("mark") * F.get("v", F.lit(i))).alias(f"_{i}") for i in range(k)]).first() or [0.0] * k
    signed = F.array(*[F.get("v", F.lit(i)) * (-1.0 if (side[i] or 0) < 0 else 1.0) for i in range(min(k, take.shape[1]))])
    return block.select("node", signed.alias("vector")), found.values[:k].tolist(), residuals.tolist()


def products(state: DataFrame, columns: int) -> np.ndarray:
    def part(f: pd.DataFrame) -> dict[int, np.ndarray]:
        sums = np.zeros((columns, columns))
        for row in f["basis"]:
            v = np.frombuffer(row, np.float64).reshape(-1, columns)
            sums += v.T @ v
        return dict(enumerate(sums))

    sums = array_sums(state.select("basis"), part)
    return np.array([sums[i] for i in range(len(sums))])


def spectral_layout(edges: DataFrame, jitter: float = 0.0, seed: int = 42, **how) -> DataFrame:
    """(node, x, y): the second and third eigenvector of the graph of nearest neighbours (src, dst, dist). jitter is the deviation of normal
    noise by hash that is added to both."""
    edges = materialize(edges)  # a search, as a rule, and read for each node's farthest neighbour too
    vectors, _, _ = spectral_vectors(distance_weights(edges), 3, seed=seed, **how)
    noise = lambda tag: jitter * F.sqrt(-2 * F.log(1 - uniform(F.lit(seed), F.lit(tag + "size"), F.col("node")))) * F.cos(2 * np.pi * uniform(F.lit(seed), F.lit(tag), F.col("node")))
    at = lambda i, tag: F.coalesce(F.get("vector", F.lit(i)), F.lit(0.0)) + (noise(tag) if jitter else 0.0)
    return vectors.select("node", at(1, "x").alias("x"), at(2, "y").alias("y"))


def fuzzy_weights(edges: DataFrame, k: int, rounds: int = 64) -> DataFrame:
    """(src, dst, w), each unordered pair once, of (src, dst, dist) to k nearest neighbours: how surely the two are neighbours.

    From a node a neighbour counts exp(-(distance - least distance) / bandwidth); the bandwidth, by bisection, makes a node's neighbours
    count log2 k together. Two directions a and b count a + b - a b. Least distances are the smallest above 0.
    """
    own = edges.groupBy("src").agg(F.sort_array(F.collect_list(F.col("dist").cast("double"))).alias("_d"))  # k numbers
    own = own.withColumn("rho", F.coalesce(F.get(F.filter("_d", lambda d: d > 0), F.lit(0)), F.lit(0.0)))
    total = lambda s: F.aggregate("_d", F.lit(0.0), lambda a, d: a + F.exp(-F.greatest(F.lit(0.0), d - F.col("rho")) / s))
    start = F.struct(F.lit(0.0).alias("lo"), F.lit(float("inf")).alias("hi"), F.lit(1.0).alias("mid"))

    def step(s: Column, _: Column) -> Column:
        over = total(s["mid"]) > float(np.log2(k))
        lo, hi = F.when(over, s["lo"]).otherwise(s["mid"]), F.when(over, s["mid"]).otherwise(s["hi"])
        return F.struct(lo.alias("lo"), hi.alias("hi"), F.when(hi == float("inf"), s["mid"] * 2).otherwise((lo + hi) / 2).alias("mid"))

    own = own.withColumn("sigma", F.greatest(F.aggregate(F.sequence(F.lit(1), F.lit(rounds)), start, step, lambda s: s["mid"]), F.lit(1e-12))).select("src", "rho", "sigma")
    one = edges.where("src <> dst").join(own, "src").select("src", "dst", F.exp(-F.greatest(F.lit(0.0), F.col("dist") - F.col("rho")) / F.col("sigma")).alias("w"))
    pairs = one.groupBy(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).agg(F.max("w").alias("hi"), F.min("w").alias("lo"), F.count("*").alias("n"))
    return pairs.select(F.col("a").alias("src"), F.col("b").alias("dst"), F.when(F.col("n") > 1, F.col("hi") + F.col("lo") - F.col("hi") * F.col("lo")).otherwise(F.col("hi")).alias("w"))


def curve_of(min_dist: float, spread: float = 1.0) -> tuple[float, float]:
    """a and b for which 1 / (1 + a d^(2b)) is nearest to 1 up to min_dist and exp(-(d - min_dist) / spread) beyond; Gauss-Newton steps."""
    d = np.linspace(0, 3 * spread, 301)[1:]
    goal = np.where(d < min_dist, 1.0, np.exp(-(d - min_dist) / spread))
    a, b = 1.0, 1.0
    for _ in range(100):
        p = d ** (2 * b)
        y = 1 / (1 + a * p)
        slopes = np.stack([-p * y * y, -a * p * 2 * np.log(d) * y * y], axis=1)
        da, db = np.linalg.lstsq(slopes, goal - y, rcond=None)[0]
        a, b = max(1e-3, a + 0.5 * da), max(1e-3, b + 0.5 * db)
    return float(a), float(b)


def neighbour_layout(edges: DataFrame, k: int, min_dist: float = 0.3, rounds: int = 30, negatives: int = 5, repulsion: float = 1.0, start: DataFrame | None = None, seed: int = 42) -> DataFrame:
    """(node, x, y): a layout in which sure neighbours attract each other and other nodes, drawn by hash, push each other away.

    edges: (src, dst, dist) to k nearest neighbours; start: (node, x, y), as a rule the spectral layout, which is the default. A round is one join
    of the edges and one of the drawn pairs with the places, and one sum per node; steps shrink to 0. Reruns agree up to rounding.
    """
    a, b = curve_of(min_dist)
    weights = fuzzy_weights(edges, k)
    both = materialize(weights.unionByName(weights.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "w")))
    start = spectral_layout(edges, seed=seed) if start is None else start
    at = materialize(start.select("node", F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y")))
    wide = at.agg(F.max(F.greatest(F.abs("x"), F.abs("y"))).alias("m"), F.count("*").alias("n")).first()
    scale, n = 10.0 / (wide["m"] or 1.0), wide["n"]
    noise = lambda tag: 1e-4 * (uniform(F.lit(seed), F.lit(tag), F.col("node")) - 0.5)  # noqa: E731  # nodes on one place come apart
    places = numbered(at.select("node", (F.col("x") * scale + noise("nx")).alias("x"), (F.col("y") * scale + noise("ny")).alias("y")))
    places = materialize(places)
    d2 = (F.col("x") - F.col("ox")) * (F.col("x") - F.col("ox")) + (F.col("y") - F.col("oy")) * (F.col("y") - F.col("oy"))
    clip = lambda c: F.greatest(F.lit(-4.0), F.least(F.lit(4.0), c))
    for j in range(rounds):
        here = places.select(F.col("node").alias("src"), "x", "y")
        there = places.select(F.col("node").alias("dst"), F.col("x").alias("ox"), F.col("y").alias("oy"))
        pull = both.join(here, "src").join(there, "dst").withColumn("d2", d2)
        force = F.when(F.col("d2") > 0, -2 * a * b * F.pow("d2", F.lit(b - 1)) / (1 + a * F.pow("d2", F.lit(b)))).otherwise(0.0) * F.col("w")
        pull = pull.select("src", *[(clip(force * (F.col(c) - F.col(f"o{c}")))).alias(f"f{c}") for c in "xy"], F.col("w").alias("share"))
        draws = places.select(F.col("node").alias("src"), "x", "y", F.explode(F.sequence(F.lit(1), F.lit(negatives))).alias("s"))
        other = F.pmod(F.xxhash64(F.lit(seed), F.lit(j), "src", "s"), F.lit(n))
        push = draws.withColumn("number", other).join(places.select("number", F.col("x").alias("ox"), F.col("y").alias("oy")), "number").withColumn("d2", d2)
        away = F.when(F.col("d2") > 0, 2 * b / ((0.001 + F.col("d2")) * (1 + a * F.pow("d2", F.lit(b))))).otherwise(0.0)
        push = push.select("src", *[(clip(away * (F.col(c) - F.col(f"o{c}")))).alias(f"f{c}") for c in "xy"], F.lit(0.0).alias("share"))
        # A node's neighbours count as sure as they are; the mean force of its drawn pairs counts as much as all of them.
        sums = pull.withColumn("kind", F.lit(0)).unionByName(push.withColumn("kind", F.lit(1))).groupBy(F.col("src").alias("node")).agg(
            *[F.sum(F.when(F.col("kind") == 0, F.col(f"f{c}")).otherwise(0.0)).alias(f"p{c}") for c in "xy"],
            *[F.avg(F.when(F.col("kind") == 1, F.col(f"f{c}"))).alias(f"q{c}") for c in "xy"], F.sum("share").alias("share"),
        )
        alpha = 1 - j / rounds
        move = lambda c: F.col(c) + alpha * (F.coalesce(f"p{c}", F.lit(0.0)) + F.coalesce(F.col(f"q{c}") * F.col("share") * repulsion, F.lit(0.0))) / F.greatest(F.coalesce("share", F.lit(1.0)), F.lit(1.0))
        places = materialize(places.join(sums, "node", "left").select("node", "number", *[move(c).alias(c) for c in "xy"]))
    return places.select("node", "x", "y")


def numbered(nodes: DataFrame) -> DataFrame:
    """nodes with number, each from 0 once, in the order of a hash: counted by ranges of it, then numbered inside a range."""
    nodes = nodes.withColumn("_h", F.xxhash64("node")).withColumn("_r", F.shiftright("_h", 52))
    before = F.coalesce(F.sum("n").over(W.orderBy("_r").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))  # 4096 rows
    ranges = nodes.groupBy("_r").agg(F.count("*").alias("n")).select("_r", before.alias("_before"))
    place = F.row_number().over(W.partitionBy("_r").orderBy("_h", "node")) - 1
    return nodes.withColumn("_p", place).join(ranges, "_r").withColumn("number", F.col("_before") + F.col("_p")).drop("_h", "_r", "_p", "_before")


def trustworthiness(near: DataFrame, shown: DataFrame, n: int, k: int) -> DataFrame:
    """(trust): 1 less the mean excess of ranks of those among the k nearest in the layout, shown (src, dst, rank), that aren't among the k nearest
    by vectors. near: (src, dst, rank) with all ranks, so for small tables."""
    false = shown.where(F.col("rank") <= k).select("src", "dst").join(near.select("src", "dst", F.col("rank").alias("r")), ["src", "dst"])
    excess = F.sum(F.greatest(F.lit(0), F.col("r") - k))
    return false.agg((1 - excess * 2.0 / (n * k * (2 * n - 3 * k - 1))).alias("trust"))
