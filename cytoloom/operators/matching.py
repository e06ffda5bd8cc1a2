"""Matching the cells of two modalities by place, and what follows from the matches; cluster masks."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cytoloom.functions.percentiles import percentiles

from .gates import affine
from .neighbors import place_pairs, places


def aligned(cells: DataFrame, scale: float = 1.0, flip_y: bool = False, dx: float = 0.0, dy: float = 0.0) -> DataFrame:
    """cells scaled, then flipped, then moved."""
    x, y = affine(F.col("x"), F.col("y"), scale, flip_y, dx, dy)
    return cells.withColumns({"x": x, "y": y})


def _least_ids(cells: DataFrame) -> DataFrame:
    """The places of cells with the least id at each: of cells at one place it alone can be another's nearest, as ties go by id."""
    return places(cells, by=(), id=F.min("cell_id"))


def nearest_within(left: DataFrame, right: DataFrame, radius: float) -> DataFrame:
    """(a_id, b_id, dist): each left cell's nearest right one within the radius, inclusive; ties by the right id.

    Places are compared, not all cells at them, and only with those in squares that suit the cells' density, so a wide radius costs no pairs.
    """
    at = _least_ids(left)
    best = place_pairs(at, _least_ids(right), radius, closest=True).select(F.col("src_id").alias("id"), "dst_id", "d2").join(at.select("id", "x", "y"), "id")
    return left.join(best, ["x", "y"]).select(F.col("cell_id").alias("a_id"), F.col("dst_id").alias("b_id"), F.sqrt("d2").alias("dist"))


def mutual_nearest(left: DataFrame, right: DataFrame, radius: float) -> DataFrame:
    """(a_id, b_id, dist): pairs of cells that are each other's nearest, within the radius; of cells at one place, that of the least id."""
    one, two = _least_ids(left), _least_ids(right)
    ahead = place_pairs(one, two, radius, closest=True).select(F.col("src_id").alias("a_id"), F.col("dst_id").alias("b_id"), F.sqrt("d2").alias("dist"))
    back = place_pairs(two, one, radius, closest=True).select(F.col("dst_id").alias("a_id"), F.col("src_id").alias("b_id"))
    return ahead.join(back, ["a_id", "b_id"])


def one_to_one(matches: DataFrame) -> DataFrame:
    """Matches with each cell once: the nearest for each right cell first, then of those the nearest for each left cell."""
    def first(rows: DataFrame, key: str, other: str) -> DataFrame:
        best = rows.groupBy(key).agg(F.min(F.struct("dist", other)).alias("m"))
        return best.select(key, F.col(f"m.{other}").alias(other), F.col("m.dist").alias("dist"))

    return first(first(matches, "b_id", "a_id"), "a_id", "b_id").select("a_id", "b_id", "dist")


def match_figures(matches: DataFrame, left: DataFrame, right: DataFrame) -> DataFrame:
    """(pairs, rate_a, rate_b, median_dist): matches in per cent of each side to one place, the median distance to two."""
    found = matches.agg(F.count("*").alias("pairs")).join(percentiles(matches, [], "dist", {"m": 0.5}), how="left")  # one row each
    sizes = left.agg(F.count("*").alias("n_a")).crossJoin(right.agg(F.count("*").alias("n_b")))  # one row each
    rate = lambda n: F.when(F.col(n) > 0, F.round(100 * F.col("pairs") / F.col(n), 1))
    return found.crossJoin(sizes).select("pairs", rate("n_a").alias("rate_a"), rate("n_b").alias("rate_b"), F.round("m", 2).alias("median_dist"))


def bound_expression(matches: DataFrame, a: DataFrame, b: DataFrame) -> DataFrame:
    """(pair_id, feature, modality, value): the expression of matched cells one below the other; pair_id is the left id."""
    part = lambda expr, key, name: expr.join(matches.select(F.col("a_id").alias("pair_id"), F.col(key).alias("cell_id")), "cell_id").select("pair_id", "feature", F.lit(name).alias("modality"), "value")
    return part(a, "a_id", "a").unionByName(part(b, "b_id", "b"))


def bound_metadata(matches: DataFrame, a: DataFrame, b: DataFrame, prefixes: tuple[str, str] = ("codex_", "merfish_"), id_col: str = "cell_id") -> DataFrame:
    """(pair_id, the columns of both sides under prefixes, modality) of matched cells."""
    side = lambda df, prefix: df.select(*[F.col(c).alias(prefix + c) for c in df.columns])
    one, two = side(a, prefixes[0]), side(b, prefixes[1])
    out = matches.select(F.col("a_id").alias("pair_id"), "b_id").join(one, F.col("pair_id") == F.col(prefixes[0] + id_col))
    return out.join(two, F.col("b_id") == F.col(prefixes[1] + id_col)).drop("b_id").withColumn("modality", F.lit("integrated"))


def all_values(tables: list[DataFrame], column: str) -> DataFrame:
    """(column): the values of all tables, each once; made distinct in each table first, so repetitions aren't shuffled."""
    return reduce(DataFrame.union, [t.select(column).distinct() for t in tables]).distinct()


def all_features(a: DataFrame, b: DataFrame) -> DataFrame:
    """(feature): of both sides, each once."""
    return all_values([a, b], "feature")


def bounds(cells: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """(keys, x_min, x_max, y_min, y_max) as whole numbers, cut towards 0."""
    return cells.groupBy(*keys).agg(*[f(c).cast("int").alias(f"{c}_{n}") for c in "xy" for n, f in (("min", F.min), ("max", F.max))])


def mask_pixels(cells: DataFrame, cluster: str = "celltype") -> DataFrame:
    """(cluster, px, py): the pixels of each cluster's mask: its cells and their four neighbours, inside the bounds.

    Pixels count from the corner of the whole table; clusters of one cell have no mask.
    """
    box = bounds(cells)
    inside = lambda c, a: F.least(F.greatest((F.col(c) - F.col(f"{c}_min")).cast("int"), F.lit(0)), F.col(f"{c}_max") - F.col(f"{c}_min"))
    many = cells.groupBy(cluster).agg(F.count("*").alias("_n")).where("_n > 1").select(cluster)
    at = cells.where("x IS NOT NULL AND y IS NOT NULL").join(many, cluster, "left_semi").crossJoin(F.broadcast(box))  # one row
    at = at.select(cluster, inside("x", "x").alias("px"), inside("y", "y").alias("py"), (F.col("x_max") - F.col("x_min")).alias("_w"), (F.col("y_max") - F.col("y_min")).alias("_h")).distinct()
    steps = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a, b in ((0, 0), (1, 0), (-1, 0), (0, 1), (0, -1))])
    near = at.withColumn("_s", F.explode(steps)).select(cluster, (F.col("px") + F.col("_s.a")).alias("px"), (F.col("py") + F.col("_s.b")).alias("py"), "_w", "_h")
    return near.where("px BETWEEN 0 AND _w AND py BETWEEN 0 AND _h").select(cluster, "px", "py").distinct()


def compression_factor(mask_gb: Column, clusters: Column, raw_gb: Column, budget_gb: float = 4.0) -> Column:
    """How far masks and image must be scaled down to stay within the budget; never above 1."""
    return F.least(F.lit(1.0), F.sqrt(F.lit(budget_gb) / (mask_gb * clusters + raw_gb)))


def mask_size(cells: DataFrame, cluster: str = "celltype", bytes_a_pixel: float = 1.0, raw_gb: float = 0.0) -> DataFrame:
    """(clusters, mask_gb, factor) of the masks of a table of cells."""
    box = bounds(cells).select(((F.col("x_max") - F.col("x_min") + 1).cast("double") * (F.col("y_max") - F.col("y_min") + 1) * bytes_a_pixel / 1e9).alias("mask_gb"))
    n = cells.groupBy(cluster).agg(F.count("*").alias("_n")).agg(F.count_if(F.col("_n") > 1).alias("clusters"))
    both = box.crossJoin(n)  # one row each
    return both.select("clusters", "mask_gb", compression_factor(F.col("mask_gb"), F.col("clusters"), F.lit(raw_gb)).alias("factor"))
