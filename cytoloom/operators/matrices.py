"""Type by type matrices in long form (matrix, ref, query, value): subsets, unions, averages, shared scales, and inputs of chord diagrams.

Matrices have one row per pair of types, so all of this is small; infinite values are ordinary doubles.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

INF = float("inf")


def infinite(c: Column) -> Column:
    return F.coalesce(F.abs(c) == INF, F.lit(False))


def finite(c: Column) -> Column:
    return c.isNotNull() & ~F.isnan(c) & ~infinite(c)


def softplus(c: Column) -> Column:
    """ln(exp(x) + 1): 0 for minus infinity; x itself where it is so large that nothing is added."""
    return F.when(c > 700, c).when(c == -INF, 0.0).otherwise(F.log1p(F.exp(c)))


def of_types(matrices: DataFrame, types: list[str]) -> DataFrame:
    return matrices.where(F.col("ref").isin(*types) & F.col("query").isin(*types))


def unimodal(matrices: DataFrame, ref: str | None) -> DataFrame:
    """All columns but one reference set to 0; unchanged without a reference."""
    return matrices if not ref else matrices.withColumn("value", F.when(F.col("ref") == ref, F.col("value")).otherwise(0.0))


def without_diagonal(matrices: DataFrame) -> DataFrame:
    return matrices.withColumn("value", F.when(F.col("ref") == F.col("query"), 0.0).otherwise(F.col("value")))


def types_of(matrices: DataFrame) -> DataFrame:
    return matrices.select("matrix", F.explode(F.array("ref", "query")).alias("type")).distinct()


def common_types(matrices: DataFrame) -> DataFrame:
    """(type): those that every matrix has; of one matrix all."""
    own = types_of(matrices)
    n = own.agg(F.count_distinct("matrix").alias("_n"))
    return own.groupBy("type").agg(F.count("*").alias("_k")).crossJoin(F.broadcast(n)).where("_k = _n").select("type")  # one row


def intersected(matrices: DataFrame) -> DataFrame:
    """The pairs of the types that every matrix has."""
    common = common_types(matrices)
    return matrices.join(common.withColumnRenamed("type", "ref"), "ref", "left_semi").join(common.withColumnRenamed("type", "query"), "query", "left_semi").select(matrices.columns)


def united(matrices: DataFrame, fill: float = -INF) -> DataFrame:
    """Every matrix over the types of all of them; pairs that one lacks get the fill."""
    types = types_of(matrices).select("type").distinct()
    full = matrices.select("matrix").distinct().crossJoin(types.withColumnRenamed("type", "ref")).crossJoin(types.withColumnRenamed("type", "query"))
    own = matrices.select("matrix", "ref", "query", "value", F.lit(True).alias("_own"))
    joined = full.join(own, ["matrix", "ref", "query"], "left")
    return joined.select("matrix", "ref", "query", F.when(F.col("_own"), F.col("value")).otherwise(fill).alias("value"))


def status(matrices: DataFrame) -> DataFrame:
    """(matrix, has_inf, has_negative, all_nonnegative) off the diagonal; signs are those of finite values."""
    m = without_diagonal(matrices)
    value = F.col("value")
    ok = finite(value)
    return m.groupBy("matrix").agg(
        F.coalesce(F.bool_or(infinite(value)), F.lit(False)).alias("has_inf"),
        F.coalesce(F.bool_or(ok & (value < 0)), F.lit(False)).alias("has_negative"),
        F.coalesce(F.bool_and(~ok | (value >= 0)), F.lit(True)).alias("all_nonnegative"),
    )


def scale_warning(state: DataFrame) -> DataFrame:
    """(warning): ``inf`` if some but not all matrices have infinite values, ``sign`` if none has and only some have negative ones, or null."""
    some = state.agg(
        F.bool_or("has_inf").alias("inf"), F.bool_and("has_inf").alias("all_inf"), F.bool_or("all_nonnegative").alias("plus"), F.bool_or("has_negative").alias("minus")
    )
    return some.select(F.when(F.col("inf") & ~F.col("all_inf"), "inf").when(~F.col("inf") & F.col("plus") & F.col("minus"), "sign").alias("warning"))


def integrated(matrices: DataFrame, every: bool = False, negative: bool = False, ref: str | None = None, whole_set: bool = False) -> DataFrame:
    """(ref, query, value): the mean over matrices, after softplus of those with infinite values off the diagonal.

    every transforms all; negative those with negative values too; whole_set all as soon as one has infinite values. A reference
    sets all others to 0 afterwards. One matrix gives itself.
    """
    state = status(matrices).select("matrix", "has_inf", "has_negative")
    if whole_set:
        state = state.withColumn("has_inf", F.max("has_inf").over(W.partitionBy()))  # one row per matrix
    change = F.lit(every) | F.col("has_inf") | (F.lit(negative) & F.col("has_negative"))
    joined = matrices.join(state, "matrix").withColumn("value", F.when(change, softplus(F.col("value"))).otherwise(F.col("value")))
    return unimodal(joined.groupBy("ref", "query").agg(F.avg("value").alias("value")), ref)


def harmonised(matrices: DataFrame, ref: str | None = None, compat: bool = False) -> DataFrame:
    """All matrices on one scale: softplus, then the reference's mask, then a zero diagonal; compat masks first, so that masked pairs become ln 2."""
    plus = lambda m: m.withColumn("value", softplus(F.col("value")))
    made = plus(unimodal(matrices, ref)) if compat else unimodal(plus(matrices), ref)
    return without_diagonal(made)


def active_references(matrices: DataFrame) -> DataFrame:
    """(matrix, ref): columns whose values don't sum to zero."""
    return matrices.groupBy("matrix", "ref").agg(F.sum("value").alias("_s")).where(F.abs("_s") > 0).select("matrix", "ref")


def shared_ramp(matrices: DataFrame) -> DataFrame:
    """(low, middle, high) over the active columns of all matrices: minimum, median or 0, maximum."""
    active = matrices.join(active_references(matrices), ["matrix", "ref"], "left_semi")
    ends = active.agg(F.min("value").alias("low"), F.percentile("value", F.lit(0.5)).alias("middle"), F.max("value").alias("high"))
    return ends.select("low", F.coalesce("middle", F.lit(0.0)).alias("middle"), "high")


def legend(matrices: DataFrame) -> DataFrame:
    """(matrix, q0, q25, q50, q75, q100) of the active columns, to four places."""
    active = matrices.join(active_references(matrices), ["matrix", "ref"], "left_semi")
    q = F.percentile("value", F.array(*[F.lit(x / 4) for x in range(5)]))
    return active.groupBy("matrix").agg(q.alias("q")).select("matrix", *[F.round(F.get("q", F.lit(k)), 4).alias(f"q{25 * k}") for k in range(5)])


def chord_inputs(matrices: DataFrame, self_interactions: bool = False) -> tuple[DataFrame, DataFrame]:
    """(links, ramps) of chord diagrams, per matrix.

    links: (matrix, ref, query, value) of active columns, with a zero diagonal unless self_interactions, and softplus where a matrix
    has infinite values. ramps: (matrix, low, centre, high): the centre is 0, or halfway for transformed matrices; equal ends move
    apart by a half each.
    """
    m = matrices if self_interactions else without_diagonal(matrices)
    m = m.withColumn("_changed", F.max(infinite(F.col("value"))).over(W.partitionBy("matrix")))  # one matrix per partition
    m = m.withColumn("value", F.when(F.col("_changed"), softplus(F.col("value"))).otherwise(F.col("value")))
    m = m if self_interactions else without_diagonal(m)
    links = m.join(active_references(m), ["matrix", "ref"], "left_semi")
    ends = links.groupBy("matrix").agg(F.min("value").alias("low"), F.max("value").alias("high"), F.max("_changed").alias("_changed"))
    flat = F.col("low") == F.col("high")
    low, high = F.when(flat, F.col("low") - 0.5).otherwise(F.col("low")), F.when(flat, F.col("high") + 0.5).otherwise(F.col("high"))
    ramps = ends.select("matrix", low.alias("low"), F.when(F.col("_changed"), (low + high) / 2).otherwise(0.0).alias("centre"), high.alias("high"))
    return links.select("matrix", "ref", "query", "value"), ramps


def wide(matrix: DataFrame, types: list[str]) -> DataFrame:
    """A matrix with one row per query and one column per reference, in the given order."""
    return matrix.groupBy("query").pivot("ref", types).agg(F.first("value")).select("query", *[F.col(f"`{t}`") for t in types])
