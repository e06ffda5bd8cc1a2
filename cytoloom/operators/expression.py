"""Expression tables: quality control, normalisation, feature statistics. Long form: cell_id, feature, value."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from cytoloom.functions.mixtures import high_share, two_normals
from cytoloom.functions.percentiles import percentiles


def qc_totals(expr: DataFrame) -> DataFrame:
    """(cell_id, total_counts, n_genes)."""
    return expr.groupBy("cell_id").agg(F.sum("value").alias("total_counts"), F.count(F.when(F.col("value") > 0, 1)).alias("n_genes"))


def qc_mask(
    totals: DataFrame,
    counts: tuple[float, float] | None = (10, 50_000),
    genes: tuple[float, float] | None = (5, 2_000),
    area: tuple[float, float] | None = None,
    max_blank: float | None = None,
    density: tuple[float, float] | None = None,
) -> DataFrame:
    """totals with keep and missing: keep holds if every active bound does (bounds inclusive); nulls fail, and are told apart."""
    total = F.col("total_counts")
    tests: list[Column] = []
    for bounds, value in ((counts, total), (genes, F.col("n_genes"))):
        if bounds:
            tests.append(value.between(*bounds))
    if area:
        tests.append(F.col("area").between(*area))
    if max_blank is not None:
        tests.append(F.col("blank_counts") / (total + 1e-10) <= max_blank)
    if density:
        tests.append((total / (F.col("area") + 1e-10)).between(*density))
    every = reduce(Column.__and__, tests) if tests else F.lit(True)
    missing = reduce(Column.__or__, [t.isNull() for t in tests]) if tests else F.lit(False)
    return totals.withColumns({"keep": F.coalesce(every, F.lit(False)), "missing": missing})


def complete_cases(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.dropna(subset=columns)


def missing_report(df: DataFrame, columns: list[str]) -> DataFrame:
    """(column, missing): nulls and NaNs of each column, in one pass."""
    bad = lambda c: F.col(c).isNull() | F.coalesce(F.isnan(F.col(c).try_cast("double")), F.lit(False))
    counts = df.agg(*[F.count(F.when(bad(c), 1)).alias(c) for c in columns])
    pairs = F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).alias("missing")) for c in columns]))
    return counts.select(pairs.alias("p")).select("p.*")


def feature_stats(expr: DataFrame) -> DataFrame:
    return expr.groupBy("feature").agg(F.avg("value").alias("mean"), F.var_samp("value").alias("var"), F.stddev_samp("value").alias("sd"))


def drop_constant_features(expr: DataFrame) -> DataFrame:
    """expr without the features whose variance is 0 or undefined."""
    useful = feature_stats(expr).where(F.col("var") > 0).select("feature")
    return expr.join(useful, "feature", "left_semi")


def top_variable(expr: DataFrame, n: int) -> DataFrame:
    """(feature, var, rank): the n features of largest variance, ties by name."""
    found = feature_stats(expr).orderBy(F.desc("var"), "feature").limit(n)  # one row per feature
    return found.select("feature", "var", F.row_number().over(W.orderBy(F.desc("var"), "feature")).alias("rank"))


def zscore(expr: DataFrame, keys: tuple[str, ...] = ("feature",), clip: float | None = None) -> DataFrame:
    """expr with z: value standardised within the keys with the sample deviation; undefined values are 0."""
    stats = expr.groupBy(*keys).agg(F.avg("value").alias("_m"), F.stddev_samp("value").alias("_s"))
    z = F.when(F.col("_s") > 0, (F.col("value") - F.col("_m")) / F.col("_s")).otherwise(F.lit(0.0))
    z = F.greatest(F.lit(-clip), F.least(F.lit(clip), z)) if clip else z
    return expr.join(stats, list(keys)).withColumn("z", F.coalesce(z, F.lit(0.0))).drop("_m", "_s")


def log_normalise(expr: DataFrame, scale: float = 1e4, log: bool = True) -> DataFrame:
    """Counts per scale of each cell's total, and their log1p."""
    size = expr.groupBy("cell_id").agg(F.sum("value").alias("_size"))
    part = F.when(F.col("_size") != 0, F.col("value") / F.col("_size") * scale).otherwise(F.lit(0.0))
    return expr.join(size, "cell_id").withColumn("norm", F.log1p(part) if log else part).drop("_size")


def volume_normalise(expr: DataFrame, volumes: DataFrame) -> DataFrame:
    """log1p of value / volume * median volume; volumes (cell_id, volume) of 0 or less count as 1e-6."""
    safe = volumes.select("cell_id", F.when(F.col("volume") <= 0, F.lit(1e-6)).otherwise(F.col("volume")).alias("_v"))
    middle = percentiles(safe, [], "_v", {"_mid": 0.5})
    joined = expr.join(safe, "cell_id").crossJoin(F.broadcast(middle))  # one row
    return joined.withColumn("norm", F.log1p(F.col("value") / F.col("_v") * F.col("_mid"))).drop("_v", "_mid")


def pearson_residuals(expr: DataFrame, theta: float = 100.0) -> DataFrame:
    """(x - mu) / sqrt(mu + mu^2 / theta), mu = total of the cell * mean of the feature / mean total; clipped at sqrt(cells)."""
    cell = expr.groupBy("cell_id").agg(F.sum("value").alias("_lib"))
    gene = expr.groupBy("feature").agg(F.avg("value").alias("_gene"))
    whole = cell.agg(F.avg("_lib").alias("_mean"), F.count("*").alias("_n"))
    mu = F.col("_lib") * F.col("_gene") / F.col("_mean")
    joined = expr.join(cell, "cell_id").join(gene, "feature").crossJoin(F.broadcast(whole)).withColumn("_mu", mu)  # one row
    spread = F.sqrt(F.col("_mu") + F.col("_mu") * F.col("_mu") / theta)
    edge = F.sqrt(F.col("_n").cast("double"))
    z = F.when(spread > 0, (F.col("value") - F.col("_mu")) / spread).otherwise(F.lit(0.0))
    return joined.withColumn("residual", F.greatest(-edge, F.least(edge, z))).select(*expr.columns, "residual")


def group_summary(expr: DataFrame, group: str = "celltype") -> DataFrame:
    """(group, feature, value): medians; if the medians of any feature sum to 0 over the groups, means for all."""
    means = expr.groupBy(group, "feature").agg(F.avg("value").alias("_mean"))
    both = percentiles(expr, [group, "feature"], "value", {"_median": 0.5}).join(means, [group, "feature"])
    sums = both.groupBy("feature").agg((F.sum("_median") == 0).alias("_zero")).agg(F.max("_zero").alias("_use_mean"))
    pick = F.when(F.col("_use_mean"), F.col("_mean")).otherwise(F.col("_median"))
    return both.crossJoin(F.broadcast(sums)).select(group, "feature", pick.alias("value"))  # one row


def group_entropy(summary: DataFrame, group: str = "celltype", cut: float = 2.0) -> DataFrame:
    """(group, entropy, z, flagged): entropy in bits over features of exp(value) / sum, standardised over the groups."""
    p = summary.withColumn("_e", F.exp("value"))
    total = p.groupBy(group).agg(F.sum("_e").alias("_t"))
    share = F.col("_e") / F.col("_t")
    h = p.join(total, group).groupBy(group).agg((-F.sum(share * F.log2(share))).alias("entropy"))
    stats = h.agg(F.avg("entropy").alias("_m"), F.stddev_samp("entropy").alias("_s"))
    z = (F.col("entropy") - F.col("_m")) / F.col("_s")
    return h.crossJoin(F.broadcast(stats)).select(group, "entropy", z.alias("z"), F.coalesce(z > cut, F.lit(False)).alias("flagged"))


def marker_signature(expr: DataFrame, group: str = "celltype", low: float = 0.05, high: float = 0.9) -> DataFrame:
    """(group, signature): of each group the features whose mean is beyond the group's quantiles, as name and sign, in order of name."""
    means = expr.groupBy(group, "feature").agg(F.avg("value").alias("m"))
    cuts = means.groupBy(group).agg(F.expr(f"percentile(m, {low})").alias("_lo"), F.expr(f"percentile(m, {high})").alias("_hi"))
    out = means.join(cuts, group).where((F.col("m") > F.col("_hi")) | (F.col("m") < F.col("_lo")))
    sign = F.when(F.col("m") > 0, F.lit("+")).otherwise(F.lit("-"))
    return out.groupBy(group).agg(F.array_join(F.sort_array(F.collect_list(F.concat("feature", sign))), ",").alias("signature"))


def _satisfied(high: DataFrame, template: DataFrame, group: str) -> DataFrame:
    """(group, phenotype): the names of the template rows all of whose signs a group has in (group, feature, sign)."""
    needs = template.select("celltype_name", F.explode(F.split("markers", r"\s*,\s*")).alias("m"))
    needs = needs.select("celltype_name", F.expr("substring(m, 1, length(m) - 1)").alias("feature"), F.expr("right(m, 1)").alias("need"))
    size = needs.groupBy("celltype_name").agg(F.count("*").alias("size"))
    met = high.join(needs, "feature").where("sign = need").groupBy(group, "celltype_name").agg(F.count("*").alias("met"))
    full = met.join(size, "celltype_name").where("met = size")
    return full.groupBy(group).agg(F.array_join(F.sort_array(F.collect_list("celltype_name")), ",").alias("phenotype"))


def template_phenotypes(expr: DataFrame, template: DataFrame, group: str = "celltype") -> DataFrame:
    """(group, phenotype): the template rows (celltype_name, markers like ``CD3+,CD4-``) that a group satisfies, or Unannotated.

    A marker is high if the group's median, standardised over the groups, is above 0. Only the last sign is taken off a marker.
    """
    medians = percentiles(expr, [group, "feature"], "value", {"value": 0.5})
    high = zscore(medians).select(group, "feature", F.when(F.col("z") > 0, "+").otherwise("-").alias("sign"))
    names = _satisfied(high, template, group)
    every = expr.select(group).distinct()
    return every.join(names, group, "left").select(group, F.coalesce("phenotype", F.lit("Unannotated")).alias("phenotype"))


def joint_features(a: DataFrame, b: DataFrame, pairs: DataFrame, weight: float = 0.5) -> DataFrame:
    """(pair_id, feature, value): standardised features of matched cells, weighted by weight and 1 - weight; pairs: pair_id, a_id, b_id."""
    part = lambda expr, key, w, tag: zscore(expr.join(pairs.select("pair_id", F.col(key).alias("cell_id")), "cell_id")).select(
        "pair_id", F.concat(F.lit(tag), "feature").alias("feature"), (F.col("z") * w).alias("value")
    )
    return part(a, "a_id", weight, "a_").unionByName(part(b, "b_id", 1 - weight, "b_"))


def template_phenotypes_by_mixture(expr: DataFrame, template: DataFrame, group: str = "celltype", compat: bool = False) -> DataFrame:
    """(group, phenotype): as template_phenotypes(), but a marker is high if its group's median is more likely of the higher of two normal
    components of the feature; groups that satisfy no row are Unannotated_ and their name.

    The components are fitted to the values of all cells; compat fits them to the groups' medians.
    """
    medians = percentiles(expr, [group, "feature"], "value", {"value": 0.5})
    model = two_normals(medians if compat else expr, ["feature"], "value")
    high = high_share(medians, model, ["feature"], "value").select(group, "feature", F.when(F.col("high") > 0.5, "+").otherwise("-").alias("sign"))
    named = _satisfied(high, template, group)
    every = expr.select(group).distinct()
    return every.join(named, group, "left").select(group, F.coalesce("phenotype", F.concat(F.lit("Unannotated_"), F.col(group).cast("string"))).alias("phenotype"))
