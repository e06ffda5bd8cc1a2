"""Queries over expression tables, gates and comparisons."""

from __future__ import annotations

from pyspark.sql import functions as F

from cytoloom.cells import cells_from_events
from cytoloom.operators import compare as C
from cytoloom.operators import expression as E
from cytoloom.operators import gates as G
from cytoloom.operators import labels as L

from .common import EVENTS, EXPR, LINES, POSITIVE, expression, lines, load, r6, registry

QUERIES, SQL, query = registry()


def positive(spark, sf_dir):
    return expression(spark, sf_dir).withColumn("value", F.abs("value"))


TOTALS = f"{EXPR}, totals AS (SELECT cell_id, sum(value) AS total_counts, count(*) FILTER (value > 0) AS n_genes FROM expr GROUP BY ALL)"


@query(f"WITH {TOTALS} SELECT cell_id, round(total_counts, 6) AS total_counts, n_genes FROM totals")
def qc_totals(spark, sf_dir):
    return E.qc_totals(expression(spark, sf_dir)).withColumns(r6("total_counts"))


@query(f"WITH {TOTALS} SELECT cell_id, total_counts BETWEEN -1.05 AND 1.05 AND n_genes BETWEEN 25 AND 40 AS keep, false AS missing FROM totals")
def qc_mask(spark, sf_dir):
    return E.qc_mask(E.qc_totals(expression(spark, sf_dir)), (-1.05, 1.05), (25, 40)).select("cell_id", "keep", "missing")


@query(" UNION ALL ".join(f"""SELECT '{c}' AS "column", count(*) FILTER ({c} IS NULL) AS missing FROM documents""" for c in ("lang", "source", "n_chars")))
def missing_report(spark, sf_dir):
    return E.missing_report(load(spark, sf_dir, "documents"), ["lang", "source", "n_chars"])


@query(f"""WITH {EXPR}, v AS (SELECT feature, var_samp(value) AS var FROM expr GROUP BY ALL)
    SELECT feature, round(var, 9) AS var, row_number() OVER (ORDER BY v.var DESC, feature)::INT AS rank FROM v QUALIFY rank <= 10""")
def top_variable(spark, sf_dir):
    return E.top_variable(expression(spark, sf_dir), 10).withColumn("var", F.round("var", 9))


@query(f"WITH {EXPR} SELECT feature FROM expr GROUP BY feature HAVING var_samp(value) > 0")
def varying_features(spark, sf_dir):
    return E.drop_constant_features(expression(spark, sf_dir)).select("feature").distinct()


@query(f"""WITH {EXPR} SELECT cell_id, feature, round(greatest(-2, least(2, (value - avg(value) OVER w) / stddev_samp(value) OVER w)), 6) AS z FROM expr WINDOW w AS (PARTITION BY feature)""")
def feature_zscore(spark, sf_dir):
    return E.zscore(expression(spark, sf_dir), clip=2.0).select("cell_id", "feature", "z").withColumns(r6("z"))


@query(f"WITH {POSITIVE} SELECT cell_id, feature, round(ln(1 + value / sum(value) OVER (PARTITION BY cell_id) * 1e4), 6) AS norm FROM expr")
def log_normalise(spark, sf_dir):
    return E.log_normalise(positive(spark, sf_dir)).select("cell_id", "feature", "norm").withColumns(r6("norm"))


@query(f"""WITH {POSITIVE}, v AS (SELECT vec_id AS cell_id, CASE WHEN vec_id % 7 = 0 THEN 1e-6 ELSE vec_id % 7 END AS volume FROM embeddings), m AS (SELECT quantile_cont(volume, 0.5) AS mid FROM v)
    SELECT cell_id, feature, round(ln(1 + value / volume * mid), 6) AS norm FROM expr JOIN v USING (cell_id), m""")
def volume_normalise(spark, sf_dir):
    volumes = load(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("cell_id"), (F.col("vec_id") % 7).cast("double").alias("volume"))
    return E.volume_normalise(positive(spark, sf_dir), volumes).select("cell_id", "feature", "norm").withColumns(r6("norm"))


@query(f"""WITH {POSITIVE}, c AS (SELECT cell_id, sum(value) AS lib FROM expr GROUP BY ALL), g AS (SELECT feature, avg(value) AS gene FROM expr GROUP BY ALL),
    w AS (SELECT avg(lib) AS mean_lib, sqrt(count(*)) AS edge FROM c), m AS (SELECT cell_id, feature, value, edge, lib * gene / mean_lib AS mu FROM expr JOIN c USING (cell_id) JOIN g USING (feature), w)
    SELECT cell_id, feature, round(greatest(-edge, least(edge, (value - mu) / sqrt(mu + mu * mu / 100))), 6) AS residual FROM m""")
def pearson_residuals(spark, sf_dir):
    return E.pearson_residuals(positive(spark, sf_dir)).select("cell_id", "feature", "residual").withColumns(r6("residual"))


SUMMARY = f"""{EXPR}, b AS (SELECT celltype, feature, quantile_cont(value, 0.5) AS mid, avg(value) AS mean FROM expr GROUP BY ALL),
    u AS (SELECT bool_or(s = 0) AS use_mean FROM (SELECT sum(mid) AS s FROM b GROUP BY feature)), summary AS (SELECT celltype, feature, CASE WHEN use_mean THEN mean ELSE mid END AS value FROM b, u)"""


@query(f"WITH {SUMMARY} SELECT celltype, feature, round(value, 6) AS value FROM summary")
def group_summary(spark, sf_dir):
    return E.group_summary(expression(spark, sf_dir)).withColumns(r6("value"))


@query(f"""WITH {EXPR}, m AS (SELECT celltype, feature, exp(avg(value)) AS e FROM expr GROUP BY ALL), s AS (SELECT celltype, e / sum(e) OVER (PARTITION BY celltype) AS p FROM m),
    h AS (SELECT celltype, -sum(p * log2(p)) AS entropy FROM s GROUP BY ALL)
    SELECT celltype, round(entropy, 6) AS entropy, (entropy - avg(entropy) OVER ()) / stddev_samp(entropy) OVER () > 2 AS flagged FROM h""")
def cluster_entropy(spark, sf_dir):
    means = expression(spark, sf_dir).groupBy("celltype", "feature").agg(F.avg("value").alias("value"))
    return E.group_entropy(means).select("celltype", "entropy", "flagged").withColumns(r6("entropy"))


SIGNED = f"""{EXPR}, m AS (SELECT celltype, feature, avg(value) AS m FROM expr GROUP BY ALL),
    q AS (SELECT *, quantile_cont(m, 0.05) OVER w AS lo, quantile_cont(m, 0.9) OVER w AS hi FROM m WINDOW w AS (PARTITION BY celltype)),
    signed AS (SELECT celltype, string_agg(feature || CASE WHEN m > 0 THEN '+' ELSE '-' END, ',' ORDER BY feature) AS signature FROM q WHERE m > hi OR m < lo GROUP BY ALL)"""


@query(f"WITH {SIGNED} SELECT celltype, signature FROM signed")
def marker_signature(spark, sf_dir):
    return E.marker_signature(expression(spark, sf_dir))


@query(f"WITH {SIGNED} SELECT celltype, 'Tissue: lymph node. Markers of the cluster: ' || signature || '. Name the cell type.' AS prompt FROM signed")
def cluster_prompts(spark, sf_dir):
    """What a language model would be asked about each cluster."""
    return L.prompts(E.marker_signature(expression(spark, sf_dir)), "lymph node")


@query(f"""WITH {LINES}, m AS (SELECT min(discount) AS low FROM cells WHERE quantity > 10) SELECT cell_id, round(log2(CASE WHEN low <= 0 THEN discount + abs(low) + 1 ELSE discount END), 6) AS axis FROM cells, m""")
def log2_axis(spark, sf_dir):
    """An axis under log2, moved by the least value of a population."""
    cells = lines(spark, sf_dir).withColumn("many", F.col("quantity") > 10)
    return G.transform_axis(cells, "discount", "log2", "axis", "many").select("cell_id", F.round("axis", 6).alias("axis"))


TEMPLATE = [("early", "g00+,g01-"), ("late", "g02+, g03+"), ("odd", "g05-,g06-,g07+"), ("any", "g09-")]
NEEDS = ", ".join(f"('{n}', '{m.strip()[:-1]}', '{m.strip()[-1]}')" for n, ms in TEMPLATE for m in ms.split(","))


@query(f"""WITH {EXPR}, b AS (SELECT celltype, feature, quantile_cont(value, 0.5) AS v FROM expr GROUP BY ALL),
    z AS (SELECT celltype, feature, CASE WHEN v > avg(v) OVER (PARTITION BY feature) THEN '+' ELSE '-' END AS sign FROM b), t(name, feature, need) AS (VALUES {NEEDS}),
    f AS (SELECT celltype, name FROM z JOIN t USING (feature) GROUP BY ALL HAVING bool_and(sign = need)), n AS (SELECT celltype, string_agg(name, ',' ORDER BY name) AS names FROM f GROUP BY ALL)
    SELECT celltype, coalesce(names, 'Unannotated') AS phenotype FROM (SELECT DISTINCT celltype FROM expr) LEFT JOIN n USING (celltype)""")
def template_phenotypes(spark, sf_dir):
    return E.template_phenotypes(expression(spark, sf_dir), spark.createDataFrame(TEMPLATE, "celltype_name string, markers string"))


def _gate(name, parent, *axes):
    gate = {"id": name, "parent": parent, "x_var": None, "y_var": None}
    for axis, (var, transform, operator, low, high) in zip("xy", axes):
        gate |= {f"{axis}_var": var, f"{axis}_transform": transform, f"{axis}_operator": operator, f"{axis}_lo": low, f"{axis}_hi": high}
    return gate


GATES = [
    _gate("G1", None, ("quantity", "none", "between", 10.5, 40.5), ("extendedprice", "log10", "gt", 4.1234, None)),
    _gate("G2", "G1", ("discount", "zscore", "gte", 0.2222, None), ("tax", "ln", "lt", 0.0555, None)),
    _gate("G3", "G1", ("tax", "none", "between", 0.0151, 0.0449)),
]
GATED = f"""{LINES}, a AS (SELECT *, (quantity BETWEEN 10.5 AND 40.5 AND log10(extendedprice) > 4.1234)::INT AS G1 FROM cells),
    s AS (SELECT avg(discount) AS m, stddev_samp(discount) AS sd, min(tax) AS low FROM a WHERE G1 = 1),
    gated AS (SELECT a.*, (G1 = 1 AND (discount - m) / sd >= 0.2222 AND ln(CASE WHEN low <= 0 THEN tax + abs(low) + 1 ELSE tax END) < 0.0555)::INT AS G2, (G1 = 1 AND tax BETWEEN 0.0151 AND 0.0449)::INT AS G3 FROM a, s)"""


@query(f"WITH {GATED} SELECT cell_id, G1, G2, G3 FROM gated")
def gate_replay(spark, sf_dir):
    return G.replay_gates(lines(spark, sf_dir), GATES).select("cell_id", "G1", "G2", "G3")


@query(f"""WITH {GATED}, n AS (SELECT count(*) AS n, sum(G1) AS g1, sum(G2) AS g2, sum(G3) AS g3 FROM gated), r AS (
    SELECT 'G1' AS gate_id, NULL::VARCHAR AS parent, 'G1' AS path, 1 AS depth, n AS before, g1 AS after, n FROM n UNION ALL SELECT 'G2', 'G1', 'G1/G2', 2, g1, g2, n FROM n UNION ALL SELECT 'G3', 'G1', 'G1/G3', 2, g1, g3, n FROM n)
    SELECT gate_id, parent, path, depth, before::BIGINT AS n_before, after::BIGINT AS n_after, round(100 * after / before, 2) AS pct_parent, round(100 * after / n, 2) AS pct_total FROM r""")
def gate_stats(spark, sf_dir):
    return G.gate_stats(G.replay_gates(lines(spark, sf_dir), GATES), GATES)


@query(f"WITH {GATED} SELECT cell_id, CASE WHEN G2 = 1 AND G3 = 1 THEN 'G2+G3' WHEN G2 = 1 THEN 'G2' WHEN G3 = 1 THEN 'G3' WHEN G1 = 1 THEN 'G1' ELSE 'Ungated' END AS gate_label FROM gated")
def deepest_gate(spark, sf_dir):
    return G.deepest_gate(G.replay_gates(lines(spark, sf_dir), GATES), GATES).select("cell_id", "gate_label")


POLYGONS = {"A": [(20.0, 40.0), (260.5, 90.0), (190.0, 400.0), (120.0, 180.0), (60.0, 390.0)], "B": [(100.0, 100.0), (330.0, 120.0), (150.0, 450.0)]}


def _inside(vertices) -> str:
    sides = zip(vertices, [vertices[-1], *vertices[:-1]])
    return " + ".join(f"(({b} > y) <> ({d} > y) AND x < {c - a}::DOUBLE * (y - {b}) / ({d - b}::DOUBLE) + {a})::INT" for (a, b), (c, d) in sides)


@query(f"""WITH {EVENTS}, g AS (SELECT cell_id, concat_ws(',', {", ".join(f"CASE WHEN ({_inside(v)}) % 2 = 1 THEN '{k}' END" for k, v in POLYGONS.items())}) AS gate FROM cells)
    SELECT cell_id, gate FROM g WHERE gate <> ''""")
def polygon_gates(spark, sf_dir):
    return G.polygon_gates(cells_from_events(load(spark, sf_dir, "events")), POLYGONS).select("cell_id", "gate")


@query(f"WITH {LINES} SELECT cell_id, round(greatest((quantity + discount) * tax, discount), 6) AS made, celltype || '_' || round(quantity)::INT::VARCHAR AS pasted FROM cells")
def computed_columns(spark, sf_dir):
    cells = lines(spark, sf_dir).withColumn("whole", F.round("quantity").cast("int"))
    made = G.computed_column(["quantity", "discount", "tax", "discount"], ["+", "*", "pmax"])
    return cells.select("cell_id", F.round(made, 6).alias("made"), G.computed_column(["celltype", "whole"], ["paste"]).alias("pasted"))


@query(f"""WITH {EVENTS}, c AS (SELECT sample_id, celltype, count(*) AS n FROM cells GROUP BY ALL), f AS (SELECT s.sample_id, t.celltype, coalesce(n, 0) AS n
    FROM (SELECT DISTINCT sample_id FROM c) s CROSS JOIN (SELECT DISTINCT celltype FROM c) t LEFT JOIN c ON c.sample_id = s.sample_id AND c.celltype = t.celltype)
    SELECT sample_id, celltype, n, round(n / sum(n) OVER (PARTITION BY sample_id), 6) AS density FROM f""")
def cell_counts(spark, sf_dir):
    return C.cell_counts(cells_from_events(load(spark, sf_dir, "events"))).withColumns(r6("density"))


@query("SELECT lang, count(*) AS n, round(count(*) / sum(count(*)) OVER (), 6) AS proportion FROM documents WHERE lang IS NOT NULL GROUP BY lang")
def proportions(spark, sf_dir):
    return C.proportions(load(spark, sf_dir, "documents"), "lang").withColumns(r6("proportion"))


@query("SELECT toxic, round(avg(quality), 6) AS mean FROM labels GROUP BY toxic")
def binary_means(spark, sf_dir):
    return C.binary_mean(load(spark, sf_dir, "labels"), "quality", "toxic").withColumns(r6("mean"))


@query(" UNION ALL ".join(f"""SELECT '{c}' AS "column", CASE WHEN count(DISTINCT {c}) <= 2 AND bool_and({c} IN (0, 1)) THEN 'binary' WHEN count(DISTINCT {c}) <= 10 THEN 'categorical' ELSE 'continuous' END AS kind FROM labels""" for c in ("doc_id", "quality", "toxic")))
def column_kinds(spark, sf_dir):
    return C.column_kinds(load(spark, sf_dir, "labels"), ["doc_id", "quality", "toxic"])


@query("SELECT lang FROM documents WHERE lang IS NOT NULL GROUP BY lang HAVING count(DISTINCT source) = (SELECT count(DISTINCT source) FROM documents)")
def common_values(spark, sf_dir):
    return C.common_values(load(spark, sf_dir, "documents").where("lang IS NOT NULL"), "lang", "source")


@query(f"""WITH {LINES}, s AS (SELECT celltype, count(*) AS size, least(1, 500.0::DOUBLE / sum(count(*)) OVER ()) * count(*) AS exact FROM cells GROUP BY ALL),
    q AS (SELECT celltype, floor(exact) + (row_number() OVER (ORDER BY exact - floor(exact) DESC, celltype) <= least(500, sum(size) OVER ()) - sum(floor(exact)) OVER ())::INT AS quota FROM s)
    SELECT cell_id, celltype FROM cells JOIN q USING (celltype) QUALIFY row_number() OVER (PARTITION BY celltype ORDER BY md5('99:' || cell_id::VARCHAR), cell_id) <= quota""")
def stratified_downsample(spark, sf_dir):
    return C.stratified_downsample(lines(spark, sf_dir), 500, "celltype", "cell_id").select("cell_id", "celltype")
