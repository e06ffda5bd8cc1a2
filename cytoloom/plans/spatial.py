"""Queries over neighbour joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cytoloom.operators import interactions as I
from cytoloom.operators import neighbors as N

from .common import D2, EVENTS, KNN, VECTORS, events, r6, registry, vectors

QUERIES, SQL, query = registry()
MEMBERS = ["click", "purchase", "view"]
LO, HI = I.annulus(0.5, 1, 3)


CONTACTS = f"""{EVENTS},
    p AS (SELECT a.sample_id, a.celltype AS ref, b.celltype AS query, a.cell_id AS src, b.cell_id AS dst FROM cells a JOIN cells b
          ON a.sample_id = b.sample_id AND {D2} > {LO * LO!r} AND {D2} < {HI * HI!r}),
    f AS (SELECT sample_id, ref, query, count(*) AS contacts, count(DISTINCT src) AS ref_cells, count(DISTINCT dst) AS query_cells FROM p GROUP BY ALL),
    s AS (SELECT sample_id, celltype, count(*) AS size FROM cells GROUP BY ALL),
    t AS (SELECT a.sample_id, a.celltype AS ref, b.celltype AS query, a.size AS n_ref, b.size AS n_query, sum(b.size) OVER (PARTITION BY a.sample_id, a.celltype) AS n,
                 coalesce(contacts, 0) AS contacts, coalesce(ref_cells, 0) AS ref_cells, coalesce(query_cells, 0) AS query_cells
          FROM s a JOIN s b USING (sample_id) LEFT JOIN f ON f.sample_id = a.sample_id AND f.ref = a.celltype AND f.query = b.celltype),
    o AS (SELECT sample_id, ref, query, CASE WHEN sum(contacts) OVER w = 0 THEN 'nan'::DOUBLE WHEN contacts = 0 THEN '-inf'::DOUBLE
                 ELSE ln((contacts / sum(contacts) OVER w) / (n_query / n)) END AS log_odds FROM t WINDOW w AS (PARTITION BY sample_id, ref))"""


def contacts(spark, sf_dir) -> DataFrame:
    return I.contact_table(events(spark, sf_dir), 0.5, 1, 3, ("sample_id",))


@query(f"WITH {CONTACTS} SELECT sample_id, ref, query, round(log_odds, 6) AS log_odds FROM o")
def pwlo_logodds(spark, sf_dir):
    return I.log_odds(contacts(spark, sf_dir), ("sample_id",)).withColumns(r6("log_odds"))


@query(f"""WITH {CONTACTS}, m AS (SELECT min(exp(log_odds)) AS least FROM o WHERE NOT isnan(log_odds))
    SELECT sample_id, ref, query, round(log_odds, 6) AS log_odds, round(ln(exp(log_odds) + 1 - least), 6) AS adjusted FROM o, m""")
def pwlo_adjusted(spark, sf_dir):
    return I.adjusted_log_odds(I.log_odds(contacts(spark, sf_dir), ("sample_id",))).withColumns(r6("log_odds", "adjusted"))


@query(f"WITH {CONTACTS} SELECT sample_id, ref, query, round(ref_cells / n_ref, 6) AS incidence FROM t")
def pwlo_incidence(spark, sf_dir):
    return I.incidence(contacts(spark, sf_dir), ("sample_id",)).withColumns(r6("incidence"))


@query(f"WITH {CONTACTS} SELECT sample_id, ref, query, contacts, query_cells FROM t")
def unique_query_contacts(spark, sf_dir):
    return contacts(spark, sf_dir).select("sample_id", "ref", "query", "contacts", "query_cells")


COMPOSITION = f"""{EVENTS}, c AS (SELECT a.cell_id, a.celltype, {", ".join(f"count(*) FILTER (b.celltype = '{m}') AS {m}" for m in MEMBERS)}
    FROM cells a JOIN cells b ON a.sample_id = b.sample_id AND {D2} <= 7.3 * 7.3::DOUBLE GROUP BY ALL),
    q AS (SELECT *, {" + ".join(MEMBERS)} AS total FROM c),
    s AS (SELECT cell_id, celltype, least({", ".join(f"{m} / greatest(total, 1)" for m in MEMBERS)}) AS score,
                 exp(({" + ".join(f"ln(greatest({m} / greatest(total, 1), 1e-10))" for m in MEMBERS)}) / 3) AS geometric FROM q)"""


def around(spark, sf_dir) -> DataFrame:
    return I.composition(events(spark, sf_dir), 7.3, MEMBERS, ("sample_id",))


@query(f"WITH {COMPOSITION} SELECT cell_id, celltype, {', '.join(MEMBERS)} FROM c")
def circuit_composition(spark, sf_dir):
    return around(spark, sf_dir).select("cell_id", "celltype", *MEMBERS)


@query(f"WITH {COMPOSITION} SELECT cell_id, round(score, 6) AS min_fraction, round(geometric, 6) AS geometric_mean FROM s")
def circuit_scores(spark, sf_dir):
    counts = around(spark, sf_dir)
    both = I.circuit_scores(I.circuit_scores(counts, MEMBERS).withColumnRenamed("score", "min_fraction"), MEMBERS, "geometric_mean")
    return both.select("cell_id", "min_fraction", F.col("score").alias("geometric_mean")).withColumns(r6("min_fraction", "geometric_mean"))


THRESHOLDS = [0.013 + 0.029 * k for k in range(11)]


@query(f"""WITH {COMPOSITION}, h AS (SELECT unnest([{", ".join(f"{t!r}::DOUBLE" for t in THRESHOLDS)}]) AS threshold)
    SELECT round(threshold, 6) AS threshold, count(*) FILTER (score >= threshold) AS n_positive, round(count(*) FILTER (score >= threshold) / count(*), 6) AS fraction,
           round(coalesce(avg(score) FILTER (score >= threshold), 0), 6) AS mean_score FROM s, h GROUP BY h.threshold""")
def circuit_threshold_sweep(spark, sf_dir):
    return I.threshold_sweep(I.circuit_scores(around(spark, sf_dir), MEMBERS), THRESHOLDS).withColumns(r6("threshold", "fraction", "mean_score"))


@query(f"""WITH {COMPOSITION} SELECT cell_id, score >= 0.113 AS positive, CASE WHEN score >= 0.113 AND celltype IN ('click', 'purchase', 'view') THEN celltype ELSE 'other' END AS domain FROM s""")
def circuit_domains(spark, sf_dir):
    return I.circuit_domains(I.circuit_scores(around(spark, sf_dir), MEMBERS), MEMBERS, 0.113).select("cell_id", "positive", "domain")


@query(f"WITH {KNN(5)} SELECT src, dst, round(sqrt(d2), 6) AS dist, rank::INT AS rank FROM e")
def knn_edges(spark, sf_dir):
    return N.knn_edges(vectors(spark, sf_dir), 5).select("src", "dst", "dist", "rank").withColumns(r6("dist"))


@query(f"""WITH {KNN(15)}, s AS (SELECT celltype, count(*) AS size FROM cells GROUP BY ALL), o AS (SELECT src_type, dst_type, count(*) AS observed FROM e GROUP BY ALL),
    f AS (SELECT a.celltype AS from_type, b.celltype AS to_type, coalesce(observed, 0) AS observed, a.size * b.size / (sum(b.size) OVER (PARTITION BY a.celltype) ** 2) * sum(coalesce(observed, 0)) OVER () AS expected
          FROM s a CROSS JOIN s b LEFT JOIN o ON src_type = a.celltype AND dst_type = b.celltype)
    SELECT from_type, to_type, observed, round(expected, 6) AS expected, round((observed - expected) / sqrt(expected + 1e-10), 6) AS z FROM f""")
def neighborhood_enrichment(spark, sf_dir):
    cells = vectors(spark, sf_dir)
    return I.neighborhood_enrichment(N.knn_edges(cells, 15), cells).withColumns(r6("expected", "z"))


@query(f"WITH {KNN(10)} SELECT src AS cell_id, round(avg(c.y), 6) AS smoothed FROM e JOIN cells c ON c.cell_id = e.dst GROUP BY src")
def knn_smoothing(spark, sf_dir):
    return N.knn_smoothing(vectors(spark, sf_dir), "y", 10).withColumns(r6("smoothed"))


def SNN(pairs: str, weight: str = "shared / 8") -> str:
    return f"""WITH {KNN(8)}, p AS ({pairs}), n AS (SELECT p.src, p.dst, count(*) AS shared FROM p JOIN e a ON a.src = p.src JOIN e b ON b.src = p.dst AND b.dst = a.dst GROUP BY ALL)
    SELECT src, dst, shared, round({weight}, 6) AS weight FROM n"""


@query(SNN("SELECT DISTINCT least(src, dst) AS src, greatest(src, dst) AS dst FROM e"))
def snn_edges(spark, sf_dir):
    return N.snn_edges(N.knn_edges(vectors(spark, sf_dir), 8), 8).withColumns(r6("weight"))


@query(SNN("SELECT DISTINCT least(src, dst) AS src, greatest(src, dst) AS dst FROM e", "shared / (16 - shared)"))
def snn_jaccard(spark, sf_dir):
    return N.snn_jaccard(N.knn_edges(vectors(spark, sf_dir), 8)).withColumns(r6("weight"))


@query(SNN("SELECT src, dst FROM e WHERE src < dst"))
def snn_edges_compat(spark, sf_dir):
    return N.snn_edges(N.knn_edges(vectors(spark, sf_dir), 8), 8, compat=True).withColumns(r6("weight"))


@query(f"""WITH {VECTORS}, e AS (SELECT a.cell_id, a.celltype AS from_type, b.celltype AS to_type, {D2} AS d2,
        row_number() OVER (PARTITION BY a.cell_id, b.celltype ORDER BY {D2}, b.cell_id) AS rank FROM cells a JOIN cells b ON a.cell_id <> b.cell_id QUALIFY rank <= 5),
    m AS (SELECT cell_id, from_type, to_type, avg(sqrt(d2)) AS d FROM e GROUP BY ALL)
    SELECT from_type, to_type, round(avg(d), 6) AS mean_dist FROM m GROUP BY ALL""")
def nn_by_type(spark, sf_dir):
    cells = vectors(spark, sf_dir).withColumn("sample_id", F.lit(0))
    return N.type_distances(cells, 5).drop("sample_id").withColumns(r6("mean_dist"))


RADIUS, STEPS, BAND = 9.0, 30, 40.0
PI = "3.141592653589793::DOUBLE"
BUMP = "greatest(0, 0.75::DOUBLE / 40 * (1 - ((a.{c} - b.{c}) / 40) ** 2))"
UPTO = "(0.5 + 0.75 * {t} - 0.25 * {t} * {t} * {t})"


def _mass(c: str) -> str:
    upto = lambda d: UPTO.format(t=f"greatest(-1::DOUBLE, least(1::DOUBLE, ({d}) / 40))")
    return f"({upto(f'{c}1 - {c}')} - {upto(f'{c}0 - {c}')})"


PCF = f"""{EVENTS}, pts AS (SELECT cell_id, sample_id, round_even(x, 0) AS x, round_even(y, 0) AS y, celltype FROM cells),
    w0 AS (SELECT sample_id, count(*) AS n, min(x) AS lx, max(x) AS hx, min(y) AS ly, max(y) AS hy FROM pts GROUP BY sample_id),
    w AS (SELECT sample_id, n, lx - 1 AS x0, hx + 1 AS x1, ly - 1 AS y0, hy + 1 AS y1, (hx - lx) * (hy - ly) AS box, (hx - lx + 2) * (hy - ly + 2) AS area,
                 0.15::DOUBLE / sqrt(n / ((hx - lx + 2) * (hy - ly + 2))) AS h FROM w0),
    p AS (SELECT c.*, w.* EXCLUDE (sample_id) FROM (SELECT * FROM pts UNION ALL SELECT cell_id, sample_id, x, y, 'All' FROM pts) c JOIN w USING (sample_id)),
    k AS (SELECT a.sample_id, a.celltype, a.cell_id, sum({BUMP.format(c="x")} * {BUMP.format(c="y")}) AS s FROM p a JOIN p b ON a.sample_id = b.sample_id AND a.celltype = b.celltype
          AND abs(a.x - b.x) < 40 AND abs(a.y - b.y) < 40 GROUP BY ALL),
    q AS (SELECT p.*, s / ({_mass("x")} * {_mass("y")}) AS lam FROM p JOIN k USING (sample_id, celltype, cell_id)),
    d AS (SELECT a.sample_id, a.celltype AS ref, b.celltype AS query, sqrt({D2}) AS d, a.h, a.area, a.lam AS la, b.lam AS lb, acos(least(1, (a.x - a.x0) / sqrt({D2}))) AS tl,
                 acos(least(1, (a.x1 - a.x) / sqrt({D2}))) AS tr, acos(least(1, (a.y - a.y0) / sqrt({D2}))) AS td, acos(least(1, (a.y1 - a.y) / sqrt({D2}))) AS tu
          FROM q a JOIN q b ON a.sample_id = b.sample_id AND a.cell_id <> b.cell_id AND abs(a.x - b.x) < 20 AND abs(a.y - b.y) < 20 AND {D2} > 0
          AND (a.celltype = 'All' OR (b.celltype <> 'All' AND a.celltype <= b.celltype))),
    e AS (SELECT *, 1 - (2 * (tl + tr + td + tu) - greatest(0, tl + td - {PI} / 2) - greatest(0, tl + tu - {PI} / 2) - greatest(0, tr + td - {PI} / 2) - greatest(0, tr + tu - {PI} / 2)) / (2 * {PI}) AS share FROM d),
    z AS (SELECT *, unnest(range(1, {STEPS})) AS step FROM e), v AS (SELECT *, step * {RADIUS / STEPS!r}::DOUBLE AS r FROM z),
    g AS (SELECT sample_id, ref, query, step, sum(0.75 / h * (1 - ((r - d) / h) ** 2) / (la * lb * share) / (2 * {PI} * r * area)) AS g FROM v WHERE abs(r - d) < h GROUP BY ALL),
    t AS (SELECT sample_id, celltype, count(*) AS n, sum(1 / lam) AS s, any_value(box) AS box FROM q GROUP BY ALL),
    f AS (SELECT a.sample_id, a.celltype AS ref, b.celltype AS query, least(a.n, b.n) AS min_count, a.s * b.s / (a.box * a.box) AS norm, unnest(range(0, {STEPS})) AS step FROM t a JOIN t b USING (sample_id)
          WHERE a.celltype = 'All' OR (b.celltype <> 'All' AND a.celltype <= b.celltype)),
    pcf AS (SELECT f.sample_id, f.ref, f.query, min_count, f.step::INT AS step, f.step * {RADIUS / STEPS!r}::DOUBLE AS r, coalesce(g, 0) AS g, coalesce(g, 0) / norm AS norm_g FROM f LEFT JOIN g USING (sample_id, ref, query, step))"""


def curves(spark, sf_dir):
    return I.pair_correlation(events(spark, sf_dir), RADIUS, STEPS, BAND)


@query(f"WITH {PCF} SELECT sample_id, ref, query, min_count, step, round(r, 6) AS r, round(g, 5) AS g, round(norm_g, 5) AS norm_g FROM pcf")
def pair_correlation(spark, sf_dir):
    return curves(spark, sf_dir).withColumns({"r": F.round("r", 6), "g": F.round("g", 5), "norm_g": F.round("norm_g", 5)})


@query(f"WITH {PCF} SELECT ref, query, step, round(avg(g), 5) AS mean, round(var_samp(g), 5) AS var FROM pcf GROUP BY ref, query, step")
def curve_moments(spark, sf_dir):
    return I.curve_moments(curves(spark, sf_dir)).withColumns({"mean": F.round("mean", 5), "var": F.round("var", 5)})


@query(f"""WITH {PCF} SELECT sample_id, CASE WHEN ref = 'view' THEN query ELSE ref END AS other, step, round(g, 5) AS g FROM pcf WHERE 'view' IN (ref, query) AND min_count > 20 AND r <= 6""")
def curve_table(spark, sf_dir):
    return I.curves_of(curves(spark, sf_dir), "view", 20, 6.0).select("sample_id", "other", "step", F.round("g", 5).alias("g"))


@query(f"""WITH {PCF} SELECT step, CASE WHEN ref = 'view' THEN query ELSE ref END AS other, round(norm_g * 0.377, 5) AS value FROM pcf WHERE 'view' IN (ref, query) AND sample_id = (SELECT min(sample_id) FROM pcf)""")
def scaled_curves(spark, sf_dir):
    return I.scaled_curves(curves(spark, sf_dir), "view", 0.377).withColumn("value", F.round("value", 5))


@query(f"""WITH {PCF}, s AS (SELECT *, (r - lag(r) OVER w) * (g + lag(g) OVER w) / 2 AS part FROM pcf WINDOW w AS (PARTITION BY sample_id, ref, query ORDER BY step))
    SELECT sample_id, ref, query, round(sum(part), 5) AS area FROM s WHERE least(ref, query) = 'click' AND greatest(ref, query) = 'view' AND min_count > 0 GROUP BY ALL""")
def curve_areas(spark, sf_dir):
    return I.curve_areas(I.pair_subset(curves(spark, sf_dir), "view", "click")).withColumn("area", F.round("area", 5))


@query(f"""WITH {EVENTS}, e AS (SELECT a.sample_id, a.celltype AS ref, b.celltype AS query, floor(sqrt({D2}) / 0.3::DOUBLE)::INT AS step, count(*) AS seen
        FROM cells a JOIN cells b ON a.sample_id = b.sample_id AND a.cell_id <> b.cell_id AND abs(a.x - b.x) <= 9 AND {D2} <= 81 GROUP BY ALL),
    w AS (SELECT sample_id, max(x) - min(x) AS w, max(y) - min(y) AS h FROM cells GROUP BY sample_id), n AS (SELECT sample_id, celltype, count(*) AS n FROM cells GROUP BY ALL),
    f AS (SELECT a.sample_id, a.celltype AS ref, b.celltype AS query, a.n AS n_a, b.n - (a.celltype = b.celltype)::INT AS n_b, w, h, unnest(range(0, 30))::INT AS step FROM n a JOIN n b USING (sample_id) JOIN w USING (sample_id)),
    m AS (SELECT *, (step + 0.5) * 0.3::DOUBLE AS mid FROM f),
    x AS (SELECT *, n_a * n_b * pi() * 0.09 * (2 * step + 1) * (w * h - 2 * mid * (w + h) / pi() + mid * mid / pi()) / ((w * h) * (w * h)) AS expected FROM m)
    SELECT sample_id, ref, query, step, round(step * 0.3::DOUBLE, 6) AS r, round(CASE WHEN expected > 0 THEN coalesce(seen, 0) / expected END, 5) AS g FROM x LEFT JOIN e USING (sample_id, ref, query, step)""")
def ring_correlation(spark, sf_dir):
    return I.ring_correlation(events(spark, sf_dir), 9.0, 30).withColumns({"r": F.round("r", 6), "g": F.round("g", 5)})
