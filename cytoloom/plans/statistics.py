"""Queries over statistical tests."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import Window as W

from cytoloom.functions import stats as S
from cytoloom.operators import interactions as I
from cytoloom.operators import neighbors as N

from .common import D2, EVENTS, EXPR, KNN, events, expression, load, r6, registry, vectors
from .spatial import COMPOSITION, CONTACTS, MEMBERS, around, contacts

QUERIES, SQL, query = registry()

ONE, TWO = ("0", "1", "2"), ("3", "4", "5")
#: Features rounded, so that values tie.
COARSE = EXPR.replace("embedding[k]::DOUBLE AS value", "round(embedding[k]::DOUBLE, 1) AS value")
RANKS = f"""WITH {COARSE}, g AS (SELECT feature, value, celltype IN {ONE} AS one FROM expr WHERE celltype IN {ONE + TWO}),
    r AS (SELECT *, rank() OVER (PARTITION BY feature ORDER BY value) + (count(*) OVER (PARTITION BY feature, value) - 1) / 2 AS rk, count(*) OVER (PARTITION BY feature, value) AS t FROM g),
    s AS (SELECT feature, count(*) FILTER (one) AS n1, count(*) FILTER (NOT one) AS n2, sum(rk) FILTER (one) AS r1, sum(t * t - 1)::DOUBLE AS ties,
                 avg(value) FILTER (one) AS m1, avg(value) FILTER (NOT one) AS m2, avg((value > 0)::INT) FILTER (one) AS pct1, avg((value > 0)::INT) FILTER (NOT one) AS pct2 FROM r GROUP BY feature),
    u AS (SELECT *, r1 - n1 * (n1 + 1) / 2 AS u, r1 - n1 * (n1 + 1) / 2 - n1 * n2 / 2 AS away, sqrt(n1 * n2 / 12 * (n1 + n2 + 1 - ties / ((n1 + n2) * (n1 + n2 - 1.0)))) AS sd FROM s)"""


def tested(spark, sf_dir):
    cells = vectors(spark, sf_dir)
    expr = expression(spark, sf_dir).withColumn("value", F.round("value", 1))
    return S.differential_expression(expr, cells, F.col("celltype").isin(*ONE), F.col("celltype").isin(*TWO))


@query(f"""{RANKS} SELECT feature, n1::BIGINT AS n1, n2::BIGINT AS n2, u::DOUBLE AS u, round((away - 0.5 * sign(away)) / sd, 6) AS z, round(pct1, 6) AS pct1, round(pct2, 6) AS pct2 FROM u""")
def de_ranksum(spark, sf_dir):
    return tested(spark, sf_dir).select("feature", "n1", "n2", "u", "z", "pct1", "pct2").withColumns(r6("z", "pct1", "pct2"))


@query()
def de_regulation(spark, sf_dir):
    """The tests with adjusted probabilities and Up, Down or NS, in order of report; probabilities are checked in tests."""
    return S.regulated(tested(spark, sf_dir), 0.5).select("feature", "p", "p_adj", "log2fc", "regulation").orderBy("p_adj", F.desc(F.abs("log2fc")), "feature")


PVALUES = """tests AS (SELECT p_partkey AS test, ((p_partkey * 7919 % 1009) / 1009.0::DOUBLE) ** 3 AS p, p_brand AS brand FROM part)"""


def pvalues(spark, sf_dir):
    p = F.pow((F.col("p_partkey") * 7919 % 1009) / F.lit(1009.0), F.lit(3.0))
    return load(spark, sf_dir, "part").select(F.col("p_partkey").alias("test"), p.alias("p"), F.col("p_brand").alias("brand"))


@query(f"""WITH {PVALUES}, r AS (SELECT *, count(*) OVER () AS n, rank() OVER (ORDER BY p) + count(*) OVER (PARTITION BY p) - 1 AS k FROM tests),
    a AS (SELECT test, p, min(p * n / k) OVER (ORDER BY p DESC RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS q FROM r) SELECT test, round(least(1, q), 9) AS p_adj FROM a""")
def bh_adjusted(spark, sf_dir):
    return S.bh_adjust(pvalues(spark, sf_dir)).select("test", F.round("p_adj", 9).alias("p_adj"))


@query(f"""WITH {PVALUES}, r AS (SELECT *, count(*) OVER () AS n, rank() OVER (ORDER BY p) + count(*) OVER (PARTITION BY p) - 1 AS k FROM tests),
    a AS (SELECT test, least(1, min(p * n / k) OVER (ORDER BY p DESC RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)) AS p_adj, (test * 31 % 201 - 100) / 100.0::DOUBLE AS log2fc FROM r)
    SELECT test, round(p_adj, 9) AS p_adj, log2fc, CASE WHEN p_adj < 0.05 AND log2fc > 0.25 THEN 'Up' WHEN p_adj < 0.05 AND log2fc < -0.25 THEN 'Down' ELSE 'NS' END AS regulation,
           row_number() OVER (ORDER BY round(p_adj, 9), abs(log2fc) DESC, test) AS place FROM a""")
def regulated_tests(spark, sf_dir):
    """Tests with given probabilities and changes as Up, Down or NS, and their places in order of report."""
    tests = S.bh_adjust(pvalues(spark, sf_dir)).withColumn("log2fc", (F.col("test") * 31 % 201 - 100) / F.lit(100.0))
    rows = S.regulated(tests).select("test", F.round("p_adj", 9).alias("p_adj"), "log2fc", "regulation")
    return rows.withColumn("place", F.row_number().over(W.orderBy("p_adj", F.desc(F.abs("log2fc")), "test")))  # one row per test


@query(f"""WITH {PVALUES}, f AS (SELECT brand, quantile_cont(-log10(p), 0.99) AS high FROM tests WHERE p > 0 GROUP BY brand)
    SELECT test, round(CASE WHEN p = 0 THEN high ELSE -log10(p) END, 6) AS minus_log10 FROM tests JOIN f USING (brand)""")
def minus_log10(spark, sf_dir):
    return S.minus_log10(pvalues(spark, sf_dir), keys=("brand",)).select("test", F.round("minus_log10", 6).alias("minus_log10"))


@query(f"""WITH {PVALUES} SELECT test, CASE WHEN p < 0.001 THEN '***' WHEN p < 0.01 THEN '**' WHEN p < 0.05 THEN '*' ELSE 'n.s.' END AS stars FROM tests""")
def p_stars(spark, sf_dir):
    return pvalues(spark, sf_dir).select("test", S.stars(F.col("p")).alias("stars"))


def MORAN(product: str) -> str:
    return f"""WITH {KNN(10)}, {EXPR}, w AS (SELECT src, dst, 1 / (sqrt(d2) + 1e-6) AS w FROM e), m AS (SELECT feature, avg(value) AS m, count(*) AS n FROM expr GROUP BY ALL),
        c AS (SELECT cell_id, feature, value - m AS x FROM expr JOIN m USING (feature)), ss AS (SELECT feature, sum(x * x) AS ss FROM c GROUP BY ALL),
        s AS (SELECT b.feature, sum(w * {product}) AS s FROM w JOIN c b ON b.cell_id = w.dst JOIN c a ON a.cell_id = w.src AND a.feature = b.feature GROUP BY ALL),
        i AS (SELECT feature, n, n / (SELECT sum(w) FROM w) * s / ss AS i FROM m JOIN ss USING (feature) JOIN s USING (feature))
        SELECT feature, round(i, 6) AS i, round((i + 1 / (n - 1)) / (0.5 / sqrt(n)), 6) AS z FROM i"""


def moran(spark, sf_dir, compat):
    edges = N.knn_edges(vectors(spark, sf_dir), 10)
    return S.morans_i(edges, expression(spark, sf_dir), compat).select("feature", "i", "z").withColumns(r6("i", "z"))


@query(MORAN("a.x * b.x"))
def morans_i(spark, sf_dir):
    return moran(spark, sf_dir, False)


@query(MORAN("b.x"))
def morans_i_compat(spark, sf_dir):
    return moran(spark, sf_dir, True)



@query("""WITH c AS (SELECT l_linestatus AS g, l_returnflag AS flag, l_extendedprice::DOUBLE AS x FROM lineitem),
    s AS (SELECT flag, g, count(*) AS n, avg(x) AS m, var_samp(x) AS v FROM c GROUP BY ALL), two AS (SELECT flag FROM s GROUP BY flag HAVING count(*) = 2),
    p AS (SELECT flag, sum(v / n) AS se2, sum((v / n) ** 2 / (n - 1)) AS down, (min_by(m, g) - max_by(m, g)) AS diff FROM s JOIN two USING (flag) GROUP BY flag)
    SELECT flag, round(diff / sqrt(se2), 6) AS t, round(se2 * se2 / down, 4) AS df2 FROM p""")
def welch_t(spark, sf_dir):
    rows = load(spark, sf_dir, "lineitem").select("l_linestatus", F.col("l_returnflag").alias("flag"), F.col("l_extendedprice").cast("double").alias("x"))
    return S.compare_groups(rows, "l_linestatus", "x", ("flag",)).where("groups = 2").select("flag", F.round("t", 6).alias("t"), F.round("df2", 4).alias("df2"))


@query("""WITH c AS (SELECT l_linenumber AS g, l_returnflag AS flag, l_extendedprice::DOUBLE AS x FROM lineitem), s AS (SELECT flag, g, count(*) AS n, avg(x) AS m, var_samp(x) AS v FROM c GROUP BY ALL),
    a AS (SELECT flag, avg(x) AS grand FROM c GROUP BY flag), f AS (SELECT flag, sum(n * (m - grand) ** 2) / (count(*) - 1) AS up, sum((n - 1) * v) / (sum(n) - count(*)) AS low, count(*) - 1 AS df1, sum(n) - count(*) AS df2
    FROM s JOIN a USING (flag) GROUP BY flag) SELECT flag, round(up / low, 5) AS f, df1::DOUBLE AS df1, df2::DOUBLE AS df2 FROM f""")
def anova_f(spark, sf_dir):
    rows = load(spark, sf_dir, "lineitem").select("l_linenumber", F.col("l_returnflag").alias("flag"), F.col("l_extendedprice").cast("double").alias("x"))
    return S.compare_groups(rows, "l_linenumber", "x", ("flag",)).select("flag", F.round("f", 5).alias("f"), "df1", "df2")


@query("""WITH c AS (SELECT event_type AS kind, value::DOUBLE AS v FROM events), o AS (SELECT DISTINCT kind FROM c WHERE kind <> 'click'),
    b AS (SELECT o.kind, v, true AS one FROM o, c WHERE c.kind = 'click' UNION ALL SELECT kind, v, false FROM c WHERE kind <> 'click'),
    r AS (SELECT *, rank() OVER (PARTITION BY kind ORDER BY v) + (count(*) OVER (PARTITION BY kind, v) - 1) / 2 AS rk FROM b)
    SELECT kind AS celltype, count(*) FILTER (one) AS n1, count(*) FILTER (NOT one) AS n2, (sum(rk) FILTER (one) - count(*) FILTER (one) * (count(*) FILTER (one) + 1) / 2)::DOUBLE AS u FROM r GROUP BY kind""")
def mann_whitney_first(spark, sf_dir):
    rows = events(spark, sf_dir).select("celltype", F.col("x").alias("value"))
    return S.rank_sum_against_first(rows, "celltype", "click").select("celltype", "n1", "n2", "u")


CHOOSE = "(lgamma({n}::DOUBLE + 1) - lgamma({k}::DOUBLE + 1) - lgamma({n}::DOUBLE - {k} + 1))"
TAIL = f"""exp({CHOOSE.format(n="white", k="k")} + {CHOOSE.format(n="(total - white)", k="(draws - k)")} - {CHOOSE.format(n="total", k="draws")})"""


@query(f"""WITH {CONTACTS}, h AS (SELECT sample_id, ref, query, 'p_out' AS side, query_cells::BIGINT AS hits, n_query::BIGINT AS white, n::BIGINT AS total, least(n_ref, n)::BIGINT AS draws FROM t
        UNION ALL SELECT sample_id, ref, query, 'p_in', ref_cells::BIGINT, n_ref::BIGINT, n::BIGINT, least(n_query, n)::BIGINT FROM t),
    k AS (SELECT *, unnest(range(greatest(hits, 0, draws - (total - white)), least(white, draws) + 1)) AS k FROM h), q AS (SELECT sample_id, ref, query, side, sum({TAIL}) AS p FROM k GROUP BY ALL)
    SELECT sample_id, ref, query, round(least(1, coalesce(sum(p) FILTER (side = 'p_out'), 0)), 6) AS p, round(least(1, coalesce(sum(p) FILTER (side = 'p_in'), 0)), 6) AS p_in
    FROM h LEFT JOIN q USING (sample_id, ref, query, side) GROUP BY sample_id, ref, query""")
def hypergeometric(spark, sf_dir):
    """That so many cells of the query type, or more, are among as many draws as the reference has cells; and the same from the other side."""
    return S.contact_enrichment(contacts(spark, sf_dir)).select("sample_id", "ref", "query", F.round("p_out", 6).alias("p"), F.round("p_in", 6).alias("p_in"))


HASHED = "md5('{seed}:' || cell_id::VARCHAR)"


@query(f"""WITH {EVENTS}, own AS (SELECT * FROM cells QUALIFY row_number() OVER (PARTITION BY celltype ORDER BY {HASHED.format(seed=42)}, cell_id) <= 60),
    anyone AS (SELECT * FROM cells QUALIFY row_number() OVER (ORDER BY {HASHED.format(seed=43)}, cell_id) <= 60),
    near AS (SELECT a.celltype AS ref, b.celltype AS query, sqrt({D2}) AS d, 1 AS one FROM own a JOIN own b ON a.cell_id <> b.cell_id),
    far AS (SELECT a.celltype AS ref, sqrt({D2}) AS d FROM own a JOIN anyone b ON a.cell_id <> b.cell_id),
    rows AS (SELECT * FROM near UNION ALL SELECT ref, celltype, d, 0 FROM far, (SELECT DISTINCT celltype FROM own)),
    c AS (SELECT ref, query, sum(one) OVER w / sum(one) OVER (PARTITION BY ref, query) - sum(1 - one) OVER w / sum(1 - one) OVER (PARTITION BY ref, query) AS d FROM rows WINDOW w AS (PARTITION BY ref, query ORDER BY d))
    SELECT ref, query, round(greatest(0, max(d)), 6) AS d FROM c GROUP BY ALL""")
def ks_effect(spark, sf_dir):
    return S.distance_effect(events(spark, sf_dir), 60).withColumns(r6("d"))


@query(f"""WITH {COMPOSITION} SELECT round(avg(score), 6) AS observed, round(avg(score), 6) AS null_mean, 0.0::DOUBLE AS null_sd, 0.0::DOUBLE AS z, 1.0::DOUBLE AS p FROM s""")
def circuit_null_compat(spark, sf_dir):
    return I.circuit_null_closed(I.circuit_scores(around(spark, sf_dir), MEMBERS), MEMBERS).withColumns(r6("observed", "null_mean"))


@query(f"""WITH {EVENTS}, l AS (SELECT sample_id, celltype, row_number() OVER (PARTITION BY sample_id ORDER BY md5('42:' || cell_id)) AS place FROM cells),
    g AS (SELECT sample_id, round, cell_id, row_number() OVER (PARTITION BY sample_id, round ORDER BY md5('42:' || round || ':' || cell_id)) AS place FROM cells, range(1, 21) AS t(round)),
    n AS (SELECT sample_id, round, cell_id AS dst, celltype FROM g JOIN l USING (sample_id, place) UNION ALL SELECT sample_id, 0, cell_id, celltype FROM cells),
    e AS MATERIALIZED (SELECT a.sample_id, a.cell_id AS src, b.cell_id AS dst FROM cells a JOIN cells b ON a.sample_id = b.sample_id AND abs(a.x - b.x) <= 7.3 AND {D2} <= 7.3 * 7.3::DOUBLE),
    c AS (SELECT round, src, {", ".join(f"count(*) FILTER (celltype = '{m}') AS {m}" for m in MEMBERS)} FROM e JOIN n USING (sample_id, dst) GROUP BY round, sample_id, src),
    s AS (SELECT round, avg(least({", ".join(f"{m} / greatest({' + '.join(MEMBERS)}, 1)" for m in MEMBERS)})) AS mean FROM c GROUP BY round), o AS (SELECT mean AS observed FROM s WHERE round = 0)
    SELECT round(observed, 6) AS observed, round(avg(mean), 6) AS null_mean, round(stddev_pop(mean), 6) AS null_sd, round((observed - avg(mean)) / greatest(stddev_pop(mean), 1e-10), 4) AS z,
           avg((mean >= observed)::INT) AS p FROM s, o WHERE round > 0 GROUP BY observed""")
def circuit_permutation(spark, sf_dir):
    """The mean score against labels shuffled within samples; shuffles go by hash, so reruns agree."""
    found = I.circuit_permutation(events(spark, sf_dir), 7.3, MEMBERS, 20, keys=("sample_id",))
    return found.withColumns(r6("observed", "null_mean", "null_sd")).withColumn("z", F.round("z", 4))


@query("""WITH c AS (SELECT l_returnflag AS kind, l_linenumber AS k, sum(l_quantity)::DOUBLE AS v FROM lineitem GROUP BY ALL) SELECT kind, median(v) AS middle FROM c GROUP BY kind""")
def bootstrap_middle(spark, sf_dir):
    sums = load(spark, sf_dir, "lineitem").groupBy(F.col("l_returnflag").alias("kind"), "l_linenumber").agg(F.sum("l_quantity").cast("double").alias("value"))
    return S.bootstrap_median(sums, ["kind"]).select("kind", "middle")


@query("""WITH c AS (SELECT l_returnflag AS kind, l_linenumber AS k, sum(l_quantity)::DOUBLE AS v FROM lineitem GROUP BY ALL), l AS (SELECT kind, list(v ORDER BY v) AS vs FROM c GROUP BY kind),
    d AS (SELECT kind, b, vs[1 + (('0x' || substr(md5(concat_ws(':', 42, kind, b, i)), 1, 13))::BIGINT % len(vs))] AS v FROM l, range(1, 101) AS t(b), LATERAL (SELECT unnest(range(1, len(vs) + 1)) AS i)),
    m AS (SELECT kind, b, median(v) AS m FROM d GROUP BY ALL), o AS (SELECT kind, median(v) AS middle FROM c GROUP BY kind)
    SELECT kind, round(quantile_cont(m, 0.025), 6) AS low, middle, round(quantile_cont(m, 0.975), 6) AS high FROM m JOIN o USING (kind) GROUP BY kind, middle""")
def bootstrap_band(spark, sf_dir):
    """The median of each kind's sums over line numbers, with the band of the medians of 100 resampled sets."""
    sums = load(spark, sf_dir, "lineitem").groupBy(F.col("l_returnflag").alias("kind"), "l_linenumber").agg(F.sum("l_quantity").cast("double").alias("value"))
    return S.bootstrap_median(sums, ["kind"]).select("kind", F.round("low", 6).alias("low"), "middle", F.round("high", 6).alias("high"))


@query(f"""WITH {EXPR}, m AS (SELECT celltype, feature, avg(value) AS m FROM expr GROUP BY ALL) SELECT celltype, feature, round(m, 6) AS m FROM m QUALIFY rank() OVER (PARTITION BY celltype ORDER BY m DESC) <= 5""")
def top_markers(spark, sf_dir):
    means = expression(spark, sf_dir).groupBy("celltype", "feature").agg(F.avg("value").alias("m"))
    return S.top_markers(means, 5, order="m").withColumns(r6("m"))


