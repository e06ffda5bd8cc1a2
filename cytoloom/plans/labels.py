"""Queries over labels, filters, summaries, matching, masks and matrices."""

from __future__ import annotations

from pyspark.sql import functions as F

from cytoloom.operators import compare as C
from cytoloom.operators import expression as E
from cytoloom.operators import gates as G
from cytoloom.operators import labels as L
from cytoloom.operators import matching as M
from cytoloom.operators import matrices as X

from .common import D2, EVENTS, EXPR, VECTORS, events, expression, load, r6, registry, vectors

QUERIES, SQL, query = registry()


@query("SELECT DISTINCT lang AS label FROM documents WHERE lang IS NOT NULL")
def classifier_labels(spark, sf_dir):
    return L.classifier_labels(load(spark, sf_dir, "documents"), "lang")


@query("SELECT p_partkey FROM part WHERE regexp_matches(p_type, 'A') OR regexp_matches(p_type, 'E')")
def classifier_filter(spark, sf_dir):
    return L.classifier_filter(load(spark, sf_dir, "part"), "p_type", ["A", "E"]).select("p_partkey")


@query("SELECT p_partkey FROM part WHERE regexp_matches(p_type, 'A')::INT + regexp_matches(p_type, 'E')::INT = 1")
def classifier_filter_compat(spark, sf_dir):
    return L.classifier_filter(load(spark, sf_dir, "part"), "p_type", ["A", "E"], compat=True).select("p_partkey")


@query("SELECT event_id FROM events ORDER BY md5('99:' || event_id::VARCHAR), event_id LIMIT 777")
def row_cap(spark, sf_dir):
    """A capped draw; the cap is the feature."""
    return L.row_cap(load(spark, sf_dir, "events"), 777, "event_id").select("event_id")


@query("SELECT doc_id, lang FROM documents WHERE lang IS NOT NULL AND lower(lang) NOT IN ('nan', 'na')")
def labelled_cells(spark, sf_dir):
    return L.labelled(load(spark, sf_dir, "documents"), "lang").select("doc_id", "lang")


@query("SELECT event_id, event_type FROM events WHERE event_type IN ('click', 'view')")
def population_subset(spark, sf_dir):
    return L.of_population(load(spark, sf_dir, "events"), "event_type", ["click", "view"]).select("event_id", "event_type")


@query("SELECT doc_id, source FROM documents WHERE doc_id IN (SELECT doc_id FROM labels WHERE toxic = 1)")
def selected_cells(spark, sf_dir):
    """A lasso's selection, or the members of a gate, given as ids."""
    return L.chosen(load(spark, sf_dir, "documents"), load(spark, sf_dir, "labels").where("toxic = 1").select("doc_id"), "doc_id").select("doc_id", "source")


@query("SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_suppkey IN (SELECT l_suppkey FROM lineitem GROUP BY l_suppkey HAVING sum(l_tax) > 0)")
def nonempty_samples(spark, sf_dir):
    return L.nonempty_samples(load(spark, sf_dir, "lineitem"), "l_suppkey", "l_tax").select("l_orderkey", "l_linenumber")


@query("SELECT event_id FROM events WHERE value IS NOT NULL ORDER BY md5('1:' || event_id::VARCHAR), event_id LIMIT 500")
def display_rows(spark, sf_dir):
    return L.display_rows(load(spark, sf_dir, "events"), "value", 500, "event_id").select("event_id")


RENAMED = {"click": "view", "view": "click", "error": "C1-error..", "absent": "x"}


@query("""SELECT event_id, CASE event_type WHEN 'click' THEN 'view' WHEN 'view' THEN 'click' WHEN 'error' THEN 'C1-error..' ELSE event_type END AS label,
    CASE event_type WHEN 'error' THEN 'error' WHEN 'click' THEN 'view' WHEN 'view' THEN 'click' ELSE event_type END AS suggestion,
    CASE WHEN event_type IN ('purchase', 'signup') THEN 'else' ELSE event_type END AS binary FROM events""")
def recoded_labels(spark, sf_dir):
    label = L.recode(F.col("event_type"), RENAMED)
    return load(spark, sf_dir, "events").select("event_id", label.alias("label"), L.default_label(label).alias("suggestion"), L.binary_view(F.col("event_type"), ["purchase", "signup"]).alias("binary"))


@query("SELECT c_custkey, coalesce(n_name, c_nationkey::VARCHAR) AS nation FROM customer LEFT JOIN nation ON n_nationkey = c_nationkey")
def map_lookup(spark, sf_dir):
    names = load(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("string").alias("old"), F.col("n_name").alias("new"))
    rows = load(spark, sf_dir, "customer").select("c_custkey", F.col("c_nationkey").cast("string").alias("nation"))
    return L.recoded_by_table(rows, "nation", names)


@query("""SELECT event_id, CASE event_type WHEN 'click' THEN 'touch' WHEN 'view' THEN 'look' ELSE event_type END AS kind_harmonised,
    CASE WHEN event_type IN ('click', 'view') THEN 'passive' ELSE event_type END AS kind_broad FROM events""")
def harmonised_labels(spark, sf_dir):
    first = L.map_from_reply('```json\n{"click": "touch", "view": "look"}\n```')
    rows = load(spark, sf_dir, "events").select("event_id", F.col("event_type").alias("kind"))
    return L.two_levels(rows, "kind", first, {"touch": "passive", "look": "passive"}).select("event_id", "kind_harmonised", "kind_broad")


@query("SELECT p_partkey, regexp_replace(regexp_replace(p_brand, 'Brand#1', 'first', 'g'), 'Brand#', 'b', 'g') AS brand FROM part")
def group_rename(spark, sf_dir):
    return load(spark, sf_dir, "part").select("p_partkey", L.rename_groups(F.col("p_brand"), {"Brand#1": "first", "Brand#": "b"}, pattern=True).alias("brand"))


@query("SELECT DISTINCT p_type, replace(replace(p_type || '+ -', '+', 'pos'), '-', '_') AS prompt, translate(replace(p_type || '+ -', '+', 'pos'), ' -', '..') AS matrix FROM part")
def cleaned_labels(spark, sf_dir):
    kinds = load(spark, sf_dir, "part").select("p_type").distinct()
    messy = F.concat("p_type", F.lit("+ -"))
    return kinds.select("p_type", L.prompt_label(messy).alias("prompt"), L.matrix_label(messy).alias("matrix"))


@query("""SELECT r_name, 'cluster_subclustered_res1.5_5clusters_' || left(md5(string_agg(n_name, '|' ORDER BY n_name)), 8) AS column_name
    FROM nation JOIN region ON r_regionkey = n_regionkey GROUP BY r_name""")
def subcluster_names(spark, sf_dir):
    both = load(spark, sf_dir, "nation").join(load(spark, sf_dir, "region"), F.col("r_regionkey") == F.col("n_regionkey"))
    names = both.groupBy("r_name").agg(F.sort_array(F.collect_list("n_name")).alias("names"))
    return names.select("r_name", L.subcluster_label("cluster", 1.5, 5, F.col("names")).alias("column_name"))


@query("SELECT lang, count(*) AS n, round(count(*) / sum(count(*)) OVER (), 6) AS fraction FROM documents GROUP BY lang")
def cluster_summary(spark, sf_dir):
    return L.cluster_summary(load(spark, sf_dir, "documents"), "lang").withColumns(r6("fraction"))


@query("SELECT lang, count(*) AS n, arg_min(coalesce(source, ''), doc_id) AS batch FROM documents GROUP BY lang")
def sample_summary(spark, sf_dir):
    rows = load(spark, sf_dir, "documents").withColumn("batch", F.coalesce("source", F.lit("")))
    return L.sample_summary(rows, "lang", "batch", "doc_id")


@query(" UNION ALL ".join(f"SELECT '{t}' AS file, count(*) AS n_rows, {n}::BIGINT AS n_columns FROM {t}" for t, n in (("events", 6), ("part", 6), ("labels", 3))))
def file_summary(spark, sf_dir):
    return L.file_summary({t: load(spark, sf_dir, t) for t in ("events", "part", "labels")})


@query(f"WITH {EXPR}, t AS (SELECT cell_id, sum(value) AS t FROM expr GROUP BY ALL) SELECT count(*) AS cells, 64::BIGINT AS genes, round(quantile_cont(t, 0.5), 6) AS median_counts, 3::BIGINT AS metadata_columns FROM t")
def import_figures(spark, sf_dir):
    return L.import_figures(expression(spark, sf_dir), 3).select("cells", "genes", F.round("median_counts", 6).alias("median_counts"), "metadata_columns")


@query("SELECT sum(n_chars)::BIGINT AS n_chars, sum(doc_id)::BIGINT AS doc_id FROM documents")
def usage_totals(spark, sf_dir):
    return L.usage_totals(load(spark, sf_dir, "documents"), ["n_chars", "doc_id"])


@query("SELECT event_type, count(*) AS n, row_number() OVER (ORDER BY count(*) DESC, event_type)::INT AS place FROM events GROUP BY event_type")
def ordered_types(spark, sf_dir):
    return L.ordered_types(load(spark, sf_dir, "events"), "event_type")


@query("SELECT event_id, value FROM events ORDER BY value DESC, event_id LIMIT 100")
def head_preview(spark, sf_dir):
    """A preview of the first hundred rows in an order."""
    return L.head(load(spark, sf_dir, "events").select("event_id", "value"), 100, F.desc("value"), "event_id")


@query("""WITH q AS (SELECT quantile_cont(value, 0.01) AS lo, quantile_cont(value, 0.99) AS hi FROM events) SELECT event_id, round(greatest(lo, least(hi, value)), 6) AS colour FROM events, q""")
def colour_range(spark, sf_dir):
    return L.colour_range(load(spark, sf_dir, "events"), "value").select("event_id", F.round("colour", 6).alias("colour"))


@query("""WITH c AS (SELECT * FROM customer), m AS (SELECT n_name AS sample, n_nationkey FROM nation), k AS (SELECT c_nationkey, count(*) AS n FROM c WHERE c_mktsegment = 'BUILDING' AND c_acctbal > 5000 GROUP BY ALL)
    SELECT n_nationkey AS sample, coalesce(n, 0) AS n FROM m LEFT JOIN k ON c_nationkey = n_nationkey""")
def zero_filled(spark, sf_dir):
    rich = load(spark, sf_dir, "customer").where("c_mktsegment = 'BUILDING' AND c_acctbal > 5000")
    counts = rich.groupBy(F.col("c_nationkey").cast("int").alias("sample")).agg(F.count("*").alias("n"))
    return C.zero_filled(counts, load(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("sample")), "sample")


@query("""SELECT 'customer' AS sample_id, c_name AS name, c_acctbal AS balance, c_mktsegment AS segment FROM customer UNION ALL SELECT 'supplier', s_name, s_acctbal, NULL FROM supplier""")
def harmonised_union(spark, sf_dir):
    a = load(spark, sf_dir, "customer").select(F.col("c_name").alias("name"), F.col("c_acctbal").alias("balance"), F.col("c_mktsegment").alias("segment"))
    b = load(spark, sf_dir, "supplier").select(F.col("s_name").alias("name"), F.col("s_acctbal").alias("balance"))
    return C.harmonised_union({"customer": a, "supplier": b})


@query("SELECT user_id, max_by(event_id, struct_pack(ts, event_id)) AS event_id FROM events GROUP BY user_id")
def newest_row(spark, sf_dir):
    rows = load(spark, sf_dir, "events").select("user_id", "event_id", F.struct("ts", "event_id").alias("at"))
    return C.newest(rows, ["user_id"], "at").select("user_id", "event_id")


@query("""WITH s AS (SELECT p_brand, count(*) AS n FROM part GROUP BY ALL), c AS (SELECT *, sum(n) OVER (ORDER BY p_brand)::BIGINT AS "end" FROM s) SELECT p_brand, n, "end", "end" - n AS start FROM c""")
def cumulative_ranges(spark, sf_dir):
    sizes = load(spark, sf_dir, "part").groupBy("p_brand").agg(F.count("*").alias("n"))
    return C.cumulative_ranges(sizes, "p_brand", "n").select("p_brand", "n", "end", "start")


@query("""WITH s AS (SELECT p_size, (p_size * 37) % 61 AS k FROM part GROUP BY ALL), r AS (SELECT *, max(k) OVER w AS before, coalesce(bool_or(k > 50) OVER w, false) AS over FROM s WINDOW w AS (ORDER BY p_size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
    SELECT p_size, k FROM r WHERE (before IS NULL OR k > before) AND NOT over AND k <= 50""")
def rising_resolutions(spark, sf_dir):
    sizes = load(spark, sf_dir, "part").select("p_size", (F.col("p_size") * 37 % 61).alias("k")).distinct()
    return C.rising(sizes, "p_size", "k", 50)


@query("SELECT l_suppkey, coalesce(stddev_samp(l_tax) > 0, false) AS l_tax, coalesce(stddev_samp(l_linenumber) > 0, false) AS l_linenumber FROM lineitem GROUP BY l_suppkey")
def thresholds_differ(spark, sf_dir):
    return C.thresholds_differ(load(spark, sf_dir, "lineitem"), "l_suppkey", ["l_tax", "l_linenumber"])


@query("""WITH t AS (SELECT l_linenumber AS k, avg(l_quantity) AS q FROM lineitem GROUP BY ALL) SELECT l_orderkey, l_linenumber, sign(coalesce(l_quantity, 0) - q + 1e-6)::INT AS l_quantity FROM lineitem JOIN t ON k = l_linenumber""")
def threshold_signs(spark, sf_dir):
    lines = load(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity")
    return C.threshold_signs(lines, lines.groupBy("l_linenumber").agg(F.avg("l_quantity").alias("l_quantity")), "l_linenumber", ["l_quantity"])


@query("SELECT doc_id, text, lang FROM documents WHERE lang IS NOT NULL AND source IS NOT NULL")
def complete_cases(spark, sf_dir):
    return E.complete_cases(load(spark, sf_dir, "documents"), ["lang", "source"]).select("doc_id", "text", "lang")


@query("SELECT event_id, (value BETWEEN 100 AND 300 AND user_id BETWEEN 10 AND 60 AND event_type <> 'error') AS gate FROM events")
def rectangle_gate(spark, sf_dir):
    gate = G.rectangle(F.col("value"), F.col("user_id"), (100, 300, 10, 60), F.col("event_type") != "error")
    return load(spark, sf_dir, "events").select("event_id", gate.alias("gate"))


SIDES = f"""{VECTORS}, a AS (SELECT * FROM cells WHERE cell_id % 2 = 0), b AS (SELECT cell_id, x * 0.9::DOUBLE + 0.01 AS x, -y * 0.9::DOUBLE - 0.02 AS y FROM cells WHERE cell_id % 2 = 1),
    p AS (SELECT a.cell_id AS a_id, b.cell_id AS b_id, sqrt({D2}) AS dist FROM a JOIN b ON {D2} <= 0.05::DOUBLE * 0.05),
    n AS (SELECT * FROM p QUALIFY row_number() OVER (PARTITION BY a_id ORDER BY dist, b_id) = 1), m AS (SELECT * FROM p QUALIFY row_number() OVER (PARTITION BY b_id ORDER BY dist, a_id) = 1),
    o AS (SELECT * FROM n QUALIFY row_number() OVER (PARTITION BY b_id ORDER BY dist, a_id) = 1)"""


def sides(spark, sf_dir):
    cells = vectors(spark, sf_dir)
    return cells.where("cell_id % 2 = 0"), M.aligned(cells.where("cell_id % 2 = 1"), 0.9, True, 0.01, -0.02)


@query(f"WITH {SIDES} SELECT a_id, b_id, round(dist, 6) AS dist FROM n")
def nearest_match(spark, sf_dir):
    return M.nearest_within(*sides(spark, sf_dir), 0.05).withColumns(r6("dist"))


@query(f"WITH {SIDES} SELECT a_id, b_id, round(n.dist, 6) AS dist FROM n JOIN m USING (a_id, b_id)")
def mutual_nn(spark, sf_dir):
    return M.mutual_nearest(*sides(spark, sf_dir), 0.05).withColumns(r6("dist"))


@query(f"WITH {SIDES} SELECT a_id, b_id, round(dist, 6) AS dist FROM o")
def one_to_one_match(spark, sf_dir):
    return M.one_to_one(M.nearest_within(*sides(spark, sf_dir), 0.05)).withColumns(r6("dist"))


@query(f"""WITH {SIDES} SELECT count(*) AS pairs, round(100 * count(*) / (SELECT count(*) FROM a), 1) AS rate_a, round(100 * count(*) / (SELECT count(*) FROM b), 1) AS rate_b,
    round(quantile_cont(dist, 0.5), 2) AS median_dist FROM o""")
def match_figures(spark, sf_dir):
    a, b = sides(spark, sf_dir)
    return M.match_figures(M.one_to_one(M.nearest_within(a, b, 0.05)), a, b)


@query(f"""WITH {SIDES}, {EXPR} SELECT a_id AS pair_id, feature, 'a' AS modality, round(value, 6) AS value FROM o JOIN expr ON cell_id = a_id UNION ALL
    SELECT a_id, feature, 'b', round(value, 6) FROM o JOIN expr ON cell_id = b_id""")
def bound_expression(spark, sf_dir):
    expr = expression(spark, sf_dir).select("cell_id", "feature", "value")
    return M.bound_expression(M.one_to_one(M.nearest_within(*sides(spark, sf_dir), 0.05)), expr, expr).withColumns(r6("value"))


@query(f"""WITH {SIDES} SELECT a_id AS pair_id, a_id AS codex_cell_id, s.celltype AS codex_celltype, b_id AS merfish_cell_id, t.celltype AS merfish_celltype, 'integrated' AS modality
    FROM o JOIN cells s ON s.cell_id = a_id JOIN cells t ON t.cell_id = b_id""")
def bound_metadata(spark, sf_dir):
    cells = vectors(spark, sf_dir).select("cell_id", "celltype")
    return M.bound_metadata(M.one_to_one(M.nearest_within(*sides(spark, sf_dir), 0.05)), cells, cells)


@query(f"""WITH {SIDES}, {EXPR}, j AS (SELECT a_id AS pair_id, 'a_' || feature AS feature, value, 0.4::DOUBLE AS w FROM o JOIN expr ON cell_id = a_id UNION ALL SELECT a_id, 'b_' || feature, value, 0.6::DOUBLE FROM o JOIN expr ON cell_id = b_id)
    SELECT pair_id, feature, round(w * coalesce((value - avg(value) OVER f) / nullif(stddev_samp(value) OVER f, 0), 0), 6) AS value FROM j WINDOW f AS (PARTITION BY feature)""")
def joint_features(spark, sf_dir):
    expr = expression(spark, sf_dir).select("cell_id", "feature", "value")
    pairs = M.one_to_one(M.nearest_within(*sides(spark, sf_dir), 0.05)).select(F.col("a_id").alias("pair_id"), "a_id", "b_id")
    return E.joint_features(expr, expr, pairs, 0.4).withColumns(r6("value"))


@query(f"WITH {EXPR} SELECT DISTINCT feature FROM expr")
def feature_union(spark, sf_dir):
    """The features of two modalities: even and odd cells."""
    expr = expression(spark, sf_dir)
    return M.all_features(expr.where("cell_id % 2 = 0"), expr.where("cell_id % 2 <> 0"))


@query(f"WITH {EVENTS} SELECT DISTINCT celltype FROM cells")
def label_union(spark, sf_dir):
    """The labels of all samples, each a table of its own."""
    cells = events(spark, sf_dir)
    return M.all_values([cells.where(F.col("sample_id") == k) for k in range(4)], "celltype")


@query(f"WITH {EVENTS} SELECT sample_id, trunc(min(x))::INT AS x_min, trunc(max(x))::INT AS x_max, trunc(min(y))::INT AS y_min, trunc(max(y))::INT AS y_max FROM cells GROUP BY sample_id")
def cell_bounds(spark, sf_dir):
    return M.bounds(events(spark, sf_dir), ("sample_id",)).select("sample_id", "x_min", "x_max", "y_min", "y_max")


@query(f"""WITH {EVENTS}, b AS (SELECT trunc(min(x))::INT AS x0, trunc(max(x))::INT AS x1, trunc(min(y))::INT AS y0, trunc(max(y))::INT AS y1 FROM cells), many AS (SELECT celltype FROM cells GROUP BY celltype HAVING count(*) > 1),
    p AS (SELECT DISTINCT celltype, least(greatest(trunc(x - x0)::INT, 0), x1 - x0) AS px, least(greatest(trunc(y - y0)::INT, 0), y1 - y0) AS py, x1 - x0 AS w, y1 - y0 AS h FROM cells JOIN many USING (celltype), b),
    s(a, c) AS (VALUES (0, 0), (1, 0), (-1, 0), (0, 1), (0, -1)) SELECT DISTINCT celltype, px + a AS px, py + c AS py FROM p, s WHERE px + a BETWEEN 0 AND w AND py + c BETWEEN 0 AND h""")
def mask_pixels(spark, sf_dir):
    return M.mask_pixels(events(spark, sf_dir))


@query(f"""WITH {EVENTS}, b AS (SELECT (trunc(max(x)) - trunc(min(x)) + 1) * (trunc(max(y)) - trunc(min(y)) + 1) * 50000 / 1e9 AS gb FROM cells), n AS (SELECT count(*) AS clusters FROM (SELECT celltype FROM cells GROUP BY celltype HAVING count(*) > 1))
    SELECT clusters, round(gb, 6) AS mask_gb, round(least(1, sqrt(4 / (gb * clusters + 2.5::DOUBLE))), 6) AS factor FROM b, n""")
def compression_factor(spark, sf_dir):
    return M.mask_size(events(spark, sf_dir), bytes_a_pixel=50_000.0, raw_gb=2.5).withColumns(r6("mask_gb", "factor"))


MATRICES = """mats AS (SELECT 'm' || (l_linenumber % 3) AS matrix, l_returnflag AS ref, l_linestatus || l_returnflag AS q, avg(l_quantity::DOUBLE) - 25.4::DOUBLE AS value FROM lineitem GROUP BY ALL),
    pairs AS (SELECT matrix, a.ref, b.ref AS query, CASE WHEN a.ref = 'N' AND b.ref = 'R' AND matrix = 'm1' THEN '-inf'::DOUBLE ELSE round(avg(a.value - 2 * b.value), 4) END AS value FROM mats a JOIN mats b USING (matrix)
              WHERE NOT (matrix = 'm2' AND 'R' IN (a.ref, b.ref)) GROUP BY matrix, a.ref, b.ref)"""
SOFT = "CASE WHEN {0} = '-inf'::DOUBLE THEN 0 ELSE ln(1 + exp({0})) END"
STATUS = """flat AS (SELECT matrix, ref, query, CASE WHEN ref = query THEN 0 ELSE value END AS value FROM pairs),
    st AS (SELECT matrix, bool_or(isinf(value)) AS has_inf, bool_or(NOT isinf(value) AND value < 0) AS has_negative, bool_and(isinf(value) OR value >= 0) AS all_nonnegative FROM flat GROUP BY matrix)"""


def matrices(spark, sf_dir):
    """Three matrices over return flags: one with minus infinity, one without a type."""
    lines = load(spark, sf_dir, "lineitem").select(F.concat(F.lit("m"), (F.col("l_linenumber") % 3).cast("string")).alias("matrix"), F.col("l_returnflag").alias("ref"), "l_linestatus", "l_quantity")
    means = lines.groupBy("matrix", "ref", "l_linestatus").agg((F.avg("l_quantity") - 25.4).alias("value"))
    other = means.select("matrix", F.col("ref").alias("query"), F.col("value").alias("v"))
    value = F.when((F.col("ref") == "N") & (F.col("query") == "R") & (F.col("matrix") == "m1"), F.lit(float("-inf"))).otherwise(F.round(F.avg(F.col("value") - 2 * F.col("v")), 4))
    both = means.join(other, "matrix").where("NOT (matrix = 'm2' AND (ref = 'R' OR query = 'R'))")
    return both.groupBy("matrix", "ref", "query").agg(value.alias("value"))


@query(f"WITH {MATRICES}, {STATUS} SELECT * FROM st")
def matrix_status(spark, sf_dir):
    return X.status(matrices(spark, sf_dir))


@query(f"WITH {MATRICES}, {STATUS} SELECT CASE WHEN bool_or(has_inf) AND NOT bool_and(has_inf) THEN 'inf' WHEN NOT bool_or(has_inf) AND bool_or(all_nonnegative) AND bool_or(has_negative) THEN 'sign' END AS warning FROM st")
def scale_warning(spark, sf_dir):
    return X.scale_warning(X.status(matrices(spark, sf_dir)))


@query(f"WITH {MATRICES} SELECT matrix, ref, query, CASE WHEN ref = 'A' THEN value ELSE 0 END AS value FROM pairs WHERE ref IN ('A', 'N') AND query IN ('A', 'N')")
def matrix_subset(spark, sf_dir):
    return X.unimodal(X.of_types(matrices(spark, sf_dir), ["A", "N"]), "A").select("matrix", "ref", "query", "value")


@query(f"WITH {MATRICES} SELECT * FROM pairs WHERE ref <> 'R' AND query <> 'R'")
def matrix_intersection(spark, sf_dir):
    return X.intersected(matrices(spark, sf_dir)).select("matrix", "ref", "query", "value")


@query(f"""WITH {MATRICES}, t AS (SELECT DISTINCT ref AS type FROM pairs), m AS (SELECT DISTINCT matrix FROM pairs)
    SELECT m.matrix, a.type AS ref, b.type AS query, coalesce(value, '-inf'::DOUBLE) AS value FROM m, t a, t b LEFT JOIN pairs p ON p.matrix = m.matrix AND p.ref = a.type AND p.query = b.type""")
def matrix_union(spark, sf_dir):
    return X.united(matrices(spark, sf_dir))


@query(f"""WITH {MATRICES}, {STATUS}, c AS (SELECT * FROM pairs WHERE ref <> 'R' AND query <> 'R' OR matrix <> 'm2'), s AS (SELECT ref, query, CASE WHEN has_inf THEN {SOFT.format("value")} ELSE value END AS value FROM c JOIN st USING (matrix))
    SELECT ref, query, round(avg(value), 6) AS value FROM s GROUP BY ALL""")
def matrix_integrated(spark, sf_dir):
    return X.integrated(matrices(spark, sf_dir)).withColumns(r6("value"))


@query(f"""WITH {MATRICES} SELECT matrix, ref, query, round(CASE WHEN ref = query OR ref <> 'A' THEN 0 ELSE {SOFT.format("value")} END, 6) AS value FROM pairs""")
def matrix_harmonised(spark, sf_dir):
    return X.harmonised(matrices(spark, sf_dir), "A").select("matrix", "ref", "query", "value").withColumns(r6("value"))


HARMONISED = f"""{MATRICES}, h AS (SELECT matrix, ref, query, CASE WHEN ref = query THEN 0 ELSE {SOFT.format("value")} END AS value FROM pairs),
    act AS (SELECT h.* FROM h JOIN (SELECT matrix, ref FROM h GROUP BY ALL HAVING abs(sum(value)) > 0) USING (matrix, ref))"""


@query(f"WITH {HARMONISED} SELECT round(min(value), 6) AS low, round(quantile_cont(value, 0.5), 6) AS middle, round(max(value), 6) AS high FROM act")
def shared_ramp(spark, sf_dir):
    return X.shared_ramp(X.harmonised(matrices(spark, sf_dir))).withColumns(r6("low", "middle", "high"))


@query(f"WITH {HARMONISED} SELECT matrix, {', '.join(f'round(quantile_cont(value, {k / 4}), 4) AS q{25 * k}' for k in range(5))} FROM act GROUP BY matrix")
def matrix_legend(spark, sf_dir):
    return X.legend(X.harmonised(matrices(spark, sf_dir)))


CHORD = f"""{MATRICES}, {STATUS}, v AS (SELECT matrix, ref, query, CASE WHEN ref = query THEN 0 WHEN has_inf THEN {SOFT.format("value")} ELSE value END AS value, has_inf FROM flat JOIN st USING (matrix)),
    link AS (SELECT v.* FROM v JOIN (SELECT matrix, ref FROM v GROUP BY ALL HAVING abs(sum(value)) > 0) USING (matrix, ref))"""


@query(f"WITH {CHORD} SELECT matrix, ref, query, round(value, 6) AS value FROM link")
def chord_links(spark, sf_dir):
    return X.chord_inputs(matrices(spark, sf_dir))[0].withColumns(r6("value"))


@query(f"""WITH {CHORD}, e AS (SELECT matrix, min(value) AS lo, max(value) AS hi, bool_or(has_inf) AS changed FROM link GROUP BY matrix),
    g AS (SELECT matrix, changed, lo - (lo = hi)::INT * 0.5 AS lo, hi + (lo = hi)::INT * 0.5 AS hi FROM e) SELECT matrix, round(lo, 6) AS low, round(CASE WHEN changed THEN (lo + hi) / 2 ELSE 0 END, 6) AS centre, round(hi, 6) AS high FROM g""")
def chord_ramps(spark, sf_dir):
    return X.chord_inputs(matrices(spark, sf_dir))[1].withColumns(r6("low", "centre", "high"))
