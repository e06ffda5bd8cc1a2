"""Queries over vectors in many dimensions: neighbours, communities, components, batches, mixtures."""

from __future__ import annotations

from pyspark.sql import functions as F

from cytoloom.functions.mixtures import two_normals
from cytoloom.lineage import materialize
from cytoloom.operators.communities import clusters, communities, modularity, named_by_size, snn_graph, sub_clusters
from cytoloom.operators.decompositions import harmony, pca
from cytoloom.operators.expression import template_phenotypes_by_mixture
from cytoloom.operators.layouts import fuzzy_weights, neighbour_layout, spectral_layout
from cytoloom.operators.vectors import nearest_vectors

from .common import expression, lines, load, r6, registry

QUERIES, SQL, query = registry()


def points(spark, sf_dir):
    """Vectors of 64 components as cells."""
    rows = load(spark, sf_dir, "embeddings").where("embedding IS NOT NULL")
    return rows.select(F.col("vec_id").alias("cell_id"), F.col("label").cast("string").alias("label"), F.col("embedding").cast("array<double>").alias("v"))


def _knn(k: int) -> str:
    return f"""p AS (SELECT vec_id AS cell_id, embedding::DOUBLE[] AS v FROM embeddings),
        e AS (SELECT a.cell_id AS src, b.cell_id AS dst, list_distance(a.v, b.v) AS dist, row_number() OVER (PARTITION BY a.cell_id ORDER BY list_distance(a.v, b.v), b.cell_id)::INT AS rank
              FROM p a JOIN p b ON a.cell_id <> b.cell_id QUALIFY rank <= {k})"""


_SHARED = """u AS (SELECT DISTINCT least(src, dst) AS src, greatest(src, dst) AS dst FROM e),
        s AS (SELECT u.src, u.dst, count(*) AS shared FROM u JOIN e a ON a.src = u.src JOIN e b ON b.src = u.dst AND b.dst = a.dst GROUP BY ALL)"""


@query(f"WITH {_knn(15)} SELECT src, dst, rank, round(dist, 6) AS dist FROM e")
def vector_knn(spark, sf_dir):
    """The 15 nearest vectors of each, in 64 dimensions."""
    return nearest_vectors(points(spark, sf_dir), 15).select("src", "dst", "rank", F.round(F.sqrt("d2"), 6).alias("dist"))


@query(f"WITH {_knn(15)}, {_SHARED} SELECT src, dst, shared, round(shared / 15.0, 6) AS weight FROM s")
def vector_snn(spark, sf_dir):
    """Linked vectors and how many of their 15 neighbours they share."""
    return snn_graph(points(spark, sf_dir), 15).withColumns(r6("weight"))


@query(f"""WITH RECURSIVE {_knn(15)}, {_SHARED}, l AS MATERIALIZED (SELECT src, dst FROM s WHERE shared >= 5 UNION SELECT dst, src FROM s WHERE shared >= 5),
        r AS (SELECT src, dst FROM l UNION SELECT r.src, l.dst FROM r JOIN l ON r.dst = l.src),
        c AS (SELECT p.cell_id, least(p.cell_id, coalesce(min(r.dst), p.cell_id)) AS low FROM p LEFT JOIN r ON r.src = p.cell_id GROUP BY p.cell_id),
        n AS (SELECT low, row_number() OVER (ORDER BY count(*) DESC, low) AS k FROM c GROUP BY low)
        SELECT cell_id, 'C' || CASE WHEN k < 10 THEN '0' ELSE '' END || k AS cluster FROM c JOIN n USING (low)""")  # fmt: skip
def strong_communities(spark, sf_dir):
    """Constant Potts communities of strong links at a resolution so low that every merge along a link gains: the graph's components."""
    cells = points(spark, sf_dir)
    found = communities(snn_graph(cells, 15).where("shared >= 5"), cells.select(F.col("cell_id").alias("node")), resolution=1e-9, objective="cpm")
    return named_by_size(found).select(F.col("node").alias("cell_id"), "cluster")


@query()
def snn_communities(spark, sf_dir):
    """Clusters by modularity of the graph of shared neighbours."""
    return clusters(points(spark, sf_dir), k=15, resolution=0.8)


@query(f"""WITH {_knn(15)}, {_SHARED}, w AS (SELECT src, dst, shared / 15.0 AS w FROM s),
        h AS (SELECT c, sum(w) AS k, sum(inside) AS inside FROM (
            SELECT a.label AS c, w, CASE WHEN a.label = b.label THEN w ELSE 0 END AS inside FROM w JOIN embeddings a ON a.vec_id = src JOIN embeddings b ON b.vec_id = dst
            UNION ALL SELECT b.label, w, CASE WHEN a.label = b.label THEN w ELSE 0 END FROM w JOIN embeddings a ON a.vec_id = src JOIN embeddings b ON b.vec_id = dst) GROUP BY c)
        SELECT round(sum(inside / t - 0.8 * (k / t) ** 2), 6) AS modularity FROM h, (SELECT sum(k) AS t FROM h)""")  # fmt: skip
def label_modularity(spark, sf_dir):
    """The modularity of the given labels on the graph of shared neighbours."""
    cells = points(spark, sf_dir)
    return modularity(snn_graph(cells, 15), cells.select(F.col("cell_id").alias("node"), F.col("label").alias("community")), resolution=0.8).withColumns(r6("modularity"))


@query()
def divided_labels(spark, sf_dir):
    """Two labels divided by their own graphs, at two resolutions in one job."""
    cells = points(spark, sf_dir)
    return sub_clusters(cells.select("cell_id", "v"), cells.select("cell_id", "label"), ["0", "1"], [0.5, 1.0], k=10)


@query("""WITH m AS (SELECT k, avg(embedding[k]::DOUBLE) AS m FROM embeddings, range(1, 65) AS t(k) GROUP BY k)
        SELECT vec_id AS cell_id, round(sum((embedding[k]::DOUBLE - m) ** 2), 5) AS energy FROM embeddings, m GROUP BY vec_id""")
def component_energy(spark, sf_dir):
    """Each cell's squared scores on all components: its squared distance from the mean, whatever the rotation."""
    scores, _ = pca(points(spark, sf_dir), 64)
    return scores.groupBy("cell_id").agg(F.round(F.sum(F.col("score") * F.col("score")), 5).alias("energy"))


@query("""WITH c AS (SELECT var_samp(l_quantity) AS a, var_samp(l_extendedprice / 1000) AS b, covar_samp(l_quantity, l_extendedprice / 1000) AS r FROM lineitem),
        v AS (SELECT 1 AS pc, (a + b) / 2 + sqrt(((a - b) / 2) ** 2 + r * r) AS v, a + b AS whole FROM c UNION ALL SELECT 2, (a + b) / 2 - sqrt(((a - b) / 2) ** 2 + r * r), a + b FROM c)
        SELECT pc, round(sqrt(v), 6) AS deviation, round(v / whole, 6) AS share FROM v""")
def line_components(spark, sf_dir):
    """Principal components of quantity and price, with the variance they explain."""
    rows = lines(spark, sf_dir).select("cell_id", F.array("quantity", F.col("extendedprice") / 1000).alias("v"))
    return pca(rows, 2)[1].drop("loadings").withColumns(r6("deviation", "share"))


@query()
def batch_corrected(spark, sf_dir):
    """Scores of ten components, moved together over three batches; the batches are shifted here, as those of a table of one batch aren't."""
    shifted = points(spark, sf_dir).withColumn("batch", F.col("cell_id") % 3)
    shifted = shifted.withColumn("v", F.transform("v", lambda x: x + F.col("batch") * 0.2))
    scores, _ = pca(shifted, 10)
    rows = scores.groupBy("cell_id").agg(F.sort_array(F.collect_list(F.struct("pc", "score"))).getField("score").alias("v")).withColumn("batch", F.col("cell_id") % 3)
    return harmony(rows, clusters=10)[0].select("cell_id", "batch", F.transform("v", lambda x: F.round(x, 6)).alias("v"))


@query()
def marker_mixtures(spark, sf_dir):
    """Two normal components of each marker of the order lines."""
    rows = lines(spark, sf_dir)
    markers = F.explode(F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).alias("value")) for c in ("quantity", "extendedprice", "discount", "tax")]))
    found = two_normals(rows.select(markers.alias("m")).select("m.*"), ["feature"], "value")
    return found.select("feature", *[F.round(c, 5).alias(c) for c in ("share1", "mean1", "sd1", "share2", "mean2", "sd2")])


@query()
def mixture_phenotypes(spark, sf_dir):
    """Labels by a template whose signs come from mixtures of the features."""
    template = spark.createDataFrame([("first", "g00+,g01-"), ("second", "g02+"), ("third", "g00-,g02-")], "celltype_name string, markers string")
    return template_phenotypes_by_mixture(expression(spark, sf_dir).where("feature IN ('g00', 'g01', 'g02')"), template)


def neighbours(spark, sf_dir):
    """(src, dst, dist) to the 15 nearest vectors."""
    return nearest_vectors(points(spark, sf_dir), 15).select("src", "dst", F.sqrt("d2").alias("dist"))


@query(f"""WITH RECURSIVE {_knn(15)}, o AS (SELECT src, list(dist ORDER BY dist) AS ds, coalesce(min(dist) FILTER (dist > 0), 0) AS rho FROM e GROUP BY src),
        b AS (SELECT src, 0 AS i, 0::DOUBLE AS lo, 'inf'::DOUBLE AS hi, 1::DOUBLE AS mid FROM o
              UNION ALL SELECT src, i + 1, lo, hi, CASE WHEN isinf(hi) THEN mid * 2 ELSE (lo + hi) / 2 END
              FROM (SELECT src, i, mid, CASE WHEN high THEN lo ELSE mid END AS lo, CASE WHEN high THEN mid ELSE hi END AS hi
                    FROM (SELECT b.*, list_sum(list_transform(ds, lambda d: exp(-greatest(0, d - rho) / mid))) > log2(15) AS high FROM b JOIN o USING (src) WHERE i < 64))),
        w AS (SELECT e.src, e.dst, exp(-greatest(0, dist - rho) / greatest(mid, 1e-12)) AS w FROM e JOIN o USING (src) JOIN b ON b.src = e.src AND b.i = 64)
        SELECT least(src, dst) AS src, greatest(src, dst) AS dst, round(CASE WHEN count(*) > 1 THEN max(w) + min(w) - max(w) * min(w) ELSE max(w) END, 5) AS w FROM w GROUP BY ALL""")  # fmt: skip
def fuzzy_links(spark, sf_dir):
    """How surely two vectors are neighbours, from bandwidths of their own."""
    return fuzzy_weights(neighbours(spark, sf_dir), 15).withColumns({"w": F.round("w", 5)})


@query()
def spectral_places(spark, sf_dir):
    """Second and third eigenvector of the graph of neighbours; tests hold their residuals."""
    return spectral_layout(neighbours(spark, sf_dir)).select(F.col("node").alias("cell_id"), F.round("x", 6).alias("x"), F.round("y", 6).alias("y"))


@query()
def layout_places(spark, sf_dir):
    """A layout by attraction and repulsion, from the vectors' first two components on."""
    cells = points(spark, sf_dir).select(F.col("cell_id").alias("node"), F.get("v", F.lit(0)).alias("x"), F.get("v", F.lit(1)).alias("y"))
    return neighbour_layout(materialize(neighbours(spark, sf_dir)), 15, rounds=20, start=cells).select(F.col("node").alias("cell_id"), F.round("x", 4).alias("x"), F.round("y", 4).alias("y"))
