"""The registered queries, and their SQL."""

from . import clusters, labels, readers, spatial, statistics, tables

MODULES = (spatial, tables, statistics, labels, readers, clusters)
QUERIES = {name: f for m in MODULES for name, f in m.QUERIES.items()}
SQL = {name: sql for m in MODULES for name, sql in m.SQL.items()}
#: Queries that no SQL is given for; tests hold them against plain versions.
UNTESTED_BY_SQL = (
    "de_regulation", "provenance", "demo_autocorrelation", "snn_communities", "divided_labels", "batch_corrected", "marker_mixtures", "mixture_phenotypes", "spectral_places",
    "layout_places",
)
