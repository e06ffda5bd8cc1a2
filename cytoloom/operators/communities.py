"""Communities of weighted graphs by rounds of moves over edge tables; many graphs in one job.

A partition is valued by H = (weight inside communities) - lambda / 2 * sum over communities of (size^2). For modularity a node's size is its
weighted degree and lambda is resolution / 2m; for the constant Potts model it is the number of cells and lambda the resolution. Weights are
whole multiples of 2^-20, so that sums don't depend on their order and reruns agree.

A round: every node looks for the community where it gains most. Each community is a source or a target by what its joiners and leavers would
gain, and nodes move from sources to targets only. No mover's new community loses a node in its round, so links between movers can only add
to the gains that were counted. What movers that join one community, or leave one, take from each other is lambda s t for each two of sizes s
and t; every mover is charged with all that come before it, by prefix sums over ranges of a hash, and moves only if its gain exceeds the
charge. So H never falls, however many move at once; rounds end when no node has anything to gain.

When rounds bring few moves, communities become the nodes of the next level, and edges are summed. Graphs without moves are finished and
drop out of the job. A second pass starts from the cells again, in the communities that the first one found. In the end communities are split
into their connected components, which raises H.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from cytoloom.lineage import materialize
from cytoloom.operators.neighbors import knn_edges, snn_edges
from cytoloom.operators.vectors import nearest_vectors

UNIT = 2**20
RANGES = 4096


def _graph(keys: tuple[str, ...]) -> Column:
    return (F.struct(*keys) if keys else F.struct(F.lit(0).alias("all"))).alias("g")


def _back(keys: tuple[str, ...]) -> list[Column]:
    return [F.col(f"g.{k}") for k in keys]


def components(edges: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """(keys, node, root): the smallest node that each node of (keys, src, dst) can reach."""
    ends = [F.struct(F.col(a).alias("a"), F.col(b).alias("b")) for a, b in (("src", "dst"), ("dst", "src"))]
    both = materialize(edges.select(_graph(keys), F.explode(F.array(*ends)).alias("e")).select("g", "e.*").distinct())
    return _roots(both, both.select("g", F.col("a").alias("node")).distinct()).select(*_back(keys), "node", "root")


def _roots(both: DataFrame, nodes: DataFrame) -> DataFrame:
    """(g, node, root) by the least root among neighbours, then that root's own root, until nothing changes."""
    roots = nodes.select("g", "node", F.col("node").alias("root"), F.lit(True).alias("changed"))
    while True:
        low = both.join(roots.select("g", F.col("node").alias("b"), "root"), ["g", "b"]).groupBy("g", F.col("a").alias("node")).agg(F.min("root").alias("low"))
        new = roots.join(low, ["g", "node"], "left").select("g", "node", F.col("root").alias("old"), F.least("root", "low").alias("root"))
        ahead = new.select("g", F.col("node").alias("root"), F.col("root").alias("next"))
        roots = materialize(new.join(ahead, ["g", "root"]).select("g", "node", F.col("next").alias("root"), (F.col("next") != F.col("old")).alias("changed")))
        if roots.where("changed").isEmpty():
            return roots.drop("changed")


def _allowed(movers: DataFrame, seed: int) -> DataFrame:
    """The movers from sources to targets: a community is a target in this round if the gains of those that would join it outweigh those of
    the ones that would leave, with weights by a hash that break circles."""
    ends = F.explode(F.array(F.struct(F.col("to").alias("c"), F.floor("gain").alias("joins"), F.lit(0).cast("long").alias("leaves")), F.struct(F.col("comm").alias("c"), F.lit(0).cast("long").alias("joins"), F.floor("gain").alias("leaves"))))
    u = 0.25 + F.pmod(F.xxhash64("c", F.lit(seed)), F.lit(1024)) / 2048
    roles = movers.select("g", ends.alias("e")).groupBy("g", "e.c").agg(F.sum("e.joins").alias("joins"), F.sum("e.leaves").alias("leaves"))
    roles = roles.select("g", "c", (F.col("joins") * u > F.col("leaves") * (1 - u)).alias("target"))
    targets, sources = roles.where("target").select("g", F.col("c").alias("to")), roles.where("NOT target").select("g", F.col("c").alias("comm"))
    return movers.join(targets, ["g", "to"], "left_semi").join(sources, ["g", "comm"], "left_semi")


def _charges(movers: DataFrame, seed: int) -> DataFrame:
    """(g, node, charge): the sizes of the movers that come before a node in the community that it joins or leaves: all of earlier ranges of a
    hash, and of its own. No community is joined and left in one round."""
    part = F.pmod(F.xxhash64("node", F.lit(seed)), F.lit(RANGES)).alias("part")
    ends = movers.select("g", "node", "s", part, F.explode(F.array("comm", "to")).alias("c"))
    upto = F.sum("n").over(W.partitionBy("g", "c").orderBy("part"))
    sums = ends.groupBy("g", "c", "part").agg(F.sum("s").alias("n")).select("g", "c", "part", upto.alias("upto"))
    return ends.join(sums, ["g", "c", "part"]).groupBy("g", "node").agg(F.sum(F.col("upto") - F.col("s")).alias("charge"))


def _gains(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(g, node, comm, to, s, lam, gain): the nodes that gain by a move, and the community where they gain most."""
    sizes = nodes.groupBy("g", "comm").agg(F.sum("s").alias("size"))
    info = nodes.join(sizes, ["g", "comm"])
    there = info.select("g", F.col("node").alias("b"), F.col("comm").alias("to"), F.col("size").alias("to_size"))
    seen = edges.join(there, ["g", "b"]).groupBy("g", "a", "to").agg(F.sum("w").alias("w"), F.first("to_size").alias("to_size"))
    seen = seen.join(info.withColumnRenamed("node", "a"), ["g", "a"])
    score = F.col("w") - F.col("lam") * F.col("s") * F.col("to_size")
    best = seen.groupBy("g", F.col("a").alias("node")).agg(
        F.max(F.when(F.col("to") != F.col("comm"), F.struct(score.alias("score"), "to"))).alias("best"),
        F.coalesce(F.max(F.when(F.col("to") == F.col("comm"), F.col("w"))), F.lit(0)).alias("w"),
        *[F.first(c).alias(c) for c in ("comm", "s", "lam", "size")],
    )
    stay = F.col("w") - F.col("lam") * F.col("s") * (F.col("size") - F.col("s"))
    return best.where("best IS NOT NULL").select("g", "node", "comm", "best.to", "s", "lam", (F.col("best.score") - stay).alias("gain")).where("gain > 1e-3")


def _round(edges: DataFrame, nodes: DataFrame, seed: int) -> tuple[DataFrame, bool]:
    """(nodes (g, node, comm, s, lam) after one round, with moved; whether any node had something to gain)."""
    movers = materialize(_gains(edges, nodes))
    if movers.isEmpty():
        return nodes.withColumn("moved", F.lit(False)), False
    movers = _allowed(movers, seed)
    moves = movers.join(_charges(movers, seed), ["g", "node"])
    moves = moves.where(F.col("gain") - F.col("lam") * F.col("s") * F.col("charge") > 1e-3).select("g", "node", "to")
    after = nodes.join(moves, ["g", "node"], "left")
    return materialize(after.select("g", "node", F.coalesce("to", "comm").alias("comm"), "s", "lam", F.col("to").isNotNull().alias("moved"))), True


def _rounds(edges: DataFrame, nodes: DataFrame, seed: int, max_rounds: int, few: float) -> tuple[DataFrame, DataFrame]:
    """(nodes, moved (g) with the graphs of which any node moved). A graph's rounds end when nothing is to be gained, or when the share ``few`` of
    its nodes or less moves, but some did; so what happens to it doesn't depend on the other graphs of the job."""
    tally = nodes.groupBy("g").agg(F.count("*").alias("total")).withColumns({"ever": F.lit(False), "open": F.lit(True)})
    for k in range(max_rounds):
        nodes, gains = _round(edges, nodes, seed + k)
        if not gains:
            break
        now = nodes.groupBy("g").agg(F.count_if("moved").alias("now"))
        ever = F.col("ever") | (F.col("now") > 0)
        tally = materialize(tally.join(now, "g").select("g", "total", ever.alias("ever"), (F.col("open") & ~(ever & (F.col("now") <= few * F.col("total")))).alias("open")))
        if tally.where("open").isEmpty():
            break
        edges = edges.join(tally.where("open").select("g"), "g", "left_semi")
    return nodes.drop("moved"), tally.where("ever").select("g")


def communities(
    edges: DataFrame, nodes: DataFrame, keys: tuple[str, ...] = (), resolution: float | str = 1.0, objective: str = "modularity", max_rounds: int = 24, passes: int = 2, few: float = 0.1, seed: int = 98
) -> DataFrame:
    """(keys, node, community): the community of each of nodes (keys, node), named by its smallest node.

    edges: (keys, src, dst, weight), each unordered pair once; weights of 0 or less and loops don't count. resolution may be one of the keys,
    so that a sweep is one job. objective: modularity or cpm. Nodes without edges are alone; a graph without any edge is one community.
    """
    rate = F.col(f"g.{resolution}").cast("double") if isinstance(resolution, str) else F.lit(float(resolution))
    weight = F.round(F.col("weight") * UNIT).cast("long")
    ends = [F.struct(F.col(a).alias("a"), F.col(b).alias("b")) for a, b in (("src", "dst"), ("dst", "src"))]
    links = edges.where("src <> dst").select(_graph(keys), F.explode(F.array(*ends)).alias("e"), weight.alias("w")).where("w > 0")
    links = materialize(links.groupBy("g", "e.a", "e.b").agg(F.sum("w").alias("w")))
    all_nodes = nodes.select(_graph(keys), "node").distinct()
    degrees = links.groupBy("g", F.col("a").alias("node")).agg(F.sum("w").alias("s"))
    totals = materialize(links.groupBy("g").agg(F.sum("w").alias("total")))
    lam, size = (rate / F.col("total"), F.col("s")) if objective == "modularity" else (rate * UNIT, F.lit(1).cast("long"))
    start = degrees.join(totals, "g").select("g", "node", F.col("node").alias("comm"), size.alias("s"), lam.alias("lam"))
    members = materialize(start)
    for _ in range(passes):
        inner, level, lowest, changed = links, members, True, False
        while True:
            level, moved = _rounds(inner, level, seed, max_rounds, few)
            seed, none = seed + max_rounds, moved.isEmpty()
            changed |= not none
            if lowest:
                members = level
            elif not none:
                step = level.select("g", F.col("node").alias("comm"), F.col("comm").alias("next"))
                members = materialize(members.join(step, ["g", "comm"], "left").select("g", "node", F.coalesce("next", "comm").alias("comm"), "s", "lam"))
            open_graphs = level.where("comm <> node").select("g").distinct().join(moved, "g", "left_semi")
            if none or open_graphs.isEmpty():
                break
            lowest = False
            to = lambda c: level.select("g", F.col("node").alias(c), F.col("comm").alias(f"{c}_to"))
            inner = inner.join(open_graphs, "g", "left_semi").join(to("a"), ["g", "a"]).join(to("b"), ["g", "b"]).where("a_to <> b_to")
            inner = materialize(inner.groupBy("g", F.col("a_to").alias("a"), F.col("b_to").alias("b")).agg(F.sum("w").alias("w")))
            level = level.join(open_graphs, "g", "left_semi").groupBy("g", "comm").agg(F.sum("s").alias("s"), F.first("lam").alias("lam"))
            level = materialize(level.select("g", F.col("comm").alias("node"), "comm", "s", "lam"))
        if not changed:
            break
    a, b = (members.select("g", F.col("node").alias(c), F.col("comm").alias(f"{c}_in")) for c in ("a", "b"))
    together = materialize(links.select("g", "a", "b").join(a, ["g", "a"]).join(b, ["g", "b"]).where("a_in = b_in").select("g", "a", "b"))
    roots = _roots(together, together.select("g", F.col("a").alias("node")).distinct())
    least = all_nodes.groupBy("g").agg(F.min("node").alias("least"))
    out = all_nodes.join(roots, ["g", "node"], "left").join(totals, "g", "left").join(least, "g")
    alone = F.when(F.col("total").isNull(), F.col("least")).otherwise(F.col("node"))
    return out.select(*_back(keys), "node", F.coalesce("root", alone).alias("community"))


def named_by_size(found: DataFrame, keys: tuple[str, ...] = (), prefix: str = "C") -> DataFrame:
    """(keys, node, cluster): C01, C02, ... from the largest community on, ties by its name."""
    sizes = found.groupBy(*keys, "community").agg(F.count("*").alias("_n"))
    place = F.row_number().over(W.partitionBy(*keys).orderBy(F.desc("_n"), "community")).cast("string")
    names = sizes.select(*keys, "community", F.concat(F.lit(prefix), F.when(F.length(place) < 2, F.lpad(place, 2, "0")).otherwise(place)).alias("cluster"))
    return found.join(names, [*keys, "community"]).select(*keys, "node", "cluster")


def modularity(edges: DataFrame, found: DataFrame, keys: tuple[str, ...] = (), resolution: float | str = 1.0, community: str = "community") -> DataFrame:
    """(keys, modularity) of a partition (keys, node, community) of (keys, src, dst, weight)."""
    rate = F.col(f"g.{resolution}").cast("double") if isinstance(resolution, str) else F.lit(float(resolution))
    of = found.select(_graph(keys), "node", F.col(community).alias("c"))
    rows = edges.where("src <> dst AND weight > 0").select(_graph(keys), "src", "dst", "weight")
    for end in ("src", "dst"):
        rows = rows.join(of.select("g", F.col("node").alias(end), F.col("c").alias(f"c_{end}")), ["g", end])
    halves = F.explode(F.array(*[F.struct(F.col(f"c_{end}").alias("c"), F.when(F.col("c_src") == F.col("c_dst"), F.col("weight")).otherwise(0.0).alias("inside")) for end in ("src", "dst")]))
    sums = rows.select("g", "weight", halves.alias("h")).groupBy("g", "h.c").agg(F.sum("weight").alias("k"), F.sum("h.inside").alias("inside"))
    total = sums.groupBy("g").agg(F.sum("k").alias("all"))
    each = F.col("inside") / F.col("all") - rate * F.pow(F.col("k") / F.col("all"), F.lit(2.0))
    return sums.join(total, "g").groupBy("g").agg(F.sum(each).alias("modularity")).select(*_back(keys), "modularity")


def snn_graph(vectors: DataFrame, k: int, keys: tuple[str, ...] = ()) -> DataFrame:
    """(keys, src, dst, shared, weight): the graph of shared neighbours over the k nearest of each (keys, cell_id, v)."""
    return materialize(snn_edges(materialize(nearest_vectors(vectors, k, keys)), k, keys=keys))


def clusters(vectors: DataFrame, k: int = 15, resolution: float = 0.8, objective: str = "modularity") -> DataFrame:
    """(cell_id, cluster): C01, C02, ... by size, from the graph of shared neighbours of (cell_id, v)."""
    found = communities(snn_graph(vectors, k), vectors.select(F.col("cell_id").alias("node")), (), resolution, objective)
    return named_by_size(found).select(F.col("node").alias("cell_id"), "cluster")


def resolution_sweep(vectors: DataFrame, resolutions: list[float], k: int = 15, keys: tuple[str, ...] = (), objective: str = "modularity") -> DataFrame:
    """(keys, resolution, cell_id, cluster): one job for all resolutions and keys; its plan doesn't grow with either."""
    rates = vectors.sparkSession.createDataFrame([(float(r),) for r in resolutions], "resolution double")
    each = lambda df: df.crossJoin(F.broadcast(rates))  # noqa: E731  # as many rows as resolutions
    of = (*keys, "resolution")
    found = communities(each(snn_graph(vectors, k, keys)), each(vectors.select(*keys, F.col("cell_id").alias("node"))), of, "resolution", objective)
    return named_by_size(found, of).select(*of, F.col("node").alias("cell_id"), "cluster")


def clusters_by_resolution(sweep: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """(keys, resolution, n_clusters) of a sweep."""
    return sweep.groupBy(*keys, "resolution").agg(F.count_distinct("cluster").alias("n_clusters"))


def sub_clusters(vectors: DataFrame, labels: DataFrame, targets: list[str], resolutions: list[float], k: int = 15) -> DataFrame:
    """(resolution, cell_id, cluster): (cell_id, label) with each of the target labels divided by its own graph, as label_1, label_2, ... by size.

    Cells of other labels keep theirs. All targets and resolutions are one job.
    """
    session = vectors.sparkSession
    rates = F.broadcast(session.createDataFrame([(float(r),) for r in resolutions], "resolution double"))  # as many rows as resolutions
    own = labels.select("cell_id", F.col("label").cast("string").alias("label"))
    parts = vectors.join(own.where(F.col("label").isin(*targets)), "cell_id").withColumnRenamed("label", "target")
    found = resolution_sweep(parts, resolutions, k, ("target",)).select("resolution", "cell_id", F.concat_ws("_", "target", F.expr("cast(substring(cluster, 2) AS int)")).alias("cluster"))
    rest = own.where(~F.coalesce(F.col("label").isin(*targets), F.lit(False))).crossJoin(rates)
    return found.unionByName(rest.select("resolution", "cell_id", F.col("label").alias("cluster")))


def joint_clusters(cells: DataFrame, k: int = 20, resolution: float = 0.8) -> DataFrame:
    """(cell_id, cluster): constant Potts communities of the plain graph of the k nearest in two dimensions; cells: cell_id, x, y, celltype."""
    edges = knn_edges(cells, k).select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst")).distinct()
    found = communities(materialize(edges.withColumn("weight", F.lit(1.0))), cells.select(F.col("cell_id").alias("node")), (), resolution, "cpm")
    return named_by_size(found).select(F.col("node").alias("cell_id"), "cluster")
