"""Mixing sources to target weights by a low-discrepancy schedule.

Slot j of the mix has the point frac((j + 1) * golden ratio), which falls into a source's part of the cumulative weights; its rank
is the number of the source's earlier slots. Each source's documents, shuffled by hash, form a line of words that repeats; a slot
of rank r takes the r-th block of ``block`` words of that line, the last one up to the source's target.

Scale: a document's place on its source's line comes from two-level sums (hash ranges of a source first), and a slot's rank from
counts by ranges of j, so no source is ever sorted in one task. Slots and documents meet by an equi-join on source and block.
Only one row per source reaches the driver; sources are taken to be few enough for that, up to a million.

Defined results
---------------
* Null, empty and blank texts have size 0 and are taken 0 times. Null sources are one source, last in order.
* Targets stop at ``max_epochs`` times their source's size; the excess is reshared by weight among the rest.
* If all sizes are 0, or the table is empty, targets are 0. Repeated rows are separate documents; ties in the shuffle go by id,
  and rows that tie in everything share what their places take, which depends on nothing but how many there are. Of rows that share
  source, id and size, take_mix() deals the copies out in turn.
* Nothing depends on partitioning or row order; reruns agree. Columns of df with clashing names are replaced.
* Texts are taken whole, however long; a document's size has no bound.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import materialize, set_aside

GOLDEN = (math.sqrt(5) - 1) / 2


def word_count(text: str) -> Column:
    return F.regexp_count(F.coalesce(F.col(text), F.lit("")), F.lit(r"[^\x20\x09-\x0D]+")).cast("long")


def targets(sizes: list[int], weights: list[float], max_epochs: float) -> list[float]:
    """Shares of the total size by weight; what exceeds max_epochs times a source's size goes to the others by weight."""
    capped: set[int] = set()
    while True:
        rest = sum(sizes) - sum(max_epochs * sizes[k] for k in capped)
        free = sum(w for k, w in enumerate(weights) if k not in capped)
        share = {k: rest * w / free for k, w in enumerate(weights) if k not in capped}
        over = {k for k, t in share.items() if t > max_epochs * sizes[k]}
        if not over:
            return [float(max_epochs * sizes[k]) if k in capped else share[k] for k in range(len(sizes))]
        capped |= over


def slot_sources(start: int, end: int, bounds: np.ndarray) -> np.ndarray:
    """The source of each slot from start to end; bounds are the cumulative weights."""
    points = ((np.arange(start, end, dtype=np.float64) + 1) * GOLDEN) % 1.0
    return np.minimum(np.searchsorted(bounds, points, side="right"), len(bounds) - 1)


def schedule(spark, quota: list[int], block: int, stretch: int = 1 << 16) -> DataFrame:
    """(slot, src, rank): the slots of the mix in order, until each source has the slots that its quota of words needs.

    The golden-ratio sequence gives a part of width w of the first n points n * w of them up to a few times log n. So n points, with a
    surplus of that size, are enough for every source that needs more than the surplus itself; their other slots are left out. The
    few slots of smaller sources are spread evenly instead, by the same sequence from each one's own start: rank r gets the slot
    nearest to (r + frac(source * golden ratio)) / need of the way. Slot numbers of those may tie with others; the order by slot,
    source and rank is the mix. The number of slots of each source is checked when the plan runs: one that falls short raises an error.
    """
    need = [-(-q // block) for q in quota]
    total = sum(need)
    if not total:
        return spark.createDataFrame([], "slot long, src int, rank long")
    spare = 16 + 4 * math.log2(total + 2)
    small = [k for k, n in enumerate(need) if 0 < n <= spare]
    wide = [0 if k in set(small) else n for k, n in enumerate(need)]
    rows = [(int((r + (k * GOLDEN) % 1.0) / need[k] * total), k, r) for k in small for r in range(need[k])]  # at most spare rows a source
    even = spark.createDataFrame(rows, "slot long, src int, rank long")
    return _golden(spark, wide, total, spare, stretch).unionByName(even) if any(wide) else even


def _golden(spark, need: list[int], span: int, spare: float, stretch: int) -> DataFrame:
    total = sum(need)
    bounds = np.cumsum(np.array(need) / total)
    n = math.ceil(max((k + spare) * total / k for k in need if k))

    def run(frames):
        for frame in frames:
            for c in frame["id"]:
                source = slot_sources(c * stretch, min(n, (c + 1) * stretch), bounds)
                order = np.argsort(source, kind="stable")
                first = np.searchsorted(source[order], np.arange(len(bounds)))
                inner = np.empty(len(source), np.int64)
                inner[order] = np.arange(len(source)) - first[source[order]]
                slot = (np.arange(len(source), dtype=np.int64) + c * stretch) * span // total
                yield pd.DataFrame({"chunk": np.int64(c), "slot": slot, "src": source.astype(np.int32), "inner": inner})

    chunks = spark.range(-(-n // stretch))
    slots = chunks.repartition("id").mapInPandas(run, "chunk long, slot long, src int, inner long")
    counts = slots.groupBy("src", "chunk").agg(F.count("*").alias("n"))  # sources x stretches: small beside the slots
    every = F.sum("n").over(W.partitionBy("src"))
    earlier = F.sum("n").over(W.partitionBy("src").orderBy("chunk").rowsBetween(W.unboundedPreceding, -1))
    needs = F.array(*[F.lit(int(k)) for k in need])
    short = F.raise_error(F.lit("the schedule has too few slots for a source"))
    earlier = F.when(every < F.get(needs, F.col("src")), short).otherwise(F.coalesce(earlier, F.lit(0)))
    counts = counts.select("src", "chunk", earlier.alias("earlier"))
    ranked = slots.hint("merge").join(counts, ["src", "chunk"]).select("slot", "src", (F.col("earlier") + F.col("inner")).alias("rank"))
    return ranked.where(F.col("rank") < F.get(needs, F.col("src")))


def source_table(rows: DataFrame, weights: tuple[float, ...], max_epochs: float) -> list[dict]:
    """One entry per source in order, null last: its size and target; weights repeat."""
    found = rows.groupBy("source").agg(F.sum("size").alias("size"), F.count("*").alias("docs")).collect()
    found.sort(key=lambda r: (r["source"] is None, r["source"] or ""))
    sizes = [int(r["size"]) for r in found]
    goals = targets(sizes, [weights[k % len(weights)] for k in range(len(found))], max_epochs) if found else []
    return [{"source": r["source"], "src": k, "size": s, "docs": r["docs"], "target": g} for k, (r, s, g) in enumerate(zip(found, sizes, goals))]


def on_lines(rows: DataFrame, sources: list[dict], range_rows: int) -> DataFrame:
    """rows with the place of each document on its source's shuffled line: column at, in words."""
    ranges = F.array(*[F.lit(max(1, math.ceil(s["docs"] / range_rows))) for s in sources])
    rows = rows.withColumn("h", F.xxhash64("doc_id", F.lit("mix")))
    # The top 31 bits of the hash, unsigned, scaled to the source's number of ranges: ranges follow the order of the hash.
    top = F.shiftrightunsigned("h", 33)
    rows = rows.withColumn("part", F.shiftrightunsigned(top * F.get(ranges, F.col("src")), 31))
    sums = rows.groupBy("src", "part").agg(F.sum("size").alias("n"))
    before = F.sum("n").over(W.partitionBy("src").orderBy("part").rowsBetween(W.unboundedPreceding, -1))
    sums = sums.select("src", "part", F.coalesce(before, F.lit(0)).alias("before"))
    inside = W.partitionBy("src", "part").orderBy(top, "h", "doc_id", "size").rowsBetween(W.unboundedPreceding, -1)
    rows = rows.withColumn("inside", F.coalesce(F.sum("size").over(inside), F.lit(0)))
    return rows.join(sums, ["src", "part"]).withColumn("at", F.col("before") + F.col("inside")).drop("h", "part", "before", "inside")


def mix_sources(
    df: DataFrame,
    text: str = "text",
    source: str = "source",
    id_col: str = "doc_id",
    weights: tuple[float, ...] = (1, 2, 3),
    max_epochs: int = 3,
    block: int = 256,
    range_rows: int = 1 << 12,
) -> tuple[DataFrame, DataFrame]:
    """What the mix takes of each document, and the schedule.

    First: (doc_id, source, size, source_size, target, taken, copies) per row of df: taken counts words with repeats; copies counts
    how often the mix comes past the document's first word, the number of whole copies to take. Second: (slot, src, rank) of schedule().
    """
    rows = materialize(df.select(F.col(id_col).alias("doc_id"), F.col(source).cast("string").alias("source"), word_count(text).alias("size")))
    sources = source_table(rows, weights, max_epochs)
    spark = df.sparkSession
    lengths = [s["size"] for s in sources]
    quota = [min(round(s["target"]), max_epochs * s["size"]) for s in sources]
    slots = schedule(spark, quota, block)
    fields = "source string, src int, source_size long, target double"
    named = spark.createDataFrame([(s["source"], s["src"], s["size"], s["target"]) for s in sources], fields)
    rows = rows.join(named, rows["source"].eqNullSafe(named["source"])).drop(named["source"])
    if not sources:
        none = {"source_size": "long", "target": "double", "taken": "long", "copies": "long"}
        return rows.select("doc_id", "source", "size", *[F.lit(None).cast(t).alias(c) for c, t in none.items()]), slots
    rows = materialize(on_lines(rows, sources, range_rows))

    # A block of the repeated line covers one stretch of the source's own line, or two where it passes the end, or whole rounds.
    length, goal = (F.get(F.array(*[F.lit(int(x)) for x in v]), F.col("src")) for v in (lengths, quota))
    cut = slots.withColumn("length", length).withColumn("from", F.col("rank") * block)
    cut = cut.withColumn("to", F.least(F.col("from") + block, goal))
    epoch = F.explode(F.sequence(F.expr("`from` div length"), F.expr("(`to` - 1) div length")))
    cut = cut.select("src", "length", "from", "to", epoch.alias("epoch"))
    cut = cut.select(
        "src",
        F.greatest(F.lit(0), F.col("from") - F.col("epoch") * F.col("length")).alias("a"),
        F.least(F.col("length"), F.col("to") - F.col("epoch") * F.col("length")).alias("b"),
    )
    pieces = cut.withColumn("cell", F.explode(F.sequence(F.expr(f"a div {block}"), F.expr(f"(b - 1) div {block}"))))
    pieces = pieces.select("src", "cell", F.greatest("a", F.col("cell") * block).alias("a"), F.least("b", (F.col("cell") + 1) * block).alias("b"))
    pieces = pieces.groupBy("src", "cell", "a", "b").agg(F.count("*").alias("times"))

    key = free = "row"
    rows = rows.withColumn(key, F.struct("src", "at", "doc_id", "size"))
    distinct = rows.where("size > 0").select("src", "at", "size", free).distinct()
    cells = F.explode(F.sequence(F.expr(f"at div {block}"), F.expr(f"(at + size - 1) div {block}")))
    spans = distinct.withColumn("cell", cells)
    covered = F.greatest(F.lit(0), F.least(F.col("b"), F.col("at") + F.col("size")) - F.greatest(F.col("a"), F.col("at")))
    first = F.when((F.col("a") <= F.col("at")) & (F.col("at") < F.col("b")), F.col("times")).otherwise(0)
    # These sides grow with the input: a sort-merge join, never a broadcast.
    got = spans.hint("merge").join(pieces, ["src", "cell"]).groupBy(key).agg(
        F.sum(covered * F.col("times")).alias("taken"), F.sum(first).cast("long").alias("copies")
    )
    got = got.select(F.col("row.src").alias("g_src"), F.col("row.at").alias("g_at"), F.col("row.doc_id").alias("g_id"), F.col("row.size").alias("g_size"), "taken", "copies")
    same = (rows["src"] == got["g_src"]) & (rows["at"] == got["g_at"]) & rows["doc_id"].eqNullSafe(got["g_id"]) & (rows["size"] == got["g_size"])
    out = rows.hint("merge").join(got, same, "left")
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    return out.select("doc_id", "source", "size", "source_size", "target", zero("taken"), zero("copies")), slots


def take_mix(df: DataFrame, text: str = "text", source: str = "source", id_col: str = "doc_id", **how) -> DataFrame:
    """The rows of df in the mix, as often as the mix comes past their first word; the columns of df.

    Rows are told apart by source, id and size. Copies of rows that tie in all three are dealt to them in turn: each gets the whole
    share, and as many of them as there are copies left over get one more, in the order of a hash of the row.
    """
    names = df.columns
    df, back = set_aside(df, (text, source, id_col))
    plan, _ = mix_sources(df, text, source, id_col, **how)
    keys = {"mix_source": F.col(source).cast("string"), "mix_id": F.col(id_col), "mix_size": word_count(text)}
    copies = plan.groupBy(F.col("source").alias("p_source"), F.col("doc_id").alias("p_id"), F.col("size").alias("p_size")).agg(F.sum("copies").alias("mix_copies"), F.count("*").alias("mix_rows"))
    rows = df.withColumns(keys)
    same = rows["mix_source"].eqNullSafe(copies["p_source"]) & rows["mix_id"].eqNullSafe(copies["p_id"]) & (rows["mix_size"] == copies["p_size"])
    joined = rows.hint("merge").join(copies.where("mix_copies > 0"), same)
    alone = joined.where("mix_rows = 1").withColumn("mix_n", F.col("mix_copies"))
    tied = dealt(joined.where("mix_rows > 1"), [F.col(c).cast("string") for c, t in df.dtypes if not t.startswith(("map", "variant"))])
    both = alone.unionByName(tied).where("mix_n > 0")
    both = both.withColumn("mix_n", F.explode(F.sequence(F.lit(1), F.col("mix_n").cast("int"))))
    return both.select(*df.columns).withColumnsRenamed(back).select(*names)


def dealt(rows: DataFrame, columns: list) -> DataFrame:
    """rows with mix_n: their group's mix_copies dealt over its mix_rows rows.

    Groups may be large (all rows without an id), so rows are counted by ranges of a hash first and ordered inside a range only.
    """
    group = ["p_source", "p_id", "p_size"]
    rows = rows.withColumn("mix_hash", F.xxhash64(*columns)).withColumn("mix_part", F.shiftrightunsigned("mix_hash", 52))
    parts = rows.groupBy(*group, "mix_part").agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(W.partitionBy(*group).orderBy("mix_part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    parts = parts.select(*[F.col(c).alias(f"q_{c}") for c in group], F.col("mix_part").alias("q_part"), before.alias("mix_before"))
    same = rows["mix_part"] == parts["q_part"]
    for c in group:
        same &= rows[c].eqNullSafe(parts[f"q_{c}"])
    place = F.row_number().over(W.partitionBy(*group, "mix_part").orderBy("mix_hash"))
    rows = rows.withColumn("mix_place", place).join(parts, same)
    more = F.col("mix_before") + F.col("mix_place") <= F.col("mix_copies") % F.col("mix_rows")
    return rows.withColumn("mix_n", F.floor(F.col("mix_copies") / F.col("mix_rows")) + more.cast("long")).drop("mix_hash", "mix_part", "mix_place", "mix_before", "q_part", *[f"q_{c}" for c in group])
