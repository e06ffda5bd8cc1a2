"""Source divergence audit: how far each source's use of terms is from the other sources' and from its language's.

Per language the terms in at least ``min_docs`` documents are kept. A group (language, source), and the language itself, gives a kept
term p = 1 + floor(10^9 (count + 5) / (N + 5 V)): V kept terms, N their occurrences there. Two groups differ by the sum of |p - q| over
all kept terms, whether they hold them or not. All arithmetic is on whole numbers.

Heavy-light split: a term in more than ``light`` groups of its language is heavy. Heavy terms are cut into tiles of about ``tile_terms``
and groups into blocks of about ``block_groups``; one task takes a tile of terms and two blocks of groups as dense matrices. A light term
is absent from nearly all groups, and there p is one number of the group, p0. So for two groups the light terms sum to
    V_light |p0 - q0| + sum over the one's terms of (|p - q0| - |p0 - q0|) + the same of the other
    + sum over terms of both of (|p - q| - |p - q0| - |p0 - q| + |p0 - q0|).
The first three come from each group's counts of equal p, the last from pairs inside posting lists of at most ``light`` groups, which are
summed in the task before anything is shuffled. Dense and sparse sums are whole numbers and are added.

On Spark: one pass over the texts counts terms inside each task (a table of about ``hold`` terms of groups, then it is handed on), and one row
per task and term is shuffled, whichever language or source is hot. What grows with languages and sources is joined, not collected.

Defined results
---------------
* Null text, language and source are ''. Rows are documents, repeated rows too; no id is read. Further columns are ignored.
* A group without terms has p0 for every kept term. Where no term is kept, all sums are 0 and there are no term rows. One source alone
  in its language has no pair rows. An empty table gives no rows. Texts are taken whole.
* Ties go to the item that is first by its UTF-8 bytes. Counts may reach 10^18.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import materialize
from .terms import LETTERS, terms_of

PAIR = "lang string, source string, other string, value long"


class Held:
    """Counts of one task: per group the occurrences of terms, per language the documents that hold them."""

    def __init__(self):
        self.groups: dict[str, dict[str, Counter]] = {}
        self.docs: dict[str, Counter] = {}

    def add(self, lang: str, source: str, text: bytes | None) -> None:
        own = terms_of(text, LETTERS)
        own.append(b"")  # a group without terms has this one
        self.groups.setdefault(lang, {}).setdefault(source, Counter()).update(own)
        self.docs.setdefault(lang, Counter()).update(set(own))

    def size(self) -> int:
        return sum(len(c) for by_source in self.groups.values() for c in by_source.values())

    def batches(self):
        """Per language a batch with one row per term: its documents, the sources that hold it, and its occurrences in each."""
        for lang, docs in self.docs.items():
            place = {t: k for k, t in enumerate(docs)}
            names, counts = list(self.groups[lang]), list(self.groups[lang].values())
            term = np.concatenate([np.fromiter(map(place.__getitem__, c), np.int64, len(c)) for c in counts])
            source = np.repeat(np.arange(len(counts)), [len(c) for c in counts])
            order = np.argsort(term, kind="stable")
            ends = pa.array(np.concatenate([[0], np.cumsum(np.bincount(term, minlength=len(docs)))]), pa.int32())
            n = np.concatenate([np.fromiter(c.values(), np.int64, len(c)) for c in counts])[order]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([lang] * len(docs), pa.string()),
                    pa.array(list(docs), pa.binary()),
                    pa.array(np.fromiter(docs.values(), np.int64, len(docs))),
                    pa.ListArray.from_arrays(ends, pa.array(names, pa.string()).take(pa.array(source[order]))),
                    pa.ListArray.from_arrays(ends, pa.array(n)),
                ],
                ["lang", "term", "docs", "sources", "ns"],
            )


def term_counts(docs: DataFrame, min_docs: int, hold: int = 300_000) -> DataFrame:
    """(lang, source, term, n): the occurrences of each kept term in the groups that hold it. The term '' stands once in each group, so that
    groups without terms are there too. One shuffle, by language and term, of a row for each task and term."""

    def count(batches):
        held = Held()
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                for row in zip(*[c.to_pylist() for c in batch.slice(at, 256).columns]):
                    held.add(*row)
                if held.size() > hold:
                    yield from held.batches()
                    held = Held()
        yield from held.batches()

    own = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    texts = docs.select(own("lang").alias("lang"), own("source").alias("source"), own("text").cast("binary").alias("text"))
    rows = texts.mapInArrow(count, "lang string, term binary, docs long, sources array<string>, ns array<long>")
    rows = rows.withColumn("term", F.col("term").cast("string")).withColumn("all_docs", F.sum("docs").over(W.partitionBy("lang", "term")))
    rows = rows.where((F.col("all_docs") >= min_docs) | (F.col("term") == ""))
    each = rows.select("lang", "term", F.explode(F.arrays_zip(F.col("sources").alias("source"), F.col("ns").alias("n"))).alias("e")).select("lang", "term", "e.*")
    return each.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"))


def share(count: Column, total: Column, kept: Column) -> Column:
    """1 + floor(10^9 (count + 5) / (total + 5 kept)); 0 where no term is kept. Decimals hold what a long can't."""
    whole = lambda c: c.cast("decimal(28,0)")
    return F.when(kept > 0, 1 + F.call_function("div", F.lit(10**9).cast("decimal(10,0)") * whole(count + 5), F.nullif(whole(total + 5 * kept), F.lit(0)))).otherwise(0)


def dense_sums(f: pd.DataFrame) -> pd.DataFrame:
    """Sums of |p - q| over a tile of heavy terms, for pairs of groups of two blocks."""
    p = np.repeat(f["p0"].to_numpy(np.int64)[:, None], int(f["width"].iloc[0]), axis=1)
    for row, at, of in zip(p, f["at"], f["p"]):
        if at is not None:
            row[np.asarray(at, np.int64)] = np.asarray(of, np.int64)
    return block_pairs(f, lambda g, others: np.abs(p[others] - p[g]).sum(axis=1))


def sparse_sums(f: pd.DataFrame) -> pd.DataFrame:
    """What light terms sum to as if no two groups shared one, for pairs of groups of two blocks."""
    p0, light = f["p0"].to_numpy(np.int64), int(f["n_light"].iloc[0])
    lists = [(np.asarray(p if p is not None else [], np.int64), np.asarray(m if m is not None else [], np.int64)) for p, m in zip(f["p"], f["m"])]

    def own(g: int, at: np.ndarray) -> np.ndarray:
        p, m = lists[g]
        return ((np.abs(p[:, None] - at[None, :]) - np.abs(p0[g] - at)[None, :]) * m[:, None]).sum(axis=0)

    def sums(g: int, others: np.ndarray) -> np.ndarray:
        return light * np.abs(p0[others] - p0[g]) + own(g, p0[others]) + np.array([own(h, p0[g : g + 1])[0] for h in others], np.int64)

    return block_pairs(f, sums)


def block_pairs(f: pd.DataFrame, sums) -> pd.DataFrame:
    """sums(g, others) for each pair of groups, one of block a and one of block b; inside one block each pair once."""
    a, b = int(f["a"].iloc[0]), int(f["b"].iloc[0])
    block, names = f["block"].to_numpy(), f["source"].to_numpy(object)
    one, two, values = [], [], []
    for g in np.flatnonzero(block == a):
        others = np.flatnonzero(block == b)
        others = others[others > g] if a == b else others
        one.append(np.full(len(others), g))
        two.append(others)
        values.append(sums(g, others) if len(others) else np.zeros(0, np.int64))
    if not sum(map(len, values)):
        return pd.DataFrame()
    return pair_rows(f["lang"].iloc[0], names[np.concatenate(one)], names[np.concatenate(two)], np.concatenate(values))


def pair_rows(lang, source: np.ndarray, other: np.ndarray, value: np.ndarray) -> pd.DataFrame:
    text = lambda x: pd.Series(x, dtype=object)
    return pd.DataFrame({"lang": text(np.broadcast_to(np.asarray(lang, object), len(value))), "source": text(source), "other": text(other), "value": value})


def shared_sums(frames):
    """Corrections for light terms that two groups share: pairs inside each posting list, summed by pair of groups and batch."""
    for f in frames:
        lengths = f["sources"].map(len).to_numpy()
        if not lengths.sum():
            continue
        term = np.repeat(np.arange(len(f)), lengths)
        lang = np.repeat(f["lang"].to_numpy(object), lengths)
        source = np.concatenate(f["sources"].to_list())
        p, p0 = (np.concatenate(f[c].to_list()).astype(np.int64) for c in ("ps", "p0s"))
        for step in range(1, int(lengths.max())):
            i = np.flatnonzero(term[:-step] == term[step:])
            j = i + step
            value = np.abs(p[i] - p[j]) - np.abs(p[i] - p0[j]) - np.abs(p0[i] - p[j]) + np.abs(p0[i] - p0[j])
            yield pair_rows(lang[i], source[i], source[j], value).groupby(["lang", "source", "other"], as_index=False).sum()


def in_blocks(groups: DataFrame) -> DataFrame:
    """Each group once for every block that its own meets: (a, b) with a <= b."""
    out = groups.withColumn("_o", F.explode(F.expr("sequence(0L, n_blocks - 1)")))
    return out.withColumns({"a": F.least("block", "_o"), "b": F.greatest("block", "_o")}).drop("_o")


def divergence(
    docs: DataFrame, min_docs: int = 30, top: int = 50, light: int = 8, tile_terms: int = 4096, block_groups: int = 64, salts: int = 32
) -> DataFrame:
    """(lang, source, part, item, value, rank): part `pair`, every other source of the language and the sum of differences to it, largest
    first; part `term`, the ``top`` terms that the source gives more weight than its language, and by how much."""
    by_term = W.partitionBy("lang", "term")
    counts = term_counts(docs, min_docs).withColumns(
        {"lang_n": F.sum("n").over(by_term), "heavy": F.count("*").over(by_term) > light, "first": F.min("source").over(by_term) == F.col("source")}
    )
    counts = materialize(counts)
    held = counts.where("term <> ''")

    kept = held.groupBy("lang").agg(F.sum("n").alias("lang_total"), F.count_if("first").alias("v"), F.count_if(F.col("first") & F.col("heavy")).alias("n_heavy"))
    totals = held.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    groups = counts.where("term = ''").select("lang", "source")
    langs = groups.groupBy("lang").agg(F.count("*").alias("n_sources")).join(kept, "lang", "left").na.fill(0)
    langs = langs.withColumns({"n_light": F.col("v") - F.col("n_heavy"), "n_blocks": F.ceil(F.col("n_sources") / block_groups), "n_tiles": F.ceil(F.col("n_heavy") / tile_terms)})
    groups = groups.join(totals, ["lang", "source"], "left").na.fill(0, ["total"]).join(langs, "lang")
    groups = materialize(groups.withColumns({"p0": share(F.lit(0), F.col("total"), F.col("v")), "block": F.expr("pmod(xxhash64(source), n_blocks)")}))

    # A source may hold a third of the rows, so its row is copied and the rows that look for it are salted.
    known = groups.select("lang", "source", "total", "lang_total", "v", "p0", "n_tiles", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("salt"))
    rows = held.withColumn("salt", F.pmod(F.xxhash64("term"), F.lit(salts)).cast("int")).join(known, ["lang", "source", "salt"])
    rows = rows.withColumns({"p": share(F.col("n"), F.col("total"), F.col("v")), "q": share(F.col("lang_n"), F.col("lang_total"), F.col("v"))})

    heavy = rows.where("heavy").withColumn("tile", F.expr("pmod(xxhash64(term), n_tiles)"))
    heavy = heavy.withColumn("at", F.dense_rank().over(W.partitionBy("lang", "tile").orderBy("term")) - 1)
    heavy = heavy.groupBy("lang", "tile", "source").agg(F.collect_list(F.struct("at", "p")).alias("l"))
    widths = heavy.groupBy("lang", "tile").agg((F.max(F.array_max("l.at")) + 1).alias("width"))
    tiles = groups.withColumn("tile", F.explode(F.expr("IF(n_tiles > 0, sequence(0L, n_tiles - 1), array())"))).join(widths, ["lang", "tile"])
    tiles = tiles.join(heavy, ["lang", "tile", "source"], "left")
    dense = in_blocks(tiles.select("lang", "tile", "source", "block", "n_blocks", "width", "p0", F.col("l.at").alias("at"), F.col("l.p").alias("p")))
    dense = dense.groupBy("lang", "tile", "a", "b").applyInPandas(dense_sums, PAIR)

    sparse = rows.where("NOT heavy")
    lists = sparse.groupBy("lang", "source", "p").agg(F.count("*").alias("m")).groupBy("lang", "source").agg(F.collect_list(F.struct("p", "m")).alias("l"))
    lists = groups.join(lists, ["lang", "source"], "left").select("lang", "source", "block", "n_blocks", "n_light", "p0", F.col("l.p").alias("p"), F.col("l.m").alias("m"))
    alone = in_blocks(lists).groupBy("lang", "a", "b").applyInPandas(sparse_sums, PAIR)
    posts = sparse.groupBy("lang", "term").agg(F.collect_list(F.struct("source", "p", "p0")).alias("l")).where(F.size("l") > 1)
    shared = posts.select("lang", F.col("l.source").alias("sources"), F.col("l.p").alias("ps"), F.col("l.p0").alias("p0s")).mapInPandas(shared_sums, PAIR)

    sums = dense.union(alone).union(shared).groupBy("lang", F.least("source", "other").alias("s"), F.greatest("source", "other").alias("o")).agg(F.sum("value").alias("value"))
    ends = F.explode(F.array(F.struct(F.col("s").alias("source"), F.col("o").alias("item")), F.struct(F.col("o").alias("source"), F.col("s").alias("item"))))
    pairs = sums.select("lang", "value", ends.alias("e")).select("lang", "e.source", F.lit("pair").alias("part"), "e.item", "value")
    order = W.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    terms = rows.where("p > q").select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), (F.col("p") - F.col("q")).alias("value"))
    terms = terms.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    return pairs.withColumn("rank", F.row_number().over(order)).union(terms)
