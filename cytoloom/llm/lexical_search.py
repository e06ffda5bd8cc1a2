"""Ranked lexical search over a two-level quantised index, with exact scores.

A term's impact in a document is (10^9 tf) div (1000 tf + 12 m), with m = 75 + (25 n N) div L: at most 10^6, so 255 steps of 3922 hold it.
The index keeps each impact twice: rounded up to a whole step, as one byte, and exactly, as tf and m.

1. The texts are read once. Each task cuts its documents into shards of at most ``shard_docs`` documents or about ``shard_posts`` postings and
   inverts them; no document is shuffled. The shards are written to the shared folder.
2. N and L come from the shards' own counts; then the bytes are added and the index is written, one row for each shard.
3. Queries go in blocks of about ``block_items`` items. Per block one pass over the index counts the documents of its terms; a second one, over
   terms, places and bytes only, takes each query's k greatest lower bounds (a step less for each term). Their kth is the least score that counts.
4. A last pass sums the upper bounds and scores every document whose bound reaches that number exactly, in whole numbers, from its tf
   and m. The k best of each task meet in a window.

Bounds: a block's items, their terms' weights and one number per item reach the driver and go to all tasks; an item's length is not bounded, the
number of items in a block is. Nothing of the documents does. A task holds one shard and, per item of the block, one number for each document of it.

Defined results
---------------
* A null or empty text has no terms; such documents don't count for N and L and are never found, and such items find nothing.
* Documents of one id are separate. A document without an id is found like others, after those with an id of equal score. Items without an id
  take no part; of items with one id the least text is taken. Further columns are ignored. Empty tables give no rows.
* Scores are above 0; equal ones go by id. Texts are taken whole, however long; a shard ends after the document that fills it.
"""

from __future__ import annotations

import math
import uuid
from array import array
from collections import Counter

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import checkpoint_dir
from .terms import LETTERS_AND_DIGITS, terms_of

STEP = 3922  # 255 steps reach 10 ** 6
NO_ID = 2**63 - 1
SHARD = "ids binary, sizes binary, words binary, first binary, places binary, counts binary, docs long, length long"


def impacts(tf: np.ndarray, m: np.ndarray) -> np.ndarray:
    return (1_000_000_000 * tf) // (1000 * tf + 12 * m)


class Shard:
    """Documents in the order they came, and their postings by term: the postings of term t are first[t] to first[t + 1]."""

    def __init__(self, row):
        self.words = bytes(row["words"]).split(b"\n") if len(row["words"]) else []
        self.first = np.frombuffer(row["first"], np.int64)
        self.places = np.frombuffer(row["places"], np.int32)
        for name, column, kind in (("bounds", "bounds", np.uint8), ("counts", "counts", np.int32), ("ids", "ids", np.int64), ("sizes", "sizes", np.int64)):
            if column in row:
                setattr(self, name, np.frombuffer(row[column], kind))

    def known(self, terms: dict) -> list[tuple[int, bytes]]:
        return [(t, w) for t, w in enumerate(self.words) if w in terms]

    def of(self, t: int) -> slice:
        return slice(int(self.first[t]), int(self.first[t + 1]))


def inverted(texts: DataFrame, shard_docs: int, shard_posts: int) -> DataFrame:
    """One row for each shard of (doc_id, text)."""

    columns = [(c, pa.int64() if c in ("docs", "length") else pa.binary()) for c in (x.split()[0] for x in SHARD.split(", "))]

    def row(ids: list, sizes: list, lengths: list, posts: array, counts: array, of: dict) -> pa.RecordBatch:
        by_name = np.array(sorted(range(len(of)), key=list(of).__getitem__), np.int64)  # terms in order of their bytes
        place = np.empty(len(of), np.int64)
        place[by_name] = np.arange(len(of))
        term = place[np.array(posts, np.int64)]
        order = np.argsort(term, kind="stable")
        names = list(of)
        made = {
            "ids": np.array(ids, np.int64).tobytes(),
            "sizes": np.array(sizes, np.int64).tobytes(),
            "words": b"\n".join(names[k] for k in by_name),
            "first": np.concatenate([[0], np.cumsum(np.bincount(term, minlength=len(of)))]).astype(np.int64).tobytes(),
            "places": np.repeat(np.arange(len(ids), dtype=np.int32), lengths)[order].tobytes(),
            "counts": np.array(counts, np.int32)[order].tobytes(),
            "docs": len(ids),
            "length": sum(sizes),
        }
        return pa.RecordBatch.from_pylist([made], schema=pa.schema(columns))

    def empty() -> tuple:
        return [], [], [], array("i"), array("i"), {}

    def shards(batches):
        held = empty()
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                for doc_id, text in zip(*[c.to_pylist() for c in batch.slice(at, 256).columns]):
                    own = terms_of(text, LETTERS_AND_DIGITS)
                    if not own:
                        continue
                    ids, sizes, lengths, posts, counts, of = held
                    tf = Counter(own)
                    ids.append(doc_id)
                    sizes.append(len(own))
                    lengths.append(len(tf))
                    posts.extend([of.setdefault(w, len(of)) for w in tf])
                    counts.extend(tf.values())
                    if len(ids) >= shard_docs or len(posts) >= shard_posts:
                        yield row(*held)
                        held = empty()
        if held[0]:
            yield row(*held)

    rows = texts.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("doc_id"), F.col("text").cast("binary").alias("text"))
    return rows.mapInArrow(shards, SHARD)


def build_index(docs: DataFrame, folder: str, shard_docs: int = 4096, shard_posts: int = 1_000_000) -> tuple[str, int, int]:
    """Writes the index of (doc_id, text) under the folder; (its path, N, L)."""
    spark = docs.sparkSession
    inverted(docs, shard_docs, shard_posts).write.parquet(f"{folder}/exact")
    exact = spark.read.parquet(f"{folder}/exact")
    total = exact.agg(F.sum("docs").alias("docs"), F.sum("length").alias("length")).first()
    n, length = int(total["docs"] or 0), int(total["length"] or 0)

    def quantise(frames):
        for f in frames:
            bounds = []
            for row in f.to_dict("records"):
                s = Shard(row)
                m = 75 + (25 * s.sizes * n) // length
                bounds.append((-(-impacts(s.counts.astype(np.int64), m[s.places]) // STEP)).astype(np.uint8).tobytes())
            yield f.assign(bounds=bounds)

    exact.mapInPandas(quantise, f"{SHARD}, bounds binary").write.parquet(f"{folder}/index")
    return f"{folder}/index", n, length


class Queries:
    """A block of items: for each term of it, the items that hold it and how often."""

    def __init__(self, rows: list):
        self.ids = np.array([r["item_id"] for r in rows], np.int64)
        held: dict[bytes, list] = {}
        for k, r in enumerate(rows):
            for term, times in Counter(terms_of(bytes(r["text"] or b""), LETTERS_AND_DIGITS)).items():
                held.setdefault(term, []).append((k, times))
        self.of = {t: (np.array([k for k, _ in v]), np.array([n for _, n in v], np.int64)) for t, v in held.items()}

    def weigh(self, df: dict[bytes, int], n: int) -> None:
        """Times become times the term's weight; terms that no document holds go."""
        self.of = {t: (items, times * math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1)))) for t, (items, times) in self.of.items() if t in df}

    def sums(self, shard: Shard, docs: int, value) -> np.ndarray:
        """For each item and document the sum of weights times the value of a posting."""
        out = np.zeros((len(self.ids), docs), np.int64)
        for t, w in shard.known(self.of):
            items, weights = self.of[w]
            at = shard.of(t)
            out[np.ix_(items, shard.places[at])] += weights[:, None] * value(at)[None, :]
        return out


def document_counts(index: DataFrame, queries: Queries) -> dict[bytes, int]:
    """How many documents hold each term of the block."""

    def count(frames):
        df: Counter = Counter()
        for f in frames:
            for row in f.to_dict("records"):
                s = Shard(row)
                df.update({w: int(s.first[t + 1] - s.first[t]) for t, w in s.known(queries.of)})
        if df:
            yield pd.DataFrame({"term": list(df), "df": np.array(list(df.values()), np.int64)})

    rows = index.select("words", "first", "places").mapInPandas(count, "term binary, df long").groupBy("term").agg(F.sum("df").alias("df"))
    return {bytes(r["term"]): r["df"] for r in rows.collect()}


def least_scores(index: DataFrame, queries: Queries, k: int) -> np.ndarray:
    """For each item the kth greatest lower bound over all documents; 1 if fewer are above 0."""

    def bound(frames):
        best = np.zeros((len(queries.ids), k), np.int64)
        for f in frames:
            for row in f.to_dict("records"):
                s = Shard(row)
                low = queries.sums(s, int(row["docs"]), lambda at: np.maximum(s.bounds[at].astype(np.int64) - 1, 0) * STEP)
                if low.shape[1] > k:
                    low = np.partition(low, low.shape[1] - k, axis=1)[:, -k:]
                best = np.sort(np.concatenate([best, low], axis=1), axis=1)[:, -k:]
        item, at = np.nonzero(best)
        yield pd.DataFrame({"item": item.astype(np.int32), "low": best[item, at]})

    rows = index.select("words", "first", "places", "bounds", "docs").mapInPandas(bound, "item int, low long")
    rank = F.row_number().over(W.partitionBy("item").orderBy(F.desc("low")))
    least = np.ones(len(queries.ids), np.int64)
    for r in rows.withColumn("rank", rank).where(F.col("rank") == k).collect():
        least[r["item"]] = max(1, r["low"])
    return least


def best_documents(index: DataFrame, queries: Queries, least: np.ndarray, k: int, n: int, length: int) -> DataFrame:
    """(item_id, rank, doc_id, score): exact scores of the documents whose upper bound reaches the least score that counts."""

    def exact(s: Shard, item: np.ndarray, doc: np.ndarray) -> np.ndarray:
        """The scores of the given pairs, which come by item."""
        m = 75 + (25 * s.sizes * n) // length
        score = np.zeros(len(item), np.int64)
        start = np.searchsorted(item, np.arange(len(queries.ids) + 1))
        for t, w in s.known(queries.of):
            at = s.of(t)
            places = s.places[at]
            for i, weight in zip(*queries.of[w]):
                own = slice(start[i], start[i + 1])
                if own.start < own.stop:
                    found = np.minimum(np.searchsorted(places, doc[own]), len(places) - 1)
                    hit = places[found] == doc[own]
                    score[own] += np.where(hit, weight * impacts(s.counts[at][found].astype(np.int64), m[doc[own]]), 0)
        return score

    def search(frames):
        best = pd.DataFrame({"item": np.zeros(0, np.int32), "doc_id": np.zeros(0, np.int64), "score": np.zeros(0, np.int64)})
        for f in frames:
            for row in f.to_dict("records"):
                s = Shard(row)
                high = queries.sums(s, len(s.ids), lambda at: s.bounds[at].astype(np.int64) * STEP)
                item, doc = np.nonzero(high >= least[:, None])
                if not len(item):
                    continue
                new = pd.DataFrame({"item": item.astype(np.int32), "doc_id": s.ids[doc], "score": exact(s, item, doc)})
                best = pd.concat([best, new[new["score"] > 0]]).sort_values(["item", "score", "doc_id"], ascending=[True, False, True])
                best = best.groupby("item").head(k)
        yield pd.DataFrame({"item_id": queries.ids[best["item"]], "doc_id": best["doc_id"], "score": best["score"]})

    found = index.select("words", "first", "places", "bounds", "ids", "sizes", "counts").mapInPandas(search, "item_id long, doc_id long, score long")
    rank = F.row_number().over(W.partitionBy("item_id").orderBy(F.desc("score"), "doc_id"))
    found = found.withColumn("rank", rank).where(F.col("rank") <= k)
    return found.select("item_id", "rank", F.nullif("doc_id", F.lit(NO_ID)).alias("doc_id"), "score")


def search(docs: DataFrame, items: DataFrame, k: int = 20, block_items: int = 512, shard_docs: int = 4096, shard_posts: int = 1_000_000) -> DataFrame:
    """(item_id, rank, doc_id, score): the k documents of (doc_id, text) that score highest for each of (item_id, text)."""
    spark = docs.sparkSession
    folder = f"{checkpoint_dir(spark).rstrip('/')}/lexical-{uuid.uuid4().hex}"
    path, n, length = build_index(docs, folder, shard_docs, shard_posts)
    index = spark.read.parquet(path)
    asked = items.where(F.col("item_id").isNotNull()).groupBy(F.col("item_id").cast("long").alias("item_id")).agg(F.min("text").cast("binary").alias("text"))
    blocks = max(1, -(-asked.count() // block_items))
    out = spark.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    for block in range(blocks if n else 0):
        queries = Queries(asked.where(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == block).collect())
        queries.weigh(document_counts(index, queries), n)
        out = out.union(best_documents(index, queries, least_scores(index, queries, k), k, n, length))
    return out
