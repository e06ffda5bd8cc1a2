"""Removal of word sequences that repeat across documents, by prefix-partitioned suffix trees.

A window is a run of ``window`` words of one document; each word in a window whose sequence also starts in a document with a smaller
id goes. The windows are the suffixes of a generalised suffix tree cut at that depth, and its internal nodes of full depth are the repeats.

Steps
-----
1. Filter. Each window has an anchor, its ``k``-word piece with the least hash; equal windows have equal anchors. Anchors that
   only one document has are dropped, with all their windows. This loses no repeat and leaves a small part of the suffixes. A batch
   of documents resolves the anchors it holds twice by itself and sends one row for each to the shuffle, so frequent ones don't pile up.
2. Partition. Suffixes meet by their anchor; neighbours with one anchor travel as one segment of text. Segments that stand twice in a
   batch are decided there, and only that of the smallest document travels. A group of more than ``group_rows`` segments doesn't
   fit in memory: its suffixes are sent on by a longer prefix, all their words, and are decided as a sorted stream.
3. Trees. Within a group the suffixes are sorted and the depths at which neighbours part are the tree's internal nodes; of each
   node of full depth, the suffixes of all but its smallest document are repeats.

Equality is decided on words, not on hashes.

Defined results
---------------
* Null, empty and blank texts have no words; texts shorter than the window lose nothing.
* Repeats within one document, or in rows that share an id, don't count. Null ids are larger than all others and equal to each other.
* Repeated rows with the same id get the same result. Very long texts are handled whole. Columns with clashing names are replaced.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

LAST_ID = (1 << 63) - 1
_hashes: dict[bytes, int] = {}


def word_hashes(words: list[bytes]) -> np.ndarray:
    """64-bit hashes of words; this worker's cache is bounded."""
    cache = _hashes
    if len(cache) > 1_000_000:
        cache.clear()
    try:
        return np.array([cache[w] for w in words], np.uint64)
    except KeyError:
        for w in words:
            if w not in cache:
                cache[w] = xxhash.xxh64_intdigest(w)
        return np.array([cache[w] for w in words], np.uint64)


def anchored(words: list[bytes], window: int, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, count, anchor) of each run of neighbouring windows that have the same anchor."""
    if len(words) < window:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64)
    h = word_hashes(words)
    n = len(h) - k + 1
    gram = h[:n].copy()
    for i in range(1, k):
        gram = gram * np.uint64(0x9E3779B97F4A7C15) + h[i : i + n]
    gram = (gram ^ (gram >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    gram ^= gram >> np.uint64(29)
    width = window - k + 1
    place = np.lib.stride_tricks.sliding_window_view(gram, width).argmin(axis=1) + np.arange(len(h) - window + 1)
    # The leftmost of equal least pieces: equal windows then have equal anchors, wherever they stand.
    new = np.flatnonzero(np.append(True, place[1:] != place[:-1]))
    return new, np.diff(np.append(new, len(place))), gram[place[new]]


def words_in(text: bytes | None) -> list[bytes]:
    return (text or b"").split()


def shared_anchors(docs: DataFrame, window: int, k: int) -> DataFrame:
    """(id, copy, anchor): the anchors of each document that another document has too."""

    def own(batches):
        for batch in batches:
            ids, copies = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            at, copy, found = [], [], []
            for j, text in enumerate(batch.column(2).cast(pa.binary()).to_pylist()):
                anchor = np.unique(anchored(words_in(text), window, k)[2])
                at.append(np.full(len(anchor), ids[j], np.int64))
                copy.append(np.full(len(anchor), copies[j], np.int64))
                found.append(anchor)
            doc, anchor = np.concatenate([np.zeros(0, np.int64), *at]), np.concatenate([np.zeros(0, np.uint64), *found])
            copy = np.concatenate([np.zeros(0, np.int64), *copy])
            order = np.lexsort((doc, anchor))
            doc, copy, anchor = doc[order], copy[order], anchor[order]
            new = np.append(True, anchor[1:] != anchor[:-1])[: len(anchor)]
            group = np.cumsum(new) - 1
            starts = np.flatnonzero(new)
            several = np.zeros(len(starts), bool)
            if len(starts):
                several = np.minimum.reduceat(doc, starts) != np.maximum.reduceat(doc, starts)
            # All but the first row of an anchor that the batch holds twice need no answer; the first one tells other batches.
            ask = new | ~several[group]
            key = np.where(ask, anchor, anchor * np.uint64(0x9E3779B97F4A7C15) + doc.astype(np.uint64) * np.uint64(0xBF58476D1CE4E5B9))
            # The key is the anchor of rows that ask; a zero there saves a third of the shuffle.
            told = np.where(ask, np.uint64(0), anchor).view(np.int64)
            columns = [key.view(np.int64), doc, copy, told, ask, several[group]]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["key", "id", "copy", "anchor", "ask", "several"])

    rows = docs.select("id", "copy", "text").mapInArrow(own, "key long, id long, copy long, anchor long, ask boolean, several boolean")

    def answer(frames):
        """Rows come sorted by key. What is held of an unfinished key: its rows so far, or if it is shared, a mark that says so."""
        held = None
        for f in frames:
            f = f.assign(mark=False)
            f = f if held is None else pd.concat([held, f], ignore_index=True)
            if not len(f):
                continue
            key, doc = f["key"].to_numpy(), f["id"].to_numpy()
            starts = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
            yes = np.minimum.reduceat(doc, starts) != np.maximum.reduceat(doc, starts)
            yes |= np.logical_or.reduceat(f["several"].to_numpy(bool), starts)
            shared = np.repeat(yes, np.diff(np.append(starts, len(f))))
            held = f.iloc[[-1]].assign(several=True, mark=True) if yes[-1] else f.iloc[starts[-1] :]
            yield f.loc[shared & ~f["mark"].to_numpy(bool), ["id", "copy", "key", "anchor", "ask"]]

    rows = rows.repartition("key").sortWithinPartitions("key").mapInPandas(answer, "id long, copy long, key long, anchor long, ask boolean")
    return rows.select("id", "copy", F.when(F.col("ask"), F.col("key")).otherwise(F.col("anchor")).alias("anchor"))


PIECES = "key long, id long, copy long, start long, count long, text binary"


def segments(docs: DataFrame, anchors: DataFrame, window: int, k: int) -> DataFrame:
    """The segments that may repeat, keyed by anchor, and marks (no text) for windows that a smaller document of the batch has.

    key is what rows meet by. copy, a hash of the text, tells rows that share an id apart; it is 0 where none do.
    """
    lists = anchors.groupBy(F.col("id").alias("a_id"), F.col("copy").alias("a_copy")).agg(F.collect_set("anchor").alias("anchors"))
    # All columns of docs go along: the last step joins the same shuffled rows again, which Spark then doesn't shuffle twice.
    rows = docs.join(lists, (docs["id"] == lists["a_id"]) & (docs["copy"] == lists["a_copy"])).drop("a_id", "a_copy")

    def cut(batches):
        for batch in batches:
            ids, copies = (batch.column(c).to_numpy() for c in ("id", "copy"))
            offsets = batch.column("anchors").offsets.to_numpy()
            flat = batch.column("anchors").values.to_numpy(zero_copy_only=False).view(np.uint64)
            least: dict[tuple, int] = {}
            found = []
            for j, text in enumerate(batch.column("text").cast(pa.binary()).to_pylist()):
                words = words_in(text)
                start, count, anchor = anchored(words, window, k)
                keep = np.isin(anchor, flat[offsets[j] : offsets[j + 1]])
                for s, n, a in zip(start[keep].tolist(), count[keep].tolist(), anchor[keep].view(np.int64).tolist()):
                    body = b" ".join(words[s : s + n + window - 1])
                    found.append((a, j, s, n, body))
                    if ids[j] < least.get((a, body), LAST_ID + 1):
                        least[a, body] = ids[j]
            out = []
            for a, j, s, n, body in found:
                if ids[j] > least[a, body]:
                    out.append((int(ids[j]) * 31 + s, ids[j], copies[j], s, n, None))
                else:
                    out.append((a, ids[j], copies[j], s, n, body))
            yield pieces_batch(out)

    return rows.mapInArrow(cut, PIECES)


def pieces_batch(rows: list[tuple]) -> pa.RecordBatch:
    key, doc, copy, start, count, text = zip(*rows) if rows else ([],) * 6
    wrapped = np.array([k & 0xFFFFFFFFFFFFFFFF for k in key], np.uint64).view(np.int64)
    columns = [pa.array(wrapped), *(pa.array(np.array(c, np.int64)) for c in (doc, copy, start, count)), pa.array(text, pa.binary())]
    return pa.RecordBatch.from_arrays(columns, names=["key", "id", "copy", "start", "count", "text"])


class SuffixTrees:
    """The suffixes of many groups of segments, sorted; group is the first place of a suffix, then come its first window words."""

    def __init__(self, group: np.ndarray, texts: list[bytes], window: int):
        number: dict[bytes, int] = {}
        words = [[number.setdefault(w, len(number)) for w in t.split(b" ")] for t in texts]
        lengths = np.array([len(w) for w in words], np.int64)
        flat = np.fromiter((x for w in words for x in w), np.int64, int(lengths.sum()))
        counts = lengths - window + 1
        self.segment = np.repeat(np.arange(len(texts)), counts)
        self.offset = np.arange(len(self.segment)) - np.repeat(np.cumsum(counts) - counts, counts)
        begin = (np.cumsum(lengths) - lengths)[self.segment] + self.offset
        rows = np.empty((len(begin), window + 1), ">u4")
        rows[:, 0] = group[self.segment]
        for i in range(window):
            rows[:, i + 1] = flat[begin + i]
        keys = rows.view(f"S{4 * (window + 1)}").ravel()
        self.order = np.argsort(keys, kind="stable")
        ordered = rows[self.order]
        # How many places each suffix shares with the one before it; equal ones share all.
        differ = ordered[1:] != ordered[:-1]
        self.shared = np.append(0, np.where(differ.any(axis=1), differ.argmax(axis=1), window + 1)) if len(ordered) else np.zeros(0, np.int64)
        self.depth = window + 1

    def repeats(self, doc: np.ndarray) -> np.ndarray:
        """Whether each suffix, in the segments' order, stands below a node of full depth that a smaller document reaches too."""
        out = np.zeros(len(self.order), bool)
        if len(self.order):
            starts = np.flatnonzero(self.shared < self.depth)
            own = doc[self.segment[self.order]]
            least = np.repeat(np.minimum.reduceat(own, starts), np.diff(np.append(starts, len(own))))
            out[self.order] = own > least
        return out


def runs(flag: np.ndarray, segment: np.ndarray, offset: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(segment, offset, length) of each run of flagged neighbours in one segment."""
    at = np.flatnonzero(flag)
    if not len(at):
        return at, at, at
    new = np.append(True, (np.diff(at) != 1) | (np.diff(segment[at]) != 0))
    first = at[new]
    return segment[first], offset[first], np.diff(np.append(np.flatnonzero(new), len(at)))


def grow_trees(pieces: DataFrame, window: int, group_rows: int, batch_rows: int) -> DataFrame:
    """Marks from each group's suffix tree. Of groups with too many segments: their suffixes, keyed by all their words."""

    def tree(f: pd.DataFrame) -> pd.DataFrame:
        _, group = np.unique(f["key"].to_numpy(), return_inverse=True)
        grown = SuffixTrees(group, list(f["text"]), window)
        seg, off, n = runs(grown.repeats(f["id"].to_numpy()), grown.segment, grown.offset)
        part = f.iloc[seg]
        return part.assign(start=part["start"].to_numpy() + off, count=n, text=None)

    def longer(f: pd.DataFrame) -> pd.DataFrame:
        out = []
        for doc, copy, start, count, text in zip(f["id"], f["copy"], f["start"], f["count"], f["text"]):
            words = text.split(b" ")
            for i in range(count):
                body = b" ".join(words[i : i + window])
                out.append((xxhash.xxh64_intdigest(body), doc, copy, start + i, 1, body))
        f = pd.DataFrame(out, columns=["key", "id", "copy", "start", "count", "text"])
        return f.assign(key=f["key"].to_numpy(np.uint64).view(np.int64))[["key", "id", "copy", "start", "count", "text"]]

    def run(frames):
        held, large = None, None  # rows of an unfinished key; a key that is known to be too large
        for f in frames:
            marks = f["text"].isna()
            if marks.any():
                yield f[marks]
                f = f[~marks]
            if large is not None:
                same = f["key"] == large
                yield longer(f[same])
                f = f[~same]
            f = f if held is None else pd.concat([held, f], ignore_index=True)
            if not len(f):
                held = None
                continue
            key = f["key"].to_numpy()
            starts = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
            held, done = f.iloc[starts[-1] :], f.iloc[: starts[-1]]
            if len(held) > group_rows:
                large = key[-1]
                yield longer(held)
                held = None
            sizes = np.diff(np.append(starts[:-1], len(done))) if len(starts) > 1 else np.zeros(0, int)
            big = np.repeat(sizes > group_rows, sizes)
            if big.any():
                yield longer(done[big])
                done = done[~big]
            at = 0
            while at < len(done):  # whole groups, about batch_rows at a time
                end = at + batch_rows
                if end < len(done):
                    ks = done["key"].to_numpy()
                    while end < len(done) and ks[end] == ks[end - 1]:
                        end += 1
                yield tree(done.iloc[at:end])
                at = end
        if held is not None and len(held):
            yield tree(held)

    return pieces.repartition("key").sortWithinPartitions("key").mapInPandas(run, PIECES)


def decide_longer(rows: DataFrame) -> DataFrame:
    """Marks for suffixes that came by all their words; sorted by key, words and id, the first of equal ones is the smallest."""

    def run(frames):
        last, least = None, None
        for f in frames:
            marks = f["text"].isna()
            yield f.loc[marks, ["id", "copy", "start", "count"]]
            f = f[~marks]
            if not len(f):
                continue
            texts = f["text"].to_numpy()
            new = np.append(texts[0] != last, texts[1:] != texts[:-1])
            group = np.cumsum(new)
            firsts = np.append([least if least is not None else 0], f["id"].to_numpy()[new])
            low = firsts[group]
            last, least = texts[-1], low[-1]
            yield f.loc[f["id"].to_numpy() > low, ["id", "copy", "start", "count"]]

    key = F.when(F.col("text").isNull(), F.xxhash64("id", "start")).otherwise(F.col("key"))
    rows = rows.withColumn("key", key).repartition("key").sortWithinPartitions("key", "text", "id")
    return rows.mapInPandas(run, "id long, copy long, start long, count long")


def substring_dedup(
    df: DataFrame,
    text: str = "text",
    id_col: str = "doc_id",
    window: int = 13,
    k: int = 5,
    group_rows: int = 50_000,
    batch_rows: int = 20_000,
) -> DataFrame:
    """df with n_words, n_removed, removed (ranges of words as structs of start and end) and kept_text.

    kept_text has the words that stay, joined by one space. Columns of these names that df has already are replaced.
    """
    df = df.drop(*({"n_words", "n_removed", "removed", "kept_text"} - {text, id_col}))
    body = F.col(text).cast("string")
    own = F.struct(*[F.col(c) for c in df.columns if c != text])
    ids = F.col(id_col).cast("long")
    # Rows are told apart by id where every id stands once; a zero for all of them takes no room in shuffles.
    unique = df.where(ids.isNotNull()).groupBy(ids).count().where("count > 1").isEmpty()
    copy = F.when(ids.isNull(), F.xxhash64(body)).otherwise(F.lit(0).cast("long")) if unique else F.xxhash64(body)
    docs = df.select(F.coalesce(ids, F.lit(LAST_ID)).alias("id"), copy.alias("copy"), body.alias("text"), own.alias("own"))
    pieces = segments(docs, shared_anchors(docs, window, k), window, k)
    marks = decide_longer(grow_trees(pieces, window, group_rows, batch_rows))
    marks = marks.groupBy(F.col("id").alias("m_id"), F.col("copy").alias("m_copy")).agg(F.collect_set(F.struct("start", "count")).alias("marks"))
    joined = docs.join(marks, (docs["id"] == marks["m_id"]) & (docs["copy"] == marks["m_copy"]), "left").drop("m_id", "m_copy")
    span = T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))
    added = [("n_words", T.LongType()), ("n_removed", T.LongType()), ("removed", span), ("kept_text", T.StringType())]

    def run(batches):
        for batch in batches:
            total, gone, spans, kept = [], [], [], []
            for body, own in zip(batch.column("text").cast(pa.binary()).to_pylist(), batch.column("marks").to_pylist()):
                words = words_in(body)
                cover = np.zeros(len(words) + 1, np.int64)
                for m in own or ():
                    cover[m["start"]] += 1
                    cover[m["start"] + m["count"] + window - 1] -= 1
                out = np.cumsum(cover[:-1]) > 0
                edge = np.flatnonzero(np.diff(np.concatenate([[0], out.view(np.int8), [0]])))
                total.append(len(words))
                gone.append(int(out.sum()))
                spans.append([{"start": int(a), "end": int(b)} for a, b in zip(edge[::2], edge[1::2])])
                kept.append(b" ".join([w for w, o in zip(words, out.tolist()) if not o] if own else words))
            new = [pa.array(total, pa.int64()), pa.array(gone, pa.int64()), pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))), pa.array(kept, pa.binary()).cast(pa.string())]
            yield pa.RecordBatch.from_arrays([batch.column("own"), batch.column("text"), *new], names=["own", "text", *(n for n, _ in added)])

    schema = T.StructType([docs.schema["own"], docs.schema["text"], *(T.StructField(n, t) for n, t in added)])
    columns = [F.col("text").alias(text) if c == text else F.col("own")[c].alias(c) for c in df.columns]
    return joined.mapInArrow(run, schema).select(*columns, *(n for n, _ in added))
