"""SimHash near-duplicate detection with bit-sliced comparison.

A fingerprint has a bit where over half of the hashes of a text's word shingles have it. Texts link if their fingerprints differ
in at most ``radius`` bits, and groups are the connected components of the links.

Candidates are exact: the 64 bits are cut into radius + 2 blocks, of which two at least must agree, so each fingerprint goes into
one bucket for each pair of blocks. Inside a bucket fingerprints are stored as vertical bit planes, 64 of them to a machine word.
One fingerprint is compared with a word of 64 at once: each plane gives the word of differing bits, carry-save adders count them in
bit-sliced counters, and words whose lanes all exceed the radius are abandoned.

For near copies by a similarity of word shingles (``near_components``), each distinct text is a node. Buckets are bands of ``rows``
least hashes of its shingles under as many permutations; a pair of similarity s shares a band with probability s ** rows, so at the
defaults one of 0.8 meets in some of the ``bands`` with probability 0.9999 (bands of 16 fingerprint bits would take over 100 for that).
A fingerprint of ``blocks`` times 64 bits, made from the distinct shingles, only filters: a pair differs in each bit with probability
acos(2 s / (1 + s)) / pi, and pairs beyond the expected number of bits plus five standard deviations go. What is left is decided
exactly, by the Jaccard similarity of the sets of shingle hashes. In buckets of up to ``SMALL`` nodes all pairs are decided; in larger
ones first a spanning forest, then all pairs that verified links don't connect yet, inside the task that holds the two chunks of the bucket with
their sets of hashes: a group of many texts just below the similarity costs its nodes once a bucket and pair of chunks, never a row a pair.

Scale: only distinct fingerprints go on. A bucket of more than ``chunk`` fingerprints is cut into chunks, and each pair of chunks
is a group of its own; a group gives a spanning forest of its links, never all pairs.

Defined results
---------------
* Null, empty and blank texts have no words and fingerprint zero; they link like any other.
* Texts with fewer words than the shingle width have one shingle, the whole sequence.
* Repeated rows each get a row with the same component. Rows with a null id take part in links; a component of such rows only
  has a null id.
* For near copies null, empty and blank texts are equal to each other and to nothing else.
* An empty table gives an empty result. Texts are taken whole, however long. Further columns come back as they were from drop_near_duplicates();
  the others return columns of their own only.
"""

from __future__ import annotations

import math
from itertools import accumulate, combinations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE_CHARS, free_name, materialize, set_aside
from .components import connected_components

BITS = 64
#: Buckets of near copies up to this size are decided pair by pair.
SMALL = 32


def shingle_hashes(text: bytes | None, width: int = 4, seed: int = 42) -> np.ndarray:
    """XXH64 of each run of width words, A-Z in lower case, joined by a space; repeats included."""
    words = (text or b"").lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    joined = b" ".join(words)
    ends = [e - 1 for e in accumulate(len(w) + 1 for w in words)]
    starts = [0, *(e + 1 for e in ends[:-1])]
    digest = xxhash.xxh64_intdigest
    last = ends[min(width, len(words)) - 1 :]
    return np.array([digest(joined[s:e], seed) for s, e in zip(starts, last)], np.uint64)


def fingerprint(hashes: np.ndarray, blocks: int = 1) -> np.ndarray:
    """The bits that are set in over half of the hashes; further blocks come from the same hashes, mixed."""
    counts = np.zeros((blocks, BITS), np.int64)
    salt = np.arange(blocks, dtype=np.uint64)[:, None] * np.uint64(0x9E3779B97F4A7C15)
    for start in range(0, len(hashes), 2048):
        part = hashes[start : start + 2048][None, :]
        if blocks > 1:
            part = (part ^ salt) * np.uint64(0xBF58476D1CE4E5B9)
            part = (part ^ (part >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
            part ^= part >> np.uint64(32)
        bits = np.unpackbits(np.ascontiguousarray(part).view(np.uint8).reshape(blocks, -1, 8), axis=2, bitorder="little")
        counts += bits.sum(axis=1, dtype=np.uint32)
    return np.packbits(2 * counts > len(hashes), axis=1, bitorder="little").view(np.uint64).ravel()


def with_fingerprints(df: DataFrame, text: str = "text", id_col: str = "doc_id", width: int = 4, blocks: int = 1) -> DataFrame:
    """(doc_id, fp): the fingerprint of each row as an array of signed longs; several blocks are of the distinct shingles."""

    def one(text):
        hashes = shingle_hashes(text, width)
        return fingerprint(np.unique(hashes) if blocks > 1 else hashes, blocks)

    def run(batches):
        for batch in batches:
            fps = [one(t) for t in batch.column(1).cast(pa.binary()).to_pylist()]
            flat = np.concatenate([np.zeros(0, np.uint64), *fps]).view(np.int64)
            ends = pa.array(np.arange(len(fps) + 1, dtype=np.int32) * blocks)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(ends, pa.array(flat))], names=["doc_id", "fp"])

    rows = df.select(F.col(id_col).try_cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, fp array<long>")


def pair_keys(radius: int) -> list[Column]:
    """A fingerprint of one block under the masks of all pairs of radius + 2 pieces: two within the radius agree under one at least."""
    return [F.get("fp", F.lit(0)).bitwiseAND(F.lit(m)) for m in masks(radius)]


def min_bands(hashes: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """One number for each band of rows least values, over the hashes under bands * rows permutations of their low halves."""
    rng = np.random.default_rng(7)
    salt, odd = (rng.integers(0, 1 << 32, (bands * rows, 1), dtype=np.uint32) for _ in range(2))
    least = np.full((bands * rows, 1), 0xFFFFFFFF, np.uint32)
    low = hashes.astype(np.uint32)[None, :]
    for start in range(0, len(hashes), 2048):
        part = (low[:, start : start + 2048] ^ salt) * (odd | np.uint32(1))
        np.minimum(least, part.min(axis=1, keepdims=True), out=least)
    return np.array([xxhash.xxh64_intdigest(x.tobytes(), k) for k, x in enumerate(least.reshape(bands, rows))], np.uint64)


def masks(radius: int) -> list[int]:
    """The masks of all pairs of pieces, as signed longs."""
    blocks = radius + 2
    edges = [round(BITS * k / blocks) for k in range(blocks + 1)]
    block = [(1 << edges[k + 1]) - (1 << edges[k]) for k in range(blocks)]
    return [m - (1 << BITS) if m >> (BITS - 1) else m for m in (a | b for a, b in combinations(block, 2))]


class BitPlanes:
    """Fingerprints (rows of blocks) of many buckets as vertical bit planes; a bucket starts a new word of 64 lanes."""

    def __init__(self, fps: np.ndarray, starts: np.ndarray, sizes: np.ndarray):
        self.words = (sizes + 63) // 64
        first = np.concatenate([[0], np.cumsum(self.words)[:-1]])
        group = np.repeat(np.arange(len(sizes)), sizes)
        place = np.arange(len(fps)) - starts[group]
        self.word_of, self.lane_of = first[group] + place // 64, place % 64
        n = int(self.words.sum())
        lanes, used = np.zeros((fps.shape[1], n, 64), np.uint64), np.zeros((n, 64), np.uint64)
        lanes[:, self.word_of, self.lane_of] = fps.T
        used[self.word_of, self.lane_of] = 1
        shift = np.arange(64, dtype=np.uint64)
        one = np.uint64(1)
        self.planes = [np.bitwise_or.reduce(((block >> b) & one) << shift, axis=1) for block in lanes for b in shift]
        self.used = np.bitwise_or.reduce(used << shift, axis=1)
        self.member = np.full((n, 64), -1, np.int64)
        self.member[self.word_of, self.lane_of] = np.arange(len(fps))
        self.first, self.group = first, group

    def tiles(self) -> tuple[np.ndarray, np.ndarray]:
        """Each fingerprint against each word of its bucket."""
        times = self.words[self.group]
        query = np.repeat(np.arange(len(self.group)), times)
        step = np.arange(len(query)) - np.repeat(np.cumsum(times) - times, times)
        return query, self.first[self.group[query]] + step


def within(planes: list[np.ndarray], used: np.ndarray, query: np.ndarray, word: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """(tile, lanes): for each tile that has any, the lanes whose fingerprint differs from the query's in at most radius bits."""
    tile, one = np.arange(len(query)), np.uint64(1)
    depth = max(1, radius.bit_length())
    counter = [np.zeros(len(query), np.uint64) for _ in range(depth)]
    over = ~used[word]

    def exceeded() -> np.ndarray:
        above, equal = over, ~over
        for k in reversed(range(depth)):
            if radius >> k & 1:
                equal = equal & counter[k]
            else:
                above, equal = above | (equal & counter[k]), equal & ~counter[k]
        return above

    for b in range(0, len(planes), 2):
        x, y = (planes[k][word] ^ (np.uint64(0) - ((query[:, k // BITS] >> np.uint64(k % BITS)) & one)) for k in (b, b + 1))
        half = counter[0] ^ x
        carry = (counter[0] & x) | (half & y)
        counter[0] = half ^ y
        for k in range(1, depth):
            counter[k], carry = counter[k] ^ carry, counter[k] & carry
        over = over | carry
        if b % 8 == 6:
            alive = exceeded() != np.uint64(0xFFFFFFFFFFFFFFFF)
            if np.count_nonzero(alive) < 0.7 * len(alive):
                tile, query, word, over = tile[alive], query[alive], word[alive], over[alive]
                counter = [c[alive] for c in counter]
                if not len(tile):
                    break
    hits = ~exceeded()
    some = hits != 0
    return tile[some], hits[some]


def forest(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest member that each of n members can reach over the links a-b."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, label[a], low)
        np.minimum.at(new, label[b], low)
        while True:
            jumped = new[new]
            if np.array_equal(jumped, new):
                break
            new = jumped
        if np.array_equal(new, label):
            return label
        label = new


class Buckets:
    """The fingerprints of buckets that hold more than one; places are where they stood. starts holds where buckets begin."""

    def __init__(self, fps: np.ndarray, starts: np.ndarray):
        sizes = np.diff(np.append(starts, len(fps)))
        keep = np.repeat(sizes > 1, sizes)
        self.places, self.fps, self.sizes = np.flatnonzero(keep), fps[keep], sizes[sizes > 1]

    def pairs(self, radius: int, tile_batch: int):
        """(a, b), by batches of comparisons: those within the radius, each once; so few are held at a time, however many there are."""
        if not len(self.fps):
            return
        sliced = BitPlanes(self.fps, np.cumsum(self.sizes) - self.sizes, self.sizes)
        query, word = sliced.tiles()
        for k in range(0, len(query), tile_batch):
            q, w = query[k : k + tile_batch], word[k : k + tile_batch]
            tile, hits = within(sliced.planes, sliced.used, self.fps[q], w, radius)
            lanes = np.unpackbits(hits.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            row, lane = np.nonzero(lanes)
            a, b = q[tile[row]], sliced.member[w[tile[row]], lane]
            yield a[a < b], b[a < b]


def bucket_links(fps: np.ndarray, starts: np.ndarray, radius: int, tile_batch: int = 1 << 14, small: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Links of a spanning forest inside each bucket, as places in fps. Buckets of up to small fingerprints give all their links.

    Pairs join the forest as they are found and are forgotten, so that a bucket of copies never holds all its pairs.
    """
    own = Buckets(fps, starts)
    root, whole = np.arange(len(own.fps)), np.repeat(own.sizes <= small, own.sizes)
    found = [(root[:0], root[:0])]
    for a, b in own.pairs(radius, tile_batch):
        few = whole[a]
        found.append((a[few], b[few]))
        a, b = root[a[~few]], root[b[~few]]
        apart = a != b
        if apart.any():
            root = forest(len(root), a[apart], b[apart])[root]
    a, b = (np.concatenate(x) for x in zip(*found))
    tied = np.flatnonzero(root != np.arange(len(root)))
    return own.places[np.append(tied, a)], own.places[np.append(root[tied], b)]


def links(nodes: DataFrame, keys: list[Column], radius: int, blocks: int = 1, chunk: int = 1024, batch_rows: int = 1 << 15, small: int = 0) -> DataFrame:
    """(u, v): links between nodes (node, fp) that share a key and differ in at most radius bits of the first blocks.

    The links connect all such pairs of a bucket; they are a spanning forest of them, not the pairs themselves. In buckets of up to
    small nodes they are all pairs.
    """
    bands = nodes.select("node", F.slice("fp", 1, blocks).alias("fp"), F.posexplode(F.array(*keys)).alias("band", "bits"))
    hot = bands.groupBy("band", "bits").agg(F.count("*").alias("n")).where(F.col("n") > chunk)
    hot = hot.select("band", "bits", F.ceil(F.col("n") / chunk).cast("int").alias("chunks"))
    rows = bands.join(hot, ["band", "bits"], "left")
    own = F.pmod(F.xxhash64("node"), F.col("chunks")).cast("int")
    other = F.explode(F.when(F.col("chunks").isNull(), F.array(F.lit(0))).otherwise(F.sequence(F.lit(0), F.col("chunks") - 1)))
    rows = rows.select("node", "fp", "band", "bits", F.coalesce(own, F.lit(0)).alias("own"), other.alias("other"))
    rows = rows.select("node", "fp", "band", "bits", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"))
    keys = ["band", "bits", "i", "j"]

    def run(frames):
        rest = None
        for frame in frames:
            frame = frame if rest is None else pd.concat([rest, frame], ignore_index=True)
            new = np.ones(len(frame), bool)
            if len(frame):
                k = frame[keys].to_numpy()
                new[1:] = (k[1:] != k[:-1]).any(axis=1)
            cut = int(np.flatnonzero(new)[-1]) if len(frame) else 0
            rest = frame.iloc[cut:]
            if cut:
                yield from done(frame.iloc[:cut], new[:cut])
        if rest is not None and len(rest):
            yield from done(rest, np.arange(len(rest)) == 0)

    def done(frame, new):
        nodes = frame["node"].to_numpy(np.int64)
        fps = np.concatenate(frame["fp"].to_numpy()).astype(np.int64).view(np.uint64).reshape(-1, blocks)
        starts = np.flatnonzero(new)
        at = 0
        while at < len(starts):  # whole buckets, about batch_rows at a time
            to = max(at + 1, int(np.searchsorted(starts, starts[at] + batch_rows)))
            end = starts[to] if to < len(starts) else len(fps)
            some = slice(starts[at], end)
            a, b = bucket_links(fps[some], starts[at:to] - starts[at], radius, small=small)
            u, v = nodes[some][a], nodes[some][b]
            yield pd.DataFrame({"u": np.maximum(u, v), "v": np.minimum(u, v)})
            at = to

    return rows.repartition(*keys).sortWithinPartitions(*keys).mapInPandas(run, "u long, v long").distinct()


def components_of(rows: DataFrame, keys: list[Column], radius: int, blocks: int = 1) -> DataFrame:
    """rows (doc_id, node, fp) with component_id, the smallest id that the row's node reaches over the links."""
    nodes = materialize(rows.groupBy("node").agg(F.first("fp").alias("fp"), F.min("doc_id").alias("least")))
    stars = connected_components(links(nodes, keys, radius, blocks)).withColumnRenamed("node", "s_node")
    nodes = nodes.join(stars, nodes["node"] == stars["s_node"], "left").select("node", "least", F.coalesce("root", "node").alias("root"))
    least = nodes.groupBy("root").agg(F.min("least").alias("component_id"))
    return rows.join(nodes.join(least, "root").select("node", "component_id"), "node", "left")


def simhash_components(df: DataFrame, text: str = "text", id_col: str = "doc_id", width: int = 4, radius: int = 4) -> DataFrame:
    """(doc_id, fp, component_id) for each row of df, by fingerprints of 64 bits; the radius may be up to 14."""
    rows = with_fingerprints(df, text, id_col, width).withColumn("node", F.get("fp", F.lit(0)))
    found = components_of(materialize(rows), pair_keys(radius), radius)
    return found.select("doc_id", F.col("node").alias("fp"), "component_id")


def once(texts: DataFrame) -> DataFrame:
    """texts (node, text) with each node once in a partition, so that many copies of one text don't meet in one task."""

    def run(batches):
        seen = set()
        for batch in batches:
            fresh = []
            for node in batch.column(0).to_pylist():
                fresh.append(node not in seen)
                seen.add(node)
            yield batch.filter(pa.array(fresh, pa.bool_()))

    return texts.mapInArrow(run, "node long, text string")


def sketches(texts: DataFrame, width: int, blocks: int, bands: int, rows: int) -> DataFrame:
    """(node, fp, bands): the fingerprint and the bands of each text's distinct shingles; repeated nodes of a partition come once."""

    def run(batches):
        seen = set()
        for batch in batches:
            nodes, fps, keys = [], [np.zeros(0, np.uint64)], [np.zeros(0, np.uint64)]
            for node, text in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()).to_pylist()):
                if node not in seen:
                    seen.add(node)
                    hashes = np.unique(shingle_hashes(text, width))
                    nodes.append(node)
                    fps.append(fingerprint(hashes, blocks))
                    keys.append(min_bands(hashes, bands, rows))
            lists = [
                pa.ListArray.from_arrays(pa.array(np.arange(len(nodes) + 1, dtype=np.int32) * n), pa.array(np.concatenate(x).view(np.int64)))
                for x, n in ((fps, blocks), (keys, bands))
            ]
            yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), *lists], names=["node", "fp", "bands"])

    return texts.mapInArrow(run, "node long, fp array<long>, bands array<long>")


def hashed_sets(texts: DataFrame, ends: DataFrame, width: int) -> DataFrame:
    """(node, hashes): the sets of shingle hashes, in order, of the texts of the given nodes."""

    def sets(batches):
        for batch in batches:
            found = [np.unique(shingle_hashes(t, width)).view(np.int64) for t in batch.column(1).cast(pa.binary()).to_pylist()]
            ends = pa.array(np.cumsum([0, *map(len, found)]).astype(np.int32))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(ends, pa.array(np.concatenate([np.zeros(0, np.int64), *found])))], names=["node", "hashes"])

    found = once(texts).join(ends.select("node").distinct(), "node", "left_semi").dropDuplicates(["node"]).mapInArrow(sets, "node long, hashes array<long>")
    return materialize(found)


def verified(pairs: DataFrame, texts: DataFrame, width: int, similarity: float) -> DataFrame:
    """The pairs (u, v) of nodes whose sets of shingle hashes have the similarity at least; decided exactly."""

    def decide(batches):
        for batch in batches:
            alike = []
            sides = []
            for name in ("a", "b"):
                column = batch.column(name)
                sides.append((column.offsets.to_numpy(), column.values.to_numpy()))
            (ea, a), (eb, b) = sides
            for k in range(batch.num_rows):
                x, y = a[ea[k] : ea[k + 1]], b[eb[k] : eb[k + 1]]
                both = len(np.intersect1d(x, y, assume_unique=True)) if min(len(x), len(y)) >= similarity * max(len(x), len(y)) - 1 else 0
                alike.append(both / max(1, len(x) + len(y) - both) >= similarity)
            yield batch.select(["u", "v"]).filter(pa.array(alike, pa.bool_()))

    hashed = hashed_sets(texts, pairs.select(F.explode(F.array("u", "v")).alias("node")), width)
    rows = pairs.join(hashed.select(F.col("node").alias("u"), F.col("hashes").alias("a")), "u")
    rows = rows.join(hashed.select(F.col("node").alias("v"), F.col("hashes").alias("b")), "v")
    return materialize(rows.select("u", "v", "a", "b").mapInArrow(decide, "u long, v long"))


def overlaps(sets: list[np.ndarray], a: np.ndarray, b: np.ndarray, slice_bits: int = 8192, batch: int = 1 << 14) -> np.ndarray:
    """How many hashes the sets a[k] and b[k] share: bits of each set for every hash that two sets hold, and counts of bits in both."""
    member = np.repeat(np.arange(len(sets)), [len(x) for x in sets])
    _, place, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    repeated = times > 1
    place, member = (np.cumsum(repeated) - 1)[place[repeated[place]]], member[repeated[place]]
    order = np.argsort(place, kind="stable")
    place, member = place[order], member[order]
    both = np.zeros(len(a), np.int64)
    for first in range(0, int(repeated.sum()), slice_bits):
        some = slice(*np.searchsorted(place, [first, first + slice_bits]))
        held = np.zeros((len(sets), slice_bits), np.uint8)
        held[member[some], place[some] - first] = 1
        bits = np.packbits(held, axis=1).view(np.uint64)
        for k in range(0, len(a), batch):
            both[k : k + batch] += np.bitwise_count(bits[a[k : k + batch]] & bits[b[k : k + batch]]).sum(axis=1, dtype=np.int64)
    return both


def verified_blocks(
    parts: DataFrame, texts: DataFrame, radius: int, width: int, similarity: float, small: int, chunk: int = 1024, most: int = 1 << 21, tile_batch: int = 1 << 13
) -> DataFrame:
    """(u, v): links by similarity between nodes (node, fp, bands, part) of different parts that share a bucket of more than small nodes.

    A node's set of shingle hashes goes to each pair of chunks of its buckets once, not to each of its pairs; pairs are found and decided
    in the task, each in the first bucket it shares, and what leaves it is a spanning forest. A chunk holds about ``chunk`` nodes or ``most``
    hashes, whichever is reached first. Buckets of one part have nothing to decide.
    """

    def decide(f: pd.DataFrame) -> pd.DataFrame:
        f = f.sort_values("node", ignore_index=True)
        part, own = f["part"].to_numpy(np.int64), f["own"].to_numpy()
        crossing, band = f["i"].iloc[0] != f["j"].iloc[0], int(f["band"].iloc[0])
        bands = np.stack(f["bands"].to_numpy())
        fps = np.stack(f["fp"].to_numpy()).astype(np.int64).view(np.uint64)
        found = [(np.zeros(0, np.int64), np.zeros(0, np.int64))]
        for a, b in Buckets(fps, np.zeros(1, np.int64)).pairs(radius, tile_batch):
            apart = part[a] != part[b]
            if crossing:
                apart &= own[a] != own[b]
            a, b = a[apart], b[apart]
            first = (bands[a, : band + 1] == bands[b, : band + 1]).argmax(axis=1) == band
            found.append((a[first], b[first]))
        a, b = (np.concatenate(x) for x in zip(*found))
        if not len(a):
            return pd.DataFrame()
        sets = [np.asarray(x, np.int64) for x in f["hashes"]]
        size = np.array([len(x) for x in sets])
        both = overlaps(sets, a, b)
        alike = both / np.maximum(1, size[a] + size[b] - both) >= similarity
        root = forest(len(f), a[alike], b[alike])
        tied = np.flatnonzero(root != np.arange(len(f)))
        nodes = f["node"].to_numpy(np.int64)
        return pd.DataFrame({"u": nodes[tied], "v": nodes[root[tied]]})

    at = ["band", "bits"]
    rows = parts.select("node", "part", F.posexplode("bands").alias("band", "bits"))
    mixed = rows.groupBy(*at).agg(F.count("*").alias("n"), F.min("part").alias("lo"), F.max("part").alias("hi")).where((F.col("n") > small) & (F.col("lo") < F.col("hi")))
    rows = materialize(rows.join(mixed.select(*at), at).select("node", *at))
    hashed = hashed_sets(texts, rows, width)
    rows = rows.join(hashed.select("node", F.size("hashes").alias("size")), "node")
    chunks = F.greatest(F.ceil(F.count("*") / chunk), F.ceil(F.sum("size") / most)).cast("int")
    rows = rows.join(rows.groupBy(*at).agg(chunks.alias("chunks")), at)
    rows = rows.withColumn("own", F.pmod(F.xxhash64("node"), F.col("chunks")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    rows = rows.select("node", *at, "own", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"))
    rows = rows.join(parts.select("node", "part", "fp", "bands"), "node").join(hashed, "node")
    return materialize(rows.groupBy(*at, "i", "j").applyInPandas(decide, "u long, v long").distinct())


def text_node(text: str) -> Column:
    """The number of a text; null, empty and blank ones have the same."""
    return F.xxhash64(F.btrim(F.coalesce(F.col(text).cast("string"), F.lit("")), F.lit(SPACE_CHARS)))


def near_roots(
    df: DataFrame, text: str = "text", width: int = 5, similarity: float = 0.8, blocks: int = 4, bands: int = 18, rows: int = 4, small: int = SMALL
) -> DataFrame:
    """(node, root) for each text_node() that is linked to another: the smallest node that it reaches over links."""
    p = math.acos(2 * similarity / (1 + similarity)) / math.pi
    n = BITS * blocks
    radius = math.ceil(n * p + 5 * math.sqrt(n * p * (1 - p)))
    texts = df.select(text_node(text).alias("node"), F.col(text).cast("string").alias("text"))
    nodes = sketches(texts, width, blocks, bands, rows).groupBy("node").agg(F.first("fp").alias("fp"), F.first("bands").alias("bands"))
    nodes = materialize(nodes)
    keys = [F.get("bands", F.lit(k)) for k in range(bands)]
    found = verified(materialize(links(nodes, keys, radius, blocks, small=small)), texts, width, similarity)
    stars = connected_components(found).withColumnRenamed("node", "s_node")
    parts = nodes.join(stars, nodes["node"] == stars["s_node"], "left").select("node", "fp", "bands", F.coalesce("root", "node").alias("part"))
    more = verified_blocks(materialize(parts), texts, radius, width, similarity, small)
    if more.isEmpty():
        return stars.withColumnRenamed("s_node", "node")
    return connected_components(found.union(more))


def near_components(df: DataFrame, text: str = "text", id_col: str = "doc_id", **how) -> DataFrame:
    """(doc_id, component_id) for each row of df, by similarity (Jaccard) of the sets of word shingles; how as for near_roots()."""
    rows = df.select(F.col(id_col).try_cast("long").alias("doc_id"), text_node(text).alias("node"))
    stars = near_roots(df, text, **how)
    least = rows.groupBy("node").agg(F.min("doc_id").alias("least")).join(stars, "node", "left").withColumn("root", F.coalesce("root", "node"))
    named = least.join(least.groupBy("root").agg(F.min("least").alias("component_id")), "root").select("node", "component_id")
    return rows.join(named, "node").select("doc_id", "component_id")


def drop_near_duplicates(df: DataFrame, text: str = "text", id_col: str = "doc_id", **how) -> DataFrame:
    """df without the near copies: of each component one row stays, the first by id (null last), then by a hash of text and row.

    Rows with one id but different texts, null ids among them, are told apart by their texts. Only rows that are equal in all
    columns of plain types are left to chance.
    """
    names = df.columns
    df, back = set_aside(df, (text, id_col))
    node, row, root, n = (free_name(df, c) for c in ("_node", "_row", "_root", "_n"))
    plain = [F.col(c).cast("string") for c, t in df.dtypes if not t.startswith(("map", "variant"))]
    rows = df.withColumns({node: text_node(text), row: F.xxhash64(*plain)})
    own = F.struct(F.col(id_col).isNull().alias("none"), F.col(id_col).alias("id"), F.col(row).alias("row"), F.col(node).alias("node"), F.col(n).alias("n"))
    # One row for each text first, with map-side combine: many copies of one text don't meet in one task.
    first = rows.groupBy(id_col, row, node).agg(F.count("*").alias(n)).groupBy(F.col(node).alias("node")).agg(F.min(own).alias("best"))
    first = first.join(near_roots(df, text, **how), "node", "left").groupBy(F.coalesce("root", "node").alias(root)).agg(F.min("best").alias("best"))
    first = first.select(root, *[F.col(f"best.{c}").alias(f"{root}_{c}") for c in ("id", "row", "node", "n")])
    same = (rows[node] == first[f"{root}_node"]) & (rows[row] == first[f"{root}_row"]) & rows[id_col].eqNullSafe(first[f"{root}_id"])
    found = rows.join(first, same)
    repeated = found.where(F.col(f"{root}_n") > 1).dropDuplicates([root])
    kept = found.where(F.col(f"{root}_n") == 1).select(*df.columns).unionByName(repeated.select(*df.columns))
    return kept.withColumnsRenamed(back).select(*names)
