"""Line deduplication by probing sharded minimal perfect hashes.

A line's key is the line stripped of white space at both ends, A-Z in lower case. Keys found in many documents lose all
their lines in every document. The distinct 128-bit key hashes are dealt into shards; each shard is indexed by a minimal perfect
hash (levels of bit arrays, each holding the keys that had a place to themselves) into a compact array of fingerprints and one of
document counts. Documents send the hashes of their own distinct lines to the shards, never the lines, and get back the hashes to drop.

Scale: a shard has about ``shard_keys`` keys, however many there are. Its probes are known beforehand, the sum of its
counts; a shard with more than ``probe_rows`` of them is copied, and probes are salted over the copies, so a line that stands
in a third of all documents doesn't end in one task.

Defined results
---------------
* Null and empty texts are one empty line; keys of fewer than ``min_chars`` code points are never dropped.
* Each row is a document, repeated rows and rows with null or repeated ids included. If all lines go, the text is empty.
* An empty table gives an empty result. Texts are taken whole, however long. Further columns come back as they were; those with the names of the
  results are replaced.
"""

from __future__ import annotations

import json

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import SPACE_BYTES, free_name, materialize


def line_key(line: bytes) -> bytes:
    return line.strip(SPACE_BYTES).lower()


def key_hashes(keys: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The halves of the 128-bit hashes."""
    both = np.frombuffer(b"".join(map(xxhash.xxh3_128_digest, keys)), ">u8").astype(np.uint64).reshape(-1, 2)
    return both[:, 1], both[:, 0]


def code_points(key: bytes) -> int:
    return len(key.decode("utf-8", "replace"))


def mixed(lo: np.ndarray, hi: np.ndarray, level: int) -> np.ndarray:
    """A hash of both halves that differs from level to level."""
    x = lo ^ (hi + np.uint64((level * 0x9E3779B97F4A7C15 + 0x632BE59BD9B4E019) % (1 << 64)))
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
        x = x ^ (hi >> np.uint64(level % 7))
    return x ^ (x >> np.uint64(31))


class PerfectHash:
    """A minimal perfect hash of distinct 128-bit keys: each gets a place of its own from 0 to their number less 1."""

    def __init__(self, sizes: list[int], words: np.ndarray):
        self.sizes, self.words = sizes, words
        self.before = np.concatenate([[0], np.cumsum(np.bitwise_count(words).astype(np.int64))])

    @classmethod
    def build(cls, lo: np.ndarray, hi: np.ndarray, room: float = 1.6) -> PerfectHash:
        sizes, words = [], []
        while len(lo):
            size = max(64, -(-int(room * len(lo)) // 64) * 64)
            place = mixed(lo, hi, len(sizes)) % np.uint64(size)
            alone = np.bincount(place.astype(np.int64), minlength=size) == 1
            words.append(np.packbits(alone, bitorder="little").view(np.uint64))
            sizes.append(size)
            left = ~alone[place.astype(np.int64)]
            lo, hi = lo[left], hi[left]
        return cls(sizes, np.concatenate(words) if words else np.zeros(0, np.uint64))

    def places(self, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        """The place of each key; of keys that weren't indexed, some place or -1."""
        found, left, base = np.full(len(lo), -1, np.int64), np.arange(len(lo)), 0
        for level, size in enumerate(self.sizes):
            bit = mixed(lo[left], hi[left], level) % np.uint64(size)
            word, lane = base + (bit >> np.uint64(6)).astype(np.int64), bit & np.uint64(63)
            hit = (self.words[word] >> lane) & np.uint64(1) == 1
            below = self.words[word] & ((np.uint64(1) << lane) - np.uint64(1))
            found[left[hit]] = (self.before[word] + np.bitwise_count(below))[hit]
            left, base = left[~hit], base + size // 64
        return found


def document_lines(df: DataFrame, text: str, id_name: str, min_chars: int) -> DataFrame:
    """(id, lo, hi): hashes of the distinct keys of each row that are long enough to be dropped."""
    rows = df.select(F.col(id_name).alias("id"), F.col(text).cast("string").alias("text"))
    schema = T.StructType([rows.schema["id"], T.StructField("lo", T.LongType()), T.StructField("hi", T.LongType())])

    def run(batches):
        for batch in batches:
            at, keys = [], []
            for k, text in enumerate(batch.column(1).cast(pa.binary()).to_pylist()):
                own = {x for x in map(line_key, (text or b"").split(b"\n")) if len(x) >= min_chars and code_points(x) >= min_chars}
                at += [k] * len(own)
                keys += own
            lo, hi = key_hashes(keys)
            ids = batch.column(0).take(pa.array(at, pa.int64()))
            yield pa.RecordBatch.from_arrays([ids, pa.array(lo.view(np.int64)), pa.array(hi.view(np.int64))], names=["id", "lo", "hi"])

    return rows.mapInArrow(run, schema)


def build_shards(counts: DataFrame, shards: int, cap: int) -> DataFrame:
    """One row per shard: its perfect hash, and the arrays of 32-bit fingerprints and of document counts up to cap."""
    number = np.uint8 if cap < 256 else np.uint32

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        lo, hi = (frame[c].to_numpy(np.int64).view(np.uint64) for c in ("lo", "hi"))
        hashed = PerfectHash.build(lo, hi)
        place = hashed.places(lo, hi)
        prints, docs = np.zeros(len(lo), np.uint32), np.zeros(len(lo), number)
        prints[place] = (hi >> np.uint64(32)).astype(np.uint32)
        docs[place] = np.minimum(frame["n"].to_numpy(), cap)
        row = {"shard": frame["shard"].iat[0], "sizes": [hashed.sizes], "words": hashed.words.tobytes()}
        return pd.DataFrame(row | {"prints": prints.tobytes(), "docs": docs.tobytes(), "probes": int(frame["n"].sum())})

    schema = "shard int, sizes array<long>, words binary, prints binary, docs binary, probes long"
    rows = counts.withColumn("shard", F.pmod(F.xxhash64("lo"), F.lit(shards)).cast("int"))
    return rows.groupBy("shard").applyInPandas(run, schema)


def probe(shard: pd.Series, lo: np.ndarray, hi: np.ndarray, cap: int) -> np.ndarray:
    """Whether each key is in at least cap documents, from a shard's arrays."""
    hashed = PerfectHash(list(shard["sizes"]), np.frombuffer(shard["words"], np.uint64))
    prints = np.frombuffer(shard["prints"], np.uint32)
    docs = np.frombuffer(shard["docs"], np.uint8 if cap < 256 else np.uint32)
    place = hashed.places(lo, hi)
    return (place >= 0) & (prints[place] == (hi >> np.uint64(32)).astype(np.uint32)) & (docs[place] >= cap)


def frequent_lines(
    df: DataFrame, text: str, id_name: str, min_docs: int, min_chars: int, shard_keys: int, probe_rows: int
) -> DataFrame:
    """(id, lo, hi): of each document, the keys that stand in at least min_docs documents."""
    lines = document_lines(df, text, id_name, min_chars)
    counts = materialize(lines.groupBy("lo", "hi").agg(F.count("*").alias("n")))
    shards = max(1, -(-counts.count() // shard_keys))
    table = materialize(build_shards(counts, shards, min_docs))
    # Only shards that are probed more often than a task should be come to the driver: at most all probes over probe_rows of them.
    hot = {r["shard"]: -(-r["probes"] // probe_rows) for r in table.where(F.col("probes") > probe_rows).select("shard", "probes").collect()}
    copies = F.coalesce(F.element_at(F.from_json(F.lit(json.dumps(hot)), "map<string,int>"), F.col("shard").cast("string")), F.lit(1)) if hot else F.lit(1)
    table = table.withColumn("copy", F.explode(F.sequence(F.lit(0), copies - 1)))
    lines = lines.withColumn("shard", F.pmod(F.xxhash64("lo"), F.lit(shards)).cast("int"))
    lines = lines.withColumn("copy", F.pmod(F.xxhash64("id", "hi"), copies).cast("int"))

    def run(own: pd.DataFrame, shard: pd.DataFrame) -> pd.DataFrame:
        if not len(own) or not len(shard):
            return own.iloc[:0][["id", "lo", "hi"]]
        lo, hi = (own[c].to_numpy(np.int64).view(np.uint64) for c in ("lo", "hi"))
        return own.loc[probe(shard.iloc[0], lo, hi, min_docs), ["id", "lo", "hi"]]

    keys = ["shard", "copy"]
    schema = T.StructType([lines.schema[c] for c in ("id", "lo", "hi")])
    return lines.groupBy(*keys).cogroup(table.groupBy(*keys)).applyInPandas(run, schema)


def line_dedup(
    df: DataFrame,
    text: str = "text",
    id_col: str = "doc_id",
    min_docs: int = 10,
    min_chars: int = 1,
    shard_keys: int = 1 << 18,
    probe_rows: int = 1 << 20,
) -> DataFrame:
    """df with n_lines, n_dropped and kept_text, replacing columns of these names.

    Drops follow from the keys alone, so rows that share id and text get the same drops, which are right for each.
    """
    df = df.drop(*({"n_lines", "n_dropped", "kept_text"} - {text, id_col}))
    columns, key = df.columns, free_name(df, "_row_key")
    df = df.withColumn(key, F.xxhash64(id_col, text))  # rows without an id, or with one id, meet by their texts only
    drops = frequent_lines(df, text, key, min_docs, min_chars, shard_keys, probe_rows)
    drops = drops.groupBy("id").agg(F.collect_set(F.struct("lo", "hi")).alias("keys")).withColumnRenamed("id", "drop_id")
    name = free_name(df, "_drops")
    joined = df.join(drops.withColumnRenamed("keys", name), df[key] == F.col("drop_id"), "left").select(*columns, name)
    df = df.select(*columns)
    place = df.columns.index(text)
    added = [T.StructField("n_lines", T.LongType()), T.StructField("n_dropped", T.LongType()), T.StructField("kept_text", T.StringType())]

    def run(batches):
        for batch in batches:
            lines, dropped, kept = [], [], []
            for body, keys in zip(batch.column(place).cast(pa.binary()).to_pylist(), batch.column(name).to_pylist()):
                own = (body or b"").split(b"\n")
                lines.append(len(own))
                if keys:
                    gone = {(x["lo"], x["hi"]) for x in keys}
                    lo, hi = key_hashes([line_key(x) for x in own])
                    own = [x for x, k in zip(own, zip(lo.view(np.int64).tolist(), hi.view(np.int64).tolist())) if k not in gone]
                dropped.append(lines[-1] - len(own))
                kept.append(b"\n".join(own))
            new = [pa.array(lines, pa.int64()), pa.array(dropped, pa.int64()), pa.array(kept, pa.binary()).cast(pa.string())]
            yield pa.RecordBatch.from_arrays([c for c, n in zip(batch.columns, batch.schema.names) if n != name] + new, names=[n for n in batch.schema.names if n != name] + ["n_lines", "n_dropped", "kept_text"])

    return joined.mapInArrow(run, T.StructType([*df.schema.fields, *added]))
