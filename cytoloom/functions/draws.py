"""Draws of an exact number of rows per group, by a hash of id and seed, so that reruns agree."""

from __future__ import annotations

from hashlib import md5

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from cytoloom.lineage import materialize


def hash_order(id_col: str, seed: int) -> Column:
    return F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(id_col).cast("string")))


def draw_quotas(df: DataFrame, quotas: DataFrame, by: list[str], id_col: str, seed: int) -> DataFrame:
    """The rows of df with the least hashes, as many of each group as quotas (by, _quota) tell.

    Groups are counted by ranges of the hash first. Ranges before the one where the quota is met are kept whole, later ones go, and
    rows are ordered inside a range only; so no group is sorted by one task.
    """
    df = df.withColumn("_order", hash_order(id_col, seed)).withColumn("_range", F.substring("_order", 1, 3))
    ranges = df.groupBy(*by, "_range").agg(F.count("*").alias("_n"))
    upto = W.partitionBy(*by).orderBy("_range").rowsBetween(W.unboundedPreceding, -1)
    ranges = ranges.withColumn("_before", F.coalesce(F.sum("_n").over(upto), F.lit(0))).join(quotas, by).where("_before < _quota")
    rows = df.join(ranges.select(*by, "_range", "_before", "_quota"), [*by, "_range"])
    place = F.row_number().over(W.partitionBy(*by, "_range").orderBy("_order", id_col))
    kept = rows.withColumn("_place", place).where(F.col("_before") + F.col("_place") <= F.col("_quota"))
    return kept.drop("_order", "_range", "_before", "_quota", "_place")


def first_by_hash(df: DataFrame, by: list[str], n: int, id_col: str, seed: int) -> DataFrame:
    """n rows of each group (all, if it has fewer); null groups are left out."""
    quotas = df.select(*by).distinct().withColumn("_quota", F.lit(n))
    return draw_quotas(df, quotas, by, id_col, seed)


def digests(ids: list[bytes | None], *head: object) -> np.ndarray:
    """(ids, 2): the MD5 of head and each id, with colons between, as two numbers that sort as its text does; ids that are None have no part."""
    start = ":".join(map(str, head)).encode()
    before, alone = md5(start + b":"), md5(start).digest()

    def digest(i: bytes) -> bytes:
        begun = before.copy()
        begun.update(i)
        return begun.digest()

    found = b"".join([alone if i is None else digest(i) for i in ids])
    return np.frombuffer(found, ">u8").astype(np.uint64).reshape(-1, 2)


def in_order(digest: np.ndarray) -> np.ndarray:
    """The order of rows of digests(); first halves hardly ever tie."""
    order = np.argsort(digest[:, 0])
    first = digest[order, 0]
    return np.lexsort((digest[:, 1], digest[:, 0])) if (first[1:] == first[:-1]).any() else order


def shuffled_codes(cells: DataFrame, keys: list[str], codes: int, shuffles: int, seed: int, rows: int = 2**15, block: int = 2**14) -> DataFrame:
    """(keys, x, y, n, given) of cells (keys, id as text, x, y, code): the places where cells are and how many cells of each code are there, as bytes.

    given: codes by rounds, round 0 as it is and then each shuffle, see counts_of(). A shuffle gives the code at one place of a hash order to the cell at
    that place of another, within the keys. Cells are dealt into parts of some ``rows``; digests leave a part once for each range of their first bits,
    as bytes, and codes come back to it in the same way, so no cell is a row more than once, however many shuffles there are. Cells whose code isn't
    from 0 to codes - 1 have a place in the orders, but don't count, and neither do those without coordinates, though their codes are given away.
    """
    cells = cells.dropna(subset=keys) if keys else cells
    most = cells.groupBy(*keys).agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 0
    parts, bits = max(1, -(-most // rows)), max(0, (most // (2 * rows)).bit_length())
    part = lambda *by: F.expr(f"int(pmod(xxhash64({', '.join(by)}), {parts}))")
    dealt = cells.withColumn("part", part("x", "y"))
    if parts > 1 and dealt.groupBy(*keys, "part").agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] > 8 * rows:
        dealt = cells.withColumn("part", part("id"))  # so many cells on one place that it is cut
    kinds = {f.name: f.dataType.simpleString() for f in cells.schema}
    of_keys = "".join(f"`{k}` {kinds[k]}, " for k in keys)
    packed = f"{of_keys}part int, round int, range int, n int, data binary"

    def frame(f: pd.DataFrame, columns: dict) -> pd.DataFrame:
        size = len(next(iter(columns.values())))
        return pd.DataFrame({k: [f[k].iloc[0]] * size for k in keys} | columns)

    def pack(f: pd.DataFrame) -> pd.DataFrame:
        code = f["code"].to_numpy(np.uint8)
        ids = [None if i is None else i.encode() for i in f["id"]]
        out = [(-1, 0, len(f), f["x"].to_numpy("<f8").tobytes() + f["y"].to_numpy("<f8").tobytes() + code.tobytes())]
        for turn in range(shuffles + 1):
            digest = digests(ids, seed, turn) if turn else digests(ids, seed)
            at = (digest[:, 0] >> np.uint64(64 - bits)).astype(np.int64) if bits else np.zeros(len(f), np.int64)
            order = np.argsort(at, kind="stable").astype(np.uint32)
            ends = np.searchsorted(at[order], np.arange(2**bits + 1))
            for k in np.flatnonzero(np.diff(ends)):
                some = order[ends[k] : ends[k + 1]]
                out.append((turn, k, len(some), digest[some].astype("<u8").tobytes() + (some.astype("<u4") if turn else code[some]).tobytes()))
        turns, ranges, sizes, data = map(list, zip(*out))
        return frame(f, {"part": [f["part"].iloc[0]] * len(out), "round": turns, "range": ranges, "n": sizes, "data": data})

    packs = materialize(dealt.groupBy(*keys, "part").applyInPandas(pack, packed))
    by_range = packs.where("round >= 0").groupBy(*keys, "round", "range").agg(F.sum("n").alias("n"))
    upto = W.partitionBy(*keys, "round").orderBy("range").rowsBetween(W.unboundedPreceding, -1)  # a row for each range
    spans = materialize(by_range.withColumn("before", F.coalesce(F.sum("n").over(upto), F.lit(0))))

    def opened(f: pd.DataFrame, kind: str) -> tuple[np.ndarray, list[np.ndarray]]:
        """The digests of all rows, and what else each holds."""
        digest = [np.frombuffer(d, "<u8", 2 * n).reshape(-1, 2) for d, n in zip(f["data"], f["n"])]
        return np.concatenate(digest), [np.frombuffer(d, kind, n, 16 * n) for d, n in zip(f["data"], f["n"])]

    def labels(f: pd.DataFrame, span: pd.DataFrame) -> pd.DataFrame:
        digest, code = opened(f, "u1")
        code, before = np.concatenate(code)[in_order(digest)], int(span["before"].iloc[0])
        ends = [before, *range((before // block + 1) * block, before + len(code), block), before + len(code)]
        pieces = [(a, code[a - before : b - before].tobytes()) for a, b in zip(ends, ends[1:])]
        return frame(f, {"block": [a // block for a, _ in pieces], "first": [a for a, _ in pieces], "codes": [c for _, c in pieces]})

    at = [*keys, "range"]
    given = packs.where("round = 0").groupBy(*at).cogroup(spans.where("round = 0").groupBy(*at)).applyInPandas(labels, f"{of_keys}block long, first long, codes binary")
    wanted = spans.where("round > 0").withColumn("block", F.explode(F.expr(f"sequence(before div {block}, (before + n - 1) div {block})")))
    wanted = wanted.hint("merge").join(given, [*keys, "block"]).select(*keys, "round", "range", "before", "first", "codes")

    def deal(f: pd.DataFrame, wanted: pd.DataFrame) -> pd.DataFrame:
        digest, rows = opened(f, "<u4")
        here = np.empty(len(digest), np.uint8)
        for before, first, given in zip(wanted["before"], wanted["first"], wanted["codes"]):
            low, given = first - before, np.frombuffer(given, np.uint8)
            begin, end = max(low, 0), min(low + len(given), len(here))
            if begin < end:  # a piece of a block may end before this range begins
                here[begin:end] = given[begin - low : end - low]
        code = np.empty(len(digest), np.uint8)
        code[in_order(digest)] = here
        out = []
        for row, c in zip(rows, np.split(code, np.cumsum(f["n"])[:-1])):
            row, c = row[c < codes], c[c < codes]
            out.append((len(row), row.tobytes() + c.tobytes()))
        return f[[*keys, "part", "round", "range"]].assign(n=[n for n, _ in out], data=[d for _, d in out])

    at = [*keys, "round", "range"]
    back = packs.where("round > 0").groupBy(*at).cogroup(wanted.groupBy(*at)).applyInPandas(deal, packed)

    def gather(f: pd.DataFrame, back: pd.DataFrame) -> pd.DataFrame:
        n, data = int(f["n"].iloc[0]), f["data"].iloc[0]
        x, y, code = np.frombuffer(data, "<f8", n), np.frombuffer(data, "<f8", n, 8 * n), np.frombuffer(data, "u1", n, 16 * n)
        there = np.isfinite(x) & np.isfinite(y)
        if not there.any():
            return pd.DataFrame()
        spots, spot = np.unique(x[there] + 1j * y[there], return_inverse=True)
        to = np.full(n, -1)
        to[there] = spot
        sums = np.zeros((len(spots), (shuffles + 1) * codes), np.int64)
        np.add.at(sums, (to[there & (code < codes)], code[there & (code < codes)]), 1)
        for turn, m, data in zip(back["round"], back["n"], back["data"]):
            row, c = np.frombuffer(data, "<u4", m), np.frombuffer(data, "u1", m, 4 * m)
            row, c = to[row], c.astype(np.int64)
            np.add.at(sums, (row[row >= 0], turn * codes + c[row >= 0]), 1)
        small = sums.max(axis=1) < 256
        return frame(f, {"x": spots.real, "y": spots.imag, "n": np.bincount(spot), "given": [r.astype("u1" if s else "<i8").tobytes() for r, s in zip(sums, small)]})

    at = [*keys, "part"]
    found = packs.where("round = -1").groupBy(*at).cogroup(back.groupBy(*at)).applyInPandas(gather, f"{of_keys}x double, y double, n long, given binary")
    return materialize(found)


def counts_of(given: pd.Series, width: int) -> np.ndarray:
    """(rows, width): the numbers that shuffled_codes() gives as bytes."""
    rows = list(given)
    small = np.array([len(r) == width for r in rows], bool)
    short = np.frombuffer(b"".join([r for r, s in zip(rows, small) if s]), "u1").reshape(-1, width)
    if small.all():
        return short
    out = np.empty((len(rows), width), np.int64)
    out[small], out[~small] = short, np.frombuffer(b"".join([r for r, s in zip(rows, small) if not s]), "<i8").reshape(-1, width)
    return out
