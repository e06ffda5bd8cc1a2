import pytest
from helpers import edge_docs, no_docs

from cytoloom.llm import mixing


def mix(df, **how):
    return mixing.mix_sources(df, **how)[0]


def test_targets_reshare_what_exceeds():
    assert mixing.targets([100, 100, 100], [1, 2, 3], 3) == pytest.approx([50, 100, 150])
    got = mixing.targets([10, 1000, 1000], [3, 2, 1], 3)
    assert got[0] == 30 and sum(got) == pytest.approx(2010) and got[1] == pytest.approx(2 * got[2])
    assert mixing.targets([0, 0], [1, 2], 3) == [0, 0]


def test_taken_words_meet_the_targets(spark):
    rows = [(i, "w " * (1 + i % 37), f"s{i % 4}" if i % 5 else None) for i in range(500)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(6)
    out = mix(df, block=16).collect()
    assert len(out) == 500 and sum(r["size"] for r in out) == sum(1 + i % 37 for i in range(500))
    sources = {}
    for r in out:
        assert 0 <= r["taken"] <= 3 * r["size"]
        s = sources.setdefault(r["source"], [0, r["target"], 0, r["source_size"]])
        s[0], s[2] = s[0] + r["taken"], s[2] + r["size"]
    assert len(sources) == 5
    for taken, target, size, told in sources.values():
        assert abs(taken - target) <= 1 and size == told
    again = mix(df.repartition(3), block=16).collect()
    assert sorted((r["doc_id"], r["taken"]) for r in out) == sorted((r["doc_id"], r["taken"]) for r in again)


def test_schedule_is_spread_evenly(spark):
    rows = mixing.schedule(spark, [1000, 2000, 3000], 10, stretch=64).orderBy("slot").collect()
    assert [sum(r["src"] == k for r in rows) for k in range(3)] == [100, 200, 300]
    assert sorted(r["rank"] for r in rows if r["src"] == 2) == list(range(300))
    half = [r for r in rows if r["slot"] < 300]
    assert abs(sum(r["src"] == 2 for r in half) - 150) <= 4


def test_edge_rows(spark):
    docs = edge_docs(spark, ("size", "target", "copies", "src", "mix_id"))
    rows = mix(docs).collect()
    assert len(rows) == 12 and all(r["taken"] == 0 for r in rows if r["doc_id"] in (2, 3, 4))
    assert mix(no_docs(spark)).count() == 0 and mixing.take_mix(no_docs(spark)).count() == 0
    assert mixing.take_mix(docs).columns == docs.columns
    blank = spark.createDataFrame([(1, None, "a"), (2, "", None)], "doc_id long, text string, source string")
    assert {r["taken"] for r in mix(blank).collect()} == {0}


def golden(quota, block):
    """(slot, src, rank) by a plain walk along the golden-ratio sequence, for sources that need many slots."""
    need = [-(-q // block) for q in quota]
    bounds, out, have, j = [sum(need[: k + 1]) / sum(need) for k in range(len(need))], [], [0] * len(need), 0
    while any(h < n for h, n in zip(have, need)):
        point = ((j + 1) * mixing.GOLDEN) % 1.0
        k = next((i for i, b in enumerate(bounds) if point < b), len(need) - 1)
        if have[k] < need[k]:
            out.append((j, k, have[k]))
            have[k] += 1
        j += 1
    return out


def test_schedule_against_a_plain_walk(spark):
    quota = [3000, 7000, 12000]
    got = sorted((r["slot"], r["src"], r["rank"]) for r in mixing.schedule(spark, quota, 10, stretch=128).collect())
    assert got == golden(quota, 10)


def test_small_sources_get_their_slots_without_a_long_schedule(spark):
    got = mixing.schedule(spark, [5, 200_000, 0], 10).collect()
    assert sorted(r["rank"] for r in got if r["src"] == 0) == [0] and sorted(r["rank"] for r in got if r["src"] == 1) == list(range(20_000))
    assert not any(r["src"] == 2 for r in got)


def test_taken_words_against_a_plain_version(spark):
    """A source's mix is the first words of its line, repeated up to its quota; a document takes what its place on the line covers."""
    rows = [(i, "w " * (1 + (i * 7) % 23), "abc"[i % 3]) for i in range(240)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    out = {r["doc_id"]: r for r in mix(df, block=16).collect()}
    from pyspark.sql import functions as F

    h = {r["doc_id"]: r["h"] for r in df.select("doc_id", F.xxhash64("doc_id", F.lit("mix")).alias("h")).collect()}
    sizes = {i: 1 + (i * 7) % 23 for i in range(240)}
    goals = mixing.targets([sum(sizes[i] for i in range(240) if i % 3 == k) for k in range(3)], [1, 2, 3], 3)
    for k in range(3):
        own = sorted((i for i in range(240) if i % 3 == k), key=lambda i: ((h[i] & (1 << 64) - 1) >> 33, h[i], i))
        line = [i for i in own for _ in range(sizes[i])]
        quota = min(round(goals[k]), 3 * len(line))
        want = {i: 0 for i in own}
        for w in range(quota):
            want[line[w % len(line)]] += 1
        assert {i: out[i]["taken"] for i in own} == want


def test_copies_of_tied_rows_are_dealt(spark):
    rows = [(None, f"t{i} " * 5, "a") for i in range(300)] + [(i, "w " * 5, "b") for i in range(1000)] + [(7, "w " * 5, "c")] * 3
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    plan = mix(df, weights=(1, 30, 1), block=16).collect()
    for source in "abc":
        copies = sum(r["copies"] for r in plan if r["source"] == source)
        took = mixing.take_mix(df, weights=(1, 30, 1), block=16).where(f"source = '{source}'").count()
        assert took == copies
