import random

import numpy as np
from helpers import edge_docs, no_docs

from cytoloom.llm import lines


def brute(rows, min_docs, min_chars):
    key = lambda x: "".join(c.lower() if c.isascii() else c for c in x.strip(" \t\n\x0b\x0c\r"))
    seen = {}
    for n, (_, text) in enumerate(rows):
        for k in {key(x) for x in (text or "").split("\n")}:
            seen.setdefault(k, set()).add(n)
    gone = {k for k, docs in seen.items() if len(docs) >= min_docs and len(k) >= min_chars}
    out = []
    for i, text in rows:
        own = (text or "").split("\n")
        kept = [x for x in own if key(x) not in gone]
        out.append((i or -1, len(own), len(own) - len(kept), "\n".join(kept)))
    return sorted(out)


def found(df, **how):
    return sorted((r["doc_id"] or -1, r["n_lines"], r["n_dropped"], r["kept_text"]) for r in lines.line_dedup(df, **how).collect())


def test_against_brute_force_with_many_shards_and_copies(spark):
    rng = random.Random(2)
    pool = ["Home", " home\t", "ÄÖ", "äÖ", "", "menu", "x" * 500, "漢"] + [f"line {k}" for k in range(40)]
    rows = [(i, "\n".join(rng.choice(pool) for _ in range(rng.randint(0, 12)))) for i in range(1, 200)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    assert found(df) == brute(rows, 10, 1)
    assert found(df, min_docs=3, min_chars=2, shard_keys=5, probe_rows=20) == brute(rows, 3, 2)
    assert found(df, min_docs=300) == brute(rows, 300, 1)


def test_edge_rows(spark):
    docs = edge_docs(spark, ("n_lines", "kept_text", "_drops", "id"))
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    assert found(docs, min_docs=2) == brute(rows, 2, 1)
    assert found(no_docs(spark)) == []


def test_places_are_minimal_and_perfect():
    rng = np.random.default_rng(1)
    lo, hi = (rng.integers(0, 1 << 63, 5000, dtype=np.uint64) for _ in range(2))
    hashed = lines.PerfectHash.build(lo, hi)
    assert sorted(hashed.places(lo, hi)) == list(range(5000))
