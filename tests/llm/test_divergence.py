"""The divergence audit against a plain version."""

import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from cytoloom.llm.divergence import divergence

from helpers import edge_docs, no_docs


def plain(rows, min_docs, top):
    texts = [(lang or "", source or "", re.findall("[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))) for text, lang, source in rows]
    out = set()
    for lang in {t[0] for t in texts}:
        docs = Counter(w for own, _, ws in texts if own == lang for w in set(ws))
        kept = sorted(w for w, n in docs.items() if n >= min_docs)
        count = defaultdict(Counter)
        for own, source, ws in texts:
            if own == lang:
                for key in (source, None):
                    count[key].update(w for w in ws if w in set(kept))
        p = {g: {w: 1 + 10**9 * (c[w] + 5) // (sum(c.values()) + 5 * len(kept)) for w in kept} for g, c in count.items()}
        for g in count:
            if g is None:
                continue
            pairs = [(-sum(abs(p[g][w] - p[h][w]) for w in kept), h.encode()) for h in count if h not in (None, g)]
            terms = [(p[None][w] - p[g][w], w.encode()) for w in kept if count[g][w] and p[g][w] > p[None][w]]
            for part, found in (("pair", sorted(pairs)), ("term", sorted(terms)[:top])):
                out |= {(lang, g, part, item.decode(), -value, k) for k, (value, item) in enumerate(found, 1)}
    return out


def ours(df, **options):
    rows = [tuple(r) for r in divergence(df, **options).select("lang", "source", "part", "item", "value", "rank").collect()]
    assert len(rows) == len(set(rows))
    return set(rows)


@pytest.mark.parametrize("light, tile_terms, block_groups", [(8, 4096, 64), (0, 2, 1), (2, 3, 2), (99, 4096, 2)])
def test_splits_agree_with_a_plain_version(spark, light, tile_terms, block_groups):
    words = ["alpha", "Beta", "beta", "gämma", "delta", "eps", "zeta", "éta", "theta"]
    rows = [(" ".join(words[(k * j) % (3 + k % 7)] for j in range(1 + k % 11)), ["en", "de", None][k % 3], f"s{k % 5}" if k % 13 else None) for k in range(90)]
    df = spark.createDataFrame(rows, "text string, lang string, source string").repartition(3)
    assert ours(df, min_docs=4, top=3, light=light, tile_terms=tile_terms, block_groups=block_groups) == plain(rows, 4, 3)


@pytest.mark.parametrize("min_docs", [1, 2, 50])
def test_edge_rows(spark, min_docs):
    docs = edge_docs(spark, ("term", "n", "docs", "p", "block"))
    assert ours(docs, min_docs=min_docs) == plain([(r["text"], r["lang"], r["source"]) for r in docs.collect()], min_docs, 50)


def test_empty(spark):
    assert divergence(no_docs(spark)).isEmpty()
    assert ours(edge_docs(spark).withColumn("text", F.lit(None).cast("string"))) == plain([(None, r["lang"], r["source"]) for r in edge_docs(spark).collect()], 30, 50)
