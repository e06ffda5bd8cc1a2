"""Ranked search against a plain version."""

import math
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from helpers import PASSAGE, edge_docs, no_docs
from pyspark.sql import functions as F

from cytoloom.llm.lexical_search import STEP, impacts, search

TERM = re.compile("[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+")


def terms(text):
    return TERM.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def plain(docs, items, k):
    tfs = [(i, Counter(terms(t))) for i, t in docs]
    tfs = [(i, c, sum(c.values())) for i, c in tfs if c]
    n, length = len(tfs), sum(s for _, _, s in tfs)
    df = Counter(w for _, c, _ in tfs for w in c)
    out = []
    for item, text in items:
        scores = defaultdict(int)
        for j, (_, c, size) in enumerate(tfs):
            m = 100 - 25 + (25 * size * n) // length
            for w in terms(text):
                if w in c:
                    scores[j] += math.floor(1000 * math.log((2 * n + 2) / (2 * df[w] + 1))) * ((10**9 * c[w]) // (1000 * c[w] + 12 * m))
        found = sorted((-s, math.inf if tfs[j][0] is None else tfs[j][0]) for j, s in scores.items() if s > 0)[:k]
        out += [(item, rank, None if i == math.inf else i, -s) for rank, (s, i) in enumerate(found, 1)]
    return sorted(map(str, out))


def ours(docs, items, **options):
    return sorted(str(tuple(r)) for r in search(docs, items, **options).select("item_id", "rank", "doc_id", "score").collect())


@pytest.mark.parametrize("options", [{}, {"block_items": 3, "shard_docs": 7}, {"shard_posts": 40}])
def test_agrees_with_a_plain_version(spark, options):
    rng = np.random.default_rng(5)
    words = [f"W{k}" for k in range(60)] + ["é", "x9"]
    text = lambda n: ", ".join(words[int(w)] for w in np.minimum(rng.zipf(1.4, n), len(words)) - 1)
    docs = [(int(i), text(1 + i % 40)) for i in rng.permutation(150)]
    docs += [(200 + k, docs[3][1]) for k in range(40)]  # copies tie
    items = [(k, text(1 + 3 * k)) for k in range(12)] + [(99, docs[3][1])]
    d = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    assert ours(d, spark.createDataFrame(items, "item_id long, text string"), k=5, **options) == plain(docs, items, 5)


def test_edge_rows(spark):
    docs = edge_docs(spark, ("term", "ids", "docs", "score", "item_id"))
    items = [(1, PASSAGE), (2, None), (3, ""), (4, "!?"), (5, "repeated REPEATED row unseen"), (6, "Ünïcödé 漢字"), (None, "alpha"), (7, "w1x1 W2x2"), (7, "alpha")]
    df = spark.createDataFrame(items, "item_id long, text string").withColumn("doc_id", F.lit("own"))
    expected = plain([(r["doc_id"], r["text"]) for r in docs.collect()], [i for i in items if i[0] is not None and i != (7, "w1x1 W2x2")], 20)
    assert ours(docs, df) == expected
    assert search(no_docs(spark), df).isEmpty() and search(docs, df.limit(0)).isEmpty()
    assert search(docs.where("text IS NULL"), df).isEmpty()
    one = docs.where("doc_id = 1").repartition(9, "doc_id")  # most partitions are empty
    assert [r["item_id"] for r in search(one, df, shard_docs=1).collect()] == [7]


def test_bytes_round_up():
    tf, m = np.meshgrid(np.arange(1, 200), np.arange(75, 4000, 7))
    exact = impacts(tf, m)
    step = -(-exact // STEP)
    assert step.max() <= 255 and (step * STEP >= exact).all() and ((step - 1) * STEP < exact).all()
