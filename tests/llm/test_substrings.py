import random

from helpers import PASSAGE, edge_docs, no_docs

from cytoloom.llm.substrings import LAST_ID, substring_dedup


def brute(rows, window):
    """kept text of each row."""
    least = {}
    docs = [(LAST_ID if i is None else i, (t or "").encode().split()) for i, t in rows]
    for i, words in docs:
        for k in range(len(words) - window + 1):
            key = tuple(words[k : k + window])
            least[key] = min(i, least.get(key, i))
    out = []
    for i, words in docs:
        gone = set()
        for k in range(len(words) - window + 1):
            if least[tuple(words[k : k + window])] < i:
                gone |= set(range(k, k + window))
        out.append((i, len(words), len(gone), b" ".join(w for k, w in enumerate(words) if k not in gone).decode()))
    return sorted(out)


def found(df, **how):
    rows = substring_dedup(df, **how).collect()
    return sorted((LAST_ID if r["doc_id"] is None else r["doc_id"], r["n_words"], r["n_removed"], r["kept_text"]) for r in rows)


def test_random_texts_with_shared_passages(spark):
    rng = random.Random(4)
    passages = [[rng.choice("abcdefgh") * rng.randint(1, 3) for _ in range(20)] for _ in range(5)]
    rows = []
    for i in range(120):
        words = [f"w{rng.randint(0, 60)}" for _ in range(rng.randint(0, 60))]
        for _ in range(rng.randint(0, 3)):
            k, p = rng.randint(0, len(words)), rng.choice(passages)
            words[k:k] = p[rng.randint(0, 4) :]
        rows.append((rng.randint(0, 90), "  ".join(words)))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    assert found(df) == brute(rows, 13)
    assert found(df, window=6, k=3, group_rows=20, batch_rows=50) == brute(rows, 6)


def test_a_passage_in_very_many_documents(spark):
    rows = [(i, f"a{i} " + " ".join(f"p{k}" for k in range(30)) + f" b{i}") for i in range(400)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(7)
    assert found(df, group_rows=10) == brute(rows, 13)


def test_edge_rows(spark):
    docs = edge_docs(spark, ("n_words", "kept_text", "marks", "id"))
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    assert found(docs) == brute(rows, 13)
    assert sum(n for i, _, n, _ in found(docs) if i == 7) == len(PASSAGE.split())
    assert found(no_docs(spark)) == []


def test_rows_without_ids_whose_texts_share_half_of_a_hash(spark):
    low = "xxhash64({0}) & 2147483647 AS h"
    a = spark.range(150_000).selectExpr(f"concat('{PASSAGE} tail', id) AS a").selectExpr("a", low.format("a"))
    b = spark.range(150_000).selectExpr("concat('other', id) AS b").selectExpr("b", low.format("b"))
    pairs = a.join(b, "h").select("a", "b").collect()
    assert pairs
    rows = [(1, PASSAGE), *((None, t) for p in pairs for t in p)]
    out = {r["text"]: r for r in substring_dedup(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()}
    for p in pairs:
        assert out[p["a"]]["removed"] == [(0, 60)] and out[p["b"]]["removed"] == [] and out[p["b"]]["kept_text"] == p["b"]
