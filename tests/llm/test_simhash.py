import numpy as np
import xxhash
from helpers import edge_docs, no_docs
from pyspark.sql import functions as F

from cytoloom.llm import simhash
from cytoloom.llm.common import read_table
from cytoloom.llm.queries import op3_simhash


def brute_fingerprint(text, width=4):
    words = "".join(c.lower() if c.isascii() else c for c in text or "").encode().split()
    grams = [b" ".join(words[i : i + width]) for i in range(max(1, len(words) - width + 1))] if words else []
    hashes = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(fps, radius):
    """The smallest id reachable over links of at most radius bits."""
    ids, root = list(fps), {}
    for i in ids:
        if i in root:
            continue
        todo, group = [i], set()
        while todo:
            j = todo.pop()
            if j not in group:
                group.add(j)
                todo += [k for k in ids if (fps[j] ^ fps[k]).bit_count() <= radius and k not in group]
        root |= {j: min(group) for j in group}
    return root


def test_query_against_brute_force(spark):
    rows = {r["doc_id"]: r for r in op3_simhash(spark, "/root/testdata/sf0.001").collect()}
    docs = read_table(spark, "/root/testdata/sf0.001", "documents").collect()
    fps = {d["doc_id"]: brute_fingerprint(d["text"]) for d in docs}
    roots = brute_components(fps, 4)
    assert len(rows) == len(docs)
    for i, fp in fps.items():
        assert rows[i]["fingerprint"] == f"{fp:016x}" and rows[i]["component_id"] == roots[i]


def test_no_link_within_the_radius_is_lost():
    rng = np.random.default_rng(3)
    base = rng.integers(0, 1 << 63, 40, dtype=np.uint64)
    fps = np.concatenate([base] + [base ^ np.uint64(sum(1 << int(b) for b in rng.choice(64, 4, replace=False))) for _ in range(5)])[:, None]
    a, b = simhash.bucket_links(fps, np.array([0]), 4)
    root = simhash.forest(len(fps), a, b)
    want = brute_components({i: int(x) for i, x in enumerate(fps[:, 0])}, 4)
    assert root.tolist() == [want[i] for i in range(len(fps))]


def test_hot_buckets_are_cut_into_chunks(spark):
    rows = [(i, [int((1 << 40) + i)]) for i in range(300)]
    nodes = spark.createDataFrame(rows, "node long, fp array<long>")
    found = simhash.links(nodes, simhash.pair_keys(4), 4, chunk=16).collect()
    label = {i: i for i in range(300)}

    def top(x):
        while label[x] != x:
            x = label[x]
        return x

    for r in found:
        label[max(top(r["u"]), top(r["v"]))] = min(top(r["u"]), top(r["v"]))
    assert {top(i) for i in range(300)} == {0}


def test_edge_rows(spark):
    rows = simhash.simhash_components(edge_docs(spark, ("fp", "component_id", "node"))).collect()
    assert len(rows) == 12
    of = {r["doc_id"]: r["component_id"] for r in rows}
    assert of[2] == of[3] == of[4] == 2 and of[8] == of[9] == 8
    assert simhash.simhash_components(no_docs(spark)).count() == 0


def test_near_copies_go_and_others_stay(spark):
    words = [f"t{k}" for k in range(400)]
    near = words[:200] + ["changed"] + words[201:]  # five of 396 shingles differ
    other = [f"u{k}" for k in range(400)]
    rows = [(5, " ".join(words)), (3, " ".join(near)), (4, " ".join(other)), (4, " ".join(other)), (7, None), (8, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(r["doc_id"] for r in simhash.drop_near_duplicates(df).collect()) == [3, 4, 7]
    assert simhash.drop_near_duplicates(no_docs(spark)).count() == 0
    assert simhash.drop_near_duplicates(edge_docs(spark)).count() > 0


def brute_near(rows, similarity=0.8, width=5):
    """Component number of each row, by the similarity of all pairs."""
    sets = []
    for _, text in rows:
        words = (text or "").lower().split()
        sets.append({tuple(words[k : k + width]) for k in range(max(1, len(words) - width + 1))} if words else set())
    label = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if (not sets[i] and not sets[j]) or len(sets[i] & sets[j]) >= similarity * max(1, len(sets[i] | sets[j])):
                a, b = label[i], label[j]
                label = [b if x == a else x for x in label]
    return label


def test_near_links_against_brute_force_around_the_threshold(spark):
    rows, rng = [], np.random.default_rng(5)
    for k in range(150):  # pairs from 0.70 to 0.90, by the number of words replaced at the end of 200
        words = [f"p{k}x{i}" for i in range(204)]
        s = rng.uniform(0.7, 0.9)
        cut = round(200 * (1 - s) / (1 + s))
        rows += [(2 * k, " ".join(words)), (2 * k + 1, " ".join(words[: 204 - cut] + [f"q{k}x{i}" for i in range(cut)]))]
    rows += [(1000 + 2 * k + d, " ".join(f"s{k}x{i}" for i in range(8 + d))) for k in range(20) for d in range(2)]  # four and five shingles: 0.8
    label = brute_near(rows)
    want = {rows[j][0]: min(rows[k][0] for k in range(len(rows)) if label[k] == label[j]) for j in range(len(rows))}
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert 50 < sum(i != r for i, r in want.items()) < 140
    assert {r["doc_id"]: r["component_id"] for r in simhash.near_components(df).collect()} == want


def test_near_links_of_large_buckets(spark):
    base = [f"b{i}" for i in range(154)]
    rows = []
    for k in range(60):  # one word in an own place: 0.87 to the base, so about 0.75 to each other
        rows.append((k, " ".join(base[: 5 + 2 * k] + [f"own{k}", f"two{k}"] + base[7 + 2 * k :])))
    rows += [(60 + k, " ".join(base[:100] + [f"far{k}x{i}" for i in range(54)])) for k in range(60)]
    for some in (rows, [(999, " ".join(base)), *rows]):
        label = brute_near(some)
        df = spark.createDataFrame(some, "doc_id long, text string")
        want = {some[j][0]: min(some[k][0] for k in range(len(some)) if label[k] == label[j]) for j in range(len(some))}
        assert {r["doc_id"]: r["component_id"] for r in simhash.near_components(df, small=4).collect()} == want


def test_overlaps_equal_plain_intersections():
    rng = np.random.default_rng(4)
    sets = [np.unique(rng.integers(-50, 3000 if k % 3 else 60, rng.integers(0, 400))) for k in range(40)]
    a, b = rng.integers(0, 40, (2, 500))
    a, b = a[a != b], b[a != b]
    want = [len(np.intersect1d(sets[i], sets[j])) for i, j in zip(a, b)]
    assert simhash.overlaps(sets, a, b).tolist() == simhash.overlaps(sets, a, b, slice_bits=128, batch=7).tolist() == want


def test_blocks_cut_into_chunks_lose_no_link(spark):
    """Chains of near copies in buckets cut into many chunks: every part meets every other, in the first bucket that they share."""
    base = [f"b{i}" for i in range(120)]
    some = [(k, " ".join(base[: 2 * k] + [f"own{k}"] + base[2 * k + 1 :])) for k in range(50)]
    some += [(50 + k, " ".join(base[: 2 * k] + [f"own{k}"] + base[2 * k + 1 : 110] + [f"tail{k % 2}x{i}" for i in range(10)])) for k in range(50)]
    label = brute_near(some)
    want = {some[j][0]: min(some[k][0] for k in range(len(some)) if label[k] == label[j]) for j in range(len(some))}
    df = spark.createDataFrame(some, "doc_id long, text string")
    nodes = df.select(simhash.text_node("text").alias("node"), "text")
    parts = simhash.sketches(nodes, 5, 4, 18, 4).withColumn("part", F.col("node"))
    links = simhash.verified_blocks(parts, nodes, 256, 5, 0.8, small=2, chunk=9, most=700)
    from cytoloom.llm.components import connected_components

    root = {r["node"]: r["root"] for r in connected_components(links).collect()}
    node = {r["doc_id"]: r["node"] for r in df.select("doc_id", simhash.text_node("text").alias("node")).collect()}
    groups = {i: root.get(n, n) for i, n in node.items()}
    found = {i: min(j for j in groups if groups[j] == groups[i]) for i in groups}
    assert found == want and len(set(want.values())) < len(want)


def test_null_and_repeated_ids_with_different_texts(spark):
    text = lambda k, n=60: " ".join(f"d{k}x{i}" for i in range(n))
    rows = [(None, text(1)), (None, text(2)), (None, text(2) + " more"), (None, text(3)), (7, text(3) + " more"), (5, text(4)), (5, text(5)), (5, text(5)), (None, text(6))]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    out = sorted((r["doc_id"] or 0, r["text"].split()[0]) for r in simhash.drop_near_duplicates(df).collect())
    assert out == [(0, "d1x0"), (0, "d2x0"), (0, "d6x0"), (5, "d4x0"), (5, "d5x0"), (7, "d3x0")]
    kept = {r["text"] for r in simhash.drop_near_duplicates(df.repartition(2)).collect()}
    assert kept == {r["text"] for r in simhash.drop_near_duplicates(df).collect()}


def test_components_of_random_graphs_equal_a_plain_search(spark):
    import random

    from cytoloom.llm.components import connected_components

    rng = random.Random(3)
    chain = [(k, k + 1) for k in range(1000, 1060)]
    hub = [(2000, k) for k in range(2001, 2100)]
    loose = [(rng.randrange(300), rng.randrange(300)) for _ in range(180)]
    for edges in (chain + hub + loose + loose[:5] + [(5000, 5000), (None, 7)], [(2, 1), (3, 1)], []):
        root = {}

        def find(x):
            while root.setdefault(x, x) != x:
                x = root[x]
            return x

        for a, b in edges:
            if a is not None and a != b:
                x, y = sorted((find(a), find(b)))
                root[y] = x
        expected = sorted((x, find(x)) for x in root if find(x) != x)
        found = connected_components(spark.createDataFrame(edges, "u long, v long"))
        assert sorted(map(tuple, found.collect())) == expected
