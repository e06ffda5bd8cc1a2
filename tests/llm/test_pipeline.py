"""Each stage of the pipeline against a plain version on its own input."""

import sentencepiece
from helpers import edge_docs
from test_lines import brute as kept_lines
from test_quality import brute as kept_documents

import corpus_pipeline
from cytoloom.llm import mixing, simhash
from cytoloom.llm.sentencepiece import DEFAULT_MODEL

SF = "/root/testdata/sf0.001"


def shingles(text, width=5):
    words = (text or "").encode().lower().split()
    return {tuple(words[k : k + width]) for k in range(max(1, len(words) - width + 1))} if words else set()


def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    names = docs.columns
    seen = [docs]
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, seen[-1], SF).write.parquet(f"{tmp_path}/{k}")
        seen.append(spark.read.parquet(f"{tmp_path}/{k}"))
    assert all(d.columns == names for d in seen[:-1])
    start, good, lined, unique, mixed, tokens = (d.collect() for d in seen)

    want = kept_documents([(r["doc_id"], r["lang"], r["text"]) for r in start])
    assert sorted(r["doc_id"] for r in good) == sorted(i for i, keep in want.items() if keep)
    assert sorted((r["doc_id"] or -1, r["text"]) for r in lined) == sorted((i, t) for i, _, _, t in kept_lines([(r["doc_id"], r["text"]) for r in good], 10, 1))

    # Near copies: none of high similarity is left, and each that went has one that stayed.
    sets = {r["doc_id"]: shingles(r["text"]) for r in lined}
    alike = lambda a, b: len(a & b) / max(1, len(a | b))
    left = {r["doc_id"] for r in unique}
    for i in left:
        assert not any(j < i and alike(sets[i], sets[j]) >= 0.8 for j in left)
    groups = {r["doc_id"]: r["component_id"] for r in simhash.near_components(seen[2]).collect()}
    for i in set(sets) - left:
        assert groups[i] in left and any(alike(sets[i], sets[j]) >= 0.8 for j in sets if j != i and groups[j] == groups[i])

    plan = {r["doc_id"]: r["copies"] for r in mixing.mix_sources(seen[3])[0].collect()}
    assert sorted(r["doc_id"] for r in mixed) == sorted(i for i, n in plan.items() for _ in range(n))
    tool = sentencepiece.SentencePieceProcessor(model_file=DEFAULT_MODEL)
    text = {r["doc_id"]: r["text"] for r in mixed}
    assert len(tokens) == len(mixed) and all(r["ids"] == tool.encode(text[r["doc_id"]]) for r in tokens)


def test_no_documents(spark, tmp_path):
    spark.read.parquet(f"{SF}/documents.parquet").limit(0).write.parquet(f"{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


CLASHES = ("n_lines", "n_dropped", "kept_text", "n_words", "kept", "_rows", "_kept", "_node", "mix_copies", "mix_n", "mix_rows", "mix_id", "size", "target", "ids", "lo", "key")


def test_edge_rows_and_clashing_columns_at_every_stage(spark):
    docs = edge_docs(spark, CLASHES)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, SF)
        assert out.columns == docs.columns, name
        rows = out.collect()
        assert all(r[c] == "own" for r in rows for c in CLASHES), name
        assert {(r["doc_id"], r["source"]) for r in rows} <= {(r["doc_id"], r["source"]) for r in docs.collect()}
    assert corpus_pipeline.STAGES[-1][1](spark, docs, SF).count() == 12


def test_planted_near_copies(spark):
    """Of copies with one word in 60 changed, all but one go; of texts that share half their words, none."""
    base = [" ".join(f"g{g}w{k}" for k in range(120)) for g in range(12)]
    rows = []
    for g, text in enumerate(base):
        words = text.split()
        for c in range(6):
            own = list(words)
            if c:
                own[c * 17] = f"changed{c}"
            rows.append((100 * g + c, " ".join(own), None, None))
        rows.append((100 * g + 50, " ".join(words[:60] + [f"other{g}x{k}" for k in range(60)]), None, None))
    rows.append((None, base[0], None, None))
    left = simhash.drop_near_duplicates(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")).collect()
    assert sorted(r["doc_id"] for r in left) == sorted([100 * g for g in range(12)] + [100 * g + 50 for g in range(12)])
