import numpy as np
from helpers import edge_docs, no_docs
from pyspark.sql import functions as F

from cytoloom.llm import language_id
from cytoloom.llm.queries import op7_language_id


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang", F.length("text").alias("n"))
    rows = op7_language_id(spark, sf).join(docs, "doc_id").where("held_out AND lang IS NOT NULL AND n >= 40").collect()
    right = sum(r["lang"] == r["lang_pred"] for r in rows)
    assert len(rows) > 50 and right >= 0.95 * len(rows)


def test_edge_rows(spark):
    docs = edge_docs(spark, ("lang_pred", "score"))
    model = language_id.fit(docs, F.lit(True), "text", "lang", "doc_id")
    rows = language_id.identify(docs, model).collect()
    assert len(rows) == 12 and all(0 <= r["score"] <= 1 for r in rows)
    assert {r["lang_pred"] for r in rows if r["doc_id"] in (2, 3, 4)} == {"und"}
    assert {r["lang_pred"] for r in rows} <= {"und", "en", "fr", "xx"}


def test_nothing_to_learn_from(spark):
    assert language_id.fit(no_docs(spark), F.lit(True), "text", "lang", "doc_id") is None
    assert {r["lang_pred"] for r in language_id.identify(edge_docs(spark), None).collect()} == {"und"}
    assert language_id.identify(no_docs(spark), None).count() == 0


def test_every_label_is_learned(spark):
    rows = [(100 * k + j, " ".join(chr(0x4E00 + 40 * k + i) * 3 for i in range(j, j + 12)), f"l{k:03}") for k in range(90) for j in range(4)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language_id.fit(df, F.lit(True), "text", "lang", "doc_id", sample_rows=200)
    assert len(model.languages) >= 80  # each text is drawn by hash with a chance of a half


def test_ridge_regression_against_a_plain_one():
    """With every sampled text a landmark, Nystroem's form gives the kernel ridge regression of the whole kernel, up to the constant."""
    rng = np.random.default_rng(3)
    words = [[f"{c}{rng.integers(99)}" for _ in range(30)] for c in "abc" for _ in range(20)]
    labels = [c for c in "abc" for _ in range(20)]
    bits = np.stack([language_id.presence(" ".join(w)) for w in words])
    model = language_id.Classifier.fit(bits, labels, landmarks=60)
    x = language_id.normalised(bits).astype(float)
    kernel = x @ x.T
    plus = np.hstack([np.linalg.cholesky(kernel + 1e-9 * np.eye(60)), np.ones((60, 1))])  # features whose products are the kernel
    goal = np.where(np.array(labels)[:, None] == np.array(["a", "b", "c"]), 1.0, -1.0)
    fitted = np.linalg.solve(plus.T @ plus + 1e-2 * 60 * 1e-2 * np.eye(61), plus.T @ goal)
    assert np.allclose(model.scores(bits), plus @ fitted, atol=2e-2)
    assert [model.languages[k] for k in model.scores(bits).argmax(axis=1)] == labels
