import random
import struct

import duckdb
import pyarrow as pa
import sentencepiece
from helpers import edge_docs, no_docs

from cytoloom.llm import sentencepiece as sp
from cytoloom.llm.common import read_table


def library():
    return sentencepiece.SentencePieceProcessor(model_file=sp.DEFAULT_MODEL)


def test_ids_equal_the_librarys(spark):
    tool = library()
    docs = read_table(spark, "/root/testdata/sf0.001", "documents")
    for r in sp.decode(sp.encode(docs)).collect():
        assert r["ids"] == tool.encode(r["text"] or "")
        assert r["decoded"] == tool.decode(r["ids"])


def test_edge_rows_and_clashing_columns(spark):
    tool = library()
    rows = sp.decode(sp.encode(edge_docs(spark, ("ids", "decoded", "keep")))).collect()
    assert len(rows) == 12 and all(r["keep"] == "own" for r in rows)
    for r in rows:
        assert r["ids"] == tool.encode(r["text"] or "")
    assert sp.decode(sp.encode(no_docs(spark))).count() == 0


def ids_of(model, *texts):
    return model.encode(pa.array(texts, pa.string())).to_pylist()


def test_window_stays_bounded():
    model = sp.Model(sp.read_model(sp.DEFAULT_MODEL))
    assert ids_of(model, "abc" * 20_000) == [library().encode("abc" * 20_000)]


def varint(n):
    return bytes([n]) if n < 128 else bytes([n & 127 | 128]) + varint(n >> 7)


def field(number, data):
    return bytes([number << 3 | 2]) + varint(len(data)) + data


def small_model():
    piece = lambda text, score, kind=1: field(1, field(1, text.encode()) + bytes([21]) + struct.pack("<f", score) + bytes([24, kind]))
    return piece("<unk>", 0, 2) + piece("▁", -1) + piece("a", -2) + piece("b", -2) + piece("ab", -3) + piece("▁ab", -5) + field(2, bytes([24, 1]))


def test_unigram_models_take_the_best_path():
    model = sp.Model(small_model())
    assert [model.text[i] for i in ids_of(model, "ab ab")[0]] == ["▁", "ab", "▁", "ab"]
    assert ids_of(model, "ab?")[0][-1] == 0
    assert ids_of(model, "??!a?")[0] == [1, 0, 2, 0]


def test_unigram_ids_equal_the_librarys():
    """The public merge model's pieces, with other scores and declared a unigram model, in the library and here."""
    out, rng = b"", random.Random(5)
    for number, value in sp.wire_fields(sp.read_model(sp.DEFAULT_MODEL)):
        if number == 1:
            piece = dict(sp.wire_fields(value))
            score = -round(1024 * len(piece[1]) ** 0.5 * rng.uniform(3, 9)) / 1024  # sums are exact in the library's floats
            out += field(1, field(1, piece[1]) + bytes([21]) + struct.pack("<f", score) + bytes([24, piece.get(3, 1)]))
        elif number == 2:
            out += field(2, value + bytes([24, 1]))  # the last value of a field counts
        elif number == 3:
            out += field(3, value)
    tool = sentencepiece.SentencePieceProcessor(model_proto=out)
    model = sp.Model(out)
    assert model.kind == model.UNIGRAM
    docs = duckdb.sql("SELECT text FROM '/root/testdata/sf0.001/documents.parquet' WHERE text IS NOT NULL ORDER BY doc_id").fetchall()
    texts = [line for (text,) in docs for line in text.split("\n") if len(line) < 400]
    assert len(texts) > 500
    for text, ids in zip(texts, ids_of(model, *texts)):
        assert ids == tool.encode(text)


def test_ids_outside_the_vocabulary(spark):
    rows = spark.createDataFrame([(1, [-5, 1, 10**6]), (2, [None, 2]), (3, []), (4, None)], "k int, ids array<int>")
    data = {r["k"]: r["decoded"] for r in sp.decode(rows).collect()}
    assert data == {1: " ⁇  ⁇ ", 2: " ⁇ ", 3: "", 4: ""} or data == {1: "⁇  ⁇ ", 2: "⁇ ", 3: "", 4: ""}
    model = sp.Model(sp.read_model(sp.DEFAULT_MODEL))
    broken = pa.array([[model.byte_ids[0xC3], model.byte_ids[0x28]], [model.byte_ids[0xC3], model.byte_ids[0xA9]]], pa.list_(pa.int32()))
    assert model.decode(broken).to_pylist() == ["\ufffd(", "é"]


def test_models_are_told_apart_by_all_their_bytes():
    one = small_model()
    two = bytes(bytearray(one))
    assert sp.load(one) is sp.load(two)
    assert sp.load(one) is not sp.load(one.replace(b"ab", b"ba"))


def test_one_pass_equals_two(spark):
    docs = edge_docs(spark, ("ids",))
    key = lambda r: (r["doc_id"] or -1, r["text"] or "", r["ids"], r["decoded"])
    assert sorted(map(key, sp.encode_and_decode(docs).collect())) == sorted(map(key, sp.decode(sp.encode(docs)).collect()))
