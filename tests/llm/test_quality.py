import math
import re
from collections import Counter

import pytest
from helpers import edge_docs, no_docs

from cytoloom.llm import quality
from cytoloom.llm.common import read_table
from cytoloom.llm.queries import op9_quality_rules

SF = "/root/testdata/sf0.001"


def base(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    rows = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    grams = [tuple(words[k : k + 3]) for k in range(len(words) - 2)]
    often = Counter(grams)
    covered = {k + j for k, g in enumerate(grams) if often[g] > 1 for j in range(3)}
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(rows) - len(set(rows)), len(covered)


def words_in(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def common_words(rows, common=24, longest=5):
    """The words that each language has most of, all languages together."""
    seen = {}
    for _, lang, text in rows:
        if lang is not None:
            seen.setdefault(lang, Counter()).update(w for w in words_in(text) if len(w) <= longest)
    return sorted({w for c in seen.values() for w, _ in sorted(c.items(), key=lambda x: (-x[1], x[0]))[:common]})


def histograms(text, listed):
    import regex

    text, words = text or "", words_in(text)
    marks = [len(regex.findall(p, text)) for p in quality.CLASSES.values()] + [len(text) - sum(map(len, words))]
    own = Counter(words)
    return [*marks, len(text) - sum(marks)], [own[w] for w in listed], len(words)


def distance(p, q):
    p, q = [a for a, b in zip(p, q) if b], [b for b in q if b]
    p, q = p + [max(0, 1 - sum(p))], q + [max(0, 1 - sum(q))]
    js = sum((a * math.log2(2 * a / (a + b)) if a else 0) + (b * math.log2(2 * b / (a + b)) if b else 0) for a, b in zip(p, q)) / 2
    return math.sqrt(max(0, js))


def brute(rows, **limits):
    """kept of each (doc_id, lang, text)."""
    langs, listed = {}, common_words(rows)
    for _, lang, text in rows:
        if lang is not None:
            c, w, n = histograms(text, listed)
            old = langs.setdefault(lang, ([0] * 5, [0] * len(w), 0))
            langs[lang] = ([a + b for a, b in zip(old[0], c)], [a + b for a, b in zip(old[1], w)], old[2] + n)
    refs = [([x / sum(c) for x in c], [x / n for x in w]) for c, w, n in langs.values() if n]
    out = {}
    for i, _, text in rows:
        n_words, *_, repeats = base(text)
        c, w, n = histograms(text, listed)
        good = n_words >= 50 and 100 * repeats <= 50 * n_words
        if good and sum(c) >= 200:
            good &= min(distance([x / sum(c) for x in c], r) for r, _ in refs) <= 0.28
        if good and n >= 100:
            good &= min(distance([x / n for x in w], r) for _, r in refs) <= 0.45
        out[i] = good
    return out


def test_query_against_brute_force(spark):
    docs = [(d["doc_id"], d["lang"], d["text"]) for d in read_table(spark, SF, "documents").collect()]
    want = brute(docs)
    rows = {r["doc_id"]: r for r in op9_quality_rules(spark, SF).collect()}
    assert len(rows) == len(docs)
    for i, _, text in docs:
        r = rows[i]
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == base(text)
        assert r["kept"] == want[i], i


@pytest.mark.parametrize("text", ["a b c a b c a", "a b a b a b a b", "x " * 200, "a b c", "a a a", "one two three four", " ".join(f"{k % 50} q{k // 3}" for k in range(300))])
def test_repeated_windows(spark, text):
    (row,) = quality.quality_features(spark.createDataFrame([(1, text)], "doc_id long, text string"), ["a", "x"]).collect()
    assert row["n_repeat_words"] == base(text)[4]


def test_edge_rows(spark):
    docs = edge_docs(spark, ("n_words", "kept", "q_runs", "_q_words"))
    rows = quality.quality_rules(docs).collect()
    assert len(rows) == 12
    for r in rows:
        assert (r["n_words"], r["n_repeat_words"]) == (base(r["text"])[0], base(r["text"])[4]) and r["_q_words"] == "own"
        assert r["kept"] is not None and (r["n_words"] or not r["kept"])
    assert quality.quality_rules(no_docs(spark)).count() == 0 and quality.keep_good(no_docs(spark)).count() == 0
    assert quality.keep_good(docs).columns == docs.columns


def test_no_language_is_pooled(spark):
    rows = [(f"l{k}", f"w{k} " * 60 + f"v{k}") for k in range(40)]
    listed, references = quality.language_references(spark.createDataFrame(rows, "lang string, text string"))
    assert len(references) == 40 and {f"w{k}" for k in range(40)} <= set(listed)


def test_junk_goes_and_prose_stays(spark):
    prose = "the cat and the dog sat on the mat for an hour but it was not in the house as they have said to be with this of that " * 1
    rows = [(k, "en", " ".join(f"{prose} number{k} of{k * 7} things{k * 3}".split())) for k in range(20)]
    rows = [(k, lang, " ".join(text.split() + [f"w{k}_{j}" for j in range(100)])) for k, lang, text in rows]
    rows.append((99, "en", " ".join("@#$%^&*(){}[]<>"[j % 15] * 3 + str(j) for j in range(300))))
    kept = {r["doc_id"]: r["kept"] for r in quality.quality_rules(spark.createDataFrame(rows, "doc_id long, lang string, text string")).collect()}
    assert not kept[99] and all(kept[k] for k in range(20))
