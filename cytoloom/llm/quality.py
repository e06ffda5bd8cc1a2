"""Quality rules by distribution divergence, with DataFrame functions only.

A document is compared with language references in two histograms: character classes, and common words against all other words.
The distance is the square root of the Jensen-Shannon divergence to base 2, from 0 to 1. References come from the corpus itself: one
per value of the language column, over all its rows and whole texts. Common words are learned as well: of each language the
``common`` most frequent words of at most ``longest`` code points (function words are short), ties by code point; the histograms
have the words of all languages.

Scale: two aggregations with map-side combine make the references, and one pass judges; texts are never shuffled. What reaches the
driver is a few numbers and words for each language.

Defined results
---------------
* Null, empty and blank texts: no words, every count 0, base rules fail, not kept.
* Null language: such rows build no reference; a document is compared with every reference and the nearest counts,
  so its own label plays no part. Every language has a reference of its own, however many there are.
* No reference at all (empty table, or all labels null): the base rules alone decide.
* Repeated rows are judged alike; extra columns stay untouched.
* Texts are taken whole, however long. An empty table gives an empty result.
"""

from __future__ import annotations

import json
import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import SPACES, free_name, materialize, words_of

MAX_WORD_DISTANCE = 0.45

#: Character classes counted by pattern; white space and all other characters are the two classes that remain.
CLASSES = {"upper": r"\p{Lu}", "digit": r"\p{Nd}", "mark": r"[\p{P}\p{S}]"}
SYMBOLS = r"[#*$%&|<>]"
FEATURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "q_classes", "q_runs")
VERDICTS = ("base_failed", "class_distance", "word_distance", "kept")
def word_features(words: Column, text: Column) -> dict[str, Column]:
    """The base counts of a text; words is a column that holds words_of(text)."""
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    return {
        "n_words": F.size(words).cast("long"),
        "word_chars": F.length(F.array_join(words, "")).cast("long"),
        "n_symbols": F.regexp_count(text, F.lit(SYMBOLS)).cast("long"),
        "n_dup_lines": (F.size(lines) - F.size(F.array_distinct(lines))).cast("long"),
    }


def with_repeated_words(df: DataFrame, grams: str, out: str, name, width: int = 3, few_repeats: int = 32) -> DataFrame:
    """Add the number of words inside windows found at least twice; grams names a column with the windows' hashes in order.

    Equal neighbours in sorted order are the repeats. A few repeated hashes are looked up for each window; where there are more,
    the windows are sorted together with their places. Either way gives the same places. A window covers its words up to the next repeated window. Each array that a
    lambda looks into is a column of its own: as an expression it would be built again for every element.
    """
    twice, order, at = name("twice"), name("order"), name("at")
    ordered = F.sort_array(grams)
    df = df.withColumn(order, F.when(F.size(F.array_distinct(grams)) < F.size(grams), ordered))
    df = df.withColumn(twice, F.array_distinct(F.filter(order, lambda h, i: F.coalesce(F.get(F.col(order), i + 1) == h, F.lit(False)))))
    few = F.size(twice) <= few_repeats
    pairs = F.sort_array(F.transform(grams, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    df = df.withColumn(order, F.when(~few, pairs))
    same = lambda j, x: F.coalesce(F.get(F.col(order), j)["h"] == x["h"], F.lit(False))
    many = F.sort_array(F.transform(F.filter(order, lambda x, j: same(j - 1, x) | same(j + 1, x)), lambda x: x["i"]))
    places = F.transform(grams, lambda h, i: F.when(F.array_contains(F.col(twice), h), i))
    df = df.withColumn(at, F.when(few, F.filter(places, lambda i: i.isNotNull())).otherwise(many))
    gaps = F.transform(at, lambda p, j: F.coalesce(F.least(F.lit(width), F.get(F.col(at), j + 1) - p), F.lit(width)))
    total = F.coalesce(F.aggregate(gaps, F.lit(0), lambda a, x: a + x), F.lit(0))
    return df.withColumn(out, total.cast("long")).drop(twice, order, at)


def quality_features(df: DataFrame, listed: list[str], text: str = "text") -> DataFrame:
    """Add the base counts, the class counts and the runs of common words; one pass, no shuffle.

    q_classes: characters by class (upper case, digits, marks, white space, all others). q_runs: (k, n) for each word of the list in
    the text, by its place in the list.
    """
    inner = {}
    name = lambda k: inner.setdefault(k, free_name(df, f"_q_{k}"))
    df = df.drop(*(set(FEATURES) - {text}))
    body, words = F.coalesce(F.col(text), F.lit("")), name("words")
    out = df.withColumn(words, words_of(F.col(text)))
    out = out.withColumns(word_features(F.col(words), body))
    marks = [F.regexp_count(body, F.lit(v)).cast("long") for v in CLASSES.values()]
    space = F.length(body) - F.col("word_chars")
    gram = lambda i: F.xxhash64(*[F.get(F.col(words), i + k) for k in range(3)])
    windows = F.transform(F.sequence(F.lit(0), (F.col("n_words") - 3).cast("int")), gram)
    out = out.withColumns(
        {
            name("marks"): F.array(*marks, space),
            name("grams"): F.when(F.col("n_words") > 3, windows),
            name("hits"): F.sort_array(F.filter(words, lambda w: w.isin(*listed))) if listed else F.array().cast("array<string>"),
        }
    )
    hits, all_marks = F.col(name("hits")), [F.get(F.col(name("marks")), F.lit(k)) for k in range(4)]
    ends = F.filter(F.sequence(F.lit(1), F.size(hits)), lambda i: F.coalesce(F.get(hits, i) != F.get(hits, i - 1), F.lit(True)))
    rest = F.length(body) - sum(all_marks[1:], all_marks[0])
    out = out.withColumns({"q_classes": F.array(*all_marks, rest), name("ends"): F.when(F.size(hits) > 0, ends).otherwise(F.array().cast("array<int>"))})
    ends, places = F.col(name("ends")), F.array(*[F.lit(w) for w in listed]) if listed else F.array().cast("array<string>")
    run = lambda e, j: F.struct(
        (F.array_position(places, F.get(hits, e - 1)) - 1).cast("int").alias("k"), (e - F.coalesce(F.get(ends, j - 1), F.lit(0))).alias("n")
    )
    out = out.withColumn("q_runs", F.transform(ends, run))
    return with_repeated_words(out, name("grams"), "n_repeat_words", name).drop(*inner.values())


def language_references(df: DataFrame, text: str = "text", lang: str = "lang", common: int = 24, longest: int = 5) -> tuple[list[str], list[dict]]:
    """(listed, references): all languages' common words, and for each language its shares of character classes and of those words."""
    body = F.coalesce(F.col(text), F.lit(""))
    rows = df.where(F.col(lang).isNotNull()).select(F.col(lang).cast("string").alias("lang"), body.alias("text"))
    counts = [F.regexp_count("text", F.lit(v)) for v in CLASSES.values()]
    inside = F.length(F.regexp_replace("text", SPACES, ""))
    n_words = F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]+"))
    sums = rows.groupBy("lang").agg(F.sum(n_words).alias("n"), F.sum(F.length("text")).alias("chars"), F.sum(inside).alias("inside"), *[F.sum(c).alias(f"c{k}") for k, c in enumerate(counts)])
    sums = sorted(sums.where("n > 0").collect(), key=lambda r: r["lang"])  # one row per language
    if not sums:
        return [], []
    short = rows.select("lang", F.explode(F.filter(words_of(F.col("text")), lambda w: F.length(w) <= longest)).alias("word"))
    short = short.groupBy("lang", "word").agg(F.count("*").alias("n"))
    place = F.row_number().over(W.partitionBy("lang").orderBy(F.desc("n"), "word"))
    short = materialize(short)
    listed = sorted({r["word"] for r in short.withColumn("place", place).where(F.col("place") <= common).select("word").distinct().collect()})
    seen: dict[str, dict[str, int]] = {}
    for r in short.where(F.col("word").isin(*listed)).collect():  # languages x listed words
        seen.setdefault(r["lang"], {})[r["word"]] = r["n"]
    references = []
    for r in sums:
        classes = [r["c0"], r["c1"], r["c2"], r["chars"] - r["inside"]]
        classes.append(r["chars"] - sum(classes))
        words = [seen.get(r["lang"], {}).get(w, 0) / r["n"] for w in listed]
        references.append({"lang": r["lang"], "classes": [c / r["chars"] for c in classes], "words": words, "every": math.fsum(words)})
    return listed, references


REFERENCES = "array<struct<classes:array<double>,words:array<double>,every:double>>"


def _plogp(p: Column, m: Column) -> Column:
    return F.when(p > 0, p * F.log2(p / m)).otherwise(F.lit(0.0))


def _both(p: Column, q: Column) -> Column:
    return _plogp(p, (p + q) / 2) + _plogp(q, (p + q) / 2)


def _distance(divergence: Column) -> Column:
    return F.sqrt(F.greatest(F.lit(0.0), divergence / 2))


def class_distance(shares: Column, reference: Column) -> Column:
    """Jensen-Shannon distance of an array of shares from a reference."""
    return F.aggregate(F.zip_with(shares, reference["classes"], _both), F.lit(0.0), lambda a, x: a + x, _distance)


def word_distance(runs: Column, n_words: Column, reference: Column) -> Column:
    """Jensen-Shannon distance of a document's common words from a reference; the words that the reference lacks form one class with all others.

    Words that the reference has and the document lacks give their share, so that only the document's runs are walked.
    """
    own = F.transform(runs, lambda r: F.struct((r["n"] / n_words).alias("p"), F.get(reference["words"], r["k"]).alias("q")))
    start = F.struct(F.lit(0.0).alias("js"), F.lit(0.0).alias("p"), F.lit(0.0).alias("q"))
    plus = lambda a, r: F.struct((a["js"] + _both(r["p"], r["q"])).alias("js"), (a["p"] + r["p"]).alias("p"), (a["q"] + r["q"]).alias("q"))
    rest = lambda x: F.greatest(F.lit(0.0), 1 - x)
    done = lambda s: _distance(s["js"] + (reference["every"] - s["q"]) + _both(rest(s["p"]), rest(reference["every"])))
    return F.aggregate(own, start, lambda a, r: F.when(r["q"] > 0, plus(a, r)).otherwise(a), done)


def quality_verdicts(
    features: DataFrame,
    references: list[dict],
    min_words: int = 50,
    max_repeat_percent: int = 50,
    max_class_distance: float = 0.28,
    max_word_distance: float = MAX_WORD_DISTANCE,
    min_chars_for_classes: int = 200,
    min_words_for_words: int = 100,
) -> DataFrame:
    """Add base_failed, class_distance, word_distance and kept to the columns of quality_features().

    base_failed: fewer than min_words words, or more than max_repeat_percent % of the words in repeated 3-word windows.
    Otherwise a document is rejected if its distance to the nearest reference exceeds a limit; each distance counts only for
    documents of a minimum length, as short histograms are noise. The distances are null where no reference exists.
    """
    failed = (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > max_repeat_percent * F.col("n_words"))
    out = features.withColumn("base_failed", failed)
    if not references:
        none = F.lit(None).cast("double")
        return out.withColumns({"class_distance": none, "word_distance": none, "kept": ~F.col("base_failed")})
    chars = F.aggregate("q_classes", F.lit(0).cast("long"), lambda a, x: a + x)
    made = F.from_json(F.lit(json.dumps([{k: r[k] for k in ("classes", "words", "every")} for r in references])), REFERENCES)
    nearest = lambda f: F.array_min(F.transform(made, f))
    total, shares = free_name(features, "_q_chars"), free_name(features, "_q_shares")
    out = out.withColumn(total, chars)
    out = out.withColumn(shares, F.when(F.col(total) > 0, F.transform("q_classes", lambda c: c / F.col(total))))
    by_class = nearest(lambda r: class_distance(F.col(shares), r))
    by_word = nearest(lambda r: word_distance(F.col("q_runs"), F.col("n_words"), r))
    out = out.withColumns({"class_distance": F.when(F.col(total) > 0, by_class), "word_distance": F.when(F.col("n_words") > 0, by_word)})
    odd = ((F.col(total) >= min_chars_for_classes) & (F.col("class_distance") > max_class_distance)) | (
        (F.col("n_words") >= min_words_for_words) & (F.col("word_distance") > max_word_distance)
    )
    return out.withColumn("kept", ~F.col("base_failed") & ~F.coalesce(odd, F.lit(False))).drop(total, shares)


def quality_rules(df: DataFrame, text: str = "text", lang: str = "lang", references: tuple[list[str], list[dict]] | None = None, **limits) -> DataFrame:
    """df with the base counts, base_failed, class_distance, word_distance and kept; references are built from df if not given.

    Columns of these names that df has already are replaced.
    """
    listed, known = references or language_references(df, text, lang)
    features = quality_features(df, listed, text)
    return quality_verdicts(features.drop(*(set(VERDICTS) - {text, lang})), known, **limits).drop("q_classes", "q_runs")


def keep_good(df: DataFrame, text: str = "text", lang: str = "lang", **how) -> DataFrame:
    """The rows of df that the rules keep, with the columns of df; those that clash with the rules' own come back as they were.

    The filter refers to a row number, so that Spark doesn't push it below the columns that it rests on and compute them again.
    """
    added = {c.lower() for c in (*FEATURES, *VERDICTS)}
    aside = {c: f"_q_own_{k}" for k, c in enumerate(df.columns) if c.lower() in added and c not in (text, lang)}
    judged, row = quality_rules(df.withColumnsRenamed(aside), text, lang, **how), free_name(df, "_q_row")
    judged = judged.withColumn(row, F.monotonically_increasing_id())
    return judged.where(F.col("kept") & (F.col(row) >= 0)).select(*[F.col(aside.get(c, c)).alias(c) for c in df.columns])
