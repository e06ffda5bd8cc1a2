"""Language identification with blended-spectrum string kernels.

The kernel of two texts is the sum over n = 1, 2, 3 of the number of hashed n-grams present in both, divided by the geometric mean
of the numbers present in each. Nyström's method expresses it by ``landmarks`` texts; one-versus-rest kernel ridge regression is
fitted on that representation, and texts are scored in batches by matrix products with the landmarks and the fitted weights.

The fit uses a bounded sample: of every label about ``per_language`` texts, fewer where ``sample_rows`` of all of them would be exceeded,
but at least about two, chosen by a hash of the id; only their packed n-gram bits reach the driver. No label is left out, however
many there are. Every text is scored whole, row by row, without a shuffle.

Defined results
---------------
* Texts that are null or have no letter: ``und`` with score 0. So is every text where nothing could be learned.
* Null labels and null ids teach nothing. Repeated rows get equal predictions; extra columns pass through.
* The score is the winner's regression value brought from [-1, 1] to [0, 1] and clipped; ties go to the smaller label.
* Texts are taken whole, however long: their n-grams are counted present or absent. An empty table gives an empty result.
"""

from __future__ import annotations

import json
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Buckets for n-grams of one, two and three characters, side by side in one row of bits.
BUCKETS = (1024, 4096, 11264)
OFFSETS = (0, 1024, 5120)
DIM = 16384
UNKNOWN = "und"
LETTER = re.compile(r"[^\W\d_]")


def has_letter(text: str | None) -> bool:
    return any(m.group().isalpha() for m in LETTER.finditer(text or ""))


def presence(text: str) -> np.ndarray:
    """Which buckets the text's n-grams fall into, over the whole text in lower case."""
    codes = np.frombuffer(text.lower().encode("utf-32-le", "replace"), np.uint32).astype(np.uint64)
    out = np.zeros(DIM, bool)
    gram = codes
    for n, (size, offset) in enumerate(zip(BUCKETS, OFFSETS)):
        if n:
            if len(gram) < 2:
                break
            gram = gram[:-1] * np.uint64(0x9E3779B97F4A7C15) + codes[n:]
        mixed = (gram ^ (gram >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
        out[offset + ((mixed >> np.uint64(32)) % np.uint64(size)).astype(np.int64)] = True
    return out


def normalised(bits: np.ndarray) -> np.ndarray:
    """Rows whose inner products are the kernel: each block of n-grams has length 1."""
    x = bits.astype(np.float32)
    for size, offset in zip(BUCKETS, OFFSETS):
        block = x[:, offset : offset + size]
        block /= np.sqrt(np.maximum(1, block.sum(axis=1, keepdims=True)))
    return x


class Classifier:
    """Landmarks and the weights that turn kernel values into one score per language."""

    def __init__(self, languages: list[str], landmarks: np.ndarray, weights: np.ndarray):
        self.languages, self.landmarks, self.weights = languages, landmarks, weights

    @classmethod
    def fit(cls, bits: np.ndarray, labels: list[str], landmarks: int = 128, ridge: float = 1e-2) -> Classifier:
        languages = sorted(set(labels))
        of = np.searchsorted(languages, labels)
        share = max(1, landmarks // len(languages))
        chosen = np.concatenate([np.flatnonzero(of == k)[:share] for k in range(len(languages))])
        marks = normalised(bits[chosen])
        # Nystroem: phi(x) = K(x, marks) K(marks, marks)^(-1/2); ridge regression of -1/1 targets on phi and a constant.
        values, vectors = np.linalg.eigh((marks @ marks.T).astype(np.float64))
        root = vectors @ np.diag(1 / np.sqrt(np.maximum(values, 1e-6 * values.max()))) @ vectors.T
        kernel = np.vstack([normalised(bits[k : k + 256]) @ marks.T for k in range(0, len(bits), 256)])
        phi = np.hstack([kernel @ root, np.ones((len(bits), 1))])
        goal = np.where(of[:, None] == np.arange(len(languages)), 1.0, -1.0)
        # Each language counts the same, however many texts it has.
        weight = (1 / np.bincount(of, minlength=len(languages)))[of][:, None] * len(bits) / len(languages)
        fitted = np.linalg.solve(phi.T @ (weight * phi) + ridge * len(bits) * 1e-2 * np.eye(phi.shape[1]), phi.T @ (weight * goal))
        return cls(languages, marks, np.vstack([root @ fitted[:-1], fitted[-1:]]).astype(np.float32))

    def scores(self, bits: np.ndarray) -> np.ndarray:
        kernel = normalised(bits) @ self.landmarks.T
        return kernel @ self.weights[:-1] + self.weights[-1]

    def predict(self, texts: list[str | None], batch: int = 256) -> tuple[list[str], list[float]]:
        names, sure = [UNKNOWN] * len(texts), [0.0] * len(texts)
        places = [k for k, t in enumerate(texts) if has_letter(t)]
        for start in range(0, len(places), batch):
            part = places[start : start + batch]
            found = self.scores(np.stack([presence(texts[k]) for k in part]))
            best = found.argmax(axis=1)
            for k, b, s in zip(part, best, found[np.arange(len(part)), best]):
                names[k], sure[k] = self.languages[b], float(min(1.0, max(0.0, (s + 1) / 2)))
        return names, sure


def fit(df: DataFrame, may_learn: Column, text: str, lang: str, id_col: str, per_language: int = 600, sample_rows: int = 24_000, landmarks: int = 128) -> Classifier | None:
    """A classifier from a bounded sample of the rows that may_learn."""
    rows = df.where(may_learn & F.col(lang).isNotNull() & F.col(id_col).isNotNull() & F.col(text).isNotNull())
    counts = rows.groupBy(F.col(lang).cast("string").alias("lang")).count().collect()  # one row per label
    if not counts:
        return None
    each = max(2.0, min(per_language, sample_rows / len(counts)))
    shares = F.from_json(F.lit(json.dumps({r["lang"]: each / r["count"] for r in counts})), "map<string,double>")
    # A hash between 0 and 1; of each language the rows below its share, about per_language of them.
    draw = F.shiftrightunsigned(F.xxhash64(F.col(id_col), F.lit("sample")), 11) / float(1 << 53)
    rows = rows.where(draw < F.element_at(shares, F.col(lang).cast("string")))
    rows = rows.select(F.col(lang).cast("string").alias("lang"), F.col(text).alias("text"), draw.alias("draw"))

    def bits(batches):
        for batch in batches:
            texts = batch.column(1).to_pylist()
            packed = [np.packbits(presence(t)).tobytes() if has_letter(t) else None for t in texts]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(packed, pa.binary())], names=["lang", "draw", "bits"])

    found = [r for r in rows.mapInArrow(bits, "lang string, draw double, bits binary").collect() if r["bits"] is not None]
    if not found:
        return None
    found.sort(key=lambda r: (r["lang"], r["draw"], r["bits"]))
    unpacked = np.stack([np.unpackbits(np.frombuffer(r["bits"], np.uint8)) for r in found]).astype(bool)
    return Classifier.fit(unpacked, [r["lang"] for r in found], landmarks)


def identify(df: DataFrame, model: Classifier | None, text: str = "text") -> DataFrame:
    """df with lang_pred and score, replacing columns of these names."""
    df = df.drop(*({"lang_pred", "score"} - {text}))
    if model is None:
        return df.withColumns({"lang_pred": F.lit(UNKNOWN), "score": F.lit(0.0)})
    shared, place = df.sparkSession.sparkContext.broadcast(model), df.columns.index(text)

    def run(batches):
        for batch in batches:
            names, sure = shared.value.predict(batch.column(place).cast(pa.string()).to_pylist())
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(names, pa.string()), pa.array(sure, pa.float64())], names=[*batch.schema.names, "lang_pred", "score"])

    added = [T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())]
    return df.mapInArrow(run, T.StructType([*df.schema.fields, *added]))
