"""Language identification: sparse multinomial logistic regression on TF-IDF of character n-grams.

Document frequencies are counted over all learnable rows. The weights are fitted by follow-the-regularised-leader with
an elastic-net penalty (proximal, per coordinate, so that most weights are exactly zero) on a bounded sample, and a
temperature is fitted on rows of the sample that the weights were not fitted on.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from capstrata.llm import ngrams
from capstrata.llm.common import in_parts, read_table
from capstrata.llm.ngrams import Grams, Layout

#: At most so many rows of each language are fitted on; the first by a hash of their id.
SAMPLE_PER_LANGUAGE = 700
GRAMS = Grams(chars=(1, 2, 3), words=(), bits=14)
ALPHA, BETA, L1, L2 = 0.5, 1.0, 2e-4, 1e-4
UNKNOWN = "und"


def normalised(text: str | None) -> str:
    return (text or "").lower()


def document_frequencies(texts: DataFrame) -> tuple[int, np.ndarray]:
    """(rows, rows that hold each bucket) over all rows of `text`; a partition sends one vector of bounded size."""

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, rows = np.zeros(GRAMS.size, np.int64), 0
        held = np.zeros(GRAMS.size, bool)
        for batch in in_parts(it):
            values = [normalised(t) for t in batch.column(0).to_pylist()]
            rows += len(values)
            for start, stop in ngrams.chunks(values):
                columns = [(first, buckets, s, e) for first, buckets, s, e in GRAMS.columns(Layout.of(values[start:stop]))]
                for i in range(stop - start):
                    held[:] = False
                    for first, buckets, s, e in columns:
                        held[first + buckets[s[i] : e[i]]] = True
                    total += held
        if rows:
            some = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([[-1], some])), pa.array(np.concatenate([[rows], total[some]]))], names=["bucket", "n"])

    counted = texts.select(F.col("text").cast("string")).mapInArrow(batches, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))
    out, rows = np.zeros(GRAMS.size, np.int64), 0
    for r in counted.collect():  # 2**bits rows for each order at most
        if r.bucket < 0:
            rows = r.n
        else:
            out[r.bucket] = r.n
    return rows, out


@dataclass
class LanguageModel:
    """weights: (buckets, languages), each bucket's inverse document frequency included."""

    languages: list[str]
    weights: np.ndarray
    bias: np.ndarray
    temperature: float = 1.0

    def predict(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The place of the likeliest language of each text, and its calibrated probability."""
        z = (GRAMS.scores(Layout.of(texts), self.weights) + self.bias) / self.temperature
        z -= z.max(axis=1, keepdims=True)
        p = np.exp(z)
        p /= p.sum(axis=1, keepdims=True)
        best = p.argmax(axis=1)
        return best, p[np.arange(len(best)), best]


def sample(learnable: DataFrame, languages: list[str], per_language: int = SAMPLE_PER_LANGUAGE) -> list:
    """(language, columns, shares) of a bounded number of rows of each language, in a fixed order.

    One pass over ids and languages: each task keeps the first so many of a language before they meet.
    """
    rank = F.row_number().over(Window.partitionBy("lang").orderBy("order", "doc_id"))
    ids = learnable.where("doc_id is not null").select("lang", "doc_id", F.xxhash64("doc_id").alias("order")).withColumn("rank", rank).where(F.col("rank") <= per_language)
    chosen = ids.select("doc_id").distinct().limit(per_language * max(1, len(languages)))  # no more than that are there
    rows = learnable.join(F.broadcast(chosen), "doc_id").select("doc_id", "lang", "text")

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in in_parts(it):
            made = [GRAMS.sparse(normalised(t)) for t in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([c.tobytes() for c, _ in made], pa.binary()), pa.array([s.tobytes() for _, s in made], pa.binary())], names=["doc_id", "lang", "columns", "shares"])

    made = rows.mapInArrow(batches, "doc_id long, lang string, columns binary, shares binary").collect()
    keyed = sorted(made, key=lambda r: (zlib.crc32(str(r.doc_id).encode()), r.doc_id, r.lang, r.columns, r.shares))
    return [(r.lang, np.frombuffer(r.columns, np.int32), np.frombuffer(r.shares, np.float32)) for r in keyed]


def fit(rows: list, languages: list[str], total: int, frequencies: np.ndarray, epochs: int = 3) -> LanguageModel:
    """Per-coordinate FTRL over four fifths of the rows, a temperature over the rest."""
    k = len(languages)
    idf = np.log((1 + total) / (1 + frequencies)) + 1
    of = {lang: i for i, lang in enumerate(languages)}
    held = np.arange(len(rows)) % 5 == 4
    z, n = np.zeros((GRAMS.size, k)), np.zeros((GRAMS.size, k))
    zb, nb = np.zeros(k), np.zeros(k)
    scale = 30.0  # shares are small; this puts a text's features near unit length

    def weights(z_: np.ndarray, n_: np.ndarray, l1: float = L1) -> np.ndarray:
        return np.where(np.abs(z_) <= l1, 0.0, -(z_ - np.sign(z_) * l1) / ((BETA + np.sqrt(n_)) / ALPHA + L2))

    for _ in range(epochs):
        for i in np.flatnonzero(~held):
            lang, columns, shares = rows[i]
            x = shares * idf[columns] * scale
            w, b = weights(z[columns], n[columns]), weights(zb, nb, 0.0)
            s = x @ w + b
            p = np.exp(s - s.max())
            p /= p.sum()
            p[of[lang]] -= 1
            g = x[:, None] * p
            sigma = (np.sqrt(n[columns] + g * g) - np.sqrt(n[columns])) / ALPHA
            z[columns] += g - sigma * w
            n[columns] += g * g
            sigma_b = (np.sqrt(nb + p * p) - np.sqrt(nb)) / ALPHA
            zb += p - sigma_b * b
            nb += p * p
    model = LanguageModel(languages, (weights(z, n) * idf[:, None] * scale).astype(np.float32), weights(zb, nb, 0.0))
    test = np.flatnonzero(held)
    if len(test):
        scores = np.array([rows[i][2] @ model.weights[rows[i][1]] for i in test]) + model.bias
        truth = np.array([of[rows[i][0]] for i in test])

        def loss(t: float) -> float:
            s = scores / t
            s = s - s.max(axis=1, keepdims=True)
            # targets are smoothed as in Platt's method, so that rows without an error give a finite temperature
            rest = 1 / (len(s) + 2)
            return float((np.log(np.exp(s).sum(axis=1)) - (1 - rest) * s[np.arange(len(s)), truth] - rest * s.mean(axis=1)).sum())

        model.temperature = min(np.exp(np.linspace(np.log(0.05), np.log(20), 120)), key=loss)
    return model


def train(learnable: DataFrame, per_language: int = SAMPLE_PER_LANGUAGE) -> LanguageModel:
    """learnable: doc_id, text, lang. Rows without lang teach nothing."""
    learnable = learnable.where("lang is not null")
    languages = sorted(r.lang for r in learnable.select("lang").distinct().collect())
    if not languages:
        return LanguageModel([], np.zeros((GRAMS.size, 0), np.float32), np.zeros(0))
    total, frequencies = document_frequencies(learnable)
    return fit(sample(learnable, languages, per_language), languages, total, frequencies)


def predict(docs: DataFrame, model: LanguageModel) -> DataFrame:
    """(doc_id, lang_pred, score) of each row; `und` and 0 for a null text, one without a letter, and a model that knows no language.

    Repeated rows are judged alike; further columns are left out.
    """

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in in_parts(it):
            raw = batch.column(1).to_pylist()
            texts = [normalised(t) for t in raw]
            names, scores = [UNKNOWN] * len(raw), np.zeros(len(raw))
            for start, stop in ngrams.chunks(texts):
                if not model.languages:
                    break
                best, p = model.predict(texts[start:stop])
                for i in range(start, stop):
                    if any(map(str.isalpha, raw[i] or "")):
                        names[i], scores[i] = model.languages[best[i - start]], p[i - start]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(names, pa.string()), pa.array(scores)], names=["doc_id", "lang_pred", "score"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(batches, "doc_id long, lang_pred string, score double")


def fold(doc_id: Column, folds: int) -> Column:
    """The remainder of the CRC-32 of an id's text."""
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(folds))


def op9_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document. Null texts and those without a letter are `und`; rows without lang teach nothing;
    repeated rows are judged alike; no rows, no result.
    """
    docs = read_table(spark, sf_dir, "documents")
    model = train(docs.where(fold(F.col("doc_id"), 3) != 1).select("doc_id", "text", "lang"))
    found = predict(docs, model)
    return found.select("doc_id", (fold(F.col("doc_id"), 3) == 1).alias("held_out"), "lang_pred", "score")
