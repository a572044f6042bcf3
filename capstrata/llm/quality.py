"""Quality rules: fixed limits on counts of a text, then a trained model of labelled quality.

The model is logistic regression on hashed n-grams of words and characters. It is fitted on a bounded sample of
labelled rows, its scores are calibrated to probabilities by Platt's method on rows it was not fitted on, and every
text is scored in Arrow batches against a fixed threshold.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from capstrata.llm import ngrams
from capstrata.llm.common import in_parts, read_table, release
from capstrata.llm.ngrams import Grams, Layout

#: At most so many labelled rows are fitted on; the first by a hash of their id.
SAMPLE_ROWS = 2400
#: A text is kept if its probability of good quality is at least this.
KEEP_FROM = 0.3
MIN_WORDS, MAX_REPEATED, WINDOW = 10, 0.2, 5
SYMBOLS = "#*$%&|<>"
GRAMS = Grams(chars=(1, 2, 3), words=(1, 2), bits=15)
#: Entries of rows that the fit works on at once.
_PART = 1 << 16
_COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def repeated_words(text: str) -> int:
    """Words that stand in a window of five words found twice or more in the text."""
    found = [w for w in text.translate(_BLANKS).split(" ") if w]
    windows = list(zip(*(found[i:] for i in range(WINDOW)), strict=False))
    often = {w for w, n in Counter(windows).items() if n > 1}
    covered = upto = 0
    for i, w in enumerate(windows):
        if w in often:
            covered += i + WINDOW - max(i, upto)
            upto = i + WINDOW
    return covered


_BLANKS = {c: " " for c in range(9, 14)}


def repeated_lines(text: str) -> int:
    """Lines with a word that equal an earlier line."""
    if "\n" not in text:
        return 0
    lines = text.split("\n")
    if len(set(lines)) == len(lines):
        return 0
    return sum(n - 1 for line, n in Counter(lines).items() if n > 1 and line.strip(" \t\n\r\x0b\x0c"))


def counts(texts: Sequence[str], layout: Layout, found: ngrams.Words) -> dict[str, np.ndarray]:
    """The five counts of each text."""
    points = layout.points
    symbol = np.zeros(128, np.int64)
    symbol[[ord(c) for c in SYMBOLS]] = 1
    out = {"n_words": found.ends - found.starts}
    out["word_chars"] = (layout.ends - layout.starts) - layout.sums(ngrams.spaces(points).astype(np.int64))
    zeros = layout.sums((points == 0).astype(np.int64))  # a zero inside a text is a character of a word
    out["n_symbols"] = layout.sums(np.where(points < 128, symbol[np.minimum(points, 127)], 0))
    out["n_dup_lines"] = np.fromiter(map(repeated_lines, texts), np.int64, len(texts))
    # equal windows have equal hashes: texts without an equal pair of hashes have no repeated window
    with np.errstate(over="ignore"):
        h = np.zeros(max(0, len(found.hashes) - WINDOW + 1), np.uint64)
        for k in range(WINDOW):
            h = h * np.uint64(0x9E3779B97F4A7C15) + found.hashes[k : k + len(h)]
        h ^= (found.texts[: len(h)].astype(np.uint64) + np.uint64(1)) * np.uint64(0xD6E8FEB86659FD93)
    whole = found.texts[: len(h)] == found.texts[WINDOW - 1 :] if len(h) else np.zeros(0, bool)
    h, owner = h[whole], found.texts[: len(whole)][whole]
    ordered = np.sort(h)
    twice = np.unique(ordered[1:][ordered[1:] == ordered[:-1]])
    repeats = np.zeros(len(texts), np.int64)
    if len(twice):
        at = np.minimum(np.searchsorted(twice, h), len(twice) - 1)
        for i in np.unique(owner[twice[at] == h]):
            repeats[i] = repeated_words(texts[i])
    out["n_repeat_words"] = repeats
    for i in np.flatnonzero(zeros):
        out["word_chars"][i] = sum(len(w) for w in texts[i].translate(_BLANKS).split(" "))
        out["n_words"][i] = sum(1 for w in texts[i].translate(_BLANKS).split(" ") if w)
        out["n_repeat_words"][i] = repeated_words(texts[i])
    return out


def failed(n_words: np.ndarray, n_repeat_words: np.ndarray) -> np.ndarray:
    return (n_words < MIN_WORDS) | (n_repeat_words > MAX_REPEATED * n_words)


@dataclass
class QualityModel:
    """weights and bias of the linear score, and the slope and offset that turn it into a probability."""

    weights: np.ndarray
    bias: float
    slope: float = 1.0
    offset: float = 0.0

    def probabilities(self, layout: Layout) -> np.ndarray:
        score = GRAMS.scores(layout, self.weights)[:, 0] + self.bias
        return ngrams.sigmoid(self.slope * score + self.offset)


def labelled_features(docs: DataFrame, labels: DataFrame, rows: int) -> list:
    """(good, columns, shares) of a bounded sample of labelled documents; features are made on the executors.

    A document with several labels has the least of them. Rows without a label or doc_id teach nothing.
    """
    sample = labels.where("quality is not null and doc_id is not null").groupBy("doc_id").agg(F.min("quality").cast("int").alias("good"))
    sample = sample.orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    joined = docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id")

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in in_parts(it):
            made = [GRAMS.sparse(t or "") for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array([c.tobytes() for c, _ in made], pa.binary()), pa.array([s.tobytes() for _, s in made], pa.binary())], names=["doc_id", "good", "columns", "shares"])

    made = joined.mapInArrow(batches, "doc_id long, good int, columns binary, shares binary").collect()
    # a fixed order, so that the same rows give the same model; repeated rows of a document count once
    return list({r.doc_id: (r.good, np.frombuffer(r.columns, np.int32), np.frombuffer(r.shares, np.float32)) for r in sorted(made, key=lambda r: (r.doc_id, r.columns, r.shares))}.values())


def _parts(ptr: np.ndarray) -> Iterator[tuple[slice, slice]]:
    """The rows in parts of bounded size, each with its entries: temporary arrays are as long as a part, not as all rows. A longer row is a part."""
    first = 0
    while first < len(ptr) - 1:
        last = max(first + 1, int(np.searchsorted(ptr, ptr[first] + _PART, "right")) - 1)
        yield slice(first, last), slice(int(ptr[first]), int(ptr[last]))
        first = last


def _owners(ptr: np.ndarray, some: slice) -> np.ndarray:
    """For each entry of these rows the row it belongs to, from 0."""
    return np.repeat(np.arange(some.stop - some.start), np.diff(ptr[some.start : some.stop + 1]))


def fit(rows: list, epochs: int = 60, l2: float = 1e-4) -> QualityModel:
    """Logistic regression by full-batch AdaGrad on four fifths of the rows, calibrated on the rest.

    No rows, or rows of one class only: a model that keeps all (or that follows the one class).
    """
    if not rows or len({r[0] for r in rows}) < 2:
        good = not rows or rows[0][0] == 1
        return QualityModel(np.zeros((GRAMS.size, 1), np.float32), 8.0 if good else -8.0)
    held = np.arange(len(rows)) % 5 == 4
    if len({r[0] for r, h in zip(rows, held, strict=True) if not h}) < 2:
        held[:] = False
    y = np.array([r[0] for r in rows], np.float64)
    ptr = np.concatenate([[0], np.cumsum([len(r[1]) for r in rows])])
    index, value = np.concatenate([r[1] for r in rows]), np.concatenate([r[2] for r in rows], dtype=np.float64)
    parts = list(_parts(ptr))
    square = np.zeros(GRAMS.size)
    for _, at in parts:
        np.add.at(square, index[at], value[at] * value[at])
    scale = 1 / (np.sqrt(square / len(rows)) + 1e-4)
    for _, at in parts:
        value[at] *= scale[index[at]]
    value /= np.sqrt(5 * 400)
    w, b = np.zeros(GRAMS.size), 0.0
    gw, gb = np.full(GRAMS.size, 1e-8), 1e-8
    balance = np.where(y == 1, 0.5 / max(1, (y[~held] == 1).sum()), 0.5 / max(1, (y[~held] == 0).sum()))
    balance[held] = 0

    def scores() -> np.ndarray:
        return np.concatenate([np.bincount(_owners(ptr, some), value[at] * w[index[at]], some.stop - some.start) for some, at in parts]) + b

    for _ in range(epochs):
        error = (ngrams.sigmoid(scores()) - y) * balance  # zero for held rows
        g = np.zeros(GRAMS.size)
        for some, at in parts:
            np.add.at(g, index[at], value[at] * error[some][_owners(ptr, some)])
        g += l2 * w
        gw += g * g
        gb += error.sum() ** 2
        w -= 0.3 * g / np.sqrt(gw)
        b -= 0.3 * error.sum() / np.sqrt(gb)
    model = QualityModel((w * scale / np.sqrt(5 * 400)).astype(np.float32)[:, None], b)
    z = scores()
    use = held if len({*y[held]}) == 2 else ~held
    slope, offset = platt(z[use], y[use])
    model.slope, model.offset = slope, offset
    return model


def platt(z: np.ndarray, y: np.ndarray, steps: int = 200) -> tuple[float, float]:
    """Slope and offset of the logistic curve through scores z, by Newton steps, with Platt's smoothed targets."""
    n1, n0 = (y == 1).sum(), (y == 0).sum()
    t = np.where(y == 1, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    a, b = 1.0, 0.0
    for _ in range(steps):
        p = ngrams.sigmoid(a * z + b)
        r, v = p - t, np.maximum(p * (1 - p), 1e-9)
        g = np.array([(r * z).sum() + 1e-3 * (a - 1), r.sum()])
        h = np.array([[(v * z * z).sum() + 1e-3, (v * z).sum()], [(v * z).sum(), v.sum() + 1e-9]])
        step = np.linalg.solve(h + 1e-6 * np.eye(2), g)
        a, b = a - step[0], b - step[1]
        if abs(step).max() < 1e-9:
            break
    return (float(a), float(b)) if a > 0 else (1.0, 0.0)


def train(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS) -> QualityModel:
    """The model of docs (doc_id, text) and labels (doc_id, quality: 1 good, 0 bad), from at most so many labelled documents.

    A null text is empty, repeated rows of a document count once. Without rows of both classes see fit().
    """
    found = labelled_features(docs, labels, rows)
    release(docs.sparkSession)  # the fit has the driver's memory to itself
    return fit(found)


def score(docs: DataFrame, model: QualityModel, keep_from: float = KEEP_FROM, carry: Sequence[str] = ("doc_id",)) -> DataFrame:
    """The columns in `carry`, then n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, good_probability, kept.

    docs needs `text`; a null text counts as empty and fails. Repeated rows are judged alike. Columns of the same
    names in docs are not carried unless named.
    """
    names = [*_COUNTS, "base_failed", "good_probability", "kept"]
    carried = [f.simpleString().replace(":", " ", 1) for f in docs.select(*carry).schema]

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in in_parts(it):
            texts = [t or "" for t in batch.column(len(carry)).to_pylist()]
            for start, stop in ngrams.chunks(texts):
                part = texts[start:stop]
                layout = Layout.of(part)
                found = counts(part, layout, ngrams.words(layout))
                bad = failed(found["n_words"], found["n_repeat_words"])
                p = model.probabilities(layout)
                columns = [batch.column(i).slice(start, stop - start) for i in range(len(carry))]
                columns += [pa.array(found[c].astype(np.int64)) for c in _COUNTS]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(bad), pa.array(p), pa.array(~bad & (p >= keep_from))], names=[*carry, *names])

    schema = ", ".join(carried) + ", " + ", ".join(f"{c} long" for c in _COUNTS) + ", base_failed boolean, good_probability double, kept boolean"
    return docs.select(*carry, F.col("text").cast("string").alias("__text")).mapInArrow(batches, schema)


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """docs without the rows that fail the limits or that the model rejects.

    A null or empty text fails; repeated rows are judged alike, rows without doc_id like others; the columns stay.
    """
    model = train(docs, labels)
    columns = docs.columns

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in in_parts(it):
            texts = [t or "" for t in batch.column(columns.index("text")).to_pylist()]
            kept = []
            for start, stop in ngrams.chunks(texts):
                part = texts[start:stop]
                layout = Layout.of(part)
                found = counts(part, layout, ngrams.words(layout))
                kept.append(~failed(found["n_words"], found["n_repeat_words"]) & (model.probabilities(layout) >= KEEP_FROM))
            if kept:
                yield batch.filter(pa.array(np.concatenate(kept)))

    return docs.mapInArrow(batches, docs.schema)


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and verdict of every document. Null and empty texts have no words and fail; repeated rows are judged alike;
    without labels the limits alone decide; no rows, no result.
    """
    docs = read_table(spark, sf_dir, "documents")
    model = train(docs, read_table(spark, sf_dir, "labels"))
    return score(docs.select("doc_id", "text"), model).select("doc_id", *_COUNTS, "base_failed", "kept", "good_probability")
