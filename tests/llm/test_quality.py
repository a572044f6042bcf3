"""Quality rules: counts against a plain version, the classifier on rows it has not seen."""

import re
import tracemalloc
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from capstrata.llm import ngrams, quality

SF = "/root/testdata/sf0.01"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain(text):
    text = text or ""
    words = WORD.findall(text)
    windows = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    n = Counter(windows)
    repeated = {i + k for i, w in enumerate(windows) if n[w] > 1 for k in range(5)}
    lines = text.split("\n")
    dup = sum(1 for i, line in enumerate(lines) if WORD.search(line) and line in lines[:i])
    base = (len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), dup, len(repeated))
    return (*base, len(words) < 10 or 100 * len(repeated) > 20 * len(words))


def test_counts_match_the_plain_version():
    texts = ["", " \n\t", "a", "a b c d e a b c d e", "x\n\nx\n \n \nx y\nx", "ab\x00cd e\x00", "é ü z", "#*$%&|<> a", "a a a a a a a a a a a a", "one\rtwo\x0bthree\x0cfour", "w " * 700, "\U0001f600 b"]
    layout = ngrams.Layout.of(texts)
    found = quality.counts(texts, layout, ngrams.words(layout))
    bad = quality.failed(found["n_words"], found["n_repeat_words"])
    got = [(*(int(found[c][i]) for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")), bool(bad[i])) for i in range(len(texts))]
    assert got == [plain(t) for t in texts]


def test_query_counts_and_held_out_accuracy(spark):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    got = {r.doc_id: r for r in quality.op6_quality(spark, SF).collect()}
    assert got.keys() == docs.keys()
    for i, r in got.items():
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == plain(docs[i])
        assert not (r.kept and r.base_failed) and 0 <= r.good_probability <= 1


def test_classifier_on_unseen_rows(spark):
    base = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{base}/documents.parquet"), spark.read.parquet(f"{base}/labels.parquet")
    chosen = F.pmod(F.xxhash64("doc_id"), F.lit(4)) != 0
    model = quality.train(docs, labels.where(chosen), rows=1200)
    scored = quality.score(docs.join(labels.where(~chosen).select("doc_id"), "doc_id"), model).join(labels, "doc_id")
    rows = scored.where("not base_failed").collect()
    good = [r.kept for r in rows if r.quality == 1]
    bad = [r.kept for r in rows if r.quality == 0]
    assert sum(good) / len(good) > 0.98 and sum(bad) / len(bad) < 0.1


def test_nulls_empty_tables_and_clashing_columns(spark):
    docs = spark.createDataFrame([(1, None, "a"), (2, "", "b"), (3, "a b c d e f g h i j k l", "c"), (3, "a b c d e f g h i j k l", "c"), (None, "q " * 20, None)], "doc_id long, text string, kept string")
    labels = spark.createDataFrame([(3, 1, None), (1, None, 0), (None, 0, 0)], "doc_id long, quality int, toxic int")
    model = quality.train(docs, labels)
    out = quality.score(docs, model)
    assert sorted((r.doc_id or -1, r.n_words, r.base_failed, r.kept) for r in out.collect()) == [(-1, 20, True, False), (1, 0, True, False), (2, 0, True, False), (3, 12, False, True), (3, 12, False, True)]
    kept = quality.keep_good(docs, labels)
    assert kept.columns == docs.columns and kept.count() == 2
    assert quality.keep_good(docs.limit(0), labels.limit(0)).count() == 0
    assert quality.score(docs.limit(0), model).count() == 0


def test_very_long_text():
    text = "lorem ipsum dolor " * 200_000
    layout = ngrams.Layout.of([text])
    assert quality.counts([text], layout, ngrams.words(layout))["n_repeat_words"][0] == 600_000


def test_the_fit_needs_little_more_memory_than_its_entries():
    """Temporary arrays are as long as a part of the entries; parts of any size give the same model."""
    rng = np.random.default_rng(1)
    rows = []
    for i in range(600):
        n = int(rng.integers(1, 4000))
        rows.append((i % 3 == 0, np.sort(rng.choice(quality.GRAMS.size, n, replace=False)).astype(np.int32), rng.random(n).astype(np.float32)))
    tracemalloc.start()
    model = quality.fit(rows, epochs=3)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 25 * sum(len(r[1]) for r in rows)  # 61 before
    whole, quality._PART = quality._PART, 1
    try:
        assert np.array_equal(quality.fit(rows, epochs=3).weights, model.weights)
    finally:
        quality._PART = whole
