"""Decontamination against exact containment of every pair."""

import re

from pyspark.sql import functions as F

from capstrata.llm import decontaminate as d

SF = "/root/testdata/sf0.001"


def words_of(text):
    return [w for w in re.split(r"[\W_]+", (text or "").lower()) if w]


def runs(words, n):
    return {tuple(words[i : i + n]) for i in range(len(words) - n + 1)}


def plain(docs, items):
    """An item of fewer than five words is one run of them all."""
    asked = [(i, min(5, len(words_of(t))), words_of(t)) for i, t in items]
    asked = [(i, n, runs(w, n)) for i, n, w in asked if n]
    held = [(i, {n: runs(words_of(t), n) for n in range(1, 6)}) for i, t in docs]
    return {(a, b) for a, s in held for b, n, q in asked if len(q & s[n]) >= 0.8 * len(q)}


def test_query_finds_what_brute_force_finds(spark):
    docs = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    items = [tuple(r) for r in spark.read.parquet(f"{SF}/benchmark.parquet").select("item_id", "text").collect()]
    found = d.op3_decontaminate(spark, SF)
    assert {(r.doc_id, r.item_id) for r in found.collect()} == plain(docs, items)


def test_partial_copies_around_the_threshold(spark):
    words = [f"w{i}" for i in range(44)]  # 40 shingles
    docs = []
    for i, cut in enumerate((0, 4, 8, 9, 12, 20)):
        docs.append((i, "x " * 3000 + " ".join(words[cut:]) + " y" * 50))
    docs += [(10, "W0, w1; " + " ".join(words[2:]).upper()), (11, " ".join(words[::2]))]
    items = [(0, " ".join(words)), (1, "only four words here"), (2, None), (3, ""), (4, "one two three four five"), (5, "Lone"), (6, "two three"), (7, "three two"), (8, "not here at all")]
    docs += [(12, "zero one two three four five six"), (13, "one two three four"), (14, "a lone word, and: only four WORDS here!")]
    frames = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    for broadcast in (1_000_000, 0):
        found = d.contaminated(*frames, broadcast_shingles=broadcast)
        assert {(r.doc_id, r.item_id) for r in found.collect()} == plain(docs, items) == {(0, 0), (1, 0), (2, 0), (10, 0), (12, 4), (14, 1), (14, 5), (12, 6), (13, 6)}


def test_no_python_in_the_plan(spark):
    plan = d.op3_decontaminate(spark, SF)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


def test_nulls_repeats_empty_and_clashing_columns(spark):
    text = "alpha beta gamma delta epsilon zeta eta theta"
    docs = spark.createDataFrame([(1, text, 5), (1, text, 5), (2, None, 5), (None, text, 5), (3, "", 5)], "doc_id long, text string, item_id int").withColumn("hash", F.lit(1))
    items = spark.createDataFrame([(7, text, "b"), (7, text, "c")], "item_id long, text string, doc_id string")
    for broadcast in (1_000_000, 0):
        found = [(r.doc_id, r.item_id, r.containment) for r in d.contaminated(docs, items, broadcast_shingles=broadcast).collect()]
        assert sorted(found, key=str) == [(1, 7, 1.0), (None, 7, 1.0)]
    clean = d.remove_contaminated(docs, items)
    assert clean.columns == docs.columns and sorted(r.doc_id or 0 for r in clean.collect()) == [2, 3]
    assert d.contaminated(docs.limit(0), items).count() == 0 and d.contaminated(docs, items.limit(0)).count() == 0


def test_rows_are_judged_by_their_own_text(spark):
    text, other = "alpha beta gamma delta epsilon zeta eta theta", "quite another text without anything that a benchmark holds"
    docs = spark.createDataFrame([(1, text), (1, other), (None, text), (None, other), (2, "of its own")], "doc_id long, text string")
    items = spark.createDataFrame([(7, text)], "item_id long, text string")
    clean = sorted((r.doc_id or 0, r.text) for r in d.remove_contaminated(docs, items).collect())
    assert clean == [(0, other), (1, other), (2, "of its own")]
