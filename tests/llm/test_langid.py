"""Language identification: held-out accuracy, sparsity, calibration, hard rows."""

import numpy as np
from pyspark.sql import functions as F

from capstrata.llm import langid

SF = "/root/testdata/sf0.01"


def test_held_out_accuracy(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang")
    rows = langid.op9_langid(spark, SF).join(docs, "doc_id").collect()
    assert len(rows) == docs.count()
    unseen = [r for r in rows if r.held_out]
    assert np.mean([r.lang_pred == r.lang for r in unseen]) > 0.98
    assert all(0 <= r.score <= 1 for r in rows)


def test_model_is_sparse_and_learns_only_what_it_may(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    seen = docs.where(langid.fold(F.col("doc_id"), 3) != 1).select("doc_id", "text", "lang")
    model = langid.train(seen, per_language=80)
    assert set(model.languages) == {r.lang for r in seen.select("lang").distinct().collect()}
    assert (model.weights == 0).mean() > 0.5


def test_frequencies_match_a_plain_count(spark):
    texts = ["abc", "abc abc", "", None, "xyz"]
    total, n = langid.document_frequencies(spark.createDataFrame([(t,) for t in texts], "text string"))
    want = np.zeros(langid.GRAMS.size, np.int64)
    for t in texts:
        want[langid.GRAMS.sparse(t or "")[0]] += 1
    assert total == 5 and (n == want).all()


def test_hard_rows(spark):
    rows = [(1, "the cat sat on the mat", "en"), (2, "der hund und die katze", "de"), (3, None, "en"), (4, "", "de"), (5, "12 34 !? ² ½", None), (None, "the dog", "en"), (1, "the cat sat on the mat", "en"), (6, "x" * 200_000, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumn("score", F.lit("clash"))
    model = langid.train(docs.select("doc_id", "text", "lang"))
    out = [(r.doc_id, r.lang_pred, r.score) for r in langid.predict(docs, model).collect()]
    assert len(out) == len(rows)
    by = {i: (p, x) for i, p, x in out}
    assert by[3] == by[4] == by[5] == ("und", 0.0) and by[1][0] in ("en", "de")
    nothing = langid.train(docs.where("false").select("doc_id", "text", "lang"))
    assert {r.lang_pred for r in langid.predict(docs, nothing).collect()} == {"und"}
    assert langid.predict(docs.limit(0), model).count() == 0


def test_weights_match_a_plain_ftrl():
    """Follow-the-regularised-leader one coordinate and class at a time."""
    texts = [("a", "aaa bab aab"), ("b", "bbb abb bba"), ("a", "aba aaa"), ("b", "bbb bb"), ("a", "held out, not fitted"), ("a", "caa"), ("b", "cbb")]
    rows = [(lang, *langid.GRAMS.sparse(t)) for lang, t in texts]
    frequencies = np.arange(langid.GRAMS.size) % 5
    model = langid.fit(rows, ["a", "b"], 7, frequencies, epochs=2)
    idf = np.log((1 + 7) / (1 + frequencies)) + 1
    z, n = [{}, {}], [{}, {}]
    weight = lambda k, i, l1: 0.0 if abs(z[k].get(i, 0.0)) <= l1 else -(z[k][i] - np.sign(z[k][i]) * l1) / ((langid.BETA + np.sqrt(n[k][i])) / langid.ALPHA + langid.L2)
    for _ in range(2):
        for at, (lang, columns, shares) in enumerate(rows):
            if at % 5 == 4:
                continue
            x = {int(c): float(s) * idf[c] * 30.0 for c, s in zip(columns, shares, strict=True)} | {-1: 1.0}
            score = [sum(v * weight(k, i, 0.0 if i < 0 else langid.L1) for i, v in x.items()) for k in range(2)]
            p = np.exp(np.array(score) - max(score))
            p /= p.sum()
            p[0 if lang == "a" else 1] -= 1
            for k in range(2):
                for i, v in x.items():
                    w, g = weight(k, i, 0.0 if i < 0 else langid.L1), v * p[k]
                    before = n[k].get(i, 0.0)
                    sigma = (np.sqrt(before + g * g) - np.sqrt(before)) / langid.ALPHA
                    z[k][i], n[k][i] = z[k].get(i, 0.0) + g - sigma * w, before + g * g
    for k in range(2):
        for i in {int(c) for _, columns, _ in rows for c in columns}:
            assert abs(model.weights[i, k] - (weight(k, i, langid.L1) if i in z[k] else 0.0) * idf[i] * 30.0) < 1e-3
        assert abs(model.bias[k] - weight(k, -1, 0.0)) < 1e-6
