"""The pipeline's stages, each held against a plain version on its own input."""

import test_decontaminate
import test_packing
import test_quality
import test_similar

import corpus_pipeline
from capstrata.llm import quality, secrets

SF = "/root/testdata/sf0.001"


def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, seen = docs.columns, [docs]
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, seen[-1], SF).write.parquet(f"{tmp_path}/{name}")
        seen.append(spark.read.parquet(f"{tmp_path}/{name}"))
    assert [s.columns for s in seen[:-1]] == [columns] * 5
    texts = [{r.doc_id: r.text for r in s.select("doc_id", "text").collect()} for s in seen[:-1]]
    # quality rules: the plain limits, then the model
    model = quality.train(docs, spark.read.parquet(f"{SF}/labels.parquet"))
    good = {r.doc_id for r in quality.score(docs, model).where(f"good_probability >= {quality.KEEP_FROM}").collect()}
    assert set(texts[1]) == {i for i, t in texts[0].items() if i in good and not test_quality.plain(t)[-1]}
    # near-dedup: the smallest id of each component by brute-force Jaccard
    roots, _ = test_similar.plain_components(texts[1])
    assert set(texts[2]) == set(roots.values())
    # decontamination: exact containment of every pair
    items = [tuple(r) for r in spark.read.parquet(f"{SF}/benchmark.parquet").select("item_id", "text").collect()]
    assert set(texts[3]) == set(texts[2]) - {i for i, _ in test_decontaminate.plain(list(texts[2].items()), items)}
    # secrets: all documents stay, no known secret does, other texts are untouched
    assert set(texts[4]) == set(texts[3])
    for i, text in texts[4].items():
        assert not secrets.base_spans(text) and (text == texts[3][i] or "[SECRET]" in text)
    assert all(r.n_chars == len(r.text) for r in seen[4].collect())
    # packing: every id in one piece
    padding, total = test_packing.check(seen[5].collect(), texts[4])
    assert padding <= 0.01 * total
    assert corpus_pipeline.run(spark, SF).count() == seen[5].count()


def test_hard_rows_pass_every_stage(spark):
    rows = [(1, None, None, None, None), (None, "", "en", "s", 0), (2, "a b c d e f g h i j k l m n", "en", "s", 27), (2, "a b c d e f g h i j k l m n", "en", "s", 27), (3, "q" * 100_000, None, "s", 1)]
    docs = spark.createDataFrame(rows, spark.read.parquet(f"{SF}/documents.parquet").schema)
    for _, stage in corpus_pipeline.STAGES:
        stage(spark, docs, SF).collect()
        stage(spark, docs.limit(0), SF).collect()
