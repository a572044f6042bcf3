"""Every query of the subpackage over tables of hard rows, and over empty ones."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from capstrata.llm.queries import QUERIES

LONG = "palabra " * 150_000
GOOD = "twelve one eleven two ten three nine four eight five seven six"
COPY = "one two three four five six seven eight nine ten eleven twelve"


def tables(spark):
    docs = [
        (1, COPY, "en", "a", 5), (2, COPY, "en", "a", 5), (2, COPY, "en", "a", 5), (3, None, "en", None, None), (4, "", None, "a", 0), (5, " \n\t\x0b", "de", "a", 4), (None, COPY + " tail", "en", "a", 1),
        (None, None, None, None, None), (6, LONG, "es", "b", len(LONG)), (7, "x" * 300_000, "de", "b", 1), (8, "é\x00ü \U0001f600 ﬁ", "fr", "b", 1), (9, "AKIA" + "A" * 20 + " token: abcdefghijkl0123456789", "en", "b", 1), (-5, "12 34", "en", "b", 5),
        (10, "uno dos tres cuatro cinco seis siete ocho nueve diez", "es", "b", 1), (11, "eins zwei drei vier fünf sechs sieben acht neun zehn", "de", "b", 1), (2**62, "big id " * 20, "en", "c", 1), (12, GOOD, "en", "a", len(GOOD)), (12, GOOD, "de", "b", len(GOOD)),
    ]
    clash = {c: F.lit("clash") for c in ("fp", "score", "kept", "root", "block", "held", "hash", "good", "spans", "component_id", "first_id", "item_id", "columns", "part", "__text")}
    documents = spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long")
    labels = spark.createDataFrame([(1, 1, 0), (1, 1, 0), (2, 1, None), (5, 0, 1), (None, 0, 0), (6, None, 1), (99, 0, 0), (10, 0, None), (12, 1, 0)], "doc_id long, quality int, toxic int")
    urls = [(1, "http://a.example.com/en/1", "<p>x</p>" * 40), (2, "http://a.example.com/en/2", "<p>x</p>" * 40), (2, None, None), (None, "HTTP://B.net/es/9.html#x", ""), (4, "nothing", "<p>x</p>" * 40), (5, "://", "é" * 60), (6, "http://x/" + "a/" * 3000, "\x00")]
    pages = spark.createDataFrame(urls, "page_id long, url string, html string")
    benchmark = spark.createDataFrame([(1, COPY), (1, COPY), (2, None), (3, ""), (None, COPY + " more"), (4, "a b")], "item_id long, text string")
    talk = [(1, 0, "user", "hi"), (1, 1, "assistant", None), (1, 1, "assistant", "<|im_end|>"), (2, None, None, "x"), (None, 0, "assistant", "<\\|"), (3, 0, "a\nb", "<|im_start|>user\n")]
    conversations = spark.createDataFrame(talk, "conv_id long, turn long, role string, text string")
    return {
        "documents": documents.withColumns(clash),
        "labels": labels.withColumns({c: F.lit("clash") for c in ("text", "page_id", "bad", "host")}),
        "pages": pages.withColumns({c: F.lit("clash") for c in ("doc_id", "host", "path", "shape", "template", "digest", "refers_to", "archive")}),
        "benchmark": benchmark.withColumns({c: F.lit("clash") for c in ("doc_id", "hash", "held", "shingles", "sketch")}),
        "conversations": conversations.withColumns({c: F.lit("clash") for c in ("formatted", "turns", "t", "read", "escaped", "id")}),
    }


@pytest.fixture(scope="module")
def folders(spark, tmp_path_factory):
    hard, empty = tmp_path_factory.mktemp("hard"), tmp_path_factory.mktemp("empty")
    for name, df in tables(spark).items():
        df.repartition(3).write.parquet(f"{hard}/{name}.parquet")
        df.limit(0).write.parquet(f"{empty}/{name}.parquet")
    return str(hard), str(empty)


EACH = {"op1_urls": "pages", "op2_simhash": "documents", "op5_ctw": "documents", "op6_quality": "documents", "op8_warc": "pages", "op9_langid": "documents", "op10_secrets": "documents", "op11_fim": "documents"}


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_hard_and_empty_tables(spark, folders, name):
    hard, empty = folders
    rows = QUERIES[name](spark, hard).collect()
    if name in EACH:
        assert len(rows) == spark.read.parquet(f"{hard}/{EACH[name]}.parquet").count()
    nothing = QUERIES[name](spark, empty).collect()
    assert len(nothing) == (1 if name == "op4_chat" else 0)


def test_decontamination_and_packing_of_hard_tables(spark, folders):
    found = {(r.doc_id, r.item_id) for r in QUERIES["op3_decontaminate"](spark, folders[0]).collect()}
    assert {(1, 1), (2, 1), (None, 1), (1, None)} <= found
    pieces = QUERIES["op7_packing"](spark, folders[0]).collect()
    assert {r.doc_id for r in pieces} == {1, 2, 3, 4, 5, 6, 7, 8, 9, 10, 11, 12, -5, 2**62, None}
    assert all(0 < r.length <= 2048 for r in pieces)


def test_pipeline_of_hard_tables(spark, folders, tmp_path):
    hard, empty = folders
    docs, ids = spark.read.parquet(f"{hard}/documents.parquet"), {}
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, hard).write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        ids[name] = sorted((r.doc_id for r in docs.select("doc_id").collect()), key=lambda i: (i is None, i))
    assert ids["quality_rules"] == [1, 2, 2, 12, 12, None]  # copies of the good rows and one with a tail; no null, empty, short or repeating text
    assert ids["near_dedup"] == [1, 12]
    assert ids["decontamination"] == ids["secret_scan"] == [12] and set(ids["packing"]) == {12}  # row 1 is a benchmark item
    kept = spark.read.parquet(f"{tmp_path}/secret_scan").collect()
    assert [(r.text, r.lang, r.source, r.n_chars) for r in kept] == [(GOOD, "de", "b", len(GOOD))]  # the first of two rows of one id and text
    assert [(r.start, r.offset) for r in docs.orderBy("start").collect()][0] == (0, 0)
    assert corpus_pipeline.run(spark, hard).count() == docs.count()
    assert corpus_pipeline.run(spark, empty).count() == 0
