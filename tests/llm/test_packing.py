"""Packing: every id in one piece, limits kept, little padding."""

import functools
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from capstrata.llm import packing

SF = "/root/testdata/sf0.001"


@functools.cache
def tokenizer():
    import public_tokenizers
    from tokenizers import Tokenizer

    return Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


def ids_of(text):
    return [*tokenizer().encode(text or "", add_special_tokens=False).ids, 1]


def check(rows, texts, most=2048):
    rows = [r.asDict() for r in rows]
    want = {i: ids_of(t) for i, t in texts.items()}
    for i, ids in want.items():
        own = sorted((r for r in rows if r["doc_id"] == i), key=lambda r: r["start"])
        assert [r["start"] for r in own] == list(np.cumsum([0, *(r["length"] for r in own)])[:-1])
        assert sum(r["length"] for r in own) == len(ids) == own[0]["doc_tokens"]
        for r in own:
            part = np.array(ids[r["start"] : r["start"] + r["length"]], "<u4")
            assert r["ids_crc32"] == zlib.crc32(part.tobytes())
    sequences = {}
    for r in rows:
        sequences.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    padding = 0
    for pieces in sequences.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= most and len(pieces) <= 64
        padding += 0 if at & (at - 1) == 0 else most - at
    return padding, sum(len(x) for x in want.values())


def test_query(spark):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    padding, total = check(packing.op7_packing(spark, SF).collect(), texts)
    assert padding <= 0.01 * total


def test_nulls_empty_long_special_and_clashing_columns(spark):
    texts = {1: None, 2: "", 3: "word " * 9000, 4: "a <|endoftext|> x<|endoftext|><|endoftext|>", 6: "<|endoftext|", 5: "a" * 30_000, **{i: "tiny" for i in range(10, 300)}}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string").withColumn("ids", F.lit("clash")).withColumn("length", F.lit(0)).repartition(2)
    padding, total = check(packing.pack_texts(docs).collect(), texts)
    assert packing.pack_texts(docs.limit(0)).count() == 0
    twice = packing.pack_texts(docs.where("doc_id = 2").union(docs.where("doc_id = 2"))).collect()
    assert len(twice) == 2


@pytest.mark.parametrize("seed", range(4))
def test_limits_hold_together(seed):
    rng = np.random.default_rng(seed)
    limits = packing.Limits(tokens=256, segments=5, loss_tokens=90)
    made = []
    for i in range(300):
        n = int(rng.choice([1, 3, 20, 100, 300, 700]))
        made.append(packing.Example(i, np.arange(n, dtype=np.uint32), 0, n, rng.random(n) < rng.choice([0.1, 0.5, 1.0])))
    whole = {e.key: len(e.ids) for e in made}
    seen = {}
    for sequence in packing.pack_stream(iter(made), limits, pool=40):
        assert sum(len(p.ids) for p in sequence) <= 256 and len(sequence) <= 5 and sum(p.loss_tokens for p in sequence) <= 90
        for p in sequence:
            seen.setdefault(p.key, []).append((p.start, len(p.ids)))
    for key, n in whole.items():
        at = 0
        for start, length in sorted(seen[key]):
            assert start == at and length > 0
            at += length
        assert at == n


def test_conversations(spark):
    rows = [(1, 0, "user", "hello"), (1, 1, "assistant", "good day"), (2, 0, None, None)]
    out = packing.pack_conversations(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()
    first = [r for r in out if r.conv_id == 1]
    assert sum(r.length for r in first) > sum(r.loss_tokens for r in first) > 0


def test_loss_limit_of_conversations_binds(spark):
    rows = [(c, t, "assistant" if t % 2 else "user", f"some words of turn {t} " * (40 if t % 2 else 3)) for c in range(60) for t in range(4)]
    out = packing.pack_conversations(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").coalesce(1)).collect()
    sequences = {}
    for r in out:
        n, loss, k = sequences.get(r.sequence_id, (0, 0, 0))
        sequences[r.sequence_id] = (n + r.length, loss + r.loss_tokens, k + 1)
    assert all(n <= 2048 and loss <= 1024 and k <= 64 for n, loss, k in sequences.values())
    assert sum(loss == 1024 and n < 2048 for n, loss, _ in sequences.values()) > len(sequences) / 2
    for bad in ({"tokens": 0}, {"segments": 0}, {"loss_tokens": 0}):
        with pytest.raises(ValueError):
            packing.Limits(**bad)
