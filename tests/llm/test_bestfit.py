"""Best-fit packing: ids as the tokenizer gives them, bounds below the best packing, few sequences."""

import functools
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from capstrata.llm import bestfit

SF = "/root/testdata/sf0.001"


@functools.cache
def tokenizer():
    import public_tokenizers
    from tokenizers import Tokenizer

    return Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))


def ids_of(text):
    return [*tokenizer().encode(text or "", add_special_tokens=False).ids, 0]


ODD = [
    "", " ", "Don't we'll THEY'RE 'Sx it's!'s", "a <|endoftext|> x<|startoftext|>y <|END", "é Éx ́a Å", "ÀÉÎ÷×ß ÿ ªº µm ¹²¼", "x\x1cy\x1fz \x85a\xa0b c　d", "İstanbul ΣΑΣ ﬁ", "日本語 \U0001f600ok",
    "1234 a1b2 --- ... ¡hola! «x» “q” – — …", "a" * 5000, "wörter " * 3000, "\x00a \x0b\x0cb", "क्षि 각 각", "don’t 'LL'd 've'Re",
]


def test_ids_are_those_of_the_tokenizer(spark):
    encode = bestfit.encoder()
    texts = ODD + [r.text for r in spark.read.parquet(f"{SF}/documents.parquet").select("text").collect()]
    for text in texts:
        assert [*encode(text or ""), 0] == ids_of(text)


@given(st.text(st.sampled_from(list("abSTé'’ \n\t\x1c\xa0́İΣß1½<|>.!×")), max_size=40))
@settings(max_examples=300, deadline=None)
def test_ids_of_odd_texts(text):
    assert [*bestfit._kept_encoder(bestfit.VOCABULARY)(text), 0] == ids_of(text)


def test_usual_words_beyond_ascii_need_no_further_calls(monkeypatch):
    """All usual characters are spelled once for a worker, not for each new word, and as the tokenizer spells them."""
    from tokenizers import pre_tokenizers

    calls = []

    class Counted:
        def __init__(self, **how):
            self.made = made_by(**how)

        def pre_tokenize_str(self, part):
            calls.append(part)
            return self.made.pre_tokenize_str(part)

    made_by = pre_tokenizers.ByteLevel
    monkeypatch.setattr(pre_tokenizers, "ByteLevel", Counted)
    encode = bestfit.encoder()
    before = len(calls)
    for c in (chr(i) for i in range(33, 0x3000) if bestfit._USUAL.fullmatch(chr(i))):
        for text in (c, f"x{c}", f"{c}{c}Y {c}1"):
            assert [*encode(text), 0] == ids_of(text)
    assert len(calls) == before


def fewest(sizes, capacity):
    """The fewest bins, by trying all."""
    best = len(sizes)

    def place(i, left):
        nonlocal best
        if len(left) >= best:
            return
        if i == len(sizes):
            best = len(left)
            return
        for b in range(len(left)):
            if left[b] >= sizes[i] and left[b] not in left[:b]:
                place(i + 1, [*left[:b], left[b] - sizes[i], *left[b + 1 :]])
        place(i + 1, [*left, capacity - sizes[i]])

    place(0, [])
    return best


@given(st.integers(3, 24).flatmap(lambda c: st.tuples(st.just(c), st.lists(st.integers(1, c), max_size=8))))
@settings(max_examples=300, deadline=None)
def test_bounds_are_below_the_best_packing(case):
    capacity, sizes = case
    sizes = sorted(sizes, reverse=True)
    bound = bestfit.lower_bound(np.bincount(np.array(sizes, np.int64), minlength=capacity + 1), capacity)
    bins, offsets, left = bestfit.best_fit_decreasing(np.array(sizes, np.int64), capacity)
    assert -(-sum(sizes) // capacity) <= bound <= fewest(sizes, capacity) <= len(left)
    for b in range(len(left)):
        own = sorted((o, s) for x, o, s in zip(bins, offsets, sizes, strict=True) if x == b)
        assert [o for o, _ in own] == list(np.cumsum([0, *(s for _, s in own)])[:-1]) and sum(s for _, s in own) + left[b] == capacity


@pytest.mark.parametrize(("sizes", "want"), [([1025] * 10, 10), ([683] * 9, 5), ([1100] * 5 + [900] * 5, 5), ([700] * 12 + [1400] * 3, 9), ([], 0)])
def test_bounds_that_total_length_does_not_give(sizes, want):
    assert bestfit.lower_bound(np.bincount(np.array(sizes, np.int64), minlength=2049), 2048) == want


def check(rows, docs, capacity=2048):
    """All ids in their pieces and gapless sequences; the number of those and of all ids."""
    own = {}
    for r in rows:
        own.setdefault(r.doc_id, []).append(r)
    for doc, texts in docs.items():
        want = sorted((p, p * capacity, len(ids[p * capacity : (p + 1) * capacity]), zlib.crc32(np.array(ids[p * capacity : (p + 1) * capacity], "<u4").tobytes())) for ids in map(ids_of, texts) for p in range(-(-len(ids) // capacity)))
        assert sorted((r.piece, r.start, r.length, r.ids_crc32) for r in own.pop(doc)) == want
    assert not own
    sequences = {}
    for r in rows:
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for pieces in sequences.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= capacity
    return len(sequences), sum(r.length for r in rows)


def test_query(spark):
    docs = {r.doc_id: [r.text] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    n, ids = check(bestfit.op12_bestfit(spark, SF).collect(), docs)
    assert n <= -(-ids // 2048) + 1


def test_hard_rows(spark):
    rows = [(1, None), (2, ""), (2, ""), (None, "no number"), (5, "word " * 2047), (6, "word " * 2048), (7, "word " * 9000), *((10 + i, t) for i, t in enumerate(ODD))]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit("clash") for c in ("key", "ids", "length", "block", "given")}).repartition(3)
    texts = {}
    for doc, text in rows:
        texts.setdefault(doc, []).append(text)
    found = bestfit.pack_whole(docs).collect()
    check(found, texts)
    assert {r.doc_id: r.ids for r in found}[10 + ODD.index("日本語 \U0001f600ok")] == ids_of("日本語 \U0001f600ok")
    assert bestfit.pack_whole(docs.limit(0)).count() == 0


def test_blocks_exchange(spark):
    """Long pieces in some blocks and short ones in others: alone each block wastes much, together little."""
    lengths = [1300] * 300 + [748] * 300
    rows = spark.createDataFrame(list(enumerate(lengths)), "key long, length long").repartitionByRange(6, "key")
    alone, together = (bestfit.assign(rows, block=100, rounds=k) for k in (0, 8))
    count = lambda df: df.select("sequence_id").distinct().count()
    assert together.count() == 600 and count(together) < count(alone)
    tails = spark.range(0, 4000, 1, 8).select(F.col("id").alias("key"), (F.col("id") % 97 + 1).alias("length"))
    total = sum(i % 97 + 1 for i in range(4000))
    assert count(bestfit.assign(tails, block=500)) == -(-total // 2048)
    first = bestfit.assign(tails, block=500, rounds=0).groupBy("block").agg(F.first("bins").alias("bins"), F.first("bound").alias("bound"), F.count_distinct("sequence_id").alias("n")).collect()
    assert len(first) == 8 and all(r.n == r.bins >= r.bound for r in first)
