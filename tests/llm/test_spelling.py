"""Spelling variants: all near pairs against brute force, and the query against a plain version."""

import itertools
import random
import re
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from capstrata.llm import spelling

SF = "/root/testdata/sf0.001"


def near(a, b):
    """Whether exactly one insertion, deletion or replacement turns a into b."""
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    p = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
    return a[p + 1 :] == b[p + 1 :] or a[p + 1 :] == b[p:] or a[p:] == b[p + 1 :]


def plain(counts, ratio=10):
    """{word: (n, n_near, form, form_n, root)}, pairs found by what is left of a word without one character."""
    left = {}
    for w in counts:
        for i in range(len(w)):
            left.setdefault((w[:i] + w[i + 1 :]), set()).add(w)
        left.setdefault(w, set()).add(w)
    partners = {w: set() for w in counts}
    for group in left.values():
        for a, b in itertools.combinations(group, 2):
            if near(a, b):
                partners[a].add(b)
                partners[b].add(a)
    form = {}
    for w, ps in partners.items():
        best = min(ps, key=lambda p: (-counts[p], p), default=None)
        form[w] = best if best is not None and counts[best] >= ratio * counts[w] else None
    out = {}
    for w in counts:
        root = w
        while form[root]:
            root = form[root]
        out[w] = (counts[w], len(partners[w]), form[w], counts[form[w]] if form[w] else None, root)
    return out


def plain_counts(rows):
    counts = Counter()
    for doc, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if doc is None else doc}:{run}".encode())
            if h % 31 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            if len(run) >= 7:
                counts[run] += 1
    return {w: n for w, n in counts.items() if n >= 2}


def found(df):
    rows = df.collect()
    assert len({r.word for r in rows}) == len(rows)
    return {r.word: (r.n, r.n_near, r.form, r.form_n, r.root) for r in rows}


def test_query(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    want = plain(plain_counts(rows))
    assert found(spelling.op13_spelling(spark, SF)) == want
    assert any(v[2] for v in want.values())


@pytest.mark.parametrize("seed", range(5))
def test_all_pairs_of_dense_words(spark, seed):
    rng = random.Random(seed)
    letters = ["ab", "abc", "aé÷ÿ", "abcdefgh", "aaab"][seed]
    counts = {}
    while len(counts) < [250, 700, 500, 400, 300][seed]:
        w = "".join(rng.choice(letters) for _ in range(rng.randint(1 if seed < 2 else 6, 8 if seed < 3 else 10)))
        counts[w] = rng.choice([2, 3, 19, 20, 21, 200, 2000, 30000])
        if seed >= 3:  # what is one slip away
            i = rng.randrange(len(w))
            counts.setdefault(w[:i] + rng.choice(["", rng.choice(letters), w[i] * 2]) + w[i + 1 :], rng.choice([2, 20, 20]))
    counts.pop("", None)
    words = spark.createDataFrame(list(counts.items()), "word string, n long").repartition(3)
    assert found(spelling.variants(words)) == plain(counts)


def test_hot_prefixes_and_suffixes(spark):
    """A third of all words begin alike, a third end alike, and a very long word has a near one."""
    rng = random.Random(1)
    some = lambda: "".join(rng.choice("abcdefg") for _ in range(6))
    counts = {("samebeginning" + some()): rng.choice([2, 30]) for _ in range(500)} | {(some() + "sameending"): rng.choice([2, 30]) for _ in range(500)}
    long = "".join(rng.choice("xyz") for _ in range(50_000))
    counts |= {long: 2, long[:30_000] + long[30_001:]: 25}
    light = spelling._light(spark.createDataFrame(list(counts.items()), "word string, n long").withColumn("id", F.monotonically_increasing_id())).groupBy("word").count().agg(F.max("count")).first()[0]
    assert light <= len(counts).bit_length()
    short = {w: n for w, n in counts.items() if len(w) < 100}
    got = found(spelling.variants(spark.createDataFrame(list(counts.items()), "word string, n long")))
    assert got.pop(long) == (2, 1, long[:30_000] + long[30_001:], 25, long[:30_000] + long[30_001:])
    got.pop(long[:30_000] + long[30_001:])
    assert got == plain(short)


def test_chains_of_forms(spark):
    chain = ["spelled", "spelledx", "spelledxy", "spelledxyz", "spelledxyzw", "spelledxyzwv"]
    counts = {w: 2 * 10**i for i, w in enumerate(chain)}
    got = found(spelling.variants(spark.createDataFrame(list(counts.items()), "word string, n long")))
    assert got == plain(counts) and {v[4] for v in got.values()} == {chain[-1]}
    with pytest.raises(ValueError):
        spelling.variants(spark.createDataFrame(list(counts.items()), "word string, n long"), ratio=1)


def test_hard_rows(spark, monkeypatch):
    monkeypatch.setattr(spelling, "_HELD_WORDS", 3)
    texts = [None, "", "12 34", "Grüße GRÜSSE größere größere grössere", "hamiltonian Hamiltonian hamiltonien", "a-b-c", "ÀÉÎÕÜÿ÷×ÀÉÎÕÜÿ÷ ÀÉÎÕÜÿ÷×ÀÉÎÕÜÿ÷", "x" * 9000 + " " + "x" * 9000]
    rows = [(i, t) for i, t in enumerate(texts * 40)] + [(None, "withoutnumber withoutnumber"), (None, "withoutnumber"), (2**62, "bignumbers bignumbers")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit("clash") for c in ("word", "n", "id", "node", "depth", "form")}).repartition(4)
    assert found(spelling.variants(spelling.word_counts(docs))) == plain(plain_counts(rows))
    assert spelling.variants(spelling.word_counts(docs.limit(0))).count() == 0
