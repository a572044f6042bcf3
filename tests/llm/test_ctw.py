"""Context-tree weighting against a recursive version on a dictionary of nodes."""

import math
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from capstrata.llm import ctw

SF = "/root/testdata/sf0.001"


def bits(byte):
    node = 1
    for k in range(7, -1, -1):
        yield node, byte >> k & 1
        node = 2 * node + (byte >> k & 1)


def kt(a, b):
    return math.lgamma(a + 0.5) + math.lgamma(b + 0.5) - math.lgamma(a + b + 1) - math.log(math.pi)


def out_of_training(i):
    return zlib.crc32(("" if i is None else str(i)).encode()) % 7 == 2


class Plain:
    def __init__(self, docs):
        self.depth = ctw.DEPTH
        counts = defaultdict(lambda: [0, 0])
        self.tokens = Counter()
        for i, text in docs:
            if out_of_training(i):
                continue
            words = ctw.tokens(text)
            self.tokens.update([*words, b""])
            s = self.bytes_of(words)
            for j in range(self.depth, len(s)):
                for node, bit in bits(s[j]):
                    for d in range(self.depth + 1):
                        counts[s[j - d : j], node][bit] += 1
        self.counts = counts
        self.children = defaultdict(float)
        for key in sorted(counts, key=lambda k: -len(k[0])):
            context, node = key
            own = kt(*counts[key])
            if len(context) < self.depth:
                own = np.logaddexp(own, self.children[key]) - math.log(2)
            if context:
                self.children[context[1:], node] += own

    def bytes_of(self, words):
        return b"\0" * self.depth + b" ".join(words) + b"\n"

    def one(self, before, node):
        p = None
        for d in range(self.depth, -1, -1):
            key = (before[len(before) - d :], node)
            a, b = self.counts.get(key, (0, 0))
            p1 = (b + 0.5) / (a + b + 1)
            if d == self.depth:
                p = p1
            else:
                ratio = math.exp(max(-700, min(700, kt(a, b) - self.children.get(key, 0.0))))
                p = (ratio * p1 + p) / (1 + ratio)
        return p

    def score(self, text):
        s, total = self.bytes_of(ctw.tokens(text)), 0.0
        for j in range(self.depth, len(s)):
            for node, bit in bits(s[j]):
                p = self.one(s[j - self.depth : j], node)
                total += math.log10(p if bit else 1 - p)
        return total

    def rare(self, text):
        s = self.bytes_of(ctw.tokens(text))
        runs = [(s[j - self.depth : j], s[j]) for j in range(self.depth, len(s))]
        counts = Counter()
        for (before, _), (node, bit) in ((r, list(bits(r[1]))[-1]) for r in runs):
            counts[before, node, bit] = self.counts.get((before, node), (0, 0))[bit]
        return sum(counts[b, *list(bits(c))[-1]] <= 1 for b, c in runs) / len(runs)

    def base(self, text):
        n, v = sum(self.tokens.values()), len(self.tokens)
        return sum(math.log10((self.tokens[t] + 1) / (n + v + 1)) for t in [*ctw.tokens(text), b""])


@pytest.mark.parametrize("block_bytes", [400, 1 << 20])
def test_scores_match_the_plain_version(spark, block_bytes):
    rows = [(r.doc_id, r.text[:1500]) for r in spark.read.parquet(f"{SF}/documents.parquet").orderBy("doc_id").limit(22).collect()]
    rows += [(1001, None), (1002, ""), (1003, "Ab  aB\n\x00 z"), (None, "ab ab"), (rows[0][0], rows[0][1]), (1004, "é ünïcode " * 30), (1005, "never-seen-0123456789 words")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("score", F.lit("clash")).withColumn("block", F.lit("clash"))
    plain = Plain(rows)
    got = ctw.score(docs, block_bytes).collect()
    assert len(got) == len(rows)
    by = {r.doc_id: r for r in got}
    for i, text in rows:
        r = by[i]
        assert r.held_out == out_of_training(i) and r.n_tokens == len(ctw.tokens(text)) + 1
        assert r.n_known == sum(t in plain.tokens for t in [*ctw.tokens(text), b""]) and r.train_tokens == sum(plain.tokens.values())
        assert r.base_score == pytest.approx(plain.base(text), rel=1e-12)
        assert r.score == pytest.approx(plain.score(text), rel=1e-8)
        assert r.rare_share == pytest.approx(plain.rare(text))
        assert r.bits_per_byte == pytest.approx(-r.score / math.log10(2) / (len(b" ".join(ctw.tokens(text))) + 1))


def test_empty_table_and_no_training(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert ctw.score(docs).count() == 0
    alone = next(i for i in range(100) if out_of_training(i))
    r = ctw.score(spark.createDataFrame([(alone, "a b")], "doc_id long, text string")).first()
    assert r.train_tokens == 0 and r.n_known == 0 and r.score == pytest.approx(4 * 8 * math.log10(0.5))


def test_held_out_texts_are_predicted_better_than_even(spark):
    rows = [r for r in ctw.op5_ctw(spark, SF).collect() if r.held_out and r.n_tokens > 20]
    assert np.mean([r.bits_per_byte for r in rows]) < 3.5


def test_log_gamma():
    x = np.array([0.5, 1.0, 1.5, 7.0, 1e6 + 0.5])
    assert ctw.log_gamma(x) == pytest.approx([math.lgamma(v) for v in x], abs=1e-9, rel=1e-12)


def test_lookup_with_collisions():
    keys = np.unique(np.random.default_rng(0).integers(0, 1 << 48, 5000))
    values = np.arange(len(keys), dtype=float)
    look = ctw.Lookup(keys, values)
    pick = np.random.default_rng(1).integers(0, len(keys), 20_000)
    assert (look(keys[pick]) == values[pick]).all()


def test_lists_grow_in_proportion(spark):
    """Every level has FAN lists a block at most, and each part's model is made and sent once."""
    rng = np.random.default_rng(2)
    block = 2000
    seen = []
    for docs in (100, 400, 1600):
        rows = [(i, " ".join(str(x) for x in rng.integers(0, 5000, 40))) for i in range(docs)]
        dealt, blocks = ctw.blocks_of(spark.createDataFrame(rows, "doc_id long, text string"), block)
        levels = ctw.levels_for(blocks)
        asked = ctw.cut(dealt.groupBy("block").applyInPandas(ctw._requests, ctw._REQUEST)).where("kind = 0").drop("kind")
        lists, parts = ctw.go_up(asked, levels, ctw.Runs)
        counts = [x.count() for x in lists]
        assert len(counts) == levels and all(n <= ctw.FAN * blocks for n in counts)
        members = max(r[0] for x in lists for r in ctw._teams(x).count().select("count").collect())
        assert members <= ctw.FAN and parts.count() == parts.select("shelf").distinct().count() == parts.where("member = 0").count()
        seen.append((blocks, sum(counts) / blocks))
    assert seen[-1][1] <= 2.2 * ctw.FAN and seen[-1][0] > 12 * seen[0][0]


def test_a_copied_text_has_no_rare_bytes(spark):
    rng = np.random.default_rng(3)
    texts = [" ".join(f"{x:x}" for x in rng.integers(0, 1 << 40, 60)) for _ in range(20)]
    trained = [i for i in range(200) if not out_of_training(i)][:21]
    rows = [(i, t) for i, t in zip(trained, [*texts, texts[0]], strict=True)]
    got = {r.doc_id: r.rare_share for r in ctw.score(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[trained[0]] == got[trained[-1]] == 0 and min(got[i] for i in trained[1:-1]) > 0.3


ODD = ["a B\x0bc\x00 d", None, "", " \t\n", "É x" * 3, "\x1fa\x1c b", "\ud800 z", "end\n", "long" * 500]


def test_words_of_many_texts_are_those_of_each():
    data, offsets, first = ctw.words_of(ODD)
    words = ctw._token_list(data, offsets).to_pylist()
    assert [words[a:b] for a, b in zip(first[:-1], first[1:], strict=True)] == [ctw.tokens(t) for t in ODD]
    run, ends = ctw.runs(data, offsets, first)
    whole = [b"\0" * ctw.DEPTH + b" ".join(ctw.tokens(t)) + b"\n" for t in ODD]
    assert run.tolist() == [int.from_bytes(w[i : i + ctw.DEPTH + 1]) for w in whole for i in range(len(w) - ctw.DEPTH)]
    assert np.diff(ends, prepend=0).tolist() == [len(w) - ctw.DEPTH for w in whole]


def test_lists_of_tokens_are_packed_dealt_and_answered():
    own, counts = ctw.Tokens.merge([(ctw.pa.array(x, ctw.pa.large_binary()), np.array(n)) for x, n in (([b"b", b"", b"abcdefghij"], [1, 2, 3]), ([b"", b"zz"], [5, 7]))])
    assert dict(zip(own.to_pylist(), counts.tolist(), strict=True)) == {b"b": 1, b"": 7, b"abcdefghij": 3, b"zz": 7}
    assert ctw.Tokens.unpack(ctw.Tokens.pack(own)).equals(own) and ctw.Tokens.unpack(ctw.Tokens.pack(own[:1])).equals(own[:1])
    dealt = [ctw.Tokens.unpack(keys) for _, keys, _ in ctw._dealt(ctw.Tokens, own, counts, 0, 0)]
    assert sorted(t for part in dealt for t in part.to_pylist()) == sorted(own.to_pylist())
    assert [x.tolist() for x in ctw.Tokens.answer([own[:2], own[2:]], [counts[:2], counts[2:]], [own[::-1], own[:0], own[1:2]])] == [counts[::-1].tolist(), [], counts[1:2].tolist()]
