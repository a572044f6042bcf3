"""Similarity join against brute-force Jaccard over all pairs."""

import random

import pytest
from pyspark.sql import functions as F

from capstrata.llm import similar, simhash


def plain_set(text):
    words = (text or "").lower().split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def plain_components(texts):
    sets = {i: plain_set(t) for i, t in texts.items()}
    root = {i: i for i in sets}
    links = [(a, b) for a in sets for b in sets if a < b and 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b])]
    moved = True
    while moved:
        moved = False
        for a, b in links:
            low = min(root[a], root[b])
            moved |= root[a] != root[b]
            root[a] = root[b] = low
    return root, links


def made():
    """Families of near copies around the limit, each grown from changes of one or more words, and texts with one line in common."""
    rng = random.Random(4)
    word = lambda: f"w{rng.randrange(3000)}"
    line, texts = [word() for _ in range(30)], []
    for _ in range(12):
        base = [word() for _ in range(rng.choice((8, 40, 120, 300)))]
        for _ in range(10):
            copy = list(base)
            for _ in range(rng.randrange(1 + len(base) // 35 + 1)):
                copy[rng.randrange(len(copy))] = word()
            texts.append(copy)
            base = rng.choice((base, copy))
    texts += [line + [word() for _ in range(rng.choice((3, 10, 60)))] for _ in range(40)]
    group = [word() for _ in range(200)]
    texts += [[*group[:k], word(), *group[k + 1 :]] for k in range(0, 200, 4)]
    return {i: " ".join(t) for i, t in enumerate(texts)}


@pytest.mark.parametrize("limit", [0, 3, 32])
def test_components_match_brute_force(spark, limit):
    texts = made()
    want, links = plain_components(texts)
    prints = {i: simhash.fingerprint(t) for i, t in texts.items()}
    # most pairs are out of reach of op2's two bits
    assert sum((prints[a] ^ prints[b]).bit_count() > 2 for a, b in links) > len(links) / 2
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(3)
    assert {r.doc_id: r.component_id for r in simhash.near_duplicates(docs, limit).collect()} == want
    if limit == 3:
        assert {r.doc_id for r in simhash.deduplicate(docs, limit).collect()} == set(want.values())


def test_blocks_of_one_group_need_few_pairs(spark):
    rng = random.Random(1)
    group = [f"w{rng.randrange(3000)}" for _ in range(200)]
    docs = spark.createDataFrame([(i, " ".join([*group[:-1], f"x{i}"])) for i in range(400)], "doc_id long, text string")
    _, links = similar.similar(docs)
    assert links.count() < 2 * 400


def test_pigeonring_comes_first_and_its_pairs_are_near(spark, monkeypatch):
    """The stage searches fingerprints of five-word shingles by pigeonring; a class with one within two bits has a pair of such."""
    from capstrata.llm import pigeonring

    texts = made()
    sets = {similar.class_of(s): s for s in similar.shingle_sets(list(texts.values()))}
    prints = {fp: pigeonring.majority(s) for fp, s in sets.items()}
    assert all(p == sum(1 << k for k in range(64) if 2 * sum(int(h) >> k & 1 for h in s) > len(s)) for p, s in list(zip(prints.values(), sets.values(), strict=True))[:5])
    rows = spark.createDataFrame([(fp, p - (1 << 64) if p >> 63 else p) for fp, p in prints.items()], "fp long, simhash long")
    firsts = rows.groupBy("simhash").agg(F.min("fp").alias("first"))
    pairs = [(r.fp, r.other) for r in similar.ring_pairs(rows, firsts).collect()]
    assert pairs and all((prints[a] ^ prints[b]).bit_count() <= 2 for a, b in pairs)
    assert {x for pair in pairs for x in pair} == {a for a in prints if any(a != b and (prints[a] ^ prints[b]).bit_count() <= 2 for b in prints)}
    assert len(pairs) <= len(prints)
    searched, links = [], pigeonring.links
    monkeypatch.setattr(pigeonring, "links", lambda fps: searched.append(fps.count()) or links(fps))
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    assert {r.doc_id for r in simhash.deduplicate(docs).collect()} == set(plain_components(texts)[0].values())
    assert searched == [len(set(prints.values()))]


def test_the_driver_is_asked_to_release_memory_between_the_searches(spark, monkeypatch):
    """Ended plans do not pile up in the driver: memory is released after each of the searches, and the result is whole."""
    asked = []
    monkeypatch.setattr(similar, "release", asked.append)
    text = " ".join(f"w{i}" for i in range(60))
    docs = spark.createDataFrame([(1, text), (2, text + " x"), (3, "other words than these are here now")], "doc_id long, text string")
    prints, roots = similar.grouped(docs)
    assert len(asked) >= 6 and prints.count() == 3 and roots.count() == 2


def test_each_plan_is_followed_by_a_look_at_the_drivers_heap_and_no_plan_is_long(spark, monkeypatch):
    """cut() asks to drop ended plans where they fill much of the heap, and pairs are written by several plans of a few joins."""
    from capstrata.llm import common

    asked, joins = [], []
    plain = common.release
    monkeypatch.setattr(common, "release", lambda *a: asked.append(a) or plain(*a))

    def seen(df):
        joins.append(df._jdf.queryExecution().optimizedPlan().toString().count("Join "))
        return common.cut(df)

    monkeypatch.setattr(similar, "cut", seen)
    texts = made()
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    assert {r.doc_id: r.component_id for r in simhash.near_duplicates(docs, 3).collect()} == plain_components(texts)[0]
    assert len(asked) >= len(joins) and all(a[1:] == (common.USED,) for a in asked)
    assert max(joins) <= 4, joins


def test_release_asks_only_where_much_of_the_heap_is_in_use(spark):
    from capstrata.llm import common

    beans = spark.sparkContext._jvm.java.lang.management.ManagementFactory
    full = lambda: sum(b.getCollectionCount() for b in beans.getGarbageCollectorMXBeans() if "Old" in b.getName() or "MarkSweep" in b.getName())
    before = full()
    common.release(spark, 1.5)
    assert full() == before
    common.release(spark)
    assert full() == before + 1


def estimate(df):
    """Bits of the size that a plan is estimated to have."""
    return df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes().bit_length()


def test_estimated_sizes_do_not_grow_with_the_rounds(spark):
    """The driver multiplies and keeps such numbers for each plan; a checkpoint hands them on, and each join adds their digits."""
    from capstrata.llm import common

    ids = random.Random(1).sample(range(10_000), 300)
    edges = spark.createDataFrame(list(zip(ids, ids[1:], strict=False)), "src long, dst long")
    found = common.connected_components(edges)
    assert {tuple(r) for r in found.collect()} == {(i, min(ids)) for i in ids}
    assert estimate(found) < 100
    docs = spark.createDataFrame(list(made().items()), "doc_id long, text string")
    prints, roots = similar.grouped(docs, 3)
    assert estimate(roots) < 100
