"""SimHash components against brute force over all pairs."""

import random

import pytest
import xxhash
from pyspark.sql import functions as F

from capstrata.llm import simhash

SF = "/root/testdata/sf0.001"


def plain_fingerprint(text):
    words = [w for w in "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").replace("\t", " ").replace("\n", " ").replace("\r", " ").replace("\x0b", " ").replace("\x0c", " ").split(" ") if w]
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << k for k in range(64) if 2 * sum(h >> k & 1 for h in hashes) > len(hashes))


def plain_components(prints):
    root = dict.fromkeys(prints)
    for i in root:
        root[i] = i
    ids = list(prints)
    changed = True
    while changed:
        changed = False
        for a in ids:
            for b in ids:
                if (prints[a] ^ prints[b]).bit_count() <= 2 and root[a] != root[b]:
                    root[a] = root[b] = min(root[a], root[b])
                    changed = True
    return root


def test_fingerprints_match_the_definition(spark):
    rows = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").limit(40).collect()
    assert all(simhash.fingerprint(r.text) == plain_fingerprint(r.text) for r in rows)
    assert simhash.fingerprint(None) == simhash.fingerprint(" \n") == 0
    assert simhash.fingerprint("One") == xxhash.xxh64_intdigest(b"one", 42)


@pytest.mark.parametrize("limit", [0, 3, 32])
def test_links_match_brute_force(spark, limit):
    rng = random.Random(5)
    base = [rng.getrandbits(64) for _ in range(12)]
    values = set(base)
    for x in base:
        for _ in range(25):
            for _ in range(rng.choice((1, 2, 2, 3, 4))):
                x ^= 1 << rng.randrange(64)
            values.add(x)
    values = sorted(values)
    want = plain_components({v - (1 << 64) if v >> 63 else v: v for v in values})
    signed = [(v - (1 << 64) if v >> 63 else v,) for v in values]
    edges = simhash.links(spark.createDataFrame(signed, "fp long"), limit).collect()
    assert all(((e.src ^ e.dst) & (1 << 64) - 1).bit_count() <= 2 for e in edges)
    found = {s: s for (s,) in signed}

    def top(x):
        while found[x] != x:
            x = found[x]
        return x

    for e in edges:
        found[max(top(e.src), top(e.dst))] = min(top(e.src), top(e.dst))
    groups = {}
    for s in found:
        groups.setdefault(top(s), set()).add(s)
    plain = {}
    for s, r in want.items():
        plain.setdefault(r, set()).add(s)
    assert sorted(map(sorted, groups.values())) == sorted(map(sorted, plain.values()))


def test_query_matches_brute_force_and_keeps_every_row(spark):
    rows = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    prints = {r.doc_id: simhash.fingerprint(r.text) for r in rows}
    want = plain_components(prints)
    got = {r.doc_id: r for r in simhash.op2_simhash(spark, SF).collect()}
    assert len(got) == len(rows)
    assert all(got[i].component_id == want[i] and got[i].fingerprint == f"{prints[i]:016x}" for i in want)


def test_nulls_empty_repeats_and_clashing_columns(spark):
    rows = [(1, None, "x"), (2, "", "y"), (3, "a b c d", "z"), (3, "a b c d", "z"), (None, "q r s t u", "z"), (4, "A  b\nc D", "w")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, fp string").withColumn("component_id", F.lit("mine"))
    found = sorted((r.doc_id or -1, r.component_id) for r in simhash.near_duplicates(docs).collect())
    assert found == [(-1, None), (1, 1), (2, 1), (3, 3), (3, 3), (4, 3)] or found[1:] == [(1, 1), (2, 1), (3, 3), (3, 3), (4, 3)]
    kept = simhash.deduplicate(docs)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id or -1 for r in kept.collect()) == [-1, 1, 3]
    empty = docs.limit(0)
    assert simhash.near_duplicates(empty).count() == 0 and simhash.deduplicate(empty).count() == 0


def test_clashing_ids_keep_a_row_of_each_component(spark):
    same, near = "a b c d e f g h i j k l m n o p q r s t", "one two three four five six seven"
    rows = [(1, same), (5, same), (5, near), (5, near), (None, near), (None, "quite another text than those"), (None, "quite another text than those"), (7, "of its own")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("digest", F.lit(0))
    for few in (simhash.DROP_LIMIT, 0):
        with pytest.MonkeyPatch.context() as patch:
            patch.setattr(simhash, "DROP_LIMIT", few)
            kept = sorted(((r.doc_id or -1, r.text) for r in simhash.deduplicate(docs).collect()))
        assert kept == [(-1, "quite another text than those"), (1, same), (5, near), (7, "of its own")]
