"""WARC archives: exact round trips through the index."""

import hashlib

import pytest
from pyspark.sql import functions as F

from capstrata.llm import warc

SF = "/root/testdata/sf0.001"


def plain(rows):
    bodies = [(i, (h or "").encode()) for i, h in rows]
    first = {}
    for i, b in bodies:
        if i is not None:
            first[b] = min(first.get(b, i), i)
    out = []
    for i, b in bodies:
        again = i is not None and len(b) >= 100 and first[b] < i
        out.append((i, len(b), hashlib.sha256(b).hexdigest(), "revisit" if again else "response", first[b] if again else None))
    return sorted(out, key=str)


def test_query_matches_the_plain_version(spark):
    rows = [(r.page_id, r.html) for r in spark.read.parquet(f"{SF}/pages.parquet").collect()]
    assert sorted(map(tuple, warc.op8_warc(spark, SF).collect()), key=str) == plain(rows)


def test_hard_rows_and_whole_records(spark, tmp_path):
    big = "<p>é\r\n\r\n</p>" * 40
    rows = [(5, big), (3, big), (9, big), (3, big), (1, None), (2, ""), (4, "x" * 99), (6, "x" * 99), (None, big), (7, "WARC/1.1\r\n\r\n" * 20), (8, "y" * 3_000_000)]
    urls = ["http://a/\n%0A: x", None]
    pages = spark.createDataFrame([(i, urls[k % 2], h) for k, (i, h) in enumerate(rows)], "page_id long, url string, html string").withColumn("refers_to", F.lit("clash")).repartition(3)
    folder = f"file://{tmp_path}/warc"
    index = warc.write_archives(pages, folder)
    got = warc.read_archives(index, folder, with_body=True).collect()
    assert sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got), key=str) == plain(rows)
    assert {r.url for r in got} == {"http://a/\n%0A: x", ""}
    assert all(bytes(r.body) == (dict(rows)[r.page_id] or "").encode() for r in got if r.record_type == "response" and r.page_id is not None)
    some = warc.read_archives(index.where("page_id in (4, 8)"), folder).collect()
    assert sorted(r.page_id for r in some) == [4, 8]


def test_damage_is_noticed(spark, tmp_path):
    folder = f"file://{tmp_path}/warc"
    index = warc.write_archives(spark.createDataFrame([(1, "u", "abc" * 50)], "page_id long, url string, html string"), folder)
    with pytest.raises(Exception):
        warc.read_archives(index.withColumn("payload_digest", F.lit("0")), folder).collect()


def test_empty_table(spark, tmp_path):
    pages = spark.createDataFrame([], "page_id long, url string, html string")
    index = warc.write_archives(pages, f"file://{tmp_path}/warc")
    assert index.count() == 0 and warc.read_archives(index, f"file://{tmp_path}/warc").count() == 0


def test_ranges_are_coalesced():
    places = [(0, 10), (10, 5), (100, 10), (90_000, 10), (90_010, 10)]
    assert warc.ranges(iter(places), gap=1000, most=1 << 20) == [(0, 110, 0, 3), (90_000, 90_020, 3, 5)]
    assert warc.ranges(iter([(0, 10), (10, 10), (20, 10)]), gap=0, most=20) == [(0, 20, 0, 2), (20, 30, 2, 3)]


def test_repeated_ids_lose_no_payload_and_multiply_no_row(spark, tmp_path):
    """Page 5 has two payloads, one of them page 1's; page 6 has two rows of page 1's payload; page 7 two of its own."""
    shared, own = "<p>shared</p>" * 20, "<p>own</p>" * 30
    rows = [(1, shared), (5, shared), (5, own), (6, shared), (6, shared), (7, "a" * 200), (7, "a" * 200), (8, own), (None, shared)]
    pages = spark.createDataFrame([(i, f"http://h/{k}", h) for k, (i, h) in enumerate(rows)], "page_id long, url string, html string").repartition(3)
    for few in (warc.BROADCAST_DIGESTS, 0):
        folder = f"file://{tmp_path}/warc-{few}"
        with pytest.MonkeyPatch.context() as patch:
            patch.setattr(warc, "BROADCAST_DIGESTS", few)
            index = warc.write_archives(pages, folder)
        got = warc.read_archives(index, folder).collect()
        assert sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got), key=str) == plain(rows)
        places = warc.payload_places(index)
        digests = sorted(hashlib.sha256(h.encode()).hexdigest() for _, h in rows)
        assert sorted(r.payload_digest for r in places.collect()) == digests
        bodies = warc.read_archives(places, folder, with_body=True).collect()
        assert sorted(hashlib.sha256(bytes(r.body)).hexdigest() for r in bodies) == digests


def test_payloads_are_not_shuffled(spark, tmp_path):
    pages = spark.createDataFrame([(i, "u", "x" * 100 + str(i % 3)) for i in range(9)], "page_id long, url string, html string")
    digested = warc.with_digests(pages)
    placed = digested.join(F.broadcast(warc.shared_payloads(digested)), "digest", "left")
    assert "Exchange hashpartitioning" not in placed._jdf.queryExecution().executedPlan().toString()
