"""Tables kept as versions of partitions: what a merge leaves alone, writes and repeats."""

from pathlib import Path

import pytest
from pyspark.sql import functions as F

from capstrata.operators import ingest, merge
from capstrata.operators.versions import Versions

SCHEMA = "external_source string, external_id string, amount_usd long, date string, moderation_status string"


def table(spark, path, parts=8):
    return Versions(spark, str(path), merge.KEY, SCHEMA, parts)


def rows(spark, ids, amount):
    return spark.createDataFrame([("S", str(i), amount, "2026-01-01", "APPROVED") for i in ids], SCHEMA)


def combine(old, new):
    return merge.upsert_children("round", old, new, ["amount_usd"])


def files(path):
    return {str(p): p.stat().st_mtime_ns for p in Path(path).rglob("*.parquet") if "/data/" in str(p)}


def test_untouched_partitions_stay_and_repeats_write_none(spark, tmp_path):
    t = table(spark, tmp_path)
    assert t.read().count() == 0 and len(t.write(rows(spark, range(200), 1))) == 8
    before = files(tmp_path)
    written, old, new = t.merge(rows(spark, [3, 1000], 7), combine)
    assert 1 <= len(written) <= 2 and old.count() + 1 == new.count() < 200
    after = files(tmp_path)
    assert before.items() <= after.items() and {p.split("__part=")[1].split("/")[0] for p in after.keys() - before.keys()} == {str(p) for p in written}
    moved = merge.revisions(old, new, "external_id", ("amount_usd",), "round", F.lit("S"), F.lit("2026-01-01").cast("timestamp_ntz")).collect()
    assert {r.entity_id for r in moved} == {"3"}
    assert t.merge(rows(spark, [3, 1000], 7), combine)[0] == set() and files(tmp_path) == after and t.versions() == [0, 1]
    held = {r.external_id: r.amount_usd for r in t.read().collect()}
    assert len(held) == 201 and held["3"] == held["1000"] == 7 and held["4"] == 1
    assert t.read(before=1).where("amount_usd = 7").count() == 0


def test_same_number_again_and_unfinished_versions(spark, tmp_path):
    t = table(spark, tmp_path)
    t.merge(rows(spark, range(20), 1), combine, number=0)
    t.merge(rows(spark, [5], 2), combine, number=1)
    t.merge(rows(spark, [5], 2), combine, number=1)
    assert {r.amount_usd for r in t.read().where("external_id = '5'").collect()} == {2} and t.read().count() == 20
    (tmp_path / "manifest" / "v=1" / "_SUCCESS").unlink()
    assert t.read().where("amount_usd = 2").count() == 0
    t.merge(rows(spark, [5], 2), combine, number=1)
    assert t.read().where("amount_usd = 2").count() == 1


def test_rows_that_go_and_keys_that_are_null(spark, tmp_path):
    t = table(spark, tmp_path, parts=3)
    keyless = spark.createDataFrame([(None, None, 1, None, None)] * 2, SCHEMA)
    t.write(rows(spark, range(9), 1).union(keyless))
    assert t.read().count() == 11
    assert t.write(keyless) and t.read().count() == 2
    assert t.write(keyless) == set()
    with pytest.raises(ValueError):
        Versions(spark, str(tmp_path / "none"), merge.KEY).read()


def test_a_store_is_saved_by_changed_partitions(spark, tmp_path):
    company = "struct<name:string,domain:string,hq:string,founded:int,industry:array<string>,stage:string,total_raised_usd:double,website_url:string,linkedin_url:string,primary_sector:string,one_liner:string,description:string,headcount:int,status:string>"
    investor = "array<struct<external_id:string,investor_external_id:string,name:string,type:string,first_round:string,rounds:int>>"
    one = lambda i, raised: (i * 100 << 33, f"k{i}", (f"Company {i}", "", "Oslo", 2000, [], "Seed", raised, None, None, None, None, None, 1, "Private"), [(f"k{i}:a", f"f{i % 5}", f"{"Alder Birch Cedar Dogwood Elm".split()[i % 5]} Capital", "Venture", "Seed", 1), (f"k{i}:b", None, "Common firm", "Angel", "Seed", 1)])
    # numbered as Spark does over thousands of partitions
    made = lambda raised: spark.createDataFrame([one(i, raised if i == 7 else 5.0) for i in range(30)], f"seq long, company_external_id string, company {company}, investors {investor}")
    at = F.lit("2026-01-01").cast("timestamp_ntz")
    folder = str(tmp_path)
    first = ingest.save(ingest.run(ingest.load(spark, folder), made(5.0), None, "S", at), folder)
    assert first["companies"] and first["holdings"] and first["investors"]
    store = ingest.load(spark, folder)
    assert (store.companies.count(), store.holdings.count(), store.investors.count(), store.revisions.count()) == (30, 60, 6, 0)
    assert not any(ingest.save(ingest.run(store, made(5.0), None, "S", at), folder).values())
    moved = ingest.save(ingest.run(ingest.load(spark, folder), made(9.0), None, "S", at), folder)
    assert len(moved["companies"]) == len(moved["revisions"]) == 1 and not moved["holdings"] and not moved["investors"]
    assert [(r.field, r.after) for r in ingest.load(spark, folder).revisions.collect()] == [("total_raised_usd", "9")]


def test_rows_that_fail_cost_themselves_only(spark):
    company, deal = "struct<name:string,total_raised_usd:double>", "array<struct<amount_usd:double>>"
    rows = [("a", ("A", 1.0), []), ("b", (None, 1.0), []), (None, ("C", 1.0), []), ("d", ("D", float("nan")), []), ("e", ("E", None), [(1e30,)]), ("f", ("F", 5.0), [(None,), (7.0,)]), ("g", None, None), (" ", ("H", 1.0), None)]
    kept, refused, n = ingest.taken(spark.createDataFrame(rows, f"company_external_id string, company {company}, acquisitions {deal}").repartition(3))
    assert {r.company_external_id for r in kept.collect()} == {"a", "f"} and n == {"processed": 8, "taken": 2}
    assert sorted((r.key or "", r.reject) for r in refused.collect()) == [("", "no key"), (" ", "no key"), ("b", "no name"), ("d", "no amount"), ("e", "no amount"), ("g", "no name")]
    assert ingest.taken(None)[2] == {"processed": 0, "taken": 0}
