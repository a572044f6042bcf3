"""Ranks, running totals and medians in groups that several tasks work on, against plain rules."""

import random
import statistics

import pytest
from pyspark.sql import functions as F

from capstrata.operators import ranking, slugs


@pytest.mark.parametrize("at_once", [5, 1_000_000])
def test_running_totals_and_medians(spark, at_once):
    rng = random.Random(3)
    rows = [(rng.choice(["hot", "hot", "hot", "b", None]), i, rng.choice([1, 5, 5, rng.randrange(10**6)])) for i in range(900)]
    df = spark.createDataFrame(rows, "k string, i long, x long").repartition(4)
    got = {(r.k, r.i): r.before for r in ranking.running_total(df, ["k"], ["i"], F.col("x"), at_once=at_once).collect()}
    sums, want = {}, {}
    for k, i, x in rows:
        want[k, i] = sums.get(k, 0)
        sums[k] = sums.get(k, 0) + x
    assert got == want
    nulls = df.union(spark.createDataFrame([("b", 0, None), ("none", 0, None)], df.schema))
    found = {r.k: r.m for r in ranking.medians(nulls.where("k is not null"), "k", "x", "m", at_once).collect()}
    assert found == {k: statistics.median(x for g, _, x in rows if g == k) for k in ("hot", "b")}
    assert ranking.medians(df.limit(0), "k", "x", "m").count() == 0


def test_slugs_of_one_hot_base(spark):
    """Many rows of one base, dealt to several tasks, get the numbers that one after the other would give."""
    n = 3000
    rows = spark.range(n).select(F.lit("Acme Inc").alias("name"), F.col("id").alias("seq"), F.lit(None).cast("string").alias("x")).repartition(4)
    base = "acme-inc"
    used = spark.createDataFrame([(base,), (f"{base}-3",), (f"{base}-4",), (f"{base}-1000",), ("other",)], "slug string")
    got = {r.seq: r.slug for r in slugs.mint(rows, used, F.col("name"), F.col("seq"), at_once=400).collect()}
    free = (f"{base}-{i}" for i in range(2, 2 * n) if i not in (3, 4, 1000))
    assert got == {i: next(free) for i in range(n)}
