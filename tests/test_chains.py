"""Resolution of records that wait for one another, against the rule of one after the other."""

import random

import pytest
from pyspark.sql import functions as F
from test_operators import walk

from capstrata.operators import resolve

SCHEMA = "seq long, key string, domain string, name_key string"


def resolved(spark, records, register):
    none = spark.createDataFrame([], "id string, external_source string, external_id string, domain string, name string, created_at int")
    got = resolve.resolve(spark.createDataFrame(records, SCHEMA), resolve.match_index(none, "id", F.col("name")), register).collect()
    return {r.seq: r.entity_id for r in got}, {r.seq: r.how for r in got}


@pytest.mark.parametrize("register", [False, True])
def test_a_long_chain_takes_few_rounds(spark, register, monkeypatch):
    """Each record shares its domain with one neighbour and its name with the other."""
    n, rounds, decided = 1000, [], resolve._decided
    monkeypatch.setattr(resolve, "_decided", lambda *a: rounds.append(1) or decided(*a))
    records = [(i, f"S:{i}", f"d{i // 2}", f"n{(i + 1) // 2}") for i in range(n)]
    ids, how = resolved(spark, records, register)
    assert ids == walk(records, {}, register) and len(rounds) <= 12
    assert all(how[i] == "new" for i in range(0, n, 2)) and {how[i] for i in range(1, n, 2)} <= {"domain", "name"}


@pytest.mark.parametrize("seed", [0])
def test_chains_and_webs_at_once(spark, seed, monkeypatch):
    """The shorter way from the first round on, over records that wait for one, several or none."""
    monkeypatch.setattr(resolve, "CHAINS_AFTER", 0)
    rng = random.Random(seed)
    pick = lambda prefix, n: None if rng.random() < 0.3 else f"{prefix}{rng.randrange(n)}"
    records = [(i, f"S:{rng.randrange(22)}", pick("d", 14), pick("n", 14)) for i in range(26)]
    records += [(200 + i, f"C:{i}", f"cd{i // 2}", f"cn{(i + 1) // 2}" if i % 9 else "n1") for i in range(8)]
    for register in (False,):
        assert resolved(spark, records, register)[0] == walk(records, {}, register)
