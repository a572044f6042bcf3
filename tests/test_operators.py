"""Merges, resolution, slugs, moderation, profiles and streams on tiny tables."""

import itertools
import random

import pytest
from pyspark.sql import functions as F

from capstrata.functions import vocabulary as v
from capstrata.functions.text import company_name_key
from capstrata.operators import checks, citations, directory, ingest, market, merge, moderation, profile, resolve, slugs
from capstrata.sources import demo
from capstrata.streaming import landing



@pytest.fixture(scope="module")
def at(spark):
    return F.lit("2026-01-01").cast("timestamp_ntz")



def walk(records, stored, register):
    """The rule, one record after the other."""
    keys, domains, names = {}, {}, {}
    for i, (key, domain, name) in stored.items():
        for table, x in ((keys, key), (domains, domain), (names, name)):
            if x:
                table.setdefault(x, str(i))
    out = {}
    for seq, key, domain, name in sorted(records):
        hit = keys.get(key) or (domains.get(domain) if domain else None) or (names.get(name) if name else None)
        if hit is None:
            hit = f"new:{seq}"
            keys[key] = hit
            if domain:
                domains.setdefault(domain, hit)
            if name:
                names.setdefault(name, hit)
        elif register:
            keys.setdefault(key, hit)
        out[seq] = hit
    return out


@pytest.mark.parametrize("seed,register", list(itertools.product(range(3), (False, True))))
def test_resolution_is_that_of_one_by_one(spark, seed, register):
    rng = random.Random(seed)
    pick = lambda prefix, n, gap=0.3: None if rng.random() < gap else f"{prefix}{rng.randrange(n)}"
    stored = {i: (f"S:{i}", pick("d", 20), pick("n", 20)) for i in range(12)}
    records = [(i, f"S:{rng.randrange(60)}", pick("d", 25), pick("n", 30)) for i in range(120)]
    rows = spark.createDataFrame([(i, *(k.split(":")), d, n, i) for i, (k, d, n) in stored.items()], "id int, external_source string, external_id string, domain string, name string, created_at int")
    index = resolve.match_index(rows, "id", F.col("name"))
    got = resolve.resolve(spark.createDataFrame(records, "seq long, key string, domain string, name_key string"), index, register).collect()
    assert {r.seq: r.entity_id for r in got} == walk(records, stored, register)


@pytest.mark.parametrize("register", [False, True])
def test_resolution_of_hot_keys_domains_and_names(spark, register, monkeypatch):
    """A third of the records share a key, a third a domain, a third a name: a few rounds, whatever the size."""
    records = [(i, "S:hot" if i % 3 == 0 else f"S:{i}", "hot.example" if i % 3 == 1 else ("stored.example" if i % 5 == 0 else None), "hot" if i % 3 == 2 else f"n{i // 7}") for i in range(600)]
    rows = spark.createDataFrame([("S", "s1", "stored.example", "stored", 1)], "external_source string, external_id string, domain string, name string, id long").withColumn("created_at", F.lit(0))
    rounds = []
    decided = resolve._decided
    monkeypatch.setattr(resolve, "_decided", lambda *a: rounds.append(1) or decided(*a))
    got = resolve.resolve(spark.createDataFrame(records, "seq long, key string, domain string, name_key string"), resolve.match_index(rows, "id", F.col("name")), register).collect()
    assert {r.seq: r.entity_id for r in got} == walk(records, {1: ("S:s1", "stored.example", "stored")}, register)
    assert len(rounds) <= 6


def test_slugs_are_unique_and_in_order(spark):
    names = ["Acme", "Acme", "acme!", "Acme 2", "Beta", "", "日本"]
    rows = spark.createDataFrame(list(enumerate(names)), "i int, name string")
    used = spark.createDataFrame([("beta",), ("acme-3",)], "slug string")
    got = {r.i: r.slug for r in slugs.mint(rows, used, F.col("name"), F.col("i")).collect()}
    assert len(set(got.values())) == len(names) and not {"beta", "acme-3"} & set(got.values())
    assert got[0] == "acme" and got[4] == "beta-2" and got[5] == "company" and got[6] == "company-2"
    keyed = {r.i: r.slug for r in slugs.mint(rows.where("i < 3"), used, F.col("name"), F.col("i"), F.lit("X 9")).collect()}
    assert keyed == {0: "acme", 1: "acme-x-9", 2: "acme-x-9-2"}
    assert slugs.clashes(slugs.numbered(spark.createDataFrame([("acme", "a"), ("acme", "b"), ("acme-2", "c")], "base string, name string"))).collect()[0].slug == "acme-2"


def records(spark, rows):
    schema = "seq long, company_external_id string, company struct<name:string,hq:string,founded:int,industry:array<string>,stage:string,total_raised_usd:double,domain:string,website_url:string,linkedin_url:string,primary_sector:string,one_liner:string,description:string,headcount:int,status:string>, round struct<external_id:string,name:string,date:date,amount_usd:double>, people array<struct<external_id:string,name:string,role:string,title:string,since:int>>, investors array<struct<external_id:string,investor_external_id:string,name:string,type:string,first_round:string,rounds:int>>, acquisitions array<struct<external_id:string,target:string,date:date,amount_usd:double,rationale:string>>, exits array<struct<external_id:string,type:string,date:date,value_usd:double,detail:string>>"
    return spark.createDataFrame(rows, schema)


def company(name, domain=None, raised=0.0, sector=None, one_liner=None):
    return (name, "", 0, [], "Seed", raised, domain, None, None, sector, one_liner, None, None, None)


def state(store):
    return {k: sorted(map(str, df.collect())) for k, df in vars(store).items() if k != "revisions"}


def test_ingest_run_is_idempotent(spark, at):
    rows = [
        (1, "10", company("Acme, Inc.", "acme.com", 5.4), ("r1", "First", None, 5.4), [("p1", "Ann", "CEO", None, 2020)], [("10:investor:Q1", "Q1", "Fund One LP", "Venture", "Undisclosed", 1)], [], []),
        (2, "11", company("ACME", None, 7.0, "Fintech", "We pay."), ("r2", "Second", None, 7.5), [], [("11:investor:x", None, "fund one", "Angel", "Undisclosed", 1), ("11:investor:y", None, "...", "Angel", "Undisclosed", 1)], [], []),
        (3, "12", company("Other", "acme.com", 9.0), None, [], [], [("a1", "Tiny", None, 1.5, "why")], [("x1", "IPO", None, None, "public")]),
        (4, "10", company("Acme, Inc.", "acme.com", 8.0), ("r1", "ignored", None, 6.0), [("p1", "Ann", "Chair", "Dr", 2021)], [], [], []),
        (5, "13", company("Other"), None, [], [], [], []),
    ]
    store = ingest.run(ingest.Store.empty(spark), records(spark, rows), None, v.SEC_EDGAR, at)
    companies = {r.external_id: r for r in store.companies.collect()}
    # the second and third match the first by name and domain; the fourth is the first's own update, the fifth is new
    assert companies.keys() == {"10", "13"}
    acme = companies["10"]
    assert (acme.slug, acme.domain, acme.primary_sector, acme.one_liner, acme.moderation_status) == ("acme-inc", "acme.com", "Fintech", "We pay.", "APPROVED")
    assert companies["13"].description.endswith("notice of exempt offering with the SEC.")
    rounds = {r.external_id: r for r in store.rounds.collect()}
    assert (rounds["r1"].name, rounds["r1"].amount_usd, rounds["r2"].amount_usd) == ("ignored", 6, 8)
    assert {r.name for r in store.investors.collect()} == {"Fund One LP"}
    held = {r.external_id: r for r in store.holdings.collect()}
    assert held["10:investor:Q1"].investor_id == held["11:investor:x"].investor_id and held["11:investor:y"].investor_id is None
    assert store.acquisitions.first().amount_usd == 2 and store.exits.first().value_usd is None
    again = ingest.run(store, records(spark, rows), None, v.SEC_EDGAR, at)
    third = ingest.run(again, records(spark, rows), None, v.SEC_EDGAR, at)
    assert state(third) == state(again)
    assert {k: len(x) for k, x in state(again).items()} == {k: len(x) for k, x in state(store).items()}
    assert again.revisions.count() == 0
    renamed = ingest.run(again, records(spark, [(1, "10", company("Acme Robotics", "acme.com", 9.0), None, [], [], [], [])]), None, v.SEC_EDGAR, at)
    assert {(r.field, r.before, r.after, r.actor_source) for r in renamed.revisions.collect()} == {("name", '"Acme, Inc."', '"Acme Robotics"', "SEC_EDGAR"), ("total_raised_usd", "8", "9", "SEC_EDGAR")}
    n = ingest.counters(store, again, records(spark, rows), None)
    assert n["processed"] == n["upserted"] == 5 and n["new_companies"] == n["skipped"] == 0


def test_firms_fill_blanks_only(spark, at):
    store = ingest.Store.empty(spark)
    first = spark.createDataFrame([(1, "7", "Sequoia Capital", "Venture", "sequoia.com", "Menlo", 3), (2, "8", "SEQUOIA CAPITAL LLC", "Angel", None, "Elsewhere", None), (3, "9", "Sequoia Planning", "Hedge fund", None, None, None)], "seq long, external_id string, name string, type string, domain string, hq string, fund_count long")
    store = ingest.run(store, None, first, v.SEC_ADV, at)
    rows = {r.name: r for r in store.investors.collect()}
    assert rows.keys() == {"Sequoia Capital", "Sequoia Planning"} and rows["Sequoia Capital"].hq == "Menlo"
    graph = spark.createDataFrame([(1, "Q1", "Sequoia", "Private equity", "sequoia.com", "Nowhere", None, 1972)], "seq long, external_id string, name string, type string, domain string, hq string, fund_count long, founded_year int")
    store = ingest.run(store, None, graph, v.WIKIDATA, at)
    row = next(r for r in store.investors.collect() if r.domain == "sequoia.com")
    assert (row.name, row.type, row.hq, row.founded_year, row.fund_count) == ("Sequoia Capital", "Venture", "Menlo", 1972, 3)


def test_upsert_hard_rows(spark):
    schema = "external_source string, external_id string, amount_usd long, date string, name string, moderation_status string"
    stored = spark.createDataFrame([("S", "1", 1, "a", "old", "PENDING"), (None, None, 5, "z", "own", "APPROVED")], schema)
    new = spark.createDataFrame([("S", "1", 2, "b", "new", 1), ("S", "1", 3, None, "newer", 2), ("S", "2", None, None, "x", 1), ("S", None, 9, "q", "lost", 1)], "external_source string, external_id string, amount_usd long, date string, name string, seq int").withColumn("extra", F.lit(1))
    out = merge.upsert_children("round", stored, new, ["seq"])
    assert out.columns == stored.columns
    assert sorted(map(tuple, out.collect()), key=str) == sorted([("S", "1", 3, None, "old", "PENDING"), (None, None, 5, "z", "own", "APPROVED"), ("S", "2", None, None, "x", "APPROVED")], key=str)
    again = merge.upsert_children("round", out, new, ["seq"])
    assert sorted(map(str, again.collect())) == sorted(map(str, out.collect()))
    assert merge.upsert_children("round", stored, new.limit(0), ["seq"]).count() == 2


def test_revisions_replay(spark, at):
    before = spark.createDataFrame([(1, "a", [1], None), (2, "b", [], 5)], "id int, s string, l array<int>, n long")
    after = spark.createDataFrame([(1, "a", [1, 2], 7), (2, None, [], 5), (3, "new", [], 1)], "id int, s string, l array<int>, n long")
    got = {(r.entity_id, r.field): (r.before, r.after) for r in merge.revisions(before, after, "id", ("s", "l", "n"), "company", F.lit("S"), at).collect()}
    assert got == {(1, "l"): ("[1]", "[1,2]"), (1, "n"): ("null", "7"), (2, "s"): ('"b"', "null")}


def test_decisions_and_linked_firms(spark):
    rows = spark.createDataFrame([(1, 10, "A", "PENDING"), (2, 10, "B", "PENDING"), (3, 10, "C", "PENDING")], "entity_id int, company_id int, name string, moderation_status string")
    asked = spark.createDataFrame([("round", 1, "APPROVED", 9, 1), ("round", 2, "APPROVED", 9, 1), ("round", 2, "REJECTED", 9, 2), ("person", 3, "APPROVED", 9, 1), ("round", 3, "PENDING", 9, 1)], "type string, entity_id int, decision string, admin_id int, decided_at int")
    new, log = moderation.decide(rows, asked, "round")
    assert {r.entity_id: r.moderation_status for r in new.collect()} == {1: "APPROVED", 2: "REJECTED", 3: "PENDING"}
    assert [(r.entity_id, r.action, r.before) for r in log.collect()] == [("1", "CREATE", "null")] and '"moderation_status":"APPROVED"' in log.first().after
    firms = spark.createDataFrame([(1, "PENDING"), (2, "REJECTED"), (3, "PENDING")], "investor_id int, moderation_status string")
    held = spark.createDataFrame([(7, 1), (8, 2), (9, None)], "entity_id int, investor_id int")
    yes = spark.createDataFrame([("investor", 7, "APPROVED"), ("investor", 8, "APPROVED"), ("investor", 9, "APPROVED")], "type string, entity_id int, decision string")
    assert {r.investor_id: r.moderation_status for r in moderation.publish_linked_firms(firms, held, yes).collect()} == {1: "APPROVED", 2: "REJECTED", 3: "PENDING"}
    kinds = moderation.dispatch(spark.createDataFrame([("proposal",), ("round",), ("x",), (None,)], "type string"))
    assert [k.count() for k in kinds] == [1, 1, 2]


def test_proposals(spark, at):
    firms = spark.createDataFrame([(1, 'A "q"', ["x"], 5, None), (2, "B", None, None, "Active")], "company_id int, name string, industry array<string>, last_valuation_usd long, operating_status string")
    schema = "proposal_id int, company_id int, changes map<string,string>, submitted_by int, created_at int, source_url string"
    asked = spark.createDataFrame(
        [
            (1, 1, {"name": '"A \\"q\\""', "industry": '["x"]', "last_valuation_usd": "5"}, 1, 1, None),
            (2, 1, {"name": '"New \\"q\\""', "last_valuation_usd": "null", "slug": '"no"'}, 1, 2, "https://s"),
            (3, 1, {"industry": '["x","y"]', "name": '"Newer"'}, 1, 3, None),
            (4, 2, {"operating_status": '"Active"', "industry": "null"}, 1, 1, None),
            (5, 9, {"name": '"none"'}, 1, 1, None),
        ],
        schema,
    )
    kept = moderation.proposed(asked, firms)
    assert {r.proposal_id: sorted(r.changes) for r in kept.collect()} == {2: ["last_valuation_usd", "name"], 3: ["industry", "name"]}
    after, log, cited = moderation.apply_proposals(firms, kept, F.lit(9), at)
    row = {r.company_id: r for r in after.collect()}
    assert (row[1].name, row[1].industry, row[1].last_valuation_usd) == ("Newer", ["x", "y"], None) and row[2].name == "B"
    assert {(r.proposal_id, r.field, r.before, r.after) for r in log.collect()} == {(2, "name", '"A \\"q\\""', '"New \\"q\\""'), (2, "last_valuation_usd", "5", "null"), (3, "industry", '["x"]', '["x","y"]'), (3, "name", '"New \\"q\\""', '"Newer"')}
    assert {(r.source_url, r.field) for r in cited.collect()} == {("https://s", "name"), ("https://s", "last_valuation_usd")}


def test_market_and_directory_edges(spark):
    companies = spark.createDataFrame([(1, "a", "A", "X", 10, None, "APPROVED"), (2, "b", "B", "X", 20, 4, "APPROVED"), (3, "c", "C", None, 5, 1_000_000_000, "APPROVED"), (4, "d", "D", "X", 99, 9, "PENDING")], "company_id int, slug string, name string, sector string, total_raised_usd long, last_valuation_usd long, moderation_status string").withColumn("one_liner", F.lit(None).cast("string")).withColumn("domain", F.lit(""))
    rounds = spark.createDataFrame([(1, 1, "2024-01-01", 5, "APPROVED"), (2, 1, "2030-01-01", 5, "APPROVED"), (3, 3, "2024-01-01", 5, "APPROVED"), (4, 4, "2024-01-01", 5, "APPROVED"), (5, 2, "2023-10-02", 0, "APPROVED")], "round_id int, company_id int, date string, amount_usd long, moderation_status string").withColumn("date", F.col("date").cast("timestamp_ntz"))
    as_of = F.lit("2024-01-01").cast("timestamp_ntz")
    stats = market.sector_stats(companies, rounds, as_of).collect()
    assert [tuple(r) for r in stats] == [("X", 2, 3, 30.0, 4.0, 100.0)]
    assert tuple(market.totals(companies, rounds, as_of).first()) == (35.0, 4, 1, "Q1 2024")
    empty = market.totals(companies.limit(0), rounds.limit(0), as_of).first()
    assert tuple(empty) == (0.0, 0, 0, "Q1 2024")
    assert [r.slug for r in directory.page_of(companies, directory.company_order("valuation")).collect()] == ["c", "d", "b", "a"]
    assert directory.typeahead(companies, "  ").count() == 0 and [r.slug for r in directory.typeahead(companies, "a").collect()] == ["a"]
    assert directory.find_companies(companies, q="%").count() == 0
    for bad in (lambda: directory.company_order("size"), lambda: directory.checked_page(0, 5), lambda: directory.checked_page(1, 101), lambda: directory.find_investors(companies, kind="Bank")):
        with pytest.raises(ValueError):
            bad()
    assert directory.lenient({"q": " x ", "sector": "Nope", "sort": "name", "page": "0"}, {"sector": v.SECTORS, "sort": v.COMPANY_SORTS}) == {"q": "x", "sort": "name"}
    assert directory.page_window(7, 12) == [1, None, 5, 6, 7, 8, 9, None, 12] and directory.page_window(1, 1) == [1] and directory.pages_of(0) == 1 and directory.pages_of(26) == 2
    assert directory.sector_by_slug("consumer-retail") == "Consumer & retail" and directory.sector_by_slug("x") is None


def test_profile_previews_hide_citations(spark):
    companies = spark.createDataFrame([(1, "APPROVED"), (2, "APPROVED")], "company_id int, moderation_status string")
    kids = spark.createDataFrame([(i, 1, f"2024-01-0{i}", "APPROVED" if i < 5 else "PENDING") for i in range(1, 6)], "entity_id int, company_id int, date string, moderation_status string")
    p = profile.profiles(companies, [profile.section(kids, "rounds", ["date", "entity_id"], ["date", "entity_id"])])
    cut = profile.gated(p, ["rounds"], F.lit(False))
    rows = {r.company_id: r for r in cut.collect()}
    assert [x.entity_id for x in rows[1].rounds] == [1, 2] and rows[1].rounds_total == 4 and rows[2].rounds == [] and rows[2].rounds_total == 0
    few = profile.profiles(companies, [profile.section(kids, "rounds", ["date", "entity_id"], ["date", "entity_id"], profile.PREVIEW)])
    assert [tuple(r) for r in few.orderBy("company_id").collect()] == [tuple(r) for r in cut.orderBy("company_id").collect()]
    cites = spark.createDataFrame([(i, str(i), 1, i) for i in range(1, 5)], "citation_id int, entity_id string, source_id int, created_at int")
    sources = spark.createDataFrame([(1, "u", "Press", None, None)], "source_id int, url string, source_type string, publisher string, title string")
    shown = cut.select(F.explode("rounds").alias("r")).select(F.col("r.entity_id").cast("string").alias("entity_id"))
    assert [r.citation_id for r in profile.shown_citations(cites, sources, shown).collect()] == [1, 2]
    money = spark.createDataFrame([(None, 1.0), (5, None)], "r long, g double").select(profile.financials(F.col("r"), F.col("g"), F.lit(None).cast("double")).alias("f")).collect()
    assert money[0].f is None and money[1].f.growth_pct == 0.0


def test_watchlists(spark):
    companies = spark.createDataFrame([(1, "a", "A", "Seed", 1, "APPROVED"), (2, "b", "B", "Seed", 1, "PENDING")], "company_id int, slug string, name string, stage string, total_raised_usd long, moderation_status string")
    saved = spark.createDataFrame([(7, 1, 5)], "user_id int, company_id int, saved_at int")
    asked = spark.createDataFrame([(7, "a", 9), (8, "a", 9), (8, "b", 9), (8, "zz", 9)], "user_id int, slug string, saved_at int")
    out = profile.save(saved, asked, companies)
    assert sorted(map(tuple, out.collect())) == [(7, 1, 5), (8, 1, 9)]
    assert sorted(map(tuple, profile.save(out, asked, companies).collect())) == [(7, 1, 5), (8, 1, 9)]
    assert profile.unsave(out, asked.select("user_id", "slug").where("user_id = 7"), companies).count() == 1
    assert {(r.user_id, r.slug): r.saved for r in profile.is_saved(out, asked.select("user_id", "slug"), companies).collect()} == {(7, "a"): True, (8, "a"): True, (8, "b"): False, (8, "zz"): False}


def test_citation_backfill_is_idempotent(spark):
    t = spark.createDataFrame([("company", "1", "u1", "SEC filing", "SEC", "t", "r", 1), ("round", "2", "u1", "SEC filing", "SEC", "t", "r", 2), ("round", "3", "u2", "Wikidata", "Wikidata", "t", "r", 2)], "entity_type string, entity_id string, url string, source_type string, publisher string, title string, reference string, retrieved_at int")
    sources = spark.createDataFrame([("u2", "Press")], "url string, source_type string")
    cited = spark.createDataFrame([], "url string, entity_type string, entity_id string, field string")
    s1, c1 = citations.backfill(sources, cited, [t])
    s2, c2 = citations.backfill(s1, c1, [t])
    assert (s1.count(), c1.count(), s2.count(), c2.count()) == (2, 3, 2, 3)
    assert {r.url: r.source_type for r in s1.collect()} == {"u1": "SEC filing", "u2": "Press"}


def test_validation_of_contributions(spark):
    cases = {
        "round": ("name string, date string, amount_usd long, post_money_usd long, investors array<struct<name:string,lead:boolean>>, source_url string", ("A", "2024-01-01", 1, None, [("x", True)], None), ("", "soon", -1, -1, [], "ftp://x"), ["name", "date", "amount_usd", "post_money_usd", "investors", "source_url"]),
        "person": ("name string, role string, since int, linkedin_url string, source_url string", ("A", "CEO", 2020, None, "https://a.b/c"), (" ", None, None, "x", None), ["name", "role", "since", "linkedin_url"]),
        "investor": ("name string, type string, first_round string, rounds int, website_url string, source_url string", ("A", "Angel", "Seed", 0, None, None), ("A", "Bank", "", -1, "a", None), ["type", "first_round", "rounds", "website_url"]),
        "acquisition": ("target string, date string, amount_usd long, rationale string, source_url string", ("A", "2024-01-01T00:00:00Z", None, "r", None), (None, "2024-13-01", -1, "", None), ["target", "date", "amount_usd", "rationale"]),
        "exit": ("type string, date string, value_usd long, detail string, source_url string", ("IPO", "2024-01-01", 5, "d", None), ("Sale", None, -5, None, None), ["type", "date", "value_usd", "detail"]),
        "diversity": ("label string, value string, note string, source_url string", ("a", "b", "c", None), (None, "", " ", ""), ["label", "value", "note", "source_url"]),
    }
    for kind, (schema, good, bad, reasons) in cases.items():
        kept, rejected = checks.split_valid(spark.createDataFrame([good, bad], schema), checks.contribution_rules(kind))
        assert kept.count() == 1, kind
        assert [sorted(r.reasons) for r in rejected.collect()] == [sorted(reasons)], kind


def test_validation_of_proposals(spark):
    good = [{"name": '"A"'}, {"last_valuation_usd": "null", "industry": '["a"]'}, {"primary_sector": '"Fintech"', "website_url": "null"}]
    bad = [({}, ["fields"]), ({"slug": '"x"'}, ["fields"]), ({"name": '" "', "founded": '"x"'}, ["name", "founded"]), ({"industry": "[]", "status": '"Gone"', "stage": "null"}, ["industry", "status", "stage"]), ({"linkedin_url": '"no"', "headcount": "-1"}, ["linkedin_url", "headcount"])]
    rows = spark.createDataFrame([(c,) for c in [*good, *(c for c, _ in bad)]], "changes map<string,string>")
    kept, rejected = checks.split_valid(rows, checks.proposal_rules())
    assert kept.count() == len(good)
    assert sorted(sorted(r.reasons) for r in rejected.collect()) == sorted(sorted(r) for _, r in bad)


def test_demo_tables_link_by_name(spark):
    t = demo.tables(spark)
    rows = t["holdings"].withColumn("seq", F.monotonically_increasing_id()).withColumn("investor_id", F.lit(None).cast("long"))
    stored = spark.createDataFrame([(7, "Long Bridge Capital"), (9, "Long Bridge Capital")], "investor_id long, name string")
    linked, fresh = merge.link_by_name(rows, stored)
    assert sorted(r.investor_id for r in linked.collect()) == ["7", "named:Fjord Ventures", "named:Fjord Ventures"]
    assert [(r.name, r.type) for r in fresh.collect()] == [("Fjord Ventures", "Venture")]
    p = profile.profiles(t["companies"], [profile.section(t["rounds"], "rounds", ["date", "name"], ["date"])])
    assert {r.slug: r.rounds_total for r in p.collect()} == {"northwind-grid": 2, "tidepool-labs": 1, "copperline": 1}
    order = [r.slug for r in t["companies"].orderBy(*directory.fallback_order("valuation")).collect()]
    assert order == ["copperline", "northwind-grid", "tidepool-labs"]


def test_landed_files_merge_once(spark, tmp_path):
    schema = "external_source string, external_id string, amount_usd long, date string, moderation_status string"
    inbox, table = tmp_path / "in", str(tmp_path / "table")
    inbox.mkdir()
    batch = landing.versioned_merge(table, lambda old, new: merge.upsert_children("round", old, new.withColumn("seq", F.col("amount_usd")), ["seq"]), schema)

    def catch_up():
        landing.catch_up(landing.new_files(spark, str(inbox), "json", schema), batch, str(tmp_path / "check")).awaitTermination()

    (inbox / "1.json").write_text('{"external_source":"S","external_id":"1","amount_usd":1}\n{"external_source":"S","external_id":"2","amount_usd":1}\n')
    catch_up()
    (inbox / "2.json").write_text('{"external_source":"S","external_id":"1","amount_usd":9}\n')
    catch_up()
    catch_up()
    rows = {r.external_id: r.amount_usd for r in landing.latest_version(spark, table).collect()}
    assert rows == {"1": 9, "2": 1}


def test_stream_of_deals(spark, tmp_path):
    inbox = tmp_path / "in"
    inbox.mkdir()
    (inbox / "1.json").write_text("".join(f'{{"external_source":"S","external_id":"{i % 3}","amount_usd":5,"date":"2024-01-0{1 + i % 3}T10:00:00"}}\n' for i in range(6)))
    stream = landing.new_files(spark, str(inbox), "json", "external_source string, external_id string, amount_usd long, date timestamp")
    q = landing.deals_by_day(stream).writeStream.format("memory").queryName("deals").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination()
    assert sorted((str(r.day.start)[:10], r.deals, r.amount_usd) for r in spark.table("deals").collect()) == [("2024-01-01", 1, 5), ("2024-01-02", 1, 5), ("2024-01-03", 1, 5)]


def test_name_index_prefers_the_oldest(spark):
    rows = spark.createDataFrame([(2, "S", "1", "a.com", "Acme Inc", 5), (1, None, None, "a.com", "ACME", 9)], "company_id int, external_source string, external_id string, domain string, name string, created_at int")
    index = resolve.match_index(rows, "company_id", company_name_key(F.col("name")))
    assert index["domain"].first().by_domain == 2 and index["name_key"].first().by_name_key == 2 and index["key"].count() == 1
