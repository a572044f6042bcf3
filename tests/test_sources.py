"""Readers of filings, rosters and graph extracts on small landed files."""

import datetime as dt
import json
import zipfile

import pyarrow as pa
from pyspark.sql import functions as F

from capstrata.functions.vocabulary import SEC_EDGAR
from capstrata.operators import ingest
from capstrata.plans import ingestion
from capstrata.functions import vocabulary as v
from capstrata.sources import filings, graph, landed, roster

INDEX = """Description: daily index

Form Type   Company Name                 CIK         Date Filed  File Name
-----------------------------------------------------------------------------
D           ACME ROBOTICS INC            1234        20260713    edgar/data/1234/0001234567-26-000001.txt
D           ACME ROBOTICS INC            1234        20260713    edgar/data/1234/0001234567-26-000001.txt
D/A         BETA LLC                     77          20260710    edgar/data/77/0000000077-26-000002.txt
10-K        GAMMA CORP                   88          20260710    edgar/data/88/0000000088-26-000003.txt
"""
PERSON = "<relatedPersonInfo><relatedPersonName><firstName>{f}</firstName><lastName>{l}</lastName></relatedPersonName><relatedPersonRelationshipList>{r}</relatedPersonRelationshipList><relationshipClarification>{c}</relationshipClarification></relatedPersonInfo>"


def document(name="Acme Robotics Inc", people=(("Ada", "Lovelace", ("Director", "Promoter"), "Chair"),), sold="1500000", offered="2000000", industry="Computers", sale="2026-07-01", amends=""):
    persons = "".join(PERSON.format(f=f, l=l, r="".join(f"<relationship>{x}</relationship>" for x in r), c=c) for f, l, r, c in people)
    amendment = f"<newOrAmendment><isAmendment>true</isAmendment><previousAccessionNumber>{amends}</previousAccessionNumber></newOrAmendment>" if amends else "<newOrAmendment><isAmendment>false</isAmendment></newOrAmendment>"
    return f"""<edgarSubmission><submissionType>D</submissionType><relatedPersonsList>{persons}</relatedPersonsList>
      <primaryIssuer><cik>1234</cik><entityName>{name}</entityName><issuerAddress><city>Berlin</city><stateOrCountry>2M</stateOrCountry><stateOrCountryDescription>GERMANY</stateOrCountryDescription></issuerAddress><yearOfInc><value>2019</value></yearOfInc></primaryIssuer>
      <offeringData><industryGroup><industryGroupType>{industry}</industryGroupType></industryGroup><typeOfFiling>{amendment}<dateOfFirstSale><value>{sale}</value></dateOfFirstSale></typeOfFiling>
      <offeringSalesAmounts><totalOfferingAmount>{offered}</totalOfferingAmount><totalAmountSold>{sold}</totalAmountSold></offeringSalesAmounts></offeringData></edgarSubmission>"""


def test_index(spark, tmp_path):
    (tmp_path / "form.idx").write_text(INDEX)
    rows = {r.accession: r for r in filings.read_index(spark, str(tmp_path)).collect()}
    assert rows.keys() == {"0001234567-26-000001", "0000000077-26-000002"}
    assert (rows["0000000077-26-000002"].cik, rows["0000000077-26-000002"].date_filed, rows["0000000077-26-000002"].form_type) == ("77", "20260710", "D/A")
    days = filings.index_days(dt.date(2026, 7, 13), 4)
    assert days == [dt.date(2026, 7, 13), dt.date(2026, 7, 10)] and filings.index_path(days[0]) == "edgar/daily-index/2026/QTR3/form.20260713.idx"


def test_documents_and_records(spark):
    docs = [
        ("0001234567-26-000001", document(people=(("Ada", "Lovelace", ("Director", "Promoter"), "Chair"), ("Fund", "Admin LLC", ("Promoter",), ""), ("", "", ("Director",), ""), ("Bob", "Ross", (), "")))),
        ("0000000077-26-000002", document("Beta", sold="0", sale="", amends="0000000077-25-000009", industry="Pooled Investment Fund")),
        ("x", document("")),
    ]
    parsed = filings.offerings(filings.parse_text(spark.createDataFrame(docs, "accession string, xml string")))
    got = {r.accession: r for r in parsed.collect()}
    a, b = got["0001234567-26-000001"], got["0000000077-26-000002"]
    assert len(got) == 2
    assert (a.entity_name, a.city, a.state, a.year_of_inc, a.amount_sold_usd, a.is_pooled, a.is_amendment, a.previous_accession) == ("Acme Robotics Inc", "Berlin", "GERMANY", 2019, 1500000.0, False, False, None)
    assert [tuple(p) for p in a.people] == [("Ada Lovelace", "Director", "Chair")]
    assert (b.amount_sold_usd, b.is_pooled, b.is_amendment, b.previous_accession, b.date_of_first_sale) == (2000000.0, True, True, "0000000077-25-000009", None)
    index = filings.parse_index(spark.createDataFrame([(line,) for line in INDEX.split("\n")], "value string")).dropDuplicates(["accession"])
    records = {r.accession: r for r in filings.records(index, parsed, F.lit("2026-08-01").cast("date")).collect()}
    r = records["0001234567-26-000001"]
    assert (r.source, r.company.hq, r.company.industry, r.company.primary_sector, r.company.stage) == (SEC_EDGAR, "Berlin, GERMANY", ["Computers"], "Technology", "Seed")
    assert (r.round.external_id, str(r.round.date), r.people[0].external_id, r.people[0].since) == ("0001234567-26-000001", "2026-07-01", "1234:person:ada-lovelace", 2026)
    assert records["0000000077-26-000002"].round.external_id == "0000000077-25-000009" and str(records["0000000077-26-000002"].round.date) == "2026-07-10"
    assert filings.records(index, parsed, F.lit("2026-08-01").cast("date"), skip_pooled=True).count() == 1


def test_documents_from_files(spark, tmp_path):
    folder = tmp_path / "000123456726000001"
    folder.mkdir()
    (folder / "primary_doc.xml").write_text(document())
    row = filings.offerings(filings.read_documents(spark, str(folder))).first()
    assert row.accession == "0001234567-26-000001" and row.entity_name == "Acme Robotics Inc"


def test_documents_of_containers(spark, tmp_path):
    """Files do not grow in number with the documents; texts of several lines and one that is no XML cost none of the others."""
    spark.range(1, 901).select(F.col("id").alias("s_suppkey")).write.parquet(f"{tmp_path}/supplier.parquet")
    folder = ingestion._land_documents(spark, str(tmp_path), f"file://{tmp_path}/landed")
    files = [p for p in (tmp_path / "landed" / "documents").rglob("*") if p.is_file() and p.name[0] not in "._"]
    assert 0 < len(files) <= 8
    assert filings.offerings(filings.read_containers(spark, f"{folder}/documents")).count() == 900 - 900 // 11
    texts = {"0001234567-26-000001": document(), "0001234567-26-000002": "<edgarSubmission><primaryIssuer>", "0001234567-26-000003": document().replace("><", ">\n<")}
    (tmp_path / "some").mkdir()
    (tmp_path / "some" / "a.json").write_text("".join(json.dumps({"accession": a, "xml": x}) + "\n" for a, x in texts.items()))
    rows = filings.offerings(filings.read_containers(spark, f"file://{tmp_path}/some")).collect()
    assert sorted((r.accession, r.entity_name) for r in rows) == [("0001234567-26-000001", "Acme Robotics Inc"), ("0001234567-26-000003", "Acme Robotics Inc")]


HEADER = ["Organization CRD#", "CIK#", "Primary Business Name", "Legal Name", "Main Office City", "Main Office State", "Main Office Country", "SEC Current Status", "Total number of offices\n other than main", "Website Address", "Any VC Funds", "Total number of VC funds", "Any PE Funds", "Total number of PE funds", "Any Hedge Funds", "Total number of Hedge funds", "Total Gross Assets of Private Funds"]


def line(crd, name, status="Approved", vc="", pe="", hedge="", site="", legal="", assets=".00", flag=""):
    cells = [crd, "", name, legal or name, "SAN JOSE", "CA", "United States", status, "2", site, flag, vc, "", pe, "", hedge, assets]
    return ",".join('"' + c.replace('"', '""') + '"' for c in cells)


def test_roster(spark, tmp_path):
    rows = [
        line("1", "HPS VENTURES, LLC", vc="3", pe="3", site="HTTPS://HPS.VC", assets="1,234,567.00"),
        line("2", 'THE "BIG" FUND', hedge="2", pe="1", site="medium.com/x", legal="BIG FUND HOLDINGS L.P."),
        line("3", "GONE CAPITAL", status="Terminated", vc="9"),
        line("4", "WEALTH ONLY"),
        line("5", "TICKED ONLY", flag="Y"),
        line("1", "REPEATED", vc="1"),
    ]
    (tmp_path / "ia.csv").write_bytes((",".join('"' + h + '"' for h in HEADER) + "\r\n" + "\r\n".join(rows) + "\r\n\r\n").encode("latin-1"))
    read = roster.read_roster(spark, str(tmp_path / "ia.csv"))
    assert read.count() == 6 and "Website Address" in read.columns
    got = {r.external_id: r for r in roster.firms(read.withColumn("n", F.monotonically_increasing_id()), order=["n"]).collect()}
    assert got.keys() == {"1", "2", "5"}
    a, b = got["1"], got["2"]
    assert (a.name, a.type, a.hq, a.domain, a.website_url, a.fund_count, a.assets_usd, a.legal_name) == ("HPS Ventures, LLC", "Venture", "San Jose, CA, United States", "hps.vc", "https://HPS.VC", 6, 1234567, None)
    assert a.description == "HPS Ventures, LLC is a venture capital firm based in San Jose, CA, United States, registered as an investment adviser with the SEC. It reports 6 private funds to the SEC."
    assert (b.type, b.domain, b.website_url, b.assets_usd, b.legal_name) == ("Hedge fund", None, "https://medium.com/x", None, "Big Fund Holdings L.P.")
    assert got["5"].type == "Venture" and got["5"].fund_count is None
    both = roster.roster_firms(read, read, ("Venture", "Hedge fund"))
    assert both.count() == 3


def test_zipped_roster(spark, tmp_path):
    with zipfile.ZipFile(tmp_path / "a.zip", "w") as z:
        z.writestr("readme.txt", "no")
        z.writestr("ROSTER.CSV", "a,b\n“x”,é".encode("cp1252"))
    assert roster.unzipped(spark, str(tmp_path / "a.zip")).first().content == "a,b\n“x”,é"


def test_snapshots(spark):
    html = '<a href="/f/ia07012026-exempt.zip"><a href="/f/IA07012026_0.zip"><a HREF="https://o.gov/ia060126-exemptzip.zip"><a href="/f/ia060126.zip"><a href="/f/ia050126.zip"><a href="/f/other.zip">'
    pairs = roster.snapshots(spark.createDataFrame([(html,)], "html string"))
    assert [(r.label, r.registered, r.exempt) for r in pairs.orderBy("pos").collect()] == [("ia07012026", "https://www.sec.gov/f/IA07012026_0.zip", "https://www.sec.gov/f/ia07012026-exempt.zip"), ("ia060126", "https://www.sec.gov/f/ia060126.zip", "https://o.gov/ia060126-exemptzip.zip")]
    assert roster.snapshot(pairs).first().label == "ia07012026" and roster.snapshot(pairs, "IA060126").first().label == "ia060126"


def bindings(rows):
    return {"results": {"bindings": [{k: {"type": "literal", "value": x} for k, x in r.items() if x is not None} for r in rows]}}


def test_graph_records(spark, tmp_path):
    ent = "http://www.wikidata.org/entity/"
    lists = {
        "details": (["company", "companyLabel", "companyDescription", "website", "inception", "hqLabel", "countryLabel", "industryLabel", "employees", "linkedinId"], [
            {"company": ent + "Q1", "companyLabel": "Acme", "companyDescription": "payment company", "website": "https://www.acme.com", "inception": "2001-05-01T00:00:00Z", "hqLabel": "Paris", "countryLabel": "France", "industryLabel": "finance", "employees": "12", "linkedinId": "acme"},
            {"company": ent + "Q1", "companyLabel": "Second"},
            {"company": ent + "Q2", "companyLabel": "Q2"},
            {"company": ent + "Q3", "companyLabel": "Bare", "hqLabel": "Q9"},
        ]),
        "investors": (["company", "investor", "investorLabel", "class"], [
            {"company": ent + "Q1", "investor": ent + "Q10", "investorLabel": "Fund", "class": ent + "Q1132207"},
            {"company": ent + "Q1", "investor": ent + "Q10", "investorLabel": "Fund", "class": ent + "Q3487908"},
            {"company": ent + "Q1", "investor": ent + "Q11", "investorLabel": "Who", "class": None},
            {"company": ent + "Q1", "investor": ent + "Q12", "investorLabel": "Q12", "class": None},
        ]),
        "people": (["company", "person", "personLabel", "role", "start"], [
            {"company": ent + "Q1", "person": ent + "Q20", "personLabel": "Ann", "role": "CEO", "start": "2010-01-01"},
            {"company": ent + "Q1", "person": ent + "Q20", "personLabel": "Ann", "role": "CEO", "start": "2015-01-01"},
            {"company": ent + "Q1", "person": ent + "Q20", "personLabel": "Ann", "role": "Founder"},
            {"company": ent + "Q3", "person": ent + "Q21", "personLabel": "Bo", "role": "Founder"},
        ]),
        "acquisitions": (["company", "target", "targetLabel", "date"], [
            {"company": ent + "Q1", "target": ent + "Q30", "targetLabel": "Tiny", "date": "2012-03-04T00:00:00Z"},
            {"company": ent + "Q1", "target": ent + "Q31", "targetLabel": "Undated", "date": ""},
        ]),
        "exits": (["company", "kind", "acquirer", "acquirerLabel", "date"], [
            {"company": ent + "Q1", "kind": "ipo", "date": "2018-01-01"},
            {"company": ent + "Q1", "kind": "ipo", "date": "2016-01-01"},
            {"company": ent + "Q1", "kind": "ipo"},
            {"company": ent + "Q3", "kind": "acq", "acquirer": ent + "Q40", "acquirerLabel": "Big", "date": "2019-01-01"},
            {"company": ent + "Q3", "kind": "acq", "acquirer": ent + "Q40", "acquirerLabel": "Big", "date": "2020-01-01"},
            {"company": ent + "Q3", "kind": "acq", "acquirer": ent + "Q41", "acquirerLabel": "Undated"},
        ]),
    }
    frames = []
    for name, (variables, rows) in lists.items():
        (tmp_path / f"{name}.json").write_text(json.dumps(bindings(rows)))
        frames.append(graph.read_bindings(spark, str(tmp_path / f"{name}.json"), variables))
    got = {r.company_external_id: r for r in graph.records(*frames, F.lit("2026-01-01").cast("date")).collect()}
    assert got.keys() == {"Q1", "Q3"}
    a, b = got["Q1"], got["Q3"]
    assert (a.company.name, a.company.hq, a.company.founded, a.company.domain, a.company.stage, a.company.status, a.company.headcount, a.company.primary_sector) == ("Acme", "Paris, France", 2001, "acme.com", "Public", "Public", 12, "Fintech")
    assert a.company.description == "Payment company. Founded in 2001. Headquartered in Paris, France. Backed by Fund, Who. Profile for Acme enriched from Wikidata."
    assert [(i.name, i.type, i.external_id) for i in a.investors] == [("Fund", "Venture", "Q1:investor:Q10"), ("Who", "Venture", "Q1:investor:Q11")]
    assert [(p.role, p.since) for p in a.people] == [("CEO", 2010), ("Founder", 2001)] and b.people[0].since == 2026
    assert [x.target for x in a.acquisitions] == ["Tiny"] and [(x.type, str(x.date)) for x in a.exits] == [("IPO", "2016-01-01")]
    assert [(x.external_id, x.detail, str(x.date)) for x in b.exits] == [("Q3:exit:acq:Q40", "Acquired by Big.", "2019-01-01")]
    assert (b.company.hq, b.company.stage, b.company.one_liner) == ("Undisclosed", "Acquired", "Bare — profile sourced from Wikidata.")


def test_graph_firms(spark):
    rows = [(0, "x/Q1", "x/Q105611", "Fund", "hedge people", "https://medium.com/f", None, "Oslo", "Norway", "5e6", "1990-01-01"), (1, "x/Q1", "x/Q3487908", "Fund", None, None, None, None, None, None, None), (2, "x/Q2", None, "Q2", None, None, None, None, None, None, None)]
    names = "seq int, investor string, class string, investorLabel string, investorDescription string, website string, linkedinId string, hqLabel string, countryLabel string, aum string, inception string"
    got = graph.firms(spark.createDataFrame(rows, names)).collect()
    assert [(r.external_id, r.type, r.hq, r.domain, r.description, r.assets_usd, r.founded_year) for r in got] == [("Q1", "Venture", "Oslo, Norway", None, "Hedge people", 5000000, 1990)]


def test_graph_questions(spark):
    triples = [
        ("C1", "P1951", "I1", "s1"), ("C1", "P1951", "I2", "s2"), ("C1", "P1951", "Q192247", "s3"), ("C1", "P1951", "I3", "s4"), ("C2", "P1951", "I1", "s5"),
        ("I1", "P31", "Q3487908", "s6"), ("I2", "P31", "bankish", "s7"), ("bankish", "P279", "mid", "s8"), ("mid", "P279", "Q5266746", "s9"),
        ("C1", "P856", "https://c1", "s10"), ("C1", "P112", "F1", "s11"), ("C1", "P169", "F2", "s12"), ("s12", "P580", "2011-01-01", "s13"),
        ("T1", "P127", "C1", "s14"), ("s14", "P580", "2013-01-01", "s15"), ("T2", "P127", "C1", "s16"), ("C2", "P127", "B1", "s17"), ("s17", "P580", "2014-01-01", "s18"),
    ]
    t = spark.createDataFrame(triples, "subject string, property string, object string, statement string")
    seed = graph.seed_companies(t)
    assert {r.company for r in seed.collect()} == {"C1", "C2"}
    assert {(r.company, r.investor, r["class"]) for r in graph.investor_edges(seed, t).collect()} == {("C1", "I1", "Q3487908"), ("C1", "I3", None), ("C2", "I1", "Q3487908")}
    assert {r.company: r.website for r in graph.company_details(seed, t).collect()} == {"C1": "https://c1", "C2": None}
    assert {(r.person, r.role, r.start) for r in graph.people_of(seed, t).collect()} == {("F1", "Founder", None), ("F2", "CEO", "2011-01-01")}
    assert {(r.company, r.target, r.date) for r in graph.owned_since(seed, t, "company", "target").collect()} == {("C1", "T1", "2013-01-01")}
    none = spark.createDataFrame([("C1", None)], "company string, date string")
    assert {(r.company, r.kind, r.acquirer, r.date) for r in graph.exits_of(seed, t, none.limit(0), none).collect()} == {("C2", "acq", "B1", "2014-01-01"), ("C1", "ipo", None, None)}
    assert {r.investor for r in graph.firm_universe(t).collect()} == {"I1"}
    assert graph.chunks(spark.range(450).select(F.col("id").cast("string").alias("qid"))).select("chunk").distinct().count() == 3


def test_zipped_roster_rows(spark, tmp_path):
    header = '"Organization CRD#"," Legal Name ","Main Office City","Any VC Funds"\r\n'
    with zipfile.ZipFile(tmp_path / "a.zip", "w") as z:
        z.writestr("readme.txt", "no")
        z.writestr("ROSTER.CSV", (header + '"1","“ONE” € L.P."," TOWN\nHALL ","Y"\r\n"2","TWO"\r\n" ","","",""\r\n\r\n').encode("cp1252"))
    with zipfile.ZipFile(tmp_path / "none.zip", "w") as z:
        z.writestr("readme.txt", "no")
    rows = roster.read_zipped(spark, str(tmp_path)).orderBy("row").collect()
    assert [(r["Organization CRD#"], r["Legal Name"], r["Main Office City"], r["Any VC Funds"], r["CIK#"]) for r in rows] == [("1", "“ONE” € L.P.", "TOWN\nHALL", "Y", ""), ("2", "TWO", "", "", "")]


def test_run_of_landed_sources(spark, tmp_path):
    """The chosen sources alone, the latest so many records, counted; again: nothing new."""
    sf, folder, day = "/root/testdata/sf0.001", f"file://{tmp_path}", F.lit("2026-08-01").cast("date")
    ingestion._land_documents(spark, sf, ingestion._land_index(spark, ingestion._supplier_index(spark, sf), f"{folder}/SEC_EDGAR"))
    ingestion._land_roster(spark, sf, f"{folder}/SEC_ADV")
    sources = [landed.Filings(day), landed.Roster(("Venture",)), landed.Graph(day)]
    at = F.lit("2026-08-01").cast("timestamp_ntz")
    store, told = ingest.run_sources(spark, ingest.Store.empty(spark), sources, folder, at, ["SEC_EDGAR", "SEC_ADV"], limit=4)
    assert [(t["source"], t["processed"], t["upserted"], t["skipped"], t["investors"], t["new_companies"]) for t in told] == [("SEC_EDGAR", 4, 4, 0, 0, 4), ("SEC_ADV", 0, 0, 0, 4, 0)]
    assert {r.external_id for r in store.companies.collect()} == {str(7_000_000 + k) for k in (6, 7, 8, 9)} and store.rounds.count() == 4
    again, told = ingest.run_sources(spark, store, sources, folder, at, ["SEC_EDGAR"], limit=4)
    assert told[0]["new_companies"] == told[0]["new_investors"] == 0 and again.companies.count() == 4


def test_results_of_the_graph_do_not_grow_with_the_tables(spark, tmp_path):
    """A result has some 200 companies however many there are, and no binding is lost on the way."""
    customers = spark.range(4000).select(F.col("id").alias("c_custkey"))
    customers.write.parquet(f"{tmp_path}/customer.parquet")
    rows = customers.select(F.concat(F.lit("Q"), F.col("c_custkey")).alias("company"), F.lit("Q1").alias("investor"), F.lit('a "name"').alias("investorLabel"), F.lit(None).cast("string").alias("class"))
    rows = rows.unionByName(rows.withColumn("investor", F.lit("Q2"))).withColumn("seq", F.concat("company", "investor"))
    folder = ingestion._land_bindings(spark, str(tmp_path), {"investors": rows}, f"file://{tmp_path}/graph")
    results = [json.loads(r.value)["results"]["bindings"] for r in spark.read.text(f"{folder}/investors").collect()]
    assert max(len({b["company"]["value"] for b in result}) for result in results) < 300
    read = landed.Graph(F.lit("2026-08-01").cast("date"), lines=True)._read(spark, folder, "investors")
    assert read.count() == read.select("company", "investor").distinct().count() == 8000
    assert {(r.seq % 2, r.investor[-2:], r.investorLabel, r["class"]) for r in read.collect()} == {(0, "Q1", 'a "name"', None), (1, "Q2", 'a "name"', None)}


def test_results_of_firms_do_not_grow_with_the_tables(spark, tmp_path):
    """The firms that an ingest run lands lie in results of some 200 as well, and all are read back."""
    suppliers = spark.range(4000).select(F.col("id").alias("s_suppkey"))
    suppliers.write.parquet(f"{tmp_path}/supplier.parquet")
    firms = suppliers.select(F.concat(F.lit("Q"), F.col("s_suppkey")).alias("investor"), F.concat(F.lit("Firm "), F.col("s_suppkey")).alias("investorLabel"), F.lit("C").alias("class")).withColumn("seq", F.col("investor"))
    for name in landed.VARIABLES["firms"]:
        firms = firms if name in firms.columns else firms.withColumn(name, F.lit(None).cast("string"))
    folder = ingestion._land_bindings(spark, str(tmp_path), {"firms": firms}, f"file://{tmp_path}/graph")
    assert max(len(json.loads(r.value)["results"]["bindings"]) for r in spark.read.text(f"{folder}/firms").collect()) < 300
    read = landed.Graph(F.lit("2026-08-01").cast("date"), lines=True).firms(spark, folder)
    assert read.select("external_id").distinct().count() == read.count() == 4000


def test_a_result_is_landed_before_the_next_is_read():
    """A task that lands results holds one of them, however many it has."""
    read = []

    def batches():
        for part in range(3):
            read.append(part)
            yield pa.RecordBatch.from_arrays([pa.array([part, part]), pa.array(['{"a": 1}', '{"a": 2}'])], names=["part", "b"])

    lines = ingestion._result_lines(batches())
    first = next(lines).column(0).to_pylist()
    assert read == [0, 1] and [json.loads(x)["results"]["bindings"] for x in first] == [[{"a": 1}, {"a": 2}]]
    assert sum(b.num_rows for b in lines) == 2


def test_archives_of_rosters_do_not_grow_with_the_tables(spark, tmp_path):
    """An archive has some 5000 advisers however many there are, and no adviser is lost on the way."""
    spark.range(14_000).select(F.col("id").alias("s_suppkey")).write.parquet(f"{tmp_path}/supplier.parquet")
    folder = ingestion._land_roster(spark, str(tmp_path), f"file://{tmp_path}/roster")
    sizes = []
    for path in (tmp_path / "roster").glob("*/*.zip"):
        with zipfile.ZipFile(path) as archive:
            sizes.append(archive.read("IA.CSV").count(b"\r\n") - 1)
    assert max(sizes) < 6000
    numbers = [r[0] for part in ("exempt", "registered") for r in roster.read_zipped(spark, f"{folder}/{part}", ("Organization CRD#",)).collect()]
    assert len(numbers) == 7000 + 7000 + 1400 and set(numbers) == {str(k) for k in range(14_000)}


def test_classes_far_below_an_excluded_one_and_cycles(spark):
    excluded = v.EXCLUDED_CLASSES[0]
    chain = [(f"K{i}", graph.SUBCLASS, f"K{i - 1}" if i else excluded) for i in range(40)]
    cycle = [("K3", graph.SUBCLASS, "K7"), (excluded, graph.SUBCLASS, "K2"), ("A", graph.SUBCLASS, "B"), ("B", graph.SUBCLASS, "A"), ("K5", graph.SUBCLASS, None), (None, graph.SUBCLASS, "K5")]
    backed = [("C1", graph.INVESTED, i) for i in ("near", "far", "free", "unknown")]
    of = [("near", graph.INSTANCE, "K2"), ("far", graph.INSTANCE, "K39"), ("far", graph.INSTANCE, "B"), ("free", graph.INSTANCE, "A")]
    t = spark.createDataFrame([(*x, None) for x in chain + cycle + backed + of], "subject string, property string, object string, statement string")
    assert {r["class"] for r in graph.subclasses(t, [excluded]).collect()} == {excluded, *(f"K{i}" for i in range(40))}
    assert {(r.investor, r["class"]) for r in graph.investor_edges(graph.seed_companies(t), t).collect()} == {("free", "A"), ("unknown", None)}


def test_details_in_one_scan_with_repeated_values(spark):
    d = graph.DETAILS
    rows = [("C1", d["website"], "a"), ("C1", d["website"], "b"), ("C1", d["country"], "N1"), ("C1", d["country"], "N2"), ("C1", d["hq"], None), ("C3", d["website"], "c"), (None, d["website"], "d")]
    t = spark.createDataFrame([(*x, None) for x in rows], "subject string, property string, object string, statement string")
    found = graph.company_details(spark.createDataFrame([("C1",), ("C2",)], "company string"), t)
    assert found.columns == ["company", *d]
    assert sorted((r.company, r.website or "", r.country or "", r.hq) for r in found.collect()) == [("C1", "a", "N1", None), ("C1", "a", "N2", None), ("C1", "b", "N1", None), ("C1", "b", "N2", None), ("C2", "", "", None)]
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("LogicalRDD") == 2 and plan.count("Join") == 1
