"""Scalar functions: tables of cases."""

import pytest
from pyspark.sql import functions as F

from capstrata.functions import text, values
from capstrata.functions import vocabulary as v


def apply(spark, fn, cells):
    rows = spark.createDataFrame(list(enumerate(cells)), "i int, c string").select("i", fn(F.col("c")).alias("out")).orderBy("i")
    return [r.out for r in rows.collect()]


def check(spark, fn, cases):
    assert dict(zip(cases, apply(spark, fn, cases), strict=True)) == cases


def test_kebab(spark):
    check(spark, text.kebab, {"Acme & Sons, Inc.": "acme-sons-inc", "--A--": "a", "日本": "company", "": "company", "X1 y2": "x1-y2"})


def test_company_name_key(spark):
    check(spark, text.company_name_key, {"Stripe, Inc.": "stripe", "OpenAI, L.L.C.": "openai", "The Boring Company": "the boring", "Company": "company", "Foo Co Ltd": "foo", "A  B": "a b", "Inc. Inc.": "inc", "Banc Sa": "banc", "Émile SA": "mile"})


def test_investor_name_key(spark):
    check(
        spark,
        text.investor_name_key,
        {
            "A.Capital Ventures": "a capital ventures",
            "Work-Bench Management, L.L.C.": "work bench management",
            "Greylock Partners": "greylock partners",
            "Greylock Capital Management LP": "greylock capital management",
            "S.A. Foo B.V.": "sa foo",
            "A B C d": "abcd",
            "LLC": "llc",
            "X": "x",
            "": "",
        },
    )


def test_title_case(spark):
    check(
        spark,
        text.title_case_firm,
        {
            "HPS INVESTMENT PARTNERS, LLC": "HPS Investment Partners, LLC",
            "A.CAPITAL VENTURES": "A.Capital Ventures",
            "WORK-BENCH": "Work-Bench",
            "FUND III": "Fund III",
            "O'NEIL GROUP": "O'neil Group",
            "  TPG   GROWTH ": "TPG Growth",
            "FIRST ROUND CAPITAL L.P.": "First Round Capital L.P.",
        },
    )


def test_hosts(spark):
    check(spark, text.host_of, {"HTTP://WWW.DFJ.COM": "dfj.com", "up.partners": "up.partners", "linkedin": "", "@providencewealth": "", "": "", "https://a.b/c?d": "a.b", "u:p@x.io:8080/y": "x.io", "not a url.com": "", "http://my_site.com": "my_site.com"})
    check(spark, text.hostname, {"https://www.acme.com/x": "acme.com", "acme.com": "", "": "", "http://Sub.Acme.com:80": "sub.acme.com"})
    check(
        spark,
        text.identifying_domain,
        {"https://acme.com": "acme.com", "medium.com/x": None, "blog.medium.com": None, "notmedium.com": "notmedium.com", "https://linkedin.com/in/a": None, "uk.linkedin.com": None, "x.com": None, "fox.com": "fox.com", "foo.github.io": None, "sites.google.com/a": None, "google.com": "google.com", "junk": None},
    )


def test_websites(spark):
    rows = apply(spark, text.classify_website, ["HTTPS://www.linkedin.com/company/x", "medium.com/@y", "facebook.com/z", "WWW.ACME.COM", ""])
    assert [tuple(r) for r in rows] == [(None, "https://www.linkedin.com/company/x", None), ("https://medium.com/@y", None, None), (None, None, None), ("https://WWW.ACME.COM", None, "acme.com"), (None, None, None)]


def test_sectors(spark):
    check(
        spark,
        text.sector_of_text,
        {"Machine Learning bank": "Artificial intelligence", "fintech bank": "Fintech", "investment bank": "Financial services", "biotech software": "Healthcare", "renewable energy": "Climate", "oil": "Energy", "cloud": "Enterprise SaaS", "urban planning": "Real estate", "railway": "Transport", "hotel": "Consumer & retail", "media": "Media & telecom", "school": "Education", "mining": "Industrials", "computer": "Technology", "poetry": None},
    )
    assert dict(zip(v.INDUSTRY_SECTORS, apply(spark, text.sector_of_industry, list(v.INDUSTRY_SECTORS)), strict=True)) == v.INDUSTRY_SECTORS
    assert set(v.INDUSTRY_SECTORS.values()) - {None} <= set(v.SECTORS) and {s for _, s in v.SECTOR_WORDS} == set(v.SECTORS)


def test_classes_and_labels(spark):
    kinds = spark.createDataFrame([(["Q5", "Q3487908"],), (["Q1132207"],), (["Q1"],), ([],)], "c array<string>").select(text.investor_type_of_classes(F.col("c")).alias("k")).collect()
    assert [r.k for r in kinds] == ["Venture", "Accelerator", None, None]
    check(spark, text.qid_of, {"http://www.wikidata.org/entity/Q12": "Q12", "Q7": "Q7", "http://x/P1": None, "xQ7": None})
    check(spark, text.label_of, {" Acme ": "Acme", "Q12": None, "": None})


def test_money_and_display(spark):
    cases = {None: "Undisclosed", 0: "$0", 999: "$999", 1000: "$1K", 1250: "$1.3K", 24_000_000_000: "$24B", 1_500_000: "$1.5M", 999_999: "$1000K"}
    got = spark.createDataFrame([(i, n) for i, n in enumerate(cases)], "i int, n long").orderBy("i").select(text.format_usd(F.col("n")).alias("s")).collect()
    assert [r.s for r in got] == list(cases.values())
    pct = spark.createDataFrame([(0, 5.0), (1, -2.5), (2, 0.0)], "i int, x double").orderBy("i").select(text.signed_percent(F.col("x")).alias("s")).collect()
    assert [r.s for r in pct] == ["+5%", "-2.5%", "0%"]
    check(spark, lambda c: F.array_join(text.comma_list(c), "|"), {"a, b ,,c": "a|b|c", "": "", " , ": ""})
    check(spark, lambda c: text.summary([c, F.lit("x")], 8), {"abc": "abc · x", "abcdefgh": "abcdefg…", "abcdef ": "abcdef…"})


def test_numbers_and_dates(spark):
    check(spark, values.roster_number, {" 484,007,760.00 ": 484007760.0, ".00": 0.0, "": 0.0, "n/a": 0.0, "$5": 5.0})
    check(spark, values.filing_number, {"Indefinite": 0.0, "1,500": 1500.0, "": 0.0, "1.2.3": 0.0})
    check(spark, values.year_of, {"1999-01-01T00:00:00Z": 1999, "-500": None, "": None, "0000": None})
    check(spark, values.positive_number, {"12.5": 13, "0": None, "-1": None, "x": None})
    check(spark, lambda c: values.safe_date(F.lit("2020-02-02"), c).cast("string"), {"20260713": "2026-07-13", "2026-07-13": "2026-07-13", "2026-13-45": "2020-02-02", "": "2020-02-02"})
    got = spark.createDataFrame([(1, 4_999_999), (2, 5_000_000), (3, 60_000_000), (4, 400_000_000)], "i int, n long").orderBy("i").select(values.stage_of_amount(F.col("n")).alias("s")).collect()
    assert [r.s for r in got] == ["Seed", "Series A", "Series C", "Late stage"]
    got = spark.createDataFrame([(1, 3, 2), (2, 1, 0), (3, 1, 8), (4, 39, 40)], "i int, r int, p int").orderBy("i").select(values.trend_percent(F.col("r"), F.col("p")).alias("t")).collect()
    assert [r.t for r in got] == [50.0, 0.0, -87.5, -2.5]


def test_shown_values(spark):
    cases = {"null": "—", '"text"': "text", "1200": "1,200", '["a","b"]': "a, b", '"' + "x" * 200 + '"': "x" * 140 + "…"}
    check(spark, lambda c: values.shown_value(c, F.lit("name"), v.MONEY_FIELDS), cases)
    check(spark, lambda c: values.shown_value(c, F.lit("total_raised_usd"), v.MONEY_FIELDS), {"1500000": "$1.5M", "null": "—"})


def test_documents(spark):
    row = spark.range(1).select(text.breadcrumb_json(F.array(F.struct(F.lit("Home").alias("name"), F.lit("/").alias("url")))).alias("j")).first()
    assert '"position":1' in row.j and '"item":"/"' in row.j


@pytest.mark.parametrize("days,unlocked,recent", [(29, True, True), (30, False, True), (31, False, False)])
def test_contribution_window(spark, days, unlocked, recent):
    last, now = F.lit("2024-01-01").cast("timestamp_ntz"), F.expr(f"timestamp_ntz '2024-01-01' + interval {days} days")
    row = spark.range(1).select(values.is_unlocked(last, now, F.lit(False)).alias("u"), values.contributed_since(last, now).alias("r"), values.is_unlocked(last, now, F.lit(True)).alias("a")).first()
    assert (row.u, row.r, row.a) == (unlocked, recent, True)


def test_nested_values_as_json(spark):
    df = spark.createDataFrame([(1, ("a", None, [("b", None), None], {"k": None}))], "i int, v struct<x:string,d:date,many:array<struct<y:string,z:long>>,map:map<string,long>>").select("*", F.lit(None).cast("struct<x:string>").alias("none"))
    shown = df.select(values.json_value(F.col("v"), "struct").alias("v"), values.json_value(F.col("v.many"), "array").alias("many"), values.json_value(F.col("v.many")[0], "struct").alias("one"), values.json_value(F.col("none"), "struct").alias("none"), values.json_value(F.col("v.x"), "string").alias("x")).first()
    assert shown.v == '{"x":"a","d":null,"many":[{"y":"b","z":null},null],"map":{"k":null}}'
    assert (shown.many, shown.one, shown.none, shown.x) == ('[{"y":"b","z":null},null]', '{"y":"b","z":null}', "null", '"a"')
