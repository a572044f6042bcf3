"""Queries of scalar functions over names, urls and texts, each with the SQL that checks it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from capstrata.functions import text, values
from capstrata.functions import vocabulary as v
from capstrata.operators import checks, slugs
from capstrata.plans import entities as e
from capstrata.plans.entities import MODEL_SQL
from capstrata.session import read_table
from capstrata.sources import roster


def _parts(s: SparkSession, sf: str) -> DataFrame:
    return read_table(s, sf, "part")


def slug_mint(s: SparkSession, sf: str) -> DataFrame:
    rows = _parts(s, sf).select("p_partkey", F.col("p_name").alias("name"), text.kebab(F.col("p_name")).alias("base"))
    return slugs.numbered(rows, "base", "p_partkey").select("p_partkey", "slug")


def slug_mint_by_key(s: SparkSession, sf: str) -> DataFrame:
    rows = _parts(s, sf).select("p_partkey", "p_name")
    used = _parts(s, sf).where("p_size = 1").select(text.kebab(F.col("p_name")).alias("slug"))
    return slugs.mint(rows, used, F.col("p_name"), F.col("p_partkey"), F.concat(F.lit("K "), F.col("p_partkey").cast("string"))).select("p_partkey", "slug")


def slug_mint_by_number(s: SparkSession, sf: str) -> DataFrame:
    rows = _parts(s, sf).select("p_partkey", "p_name")
    used = s.createDataFrame([("none",)], "slug string")
    return slugs.mint(rows, used, F.col("p_name"), F.col("p_partkey")).select("p_partkey", "slug")


def slug_collisions(s: SparkSession, sf: str) -> DataFrame:
    return slugs.clashes(_parts(s, sf).select(text.kebab(F.col("p_name")).alias("slug")))


def name_keys(s: SparkSession, sf: str) -> DataFrame:
    docs = read_table(s, sf, "documents").select(F.col("doc_id").alias("id"), F.concat("text", F.lit(" Co., Inc.")).alias("name"))
    parts = _parts(s, sf).select(F.col("p_partkey").alias("id"), F.concat("p_name", F.lit(", L.L.C."), F.lit(" Ltd")).alias("name"))
    return docs.unionByName(parts).select("id", text.company_name_key(F.col("name")).alias("name_key"))


def investor_name_keys(s: SparkSession, sf: str) -> DataFrame:
    docs = read_table(s, sf, "documents").select(F.col("doc_id").alias("id"), F.concat("text", F.lit(" S.A.R.L.")).alias("name"))
    firms = read_table(s, sf, "supplier").select(F.col("s_suppkey").alias("id"), F.concat(F.lit("A.B "), "s_name", F.lit(" Capital, L. P.")).alias("name"))
    return docs.unionByName(firms).select("id", text.investor_name_key(F.col("name")).alias("name_key"))


def host_extract(s: SparkSession, sf: str) -> DataFrame:
    bare = F.regexp_replace("url", "^https?://", F.lit(""))
    url = F.when(F.col("page_id") % 3 == 0, bare).when(F.col("page_id") % 3 == 1, F.upper("url")).otherwise(F.col("url"))
    return read_table(s, sf, "pages").select("page_id", text.host_of(url).alias("host"), text.hostname(F.col("url")).alias("hostname"))


_SITES = ("https://linkedin.com/in/x", "www.facebook.com/y", "blog.medium.com", "notmedium.com", "HTTPS://Fund.example/Team", "linkedin", "@handle", "", "user@x.io:80/p", "sites.google.com/z")


def identifying_domain(s: SparkSession, sf: str) -> DataFrame:
    sites = F.array(*[F.lit(x) for x in _SITES])
    cell = F.get(sites, (F.col("page_id") % len(_SITES)).cast("int"))
    site = text.classify_website(cell)
    return read_table(s, sf, "pages").select("page_id", text.identifying_domain(F.col("url")).alias("page_domain"), site["website_url"].alias("website_url"), site["linkedin_url"].alias("linkedin_url"), site["domain"].alias("domain"))


def href_extract(s: SparkSession, sf: str) -> DataFrame:
    return read_table(s, sf, "pages").select("page_id", F.posexplode(F.regexp_extract_all("html", F.lit('(?i)href="([^"]+)"'), 1)).alias("pos", "href")).withColumn("pos", F.col("pos").cast("long"))


def snapshot_pairs(s: SparkSession, sf: str) -> DataFrame:
    """Listings built of page ids: each links a registered and, for most, an exempt file."""
    i = F.col("page_id").cast("string")
    label = F.concat(F.lit("IA"), F.lpad(i, 6, "0"))
    exempt = F.when(F.col("page_id") % 4 != 0, F.concat(F.lit('<a href="https://x.gov/f/'), label, F.lit('-exemptzip.zip">'))).otherwise("")
    html = F.concat(exempt, F.lit('<A HREF="/files/'), label, F.lit('_0.zip"> <a href="/files/other.zip">'))
    pages = read_table(s, sf, "pages").select(html.alias("html"))
    return roster.snapshots(pages).select("label", "registered", "exempt")


def sector_rules(s: SparkSession, sf: str) -> DataFrame:
    words = F.array(*[F.lit(x) for x in ("Payments bank", "Hospital chain", "wind power", "Oil rig", "cloud hosting", "HOUSING", "railway", "food", "media", "school", "mining", "internet", "nothing")])
    phrase = F.get(words, (F.col("doc_id") % 13).cast("int"))
    return read_table(s, sf, "documents").select("doc_id", text.sector_of_text(F.concat("text", F.lit(" "), phrase)).alias("sector"))


_INDUSTRIES = ("Agriculture", "Biotechnology", "Other", "Oil and Gas", "REITS and Finance", "Business Services", "Restaurants", "no such industry")


def sector_map(s: SparkSession, sf: str) -> DataFrame:
    names = F.array(*[F.lit(x) for x in _INDUSTRIES])
    return _parts(s, sf).select("p_partkey", text.sector_of_industry(F.get(names, (F.col("p_partkey") % 8).cast("int"))).alias("sector"))


def title_case(s: SparkSession, sf: str) -> DataFrame:
    kinds = F.array(*[F.lit(x) for x in (" PARTNERS IV, LLC", " HPS L.P.", " O'NEIL-WORK'S CO.", " A.CAPITAL (USA)", " xii. TPG 3rd")])
    name = F.concat(F.upper("p_name"), F.get(kinds, (F.col("p_partkey") % 5).cast("int")))
    return _parts(s, sf).select("p_partkey", text.title_case_firm(name).alias("firm"))


def money_format(s: SparkSession, sf: str) -> DataFrame:
    scale = F.pow(F.lit(10), F.col("o_orderkey") % 7).cast("long")
    amount = F.when(F.col("o_orderkey") % 11 != 0, values.round_half_up(F.col("o_totalprice")) * scale)
    change = F.round((F.col("o_orderkey") % 41 - 20) / 2, 1)
    return read_table(s, sf, "orders").select("o_orderkey", text.format_usd(amount).alias("usd"), text.format_count(values.round_half_up(F.col("o_totalprice"))).alias("counted"), text.signed_percent(change).alias("pct"))


def summary_truncate(s: SparkSession, sf: str) -> DataFrame:
    docs = read_table(s, sf, "documents")
    return docs.select("doc_id", text.summary([F.col("text"), text.blank_to_null(F.col("source")), F.when(F.col("doc_id") % 2 == 0, F.col("lang"))], 72).alias("summary"))


def comma_lists(s: SparkSession, sf: str) -> DataFrame:
    return read_table(s, sf, "documents").select("doc_id", F.array_join(text.comma_list(F.col("text")), "|").alias("items"))


def json_ld(s: SparkSession, sf: str) -> DataFrame:
    c = e.companies(s, sf)
    doc = text.organization_json(F.col("name"), F.concat(F.lit("https://"), "domain"), F.when(F.col("company_id") % 2 == 0, 1990), F.array_compact(F.array(F.when(F.col("company_id") % 5 == 0, F.lit("https://a.example")))))
    return c.select("company_id", F.get_json_object(doc, "$.name").alias("name"), F.get_json_object(doc, "$.url").alias("url"), F.get_json_object(doc, "$.foundingDate").alias("founded"), F.get_json_object(doc, "$.sameAs[0]").alias("same_as"))


def stage_band(s: SparkSession, sf: str) -> DataFrame:
    return read_table(s, sf, "orders").select("o_orderkey", values.stage_of_amount(values.round_half_up(F.col("o_totalprice")) * 1000).alias("stage"))


def dates_and_numbers(s: SparkSession, sf: str) -> DataFrame:
    d = F.date_format("o_orderdate", "yyyy-MM-dd")
    filed = F.when(F.col("o_orderkey") % 3 == 0, F.replace(d, F.lit("-"), F.lit(""))).when(F.col("o_orderkey") % 3 == 1, d).otherwise("soon")
    cell = F.when(F.col("o_orderkey") % 4 == 0, " $1,234,567.00 ").when(F.col("o_orderkey") % 4 == 1, ".00").when(F.col("o_orderkey") % 4 == 2, "n/a").otherwise(F.col("o_orderkey").cast("string"))
    return read_table(s, sf, "orders").select(
        "o_orderkey",
        values.safe_date(F.lit("2020-01-01"), F.lit(None).cast("string"), filed).alias("day"),
        values.year_of(filed).cast("long").alias("year"),
        values.roster_number(cell).alias("roster_number"),
        values.positive_number(F.trim(cell)).alias("positive"),
        values.quarter_label(F.col("o_orderdate")).alias("quarter"),
        values.external_id(F.col("o_orderkey").cast("string"), "person", text.kebab(F.col("o_orderpriority"))).alias("external_id"),
    )


def form_validation(s: SparkSession, sf: str) -> DataFrame:
    c = e.companies(s, sf).withColumn("i", F.col("company_id"))
    pick = lambda good, bad, n: F.when(F.col("i") % n == 0, bad).otherwise(good)
    rows = c.select(
        "company_id", pick(F.col("name"), F.lit(" "), 13).alias("name"), pick(F.col("domain"), F.lit("no domain"), 17).alias("domain"), pick(F.col("one_liner"), F.repeat(F.lit("x"), 161), 19).alias("one_liner"),
        F.lit("d").alias("description"), F.lit("h").alias("hq"), pick(F.lit("1999"), F.lit("1799"), 23).alias("founded"), F.lit("12").alias("headcount"), pick(F.lit("5"), F.lit("5.5"), 29).alias("total_raised_usd"),
        F.lit("").alias("last_valuation_usd"), F.lit("a, b").alias("industry"), pick(F.lit("Fintech"), F.lit("Banking"), 31).alias("primary_sector"), F.lit("Private").alias("status"), F.lit("Seed").alias("stage"),
        pick(F.lit(""), F.lit("ftp://x"), 37).alias("source_url"),
    )
    _, rejected = checks.split_valid(rows, checks.company_form_rules(2027))
    return rejected.select("company_id", F.array_join("reasons", ",").alias("reasons"))


def shared_domains(s: SparkSession, sf: str) -> DataFrame:
    return checks.repeated(e.companies(s, sf), "domain")


def invariants(s: SparkSession, sf: str) -> DataFrame:
    return checks.invariants(e.companies(s, sf), e.investors(s, sf), e.holdings(s, sf))


def type_histogram(s: SparkSession, sf: str) -> DataFrame:
    return checks.type_histogram(e.investors(s, sf))


def row_counts(s: SparkSession, sf: str) -> DataFrame:
    return checks.row_counts({t: read_table(s, sf, t) for t in ("customer", "orders", "supplier", "lineitem")})


def _case(of: str, pairs) -> str:
    return "case " + " ".join(f"when {of.format(x=x)} then '{y}'" for x, y in pairs) + " end"


_KEY_SQL = "regexp_replace(trim(regexp_replace(regexp_replace(lower(name), '[^a-z0-9\\s]+', '{gap}', 'g'), '\\s+', ' ', 'g')), '( ({forms}))+$', '')"
_SPACED = "trim(regexp_replace(regexp_replace(lower(name), '[^a-z0-9\\s]+', ' ', 'g'), '\\s+', ' ', 'g'))"
_INVESTOR_KEY_SQL = f"regexp_replace(trim(regexp_replace(replace(regexp_replace(' ' || replace({_SPACED}, ' ', '  ') || ' ', ' ([a-z0-9]) ', '<\\1>', 'g'), '><', ''), '[<> ]+', ' ', 'g')), '( ({'|'.join(v.INVESTOR_LEGAL)}))+$', '')"
_HOST_SQL = "regexp_replace(lower(regexp_replace(regexp_replace(regexp_extract(regexp_replace({x}, '^(?i)https?://', ''), '^[^/?#]*'), '^.*@', ''), ':[0-9]*$', '')), '^www\\.', '')"
_OTHERS = "({h} = 'linkedin.com' or ends_with({h}, '.linkedin.com') or " + " or ".join(f"{{h}} = '{x}' or ends_with({{h}}, '.{x}')" for x in (*v.SOCIAL_HOSTS, *v.PLATFORM_HOSTS)) + ")"
_SOCIAL = "(" + " or ".join(f"h = '{x}' or ends_with(h, '.{x}')" for x in v.SOCIAL_HOSTS) + ")"
_LINKEDIN = "(h = 'linkedin.com' or ends_with(h, '.linkedin.com'))"
_UPPER = ", ".join(f"'{x}'" for x in v.KEEP_UPPER)

QUERIES = {
    f.__name__: f
    for f in (
        slug_mint, slug_mint_by_key, slug_mint_by_number, slug_collisions, name_keys, investor_name_keys, host_extract, identifying_domain, href_extract, snapshot_pairs, sector_rules,
        sector_map, title_case, money_format, summary_truncate, comma_lists, json_ld, stage_band, dates_and_numbers, form_validation, shared_domains, invariants, type_histogram, row_counts,
    )
}

SQL = {
    "slug_mint": "select p_partkey, case when n = 1 then base else base || '-' || n end as slug from (select *, row_number() over (partition by base order by p_partkey) as n from (select p_partkey, trim(regexp_replace(lower(p_name), '[^a-z0-9]+', '-', 'g'), '-') as base from part))",
    "slug_mint_by_key": """with b as (select p_partkey, p_size, trim(regexp_replace(lower(p_name), '[^a-z0-9]+', '-', 'g'), '-') as base from part),
      u as (select distinct base from b where p_size = 1), r as (select *, row_number() over (partition by base order by p_partkey) as n from b)
      select p_partkey, case when n = 1 and u.base is null then r.base else r.base || '-k-' || p_partkey end as slug from r left join u on u.base = r.base""",
    "slug_mint_by_number": "select p_partkey, case when n = 1 then base else base || '-' || n end as slug from (select *, row_number() over (partition by base order by p_partkey) as n from (select p_partkey, trim(regexp_replace(lower(p_name), '[^a-z0-9]+', '-', 'g'), '-') as base from part))",
    "slug_collisions": "select trim(regexp_replace(lower(p_name), '[^a-z0-9]+', '-', 'g'), '-') as slug, count(*) as n from part group by 1 having count(*) > 1",
    "name_keys": "select id, " + _KEY_SQL.format(gap="", forms="|".join(v.COMPANY_LEGAL)) + " as name_key from (select doc_id as id, text || ' Co., Inc.' as name from documents union all select p_partkey, p_name || ', L.L.C. Ltd' from part)",
    "investor_name_keys": f"select id, {_INVESTOR_KEY_SQL} as name_key from (select doc_id as id, text || ' S.A.R.L.' as name from documents union all select s_suppkey, 'A.B ' || s_name || ' Capital, L. P.' from supplier)",
    "host_extract": "select page_id, " + _HOST_SQL.format(x="case page_id % 3 when 0 then regexp_replace(url, '^https?://', '') when 1 then upper(url) else url end") + " as host, " + _HOST_SQL.format(x="url") + " as hostname from pages",
    "identifying_domain": "with p as (select page_id, "
    + _HOST_SQL.format(x="url")
    + f" as ph, list_extract({list(_SITES)!r}, 1 + page_id % {len(_SITES)}) as cell from pages), q as (select *, case when contains(x, '.') then x else '' end as h, case when cell = '' then '' when regexp_matches(cell, '^(?i)https?://') then regexp_replace(regexp_replace(cell, '^(?i)https://', 'https://'), '^(?i)http://', 'http://') else 'https://' || cell end as url from (select *, "
    + _HOST_SQL.format(x="cell")
    + f" as x from p)) select page_id, ph as page_domain, case when h <> '' and not {_LINKEDIN} and not {_SOCIAL} then url end as website_url, case when h <> '' and {_LINKEDIN} then url end as linkedin_url, case when h <> '' and not {_OTHERS.format(h='h')} then h end as domain from q",
    "href_extract": "select page_id, i - 1 as pos, l[i] as href from (select page_id, regexp_extract_all(html, '(?i)href=\"([^\"]+)\"', 1) as l from pages), unnest(range(1, len(l) + 1)) t(i)",
    "snapshot_pairs": "select 'ia' || lpad(cast(page_id as varchar), 6, '0') as label, 'https://www.sec.gov/files/IA' || lpad(cast(page_id as varchar), 6, '0') || '_0.zip' as registered, 'https://x.gov/f/IA' || lpad(cast(page_id as varchar), 6, '0') || '-exemptzip.zip' as exempt from pages where page_id % 4 <> 0",
    "sector_rules": "select doc_id, " + _case("regexp_matches(t, '(?i){x}')", v.SECTOR_WORDS) + " as sector from (select doc_id, text || ' ' || list_extract(['Payments bank', 'Hospital chain', 'wind power', 'Oil rig', 'cloud hosting', 'HOUSING', 'railway', 'food', 'media', 'school', 'mining', 'internet', 'nothing'], 1 + doc_id % 13) as t from documents)",
    "sector_map": "select p_partkey, " + _case("i = '{x}'", [(x, y) for x, y in v.INDUSTRY_SECTORS.items() if y]) + f" as sector from (select p_partkey, list_extract({list(_INDUSTRIES)!r}, 1 + p_partkey % 8) as i from part)",
    "title_case": f"""with w as (select p_partkey, i, l[i] as w from (select p_partkey, string_split_regex(trim(upper(p_name) || list_extract([' PARTNERS IV, LLC', ' HPS L.P.', ' O''NEIL-WORK''S CO.', ' A.CAPITAL (USA)', ' xii. TPG 3rd'], 1 + p_partkey % 5)), '\\s+') as l from part), unnest(range(1, len(l) + 1)) t(i)),
      b as (select *, regexp_replace(w, '[^A-Za-z.]', '', 'g') as bare from w)
      select p_partkey, string_agg(case when upper(w) in ({_UPPER}) or upper(bare) in ({_UPPER}) or (regexp_matches(upper(w), '^[IVXLCDM]+\\.?$') and length(w) > 1) or (length(bare) between 2 and 4 and not regexp_matches(bare, '(?i)[aeiouy]')) then upper(w)
        else array_to_string(list_transform(regexp_extract_all(lower(w), '[a-z][a-z'']*|[^a-z]+'), lambda r: case when regexp_matches(r, '^[a-z]') then upper(r[1]) || r[2:] else r end), '') end, ' ' order by i) as firm from b group by p_partkey""",
    "money_format": """with a as (select o_orderkey, cast(floor(o_totalprice + 0.5) as bigint) as n, case when o_orderkey % 11 <> 0 then cast(floor(o_totalprice + 0.5) as bigint) * cast(pow(10, o_orderkey % 7) as bigint) end as x, round((o_orderkey % 41 - 20) / 2, 1) as p from orders),
      b as (select *, case when x >= 1000000000 then 'B' when x >= 1000000 then 'M' else 'K' end as unit, case when x >= 1000000000 then x / 1000000000 when x >= 1000000 then x / 1000000 else x / 1000 end as y from a), c as (select *, cast(floor(y * 10 + 0.5) as bigint) as tenths from b)
      select o_orderkey, case when x is null then 'Undisclosed' when x < 1000 then '$' || x else '$' || (tenths // 10) || case when tenths % 10 = 0 then '' else '.' || (tenths % 10) end || unit end as usd, format('{:,}', n) as counted,
        case when p > 0 then '+' else '' end || case when p = floor(p) then cast(cast(p as bigint) as varchar) else cast(p as varchar) end || '%' as pct from c""",
    "summary_truncate": "select doc_id, case when length(t) > 72 then rtrim(substr(t, 1, 71)) || '…' else t end as summary from (select doc_id, concat_ws(' · ', text, nullif(trim(source), ''), case when doc_id % 2 = 0 then lang end) as t from documents)",
    "comma_lists": "select doc_id, array_to_string(list_filter(list_transform(string_split(text, ','), lambda x: trim(x)), lambda x: x <> ''), '|') as items from documents",
    "json_ld": MODEL_SQL + "select company_id, name, 'https://' || domain as url, case when company_id % 2 = 0 then '1990' end as founded, case when company_id % 5 = 0 then 'https://a.example' end as same_as from companies",
    "stage_band": "select o_orderkey, case when a < 5000000 then 'Seed' when a < 20000000 then 'Series A' when a < 60000000 then 'Series B' when a < 150000000 then 'Series C' when a < 400000000 then 'Series D' else 'Late stage' end as stage from (select o_orderkey, floor(o_totalprice + 0.5) * 1000 as a from orders)",
    "dates_and_numbers": """select o_orderkey, case when o_orderkey % 3 = 2 then date '2020-01-01' else cast(o_orderdate as date) end as day, case when o_orderkey % 3 <> 2 then year(o_orderdate) end as year,
      case o_orderkey % 4 when 0 then 1234567.0 when 3 then o_orderkey else 0.0 end::double as roster_number, case when o_orderkey % 4 = 3 then o_orderkey end as positive, 'Q' || quarter(o_orderdate) || ' ' || year(o_orderdate) as quarter,
      o_orderkey || ':person:' || trim(regexp_replace(lower(o_orderpriority), '[^a-z0-9]+', '-', 'g'), '-') as external_id from orders""",
    "form_validation": """select company_id, reasons from (select c_custkey as company_id, concat_ws(',', case when c_custkey % 13 = 0 then 'name' end, case when c_custkey % 17 = 0 then 'domain' end, case when c_custkey % 19 = 0 then 'one_liner' end, case when c_custkey % 23 = 0 then 'founded' end,
      case when c_custkey % 29 = 0 then 'total_raised_usd' end, case when c_custkey % 31 = 0 then 'primary_sector' end, case when c_custkey % 37 = 0 then 'source_url' end) as reasons from customer) where reasons <> ''""",
    "shared_domains": MODEL_SQL + "select domain, count(*) as n from companies group by domain having count(*) > 1",
    "invariants": MODEL_SQL
    + """select 'company slugs' as "check", (select count(*) from (select slug from companies group by slug having count(*) > 1)) as violations
      union all select 'investor slugs', (select count(*) from (select slug from investors group by slug having count(*) > 1))
      union all select 'company domains', (select count(*) from (select domain from companies group by domain having count(*) > 1))
      union all select 'holdings without investor', (select count(*) from holdings where investor_id is null)""",
    "type_histogram": MODEL_SQL + "select type, count(*) as n from investors group by type",
    "row_counts": "select 'customer' as table_name, count(*) as n from customer union all select 'orders', count(*) from orders union all select 'supplier', count(*) from supplier union all select 'lineitem', count(*) from lineitem",
}
