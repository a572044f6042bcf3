"""Queries of the market, the directory and profiles, each with the SQL that checks it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from capstrata.functions.vocabulary import PENDING
from capstrata.operators import directory, market, moderation, profile
from capstrata.plans import entities as e
from capstrata.plans.entities import MODEL_SQL
from capstrata.session import read_table

#: The threshold that valuations of these tables can reach.
UNICORN = 5000


def market_stats(s: SparkSession, sf: str) -> DataFrame:
    return market.by_total_raised(market.sector_stats(e.companies(s, sf), e.rounds(s, sf), e.as_of(s, sf)))


_STATS_SQL = """
, c as (
  select sector, count(*) as company_count, cast(coalesce(sum(total_raised_usd), 0) as double) as total_raised_usd, cast(coalesce(median(last_valuation_usd), 0) as double) as median_valuation_usd
  from shown where sector is not null group by sector
), r as (
  select c.sector, count(*) as deals, count(*) filter (r.date >= a.d - interval 90 day) as recent, count(*) filter (r.date >= a.d - interval 180 day and r.date < a.d - interval 90 day) as prior
  from rounds r join shown c using (company_id), (select max(o_orderdate) as d from orders) a where r.moderation_status = 'APPROVED' and c.sector is not null group by c.sector
), stats as (
  select sector, company_count, coalesce(deals, 0) as deal_count, total_raised_usd, median_valuation_usd,
    case when coalesce(prior, 0) = 0 then 0.0::double else floor(cast(recent - prior as double) / prior * 1000 + 0.5) / 10 end as trend_pct
  from c left join r using (sector)
)
"""


def market_totals(s: SparkSession, sf: str) -> DataFrame:
    return market.totals(e.companies(s, sf), e.rounds(s, sf), e.as_of(s, sf), UNICORN)


def market_sort(s: SparkSession, sf: str) -> DataFrame:
    stats = market.sector_stats(e.companies(s, sf), e.rounds(s, sf), e.as_of(s, sf))
    return market.sorted_stats(stats, "trend_pct", descending=True, limit=3)


def top_raised(s: SparkSession, sf: str) -> DataFrame:
    return directory.page_of(directory.find_companies(e.companies(s, sf)), directory.company_order("raised"), 1, 8).select("slug", "name", "total_raised_usd")


def sector_page(s: SparkSession, sf: str) -> DataFrame:
    companies = e.companies(s, sf)
    stats = market.sector_stats(companies, e.rounds(s, sf), e.as_of(s, sf)).select("sector", "company_count", "deal_count")
    page = directory.page_of(directory.find_companies(companies, sector="BUILDING"), directory.company_order(), 1, 25)
    return page.join(stats, "sector").select("slug", "name", "sector", "company_count", "deal_count")


_LIST = ("slug", "name", "sector", "stage", "status", "total_raised_usd", "last_valuation_usd")


def directory_page(s: SparkSession, sf: str) -> DataFrame:
    return directory.page_with_total(directory.find_companies(e.companies(s, sf)), directory.company_order(), 3, 20).select(*_LIST, "total")


def directory_search(s: SparkSession, sf: str) -> DataFrame:
    return directory.page_with_total(directory.find_companies(e.companies(s, sf), q="BUILD"), directory.company_order(), 1, 25).select(*_LIST, "total")


def directory_facets(s: SparkSession, sf: str) -> DataFrame:
    return directory.find_companies(e.companies(s, sf), sector="MACHINERY", stage="Series B", status="Private").select(*_LIST)


def directory_sort_valuation_nulls_last(s: SparkSession, sf: str) -> DataFrame:
    found = directory.find_companies(e.companies(s, sf))
    return directory.page_of(found, directory.company_order("valuation"), 12, 100).select("slug", "last_valuation_usd")


def directory_fallback_order(s: SparkSession, sf: str) -> DataFrame:
    found = directory.find_companies(e.companies(s, sf))
    return directory.page_of(found, directory.fallback_order("valuation"), 12, 100).select("slug", "last_valuation_usd")


def directory_in_list(s: SparkSession, sf: str) -> DataFrame:
    return directory.find_companies(e.companies(s, sf), slugs="customer-000000001,,customer-000000005,customer-000000010,nobody").select(*_LIST)


def compare_selection(s: SparkSession, sf: str) -> DataFrame:
    wanted = ["customer-000000009", "customer-000000003", "customer-000000009", "nobody", "customer-000000001", "customer-000000002"]
    return directory.selection(e.companies(s, sf), wanted).select("pos", "slug", "name")


def typeahead(s: SparkSession, sf: str) -> DataFrame:
    return directory.typeahead(e.companies(s, sf), " 00007 ")


def listed_slugs(s: SparkSession, sf: str) -> DataFrame:
    return market.visible(e.companies(s, sf)).select("slug").orderBy("slug")


def sitemap(s: SparkSession, sf: str) -> DataFrame:
    at = F.lit(None).cast("timestamp_ntz")
    return directory.sitemap(e.companies(s, sf).withColumn("updated_at", at), e.investors(s, sf).withColumn("updated_at", at), "https://example.com", ["", "/about"]).select("url")


def investor_directory(s: SparkSession, sf: str) -> DataFrame:
    page = directory.investor_page(e.investors(s, sf), e.holdings(s, sf), e.companies(s, sf), page=1, size=20)
    return page.select("slug", "name", "type", "all_holdings", "portfolio_count", F.array_join(F.transform("portfolio", lambda p: p["company_slug"]), ",").alias("sample"), F.array_join("sectors", ",").alias("sectors"))


def investor_search(s: SparkSession, sf: str) -> DataFrame:
    return directory.find_investors(e.investors(s, sf), q="supplier", kind="Hedge fund").select("slug", "name", "type")


def investor_portfolio_sample(s: SparkSession, sf: str) -> DataFrame:
    from pyspark.sql.window import Window

    ranked = Window.partitionBy("investor_id").orderBy("company_name", "company_slug", "holding_id")
    return directory.public_holdings(e.holdings(s, sf), e.companies(s, sf)).withColumn("rank", F.row_number().over(ranked)).where("rank <= 6").select("investor_id", "company_slug", F.col("rank").cast("long").alias("rank"))


def investor_detail(s: SparkSession, sf: str) -> DataFrame:
    whole = directory.investor_portfolios(e.investors(s, sf).where("slug = 'supplier-000000007'"), e.holdings(s, sf), e.companies(s, sf), sample=None)
    return whole.select("slug", "portfolio_count", F.size("portfolio").cast("long").alias("listed"), F.array_join("sectors", ",").alias("sectors"))


def _profiles(s: SparkSession, sf: str) -> DataFrame:
    rounds = profile.section(e.rounds(s, sf), "rounds", ["date", "round_id", "amount_usd"], ["date", "round_id"])
    firms = profile.linked_holdings(e.holdings(s, sf), e.investors(s, sf).select("investor_id", "slug", "moderation_status"))
    owners = profile.section(firms, "investors", ["holding_id", "investor_slug"], ["holding_id"])
    return profile.profiles(e.companies(s, sf), [rounds, owners])


def profile_sections(s: SparkSession, sf: str) -> DataFrame:
    p = _profiles(s, sf)
    return p.select("slug", F.col("rounds_total").cast("long").alias("rounds_total"), F.col("investors_total").cast("long").alias("investors_total"), F.array_join(F.transform("rounds", lambda r: r["round_id"].cast("string")), ",").alias("round_ids"), F.array_join(F.transform("investors", lambda r: F.coalesce(r["investor_slug"], F.lit("-"))), ",").alias("firms"))


def profile_preview_gate(s: SparkSession, sf: str) -> DataFrame:
    last = profile.last_contribution([_contributions(s, sf)])
    gate = profile.access(last, e.users(s, sf), e.events_as_of(s, sf)).select(F.col("user_id").alias("company_id"), "unlocked")
    p = _profiles(s, sf).join(gate, "company_id", "left").withColumn("unlocked", F.coalesce("unlocked", F.lit(False)))
    g = profile.gated(p, ["rounds", "investors"], F.col("unlocked"))
    return g.select("slug", "unlocked", F.size("rounds").cast("long").alias("rounds_shown"), F.size("investors").cast("long").alias("investors_shown"), F.col("rounds_total").cast("long").alias("rounds_total"))


def funding_ladder(s: SparkSession, sf: str) -> DataFrame:
    return market.funding_ladder(e.rounds(s, sf))


def history_timeline(s: SparkSession, sf: str) -> DataFrame:
    named = profile.labels({"company": e.companies(s, sf).withColumn("entity_id", F.col("company_id").cast("string")), "round": e.rounds(s, sf).withColumn("entity_id", F.col("round_id").cast("string"))}, {"company": profile.row_label("company"), "round": profile.row_label("round")})
    rows = e.revisions(s, sf).where("company_id = 7")
    out = profile.timeline(rows, e.users(s, sf), named).withColumn("actor_user_id", F.col("actor_user_id"))
    return out.offset(10).limit(25).select("revision_id", "entity_type", "entity_label", "field", "actor", "actor_name", "created_at")


def _contributions(s: SparkSession, sf: str) -> DataFrame:
    """Large purchases stand for contributions."""
    ev = read_table(s, sf, "events").where("event_type = 'purchase' and value > 150")
    return ev.select(F.col("event_id").alias("entity_id"), F.col("user_id").alias("submitted_by"), F.col("ts").alias("created_at"), F.col("user_id").alias("company_id"))


def last_contribution(s: SparkSession, sf: str) -> DataFrame:
    ev = read_table(s, sf, "events").select(F.col("user_id").alias("submitted_by"), F.col("ts").alias("created_at"), "event_type")
    return profile.last_contribution([ev.where(F.col("event_type") == t) for t in ("click", "view", "purchase")])


def recent_contribution(s: SparkSession, sf: str) -> DataFrame:
    last = profile.last_contribution([_contributions(s, sf).where("created_at < timestamp_ntz '2024-01-20'")])
    return profile.access(last, e.users(s, sf), e.events_as_of(s, sf))


def my_contributions(s: SparkSession, sf: str) -> DataFrame:
    return _queue(s, sf, None).where("submitted_by = 8").select("type", "entity_id", "label", "created_at")


def _queue(s: SparkSession, sf: str, status: str | None) -> DataFrame:
    by, at = F.col("company_id") % 150, F.lit(None).cast("timestamp_ntz")
    companies = e.companies(s, sf).select(F.col("company_id").alias("entity_id"), "company_id", "name", "moderation_status", by.alias("submitted_by"), at.alias("created_at"))
    rounds = e.rounds(s, sf).select(F.col("round_id").alias("entity_id"), "company_id", "name", "moderation_status", by.alias("submitted_by"), F.col("date").alias("created_at"))
    holdings = e.holdings(s, sf).join(e.investors(s, sf).select("investor_id", "name"), "investor_id").select(F.col("holding_id").alias("entity_id"), "company_id", "name", "moderation_status", by.alias("submitted_by"), at.alias("created_at"))
    parts = {"company": companies, "round": rounds, "investor": holdings}
    if status is None:
        return moderation.queue([moderation.queue_part(k, df.withColumn("moderation_status", F.lit(PENDING))) for k, df in parts.items()])
    return moderation.queue([moderation.queue_part(k, df, status) for k, df in parts.items()])


def moderation_queue(s: SparkSession, sf: str) -> DataFrame:
    return _queue(s, sf, PENDING).select("type", "entity_id", "company_id", "label", "submitted_by", "created_at")


def queue_counts_by_type(s: SparkSession, sf: str) -> DataFrame:
    return moderation.counts_by_type(_queue(s, sf, PENDING))


def _saved(s: SparkSession, sf: str) -> DataFrame:
    ev = read_table(s, sf, "events").where("event_type = 'purchase'")
    return ev.groupBy("user_id", (F.col("event_id") % 300 + 1).alias("company_id")).agg(F.min("ts").alias("saved_at"))


def watchlist(s: SparkSession, sf: str) -> DataFrame:
    return profile.watchlist(_saved(s, sf), e.companies(s, sf))


def watchlist_save(s: SparkSession, sf: str) -> DataFrame:
    asked = read_table(s, sf, "events").where("event_type = 'view'").select("user_id", F.concat(F.lit("customer-"), F.lpad((F.col("event_id") % 40 + 1).cast("string"), 9, "0")).alias("slug"), F.col("ts").alias("saved_at"))
    return profile.save(_saved(s, sf), asked, e.companies(s, sf))


_CONTRIB_SQL = "contributions as (select event_id, user_id, ts from events where event_type = 'purchase' and value > 150)"
_ACCESS_SQL = """select user_id, role = 'ADMIN' or coalesce(a.d < last_at + interval 30 day, false) as unlocked, last_at + interval 30 day as unlocked_until, coalesce(last_at >= a.d - interval 30 day, false) as recent
  from users left join last using (user_id), (select max(ts) as d from events) a"""
_QUEUE_SQL = """, q as (
  select 'company' as type, 0 as o, cast(company_id as varchar) as entity_id, company_id, name as label, moderation_status, null::timestamp as created_at from companies
  union all select 'round', 1, cast(round_id as varchar), company_id, name || ' round', moderation_status, date from rounds
  union all select 'investor', 3, cast(holding_id as varchar), company_id, i.name, h.moderation_status, null from holdings h join investors i using (investor_id)
)
"""
_SAVED_SQL = ", saved as (select user_id, event_id % 300 + 1 as company_id, min(ts) as saved_at from events where event_type = 'purchase' group by all)"
_LIST_SQL = ", ".join(_LIST)

QUERIES = {
    f.__name__: f
    for f in (
        market_stats, market_totals, market_sort, top_raised, sector_page, directory_page, directory_search, directory_facets, directory_sort_valuation_nulls_last, directory_fallback_order,
        directory_in_list, compare_selection, typeahead, listed_slugs, sitemap, investor_directory, investor_search, investor_portfolio_sample, investor_detail,
        profile_sections, profile_preview_gate, funding_ladder, history_timeline, last_contribution, recent_contribution, my_contributions, moderation_queue,
        queue_counts_by_type, watchlist, watchlist_save,
    )
}

SQL = {
    "market_stats": MODEL_SQL + _STATS_SQL + "select * from stats",
    "market_totals": MODEL_SQL
    + f"""select (select cast(coalesce(sum(total_raised_usd), 0) as double) from shown) as total_raised_usd,
      (select count(*) from rounds r join shown c using (company_id) where r.moderation_status = 'APPROVED') as deal_count,
      (select count(*) from shown where last_valuation_usd >= {UNICORN}) as new_unicorns,
      (select 'Q' || quarter(max(o_orderdate)) || ' ' || year(max(o_orderdate)) from orders) as quarter""",
    "market_sort": MODEL_SQL + _STATS_SQL + "select * from stats order by trend_pct desc nulls last, sector limit 3",
    "top_raised": MODEL_SQL + "select slug, name, total_raised_usd from shown order by total_raised_usd desc, slug limit 8",
    "sector_page": MODEL_SQL + _STATS_SQL + "select slug, name, sector, company_count, deal_count from (select * from shown where sector = 'BUILDING' order by name, slug limit 25) join (select sector, company_count, deal_count from stats) using (sector)",
    "directory_page": MODEL_SQL + f"select {_LIST_SQL}, count(*) over () as total from shown order by name, slug limit 20 offset 40",
    "directory_search": MODEL_SQL + f"select {_LIST_SQL}, count(*) over () as total from shown where contains(lower(name), 'build') or contains(lower(one_liner), 'build') order by name, slug limit 25",
    "directory_facets": MODEL_SQL + f"select {_LIST_SQL} from shown where sector = 'MACHINERY' and stage = 'Series B' and status = 'Private'",
    "directory_sort_valuation_nulls_last": MODEL_SQL + "select slug, last_valuation_usd from shown order by last_valuation_usd desc nulls last, slug limit 100 offset 1100",
    "directory_fallback_order": MODEL_SQL + "select slug, last_valuation_usd from shown order by coalesce(last_valuation_usd, 0) desc, slug limit 100 offset 1100",
    "directory_in_list": MODEL_SQL + f"select {_LIST_SQL} from shown where slug in ('customer-000000001', 'customer-000000005', 'customer-000000010', 'nobody')",
    "compare_selection": MODEL_SQL + "select w.pos, slug, name from shown join (values (0, 'customer-000000009'), (1, 'customer-000000003'), (2, 'nobody'), (3, 'customer-000000001')) w(pos, slug) using (slug)",
    "typeahead": MODEL_SQL + "select slug, name, domain from shown where contains(lower(name), '00007') or contains(lower(one_liner), '00007') order by name, slug limit 10",
    "listed_slugs": MODEL_SQL + "select slug from shown",
    "sitemap": MODEL_SQL
    + """select 'https://example.com' || p as url from (values (''), ('/about')) t(p)
      union all select 'https://example.com/markets/' || trim(regexp_replace(lower(s), '[^a-z0-9]+', '-', 'g'), '-') from (values ('Artificial intelligence'), ('Fintech'), ('Financial services'), ('Healthcare'), ('Climate'), ('Energy'), ('Enterprise SaaS'), ('Real estate'), ('Transport'), ('Consumer & retail'), ('Media & telecom'), ('Education'), ('Industrials'), ('Technology')) t(s)
      union all select 'https://example.com/companies/' || slug from shown
      union all select 'https://example.com/investors/' || slug from investors where moderation_status = 'APPROVED'""",
    "investor_directory": MODEL_SQL
    + """, page as (select i.*, coalesce(n, 0) as all_holdings from investors i left join (select investor_id, count(*) as n from holdings group by 1) using (investor_id) where moderation_status = 'APPROVED' order by all_holdings desc, name, slug limit 20),
      r as (select *, row_number() over (partition by investor_id order by company_name, company_slug, holding_id) as k from public_holdings)
      select p.slug, p.name, p.type, all_holdings, (select count(*) from public_holdings h where h.investor_id = p.investor_id) as portfolio_count,
        coalesce((select string_agg(company_slug, ',' order by company_name, company_slug) from r where r.investor_id = p.investor_id and k <= 6), '') as sample,
        coalesce((select string_agg(distinct sector, ',' order by sector) from r where r.investor_id = p.investor_id and k <= 6), '') as sectors
      from page p""",
    "investor_search": MODEL_SQL + "select slug, name, type from investors where moderation_status = 'APPROVED' and contains(lower(name), 'supplier') and type = 'Hedge fund'",
    "investor_portfolio_sample": MODEL_SQL + "select investor_id, company_slug, rank from (select *, row_number() over (partition by investor_id order by company_name, company_slug, holding_id) as rank from public_holdings) where rank <= 6",
    "investor_detail": MODEL_SQL + "select i.slug, count(*) as portfolio_count, count(*) as listed, string_agg(distinct sector, ',' order by sector) as sectors from investors i join public_holdings using (investor_id) where i.slug = 'supplier-000000007' group by i.slug",
    "profile_sections": MODEL_SQL
    + """, r as (select company_id, count(*) as n, string_agg(cast(round_id as varchar), ',' order by date, round_id) as ids from rounds where moderation_status = 'APPROVED' group by 1),
      h as (select company_id, count(*) as n, string_agg(coalesce(case when i.moderation_status = 'APPROVED' then i.slug end, '-'), ',' order by holding_id) as firms from holdings h left join investors i using (investor_id) where h.moderation_status = 'APPROVED' group by 1)
      select slug, coalesce(r.n, 0) as rounds_total, coalesce(h.n, 0) as investors_total, coalesce(ids, '') as round_ids, coalesce(firms, '') as firms from shown left join r using (company_id) left join h using (company_id)""",
    "profile_preview_gate": MODEL_SQL
    + f""", {_CONTRIB_SQL}, last as (select user_id, max(ts) as last_at from contributions group by 1), gate as ({_ACCESS_SQL}),
      r as (select company_id, count(*) as n from rounds where moderation_status = 'APPROVED' group by 1), h as (select company_id, count(*) as n from holdings where moderation_status = 'APPROVED' group by 1)
      select slug, coalesce(unlocked, false) as unlocked, case when coalesce(unlocked, false) then coalesce(r.n, 0) else least(2, coalesce(r.n, 0)) end as rounds_shown,
        case when coalesce(unlocked, false) then coalesce(h.n, 0) else least(2, coalesce(h.n, 0)) end as investors_shown, coalesce(r.n, 0) as rounds_total
      from shown left join r using (company_id) left join h using (company_id) left join gate on gate.user_id = company_id""",
    "funding_ladder": MODEL_SQL + "select company_id, round_id, amount_usd, greatest(8.0::double, case when max(amount_usd) over w > 0 then cast(amount_usd as double) / max(amount_usd) over w * 100 else 0.0::double end) as bar_pct from rounds where moderation_status = 'APPROVED' window w as (partition by company_id)",
    "history_timeline": MODEL_SQL
    + """select revision_id, entity_type, coalesce(case when entity_type = 'company' then c.name else r.name || ' round' end, entity_type) as entity_label, field, actor, case when actor = 'INGEST' then actor_source else u.name end as actor_name, created_at
      from revisions v left join users u on u.user_id = v.actor_user_id left join companies c on v.entity_type = 'company' and cast(c.company_id as varchar) = v.entity_id left join rounds r on v.entity_type = 'round' and cast(r.round_id as varchar) = v.entity_id
      where v.company_id = 7 order by created_at desc, revision_id desc limit 25 offset 10""",
    "last_contribution": "select user_id, max(ts) as last_at from events where event_type in ('click', 'view', 'purchase') group by user_id",
    "recent_contribution": MODEL_SQL + f", {_CONTRIB_SQL}, last as (select user_id, max(ts) as last_at from contributions where ts < timestamp '2024-01-20' group by 1) {_ACCESS_SQL}",
    "my_contributions": MODEL_SQL + _QUEUE_SQL + "select type, entity_id, label, created_at from q where company_id % 150 = 8",
    "moderation_queue": MODEL_SQL + _QUEUE_SQL + "select type, entity_id, cast(company_id as varchar) as company_id, label, company_id % 150 as submitted_by, created_at from q where moderation_status = 'PENDING'",
    "queue_counts_by_type": MODEL_SQL + _QUEUE_SQL + "select t as type, count(q.type) as n from (values ('company'), ('round'), ('person'), ('investor'), ('acquisition'), ('exit'), ('diversity'), ('proposal')) k(t) left join q on q.type = t and moderation_status = 'PENDING' group by t",
    "watchlist": MODEL_SQL + _SAVED_SQL + " select user_id, slug, name, stage, total_raised_usd, saved_at from saved join shown using (company_id)",
    "watchlist_save": MODEL_SQL
    + _SAVED_SQL
    + """, asked as (select user_id, company_id, min(ts) as saved_at from events join shown on slug = 'customer-' || lpad(cast(event_id % 40 + 1 as varchar), 9, '0') where event_type = 'view' group by all)
      select user_id, company_id, saved_at from saved union all select user_id, company_id, saved_at from asked anti join saved using (user_id, company_id)""",
}
