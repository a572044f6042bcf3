"""The data model over the driver's tables: customers are companies, orders rounds, suppliers investors, events changes and contributions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from capstrata.functions import values
from capstrata.functions import vocabulary as v
from capstrata.functions.text import kebab
from capstrata.session import read_table


def companies(spark: SparkSession, sf: str) -> DataFrame:
    c = read_table(spark, sf, "customer")
    key = F.col("c_custkey")
    raised = values.round_half_up(F.abs("c_acctbal") * 1000)
    source = F.when(key % 3 == 0, v.SEC_EDGAR).when(key % 3 == 1, v.WIKIDATA)
    return c.select(
        key.alias("company_id"),
        F.col("c_name").alias("name"),
        kebab(F.col("c_name")).alias("slug"),
        F.concat(F.lit("c"), (key % 1000).cast("string"), F.lit(".example.com")).alias("domain"),
        F.col("c_mktsegment").alias("sector"),
        F.concat(F.lit("Works in "), F.lower("c_mktsegment")).alias("one_liner"),
        values.stage_of_amount(raised * 10).alias("stage"),
        F.when(key % 7 == 0, "Public").when(key % 11 == 0, "Acquired").otherwise("Private").alias("status"),
        raised.alias("total_raised_usd"),
        F.when(F.col("c_acctbal") >= 0, values.round_half_up(F.col("c_acctbal"))).alias("last_valuation_usd"),
        F.when(key % 10 == 0, v.PENDING).otherwise(v.APPROVED).alias("moderation_status"),
        source.alias("external_source"),
        F.when(key % 3 == 0, key.cast("string")).when(key % 3 == 1, F.concat(F.lit("Q"), key.cast("string"))).alias("external_id"),
        F.col("c_nationkey").alias("nation_id"),
    )


def rounds(spark: SparkSession, sf: str) -> DataFrame:
    o = read_table(spark, sf, "orders")
    status = F.when(F.col("o_orderstatus") == "F", v.APPROVED).when(F.col("o_orderstatus") == "O", v.PENDING).otherwise(v.REJECTED)
    return o.select(
        F.col("o_orderkey").alias("round_id"),
        F.col("o_custkey").alias("company_id"),
        F.col("o_orderpriority").alias("name"),
        values.round_half_up(F.col("o_totalprice")).alias("amount_usd"),
        F.col("o_orderdate").alias("date"),
        status.alias("moderation_status"),
        F.lit(v.SEC_EDGAR).alias("external_source"),
        F.concat(F.lit("acc-"), F.col("o_orderkey").cast("string")).alias("external_id"),
    )


def investors(spark: SparkSession, sf: str) -> DataFrame:
    s = read_table(spark, sf, "supplier")
    key = F.col("s_suppkey")
    kinds = F.array(*[F.lit(t) for t in v.INVESTOR_TYPES])
    return s.select(
        key.alias("investor_id"),
        F.col("s_name").alias("name"),
        kebab(F.col("s_name"), "investor").alias("slug"),
        F.get(kinds, (key % len(v.INVESTOR_TYPES)).cast("int")).alias("type"),
        F.when(key % 10 == 0, v.PENDING).otherwise(v.APPROVED).alias("moderation_status"),
    )


def holdings(spark: SparkSession, sf: str) -> DataFrame:
    """Which supplier served which customer, once each.

    Orders are merged, whatever their file's size: compressed, one of millions of rows can look small enough to be broadcast.
    """
    lines = read_table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), F.col("l_suppkey").alias("investor_id"))
    orders = read_table(spark, sf, "orders").select("o_orderkey", F.col("o_custkey").alias("company_id"))
    pairs = lines.join(orders.hint("merge"), "o_orderkey").select("investor_id", "company_id").distinct()
    both = F.col("investor_id") + F.col("company_id")
    return pairs.select((F.col("investor_id") * 1_000_000_000 + F.col("company_id")).alias("holding_id"), "investor_id", "company_id", F.when(both % 7 == 0, v.PENDING).otherwise(v.APPROVED).alias("moderation_status"))


def users(spark: SparkSession, sf: str) -> DataFrame:
    ids = read_table(spark, sf, "events").select("user_id").distinct()
    return ids.select("user_id", F.concat(F.lit("user-"), F.col("user_id").cast("string")).alias("name"), F.when(F.col("user_id") % 25 == 0, "ADMIN").otherwise("USER").alias("role"))


def revisions(spark: SparkSession, sf: str) -> DataFrame:
    e = read_table(spark, sf, "events")
    i = F.col("event_id")
    return e.select(
        i.alias("revision_id"),
        F.col("user_id").alias("company_id"),
        F.when(i % 3 == 0, "round").otherwise("company").alias("entity_type"),
        F.when(i % 3 == 0, i).otherwise(F.col("user_id")).cast("string").alias("entity_id"),
        F.col("event_type").alias("field"),
        F.when(i % 4 == 0, "INGEST").otherwise("ADMIN").alias("actor"),
        F.when(i % 4 == 0, v.SEC_EDGAR).alias("actor_source"),
        F.when(i % 4 != 0, F.col("user_id")).alias("actor_user_id"),
        F.col("ts").alias("created_at"),
    )


def as_of(spark: SparkSession, sf: str) -> Column:
    """The last order date: one figure, asked for once."""
    return F.lit(read_table(spark, sf, "orders").agg(F.max("o_orderdate")).first()[0])


def events_as_of(spark: SparkSession, sf: str) -> Column:
    return F.lit(read_table(spark, sf, "events").agg(F.max("ts")).first()[0])


_STAGE = "case when {x} < 5000000 then 'Seed' when {x} < 20000000 then 'Series A' when {x} < 60000000 then 'Series B' when {x} < 150000000 then 'Series C' when {x} < 400000000 then 'Series D' else 'Late stage' end"
STAGE_SQL = _STAGE.format(x="total_raised_usd * 10")

#: The same model in SQL, as common table expressions for the checks.
MODEL_SQL = f"""
with companies as (
  select *, {STAGE_SQL} as stage from (
    select c_custkey as company_id, c_name as name, trim(regexp_replace(lower(c_name), '[^a-z0-9]+', '-', 'g'), '-') as slug,
      'c' || (c_custkey % 1000) || '.example.com' as domain, c_mktsegment as sector, 'Works in ' || lower(c_mktsegment) as one_liner,
      case when c_custkey % 7 = 0 then 'Public' when c_custkey % 11 = 0 then 'Acquired' else 'Private' end as status,
      cast(floor(abs(c_acctbal) * 1000 + 0.5) as bigint) as total_raised_usd,
      case when c_acctbal >= 0 then cast(floor(c_acctbal + 0.5) as bigint) end as last_valuation_usd,
      case when c_custkey % 10 = 0 then 'PENDING' else 'APPROVED' end as moderation_status,
      case c_custkey % 3 when 0 then 'SEC_EDGAR' when 1 then 'WIKIDATA' end as external_source,
      case c_custkey % 3 when 0 then cast(c_custkey as varchar) when 1 then 'Q' || c_custkey end as external_id,
      c_nationkey as nation_id
    from customer)
), rounds as (
  select o_orderkey as round_id, o_custkey as company_id, o_orderpriority as name, cast(floor(o_totalprice + 0.5) as bigint) as amount_usd, o_orderdate as date,
    case o_orderstatus when 'F' then 'APPROVED' when 'O' then 'PENDING' else 'REJECTED' end as moderation_status, 'SEC_EDGAR' as external_source, 'acc-' || o_orderkey as external_id
  from orders
), investors as (
  select s_suppkey as investor_id, s_name as name, trim(regexp_replace(lower(s_name), '[^a-z0-9]+', '-', 'g'), '-') as slug,
    list_extract({list(v.INVESTOR_TYPES)!r}, 1 + s_suppkey % {len(v.INVESTOR_TYPES)}) as type,
    case when s_suppkey % 10 = 0 then 'PENDING' else 'APPROVED' end as moderation_status
  from supplier
), holdings as (
  select investor_id * 1000000000 + company_id as holding_id, investor_id, company_id, case when (investor_id + company_id) % 7 = 0 then 'PENDING' else 'APPROVED' end as moderation_status
  from (select distinct l_suppkey as investor_id, o_custkey as company_id from lineitem join orders on l_orderkey = o_orderkey)
), users as (
  select distinct user_id, 'user-' || user_id as name, case when user_id % 25 = 0 then 'ADMIN' else 'USER' end as role from events
), revisions as (
  select event_id as revision_id, user_id as company_id, case when event_id % 3 = 0 then 'round' else 'company' end as entity_type,
    cast(case when event_id % 3 = 0 then event_id else user_id end as varchar) as entity_id, event_type as field,
    case when event_id % 4 = 0 then 'INGEST' else 'ADMIN' end as actor, case when event_id % 4 = 0 then 'SEC_EDGAR' end as actor_source,
    case when event_id % 4 <> 0 then user_id end as actor_user_id, ts as created_at
  from events
), shown as (select * from companies where moderation_status = 'APPROVED'
), public_holdings as (
  select h.holding_id, h.investor_id, h.company_id, c.slug as company_slug, c.name as company_name, c.sector
  from holdings h join shown c using (company_id) where h.moderation_status = 'APPROVED'
)
"""
