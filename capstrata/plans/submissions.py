"""Queries of what users submit and what forms and profiles show of a company, each with the SQL that checks it."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from capstrata.functions import vocabulary as v
from capstrata.operators import checks, moderation, profile
from capstrata.plans import entities as e
from capstrata.plans.entities import MODEL_SQL
from capstrata.session import read_table


def contribution_inserts(s: SparkSession, sf: str) -> DataFrame:
    """Events of known users stand for new rows of the seven kinds: pending, with who submitted them and when."""
    k = F.col("event_id")
    kind = F.get(F.array(*[F.lit(t) for t in v.REVISABLE_TYPES]), (k % len(v.REVISABLE_TYPES)).cast("int"))
    rows = read_table(s, sf, "events").where("user_id > 0").select(kind.alias("type"), k.alias("entity_id"), (k % 100).alias("company_id"), "user_id", "ts")
    made = moderation.contributed(rows, F.col("user_id"), F.col("ts"))
    return made.select("type", "entity_id", "company_id", "moderation_status", "submitted_by", "created_at")


def decision_dispatch(s: SparkSession, sf: str) -> DataFrame:
    """Where each decision goes; some name no known kind, some none at all."""
    k = F.col("event_id")
    kinds = F.array(*[F.lit(t) for t in (*v.REVIEWABLE_TYPES, "comment")])
    decisions = read_table(s, sf, "events").select(k.alias("entity_id"), F.get(kinds, (k % 10).cast("int")).alias("type"))
    routes = zip(("proposal", "row", "refused"), moderation.dispatch(decisions), strict=True)
    return reduce(DataFrame.unionByName, [df.withColumn("route", F.lit(name)) for name, df in routes])


def contribution_validation(s: SparkSession, sf: str) -> DataFrame:
    """Submitted exits and persons, valid or not, with the names of the rules that they break."""
    o, c = F.col("o_orderkey"), F.col("c_custkey")
    exits = read_table(s, sf, "orders").select(
        o.alias("entity_id"), F.get(F.array(*[F.lit(t) for t in (*v.EXIT_TYPES, "Gift")]), (o % 4).cast("int")).alias("type"),
        F.when(o % 5 == 0, "soon").otherwise(F.date_format("o_orderdate", "yyyy-MM-dd")).alias("date"),
        F.when(o % 6 == 0, None).when(o % 7 == 0, -1).otherwise(o).alias("value_usd"), F.when(o % 9 == 0, "  ").otherwise("Sold").alias("detail"),
        F.when(o % 3 == 0, "https://proof.example/1").when(o % 11 == 0, "ftp:x").alias("source_url"),
    )
    people = read_table(s, sf, "customer").select(
        c.alias("entity_id"), F.when(c % 4 == 0, "").otherwise(F.col("c_name")).alias("name"), F.when(c % 5 != 0, "Founder").alias("role"), F.when(c % 3 != 0, 2000 + c % 20).alias("since"),
        F.when(c % 7 == 0, "https://people.example/1").when(c % 8 == 0, "people").alias("linkedin_url"), F.lit(None).cast("string").alias("source_url"),
    )
    out = []
    for kind, rows in (("exit", exits), ("person", people)):
        valid, refused = checks.split_valid(rows, checks.contribution_rules(kind))
        for part, reasons in ((valid, F.lit("")), (refused, F.array_join("reasons", ","))):
            out.append(part.select(F.lit(kind).alias("kind"), "entity_id", reasons.alias("reasons")))
    return reduce(DataFrame.unionByName, out)


def edit_fields(s: SparkSession, sf: str) -> DataFrame:
    """The editable fields of all companies, as JSON values."""
    companies = e.companies(s, sf)
    return companies.select("company_id", F.explode(moderation.current_values(companies)).alias("field", "value"))


def company_figures(s: SparkSession, sf: str) -> DataFrame:
    """The sector that is shown (else the first industry), and figures only where the revenue is known."""
    k = F.col("company_id")
    industry = F.when(k % 6 == 0, F.array().cast("array<string>")).otherwise(F.array(F.lower("sector"), F.lit("other")))
    figures = profile.financials(F.when(k % 4 != 0, k * 1000), F.when(k % 5 != 0, (k % 9).cast("double")), F.when(k % 7 != 0, (k % 8).cast("double")))
    rows = e.companies(s, sf).select("slug", profile.display_sector(F.when(k % 3 != 0, F.col("sector")), industry).alias("shown_sector"), figures.alias("f"))
    return rows.select("slug", "shown_sector", F.col("f").isNotNull().alias("has_figures"), "f.revenue_usd", "f.growth_pct", "f.margin_pct")


QUERIES = {f.__name__: f for f in (contribution_inserts, decision_dispatch, contribution_validation, edit_fields, company_figures)}

_EDITABLE = ("name", "domain", "one_liner", "status", "stage")
_FIELDS_SQL = " union all ".join(
    [f"""select company_id, '{f}' as field, coalesce('"' || {f} || '"', 'null') as value from companies""" for f in _EDITABLE]
    + [f"select company_id, '{f}', coalesce(cast({f} as varchar), 'null') from companies" for f in v.MONEY_FIELDS]
)
SQL = {
    "contribution_inserts": f"select list_extract({list(v.REVISABLE_TYPES)!r}, 1 + event_id % 7) as type, event_id as entity_id, event_id % 100 as company_id, 'PENDING' as moderation_status, user_id as submitted_by, ts as created_at from events where user_id > 0",
    "decision_dispatch": f"""select entity_id, type, case when type = 'proposal' then 'proposal' when type is null or type = 'comment' then 'refused' else 'row' end as route
      from (select event_id as entity_id, list_extract({[*v.REVIEWABLE_TYPES, "comment"]!r}, 1 + event_id % 10) as type from events)""",
    "contribution_validation": """
      select 'exit' as kind, o_orderkey as entity_id, concat_ws(',', case when o_orderkey % 4 = 3 then 'type' end, case when o_orderkey % 5 = 0 then 'date' end, case when o_orderkey % 7 = 0 and o_orderkey % 6 <> 0 then 'value_usd' end,
        case when o_orderkey % 9 = 0 then 'detail' end, case when o_orderkey % 11 = 0 and o_orderkey % 3 <> 0 then 'source_url' end) as reasons from orders
      union all select 'person', c_custkey, concat_ws(',', case when c_custkey % 4 = 0 then 'name' end, case when c_custkey % 5 = 0 then 'role' end, case when c_custkey % 3 = 0 then 'since' end,
        case when c_custkey % 8 = 0 and c_custkey % 7 <> 0 then 'linkedin_url' end) from customer""",
    "edit_fields": MODEL_SQL + _FIELDS_SQL,
    "company_figures": MODEL_SQL
    + """select slug, case when company_id % 3 <> 0 then sector when company_id % 6 <> 0 then lower(sector) end as shown_sector, company_id % 4 <> 0 as has_figures, case when company_id % 4 <> 0 then company_id * 1000 end as revenue_usd,
        case when company_id % 4 <> 0 then case when company_id % 5 <> 0 then cast(company_id % 9 as double) else 0.0 end end as growth_pct, case when company_id % 4 <> 0 then case when company_id % 7 <> 0 then cast(company_id % 8 as double) else 0.0 end end as margin_pct
      from companies""",
}
