"""Reads over all kinds of contributions and all sections of a profile, each with the SQL that checks it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from capstrata.functions import values
from capstrata.functions import vocabulary as v
from capstrata.operators import directory, moderation, profile
from capstrata.plans import entities as e
from capstrata.plans.entities import MODEL_SQL
from capstrata.session import read_table

_SECTIONS = ("rounds", "people", "investors", "acquisitions", "exits", "diversity")


def _of_companies(s: SparkSession, sf: str, every: int, columns: dict[str, Column], id_offset: int) -> DataFrame:
    """A child of every so many customers, pending where the customer's number is a multiple of four."""
    k = F.col("c_custkey")
    made = {"entity_id": k + id_offset, "company_id": k, "moderation_status": F.when(k % 4 == 0, v.PENDING).otherwise(v.APPROVED)}
    return read_table(s, sf, "customer").where(k % every == 0).select(*[c.alias(n) for n, c in (made | columns).items()])


def _parts(s: SparkSession, sf: str) -> dict[str, DataFrame]:
    """The seven kinds of rows; companies, rounds and holdings as in the other queries."""
    k, none = F.col("c_custkey"), F.lit(None).cast("timestamp_ntz")
    held = e.holdings(s, sf).join(e.investors(s, sf).select("investor_id", "name"), "investor_id").select(F.col("holding_id").alias("entity_id"), "company_id", "name", "moderation_status")
    made = {
        "company": e.companies(s, sf).select(F.col("company_id").alias("entity_id"), "company_id", "name", "moderation_status"),
        "round": e.rounds(s, sf).select(F.col("round_id").alias("entity_id"), "company_id", "name", "moderation_status", F.col("date").alias("created_at")),
        "person": _of_companies(s, sf, 2, {"name": F.concat(F.lit("Head "), k.cast("string"))}, 0),
        "investor": held,
        "acquisition": _of_companies(s, sf, 3, {"target": F.concat(F.lit("Target "), k.cast("string"))}, 0),
        "exit": _of_companies(s, sf, 5, {"type": F.when(k % 2 == 0, "IPO").otherwise("Secondary")}, 0),
        "diversity": _of_companies(s, sf, 7, {"label": F.concat(F.lit("Label "), k.cast("string"))}, 0),
    }
    by = (F.col("company_id") % 150).alias("submitted_by")
    return {kind: df.select("*", by, *([] if "created_at" in df.columns else [none.alias("created_at")])) for kind, df in made.items()}


def _asked(s: SparkSession, sf: str) -> DataFrame:
    """Views propose a new name of the user's company; every third cites a source."""
    ev = read_table(s, sf, "events").where("event_type = 'view' and user_id > 0")
    k = F.col("event_id")
    state = F.when(k % 2 == 0, v.PENDING).otherwise(v.REJECTED)
    changes = F.create_map(F.lit("name"), F.concat(F.lit('"Name '), k.cast("string"), F.lit('"')))
    return ev.select(k.alias("proposal_id"), F.col("user_id").alias("company_id"), changes.alias("changes"), F.col("user_id").alias("submitted_by"), F.col("ts").alias("created_at"), F.when(k % 3 == 0, F.concat(F.lit("https://proof.example/"), k.cast("string"))).alias("source_url"), state.alias("moderation_status"))


def _cited(s: SparkSession, sf: str) -> DataFrame:
    """Clicks cite orders as a whole, or a field of them."""
    ev = read_table(s, sf, "events").where("event_type = 'click'")
    k = F.col("event_id")
    return ev.select(F.lit("round").alias("entity_type"), (k % 700).cast("string").alias("entity_id"), F.when(k % 4 == 0, "amount_usd").otherwise("").alias("field"), F.concat(F.lit("https://cited.example/"), k.cast("string")).alias("url"), F.col("ts").alias("created_at"))


def _queue(s: SparkSession, sf: str, status: str) -> DataFrame:
    parts = [moderation.queue_part(kind, df, status) for kind, df in _parts(s, sf).items()]
    return moderation.queue([*parts, moderation.proposal_part(_asked(s, sf), status)], _cited(s, sf))


def queue_whole(s: SparkSession, sf: str) -> DataFrame:
    """All eight kinds that wait, with who submitted them, their company and source."""
    rows = moderation.with_context(_queue(s, sf, v.PENDING), e.users(s, sf), e.companies(s, sf))
    return rows.select("type", "entity_id", "label", F.col("submitter.name").alias("submitter"), F.col("company.slug").alias("company_slug"), F.col("company.name").alias("company_name"), "source_url", "created_at")


def queue_whole_counts(s: SparkSession, sf: str) -> DataFrame:
    return moderation.counts_by_type(_queue(s, sf, v.PENDING))


def contributions_whole(s: SparkSession, sf: str) -> DataFrame:
    """What a user contributed, in any state, with its state and company, beside the window that it opens."""
    rows = moderation.contributions(_parts(s, sf), _asked(s, sf), e.companies(s, sf), F.lit(8))
    granted = profile.access(_last(s, sf), e.users(s, sf), e.as_of(s, sf))
    return profile.contributions_with_access(rows, granted).select("type", "entity_id", "label", F.col("moderation_status").alias("status"), F.col("company.slug").alias("company_slug"), F.col("company.name").alias("company_name"), "created_at", "unlocked", values.date_only(F.col("unlocked_until")).alias("unlocked_until"))


def _last(s: SparkSession, sf: str) -> DataFrame:
    return profile.last_contribution([*_parts(s, sf).values(), _asked(s, sf)])


def last_contribution_whole(s: SparkSession, sf: str) -> DataFrame:
    """Over all eight tables."""
    return _last(s, sf)


def _lines(s: SparkSession, sf: str) -> DataFrame:
    """The suppliers of an order's lines stand for a round's investors; the first line leads."""
    lines = read_table(s, sf, "lineitem").join(read_table(s, sf, "supplier"), F.col("l_suppkey") == F.col("s_suppkey"))
    return lines.select(F.col("l_orderkey").alias("round_id"), F.concat("s_name", F.lit(" "), F.col("l_linenumber").cast("string")).alias("name"), (F.col("l_linenumber") == 1).alias("lead"))


def profile_whole(s: SparkSession, sf: str) -> DataFrame:
    """Approved companies with the rows of their six sections that are shown, totals, access, and the citations of what is shown.

    Clicks cite companies, persons and rounds.
    """
    parts = _parts(s, sf)
    rounds = profile.round_investors(e.rounds(s, sf), _lines(s, sf)).select(F.col("round_id").alias("entity_id"), "company_id", "moderation_status", F.col("date").alias("created_at"), F.concat("name", F.lit(" round")).alias("label"), "investors")
    firms = profile.linked_holdings(e.holdings(s, sf), e.investors(s, sf)).select(F.col("holding_id").alias("entity_id"), "company_id", "moderation_status", F.col("investor_slug").alias("label"))
    rows = {"rounds": ("round", rounds, ["label", "investors"], ["created_at", "entity_id"]), "investors": ("investor", firms, ["label"], ["entity_id"])}
    for name, kind in {"people": "person", "acquisitions": "acquisition", "exits": "exit", "diversity": "diversity"}.items():
        rows[name] = (kind, parts[kind].withColumn("label", profile.row_label(kind)), ["label"], ["entity_id"])
    k = F.col("event_id")
    cited = read_table(s, sf, "events").where("event_type = 'click'").select(k.alias("citation_id"), (k % 250).alias("source_id"), F.when(k % 3 == 0, "company").when(k % 3 == 1, "person").otherwise("round").alias("entity_type"), F.when(k % 3 == 2, k).otherwise(F.col("user_id")).alias("entity_id"), F.col("ts").alias("created_at"))
    sources = read_table(s, sf, "pages").select(F.col("page_id").alias("source_id"), "url")
    viewer = profile.access(_last(s, sf), e.users(s, sf), e.as_of(s, sf)).withColumnRenamed("user_id", "company_id")
    p = profile.read(e.companies(s, sf), rows, cited, sources, viewer)
    listed = [F.array_join(F.transform(n, lambda x: F.concat_ws(":", x["entity_id"].cast("string"), x["label"])), ";").alias(n) for n in _SECTIONS]
    investors = F.array_join(F.flatten(F.transform("rounds", lambda r: F.transform(r["investors"], lambda i: F.concat(i["name"], F.when(i["lead"], "*").otherwise(""))))), ",")
    return p.select("slug", "unlocked", values.date_only(F.col("unlocked_until")).alias("unlocked_until"), "preview_limit", *[F.col(f"{n}_total").cast("long").alias(f"{n}_total") for n in _SECTIONS], *listed, investors.alias("round_investors"), F.array_join(F.transform("citations", lambda c: F.concat_ws(" ", c["entity_type"], c["url"])), ",").alias("citations"))


def history_page(s: SparkSession, sf: str) -> DataFrame:
    named = profile.labels({kind: df.withColumn("entity_id", F.col("entity_id").cast("string")) for kind, df in _parts(s, sf).items()}, {kind: profile.row_label(kind) for kind in v.REVISABLE_TYPES})
    out = profile.history(e.revisions(s, sf).where("company_id = 7"), e.users(s, sf), named, 2, 10)
    return out.select("revision_id", "entity_type", "entity_label", "field", "actor_name", "created_at", "total")


def slugs_newest(s: SparkSession, sf: str) -> DataFrame:
    """Slugs by the day of a company's last order, newest first."""
    last = e.rounds(s, sf).groupBy("company_id").agg(F.max("date").alias("updated_at"))
    return directory.slugs(e.companies(s, sf).join(last, "company_id"), newest_first=True).select("slug", values.date_only(F.col("updated_at")).alias("updated"))


QUERIES = {f.__name__: f for f in (queue_whole, queue_whole_counts, contributions_whole, last_contribution_whole, profile_whole, history_page, slugs_newest)}

_KIDS = "case when c_custkey % 4 = 0 then 'PENDING' else 'APPROVED' end"
_PARTS_SQL = (
    MODEL_SQL
    + f""", parts as (
  select 'company' as type, company_id as entity_id, company_id, name as label, moderation_status, null::timestamp as created_at, company_id % 150 as submitted_by from companies
  union all select 'round', round_id, company_id, name || ' round', moderation_status, date, company_id % 150 from rounds
  union all select 'person', c_custkey, c_custkey, 'Head ' || c_custkey, {_KIDS}, null, c_custkey % 150 from customer where c_custkey % 2 = 0
  union all select 'investor', holding_id, company_id, i.name, h.moderation_status, null, company_id % 150 from holdings h join investors i using (investor_id)
  union all select 'acquisition', c_custkey, c_custkey, 'Acquired Target ' || c_custkey, {_KIDS}, null, c_custkey % 150 from customer where c_custkey % 3 = 0
  union all select 'exit', c_custkey, c_custkey, case when c_custkey % 2 = 0 then 'IPO' else 'Secondary' end || ' exit', {_KIDS}, null, c_custkey % 150 from customer where c_custkey % 5 = 0
  union all select 'diversity', c_custkey, c_custkey, 'Label ' || c_custkey, {_KIDS}, null, c_custkey % 150 from customer where c_custkey % 7 = 0
), asked as (
  select event_id, user_id, ts, case when event_id % 3 = 0 then 'https://proof.example/' || event_id end as source_url, case when event_id % 2 = 0 then 'PENDING' else 'REJECTED' end as moderation_status from events where event_type = 'view' and user_id > 0
), all8 as (
  select type, cast(entity_id as varchar) as entity_id, company_id, label, moderation_status, created_at, submitted_by, null::varchar as source_url from parts
  union all select 'proposal', cast(event_id as varchar), user_id, 'Edit name', moderation_status, ts, user_id, source_url from asked
), last as (select submitted_by as user_id, max(created_at) as last_at from all8 group by 1
), gate as (select user_id, role = 'ADMIN' or coalesce(a.d < last_at + interval 30 day, false) as unlocked, last_at + interval 30 day as unlocked_until from users left join last using (user_id), (select max(o_orderdate) as d from orders) a)
"""
)
_KINDS = {"rounds": "round", "people": "person", "investors": "investor", "acquisitions": "acquisition", "exits": "exit", "diversity": "diversity"}
_TOTALS_SQL = ", ".join(f"coalesce((select max(n) from kids x where x.company_id = p.company_id and x.type = '{kind}'), 0) as {name}_total" for name, kind in _KINDS.items())
_LISTS_SQL = ", ".join(f"coalesce((select string_agg(concat_ws(':', cast(entity_id as varchar), label), ';' order by k) from seen x where x.company_id = p.company_id and x.type = '{kind}'), '') as {name}" for name, kind in _KINDS.items())
SQL = {
    "queue_whole": _PARTS_SQL
    + """, cited as (select entity_id, arg_max(url, (created_at, url)) as url from (select cast(event_id % 700 as varchar) as entity_id, 'https://cited.example/' || event_id as url, ts as created_at from events where event_type = 'click' and event_id % 4 <> 0) group by 1)
      select q.type, q.entity_id, q.label, u.name as submitter, c.slug as company_slug, c.name as company_name, coalesce(q.source_url, case when q.type = 'round' then x.url end) as source_url, q.created_at
      from all8 q left join users u on u.user_id = q.submitted_by left join companies c on c.company_id = q.company_id left join cited x on x.entity_id = q.entity_id where q.moderation_status = 'PENDING'""",
    "queue_whole_counts": _PARTS_SQL + "select type, count(*) filter (moderation_status = 'PENDING') as n from all8 group by type",
    "contributions_whole": _PARTS_SQL
    + """select type, entity_id, case when type = 'proposal' then 'Edit: name' else label end as label, moderation_status as status, c.slug as company_slug, c.name as company_name, created_at, unlocked, strftime(unlocked_until, '%Y-%m-%d') as unlocked_until
      from all8 q left join gate on user_id = submitted_by left join companies c on c.company_id = q.company_id where submitted_by = 8""".replace("moderation_status", "q.moderation_status"),
    "last_contribution_whole": _PARTS_SQL + "select user_id, last_at from last",
    "profile_whole": _PARTS_SQL
    + f""", labelled as (select type, entity_id, company_id, created_at, moderation_status, label from parts where type not in ('company', 'investor')
        union all select 'investor', holding_id, company_id, null, h.moderation_status, case when i.moderation_status = 'APPROVED' then slug end from holdings h left join investors i using (investor_id)),
      kids as (select *, row_number() over (partition by type, company_id order by created_at, entity_id) as k, count(*) over (partition by type, company_id) as n from labelled where moderation_status = 'APPROVED'),
      p as (select shown.company_id, slug, coalesce(unlocked, false) as unlocked, unlocked_until from shown left join gate on gate.user_id = shown.company_id),
      seen as (select kids.* from kids join p using (company_id) where unlocked or k <= 2),
      ri as (select l_orderkey as round_id, string_agg(s_name || ' ' || l_linenumber || case when l_linenumber = 1 then '*' else '' end, ',' order by s_name || ' ' || l_linenumber) as names from lineitem join supplier on s_suppkey = l_suppkey group by 1),
      cites as (select event_id, ts, url, case event_id % 3 when 0 then 'company' when 1 then 'person' else 'round' end as type, case when event_id % 3 = 2 then event_id else user_id end as entity_id from events join pages on page_id = event_id % 250 where event_type = 'click'),
      visible as (select company_id, 'company' as type, company_id as entity_id from p union all select company_id, type, entity_id from seen),
      cited as (select company_id, string_agg(type || ' ' || url, ',' order by ts, event_id) as citations from visible join cites using (type, entity_id) group by 1)
      select slug, unlocked, strftime(unlocked_until, '%Y-%m-%d') as unlocked_until, cast(2 as integer) as preview_limit, {_TOTALS_SQL}, {_LISTS_SQL},
        coalesce((select string_agg(names, ',' order by k) from seen x join ri on round_id = entity_id where x.company_id = p.company_id and x.type = 'round'), '') as round_investors, coalesce(citations, '') as citations
      from p left join cited using (company_id)""",
    "history_page": _PARTS_SQL
    + """select revision_id, entity_type, coalesce(p.label, entity_type) as entity_label, field, case when actor = 'INGEST' then actor_source else u.name end as actor_name, v.created_at, count(*) over () as total
      from revisions v left join users u on u.user_id = v.actor_user_id left join parts p on p.type = v.entity_type and cast(p.entity_id as varchar) = v.entity_id where v.company_id = 7 order by v.created_at desc, revision_id desc limit 10 offset 10""",
    "slugs_newest": MODEL_SQL + "select slug, strftime(d, '%Y-%m-%d') as updated from shown join (select company_id, max(date) as d from rounds group by 1) using (company_id) order by d desc, slug",
}
