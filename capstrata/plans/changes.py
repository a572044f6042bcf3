"""Queries of resolution, merges, proposals and citations, each with the SQL that checks it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from capstrata.functions import text, values
from capstrata.functions import vocabulary as v
from capstrata.operators import citations, merge, moderation, profile, resolve
from capstrata.operators.versions import Versions
from capstrata.plans import entities as e
from capstrata.plans.entities import MODEL_SQL
from capstrata.session import new_folder, read_table


def _events(s: SparkSession, sf: str) -> DataFrame:
    return read_table(s, sf, "events")


def first_wins(s: SparkSession, sf: str) -> DataFrame:
    """The first event of each user and type."""
    rows = _events(s, sf).select("user_id", "event_type", "event_id", "ts", "value")
    return merge.first(rows, ["user_id", "event_type"], ["ts", "event_id"])


def latest_filing(s: SparkSession, sf: str) -> DataFrame:
    return citations.latest_filing(e.rounds(s, sf))


def earliest_event(s: SparkSession, sf: str) -> DataFrame:
    return _events(s, sf).groupBy("user_id").agg(F.min(F.when(F.col("event_type") == "purchase", F.col("ts"))).alias("first_purchase"))


def exclusion_anti_join(s: SparkSession, sf: str) -> DataFrame:
    """Investors without those of barred classes and those named one by one."""
    served = read_table(s, sf, "lineitem").where("l_returnflag = 'R' and l_quantity >= 50").select(F.col("l_suppkey").alias("investor_id")).distinct()
    return e.investors(s, sf).where(~F.col("investor_id").isin(3, 5)).join(served, "investor_id", "left_anti").select("investor_id", "name")


def modal_type_backfill(s: SparkSession, sf: str) -> DataFrame:
    investors, _ = merge.investor_backfill(*_named_holdings(s, sf), ["Supplier#000000004"])
    return investors.select("name", "type", "slug")


def name_link(s: SparkSession, sf: str) -> DataFrame:
    _, linked = merge.investor_backfill(*_named_holdings(s, sf), ["Supplier#000000004"])
    return linked.select("holding_id", "name", "investor_slug")


def _named_holdings(s: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    lines = read_table(s, sf, "lineitem").join(read_table(s, sf, "supplier"), F.col("l_suppkey") == F.col("s_suppkey"))
    kinds = F.when(F.col("l_returnflag") == "A", "Angel").when(F.col("l_returnflag") == "N", "Growth").otherwise("Venture")
    rows = lines.select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("holding_id"), F.col("s_name").alias("name"), kinds.alias("type"), F.lit(None).cast("string").alias("investor_slug"))
    parts = read_table(s, sf, "part").select(F.col("p_name").alias("name"))
    return rows, parts


def link_by_name(s: SparkSession, sf: str) -> DataFrame:
    """Line items whose flag is R have lost their supplier, and know it by name only; every fifth name is nobody's."""
    lines = read_table(s, sf, "lineitem").join(read_table(s, sf, "supplier"), F.col("l_suppkey") == F.col("s_suppkey"))
    seq = F.col("l_orderkey") * 10 + F.col("l_linenumber")
    name = F.when(F.col("l_suppkey") % 5 == 0, F.concat(F.lit(" Nobody "), (F.col("l_suppkey") % 20).cast("string"))).otherwise(F.concat("s_name", F.lit(" ")))
    rows = lines.select(seq.alias("seq"), name.alias("name"), F.col("l_returnflag").alias("type"), F.when(F.col("l_returnflag") != "R", F.col("l_suppkey")).alias("investor_id"))
    linked, fresh = merge.link_by_name(rows, e.investors(s, sf))
    return linked.groupBy("investor_id").agg(F.count("*").alias("n"), F.min("seq").alias("first_seq")).join(fresh.select("investor_id", F.lit(True).alias("minted")), "investor_id", "left")


def _incoming(s: SparkSession, sf: str) -> DataFrame:
    """Records that match companies by key, by domain or by name, or not at all."""
    c = e.companies(s, sf)
    i = F.col("company_id")
    return c.select(
        i.alias("seq"),
        F.when(i % 4 == 0, F.concat_ws(":", "external_source", "external_id")).otherwise(F.concat(F.lit("NEW:"), F.floor(i / 3).cast("string"))).alias("key"),
        F.when(i % 5 == 0, F.concat(F.lit("c"), (i + 7).cast("string"), F.lit(".example.com"))).when(i % 5 == 1, F.concat(F.lit("new"), F.floor(i / 4).cast("string"), F.lit(".example"))).alias("domain"),
        text.company_name_key(F.when(i % 6 == 0, F.concat("name", F.lit(" Inc."))).otherwise(F.concat(F.lit("Fresh "), F.floor(i / 5).cast("string")))).alias("name_key"),
    )


def _index(s: SparkSession, sf: str) -> dict[str, DataFrame]:
    stored = e.companies(s, sf).withColumn("created_at", F.lit(0))
    return resolve.match_index(stored, "company_id", text.company_name_key(F.col("name")))


def multi_key_match(s: SparkSession, sf: str) -> DataFrame:
    return resolve.match(_incoming(s, sf), _index(s, sf)).select("seq", "matched_id", "matched_by")


def resolve_in_order(s: SparkSession, sf: str) -> DataFrame:
    return resolve.resolve(_incoming(s, sf), _index(s, sf), register_matches=False).select("seq", "entity_id", "how")


def contributed_investors(s: SparkSession, sf: str) -> DataFrame:
    firms = e.investors(s, sf).withColumn("created_at", F.col("investor_id") % 3)
    asked = read_table(s, sf, "customer").select(F.col("c_custkey").alias("seq"), F.when(F.col("c_custkey") % 2 == 0, F.upper(F.concat(F.lit(" supplier#"), F.lpad((F.col("c_custkey") % 150).cast("string"), 9, "0")))).otherwise(F.concat(F.lit("New Firm "), (F.col("c_custkey") % 40).cast("string"))).alias("name"))
    return resolve.contributed_investors(asked, firms)


def _stored_rounds(s: SparkSession, sf: str) -> DataFrame:
    return e.rounds(s, sf).where("name <> '1-URGENT'").select("company_id", "name", "date", "amount_usd", "moderation_status", "external_source", "external_id")


def _new_rounds(s: SparkSession, sf: str) -> DataFrame:
    """Orders of the two most urgent kinds, twice: a first filing and its amendment."""
    rows = e.rounds(s, sf).where("name in ('1-URGENT', '2-HIGH')").drop("moderation_status", "round_id")
    later = rows.withColumns({"amount_usd": F.col("amount_usd") + 1000, "date": F.col("date") + F.expr("interval 10 days"), "name": F.lit("amended")})
    return rows.withColumn("filed", F.lit(1)).unionByName(later.withColumn("filed", F.lit(2)))


def upsert_merge(s: SparkSession, sf: str) -> DataFrame:
    return merge.upsert_children("round", _stored_rounds(s, sf), _new_rounds(s, sf), ["filed"])


def upsert_merge_twice(s: SparkSession, sf: str) -> DataFrame:
    """Merging again changes nothing."""
    once = upsert_merge(s, sf)
    return merge.upsert_children("round", once, _new_rounds(s, sf), ["filed"])


def upsert_merge_versions(s: SparkSession, sf: str) -> DataFrame:
    """The same by partitions of a table on disk, merged twice: the second time writes none."""
    stored = _stored_rounds(s, sf)
    table = Versions(s, new_folder(s, "rounds"), merge.KEY, ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in stored.schema), parts=16)
    table.write(stored)
    for _ in range(2):
        table.merge(_new_rounds(s, sf), lambda old, new: merge.upsert_children("round", old, new, ["filed"]))
    return table.read()


def _enrich_target(s: SparkSession, sf: str) -> DataFrame:
    c = e.companies(s, sf)
    i = F.col("company_id")
    return c.select(
        "company_id", "name",
        F.when(i % 2 == 0, F.col("domain")).otherwise("").alias("domain"),
        F.when(i % 3 == 0, F.lit("https://own.example")).alias("website_url"),
        F.when(i % 5 != 0, F.col("sector")).alias("primary_sector"),
        F.when(i % 4 == 0, 0).otherwise(1990).alias("founded"),
        F.when(i % 3 == 1, F.lit(f"{v.ONE_LINER_PREFIX} via SEC Form D.")).otherwise(F.col("one_liner")).alias("one_liner"),
        F.when(i % 3 == 2, F.concat("name", F.lit(f" {v.DESCRIPTION_MARKER} notice."))).otherwise("own words").alias("description"),
        "total_raised_usd",
    )


def _facts(s: SparkSession, sf: str) -> DataFrame:
    o = read_table(s, sf, "orders")
    k = F.col("o_orderkey")
    return o.select(
        F.col("o_custkey").alias("company_id"), k.alias("seq"),
        F.when(k % 2 == 0, F.concat(F.lit("d"), k.cast("string"), F.lit(".example"))).alias("domain"),
        F.when(k % 3 == 0, F.concat(F.lit("https://w"), k.cast("string"), F.lit(".example"))).otherwise("").alias("website_url"),
        F.when(k % 4 == 0, F.lit("Energy")).alias("primary_sector"),
        F.when(k % 5 == 0, F.lit(0)).otherwise((k % 100 + 1900).cast("int")).alias("founded"),
        F.concat(F.lit("Line "), k.cast("string")).alias("one_liner"),
        F.when(k % 2 == 1, F.concat(F.lit("Text "), k.cast("string"))).alias("description"),
    )


def enrich_fill_blanks(s: SparkSession, sf: str) -> DataFrame:
    return merge.enrich_companies(_enrich_target(s, sf), _facts(s, sf))


_FIELDS = ("domain", "website_url", "primary_sector", "founded", "one_liner", "description")


def revision_diff(s: SparkSession, sf: str) -> DataFrame:
    before = _enrich_target(s, sf)
    after = merge.enrich_companies(before, _facts(s, sf))
    return merge.revisions(before, after, "company_id", _FIELDS, "company", F.lit(v.SEC_EDGAR), F.lit(None).cast("timestamp_ntz")).select("entity_id", "field", "before", "after", "actor_source")


def update_own_rows(s: SparkSession, sf: str) -> DataFrame:
    stored = e.companies(s, sf).select("company_id", "name", "stage", "total_raised_usd", "sector")
    filed = e.rounds(s, sf).select("company_id", F.col("round_id").alias("seq"), F.concat("name", F.lit(" filer")).alias("name"), values.stage_of_amount(F.col("amount_usd") * 100).alias("stage"), F.col("amount_usd").alias("total_raised_usd"))
    return merge.update_own(stored, filed, "company_id", merge.COMPANY_OWN)


def sector_backfill(s: SparkSession, sf: str) -> DataFrame:
    c = e.companies(s, sf)
    i = F.col("company_id")
    names = F.array(*[F.lit(x) for x in ("Agriculture", "Other", "Oil and Gas", "wind power retail", "nothing")])
    rows = c.select("company_id", "external_source", F.when(i % 4 == 0, F.col("sector")).alias("sector"), F.when(i % 7 == 0, F.array().cast("array<string>")).otherwise(F.array(F.get(names, (i % 5).cast("int")))).alias("industry"))
    return merge.backfill_sectors(rows, v.SEC_EDGAR).select("company_id", "sector")


def _proposals(s: SparkSession, sf: str) -> DataFrame:
    """Views propose names and stages, clear valuations, and repeat what is there."""
    ev = _events(s, sf).where("event_type = 'view' and user_id > 0")
    k = F.col("event_id")
    changes = F.map_from_entries(
        F.array(
            F.struct(F.lit("name").alias("k"), F.when(k % 2 == 0, F.concat(F.lit('"Name '), k.cast("string"), F.lit('"'))).alias("x")),
            F.struct(F.lit("last_valuation_usd").alias("k"), F.when(k % 3 == 0, "null").when(k % 3 == 1, (k * 1000).cast("string")).alias("x")),
            F.struct(F.lit("status").alias("k"), F.lit('"Private"').alias("x")),
            F.struct(F.lit("slug").alias("k"), F.lit('"x"').alias("x")),
        )
    )
    return ev.select(F.col("event_id").alias("proposal_id"), F.col("user_id").alias("company_id"), changes.alias("changes"), F.col("user_id").alias("submitted_by"), F.col("ts").alias("created_at"), F.when(k % 5 == 0, F.lit("https://proof.example")).alias("source_url"))


def proposal_diff(s: SparkSession, sf: str) -> DataFrame:
    kept = moderation.proposed(_proposals(s, sf), e.companies(s, sf))
    return kept.select("proposal_id", "company_id", F.array_join(F.array_sort(F.map_keys("changes")), ",").alias("fields"), "moderation_status")


def proposal_apply(s: SparkSession, sf: str) -> DataFrame:
    c = e.companies(s, sf)
    after, _, _ = moderation.apply_proposals(c, moderation.proposed(_proposals(s, sf), c), F.lit(1), F.lit(None).cast("timestamp_ntz"))
    return after.select("company_id", "name", "status", "last_valuation_usd")


def proposal_revisions(s: SparkSession, sf: str) -> DataFrame:
    c = e.companies(s, sf)
    _, log, _ = moderation.apply_proposals(c, moderation.proposed(_proposals(s, sf), c), F.lit(1), F.lit(None).cast("timestamp_ntz"))
    return log.select("proposal_id", "entity_id", "field", "before", "after")


def moderation_flip(s: SparkSession, sf: str) -> DataFrame:
    new, _ = moderation.decide(_rounds_for_review(s, sf), _decisions(s, sf), "round")
    return new.select("entity_id", "moderation_status")


def moderation_revisions(s: SparkSession, sf: str) -> DataFrame:
    _, log = moderation.decide(_rounds_for_review(s, sf), _decisions(s, sf), "round")
    return log.select("company_id", "entity_id", "action", "actor_user_id", F.get_json_object("after", "$.moderation_status").alias("status"))


def _rounds_for_review(s: SparkSession, sf: str) -> DataFrame:
    return e.rounds(s, sf).select(F.col("round_id").alias("entity_id"), "company_id", "name", "moderation_status")


def _decisions(s: SparkSession, sf: str) -> DataFrame:
    ev = _events(s, sf)
    return ev.select(F.when(F.col("event_id") % 10 == 0, "person").otherwise("round").alias("type"), (F.col("event_id") % 4000).alias("entity_id"), F.when(F.col("event_id") % 3 == 0, v.REJECTED).otherwise(v.APPROVED).alias("decision"), F.col("user_id").alias("admin_id"), (F.col("event_id")).alias("decided_at"))


def publish_linked_firms(s: SparkSession, sf: str) -> DataFrame:
    decided = _events(s, sf).select(F.lit("investor").alias("type"), (F.col("event_id") * 1_000_000_000 + F.col("user_id")).alias("entity_id"), F.when(F.col("event_id") % 4 == 0, v.REJECTED).otherwise(v.APPROVED).alias("decision"))
    rows = decided.select("entity_id").distinct().withColumn("investor_id", F.floor(F.col("entity_id") / 1_000_000_000) % 150)
    return moderation.publish_linked_firms(e.investors(s, sf), rows, decided).select("investor_id", "moderation_status")


def citation_attach(s: SparkSession, sf: str) -> DataFrame:
    _, cited = _attached(s, sf)
    return cited.select("url", "entity_type", "entity_id", "field", "submitted_by")


def citation_sources(s: SparkSession, sf: str) -> DataFrame:
    sources, _ = _attached(s, sf)
    return sources.select("url", "source_type")


def _attached(s: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    pages = read_table(s, sf, "pages").where("url like 'https:%'").select("url", F.lit("Press").alias("source_type"), F.lit(None).cast("timestamp_ntz").alias("retrieved_at"))
    have = read_table(s, sf, "pages").where("url like 'https:%/de/%'").select("url", F.lit("company").alias("entity_type"), (F.col("page_id") % 50).cast("string").alias("entity_id"), F.lit("").alias("field"), F.lit(0).cast("long").alias("submitted_by"), F.lit(None).cast("timestamp_ntz").alias("created_at"))
    ev = _events(s, sf).select((F.col("event_id") % 250).alias("page_id"), "user_id", "ts")
    asked = ev.join(read_table(s, sf, "pages"), "page_id").select("url", F.lit("company").alias("entity_type"), (F.col("page_id") % 50).cast("string").alias("entity_id"), F.lit("").alias("field"), F.col("user_id").alias("submitted_by"), F.col("ts").alias("at"))
    return moderation.attach_citations(pages, have, asked)


def _with_times(df: DataFrame) -> DataFrame:
    return df.withColumn("updated_at", F.lit(None).cast("timestamp_ntz"))


def citation_targets(s: SparkSession, sf: str) -> DataFrame:
    c, r = _with_times(e.companies(s, sf)), _with_times(e.rounds(s, sf))
    held = _with_times(e.holdings(s, sf)).select(F.col("holding_id").alias("entity_id"), "company_id", F.lit(v.WIKIDATA).alias("external_source"), F.lit("x").alias("external_id"), "updated_at")
    people = _with_times(c).select(F.col("company_id").alias("person_id"), "company_id", "external_source", "external_id", "updated_at")
    parts = [citations.company_targets(c), citations.round_targets(r, c), citations.person_targets(people, c, r), citations.child_targets("investor", held, c)]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.select("entity_type", "entity_id", "url", "title", "reference")


def citation_resolve(s: SparkSession, sf: str) -> DataFrame:
    ev = _events(s, sf)
    rows = ev.select(F.col("event_id").alias("citation_id"), F.col("user_id").alias("entity_id"), F.when(F.col("event_type") == "purchase", "").when(F.col("user_id") % 2 == 0, "stage").otherwise("name").alias("field"), F.col("ts").alias("created_at"))
    return profile.field_citations(rows, "stage").select("citation_id", "entity_id", "field", F.col("rank").cast("long").alias("rank"))


def citation_list(s: SparkSession, sf: str) -> DataFrame:
    ev = _events(s, sf)
    cited = ev.select(F.col("event_id").alias("citation_id"), F.col("user_id").alias("entity_id"), (F.col("event_id") % 250).alias("source_id"), F.col("ts").alias("created_at"))
    sources = read_table(s, sf, "pages").select(F.col("page_id").alias("source_id"), "url", F.lit("Press").alias("source_type"), F.lit(None).cast("string").alias("publisher"), F.lit(None).cast("string").alias("title"))
    shown = e.users(s, sf).where("role = 'ADMIN'").select(F.col("user_id").alias("entity_id"))
    return profile.shown_citations(cited, sources, shown).select("citation_id", "entity_id", F.col("source.url").alias("url"), "created_at")


def json_diff_explode(s: SparkSession, sf: str) -> DataFrame:
    ev = _events(s, sf)
    each = ev.select("event_id", F.explode(F.from_json("props", "map<string,string>")).alias("field", "after"))
    return each.select("event_id", "field", "after", values.shown_value(F.col("after"), F.col("field"), ("k",)).alias("shown"))


def _sql_case(pairs: list[tuple[str, str | None]]) -> str:
    return "case " + " ".join(f"when industry = '{a}' then '{b}'" for a, b in pairs if b) + " end"


QUERIES = {
    f.__name__: f
    for f in (
        first_wins, latest_filing, earliest_event, exclusion_anti_join, modal_type_backfill, name_link, link_by_name, multi_key_match, resolve_in_order, contributed_investors, upsert_merge,
        upsert_merge_twice, upsert_merge_versions, enrich_fill_blanks, revision_diff, update_own_rows, sector_backfill, proposal_diff, proposal_apply, proposal_revisions, moderation_flip, moderation_revisions,
        publish_linked_firms, citation_attach, citation_sources, citation_targets, citation_resolve, citation_list, json_diff_explode,
    )
}

_BACKFILL = """with h as (select l_orderkey * 10 + l_linenumber as holding_id, s_name as name, case l_returnflag when 'A' then 'Angel' when 'N' then 'Growth' else 'Venture' end as type from lineitem join supplier on l_suppkey = s_suppkey where s_name <> 'Supplier#000000004'),
  t as (select name, type, count(*) as n from (select name, type from h union all select p_name, 'Venture' from part) group by all),
  m as (select name, type from (select *, row_number() over (partition by name order by n desc, type) as k from t) where k = 1),
  b as (select *, trim(regexp_replace(lower(name), '[^a-z0-9]+', '-', 'g'), '-') as base from m),
  i as (select name, type, case when n = 1 then base else base || '-' || n end as slug from (select *, row_number() over (partition by base order by name) as n from b where base <> ''))
"""
_MATCH = (
    MODEL_SQL
    + """, inc as (select company_id as seq, case when company_id % 4 = 0 then concat_ws(':', external_source, external_id) else 'NEW:' || (company_id // 3) end as key,
  case when company_id % 5 = 0 then 'c' || (company_id + 7) || '.example.com' when company_id % 5 = 1 then 'new' || (company_id // 4) || '.example' end as domain,
  regexp_replace(lower(case when company_id % 6 = 0 then name || ' Inc.' else 'Fresh ' || (company_id // 5) end), '[^a-z0-9 ]+', '', 'g') as nk0 from companies),
  incoming as (select seq, key, domain, regexp_replace(nk0, '( (inc))+$', '') as name_key from inc),
  ik as (select external_source || ':' || external_id as key, min(company_id) as id from companies where external_id is not null group by 1), idm as (select domain, min(company_id) as id from companies group by 1),
  inm as (select regexp_replace(lower(name), '[^a-z0-9 ]+', '', 'g') as name_key, min(company_id) as id from companies group by 1),
  matched as (select seq, incoming.key, incoming.domain, incoming.name_key, coalesce(ik.id, idm.id, inm.id) as matched_id, case when ik.id is not null then 'key' when idm.id is not null then 'domain' when inm.id is not null then 'name' end as matched_by
    from incoming left join ik using (key) left join idm using (domain) left join inm using (name_key))
"""
)
_UPSERT = (
    MODEL_SQL
    + """, stored as (select company_id, name, date, amount_usd, moderation_status, external_source, external_id from rounds where name <> '1-URGENT'),
  fresh as (select company_id, name, date + interval 10 day as date, amount_usd + 1000 as amount_usd, external_source, external_id from rounds where name in ('1-URGENT', '2-HIGH'))
  select coalesce(s.company_id, f.company_id) as company_id, case when s.external_id is null then 'amended' else s.name end as name, coalesce(f.date, s.date) as date, coalesce(f.amount_usd, s.amount_usd) as amount_usd,
    case when s.external_id is null then 'APPROVED' else s.moderation_status end as moderation_status, external_source, external_id from stored s full join fresh f using (external_source, external_id)"""
)
_ENRICH = (
    MODEL_SQL
    + f""", target as (select company_id, name, case when company_id % 2 = 0 then domain else '' end as domain, case when company_id % 3 = 0 then 'https://own.example' end as website_url, case when company_id % 5 <> 0 then sector end as primary_sector,
    case when company_id % 4 = 0 then 0 else 1990 end as founded, case when company_id % 3 = 1 then '{v.ONE_LINER_PREFIX} via SEC Form D.' else one_liner end as one_liner, case when company_id % 3 = 2 then name || ' {v.DESCRIPTION_MARKER} notice.' else 'own words' end as description, total_raised_usd from companies),
  k as (select o_custkey as company_id, o_orderkey as k from orders),
  f as (select company_id, 'd' || min(k) filter (k % 2 = 0) || '.example' as domain, 'https://w' || min(k) filter (k % 3 = 0) || '.example' as website_url, max(case when k % 4 = 0 then 'Energy' end) as primary_sector,
    cast(min(k) filter (k % 5 <> 0) % 100 + 1900 as integer) as founded, 'Line ' || min(k) as one_liner, 'Text ' || min(k) filter (k % 2 = 1) as description from k group by 1),
  enriched as (select t.company_id, t.name, case when t.domain = '' and f.domain is not null then f.domain else t.domain end as domain, coalesce(t.website_url, f.website_url) as website_url, coalesce(t.primary_sector, f.primary_sector) as primary_sector,
    case when t.founded = 0 and f.founded is not null then f.founded else t.founded end as founded, case when f.one_liner is not null and starts_with(t.one_liner, '{v.ONE_LINER_PREFIX}') then f.one_liner else t.one_liner end as one_liner,
    case when f.description is not null and contains(t.description, '{v.DESCRIPTION_MARKER}') then f.description else t.description end as description, t.total_raised_usd from target t left join f using (company_id))
"""
)
_PROPOSED = (
    MODEL_SQL
    + """, p0 as (select event_id as proposal_id, user_id as company_id, ts as created_at, case when event_id % 2 = 0 then 'Name ' || event_id end as new_name, event_id % 3 as m, event_id * 1000 as new_value from events where event_type = 'view' and user_id > 0),
  p as (select p0.*, c.name as old_name, c.status as old_status, c.last_valuation_usd as old_value,
      new_name is not null as f_name, case m when 0 then old_value is not null when 1 then old_value is distinct from new_value else false end as f_value, c.status <> 'Private' as f_status from p0 join companies c using (company_id)),
  kept as (select * from p where f_name or f_value or f_status),
  each as (select proposal_id, company_id, created_at, 'name' as field, to_json(old_name) as before, to_json(new_name) as after from kept where f_name
    union all select proposal_id, company_id, created_at, 'last_valuation_usd', coalesce(cast(old_value as varchar), 'null'), case when m = 0 then 'null' else cast(new_value as varchar) end from kept where f_value
    union all select proposal_id, company_id, created_at, 'status', to_json(old_status), '"Private"' from kept where f_status)
"""
)
_DECIDED = ", d as (select event_id % 4000 as entity_id, case when event_id % 3 = 0 then 'REJECTED' else 'APPROVED' end as decision, user_id as admin_id from events where event_id % 10 <> 0 qualify row_number() over (partition by event_id % 4000 order by event_id desc) = 1)"
_ASKED = """with asked as (select url, cast(page_id % 50 as varchar) as entity_id, user_id, ts from (select event_id % 250 as page_id, user_id, ts from events) join pages using (page_id)),
  have as (select url, cast(page_id % 50 as varchar) as entity_id from pages where url like 'https:%/de/%')"""

SQL = {
    "first_wins": "select user_id, event_type, event_id, ts, value from events qualify row_number() over (partition by user_id, event_type order by ts, event_id) = 1",
    "latest_filing": "select o_custkey as company_id, 'acc-' || o_orderkey as accession from orders qualify row_number() over (partition by o_custkey order by o_orderdate desc, 'acc-' || o_orderkey desc) = 1",
    "earliest_event": "select user_id, min(ts) filter (event_type = 'purchase') as first_purchase from events group by user_id",
    "exclusion_anti_join": "select s_suppkey as investor_id, s_name as name from supplier where s_suppkey not in (3, 5) and not exists (select 1 from lineitem where l_suppkey = s_suppkey and l_returnflag = 'R' and l_quantity >= 50)",
    "modal_type_backfill": _BACKFILL + "select name, type, slug from i",
    "name_link": _BACKFILL + "select holding_id, name, slug as investor_slug from h left join i using (name)",
    "link_by_name": """with r as (select l_orderkey * 10 + l_linenumber as seq, case when l_returnflag <> 'R' then cast(l_suppkey as varchar) when l_suppkey % 5 = 0 then 'named:Nobody ' || (l_suppkey % 20) else cast(l_suppkey as varchar) end as investor_id from lineitem)
      select investor_id, count(*) as n, min(seq) as first_seq, case when starts_with(investor_id, 'named:') then true end as minted from r group by investor_id""",
    "multi_key_match": _MATCH + "select seq, matched_id, matched_by from matched",
    "contributed_investors": MODEL_SQL
    + """, asked as (select c_custkey as seq, case when c_custkey % 2 = 0 then upper(' supplier#' || lpad(cast(c_custkey % 150 as varchar), 9, '0')) else 'New Firm ' || (c_custkey % 40) end as name from customer),
      f as (select lower(name) as k, investor_id from investors qualify row_number() over (partition by lower(name) order by investor_id % 3, investor_id) = 1)
      select seq, name, investor_id, case when investor_id is null then min(seq) over (partition by lower(trim(name))) end as minted_by from asked left join f on f.k = lower(trim(asked.name))""",
    "upsert_merge": _UPSERT,
    "upsert_merge_twice": _UPSERT,
    "upsert_merge_versions": _UPSERT,
    "enrich_fill_blanks": _ENRICH + "select * from enriched",
    "revision_diff": _ENRICH
    + " union all ".join(
        f"select company_id as entity_id, '{f}' as field, coalesce(cast(to_json(t.{f}) as varchar), 'null') as before, coalesce(cast(to_json(e.{f}) as varchar), 'null') as after, 'SEC_EDGAR' as actor_source from target t join enriched e using (company_id) where t.{f} is distinct from e.{f}" for f in _FIELDS
    ),
    "update_own_rows": MODEL_SQL
    + """, f as (select company_id, name || ' filer' as name, case when amount_usd < 50000 then 'Seed' when amount_usd < 200000 then 'Series A' when amount_usd < 600000 then 'Series B' when amount_usd < 1500000 then 'Series C' when amount_usd < 4000000 then 'Series D' else 'Late stage' end as stage, amount_usd from rounds qualify row_number() over (partition by company_id order by round_id desc) = 1)
      select company_id, coalesce(f.name, c.name) as name, coalesce(f.stage, c.stage) as stage, coalesce(f.amount_usd, c.total_raised_usd) as total_raised_usd, c.sector from companies c left join f using (company_id)""",
    "sector_backfill": MODEL_SQL
    + """, x as (select *, case when company_id % 7 <> 0 then list_extract(['Agriculture', 'Other', 'Oil and Gas', 'wind power retail', 'nothing'], 1 + company_id % 5) end as industry from companies)
      select company_id, case when company_id % 4 = 0 then sector when industry is null then null when external_source = 'SEC_EDGAR' then case industry when 'Agriculture' then 'Industrials' when 'Oil and Gas' then 'Energy' end
        when industry = 'Agriculture' then 'Industrials' when industry = 'Oil and Gas' then 'Energy' when industry = 'wind power retail' then 'Climate' end as sector from x""",
    "proposal_diff": _PROPOSED + "select proposal_id, company_id, string_agg(field, ',' order by field) as fields, 'PENDING' as moderation_status from each group by all",
    "proposal_apply": _PROPOSED
    + """, last as (select company_id, field, after from each qualify row_number() over (partition by company_id, field order by created_at desc, proposal_id desc) = 1)
      select company_id, coalesce((select replace(after, '"', '') from last l where l.company_id = c.company_id and field = 'name'), name) as name, coalesce((select replace(after, '"', '') from last l where l.company_id = c.company_id and field = 'status'), status) as status,
        case when exists (select 1 from last l where l.company_id = c.company_id and field = 'last_valuation_usd') then (select try_cast(nullif(after, 'null') as bigint) from last l where l.company_id = c.company_id and field = 'last_valuation_usd') else last_valuation_usd end as last_valuation_usd from companies c""",
    "proposal_revisions": _PROPOSED + "select proposal_id, cast(company_id as varchar) as entity_id, field, cast(coalesce(lag(after) over (partition by company_id, field order by created_at, proposal_id), before) as varchar) as before, cast(after as varchar) as after from each",
    "resolve_in_order": _MATCH
    + """, r as (select *, row_number() over (order by seq) as n from incoming), walk(n, k, d, m, seq, entity_id, how) as materialized (
      with recursive walk(n, k, d, m, seq, entity_id, how) as (
        select 0::bigint, map([]::varchar[], []::varchar[]), map([]::varchar[], []::varchar[]), map([]::varchar[], []::varchar[]), null::bigint, null::varchar, null::varchar
        union all
        select n, case when how = 'new' and key is not null then map_concat(k, map([key], [entity_id])) else k end,
          case when how = 'new' and domain is not null and d[domain] is null then map_concat(d, map([domain], [entity_id])) else d end,
          case when how = 'new' and nullif(name_key, '') is not null and m[name_key] is null then map_concat(m, map([name_key], [entity_id])) else m end, seq, entity_id, how
        from (select *, case when hk is not null then 'key' when hd is not null then 'domain' when hn is not null then 'name' else 'new' end as how, coalesce(hk, hd, hn, 'new:' || seq) as entity_id
          from (select r.n, w.k, w.d, w.m, r.seq, r.key, r.domain, r.name_key, coalesce(cast(ik.id as varchar), w.k[r.key]) as hk, coalesce(cast(idm.id as varchar), w.d[r.domain]) as hd, coalesce(cast(inm.id as varchar), w.m[r.name_key]) as hn
            from walk w join r on r.n = w.n + 1 left join ik using (key) left join idm using (domain) left join inm using (name_key))))
      select * from walk)
      select seq, entity_id, how from walk where n > 0""",
    "moderation_flip": MODEL_SQL + _DECIDED + " select round_id as entity_id, coalesce(decision, moderation_status) as moderation_status from rounds left join d on entity_id = round_id",
    "moderation_revisions": MODEL_SQL + _DECIDED + " select cast(company_id as varchar) as company_id, cast(round_id as varchar) as entity_id, 'CREATE' as action, admin_id as actor_user_id, decision as status from rounds join d on entity_id = round_id where decision = 'APPROVED'",
    "publish_linked_firms": MODEL_SQL + "select investor_id, case when moderation_status = 'PENDING' and investor_id in (select event_id % 150 from events where event_id % 4 <> 0) then 'APPROVED' else moderation_status end as moderation_status from investors",
    "citation_attach": _ASKED
    + """select url, 'company' as entity_type, entity_id, '' as field, 0 as submitted_by from have union all
      select url, 'company', entity_id, '', arg_min(user_id, ts) from asked anti join have using (url, entity_id) group by url, entity_id""",
    "citation_sources": _ASKED + "select url, 'Press' as source_type from pages where url like 'https:%' union all select distinct url, 'Other' from asked where url not in (select url from pages where url like 'https:%')",
    "citation_targets": MODEL_SQL
    + """, l as (select company_id, 'acc-' || round_id as a from rounds qualify row_number() over (partition by company_id order by date desc, 'acc-' || round_id desc) = 1), w as (select *, 'https://www.wikidata.org/wiki/' || external_id as url, 'Wikidata entity ' || external_id as title from companies where external_source = 'WIKIDATA'),
      s as (select *, 'https://www.sec.gov/cgi-bin/browse-edgar?action=getcompany&CIK=' || external_id || '&type=D' as url, 'SEC EDGAR Form D filings (CIK ' || external_id || ')' as title from companies where external_source = 'SEC_EDGAR')
      select 'company' as entity_type, cast(company_id as varchar) as entity_id, url, title, external_id as reference from s union all select 'company', cast(company_id as varchar), url, title, external_id from w
      union all select 'round', cast(r.round_id as varchar), 'https://www.sec.gov/Archives/edgar/data/' || s.external_id || '/acc' || r.round_id || '/primary_doc.xml', 'SEC Form D filing ' || r.external_id, r.external_id from rounds r join s using (company_id)
      union all select 'person', cast(company_id as varchar), url, title, external_id from w
      union all select 'person', cast(company_id as varchar), case when a is null then url else 'https://www.sec.gov/Archives/edgar/data/' || external_id || '/' || replace(a, '-', '') || '/primary_doc.xml' end, case when a is null then title else 'SEC Form D filing ' || a end, coalesce(a, external_id) from s left join l using (company_id)
      union all select 'investor', cast(holding_id as varchar), url, title, external_id from holdings join w using (company_id)""",
    "citation_resolve": """with r as (select event_id as citation_id, user_id as entity_id, case when event_type = 'purchase' then '' when user_id % 2 = 0 then 'stage' else 'name' end as field, ts from events)
      select citation_id, entity_id, field, rank from (select *, row_number() over (partition by entity_id order by ts, citation_id) as rank from (select *, max(field = 'stage') over (partition by entity_id) as has from r where field in ('stage', '')) where has = (field = 'stage')) where rank <= 3""",
    "citation_list": "select event_id as citation_id, user_id as entity_id, url, ts as created_at from events join pages on page_id = event_id % 250 where user_id % 25 = 0",
    "json_diff_explode": """select event_id, 'k' as field, json_extract_string(props, '$.k') as after, case when x < 1000 then '$' || x else '$' || (t // 10) || case when t % 10 = 0 then '' else '.' || (t % 10) end || 'K' end as shown
      from (select *, cast(json_extract_string(props, '$.k') as bigint) as x, cast(floor(cast(json_extract_string(props, '$.k') as bigint) / 1000 * 10 + 0.5) as bigint) as t from events)""",
}
