"""An ingest run: records of sources resolved against stored companies and investors, and merged table by table."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from capstrata.functions.text import company_name_key, investor_name_key
from capstrata.functions.values import round_half_up
from capstrata.functions.vocabulary import APPROVED
from capstrata.operators import merge, resolve, slugs
from capstrata.operators.versions import Versions
from capstrata.session import materialised, new_folder
from capstrata.sources.normalized import Source, chosen

#: The columns of stored tables that an ingest run works on.
COMPANIES = "company_id string, slug string, name string, domain string, website_url string, linkedin_url string, primary_sector string, one_liner string, description string, hq string, founded int, headcount int, industry array<string>, status string, stage string, total_raised_usd long, external_source string, external_id string, moderation_status string, created_at timestamp_ntz"
INVESTORS = "investor_id string, slug string, name string, type string, legal_name string, hq string, website_url string, linkedin_url string, domain string, description string, crd_number string, cik_number string, fund_count long, assets_usd long, founded_year int, external_source string, external_id string, moderation_status string, created_at timestamp_ntz"
ROUNDS = "company_id string, name string, date date, amount_usd long, external_source string, external_id string, moderation_status string"
PEOPLE = "company_id string, name string, role string, title string, since int, external_source string, external_id string, moderation_status string"
HOLDINGS = "company_id string, investor_id string, name string, type string, first_round string, rounds int, external_source string, external_id string, moderation_status string"
ACQUISITIONS = "company_id string, target string, date date, amount_usd long, rationale string, external_source string, external_id string, moderation_status string"
EXITS = "company_id string, type string, date date, value_usd long, detail string, external_source string, external_id string, moderation_status string"
REVISIONS = "entity_type string, entity_id string, field string, before string, after string, action string, actor string, actor_source string, created_at timestamp_ntz"


@dataclass
class Store:
    """The stored tables. A run returns a new store; the old one's rows are not touched."""

    companies: DataFrame
    investors: DataFrame
    rounds: DataFrame
    people: DataFrame
    holdings: DataFrame
    acquisitions: DataFrame
    exits: DataFrame
    revisions: DataFrame

    @classmethod
    def empty(cls, spark) -> Store:
        return cls(**{name: spark.createDataFrame([], schema) for name, schema in _SCHEMAS.items()})


#: What the partitions of each stored table follow from; children lie with their company.
TABLE_KEYS = {"companies": ["company_id"], "investors": ["investor_id"], "revisions": ["entity_id"]} | dict.fromkeys(("rounds", "people", "holdings", "acquisitions", "exits"), ["company_id"])
_SCHEMAS = {"companies": COMPANIES, "investors": INVESTORS, "rounds": ROUNDS, "people": PEOPLE, "holdings": HOLDINGS, "acquisitions": ACQUISITIONS, "exits": EXITS, "revisions": REVISIONS}


def _tables(spark: SparkSession, folder: str) -> dict[str, Versions]:
    return {name: Versions(spark, f"{folder}/{name}", TABLE_KEYS[name], schema) for name, schema in _SCHEMAS.items()}


def load(spark: SparkSession, folder: str) -> Store:
    """The store as it was saved last under a folder; an empty one where nothing was."""
    return Store(**{name: table.read() for name, table in _tables(spark, folder).items()})


def save(store: Store, folder: str) -> dict[str, set[int]]:
    """Writes those partitions of each table that a run has changed, and tells which: none after a run that changed nothing."""
    return {name: table.write(getattr(store, name)) for name, table in _tables(store.companies.sparkSession, folder).items()}


def _new_id(kind: str, source: Column, key: Column) -> Column:
    """Ids of new rows follow from where they came from, so that a repeated run gives the same ones."""
    return F.concat(F.lit(f"{kind}-"), F.substring(F.sha2(F.concat_ws(":", source, key), 256), 1, 24))


def merge_companies(store: Store, records: DataFrame, source: str, at: Column, log: bool = True) -> tuple[Store, DataFrame]:
    """(store with companies and revisions merged, records with company_id). records: seq, company_external_id, company."""
    index = resolve.match_index(store.companies, "company_id", company_name_key(F.col("name")))
    flat = records.select("seq", F.col("company_external_id").alias("external_id"), "company.*")
    keyed = flat.withColumns({"key": F.concat(F.lit(f"{source}:"), "external_id"), "name_key": F.nullif(company_name_key(F.col("name")), F.lit("")), "domain": F.nullif(F.col("domain"), F.lit(""))})
    found = materialised(resolve.resolve(keyed, index, register_matches=False))
    made = found.where("how = 'new'")
    ids = found.join(made.select(F.col("seq").alias("made_by"), F.col("external_id").alias("made_key")), F.concat(F.lit("new:"), F.col("made_by").cast("string")) == F.col("entity_id"), "left")
    ids = ids.withColumn("company_id", F.when(F.col("made_by").isNotNull(), _new_id("company", F.lit(source), F.col("made_key"))).otherwise(F.col("entity_id"))).drop("made_by", "made_key")
    ids = materialised(ids.withColumn("total_raised_usd", round_half_up(F.coalesce("total_raised_usd", F.lit(0.0)))).withColumn("hq", F.coalesce(F.nullif(F.col("hq"), F.lit("")), F.lit("Undisclosed"))))
    fresh = merge.new_companies(ids.where("how = 'new'").withColumn("founded", F.coalesce("founded", F.lit(0))))
    fresh = slugs.mint(fresh, store.companies.select("slug"), F.col("name"), F.col("seq"), F.col("external_id")).withColumns({"external_source": F.lit(source), "created_at": at})
    known = store.companies.select("company_id").join(ids.select("company_id").distinct(), "company_id", "left_semi")
    before = store.companies.join(known, "company_id", "left_semi")
    base = store.companies.unionByName(fresh.select(*store.companies.columns))
    own = merge.update_own(base, ids.where("how = 'key'"), "company_id", merge.COMPANY_OWN)
    after = materialised(merge.enrich_companies(own, ids.where("how in ('domain', 'name')")))
    fields = (*merge.COMPANY_OWN, *merge.COMPANY_BLANKS, "founded", "headcount", "one_liner", "description")
    out = replace(store, companies=after)
    if log:
        moved = merge.revisions(before, after, "company_id", fields, "company", F.lit(source), at)
        out = replace(out, revisions=materialised(store.revisions.unionByName(moved)))
    return out, records.join(ids.select("seq", "company_id"), "seq")


def _children(records: DataFrame, name: str, source: str) -> DataFrame:
    each = records.select("seq", "company_id", F.posexplode(name).alias("pos", "x")).select("seq", "pos", "company_id", "x.*")
    return each.withColumns({"external_source": F.lit(source), "moderation_status": F.lit(APPROVED)})


def merge_holdings(store: Store, records: DataFrame, source: str, at: Column) -> Store:
    """Holdings with their investors resolved or minted."""
    rows = materialised(_children(records, "investors", source).withColumn("__record", F.col("seq")).withColumn("seq", F.struct("seq", "pos")))
    index = resolve.match_index(store.investors, "investor_id", investor_name_key(F.col("name")))
    linked, minted = resolve.holding_investors(rows, index, source)
    minted = minted.withColumn("investor_id", _new_id("investor", F.lit(source), F.col("slug_suffix")))
    minted = materialised(slugs.mint(minted, store.investors.select("slug"), F.col("name"), F.col("investor_id"), F.col("slug_suffix")).withColumns({"moderation_status": F.lit(APPROVED), "created_at": at}))
    ids = linked.join(minted.select("investor_ref", "investor_id"), "investor_ref", "left").withColumn("investor_id", F.coalesce("investor_id", "investor_ref"))
    investors = store.investors.unionByName(minted.drop("investor_ref", "slug_suffix"), allowMissingColumns=True)
    return replace(store, investors=materialised(investors), holdings=materialised(merge.upsert_children("holding", store.holdings, ids.withColumn("seq", F.col("__record")), ["seq", "pos"])))


def merge_firms(store: Store, firms: DataFrame, source: str, at: Column) -> Store:
    """Investor firms: a source's own rows are overwritten, matches have their blanks filled, the rest are new."""
    index = resolve.match_index(store.investors, "investor_id", investor_name_key(F.col("name")))
    keyed = firms.withColumns({"key": F.concat(F.lit(f"{source}:"), "external_id"), "name_key": F.nullif(investor_name_key(F.col("name")), F.lit("")), "domain": F.nullif(F.col("domain"), F.lit(""))})
    found = materialised(resolve.resolve(keyed, index, register_matches=True))
    made = found.where("how = 'new'").select(F.col("entity_id"), _new_id("investor", F.lit(source), F.col("external_id")).alias("made_id"))
    ids = materialised(found.join(made, "entity_id", "left").withColumn("investor_id", F.coalesce("made_id", "entity_id")).drop("made_id"))
    fresh = slugs.mint(ids.where("how = 'new'"), store.investors.select("slug"), F.col("name"), F.col("seq"), F.col("external_id")).withColumns({"external_source": F.lit(source), "moderation_status": F.lit(APPROVED), "created_at": at})
    base = store.investors.unionByName(fresh.select(*[c for c in fresh.columns if c in store.investors.columns]), allowMissingColumns=True)
    own = merge.update_own(base, ids.where("how = 'key'"), "investor_id", ("name", "type", *merge.INVESTOR_FACTS))
    return replace(store, investors=materialised(merge.enrich_investors(own, ids.where("how in ('domain', 'name')"))))


def run(store: Store, records: DataFrame | None, firms: DataFrame | None, source: str, at: Column, log: bool = True) -> Store:
    """One source's records and firms merged into the store. Merging the same input again changes nothing but repeats no row."""
    if records is not None:
        store, named = merge_companies(store, records, source, at, log)
        named = materialised(named)
        if "round" in records.columns:
            placed = named.where("round is not null").select("seq", "company_id", "round.*").withColumns({"external_source": F.lit(source), "moderation_status": F.lit(APPROVED), "amount_usd": round_half_up(F.col("amount_usd"))})
            store = replace(store, rounds=materialised(merge.upsert_children("round", store.rounds, placed, ["seq"])))
        if "people" in records.columns:
            store = replace(store, people=materialised(merge.upsert_children("person", store.people, _children(named, "people", source), ["seq", "pos"])))
        if "investors" in records.columns:
            store = merge_holdings(store, named, source, at)
        if "acquisitions" in records.columns:
            rows = _children(named, "acquisitions", source).withColumn("amount_usd", round_half_up(F.col("amount_usd")))
            store = replace(store, acquisitions=materialised(merge.upsert_children("acquisition", store.acquisitions, rows, ["seq", "pos"])))
        if "exits" in records.columns:
            rows = _children(named, "exits", source).withColumn("value_usd", round_half_up(F.col("value_usd")))
            store = replace(store, exits=materialised(merge.upsert_children("exit", store.exits, rows, ["seq", "pos"])))
    if firms is not None:
        store = merge_firms(store, firms, source, at)
    return store


#: Amounts beyond this have no place in a column of whole dollars.
MOST_USD = 9_000_000_000_000_000_000


def judged(rows: DataFrame, key: str = "company_external_id", name: str = "company.name") -> DataFrame:
    """rows with `reject`: why a run can not take a row (no name, no key, an amount that is no amount), null where it can.

    A row that fails would fail the whole run, so what can fail is told before; each row costs itself only.
    """
    blank = lambda c: F.trim(F.coalesce(F.col(c), F.lit(""))) == ""
    wild = lambda c: F.coalesce(F.isnan(c.cast("double")) | (F.abs(c.cast("double")) > MOST_USD), F.lit(False))
    amounts = [F.col(c) for c in ("company.total_raised_usd", "round.amount_usd") if c.partition(".")[0] in rows.columns]
    bad = [wild(a) for a in amounts]
    any_wild = lambda c, field: F.exists(c, lambda x: wild(x[field]))
    bad += [any_wild(c, field) for c, field in (("acquisitions", "amount_usd"), ("exits", "value_usd")) if c in rows.columns]
    reason = F.when(blank(name), "no name").when(blank(key), "no key")
    for condition in bad:
        reason = reason.when(F.coalesce(condition, F.lit(False)), "no amount")
    return rows.withColumn("reject", reason)


def taken(rows: DataFrame | None, **columns: str) -> tuple[DataFrame | None, DataFrame | None, dict[str, int]]:
    """(rows that a run can take, the others as (key, reject), how many came and were taken). None gives none and zeros.

    The rows are written once, and counted as they pass.
    """
    if rows is None:
        return None, None, {"processed": 0, "taken": 0}
    spark, seen, path = rows.sparkSession, Observation(), new_folder(rows.sparkSession, "taken")
    said = judged(rows, **columns).observe(seen, F.count(F.lit(1)).alias("processed"), F.count_if(F.col("reject").isNull()).alias("taken"))
    said.write.parquet(path)
    held = spark.read.parquet(path)
    refused = held.where("reject is not null").select(F.col(columns.get("key", "company_external_id")).alias("key"), "reject")
    return held.where("reject is null").drop("reject"), refused, seen.get


def run_sources(spark: SparkSession, store: Store, sources: list[Source], folder: str, at: Column, names: list[str] | None = None, limit: int | None = None, log: bool = True, rejects: list[DataFrame] | None = None) -> tuple[Store, list[dict]]:
    """(store, counters of each source): the chosen sources (all without names) one after the other, each from its own folder in `folder`.

    `rejects` takes, for each source, the rows that were refused: source, key, reject.
    """
    told, before = [], (store.companies.count(), store.investors.count())
    for source in chosen(sources, names):
        records, no_records, n = taken(source.records(spark, f"{folder}/{source.name}", limit))
        firms, no_firms, m = taken(source.firms(spark, f"{folder}/{source.name}", limit), key="external_id", name="name")
        store = run(store, records, firms, source.name, at, log)
        if rejects is not None:
            rejects += [df.withColumn("source", F.lit(source.name)) for df in (no_records, no_firms) if df is not None]
        after = (store.companies.count(), store.investors.count())
        counted = {"processed": n["processed"], "upserted": n["taken"], "skipped": n["processed"] - n["taken"], "investors": m["taken"]}
        told.append({"source": source.name} | counted | {"new_companies": after[0] - before[0], "new_investors": after[1] - before[1]})
        before = after
    return store, told


def placeable(rows: DataFrame | None, name: str = "company.name") -> DataFrame | None:
    """The rows that a run can place: those with a name."""
    return None if rows is None else rows.where(F.trim(F.coalesce(F.col(name), F.lit(""))) != "")


def counters(before: Store, after: Store, records: DataFrame | None, firms: DataFrame | None) -> dict[str, int]:
    """Records processed, upserted and skipped for want of a name, firms upserted, and companies and investors that are new."""
    n, placed = (0 if df is None else df.count() for df in (records, placeable(records)))
    return {
        "processed": n,
        "upserted": placed,
        "skipped": n - placed,
        "investors": 0 if firms is None else placeable(firms, "name").count(),
        "new_companies": after.companies.count() - before.companies.count(),
        "new_investors": after.investors.count() - before.investors.count(),
    }
