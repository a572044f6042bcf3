"""Idempotent merges of incoming rows into stored ones, with a log of what moved.

Stored tables are never updated in place: a merge joins the stored and the incoming rows by key and returns the new
table. versions.py keeps tables as versions of partitions, of which a merge reads and writes only those it touches.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from capstrata.functions.values import json_value
from capstrata.functions.vocabulary import APPROVED, DESCRIPTION_MARKER, ONE_LINER_PREFIX, UNDISCLOSED

KEY = ["external_source", "external_id"]
COMPANY_OWN = ("name", "hq", "industry", "stage", "total_raised_usd")
COMPANY_BLANKS = ("domain", "website_url", "linkedin_url", "primary_sector")
INVESTOR_FACTS = ("legal_name", "hq", "website_url", "linkedin_url", "domain", "description", "crd_number", "cik_number", "fund_count", "assets_usd", "founded_year")
#: For each kind of child: the columns that a repeated key updates.
CHILD_UPDATES = {
    "round": ("amount_usd", "date"),
    "person": ("role", "title"),
    "holding": ("investor_id", "type", "first_round", "rounds"),
    "acquisition": ("date", "amount_usd", "rationale"),
    "exit": ("type", "date", "value_usd", "detail"),
}


def latest(rows: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """One row for each key: the last in order. Reduced before the shuffle, whole rows at a time."""
    rest = [c for c in rows.columns if c not in key]
    last = rows.groupBy(*key).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("r"))
    return last.select(*key, "r.*")


def first(rows: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """One row for each key: the first in order."""
    rest = [c for c in rows.columns if c not in key]
    found = rows.groupBy(*key).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("r"))
    return found.select(*key, "r.*")


def upsert(stored: DataFrame, incoming: DataFrame, updates: tuple[str, ...], order: list[str], key: list[str] = KEY) -> DataFrame:
    """stored with incoming merged by key: a new key is inserted, a known one takes the named columns only.

    Of several incoming rows the last in order wins. Merging twice gives what merging once gives. A row without a
    whole key is never merged: incoming ones are dropped, stored ones stay.
    """
    whole = " and ".join(f"{k} is not null" for k in key)
    new = latest(incoming.where(whole), key, order)
    fresh = [c for c in new.columns if c not in key]
    renamed = new.select(*key, *[F.col(c).alias(f"__{c}") for c in fresh], F.lit(True).alias("__in"))
    both = stored.withColumn("__old", F.lit(True)).join(renamed, key, "full")
    columns = []
    for c in stored.columns:
        if c in key:
            columns.append(F.col(c))
        elif c not in fresh:
            default = F.lit(APPROVED) if c == "moderation_status" else F.lit(None)
            columns.append(F.when(F.col("__old").isNull(), default.cast(stored.schema[c].dataType)).otherwise(F.col(c)).alias(c))
        elif c in updates:
            columns.append(F.when(F.col("__in"), F.col(f"__{c}")).otherwise(F.col(c)).cast(stored.schema[c].dataType).alias(c))
        else:
            columns.append(F.when(F.col("__old").isNull(), F.col(f"__{c}")).otherwise(F.col(c)).cast(stored.schema[c].dataType).alias(c))
    return both.select(*columns)


def upsert_children(kind: str, stored: DataFrame, incoming: DataFrame, order: list[str]) -> DataFrame:
    return upsert(stored, incoming, CHILD_UPDATES[kind], order)


def _blank(c: Column, kind: str) -> Column:
    return c.isNull() | (c == "") if kind == "string" else c.isNull()


def enrich_companies(stored: DataFrame, incoming: DataFrame) -> DataFrame:
    """stored with its blanks filled from incoming (company_id, seq, facts): for each field the first that knows it.

    Sector and links fill blanks, founding year and headcount fill 0, and the one-liner and description are replaced
    only where they are the placeholder. Name, stage, status, raised totals and keys never change.
    """
    picked = [f for f in (*COMPANY_BLANKS, "founded", "headcount", "one_liner", "description") if f in incoming.columns]
    of = []
    for f in picked:
        known = F.col(f).isNotNull() & (F.col(f) != (0 if f in ("founded", "headcount") else ""))
        of.append(F.min_by(F.when(known, F.col(f)), F.when(known, F.col("seq"))).alias(f"__{f}"))
    facts = incoming.groupBy("company_id").agg(*of)
    out = stored.join(facts, "company_id", "left")
    for f in picked:
        new, old = F.col(f"__{f}"), F.col(f)
        if f in ("founded", "headcount"):
            open_ = old == 0
        elif f == "one_liner":
            open_ = old.startswith(ONE_LINER_PREFIX)
        elif f == "description":
            open_ = old.contains(DESCRIPTION_MARKER)
        else:
            open_ = _blank(old, "string")
        out = out.withColumn(f, F.when(new.isNotNull() & F.coalesce(open_, F.lit(False)), new).otherwise(old).cast(stored.schema[f].dataType))
    return out.select(*stored.columns)


def enrich_investors(stored: DataFrame, incoming: DataFrame) -> DataFrame:
    """stored investors with null facts filled from incoming (investor_id, seq, facts): for each the first that knows it."""
    picked = [f for f in INVESTOR_FACTS if f in incoming.columns and f in stored.columns]
    facts = incoming.groupBy("investor_id").agg(*[F.min_by(f, F.when(F.col(f).isNotNull(), F.col("seq"))).alias(f"__{f}") for f in picked])
    out = stored.join(facts, "investor_id", "left")
    return out.select(*[F.coalesce(F.col(c), F.col(f"__{c}")).cast(stored.schema[c].dataType).alias(c) if c in picked else F.col(c) for c in stored.columns])


def update_own(stored: DataFrame, incoming: DataFrame, id_column: str, fields: tuple[str, ...]) -> DataFrame:
    """stored rows that a source owns, with the source's figures: the last row by seq of each id."""
    own = [f for f in fields if f in incoming.columns and f in stored.columns]
    last = incoming.groupBy(id_column).agg(F.max_by(F.struct(*own), "seq").alias("__new"))
    out = stored.join(last, id_column, "left")
    return out.select(*[F.when(F.col("__new").isNotNull(), F.col(f"__new.{c}")).otherwise(F.col(c)).cast(stored.schema[c].dataType).alias(c) if c in own else F.col(c) for c in stored.columns])


def new_companies(records: DataFrame) -> DataFrame:
    """Company rows of records that matched nothing, with the defaults of what they leave open."""
    text = lambda c, default: F.coalesce(F.nullif(F.col(c), F.lit("")), default)
    return records.withColumns(
        {
            "domain": F.coalesce("domain", F.lit("")),
            "one_liner": text("one_liner", F.lit(f"{ONE_LINER_PREFIX} via SEC Form D.")),
            "description": text("description", F.concat("name", F.lit(f" {DESCRIPTION_MARKER} notice of exempt offering with the SEC."))),
            "hq": text("hq", F.lit(UNDISCLOSED)),
            "headcount": F.coalesce("headcount", F.lit(0)),
            "status": F.coalesce("status", F.lit("Private")),
            "moderation_status": F.lit(APPROVED),
        }
    )


def revisions(before: DataFrame, after: DataFrame, key: str, fields: tuple[str, ...], kind: str, source: Column, at: Column) -> DataFrame:
    """UPDATE revisions, one for each field of each key whose value moved; values as JSON, the JSON null for null.

    Rows that only one side has are not changes.
    """

    def shown(prefix: str, f: str) -> Column:
        return json_value(F.col(f"{prefix}_{f}"), after.schema[f].dataType.typeName())

    old = before.select(key, *[F.col(f).alias(f"b_{f}") for f in fields])
    new = after.select(key, *[F.col(f).alias(f"a_{f}") for f in fields])
    moved = [F.when(~F.col(f"b_{f}").eqNullSafe(F.col(f"a_{f}")), F.struct(F.lit(f).alias("field"), shown("b", f).alias("before"), shown("a", f).alias("after"))) for f in fields]
    each = old.join(new, key).select(key, F.explode(F.array_compact(F.array(*moved))).alias("m"))
    return each.select(
        F.lit(kind).alias("entity_type"), F.col(key).alias("entity_id"), F.col("m.field").alias("field"), F.col("m.before").alias("before"), F.col("m.after").alias("after"),
        F.lit("UPDATE").alias("action"), F.lit("INGEST").alias("actor"), source.alias("actor_source"), at.alias("created_at"),
    )


def write_version(df: DataFrame, folder: str, version: str) -> str:
    """Writes a table as a new version beside the others and returns its path. Readers move to it when it is whole."""
    path = f"{folder.rstrip('/')}/{version}"
    df.write.mode("errorifexists").parquet(path)
    return path


def backfill_sectors(companies: DataFrame, own_source: str) -> DataFrame:
    """companies with unknown sectors derived from their industries: by table for one source, by words for the others."""
    from capstrata.functions.text import sector_of_industry, sector_of_text

    found = F.when(F.col("external_source") == own_source, sector_of_industry(F.try_element_at("industry", F.lit(1)))).otherwise(sector_of_text(F.array_join("industry", " ")))
    return companies.withColumn("sector", F.when(F.col("sector").isNull() & (F.size("industry") > 0), found).otherwise(F.col("sector")))


def investor_backfill(holdings: DataFrame, round_investors: DataFrame, excluded: list[str]) -> tuple[DataFrame, DataFrame]:
    """(investors, holdings linked to them): one investor for each distinct name, with its most frequent type and a slug.

    Types tie by the smallest. Round investors vote Venture. Slugs are numbered by name within a base.
    """
    from capstrata.functions.text import kebab
    from capstrata.operators.slugs import numbered

    kept = holdings.where(~F.coalesce(F.col("name").isin(*excluded), F.lit(False)))
    votes = kept.select("name", "type").unionByName(round_investors.select("name", F.lit("Venture").alias("type"))).where("trim(name) <> ''")
    counted = votes.groupBy("name", "type").agg(F.count("*").alias("n"))
    types = counted.groupBy("name").agg(F.max_by("type", F.struct("n", F.expr("-n").alias("m"))).alias("any"), F.min_by("type", F.struct((-F.col("n")).alias("n"), "type")).alias("type")).drop("any")
    named = types.withColumn("base", kebab(F.col("name"), "")).where("base <> ''")
    investors = numbered(named).withColumn("moderation_status", F.lit(APPROVED))
    linked = kept.drop("investor_slug").join(investors.select("name", F.col("slug").alias("investor_slug")), "name", "left")
    return investors, linked


def link_by_name(rows: DataFrame, investors: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows with investor_id filled where it was null, investors to mint): by trimmed exact name.

    rows: seq, name, type, investor_id. The first investor of a name by id counts; a name without one is minted once,
    with the type of its first row by seq (Venture where that is null), as `named:<name>`. Blank names stay unlinked.
    """
    known = investors.groupBy(F.trim("name").alias("__name")).agg(F.min("investor_id").cast("string").alias("__known"))
    open_ = rows.withColumn("__name", F.trim("name")).join(known, "__name", "left")
    wanted = F.col("investor_id").isNull() & (F.coalesce("__name", F.lit("")) != "")
    minted = F.concat(F.lit("named:"), "__name")
    linked = open_.withColumn("investor_id", F.when(wanted, F.coalesce("__known", minted)).otherwise(F.col("investor_id").cast("string")))
    fresh = open_.where(wanted & F.col("__known").isNull()).groupBy("__name").agg(F.min_by("type", "seq").alias("type"))
    fresh = fresh.select(minted.alias("investor_id"), F.col("__name").alias("name"), F.coalesce("type", F.lit("Venture")).alias("type"), F.lit(APPROVED).alias("moderation_status"))
    return linked.drop("__name", "__known"), fresh
