"""Company profiles: sections of approved children, preview for those who have not contributed, timelines and watchlists."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from capstrata.functions import values
from capstrata.functions.vocabulary import APPROVED
from capstrata.operators.market import visible

PREVIEW = 2


def section(children: DataFrame, name: str, fields: list[str], order: list[str], most: int | None = None) -> DataFrame:
    """(company_id, name, name_total): a company's approved children as one list, in order.

    Each section is gathered by itself before profiles join it, so sections do not multiply each other's rows. With
    `most` only the first so many are gathered (a preview needs no more), however many a company has; the total is
    always that of the whole.
    """
    shown = visible(children)
    entry = F.struct(*[F.col(c) for c in order], *[F.col(c) for c in fields if c not in order])
    if most is None:
        listed = shown.groupBy("company_id").agg(F.array_sort(F.collect_list(entry)).alias(name))
        return listed.withColumn(f"{name}_total", F.size(name))
    totals = shown.groupBy("company_id").agg(F.count("*").cast("int").alias(f"{name}_total"))
    rank = F.row_number().over(Window.partitionBy("company_id").orderBy(*order))
    first = shown.withColumn("__rank", rank).where(F.col("__rank") <= most).groupBy("company_id").agg(F.array_sort(F.collect_list(entry)).alias(name))
    return first.join(totals, "company_id")


def profiles(companies: DataFrame, sections: list[DataFrame]) -> DataFrame:
    """Approved companies with their sections; an absent section is an empty list with total 0."""
    out = visible(companies)
    for s in sections:
        name = next(c for c in s.columns if c != "company_id" and not c.endswith("_total"))
        kind = s.schema[name].dataType.simpleString()
        out = out.join(s, "company_id", "left").withColumn(name, F.coalesce(name, F.array().cast(kind))).withColumn(f"{name}_total", F.coalesce(f"{name}_total", F.lit(0)))
    return out


def round_investors(rounds: DataFrame, investors: DataFrame) -> DataFrame:
    """Rounds with their investors (name, lead) as a list; they share the round's state."""
    each = investors.groupBy("round_id").agg(F.array_sort(F.collect_list(F.struct("name", "lead"))).alias("investors"))
    return rounds.join(each, "round_id", "left").withColumn("investors", F.coalesce("investors", F.array().cast("array<struct<name:string,lead:boolean>>")))


def linked_holdings(holdings: DataFrame, investors: DataFrame) -> DataFrame:
    """Holdings with the slug of their firm, where that firm is approved."""
    firms = investors.select("investor_id", F.when(F.col("moderation_status") == APPROVED, F.col("slug")).alias("investor_slug"))
    return holdings.join(firms, "investor_id", "left")


def gated(profile: DataFrame, names: list[str], unlocked: Column) -> DataFrame:
    """Profiles with each section cut to its first rows, unless unlocked; totals stay those of the whole."""
    return profile.withColumns({n: F.when(unlocked, F.col(n)).otherwise(F.slice(n, 1, PREVIEW)) for n in names})


def financials(revenue: Column, growth: Column, margin: Column) -> Column:
    """A struct if the revenue is known; unknown growth and margin are 0."""
    return F.when(revenue.isNotNull(), F.struct(revenue.alias("revenue_usd"), F.coalesce(growth, F.lit(0.0)).alias("growth_pct"), F.coalesce(margin, F.lit(0.0)).alias("margin_pct")))


def display_sector(sector: Column, industry: Column) -> Column:
    return F.coalesce(sector, F.try_element_at(industry, F.lit(1)))


def shown_citations(citations: DataFrame, sources: DataFrame, shown: DataFrame) -> DataFrame:
    """Citations of the shown entities (entity_id) with their source inlined, oldest first.

    What a preview hides is not in `shown`, and so no citation of it is either.
    """
    own = citations.join(shown.select("entity_id").distinct(), "entity_id", "left_semi")
    inline = sources.select("source_id", F.struct("url", "source_type", "publisher", "title").alias("source"))
    return own.join(inline, "source_id").orderBy("created_at", "citation_id")


def field_citations(citations: DataFrame, field: str, most: int = 3) -> DataFrame:
    """For each entity the citations of a field, or those of the whole row (empty field) where the field has none; at most three."""
    rows = citations.where(F.col("field").isin(field, ""))
    exact = rows.groupBy("entity_id").agg(F.max(F.col("field") == field).alias("has"))
    kept = rows.join(exact, "entity_id").where(F.col("has") == (F.col("field") == field) if field else F.lit(True))
    rank = F.row_number().over(Window.partitionBy("entity_id").orderBy("created_at", "citation_id"))
    return kept.withColumn("rank", rank).where(F.col("rank") <= most).drop("has")


def labels(frames: dict[str, DataFrame], of: dict[str, Column]) -> DataFrame:
    """(entity_type, entity_id, label) of several kinds of rows."""
    out = None
    for kind, df in frames.items():
        part = df.select(F.lit(kind).alias("entity_type"), F.col("entity_id"), of[kind].cast("string").alias("label"))
        out = part if out is None else out.unionByName(part)
    return out


def row_label(kind: str) -> Column:
    """What a row of a kind is called in queues and timelines."""
    return {
        "company": F.col("name"),
        "round": F.concat("name", F.lit(" round")),
        "person": F.col("name"),
        "investor": F.col("name"),
        "acquisition": F.concat(F.lit("Acquired "), "target"),
        "exit": F.concat("type", F.lit(" exit")),
        "diversity": F.col("label"),
    }[kind]


def timeline(revisions: DataFrame, users: DataFrame, named: DataFrame) -> DataFrame:
    """Revisions, newest first, with the label of their subject and the name of their actor: a source or a user, never an address."""
    by_user = users.select(F.col("user_id").alias("actor_user_id"), F.col("name").alias("user_name"))
    known = named.select("entity_type", "entity_id", "label")
    out = revisions.join(by_user, "actor_user_id", "left").join(known, ["entity_type", "entity_id"], "left")
    actor = F.when(F.col("actor") == "INGEST", F.col("actor_source")).otherwise(F.col("user_name"))
    return out.withColumn("entity_label", F.coalesce("label", "entity_type")).withColumn("actor_name", actor).drop("label", "user_name").orderBy(F.desc("created_at"), F.desc("revision_id"))


def history(revisions: DataFrame, users: DataFrame, named: DataFrame, page: int, size: int) -> DataFrame:
    """A page of a company's timeline, each row with the number of all its revisions."""
    return timeline(revisions, users, named).withColumn("total", F.count("*").over(Window.partitionBy("company_id"))).orderBy(F.desc("created_at"), F.desc("revision_id")).offset((page - 1) * size).limit(size)


def shown_rows(children: DataFrame, order: list[str], viewer: DataFrame) -> DataFrame:
    """Approved children that a viewer sees: all of companies that are unlocked, of others the first PREVIEW in order.

    viewer: company_id, unlocked; companies without a row are locked. Rows are cut before any list is gathered.
    """
    rank = F.row_number().over(Window.partitionBy("company_id").orderBy(*order))
    ranked = visible(children).withColumn("__rank", rank)
    open_ = viewer.where("unlocked").select("company_id", F.lit(True).alias("__open"))
    return ranked.join(open_, "company_id", "left").where((F.col("__rank") <= PREVIEW) | F.col("__open")).drop("__rank", "__open")


def read(companies: DataFrame, children: dict[str, tuple[str, DataFrame, list[str], list[str]]], citations: DataFrame, sources: DataFrame, viewer: DataFrame) -> DataFrame:
    """Approved companies as one viewer reads them: company_id and its columns, a list and a total for each section, access, citations.

    children: for each section its kind, rows (company_id, entity_id, moderation_status and what follows), the fields
    of an entry, and its order. citations: citation_id, entity_type, entity_id, source_id, created_at. viewer:
    company_id, unlocked, unlocked_until. Locked companies show a preview of each section; totals are those of all
    approved rows. The citations, oldest first, are those of the company and of the rows shown, and of no others.
    """
    out = visible(companies).join(viewer.select("company_id", "unlocked", "unlocked_until"), "company_id", "left")
    out = out.withColumns({"unlocked": F.coalesce("unlocked", F.lit(False)), "preview_limit": F.lit(PREVIEW)})
    shown = out.select("company_id", F.lit("company").alias("entity_type"), F.col("company_id").cast("string").alias("entity_id"))
    for name, (kind, rows, fields, order) in children.items():
        seen = shown_rows(rows, order, viewer)
        entry = F.struct(*order, *[c for c in fields if c not in order])
        listed = seen.groupBy("company_id").agg(F.array_sort(F.collect_list(entry)).alias(name))
        totals = visible(rows).groupBy("company_id").agg(F.count("*").alias(f"{name}_total"))
        out = out.join(listed, "company_id", "left").join(totals, "company_id", "left")
        out = out.withColumns({name: F.coalesce(name, F.array().cast(listed.schema[name].dataType)), f"{name}_total": F.coalesce(f"{name}_total", F.lit(0))})
        shown = shown.unionByName(seen.join(visible(companies).select("company_id"), "company_id", "left_semi").select("company_id", F.lit(kind).alias("entity_type"), F.col("entity_id").cast("string")))
    inline = sources.select("source_id", "url")
    own = citations.withColumn("entity_id", F.col("entity_id").cast("string")).join(shown, ["entity_type", "entity_id"]).join(inline, "source_id")
    cited = own.groupBy("company_id").agg(F.array_sort(F.collect_list(F.struct("created_at", "citation_id", "entity_type", "entity_id", "url"))).alias("citations"))
    return out.join(cited, "company_id", "left").withColumn("citations", F.coalesce("citations", F.array().cast(cited.schema["citations"].dataType)))


def contributions_with_access(rows: DataFrame, granted: DataFrame) -> DataFrame:
    """Contributions with the access window of who made them: unlocked and unlocked_until."""
    return rows.join(granted.select(F.col("user_id").alias("submitted_by"), "unlocked", "unlocked_until"), "submitted_by", "left")


def last_contribution(frames: list[DataFrame]) -> DataFrame:
    """(user_id, last_at) over all kinds of contributions in any state; each kind is reduced before they meet."""
    out = None
    for df in frames:
        part = df.where("submitted_by is not null").groupBy(F.col("submitted_by").alias("user_id")).agg(F.max("created_at").alias("at"))
        out = part if out is None else out.unionByName(part)
    return out.groupBy("user_id").agg(F.max("at").alias("last_at"))


def access(last: DataFrame, users: DataFrame, as_of: Column) -> DataFrame:
    """(user_id, unlocked, unlocked_until, recent) of each user."""
    admin = F.col("role") == "ADMIN"
    out = users.join(last, "user_id", "left")
    return out.select("user_id", values.is_unlocked(F.col("last_at"), as_of, admin).alias("unlocked"), values.unlocked_until(F.col("last_at")).alias("unlocked_until"), values.contributed_since(F.col("last_at"), as_of).alias("recent"))


def watchlist(saved: DataFrame, companies: DataFrame) -> DataFrame:
    """Users' saved companies that are approved, newest first."""
    shown = visible(companies).select("company_id", "slug", "name", "stage", "total_raised_usd")
    return saved.join(shown, "company_id").select("user_id", "slug", "name", "stage", "total_raised_usd", "saved_at").orderBy(F.desc("saved_at"), "user_id", "slug")


def save(saved: DataFrame, asked: DataFrame, companies: DataFrame) -> DataFrame:
    """saved with the asked (user_id, slug, saved_at) of approved companies; what is there stays as it is."""
    ids = asked.join(visible(companies).select("slug", "company_id"), "slug").groupBy("user_id", "company_id").agg(F.min("saved_at").alias("saved_at"))
    return saved.unionByName(ids.join(saved, ["user_id", "company_id"], "left_anti"))


def unsave(saved: DataFrame, asked: DataFrame, companies: DataFrame) -> DataFrame:
    """saved without the asked (user_id, slug); a company in any state can be removed."""
    ids = asked.join(companies.select("slug", "company_id"), "slug").select("user_id", "company_id")
    return saved.join(ids, ["user_id", "company_id"], "left_anti")


def is_saved(saved: DataFrame, asked: DataFrame, companies: DataFrame) -> DataFrame:
    """asked (user_id, slug) with whether it is saved."""
    have = saved.join(companies.select("slug", "company_id"), "company_id").select("user_id", "slug").distinct().withColumn("saved", F.lit(True))
    return asked.join(have, ["user_id", "slug"], "left").withColumn("saved", F.coalesce("saved", F.lit(False)))
