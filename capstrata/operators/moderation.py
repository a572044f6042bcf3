"""Contributions, decisions on them, edit proposals, and the queue of what waits."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from capstrata.functions.values import json_value
from capstrata.functions.vocabulary import APPROVED, EDIT_FIELDS, PENDING, REJECTED, REVIEWABLE_TYPES
from capstrata.operators.profile import row_label

QUEUE = ("type", "entity_id", "company_id", "label", "submitted_by", "created_at", "source_url")


def contributed(rows: DataFrame, user: Column, at: Column) -> DataFrame:
    """New rows as a user submits them: pending."""
    return rows.withColumns({"moderation_status": F.lit(PENDING), "submitted_by": user, "created_at": at})


def _in_state(rows: DataFrame, status: str | None) -> DataFrame:
    return rows if status is None else rows.where(F.col("moderation_status") == status)


def queue_part(kind: str, rows: DataFrame, status: str | None = PENDING) -> DataFrame:
    """The queue's columns of one kind of contribution in a state (None: in any), and that state. rows: entity_id, company_id, submitted_by, created_at, moderation_status, and what its label needs."""
    return _in_state(rows, status).select(F.lit(kind).alias("type"), F.col("entity_id").cast("string"), F.col("company_id").cast("string"), row_label(kind).alias("label"), "submitted_by", "created_at", F.lit(None).cast("string").alias("source_url"), "moderation_status")


def proposal_part(proposals: DataFrame, status: str | None = PENDING, mark: str = "Edit ") -> DataFrame:
    """Edit proposals for the queue, named by the fields they change (changes: map of field to JSON value)."""
    label = F.concat(F.lit(mark), F.array_join(F.map_keys("changes"), ", "))
    return _in_state(proposals, status).select(F.lit("proposal").alias("type"), F.col("proposal_id").cast("string").alias("entity_id"), F.col("company_id").cast("string"), label.alias("label"), "submitted_by", "created_at", "source_url", "moderation_status")


def contributions(parts: dict[str, DataFrame], proposals: DataFrame, companies: DataFrame, user: Column) -> DataFrame:
    """A user's own submissions of every kind, in any state, newest first, with their state and company."""
    rows = [queue_part(kind, df.where(F.col("submitted_by") == user), None) for kind, df in parts.items()]
    rows.append(proposal_part(proposals.where(F.col("submitted_by") == user), None, "Edit: "))
    of = companies.select(F.col("company_id").cast("string").alias("company_id"), F.struct("slug", "name").alias("company"))
    return _newest_first(reduce(DataFrame.unionByName, rows).join(of, "company_id", "left").drop("source_url"))


def _newest_first(rows: DataFrame) -> DataFrame:
    rank = F.array_position(F.array(*[F.lit(t) for t in REVIEWABLE_TYPES]), F.col("type"))
    return rows.orderBy(F.desc("created_at"), rank, "entity_id")


def queue(parts: list[DataFrame], citations: DataFrame | None = None) -> DataFrame:
    """All parts together, newest first, kinds in their fixed order on ties; each row with the source it cites as a whole.

    citations: entity_type (where ids of several kinds may be the same), entity_id, field, url, created_at. The newest
    whole-row citation counts.
    """
    rows = reduce(DataFrame.unionByName, parts)
    if citations is not None:
        named = citations.withColumnRenamed("entity_type", "type")
        key = [c for c in ("type", "entity_id") if c in named.columns]
        whole = named.where("field = ''").groupBy(*key).agg(F.max_by("url", F.struct("created_at", "url")).alias("cited"))
        rows = rows.join(whole, key, "left").withColumn("source_url", F.when(F.col("type") == "proposal", F.col("source_url")).otherwise(F.coalesce("source_url", "cited"))).drop("cited")
    return _newest_first(rows.select(*QUEUE))


def with_context(rows: DataFrame, users: DataFrame, companies: DataFrame) -> DataFrame:
    """Queue rows with who submitted them (user_id, name) and the company that they are of (slug, name); null where there is none."""
    who = users.select(F.col("user_id").alias("submitted_by"), F.struct("user_id", "name").alias("submitter"))
    of = companies.select(F.col("company_id").cast("string").alias("company_id"), F.struct("slug", "name").alias("company"))
    return rows.join(who, "submitted_by", "left").join(of, "company_id", "left")


def counts_by_type(rows: DataFrame) -> DataFrame:
    """(type, n) for every kind, 0 where nothing waits."""
    kinds = rows.sparkSession.createDataFrame([(t,) for t in REVIEWABLE_TYPES], "type string")
    n = rows.groupBy("type").agg(F.count("*").alias("n"))
    return F.broadcast(kinds).join(n, "type", "left").select("type", F.coalesce("n", F.lit(0)).alias("n"))


def decide(rows: DataFrame, decisions: DataFrame, kind: str) -> tuple[DataFrame, DataFrame]:
    """(rows in their new state, CREATE revisions of what became public).

    decisions: type, entity_id, decision (APPROVED or REJECTED), admin_id, decided_at. The latest decision of a row
    counts, at one time that of the largest admin_id. A rejected row leaves no revision.
    """
    own = decisions.where((F.col("type") == kind) & F.col("decision").isin(APPROVED, REJECTED))
    own = own.groupBy("entity_id").agg(F.max_by(F.struct("decision", "admin_id", "decided_at"), F.struct("decided_at", "admin_id", "decision")).alias("d"))
    joined = rows.join(own, "entity_id", "left")
    new = joined.withColumn("moderation_status", F.coalesce("d.decision", "moderation_status"))
    after = new.where(F.col("d.decision") == APPROVED)
    values = F.to_json(F.struct(*[F.col(c) for c in rows.columns]))
    revisions = after.select(
        F.col("company_id").cast("string").alias("company_id"),
        F.lit(kind).alias("entity_type"),
        F.col("entity_id").cast("string").alias("entity_id"),
        F.lit("").alias("field"),
        F.lit("null").alias("before"),
        values.alias("after"),
        F.lit("CREATE").alias("action"),
        F.lit("ADMIN").alias("actor"),
        F.col("d.admin_id").alias("actor_user_id"),
        F.lit(None).cast("string").alias("actor_source"),
        F.col("d.decided_at").alias("created_at"),
    )
    return new.drop("d"), revisions


def publish_linked_firms(investors: DataFrame, holdings: DataFrame, decisions: DataFrame) -> DataFrame:
    """Investors, with pending firms approved that an approved holding names. Other states stay."""
    approved = decisions.where((F.col("type") == "investor") & (F.col("decision") == APPROVED)).select("entity_id")
    firms = holdings.join(approved, "entity_id", "left_semi").where("investor_id is not null").select("investor_id").distinct().withColumn("named", F.lit(True))
    out = investors.join(firms, "investor_id", "left")
    flip = F.coalesce("named", F.lit(False)) & (F.col("moderation_status") == PENDING)
    return out.withColumn("moderation_status", F.when(flip, APPROVED).otherwise(F.col("moderation_status"))).drop("named")


def current_values(companies: DataFrame) -> Column:
    """A company's editable fields as a map of field to JSON value; null is the JSON null."""
    entries = []
    for f in EDIT_FIELDS:
        if f in companies.columns:
            entries += [F.lit(f), json_value(F.col(f), companies.schema[f].dataType.typeName())]
    return F.create_map(*entries)


def proposed(asked: DataFrame, companies: DataFrame) -> DataFrame:
    """Edit proposals without their no-op fields; those that change nothing are left out.

    asked: proposal_id, company_id, changes (map of field to JSON value; absent: unchanged, `null`: cleared),
    submitted_by, created_at, source_url. Fields that cannot be edited are left out too.
    """
    now = companies.select("company_id", current_values(companies).alias("current"))
    joined = asked.join(now, "company_id")
    kept = F.map_filter("changes", lambda k, x: k.isin(*EDIT_FIELDS) & x.isNotNull() & ~x.eqNullSafe(F.try_element_at("current", k)))
    return joined.withColumn("changes", kept).where(F.size("changes") > 0).withColumn("moderation_status", F.lit(PENDING)).drop("current")


def picked(companies: DataFrame, proposals: DataFrame) -> DataFrame:
    """proposals with the current values of the fields they change in `current`."""
    now = companies.select("company_id", current_values(companies).alias("all_values"))
    return proposals.join(now, "company_id").withColumn("current", F.map_filter("all_values", lambda k, _: F.array_contains(F.map_keys("changes"), k))).drop("all_values")


def apply_proposals(companies: DataFrame, proposals: DataFrame, admin: Column, at: Column) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(companies after approved proposals, UPDATE revisions by field, citations by field).

    Several proposals on a company apply in order of (created_at, proposal_id), the last one of a field wins; each
    leaves its revisions, whose `before` is what the one before it left.
    """
    order = Window.partitionBy("company_id", "field").orderBy("proposed_at", "proposal_id")
    each = picked(companies, proposals).select("proposal_id", "company_id", "submitted_by", "source_url", F.col("created_at").alias("proposed_at"), "current", F.explode("changes").alias("field", "after"))
    revisions = each.select(
        F.col("company_id").cast("string").alias("company_id"), F.lit("company").alias("entity_type"), F.col("company_id").cast("string").alias("entity_id"), "field",
        F.coalesce(F.lag("after").over(order), F.try_element_at("current", F.col("field")), F.lit("null")).alias("before"), "after",
        F.lit("UPDATE").alias("action"), F.lit("ADMIN").alias("actor"), admin.alias("actor_user_id"), F.lit(None).cast("string").alias("actor_source"), at.alias("created_at"), "proposal_id",
    )
    cited = each.where("source_url is not null").select("source_url", F.lit("company").alias("entity_type"), F.col("company_id").cast("string").alias("entity_id"), "field", "submitted_by").distinct()
    last = each.groupBy("company_id", "field").agg(F.max_by("after", F.struct("proposed_at", "proposal_id")).alias("after"))
    new = last.groupBy("company_id").agg(F.map_from_entries(F.collect_list(F.struct("field", "after"))).alias("new"))
    out = companies.join(new, "company_id", "left")
    for f in EDIT_FIELDS:
        if f in companies.columns:
            kind = companies.schema[f].dataType
            value = F.try_element_at("new", F.lit(f))
            typed = F.from_json(value, kind.simpleString()) if kind.typeName() == "array" else F.get_json_object(F.concat(F.lit('{"v":'), value, F.lit("}")), "$.v").cast(kind)
            out = out.withColumn(f, F.when(value.isNull(), F.col(f)).when(value == "null", F.lit(None).cast(kind)).otherwise(typed))
    return out.drop("new"), revisions, cited


def dispatch(decisions: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(decisions on proposals, decisions on rows, decisions of no known kind)."""
    kind = F.coalesce(F.col("type"), F.lit(""))
    known = kind.isin(*REVIEWABLE_TYPES)
    return decisions.where(kind == "proposal"), decisions.where(known & (kind != "proposal")), decisions.where(~known)


def attach_citations(sources: DataFrame, citations: DataFrame, asked: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(sources, citations) with the asked (url, entity_type, entity_id, field, submitted_by, at) added.

    A url that is there keeps its row; a new one has type Other. A citation is one by (url, entity_type, entity_id, field).
    """
    wanted = asked.where("url is not null and url <> ''")
    fresh = wanted.groupBy("url").agg(F.min("at").alias("retrieved_at")).join(sources.select("url"), "url", "left_anti")
    sources = sources.unionByName(fresh.withColumn("source_type", F.lit("Other")), allowMissingColumns=True)
    key = ["url", "entity_type", "entity_id", "field"]
    new = wanted.groupBy(*key).agg(F.min_by("submitted_by", F.struct("at", "submitted_by")).alias("submitted_by"), F.min("at").alias("created_at")).join(citations.select(*key), key, "left_anti")
    return sources, citations.unionByName(new, allowMissingColumns=True)
