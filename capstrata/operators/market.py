"""Market analytics over approved companies and rounds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from capstrata.functions import values
from capstrata.functions.vocabulary import APPROVED, UNICORN_USD
from capstrata.operators import ranking


def visible(df: DataFrame) -> DataFrame:
    """Rows that the public sees."""
    return df.where(F.col("moderation_status") == APPROVED)


def approved_rounds(companies: DataFrame, rounds: DataFrame) -> DataFrame:
    """(sector, date) of approved rounds of approved companies; only the keys and what is counted are joined."""
    left = visible(rounds).select("company_id", "date")
    return left.join(visible(companies).select("company_id", "sector"), "company_id").drop("company_id")


def sector_stats(companies: DataFrame, rounds: DataFrame, as_of: Column) -> DataFrame:
    """For each sector: companies, deals, total raised, median valuation, and the trend of deals over 90 days.

    Sums are pre-aggregated on both sides before the join by sector. Medians are exact, and no task holds the values of a
    sector. The recent window has no upper bound.
    """
    quarter = F.expr("interval 90 days")
    known = visible(companies).where("sector is not null")
    by_company = known.groupBy("sector").agg(
        F.count("*").alias("company_count"),
        F.coalesce(F.sum("total_raised_usd"), F.lit(0)).cast("double").alias("total_raised_usd"),
    )
    median = ranking.medians(known, "sector", "last_valuation_usd", "median_valuation_usd")
    recent = F.col("date") >= as_of - quarter
    prior = (F.col("date") >= as_of - F.expr("interval 180 days")) & (F.col("date") < as_of - quarter)
    by_round = approved_rounds(known, rounds).groupBy("sector").agg(F.count("*").alias("deals"), F.count_if(recent).alias("recent"), F.count_if(prior).alias("prior"))
    zero = lambda c: F.coalesce(c, F.lit(0))
    return by_company.join(by_round, "sector", "left").join(median, "sector", "left").select(
        "sector",
        "company_count",
        zero(F.col("deals")).alias("deal_count"),
        "total_raised_usd",
        F.coalesce("median_valuation_usd", F.lit(0.0)).alias("median_valuation_usd"),
        values.trend_percent(zero(F.col("recent")), zero(F.col("prior"))).alias("trend_pct"),
    )


def by_total_raised(stats: DataFrame) -> DataFrame:
    return stats.orderBy(F.desc("total_raised_usd"), "sector")


def sorted_stats(stats: DataFrame, key: str, descending: bool = False, limit: int | None = None) -> DataFrame:
    """Stats by one of their columns; ties by sector. Text goes by the rules of a language (Unicode's root order), not by code point."""
    if key not in stats.columns:
        raise ValueError(f"no such column: {key}")
    c = F.collate(F.col(key), "UNICODE") if stats.schema[key].dataType.typeName() == "string" else F.col(key)
    ordered = stats.orderBy(c.desc_nulls_last() if descending else c.asc_nulls_last(), F.collate("sector", "UNICODE"))
    return ordered if limit is None else ordered.limit(limit)


def totals(companies: DataFrame, rounds: DataFrame, as_of: Column, unicorn_usd: int = UNICORN_USD) -> DataFrame:
    """One row: total raised, deals, companies at or above the threshold, and the quarter. Companies without sector count."""
    shown = visible(companies)
    own = shown.agg(F.coalesce(F.sum("total_raised_usd"), F.lit(0)).cast("double").alias("total_raised_usd"), F.count_if(F.col("last_valuation_usd") >= unicorn_usd).alias("new_unicorns"))
    deals = approved_rounds(companies, rounds).agg(F.count("*").alias("deal_count"))
    # both sides are one row
    return own.withColumn("one", F.lit(1)).join(deals.withColumn("one", F.lit(1)), "one").select("total_raised_usd", "deal_count", "new_unicorns", values.quarter_label(as_of).alias("quarter"))


def funding_ladder(rounds: DataFrame) -> DataFrame:
    """Each approved round's amount in percent of its company's largest, at least 8 for display."""
    largest = visible(rounds).groupBy("company_id").agg(F.max("amount_usd").alias("largest"))
    share = F.when(F.col("largest") > 0, F.col("amount_usd") / F.col("largest") * 100).otherwise(F.lit(0.0))
    return visible(rounds).join(largest, "company_id").select("company_id", "round_id", "amount_usd", F.greatest(F.lit(8.0), share).alias("bar_pct"))
