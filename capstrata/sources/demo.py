"""Demonstration rows: a few invented companies with everything that a profile can show, as flat tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from capstrata.functions.vocabulary import APPROVED

_COMPANIES = [
    ("demo-1", "northwind-grid", "Northwind Grid", "northwindgrid.example", "Energy", "Batteries for small towns", "Series B", "Private", 42_000_000, 180_000_000),
    ("demo-2", "tidepool-labs", "Tidepool Labs", "tidepool.example", "Healthcare", "Tests that run on a phone", "Seed", "Private", 3_500_000, None),
    ("demo-3", "copperline", "Copperline", "copperline.example", "Transport", "Freight without paper", "Public", "Public", 310_000_000, 1_900_000_000),
]
_ROUNDS = [("demo-1", "Series A", "2021-03-01", 12_000_000), ("demo-1", "Series B", "2023-06-15", 30_000_000), ("demo-2", "Seed", "2024-02-10", 3_500_000), ("demo-3", "Series D", "2019-09-01", 120_000_000)]
_PEOPLE = [("demo-1", "Ida Moor", "Founder", 2018), ("demo-2", "Sam Reyes", "CEO", 2022), ("demo-3", "Lena Voss", "Founder", 2011)]
_HOLDINGS = [("demo-1", "Fjord Ventures", "Venture", "Series A", 2), ("demo-3", "Fjord Ventures", "Venture", "Series C", 1), ("demo-3", "Long Bridge Capital", "Private equity", "Series D", 1)]
_ACQUISITIONS = [("demo-3", "Portside", "2020-05-01", 25_000_000, "Adds harbour bookings")]
_EXITS = [("demo-3", "IPO", "2022-11-03", 1_700_000_000, "Listed in Frankfurt")]
_DIVERSITY = [("demo-2", "Founders", "2 of 3 women", "As stated by the company")]


def tables(spark: SparkSession) -> dict[str, DataFrame]:
    """companies, rounds, people, holdings (not yet linked), acquisitions, exits and diversity, all approved."""
    shapes = {
        "companies": (_COMPANIES, "company_id string, slug string, name string, domain string, sector string, one_liner string, stage string, status string, total_raised_usd long, last_valuation_usd long"),
        "rounds": (_ROUNDS, "company_id string, name string, date string, amount_usd long"),
        "people": (_PEOPLE, "company_id string, name string, role string, since int"),
        "holdings": (_HOLDINGS, "company_id string, name string, type string, first_round string, rounds int"),
        "acquisitions": (_ACQUISITIONS, "company_id string, target string, date string, amount_usd long, rationale string"),
        "exits": (_EXITS, "company_id string, type string, date string, value_usd long, detail string"),
        "diversity": (_DIVERSITY, "company_id string, label string, value string, note string"),
    }
    return {name: spark.createDataFrame([(*r, APPROVED) for r in rows], schema + ", moderation_status string") for name, (rows, schema) in shapes.items()}
