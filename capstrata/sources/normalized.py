"""The shapes that all sources deliver, and how a source is chosen."""

from __future__ import annotations

from typing import Protocol

from pyspark.sql import DataFrame, SparkSession

#: One row for each company that a source tells of, with what belongs to it.
RECORD = """
source string, company_external_id string, seq long,
company struct<name:string, hq:string, founded:int, industry:array<string>, stage:string, total_raised_usd:double, domain:string, website_url:string,
  linkedin_url:string, primary_sector:string, one_liner:string, description:string, headcount:int, status:string>,
round struct<external_id:string, name:string, date:date, amount_usd:double>,
people array<struct<external_id:string, name:string, role:string, title:string, since:int>>,
investors array<struct<external_id:string, investor_external_id:string, name:string, type:string, first_round:string, rounds:int>>,
acquisitions array<struct<external_id:string, target:string, date:date, amount_usd:double, rationale:string>>,
exits array<struct<external_id:string, type:string, date:date, value_usd:double, detail:string>>
"""
#: One row for each investor firm without companies.
FIRM = """
external_id string, name string, legal_name string, type string, hq string, website_url string, linkedin_url string, domain string,
description string, crd_number string, cik_number string, fund_count long, assets_usd long, founded_year int, seq long
"""


class Source(Protocol):
    """A source of landed files: records of companies, and of firms where it has any."""

    name: str

    def records(self, spark: SparkSession, folder: str, limit: int | None = None) -> DataFrame | None: ...

    def firms(self, spark: SparkSession, folder: str, limit: int | None = None) -> DataFrame | None: ...


def chosen(sources: list[Source], names: list[str] | None) -> list[Source]:
    return [s for s in sources if not names or s.name in names]
