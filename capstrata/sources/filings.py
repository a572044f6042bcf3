"""Exempt-offering filings: the daily index, the documents, and the records made of them."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from capstrata.functions import text, values
from capstrata.functions.vocabulary import ENTITY_WORDS, SEC_EDGAR
from capstrata.session import materialised

#: The document's parts that are read. A single child is a list of one under this schema.
DOCUMENT = """
submissionType string,
relatedPersonsList struct<relatedPersonInfo: array<struct<
  relatedPersonName: struct<firstName: string, middleName: string, lastName: string>,
  relatedPersonRelationshipList: struct<relationship: array<string>>,
  relationshipClarification: string>>>,
primaryIssuer struct<cik: string, entityName: string,
  issuerAddress: struct<city: string, stateOrCountry: string, stateOrCountryDescription: string>,
  yearOfInc: struct<value: string>>,
offeringData struct<
  industryGroup: struct<industryGroupType: string>,
  dateOfFirstSale: struct<value: string>,
  typeOfFiling: struct<newOrAmendment: struct<isAmendment: string, previousAccessionNumber: string>, dateOfFirstSale: struct<value: string>>,
  offeringSalesAmounts: struct<totalOfferingAmount: string, totalAmountSold: string>>
"""
# Fixed values.
POOLED = "Pooled Investment Fund"
ROUND_NAME = "Private placement (Form D)"


def index_days(today: dt.date, days: int) -> list[dt.date]:
    """The last `days` calendar days from today on back, without weekends."""
    return [d for d in (today - dt.timedelta(n) for n in range(days)) if d.weekday() < 5]


def index_path(day: dt.date) -> str:
    return f"edgar/daily-index/{day.year}/QTR{(day.month + 2) // 3}/form.{day:%Y%m%d}.idx"


def parse_index(lines: DataFrame) -> DataFrame:
    """(form_type, company_name, cik, date_filed, file_name, accession) of the offering rows of index lines (value).

    Only rows of form D and D/A have a known type in their first column, so preamble and header fall away with the rest.
    """
    cols = F.transform(F.split("value", r"\s{2,}"), lambda x: F.trim(x))
    base = F.regexp_extract("file_name", "[^/]*$", 0)
    rows = lines.select(cols.alias("c")).where((F.size("c") >= 5) & F.get("c", F.lit(0)).isin("D", "D/A"))
    named = rows.select(*[F.get("c", F.lit(i)).alias(n) for i, n in enumerate(("form_type", "company_name", "cik", "date_filed", "file_name"))])
    return named.withColumn("accession", F.regexp_replace(base, r"\.txt$", "")).where("cik <> '' and accession <> ''")


def read_index(spark: SparkSession, path: str) -> DataFrame:
    """Index rows of landed files, one for each accession: the newest filing date wins, so the walk goes from today back."""
    rows = parse_index(spark.read.text(path))
    rest = [c for c in rows.columns if c != "accession"]
    return rows.groupBy("accession").agg(F.max_by(F.struct(*rest), F.struct("date_filed", "company_name")).alias("r")).select("accession", "r.*")


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """Parsed documents with the accession that their folder is named by (18 digits)."""
    rows = spark.read.format("xml").option("rowTag", "edgarSubmission").schema(DOCUMENT).load(path)
    digits = F.regexp_extract(F.input_file_name(), r"([0-9]{10})([0-9]{2})([0-9]{6})/[^/]*$", 0)
    return rows.withColumn("accession", F.regexp_replace(digits, r"^([0-9]{10})([0-9]{2})([0-9]{6})/.*$", "$1-$2-$3"))


def read_containers(spark: SparkSession, path: str) -> DataFrame:
    """Parsed documents of container files, which have a document a line as JSON: its accession, and its text as xml.

    So the number of files follows from the bytes, not from the number of documents, and a file may be split.
    """
    return parse_text(spark.read.schema("accession string, xml string").json(path))


def parse_text(documents: DataFrame, xml: str = "xml") -> DataFrame:
    """Documents held as text, parsed into the same columns."""
    return documents.withColumn("d", F.from_xml(xml, DOCUMENT)).select(*[c for c in documents.columns if c != xml], "d.*")


def _plain(c: str) -> Column:
    return F.trim(F.coalesce(F.col(c), F.lit("")))


def _person(p: Column) -> Column:
    n = p["relatedPersonName"]
    name = F.concat_ws(" ", *(text.blank_to_null(n[c]) for c in ("firstName", "middleName", "lastName")))
    roles = F.filter(F.transform(p["relatedPersonRelationshipList"]["relationship"], lambda x: F.trim(x)), lambda r: r != "")
    return F.struct(name.alias("name"), F.try_element_at(roles, F.lit(1)).alias("role"), text.blank_to_null(p["relationshipClarification"]).alias("title"))


def offerings(documents: DataFrame) -> DataFrame:
    """One row for each document that names its issuer: name, place, year, industry, amount, date, flags and people.

    The amount is what was sold, or the whole offering where nothing was. People without a name or role, and those
    whose name is a firm's, are left out.
    """
    sold, whole = (values.filing_number(F.col(f"offeringData.offeringSalesAmounts.{c}")) for c in ("totalAmountSold", "totalOfferingAmount"))
    state = F.coalesce(text.blank_to_null(F.col("primaryIssuer.issuerAddress.stateOrCountryDescription")), _plain("primaryIssuer.issuerAddress.stateOrCountry"))
    people = F.transform(F.coalesce("relatedPersonsList.relatedPersonInfo", F.array().cast("array<" + "struct<relatedPersonName:struct<firstName:string,middleName:string,lastName:string>,relatedPersonRelationshipList:struct<relationship:array<string>>,relationshipClarification:string>>")), _person)
    first_sale = F.coalesce("offeringData.typeOfFiling.dateOfFirstSale.value", "offeringData.dateOfFirstSale.value")
    return documents.where(_plain("primaryIssuer.entityName") != "").select(
        "accession",
        _plain("primaryIssuer.entityName").alias("entity_name"),
        _plain("primaryIssuer.issuerAddress.city").alias("city"),
        state.alias("state"),
        values.filing_number(F.col("primaryIssuer.yearOfInc.value")).cast("int").alias("year_of_inc"),
        _plain("offeringData.industryGroup.industryGroupType").alias("industry"),
        F.when(sold > 0, sold).otherwise(whole).alias("amount_sold_usd"),
        values.iso_date(F.trim(first_sale)).alias("date_of_first_sale"),
        (_plain("offeringData.industryGroup.industryGroupType") == POOLED).alias("is_pooled"),
        (_plain("offeringData.typeOfFiling.newOrAmendment.isAmendment") == "true").alias("is_amendment"),
        text.blank_to_null(F.col("offeringData.typeOfFiling.newOrAmendment.previousAccessionNumber")).alias("previous_accession"),
        F.filter(people, lambda p: (p["name"] != "") & p["role"].isNotNull() & ~p["name"].rlike(ENTITY_WORDS)).alias("people"),
    )


def records(index: DataFrame, parsed: DataFrame, as_of: Column, skip_pooled: bool = False, limit: int | None = None) -> DataFrame:
    """Normalised records of index rows and their parsed offerings, with seq in order of (date filed, accession).

    An amendment takes the key of the filing that it amends, and people are keyed by filer, so later filings update.
    With a limit, the latest so many.
    """
    if skip_pooled:
        parsed = parsed.where("not is_pooled")
    joined = index.join(parsed, "accession")
    if limit is not None:
        joined = joined.orderBy(F.desc("date_filed"), F.desc("accession")).limit(limit)
    # numbers of sorted partitions follow the order without gathering the rows; kept, so that they stay what they are
    joined = materialised(joined.orderBy("date_filed", "accession").withColumn("seq", F.monotonically_increasing_id()))
    year = F.substring("date_filed", 1, 4).try_cast("int")
    since = F.when(year > 0, year).otherwise(F.year(as_of))
    people = F.transform(
        "people",
        lambda p: F.struct(values.external_id(F.col("cik"), "person", text.kebab(p["name"])).alias("external_id"), p["name"].alias("name"), p["role"].alias("role"), p["title"].alias("title"), since.alias("since")),
    )
    industry = F.when(F.col("industry") != "", F.col("industry"))
    company = F.struct(
        F.col("entity_name").alias("name"),
        F.coalesce(text.comma_joined(F.col("city"), F.col("state")), F.lit("")).alias("hq"),
        F.col("year_of_inc").alias("founded"),
        F.array_compact(F.array(industry)).alias("industry"),
        values.stage_of_amount(F.col("amount_sold_usd")).alias("stage"),
        F.col("amount_sold_usd").alias("total_raised_usd"),
        *[F.lit(None).cast("string").alias(c) for c in ("domain", "website_url", "linkedin_url")],
        text.sector_of_industry(industry).alias("primary_sector"),
        *[F.lit(None).cast("string").alias(c) for c in ("one_liner", "description")],
        F.lit(None).cast("int").alias("headcount"),
        F.lit(None).cast("string").alias("status"),
    )
    placed = F.struct(
        values.round_key(F.col("is_amendment"), F.col("previous_accession"), F.col("accession")).alias("external_id"),
        F.lit(ROUND_NAME).alias("name"),
        values.safe_date(as_of, F.col("date_of_first_sale"), F.col("date_filed")).alias("date"),
        F.col("amount_sold_usd").alias("amount_usd"),
    )
    return joined.select(F.lit(SEC_EDGAR).alias("source"), F.col("cik").alias("company_external_id"), "seq", "date_filed", "accession", company.alias("company"), placed.alias("round"), people.alias("people"))
