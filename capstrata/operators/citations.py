"""Citations derived from where a row came from."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from capstrata.functions import text
from capstrata.functions.vocabulary import SEC_ADV, SEC_EDGAR, WIKIDATA

TARGET = ("entity_type", "entity_id", "url", "source_type", "publisher", "title", "reference", "retrieved_at")


def _filing(kind: str, entity: Column, url: Column, title: Column, reference: Column, at: Column) -> list[Column]:
    return [F.lit(kind).alias("entity_type"), entity.cast("string").alias("entity_id"), url.alias("url"), F.lit("SEC filing").alias("source_type"), F.lit("SEC").alias("publisher"), title.alias("title"), reference.alias("reference"), at.alias("retrieved_at")]


def _entity(kind: str, entity: Column, qid: Column, at: Column) -> list[Column]:
    return [F.lit(kind).alias("entity_type"), entity.cast("string").alias("entity_id"), text.entity_url(qid).alias("url"), F.lit("Wikidata").alias("source_type"), F.lit("Wikidata").alias("publisher"), F.concat(F.lit("Wikidata entity "), qid).alias("title"), qid.alias("reference"), at.alias("retrieved_at")]


def latest_filing(rounds: DataFrame) -> DataFrame:
    """(company_id, accession) of each company's newest filed round, by (date, external_id)."""
    filed = rounds.where((F.col("external_source") == SEC_EDGAR) & F.col("external_id").isNotNull())
    return filed.groupBy("company_id").agg(F.max_by("external_id", F.struct("date", "external_id")).alias("accession"))


def provenance(companies: DataFrame) -> DataFrame:
    """(company_id, cik, qid) of companies that a source created."""
    own = companies.where("external_source is not null and external_id is not null")
    return own.select("company_id", F.when(F.col("external_source") == SEC_EDGAR, F.col("external_id")).alias("cik"), F.when(F.col("external_source") == WIKIDATA, F.col("external_id")).alias("qid"))


def company_targets(companies: DataFrame) -> DataFrame:
    rows = companies.where("external_id is not null")
    key, at = F.col("external_id"), F.col("updated_at")
    filed = rows.where(F.col("external_source") == SEC_EDGAR).select(*_filing("company", F.col("company_id"), text.filer_url(key), F.concat(F.lit("SEC EDGAR Form D filings (CIK "), key, F.lit(")")), key, at))
    return filed.unionByName(rows.where(F.col("external_source") == WIKIDATA).select(*_entity("company", F.col("company_id"), key, at)))


def round_targets(rounds: DataFrame, companies: DataFrame) -> DataFrame:
    """A filing's address needs the filer's number: rounds of companies from elsewhere have no target."""
    rows = rounds.where((F.col("external_source") == SEC_EDGAR) & F.col("external_id").isNotNull()).join(provenance(companies).where("cik is not null"), "company_id")
    key = F.col("external_id")
    return rows.select(*_filing("round", F.col("round_id"), text.filing_url(F.col("cik"), key), F.concat(F.lit("SEC Form D filing "), key), key, F.col("updated_at")))


def person_targets(people: DataFrame, companies: DataFrame, rounds: DataFrame) -> DataFrame:
    """The company's newest filing names its people; without one, the filer's list does."""
    own = people.where("external_id is not null").join(provenance(companies), "company_id")
    cik, qid, at = F.col("cik"), F.col("qid"), F.col("updated_at")
    graph = own.where((F.col("external_source") == WIKIDATA) & qid.isNotNull()).select(*_entity("person", F.col("person_id"), qid, at))
    filed = own.where((F.col("external_source") == SEC_EDGAR) & cik.isNotNull()).join(latest_filing(rounds), "company_id", "left")
    acc = F.col("accession")
    one = acc.isNotNull()
    return graph.unionByName(
        filed.select(
            *_filing("person", F.col("person_id"), F.when(one, text.filing_url(cik, acc)).otherwise(text.filer_url(cik)), F.when(one, F.concat(F.lit("SEC Form D filing "), acc)).otherwise(F.concat(F.lit("SEC EDGAR Form D filings (CIK "), cik, F.lit(")"))), F.coalesce(acc, cik), at)
        )
    )


def child_targets(kind: str, children: DataFrame, companies: DataFrame) -> DataFrame:
    """Holdings, acquisitions and exits cite their company's entity."""
    rows = children.where(F.col("external_id").isNotNull() & (F.col("external_source") == WIKIDATA)).join(provenance(companies).where("qid is not null"), "company_id")
    return rows.select(*_entity(kind, F.col("entity_id"), F.col("qid"), F.col("updated_at")))


def firm_targets(investors: DataFrame) -> DataFrame:
    rows = investors.where("external_id is not null")
    key, at = F.col("external_id"), F.col("updated_at")
    adv = rows.where(F.col("external_source") == SEC_ADV).select(*_filing("investor", F.col("investor_id"), text.adviser_url(key), F.concat(F.lit("SEC Form ADV — CRD "), key), key, at))
    return adv.unionByName(rows.where(F.col("external_source") == WIKIDATA).select(*_entity("investor", F.col("investor_id"), key, at)))


def backfill(sources: DataFrame, citations: DataFrame, targets: list[DataFrame]) -> tuple[DataFrame, DataFrame]:
    """(sources, citations) with whole-row citations of all targets added; a url is one source, a key one citation."""
    every = reduce(DataFrame.unionByName, targets)
    new = every.groupBy("url").agg(F.min_by(F.struct("source_type", "publisher", "title", "reference"), F.struct("retrieved_at", "title")).alias("s"), F.max("retrieved_at").alias("retrieved_at"))
    sources = sources.unionByName(new.select("url", "s.*", "retrieved_at").join(sources.select("url"), "url", "left_anti"), allowMissingColumns=True)
    key = ["url", "entity_type", "entity_id", "field"]
    cited = every.withColumn("field", F.lit("")).select(*key).distinct().join(citations.select(*key), key, "left_anti")
    return sources, citations.unionByName(cited, allowMissingColumns=True)
