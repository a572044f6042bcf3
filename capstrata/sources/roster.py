"""Adviser rosters: snapshot listings, the CSV files, and the firms made of their rows."""

from __future__ import annotations

import csv
import io
import zipfile
from collections.abc import Iterator
from itertools import islice

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from capstrata.functions import text, values

# Names of columns, and words of a status that ends a registration.
ORIGIN = "https://www.sec.gov"
COUNTS = {"Venture": "Total number of VC funds", "Private equity": "Total number of PE funds", "Hedge fund": "Total number of Hedge funds"}
FLAGS = {"Venture": "Any VC Funds", "Private equity": "Any PE Funds", "Hedge fund": "Any Hedge Funds"}
OTHER_COUNTS = ("Total number of Real Estate funds", "Total number of Securitized funds", "Total number of Other funds")
ENDED = "withdraw|terminat|revok|expire|cancel"
COLUMNS = (
    "Organization CRD#", "CIK#", "Primary Business Name", "Legal Name", "Main Office City", "Main Office State", "Main Office Country", "SEC Current Status", "Website Address",
    *FLAGS.values(), *COUNTS.values(), *OTHER_COUNTS, "Total Gross Assets of Private Funds",
)
#: Rows of an archive that are handed on at once.
_ROWS = 5000


def snapshots(pages: DataFrame, html: str = "html") -> DataFrame:
    """(label, registered, exempt, pos): complete pairs of roster files that a listing links, in the listing's order, newest first."""
    links = pages.select(F.posexplode(F.regexp_extract_all(html, F.lit(r'(?i)href="([^"]+\.zip)"'), 1)).alias("pos", "href"))
    name = F.regexp_extract("href", "[^/]*$", 0)
    label = F.lower(F.regexp_extract(name, r"(?i)^(ia\d{6,8}).*\.zip$", 1))
    exempt = F.regexp_extract(name, r"(?i)^ia\d{6,8}(.*)\.zip$", 1).rlike("(?i)exempt")
    url = F.when(F.col("href").startswith("http"), F.col("href")).otherwise(F.concat(F.lit(ORIGIN), "href"))
    found = links.select("pos", label.alias("label"), exempt.alias("is_exempt"), url.alias("url")).where("label <> ''")
    pairs = found.groupBy("label").agg(
        F.min_by(F.when(~F.col("is_exempt"), F.col("url")), F.when(~F.col("is_exempt"), F.col("pos"))).alias("registered"),
        F.min_by(F.when(F.col("is_exempt"), F.col("url")), F.when(F.col("is_exempt"), F.col("pos"))).alias("exempt"),
        F.min("pos").alias("pos"),
    )
    return pairs.where("registered is not null and exempt is not null")


def snapshot(pairs: DataFrame, label: str | None = None) -> DataFrame:
    """The labelled pair, or the newest."""
    return pairs.where(F.col("label") == label.lower()) if label else pairs.orderBy("pos").limit(1)


def unzipped(spark: SparkSession, path: str) -> DataFrame:
    """(path, content) of the first CSV in each archive, decoded from windows-1252, which Spark's readers do not know."""

    def texts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            out = []
            for name, data in zip(rows["path"], rows["content"], strict=True):
                with zipfile.ZipFile(io.BytesIO(data)) as archive:
                    entry = next((n for n in archive.namelist() if n.lower().endswith(".csv")), None)
                    if entry:
                        out.append((name, archive.read(entry).decode("cp1252", "replace")))
            yield pd.DataFrame(out, columns=["path", "content"])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(texts, "path string, content string")


def read_zipped(spark: SparkSession, path: str, columns: tuple[str, ...] = COLUMNS) -> DataFrame:
    """The named columns of the first CSV in each archive, in windows-1252, trimmed; missing cells are empty, blank rows left out.

    `row` numbers the rows of an archive. An archive is read as a stream, some rows at a time.
    """

    def rows_of(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for files in batches:
            for data in files["content"]:
                with zipfile.ZipFile(io.BytesIO(data)) as archive:
                    entry = next((n for n in archive.namelist() if n.lower().endswith(".csv")), None)
                    if entry is None:
                        continue
                    lines = csv.reader(io.TextIOWrapper(archive.open(entry), encoding="cp1252", errors="replace", newline=""))
                    header = [h.strip() for h in next(lines, [])]
                    at = [header.index(c) if c in header else -1 for c in columns]
                    cells = ([r[i].strip() if 0 <= i < len(r) else "" for i in at] for r in lines if any(x.strip() for x in r))
                    first = 0
                    while part := list(islice(cells, _ROWS)):
                        yield pd.DataFrame(part, columns=list(columns)).assign(row=range(first, first + len(part)))
                        first += len(part)

    schema = ", ".join(f"`{c}` string" for c in columns) + ", row long"
    return spark.read.format("binaryFile").load(path).select("content").mapInPandas(rows_of, schema)


def read_roster(spark: SparkSession, path: str) -> DataFrame:
    """A roster CSV with trimmed headers and cells, all strings; missing cells are empty, and blank rows are left out."""
    raw = spark.read.option("header", True).option("multiLine", True).option("escape", '"').option("encoding", "ISO-8859-1").csv(path)
    rows = raw.toDF(*[c.strip().lstrip("﻿").removeprefix("ï»¿").strip('"') for c in raw.columns])
    named = rows.select(*[F.trim(F.regexp_replace(F.coalesce(F.col(f"`{c}`"), F.lit("")), r"^[\r\n]+|[\r\n]+$", "")).alias(c) for c in rows.columns])
    return named.where(F.concat(*[F.col(f"`{c}`") for c in named.columns]) != "")


def _cell(rows: DataFrame, name: str) -> Column:
    return F.trim(F.coalesce(F.col(f"`{name}`"), F.lit(""))) if name in rows.columns else F.lit("")


def firm_type(rows: DataFrame) -> Column:
    """The kind of fund that a firm has most of, in their fixed order on ties; else the first kind that is ticked; else null."""
    n = {kind: values.roster_number(_cell(rows, column)) for kind, column in COUNTS.items()}
    most = F.greatest(*n.values())
    out = F.when(F.lit(False), "")
    for kind, count in n.items():
        out = out.when((count == most) & (count > 0), kind)
    for kind, column in FLAGS.items():
        out = out.when((most <= 0) & (F.upper(_cell(rows, column)) == "Y"), kind)
    return out


def is_active(rows: DataFrame) -> Column:
    status = F.lower(_cell(rows, "SEC Current Status"))
    return (status != "") & ~status.rlike(ENDED)


def firms(rows: DataFrame, types: tuple[str, ...] = ("Venture", "Private equity", "Hedge fund"), order: list[str] | None = None) -> DataFrame:
    """Firms of active roster rows that run private funds of the given kinds; of repeated numbers the first row in order."""
    crd, legal_raw = _cell(rows, "Organization CRD#"), _cell(rows, "Legal Name")
    raw = F.coalesce(text.blank_to_null(_cell(rows, "Primary Business Name")), legal_raw)
    name = text.title_case_firm(raw)
    city = F.when(_cell(rows, "Main Office City") != "", text.title_case_firm(_cell(rows, "Main Office City")))
    hq = text.comma_joined(city, _cell(rows, "Main Office State"), _cell(rows, "Main Office Country"))
    funds = F.lit(0.0)
    for column in (*COUNTS.values(), *OTHER_COUNTS):
        funds = funds + values.roster_number(_cell(rows, column))
    assets = values.roster_number(_cell(rows, "Total Gross Assets of Private Funds"))
    site = text.classify_website(_cell(rows, "Website Address"))
    kept = rows.where(is_active(rows) & (crd != "") & (raw != "")).withColumn("__type", firm_type(rows)).where(F.col("__type").isin(*types))
    mapped = kept.select(
        crd.alias("external_id"),
        name.alias("name"),
        F.when((legal_raw != "") & (legal_raw != raw), text.title_case_firm(legal_raw)).alias("legal_name"),
        F.col("__type").alias("type"),
        hq.alias("hq"),
        site["website_url"].alias("website_url"),
        site["linkedin_url"].alias("linkedin_url"),
        site["domain"].alias("domain"),
        text.firm_description(name, F.col("__type"), funds, hq).alias("description"),
        crd.alias("crd_number"),
        text.blank_to_null(_cell(rows, "CIK#")).alias("cik_number"),
        F.when(funds > 0, funds.cast("long")).alias("fund_count"),
        F.when(assets > 0, values.round_half_up(assets)).alias("assets_usd"),
        F.lit(None).cast("int").alias("founded_year"),
        *[F.col(c).alias(f"__{c}") for c in order or []],
    )
    by = [f"__{c}" for c in order] if order else ["name", "legal_name", "hq"]
    rest = [c for c in mapped.columns if c != "external_id"]
    first = mapped.groupBy("external_id").agg(F.min_by(F.struct(*rest), F.struct(*by)).alias("r")).select("external_id", "r.*")
    return first.drop(*[f"__{c}" for c in order or []])


def roster_firms(exempt: DataFrame, registered: DataFrame, types: tuple[str, ...], limit: int | None = None) -> DataFrame:
    """Firms of both files; a number that both have is the exempt file's. With a limit, the first so many by number."""
    both = exempt.withColumn("file_rank", F.lit(0)).unionByName(registered.withColumn("file_rank", F.lit(1)), allowMissingColumns=True)
    found = firms(both, types, ["file_rank", "row"] if "row" in both.columns else ["file_rank"])
    return found if limit is None else found.orderBy(F.length("external_id"), "external_id").limit(limit)
