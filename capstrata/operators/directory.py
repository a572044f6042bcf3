"""Directory reads: filtered, sorted and paged companies and investors, and what the site lists of them."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from capstrata.functions import vocabulary as v
from capstrata.functions.text import kebab
from capstrata.operators.market import visible

PAGE_SIZE, MOST_ON_PAGE = 25, 100


def checked(value, allowed, what: str):
    """A parameter that must be one of a closed list, or absent."""
    if value is not None and value not in allowed:
        raise ValueError(f"{what} must be one of {', '.join(allowed)}")
    return value


def checked_page(page: int, size: int) -> tuple[int, int]:
    if page < 1 or not 1 <= size <= MOST_ON_PAGE:
        raise ValueError(f"page must be at least 1, and its size 1 to {MOST_ON_PAGE}")
    return page, size


def lenient(raw: dict, choices: dict[str, tuple[str, ...]]) -> dict:
    """Parameters as a link carries them: unknown values are dropped rather than refused."""
    out = {"q": (raw.get("q") or "").strip() or None}
    out |= {k: raw.get(k) if raw.get(k) in allowed else None for k, allowed in choices.items()}
    page = str(raw.get("page") or "")
    out["page"] = int(page) if page.isdigit() and int(page) >= 1 else None
    return {k: x for k, x in out.items() if x is not None}


def holds(column: Column, q: str) -> Column:
    """Literal substring, whatever the case."""
    return F.contains(F.lower(column), F.lower(F.lit(q)))


def find_companies(companies: DataFrame, q: str | None = None, sector: str | None = None, stage: str | None = None, status: str | None = None, slugs: str | None = None) -> DataFrame:
    """Approved companies under all given facets; q searches name and one-liner, slugs is a comma list."""
    out = visible(companies)
    if slugs:
        out = out.where(F.col("slug").isin(*[s for s in slugs.split(",") if s]))
    if q:
        out = out.where(holds(F.col("name"), q) | F.coalesce(holds(F.col("one_liner"), q), F.lit(False)))
    for name, value in (("sector", sector), ("stage", stage), ("status", status)):
        if value is not None:
            out = out.where(F.col(name) == value)
    return out


def company_order(sort: str | None = None) -> list[Column]:
    checked(sort, v.COMPANY_SORTS, "sort")
    if sort == "raised":
        return [F.desc("total_raised_usd"), F.asc("slug")]
    if sort == "valuation":
        return [F.desc_nulls_last("last_valuation_usd"), F.asc("slug")]
    return [F.asc("name"), F.asc("slug")]


def fallback_order(sort: str | None = None) -> list[Column]:
    """The order of the fixture list that stands in for the directory: as the directory's, but an unknown valuation counts as 0."""
    checked(sort, v.COMPANY_SORTS, "sort")
    return [F.coalesce("last_valuation_usd", F.lit(0)).desc(), F.asc("slug")] if sort == "valuation" else company_order(sort)


def page_of(df: DataFrame, order: list[Column], page: int = 1, size: int = PAGE_SIZE) -> DataFrame:
    """One page in a total order; Spark keeps no more than the rows up to the page's end in each task."""
    page, size = checked_page(page, size)
    return df.orderBy(*order).offset((page - 1) * size).limit(size)


def page_with_total(df: DataFrame, order: list[Column], page: int = 1, size: int = PAGE_SIZE) -> DataFrame:
    """A page with the number of rows under the same filter in `total`."""
    total = df.agg(F.count("*").alias("total")).withColumn("one", F.lit(1))
    return page_of(df, order, page, size).withColumn("one", F.lit(1)).join(F.broadcast(total), "one").drop("one")


def typeahead(companies: DataFrame, q: str, limit: int = 10) -> DataFrame:
    """The first names that hold q; none for a blank q."""
    asked = q.strip()
    found = find_companies(companies, q=asked) if asked else companies.where("false")
    return found.orderBy("name", "slug").limit(limit).select("slug", "name", "domain")


def selection(companies: DataFrame, slugs: list[str], most: int = 4) -> DataFrame:
    """Approved companies in the order asked for, each once, at most four; unknown ones are dropped."""
    wanted = list(dict.fromkeys(s for s in slugs if s))[:most]
    asked = companies.sparkSession.createDataFrame(list(enumerate(wanted)), "pos int, slug string")
    return visible(companies).join(F.broadcast(asked), "slug").orderBy("pos")


def page_window(current: int, pages: int) -> list[int | None]:
    """First, last and two to each side of the current page; None for a gap."""
    shown = sorted({1, pages} | {p for p in range(current - 2, current + 3) if 1 <= p <= pages})
    out: list[int | None] = []
    for before, p in zip([None, *shown], shown, strict=False):
        if before and p - before > 1:
            out.append(None)
        out.append(p)
    return out


def pages_of(total: int, size: int = PAGE_SIZE) -> int:
    return max(1, math.ceil(total / size))


def public_holdings(holdings: DataFrame, companies: DataFrame) -> DataFrame:
    """Approved holdings of approved companies, with what a portfolio shows of the company."""
    shown = visible(companies).select("company_id", F.col("slug").alias("company_slug"), F.col("name").alias("company_name"), "sector")
    return visible(holdings).select("holding_id", "investor_id", "company_id").join(shown, "company_id")


def _sectors(rows: Column) -> Column:
    return F.array_sort(F.array_distinct(F.filter(F.transform(rows, lambda r: r["sector"]), lambda s: s.isNotNull() & (s != ""))))


def investor_portfolios(investors: DataFrame, holdings: DataFrame, companies: DataFrame, sample: int | None = 6) -> DataFrame:
    """Approved investors with portfolio_count (public holdings), the portfolio (a sample in the order of names, or all) and its sectors.

    The sample is taken before rows meet in a list, so a list is at most that long; the sectors are those of the list.
    """
    public = public_holdings(holdings, companies)
    counts = public.groupBy("investor_id").agg(F.count("*").alias("portfolio_count"))
    if sample is not None:
        ranked = Window.partitionBy("investor_id").orderBy("company_name", "company_slug", "holding_id")
        public = public.withColumn("rank", F.row_number().over(ranked)).where(F.col("rank") <= sample)
    listed = public.groupBy("investor_id").agg(F.array_sort(F.collect_list(F.struct("company_name", "company_slug", "sector"))).alias("portfolio"))
    empty = F.array().cast("array<struct<company_name:string,company_slug:string,sector:string>>")
    out = visible(investors).join(counts, "investor_id", "left").join(listed, "investor_id", "left")
    out = out.withColumn("portfolio_count", F.coalesce("portfolio_count", F.lit(0))).withColumn("portfolio", F.coalesce("portfolio", empty))
    return out.withColumn("sectors", _sectors(F.col("portfolio")))


def find_investors(investors: DataFrame, q: str | None = None, kind: str | None = None) -> DataFrame:
    checked(kind, v.INVESTOR_TYPES, "type")
    out = visible(investors)
    if q:
        out = out.where(holds(F.col("name"), q))
    return out if kind is None else out.where(F.col("type") == kind)


def investor_page(investors: DataFrame, holdings: DataFrame, companies: DataFrame, sort: str | None = None, page: int = 1, size: int = PAGE_SIZE, **facets) -> DataFrame:
    """A page of investors with their portfolio sample. The default order counts all holdings, public or not; then by name."""
    checked(sort, v.INVESTOR_SORTS, "sort")
    found = find_investors(investors, **facets)
    every = holdings.groupBy("investor_id").agg(F.count("*").alias("all_holdings"))
    ordered = found.join(every, "investor_id", "left").withColumn("all_holdings", F.coalesce("all_holdings", F.lit(0)))
    order = [F.asc("name"), F.asc("slug")] if sort == "name" else [F.desc("all_holdings"), F.asc("name"), F.asc("slug")]
    chosen = page_of(ordered, order, page, size)
    # a page is at most a hundred investors: only their holdings are joined
    own = holdings.join(F.broadcast(chosen.select("investor_id")), "investor_id", "left_semi")
    return investor_portfolios(chosen, own, companies).orderBy(*order)


def slugs(df: DataFrame, newest_first: bool = False) -> DataFrame:
    order = [F.desc("updated_at"), F.asc("slug")] if newest_first else [F.asc("slug")]
    return visible(df).select("slug", "updated_at").orderBy(*order)


def sitemap(companies: DataFrame, investors: DataFrame, site: str, static_paths: list[str]) -> DataFrame:
    """(url, last_modified) of static pages, sectors, companies and investors."""
    spark = companies.sparkSession
    static = spark.createDataFrame([(p,) for p in static_paths], "path string").select(F.concat(F.lit(site), "path").alias("url"), F.lit(None).cast("timestamp_ntz").alias("last_modified"))
    sectors = spark.createDataFrame([(s,) for s in v.SECTORS], "name string").select(F.concat(F.lit(f"{site}/markets/"), kebab(F.col("name"))).alias("url"), F.lit(None).cast("timestamp_ntz").alias("last_modified"))
    rows = [visible(df).select(F.concat(F.lit(f"{site}/{kind}/"), "slug").alias("url"), F.col("updated_at").alias("last_modified")) for kind, df in (("companies", companies), ("investors", investors))]
    return static.unionByName(sectors).unionByName(rows[0]).unionByName(rows[1])


def sector_by_slug(slug: str) -> str | None:
    """The sector that a page's address names."""
    import re

    return next((s for s in v.SECTORS if re.sub(r"[^a-z0-9]+", "-", s.lower()).strip("-") == slug), None)
