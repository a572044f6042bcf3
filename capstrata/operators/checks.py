"""Invariants of the stored tables, reports, and validation of submitted rows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from capstrata.functions import vocabulary as v


def repeated(df: DataFrame, column: str) -> DataFrame:
    """Non-empty values of a column that several rows have."""
    return df.where(F.col(column).isNotNull() & (F.col(column) != "")).groupBy(column).agg(F.count("*").alias("n")).where("n > 1")


def invariants(companies: DataFrame, investors: DataFrame, holdings: DataFrame) -> DataFrame:
    """(check, violations): repeated slugs, shared domains, holdings without investor. All should be 0."""
    one = lambda name, df: df.agg(F.count("*").alias("violations")).select(F.lit(name).alias("check"), "violations")
    parts = [
        one("company slugs", repeated(companies, "slug")),
        one("investor slugs", repeated(investors, "slug")),
        one("company domains", repeated(companies, "domain")),
        one("holdings without investor", holdings.where("investor_id is null")),
    ]
    return reduce(DataFrame.unionByName, parts)


def type_histogram(investors: DataFrame) -> DataFrame:
    return investors.groupBy("type").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "type")


def row_counts(tables: dict[str, DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, [df.agg(F.count("*").alias("n")).select(F.lit(name).alias("table_name"), "n") for name, df in tables.items()])


def split_valid(rows: DataFrame, rules: dict[str, Column]) -> tuple[DataFrame, DataFrame]:
    """(rows that keep all rules, the others with the names of the rules they break in `reasons`). A rule that is null is broken."""
    broken = F.array_compact(F.array(*[F.when(~F.coalesce(rule, F.lit(False)), F.lit(name)) for name, rule in rules.items()]))
    marked = rows.withColumn("reasons", broken)
    return marked.where(F.size("reasons") == 0).drop("reasons"), marked.where(F.size("reasons") > 0)


def filled(c: str) -> Column:
    return F.trim(F.col(c)) != ""


def web_address(c: Column) -> Column:
    return c.rlike(r"^https?://[^\s/?#]+\.[^\s/?#]+")


def _optional(rule: Column, c: str) -> Column:
    return F.col(c).isNull() | rule


def _day(c: str) -> Column:
    return F.try_to_date(F.substring(F.col(c), 1, 10)).isNotNull()


def _money(c: str) -> Column:
    return _optional(F.col(c) >= 0, c)


def contribution_rules(kind: str) -> dict[str, Column]:
    """Rules of the rows that users submit, by kind. Optional cells may be null; a source, where given, is a web address."""
    rules = {
        "round": lambda: {"name": filled("name"), "date": _day("date"), "amount_usd": F.col("amount_usd") >= 0, "post_money_usd": _money("post_money_usd"), "investors": (F.size("investors") > 0) & F.forall("investors", lambda i: F.trim(i["name"]) != "")},
        "person": lambda: {"name": filled("name"), "role": filled("role"), "since": F.col("since").isNotNull(), "linkedin_url": _optional(web_address(F.col("linkedin_url")), "linkedin_url")},
        "investor": lambda: {"name": filled("name"), "type": F.col("type").isin(*v.INVESTOR_TYPES), "first_round": filled("first_round"), "rounds": F.col("rounds") >= 0, "website_url": _optional(web_address(F.col("website_url")), "website_url")},
        "acquisition": lambda: {"target": filled("target"), "date": _day("date"), "amount_usd": _money("amount_usd"), "rationale": filled("rationale")},
        "exit": lambda: {"type": F.col("type").isin(*v.EXIT_TYPES), "date": _day("date"), "value_usd": _money("value_usd"), "detail": filled("detail")},
        "diversity": lambda: {"label": filled("label"), "value": filled("value"), "note": filled("note")},
    }
    return rules[kind]() | {"source_url": _optional(web_address(F.col("source_url")), "source_url")}


def proposal_rules() -> dict[str, Column]:
    """Rules of an edit proposal's changes (map of field to JSON value): known fields, filled texts, known vocabularies, whole numbers."""
    at = lambda f: F.try_element_at("changes", F.lit(f))
    absent = lambda f: at(f).isNull()
    text = lambda f: F.trim(F.get_json_object(F.concat(F.lit('{"v":'), at(f), F.lit("}")), "$.v"))
    rules = {"fields": F.forall(F.map_keys("changes"), lambda k: k.isin(*v.EDIT_FIELDS)) & (F.size("changes") > 0)}
    rules |= {f: absent(f) | (text(f) != "") for f in ("name", "domain", "one_liner", "description", "hq")}
    rules |= {f: absent(f) | at(f).rlike(r"^-?\d+$") for f in ("founded",)} | {f: absent(f) | at(f).rlike(r"^\d+$") for f in ("headcount", "total_raised_usd")}
    rules |= {"last_valuation_usd": absent("last_valuation_usd") | (at("last_valuation_usd") == "null") | at("last_valuation_usd").rlike(r"^\d+$")}
    rules |= {"industry": absent("industry") | (F.size(F.from_json(at("industry"), "array<string>")) > 0)}
    for f, allowed, clears in (("status", v.COMPANY_STATUSES, False), ("stage", v.STAGES, False), ("operating_status", v.OPERATING_STATUSES, True), ("company_type", v.COMPANY_TYPES, True), ("primary_sector", v.SECTORS, True)):
        rules[f] = absent(f) | text(f).isin(*allowed) | (F.lit(clears) & (at(f) == "null"))
    return rules | {f: absent(f) | (at(f) == "null") | web_address(text(f)) for f in ("website_url", "linkedin_url", "twitter_url")}


def company_form_rules(year: int) -> dict[str, Column]:
    """Rules of the company form, whose cells are all strings. year: the last founding year that is accepted."""
    whole = lambda c, pattern: F.trim(F.col(c)).rlike(pattern)
    return {
        "name": filled("name"),
        "domain": whole("domain", r"^(?i)[a-z0-9-]+(\.[a-z0-9-]+)+$"),
        "one_liner": filled("one_liner") & (F.char_length(F.trim("one_liner")) <= 160),
        "description": filled("description"),
        "hq": filled("hq"),
        "founded": whole("founded", r"^\d{4}$") & F.trim(F.col("founded")).try_cast("int").between(1800, year),
        "headcount": whole("headcount", r"^\d+$"),
        "total_raised_usd": whole("total_raised_usd", r"^\d+$"),
        "last_valuation_usd": whole("last_valuation_usd", r"^\d*$"),
        "industry": filled("industry"),
        "primary_sector": F.col("primary_sector").isin(*v.SECTORS),
        "status": F.col("status").isin(*v.COMPANY_STATUSES),
        "stage": F.col("stage").isin(*v.STAGES),
        "source_url": (F.coalesce(F.trim("source_url"), F.lit("")) == "") | web_address(F.trim("source_url")),
    }
