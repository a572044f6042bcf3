"""Scalar functions on amounts, dates, arrays and recorded values."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def round_half_up(x: Column) -> Column:
    """To the nearest whole number, halves towards plus infinity."""
    return F.floor(x + 0.5).cast("long")


def trend_percent(recent: Column, prior: Column) -> Column:
    """Change in percent with one decimal, halves towards plus infinity; 0 without a prior."""
    return F.when(prior == 0, F.lit(0.0)).otherwise(F.floor((recent - prior) / prior * 1000 + 0.5) / 10)


def stage_of_amount(amount: Column) -> Column:
    out = F.when(amount < 5_000_000, "Seed")
    for below, stage in ((20_000_000, "Series A"), (60_000_000, "Series B"), (150_000_000, "Series C"), (400_000_000, "Series D")):
        out = out.when(amount < below, stage)
    return out.otherwise("Late stage")


def iso_date(c: Column) -> Column:
    """The string if it has the shape of a date."""
    return F.when(c.rlike(r"^\d{4}-\d{2}-\d{2}$"), c)


def safe_date(as_of: Column, *candidates: Column) -> Column:
    """The first candidate that is a date, as yyyy-MM-dd or yyyyMMdd; else as_of."""
    tried = []
    for c in candidates:
        tried += [F.try_to_date(iso_date(c)), F.try_to_date(F.when(c.rlike(r"^\d{8}$"), c), "yyyyMMdd")]
    return F.coalesce(*tried, as_of.cast("date"))


def year_of(c: Column) -> Column:
    year = F.substring(c, 1, 4).try_cast("int")
    return F.when(year > 0, year)


def positive_number(c: Column) -> Column:
    n = c.try_cast("double")
    return F.when((n > 0) & (n < float("inf")), round_half_up(n))


def roster_number(c: Column) -> Column:
    """A padded number with thousands separators; 0 for a blank cell and for what is no number."""
    return F.coalesce(F.regexp_replace(F.coalesce(c, F.lit("")), r"[,\s$]", "").try_cast("double"), F.lit(0.0))


def filing_number(c: Column) -> Column:
    """Digits and dots of a cell as a number; 0 where they are none."""
    return F.coalesce(F.regexp_replace(F.coalesce(c, F.lit("")), "[^0-9.]", "").try_cast("double"), F.lit(0.0))


def quarter_label(day: Column) -> Column:
    return F.concat(F.lit("Q"), F.quarter(day).cast("string"), F.lit(" "), F.year(day).cast("string"))


def unlocked_until(last: Column, days: int = 30) -> Column:
    return last + F.expr(f"interval {days} days")


def is_unlocked(last: Column, as_of: Column, admin: Column, days: int = 30) -> Column:
    """A profile is open to admins and for fewer than 30 days from a contribution."""
    return admin | F.coalesce(as_of < unlocked_until(last, days), F.lit(False))


def contributed_since(last: Column, as_of: Column, days: int = 30) -> Column:
    """Whether the last contribution is at most 30 days old; the bound counts."""
    return F.coalesce(last >= as_of - F.expr(f"interval {days} days"), F.lit(False))


def same_value(a: Column, b: Column) -> Column:
    return a.eqNullSafe(b)


def external_id(*parts: Column | str) -> Column:
    return F.concat_ws(":", *(F.lit(p) if isinstance(p, str) else p for p in parts))


def round_key(is_amendment: Column, previous: Column, accession: Column) -> Column:
    """An amendment that names the filing it amends takes that one's key."""
    return F.when(is_amendment & previous.isNotNull(), previous).otherwise(accession)


def shown_value(value: Column, field: Column, money_fields: tuple[str, ...], most: int = 140) -> Column:
    """A recorded JSON value for display: a dash for null, money and counts formatted, lists joined, long ones cut."""
    from capstrata.functions.text import format_count, format_usd

    plain = F.coalesce(F.get_json_object(value, "$"), value)
    number = plain.try_cast("long")
    items = F.from_json(value, "array<string>")
    text = (
        F.when(value.isNull() | (value == "null"), "—")
        .when(field.isin(*money_fields) & number.isNotNull(), format_usd(number))
        .when(number.isNotNull() & ~value.startswith('"'), format_count(number))
        .when(value.startswith("["), F.array_join(items, ", "))
        .otherwise(plain)
    )
    return F.when(F.char_length(text) > most, F.concat(F.substring(text, 1, most), F.lit("…"))).otherwise(text)


def json_value(value: Column, kind: str) -> Column:
    """A value as JSON text, by its type's name: texts in quotes, null as the JSON null, whether by itself or a field of a structure at any depth."""
    nulls = {"ignoreNullFields": "false"}
    listed = F.to_json(F.array(value), nulls)  # a list of one, whose brackets are cut off
    shown = F.to_json(value, nulls) if kind in ("array", "struct", "map") else F.substr(listed, F.lit(2), F.length(listed) - 2)
    return F.when(value.isNull(), F.lit("null")).otherwise(shown)


def date_only(at: Column) -> Column:
    """The day of a date or time, as yyyy-MM-dd."""
    return F.date_format(at, "yyyy-MM-dd")
