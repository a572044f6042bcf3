"""Scalar functions on names, hosts, labels and display strings, all as Column expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from capstrata.functions import vocabulary as v

#: White space as web clients see it, beyond ASCII too.
_WS = r"\s\p{Z}\x{FEFF}"


def blank_to_null(c: Column) -> Column:
    trimmed = F.trim(c)
    return F.when(trimmed != "", trimmed)


def kebab(name: Column, fallback: str = "company") -> Column:
    """Lower case, runs of other characters than a-z and 0-9 as one hyphen, none at the ends; the fallback if nothing is left."""
    slug = F.btrim(F.regexp_replace(F.lower(name), "[^a-z0-9]+", "-"), F.lit("-"))
    return F.coalesce(F.nullif(slug, F.lit("")), F.lit(fallback))


def _squeeze(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, f"[{_WS}]+", " "))


def _without_legal(c: Column, forms: tuple[str, ...]) -> Column:
    """Trailing legal forms go while a word is left."""
    return F.regexp_replace(c, f"( ({'|'.join(forms)}))+$", "")


def company_name_key(name: Column) -> Column:
    """Punctuation deleted, legal forms dropped from the end: the key by which company names match."""
    plain = _squeeze(F.regexp_replace(F.lower(name), f"[^a-z0-9{_WS}]+", ""))
    return _without_legal(plain, v.COMPANY_LEGAL)


def investor_name_key(name: Column) -> Column:
    """Punctuation as a space, runs of single letters glued together, legal forms dropped from the end.

    Each single letter is put in brackets (spaces are doubled first, so that neighbours do not share one); touching
    brackets then join what belongs together.
    """
    plain = _squeeze(F.regexp_replace(F.lower(name), f"[^a-z0-9{_WS}]+", " "))
    spaced = F.concat(F.lit(" "), F.replace(plain, F.lit(" "), F.lit("  ")), F.lit(" "))
    marked = F.replace(F.regexp_replace(spaced, " ([a-z0-9]) ", "<$1>"), F.lit("><"), F.lit(""))
    return _without_legal(F.trim(F.regexp_replace(marked, "[<> ]+", " ")), v.INVESTOR_LEGAL)


def title_case_firm(name: Column) -> Column:
    """Words of a firm's name: legal forms, roman numerals and short words without a vowel in capitals, others capitalised."""

    def word(w: Column) -> Column:
        bare = F.regexp_replace(w, "[^A-Za-z.]", "")
        upper = F.upper(w)
        roman = upper.rlike(r"^[IVXLCDM]+\.?$") & (F.length(w) > 1)
        initials = F.length(bare).between(2, 4) & ~bare.rlike("(?i)[aeiouy]")
        runs = F.regexp_extract_all(F.lower(w), F.lit("[a-z][a-z']*|[^a-z]+"), 0)
        capitalised = F.array_join(F.transform(runs, lambda r: F.when(r.rlike("^[a-z]"), F.concat(F.upper(F.substring(r, 1, 1)), F.substring(r, 2, 1_000_000))).otherwise(r)), "")
        return F.when(upper.isin(*v.KEEP_UPPER) | F.upper(bare).isin(*v.KEEP_UPPER) | roman | initials, upper).otherwise(capitalised)

    return F.array_join(F.transform(F.split(_squeeze(name), " "), word), " ")


def capitalize(c: Column) -> Column:
    return F.concat(F.upper(F.substring(c, 1, 1)), F.substring(c, 2, 1_000_000))


def _schemed(url: Column) -> Column:
    value = F.trim(F.coalesce(url, F.lit("")))
    return F.when(value == "", value).when(value.rlike("(?i)^https?://"), value).otherwise(F.concat(F.lit("https://"), value))


def host_of(url: Column) -> Column:
    """Host of a url whose scheme may be missing: lower case, no `www.`; empty unless it is a name with a dot."""
    rest = F.regexp_replace(_schemed(url), "(?i)^https?://", "")
    authority = F.regexp_extract(rest, r"^[^/?#\\]*", 0)
    host = F.lower(F.regexp_replace(F.regexp_replace(authority, "^.*@", ""), r":[0-9]*$", ""))
    host = F.regexp_replace(host, r"^www\.", "")
    return F.when(host.contains(".") & ~host.rlike(r"""[\s<>^|%:\[\]"`{}]"""), host).otherwise("")


def hostname(url: Column) -> Column:
    """Host of a url that has a scheme, lower case, no `www.`; empty without one."""
    host = F.regexp_extract(F.coalesce(url, F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#\\]*)", 1)
    host = F.lower(F.regexp_replace(F.regexp_replace(host, "^.*@", ""), r":[0-9]*$", ""))
    return F.when(host.rlike(r"""[\s<>^|%"`{}]"""), "").otherwise(F.regexp_replace(host, r"^www\.", ""))


def _at_host(host: Column, hosts: tuple[str, ...]) -> Column:
    """Whether a host is one of the list or below one: a single pattern, so that the host is worked out once."""
    names = "|".join(h.replace(".", r"\.") for h in hosts)
    return host.rlike(rf"(?:^|\.)(?:{names})$")


def is_linkedin(host: Column) -> Column:
    return _at_host(host, ("linkedin.com",))


def is_social(host: Column) -> Column:
    return _at_host(host, v.SOCIAL_HOSTS)


def is_platform(host: Column) -> Column:
    return _at_host(host, v.PLATFORM_HOSTS)


def _own_host(host: Column) -> Column:
    return F.when((host != "") & ~_at_host(host, ("linkedin.com", *v.SOCIAL_HOSTS, *v.PLATFORM_HOSTS)), host)


def identifying_domain(url: Column) -> Column:
    """The host, unless it belongs to a network or platform rather than to the firm; null then."""
    return _with(host_of(url), _own_host)


def _with(value: Column, then) -> Column:
    """then(value), with the value bound as a lambda's variable so that it is worked out once."""
    return F.element_at(F.transform(F.array(value), then), 1)


def classify_website(cell: Column) -> Column:
    """(website_url, linkedin_url, domain) of the one cell that filers put any link into."""

    def links(both: Column) -> Column:
        host, url = both["host"], both["url"]
        there, linkedin = host != "", is_linkedin(host)
        return F.struct(F.when(there & ~linkedin & ~is_social(host), url).alias("website_url"), F.when(there & linkedin, url).alias("linkedin_url"), _own_host(host).alias("domain"))

    url = F.regexp_replace(F.regexp_replace(_schemed(cell), "(?i)^https://", "https://"), "(?i)^http://", "http://")
    return _with(F.struct(host_of(cell).alias("host"), url.alias("url")), links)


def sector_of_text(text: Column) -> Column:
    """The sector of the first rule that the text holds a word of; null if none."""


    def of(lowered: Column) -> Column:
        out = F.when(F.lit(False), "")
        for words, sector in v.SECTOR_WORDS:
            out = out.when(reduce(Column.__or__, (F.contains(lowered, F.lit(w)) for w in words.split("|"))), sector)
        return out

    # A-Z alone are lowered, once for all words
    return _with(F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), of)


def sector_of_industry(industry: Column) -> Column:
    known = [F.lit(x) for pair in v.INDUSTRY_SECTORS.items() if pair[1] for x in pair]
    return F.try_element_at(F.create_map(*known), industry)


def investor_type_of_classes(classes: Column) -> Column:
    """The type of the most telling class among them; null if none is known."""
    out = F.when(F.lit(False), "")
    for qid, kind in v.INVESTOR_CLASSES:
        out = out.when(F.array_contains(classes, qid), kind)
    return out


def qid_of(uri: Column) -> Column:
    return F.nullif(F.regexp_extract(uri, r"(?:^|/)(Q[0-9]+)$", 1), F.lit(""))


def label_of(label: Column) -> Column:
    """A trimmed label; null if empty or a bare identifier."""
    value = F.trim(label)
    return F.when((value != "") & ~value.rlike("^Q[0-9]+$"), value)


def comma_joined(*parts: Column) -> Column:
    """Non-empty parts joined by a comma; null if there is none."""
    return F.nullif(F.concat_ws(", ", *(blank_to_null(p) for p in parts)), F.lit(""))


def comma_list(c: Column) -> Column:
    """The non-empty trimmed items of a comma-separated cell."""
    return F.filter(F.transform(F.split(F.coalesce(c, F.lit("")), ","), lambda x: F.trim(x)), lambda x: x != "")


def filing_url(cik: Column, accession: Column) -> Column:
    return F.concat(F.lit("https://www.sec.gov/Archives/edgar/data/"), cik, F.lit("/"), F.replace(accession, F.lit("-"), F.lit("")), F.lit("/primary_doc.xml"))


def filer_url(cik: Column) -> Column:
    return F.concat(F.lit("https://www.sec.gov/cgi-bin/browse-edgar?action=getcompany&CIK="), cik, F.lit("&type=D"))


def adviser_url(crd: Column) -> Column:
    return F.concat(F.lit("https://adviserinfo.sec.gov/firm/summary/"), crd)


def entity_url(qid: Column) -> Column:
    return F.concat(F.lit("https://www.wikidata.org/wiki/"), qid)


def firm_description(name: Column, kind: Column, funds: Column, hq: Column) -> Column:
    noun = F.when(kind == "Venture", "venture capital firm").when(kind == "Private equity", "private equity firm").when(kind == "Hedge fund", "hedge fund manager").otherwise("investment firm")
    where = F.when(hq.isNotNull(), F.concat(F.lit(" based in "), hq)).otherwise("")
    count = F.when(funds > 0, F.concat(F.lit(" It reports "), funds.cast("long").cast("string"), F.when(funds == 1, " private fund").otherwise(" private funds"), F.lit(" to the SEC."))).otherwise("")
    return F.concat(name, F.lit(" is a "), noun, where, F.lit(", registered as an investment adviser with the SEC."), count)


def company_description(name: Column, one_liner: Column, founded: Column, hq: Column, backers: Column) -> Column:
    """Sentences from what is known; of the backers the first five."""
    backed = F.when(F.size(backers) > 0, F.concat(F.lit("Backed by "), F.array_join(F.slice(backers, 1, 5), ", "), F.when(F.size(backers) > 5, " and others").otherwise(""), F.lit(".")))
    return F.concat_ws(
        " ",
        F.when(one_liner.endswith("."), one_liner).otherwise(F.concat(one_liner, F.lit("."))),
        F.when(founded > 0, F.concat(F.lit("Founded in "), founded.cast("string"), F.lit("."))),
        F.when(F.coalesce(hq, F.lit("")) != "", F.concat(F.lit("Headquartered in "), hq, F.lit("."))),
        backed,
        F.concat(F.lit("Profile for "), name, F.lit(" enriched from Wikidata.")),
    )


def summary(parts: list[Column], most: int) -> Column:
    """Facts joined by middle dots, cut to `most` characters with an ellipsis for the last."""
    text = F.concat_ws(" · ", *parts)
    return F.when(F.char_length(text) > most, F.concat(F.rtrim(F.substring(text, 1, most - 1)), F.lit("…"))).otherwise(text)


def _one_decimal(x: Column) -> Column:
    """Half up in the last place, a zero in it left out."""
    tenths = F.floor(x * 10 + 0.5)
    whole = F.floor(tenths / 10).cast("long").cast("string")
    return F.when(tenths % 10 == 0, whole).otherwise(F.concat(whole, F.lit("."), (tenths % 10).cast("long").cast("string")))


def format_usd(amount: Column) -> Column:
    """$ with B, M or K and at most one decimal; Undisclosed for null. amount: whole dollars."""
    scaled = lambda by, unit: F.concat(F.lit("$"), _one_decimal(amount / by), F.lit(unit))
    return (
        F.when(amount.isNull(), v.UNDISCLOSED)
        .when(amount >= 1_000_000_000, scaled(1_000_000_000, "B"))
        .when(amount >= 1_000_000, scaled(1_000_000, "M"))
        .when(amount >= 1_000, scaled(1_000, "K"))
        .otherwise(F.concat(F.lit("$"), amount.cast("string")))
    )


def format_count(n: Column) -> Column:
    return F.format_number(n, 0)


def signed_percent(x: Column) -> Column:
    shown = F.when(x == F.floor(x), x.cast("long").cast("string")).otherwise(x.cast("string"))
    return F.concat(F.when(x > 0, "+").otherwise(""), shown, F.lit("%"))


def organization_json(name: Column, url: Column, founded: Column, same_as: Column) -> Column:
    """A structured-data document of an organisation; absent facts are left out."""
    return F.to_json(
        F.struct(
            F.lit("https://schema.org").alias("@context"),
            F.lit("Organization").alias("@type"),
            name.alias("name"),
            url.alias("url"),
            F.when(founded > 0, founded.cast("string")).alias("foundingDate"),
            F.when(F.size(same_as) > 0, same_as).alias("sameAs"),
        )
    )


def breadcrumb_json(crumbs: Column) -> Column:
    """A structured-data breadcrumb list of array<struct<name, url>>."""
    items = F.transform(crumbs, lambda c, i: F.struct(F.lit("ListItem").alias("@type"), (i + 1).alias("position"), c["name"].alias("name"), c["url"].alias("item")))
    return F.to_json(F.struct(F.lit("https://schema.org").alias("@context"), F.lit("BreadcrumbList").alias("@type"), items.alias("itemListElement")))
