"""Knowledge-graph extracts: bindings landed as JSON, the same questions asked of a table of triples, and the records made of them."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from capstrata.functions import text, values
from capstrata.functions import vocabulary as v
from capstrata.session import materialised

# Properties of the graph, and below the sentences of records made of it.
_BINDING = "array<map<string, struct<type: string, value: string>>>"
INVESTED, INSTANCE, SUBCLASS, FOUNDER, HEAD, OWNER, START = "P1951", "P31", "P279", "P112", "P169", "P127", "P580"
DETAILS = {"website": "P856", "inception": "P571", "hq": "P159", "country": "P17", "industry": "P452", "employees": "P1128", "linkedinId": "P4264"}


def read_bindings(spark: SparkSession, path: str, variables: list[str], lines: bool = False) -> DataFrame:
    """One row for each binding of landed results: seq in the order of the result, and a string column for each variable.

    A file is one result, or has one on each line (`lines`). A result is held whole, so lines of many small ones bound
    what a task holds, however large the file.
    """
    results = spark.read.schema(f"results struct<bindings: {_BINDING}>").option("multiLine", not lines).json(path)
    rows = results.select(F.posexplode("results.bindings").alias("seq", "b"))
    return rows.select("seq", *[F.try_element_at("b", F.lit(name))["value"].alias(name) for name in variables])


def chunks(ids: DataFrame, size: int = 200) -> DataFrame:
    """ids (qid) with the chunk that each falls in; chunks are by hash, without order, and hold about `size` ids each."""
    n = max(1, -(-ids.count() // size))
    return ids.withColumn("chunk", F.pmod(F.xxhash64("qid"), F.lit(n)))


# --- the questions, over triples (subject, property, object, statement) -----


def _with(triples: DataFrame, prop: str, subject: str, value: str) -> DataFrame:
    return triples.where(F.col("property") == prop).select(F.col("subject").alias(subject), F.col("object").alias(value))


def seed_companies(triples: DataFrame) -> DataFrame:
    """Distinct companies that someone has invested in."""
    return _with(triples, INVESTED, "company", "x").select("company").distinct()


def company_details(companies: DataFrame, triples: DataFrame) -> DataFrame:
    """Companies (their first column) with what is known of them; each fact may be absent, and several of one repeat the row.

    The facts of a company are gathered in one pass over the triples, a list for each property; a fact without a value is
    none. Lists are as long as one company's values of one property.
    """
    key = companies.columns[0]
    facts = triples.where(F.col("property").isin(*DETAILS.values()))
    listed = facts.groupBy(F.col("subject").alias(key)).agg(*[F.collect_list(F.when(F.col("property") == prop, F.col("object"))).alias(name) for name, prop in DETAILS.items()])
    out = companies.join(listed, key, "left")
    for name in DETAILS:
        out = out.withColumn(name, F.explode_outer(name))
    return out


#: Parts that a fixpoint gathers before they are written as one.
_PARTS = 16


def subclasses(triples: DataFrame, roots: list[str]) -> DataFrame:
    """(class) of all classes below the roots, the roots included, however far below; cycles end.

    A semi-naive fixpoint: in each round the classes right below those of the last round, without those seen before,
    until there are none.
    """
    edges = materialised(triples.where(F.col("property") == SUBCLASS).select(F.col("object").alias("above"), F.col("subject").alias("class")).where("above is not null and class is not null").distinct())
    latest = triples.sparkSession.createDataFrame([(r,) for r in roots], "class string").distinct()
    seen, parts = latest, 1
    while True:
        latest = materialised(edges.join(latest.withColumnRenamed("class", "above"), "above").select("class").distinct().join(seen, "class", "left_anti"))
        if latest.isEmpty():
            return seen
        seen, parts = seen.unionByName(latest), parts + 1
        if parts > _PARTS:
            seen, parts = materialised(seen), 1


def investor_edges(companies: DataFrame, triples: DataFrame) -> DataFrame:
    """(company, investor, class): without lenders named one by one, and without those of excluded classes or classes below them."""
    edges = companies.join(_with(triples, INVESTED, "company", "investor"), "company").where(~F.col("investor").isin(*v.EXCLUDED_INVESTORS))
    classes = _with(triples, INSTANCE, "investor", "class")
    barred = classes.join(subclasses(triples, list(v.EXCLUDED_CLASSES)), "class", "left_semi").select("investor").distinct()
    return edges.join(barred, "investor", "left_anti").join(classes, "investor", "left").select("company", "investor", "class")


def firm_universe(triples: DataFrame) -> DataFrame:
    """(investor, class) of all entities of an investor's class."""
    return _with(triples, INSTANCE, "investor", "class").where(F.col("class").isin(*v.FIRM_CLASSES))


def people_of(companies: DataFrame, triples: DataFrame) -> DataFrame:
    """(company, person, role, start): founders, and heads with the start of their term where it is known."""
    founders = companies.join(_with(triples, FOUNDER, "company", "person"), "company").select("company", "person", F.lit("Founder").alias("role"), F.lit(None).cast("string").alias("start"))
    heads = triples.where(F.col("property") == HEAD).select(F.col("subject").alias("company"), F.col("object").alias("person"), "statement")
    terms = triples.where(F.col("property") == START).select(F.col("subject").alias("statement"), F.col("object").alias("start"))
    led = companies.join(heads, "company").join(terms, "statement", "left").select("company", "person", F.lit("CEO").alias("role"), "start")
    return founders.unionByName(led)


def owned_since(companies: DataFrame, triples: DataFrame, owner: str, target: str) -> DataFrame:
    """(owner, target, date): who owns what since when, where either is among companies under its own name; the date is required."""
    owned = triples.where(F.col("property") == OWNER).select(F.col("subject").alias(target), F.col("object").alias(owner), "statement")
    since = triples.where(F.col("property") == START).select(F.col("subject").alias("statement"), F.col("object").alias("date"))
    return companies.join(owned, companies.columns[0]).join(since, "statement").drop("statement").where("date is not null")


def exits_of(companies: DataFrame, triples: DataFrame, listed: DataFrame, offered: DataFrame) -> DataFrame:
    """(company, kind, acquirer, date): purchases with a date, offerings with or without, and the start of listings."""
    bought = owned_since(companies, triples, "acquirer", "company").select("company", F.lit("acq").alias("kind"), "acquirer", "date")
    none = F.lit(None).cast("string").alias("acquirer")
    parts = [companies.join(df, "company").select("company", F.lit("ipo").alias("kind"), none, "date") for df in (offered, listed)]
    return reduce(DataFrame.unionByName, [bought, *parts])


def bindings(triples: DataFrame, labels: DataFrame, listed: DataFrame, offered: DataFrame, limit: int | None = None) -> list[DataFrame]:
    """The five lists of bindings of all companies that someone has invested in: details, investors, people, acquisitions, exits.

    labels: id, label. With a limit, the first so many companies by length and then text of their id. Rows are numbered
    by their values, so that the first of a key is always the same. The triples and the companies are materialised, as
    each list asks for them.
    """
    triples = materialised(triples)
    seed = seed_companies(triples)
    if limit is not None:
        seed = seed.orderBy(F.length("company"), "company").limit(limit)
    seed = materialised(seed)

    def named(rows: DataFrame, names: dict[str, str]) -> DataFrame:
        for column, label in names.items():
            rows = rows.join(labels.select(F.col("id").alias(column), F.col("label").alias(label)), column, "left")
        return rows.withColumn("seq", F.to_json(F.struct(*sorted(rows.columns))))

    details = named(company_details(seed, triples), {"company": "companyLabel", "hq": "hqLabel", "country": "countryLabel", "industry": "industryLabel"}).withColumn("companyDescription", F.lit(None).cast("string"))
    return [
        details,
        named(investor_edges(seed, triples), {"investor": "investorLabel"}),
        named(people_of(seed, triples), {"person": "personLabel"}),
        named(owned_since(seed, triples, "company", "target"), {"target": "targetLabel"}),
        named(exits_of(seed, triples, listed, offered), {"acquirer": "acquirerLabel"}),
    ]


# --- records of bindings ------------------------------------------------------


def _first(rows: DataFrame, key: list[str]) -> DataFrame:
    rest = [c for c in rows.columns if c not in key]
    return rows.groupBy(*key).agg(F.min_by(F.struct(*rest), "seq").alias("r")).select(*key, "r.*")


def _listed(rows: DataFrame, name: str, fields: list[Column]) -> DataFrame:
    each = rows.groupBy("qid").agg(F.array_sort(F.collect_list(F.struct(F.col("seq").isNull().alias("last"), "seq", *fields))).alias("x"))
    return each.select("qid", F.transform("x", lambda r: r.dropFields("last", "seq")).alias(name))


def typed_investors(rows: DataFrame, key: list[str]) -> DataFrame:
    """One row for each key of (…, label, class, seq): the first label, and the type of all its classes; Venture without one.

    Rows whose label is none are left out before, as they are no investor.
    """
    return rows.groupBy(*key).agg(F.min_by("label", "seq").alias("name"), F.min("seq").alias("seq"), F.collect_set("class").alias("classes")).withColumn("type", F.coalesce(text.investor_type_of_classes(F.col("classes")), F.lit("Venture")))


def company_investors(bindings: DataFrame) -> DataFrame:
    rows = bindings.select("seq", text.qid_of(F.col("company")).alias("qid"), text.qid_of(F.col("investor")).alias("inv"), text.label_of(F.col("investorLabel")).alias("label"), text.qid_of(F.col("class")).alias("class"))
    typed = typed_investors(rows.where("qid is not null and inv is not null and label is not null"), ["qid", "inv"])
    return _listed(typed, "investors", [values.external_id(F.col("qid"), "investor", F.col("inv")).alias("external_id"), F.col("inv").alias("investor_external_id"), F.col("name"), F.col("type"), F.lit(v.UNDISCLOSED).alias("first_round"), F.lit(1).alias("rounds")])


def company_people(bindings: DataFrame, founded: DataFrame, as_of: Column) -> DataFrame:
    """The first row of each person and role; since is the start's year, else the company's founding, else this year. founded: qid, founded."""
    rows = bindings.select("seq", text.qid_of(F.col("company")).alias("qid"), text.qid_of(F.col("person")).alias("person"), text.label_of(F.col("personLabel")).alias("name"), F.nullif(F.col("role"), F.lit("")).alias("role"), F.col("start"))
    once = _first(rows.where("qid is not null and person is not null and name is not null and role is not null"), ["qid", "person", "role"]).join(founded, "qid", "left")
    since = F.coalesce(values.year_of(F.col("start")), F.nullif(F.col("founded"), F.lit(0)), F.year(as_of))
    return _listed(once, "people", [values.external_id(F.col("qid"), "person", F.col("person"), F.col("role")).alias("external_id"), F.col("name"), F.col("role"), F.lit(None).cast("string").alias("title"), since.alias("since")])


def company_acquisitions(bindings: DataFrame) -> DataFrame:
    rows = bindings.select("seq", text.qid_of(F.col("company")).alias("qid"), text.qid_of(F.col("target")).alias("t"), text.label_of(F.col("targetLabel")).alias("target"), values.iso_date(F.substring("date", 1, 10)).alias("date"))
    once = _first(rows.where("qid is not null and t is not null and target is not null and date is not null"), ["qid", "t"])
    return _listed(once, "acquisitions", [values.external_id(F.col("qid"), "acq", F.col("t")).alias("external_id"), F.col("target"), F.try_to_date("date").alias("date"), F.lit(None).cast("double").alias("amount_usd"), F.lit("Acquisition recorded on Wikidata.").alias("rationale")])


def company_exits(bindings: DataFrame) -> DataFrame:
    """The first dated purchase by each acquirer, then one public offering at its earliest date; undated rows count for nothing."""
    rows = bindings.select("seq", text.qid_of(F.col("company")).alias("qid"), F.col("kind"), text.qid_of(F.col("acquirer")).alias("a"), text.label_of(F.col("acquirerLabel")).alias("label"), values.iso_date(F.substring("date", 1, 10)).alias("date")).where("qid is not null and date is not null")
    bought = _first(rows.where("kind = 'acq' and a is not null"), ["qid", "a"]).select("qid", "seq", values.external_id(F.col("qid"), "exit", "acq", F.col("a")).alias("external_id"), F.lit("Acquisition").alias("type"), "date", F.coalesce(F.concat(F.lit("Acquired by "), F.col("label"), F.lit(".")), F.lit("Acquired.")).alias("detail"))
    offered = rows.where("kind = 'ipo'").groupBy("qid").agg(F.min("date").alias("date")).select("qid", F.lit(None).cast(bought.schema["seq"].dataType).alias("seq"), values.external_id(F.col("qid"), "exit", "ipo").alias("external_id"), F.lit("IPO").alias("type"), "date", F.lit("Initial public offering.").alias("detail"))
    return _listed(bought.unionByName(offered), "exits", [F.col("external_id"), F.col("type"), F.try_to_date("date").alias("date"), F.lit(None).cast("double").alias("value_usd"), F.col("detail")])


def records(details: DataFrame, investors: DataFrame, people: DataFrame, acquisitions: DataFrame, exits: DataFrame, as_of: Column) -> DataFrame:
    """Normalised records of five lists of bindings: one for each company with a label, of its first row of details."""
    d = details.select(
        "seq",
        text.qid_of(F.col("company")).alias("qid"),
        text.label_of(F.col("companyLabel")).alias("name"),
        F.coalesce("companyDescription", F.lit("")).alias("raw"),
        "website",
        "linkedinId",
        F.coalesce(values.year_of(F.col("inception")), F.lit(0)).alias("founded"),
        text.comma_joined(F.coalesce(text.label_of(F.col("hqLabel")), F.lit("")), F.coalesce(text.label_of(F.col("countryLabel")), F.lit(""))).alias("hq"),
        text.label_of(F.col("industryLabel")).alias("industry"),
        F.coalesce(values.positive_number(F.col("employees")), F.lit(0)).cast("int").alias("headcount"),
    ).where("qid is not null")
    d = _first(d, ["qid"]).where("name is not null")
    lists = [company_investors(investors), company_people(people, d.select("qid", "founded"), as_of), company_acquisitions(acquisitions), company_exits(exits)]
    for part in lists:
        name = part.columns[1]
        d = d.join(part, "qid", "left").withColumn(name, F.coalesce(name, F.array().cast(part.schema[name].dataType)))
    ipo = F.exists("exits", lambda e: e["type"] == "IPO")
    bought = F.exists("exits", lambda e: e["type"] == "Acquisition")
    one_liner = F.when(F.col("raw") != "", text.capitalize(F.col("raw"))).otherwise(F.concat("name", F.lit(" — profile sourced from Wikidata.")))
    company = F.struct(
        F.col("name"),
        F.coalesce("hq", F.lit(v.UNDISCLOSED)).alias("hq"),
        F.col("founded"),
        F.array_compact(F.array("industry")).alias("industry"),
        F.when(ipo, "Public").when(bought, "Acquired").otherwise("Late stage").alias("stage"),
        F.lit(0.0).alias("total_raised_usd"),
        text.hostname(F.col("website")).alias("domain"),
        F.col("website").alias("website_url"),
        F.concat(F.lit("https://www.linkedin.com/company/"), "linkedinId").alias("linkedin_url"),
        text.sector_of_text(F.concat_ws(" ", "industry", "raw")).alias("primary_sector"),
        one_liner.alias("one_liner"),
        text.company_description(F.col("name"), one_liner, F.col("founded"), F.col("hq"), F.transform("investors", lambda i: i["name"])).alias("description"),
        F.col("headcount"),
        F.when(ipo, "Public").when(bought, "Acquired").otherwise("Private").alias("status"),
    )
    return d.select(F.lit(v.WIKIDATA).alias("source"), F.col("qid").alias("company_external_id"), "seq", company.alias("company"), "investors", "people", "acquisitions", "exits")


def firms(bindings: DataFrame) -> DataFrame:
    """Investor firms of class-enumerated bindings: the first row's facts, the type of all classes; rows without a label are left out."""
    rows = bindings.select("seq", text.qid_of(F.col("investor")).alias("qid"), text.qid_of(F.col("class")).alias("class"), text.label_of(F.col("investorLabel")).alias("label"), *[F.col(c) for c in ("investorDescription", "website", "linkedinId", "hqLabel", "countryLabel", "aum", "inception")]).where("qid is not null")
    kinds = rows.groupBy("qid").agg(F.collect_set("class").alias("classes"))
    once = _first(rows.drop("class"), ["qid"]).where("label is not null").join(kinds, "qid")
    hq = text.comma_joined(F.coalesce(text.label_of(F.col("hqLabel")), F.lit("")), F.coalesce(text.label_of(F.col("countryLabel")), F.lit("")))
    return once.select(
        F.col("qid").alias("external_id"),
        F.col("label").alias("name"),
        F.coalesce(text.investor_type_of_classes(F.col("classes")), F.lit("Venture")).alias("type"),
        hq.alias("hq"),
        F.col("website").alias("website_url"),
        text.identifying_domain(F.col("website")).alias("domain"),
        F.concat(F.lit("https://www.linkedin.com/company/"), "linkedinId").alias("linkedin_url"),
        F.when(F.coalesce("investorDescription", F.lit("")) != "", text.capitalize(F.col("investorDescription"))).alias("description"),
        values.positive_number(F.col("aum")).alias("assets_usd"),
        values.year_of(F.col("inception")).alias("founded_year"),
        "seq",
    )
