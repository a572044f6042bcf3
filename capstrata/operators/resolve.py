"""Entity resolution: which stored company or investor an incoming record is, by key, then domain, then name."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from capstrata.functions.text import investor_name_key
from capstrata.session import materialised


def match_index(stored: DataFrame, id_column: str, name_key: Column) -> dict[str, DataFrame]:
    """Three tables from a key, a domain or a normalised name to the first stored row that has it, by (created_at, id)."""
    order = F.struct("created_at", id_column)
    rows = stored.select(
        F.concat_ws(":", "external_source", "external_id").alias("key"),
        (F.col("external_source").isNotNull() & F.col("external_id").isNotNull()).alias("keyed"),
        F.nullif(F.col("domain"), F.lit("")).alias("domain"),
        F.nullif(name_key, F.lit("")).alias("name_key"),
        F.col(id_column).alias("id"),
        order.alias("o"),
    )
    first = lambda c, df: df.where(f"{c} is not null").groupBy(c).agg(F.min_by("id", "o").alias(f"by_{c}"))
    return {"key": first("key", rows.where("keyed")), "domain": first("domain", rows), "name_key": first("name_key", rows)}


def match(records: DataFrame, index: dict[str, DataFrame]) -> DataFrame:
    """records (key, domain, name_key) with matched_id and matched_by (key, domain, name or null): the first hit in that order."""
    out = records.join(index["key"], "key", "left").join(index["domain"], "domain", "left").join(index["name_key"], "name_key", "left")
    by = F.when(F.col("by_key").isNotNull(), "key").when(F.col("by_domain").isNotNull(), "domain").when(F.col("by_name_key").isNotNull(), "name")
    return out.withColumn("matched_id", F.coalesce("by_key", "by_domain", "by_name_key")).withColumn("matched_by", by).drop("by_key", "by_domain", "by_name_key")


def _first_open(open_: DataFrame, token: str) -> DataFrame:
    """(token, first_<token>): the first open record of each token."""
    return open_.where(F.col(token).isNotNull()).groupBy(token).agg(F.min("seq").alias(f"first_{token}"))


#: Rounds after which records that wait for one another in chains are settled along the chain.
CHAINS_AFTER = 3


def _single_waits(decided: DataFrame, maybe_new: DataFrame) -> DataFrame:
    """(seq, pred, token): the records that are new exactly if one other, pred, is not: they wait for it alone, by one token."""
    pairs = []
    for token in ("domain", "name_key"):
        few = Window.partitionBy(token).orderBy("seq")
        firsts = maybe_new.where(F.col(token).isNotNull()).select(token, "seq").withColumn("at", F.row_number().over(few)).where("at <= 2")
        two = firsts.groupBy(token).agg(F.min(F.when(F.col("at") == 1, F.col("seq"))).alias("first"), F.min(F.when(F.col("at") == 2, F.col("seq"))).alias("second"))
        waiting = decided.where(F.col("how").isNull() & F.col("by_domain").isNull() & F.col("by_name_key").isNull() & ~F.col("waits_key")).join(two, token)
        pairs.append(waiting.where(F.col("first") < F.col("seq")).select("seq", F.col("first").alias("pred"), F.lit(token).alias("token"), (F.col("second").isNull() | (F.col("second") >= F.col("seq"))).alias("alone")))
    both = pairs[0].unionByName(pairs[1])
    return both.groupBy("seq").agg(F.count("*").alias("n"), F.min("pred").alias("pred"), F.min("token").alias("token"), F.min("alone").alias("alone")).where("n = 1 and alone").select("seq", "pred", "token")


def _along_chains(decided: DataFrame) -> DataFrame:
    """decided with the outcome of the records of chains whose first record is new: every other one is, the rest are matched to the one before.

    The distance to a chain's first record is found by pointer jumping: as many steps as its length has binary digits.
    """
    waits = materialised(_single_waits(decided, decided.where("by_key is null and how is null or how = 'new'").where("by_domain is null and by_name_key is null")))
    links = waits.select("seq", F.col("pred").alias("to"), F.lit(1).cast("long").alias("steps"))
    while True:
        ahead = links.select(F.col("seq").alias("to"), F.col("to").alias("next"), F.col("steps").alias("more"))
        links = materialised(links.join(ahead, "to", "left").select("seq", F.coalesce("next", "to").alias("to"), (F.col("steps") + F.coalesce("more", F.lit(0))).alias("steps"), F.col("next").isNotNull().alias("moved")))
        if links.where("moved").isEmpty():
            break
        links = links.drop("moved")
    heads = decided.where("how = 'new'").select(F.col("seq").alias("to"))
    settled = links.join(heads, "to").join(waits, "seq").select("seq", F.col("pred").alias("__pred"), F.when(F.col("steps") % 2 == 0, "new").when(F.col("token") == "domain", "domain").otherwise("name").alias("__how"))
    named = lambda c: F.concat(F.lit("new:"), F.col(c).cast("string"))
    out = decided.join(settled, "seq", "left")
    entity = F.when(F.col("__how") == "new", named("seq")).when(F.col("__how").isNotNull(), named("__pred")).otherwise(F.col("entity_id"))
    return out.withColumns({"entity_id": entity, "how": F.coalesce("__how", "how")}).drop("__pred", "__how")


def _decided(open_: DataFrame, register_matches: bool) -> DataFrame:
    """open_ with entity_id and how, where no open record before a row can change them; else null. waits_key: whether one may change its key.

    open_: seq, key, domain, name_key, and for each of the three the entity that it stands for by now (by_…), which
    is final. A record that has one of the latter two by now will not be new, so it registers no domain or name, and
    no key unless matched ones do.
    """
    maybe_new = open_.where("by_domain is null and by_name_key is null")
    out = open_
    for token, rows in (("key", open_ if register_matches else maybe_new), ("domain", maybe_new), ("name_key", maybe_new)):
        out = out.join(_first_open(rows, token), token, "left")
    waits = {t: F.coalesce(F.col(f"first_{t}") < F.col("seq"), F.lit(False)) for t in ("key", "domain", "name_key")}
    none = F.lit(None).cast("string")
    cases = [(F.col("by_key").isNotNull(), "key", F.col("by_key")), (waits["key"], None, none), (F.col("by_domain").isNotNull(), "domain", F.col("by_domain")), (waits["domain"], None, none), (F.col("by_name_key").isNotNull(), "name", F.col("by_name_key")), (waits["name_key"], None, none)]
    entity, how = F.when(F.lit(False), none), F.when(F.lit(False), none)
    for condition, name, value in cases:
        entity, how = entity.when(condition, value), how.when(condition, F.lit(name).cast("string"))
    return out.withColumns({"entity_id": entity.otherwise(F.concat(F.lit("new:"), F.col("seq").cast("string"))), "how": how.otherwise("new"), "waits_key": F.col("by_key").isNull() & waits["key"]}).drop("first_key", "first_domain", "first_name_key")


def resolve(records: DataFrame, index: dict[str, DataFrame], register_matches: bool) -> DataFrame:
    """records with entity_id and how (key, domain, name, new): the outcome of taking them one by one in order of seq.

    records: seq (unique; anything that has an order, as a struct of record and place), key, domain, name_key, and
    further columns. A record that matches nothing is a new entity, named `new:<seq>`, under which its key, domain and name are registered for those after it. A matched record
    registers its key only if `register_matches` (so for investors, not for companies).

    Records are settled in rounds: in each, those of which no earlier open record can change the outcome, all at once;
    what they register is final and settles others in the next. Groups of any size that share a key, domain or name
    take two rounds or three. After so many, records that wait for one other each are settled along their chains, in
    steps by the logarithm of their length; only webs of records that wait for several others each take more rounds.
    """
    seen = match(records.select("seq", "key", "domain", "name_key"), index)
    first = seen.select("seq", "key", "domain", "name_key", F.when(F.col("matched_by") == "key", F.col("matched_id").cast("string")).alias("by_key"))
    for token in ("domain", "name_key"):
        first = first.join(index[token].withColumn(f"by_{token}", F.col(f"by_{token}").cast("string")), token, "left")
    open_, done = materialised(first), []
    while not open_.isEmpty():
        decided = materialised(_decided(open_, register_matches))
        if len(done) >= CHAINS_AFTER:
            decided = materialised(_along_chains(decided))
        settled = decided.where("how is not null")
        done.append(settled.select("seq", "entity_id", "how"))
        open_ = decided.where("how is null").drop("entity_id", "how", "waits_key")
        fresh = settled.where("how = 'new'")
        for token, rows in (("key", settled.where("how <> 'key'") if register_matches else fresh), ("domain", fresh), ("name_key", fresh)):
            # no two of a round register the same: the later one would have waited; what is registered counts for later records
            made = rows.where(F.col(token).isNotNull()).select(token, F.col("entity_id").alias("made"), F.col("seq").alias("made_seq"))
            open_ = open_.join(made, token, "left").withColumn(f"by_{token}", F.coalesce(f"by_{token}", F.when(F.col("seq") > F.col("made_seq"), F.col("made")))).drop("made", "made_seq")
        open_ = materialised(open_)
    if not done:
        return records.withColumns({"entity_id": F.lit(None).cast("string"), "how": F.lit(None).cast("string")})
    outcome = done[0]
    for part in done[1:]:
        outcome = outcome.unionByName(part)
    return records.join(outcome, "seq").select(*records.columns, "entity_id", "how")


def holding_investors(holdings: DataFrame, index: dict[str, DataFrame], source: str) -> tuple[DataFrame, DataFrame]:
    """(holdings with investor_ref, investors to mint): key first, then name; an empty name resolves to nothing.

    holdings: seq, name, type, external_id, investor_external_id. New firms are one for each unmatched key or name,
    the first by seq; their ref is `new:<seq>`.
    """
    keyed = holdings.withColumns({"key": F.when(F.col("investor_external_id").isNotNull(), F.concat(F.lit(f"{source}:"), "investor_external_id")), "domain": F.lit(None).cast("string"), "name_key": F.nullif(investor_name_key(F.col("name")), F.lit(""))})
    named = keyed.where("name_key is not null")
    resolved = materialised(resolve(named, index, register_matches=False))
    refs = resolved.select("seq", F.col("entity_id").alias("investor_ref"))
    minted = resolved.where("how = 'new'").select(F.col("entity_id").alias("investor_ref"), "name", "type", F.when(F.col("investor_external_id").isNotNull(), F.lit(source)).alias("external_source"), F.col("investor_external_id").alias("external_id"), F.coalesce("investor_external_id", "external_id").alias("slug_suffix"))
    return holdings.join(refs, "seq", "left"), minted


def contributed_investors(names: DataFrame, investors: DataFrame) -> DataFrame:
    """names (seq, name) with investor_id of the firm of that name, whatever the case, or `new` where a pending firm is to be minted.

    The first stored firm by (created_at, investor_id) counts; of several new rows of one name the first by seq mints.
    """
    known = investors.groupBy(F.lower(F.trim("name")).alias("k")).agg(F.min_by("investor_id", F.struct("created_at", "investor_id")).alias("investor_id"))
    asked = names.withColumn("k", F.lower(F.trim("name"))).where("k <> ''")
    first = asked.groupBy("k").agg(F.min("seq").alias("minted_by"))
    return asked.join(known, "k", "left").join(first, "k").select("seq", "name", "investor_id", F.when(F.col("investor_id").isNull(), F.col("minted_by")).alias("minted_by"))
