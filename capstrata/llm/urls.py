"""URL filters: fixed rules, and a path-template tree of each host judged by labelled purity.

The tree is grown level by level from counts, as deep as paths go. A segment that is variable by its form (numbers,
hashes, very long ones) is a wildcard from the start. Below each node a two-proportion test tells whether a child's
share of bad labels is above, below or like that of its siblings; children on one side that do not differ from the
others there are merged into one branch. Where there are many children, those of few pages each are too thin for the
test and count as alike. A template is rejected by the share of bad labels among its pages, smoothed towards its
host's share, and that towards the share of all.

Pages are counted by (host, generalised path) first; everything after works on those counts, and the pages meet the
verdicts in one join, whose hot keys adaptive execution splits.
"""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from capstrata.llm.common import ascii_lower, cut, read_table

#: (rule, verdict): a host and the start of a path. A rule fits its host and all subdomains; the longest wins.
RULES = (("com/", "allow"), ("example.com/en/", "block"), ("www.example.com/en/", "allow"), ("net/es/", "block"), ("net/fr/", "block"))
#: Among so many children, those with fewer pages than the second figure are thin.
MANY_CHILDREN, FEW_PAGES = 20, 3
#: Branches that differ by no more standard errors are alike.
ALIKE = 1.96
#: Pseudo-labels of the smoothing, the least labels of a template, and the share of bad ones that rejects it.
SMOOTHING, LEAST_LABELS, REJECT_FROM = 5.0, 3, 0.5
#: A segment that is variable by its form, and the merged branches of a node: like their siblings, or below or above them.
ANY, MERGED = "*", {0: "**", -1: "**-", 1: "**+"}


def host_of(url: Column) -> Column:
    return ascii_lower(F.regexp_extract(_rest(url), r"^[^/?#]*", 0))


def path_of(url: Column) -> Column:
    return F.regexp_extract(_rest(url), r"^[^/?#]*([^?#]*)", 1)


def _rest(url: Column) -> Column:
    """What follows the first `://`; empty without one."""
    at = F.instr(url, "://")
    return F.coalesce(F.when(at > 0, F.substr(url, at + 3)), F.lit(""))


def rule_for(host: Column, path: Column, rules: tuple = RULES) -> tuple[Column, Column]:
    """The longest rule that fits and its verdict; null where none does."""
    rule = verdict = None
    for text, then in sorted(rules, key=lambda r: (-len(r[0]), r[0])):
        of, slash, start = text.partition("/")
        fits = ((host == of) | F.endswith(host, F.lit("." + of))) & F.startswith(path, F.lit(slash + start))
        rule = F.when(fits, text) if rule is None else rule.when(fits, text)
        verdict = F.when(fits, then) if verdict is None else verdict.when(fits, then)
    return rule, verdict


def generalised(segment: Column) -> Column:
    """A segment, or a wildcard where its form is variable; a short extension of letters stays."""
    extension = F.regexp_extract(segment, r"(\.[A-Za-z]{1,5})$", 1)
    stem = F.regexp_replace(segment, r"\.[A-Za-z]{1,5}$", "")
    variable = stem.rlike(r"^[0-9]+$") | (stem.rlike(r"^[0-9A-Fa-f-]{8,}$") & stem.rlike("[0-9]")) | (F.length(stem) > 32) | segment.contains(ANY)
    return F.when(variable, F.concat(F.lit(ANY), extension)).otherwise(segment)


def segments(path: Column) -> Column:
    """Generalised segments of a path; empty ones are left out, equal ones in a row count once (they come from loops of links)."""
    shaped = F.transform(F.filter(F.split(path, "/"), lambda s: s != ""), generalised)
    # transform(array(shaped), ...) binds the segments once
    return F.element_at(F.transform(F.array(shaped), lambda all_: F.filter(all_, lambda s, i: (i == 0) | (s != F.get(all_, i - 1)))), 1)


def _apart(labelled: Column, bad: Column, all_labelled: Column, all_bad: Column) -> Column:
    """1 or -1 where the share of bad labels is above or below that of the rest of all; 0 where it is like it, or one has no label."""
    rest, rest_bad = all_labelled - labelled, all_bad - bad
    one = F.lit(1)
    share = all_bad / F.greatest(all_labelled, one)
    error = F.sqrt(share * (1 - share) * (1 / F.greatest(labelled, one) + 1 / F.greatest(rest, one)))
    differ = bad / F.greatest(labelled, one) - rest_bad / F.greatest(rest, one)
    return F.when((labelled > 0) & (rest > 0) & (F.abs(differ) > ALIKE * error), F.when(differ > 0, 1).otherwise(-1)).otherwise(0)


def _tokens(live: DataFrame) -> DataFrame:
    """(host, prefix, child, token, shapes) for the children of all nodes; shapes: how many go on below the token."""
    figures = [F.sum(c).alias(c) for c in ("n", "labelled", "bad")]
    children = cut(live.where("child is not null").groupBy("host", "prefix", "child").agg(*figures, F.count("*").alias("shapes")))
    parents = children.groupBy("host", "prefix").agg(F.sum("labelled").alias("all_labelled"), F.sum("bad").alias("all_bad"), F.count("*").alias("children"))
    thin = (F.col("children") >= MANY_CHILDREN) & (F.col("n") < FEW_PAGES)
    side = F.when(thin, 0).otherwise(_apart(F.col("labelled"), F.col("bad"), F.col("all_labelled"), F.col("all_bad")))
    sided = cut(children.join(parents, ["host", "prefix"]).withColumns({"thin": thin, "side": side}).drop("all_labelled", "all_bad", "children"))
    sides = sided.groupBy("host", "prefix", "side").agg(F.sum("labelled").alias("all_labelled"), F.sum("bad").alias("all_bad"), F.count("*").alias("members"))
    alike = F.col("thin") | (_apart(F.col("labelled"), F.col("bad"), F.col("all_labelled"), F.col("all_bad")) == 0)
    name = F.when(F.col("side") == 0, MERGED[0]).when(F.col("side") < 0, MERGED[-1]).otherwise(MERGED[1])
    named = cut(sided.join(sides, ["host", "prefix", "side"]).select("host", "prefix", "child", F.when((F.col("members") > 1) & alike, name).otherwise(F.col("child")).alias("token"), "shapes"))
    below = named.groupBy("host", "prefix", "token").agg(F.sum("shapes").alias("shapes"))
    return named.drop("shapes").join(below, ["host", "prefix", "token"])


def template_tree(counts: DataFrame) -> DataFrame:
    """(host, shape, template, labelled, bad) for counts of (host, shape, segments, labelled, bad, n).

    There are as many rounds as the longest path that two shapes share, and one more; a shape that is alone in its
    node has the rest of its own segments for template.
    """
    live, level, done = counts.withColumn("prefix", F.lit("")), 0, []
    while level == 0 or not live.isEmpty():
        placed = live.withColumn("child", F.get("segments", F.lit(level)))
        level += 1
        ended = placed.where("child is null").withColumnRenamed("prefix", "template")
        going = cut(placed.where("child is not null").join(_tokens(placed), ["host", "prefix", "child"]).withColumn("prefix", F.concat("prefix", F.lit("/"), "token")))
        alone = F.col("shapes") == 1
        rest = F.concat("prefix", F.array_join(F.transform(F.slice("segments", level + 1, F.greatest(F.size("segments") - level, F.lit(0))), lambda s: F.concat(F.lit("/"), s)), ""))
        done += [part.select("host", "shape", "template", "labelled", "bad") for part in (ended, going.where(alone).withColumn("template", rest))]
        live = going.where(~alone).drop("child", "token", "shapes")
    return cut(functools.reduce(DataFrame.unionByName, done))


def judge_templates(tree: DataFrame) -> DataFrame:
    """(host, shape, template, labelled, purity, template_verdict) for the rows of a template tree.

    purity is the smoothed share of labels that are not bad.
    """
    templates = tree.groupBy("host", "template").agg(F.sum("labelled").alias("labelled"), F.sum("bad").alias("bad"))
    hosts = cut(templates.groupBy("host").agg(F.sum("labelled").alias("host_labelled"), F.sum("bad").alias("host_bad")))
    total = hosts.agg(F.coalesce(F.sum("host_labelled"), F.lit(0)).alias("n"), F.coalesce(F.sum("host_bad"), F.lit(0)).alias("bad")).first()
    overall = total.bad / max(1, total.n)
    host_share = (F.col("host_bad") + SMOOTHING * overall) / (F.col("host_labelled") + SMOOTHING)
    share = (F.col("bad") + SMOOTHING * host_share) / (F.col("labelled") + SMOOTHING)
    verdict = F.when((F.col("labelled") >= LEAST_LABELS) & (share >= REJECT_FROM), "block").otherwise("allow")
    judged = cut(templates.join(hosts, "host").select("host", "template", "labelled", (1 - share).alias("purity"), verdict.alias("template_verdict")))
    return tree.select("host", "shape", "template").join(judged, ["host", "template"])


def judge(pages: DataFrame, labels: DataFrame, rules: tuple = RULES) -> DataFrame:
    """(page_id, host, path, rule, verdict, template, purity) of each row of pages (page_id, url).

    labels: page_id, bad (boolean); pages without a label are judged by their template. A url that is null or has no
    `://` has an empty host and path, no rule, and the template of such urls. Repeated rows are judged alike; a page
    with several labels is bad if one of them is.
    """
    parsed = pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    shaped = parsed.withColumn("segments", segments(F.col("path"))).withColumn("shape", F.array_join("segments", "/"))
    known = labels.where("page_id is not null and bad is not null").groupBy("page_id").agg(F.max("bad").alias("bad"))
    labelled = shaped.select("page_id", "host", "shape").join(known, "page_id", "left")
    counts = labelled.groupBy("host", "shape").agg(F.count("*").alias("n"), F.count("bad").alias("labelled"), F.count_if("bad").alias("bad"))
    counts = cut(counts.withColumn("segments", F.when(F.col("shape") == "", F.array().cast("array<string>")).otherwise(F.split("shape", "/"))))
    verdicts = cut(judge_templates(template_tree(counts)))
    rule, ruled = rule_for(F.col("host"), F.col("path"), rules)
    judged = shaped.drop("segments").join(verdicts, ["host", "shape"])
    return judged.select("page_id", "host", "path", rule.alias("rule"), F.coalesce(ruled, "template_verdict").alias("verdict"), "template", "purity")


def page_labels(pages: DataFrame, labels: DataFrame) -> DataFrame:
    """(page_id, bad): a page shows the document whose number ends its path; bad is poor quality or toxic."""
    number = F.regexp_extract(path_of(F.col("url")), r"([0-9]{1,18})[^0-9]*$", 1)
    numbered = pages.select("page_id", F.when(number != "", number).cast("bigint").alias("doc_id"))
    bad = (F.coalesce(F.col("quality"), F.lit(1)) == 0) | (F.coalesce(F.col("toxic"), F.lit(0)) == 1)
    return numbered.join(labels.select("doc_id", bad.alias("bad")), "doc_id").select("page_id", "bad")


def op1_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Host, path, rule and verdict of every page. A null url, or one without `://`, has an empty host and path and is
    judged with the others of that kind; repeated rows are judged alike; no rows, no result.
    """
    pages = read_table(spark, sf_dir, "pages")
    return judge(pages, page_labels(pages, read_table(spark, sf_dir, "labels")))


#: Levels that the SQL spells out; the query has no such bound.
_SQL_LEVELS = 9


def _apart_sql(of: str) -> str:
    share, rest = f"(all_bad / greatest(all_labelled, 1)::double)", "(all_labelled - labelled)"
    differ = f"(bad / greatest(labelled, 1)::double - (all_bad - bad) / greatest({rest}, 1)::double)"
    error = f"sqrt({share} * (1 - {share}) * (1 / greatest(labelled, 1)::double + 1 / greatest({rest}, 1)::double))"
    return f"(case when labelled > 0 and {rest} > 0 and abs({differ}) > {ALIKE} * {error} then case when {differ} > 0 then 1 else -1 end else 0 end) {of}"


def _levels_sql() -> str:
    """The tree level by level: child counts, the side of each child, those of its side, its token, and the prefixes that follow."""
    out = []
    for i in range(_SQL_LEVELS):
        out.append(f"""
c{i} as materialized (select host, prefix, segments[{i + 1}] as child, sum(n) as n, sum(labelled) as labelled, sum(bad) as bad from t{i} where segments[{i + 1}] is not null group by all),
q{i} as materialized (select *, sum(labelled) over w as all_labelled, sum(bad) over w as all_bad, count(*) over w as children from c{i} window w as (partition by host, prefix)),
x{i} as materialized (select * exclude (all_labelled, all_bad), children >= {MANY_CHILDREN} and n < {FEW_PAGES} as thin, {_apart_sql("as side")} from q{i}),
y{i} as materialized (select * exclude (side), case when thin then 0 else side end as side from x{i}),
z{i} as materialized (select *, sum(labelled) over w as all_labelled, sum(bad) over w as all_bad, count(*) over w as members from y{i} window w as (partition by host, prefix, side)),
k{i} as materialized (select host, prefix, child, case when members > 1 and (thin or {_apart_sql("= 0")}) then case side when 0 then '{MERGED[0]}' when -1 then '{MERGED[-1]}' else '{MERGED[1]}' end else child end as token from z{i}),
t{i + 1} as materialized (select t.host, t.shape, t.segments, t.n, t.labelled, t.bad, case when k.token is null then t.prefix else t.prefix || '/' || k.token end as prefix
  from t{i} t left join k{i} k on k.host = t.host and k.prefix = t.prefix and k.child = t.segments[{i + 1}])""")
    return ",".join(out)


def _rules_sql(of: int) -> str:
    cases = [f"when (host = '{r.partition('/')[0]}' or ends_with(host, '.{r.partition('/')[0]}')) and starts_with(path, '/{r.partition('/')[2]}') then '{(r, then)[of]}'" for r, then in sorted(RULES, key=lambda x: (-len(x[0]), x[0]))]
    return "case " + " ".join(cases) + " end"


OP1_SQL = rf"""
with u as (select page_id, case when instr(coalesce(url, ''), '://') > 0 then substr(url, instr(url, '://') + 3) else '' end as rest from pages),
p as (select page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) as path from u),
g as materialized (select *, list_transform(list_filter(string_split(path, '/'), lambda s: s <> ''), lambda s: case
  when regexp_matches(regexp_replace(s, '\.[A-Za-z]{{1,5}}$', ''), '^[0-9]+$') or length(regexp_replace(s, '\.[A-Za-z]{{1,5}}$', '')) > 32 or contains(s, '*')
    or (regexp_matches(regexp_replace(s, '\.[A-Za-z]{{1,5}}$', ''), '^[0-9A-Fa-f-]{{8,}}$') and regexp_matches(regexp_replace(s, '\.[A-Za-z]{{1,5}}$', ''), '[0-9]'))
  then '*' || regexp_extract(s, '(\.[A-Za-z]{{1,5}})$', 1) else s end) as every from p),
s as materialized (select page_id, host, path, list_filter(every, lambda s, i: i = 1 or s <> every[i - 1]) as segments from g),
l as (select page_id, max(coalesce(quality, 1) = 0 or coalesce(toxic, 0) = 1) as bad from (select page_id, try_cast(nullif(regexp_extract(path, '([0-9]{{1,18}})[^0-9]*$', 1), '') as bigint) as doc_id from p) join labels using (doc_id) where page_id is not null group by page_id),
t0 as materialized (select host, array_to_string(segments, '/') as shape, any_value(segments) as segments, count(*) as n, count(bad) as labelled, count(*) filter (bad) as bad, '' as prefix from s left join l using (page_id) group by 1, 2),
{_levels_sql()},
m as materialized (select host, prefix, sum(labelled) as labelled, sum(bad) as bad from t{_SQL_LEVELS} group by all),
h as (select host, sum(labelled) as host_labelled, sum(bad) as host_bad from m group by all),
o as (select coalesce(sum(host_bad), 0) / greatest(1, coalesce(sum(host_labelled), 0))::double as overall from h),
j as (select m.host, m.prefix, m.labelled, (bad + {SMOOTHING} * ((host_bad + {SMOOTHING} * overall) / (host_labelled + {SMOOTHING}))) / (labelled + {SMOOTHING}) as share from m join h using (host), o),
v as (select t.host, t.shape, t.prefix as template, 1 - share as purity, case when j.labelled >= {LEAST_LABELS} and share >= {REJECT_FROM} then 'block' else 'allow' end as verdict from t{_SQL_LEVELS} t join j on j.host = t.host and j.prefix = t.prefix)
select page_id, s.host, path, {_rules_sql(0).replace("host", "s.host")} as rule, coalesce({_rules_sql(1).replace("host", "s.host")}, verdict) as verdict, template, purity
from (select *, array_to_string(segments, '/') as shape from s) s join v using (host, shape)
"""
