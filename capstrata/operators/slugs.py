"""Unique slugs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from capstrata.functions.text import kebab
from capstrata.operators import ranking
from capstrata.session import materialised


def numbered(rows: DataFrame, base: str = "base", order: str = "name") -> DataFrame:
    """rows with `slug`: the base, or base-n for the n-th of a base in order. Bases may still clash with each other's numbers."""
    n = F.row_number().over(Window.partitionBy(base).orderBy(order))
    return rows.withColumn("n", n).withColumn("slug", F.when(F.col("n") == 1, F.col(base)).otherwise(F.concat(F.col(base), F.lit("-"), F.col("n").cast("string")))).drop("n")


def clashes(rows: DataFrame) -> DataFrame:
    """Slugs that several rows have."""
    return rows.groupBy("slug").agg(F.count("*").alias("n")).where("n > 1")


def mint(rows: DataFrame, used: DataFrame, name: Column, seq: Column, suffix: Column | None = None, fallback: str = "company", at_once: int = ranking.AT_ONCE) -> DataFrame:
    """rows with a `slug` that neither `used` (slug) nor another row has.

    Without a suffix the rows of a base take the base, base-2, base-3, … in order of seq, leaving out what is used.
    With one, the first row of a base takes the base if it is free, and each other row base-suffix, numbered likewise.
    Numbers of one base that are the name of another go to the first by seq; who loses takes the next number that is
    free after that round, so there are as many rounds as such clashes chain. Rows of a base beyond `at_once` are numbered
    by several tasks.
    """
    base = kebab(name, fallback)
    open_ = materialised(rows.withColumns({"__base": base, "__seq": seq} | ({} if suffix is None else {"__stem": F.concat(base, F.lit("-"), kebab(suffix, fallback))})))
    taken, done = used.select("slug").distinct(), []
    if suffix is not None:
        firsts = open_.groupBy("__base").agg(F.min("__seq").alias("__first")).join(taken.withColumnRenamed("slug", "__base"), "__base", "left_anti")
        placed = materialised(open_.join(firsts, "__base", "left").withColumn("__won", F.coalesce(F.col("__seq") == F.col("__first"), F.lit(False))).drop("__first"))
        done.append(placed.where("__won").withColumn("slug", F.col("__base")).drop("__won", "__stem", "__base", "__seq"))
        taken = taken.unionByName(done[-1].select("slug"))
        open_ = placed.where("not __won").drop("__won", "__base").withColumnRenamed("__stem", "__base")
    while not open_.isEmpty():
        numbers = taken.select(F.col("slug").alias("__base"), F.lit(1).cast("long").alias("n")).unionByName(
            taken.select(F.regexp_extract("slug", r"^(.+)-[0-9]{1,18}$", 1).alias("__base"), F.regexp_extract("slug", r"-([0-9]{1,18})$", 1).try_cast("long").alias("n")).where("n > 1")
        )
        used_up = numbers.join(open_.select("__base").distinct(), "__base", "left_semi").distinct()
        placed = materialised(ranking.ranked(open_, ["__base"], ["__seq"], "__rank", at_once))
        # the rank-th number that is not used: the k-th used number u leaves u - k free ones below it, and each with
        # fewer than rank free ones below moves the rank up by one
        free = ranking.ranked(used_up, ["__base"], ["n"], "__k", at_once).select("__base", (F.col("n") - F.col("__k")).alias("at"), F.lit(1).cast("long").alias("step"), F.lit(None).cast(placed.schema["__seq"].dataType).alias("__seq"))
        places = placed.select("__base", F.col("__rank").alias("at"), F.lit(0).cast("long").alias("step"), "__seq")
        moved = ranking.running_total(places.unionByName(free), ["__base"], ["at", "step"], F.col("step"), "__moved", at_once).where("step = 0").select("__base", "__seq", "__moved")
        offered = placed.join(moved, ["__base", "__seq"]).withColumn("__n", F.col("__rank") + F.col("__moved")).withColumn("slug", F.when(F.col("__n") == 1, F.col("__base")).otherwise(F.concat("__base", F.lit("-"), F.col("__n").cast("string")))).drop("__rank", "__moved", "__n")
        offered = materialised(offered)
        winners = offered.groupBy("slug").agg(F.min("__seq").alias("__first"))
        placed = materialised(offered.join(winners, "slug").withColumn("__won", F.col("__seq") == F.col("__first")).drop("__first"))
        done.append(placed.where("__won").drop("__won", "__base", "__seq"))
        taken = materialised(taken.unionByName(done[-1].select("slug")))
        open_ = placed.where("not __won").drop("__won", "slug")
    out = done[0] if done else rows.withColumn("slug", F.lit(None).cast("string"))
    for part in done[1:]:
        out = out.unionByName(part)
    return out
