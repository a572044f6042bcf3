"""Benchmark decontamination: short test items searched for inside long documents by size-partitioned MinHash sketches.

Items are partitioned by their number of distinct shingles, in classes whose upper bounds double. A class with upper
bound u is sketched by the k = floor((1 - t) * u) + 1 shingles of each item with the smallest hashes (bottom-k
MinHash). A document that holds a share t of an item's shingles misses at most floor((1 - t) * u) of them, so it
holds one of the k at least: the candidates from sketch hits are complete, whatever the document's length. Each
candidate is verified by exact containment of the item's distinct shingles. All of it is DataFrame functions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from capstrata.llm.common import DROP_LIMIT, cut, joined_by_key, read_table, text_key

#: Words of a shingle, and the share of an item's distinct shingles that makes a document contaminated.
SHINGLE, CONTAINMENT = 5, 0.8
#: A benchmark is broadcast only up to so many shingles over all items (16 MB); a larger one is joined by shuffling.
BROADCAST_SHINGLES = 1_000_000
_BETWEEN_WORDS = r"[^\p{L}\p{N}]+"


def _words(text: Column) -> Column:
    """Lower-cased runs of letters and digits."""
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), _BETWEEN_WORDS), lambda w: w != "")


def shingle_hashes(text: Column, lengths: tuple[int, ...] = (SHINGLE,)) -> Column:
    """Distinct 64-bit hashes of the runs of so many words of a text. Null, or fewer words than any length: an empty array."""
    # transform(array(words), ...) binds the words once, so that they are not split again for each run
    return F.element_at(F.transform(F.array(_words(text)), lambda w: F.array_distinct(F.concat(*(_runs(w, n) for n in lengths)))), 1)


def _runs(words: Column, length: int) -> Column:
    each = F.transform(F.sequence(F.lit(1), F.greatest(F.size(words) - (length - 1), F.lit(1))), lambda i: F.xxhash64(F.slice(words, i, length)))
    return F.when(F.size(words) >= length, each).otherwise(F.array().cast("array<bigint>"))


def sketches(items: DataFrame, containment: float = CONTAINMENT) -> DataFrame:
    """(item_id, n_shingles, shingles, run, size_class, sketch) of each item that has a word. Items: item_id, text.

    An item of fewer than five words is one shingle, the run of all its words; run is its length. Repeated rows of an
    item count once; an item_id with several texts is searched for by each of them.
    """
    n_words = F.size(_words(F.col("text")))
    # a text of k < 5 words has one run of k words
    shingles = F.when(n_words >= SHINGLE, shingle_hashes(F.col("text")))
    for k in range(1, SHINGLE):
        shingles = shingles.when(n_words == k, shingle_hashes(F.col("text"), (k,)))
    hashed = items.select("item_id", F.least(n_words, F.lit(SHINGLE)).alias("run"), shingles.alias("shingles")).distinct().where("run > 0")
    sized = hashed.withColumn("n_shingles", F.size("shingles")).withColumn("size_class", F.ceil(F.log2("n_shingles")).cast("int"))
    k = F.floor(F.round((1 - containment) * F.pow(F.lit(2.0), F.col("size_class")), 6)).cast("int") + 1
    # the hash is mixed once more, so that the order of the sketch is not that of any other use of it
    mixed = F.array_sort(F.transform("shingles", lambda h: F.struct(F.xxhash64(h, F.lit("sketch")).alias("order"), h.alias("hash"))))
    return sized.withColumn("sketch", F.slice(F.transform(mixed, lambda x: x["hash"]), F.lit(1), k))


def _found(docs: DataFrame, items: DataFrame, containment: float, broadcast_shingles: int) -> DataFrame:
    """(doc_id, digest, item_id, n_shingles, n_found), one row for each text that holds an item and text of that item."""
    sketched = sketches(items, containment)
    size, lengths = sketched.agg(F.coalesce(F.sum("n_shingles"), F.lit(0)), F.sort_array(F.collect_set("run"))).first()  # five lengths at most
    held = docs.select("doc_id", text_key(F.col("text")).alias("digest"), shingle_hashes(F.col("text").cast("string"), tuple(lengths) or (SHINGLE,)).alias("held"))
    return _found_by_broadcast(held, sketched, containment) if size <= broadcast_shingles else _found_by_shuffle(held, sketched, containment)


def contaminated(docs: DataFrame, items: DataFrame, containment: float = CONTAINMENT, broadcast_shingles: int = BROADCAST_SHINGLES) -> DataFrame:
    """(doc_id, item_id, n_shingles, n_found, containment): documents that hold at least the given share of an item.

    Documents and items may come in any order and length, with nulls (a null text holds nothing), repeats (one row
    for each pair) and further columns (ignored). With a benchmark of bounded size a document is read once and neither
    its text nor its shingles are shuffled; with a larger one only hashes are.
    """
    found = _found(docs, items, containment, broadcast_shingles)
    best = found.groupBy("doc_id", "item_id").agg(F.max(F.struct((F.col("n_found") / F.col("n_shingles")).alias("containment"), "n_found", "n_shingles")).alias("m"))
    return best.select("doc_id", "item_id", F.col("m.n_shingles").cast("long").alias("n_shingles"), F.col("m.n_found").cast("long").alias("n_found"), "m.containment")


def _found_by_broadcast(held: DataFrame, sketched: DataFrame, containment: float) -> DataFrame:
    """Sketch hits in each document, verified in place. An item's shingles go out once, its sketch entries point to them."""
    entries = sketched.select(F.xxhash64("item_id", "shingles").alias("item"), "n_shingles", F.explode_outer("sketch").alias("hash"))
    whole = sketched.select(F.xxhash64("item_id", "shingles").alias("item"), "item_id", "shingles")
    # explode would have Catalyst filter empty arrays below the projection and hash each text twice; the join drops nulls
    hits = held.select("doc_id", "digest", "held", F.explode_outer("held").alias("hash")).join(F.broadcast(entries), "hash")
    # a document with fewer shingles than the share needs cannot hold the item
    able = hits.where(F.size("held") >= F.col("n_shingles") * containment).join(F.broadcast(whole), "item")
    return able.withColumn("n_found", F.size(F.array_intersect("shingles", "held"))).where(F.col("n_found") >= F.col("n_shingles") * containment).select("doc_id", "digest", "item_id", "n_shingles", "n_found")


def _found_by_shuffle(held: DataFrame, sketched: DataFrame, containment: float) -> DataFrame:
    """The same by joins on hashes: sketch hits give candidates, and the shingles of candidates alone are counted."""
    items = sketched.select(F.xxhash64("item_id", "shingles").alias("item"), "item_id", "n_shingles", "shingles", "sketch")
    keyed = held.withColumn("doc", F.xxhash64("doc_id", "digest"))
    each = keyed.select("doc", "doc_id", "digest", F.size("held").alias("n_held"), F.explode_outer("held").alias("hash"))
    entries = items.select("item", "item_id", "n_shingles", F.explode_outer("sketch").alias("hash"))
    candidates = cut(each.join(entries, "hash").where(F.col("n_held") >= F.col("n_shingles") * containment).select("doc", "doc_id", "digest", "item", "item_id", "n_shingles").distinct())
    named = candidates.select("doc").distinct()
    some = keyed.join(F.broadcast(named) if named.count() <= DROP_LIMIT else named, "doc", "left_semi")
    asked = candidates.join(items.select("item", F.explode_outer("shingles").alias("hash")), "item")
    matched = asked.join(some.select("doc", F.explode_outer("held").alias("hash")).distinct(), ["doc", "hash"])
    counted = matched.groupBy("doc", "doc_id", "digest", "item", "item_id", "n_shingles").agg(F.count("*").alias("n_found"))
    return counted.where(F.col("n_found") >= F.col("n_shingles") * containment).select("doc_id", "digest", "item_id", "n_shingles", "n_found")


def remove_contaminated(docs: DataFrame, items: DataFrame, containment: float = CONTAINMENT) -> DataFrame:
    """docs without the rows that hold a benchmark item, each row by its own text, with or without doc_id."""
    dirty = cut(_found(docs, items, containment, BROADCAST_SHINGLES).select(F.col("doc_id").cast("long").alias("__doc_id"), F.col("digest").alias("__digest")).distinct())
    return joined_by_key(docs, dirty, "left_anti", DROP_LIMIT)


def op3_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pairs of documents and benchmark items that they hold. Null and empty texts hold and ask nothing; repeated rows
    are one pair; an empty table of either kind gives no rows.
    """
    return contaminated(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))


OP3_SQL = """
with d as (
  select doc_id, list_filter(string_split_regex(lower(coalesce(text, '')), '[^\\p{L}\\p{N}]+'), lambda w: w <> '') as w from documents
), b as (
  select item_id, list_filter(string_split_regex(lower(coalesce(text, '')), '[^\\p{L}\\p{N}]+'), lambda w: w <> '') as w from benchmark
), l as (
  select distinct least(len(w), 5) as n from b where len(w) > 0
), ds as (
  select distinct doc_id, n, array_to_string(w[i : i + n - 1], ' ') as s from d, l, unnest(range(1, greatest(len(w) - n + 2, 1))) as r(i)
), bs as (
  select distinct item_id, least(len(w), 5) as n, array_to_string(w[i : i + 4], ' ') as s from b, unnest(range(1, case when len(w) = 0 then 1 else greatest(len(w) - 3, 2) end)) as r(i)
), n as (
  select item_id, count(*) as n_shingles from bs group by item_id
), f as (
  select doc_id, item_id, count(*) as n_found from ds join bs using (n, s) group by doc_id, item_id
)
select doc_id, item_id, n_shingles, n_found, cast(n_found as double) / n_shingles as containment
from f join n using (item_id) where n_found >= 0.8 * n_shingles
"""
