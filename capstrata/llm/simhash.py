"""SimHash near-duplicates, with pigeonring filtering of candidates.

The search itself, exact and by pigeonring, is in pigeonring.py.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from capstrata.llm import similar
from capstrata.llm.common import DROP_LIMIT, connected_components, cut, in_parts, joined_by_key, read_table, text_key
from capstrata.llm.pigeonring import BLOCK_LIMIT, links, majority

SEED, SHINGLE = 42, 3


def fingerprint(text: str | None) -> int:
    """SimHash over word shingles: a bit is set if over half of the shingles' XXH64 have it. No words: zero."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    count = max(1, len(words) - SHINGLE + 1)
    shingles = map(b" ".join, zip(*(words[i:] for i in range(SHINGLE)), strict=False)) if len(words) >= SHINGLE else iter([b" ".join(words)])
    return majority(np.fromiter((xxhash.xxh64_intdigest(s, SEED) for s in shingles), np.uint64, count))


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, fp) for each row; fp is the fingerprint as a signed long. Null texts count as empty."""

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in in_parts(it):
            fps = np.fromiter((fingerprint(t) for t in batch.column(1).to_pylist()), np.uint64, batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps.view(np.int64))], names=["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(batches, "doc_id long, fp long")


def _components(prints: DataFrame, roots_of: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """(doc_id, fp, component_id) for prints (doc_id, fp) and the components (node, root) of its distinct fp."""
    classes = cut(prints.groupBy("fp").agg(F.min("doc_id").alias("first_id")))
    roots = roots_of(classes.select("fp"))
    rooted = cut(classes.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "first_id", F.coalesce("root", "fp").alias("root")))
    groups = cut(rooted.groupBy("root").agg(F.min("first_id").alias("component_id")))
    by_print = cut(rooted.join(groups, "root").select("fp", "component_id"))
    return prints.join(by_print, "fp").select("doc_id", "fp", "component_id")


def simhash_components(docs: DataFrame, block_limit: int = BLOCK_LIMIT) -> DataFrame:
    """(doc_id, fp, component_id) for each row of docs; component_id is the smallest doc_id reachable by links.

    Repeated rows keep their rows. A null doc_id is never a component_id, unless its component has no other.
    Copies are collapsed to their fingerprint before candidates are searched.
    """
    return _components(cut(fingerprints(docs)), lambda fps: connected_components(links(fps, block_limit)))


def near_duplicates(docs: DataFrame, block_limit: int = similar.BLOCK_LIMIT) -> DataFrame:
    """The same for texts of which five-word shingles have a Jaccard similarity of 0.8 or more; fp is the set's hash."""
    prints, roots = similar.grouped(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")), block_limit)
    return _components(prints, lambda _: roots)


def deduplicate(docs: DataFrame, block_limit: int = similar.BLOCK_LIMIT) -> DataFrame:
    """docs with one row for each component of near_duplicates: that of the smallest doc_id, then of the smallest hash of its text.

    A row without doc_id stays only where its component has none with one. Of rows of one doc_id and text that stays
    whose other columns, as JSON, are the first.
    Null and empty texts are one component. Rows to drop are named by doc_id and the text's hash; texts are not
    shuffled, but for those of repeated rows, and where there are more than DROP_LIMIT to drop.
    """
    prints, roots = similar.grouped(docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_key(F.col("text")).alias("digest"), F.col("text").cast("string").alias("text")), block_limit)
    keys = cut(prints.groupBy("doc_id", "digest", "fp").agg(F.count("*").alias("rows")))
    name = F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "digest")
    classes = cut(keys.groupBy("fp").agg(F.min(name).alias("first")))
    rooted = cut(classes.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp")))
    firsts = rooted.groupBy("root").agg(F.min("first").alias("kept"))
    kept = rooted.join(firsts, "root").where(F.col("first") == F.col("kept")).select("fp", "kept")
    judged = keys.join(kept, "fp", "left").select(F.col("doc_id").alias("__doc_id"), F.col("digest").alias("__digest"), F.coalesce(name == F.col("kept"), F.lit(False)).alias("stays"), "rows")
    odd = cut(judged.where("rows > 1 or not stays"))
    several = joined_by_key(docs, odd.where("stays").select("__doc_id", "__digest"), "inner", DROP_LIMIT)
    first = F.min_by(F.struct(*docs.columns), F.to_json(F.struct(*(c for c in docs.columns if c != "text")))).alias("__row")
    once = several.groupBy("__doc_id", "__digest").agg(first).select("__row.*")
    return joined_by_key(docs, odd.select("__doc_id", "__digest"), "left_anti", DROP_LIMIT).unionByName(once)


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and component of every document. Null and empty texts have fingerprint zero and are one component;
    repeated rows keep their rows; no rows, no result.
    """
    found = simhash_components(read_table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
