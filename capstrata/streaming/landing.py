"""Landed files as a stream: each run takes what is new since the last and merges it by key, so that repeats do no harm.

A run is one `availableNow` trigger. A batch that fails is taken again, and merging is idempotent, so the table is the
same as if the batch had come once.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from capstrata.operators.merge import KEY
from capstrata.operators.versions import Versions


def new_files(spark: SparkSession, path: str, kind: str = "text", schema: str | None = None, files_per_batch: int = 1000) -> DataFrame:
    """A stream of the rows of files that land under a path."""
    reader = spark.readStream.format(kind).option("maxFilesPerTrigger", files_per_batch)
    return (reader.schema(schema) if schema else reader).load(path)


def catch_up(stream: DataFrame, merge_batch: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    """Hands all that is new to merge_batch, batch by batch, and ends."""
    return stream.writeStream.foreachBatch(merge_batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def versioned_merge(table: str, merge: Callable[[DataFrame, DataFrame], DataFrame], schema: str, key: list[str] = KEY) -> Callable[[DataFrame, int], None]:
    """A merge_batch that keeps a table as numbered versions of its partitions: version n holds the batches up to n.

    A batch reads the versions before its own, and writes the partitions that it changes, so repeating it gives the same.
    """

    def batch(rows: DataFrame, number: int) -> None:
        Versions(rows.sparkSession, table, key, schema).merge(rows, merge, number)

    return batch


def latest_version(spark: SparkSession, table: str, schema: str | None = None) -> DataFrame:
    """The newest version of a versioned table."""
    return Versions(spark, table, KEY, schema).read()


def deals_by_day(rounds: DataFrame, late: str = "10 days") -> DataFrame:
    """Deals and amounts by day over a stream of rounds, each key once; rows later than the watermark are left out."""
    once = rounds.withWatermark("date", late).dropDuplicatesWithinWatermark(["external_source", "external_id"])
    return once.groupBy(F.window("date", "1 day").alias("day")).agg(F.count("*").alias("deals"), F.sum("amount_usd").alias("amount_usd"))
