"""Tables kept as versions of their partitions, so that a merge reads and rewrites only what it touches.

A table lies under a folder: rows in `data/v=<n>/__part=<p>`, where p follows from the hash of the key, and for each
version a small manifest that says which version of each partition counts, with its number of rows and their digest. A
merge reads the partitions of the changed keys, and writes those of them that come out different, then the manifest.
What has no finished manifest does not count, so a merge that failed can be done again under the same number.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from capstrata.session import materialised

PARTS = 64


class Versions:
    """A table of rows that belong to a partition by their key. The number of partitions is fixed when it is first written."""

    def __init__(self, spark: SparkSession, path: str, key: list[str], schema: str | None = None, parts: int = PARTS):
        self.spark, self.path, self.key, self.schema, self.parts = spark, path, key, schema, parts

    def versions(self) -> list[int]:
        """The numbers of all versions that were finished, in order."""
        jvm = self.spark.sparkContext._jvm
        folder = jvm.org.apache.hadoop.fs.Path(f"{self.path}/manifest")
        files = folder.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        if not files.exists(folder):
            return []
        names = [f.getPath() for f in files.listStatus(folder)]
        return sorted(int(p.getName().partition("=")[2]) for p in names if files.exists(jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS")))

    def manifest(self, before: int | None = None) -> dict[int, tuple[int, int, str]]:
        """(version, rows, digest) of each partition with rows, in the newest version, or the newest before a number."""
        known = [v for v in self.versions() if before is None or v < before]
        if not known:
            return {}
        rows = self.spark.read.parquet(f"{self.path}/manifest/v={known[-1]}").collect()
        return {r.part: (r.version, r.n, r.digest) for r in rows}

    def read(self, parts: set[int] | None = None, before: int | None = None) -> DataFrame:
        """The table, or the rows of some partitions, as of the newest version or the newest before a number."""
        held = self.manifest(before)
        paths = [f"{self.path}/data/v={version}/__part={part}" for part, (version, _, _) in sorted(held.items()) if parts is None or part in parts]
        reader = self.spark.read if self.schema is None else self.spark.read.schema(self.schema)
        if paths:
            return reader.parquet(*paths)
        if self.schema is None:
            raise ValueError(f"{self.path} holds no rows, and no schema was given")
        return self.spark.createDataFrame([], self.schema)

    def _part(self) -> Column:
        return F.pmod(F.xxhash64(*self.key), F.lit(self.parts)).cast("int")

    def _write(self, rows: DataFrame, held: dict[int, tuple[int, int, str]], touched: set[int] | None, number: int) -> set[int]:
        """Writes those partitions of rows (with __part) that differ from what is held; `touched` are all there can be."""
        columns = [c for c in rows.columns if c != "__part"]
        each = rows.groupBy("__part").agg(F.count("*").alias("n"), F.sum(F.xxhash64(*columns).cast("decimal(38,0)")).cast("string").alias("digest"))
        found = {r["__part"]: (r.n, r.digest) for r in each.collect()}  # one row for each partition
        changed = {p for p, state in found.items() if held.get(p, (None, None, None))[1:] != state}
        gone = {p for p in held if (touched is None or p in touched) and p not in found}
        if not changed and not gone and self.versions():
            return set()
        if changed:
            rows.where(F.col("__part").isin(*changed)).repartition("__part").write.mode("overwrite").partitionBy("__part").parquet(f"{self.path}/data/v={number}")
        now = {p: v for p, v in held.items() if p not in gone} | {p: (number, *found[p]) for p in changed}
        said = self.spark.createDataFrame([(p, *v) for p, v in sorted(now.items())], "part int, version long, n long, digest string")
        said.coalesce(1).write.mode("overwrite").parquet(f"{self.path}/manifest/v={number}")
        return changed | gone

    def _next(self) -> int:
        return max(self.versions(), default=-1) + 1

    def write(self, rows: DataFrame, number: int | None = None) -> set[int]:
        """The whole table anew; partitions that stay the same are not written. Returns those that were."""
        number = self._next() if number is None else number
        return self._write(materialised(rows.withColumn("__part", self._part())), self.manifest(number), None, number)

    def merge(self, changes: DataFrame, combine: Callable[[DataFrame, DataFrame], DataFrame], number: int | None = None) -> tuple[set[int], DataFrame, DataFrame]:
        """(partitions written, rows before and after of the partitions that the changes touch).

        changes hold the key's columns; combine(rows, changes) gives the rows anew, each under its key. Doing a merge
        again, under its number or a new one, writes nothing or the same, if combine is idempotent.
        """
        number = self._next() if number is None else number
        changes = materialised(changes)
        touched = {r[0] for r in changes.select(self._part()).distinct().collect()}  # as many as there are partitions at most
        before = self.read(touched, number)
        after = materialised(combine(before, changes).withColumn("__part", self._part()))
        written = self._write(after, {p: v for p, v in self.manifest(number).items()}, touched, number)
        return written, before, after.drop("__part")
