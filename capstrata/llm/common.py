"""What several operators of this subpackage share: table access, checkpoints, hashing and connected components."""

from __future__ import annotations

import tempfile
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII letters, for lower-casing A-Z and nothing else.
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir of the session.

    Where the setting is absent, a local master gets a temporary folder and a cluster a folder in its warehouse.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        if spark.sparkContext.master.startswith("local[") or spark.sparkContext.master == "local":
            folder = "file://" + tempfile.mkdtemp(prefix="capstrata-")
        else:
            folder = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_checkpoints"
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(folder)
    return folder


def new_folder(spark: SparkSession, name: str) -> str:
    """A folder of its own in the shared one."""
    return f"{shared_folder(spark).rstrip('/')}/{name}-{spark.sparkContext._jvm.java.util.UUID.randomUUID()}"


def cut(df: DataFrame) -> DataFrame:
    """The same rows, materialised in the shared checkpoint folder: lineage ends here and lost executors cost nothing.

    What the plan has left in the driver goes when it has ended, where that is much (see release).
    """
    shared_folder(df.sparkSession)
    found = df.checkpoint(eager=True)
    release(df.sparkSession, USED)
    return found


def landed(df: DataFrame) -> DataFrame:
    """The same rows, written as Parquet in the shared folder and read again, so that their size is that of the files.

    A checkpoint keeps the size that its plan was estimated to have, and a join's estimate is the product of those of its
    sides: in rounds of joins behind checkpoints that number gets several times as many digits in each, until numbers
    of megabytes are multiplied for each plan and kept with each checkpoint, all in the driver. What goes from round to
    round is landed. The files stay as long as the folder, so this is for rows of a few numbers.
    """
    path = new_folder(df.sparkSession, "landed")
    df.write.parquet(path)
    release(df.sparkSession, USED)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: The share of the driver's heap that ended plans may fill before cut() and landed() ask to drop them.
USED = 0.25


def release(spark: SparkSession, used: float = 0) -> None:
    """Asks the driver's JVM to drop what ended plans hold: their rows and generated classes, and the shuffles and checkpoints that Spark clears after that.

    A search of many small plans fills the heap with them long before they are collected, and the heap stays as large as it
    was once; used: the share of the largest heap that must be in use, else nothing is asked.
    """
    java = spark.sparkContext._jvm.java.lang
    heap = java.Runtime.getRuntime()
    if heap.totalMemory() - heap.freeMemory() >= used * heap.maxMemory():
        java.System.gc()


def in_parts(batches: Iterator[pa.RecordBatch], rows: int = 1000) -> Iterator[pa.RecordBatch]:
    """The batches in parts of so many rows, so that Python objects of few texts exist at once; what Arrow has freed goes back."""
    for batch in batches:
        for start in range(0, batch.num_rows, rows):
            yield batch.slice(start, rows)
        pa.default_memory_pool().release_unused()


def ascii_lower(col):
    return F.translate(col, UPPER, LOWER)


#: Rows to drop are broadcast up to so many (16 bytes each); more are joined by shuffling.
DROP_LIMIT = 1_000_000


def text_key(text) -> Column:
    """A hash of a text (null: empty), by which rows of one doc_id are told apart."""
    return F.xxhash64(F.coalesce(text.cast("string"), F.lit("")))


def joined_by_key(docs: DataFrame, keys: DataFrame, how: str, limit: int) -> DataFrame:
    """docs joined with keys (__doc_id, __digest) by their doc_id (null like any other) and text.

    Few keys are broadcast, so that no text is shuffled; their number is counted first.
    """
    few = F.broadcast(keys) if keys.count() <= limit else keys
    return docs.join(few, docs["doc_id"].cast("long").eqNullSafe(F.col("__doc_id")) & (text_key(docs["text"]) == F.col("__digest")), how)


def connected_components(edges: DataFrame, max_rounds: int = 40) -> DataFrame:
    """Components of an undirected graph by alternating large-star and small-star rounds.

    edges: two long columns (src, dst). Returns (node, root) for each node that has an edge, root being the smallest
    node of its component. Minima are pre-aggregated before each shuffle, and both sides of each join are plain
    exchanges, so that adaptive execution splits the rows of a hub. A round starts only while some node is neither a
    root nor hung on one alone, which one aggregation tells; so edges that are stars already need none. Rounds grow
    with the logarithm of the number of nodes; what has not settled after max_rounds fails the job. Edges are
    landed in each round, so that estimated sizes do not grow with the rounds (see landed).
    """
    edges = landed(edges.select(F.greatest("src", "dst").alias("u"), F.least("src", "dst").alias("v")).where("u <> v").distinct())
    for _ in range(max_rounds):
        ends = edges.select("u", F.lit(1).alias("up")).unionByName(edges.select(F.col("v").alias("u"), F.lit(0).alias("up")))
        if ends.groupBy("u").agg(F.sum("up").alias("up"), F.count("*").alias("n")).where("up > 0 and n > 1").isEmpty():
            break
        both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = cut(both.groupBy("u").agg(F.min("v").alias("w")).select("u", F.least("u", "w").alias("w")))
        # large star: every larger neighbour of u goes to the least neighbour
        large = cut(both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("w").alias("v")).distinct())
        # small star: u and its smaller neighbours go to the least of them
        down = cut(large.groupBy("u").agg(F.min("v").alias("w")))
        moved = large.join(down, "u").where("v <> w").select(F.col("v").alias("u"), F.col("w").alias("v"))
        edges = landed(moved.unionByName(down.select("u", F.col("w").alias("v"))).distinct())
    else:
        raise RuntimeError("components did not settle")
    roots = edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(roots)
