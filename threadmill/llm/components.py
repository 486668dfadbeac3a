"""Connected components by alternating large-star and small-star rounds, all on the executors."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ROWS = 200_000
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The session's checkpoint folder: the one that is set, or that named in spark.checkpoint.dir.

    Without either a local session takes a folder under its own working
    directory for Spark's files; on a cluster that is an error, as no machine's
    own folder will do.
    """
    context = spark.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder and not context.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        context.setCheckpointDir(folder or f"{spark.conf.get('spark.local.dir', '/tmp')}/checkpoint-{uuid.uuid4().hex}")
    return context._jsc.sc().getCheckpointDir().get()


def written(frame: DataFrame, *parts: str, records: int = 2_000) -> DataFrame:
    """The rows, written as Parquet (in folders by ``parts``) under the checkpoint folder and read again.

    The written rows no longer need the shuffles that made them, so these give
    their disk back at once. ``records`` bounds the rows that Python gets at
    once, for rows of many kilobytes.
    """
    spark = frame.sparkSession
    path = f"{ensure_checkpoint_dir(spark)}/{uuid.uuid4().hex}"
    wanted = {CLEANUP: "true", BATCH: str(records)}
    before = {name: spark.conf.get(name, default) for name, default in ((CLEANUP, "false"), (BATCH, "10000"))}
    try:
        for name, value in wanted.items():
            spark.conf.set(name, value)
        (frame.write.partitionBy(*parts) if parts else frame.write).parquet(path)
    finally:
        for name, value in before.items():
            spark.conf.set(name, value)
    return spark.read.schema(frame.schema).parquet(path)


def _star(edges: DataFrame, large: bool, files: int) -> DataFrame:
    """One round over edges (a, b) with a > b: each neighbour is hung on the smallest node it is known to reach.

    The minima are written before they are joined: Spark can then split the
    rows of a hot node over tasks, or broadcast the minima if they are small.
    """
    if large:  # neighbours on both sides; those larger than the node move to its minimum
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m")).coalesce(files).checkpoint()
        moved = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:  # smaller neighbours move to the smallest of them, as does the node itself
        least = edges.groupBy("a").agg(F.min("b").alias("m")).coalesce(files).checkpoint()
        moved = edges.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b")))
    return moved.where("a > b").distinct()


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root): for each node of an edge the smallest node reachable from it.

    Null ends and loops are ignored, repeated edges and either direction are
    the same. Each round is written to the checkpoint folder, so a lost
    executor costs one round at most; hot nodes are joined, never collected.
    A round's files are as many as its edges need (``ROWS`` each).
    """
    spark = edges.sparkSession
    ensure_checkpoint_dir(spark)
    now = edges.where(f"{a} <> {b}").select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b")).distinct().checkpoint()
    signature = None
    while True:
        state = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if state == signature or not state[0]:
            break
        signature = state
        files = max(1, -(-state[0] // ROWS))
        for large in (True, False):
            now = _star(now, large, files).coalesce(files).checkpoint()
    roots = now.select(F.col("b").alias("node")).distinct().select("node", F.col("node").alias("root"))
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(roots)
