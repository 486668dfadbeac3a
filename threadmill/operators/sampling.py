"""Seeded samples of threads and role orders."""

from __future__ import annotations

import random

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.scratch import checkpoint_folder


def hash_sample(rows: DataFrame, n: int, seed: int = 42, key: str = "id") -> DataFrame:
    """n rows by the order of a hash of key and seed, sorted by key; n <= 0 keeps all. A larger n keeps every row of a smaller one."""
    if n <= 0:
        return rows.orderBy(key)
    mark = F.md5(F.concat(F.col(key).cast("string"), F.lit(f":{seed}")).cast("binary"))
    return rows.orderBy(mark, key).limit(n).orderBy(key)


def numbered(rows: DataFrame, key: str) -> DataFrame:
    """Adds _n, each row's 0-based place in the order of ``key``, without gathering the rows in one task."""
    checkpoint_folder(rows.sparkSession)
    # the ranges come from a sample, so they are fixed before they are numbered
    parts = rows.repartitionByRange(key).withColumn("_p", F.spark_partition_id()).checkpoint()
    before, at = {}, 0
    for p, n in sorted((r["_p"], r["n"]) for r in parts.groupBy("_p").agg(F.count("*").alias("n")).collect()):
        before[p] = at
        at += n
    start = F.create_map(*(x for p, b in before.items() for x in (F.lit(p), F.lit(b)))) if before else F.lit(None)
    inside = F.row_number().over(Window.partitionBy("_p").orderBy(key))
    return parts.withColumn("_n", start[F.col("_p")] + inside - 1 if before else F.lit(0)).drop("_p")


def random_module_sample(rows: DataFrame, n: int, seed: int = 42, key: str = "id") -> DataFrame:
    """The rows that random.Random(seed).sample picks among the positions in key order: for results that must repeat an earlier Python run."""
    total = rows.count()
    if n <= 0 or n >= total:
        return rows.orderBy(key)
    picked = rows.sparkSession.createDataFrame([(i,) for i in random.Random(seed).sample(range(total), n)], "_n bigint")
    return numbered(rows, key).join(F.broadcast(picked), "_n").drop("_n").orderBy(key)  # n rows of one number: the caller's bound


def role_sequence(clinician: Column | str, layperson: Column | str, seed: int = 42) -> Column:
    """The thread's roles in a seeded random order."""
    c, l = (F.col(x) if isinstance(x, str) else x for x in (clinician, layperson))
    return F.shuffle(F.concat(F.array_repeat(F.lit("clinician"), c.cast("int")), F.array_repeat(F.lit("layperson"), l.cast("int"))), seed)
