"""Folders for rows that a plan writes and reads again."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession


def checkpoint_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: the session's, or that named in spark.checkpoint.dir; a local session without either gets a temporary one, any other is an error."""
    context = spark.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and not context.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="checkpoint-"))
    return context._jsc.sc().getCheckpointDir().get()


def fresh_folder(spark: SparkSession) -> str:
    """The path of a new folder under the shared one."""
    return f"{checkpoint_folder(spark)}/{uuid.uuid4().hex}"
