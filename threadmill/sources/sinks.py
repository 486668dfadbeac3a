"""Writers: JSON lines with nulls, CSV, and partitioned splits."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.match import display_names


def write_jsonl(records: DataFrame, path: str, compression: str | None = None, mode: str = "overwrite") -> None:
    """JSON lines in UTF-8 with explicit nulls; compression "gzip" for the compressed copy."""
    writer = records.write.mode(mode).option("ignoreNullFields", "false")
    (writer.option("compression", compression) if compression else writer).json(path)


def written_bytes(spark: SparkSession, path: str) -> int:
    """Bytes of all files below a path."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()).getContentSummary(where).getLength()


def write_with_copy(records: DataFrame, path: str) -> dict[str, float]:
    """JSON lines and a gzip copy beside them (path.gz), made from what was written; reports both sizes in MB and their ratio."""
    spark = records.sparkSession
    write_jsonl(records, path)
    spark.read.text(path).write.mode("overwrite").option("compression", "gzip").text(f"{path}.gz")
    plain, copy = written_bytes(spark, path), written_bytes(spark, f"{path}.gz")
    return {"mb": plain / 1e6, "gz_mb": copy / 1e6, "ratio": copy / plain if plain else 0.0}


def write_metadata_csv(metadata: DataFrame, path: str) -> None:
    """submission_id, total_comments, layperson_comments, layperson_fraction with a header row."""
    metadata.select("submission_id", "total_comments", "layperson_comments", "layperson_fraction").write.mode("overwrite").option("header", True).option("lineSep", "\r\n").csv(path)


def write_split(matched: DataFrame, path: str) -> DataFrame:
    """The raw lines by kind and lower-cased value, with a table of each value's display name (its casing when first seen).

    A value without rows makes no folder; no rows at all write nothing but
    Spark's marker. The first letter is a further level of folders, so that a
    reader can take one shard.
    """
    # a value's lines go to one task, but for large ones, which Spark splits: as many files as their bytes ask for
    out = matched.withColumn("prefix", F.left("value_lc", F.lit(1))).select("raw", "kind", "prefix", "value_lc").hint("rebalance", "kind", "prefix", "value_lc")
    out.write.mode("overwrite").partitionBy("kind", "prefix", "value_lc").option("compression", "gzip").text(path)
    return display_names(matched)


def write_single(matched: DataFrame, path: str) -> None:
    """The raw lines by kind only: one output for pattern and substring matches."""
    matched.select("raw", "kind").write.mode("overwrite").partitionBy("kind").option("compression", "gzip").text(path)


def append_checkpoint(generated: DataFrame, path: str) -> None:
    """Adds finished threads to the folders of their model and strategy."""
    generated.write.mode("append").partitionBy("model", "strategy").option("ignoreNullFields", "false").json(path)
