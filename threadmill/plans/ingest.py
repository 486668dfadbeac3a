"""Stage 1: monthly dumps to the matched records of one field."""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.match import Match, classify, file_report, matching, over_error_rate
from ..sources.ndjson import DUMP_NAME, file_kind, read_lines, read_long_window
from ..sources.sinks import write_single, write_split


class TooManyErrors(Exception):
    """Some file has more unreadable lines than the rate allows."""


@dataclass(frozen=True)
class Ingest:
    """path is searched in depth for files whose name matches; long_window is for archives beyond Spark's own codec."""

    path: str
    match: Match
    name_pattern: str = DUMP_NAME
    error_percent: float = 1.0
    long_window: bool = False
    kinds: tuple[str, ...] = field(default=("COMMENT", "SUBMISSION"))

    def arguments(self) -> str:
        """All that the result depends on: a saved run is only resumed under the same arguments."""
        return json.dumps(asdict(self), sort_keys=True)


def value_file(spark: SparkSession, path: str) -> tuple[str, ...]:
    """The values of a list file, one a line (a list of search terms: it is small)."""
    return tuple(v for r in spark.read.text(path).toLocalIterator() if (v := r[0].strip()))


def lines_of(spark: SparkSession, plan: Ingest) -> DataFrame:
    if plan.long_window:
        return read_long_window(spark, plan.path).where(F.col("file_name").rlike(plan.name_pattern))
    return read_lines(spark, plan.path, plan.name_pattern, recursive=True)


def manifest(spark: SparkSession, plan: Ingest) -> DataFrame:
    """Per file: kind, lines, errors and matches."""
    return file_report(classify(lines_of(spark, plan), plan.match)).withColumn("kind", file_kind(F.col("file_name")))


def run(spark: SparkSession, plan: Ingest, out: str) -> DataFrame:
    """Checks the error rates, writes the matched lines, and returns the per-file report.

    Exact matches are split by value; substring and pattern matches go to one
    output. The report is written beside them as ``manifest``.
    """
    report = manifest(spark, plan).cache()
    bad = over_error_rate(report, plan.error_percent).limit(20).collect()
    if bad:
        raise TooManyErrors("; ".join(f"{r['file_name']}: {r['error_lines']} of {r['lines_processed']}" for r in bad))
    matched = matching(classify(lines_of(spark, plan), plan.match), file_kind(F.col("file_name"))).where(F.col("kind").isin(*plan.kinds))
    if plan.match.mode == "exact":
        write_split(matched, f"{out}/matched").write.mode("overwrite").json(f"{out}/names")
    else:
        write_single(matched, f"{out}/matched")
    report.withColumn("arguments", F.lit(plan.arguments())).write.mode("overwrite").json(f"{out}/manifest")
    return report


def is_done(spark: SparkSession, plan: Ingest, out: str) -> bool:
    """Whether ``out`` holds a finished run under the same arguments."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{out}/manifest/_SUCCESS")
    if not path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
        return False
    return spark.read.json(f"{out}/manifest").where(F.col("arguments") != plan.arguments()).isEmpty()
