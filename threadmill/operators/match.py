"""Field filter over raw records: exact, set, substring and pattern matches with error accounting."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Match:
    """mode: exact (any of the values, either casing), partial (contains any), regex (finds any, as written, in the lower-cased value)."""

    field: str
    values: tuple[str, ...]
    mode: str = "exact"

    def __post_init__(self):
        if self.mode not in ("exact", "partial", "regex"):
            raise ValueError(f"unknown mode {self.mode}")

    def condition(self, observed: Column) -> Column:
        low = F.lower(observed)
        if self.mode == "regex":
            return low.rlike("|".join(f"(?:{v})" for v in self.values)) if self.values else F.lit(False)
        wanted = [v.lower() for v in self.values]
        if self.mode == "partial":
            out = F.lit(False)
            for v in wanted:
                out = out | F.contains(low, F.lit(v))
            return out
        return low.isin(wanted)


def top_level_field(raw: Column | str, field: str) -> Column:
    """Any top-level field of a JSON record as text; null where it is missing, null, or the record is broken."""
    return F.get_json_object(F.col(raw) if isinstance(raw, str) else raw, f"$['{field}']")


def classify(lines: DataFrame, match: Match, raw: str = "value") -> DataFrame:
    """Adds observed and status: error (broken record, or no text in the field), matched or unmatched. Null counts as an error."""
    observed = top_level_field(raw, match.field)
    status = F.when(F.col("observed").isNull(), "error").when(match.condition(F.col("observed")), "matched").otherwise("unmatched")
    return lines.withColumn("observed", observed).withColumn("status", status)


def counted(classified: DataFrame, observation) -> DataFrame:
    """The same rows; the pyspark Observation gets lines, errors and matches once an action has run over them."""
    return classified.observe(observation, F.count(F.lit(1)).alias("lines"), F.count_if(F.col("status") == "error").alias("errors"), F.count_if(F.col("status") == "matched").alias("matches"))


def matching(classified: DataFrame, kind: Column | None = None) -> DataFrame:
    """Matched lines as raw, observed, value_lc, kind and their order."""
    rows = classified.where("status = 'matched'")
    return rows.select(F.col("value").alias("raw"), "observed", F.lower("observed").alias("value_lc"), (kind if kind is not None else F.lit("COMMENT")).alias("kind"), "file_name", "file_block", "seq")


def match_values(rows: DataFrame, field: str, values: DataFrame) -> DataFrame:
    """Rows whose field is in a long value list (one column), casing ignored: a semi-join that Spark broadcasts if it is small."""
    wanted = values.select(F.lower(F.trim(values.columns[0])).alias("_v")).where("_v <> ''").distinct()
    return rows.join(wanted, F.lower(rows[field]) == wanted["_v"], "left_semi")


def file_report(classified: DataFrame) -> DataFrame:
    """Per file: lines, errors and matches."""
    return classified.groupBy("file_name").agg(F.count("*").alias("lines_processed"), F.count_if(F.col("status") == "error").alias("error_lines"), F.count_if(F.col("status") == "matched").alias("lines_matched"))


def progress(log: DataFrame, samples: int = 40) -> DataFrame:
    """Adds rate to a log of (file_name, at in seconds, lines read so far): lines a second over each file's last ``samples`` entries; null for the first."""
    last = Window.partitionBy("file_name").orderBy("at").rowsBetween(1 - samples, 0)
    return log.withColumn("rate", F.try_divide(F.col("lines") - F.first("lines").over(last), F.col("at") - F.first("at").over(last)))


def over_error_rate(report: DataFrame, percent: float = 1.0) -> DataFrame:
    """Files with more errors than the rate allows."""
    return report.where(F.col("error_lines") > F.col("lines_processed") * F.lit(percent / 100))


def display_names(matched: DataFrame) -> DataFrame:
    """kind, value_lc and the casing that was seen first."""
    order = F.struct("file_name", "file_block", "seq")
    return matched.groupBy("kind", "value_lc").agg(F.min_by("observed", order).alias("display"), F.count("*").alias("n"))
