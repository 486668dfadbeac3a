"""Stage 1 as a stream: new dump files are filtered as they arrive, without state."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.match import Match, classify


def matched_stream(spark: SparkSession, path: str, match: Match, files_per_trigger: int = 8) -> DataFrame:
    """raw, observed and value_lc of the matched lines of files that come to the folder."""
    lines = spark.readStream.option("maxFilesPerTrigger", files_per_trigger).text(path)
    return classify(lines, match).where("status = 'matched'").select(F.col("value").alias("raw"), "observed", F.lower("observed").alias("value_lc"))


def write_stream(matched: DataFrame, out: str, checkpoint: str, available_now: bool = True) -> StreamingQuery:
    """Appends to folders by value; each file is taken once, also after a restart from the checkpoint."""
    writer = matched.writeStream.format("json").partitionBy("value_lc").option("path", out).option("checkpointLocation", checkpoint).outputMode("append")
    return (writer.trigger(availableNow=True) if available_now else writer).start()
