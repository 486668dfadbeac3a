"""Corpus building: candidate posts, their top-level replies, counts by thread, last-wins records."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import is_filled, part_after, strip_length

#: Authors and moderation marks whose replies do not count, and the flair that marks a layperson.
BOT = "AutoModerator"
REMOVAL_TYPES = ("deleted", "removed", "removed by reddit")
LAYPERSON = "layperson"


def last_wins(records: DataFrame, key: str = "id") -> DataFrame:
    """For each key the last record in reading order, at the place (``first_seq``) of the first."""
    order = F.struct("file_name", "file_block", "seq")
    grouped = records.groupBy(key).agg(F.max_by(F.struct(*records.columns), order).alias("r"), F.min(order).alias("f"))
    return grouped.select("r.*", F.col("f").alias("first_seq"))


def candidates(posts: DataFrame, min_chars: int = 30) -> DataFrame:
    """Posts with an id and a stripped text of at least ``min_chars`` code points."""
    return posts.where(is_filled("selftext") & (strip_length("selftext") >= min_chars) & is_filled("id"))


def retained_replies(replies: DataFrame, posts: DataFrame) -> DataFrame:
    """Top-level replies to the posts, without the bot's and moderated ones; adds submission_id."""
    moderated = F.coalesce(F.col("_meta.removal_type").isin(*REMOVAL_TYPES), F.lit(False))
    rows = replies.where(~F.col("author").eqNullSafe(BOT) & ~moderated & is_filled("link_id") & is_filled("parent_id"))
    rows = rows.where(F.col("parent_id") == F.col("link_id")).withColumn("submission_id", part_after("link_id", "_"))
    return rows.join(posts.select(F.col("id").alias("submission_id")).distinct(), "submission_id", "left_semi")


def is_layperson(flair: str = "author_flair_text"):
    return F.coalesce(F.contains(F.lower(flair), F.lit(LAYPERSON)), F.lit(False))


def thread_metadata(replies: DataFrame) -> DataFrame:
    """Per thread with replies: total, layperson, clinician (all others) and the layperson fraction."""
    counts = replies.groupBy("submission_id").agg(F.count("*").alias("total_comments"), F.count_if(is_layperson()).alias("layperson_comments"))
    return counts.withColumn("clinician_comments", F.col("total_comments") - F.col("layperson_comments")).withColumn("layperson_fraction", F.col("layperson_comments") / F.col("total_comments"))


def final_posts(posts: DataFrame, metadata: DataFrame) -> DataFrame:
    """Posts with at least one reply, with total_top_level_comments and layperson_comment_fraction."""
    counts = metadata.select(F.col("submission_id").alias("id"), F.col("total_comments").alias("total_top_level_comments"), F.col("layperson_fraction").alias("layperson_comment_fraction"))
    return posts.drop("total_top_level_comments", "layperson_comment_fraction").join(counts, "id")


def count_mismatches(posts: DataFrame, metadata: DataFrame, n: int = 100) -> DataFrame:
    """Of the first n posts by id: how many stored reply counts differ from the counted ones."""
    first = posts.orderBy("id").limit(n)
    joined = first.join(metadata, first.id == metadata.submission_id, "left")
    return joined.agg(F.count("*").alias("checked"), F.count_if(~F.col("total_top_level_comments").eqNullSafe(F.coalesce("total_comments", F.lit(0)))).alias("mismatches"))


def row_counters(**steps: DataFrame) -> DataFrame:
    """One row: the number of rows of each step."""
    frames = [f.agg(F.count("*").alias("n")).select(F.lit(name).alias("step"), "n") for name, f in steps.items()]
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out.groupBy().pivot("step", list(steps)).agg(F.first("n"))
