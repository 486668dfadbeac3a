"""Thread filters and eligibility; the rounds of the study differ in these knobs only."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import is_filled, matches, term_pattern
from .corpus import is_layperson

# Marks of removed replies, hosts and endings of images, and term lists of the study's rounds.
REMOVED = ("[removed]", "[deleted]")
IMAGE_PATTERN = r"(i\.redd\.it|preview\.redd\.it|imgur\.com|\.jpg|\.jpeg|\.png|\.gif|\.webp|\.heic)"
TERMS_1 = ["health(y)?"]
TERMS_2 = ["healthy", "ill", "sick", "unhealthy", "unwell", "disease", "dysfunction", "illness", "health", "disorder"]
TERMS_3 = ["healthy", "ill", "sick", "unhealthy", "unwell", "well", "disease", "dysfunction", "illness", "health", "disorder"]
EMPTY_JSON = ("", "{}", "[]", '""', "false", "0", "null")
TOP_LEVEL = "t3_"


@dataclass(frozen=True)
class Round:
    """What one round of the study asks of a thread and how it samples."""

    terms: tuple[str, ...] = ()
    search_body: bool = False
    drop_self_replies: bool = False
    drop_images: bool = False
    need_real_reply: bool = True
    sample: int = 0
    seed: int = 42
    ratio_arms: bool = False  # three fixed mixtures of roles, and not three strategies
    truncate: bool = True


ROUNDS = {
    "1": Round(need_real_reply=False, sample=1, ratio_arms=True, truncate=False),
    "1a": Round(tuple(TERMS_1), need_real_reply=False, sample=5, ratio_arms=True, truncate=False),
    "2": Round(tuple(TERMS_2), sample=5, ratio_arms=True),
    "3": Round(tuple(TERMS_3), search_body=True, sample=100),
    "4": Round(drop_self_replies=True, drop_images=True, sample=100),
    "5": Round(drop_self_replies=True, drop_images=True, sample=3000),
}


def is_real(body: Column | str = "body") -> Column:
    """Not a removed reply; a missing body counts as real."""
    return ~F.coalesce(F.col(body) if isinstance(body, str) else body, F.lit("")).isin(*REMOVED)


def top_level(replies: DataFrame) -> DataFrame:
    """Replies whose parent is a post, with submission_id."""
    rows = replies.where(F.coalesce(F.startswith("parent_id", F.lit(TOP_LEVEL)), F.lit(False)))
    return rows.withColumn("submission_id", F.substr("parent_id", F.lit(len(TOP_LEVEL) + 1)))


def without_self_replies(replies: DataFrame, posts: DataFrame) -> DataFrame:
    """Drops replies by the post's own author; orphans and unknown authors stay."""
    owner = posts.select(F.col("id").alias("_id"), F.col("author").alias("_author"))
    same = is_filled("author") & is_filled("_author") & F.coalesce(F.col("author") == F.col("_author"), F.lit(False))
    return replies.join(owner, F.col("submission_id") == F.col("_id"), "left").where(~same).drop("_id", "_author")


def has_image(preview: Column | str = "preview", text: Column | str = "selftext") -> Column:
    p = F.col(preview) if isinstance(preview, str) else preview
    return F.coalesce(~F.trim(p).isin(*EMPTY_JSON), F.lit(False)) | matches(text, IMAGE_PATTERN)


def matches_terms(terms: list[str] | tuple[str, ...], *columns: str) -> Column:
    """Any of the columns holds any of the terms as a word."""
    out = F.lit(False)
    for c in columns:
        out = out | matches(c, term_pattern(list(terms)))
    return out


def eligible(posts: DataFrame, replies: DataFrame, rules: Round) -> DataFrame:
    """Posts that the round accepts, with n_comments and the counts by flair (removed replies count in all three)."""
    rows = top_level(replies)
    if rules.drop_self_replies:
        rows = without_self_replies(rows, posts)
    keep = posts
    if rules.drop_images:
        keep = keep.where(~has_image())
    if rules.terms:
        keep = keep.where(matches_terms(rules.terms, "title", *(["selftext"] if rules.search_body else [])))
    counts = rows.groupBy("submission_id").agg(
        F.count("*").alias("n_comments"), F.count_if(is_layperson()).alias("n_layperson"), F.count_if(is_real()).alias("_real"),
    )
    counts = counts.withColumn("n_clinician", F.col("n_comments") - F.col("n_layperson"))
    if rules.need_real_reply:
        counts = counts.where("_real > 0")
    return keep.join(counts.drop("_real"), keep.id == counts.submission_id).drop("submission_id")


def reply_count_summary(threads: DataFrame, column: str = "n_comments") -> DataFrame:
    """Minimum, maximum, mean and median replies of a thread, and threads without and with any."""
    c = F.col(column)
    return threads.agg(F.count("*").alias("threads"), F.min(c).alias("least"), F.max(c).alias("most"), F.avg(c).alias("mean"), F.median(c).alias("median"), F.count_if(c == 0).alias("without"), F.count_if(c >= 1).alias("with_any"))
