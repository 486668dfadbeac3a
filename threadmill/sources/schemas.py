"""Explicit schemas of posts, replies and everything derived from them."""

from __future__ import annotations

from pyspark.sql.types import ArrayType, BooleanType, DataType, DoubleType, LongType, StringType, StructField, StructType

_TYPES = {"string": StringType(), "bigint": LongType(), "double": DoubleType(), "boolean": BooleanType()}


def fields(text: str, **other: DataType) -> StructType:
    """The simple fields of a text like "id string, n bigint", then others by name."""
    simple = [StructField(n, _TYPES[t]) for n, t in (f.split() for f in text.split(",") if f.strip())]
    return StructType(simple + [StructField(n, t) for n, t in other.items()])


POST = fields(
    "id string, title string, selftext string, author string, author_flair_text string, score bigint, num_comments bigint, created_utc double, "
    "permalink string, subreddit string, preview string, total_top_level_comments bigint, layperson_comment_fraction double"
)
REPLY = fields("id string, body string, author string, author_flair_text string, link_id string, parent_id string, score bigint, created_utc double, is_submitter boolean", _meta=fields("removal_type string"))
SYNTHETIC = ArrayType(fields("body string, author_type string"))
GENERATED = fields("submission_id string, model string, model_id string, strategy string, n_comments bigint", comments=SYNTHETIC)
METADATA = fields("submission_id string, total_comments bigint, layperson_comments bigint, layperson_fraction double")
MANIFEST = fields("input_path string, output_path string, complete boolean, lines_processed bigint, error_lines bigint, lines_matched bigint")
#: The long table from which all statistics are made.
REPLIES = fields("submission_id string, group string, model string, strategy string, pos bigint, seq bigint, body string, author string, flair string, score bigint, created_utc bigint, n_words bigint, has_needle boolean")
