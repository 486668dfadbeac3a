"""Column helpers with the text semantics of thread corpora.

White space is Unicode's, with the four ASCII separators U+001C..U+001F; a
falsy text is null or empty; predicates are null-safe and give true or false.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SPACE = r"[\s\x1c-\x1f]"
WORD = r"(?U)[^\s\x1c-\x1f]+"
STRIP = rf"(?U)^{SPACE}+|{SPACE}+$"


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def strip(text: Column | str) -> Column:
    """Without white space at both ends."""
    return F.regexp_replace(col(text), STRIP, "")


def strip_length(text: Column | str) -> Column:
    """Code points of the stripped text; 0 for null."""
    return F.length(strip(F.coalesce(col(text), F.lit(""))))


def word_count(text: Column | str) -> Column:
    """Runs of anything but white space; 0 for null."""
    return F.regexp_count(F.coalesce(col(text), F.lit("")), F.lit(WORD)).cast("bigint")


def is_blank(text: Column | str) -> Column:
    return ~F.coalesce(col(text), F.lit("")).rlike(WORD)


def squeeze(text: Column | str) -> Column:
    """Words joined by one space."""
    return F.array_join(F.regexp_extract_all(F.coalesce(col(text), F.lit("")), F.lit(WORD), F.lit(0)), " ")


def preview(text: Column | str, width: int = 300) -> Column:
    """The squeezed text, cut after ``width`` code points with an ellipsis."""
    short = squeeze(text)
    return F.when(F.length(short) > width, F.concat(F.left(short, F.lit(width)), F.lit("..."))).otherwise(short)


def has_needle(text: Column | str, needle: str = "?") -> Column:
    return F.coalesce(F.contains(col(text), F.lit(needle)), F.lit(False))


def falsy_to(text: Column | str, default: str) -> Column:
    """The text, or the default where it is null or empty."""
    return F.coalesce(F.nullif(col(text), F.lit("")), F.lit(default))


def is_filled(text: Column | str) -> Column:
    return F.coalesce(col(text) != "", F.lit(False))


def matches(text: Column | str, pattern: str) -> Column:
    """Unanchored search that ignores case by Unicode's rules; null does not match."""
    return F.coalesce(col(text).rlike(f"(?iuU){pattern}"), F.lit(False))


def term_pattern(terms: list[str]) -> str:
    return r"\b(" + "|".join(terms) + r")\b"


def part_after(text: Column | str, separator: str, index: int = 1) -> Column:
    """The index-th part of the split text; null if there are fewer."""
    return F.get(F.split(col(text), separator), F.lit(index))


def without_characters(text: Column | str, characters: str) -> Column:
    return F.translate(col(text), characters, "")


def parse_replies(response: Column | str) -> Column:
    """Replies in a model's answer, an object with ``comments`` or a bare list: array of (body, author_type); null if it is neither."""
    item = "array<struct<body string, author_type string>>"
    return F.coalesce(F.from_json(col(response), f"struct<comments {item}>")["comments"], F.from_json(col(response), item))
