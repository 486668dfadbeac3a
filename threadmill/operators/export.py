"""Nested records, sheet layouts and previews."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import falsy_to, preview, without_characters
from .analysis import MODELS, STRATEGIES, _last_of
from .threads import is_real

#: The sheets' section titles and labels, and characters that sheet names must not hold.
ILLEGAL = "[]*?/\\:"
SECTIONS = {"dg": "Synthetic: DG (Discourse Generation)", "sag": "Synthetic: SAG (Single Advice Generation)", "sagii": "Synthetic: SAGII (SAG + Incremental Info)"}


def ordered_replies(replies: DataFrame, *fields: str, key: str = "submission_id", name: str = "comments") -> DataFrame:
    """Per thread an array of its replies by created_utc (missing: 0), ties in reading order."""
    item = F.struct(F.coalesce(F.col("created_utc").cast("double"), F.lit(0.0)).alias("_t"), F.col("file_name").alias("_f"), F.col("file_block").alias("_b"), F.col("seq").alias("_s"), F.struct(*fields).alias("r"))
    return replies.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(item)), lambda x: x["r"]).alias(name))


def analysis_records(posts: DataFrame, replies: DataFrame, generated: DataFrame, models=MODELS, strategies=STRATEGIES) -> DataFrame:
    """One record for each thread that has a generated set and a post: its fields, real replies and model -> strategy -> replies; n_comments includes removed replies."""
    real = ordered_replies(replies.where(is_real()).select("*", F.coalesce("body", F.lit("")).alias("_body")).drop("body").withColumnRenamed("_body", "body"), "body", "author_flair_text", "score", name="real_comments")
    counts = replies.groupBy("submission_id").agg(F.count("*").alias("n_comments"))
    empty = F.array().cast("array<struct<body: string, author_type: string>>")
    here = lambda m, s, c: F.when((F.col("model") == m) & (F.col("strategy") == s), c)
    cells = [F.max_by(here(m, s, F.col("comments")), here(m, s, _last_of(generated))).alias(f"{m}_{s}") for m in models for s in strategies]
    sets = generated.groupBy("submission_id").agg(*cells)
    joined = sets.join(posts.withColumnRenamed("id", "submission_id"), "submission_id").join(real, "submission_id", "left").join(counts, "submission_id", "left")
    nested = F.struct(*(F.struct(*(F.coalesce(f"{m}_{s}", empty).alias(s) for s in strategies)).alias(m) for m in models))
    return joined.select(
        "submission_id", falsy_to("title", "").alias("title"), falsy_to("selftext", "").alias("selftext"), F.coalesce("n_comments", F.lit(0)).alias("n_comments"), "permalink", "created_utc",
        F.coalesce("real_comments", F.array().cast("array<struct<body: string, author_flair_text: string, score: bigint>>")).alias("real_comments"), nested.alias("synthetic"),
    )


#: Fields of a post and a reply in the nested record.
POST_FIELDS = ("id", "title", "selftext", "author", "author_flair_text", "score", "num_comments", "created_utc", "permalink", "subreddit", "total_top_level_comments", "layperson_comment_fraction")
REPLY_FIELDS = ("id", "body", "author", "author_flair_text", "score", "created_utc", "is_submitter")


def combined_records(posts: DataFrame, replies: DataFrame, arms: DataFrame) -> DataFrame:
    """The first round's record: the post, its replies in order, and the arms' columns; threads that have all three."""
    real = ordered_replies(replies.withColumn("is_submitter", F.coalesce("is_submitter", F.lit(False))), *REPLY_FIELDS, name="real_comments")
    own = posts.select(F.col("id").alias("submission_id"), F.struct(*POST_FIELDS).alias("submission"))
    return own.join(real, "submission_id").join(arms.drop("n_top_level_comments"), "submission_id")


def arms_long(records: DataFrame, arms: tuple[str, ...]) -> DataFrame:
    """Checkpoint records with one array of replies for each arm, as rows: submission_id, strategy, pos, author_type, body."""
    cells = F.array(*(F.struct(F.lit(a).alias("strategy"), F.col(a).alias("comments")) for a in arms))
    one = records.select("submission_id", F.explode(cells).alias("x")).select("submission_id", "x.strategy", F.posexplode("x.comments").alias("pos", "c"))
    return one.select("submission_id", "strategy", "pos", F.col("c.author_type").alias("author_type"), F.col("c.body").alias("body"))


def first_replies(records: DataFrame, n: int = 3, column: str = "real_comments") -> DataFrame:
    """Records with the first n replies of their ordered array, removed ones included."""
    return records.withColumn(column, F.slice(column, 1, n))


def sheet_name(number: Column, title: Column, width: int = 26, strip_illegal: bool = True) -> Column:
    """"number. title", at most 31 characters; the early rounds kept 28 of the title and did not strip."""
    name = F.concat(number.cast("string"), F.lit(". "), F.left(title, F.lit(width)))
    return F.left(without_characters(name, ILLEGAL) if strip_illegal else name, F.lit(31))


def sheet_rows(threads: DataFrame, real: DataFrame, generated: DataFrame, order: str = "submission_id", breakdown: bool = True) -> DataFrame:
    """A workbook's cells, one sheet a thread: sheet_idx, sheet_name, section_ord, row_ord, col_a, col_b.

    threads: submission_id, title, selftext, n_clinician, n_layperson. real:
    submission_id, pos, flair, body. generated: submission_id, strategy, pos,
    author_type, body. Removed replies are left out.
    """
    from .sampling import numbered

    sheets = numbered(threads, order).withColumn("sheet_idx", F.col("_n") + 1).drop("_n")
    sheets = sheets.withColumn("sheet_name", sheet_name(F.col("sheet_idx"), F.coalesce("title", F.concat(F.lit("OP "), F.col("sheet_idx").cast("string")))))
    cell = lambda section, row, a, b: F.struct(F.lit(section).alias("section_ord"), row.cast("bigint").alias("row_ord"), a.alias("col_a"), b.alias("col_b"))
    none = F.lit(None).cast("string")
    counts = F.format_string("%d clinician, %d layperson (%d total)", "n_clinician", "n_layperson", F.col("n_clinician") + F.col("n_layperson"))
    fixed = [cell(0, F.lit(0), F.lit("Opening Post"), none), cell(0, F.lit(1), F.lit("Title:"), falsy_to("title", "")), cell(0, F.lit(2), F.lit("Body:"), falsy_to("selftext", ""))]
    if breakdown:
        fixed.append(cell(0, F.lit(3), F.lit("Real breakdown:"), counts))
    for i, title in enumerate(["Real Comments", *SECTIONS.values()], 1):
        fixed += [cell(i, F.lit(0), F.lit(title), none), cell(i, F.lit(1), F.lit("Author Type"), F.lit("Comment"))]
    head = sheets.select("sheet_idx", "sheet_name", F.inline(F.array(*fixed)))
    names = sheets.select("submission_id", "sheet_idx", "sheet_name")
    rank = F.row_number().over(Window.partitionBy("submission_id").orderBy("pos")) + 1
    own = real.where(is_real()).withColumn("row_ord", rank.cast("bigint")).join(names, "submission_id").select("sheet_idx", "sheet_name", F.lit(1).alias("section_ord"), "row_ord", falsy_to("flair", "No flair").alias("col_a"), falsy_to("body", "").alias("col_b"))
    place = F.array_position(F.array(*map(F.lit, SECTIONS)), F.col("strategy")).cast("int") + 1
    rank = F.row_number().over(Window.partitionBy("submission_id", "strategy").orderBy("pos")) + 1
    made = generated.where(F.col("strategy").isin(*SECTIONS)).withColumn("row_ord", rank.cast("bigint")).join(names, "submission_id").select("sheet_idx", "sheet_name", place.alias("section_ord"), "row_ord", F.col("author_type").alias("col_a"), F.col("body").alias("col_b"))
    return head.unionByName(own).unionByName(made)


def previews(threads: DataFrame, width: int = 300, n: int = 3, order: str = "submission_id") -> DataFrame:
    """The first n threads with squeezed and shortened texts."""
    return threads.orderBy(order).limit(n).select("submission_id", "title", preview("selftext", width).alias("selftext"))


WIDTHS = (28, 100)  # of a sheet's two columns, in characters


def write_workbook(rows: DataFrame, path: str) -> None:
    """An .xlsx of sheet_rows where openpyxl is installed, headings bold and columns wide enough to read; a workbook is small enough to be read row by row."""
    from openpyxl import Workbook
    from openpyxl.styles import Alignment, Font

    book = Workbook()
    book.remove(book.active)
    sheet, current = None, None
    for r in rows.orderBy("sheet_idx", "section_ord", "row_ord").toLocalIterator():
        if r["sheet_idx"] != current:
            current, sheet = r["sheet_idx"], book.create_sheet(title=r["sheet_name"])
            sheet.column_dimensions["A"].width, sheet.column_dimensions["B"].width = WIDTHS
        sheet.append([r["col_a"], r["col_b"]])
        for cell in sheet[sheet.max_row]:
            cell.alignment = Alignment(wrap_text=True, vertical="top")
            cell.font = Font(bold=r["row_ord"] == 0 or r["row_ord"] == 1 and r["section_ord"] > 0)
    book.save(path)
