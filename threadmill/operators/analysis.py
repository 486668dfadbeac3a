"""Comparison of groups of replies on the long reply table (submission_id, group, model, strategy, pos, body)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import has_needle, is_blank, word_count

#: Names of models and strategies, and half-open bands of words; longer replies are in none.
MODELS = ("gemini", "openai", "grok")
STRATEGIES = ("dg", "sag", "sagii")
REAL = "real"
BANDS = ((0, 25), (25, 50), (50, 100), (100, 10_000))


def groups(models=MODELS, strategies=STRATEGIES) -> list[str]:
    return [REAL, *(f"{m}/{s}" for m in models for s in strategies)]


def long_replies(real: DataFrame, generated: DataFrame, needle: str = "?") -> DataFrame:
    """One row for each reply that is not blank, of real replies (submission_id, body) and generated sets, with its group, words and needle."""
    sets = generated.select("submission_id", "model", "strategy", F.posexplode("comments").alias("pos", "c"))
    sets = sets.select("submission_id", F.concat_ws("/", "model", "strategy").alias("group"), "model", "strategy", F.col("pos").cast("bigint").alias("pos"), F.col("c.body").alias("body"))
    own = real.select("submission_id", F.lit(REAL).alias("group"), F.lit(None).cast("string").alias("model"), F.lit(None).cast("string").alias("strategy"), F.lit(None).cast("bigint").alias("pos"), "body")
    return measured(own.unionByName(sets).where(~is_blank("body")), needle)


def measured(replies: DataFrame, needle: str = "?", body: str = "body") -> DataFrame:
    """Adds n_words and has_needle, computed once for all statistics."""
    return replies.withColumn("n_words", word_count(body)).withColumn("has_needle", has_needle(body, needle))


def length_stats(replies: DataFrame, by: str = "group") -> DataFrame:
    """n, mean, median, population standard deviation and p90 of n_words by group.

    p90 is the sorted value at index floor(0.9 n). All come from the histogram
    of word counts, so no group's replies are ever sorted or held together.
    """
    bins = replies.groupBy(by, "n_words").agg(F.count("*").alias("c"))
    w = Window.partitionBy(by).orderBy("n_words").rowsBetween(Window.unboundedPreceding, 0)
    up = bins.withColumn("upto", F.sum("c").over(w)).withColumn("n", F.sum("c").over(Window.partitionBy(by)))
    at = lambda index: F.min(F.when(F.col("upto") > index, F.col("n_words")))
    n, total, squares = F.first("n"), F.sum(F.col("n_words") * F.col("c")), F.sum(F.col("n_words") * F.col("n_words") * F.col("c"))
    return up.groupBy(by).agg(
        n.alias("n"), (total / n).alias("mean"),
        ((at(F.floor((F.col("n") - 1) / 2)) + at(F.floor(F.col("n") / 2))) / 2).alias("median"),
        F.sqrt(F.greatest((squares.cast("double") * n - total.cast("double") * total) / n / n, F.lit(0.0))).alias("sd"),
        at(F.floor(F.col("n") * F.lit(0.9))).alias("p90"),
    )


def box_inputs(replies: DataFrame, by: str = "group") -> DataFrame:
    """Quartiles by linear interpolation and whiskers (the extreme values within 1.5 interquartile ranges), from the histogram."""
    bins = replies.groupBy(by, "n_words").agg(F.count("*").alias("c"))
    q = bins.groupBy(by).agg(*(F.expr(f"percentile(n_words, {p}D, c)").alias(name) for p, name in ((0.25, "q1"), (0.5, "median"), (0.75, "q3"))))
    joined = bins.join(q, by).withColumn("reach", 1.5 * (F.col("q3") - F.col("q1")))
    inside = (F.col("n_words") >= F.col("q1") - F.col("reach")) & (F.col("n_words") <= F.col("q3") + F.col("reach"))
    return joined.where(inside).groupBy(by, "q1", "median", "q3").agg(F.min("n_words").alias("low"), F.max("n_words").alias("high"))


def needle_rates(replies: DataFrame, dimension: DataFrame | None = None, by: str = "group", baseline: str = REAL) -> DataFrame:
    """Percent of replies with the needle by group, and the baseline's rate divided by it; groups of ``dimension`` without replies stay, with null."""
    rates = replies.groupBy(by).agg(F.count("*").alias("n"), (100.0 * F.count_if("has_needle") / F.nullif(F.count("*"), F.lit(0))).alias("rate"))
    if dimension is not None:
        rates = dimension.select(by).distinct().join(rates, by, "left").withColumn("n", F.coalesce("n", F.lit(0)))
    base = F.max(F.when(F.col(by) == baseline, F.col("rate"))).over(Window.partitionBy())  # over one row a group
    return rates.select(by, "n", "rate", F.try_divide(base, "rate").alias("ratio"))


def band_name(low: int, high: int) -> str:
    return f"w{low}_{high}"


def needle_rates_by_band(replies: DataFrame, bands=BANDS, least: int = 30, by: str = "group") -> DataFrame:
    """The rate within each band of n_words, null where the group has fewer than ``least`` replies in it."""
    columns = []
    for low, high in bands:
        inside = (F.col("n_words") >= low) & (F.col("n_words") < high)
        n = F.count_if(inside)
        columns.append(F.when(n >= least, 100.0 * F.count_if(inside & F.col("has_needle")) / n).alias(band_name(low, high)))
    return replies.groupBy(by).agg(*columns)


def coverage(ids: DataFrame, generated: DataFrame, models=MODELS, strategies=STRATEGIES) -> DataFrame:
    """By model and strategy: replies, threads without any, and blank replies. A missing set counts as an empty one."""
    sizes = _grid(ids, generated, models, strategies)
    return sizes.groupBy("model", "strategy").agg(F.sum("n").alias("replies"), F.count_if(F.col("n") == 0).alias("missing_sets"), F.sum("blank").alias("blank_bodies"))


def incomplete(ids: DataFrame, generated: DataFrame, models=MODELS, strategies=STRATEGIES) -> DataFrame:
    """The number of threads of which any set is empty."""
    per = _grid(ids, generated, models, strategies).groupBy("submission_id").agg(F.bool_or(F.col("n") == 0).alias("gap"))
    return per.agg(F.count("*").alias("threads"), F.count_if("gap").alias("incomplete"))


def _last_of(generated: DataFrame):
    """The order by which the last of several sets wins: reading order where it is known, else the fuller set."""
    reading = [F.col(c) for c in ("file_name", "file_block", "seq") if c in generated.columns]
    return F.struct(*reading, F.size("comments"), F.to_json("comments"))


def _grid(ids, generated, models, strategies):
    cells = F.array(*(F.struct(F.lit(m).alias("model"), F.lit(s).alias("strategy")) for m in models for s in strategies))
    n = F.size(F.coalesce("comments", F.array()))
    blank = F.size(F.filter(F.coalesce("comments", F.array()), lambda c: is_blank(c["body"])))
    sets = generated.groupBy("submission_id", "model", "strategy").agg(F.max_by("comments", _last_of(generated)).alias("comments")).select("submission_id", "model", "strategy", n.alias("n"), blank.alias("blank"))
    every = ids.select("submission_id").distinct().select("submission_id", F.inline(cells))
    return every.join(sets, ["submission_id", "model", "strategy"], "left").select("submission_id", "model", "strategy", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("blank", F.lit(0)).alias("blank"))


def pattern_threads(replies: DataFrame, real: str = REAL, n_real: int = 1) -> DataFrame:
    """Threads with exactly ``n_real`` real replies, one of which has the needle, where no generated reply has it."""
    own = F.col("group") == real
    per = replies.groupBy("submission_id").agg(F.count_if(own).alias("n_real"), F.count_if(own & F.col("has_needle")).alias("asked"), F.count_if(~own & F.col("has_needle")).alias("generated_asked"))
    return per.where((F.col("n_real") == n_real) & (F.col("asked") > 0) & (F.col("generated_asked") == 0)).select("submission_id")


def pattern_share(replies: DataFrame, n_threads: int, **kw) -> DataFrame:
    return pattern_threads(replies, **kw).agg(F.count("*").alias("threads"), (100.0 * F.count("*") / F.nullif(F.lit(n_threads), F.lit(0))).alias("percent"))


def totals_by_strategy(records: DataFrame, columns: tuple[str, ...]) -> DataFrame:
    """Replies in each array column of nested records, and their mean by record (of one record if there are none)."""
    rows = records.agg(F.count("*").alias("threads"), *(F.coalesce(F.sum(F.size(F.coalesce(c, F.array()))), F.lit(0)).alias(c) for c in columns))
    return rows.select("threads", *columns, *((F.col(c) / F.greatest("threads", F.lit(1))).alias(f"{c}_mean") for c in columns))
