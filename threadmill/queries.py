"""Queries of the engine over the stand-in tables, and the SQL that each must agree with.

Stand-ins: a thread is a conversation, its opening post the turn 0, its
replies the later turns; author and group are the role ("user" stands for
real replies); model is conv_id % 3 and strategy is turn % 3; removal marks
are labels.toxic; posts are documents. The needle is a comma, as question
marks do not occur. Doubles are rounded to six places, costs to four.
"""

from __future__ import annotations

import math
from statistics import NormalDist

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.text import preview, squeeze, strip_length, word_count
from .operators import analysis, corpus, export, generation, match, power, sampling, threads
from .operators.prompts import prior_text

NEEDLE = ","
TERMS = ["the", "und", "que", "des"]
URL_PATTERN = r"(blog\.|page=2|\.org)"
W = r"len(regexp_extract_all({}, '[^\s\x1c-\x1f]+'))"
_REPLIES = "SELECT conv_id, turn, role, text, " + W.format("text") + " AS w, contains(text, ',') AS q FROM conversations WHERE turn >= 1"


def _table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def _r(c: Column | str) -> Column:
    return F.round(F.col(c) if isinstance(c, str) else c, 6)


def _replies(spark, sf) -> DataFrame:
    rows = _table(spark, sf, "conversations").where("turn >= 1")
    rows = rows.select(F.col("conv_id").alias("submission_id"), F.col("role").alias("group"), F.col("turn").alias("pos"), F.col("text").alias("body"))
    return analysis.measured(rows, NEEDLE)


def _posts(spark, sf) -> DataFrame:
    rows = _table(spark, sf, "conversations").where("turn = 0")
    return rows.select(F.col("conv_id").cast("string").alias("id"), F.left("text", F.lit(40)).alias("title"), F.col("text").alias("selftext"), F.col("role").alias("author"))


def _thread_replies(spark, sf) -> DataFrame:
    """Conversations in the shape of raw replies."""
    rows = _table(spark, sf, "conversations").where("turn >= 1")
    link = F.concat(F.lit("t3_"), F.col("conv_id").cast("string"))
    flair = F.when(F.col("role") == "user", "Layperson/not verified").when(F.col("role") == "assistant", "Physician")
    return rows.select(
        F.concat_ws("-", "conv_id", "turn").alias("id"), F.col("text").alias("body"), F.col("role").alias("author"), flair.alias("author_flair_text"), link.alias("link_id"), link.alias("parent_id"),
        F.lit(0).cast("bigint").alias("score"), F.col("turn").alias("created_utc"), F.struct(F.lit(None).cast("string").alias("removal_type")).alias("_meta"), F.lit("f").alias("file_name"), F.lit(0).cast("bigint").alias("file_block"), F.col("turn").alias("seq"),
    )


def _generated(spark, sf) -> DataFrame:
    """Assistant turns as generated sets by model and strategy."""
    rows = _table(spark, sf, "conversations").where("turn >= 1 AND role = 'assistant'")
    item = F.struct("turn", F.struct(F.col("text").alias("body"), F.col("role").alias("author_type")).alias("c"))
    keys = [F.col("conv_id").alias("submission_id"), (F.col("conv_id") % 3).cast("string").alias("model"), (F.col("turn") % 3).cast("string").alias("strategy")]
    return rows.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(item)), lambda x: x["c"]).alias("comments"))


def _lines(rows: DataFrame) -> DataFrame:
    """Rows as raw JSON lines."""
    return rows.select(F.to_json(F.struct(*rows.columns), {"ignoreNullFields": "false"}).alias("value"), F.lit("RC_test").alias("file_name"), F.lit(0).cast("bigint").alias("file_block"), F.col(rows.columns[0]).alias("seq"))


def length_stats_by_group(spark, sf):
    s = analysis.length_stats(_replies(spark, sf))
    return s.select("group", "n", _r("mean").alias("mean"), _r("median").alias("median"), _r("sd").alias("sd"), "p90")


def length_stats_by_language(spark, sf):
    rows = _table(spark, sf, "documents").select(F.col("lang").alias("group"), word_count("text").alias("n_words"))
    s = analysis.length_stats(rows)
    return s.select("group", "n", _r("mean").alias("mean"), _r("median").alias("median"), _r("sd").alias("sd"), "p90")


def length_boxes(spark, sf):
    b = analysis.box_inputs(_replies(spark, sf))
    return b.select("group", _r("q1").alias("q1"), _r("median").alias("median"), _r("q3").alias("q3"), "low", "high")


def needle_rate_by_group(spark, sf):
    s = analysis.needle_rates(_replies(spark, sf), baseline="user")
    return s.select("group", "n", _r("rate").alias("rate"), _r("ratio").alias("ratio"))


def needle_rate_by_band(spark, sf):
    s = analysis.needle_rates_by_band(_replies(spark, sf))
    return s.select("group", *(_r(analysis.band_name(*b)).alias(analysis.band_name(*b)) for b in analysis.BANDS))


def coverage_grid(spark, sf):
    ids = _table(spark, sf, "conversations").select(F.col("conv_id").alias("submission_id")).distinct()
    return analysis.coverage(ids, _generated(spark, sf), ("0", "1", "2"), ("0", "1", "2"))


def incomplete_threads(spark, sf):
    ids = _table(spark, sf, "conversations").select(F.col("conv_id").alias("submission_id")).distinct()
    return analysis.incomplete(ids, _generated(spark, sf), ("0", "1", "2"), ("0", "1", "2"))


def pattern_threads(spark, sf):
    return analysis.pattern_threads(_replies(spark, sf), real="user")


def candidate_filter_min_chars(spark, sf):
    docs = _table(spark, sf, "documents").select(F.col("doc_id").cast("string").alias("id"), F.col("text").alias("selftext"))
    return corpus.candidates(docs, 120).select("id", strip_length("selftext").cast("bigint").alias("chars"))


def thread_counts_and_fraction(spark, sf):
    posts = _posts(spark, sf)
    m = corpus.thread_metadata(corpus.retained_replies(_thread_replies(spark, sf), posts))
    return m.select("submission_id", "total_comments", "layperson_comments", "clinician_comments", _r("layperson_fraction").alias("layperson_fraction"))


def count_cross_check(spark, sf):
    posts = _posts(spark, sf)
    m = corpus.thread_metadata(corpus.retained_replies(_thread_replies(spark, sf), posts))
    stored = posts.withColumn("total_top_level_comments", F.col("id").cast("bigint") % 5)
    return corpus.count_mismatches(stored, m, 100)


def moderation_anti_filter(spark, sf):
    """Documents as replies, moderated where they are labelled toxic."""
    labels = _table(spark, sf, "labels").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    link = F.concat(F.lit("t3_"), F.col("doc_id").cast("string"))
    mark = F.struct(F.when(F.col("toxic") == 1, "removed").alias("removal_type"))
    docs = _table(spark, sf, "documents").join(labels, "doc_id", "left").select("doc_id", "lang", F.lit("someone").alias("author"), mark.alias("_meta"), link.alias("link_id"), link.alias("parent_id"))
    posts = docs.select(F.col("doc_id").cast("string").alias("id"))
    return corpus.retained_replies(docs, posts).select("doc_id", "lang")


def self_reply_filter(spark, sf):
    rows = threads.without_self_replies(threads.top_level(_thread_replies(spark, sf)), _posts(spark, sf))
    return rows.select("id", "submission_id", "author")


def eligible_threads(spark, sf):
    posts = _posts(spark, sf).withColumn("preview", F.when(F.col("id").cast("bigint") % 7 == 0, F.lit('{"images":[1]}')).otherwise(F.lit("{}")))
    rows = threads.eligible(posts, _thread_replies(spark, sf), threads.Round(drop_self_replies=True, drop_images=True))
    return rows.select("id", "n_comments", "n_layperson", "n_clinician")


def reply_count_summary(spark, sf):
    rows = _replies(spark, sf).groupBy("submission_id").agg(F.count("*").alias("n_comments"))
    s = threads.reply_count_summary(rows)
    return s.select("threads", "least", "most", _r("mean").alias("mean"), _r("median").alias("median"), "without", "with_any")


def field_match_exact(spark, sf):
    m = match.Match("event_type", ("CLICK", "purchase"))
    return match.matching(match.classify(_lines(_table(spark, sf, "events").select("event_id", "event_type")), m)).select(F.col("seq").alias("event_id"), "value_lc")


def field_match_partial(spark, sf):
    m = match.Match("source", ("C1", "9"), "partial")
    return match.matching(match.classify(_lines(_table(spark, sf, "documents").select("doc_id", "source")), m)).select(F.col("seq").alias("doc_id"), "value_lc")


def field_match_regex(spark, sf):
    m = match.Match("source", ("[05]$", "^src1.$"), "regex")
    return match.matching(match.classify(_lines(_table(spark, sf, "documents").select("doc_id", "source")), m)).select(F.col("seq").alias("doc_id"), "value_lc")


def file_error_report(spark, sf):
    labels = _table(spark, sf, "labels").select("doc_id", F.when(F.col("toxic") == 0, F.col("quality").cast("string")).alias("mark"))
    rows = match.classify(_lines(labels).withColumn("file_name", F.concat(F.lit("RC_"), (F.col("seq") % 4).cast("string"))), match.Match("mark", ("1",)))
    report = match.file_report(rows)
    over = match.over_error_rate(report, 10).select("file_name", F.lit(True).alias("over_rate"))
    return report.join(over, "file_name", "left").withColumn("over_rate", F.coalesce("over_rate", F.lit(False)))


def split_display_names(spark, sf):
    odd = F.when(F.col("doc_id") % 3 == 0, F.upper("source")).otherwise(F.col("source"))
    rows = _lines(_table(spark, sf, "documents").select("doc_id", odd.alias("source")))
    names = tuple(f"src{i}" for i in range(20))
    return match.display_names(match.matching(match.classify(rows, match.Match("source", names)))).select("value_lc", "display", "n")


def url_pattern_filter(spark, sf):
    from .functions.text import matches

    return _table(spark, sf, "pages").where(~matches("url", URL_PATTERN)).select("page_id", "url")


def keyword_filter(spark, sf):
    return _table(spark, sf, "documents").where(threads.matches_terms(TERMS, "text")).select("doc_id")


def json_field_extract(spark, sf):
    rows = _table(spark, sf, "events").withColumn("k", match.top_level_field("props", "k").cast("bigint"))
    return rows.groupBy("k").agg(F.count("*").alias("n"))


def last_wins_dedupe(spark, sf):
    rows = _table(spark, sf, "events").select("user_id", "event_id", "event_type", F.date_format("ts", "yyyyMMddHHmmssSSSSSS").alias("file_name"), F.col("event_id").alias("file_block"), F.lit(0).alias("seq"))
    return corpus.last_wins(rows, "user_id").select("user_id", "event_id", "event_type")


def ordered_thread_collect(spark, sf):
    rows = threads.top_level(_thread_replies(spark, sf)).withColumn("body", squeeze("body"))
    return export.ordered_replies(rows, "body").select("submission_id", F.array_join(F.col("comments.body"), " / ").alias("joined"), F.size("comments").cast("bigint").alias("n"))


def hash_sample(spark, sf):
    return sampling.hash_sample(_table(spark, sf, "documents").select("doc_id", "lang"), 100, 42, "doc_id")


def resume_anti_join(spark, sf):
    docs = _table(spark, sf, "documents").select(F.col("doc_id").alias("id"))
    return generation.remaining(docs, _table(spark, sf, "labels").select(F.col("doc_id").alias("submission_id")))


def _sized(spark, sf):
    counts = _replies(spark, sf).groupBy(F.col("submission_id").cast("string").alias("id")).agg(F.count("*").alias("n_comments"))
    return _posts(spark, sf).join(counts, "id")


def workload_estimate(spark, sf):
    w = generation.workload(_sized(spark, sf))
    return w.select("strategy", "threads", "calls", _r("tokens_in").alias("tokens_in"), _r("tokens_out").alias("tokens_out"))


def call_usage(spark, sf):
    log = _table(spark, sf, "conversations").select((F.col("conv_id") % 3).cast("string").alias("model"), (F.col("turn") % 5 == 4).alias("failed"), F.length("text").alias("tokens_in"), word_count("text").alias("tokens_out"))
    return generation.usage(log)


def cost_rollup(spark, sf):
    prices = generation.price_table(spark)
    names = F.element_at(F.array(*map(F.lit, generation.PROVIDERS)), (F.col("conv_id") % 3 + 1).cast("int"))
    tokens = _table(spark, sf, "conversations").select(names.alias("model"), F.length("text").alias("tokens_in"), word_count("text").alias("tokens_out"))
    c = generation.cost(tokens, prices)
    return c.select("model", "tokens_in", "tokens_out", F.round("cost", 4).alias("cost"))


def prior_context(spark, sf):
    """What each reply's prompt shows: all replies before it, whole. Threads are short; a thread's replies are one prompt."""
    from pyspark.sql import Window

    prior = F.collect_list("body").over(Window.partitionBy("submission_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1))
    return _replies(spark, sf).select("submission_id", "pos", prior_text(prior).alias("prior"))


def sheet_layout(spark, sf):
    rows = _sized(spark, sf)
    replies = _thread_replies(spark, sf).withColumn("submission_id", F.substr("link_id", F.lit(4)))
    counts = replies.groupBy("submission_id").agg(F.count_if(corpus.is_layperson()).alias("n_layperson"), F.count_if(~corpus.is_layperson()).alias("n_clinician"))
    sheets = rows.withColumnRenamed("id", "submission_id").join(counts, "submission_id").withColumn("order", F.col("submission_id").cast("bigint"))
    real = replies.where("author = 'user'").select("submission_id", F.col("seq").alias("pos"), F.col("author_flair_text").alias("flair"), "body")
    strategy = F.element_at(F.array(*map(F.lit, export.SECTIONS)), (F.col("seq") % 3 + 1).cast("int"))
    made = replies.where("author = 'assistant'").select("submission_id", strategy.alias("strategy"), F.col("seq").alias("pos"), F.col("author").alias("author_type"), "body")
    out = export.sheet_rows(sheets, real, made, "order")
    return out.select(F.col("sheet_idx").cast("bigint").alias("sheet_idx"), "sheet_name", F.col("section_ord").cast("bigint").alias("section_ord"), "row_ord", "col_a", "col_b")


def text_previews(spark, sf):
    return _table(spark, sf, "documents").select("doc_id", preview("text", 300).alias("preview"))


def nested_thread_export(spark, sf):
    posts = _posts(spark, sf).withColumn("permalink", F.lit(None).cast("string")).withColumn("created_utc", F.lit(0).cast("bigint"))
    replies = threads.top_level(_thread_replies(spark, sf)).where("author = 'user'")
    generated = _generated(spark, sf).withColumn("submission_id", F.col("submission_id").cast("string"))
    records = export.analysis_records(posts, replies, generated, ("0", "1", "2"), ("0", "1", "2"))
    total = sum((F.size(f"synthetic.`{m}`.`{s}`") for m in "012" for s in "012"), F.lit(0))
    return records.select("submission_id", "title", "n_comments", F.array_join("real_comments.body", "|").alias("real"), total.cast("bigint").alias("n_synthetic"))


def two_proportion_power(spark, sf):
    rows = spark.createDataFrame([("a", 0.103, 0.08, 3882.0, 6475.0), ("b", 0.103, 0.095, 3882.0, 6475.0), ("c", 0.2, 0.2, 100.0, 100.0)], "name string, p1 double, p2 double, n1 double, n2 double")
    out = power.contrasts(rows, alpha=power.bonferroni(0.05, 27)).withColumn("power", _r("power"))
    return out.withColumn("n_needed", F.coalesce(power.required_n(F.col("p1"), F.col("p2"), 6475 / 3882).cast("bigint"), F.lit(-1)))  # -1: no n is enough


def generated_replies(spark, sf):
    rows = _sized(spark, sf)
    out = None
    for s in generation.STRATEGIES:
        part = generation.generate(rows, generation.PROVIDERS["grok"], s)
        out = part if out is None else out.unionByName(part)
    return out.select("submission_id", "strategy", "n_comments", F.size("comments").cast("bigint").alias("n_replies"), "calls", "failures", "status")


QUERIES = {
    f.__name__: f
    for f in (
        length_stats_by_group, length_stats_by_language, length_boxes, needle_rate_by_group, needle_rate_by_band, coverage_grid, incomplete_threads, pattern_threads, candidate_filter_min_chars,
        thread_counts_and_fraction, count_cross_check, moderation_anti_filter, self_reply_filter, eligible_threads, reply_count_summary, field_match_exact, field_match_partial, field_match_regex,
        file_error_report, split_display_names, url_pattern_filter, keyword_filter, json_field_extract, last_wins_dedupe, ordered_thread_collect, hash_sample, resume_anti_join, workload_estimate,
        call_usage, cost_rollup, prior_context, sheet_layout, text_previews, nested_thread_export, two_proportion_power, generated_replies,
    )
}

_STATS = "count(*) AS n, round(avg(w), 6) AS mean, round(median(w), 6) AS median, round(stddev_pop(w), 6) AS sd, list_sort(list(w))[CAST(floor(count(*) * 0.9) AS INT) + 1] AS p90"
_GRID = (
    "WITH ids AS (SELECT DISTINCT conv_id FROM conversations), cells AS (SELECT CAST(m AS VARCHAR) AS model, CAST(s AS VARCHAR) AS strategy FROM range(3) a(m), range(3) b(s)), "
    "sets AS (SELECT conv_id, CAST(conv_id % 3 AS VARCHAR) AS model, CAST(turn % 3 AS VARCHAR) AS strategy, count(*) AS n, count(*) FILTER (trim(text) = '') AS blank FROM conversations WHERE turn >= 1 AND role = 'assistant' GROUP BY ALL), "
    "grid AS (SELECT ids.conv_id, cells.model, cells.strategy, coalesce(n, 0) AS n, coalesce(blank, 0) AS blank FROM ids CROSS JOIN cells LEFT JOIN sets ON ids.conv_id = sets.conv_id AND cells.model = sets.model AND cells.strategy = sets.strategy) "
)
_BAND = "CASE WHEN count(*) FILTER (w >= {0} AND w < {1}) >= 30 THEN round(100.0 * count(*) FILTER (w >= {0} AND w < {1} AND q) / count(*) FILTER (w >= {0} AND w < {1}), 6) END AS w{0}_{1}"
_THREADS = "p AS (SELECT conv_id, role, text FROM conversations WHERE turn = 0), r AS (SELECT c.* FROM conversations c WHERE turn >= 1 AND conv_id IN (SELECT conv_id FROM p))"
_SIZED = "p AS (SELECT conv_id, text FROM conversations WHERE turn = 0), n AS (SELECT conv_id, count(*) AS n FROM conversations WHERE turn >= 1 GROUP BY 1), s AS (SELECT p.conv_id, p.text, n.n, (length(p.text) + length(left(p.text, 40))) / 4 + 200 AS base FROM p JOIN n USING (conv_id))"

def _two_proportion_values() -> str:
    """The same contrasts by the error function."""
    out = []
    for name, p1, p2, n1, n2 in (("a", 0.103, 0.08, 3882, 6475), ("b", 0.103, 0.095, 3882, 6475), ("c", 0.2, 0.2, 100, 100)):
        z = abs(p1 - p2) / math.sqrt(p1 * (1 - p1) / n1 + p2 * (1 - p2) / n2) - NormalDist().inv_cdf(1 - 0.05 / 54)
        z2 = (NormalDist().inv_cdf(0.975) + NormalDist().inv_cdf(0.8)) ** 2
        needed = math.ceil(z2 * (p1 * (1 - p1) + p2 * (1 - p2) / (6475 / 3882)) / (p1 - p2) ** 2) if p1 != p2 else -1
        out.append(f"('{name}', {p1}::DOUBLE, {p2}::DOUBLE, {n1}::DOUBLE, {n2}::DOUBLE, {0.5 * (1 + math.erf(z / math.sqrt(2))):.6f}::DOUBLE, {needed}::BIGINT)")
    return ", ".join(out)


ORACLE_SQL = {
    "two_proportion_power": f"SELECT * FROM (VALUES {_two_proportion_values()}) t(name, p1, p2, n1, n2, power, n_needed)",
    "length_stats_by_group": f'SELECT role AS "group", {_STATS} FROM ({_REPLIES}) GROUP BY role',
    "length_stats_by_language": f'SELECT lang AS "group", {_STATS} FROM (SELECT lang, {W.format("text")} AS w FROM documents) GROUP BY lang',
    "length_boxes": f"WITH r AS ({_REPLIES}), q AS (SELECT role, quantile_cont(w, 0.25) AS q1, quantile_cont(w, 0.5) AS median, quantile_cont(w, 0.75) AS q3 FROM r GROUP BY role) "
    'SELECT role AS "group", round(q1, 6) AS q1, round(median, 6) AS median, round(q3, 6) AS q3, min(w) AS low, max(w) AS high FROM r JOIN q USING (role) WHERE w BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1) GROUP BY ALL',
    "needle_rate_by_group": f"WITH g AS (SELECT role, count(*) AS n, 100.0 * count(*) FILTER (q) / count(*) AS rate FROM ({_REPLIES}) GROUP BY role) "
    "SELECT role AS \"group\", n, round(rate, 6) AS rate, round((SELECT rate FROM g WHERE role = 'user') / nullif(rate, 0), 6) AS ratio FROM g",
    "needle_rate_by_band": f'SELECT role AS "group", {", ".join(_BAND.format(*b) for b in analysis.BANDS)} FROM ({_REPLIES}) GROUP BY role',
    "coverage_grid": _GRID + "SELECT model, strategy, CAST(sum(n) AS BIGINT) AS replies, count(*) FILTER (n = 0) AS missing_sets, CAST(sum(blank) AS BIGINT) AS blank_bodies FROM grid GROUP BY ALL",
    "incomplete_threads": _GRID + "SELECT count(*) AS threads, count(*) FILTER (gap) AS incomplete FROM (SELECT conv_id, bool_or(n = 0) AS gap FROM grid GROUP BY 1)",
    "pattern_threads": f"WITH r AS ({_REPLIES}) SELECT DISTINCT conv_id AS submission_id FROM r a WHERE role = 'user' AND q AND (SELECT count(*) FROM r b WHERE b.conv_id = a.conv_id AND b.role = 'user') = 1 AND NOT EXISTS (SELECT 1 FROM r c WHERE c.conv_id = a.conv_id AND c.role <> 'user' AND c.q)",
    "candidate_filter_min_chars": "SELECT CAST(doc_id AS VARCHAR) AS id, CAST(length(trim(text, chr(32) || chr(9) || chr(10) || chr(13))) AS BIGINT) AS chars FROM documents WHERE length(trim(text, chr(32) || chr(9) || chr(10) || chr(13))) >= 120",
    "thread_counts_and_fraction": f"WITH {_THREADS} SELECT CAST(conv_id AS VARCHAR) AS submission_id, count(*) AS total_comments, count(*) FILTER (role = 'user') AS layperson_comments, count(*) FILTER (role <> 'user') AS clinician_comments, round(count(*) FILTER (role = 'user') / count(*), 6) AS layperson_fraction FROM r GROUP BY conv_id",
    "count_cross_check": f"WITH {_THREADS}, f AS (SELECT conv_id FROM p ORDER BY CAST(conv_id AS VARCHAR) LIMIT 100), n AS (SELECT conv_id, count(*) AS n FROM r GROUP BY 1) SELECT count(*) AS checked, count(*) FILTER (f.conv_id % 5 <> coalesce(n, 0)) AS mismatches FROM f LEFT JOIN n USING (conv_id)",
    "moderation_anti_filter": "SELECT d.doc_id, d.lang FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id WHERE NOT coalesce(l.toxic = 1, false)",
    "self_reply_filter": "SELECT concat(c.conv_id, '-', c.turn) AS id, CAST(c.conv_id AS VARCHAR) AS submission_id, c.role AS author FROM conversations c LEFT JOIN (SELECT conv_id, role FROM conversations WHERE turn = 0) p ON c.conv_id = p.conv_id WHERE c.turn >= 1 AND NOT coalesce(c.role <> '' AND p.role <> '' AND c.role = p.role, false)",
    "eligible_threads": f"WITH {_THREADS}, k AS (SELECT r.*, p.text AS post FROM r JOIN p USING (conv_id) WHERE r.role <> p.role AND r.conv_id % 7 <> 0 AND NOT regexp_matches(lower(p.text), '(i\\.redd\\.it|preview\\.redd\\.it|imgur\\.com|\\.jpg|\\.jpeg|\\.png|\\.gif|\\.webp|\\.heic)')) SELECT CAST(conv_id AS VARCHAR) AS id, count(*) AS n_comments, count(*) FILTER (role = 'user') AS n_layperson, count(*) FILTER (role <> 'user') AS n_clinician FROM k GROUP BY conv_id",
    "reply_count_summary": 'WITH n AS (SELECT conv_id, count(*) AS n FROM conversations WHERE turn >= 1 GROUP BY 1) SELECT count(*) AS threads, min(n) AS least, max(n) AS most, round(avg(n), 6) AS mean, round(median(n), 6) AS median, count(*) FILTER (n = 0) AS "without", count(*) FILTER (n >= 1) AS with_any FROM n',
    "field_match_exact": "SELECT event_id, lower(event_type) AS value_lc FROM events WHERE lower(event_type) IN ('click', 'purchase')",
    "field_match_partial": "SELECT doc_id, lower(source) AS value_lc FROM documents WHERE contains(lower(source), 'c1') OR contains(lower(source), '9')",
    "field_match_regex": "SELECT doc_id, lower(source) AS value_lc FROM documents WHERE regexp_matches(lower(source), '[05]$') OR regexp_matches(lower(source), '^src1.$')",
    "file_error_report": "SELECT concat('RC_', doc_id % 4) AS file_name, count(*) AS lines_processed, count(*) FILTER (toxic <> 0 OR toxic IS NULL OR quality IS NULL) AS error_lines, count(*) FILTER (toxic = 0 AND quality = 1) AS lines_matched, count(*) FILTER (toxic <> 0 OR toxic IS NULL OR quality IS NULL) > count(*) * 0.1 AS over_rate FROM labels GROUP BY 1",
    "split_display_names": "SELECT lower(source) AS value_lc, arg_min(CASE WHEN doc_id % 3 = 0 THEN upper(source) ELSE source END, doc_id) AS display, count(*) AS n FROM documents WHERE regexp_full_match(lower(source), 'src(1?[0-9])') GROUP BY 1",
    "url_pattern_filter": "SELECT page_id, url FROM pages WHERE NOT regexp_matches(lower(url), '(blog\\.|page=2|\\.org)')",
    "keyword_filter": "SELECT doc_id FROM documents WHERE regexp_matches(lower(text), '(^|[^\\p{L}\\p{N}\\p{M}_])(the|und|que|des)($|[^\\p{L}\\p{N}\\p{M}_])')",
    "json_field_extract": "SELECT CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, count(*) AS n FROM events GROUP BY 1",
    "last_wins_dedupe": "SELECT user_id, event_id, event_type FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1",
    "ordered_thread_collect": "SELECT CAST(conv_id AS VARCHAR) AS submission_id, string_agg(trim(regexp_replace(text, '\\s+', ' ', 'g')), ' / ' ORDER BY turn) AS joined, count(*) AS n FROM conversations WHERE turn >= 1 GROUP BY conv_id",
    "hash_sample": "SELECT doc_id, lang FROM documents ORDER BY md5(concat(doc_id, ':42')) LIMIT 100",
    "resume_anti_join": "SELECT doc_id AS id FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id)",
    "workload_estimate": f"WITH {_SIZED} SELECT strategy, count(*) AS threads, CAST(sum(CASE strategy WHEN 'dg' THEN 1 ELSE n END) AS BIGINT) AS calls, round(sum(CASE strategy WHEN 'dg' THEN base WHEN 'sag' THEN base * n ELSE base * n + 80 * n * (n - 1) / 2 END), 6) AS tokens_in, round(sum(80.0::DOUBLE * n), 6) AS tokens_out FROM s, (VALUES ('dg'), ('sag'), ('sagii')) t(strategy) GROUP BY strategy",
    "call_usage": f"SELECT CAST(conv_id % 3 AS VARCHAR) AS model, count(*) AS calls, count(*) FILTER (turn % 5 = 4) AS failures, CAST(sum(length(text)) AS BIGINT) AS tokens_in, CAST(sum({W.format('text')}) AS BIGINT) AS tokens_out FROM conversations GROUP BY 1",
    "cost_rollup": f"WITH p(i, model, a, b) AS (VALUES (0, 'gemini', 1.25::DOUBLE, 10.0::DOUBLE), (1, 'openai', 1.25, 15.0), (2, 'grok', 1.5, 5.0)) SELECT coalesce(model, 'TOTAL') AS model, CAST(sum(length(text)) AS BIGINT) AS tokens_in, CAST(sum({W.format('text')}) AS BIGINT) AS tokens_out, round(sum(length(text) / 1e6 * a + {W.format('text')} / 1e6 * b), 4) AS cost FROM conversations JOIN p ON conv_id % 3 = i GROUP BY ROLLUP (model)",
    "prior_context": "WITH r AS (SELECT conv_id, turn, text AS t, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS i FROM conversations WHERE turn >= 1) SELECT conv_id AS submission_id, turn AS pos, coalesce(string_agg(concat('Comment ', i, ': ', t, chr(10), chr(10)), '') OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS prior FROM r",
    "sheet_layout": (
        f"WITH {_SIZED}, r AS (SELECT c.* FROM conversations c JOIN s USING (conv_id) WHERE turn >= 1), "
        "k AS (SELECT conv_id, count(*) FILTER (role = 'user') AS l, count(*) FILTER (role <> 'user') AS c FROM r GROUP BY 1), "
        "h AS (SELECT s.conv_id, row_number() OVER (ORDER BY s.conv_id) AS i, left(s.text, 40) AS title, s.text, k.l, k.c FROM s JOIN k USING (conv_id)), "
        "m AS (SELECT *, left(translate(concat(i, '. ', left(title, 26)), '[]*?/\\:', ''), 31) AS name FROM h), "
        "cells AS (SELECT i, name, 0 AS s, unnest([0, 1, 2, 3]) AS r, unnest(['Opening Post', 'Title:', 'Body:', 'Real breakdown:']) AS a, unnest([NULL, title, text, concat(c, ' clinician, ', l, ' layperson (', c + l, ' total)')]) AS b FROM m "
        "UNION ALL SELECT i, name, sec, 0, t, NULL FROM m, (VALUES (1, 'Real Comments'), (2, 'Synthetic: DG (Discourse Generation)'), (3, 'Synthetic: SAG (Single Advice Generation)'), (4, 'Synthetic: SAGII (SAG + Incremental Info)')) x(sec, t) "
        "UNION ALL SELECT i, name, sec, 1, 'Author Type', 'Comment' FROM m, (VALUES (1), (2), (3), (4)) x(sec) "
        "UNION ALL SELECT i, name, 1, 1 + row_number() OVER (PARTITION BY conv_id ORDER BY turn), 'Layperson/not verified', r.text FROM r JOIN m USING (conv_id) WHERE role = 'user' "
        "UNION ALL SELECT i, name, turn % 3 + 2, 1 + row_number() OVER (PARTITION BY conv_id, turn % 3 ORDER BY turn), role, r.text FROM r JOIN m USING (conv_id) WHERE role = 'assistant') "
        "SELECT CAST(i AS BIGINT) AS sheet_idx, name AS sheet_name, CAST(s AS BIGINT) AS section_ord, CAST(r AS BIGINT) AS row_ord, a AS col_a, b AS col_b FROM cells"
    ),
    "text_previews": "WITH t AS (SELECT doc_id, trim(regexp_replace(text, '\\s+', ' ', 'g')) AS x FROM documents) SELECT doc_id, CASE WHEN length(x) > 300 THEN concat(left(x, 300), '...') ELSE x END AS preview FROM t",
    "nested_thread_export": f"WITH {_THREADS} SELECT CAST(p.conv_id AS VARCHAR) AS submission_id, left(p.text, 40) AS title, (SELECT count(*) FROM r WHERE r.conv_id = p.conv_id AND role = 'user') AS n_comments, coalesce((SELECT string_agg(text, '|' ORDER BY turn) FROM r WHERE r.conv_id = p.conv_id AND role = 'user'), '') AS real, (SELECT count(*) FROM r WHERE r.conv_id = p.conv_id AND role = 'assistant') AS n_synthetic FROM p WHERE EXISTS (SELECT 1 FROM r WHERE r.conv_id = p.conv_id AND role = 'assistant')",
    "generated_replies": f"WITH {_SIZED} SELECT CAST(conv_id AS VARCHAR) AS submission_id, strategy, n AS n_comments, n AS n_replies, CAST(CASE strategy WHEN 'dg' THEN 1 ELSE n END AS BIGINT) AS calls, CAST(0 AS BIGINT) AS failures, 'done' AS status FROM s, (VALUES ('dg'), ('sag'), ('sagii')) t(strategy)",
}
