"""Queries over forum records, files and model answers made from the stand-in tables, and the SQL that each must agree with.

Unlike the plain stand-ins these rows hold what real dumps hold: a bot,
moderated and removed replies, replies to replies, orphans, missing links and
authors, equal and missing times. Files are written under the shared folder
and read by the engine's own readers.
"""

from __future__ import annotations

import json
import math
from statistics import NormalDist

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .functions.text import parse_replies
from .operators import analysis, corpus, export, generation, match, power, prompts, sampling, threads
from .plans import study
from .sources import ndjson, schemas, sinks
from .sources.scratch import fresh_folder

ARMS = tuple(prompts.RATIO_ARMS)


def _table(spark, sf, name) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def _round(c, n=6):
    return F.round(F.col(c) if isinstance(c, str) else c, n)


# The same rows in both languages: an expression of Spark SQL and of DuckDB for each column.
_FORUM = {
    "id": "concat(conv_id, '-', turn)",
    "body": "CASE (conv_id + turn) % 7 WHEN 0 THEN '[removed]' WHEN 1 THEN '[deleted]' WHEN 2 THEN NULL ELSE text END",
    "author": "CASE WHEN (conv_id + turn) % 11 = 0 THEN 'AutoModerator' WHEN (conv_id + turn) % 11 = 1 THEN 'automoderator' WHEN (conv_id + turn) % 11 = 2 THEN NULL ELSE role END",
    "author_flair_text": "CASE WHEN role = 'user' THEN 'Layperson/not verified' WHEN turn % 3 = 0 THEN 'Physician' WHEN turn % 3 = 1 THEN '' END",
    "link_id": "CASE (conv_id + 2 * turn) % 17 WHEN 0 THEN NULL WHEN 1 THEN concat('t3_none', conv_id) WHEN 2 THEN concat('x', conv_id) ELSE concat('t3_', conv_id) END",
    "score": "CAST(turn * 3 AS BIGINT)",
    "created_utc": "CASE WHEN (conv_id + turn) % 5 = 0 THEN NULL ELSE CAST(turn % 3 AS DOUBLE) END",
    "is_submitter": "CASE WHEN turn % 2 = 0 THEN true END",
    "removal": "CASE (3 * conv_id + turn) % 8 WHEN 0 THEN 'deleted' WHEN 1 THEN 'removed' WHEN 2 THEN 'author' WHEN 3 THEN 'removed by reddit' END",
    "seq": "CAST(turn AS BIGINT)",
}
_PARENT = "CASE WHEN turn % 4 = 3 THEN concat('t1_', conv_id, '-', turn - 1) WHEN (conv_id + turn) % 19 = 0 THEN '' ELSE link_id END"
_FR = (
    f"fr0 AS (SELECT conv_id, turn, {', '.join(f'{e} AS {n}' for n, e in _FORUM.items())} FROM conversations WHERE turn >= 1), fr AS (SELECT *, {_PARENT} AS parent_id FROM fr0), "
    "po AS (SELECT CAST(conv_id AS VARCHAR) AS id, left(text, 40) AS title, text AS selftext FROM conversations WHERE turn = 0)"
)
_KEPT = (
    f"{_FR}, kept AS (SELECT *, split_part(link_id, '_', 2) AS submission_id FROM fr WHERE author IS DISTINCT FROM 'AutoModerator' AND coalesce(removal NOT IN ('deleted', 'removed', 'removed by reddit'), true) "
    "AND link_id <> '' AND parent_id <> '' AND parent_id = link_id AND split_part(link_id, '_', 2) IN (SELECT id FROM po))"
)
_TOP = f"{_FR}, top AS (SELECT *, substr(parent_id, 4) AS submission_id FROM fr WHERE starts_with(parent_id, 't3_'))"


def _forum(spark, sf) -> DataFrame:
    """Replies as a dump holds them."""
    rows = _table(spark, sf, "conversations").where("turn >= 1").selectExpr("conv_id", "turn", *(f"{e} AS {n}" for n, e in _FORUM.items()))
    rows = rows.selectExpr("*", f"{_PARENT} AS parent_id", "named_struct('removal_type', removal) AS _meta", "'RC_1' AS file_name", "CAST(conv_id AS BIGINT) AS file_block")
    return rows.drop("removal", "conv_id", "turn")


def _forum_posts(spark, sf) -> DataFrame:
    rows = _table(spark, sf, "conversations").where("turn = 0").selectExpr("CAST(conv_id AS STRING) AS id", "left(text, 40) AS title", "text AS selftext")
    more = {"author": "string", "author_flair_text": "string", "score": "bigint", "num_comments": "bigint", "created_utc": "double", "permalink": "string", "subreddit": "string", "preview": "string", "total_top_level_comments": "bigint", "layperson_comment_fraction": "double"}
    return rows.select("*", *(F.lit(None).cast(t).alias(n) for n, t in more.items()))


def _sets(spark, sf) -> DataFrame:
    """Assistant turns as generated sets; model gemini, openai or grok by conv_id, strategy by turn."""
    rows = _table(spark, sf, "conversations").where("turn >= 1 AND role = 'assistant'")
    pick = lambda names, i: F.element_at(F.array(*map(F.lit, names)), (i % 3 + 1).cast("int"))
    item = F.struct("turn", F.struct(F.col("text").alias("body"), F.col("role").alias("author_type")).alias("c"))
    keys = [F.col("conv_id").cast("string").alias("submission_id"), pick(analysis.MODELS, F.col("conv_id")).alias("model"), pick(analysis.STRATEGIES, F.col("turn")).alias("strategy")]
    rows = rows.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(item)), lambda x: x["c"]).alias("comments"))
    return rows.withColumn("model_id", F.lit("m")).withColumn("n_comments", F.size("comments").cast("bigint"))


_SETS = (
    "sets AS (SELECT CAST(conv_id AS VARCHAR) AS submission_id, ['gemini', 'openai', 'grok'][CAST(conv_id % 3 AS INT) + 1] AS model, ['dg', 'sag', 'sagii'][CAST(turn % 3 AS INT) + 1] AS strategy, turn, text, "
    "row_number() OVER (PARTITION BY conv_id, turn % 3 ORDER BY turn) - 1 AS pos FROM conversations WHERE turn >= 1 AND role = 'assistant')"
)


# corpus


def retained_forum_replies(spark, sf):
    return corpus.retained_replies(_forum(spark, sf), _forum_posts(spark, sf)).select("id", "submission_id", "author")


def posts_with_counts(spark, sf):
    posts = _forum_posts(spark, sf)
    metadata = corpus.thread_metadata(corpus.retained_replies(_forum(spark, sf), posts))
    return corpus.final_posts(posts, metadata).select("id", "title", "total_top_level_comments", _round("layperson_comment_fraction").alias("layperson_comment_fraction"))


def corpus_row_counters(spark, sf):
    posts, replies = _forum_posts(spark, sf), _forum(spark, sf)
    kept = corpus.candidates(posts, 60)
    return corpus.row_counters(posts=posts, candidates=kept, replies=replies, retained=corpus.retained_replies(replies, kept))


def top_level_replies(spark, sf):
    return threads.top_level(_forum(spark, sf)).select("id", "submission_id")


def real_replies(spark, sf):
    return _forum(spark, sf).where(threads.is_real()).select("id")


def built_corpus(spark, sf):
    """Every post twice, the later one with another title: the last record wins."""
    posts = _forum_posts(spark, sf)
    twice = posts.withColumn("seq", F.lit(1)).unionByName(posts.withColumn("title", F.concat(F.lit("again "), "title")).withColumn("seq", F.lit(2)))
    twice = twice.withColumn("file_name", F.lit("RS_1")).withColumn("file_block", F.col("id").cast("bigint"))
    built = study.build_corpus(twice, _forum(spark, sf), 60)
    return built.posts.select("id", "title", "total_top_level_comments", F.col("first_seq.seq").cast("bigint").alias("first_seq"))


def replies_in_time_order(spark, sf):
    rows = export.ordered_replies(threads.top_level(_forum(spark, sf)), "id")
    return rows.select("submission_id", F.array_join("comments.id", " ").alias("ids"))


# nested records


def _arms(spark, sf) -> DataFrame:
    made = _sets(spark, sf)
    none = F.array().cast("array<struct<body: string, author_type: string>>")
    cells = [F.coalesce(F.first(F.when(F.col("strategy") == s, F.col("comments")), ignorenulls=True), none).alias(a) for s, a in zip(analysis.STRATEGIES, ARMS, strict=True)]
    return made.groupBy("submission_id").agg(F.lit(0).alias("n_top_level_comments"), *cells)


def _combined(spark, sf) -> DataFrame:
    return export.combined_records(_forum_posts(spark, sf), threads.top_level(_forum(spark, sf)), _arms(spark, sf))


def combined_thread_records(spark, sf):
    r = _combined(spark, sf)
    submitted = F.size(F.filter("real_comments", lambda c: c["is_submitter"]))
    return r.select("submission_id", F.col("submission.title").alias("title"), F.array_join("real_comments.id", " ").alias("ids"), submitted.cast("bigint").alias("by_submitter"), *(F.array_join(f"{a}.body", "|").alias(a) for a in ARMS))


def combined_totals(spark, sf):
    t = analysis.totals_by_strategy(_combined(spark, sf), ("real_comments", *ARMS))
    return t.select("threads", "real_comments", *ARMS, *(_round(f"{c}_mean").alias(f"{c}_mean") for c in ("real_comments", *ARMS)))


def strategy_totals(spark, sf):
    made = _sets(spark, sf).groupBy("submission_id").agg(*(F.first(F.when(F.col("strategy") == s, F.col("comments")), ignorenulls=True).alias(s) for s in analysis.STRATEGIES))
    t = analysis.totals_by_strategy(made, analysis.STRATEGIES)
    return t.select("threads", *analysis.STRATEGIES, *(_round(f"{s}_mean").alias(f"{s}_mean") for s in analysis.STRATEGIES))


def arms_as_rows(spark, sf):
    rows = export.arms_long(_arms(spark, sf), ARMS)
    return rows.select("submission_id", "strategy", F.col("pos").cast("bigint").alias("pos"), "author_type", "body")


def first_three_replies(spark, sf):
    """The limit comes before removed replies are left out, as in the study."""
    records = export.ordered_replies(threads.top_level(_forum(spark, sf)), "id", "body", name="real_comments")
    first = export.first_replies(records, 3)
    real = F.filter("real_comments", lambda c: ~F.coalesce(c["body"], F.lit("")).isin(*threads.REMOVED))
    return first.select("submission_id", F.array_join(F.transform(real, lambda c: c["id"]), " ").alias("ids"))


def analysis_record_fields(spark, sf):
    """The last checkpoint's record with removed replies counted but not listed."""
    posts, replies = _forum_posts(spark, sf), threads.top_level(_forum(spark, sf))
    r = export.analysis_records(posts, replies, _sets(spark, sf))
    cells = [F.array_join(f"synthetic.{m}.{s}.body", "|").alias(f"{m}_{s}") for m in analysis.MODELS for s in analysis.STRATEGIES]
    return r.select("submission_id", "title", "n_comments", F.array_join("real_comments.author_flair_text", "|", "-").alias("flairs"), F.array_join("real_comments.body", "|").alias("real"), *cells)


# comparison


def _real(spark, sf) -> DataFrame:
    return threads.top_level(_forum(spark, sf)).where(threads.is_real()).select("submission_id", "body")


def long_reply_table(spark, sf):
    rows = analysis.long_replies(_real(spark, sf), _sets(spark, sf), ",")
    return rows.groupBy("submission_id", "group").agg(F.count("*").alias("n"), F.sum("n_words").alias("words"), F.count_if("has_needle").alias("with_needle"), F.coalesce(F.max("pos"), F.lit(-1)).alias("last"))


def pattern_thread_share(spark, sf):
    rows = analysis.long_replies(_real(spark, sf), _sets(spark, sf), ",")
    n = _table(spark, sf, "conversations").select("conv_id").distinct().count()
    return analysis.pattern_share(rows, n).select("threads", _round("percent").alias("percent"))


def rates_of_all_groups(spark, sf):
    """Groups without replies stay, with no rate."""
    dimension = spark.createDataFrame([(g,) for g in [*analysis.groups(), "none/dg"]], "group string")
    rates = analysis.needle_rates(analysis.long_replies(_real(spark, sf), _sets(spark, sf), ","), dimension)
    return rates.select("group", "n", _round("rate").alias("rate"), _round("ratio").alias("ratio"))


# files


def _lines(spark, sf) -> DataFrame:
    """Events as JSON lines, one folder of files for each day of the month; every 50th line is broken and every 70th blank."""
    line = F.to_json(F.struct("event_id", "event_type", "user_id"))
    broken = F.when(F.col("event_id") % 50 == 0, F.left(line, F.lit(9))).when(F.col("event_id") % 70 == 0, F.lit("  ")).otherwise(line)
    return _table(spark, sf, "events").select(broken.alias("value"), (F.col("event_id") % 4).alias("part"))


_GOOD = "event_id % 50 <> 0 AND event_id % 70 <> 0"
_EVENT = schemas.fields("event_id bigint, event_type string, user_id bigint")


def _written_lines(spark, sf) -> str:
    path = fresh_folder(spark)
    for part, name in enumerate(("RC_2024-01", "RS_2024-01", "RC_2024-02", "other")):
        _lines(spark, sf).where(F.col("part") == part).select("value").write.option("compression", "gzip").text(f"{path}/{name}")
    return path


def _named(lines: DataFrame) -> DataFrame:
    """Spark names its files itself: the folder stands for the file."""
    return lines.withColumn("file_name", F.element_at(F.split("file_path", "/"), -2))


def dump_lines_by_file(spark, sf):
    lines = _named(ndjson.read_lines(spark, _written_lines(spark, sf), recursive=True)).where(F.col("file_name").rlike(ndjson.DUMP_NAME))
    return lines.withColumn("kind", ndjson.file_kind(F.col("file_name"))).groupBy("kind", "file_name").agg(F.count("*").alias("n"), F.sum(F.octet_length("value")).alias("bytes"))


def tolerant_jsonl(spark, sf):
    return ndjson.read_jsonl(spark, _written_lines(spark, sf), _EVENT, strict=False, recursive=True).select("event_id", "event_type", "user_id")


def strict_jsonl(spark, sf):
    path = fresh_folder(spark)
    sinks.write_jsonl(_table(spark, sf, "events").select("event_id", F.nullif("event_type", F.lit("click")).alias("event_type"), "user_id"), path, "gzip")
    return ndjson.read_jsonl(spark, path, _EVENT).select("event_id", "event_type", "user_id")


def explicit_nulls(spark, sf):
    """Null fields are written, not left out."""
    path = fresh_folder(spark)
    sinks.write_jsonl(_table(spark, sf, "events").select("event_id", F.nullif("event_type", F.lit("click")).alias("event_type")), path)
    lines = spark.read.text(path)
    return lines.agg(F.count("*").alias("n"), F.count_if(F.contains("value", F.lit('"event_type":null'))).alias("nulls"))


def missing_input(spark, sf):
    """An optional file that is not there is an empty table."""
    none = ndjson.read_if_present(spark, f"{fresh_folder(spark)}/none.jsonl", _EVENT)
    return none.agg(F.count("*").alias("n"))


def head_of_files(spark, sf):
    rows = _table(spark, sf, "documents").select("doc_id", F.concat(F.lit("f"), (F.col("doc_id") % 3).cast("string")).alias("file_name"), F.lit(0).alias("file_block"), F.col("doc_id").alias("seq"))
    return ndjson.head(rows, 5).select("doc_id", "file_name")


def split_shard(spark, sf):
    """Matched lines are split by value, and one shard, that of a first letter, is read again."""
    rows = _table(spark, sf, "events").select("event_id", "event_type")
    lines = rows.select(F.to_json(F.struct("event_id", "event_type")).alias("value"), F.lit("RC_1").alias("file_name"), F.lit(0).alias("file_block"), F.col("event_id").alias("seq"))
    path = fresh_folder(spark)
    sinks.write_split(match.matching(match.classify(lines, match.Match("event_type", ("click", "cart", "purchase", "never")))), path)
    shard = ndjson.read_shard(spark, path, "c")
    return shard.groupBy("kind", "value_lc").agg(F.count("*").alias("n"), F.sum(F.get_json_object("raw", "$.event_id").cast("bigint")).alias("ids"))


def single_output(spark, sf):
    rows = _table(spark, sf, "documents").select("doc_id", "source")
    lines = rows.select(F.to_json(F.struct("doc_id", "source")).alias("value"), F.lit("RS_1").alias("file_name"), F.lit(0).alias("file_block"), F.col("doc_id").alias("seq"))
    path = fresh_folder(spark)
    sinks.write_single(match.matching(match.classify(lines, match.Match("source", ("1",), "partial")), F.lit("SUBMISSION")), path)
    return spark.read.text(path).groupBy("kind").agg(F.count("*").alias("n"), F.sum(F.get_json_object("value", "$.doc_id").cast("bigint")).alias("ids"))


def metadata_csv(spark, sf):
    posts = _forum_posts(spark, sf)
    path = fresh_folder(spark)
    sinks.write_metadata_csv(corpus.thread_metadata(corpus.retained_replies(_forum(spark, sf), posts)), path)
    rows = spark.read.option("header", True).option("lineSep", "\r\n").schema(schemas.METADATA).csv(path)
    return rows.select("submission_id", "total_comments", "layperson_comments", _round("layperson_fraction").alias("layperson_fraction"))


def compressed_copy(spark, sf):
    """The copy's records; sizes go to the report and depend on the codec."""
    path = fresh_folder(spark)
    report = sinks.write_with_copy(_table(spark, sf, "documents").select("doc_id", "text"), path)
    return spark.read.json(f"{path}.gz").agg(F.count("*").alias("n"), F.sum("doc_id").alias("ids")).withColumn("smaller", F.lit(report["ratio"] < 1))


def generated_files(spark, sf):
    """Sets in files named after model and strategy, some of whose records lack both; every task writes its own part of a file."""
    path = fresh_folder(spark)
    made = _sets(spark, sf)
    for m in analysis.MODELS:
        for s in analysis.STRATEGIES:
            own = made.where((F.col("model") == m) & (F.col("strategy") == s))
            bare = own.withColumn("model", F.when(F.col("submission_id").cast("bigint") % 2 == 0, F.col("model"))).withColumn("strategy", F.when(F.col("model").isNotNull(), F.col("strategy")))
            bare.write.json(f"{path}/{m}_{s}.jsonl")
    rows = ndjson.read_generated_files(spark, path, schemas.GENERATED, folders=True)
    return rows.select("submission_id", "model", "strategy", F.size("comments").cast("bigint").alias("n"))


def manifest_files(spark, sf):
    """A status file's list of files as rows."""
    files = _table(spark, sf, "labels").groupBy((F.col("doc_id") % 4).alias("f")).agg(F.count("*").alias("lines"), F.count_if(F.col("toxic") == 1).alias("errors"))
    entry = F.to_json(F.array(F.concat(F.lit("in"), F.col("f").cast("string")), F.concat(F.lit("out"), F.col("f").cast("string")), F.lit("true"), F.col("lines").cast("string"), F.col("errors").cast("string"), F.lit("0")))
    path = fresh_folder(spark)
    files.agg(F.concat(F.lit('{"args": "a", "files": ['), F.array_join(F.collect_list(entry), ", "), F.lit("]}")).alias("value")).coalesce(1).write.text(path)
    return ndjson.read_manifest(spark, path)


def match_value_list(spark, sf):
    values = _table(spark, sf, "labels").select(F.concat(F.lit("  SRC"), (F.col("doc_id") % 7).cast("string"), F.lit(" ")).alias("v"))
    return match.match_values(_table(spark, sf, "documents").select("doc_id", "source"), "source", values)


def scan_progress(spark, sf):
    """Lines read and the rate over the last samples of each file."""
    log = _table(spark, sf, "events").select(F.col("event_type").alias("file_name"), F.col("event_id").alias("at"), (F.col("event_id") * 10 + F.col("user_id") % 10).alias("lines"))
    return match.progress(log, 40).select("file_name", "at", "lines", _round("rate").alias("rate"))


def files_by_size(spark, sf):
    """Every task writes its own lines, so that a name's file is a folder of as many parts as tasks had lines for it."""
    path = fresh_folder(spark)
    rows = _table(spark, sf, "documents").select("text", F.concat(F.lit("k"), (F.col("doc_id") % 5).cast("string")).alias("k")).where("text IS NOT NULL")
    rows.select(F.base64(F.encode("text", "utf-8")).alias("value"), "k").select(F.regexp_replace("value", r"\s", "").alias("value"), "k").write.partitionBy("k").text(path)
    listed = ndjson.largest_first(spark, path, folders=True)
    return listed.select(F.regexp_extract("path", "/k=([^/]+)$", 1).alias("name"), "bytes", "turn")


# prompts and answers


def _sized(spark, sf) -> DataFrame:
    posts = _forum_posts(spark, sf).select("id", "title", "selftext")
    counts = _table(spark, sf, "conversations").where("turn >= 1").groupBy(F.col("conv_id").cast("string").alias("id")).agg(F.count("*").alias("n_comments"), F.count_if(F.col("role") == "user").alias("n_layperson"))
    return posts.join(counts, "id").withColumn("n_clinician", F.col("n_comments") - F.col("n_layperson"))


_SIZED = "sized AS (SELECT p.id, p.title, p.selftext, n.n AS n_comments, n.l AS n_layperson, n.n - n.l AS n_clinician FROM po p JOIN (SELECT CAST(conv_id AS VARCHAR) AS id, count(*) AS n, count(*) FILTER (role = 'user') AS l FROM conversations WHERE turn >= 1 GROUP BY 1) n USING (id))"
_MIX = "CASE WHEN n_layperson = 0 THEN 'all by clinicians' WHEN n_clinician = 0 THEN 'all by laypersons' ELSE concat(n_clinician, ' by clinicians and ', n_layperson, ' by laypersons') END"


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _filled_sql(template: str, **values: str) -> str:
    """The template as a SQL expression."""
    out, rest = [], template
    while rest:
        found = min(((rest.find("{" + n + "}"), n) for n in values if "{" + n + "}" in rest), default=None)
        if found is None:
            out.append(_quoted(rest))
            break
        at, name = found
        out += [_quoted(rest[:at]), values[name]]
        rest = rest[at + len(name) + 2 :]
    return f"concat({', '.join(out)})"


def prompt_texts(spark, sf):
    rows = _sized(spark, sf)
    mix = prompts.role_mix(F.col("n_clinician"), F.col("n_layperson"))
    prior = F.array(F.lit("one"), F.col("title"))
    return rows.select("id", prompts.thread_prompt(mix=mix).alias("thread"), prompts.single_prompt(F.lit("layperson")).alias("single"), prompts.incremental_prompt(F.lit("clinician"), prior).alias("incremental"))


def prompt_with_braces(spark, sf):
    """A value that looks like a name to fill in stays as it is."""
    rows = _sized(spark, sf).withColumn("title", F.concat(F.lit("{body} {n} "), "id"))
    made = generation.generate(rows, generation.PROVIDERS["grok"], "dg", generation.Calls(provider=_echo, tries=1))
    return made.select("submission_id", F.col("comments")[0]["body"].alias("body"))


def _echo(prompt: str, n: int, role: str) -> str:
    """The prompt itself as a reply."""
    return json.dumps([{"body": prompt, "author_type": role}] * n)


def _counting(prompt: str, n: int, role: str) -> str:
    """How many replies the prompt shows."""
    return json.dumps([{"body": str(prompt.count("Comment ")), "author_type": role}] * n)


def _messy(prompt: str, n: int, role: str) -> str:
    """Too many replies, some of them none."""
    return json.dumps({"comments": ["not one", {"body": None}, 5, *({"body": f"r{i}", "author_type": None} for i in range(n + 3))]})


def _failing(prompt: str, n: int, role: str) -> str:
    if len(prompt) % 2:
        raise OSError("no answer")
    return json.dumps([{"body": "ok"}] * n)


def incremental_context(spark, sf):
    """Each reply of sagii sees those before it, those of sag see none."""
    calls = generation.Calls(provider=_counting, tries=1)
    rows = _sized(spark, sf).select("id", F.lit("t").alias("title"), F.lit("b").alias("selftext"), "n_comments")
    out = None
    for s in ("sag", "sagii"):
        part = generation.generate(rows, generation.PROVIDERS["grok"], s, calls).select("submission_id", "strategy", F.array_join("comments.body", " ").alias("seen"))
        out = part if out is None else out.unionByName(part)
    return out


def messy_answers(spark, sf):
    calls = generation.Calls(provider=_messy, tries=1)
    made = generation.generate(_sized(spark, sf), generation.PROVIDERS["openai"], "dg", calls)
    return made.select("submission_id", F.array_join("comments.body", ",").alias("bodies"), F.array_join(F.array_distinct("comments.author_type"), ",").alias("roles"), "status")


def failed_calls(spark, sf):
    """Calls fail by the length of their prompt; failed threads are told apart and asked for again."""
    calls = generation.Calls(provider=_failing, tries=2, wait=lambda _: 0.0)
    rows = _sized(spark, sf).select("id", F.lit("").alias("title"), F.repeat(F.lit("x"), F.col("id").cast("int") % 2).alias("selftext"), "n_comments")
    made = generation.generate(rows, generation.PROVIDERS["gemini"], "dg", calls)
    path = fresh_folder(spark)
    sinks.append_checkpoint(made, path)
    done = spark.read.schema(generation.GENERATED).json(path)
    again = generation.remaining(rows, done, "gemini", "dg", retry_failed=True).select(F.col("id").alias("submission_id"), F.lit(True).alias("again"))
    return done.select("submission_id", "status", "calls", "failures").join(again, "submission_id", "left").withColumn("again", F.coalesce("again", F.lit(False)))


def resumed_checkpoint(spark, sf):
    """Two runs over one checkpoint, the first over half of the threads: each thread is made once."""
    rows, path = _sized(spark, sf), fresh_folder(spark)
    provider = generation.PROVIDERS["grok"]
    study.generate_missing(spark, rows.where(F.col("id").cast("bigint") % 2 == 0), provider, "dg", path)
    study.generate_missing(spark, rows, provider, "dg", path)
    lines = spark.read.schema(generation.GENERATED).json(path).groupBy("submission_id").agg(F.count("*").alias("lines"))
    return lines.join(study.generated_sets(spark, path), "submission_id").select("submission_id", "lines", "model", "model_id", "strategy", "n_comments")


def ratio_arm_sets(spark, sf):
    made = generation.ratio_arms(_sized(spark, sf), prompts.RATIO_ARMS)
    return made.select("submission_id", "n_top_level_comments", *(F.size(a).cast("bigint").alias(a) for a in ARMS))


def parsed_answers(spark, sf):
    """Answers as an object, a bare list, and neither."""
    item = F.struct(F.col("text").alias("body"), F.col("role").alias("author_type"))
    answer = F.when(F.col("turn") % 3 == 0, F.to_json(F.struct(F.array(item, item).alias("comments")))).when(F.col("turn") % 3 == 1, F.to_json(F.array(item))).otherwise(F.lit("sorry, no"))
    parsed = _table(spark, sf, "conversations").select("conv_id", "turn", parse_replies(answer).alias("r"))
    return parsed.select("conv_id", "turn", F.coalesce(F.size("r"), F.lit(-1)).cast("bigint").alias("n"), F.col("r")[0]["body"].alias("body"), F.col("r")[0]["author_type"].alias("author_type"))


def role_sequences(spark, sf):
    """A seeded order of each thread's roles: the order is free, the roles are not."""
    rows = _sized(spark, sf).withColumn("roles", sampling.role_sequence("n_clinician", "n_layperson", 42))
    return rows.select("id", F.array_join(F.array_sort("roles"), " ").alias("roles"))


def provider_registry(spark, sf):
    made = generation.registry(["openai=gpt-x"], ["grok=low"])
    rows = [(p.name, p.model_id, p.reasoning_effort, p.price_in, p.price_out) for n in generation.chosen("grok, openai", made) for p in [made[n]]]
    return spark.createDataFrame(rows, "name string, model_id string, effort string, price_in double, price_out double")


def generated_usage(spark, sf):
    """Calls, failures and tokens that our own runs record, estimated by characters where a provider tells none."""
    rows = _sized(spark, sf).select("id", F.lit("").alias("title"), F.repeat(F.lit("x"), F.col("id").cast("int") % 2).alias("selftext"), "n_comments")
    calls = generation.Calls(provider=_failing, tries=1)
    made = [generation.generate(rows, generation.PROVIDERS[m], "dg", calls) for m in ("gemini", "grok")]
    return generation.usage_of(made[0].unionByName(made[1]))


# power


def _contrasts(spark):
    rows = [("a", 0.103, 0.08, 3882.0, 6475.0), ("b", 0.103, 0.095, 3882.0, 6475.0), ("c", 0.103, 0.01, 3882.0, 6475.0), ("d", 0.2, 0.2, 100.0, 100.0)]
    return rows, spark.createDataFrame(rows, "name string, p1 double, p2 double, n1 double, n2 double")


def _phi(x: float) -> float:
    return 0.5 * (1 + math.erf(x / math.sqrt(2)))


def _power_values() -> str:
    """The power of the contrasts at the published sizes and scaled, by the error function."""
    out = []
    for name, p1, p2, n1, n2 in (("a", 0.103, 0.08, 3882, 6475), ("b", 0.103, 0.095, 3882, 6475), ("c", 0.103, 0.01, 3882, 6475), ("d", 0.2, 0.2, 100, 100)):
        z = lambda scale, alpha: _phi(abs(p1 - p2) / math.sqrt(p1 * (1 - p1) / (n1 * scale) + p2 * (1 - p2) / (n2 * scale)) - NormalDist().inv_cdf(1 - alpha / 2))  # noqa: B023, E731
        out.append(f"('{name}', {z(1, 0.05):.6f}::DOUBLE, {z(12464 / 3000, 0.05 / 27):.6f}::DOUBLE)")
    return ", ".join(out)


def contrast_power(spark, sf):
    _, rows = _contrasts(spark)
    now = power.contrasts(rows).select("name", _round("power").alias("power"))
    scaled = power.contrasts(rows, 12464 / 3000, power.bonferroni(0.05, 27)).select("name", _round("power").alias("power_scaled"))
    return now.join(scaled, "name")


_Z2 = (NormalDist().inv_cdf(0.975) + NormalDist().inv_cdf(0.8)) ** 2


def required_sizes(spark, sf):
    _, rows = _contrasts(spark)
    n = power.required_n(F.col("p1"), F.col("p2"), 6475 / 3882)
    return rows.select("name", F.coalesce(n, F.lit(-1)).cast("bigint").alias("replies"), F.coalesce(power.threads_needed(n, 3882 / 3000), F.lit(-1)).cast("bigint").alias("threads"), F.coalesce(power.interaction_threads(F.col("n1") / 100, 4, 3000), F.lit(-1)).cast("bigint").alias("interaction"), _round(power.option_cost(F.col("n2")), 4).alias("cost"))


def adjusted_p_values(spark, sf):
    """The step-up adjustment over made-up tests, some of equal p."""
    rows = _table(spark, sf, "nation").select("n_name", ((F.col("n_nationkey") % 9 + 1) / 100.0).alias("p_value"))
    return power.benjamini_hochberg(rows).select("n_name", _round("p_adjusted").alias("p_adjusted"))


QUERIES = {
    f.__name__: f
    for f in (
        retained_forum_replies, posts_with_counts, corpus_row_counters, top_level_replies, real_replies, built_corpus, replies_in_time_order, combined_thread_records, combined_totals, strategy_totals, arms_as_rows,
        first_three_replies, analysis_record_fields, long_reply_table, pattern_thread_share, rates_of_all_groups, dump_lines_by_file, tolerant_jsonl, strict_jsonl, explicit_nulls, missing_input, head_of_files, split_shard,
        single_output, metadata_csv, compressed_copy, generated_files, manifest_files, match_value_list, scan_progress, files_by_size, prompt_texts, prompt_with_braces, incremental_context, messy_answers, failed_calls,
        resumed_checkpoint, ratio_arm_sets, parsed_answers, role_sequences, provider_registry, generated_usage, contrast_power, required_sizes, adjusted_p_values,
    )
}

_WORDS = r"len(regexp_extract_all(body, '[^\s\x1c-\x1f]+'))"
_LONG = (
    f"{_TOP}, {_SETS}, long AS (SELECT submission_id, 'real' AS g, NULL AS pos, body FROM top WHERE coalesce(body, '') NOT IN ('[removed]', '[deleted]') UNION ALL SELECT submission_id, concat(model, '/', strategy), pos, text FROM sets), "
    f"lr AS (SELECT *, {_WORDS} AS w, contains(body, ',') AS q FROM long WHERE regexp_matches(body, '[^\\s\\x1c-\\x1f]'))"
)
_ORDER = "ORDER BY coalesce(created_utc, 0), conv_id, seq"
_DG, _SINGLE, _INC = prompts.Templates().thread, prompts.Templates().single, prompts.Templates().incremental
_COMBINED = (
    f"{_TOP}, {_SETS}, real AS (SELECT submission_id, string_agg(id, ' ' {_ORDER}) AS ids, count(*) FILTER (is_submitter) AS by_submitter, count(*) AS n FROM top GROUP BY 1), "
    f"arms AS (SELECT submission_id, {', '.join(f'''coalesce(string_agg(text, '|' ORDER BY turn) FILTER (strategy = '{s}'), '') AS {a}, count(*) FILTER (strategy = '{s}') AS n_{s}''' for s, a in zip(analysis.STRATEGIES, ARMS))} FROM sets GROUP BY 1), "
    "c AS (SELECT po.id AS submission_id, po.title, real.*, arms.* FROM po JOIN real ON po.id = real.submission_id JOIN arms ON po.id = arms.submission_id)"
)
_DG_TOKENS = "(len(prompt) // 4)"

ORACLE_SQL = {
    "retained_forum_replies": f"WITH {_KEPT} SELECT id, submission_id, author FROM kept",
    "posts_with_counts": f"WITH {_KEPT} SELECT po.id, any_value(title) AS title, count(*) AS total_top_level_comments, round(count(*) FILTER (contains(lower(author_flair_text), 'layperson')) / count(*), 6) AS layperson_comment_fraction FROM kept JOIN po ON kept.submission_id = po.id GROUP BY po.id",
    "corpus_row_counters": f"WITH {_KEPT}, ca AS (SELECT id FROM po WHERE length(trim(selftext, chr(32) || chr(9) || chr(10) || chr(13))) >= 60) SELECT (SELECT count(*) FROM po) AS posts, (SELECT count(*) FROM ca) AS candidates, (SELECT count(*) FROM fr) AS replies, (SELECT count(*) FROM kept WHERE submission_id IN (SELECT id FROM ca)) AS retained",
    "top_level_replies": f"WITH {_TOP} SELECT id, submission_id FROM top",
    "real_replies": f"WITH {_FR} SELECT id FROM fr WHERE coalesce(body, '') NOT IN ('[removed]', '[deleted]')",
    "built_corpus": f"WITH {_KEPT} SELECT po.id, concat('again ', any_value(title)) AS title, count(*) AS total_top_level_comments, CAST(1 AS BIGINT) AS first_seq FROM kept JOIN po ON kept.submission_id = po.id WHERE length(trim(selftext, chr(32) || chr(9) || chr(10) || chr(13))) >= 60 GROUP BY po.id",
    "replies_in_time_order": f"WITH {_TOP} SELECT submission_id, string_agg(id, ' ' {_ORDER}) AS ids FROM top GROUP BY 1",
    "combined_thread_records": f"WITH {_COMBINED} SELECT submission_id, title, ids, by_submitter, {', '.join(ARMS)} FROM c",
    "combined_totals": f"WITH {_COMBINED} SELECT count(*) AS threads, CAST(coalesce(sum(n), 0) AS BIGINT) AS real_comments, {', '.join(f'CAST(coalesce(sum(n_{s}), 0) AS BIGINT) AS {a}' for s, a in zip(analysis.STRATEGIES, ARMS))}, round(coalesce(sum(n), 0) / greatest(count(*), 1), 6) AS real_comments_mean, {', '.join(f'round(coalesce(sum(n_{s}), 0) / greatest(count(*), 1), 6) AS {a}_mean' for s, a in zip(analysis.STRATEGIES, ARMS))} FROM c",
    "strategy_totals": f"WITH {_SETS} SELECT count(DISTINCT submission_id) AS threads, {', '.join(f'''count(*) FILTER (strategy = '{s}') AS {s}''' for s in analysis.STRATEGIES)}, {', '.join(f'''round(count(*) FILTER (strategy = '{s}') / greatest(count(DISTINCT submission_id), 1), 6) AS {s}_mean''' for s in analysis.STRATEGIES)} FROM sets",
    "arms_as_rows": f"WITH {_SETS} SELECT submission_id, CASE strategy {' '.join(f'''WHEN '{s}' THEN '{a}' ''' for s, a in zip(analysis.STRATEGIES, ARMS))} END AS strategy, pos, 'assistant' AS author_type, text AS body FROM sets",
    "first_three_replies": f"WITH {_TOP}, r AS (SELECT *, row_number() OVER (PARTITION BY submission_id {_ORDER}) AS i FROM top) SELECT submission_id, coalesce(string_agg(id, ' ' ORDER BY i) FILTER (i <= 3 AND coalesce(body, '') NOT IN ('[removed]', '[deleted]')), '') AS ids FROM r GROUP BY 1",
    "analysis_record_fields": (
        f"WITH {_TOP}, {_SETS}, n AS (SELECT submission_id, count(*) AS n, string_agg(coalesce(author_flair_text, '-'), '|' {_ORDER}) FILTER (coalesce(body, '') NOT IN ('[removed]', '[deleted]')) AS flairs, string_agg(coalesce(body, ''), '|' {_ORDER}) FILTER (coalesce(body, '') NOT IN ('[removed]', '[deleted]')) AS real FROM top GROUP BY 1), "
        f"s AS (SELECT submission_id, {', '.join(f'''coalesce(string_agg(text, '|' ORDER BY turn) FILTER (model = '{m}' AND strategy = '{x}'), '') AS {m}_{x}''' for m in analysis.MODELS for x in analysis.STRATEGIES)} FROM sets GROUP BY 1) "
        f"SELECT s.submission_id, po.title, coalesce(n.n, 0) AS n_comments, coalesce(flairs, '') AS flairs, coalesce(real, '') AS real, {', '.join(f'{m}_{x}' for m in analysis.MODELS for x in analysis.STRATEGIES)} FROM s JOIN po ON s.submission_id = po.id LEFT JOIN n ON s.submission_id = n.submission_id"
    ),
    "long_reply_table": f'WITH {_LONG} SELECT submission_id, g AS "group", count(*) AS n, CAST(sum(w) AS BIGINT) AS words, count(*) FILTER (q) AS with_needle, coalesce(max(pos), -1) AS last FROM lr GROUP BY ALL',
    "pattern_thread_share": f"WITH {_LONG}, t AS (SELECT submission_id FROM lr GROUP BY 1 HAVING count(*) FILTER (g = 'real') = 1 AND count(*) FILTER (g = 'real' AND q) > 0 AND count(*) FILTER (g <> 'real' AND q) = 0) SELECT count(*) AS threads, round(100.0 * count(*) / (SELECT count(DISTINCT conv_id) FROM conversations), 6) AS percent FROM t",
    "rates_of_all_groups": f"""WITH {_LONG}, d(g) AS (VALUES {', '.join(f"('{g}')" for g in [*analysis.groups(), 'none/dg'])}), r AS (SELECT d.g, count(lr.g) AS n, 100.0 * count(*) FILTER (q) / nullif(count(lr.g), 0) AS rate FROM d LEFT JOIN lr ON d.g = lr.g GROUP BY d.g) SELECT g AS "group", n, round(rate, 6) AS rate, round((SELECT rate FROM r WHERE g = 'real') / nullif(rate, 0), 6) AS ratio FROM r""",
    "dump_lines_by_file": """WITH l AS (SELECT event_id % 4 AS p, concat('{"event_id":', event_id, ',"event_type":"', event_type, '","user_id":', user_id, '}') AS s, event_id FROM events), v AS (SELECT p, CASE WHEN event_id % 50 = 0 THEN left(s, 9) WHEN event_id % 70 = 0 THEN '  ' ELSE s END AS s FROM l)
        SELECT CASE WHEN p = 1 THEN 'SUBMISSION' ELSE 'COMMENT' END AS kind, CASE p WHEN 0 THEN 'RC_2024-01' WHEN 1 THEN 'RS_2024-01' ELSE 'RC_2024-02' END AS file_name, count(*) AS n, CAST(sum(strlen(s)) AS BIGINT) AS bytes FROM v WHERE p < 3 GROUP BY ALL""",
    "tolerant_jsonl": f"SELECT event_id, event_type, user_id FROM events WHERE {_GOOD}",
    "strict_jsonl": "SELECT event_id, nullif(event_type, 'click') AS event_type, user_id FROM events",
    "explicit_nulls": "SELECT count(*) AS n, count(*) FILTER (event_type = 'click') AS nulls FROM events",
    "missing_input": "SELECT CAST(0 AS BIGINT) AS n",
    "head_of_files": "SELECT doc_id, concat('f', doc_id % 3) AS file_name FROM documents ORDER BY 2, 1 LIMIT 5",
    "split_shard": "SELECT 'COMMENT' AS kind, lower(event_type) AS value_lc, count(*) AS n, CAST(sum(event_id) AS BIGINT) AS ids FROM events WHERE lower(event_type) IN ('click', 'cart') GROUP BY 2",
    "single_output": "SELECT 'SUBMISSION' AS kind, count(*) AS n, CAST(sum(doc_id) AS BIGINT) AS ids FROM documents WHERE contains(source, '1')",
    "metadata_csv": f"WITH {_KEPT} SELECT submission_id, count(*) AS total_comments, count(*) FILTER (contains(lower(author_flair_text), 'layperson')) AS layperson_comments, round(count(*) FILTER (contains(lower(author_flair_text), 'layperson')) / count(*), 6) AS layperson_fraction FROM kept GROUP BY 1",
    "compressed_copy": "SELECT count(*) AS n, CAST(sum(doc_id) AS BIGINT) AS ids, true AS smaller FROM documents",
    "generated_files": f"WITH {_SETS} SELECT submission_id, model, strategy, count(*) AS n FROM sets GROUP BY ALL",
    "manifest_files": "SELECT concat('in', doc_id % 4) AS input_path, concat('out', doc_id % 4) AS output_path, true AS complete, count(*) AS lines_processed, count(*) FILTER (toxic = 1) AS error_lines, CAST(0 AS BIGINT) AS lines_matched FROM labels GROUP BY doc_id % 4",
    "match_value_list": "SELECT doc_id, source FROM documents WHERE lower(source) IN (SELECT concat('src', doc_id % 7) FROM labels)",
    "scan_progress": "WITH l AS (SELECT event_type AS file_name, event_id AS \"at\", event_id * 10 + user_id % 10 AS lines, row_number() OVER w AS i FROM events WINDOW w AS (PARTITION BY event_type ORDER BY event_id)), r AS (SELECT *, first_value(\"at\") OVER w AS at0, first_value(lines) OVER w AS lines0 FROM l WINDOW w AS (PARTITION BY file_name ORDER BY \"at\" ROWS BETWEEN 39 PRECEDING AND CURRENT ROW)) SELECT file_name, \"at\", lines, round((lines - lines0) / nullif(\"at\" - at0, 0), 6) AS rate FROM r",
    "files_by_size": "WITH f AS (SELECT concat('k', doc_id % 5) AS name, CAST(sum(strlen(base64(encode(text))) + 1) AS BIGINT) AS bytes FROM documents WHERE text IS NOT NULL GROUP BY 1) SELECT name, bytes, row_number() OVER (ORDER BY bytes DESC, name) AS turn FROM f",
    "prompt_texts": f"WITH {_FR}, {_SIZED} SELECT id, {_filled_sql(_DG, title='title', body='selftext', n='n_comments', mix=_MIX)} AS thread, {_filled_sql(_SINGLE, title='title', body='selftext', role=_quoted('layperson'))} AS single, "
    f"{_filled_sql(_INC, title='title', body='selftext', role=_quoted('clinician'), prior='''concat('Comment 1: one', chr(10), chr(10), 'Comment 2: ', title, chr(10), chr(10))''')} AS incremental FROM sized",
    "prompt_with_braces": f"WITH {_FR}, {_SIZED} SELECT id AS submission_id, {_filled_sql(_DG, title='''concat('{body} {n} ', id)''', body='selftext', n='n_comments', mix=_quoted('all by clinicians'))} AS body FROM sized",
    "incremental_context": f"WITH {_FR}, {_SIZED}, i AS (SELECT id, unnest(range(n_comments)) AS k FROM sized) SELECT id AS submission_id, strategy, string_agg(CASE strategy WHEN 'sag' THEN '0' ELSE CAST(k AS VARCHAR) END, ' ' ORDER BY k) AS seen FROM i, (VALUES ('sag'), ('sagii')) t(strategy) GROUP BY ALL",
    "messy_answers": f"WITH {_FR}, {_SIZED}, i AS (SELECT id, n_comments, unnest(range(n_comments)) AS k FROM sized) SELECT id AS submission_id, string_agg(CASE k WHEN 0 THEN '' ELSE concat('r', k - 1) END, ',' ORDER BY k) AS bodies, CASE WHEN any_value(n_comments) > 1 THEN 'clinician,' ELSE 'clinician' END AS roles, 'done' AS status FROM i GROUP BY id",
    "failed_calls": f"WITH {_FR}, {_SIZED}, p AS (SELECT id, {_filled_sql(_DG, title=_quoted(''), body='''repeat('x', CAST(CAST(id AS BIGINT) % 2 AS INT))''', n='n_comments', mix=_quoted('all by clinicians'))} AS prompt FROM sized) SELECT id AS submission_id, CASE WHEN len(prompt) % 2 = 1 THEN 'failed' ELSE 'done' END AS status, CAST(1 AS BIGINT) AS calls, CAST(len(prompt) % 2 AS BIGINT) AS failures, len(prompt) % 2 = 1 AS again FROM p",
    "resumed_checkpoint": f"WITH {_FR}, {_SIZED} SELECT id AS submission_id, CAST(1 AS BIGINT) AS lines, 'grok' AS model, 'x-ai/grok-4.6' AS model_id, 'dg' AS strategy, n_comments FROM sized",
    "ratio_arm_sets": f"WITH {_FR}, {_SIZED} SELECT id AS submission_id, n_comments AS n_top_level_comments, {', '.join(f'n_comments AS {a}' for a in ARMS)} FROM sized",
    "parsed_answers": "SELECT conv_id, turn, CASE turn % 3 WHEN 0 THEN 2 WHEN 1 THEN 1 ELSE -1 END::BIGINT AS n, CASE WHEN turn % 3 < 2 THEN text END AS body, CASE WHEN turn % 3 < 2 THEN role END AS author_type FROM conversations",
    "role_sequences": f"WITH {_FR}, {_SIZED} SELECT id, trim(concat(repeat('clinician ', CAST(n_clinician AS INT)), repeat('layperson ', CAST(n_layperson AS INT)))) AS roles FROM sized",
    "provider_registry": "SELECT * FROM (VALUES ('grok', 'x-ai/grok-4.6', 'low', 1.5::DOUBLE, 5.0::DOUBLE), ('openai', 'gpt-x', NULL, 1.25, 15.0)) t(name, model_id, effort, price_in, price_out)",
    "generated_usage": f"WITH {_FR}, {_SIZED}, p AS (SELECT n_comments AS n, {_filled_sql(_DG, title=_quoted(''), body='''repeat('x', CAST(CAST(id AS BIGINT) % 2 AS INT))''', n='n_comments', mix=_quoted('all by clinicians'))} AS prompt FROM sized) SELECT model, count(*) AS calls, count(*) FILTER (len(prompt) % 2 = 1) AS failures, CAST(sum({_DG_TOKENS}) AS BIGINT) AS tokens_in, CAST(sum(CASE WHEN len(prompt) % 2 = 0 THEN (16 * n) // 4 ELSE 0 END) AS BIGINT) AS tokens_out FROM p, (VALUES ('gemini'), ('grok')) t(model) GROUP BY model",
    "contrast_power": f"SELECT * FROM (VALUES {_power_values()}) t(name, power, power_scaled)",
    "required_sizes": f"WITH t(name, p1, p2, n1, n2) AS (VALUES ('a', 0.103::DOUBLE, 0.08::DOUBLE, 3882.0::DOUBLE, 6475.0::DOUBLE), ('b', 0.103, 0.095, 3882, 6475), ('c', 0.103, 0.01, 3882, 6475), ('d', 0.2, 0.2, 100, 100)), r AS (SELECT *, CASE WHEN p1 <> p2 THEN ceil({_Z2!r} * (p1 * (1 - p1) + p2 * (1 - p2) / (6475.0::DOUBLE / 3882)) / ((p1 - p2) * (p1 - p2))) END AS n FROM t) SELECT name, CAST(coalesce(n, -1) AS BIGINT) AS replies, CAST(coalesce(ceil(n / 1.294), -1) AS BIGINT) AS threads, CAST(coalesce(ceil(3000 * 11.94::DOUBLE / nullif(n1 / 100 - 4, 0)), -1) AS BIGINT) AS interaction, round(n2 * 0.0032, 4) AS cost FROM r",
    "adjusted_p_values": "WITH t AS (SELECT n_name, (n_nationkey % 9 + 1) / 100.0::DOUBLE AS p FROM nation), r AS (SELECT *, p * count(*) OVER () / count(*) OVER (ORDER BY p RANGE UNBOUNDED PRECEDING) AS a FROM t) SELECT n_name, round(least(min(a) OVER (ORDER BY p DESC RANGE UNBOUNDED PRECEDING), 1), 6) AS p_adjusted FROM r",
}
