"""Stages 2 to 5: corpus, sample, generation with resume, and the comparison of groups."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import analysis, corpus, export, generation, sampling, threads
from ..operators.prompts import role_mix
from ..sources import schemas
from ..sources.ndjson import read_if_present
from ..sources.sinks import append_checkpoint, write_jsonl, write_metadata_csv


@dataclass(frozen=True)
class Corpus:
    posts: DataFrame
    replies: DataFrame
    metadata: DataFrame


def build_corpus(posts: DataFrame, replies: DataFrame, min_chars: int = 30) -> Corpus:
    """Posts with a text, the last record of each id, with at least one retained reply; the replies; counts by thread."""
    kept = corpus.last_wins(corpus.candidates(posts, min_chars))
    own = corpus.retained_replies(replies, kept)
    metadata = corpus.thread_metadata(own)
    return Corpus(corpus.final_posts(kept, metadata), own, metadata)


def write_corpus(built: Corpus, out: str) -> None:
    write_jsonl(built.posts.drop("file_name", "file_block", "seq", "first_seq"), f"{out}/submissions_corpus.jsonl")
    write_jsonl(built.replies.drop("file_name", "file_block", "seq", "submission_id"), f"{out}/comments_corpus.jsonl")
    write_metadata_csv(built.metadata, f"{out}/submission_metadata.csv")


def read_corpus(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Posts and replies of a written corpus; a missing file raises."""
    return read_if_present(spark, f"{path}/submissions_corpus.jsonl", schemas.POST, required=True), read_if_present(spark, f"{path}/comments_corpus.jsonl", schemas.REPLY, required=True)


def sample_threads(posts: DataFrame, replies: DataFrame, rules: threads.Round, n: int | None = None, compatible: bool = False) -> DataFrame:
    """Eligible threads of the round, sampled, with their roles and mix of roles."""
    chosen = threads.eligible(posts, replies, rules)
    pick = sampling.random_module_sample if compatible else sampling.hash_sample
    rows = pick(chosen, rules.sample if n is None else n, rules.seed)
    return rows.withColumn("roles", sampling.role_sequence("n_clinician", "n_layperson", rules.seed)).withColumn("mix", role_mix(F.col("n_clinician"), F.col("n_layperson")))


def generate_missing(spark: SparkSession, sample: DataFrame, provider: generation.Provider, strategy: str, checkpoint: str, calls: generation.Calls = generation.Calls(), retry_failed: bool = False) -> None:
    """Generates the threads that the checkpoint lacks and appends them; nothing else reads the plan that calls the provider."""
    path = spark._jvm.org.apache.hadoop.fs.Path(checkpoint)
    done = path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path)
    rest = sample
    if done:
        finished = spark.read.schema(generation.GENERATED).json(checkpoint)
        rest = generation.remaining(sample, finished, provider.name, strategy, retry_failed)
    append_checkpoint(generation.generate(rest, provider, strategy, calls), checkpoint)


def generated_sets(spark: SparkSession, checkpoint: str) -> DataFrame:
    """The checkpoint's sets; of several for one thread, a finished one."""
    rows = spark.read.schema(generation.GENERATED).json(checkpoint)
    rank = F.struct((F.col("status") == "done").cast("int"), (F.col("status") == "partial").cast("int"), -F.col("failures"))
    best = rows.groupBy("submission_id", "model", "strategy").agg(F.max_by(F.struct(*(c for c in rows.columns if c not in ("submission_id", "model", "strategy"))), rank).alias("r"))
    return best.select("submission_id", "model", "strategy", "r.*")


def analysis_dataset(posts: DataFrame, replies: DataFrame, generated: DataFrame) -> DataFrame:
    """One nested record for each generated thread; self-replies do not count."""
    own = threads.without_self_replies(threads.top_level(replies), posts)
    return export.analysis_records(posts, own, generated)


def write_analysis(records: DataFrame, out: str) -> None:
    write_jsonl(records, f"{out}/analysis_dataset.jsonl")
    write_jsonl(records, f"{out}/analysis_dataset.jsonl.gz", "gzip")


def statistics(real: DataFrame, generated: DataFrame, needle: str = "?") -> dict[str, DataFrame]:
    """All tables of the comparison, from one long table that is cached."""
    replies = analysis.long_replies(real, generated, needle).cache()
    dimension = real.sparkSession.createDataFrame([(g,) for g in analysis.groups()], "group string")
    ids = generated.select("submission_id").distinct()
    return {
        "coverage": analysis.coverage(ids, generated), "incomplete": analysis.incomplete(ids, generated), "lengths": dimension.join(analysis.length_stats(replies), "group", "left"), "boxes": analysis.box_inputs(replies),
        "rates": analysis.needle_rates(replies, dimension), "bands": analysis.needle_rates_by_band(replies), "patterns": analysis.pattern_threads(replies),
    }
