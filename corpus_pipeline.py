"""The training-data pipeline: five stages over documents, each on all rows that its predecessor kept.

Every stage takes (spark, docs, sf_dir). All but the last return the columns
of documents, whatever they are called; n_chars follows the text where a stage
changes it. Nulls in other columns than doc_id and text go through. An empty
table gives an empty one of the same columns in every stage.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from threadmill.llm import bpe, decontaminate, langid, simhash, suffix_tree
from threadmill.llm.common import read, set_aside
from threadmill.llm.components import ensure_checkpoint_dir


def _resized(docs: DataFrame) -> DataFrame:
    return docs.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else docs


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is known: texts without letters, and texts too far from every language, go.

    Null and empty texts have no letters and go; repeated rows share one
    decision, and a null doc_id or lang does not matter to it. Without any
    labelled text nothing is known, and all go.
    """
    model = langid.fit(docs, F.lit(True))
    packed, restore = set_aside(docs, ("doc_id", "text"))
    return restore(langid.predict(packed, model, tuple(packed.columns)).where("NOT rejected"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the smallest doc_id, of each group of texts that are alike to 0.8 or more in five-word shingles.

    Candidates come from SimHash fingerprints and, so that no link is lost,
    from a join by prefixes. A null doc_id is larger than any other; of
    repeated rows one stays; texts without words, null ones too, are one group.
    """
    return simhash.drop_near_duplicates(docs, shingle=5, similarity=0.8)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the passages of 50 words or more that also stand in a document with a smaller doc_id.

    All rows stay: null texts stay null and short ones as they are. A null
    doc_id is larger than any other; rows of equal doc_id do not count against
    each other.
    """
    packed, restore = set_aside(docs, ("doc_id", "text"))
    keep = tuple(c for c in packed.columns if c != "text")
    cut = suffix_tree.remove_repeated_words(packed, width=50, gram=18, keep=keep, cut=True)
    return _resized(restore(cut.withColumnRenamed("kept", "text")))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the benchmark's ten-word windows; documents that are mostly benchmark go.

    Null and empty texts stay as they are, as do all rows if the benchmark is
    empty; repeated rows share one decision.
    """
    return _resized(decontaminate.remove_contaminated(docs, read(spark, sf_dir, "benchmark"), width=10))


def bpe_encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id with the text's token ids and their number, one row for each row; a null text has no ids."""
    import public_tokenizers

    definition = bpe.load(public_tokenizers.path("word_bpe_49k.json"))
    return bpe.encode(docs.select("doc_id", "text"), definition).select("doc_id", "ids", F.size("ids").cast("long").alias("n_tokens"))


STAGES = [
    ("language_id", language_id),
    ("near_dedup", near_dedup),
    ("substring_dedup", substring_dedup),
    ("decontamination", decontamination),
    ("bpe_encoding", bpe_encoding),
]

#: Fingerprints, centroids and merges are not for SQL; tests/llm holds run() against brute-force stages.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in a row; each stage's rows but the last's are written to the checkpoint folder and read again."""
    ensure_checkpoint_dir(spark)
    folder = f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/stages-{uuid.uuid4().hex}"
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
