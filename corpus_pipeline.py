"""The corpus pipeline: five stages over the documents table, each reading what the one before wrote.

A stage takes ``(spark, docs, sf_dir)`` and returns a frame; ``run`` writes it as Parquet in the shared folder and rereads it as the
next stage's ``docs``. All stages but the last return the columns of ``documents``: filters leave rows out, and substring dedup
replaces ``text`` (and ``n_chars``) of the documents that lose words. Rows without an id are kept by every filter's default.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from thicket.llm import minhash, packing, quality, substring_dedup, toxicity
from thicket.llm.common import Scratch
from thicket.llm.encoder import byte_bpe_path

#: Fixed decisions of the stages.
NEAR_WORDS, NEAR_SIMILARITY = 5, 0.8


def _labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose quality score reaches 0.3; the classifier learns from this stage's own input and the labels' training folds."""
    model = quality.train(docs, _labels(spark, sf_dir), "quality", toxicity.fold("doc_id", 5) != 0)
    return quality.at_least(docs, model, quality.THRESHOLD)


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score stays below 0.7."""
    model = toxicity.train(docs, _labels(spark, sf_dir), "toxic", toxicity.fold("doc_id", 3) != 1)
    return toxicity.below(docs, model, toxicity.THRESHOLD)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies (five-word shingles, similarity 0.8 or more) the document with the smallest id."""
    found = minhash.near_duplicates(docs, NEAR_SIMILARITY, NEAR_WORDS)
    gone = found.where(~F.col("kept")).select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti").select(*docs.columns)


def drop_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the words of windows that also start in a document with a smaller id."""
    return substring_dedup.without_repeats(docs, length_col="n_chars" if "n_chars" in docs.columns else None)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row a piece of at most 2048 tokens, with its place in a sequence."""
    out = packing.pack(docs, byte_bpe_path())
    return out.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


STAGES = [
    ("quality classifier", keep_good),
    ("toxicity", drop_toxic),
    ("MinHash near-dedup", drop_near_copies),
    ("substring dedup", drop_repeats),
    ("best-fit packing", pack_sequences),
]

#: SQL can't express the trained classifiers; the tests hold the pipeline against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = scratch.keep(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
