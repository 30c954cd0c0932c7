"""The corpus pipeline: five of the training-data operators one after the other over `documents`.

Each stage takes what the one before kept and returns a DataFrame with the columns of documents; the last adds the words that the mix
takes of each document, and drops documents it takes none of. run() writes each stage's result to the shared scratch
folder and reads it again, so a lost executor costs one stage at most."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm import apportion, decontaminate, jaccard_join, pii, quality
from lodestone.llm.common import scratch, table


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quadratic discriminant, fitted on labels.quality, scores 0.3 or more."""
    labels = table(spark, sf_dir, "labels").select("doc_id", F.col("quality").alias("label"))
    return quality.accepted(docs, quality.trained(docs, labels))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of five-word shingle sets with a Jaccard similarity of 0.8 or more."""
    return jaccard_join.deduplicated(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def redact_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, personal data replaced by its kind."""
    return pii.redacted(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the mix takes words of, with size, source_size, target and taken."""
    added = ("size", "source_size", "target", "taken")  # these take the place of columns of that name
    others = tuple(c for c in docs.columns if c not in ("doc_id", *added))
    mix = apportion.mixed(docs, keep=others)
    return mix.where("taken > 0").select("doc_id", *others, *added)


STAGES = [
    ("quality classifier", keep_quality),
    ("n-gram jaccard join", drop_near_copies),
    ("benchmark decontamination", drop_contaminated),
    ("pii", redact_personal_data),
    ("mixing sources", mix_sources),
]

#: SQL can't express the classifier and the transitive closure at this size; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows over the whole table documents."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = scratch(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
