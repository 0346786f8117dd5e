"""A corpus pipeline over `documents`: quality, exact copies, near copies, benchmark passages, token ids.

Each stage reads its predecessor's rows, written as Parquet, and its decisions take effect; all but the last return the
columns of `documents`. Stages work on any such table with doc_id and text; rows that repeat an id are told apart by
their texts where they differ.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.llm import bpe, decontaminate, exact, quality, shingles
from textloom.llm.common import Workspace, free_name, table
from textloom.llm.queries import vocabulary


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts; a document that it rejects goes. A null text is scored as an empty
    one, and rows that repeat share their fate."""
    name = free_name(docs, "score")
    scored = quality.append_score(docs, table(spark, sf_dir, "labels"), name)
    return scored.where(F.col(name) >= quality.THRESHOLD).select(*docs.columns)


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts, the document with the largest id; a null text is an empty one, a null id the smallest, and of
    rows that repeat an id with its text one stays."""
    copies = exact.groups(docs).where("group_size > 1").select("doc_id", F.col("text_sha256").alias("text_key"), "kept")
    return exact.keep_rows(docs, copies, F.sha2(F.coalesce("text", F.lit("")), 256))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of documents linked by 5-word shingles of similarity 0.8 or more, the one with the smallest id; a
    null text is an empty one and these are alike, a null id comes last, and rows that repeat are copies."""
    copies = shingles.classes(docs).where("size > 1").select("doc_id", "text_key", "kept")
    return exact.keep_rows(docs, copies, F.xxhash64(F.coalesce("text", F.lit(""))))


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a benchmark window; null and empty texts have none, and rows that repeat share their fate."""
    name = free_name(docs, "hits")
    found = decontaminate.append_hits(docs, table(spark, sf_dir, "benchmark"), name)
    return found.where(F.col(name) == 0).select(*docs.columns)


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of what is left, a row each; a null text is an empty one."""
    return bpe.digests(docs, vocabulary())


STAGES = [
    ("quality classifier", keep_quality),
    ("exact dedup", drop_exact_copies),
    ("SimHash near-dedup", drop_near_copies),
    ("benchmark decontamination", drop_contaminated),
    ("BPE encoding and decoding", token_ids),
]

#: The classifier and the encoder can't be written in SQL; tests/llm holds the pipeline against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    space = Workspace(spark, "pipeline")
    docs = table(spark, sf_dir, "documents")
    for n, (_, stage) in enumerate(STAGES):
        docs = space.save(stage(spark, docs, sf_dir), f"stage{n}")
        if n:
            space.drop(f"stage{n - 1}")
    return docs
