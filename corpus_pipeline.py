"""Corpus pipeline: quality classifier, line dedup, near-dedup, decontamination, mixing.

Each stage takes the documents its predecessor kept, written as Parquet in the
shared checkpoint folder and read again, and returns documents with the same
columns, whatever they are beside doc_id, text and source. The last adds the
number of the copy as ``copy`` or, where the documents have such a column, under the
first free name of ``copy_1``, ``copy_2``, ...

Null and empty texts: the classifier scores them as one empty passage; line dedup
leaves them; they share the fingerprint zero, so one of them stays; they hold no
benchmark window; mixing gives them no share of the characters beyond their
source's rate. A null id is the largest. Rows that repeat id and text are one document to
line dedup and near-dedup keeps one of them. Empty documents give an empty result;
without labels the classifier knows nothing and keeps all.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from campaignlab.llm.common import ROW, read
from campaignlab.llm.line_dedup import dedup_lines
from campaignlab.llm.mil import score_quality
from campaignlab.llm.mixing import mix_sources
from campaignlab.llm.queries import MIX, quality_model
from campaignlab.llm.simhash import keep_one, simhash_groups
from campaignlab.llm.wu_manber import find_benchmark
from campaignlab.session import ensure_checkpoint_dir


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents the classifier scores at least 0.5."""
    return score_quality(docs, quality_model(spark, sf_dir)).filter("score >= 0.5").select(f"{ROW}.*")


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without lines aligned with an earlier one; n_chars, where there is one, follows the text."""
    out = dedup_lines(docs)
    if "n_chars" not in docs.columns:
        return out.select(f"{ROW}.*")
    row = F.col(ROW)
    return out.select(row.withField("n_chars", F.length(row["text"]).cast("long")).alias(ROW)).select(f"{ROW}.*")


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of linked fingerprints, the smallest."""
    return keep_one(docs, simhash_groups(docs, shingle=4, radius=4)).select(f"{ROW}.*")


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no window of a benchmark item."""
    return find_benchmark(docs, read(spark, sf_dir, "benchmark")).filter("n_hit = 0").select(f"{ROW}.*")


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as its source's share wants."""
    taken = {c.lower() for c in docs.columns}
    name = next(n for n in ("copy", *(f"copy_{k}" for k in range(1, len(taken) + 2))) if n not in taken)
    return mix_sources(docs, MIX).select(f"{ROW}.*", F.col("copy").alias(name))


STAGES = [("quality classifier", quality), ("line dedup", lines), ("simhash near-dedup", near_copies),
          ("benchmark decontamination", decontaminate), ("mixing", mix)]

ORACLE_SQL = None  # training and alignment have no SQL; tests hold the stages against brute force


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = f"{ensure_checkpoint_dir(spark).rstrip('/')}/pipeline-{uuid.uuid4()}"
    docs = read(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{k}")
        docs = spark.read.parquet(f"{folder}/{k}")
    return docs
