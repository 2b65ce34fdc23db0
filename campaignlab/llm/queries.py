"""Registered queries of this subpackage: each applies its operator to the whole
table and derives the columns of its contract."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from campaignlab.llm import sql
from campaignlab.llm.align import align_tokenizers
from campaignlab.llm.chat import chat_digests, format_chat
from campaignlab.llm.common import ROW, read, remainder
from campaignlab.llm.gru_lm import lm_scores
from campaignlab.llm.licenses import scan_licenses
from campaignlab.llm.line_dedup import dedup_lines
from campaignlab.llm.mil import score_quality, train_quality
from campaignlab.llm.mixing import mix_sources
from campaignlab.llm.negatives import hard_negatives
from campaignlab.llm.quality_rules import quality_rules
from campaignlab.llm.simhash import simhash_groups
from campaignlab.llm.tokens import token_counts
from campaignlab.llm.topk import top_k
from campaignlab.llm.wu_manber import find_benchmark

# Production parameter: shares of the output's characters by source.
MIX = {"src0": 0.15, "src1": 0.10, "src2": 0.10, "src3": 0.05, "*": 0.60}
DOC = f"cast({ROW}.doc_id as long) as doc_id"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "documents")


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    out = token_counts(documents(spark, sf_dir), str(public_tokenizers.path("word_bpe_49k.json")))
    return out.selectExpr(DOC, "n_bytes", "n_tokens", "over_limit")


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = quality_rules(documents(spark, sf_dir), read(spark, sf_dir, "labels"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
                      "kept", "anomaly", "threshold")


def op3_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = mix_sources(documents(spark, sf_dir), MIX)
    return out.selectExpr(DOC, f"{ROW}.source as source", "cast(copy as int) as copy",
                          f"cast(octet_length({ROW}.text) as long) as n_bytes")


def op4_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    hard = "</s>[INST] ok [/INST]"
    extra = spark.createDataFrame([(-7, 0, "user", hard), (-7, 1, "assistant", hard)],
                                  "conv_id long, turn long, role string, text string")
    talks = read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(extra)
    return chat_digests(format_chat(talks))


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = dedup_lines(documents(spark, sf_dir))
    return out.selectExpr(DOC, "n_lines", "size(deleted) as n_deleted", f"{ROW}.text as text")


def quality_model(spark: SparkSession, sf_dir: str):
    """Trained on labelled rows whose crc32(doc_id as text) mod 3 is not 1."""
    return train_quality(documents(spark, sf_dir), read(spark, sf_dir, "labels").filter(remainder("doc_id", 3) != 1))


def op6_quality_mil(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = score_quality(documents(spark, sf_dir), quality_model(spark, sf_dir))
    out = out.withColumn("held_out", remainder(F.col(f"{ROW}.doc_id"), 3) == 1)
    return out.selectExpr(DOC, "held_out", "score", "cast(score >= 0.5 as int) as predicted")


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = simhash_groups(documents(spark, sf_dir), shingle=4, radius=4)
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op8_gru_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_scores(documents(spark, sf_dir))


def op9_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = find_benchmark(documents(spark, sf_dir), read(spark, sf_dir, "benchmark"))
    return out.selectExpr(DOC, "n_words", "n_hit", "cast(size(items) as long) as n_items",
                          "sha2(concat_ws(',', items), 256) as items_sha256", "n_hit > 0 as contaminated")


def op10_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(documents(spark, sf_dir)).selectExpr(DOC, "found.*")


def op11_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = top_k(read(spark, sf_dir, "embeddings"), lambda vec_id: vec_id % 50 == 0, k=5)
    return out.select("query_id", "rank", "vec_id", "score")


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    label, vec_id = F.col("label").cast("long"), F.col("vec_id")
    moved = F.when(vec_id % 7 == 0, (label + 1) % 10).otherwise(label)
    table = read(spark, sf_dir, "embeddings").withColumn("label", moved)
    return hard_negatives(table, lambda vec_id: vec_id % 100 == 0, positives=5, negatives=10, low=30, high=90)


def op13_align(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    out = align_tokenizers(documents(spark, sf_dir), str(public_tokenizers.path("byte_bpe_50k.json")),
                           str(public_tokenizers.path("piece_bpe_32k.model")))
    return out.selectExpr(DOC, "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_token_counts, op2_quality_rules, op3_mix_sources, op4_chat_format, op5_line_dedup,
                                    op6_quality_mil, op7_simhash, op8_gru_lm, op9_decontaminate, op10_licenses, op11_top_k, op12_hard_negatives, op13_align)}


def oracle_sql() -> dict[str, str]:
    return {"op3_mix_sources": sql.mix(MIX), "op4_chat_format": sql.CHAT, "op9_decontaminate": sql.DECONTAMINATE,
            "op11_top_k": sql.TOP_K, "op12_hard_negatives": sql.HARD_NEGATIVES}
