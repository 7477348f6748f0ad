"""The operators over their whole tables, as queries with fixed result columns."""

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cartwright.llm import (
    best_fit_packing, bpe, conversation_repair, exact_topk, hard_negatives,
    host_rules, html_text, language_id, lm_scoring, mixing, ngram_join, pii,
    substring_dedup,
)
from cartwright.llm.shipping import ship


RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
#: For the registered query alone, whose results have to be the same in every run.
SURROGATE_KEY = b"key of the registered query"
PIECES = public_tokenizers.path("word_bpe_49k.json")


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return ship(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def op1_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = html_text.extracted(_table(spark, sf_dir, "pages"))
    return rows.select("page_id", F.length("text").cast("bigint").alias("n_chars"), "text")


def op2_host_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return host_rules.judged(_table(spark, sf_dir, "documents")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        "base_failed", "kept", F.round("host_rate", 6).alias("host_rate"),
    )


def op3_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.near_copies(_table(spark, sf_dir, "documents"))


def op4_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = lm_scoring.scored(_table(spark, sf_dir, "documents"))
    return rows.select("doc_id", "n_words", F.round("mean_log10", 6).alias("mean_log10"))


def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.with_surrogates(_table(spark, sf_dir, "documents"), SURROGATE_KEY).select("doc_id", "n_replaced", "text")


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    recipe = mixing.Recipe()
    rows = mixing.mixed(_table(spark, sf_dir, "documents"), recipe)
    position = F.when(
        F.col("taken") > 0, mixing.due(F.col("start"), F.col("budget"), F.col("turn"), recipe)
    )
    rows = rows.withColumn("position", F.round(position, 9)).orderBy("position", "source", "doc_id")
    return rows.select("doc_id", "size", "source_size", "target", "taken", "position")


def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = substring_dedup.without_repeats(_table(spark, sf_dir, "documents"))
    digest = F.sha2(F.col("kept").cast("binary"), 256)
    return rows.select("doc_id", "n_words", "n_removed", digest.alias("kept_sha256"))


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = language_id.identified(_table(spark, sf_dir, "documents"))
    return found.select("doc_id", language_id.held_out().alias("held_out"), "lang_pred", "score")


def op9_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_topk.top_k(_table(spark, sf_dir, "embeddings"))


def op10_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    rows = bpe.with_ids(docs, bpe.Vocabulary.read(RANKS), decode=True)
    return rows.select(
        "doc_id",
        F.size("ids").cast("bigint").alias("n_tokens"),
        F.sha2(F.concat_ws(",", F.col("ids").cast("array<string>")).cast("binary"), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "embeddings")
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.hard_negatives(rows.select("vec_id", "embedding", moved.alias("label")))


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "conversations")
    return conversation_repair.every_summary(conversation_repair.damaged(rows), rows)


def op13_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    with open(PIECES, encoding="utf-8") as file:
        return best_fit_packing.packed(_table(spark, sf_dir, "documents"), file.read())


QUERIES = {
    "op1_html_text": op1_html_text,
    "op2_host_rules": op2_host_rules,
    "op3_ngram_join": op3_ngram_join,
    "op4_lm_scoring": op4_lm_scoring,
    "op5_pii": op5_pii,
    "op6_mixing": op6_mixing,
    "op7_substring_dedup": op7_substring_dedup,
    "op8_language_id": op8_language_id,
    "op9_exact_topk": op9_exact_topk,
    "op10_bpe": op10_bpe,
    "op11_hard_negatives": op11_hard_negatives,
    "op12_conversation_repair": op12_conversation_repair,
    "op13_best_fit_packing": op13_best_fit_packing,
}
