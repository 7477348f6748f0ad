"""From raw documents to token ids: the stages of a corpus, each written before the next."""

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cartwright.llm import bpe, language_id, mixing, ngram_join, pii
from cartwright.llm.shipping import ship
from cartwright.llm.tables import stored

RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
#: For the registered pipeline alone, whose results have to be the same in every run; others need a secret one.
SURROGATE_KEY = b"key of the registered pipeline"


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose text is in a learned language; without any labels all that have a letter."""
    ship(spark)
    model = language_id.learn(docs.where(~language_id.held_out()))
    return language_id.known(docs, model)


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies."""
    ship(spark)
    return ngram_join.one_of_each(docs)


def without_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with surrogates for personal data; n_chars follows the text."""
    ship(spark)
    rows = pii.with_surrogates(docs, SURROGATE_KEY)
    return rows.withColumn(
        "n_chars", F.when(F.col("n_replaced") > 0, F.length("text")).otherwise(F.col("n_chars")).cast("bigint")
    ).select(*docs.columns)


def in_training_order(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each time the mix takes a document, always whole."""
    ship(spark)
    return mixing.training_order(docs)


def as_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, lang, source, n_tokens, ids, round_trip): token ids of whole texts, and whether
    decoding them gives the text's bytes again."""
    ship(spark)
    rows = bpe.with_ids(docs, bpe.Vocabulary.read(RANKS), decode=True)
    return rows.select(
        "doc_id", "lang", "source", F.size("ids").cast("bigint").alias("n_tokens"), "ids",
        F.col("decoded").eqNullSafe(F.coalesce("text", F.lit("")).cast("binary")).alias("round_trip"),
    )


STAGES = [
    ("language_id", known_language),
    ("ngram_join", one_of_each_group),
    ("pii", without_personal_data),
    ("mixing", in_training_order),
    ("bpe", as_tokens),
]

# Language models, keyed surrogates and BPE are no SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result is stored and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
