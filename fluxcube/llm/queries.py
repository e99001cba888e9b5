"""Registered queries of the corpus operators: each applies its operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fluxcube.llm import chat_format, decontaminate, embed_dedup, langid, mixing, ngram_join, pii, suffix_dedup, token_counts, token_output
from fluxcube.llm.common import read_table
from fluxcube.session import ship_package


def tokenizer_path(name: str) -> str:
    """Place of a public tokenizer file, where the package that holds them is installed."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.digest(suffix_dedup.remove_repeats(read_table(spark, sf_dir, "documents")))


def op2_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embed_dedup.near_duplicates(read_table(spark, sf_dir, "embeddings"))


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    found = langid.identify(docs, langid.fit(docs))
    return found.select("doc_id", langid.held_out().alias("held_out"), "lang_pred", F.col("lang_score").alias("score"), F.col("lang_rejected").alias("rejected"))


def op4_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat_format.digest(chat_format.format_chats(chat_format.with_probe(read_table(spark, sf_dir, "conversations"))))


def op5_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    read = token_output.round_trip(read_table(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json"))
    return read.select("doc_id", "start", "n_tokens", "ids_crc32")


def op6_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.find_leaks(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(read_table(spark, sf_dir, "documents"), tokenizer_path("piece_bpe_32k.model"))


def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.digest(pii.find_spans(read_table(spark, sf_dir, "documents")))


def op9_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.jaccard_components(read_table(spark, sf_dir, "documents"), words=3, percent=90)


def op10_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.digest(mixing.source_mix(read_table(spark, sf_dir, "documents")))


ALL: list[Callable[[SparkSession, str], DataFrame]] = [
    op1_suffix_dedup,
    op2_embedding_dedup,
    op3_language_id,
    op4_chat_format,
    op5_token_output,
    op6_decontaminate,
    op7_token_counts,
    op8_pii,
    op9_ngram_join,
    op10_source_mix,
]


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    def shipped(fn: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            ship_package(spark)
            return fn(spark, sf_dir)

        return run

    return {fn.__name__: shipped(fn) for fn in ALL}


def oracle_sql() -> dict[str, str]:
    return {"op4_chat_format": chat_format.ORACLE, "op10_source_mix": mixing.ORACLE}
