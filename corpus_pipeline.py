"""From raw documents to token shards in five stages.

Each stage takes `(spark, docs, sf_dir)` and returns a DataFrame that is written and read again before the next one.
All but the last keep the columns of `documents`:

1. language ID: documents without a recognised language go;
2. n-gram Jaccard join (five words, 0.8): of each group of near copies the smallest id stays;
3. decontamination: documents that hold a benchmark item go;
4. mixing: every source is taken up to its target, whole copies and one cropped one a source, in training order;
5. token output: the mix is encoded and written as shards in that order; the rows are read back from them.

Mixing can take a document twice; both copies then go on to the shards under one doc_id, each at its place in training.
Stages hand on the columns of `documents` alone, so the order is that of the rows in the files which stage 4 is written to;
token output of rows that come from no file is by doc_id.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fluxcube.llm import decontaminate, langid, mixing, ngram_join, token_output
from fluxcube.llm.common import materialize, read_table
from fluxcube.llm.queries import tokenizer_path
from fluxcube.session import ship_package

#: SQL can express neither the language model nor the tokenizer.
ORACLE_SQL = None
#: Column with a row's place in the files that it was read from.
PLACE = "_place"


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship_package(spark)
    return langid.keep_identified(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship_package(spark)
    return ngram_join.keep_first(docs)


def drop_benchmark_items(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship_package(spark)
    return decontaminate.drop_leaks(docs, read_table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship_package(spark)
    return mixing.mix(docs)


def in_written_order(docs: DataFrame) -> DataFrame | None:
    """`docs` with each row's place in its Parquet files, which are numbered in the order of the partitions that were written;
    None if the rows don't come straight from files."""
    try:
        return docs.withColumn(PLACE, F.struct("_metadata.file_name", "_metadata.row_index"))
    except AnalysisException:
        return None


def write_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship_package(spark)
    placed = in_written_order(docs)
    read = token_output.round_trip(docs if placed is None else placed, tokenizer_path("word_bpe_49k.json"), order=None if placed is None else PLACE)
    return read.select("doc_id", "start", "n_tokens", "ids_crc32")


STAGES = [
    ("language_id", identify_language),
    ("ngram_join", drop_near_copies),
    ("decontamination", drop_benchmark_items),
    ("mixing", mix_sources),
    ("token_output", write_tokens),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = materialize(docs, name)
    return docs
