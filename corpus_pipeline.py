"""From raw documents to token ids, in five stages.

Each stage takes what the one before kept and returns the columns of ``documents``; the last returns the ids.
The stages' edge cases are those of their operators: rows without a doc_id are judged by their text where a
stage looks at one row at a time, and are never removed as a copy of another.
"""

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from dialogscope.config import scratch_path
from dialogscope.llm import bpe_automaton, decontaminate, langid, line_dedup, simhash
from dialogscope.llm.common import table


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 8: documents without a recognisable language go."""
    return langid.accepted(docs)


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 4: lines that repeat across documents stay in one document only."""
    return line_dedup.deduplicated(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 10: one document of each group of near copies stays, the one with the smallest doc_id."""
    return simhash.representatives(docs, shingle=3, distance=3)


def drop_benchmark_items(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 5: documents that hold a benchmark item go."""
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 3: token ids, checked by decoding them."""
    return bpe_automaton.encoded_documents(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("language_id", language_id),
    ("line_dedup", drop_repeated_lines),
    ("simhash_near_dedup", drop_near_copies),
    ("benchmark_decontamination", drop_benchmark_items),
    ("bpe_encoding", encode),
]

# The first stage's model is trained here, which SQL can't express; tests hold each stage against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over the documents; what each stage keeps is written as Parquet and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        path = scratch_path(spark, name)
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
