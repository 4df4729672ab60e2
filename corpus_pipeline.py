"""From raw documents to token files: operators of ``gridspark.llm`` one after the other.

Every stage takes what its predecessor kept; all but the last return the columns of
``documents``, whatever these are besides ``doc_id``, ``text``, ``lang`` and ``source`` (names that
need quoting or that the operators use inside are kept as they are).  ``run`` writes each result
to the shared folder and reads it again, so that a lost executor never costs more than the
stage at hand.

All stages judge rows by id and text, never by id alone: ids may be null, repeat, or be strings.
Empty tables give empty results in every stage.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from gridspark.llm import common, decontaminate, jaccard_join, mixing, quality_rules, token_store
from gridspark.llm.queries import tokenizer_path

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 1: documents that the quality rules reject go.

    Null, empty and short texts fail the base rules; null languages and sources are groups of
    their own; equal rows are judged alike; very long texts are read whole.
    """
    return quality_rules.quality_filter(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 6: of each group of linked documents the one of least id stays.

    Null ids come last, ties go to the least row key; of equal rows one stays.  Rows with null or
    empty texts link with nothing and all stay.
    """
    return jaccard_join.first_of_each(docs)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 7: documents that hold a benchmark item go.

    Rows with null or empty texts hold nothing and stay; a leak goes whatever its id, and a row
    that only shares a leak's id stays.  An empty benchmark lets all stay.
    """
    return decontaminate.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 9: sources at their target weights, a document as often as the mix takes it.

    A null source is a source of its own; rows without a word take nothing and go; equal rows share
    their quota; ties of the seeded hash go by id, so that reruns agree.
    """
    return mixing.mix(docs)


def tokenized(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 5: the token store of what is left, read back: a row per stored document.

    A null or empty text is the end token alone; null ids sort first; equal ids are stored each.
    """
    return token_store.token_report(docs, tokenizer_path())


STAGES: list[tuple[str, Stage]] = [
    ("quality rules", quality),
    ("n-gram Jaccard join", near_duplicates),
    ("benchmark decontamination", decontaminated),
    ("mixing sources to target weights", mixed),
    ("token-ID / binary output", tokenized),
]

#: The near-duplicate, retrieval and tokenizing stages aren't SQL; tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; the last one's rows (doc_id, start, n_tokens, ids_crc32)."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (_, stage) in enumerate(STAGES):
        docs = common.written(spark, stage(spark, docs, sf_dir), f"stage-{i}")
    return docs
