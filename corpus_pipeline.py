"""The corpus pipeline: five stages from documents to token ids.

Each stage is a function of (spark, docs, sf_dir). All but the last return the rows of docs
that stay, with their columns. They judge rows by their text and place, never by id alone: rows
with null or repeated ids stay or go by themselves, other columns may have any name, and an
empty table gives no rows.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from weft.llm.bpe import VOCABULARY, tokenised
from weft.llm.common import stored, table
from weft.llm.decontamination import drop_contaminated
from weft.llm.exact_dedup import drop_copies
from weft.llm.jaccard_join import drop_near_copies
from weft.llm.language import keep_identified


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is determined; null texts and texts without letters go."""
    return keep_identified(docs)


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal documents the longest, then the one with the smallest id, then the first by place: one row for each group."""
    return drop_copies(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group that links join, the document with the smallest id: one row for each; texts without words stay."""
    return drop_near_copies(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with less than one word in twenty from the benchmark; texts without words stay."""
    return drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def byte_bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The token ids of each document, with digests of them and of the bytes they decode to; a null text has none."""
    return tokenised(docs, public_tokenizers.path(VOCABULARY), public_tokenizers.PATTERN)


STAGES = [
    ("language_id", language_id),
    ("exact_dedup", exact_dedup),
    ("near_duplicates", near_duplicates),
    ("decontaminate", decontaminate),
    ("byte_bpe", byte_bpe),
]

#: Language identification is learned and BPE is iterative: SQL expresses neither.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written in the shared folder before the next."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
