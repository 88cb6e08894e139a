"""From raw documents to encoded training text, in five stages over the corpus operators.

1. quality: documents that the quality rules reject go.
2. lines: lines of templates that recur across documents go, but for one document each.
3. near: of near duplicates (five-word shingles, Jaccard similarity of 0.8 or more) the smallest identifier stays.
4. mix: rows repeat or go so that sources meet their temperature weights, half the way from their own shares to equal ones.
5. encode: token counts and digests of each row that is left.

Stages 1 to 4 return the columns of documents, whatever they are called. ORACLE_SQL
is None: SQL has no BPE; tests compare each stage with a plain version.

Defined results: a document of null, empty or few words fails the base rule and goes
in stage 1; a null identifier is one like any other, below all others; rows that
repeat an identifier and a text are copies, which stage 3 counts as one document and
keeps or drops together; of equal texts the smallest identifier stays; texts of any
length pass whole; an empty table passes through every stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from shelfspark.llm import bpe, jaccard, line_dedup, mixing, quality
from shelfspark.llm.common import drop, read, stage
from shelfspark.llm.queries import MIX_TARGET, WORD_BPE


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.quality_filter(docs)


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return line_dedup.line_filter(docs)


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return jaccard.near_filter(docs, width=5, percent=80)


def mix_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mix(docs, MIX_TARGET)


def encode_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return bpe.bpe_digests(docs, WORD_BPE)


STAGES = [("quality", quality_stage), ("lines", line_stage), ("near", near_stage), ("mix", mix_stage), ("encode", encode_stage)]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for name, function in STAGES[:-1]:
        before, docs = docs, stage(function(spark, docs, sf_dir), name)
        drop(before)
    return STAGES[-1][1](spark, docs, sf_dir)
