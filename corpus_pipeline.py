"""The corpus pipeline: four stages over ``documents``, each reading what the one before it kept.

1. quality rules: documents that break the base rule or the threshold table go;
2. language ID: documents of no known language, or of a doubtful one, go;
3. n-gram Jaccard join: of each group of near-duplicates one document stays;
4. packing: what is left is packed into sequences.

Stages 1 to 3 return the columns of ``documents``; stage 4 returns pieces.

Defined results: null and empty texts go in stage 1; a null id is an id like
any other, and rows with one id and different texts are told apart by text; of
a group the row with the smallest id stays (of rows that are alike in id and
text the first by its other columns), rows without id last; empty tables stay
empty; extra columns are carried to stage 3.
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession

from quillion.llm import jaccard_join, langid, packing, quality

#: Least score of a language that is known well enough.
LEAST_LANGUAGE_SCORE = 0.5
SHINGLE_WORDS, SIMILAR, OF = 5, 80, 100
SEQUENCE_TOKENS = 2048
TOKENIZER = "word_bpe_49k.json"

#: No SQL: language ID is a learned model.
ORACLE_SQL = None


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.keep_clean(docs)


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return langid.keep_identified(docs, langid.train(docs), LEAST_LANGUAGE_SCORE)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return jaccard_join.keep_one_of_each(docs, k=SHINGLE_WORDS, num=SIMILAR, den=OF)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return packing.pack_documents(docs, public_tokenizers.path(TOKENIZER), SEQUENCE_TOKENS)


STAGES = [
    ("quality rules", quality_stage),
    ("language ID", language_stage),
    ("n-gram Jaccard join", near_duplicate_stage),
    ("packing", packing_stage),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages; between two of them the documents are written to the shared checkpoint folder and read again."""
    docs = spark.read.parquet(os.path.join(sf_dir, "documents.parquet"))
    for _, stage in STAGES[:-1]:
        docs = jaccard_join.written(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
