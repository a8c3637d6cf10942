"""A training corpus from raw documents: five stages, each over all that its predecessor kept.

1. quality classifier: rows whose text scores under one half go;
2. line dedup: lines that an earlier document (or place) has, or has but for two
   byte edits, go, and with them documents of which only blanks are left;
3. near duplicates: of each group linked by five-word shingles at 80 % only the
   smallest doc_id stays (rows without doc_id stay);
4. decontamination: documents that hold a benchmark item, as it is or with other
   numbers, names or units, go;
5. packing: what is left becomes pieces in sequences of 2048 tokens.

All but the last return the columns of ``docs``.  Where no labels exist the
first stage rejects nothing; an empty table gives empty results.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lodestone.llm import best_fit_packing, line_dedup, minhash_forest, quality_rules, template_decontamination
from lodestone.llm.common import cut, table

SHINGLE, PERCENT = 5, 80


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = quality_rules.learn(docs, table(spark, sf_dir, "labels"))
    return quality_rules.keep_good(docs, model)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return line_dedup.without_repeated_lines(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return minhash_forest.first_of_each(docs, shingle=SHINGLE, percent=PERCENT)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return template_decontamination.without_leaks(docs, table(spark, sf_dir, "benchmark"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return best_fit_packing.pack(docs)


STAGES = [("quality", quality), ("lines", lines), ("near_duplicates", near_duplicates), ("decontamination", decontamination), ("packing", packing)]
ORACLE_SQL = None  # trained scores, MinHash candidates and tokenizers are beyond SQL; tests/llm holds stages against brute force


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows; every stage is written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
