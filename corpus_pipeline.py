"""The corpus pipeline: quality rules, language ID, near-duplicates, decontamination, encoding.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; it is written as Parquet and read again as the next
stage's ``docs``.  All but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from noticewindows.llm import language_id, minhash_join, piece_viterbi, quality_rules, spaced_seeds, store


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 2: documents that break a rule go."""
    return quality_rules.keep_good(docs)


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 7: documents without letters, or whose language stays open, go."""
    return language_id.keep_known(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 6, five words and 80 percent: one document of each class stays."""
    return minhash_join.one_of_each(docs, shingle_words=5, percent=80)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 5: documents that hold a passage of the benchmark go."""
    return spaced_seeds.remove_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 9: ``doc_id, lang, source, n_pieces, n_bytes, ids`` of what is left."""
    return piece_viterbi.encode(docs, keep=("doc_id", "lang", "source"))


STAGES = [
    ("quality_rules", quality),
    ("language_id", language),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontaminate),
    ("pieces", pieces),
]

#: Language ID, the tokenizer and the near-duplicate classes have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = store.stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
