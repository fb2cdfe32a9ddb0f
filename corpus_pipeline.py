"""The corpus pipeline: quality selection, line and document de-duplication, decontamination, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which the pipeline
writes as Parquet in the shared folder and reads again as the next stage's docs.

All stages accept empty tables (no rows come out), null and empty texts (they have no
n-grams, lines, shingles or windows, stay in every stage and are packed as one token),
texts of any length, rows with null or repeated ids, and further columns of any name,
which all stages but the last pass through. What each does with ties, repeated rows and
null ids is said below. Lines go before near duplicates, so a document may lose all its
lines to an earlier one; it stays as an empty text.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from runscope.llm import decontaminate, lines, minhash, packing, quality
from runscope.llm.shared import written


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def select_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that importance resampling selects.

    Rows with null ids take part; repeated rows have equal keys, and all ties at the last key stay.
    """
    return quality.select_documents(docs, _table(spark, sf_dir, "labels"))


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows, without lines that an earlier one nearly repeats (Jaccard 0.75 of their distinct words); n_chars follows.

    Lines without words stay, and so do rows with null ids as they are. Rows that repeat an
    id are that document again: equal lines at equal places stay in all of them.
    """
    return lines.without_lines(docs).withColumn("n_chars", F.length("text").cast("long"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near duplicates: that of the smallest doc_id, null ids last; rows without words stay.

    Each row is a document of its own, whatever its id; of rows with equal id and text one stays.
    """
    return minhash.first_documents(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows without a benchmark window, each judged by its own text; rows with null or repeated ids too."""
    return decontaminate.clean_documents(docs, _table(spark, sf_dir, "benchmark"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The packed pieces of what is left; repeated rows and rows with null ids are packed each."""
    return packing.pack(docs)


STAGES = [
    ("quality", select_quality),
    ("lines", drop_lines),
    ("near_duplicates", drop_near_duplicates),
    ("decontaminate", drop_contaminated),
    ("pack", pack),
]

#: Tokenizing, packing and the seeded selection have no SQL; tests/llm/test_pipeline.py compares each stage with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
