"""The queries over the corpus tables and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import chat, decontaminate, fim, lines, minhash, packing, phrases, quality, sentences, suffixes, topk, toxicity, warc


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op3_suffixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixes.repeated_passages(table(spark, sf_dir, "documents"))


def op4_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id", "kept")


def op5_sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentences.repeats(table(spark, sf_dir, "documents"))


def op6_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.reply_conversations(table(spark, sf_dir, "conversations"))


def op7_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("items")


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.importance_sample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op9_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(table(spark, sf_dir, "embeddings"))


def op10_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.line_duplicates(table(spark, sf_dir, "documents"))


def op11_fim(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fim.digests(table(spark, sf_dir, "documents"))


def op12_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.collocations(table(spark, sf_dir, "documents"))


def op13_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archive_digests(table(spark, sf_dir, "pages"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {"op1_packing": op1_packing, "op2_toxicity": op2_toxicity, "op3_suffixes": op3_suffixes, "op4_minhash": op4_minhash, "op5_sentences": op5_sentences, "op6_chat": op6_chat, "op7_decontaminate": op7_decontaminate, "op8_quality": op8_quality, "op9_topk": op9_topk, "op10_lines": op10_lines, "op11_fim": op11_fim, "op12_phrases": op12_phrases, "op13_warc": op13_warc}
ORACLE_SQL: dict[str, str] = {"op7_decontaminate": decontaminate.SQL, "op9_topk": topk.SQL, "op10_lines": lines.SQL, "op5_sentences": sentences.SQL, "op6_chat": chat.SQL, "op11_fim": fim.SQL, "op12_phrases": phrases.SQL, "op13_warc": warc.SQL}
