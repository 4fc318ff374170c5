"""A corpus pipeline of four operators, each over all rows that the one before it kept.

Null and empty texts are documents without words: the classifier keeps or rejects
them all alike, and of those kept one passes the dedup stages.  Null ids and ids
that several rows have are no error: rows are told apart by their texts, and of
wholly equal rows one stays.  Other columns pass through the filtering stages under
their own names, whatever those are.  An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from meshset.llm import exact_dedup, packing, quality, simhash
from meshset.llm.common import drop_scratch, materialise
from meshset.llm.queries import table, tokenizer


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier, learned from the labels, rejects go; without labels of both kinds all have one score."""
    return quality.keep_good(docs, quality.fit(docs, table(spark, sf_dir, "labels")))


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of texts that are equal without white space stays: the longest, then the one with the smallest id."""
    return exact_dedup.exact_dedup(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays, the one with the smallest id."""
    return simhash.near_dedup(docs, radius=3, words=3)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where each piece of what is left lies in sequences of at most 2048 tokens."""
    return packing.pack(docs, tokenizer("word_bpe_49k.json"), capacity=2048, kept=100_000, forget=True)


STAGES = [("quality classifier", keep_good), ("exact dedup", drop_copies), ("simhash near-dedup", drop_near_copies), ("best-fit packing", pack)]

#: A learned score, hashes and tokenizers are beyond SQL; tests/llm holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; what each returns is written to the shared folder, read by the next one, and deleted after it."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        kept = materialise(stage(spark, docs, sf_dir), name.replace(" ", "-"), arrow_rows=1024)
        drop_scratch(docs)
        docs = kept
    packed = materialise(STAGES[-1][1](spark, docs, sf_dir), "packed")
    drop_scratch(docs)
    return packed
