"""The corpus pipeline: five stages over documents, each written and read again before the next."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm import linededup, packing, repeats, simhash, toxicity
from quarry.llm.common import read, written

#: What the stages hand on: the columns of documents.
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def _documents(df: DataFrame) -> DataFrame:
    return df.withColumn("n_chars", F.coalesce(F.length("text"), F.lit(0)).cast("long")).select(*COLUMNS)


def toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score 0.5 or more for toxicity go."""
    return toxicity.reject_toxic(docs, read(spark, sf_dir, "labels")).select(*COLUMNS)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that match an earlier line go; documents stay."""
    return _documents(linededup.dedup_lines(docs))


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates the smallest doc_id stays: sets of five-word shingles alike by 0.8 (Jaccard)."""
    return simhash.keep_first(docs).select(*COLUMNS)


def suffixes(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Strings of 100 bytes that start earlier, too, go, up to whole characters; documents stay."""
    out = repeats.remove_repeats(docs, whole_chars=True)
    return _documents(out.withColumn("text", F.col("kept").cast("string")))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What is left, as pieces of at most 4096 tokens in sequences."""
    pieces = packing.token_pieces(docs)
    return packing.pack(written(pieces.select("doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32"))), ["doc_id", "piece"])


STAGES = [("toxicity", toxic), ("line_dedup", lines), ("simhash", near), ("suffix_array_dedup", suffixes), ("packing", pack)]

#: No stage of learned scores, byte spans or tokens can be said in SQL; tests compare the near-duplicate stage and the other operators with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
