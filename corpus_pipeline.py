"""Cleaning and packing a corpus: toxicity, exact and near duplicates, secrets, packing.

Each stage takes (spark, docs, sf_dir) and returns what is left of docs with the columns of
``documents``; the last returns the packed pieces. What a stage's result reads is there until
the driver ends; ``run`` deletes it as soon as the result is written.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexloom.llm import common, minhash_dedup, noisy_channel, packing, radix_dedup, secret_ownership
from lexloom.llm.queries import table, tokenizer


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a score of 0.5 or more go. Null and empty texts stay, as do rows that
    repeat; other columns may have any name; an empty table stays empty."""
    model = noisy_channel.fit(docs, table(spark, sf_dir, "labels"))
    score = common.free_name(docs, "score")
    return noisy_channel.score(docs, model, score).where(F.col(score) < 0.5).select(*docs.columns)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts (null: empty) the one with the largest doc_id stays, null ids last; of
    rows that repeat it any one. Other columns may have any name; an empty table stays empty."""
    return radix_dedup.drop_duplicates(docs).select(*docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies the one with the smallest doc_id stays, null ids last.
    Null, empty and blank texts all stay. Other columns may have any name; an empty table stays empty."""
    return minhash_dedup.drop_near_duplicates(docs).select(*docs.columns)


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets that look live are replaced; every document stays, null and empty texts as they
    are. Other columns may have any name; an empty table stays empty."""
    return secret_ownership.redact(docs).select(*docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces and their places; null texts are empty, rows that repeat are packed each for
    itself. An empty table gives no pieces."""
    return packing.pack(docs, tokenizer("word_bpe_49k.json"))


STAGES = [("toxicity", drop_toxic), ("exact dedup", drop_copies), ("MinHash near-dedup", drop_near_copies), ("secret scans", mask_secrets), ("best-fit packing", pack)]

#: Scores, signatures and tokens are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage over ``documents``; what a stage has stored goes as soon as
    its result is written, and that as soon as the next one's is."""
    docs = table(spark, sf_dir, "documents")
    with common.scratch():
        for i, (name, work) in enumerate(STAGES):
            with common.scratch():
                after = common.keep(common.store(work(spark, docs, sf_dir), name.replace(" ", "-")))
            if i:
                common.discard(docs)
            docs = after
        return common.keep(docs)
