"""One query for each operator of this subpackage, over its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_noisy_channel(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import noisy_channel as m

    return m.score_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op2_elias_fano(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import elias_fano as m

    return m.read_token_files(m.write_token_files(table(spark, sf_dir, "documents"), tokenizer("byte_bpe_50k.json")))


def op3_jump_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import jump_hash as m

    return m.assign_shards(table(spark, sf_dir, "documents"))


def op5_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import minhash_dedup as m

    return m.near_duplicates(table(spark, sf_dir, "documents"))


def op6_backtracking_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import backtracking_bpe as m

    return m.encode_digests(table(spark, sf_dir, "documents"), tokenizer("byte_bpe_50k.json"))


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import packing as m

    return m.pack(table(spark, sf_dir, "documents"), tokenizer("word_bpe_49k.json"))


def op4_radix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import radix_dedup as m

    return m.duplicate_groups(table(spark, sf_dir, "documents"))


def op7_pivot_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import pivot_join as m

    return m.near_vectors(table(spark, sf_dir, "embeddings"))


def op8_secret_ownership(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import secret_ownership as m

    return m.scan(table(spark, sf_dir, "documents"))


def op10_link_trust(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import link_trust as m

    return m.judge(table(spark, sf_dir, "pages"))


def op11_ball_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import ball_tree as m

    return m.cluster(table(spark, sf_dir, "embeddings"))


def op12_prefix_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import prefix_bpe as m

    return m.encode_digests(table(spark, sf_dir, "documents"), tokenizer("byte_bpe_multi_50k.tiktoken"))


def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import conversation_repair as m

    return m.repair(m.damage(table(spark, sf_dir, "conversations")))


QUERIES = {f.__name__: f for f in (op1_noisy_channel, op2_elias_fano, op3_jump_hash, op4_radix_dedup, op5_minhash_dedup, op6_backtracking_bpe, op7_pivot_join, op8_secret_ownership, op9_packing, op10_link_trust, op11_ball_tree, op12_prefix_bpe, op13_conversation_repair)}


def _oracles() -> dict[str, str]:
    from . import ball_tree, link_trust, pivot_join, radix_dedup

    return {"op4_radix_dedup": radix_dedup.ORACLE, "op7_pivot_join": pivot_join.ORACLE, "op10_link_trust": link_trust.ORACLE, "op11_ball_tree": ball_tree.ORACLE}


ORACLES = _oracles()
