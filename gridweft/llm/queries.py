"""The thin opN_ queries: each applies its operator, with production parameters, to its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridweft.llm import audit, balls, chunks, counts, hyperplanes, lines, mixing, oracles, simhash, substring, token_files, tokens, topk, toxicity, weighted
from gridweft.llm.common import read_documents


def op7_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.without_repeats(read_documents(spark, sf_dir), digest=True)


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return counts.section_counts(read_documents(spark, sf_dir), None, tokens.default_tokenizer())


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = toxicity.scored(read_documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))
    held_out = F.coalesce(~toxicity.learnable(), F.lit(False))
    return found.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= toxicity.THRESHOLD).cast("int").alias("predicted"), "evidence")


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(read_documents(spark, sf_dir)).select("doc_id", "size", "source_size", "target", "taken")


def op1_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.without_repeated_lines(read_documents(spark, sf_dir), digest=True)


def op2_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.nearest(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), F.col("vec_id") % 50 == 0)


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_groups(read_documents(spark, sf_dir))


def op4_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    tokenizer = tokens.default_tokenizer()
    encoded = chunks.encode_documents(read_documents(spark, sf_dir), tokenizer, digest=False)
    return chunks.digests(encoded, tokenizer)


def op5_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return weighted.against_next(read_documents(spark, sf_dir))


def op6_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = token_files.fresh_path(spark)
    token_files.write_shards(read_documents(spark, sf_dir), path, tokens.default_tokenizer())
    return token_files.read_shards(spark, path)


def op11_near_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = hyperplanes.linked(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    return found.withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))


def op12_balls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return balls.clusters(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def op13_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.interactions(read_documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


QUERIES = {
    "op1_lines": op1_lines,
    "op2_top_k": op2_top_k,
    "op3_simhash": op3_simhash,
    "op4_bpe": op4_bpe,
    "op5_fingerprints": op5_fingerprints,
    "op6_token_files": op6_token_files,
    "op7_substrings": op7_substrings,
    "op8_token_counts": op8_token_counts,
    "op9_toxicity": op9_toxicity,
    "op10_mixing": op10_mixing,
    "op11_near_vectors": op11_near_vectors,
    "op12_balls": op12_balls,
    "op13_audit": op13_audit,
}

ORACLES = {
    "op1_lines": oracles.LINES,
    "op2_top_k": oracles.TOP_K,
    "op7_substrings": oracles.SUBSTRINGS,
    "op11_near_vectors": oracles.NEAR_VECTORS,
    "op12_balls": oracles.BALLS,
    "op13_audit": oracles.AUDIT,
}
