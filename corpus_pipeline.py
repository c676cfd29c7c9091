"""A corpus pipeline of five stages, each written and read again before the next.

Toxic documents go, later copies of repeated line runs go from the texts, one document of
each near-duplicate group stays, sources are mixed to their target weights, and what is left
is encoded. STAGES holds (name, function); a function takes (spark, docs, sf_dir).

Every stage takes null doc_ids, texts and sources, empty texts, repeated rows, ties, further
columns of any name and empty tables as its operator's docstring says; none fails on them.
Without usable labels no document is toxic.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from gridweft.llm import chunks, lines, mixing, simhash, tokens, toxicity
from gridweft.llm.common import read_documents, written


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects what scores at the threshold or above; clean documents stay whole."""
    return toxicity.without_toxic(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document stays; n_chars follows its text."""
    return lines.deduplicated(docs)


def dedup_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each SimHash group stays, whole; all texts without words are one group."""
    return simhash.without_near_copies(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A document comes as often as the mix takes it."""
    return mixing.mixed_documents(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, ids, n_tokens, ids_sha256, decoded_sha256) of every row that is left, one for each copy."""
    return chunks.encode_documents(docs, tokens.default_tokenizer())


STAGES = [
    ("toxicity", drop_toxic),
    ("line dedup", dedup_lines),
    ("SimHash near-dedup", dedup_near_copies),
    ("mixing sources", mix_sources),
    ("BPE encoding", encode),
]

#: No SQL has the tokenizer, the scores or the fingerprints; tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_documents(spark, sf_dir)
    for _, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
