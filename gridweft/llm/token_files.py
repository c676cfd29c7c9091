"""Token-ID output: one wavelet-matrix file body per shard, documents in ascending doc_id order."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gridweft.functions.rounds import new_folder
from gridweft.llm import tokens
from gridweft.llm.common import doc_key, from_key, in_arrow, partitions, row_keyed
from gridweft.llm.wavelet import WaveletMatrix

SHARD_IDS = 2_000_000
END_ID = 2
_SHARD = "first_key long, part int, n_docs long, n_ids long, content binary"


def write_shards(docs: DataFrame, path: str, tokenizer: str, end_id: int = END_ID, shard_ids: int = SHARD_IDS) -> None:
    """Writes the ids of every whole text to Parquet files of shards under path.

    Rows are dealt to ranges of row_keyed(), so shards sorted by (first_key, part) hold all
    documents in ascending order; a null doc_id comes first. A shard ends with the document
    that brings it to shard_ids. Null texts are empty; every document gets end_id. Rows that
    repeat a doc_id or have none are documents of their own, in the order of a hash of their
    texts. An empty table gives no shards.
    """

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        size = tokens.load(tokenizer).get_vocab_size()
        kind, code = (np.dtype("<u2"), "H") if max(size, end_id + 1) <= 1 << 16 else (np.dtype("<u4"), "I")
        bits = max(size - 1, end_id, 1).bit_length()
        memo, end = tokens.memo(tokenizer, code), np.array([end_id], kind).tobytes()
        keys, lengths, bodies, held, part, first = [], [], [], 0, 0, None

        def shard() -> pa.RecordBatch:
            nonlocal part
            matrix = WaveletMatrix.build(np.frombuffer(b"".join(bodies), kind), keys, lengths, bits)
            row = {"first_key": pa.array([first], pa.int64()), "part": pa.array([part], pa.int32()), "n_docs": [len(keys)], "n_ids": [matrix.n], "content": pa.array([matrix.to_bytes()], pa.binary())}
            part += 1
            return pa.RecordBatch.from_pydict(row)

        for batch in batches:
            for place, key, text in zip(batch["row_key"].to_pylist(), batch["doc_key"].to_pylist(), batch["text"], strict=True):
                first = first if keys else place
                body = b"".join(memo.lookup(tokens.words(text.as_py() or ""))) + end
                keys.append(key)
                bodies.append(body)
                lengths.append(len(body) // kind.itemsize)
                held += lengths[-1]
                if held >= shard_ids:
                    yield shard()
                    keys, lengths, bodies, held = [], [], [], 0
        if keys:
            yield shard()

    keyed = row_keyed(docs.select("doc_id", "text"), "row_key").select("row_key", doc_key().alias("doc_key"), "text")
    dealt = keyed.repartitionByRange(partitions(docs.sparkSession), "row_key").sortWithinPartitions("row_key")
    in_arrow(dealt, encode, _SHARD).write.option("compression", "zstd").parquet(path)


def read_shards(spark: SparkSession, path: str, end_id: int = END_ID) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32, n_ends, end_at) of every document, from the files.

    ids_crc32 is of the ids, which come from the planes. n_ends, by rank, is how often end_id
    stands in the document, and end_at, by select, the place of the last one in it, from 0,
    null where it has none. Without shards there are no rows; a null doc_id is null again.
    """

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, part, content in zip(batch["first_key"].to_pylist(), batch["part"].to_pylist(), batch["content"], strict=True):
                matrix = WaveletMatrix.from_bytes(content.as_py())
                ids = matrix.to_array().astype("<u4")
                ends = np.cumsum(matrix.lengths)
                starts = ends - matrix.lengths
                n = len(ends)
                upto = matrix.rank_many(end_id, ends)
                before = np.append(0, upto[:-1])  # a document begins where the one before ends
                last = matrix.select_many(end_id, np.maximum(upto - 1, 0)) if matrix.count(end_id) else starts
                yield pa.RecordBatch.from_pydict(
                    {
                        "first_key": np.full(n, first, np.int64),
                        "part": np.full(n, part, np.int32),
                        "doc_key": matrix.docs,
                        "within": starts,
                        "n_tokens": matrix.lengths,
                        "ids_crc32": np.array([zlib.crc32(ids[s:e]) for s, e in zip(starts.tolist(), ends.tolist(), strict=True)], np.int64),
                        "n_ends": upto - before,
                        "end_at": pa.array(last - starts, mask=upto == before),
                    }
                )

    shards = spark.read.parquet(path)
    # one small row for each shard of some two million ids meets in one task
    before = Window.orderBy("first_key", "part").rowsBetween(Window.unboundedPreceding, -1)
    bases = shards.select("first_key", "part", F.coalesce(F.sum("n_ids").over(before), F.lit(0)).alias("base"))
    rows = in_arrow(shards.select("first_key", "part", "content"), decode, "first_key long, part int, doc_key long, within long, n_tokens long, ids_crc32 long, n_ends long, end_at long")
    return rows.join(bases, ["first_key", "part"]).select(from_key().alias("doc_id"), (F.col("base") + F.col("within")).alias("start"), "n_tokens", "ids_crc32", "n_ends", "end_at")


def find_token(spark: SparkSession, path: str, token: int) -> DataFrame:
    """(doc_id, place) of every occurrence of a token, by rank and select without decoding a shard.

    place counts a document's ids from 0. A token that no document has gives no rows, nor do
    files without shards; documents without id have a null one.
    """

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch["content"]:
                matrix = WaveletMatrix.from_bytes(content.as_py())
                at = matrix.select_many(token, np.arange(matrix.count(token), dtype=np.int64))
                ends = np.cumsum(matrix.lengths)
                doc = np.searchsorted(ends, at, side="right")
                yield pa.RecordBatch.from_pydict({"doc_key": matrix.docs[doc], "place": at - (ends - matrix.lengths)[doc]})

    return in_arrow(spark.read.parquet(path).select("content"), find, "doc_key long, place long").select(from_key().alias("doc_id"), "place")


def fresh_path(spark: SparkSession) -> str:
    """A new folder in the shared checkpoint folder."""
    return new_folder(spark, "shards")


