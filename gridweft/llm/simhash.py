"""SimHash near-duplicate groups, candidates found by Golay-code fuzzy hashing."""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from gridweft.llm.common import components, doc_key, from_key, in_arrow, saved, spare, written

SHINGLE_WORDS, MAX_BITS, SEED = 3, 3, 42
#: Fixed value: generator polynomial of the binary Golay code of length 23.
GENERATOR = 0xC75
#: Bits of the three segments of a fingerprint, each a word of the code padded by zeros.
SEGMENTS = (22, 21, 21)
_CHUNK = 200_000


def fingerprint(text: str | None) -> int:
    """64-bit SimHash of a whole text as a signed integer; 0 if it has no words."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    body = b" ".join(words)
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(lengths + 1) - 1
    starts = ends - lengths
    width = min(SHINGLE_WORDS, len(words))
    n = len(words) - width + 1
    ones = np.zeros(64, np.int64)
    digest = xxhash.xxh64_digest
    for low in range(0, n, _CHUNK):
        high = min(n, low + _CHUNK)
        spans = zip(starts[low:high].tolist(), ends[low + width - 1 : high + width - 1].tolist(), strict=True)
        hashes = np.frombuffer(b"".join([digest(body[s:e], SEED) for s, e in spans]), np.uint8).reshape(-1, 8)
        ones += np.unpackbits(hashes, axis=1).sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > n).tobytes(), "big", signed=True)


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = [fingerprint(t.as_py()) for t in batch["text"]]
        yield pa.RecordBatch.from_pydict({"doc_key": batch["doc_key"], "fp": pa.array(found, pa.int64())})


@cache
def _syndromes() -> np.ndarray:
    """Remainders modulo the generator of the 23 single bits."""
    out = []
    for bit in range(23):
        value = 1 << bit
        for high in range(22, 10, -1):
            if value >> high & 1:
                value ^= GENERATOR << (high - 11)
        out.append(value)
    return np.array(out, np.int64)


@cache
def _patterns() -> tuple[np.ndarray, np.ndarray]:
    """Of each syndrome: its errors of weight up to 4, the least first, and which of 6 places hold one.

    The code is perfect, so each syndrome has one error of weight up to 3; those of weight 3
    have five of weight 4 besides.
    """
    found: list[list[int]] = [[] for _ in range(1 << 11)]
    single = _syndromes()
    for weight in range(5):
        for bits in combinations(range(23), weight):
            s = int(np.bitwise_xor.reduce(single[list(bits)])) if bits else 0
            found[s].append(sum(1 << b for b in bits))
    table = np.array([p + [0] * (6 - len(p)) for p in found], np.int64)
    return table, np.array([[k < len(p) for k in range(6)] for p in found])


def near_codewords(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Indices of the codewords within 4 bits of each word, its own first; which places hold one."""
    syndrome = np.zeros(len(words), np.int64)
    for bit, s in enumerate(_syndromes()):
        syndrome ^= np.where(words >> bit & 1, s, 0)
    table, there = _patterns()
    return (words[:, None] ^ table[syndrome]) >> 11, there[syndrome]


def keys(fps: np.ndarray, probe: bool) -> tuple[np.ndarray, np.ndarray]:
    """(row, key) of fingerprints: any two within 3 bits meet, one as stored and one as probe.

    Three differing bits leave, of three segments, either two equal ones; or one equal and
    one that differs by one bit; or one differing bit in each. A word within one bit of
    another is within 4 bits of the other's codeword, so a stored segment gives its own
    codeword's index and a probe those of all codewords within 4 bits. A segment that
    differs by one bit has the other parity, which the keys hold too.
    """
    u, at, parts = fps.view(np.uint64), 0, []
    for bits in SEGMENTS:
        parts.append((u >> np.uint64(at) & np.uint64((1 << bits) - 1)).astype(np.int64))
        at += bits
    codes = [near_codewords(p) for p in parts]
    parity = [np.bitwise_count(p).astype(np.int64) & 1 ^ int(probe) for p in parts]
    take = 6 if probe else 1
    rows, out = [], []

    def add(tag: int, value: np.ndarray, mask: np.ndarray | None = None) -> None:
        value = (value.reshape(len(fps), -1) << 4) | tag
        row = np.repeat(np.arange(len(fps)), value.shape[1])
        keep = slice(None) if mask is None else mask.reshape(-1)
        rows.append(row[keep])
        out.append(value.reshape(-1)[keep])

    for tag, (i, j) in enumerate(combinations(range(3), 2)):
        add(tag, parts[i] << 23 | parts[j])
    for tag, (i, j) in enumerate([(i, j) for i in range(3) for j in range(3) if i != j], 3):
        index, there = codes[j][0][:, :take], codes[j][1][:, :take]
        add(tag, (parts[i] << 1 | parity[j])[:, None] << 12 | index, there)
    both = codes[0][0][:, :take, None] << 12 | codes[1][0][:, None, :take]
    there = codes[0][1][:, :take, None] & codes[1][1][:, None, :take]
    add(9, (parity[0] << 2 | parity[1] << 1 | parity[2])[:, None, None] << 24 | both, there)
    return np.concatenate(rows), np.concatenate(out)


def _keyed(probe: bool):
    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            every = batch["fp"].to_numpy()
            for low in range(0, len(every), 4096):
                fps = every[low : low + 4096]
                row, key = keys(fps, probe)
                yield pa.RecordBatch.from_pydict({"key": key, "fp": fps[row]})

    return emit


def links(fps: DataFrame) -> DataFrame:
    """(a, b), a < b, of the distinct fingerprints in column fp that differ by 3 bits or fewer."""
    stored = in_arrow(fps, _keyed(False), "key long, fp long").withColumnRenamed("fp", "a")
    probes = in_arrow(fps, _keyed(True), "key long, fp long").withColumnRenamed("fp", "b")
    return stored.join(probes, "key").filter((F.col("a") < F.col("b")) & (F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= MAX_BITS)).select("a", "b").distinct()


def _roots(fps: DataFrame) -> DataFrame:
    """(fp, root) of the fingerprints in column fp, which are distinct; root names the component."""
    roots = components(links(fps))
    return fps.join(roots, fps.fp == roots.node, "left").select("fp", F.coalesce("root", "fp").alias("root"))


def near_groups(docs: DataFrame) -> DataFrame:
    """(doc_id, fingerprint, component_id), one row per input row.

    Documents whose fingerprints differ by 3 bits or fewer are linked; component_id is the
    smallest doc_id reachable. Only distinct fingerprints are keyed, joined and walked, so
    copies cost no pairs. Null, empty and blank texts have fingerprint zero, linked like any
    other. A null doc_id is smaller than no other: it names a component only where all its
    ids are null. Rows that repeat are members as often. An empty table gives no rows.
    """
    texts = docs.select(doc_key().alias("doc_key"), "text")
    found = saved(in_arrow(texts, _fingerprints, "doc_key long, fp long"))
    least = saved(found.groupBy("fp").agg(F.min(from_key()).alias("least")))
    named = saved(least.join(_roots(least.select("fp")), "fp").select("fp", "root", "least"))
    ids = named.groupBy("root").agg(F.min("least").alias("component_id"))
    of = named.join(ids, "root").select("fp", "component_id")
    return found.join(of, "fp").select(from_key().alias("doc_id"), F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def without_near_copies(docs: DataFrame) -> DataFrame:
    """One row of each component, whole: that of smallest doc_id, null ids last.

    Rows are members each by itself, those too that repeat a doc_id or have none; of rows of
    the same id in one component that of least text hash stays.
    """
    row, fp = spare(docs, "_row", "_fp")
    columns, at = docs.columns, docs.columns.index("text")

    def with_fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = pa.array([fingerprint(t.as_py()) for t in batch.column(at)], pa.int64())
            yield pa.RecordBatch.from_arrays([*batch.columns, fps], [*columns, fp])

    rows = in_arrow(docs, with_fingerprints, StructType([*docs.schema.fields, StructField(fp, LongType())]))
    rows = written(rows.withColumn(row, F.monotonically_increasing_id()))
    place = F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id"), F.xxhash64("text").alias("h"), F.col(row).alias("row"))
    members = rows.select(F.col(fp).alias("fp"), place.alias("place"))
    least = saved(members.groupBy("fp").agg(F.min("place").alias("place")))
    keep = least.join(_roots(least.select("fp")), "fp").groupBy("root").agg(F.min("place").alias("place")).select(F.col("place.row").alias(row))
    return rows.join(keep, row, "left_semi").select(*columns)
