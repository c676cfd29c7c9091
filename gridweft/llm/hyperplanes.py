"""Embedding near-duplicates: sign hashes by random hyperplanes, exact cosines, connected components."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import FloatType

from gridweft.llm.common import components, in_arrow, saved, spread_join

THRESHOLD, RECALL, SEED = 0.9, 0.995, 42
#: A bucket of unrelated vectors holds about so many; a bucket of more than BLOCK goes in blocks.
MEAN_BUCKET, BLOCK = 512, 1024


def tables_for(n: int, threshold: float = THRESHOLD, recall: float = RECALL) -> tuple[int, int]:
    """(bits of a table's key, number of tables) for n vectors.

    Two vectors at the threshold lie on one side of a random hyperplane with probability
    p = 1 - angle / pi, so `tables` keys of `bits` signs meet once at least with probability
    1 - (1 - p^bits)^tables; tables is the least number for which that reaches the recall.
    Closer pairs meet more often: at 0.95 all but 2 in 10,000 do.
    """
    bits = max(6, math.ceil(math.log2(max(1, n) / MEAN_BUCKET)))
    meet = (1 - math.acos(threshold) / math.pi) ** bits
    return bits, max(1, math.ceil(math.log(1 - recall) / math.log(1 - meet)))


def _read(width: str):
    """vec_id, digest and bytes of vectors; null bytes where a vector links with nothing."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lengths = pc.fill_null(pc.list_value_length(batch["x"]), 0).to_numpy()
            flat = batch["x"].flatten().to_numpy(zero_copy_only=False).astype(width) + 0.0  # one zero
            starts = np.cumsum(lengths) - lengths
            bodies: list[bytes | None] = [None] * batch.num_rows
            for n in np.unique(lengths[lengths > 0]):
                at = np.flatnonzero(lengths == n)
                x = flat[starts[at][:, None] + np.arange(n)]
                for k in np.flatnonzero(np.isfinite(x).all(1) & (x != 0).any(1)):
                    bodies[at[k]] = x[k].tobytes()
            digests = [b and hashlib.blake2b(b, digest_size=16).digest() for b in bodies]
            yield pa.RecordBatch.from_arrays([batch["vec_id"], pa.array(digests, pa.binary()), pa.array(bodies, pa.binary())], ["vec_id", "digest", "v"])

    return run


def _unit(bodies: pa.Array, width: str) -> np.ndarray:
    """Vectors of one length as rows of doubles, divided by their greatest component so that squares neither overflow nor vanish."""
    x = np.frombuffer(b"".join(bodies.to_pylist()), width).reshape(len(bodies), -1).astype(np.float64)
    return x / np.abs(x).max(1, keepdims=True)


def _signs(width: str, bits: int, tables: int, seed: int):
    """keys: of each vector one int64 for every table, the signs of its products with the table's hyperplanes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        planes: dict[int, np.ndarray] = {}
        for batch in batches:
            if not batch.num_rows:
                continue
            keys: list[bytes] = [b""] * batch.num_rows
            sizes = pc.binary_length(batch["v"]).to_numpy()
            for size in np.unique(sizes):
                at = np.flatnonzero(sizes == size)
                x = _unit(batch["v"].take(pa.array(at)), width)
                dim = x.shape[1]
                if dim not in planes:
                    planes = {dim: np.random.default_rng([seed, dim]).standard_normal((dim, tables * bits))}
                side = (x @ planes[dim] > 0).reshape(len(x), tables, bits)
                own = side.astype(np.int64) @ (1 << np.arange(bits, dtype=np.int64))
                for k, row in zip(at, own, strict=True):
                    keys[k] = row.tobytes()
            longs = pa.ListArray.from_arrays(pa.array(np.arange(batch.num_rows + 1, dtype=np.int32) * tables), pa.array(np.frombuffer(b"".join(keys), np.int64)))
            yield pa.RecordBatch.from_arrays([batch["id"], longs], ["id", "keys"])

    return run


def _forest(linked: np.ndarray) -> list[tuple[int, int]]:
    """Edges that join what the symmetric matrix joins, fewer than it has rows."""
    free, out = linked.any(1), []
    for first in np.flatnonzero(free):
        if not free[first]:
            continue
        free[first], waiting = False, [first]
        while waiting:
            here = waiting.pop()
            near = np.flatnonzero(linked[here] & free)
            free[near] = False
            out += [(here, k) for k in near]
            waiting += near.tolist()
    return out


def _verify(width: str, threshold: float):
    """Of a pair of blocks of a bucket, the links found in its table first: (a, null, n) says that a has n of them, (a, b, null) are edges that join the same vectors."""

    def run(key: tuple, table: pa.Table) -> pa.Table:
        t, low, high = key[0].as_py(), key[3].as_py(), key[4].as_py()
        part, ids, weight = table["part"].to_numpy(), table["id"].to_numpy(), table["weight"].to_numpy()
        x = _unit(table["v"].combine_chunks(), width)
        x = x / np.sqrt((x * x).sum(1, keepdims=True))
        left, right = np.flatnonzero(part == low), np.flatnonzero(part == high)
        links = x[left] @ x[right].T >= threshold
        if low == high:
            links &= left[:, None] < right[None, :]
        if t and links.any():
            keys = table["earlier"].combine_chunks().flatten().to_numpy().reshape(len(ids), t)
            for k in range(t):
                links &= keys[left, k][:, None] != keys[right, k][None, :]
        a: list = []
        b: list = []
        n: list = []
        if links.any():
            counts = np.zeros(len(ids), np.int64)
            counts[left] += links @ weight[right]
            counts[right] += weight[left] @ links
            at = np.flatnonzero(counts)
            square = np.zeros((len(ids), len(ids)), bool)
            square[np.ix_(left, right)] = links
            edges = _forest(square | square.T)
            a = [*ids[at].tolist(), *(int(ids[i]) for i, _ in edges)]
            b = [*[None] * len(at), *(int(ids[j]) for _, j in edges)]
            n = [*counts[at].tolist(), *[None] * len(edges)]
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64()), "n": pa.array(n, pa.int64())})

    return run


def linked(vectors: DataFrame, threshold: float = THRESHOLD, recall: float = RECALL, seed: int = SEED) -> DataFrame:
    """(vec_id, n_links, component_id), one row for each input row.

    Vectors of equal length link where their cosine in double precision reaches the threshold.
    Every link told is verified; of pairs exactly at the threshold the share `recall` is
    expected to be found, and more of closer ones (tables_for()). n_links counts the rows
    linked directly, component_id is the smallest vec_id that links reach, the row's own
    included. Rows of equal vectors are linked with each other. A vector that is null, empty,
    zero or holds null or non-finite components links with nothing and is its own component.
    Rows that repeat a vec_id, or have none, are vectors of their own; a null id names a
    component only where all its ids are null. An empty table gives no rows.

    Only distinct vectors are hashed and compared. Each bucket of a table is compared by
    matrix products of blocks, and a pair that meets in several tables counts in the first.
    No pairs leave a task: it tells how many links each vector has, and a spanning forest of
    them. A bucket of p blocks costs p^2 / 2 products of blocks in as many tasks.
    """
    width = "<f4" if isinstance(vectors.schema["embedding"].dataType.elementType, FloatType) else "<f8"
    x = F.col("embedding") if width == "<f4" else F.col("embedding").cast("array<double>")
    rows = saved(in_arrow(vectors.select(F.col("vec_id").cast("long").alias("vec_id"), x.alias("x")), _read(width), "vec_id long, digest binary, v binary"))
    distinct = rows.filter("digest is not null").groupBy("digest").agg(F.first("v").alias("v"), F.count(F.lit(1)).alias("weight"), F.min("vec_id").alias("least"))
    distinct = saved(distinct.withColumn("id", F.monotonically_increasing_id()))
    bits, tables = tables_for(distinct.count(), threshold, recall)

    keyed = saved(in_arrow(distinct.select("id", "v"), _signs(width, bits, tables, seed), "id long, keys array<long>"))
    size = distinct.select("id", F.length("v").alias("size"))
    each = keyed.join(size, "id").select("id", "size", F.posexplode("keys").alias("t", "key"))
    bucket = ["t", "size", "key"]
    large = saved(each.groupBy(*bucket).count().filter(F.col("count") > BLOCK).select(*bucket, F.ceil(F.col("count") / BLOCK).cast("int").alias("parts")))
    split = spread_join(each, large, bucket, "inner").groupBy("id").agg(F.map_from_entries(F.collect_list(F.struct("t", "parts"))).alias("split"))  # an entry for each table at most

    placed = distinct.select("id", "v", "weight").join(keyed, "id").join(split, "id", "left")
    placed = placed.select("id", "v", "weight", "split", F.length("v").alias("size"), "keys", F.posexplode("keys").alias("t", "key"))
    placed = placed.withColumn("parts", F.coalesce(F.element_at("split", F.col("t")), F.lit(1)))
    placed = placed.withColumn("part", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    placed = placed.select(*bucket, F.least("part", "other").alias("low"), F.greatest("part", "other").alias("high"), "part", "id", "weight", "v", F.slice("keys", 1, F.col("t")).alias("earlier"))
    return _classes(rows, distinct, placed, width, threshold)


def _classes(rows: DataFrame, distinct: DataFrame, placed: DataFrame, width: str, threshold: float) -> DataFrame:
    """What the links of the blocks say of every row."""
    found = saved(placed.groupBy("t", "size", "key", "low", "high").applyInArrow(_verify(width, threshold), "a long, b long, n long"))
    counts = found.filter("b is null").groupBy(F.col("a").alias("id")).agg(F.sum("n").alias("n"))
    roots = components(found.filter("b is not null").select("a", "b")).select(F.col("node").alias("id"), "root")
    known = saved(distinct.select("digest", "id", "weight", "least").join(roots, "id", "left").withColumn("root", F.coalesce("root", "id")).join(counts, "id", "left"))
    names = known.groupBy("root").agg(F.min("least").alias("component_id"))
    facts = known.join(names, "root").select("digest", (F.col("weight") - 1 + F.coalesce("n", F.lit(0))).alias("n_links"), "component_id", F.lit(True).alias("links"))
    out = spread_join(rows.select("vec_id", "digest"), saved(facts), ["digest"], "left")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.when(F.col("links"), F.col("component_id")).otherwise(F.col("vec_id")).alias("component_id"))
