"""Exact top-k by inner product with pivot-table elimination."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridweft.llm.common import in_arrow, saved
from gridweft.ship import ship

BLOCK, QUERY_BLOCK, STEP = 1024, 128, 64
#: Pivots: so many for each doubling of the vectors, chosen among so many.
PIVOTS_A_DOUBLING, PIVOT_SAMPLE = 4, 1024
#: Room left to rounding in bounds, absolute and relative; scores are integers.
_SLACK, _RELATIVE = 1.0, 1e-6
_BLOCK_ROW = "home int, part int, rows binary, ids binary, vectors binary, norms binary, pivots binary"


def _distances(vectors: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    """(vectors, pivots) Euclidean distances."""
    v, p = vectors.astype(np.float64), pivots.astype(np.float64)
    return np.sqrt(np.maximum(0, (v * v).sum(1)[:, None] + (p * p).sum(1)[None, :] - 2 * v @ p.T))


def spread_out(vectors: np.ndarray, n: int) -> np.ndarray:
    """n of the vectors: the first, and then always the one farthest from those taken."""
    taken = [0]
    nearest = _distances(vectors, vectors[:1])[:, 0]
    while len(taken) < min(n, len(vectors)) and nearest.max() > 0:
        taken.append(int(nearest.argmax()))
        nearest = np.minimum(nearest, _distances(vectors, vectors[taken[-1:]])[:, 0])
    return vectors[taken]


def quantised(vectors: DataFrame, scale: int, is_query: Column) -> DataFrame:
    """(row, vec_id, v array<long>, asks) with floor(scale * x) of every component as double, row a number of its own.

    Vectors that are null, empty or hold null or non-finite components take no part, nor do
    rows without vec_id. Components of 2^63 / scale or more in size are an error of ANSI
    sessions and saturate in others.
    """
    x = F.col("embedding")
    finite = F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    rows = vectors.filter(F.col("vec_id").isNotNull() & x.isNotNull() & (F.size(x) > 0)).filter(F.coalesce(finite, F.lit(False)))
    return rows.select(F.monotonically_increasing_id().alias("row"), F.col("vec_id").cast("long").alias("vec_id"), F.transform(x, lambda c: F.floor(c.cast("double") * scale)).alias("v"), F.coalesce(is_query, F.lit(False)).alias("asks"))


def _blocks(rows: DataFrame, pivots: np.ndarray, size: int) -> DataFrame:
    """Rows of equal home in blocks of about so many, each a row with its part of the pivot table."""
    counts = {r["home"]: r["count"] for r in rows.groupBy("home").count().collect()}  # a row for each pivot
    parts = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for h, n in (counts or {0: 1}).items() for x in (h, -(-n // size))]), F.col("home")), F.lit(1))

    def block(table: pa.Table) -> pa.Table:
        table = table.sort_by([("vec_id", "ascending"), ("row", "ascending")])
        numbers, ids = table["row"].to_numpy(), table["vec_id"].to_numpy()
        v = np.array(table["v"].to_pylist(), np.int64)
        row = {"home": table["home"][:1], "part": table["part"][:1], "rows": [numbers.tobytes()], "ids": [ids.tobytes()], "vectors": [v.tobytes()], "norms": [(v * v).sum(1).tobytes()], "pivots": [_distances(v, pivots).astype(np.float32).tobytes()]}
        return pa.table(row, schema=pa.schema([("home", pa.int32()), ("part", pa.int32()), *[(c, pa.binary()) for c in ("rows", "ids", "vectors", "norms", "pivots")]]))

    return rows.withColumn("part", F.pmod(F.xxhash64("row"), parts).cast("int")).groupBy("home", "part").applyInArrow(block, _BLOCK_ROW)


def _open(row: dict, prefix: str, width: int) -> tuple[np.ndarray, ...]:
    rows, ids, norms = (np.frombuffer(row[prefix + c], np.int64) for c in ("rows", "ids", "norms"))
    return rows, ids, np.frombuffer(row[prefix + "vectors"], np.int64).reshape(len(ids), -1), norms, np.frombuffer(row[prefix + "pivots"], np.float32).reshape(len(ids), width)


def _products(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Exact integer inner products of all of q and x, by floating point where that is exact."""
    most = max(1, int(np.abs(q).max(initial=0))) * max(1, int(np.abs(x).max(initial=0))) * q.shape[1]
    return (q.astype(np.float64) @ x.astype(np.float64).T).astype(np.int64) if most < 1 << 53 else q @ x.T


def _best(query: tuple, block: tuple, least: np.ndarray, k: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(place of query, candidates' places, scores): up to k of this block for each query, exactly.

    |q - x| is at least the greatest difference of their distances to a pivot, which bounds
    q.x from above. Of each query the candidates of greatest bounds are scored first, and then
    those whose bounds reach the k-th best score so far or what the query is known to reach
    elsewhere; the others are eliminated. Equal scores are kept.
    """
    q_rows, _, q, q_norms, q_pivots = query
    rows, ids, x, norms, pivots = block
    apart, gap = np.zeros((len(q), len(x)), np.float32), np.empty((len(q), len(x)), np.float32)
    for p in range(q_pivots.shape[1]):
        np.subtract(q_pivots[:, p, None], pivots[None, :, p], out=gap)
        np.abs(gap, out=gap)
        np.maximum(apart, gap, out=apart)
    sizes = (q_norms[:, None] + norms[None, :]).astype(np.float64)
    bounds = (sizes - apart.astype(np.float64) ** 2) / 2 + _SLACK + _RELATIVE * sizes
    bounds[q_rows[:, None] == rows[None, :]] = -np.inf
    reached = least.astype(np.float64)
    step = max(STEP, k)
    if len(x) > 2 * step:
        first = np.argpartition(-bounds, step, axis=1)[:, :step]
        scores = np.einsum("qd,qkd->qk", q, x[first])
        kth = np.partition(np.where(np.take_along_axis(bounds, first, 1) > -np.inf, scores, np.iinfo(np.int64).min), step - k, axis=1)[:, step - k]
        reached = np.maximum(reached, kth)
    wanted = (bounds >= reached[:, None]) & (bounds > -np.inf)
    some = np.flatnonzero(wanted.any(0))
    scores = _products(q, x[some])
    for at in range(len(q)):
        mine = np.flatnonzero(wanted[at, some] & (scores[at] >= least[at]))
        if len(mine) > k:
            own = scores[at][mine]
            mine = mine[own >= np.partition(own, len(own) - k)[len(own) - k]]
        if len(mine):
            place = some[mine]
            best = np.lexsort((rows[place], ids[place], -scores[at][mine]))[:k]
            yield at, place[best], scores[at][mine[best]]


def nearest(vectors: DataFrame, is_query: Column, k: int = 5, scale: int = 256, pivots: int | None = None) -> DataFrame:
    """(query_id, rank, vec_id, score): each query row's k greatest integer inner products with other rows.

    Ties go to the smaller vec_id; a query of fewer candidates gets all of them. Rows that
    repeat a vec_id are rows of their own, as queries and as candidates. Vectors are searched
    among those of their own length, a search for each length. What quantised() leaves out
    takes no part. An empty table gives no rows. pivots defaults to PIVOTS_A_DOUBLING times
    the logarithm of the number of vectors.
    """
    rows = saved(quantised(vectors, scale, is_query))
    lengths = sorted(r["n"] for r in rows.select(F.size("v").alias("n")).distinct().collect())
    out = None
    for n in lengths or [0]:
        part = _nearest(rows.filter(F.size("v") == n), k, pivots)
        out = part if out is None else out.unionByName(part)
    return out


def _nearest(rows: DataFrame, k: int, pivots: int | None) -> DataFrame:
    """nearest() of the rows (row, vec_id, v, asks), whose vectors are of one length.

    Queries and candidates are kept in blocks about the same pivots. Each query is first held
    against blocks of its own pivot, then query blocks meet all blocks; pairs of blocks whose
    pivot distances bound every score below what the queries already reach are left out, and
    within a pair single candidates are.
    """
    spark = rows.sparkSession
    ship(spark)
    n = rows.count()
    width = pivots or max(1, PIVOTS_A_DOUBLING * max(1, n).bit_length())
    sample = rows.orderBy(F.xxhash64("vec_id", "row"), "row").limit(max(PIVOT_SAMPLE, width)).select("v").collect()
    table = spread_out(np.array([r["v"] for r in sample] or [[0]], np.int64), width)
    width = len(table)

    def homes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                flat = batch["v"].flatten().to_numpy().reshape(batch.num_rows, -1)
                yield batch.append_column("home", pa.array(_distances(flat, table).argmin(1).astype(np.int32)))

    placed = saved(in_arrow(rows.select("row", "vec_id", "v", "asks"), homes, "row long, vec_id long, v array<long>, asks boolean, home int"))
    blocks = saved(_blocks(placed, table, BLOCK))
    queries = saved(_blocks(placed.filter("asks"), table, QUERY_BLOCK))
    asking = queries.select(*[F.col(c).alias("q_" + c) for c in queries.columns])

    def reach(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                query = _open(row, "q_", width)
                out = np.full(len(query[0]), np.iinfo(np.int64).min)
                for at, _, scores in _best(query, _open(row, "", width), out.copy(), k):
                    if len(scores) >= k:
                        out[at] = scores[k - 1]
                yield pa.RecordBatch.from_pydict({"home": pa.array([row["q_home"]], pa.int32()), "part": pa.array([row["q_part"]], pa.int32()), "least": pa.array([out.tolist()], pa.list_(pa.int64()))})

    own = asking.join(blocks.filter("part < 2"), F.col("q_home") == F.col("home"))
    reached = in_arrow(own, reach, "home int, part int, least array<long>").groupBy("home", "part").agg(F.collect_list("least").alias("lists"))
    reached = reached.select(F.col("home").alias("q_home"), F.col("part").alias("q_part"), F.aggregate("lists", F.element_at("lists", 1), lambda a, b: F.zip_with(a, b, lambda x, y: F.greatest(x, y))).alias("least"))

    def limits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                distances = np.frombuffer(row["pivots"], np.float32).reshape(-1, width).astype(np.float64)
                yield pa.RecordBatch.from_pydict({"home": pa.array([row["home"]], pa.int32()), "part": pa.array([row["part"]], pa.int32()), "top": [float(np.frombuffer(row["norms"], np.int64).max())], "lo": [distances.min(0).tolist()], "hi": [distances.max(0).tolist()]})

    summary = "home int, part int, top double, lo array<double>, hi array<double>"
    spans = saved(in_arrow(blocks.select("home", "part", "norms", "pivots"), limits, summary))
    q_spans = in_arrow(queries.select("home", "part", "norms", "pivots"), limits, summary).toDF("q_home", "q_part", "q_top", "q_lo", "q_hi")
    q_spans = q_spans.join(reached.select("q_home", "q_part", F.array_min("least").alias("goal")), ["q_home", "q_part"], "left")
    # Blocks meet by the blocks' home, one row of limits each: a stated query set, in blocks.
    pairs = q_spans.withColumn("home", F.explode(F.sequence(F.lit(0), F.lit(width - 1)))).join(spans, "home")
    gap = F.aggregate(F.sequence(F.lit(1), F.lit(width)), F.lit(0.0), lambda m, p: F.greatest(m, F.element_at("q_lo", p) - F.element_at("hi", p), F.element_at("lo", p) - F.element_at("q_hi", p)))
    bound = (F.col("q_top") + F.col("top") - gap * gap) / 2 + _SLACK + _RELATIVE * (F.col("q_top") + F.col("top"))
    pairs = pairs.filter(F.col("goal").isNull() | (bound >= F.col("goal"))).select("q_home", "q_part", "home", "part")

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                query, block = _open(row, "q_", width), _open(row, "", width)
                least = np.array(row["least"] or [np.iinfo(np.int64).min] * len(query[0]), np.int64)
                found = [(np.full(len(at), query[0][q]), np.full(len(at), query[1][q]), block[0][at], block[1][at], scores) for q, at, scores in _best(query, block, least, k)]
                if found:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*found, strict=True)], ["query_row", "query_id", "row", "vec_id", "score"])

    meet = pairs.join(asking, ["q_home", "q_part"]).join(reached, ["q_home", "q_part"], "left").join(blocks, ["home", "part"])
    hits = in_arrow(meet, search, "query_row long, query_id long, row long, vec_id long, score long")
    order = Window.partitionBy("query_row").orderBy(F.desc("score"), "vec_id", "row")
    return hits.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
