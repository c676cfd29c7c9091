"""Directed pieces joined into lines: chains within tiles first, then chains across tiles by doubling.

A piece leads from one node to another, and no two pieces of a group leave one node or reach
one node, so they make up paths and rings. Within a tile numpy chains them; what is left to
join are chains that cross tiles, whose number goes with the length of the tiles' borders.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridweft.functions.rounds import cut


def local_chains(start: np.ndarray, end: np.ndarray, key: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(order, heads, closed): the pieces in the order of their chains, where in it each chain begins, and which are rings.

    A ring begins at its piece of least key. Chains come by their last piece.
    """
    n = len(start)
    if not n:
        return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, bool)
    by_start = np.argsort(start, kind="stable")
    at = np.searchsorted(start, end, sorter=by_start)
    after = np.append(np.where((at < n) & (start[by_start[np.minimum(at, n - 1)]] == end), by_start[np.minimum(at, n - 1)], n), n)
    rounds = max(1, n.bit_length())
    ahead, low = after.copy(), np.append(key, np.iinfo(np.int64).max)
    for _ in range(rounds):
        low, ahead = np.minimum(low, low[ahead]), ahead[ahead]
    ring = ahead < n
    ring[n] = False
    first = ring[:n] & (key == low[:n])
    after[:n][(after[:n] < n) & np.append(first, False)[after[:n]]] = n
    last, left, ahead = np.arange(n + 1), (after < n).astype(np.int64), after.copy()
    for _ in range(rounds):
        going = ahead < n
        last[going] = last[ahead[going]]
        left, ahead = left + np.where(going, left[ahead], 0), ahead[ahead]
    order = np.lexsort((-left[:n], last[:n]))
    heads = np.flatnonzero(np.append(True, np.diff(last[order]) != 0))
    return order, heads, ring[order[heads]]


def ranked(chains: DataFrame, within: list[str]) -> DataFrame:
    """(*within, key, line, seq, n, ring): of each chain its line, its place in it from 0, how many the line has, and whether it is a ring.

    `chains` has (*within, start, end, key, closed), key being another for each chain of a
    group; line is the least key of a line's chains, and a ring of several chains begins with
    that one. Pointers double, so a line of m chains takes about log m rounds; chains that are
    lines by themselves take no part.
    """
    key = [*within, "key"]
    open_ = cut(chains.where("not closed").select(*within, "start", "end", "key"))
    follow = cut(open_.select(*key, F.col("end").alias("node")).join(open_.select(*within, F.col("start").alias("node"), F.col("key").alias("next")), [*within, "node"]).select(*key, "next"))
    linked = follow.select(*key).union(follow.select(*within, F.col("next").alias("key"))).distinct()
    state = cut(linked.join(follow, key, "left").select(*key, F.col("next").alias("to"), F.col("key").alias("low"), F.when(F.col("next").isNotNull(), 1).otherwise(0).cast("long").alias("left"), F.col("key").alias("last")))

    def doubled(state: DataFrame) -> tuple[DataFrame, bool]:
        ahead = state.select(*within, F.col("key").alias("to"), F.col("to").alias("to2"), F.col("low").alias("low2"), F.col("left").alias("left2"), F.col("last").alias("last2"))
        both = state.join(ahead, [*within, "to"], "left")
        moved = F.col("to").isNotNull()
        after = cut(both.select(*key, F.col("to2").alias("to"), F.least("low", "low2").alias("low"), (F.col("left") + F.coalesce("left2", F.lit(0))).alias("left"), F.when(moved, F.col("last2")).otherwise(F.col("last")).alias("last"), (moved & (F.col("to2").isNull() | (F.col("low2") < F.col("low")))).alias("news")))
        return after.drop("news"), after.where("news").limit(1).count() > 0

    def settled(state: DataFrame) -> DataFrame:
        state, news = doubled(state)
        while news:
            state, news = doubled(state)
        return state

    # once nothing ends and no least key falls, pointers are left in rings alone
    state = settled(state)
    rings = cut(state.where("to is not null").select(*key, "low"))
    paths = state.where("to is null").select(*key, "left", "last", F.lit(False).alias("ring"))
    if rings.limit(1).count():
        opened = rings.join(follow, key).withColumn("to", F.when(F.col("next") != F.col("low"), F.col("next")))
        opened = cut(opened.select(*key, "to", F.col("key").alias("low"), F.when(F.col("to").isNotNull(), 1).otherwise(0).cast("long").alias("left"), F.col("key").alias("last")))
        paths = paths.union(settled(opened).select(*key, "left", "last", F.lit(True)))
    paths = cut(paths)
    lines = paths.groupBy(*within, "last").agg(F.min("key").alias("line"), (F.max("left") + 1).alias("n"))
    found = paths.join(lines, [*within, "last"]).select(*key, "line", (F.col("n") - 1 - F.col("left")).alias("seq"), "n", "ring")
    alone = chains.select(*key, "closed").join(found.select(*key), key, "left_anti")
    return found.union(alone.select(*key, F.col("key"), F.lit(0).cast("long"), F.lit(1).cast("long"), F.col("closed")))
