"""Mixing sources to target weights: a low-discrepancy schedule over shuffled equal-token blocks.

DataFrame and SQL functions only.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridweft.llm.common import WORD_PATTERN, row_keyed, running_before, saved, spare, spread_join

GOLDEN = 0.6180339887498949
SOURCE_WEIGHTS = (5, 2, 1)
REPEAT_CAP = 3
#: A block holds 1/SLOTS of all words, MOST_WORDS at most, so that slots grow with the input, and
#: no more than gives each source LEAST_SLOTS of its own, or as many as its target has words.
SLOTS, MOST_WORDS, LEAST_SLOTS = 1 << 20, 256, 128
_ROWS_A_BUCKET, _PART = 20_000, 4096


def word_count(column: str) -> Column:
    return F.coalesce(F.regexp_count(F.col(column), F.lit(WORD_PATTERN)), F.lit(0)).cast("long")


def source_targets(sized: DataFrame, weights=SOURCE_WEIGHTS, repeat_cap: int = REPEAT_CAP) -> DataFrame:
    """(source, s, source_size, target) with s = rank by code point, null last.

    Sources weigh weights[s mod len] and share all words; no target passes repeat_cap times
    its source's size, and what that leaves over is shared again by weight. At the fixed
    point the capped sources are those of least cap/weight, so one running sum over the
    sources in that order gives it.
    """
    sums = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    ranked = sums.withColumn("s", F.row_number().over(Window.orderBy(F.asc_nulls_last("source"))) - 1)
    ranked = ranked.withColumn("w", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("s") % len(weights) + 1).cast("int")))
    ranked = ranked.withColumn("cap", F.col("source_size") * float(repeat_cap)).withColumn("ratio", F.col("cap") / F.col("w"))
    order = Window.orderBy("ratio", "s")
    before, rest, every = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(0, Window.unboundedFollowing), Window.partitionBy()
    level = (F.sum("source_size").over(every) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("w").over(rest)
    open_level = F.min(F.when(F.col("level") <= F.col("ratio"), F.struct("ratio", "s", "level"))).over(every)
    return (
        ranked.withColumn("level", level)
        .withColumn("open", open_level)
        .select("source", "s", "source_size", F.when(F.struct("ratio", "s") < F.struct(F.col("open.ratio"), F.col("open.s")), F.col("cap")).otherwise(F.col("w") * F.coalesce("open.level", F.lit(0.0))).alias("target"))
    )


def golden_step(n: int) -> int:
    """The number without common factor with n that is nearest to n times the golden ratio, the smaller of two."""
    near = round(n * GOLDEN)
    return next(g for d in range(n + 1) for g in (near - d, near + d) if 0 < g <= max(1, n) and math.gcd(g, n) == 1)


def schedule(targets: DataFrame, slots: int) -> DataFrame:
    """(slot, s, rank) of so many slots; `targets` has (s, target), and a source s is due its share of the slots by target.

    Slot i of n lies at the golden-ratio point (i * g mod n) / n, g being golden_step(n), and
    belongs to the source whose span of the cumulative shares holds that point; rank numbers a
    source's slots from 0. The n points are all the multiples of 1/n, so a source has its due
    to within one slot, and any stretch of slots has its share to within a few.
    """
    due, n = targets.filter("target > 0").select("s", "target"), max(1, slots)
    total = due.agg(F.sum("target")).first()[0] or 0.0
    back = pow(golden_step(n), -1, n) if n > 1 else 0
    upto = F.sum("target").over(Window.orderBy("s").rowsBetween(Window.unboundedPreceding, 0))  # a row for each source
    place = lambda c: F.ceil(c * (n / max(total, 1e-300)) - 1e-6)
    spans = due.withColumn("upto", upto).select("s", place(F.col("upto") - F.col("target")).alias("lo"), place(F.col("upto")).alias("hi")).filter("lo < hi")
    parts = spans.withColumn("part", F.explode(F.sequence(F.floor(F.col("lo") / _PART), F.floor((F.col("hi") - 1) / _PART)))).repartition("s", "part")
    base = F.col("part").cast("decimal(38,0)") * F.lit(_PART * back).cast("decimal(38,0)") % F.lit(n).cast("decimal(38,0)")
    low, high = F.greatest(F.col("lo") - F.col("part") * _PART, F.lit(0)), F.least(F.col("hi") - F.col("part") * _PART, F.lit(_PART)) - 1
    points = parts.select("s", base.cast("long").alias("base"), F.explode(F.sequence(low, high)).alias("k"))
    slots = points.select("s", F.pmod(F.col("base") + F.col("k") * F.lit(back).cast("long"), F.lit(n).cast("long")).alias("slot"), F.lit(1).alias("one")).hint("merge")  # rows made by explode look few, and must not be broadcast
    return running_before(slots, ["s"], ["slot"], "one", F.floor(F.col("slot") / _ROWS_A_BUCKET), "rank").select("slot", "s", "rank")


def _passages(sized: DataFrame, weights, repeat_cap: int, slots: int, seed: int) -> tuple[DataFrame, DataFrame]:
    """(targets, passages) of rows (uid, doc_id, source, h, size).

    targets: (source, s, source_size, target). passages: (slot, s, uid, pass, first, words),
    what each slot takes of which row.
    """
    total, rows = sized.agg(F.coalesce(F.sum("size"), F.lit(0)), F.count(F.lit(1))).first()
    most = max(1, min(math.ceil(total / slots), MOST_WORDS))
    bits = max(6, min(30, math.ceil(math.log2(max(1, rows / _ROWS_A_BUCKET)))))
    block = F.greatest(F.lit(1), F.least(F.lit(most), F.floor(F.floor("target") / LEAST_SLOTS)))
    targets = saved(source_targets(sized, weights, repeat_cap).withColumn("block", block))
    due = targets.select("s", (F.floor("target") / F.col("block")).alias("target"))
    plan = saved(schedule(due, math.ceil((due.agg(F.sum("target")).first()[0] or 0.0) - 1e-6)))
    dealt = targets.join(plan.groupBy("s").agg(F.count(F.lit(1)).alias("n")), "s")
    # the last slot also takes what is left of the target, a block at most
    dealt = saved(dealt.withColumn("limit", F.least(F.floor("target"), (F.col("n") + 1) * F.col("block"))).select("source", "s", "source_size", "block", "n", "limit"))

    placed = sized.join(dealt, sized.source.eqNullSafe(dealt.source)).select("uid", "doc_id", "h", "s", "size", "source_size", "block", "n", "limit").filter("size > 0")
    placed = running_before(placed, ["s"], ["h", "doc_id", "size", "uid"], "size", F.shiftright("h", 64 - bits), "before")
    passes = placed.withColumn("pass", F.explode(F.sequence(F.lit(0), F.lit(repeat_cap - 1)))).withColumn("start", F.col("before") + F.col("pass") * F.col("source_size"))
    passes = passes.withColumn("end", F.least(F.col("start") + F.col("size"), F.col("limit"))).filter("start < end")
    last = F.col("n") - 1
    pieces = passes.withColumn("rank", F.explode(F.sequence(F.least(F.floor(F.col("start") / F.col("block")), last), F.least(F.floor((F.col("end") - 1) / F.col("block")), last))))
    low = F.greatest("start", F.col("rank") * F.col("block"))
    high = F.when(F.col("rank") < last, F.least("end", (F.col("rank") + 1) * F.col("block"))).otherwise(F.col("end"))
    pieces = pieces.select("uid", "s", "rank", "pass", (low - F.col("start")).alias("first"), (high - low).alias("words"))
    return targets, pieces.join(plan.hint("merge"), ["s", "rank"]).select("slot", "s", "uid", "pass", "first", "words")


def _sized(docs: DataFrame, seed: int, key: str | None) -> DataFrame:
    """(uid, doc_id, source, size, h), saved; h is the place of a row in its source's stream.

    h hashes doc_id and text, so that it does not depend on partitioning. Over _ROWS_A_BUCKET
    rows that agree in both would share one place; those, and only those, are hashed with
    their uid, so that they are no hot task.
    """
    uid = F.monotonically_increasing_id() if key is None else F.col(key)
    sized = saved(docs.select(uid.alias("uid"), "doc_id", "source", word_count("text").alias("size"), F.xxhash64("doc_id", "text", F.lit(seed)).alias("h")))
    alike = saved(sized.groupBy("h").count().filter(F.col("count") > _ROWS_A_BUCKET).select("h", F.lit(True).alias("alike")))  # rows / _ROWS_A_BUCKET at most
    if alike.limit(1).count() == 0:
        return sized
    own = F.when(F.col("alike"), F.xxhash64("h", "uid")).otherwise(F.col("h"))
    return saved(spread_join(sized, alike, ["h"]).select("uid", "doc_id", "source", "size", own.alias("h")))


def mix(docs: DataFrame, weights=SOURCE_WEIGHTS, repeat_cap: int = REPEAT_CAP, slots: int = SLOTS, seed: int = 42, key: str | None = None) -> DataFrame:
    """(doc_id, source, size, source_size, target, taken), one row per input row, and with it the column `key`, if named, of unique numbers.

    A source's documents, in an order shuffled by a seeded hash, form a stream of words that
    runs repeat_cap times and is cut into blocks of equal words, smaller ones for a source
    that would have under LEAST_SLOTS of them. Sources are due target / block slots each;
    schedule() deals them, and the k-th slot of a source takes the k-th block of its stream,
    the last slot with it what is left of the target, under a block. `taken` is the number of
    words of the row's passages that lie in taken blocks. Reruns agree, and so do other
    partitionings but for which of more than _ROWS_A_BUCKET rows equal in id and text is taken.

    Null texts, empty texts and texts of white space have size 0 and take 0; a null source is
    a source of its own and sorts last; rows that repeat are documents of their own. An empty
    table gives no rows.
    """
    sized = _sized(docs, seed, key)
    targets, passages = _passages(sized, weights, repeat_cap, slots, seed)
    taken = passages.groupBy("uid").agg(F.sum("words").alias("taken"))
    out = sized.join(taken, "uid", "left").join(targets.withColumnRenamed("source", "of"), F.col("source").eqNullSafe(F.col("of")))
    named = [] if key is None else [F.col("uid").alias(key)]
    return out.select("doc_id", "source", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"), *named)


def reading_order(docs: DataFrame, weights=SOURCE_WEIGHTS, repeat_cap: int = REPEAT_CAP, slots: int = SLOTS, seed: int = 42) -> DataFrame:
    """(slot, part, doc_id, source, pass, first_word, words): the passages of the mix in the order in which to read them.

    Slots are read from 0 on, and the passages of a slot by `part`. first_word counts a row's
    words from 0, pass how often its source has run before. What mix() says of odd rows holds;
    rows without words have no passage.
    """
    sized = _sized(docs, seed, None)
    _, passages = _passages(sized, weights, repeat_cap, slots, seed)
    named = passages.join(sized.select("uid", "doc_id", "source", "h"), "uid")
    part = F.row_number().over(Window.partitionBy("slot").orderBy("pass", "h", "doc_id", "uid")) - 1  # a block's passages, no more than it has words
    return named.withColumn("part", part).select("slot", "part", "doc_id", "source", "pass", F.col("first").alias("first_word"), "words")


def mixed_documents(docs: DataFrame, **options) -> DataFrame:
    """The rows as the mix takes them, all columns as they were: each as many times as the words
    taken make its passages, a rest of half a passage or more counting as one. A source's
    stream is cut in one row at most, so its words come within half of that row's of its target.

    Rows without words, which no slot can take, stay once. Rows that repeat a doc_id or have
    none are taken each by itself. An empty table gives no rows.
    """
    key, copies, copy = spare(docs, "_key", "_copies", "_copy")
    keyed = row_keyed(docs, key, ordered=False)
    times = F.when(F.col("size") == 0, 1).otherwise(F.floor(F.col("taken") / F.col("size") + 0.5)).cast("int")
    share = mix(keyed, key=key, **options).select(key, times.alias(copies)).filter(F.col(copies) > 0)
    return keyed.join(share, key).withColumn(copy, F.explode(F.sequence(F.lit(1), F.col(copies)))).select(*docs.columns)
