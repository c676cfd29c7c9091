"""Helpers that several corpus operators share."""

from __future__ import annotations

import contextlib
import ctypes

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gridweft.functions.rounds import give_back, new_folder, use_checkpoints
from gridweft.ship import ship

#: A word of the corpus contracts: a run of anything but space, tab, LF, VT, FF and CR.
WORD_PATTERN = r"[^\x20\x09-\x0D]+"

#: Stands for a null doc_id inside joins, which would otherwise lose such rows.
NULL_ID = -(2**63)


def read_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def saved(df: DataFrame) -> DataFrame:
    """df with its lineage cut at a copy in the shared checkpoint folder."""
    use_checkpoints(df.sparkSession)
    df = df.checkpoint()
    give_back(df.sparkSession)
    return df


def table_path(spark: SparkSession) -> str:
    """A new folder in the shared checkpoint folder."""
    return new_folder(spark, "table")


def written(df: DataFrame, path: str | None = None) -> DataFrame:
    """df as a compressed table in the shared checkpoint folder, read again."""
    spark = df.sparkSession
    path = path or table_path(spark)
    df.write.option("compression", "zstd").parquet(path)
    give_back(spark)
    return spark.read.schema(df.schema).parquet(path)


def doc_key(column: str = "doc_id") -> Column:
    return F.coalesce(F.col(column).cast("long"), F.lit(NULL_ID))


def row_keyed(docs: DataFrame, name: str = "row_key", ordered: bool = True) -> DataFrame:
    """docs with a long column `name` that is another in each row and, if ordered, rises with doc_id, null first.

    It is doc_key() where no doc_id repeats. Where one does, null among them, it numbers the
    rows of a saved copy, which, if ordered, is dealt to ranges of doc_id, text hash and arrival.
    """
    keys = docs.select(doc_key().alias("k")).groupBy("k").count()
    if keys.filter("count > 1").limit(1).count() == 0:
        return docs.withColumn(name, doc_key())
    if not ordered:
        return written(docs.withColumn(name, F.monotonically_increasing_id()))
    key, h, arrival = spare(docs, "_doc", "_h", "_arrival")
    dealt = docs.withColumn(key, doc_key()).withColumn(h, F.xxhash64("text")).withColumn(arrival, F.monotonically_increasing_id())
    dealt = dealt.repartitionByRange(partitions(docs.sparkSession), key, h, arrival).sortWithinPartitions(key, h, arrival)
    return written(dealt.select(*docs.columns, F.monotonically_increasing_id().alias(name)))


def from_key(column: str = "doc_key") -> Column:
    return F.when(F.col(column) != NULL_ID, F.col(column))


_KEPT: dict = {}


def kept(name, make):
    """An object of a Python worker that its later tasks find again, made on first use.

    Workers outlive the stages of an operator, so only the objects of one name stay.
    """
    if name not in _KEPT:
        _KEPT.clear()
        _KEPT[name] = make()
    return _KEPT[name]


def release() -> None:
    """Gives freed memory back to the system, for workers wait long for their next task."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


def in_arrow(df: DataFrame, function, schema: str) -> DataFrame:
    """mapInArrow of a function that imports this package."""
    ship(df.sparkSession)

    def run(batches):
        yield from function(batches)
        release()

    return df.mapInArrow(run, schema)


def spare(df: DataFrame, *names: str) -> list[str]:
    """The names, with underscores before them until no column of df has them."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name = "_" + name
        out.append(name)
    return out


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def running_before(df: DataFrame, within: list[str], order: list[str], value: str, bucket: Column, name: str) -> DataFrame:
    """Adds the sum of `value` over the rows of the same `within` that sort before each row.

    `bucket` must rise with the order. Sums of buckets are taken first (combined before the
    shuffle) and only they meet in one window, so that no task gets all rows of a hot group.
    """
    df = df.withColumn("_bucket", bucket)
    sums = df.groupBy(*within, "_bucket").agg(F.sum(value).alias("_sum"))
    over = Window.partitionBy(*within).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select(*within, "_bucket", F.coalesce(F.sum("_sum").over(over), F.lit(0)).alias("_offset"))
    inner = Window.partitionBy(*within, "_bucket").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    df = df.withColumn("_inner", F.coalesce(F.sum(value).over(inner), F.lit(0)))
    return df.join(sums, [*within, "_bucket"]).withColumn(name, F.col("_offset") + F.col("_inner")).drop("_bucket", "_offset", "_inner")


def components(edges: DataFrame, max_rounds: int = 200) -> DataFrame:
    """(node, root) for every node of the edges (a, b), root being the smallest node reachable.

    Each round takes the least label among neighbours and then the label of that label
    (pointer jumping), so a path of n nodes needs about log n rounds. Labels only fall and
    minima are combined before the shuffle, so a node with very many edges is no hot task.
    """
    both = saved(edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    labels = saved(both.groupBy(F.col("a").alias("node")).agg(F.least(F.first("a"), F.min("b")).alias("root")))
    for _ in range(max_rounds):
        near = both.join(labels.withColumnRenamed("node", "b"), "b").groupBy("a").agg(F.min("root").alias("near"))
        low = labels.join(near, labels.node == near.a).select("node", "root", F.least("root", "near").alias("low"))
        jump = labels.select(F.col("node").alias("low"), F.col("root").alias("jump"))
        after = saved(low.join(jump, "low", "left").select("node", F.least("low", F.coalesce("jump", "low")).alias("next"), "root"))
        if after.filter("next < root").limit(1).count() == 0:
            return after.select("node", "root")
        labels = after.select("node", F.col("next").alias("root"))
    raise RuntimeError("components did not settle")


def spread_join(rows: DataFrame, facts: DataFrame, on: list[str], how: str = "left", share: int = 1000) -> DataFrame:
    """rows joined to facts by equality, where facts hold each key once and one key may be a large part of all rows.

    Keys of more than a share-th of the rows, fewer than `share` by that, are joined by
    broadcast; the others by a shuffle, in which none of them is a hot task. `rows` is read
    more than once, so it should be saved. Null keys match nothing.
    """
    total = rows.count()
    hot = rows.groupBy(*on).count().filter(F.col("count") > max(10_000, total // share)).select(*on)
    hot_facts = saved(facts.join(F.broadcast(hot), on, "left_semi"))
    flag = spare(rows, "_hot")[0]
    keys = F.broadcast(hot_facts.select(*on, F.lit(True).alias(flag)))
    marked = rows.join(keys, on, "left")
    near = marked.filter(F.col(flag)).drop(flag).join(F.broadcast(hot_facts), on)
    return near.unionByName(marked.filter(F.col(flag).isNull()).drop(flag).join(facts, on, how))
