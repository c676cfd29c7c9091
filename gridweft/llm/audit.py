"""Filter interaction audit: every order of a few filters, by edges of the lattice of their subsets.

A document that is held against subset S and next filter f is one of n * 2^(n-1) edges (S, f);
an order of the filters is a path of n edges from the empty set, so the counts of all n! orders
are joins of the edges' sums and no order is ever run. DataFrame functions only.
"""

from __future__ import annotations

from collections.abc import Mapping
from itertools import permutations
from math import factorial

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridweft.llm.common import spare

_COUNTS = ("docs", "good", "toxic")
_BLANKS = " \t\n\x0b\f\r"
#: Rows without doc_id meet no label; they are dealt to so many tasks.
_NO_ID_PARTS = 1024


def words(text: Column) -> Column:
    """The words `[^\\x20\\x09-\\x0D]+` of a text as an array."""
    trimmed = F.btrim(text, F.lit(_BLANKS))
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, "[\\x20\\x09-\\x0D]+"))


def text_filters(text: Column, found: Column) -> dict[str, Column]:
    """Failure conditions A to D of a text that is not null and the array of its words; E is repeats()."""
    return {
        "A": F.size(found) < 200,
        "B": 100 * F.size(F.array_distinct(found)).cast("long") < 50 * F.size(found).cast("long"),
        "C": 100 * F.regexp_count(text, F.lit("[A-Z]")).cast("long") > 3 * F.length(text).cast("long"),
        "D": text.rlike("[#$%&*|]"),
    }


def failures(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(part, mask, docs, good, toxic): how many documents of a part fail which of A to E, bit k of mask being letter k.

    part is lang, null as the empty string. A null text is empty. E fails if a smaller doc_id
    has the same text; a null doc_id has no smaller one and is none. good and toxic count
    documents with a label of quality 1, and of toxic 1, be it in one of several rows of their
    doc_id; null ids have none. Rows that repeat count each. An empty table gives no rows.

    A scan makes one short row of each document. Rows of one text are added up by part and
    label, with the number of those of the least doc_id, before they meet, so copies of a text
    that are a large part of all rows are no hot task.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    read = docs.select(F.col("doc_id").cast("long").alias("id"), F.coalesce("lang", F.lit("")).alias("part"), text.alias("body"))
    read = read.select("id", "part", "body", words(F.col("body")).alias("found"))
    mask = sum((F.when(fails, 1 << k).otherwise(0) for k, fails in enumerate(text_filters(F.col("body"), F.col("found")).values())), F.lit(0))
    short = read.select("id", "part", F.unhex(F.sha2("body", 256)).alias("digest"), mask.alias("mask"))
    short = short.withColumn("salt", F.when(F.col("id").isNull(), F.pmod(F.xxhash64("digest", "part"), F.lit(_NO_ID_PARTS))).otherwise(0).cast("int"))

    marks = labels.filter("doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("id"))
    marks = marks.agg(F.max((F.col("quality") == 1).cast("int")).alias("good"), F.max((F.col("toxic") == 1).cast("int")).alias("toxic")).withColumn("salt", F.lit(0))
    marked = short.join(marks, ["id", "salt"], "left").select("id", "salt", "part", "digest", "mask", F.coalesce("good", F.lit(0)).alias("good"), F.coalesce("toxic", F.lit(0)).alias("toxic"))

    of_text = ["digest", "part", "mask", "good", "toxic"]
    by_id = marked.groupBy("id", "salt", *of_text).agg(F.count(F.lit(1)).alias("n"))
    least = F.min(F.when(F.col("id").isNotNull(), F.struct("id", "n")))
    by_text = by_id.groupBy(*of_text).agg(F.sum("n").alias("n"), F.coalesce(F.sum(F.when(F.col("id").isNull(), F.col("n"))), F.lit(0)).alias("unnamed"), least.alias("least"))
    firsts = by_text.groupBy("digest").agg(F.min("least.id").alias("first"))
    # joined by text: a row for each part and label that has it
    first_here = by_text.join(firsts, "digest").withColumn("firsts", F.col("unnamed") + F.when(F.col("least.id") == F.col("first"), F.col("least.n")).otherwise(0))
    copies = F.array(F.struct(F.col("firsts").alias("docs"), F.col("mask").alias("mask")), F.struct((F.col("n") - F.col("firsts")).alias("docs"), (F.col("mask") + 16).alias("mask")))
    counted = first_here.select("part", "good", "toxic", F.explode(copies).alias("c")).filter("c.docs > 0")
    return counted.groupBy("part", F.col("c.mask").alias("mask")).agg(*[F.sum(F.col("c.docs") * one).alias(name) for name, one in zip(_COUNTS, (F.lit(1), F.col("good"), F.col("toxic")), strict=True)])


def edges(failed: DataFrame, n: int) -> DataFrame:
    """(part, before, next, ...): of n filters, the sums over each part's documents for every subset `before` and filter `next` not in it.

    kept: pass all of both; removed: pass before, fail next; redundant: fail next and something
    before; unique_fails: fail next alone; good_lost, toxic_lost: removed ones that are labelled.
    `failed` has (part, mask, docs, good, toxic), as failures() makes it: at most 2^n rows a part.
    """
    every = [(s, k) for s in range(1 << n) for k in range(n) if not s >> k & 1]
    each = failed.withColumn("edge", F.explode(F.array(*[F.struct(F.lit(s).alias("before"), F.lit(k).alias("next")) for s, k in every])))
    bit = F.expr("shiftleft(1, edge.next)")
    passes, fails = F.col("mask").bitwiseAND(F.col("edge.before")) == 0, F.col("mask").bitwiseAND(bit) != 0

    def total(column: str, where: Column, name: str) -> Column:
        return F.sum(F.when(where, F.col(column)).otherwise(0)).alias(name)

    return each.groupBy("part", "edge.before", "edge.next").agg(
        total("docs", passes & ~fails, "kept"),
        total("docs", passes & fails, "removed"),
        total("docs", ~passes & fails, "redundant"),
        total("docs", F.col("mask") == bit, "unique_fails"),
        total("good", passes & fails, "good_lost"),
        total("toxic", passes & fails, "toxic_lost"),
    )


def orders(failed: DataFrame, letters: str) -> DataFrame:
    """(part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley) of every order of the letters.

    One row for each part, order and step, zeros included; a part without documents has none.
    shapley is what the step's filter removes, summed over all orders: an edge whose subset has
    s of n filters lies on s! (n - 1 - s)! paths.
    """
    n = len(letters)
    found = edges(failed, n)
    sizes = F.bit_count("before")
    paths = F.element_at(F.array(*[F.lit(factorial(s) * factorial(n - 1 - s)).cast("long") for s in range(n)]), sizes + 1)
    shapley = found.groupBy("part", "next").agg(F.sum(F.col("removed") * paths).alias("shapley"))
    steps = [("".join(order), k + 1, sum(1 << letters.index(c) for c in order[:k]), letters.index(order[k])) for order in permutations(letters) for k in range(n)]
    lattice = failed.sparkSession.createDataFrame(steps, "filter_order string, step int, before int, next int")  # n * n! rows
    counts = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost")
    return found.join(shapley, ["part", "next"]).join(F.broadcast(lattice), ["before", "next"]).select("part", "filter_order", "step", *[F.col(c).cast("long").alias(c) for c in (*counts, "shapley")])


def interactions(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """orders() of the five filters A to E over whole documents; failures() says what odd rows do."""
    return orders(failures(docs, labels), "ABCDE")


def first_failures(docs: DataFrame, filters: Mapping[str, Column], part: Column) -> DataFrame:
    """(part, mask, docs, good, toxic) for orders() of filters of one's own, conditions over docs' columns; no labels.

    A condition that is null does not fail. Letters are in the mapping's order.
    """
    name, bits = spare(docs, "part", "mask")
    mask = sum((F.when(fails, 1 << k).otherwise(0) for k, fails in enumerate(filters.values())), F.lit(0))
    found = docs.select(part.alias(name), mask.alias(bits)).groupBy(name, bits).agg(F.count(F.lit(1)).alias("docs"))
    return found.select(F.col(name).alias("part"), F.col(bits).alias("mask"), "docs", F.lit(0).alias("good"), F.lit(0).alias("toxic"))
