"""Line dedup: a suffix array over line ids by distributed prefix doubling."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from gridweft.llm.common import doc_key, from_key, in_arrow, row_keyed, running_before, spare, table_path, written

#: A repeated run is deleted from so many lines on, or if its first line alone is so long.
MIN_LINES, LONG_LINE = 2, 100
_BLANK = " \t\r\v\f"
#: Rows of a bucket of the suffix array, and the least bits of its buckets.
_ROWS_A_BUCKET, _LEAST_BITS = 20_000, 8


def _lines(text: str) -> list[str]:
    return text.split("\n")


def _find_lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The lines of each text that aren't blank, numbered, by 128-bit hashes; n is how many the text has."""
    for batch in batches:
        docs, places, hashes, long, many = [], [], [], [], []
        for key, text in zip(batch["doc_key"].to_pylist(), batch["text"], strict=True):
            found = [x for x in _lines(text.as_py() or "") if x.strip(_BLANK)]
            docs += [key] * len(found)
            places += range(len(found))
            hashes += [xxhash.xxh3_128_digest(x.encode("utf-8", "surrogatepass")) for x in found]
            long += [len(x) >= LONG_LINE for x in found]
            many += [len(found)] * len(found)
        pair = np.frombuffer(b"".join(hashes), ">i8").astype(np.int64).reshape(-1, 2)
        yield pa.RecordBatch.from_pydict({"doc_key": pa.array(docs, pa.int64()), "line": pa.array(places, pa.int32()), "h1": pair[:, 0].copy(), "h2": pair[:, 1].copy(), "long": pa.array(long, pa.bool_()), "n": pa.array(many, pa.int32())})


def _level(a: Column, b: Column) -> Column:
    """The last level at which two suffixes have one rank, -1 if they have none; a and b hold the ranks of each level."""
    equal = F.size(F.filter(F.zip_with(a, b, lambda x, y: x == y), lambda x: x)) - 1
    return F.when(a[0] == b[0], equal).otherwise(-1)


def _prefix(level: Column) -> Column:
    return F.when(level >= 0, F.pow(F.lit(2.0), level)).otherwise(0).cast("long")


class SuffixArray:
    """Suffixes of line-id sequences in order, and the lengths of their common prefixes, by prefix doubling.

    Lines that repeat are smaller than lines that don't, the former in the order of their
    hashes, the latter in that of a hash of the document, then document and place; a suffix
    that ends sooner is smaller. Round k ranks each suffix whose first line repeats among all
    such by its first 2^k lines, from its rank so far and that of the suffix 2^(k-1) lines on,
    which a frame over its document gives without a join. Suffixes that a unique line tells
    apart keep one rank together, as (hash, document, place) orders them; so do those that are
    equal to their ends. Documents all of whose suffixes are told apart leave the rounds. `hist`
    holds a suffix's ranks of the rounds after which others had the same one.
    doc_key is that of row_keyed(), or a column of such keys that docs has.
    """

    def __init__(self, docs: DataFrame, key: str | None = None):
        if key is None:
            (key,) = spare(docs, "_key")
            docs = row_keyed(docs, key)
        texts = docs.select(F.col(key).alias("doc_key"), "text")
        rows = written(in_arrow(texts, _find_lines, "doc_key long, line int, h1 long, h2 long, long boolean, n int"))
        ids = written(rows.groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("size")).filter("size > 1"))
        total, kinds = ids.agg(F.coalesce(F.sum("size"), F.lit(0)), F.count(F.lit(1))).first()
        self.total, self.bits = total, max(_LEAST_BITS, min(30, math.ceil(math.log2(max(1, total / _ROWS_A_BUCKET)))))
        self.width = max(1, total >> self.bits)
        bits = max(1, min(30, math.ceil(math.log2(max(1, kinds / _ROWS_A_BUCKET)))))
        ids = running_before(ids, [], ["h1", "h2"], "size", F.shiftright("h1", 64 - bits), "rank")
        # code is twice the rank, plus one where no other suffix starts with these lines
        now = rows.join(ids, ["h1", "h2"]).select("doc_key", "line", "n", "long", (2 * F.col("rank")).alias("code"), F.col("size").alias("tie"), F.lit(True).alias("open"), F.array("rank").alias("hist"))
        root, level = table_path(docs.sparkSession), 0
        while True:
            step = written(self._ahead(now, 1 << level), f"{root}/level={level}")
            if step.filter("alive").limit(1).count() == 0:
                break
            now, level = self._ranked(step.filter("alive"), 1 << level), level + 1
        every = docs.sparkSession.read.schema(StructType([*step.schema.fields, StructField("level", IntegerType())]))
        self.suffixes = every.parquet(root).filter("not alive").select("doc_key", "line", "n", "long", F.shiftright("code", 1).alias("rank"), "tie", "hist")

    @staticmethod
    def _ahead(rows: DataFrame, h: int) -> DataFrame:
        """Adds next, the code of the suffix h lines on, and whether the document has suffixes that aren't told apart."""
        document = Window.partitionBy("doc_key")
        return rows.withColumn("next", F.max("code").over(document.orderBy("line").rangeBetween(h, h))).withColumn("alive", F.max("open").over(document))

    def _ranked(self, step: DataFrame, h: int) -> DataFrame:
        ends = F.col("line") + h >= F.col("n")
        rest = step.filter("not open").select("doc_key", "line", "n", "long", "code", "tie", "open", "hist")
        ahead = step.filter("open").withColumn("next", F.when(ends, -1).otherwise(F.coalesce("next", F.lit(2 * self.total + 1))))
        counts = ahead.groupBy("code", "next").agg(F.count(F.lit(1)).alias("size"))
        counts = running_before(counts, ["code"], ["next"], "size", F.floor(F.col("next") / (2 * self.width)), "before")
        alone = (F.col("size") == 1) | (F.col("next") >= 0) & (F.col("next") % 2 == 1)
        moved = ahead.join(counts, ["code", "next"]).withColumn("rank", F.shiftright("code", 1) + F.col("before")).withColumn("alone", alone)
        code, open_ = 2 * F.col("rank") + F.col("alone").cast("long"), ~F.col("alone") & (F.col("next") >= 0)
        hist = F.when(F.col("alone"), F.col("hist")).otherwise(F.array_append("hist", F.col("rank")))
        return moved.select("doc_key", "line", "n", "long", code.alias("code"), F.col("size").alias("tie"), open_.alias("open"), hist.alias("hist")).union(rest)

    def neighbours(self) -> DataFrame:
        """(index, doc_key, line, n, long, doc_b, line_b, level): each suffix in its place in order,
        the one before it and the last level at which both have one rank.

        Buckets hold ranges of the order: a range of ranks each, or a part of one rank that is wider.
        The last suffix of a bucket is handed to the next bucket.
        """
        hash_, hot = F.xxhash64("doc_key"), F.col("tie") > self.width
        rows = self.suffixes.select(F.floor(F.col("rank") / self.width).alias("range"), hot.alias("hot"), F.when(hot, F.shiftrightunsigned(hash_, 64 - self.bits)).otherwise(0).alias("part"), "rank", hash_.alias("hash"), "doc_key", "line", "n", "long", "hist")
        bucket, own = ["range", "hot", "part"], F.struct("doc_key", "line", "hist")
        order = Window.partitionBy(*bucket).orderBy("rank", "hash", "doc_key", "line")
        rows = rows.withColumn("at", F.row_number().over(order)).withColumn("prev", F.lag(own).over(order)).withColumn("last", F.lead("line").over(order).isNull())
        edge = F.col("last") | F.col("prev").isNull()
        rows = written(rows.select(*bucket, "at", "last", "doc_key", "line", "n", "long", F.when(edge, F.col("hist")).alias("hist"), F.col("prev.doc_key").alias("doc_b"), F.col("prev.line").alias("line_b"), F.when(F.col("prev").isNotNull(), _level(F.col("hist"), F.col("prev.hist"))).alias("level")))
        over = Window.orderBy(*bucket)  # a row for each bucket
        heads = rows.filter("last").select(*bucket, F.coalesce(F.sum("at").over(over.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("base"), F.lag(own).over(over).alias("prev"))
        first = F.col("at") == 1
        level = F.when(first, F.coalesce(_level(F.col("hist"), F.col("prev.hist")), F.lit(-1))).otherwise(F.col("level"))
        return rows.join(heads, bucket).select(
            (F.col("base") + F.col("at") - 1).alias("index"), "doc_key", "line", "n", "long",
            F.when(first, F.col("prev.doc_key")).otherwise(F.col("doc_b")).alias("doc_b"), F.when(first, F.col("prev.line")).otherwise(F.col("line_b")).alias("line_b"), level.alias("level"),
        )

    def common(self) -> DataFrame:
        """(index, doc_key, line, n, long, doc_b, line_b, lcp): lines that each suffix shares with the one before it in order.

        Suffixes of one rank by 2^k lines but none by 2^(k+1) share 2^k lines and what the
        suffixes 2^k lines on share, whose ranks tell the next and smaller step. Pairs that
        share one line, or all lines to their ends, need no such step.
        """
        size, left = _prefix(F.col("level")), F.col("n") - F.col("line")
        pairs = self.neighbours().withColumn("lcp", F.least(size, left.cast("long"))).withColumn("open", (F.col("level") >= 1) & (size < left)).drop("level")
        pairs = written(pairs)
        columns, root, steps = [c for c in pairs.columns if c not in ("lcp", "open")], table_path(pairs.sparkSession), 0
        open_, hists = pairs.filter("open").drop("open"), self.suffixes.select("doc_key", "line", "hist")
        while open_.limit(1).count():
            wanted = open_.select("doc_key").union(open_.select("doc_b")).distinct()
            hists = written(hists.join(wanted, "doc_key", "left_semi"))
            here = F.struct(F.lit(0).alias("side"), F.col("doc_key").alias("doc"), (F.col("line") + F.col("lcp")).alias("place"))
            there = F.struct(F.lit(1).alias("side"), F.col("doc_b").alias("doc"), (F.col("line_b") + F.col("lcp")).alias("place"))
            asked = open_.withColumn("ask", F.explode(F.array(here, there))).select(*columns, "lcp", "ask.*")
            found = asked.join(hists.select(F.col("doc_key").alias("doc"), F.col("line").cast("long").alias("place"), "hist"), ["doc", "place"], "left")
            found = found.groupBy(*columns, "lcp").agg(F.max(F.when(F.col("side") == 0, F.col("hist"))).alias("a"), F.max(F.when(F.col("side") == 1, F.col("hist"))).alias("b"))
            level = F.coalesce(_level(F.col("a"), F.col("b")), F.lit(-1))
            lcp = F.least(F.col("lcp") + _prefix(level), left.cast("long"))
            found = found.select(*columns, lcp.alias("lcp"), ((level >= 1) & (lcp < left)).alias("open"))
            open_, steps = written(found, f"{root}/step={steps}").filter("open").drop("open"), steps + 1
        done = pairs.filter("not open").drop("open")
        if steps:
            settled = pairs.sparkSession.read.schema(StructType([*pairs.schema.fields, StructField("step", IntegerType())])).parquet(root)
            done = done.unionByName(settled.filter("not open").drop("open", "step"))
        return done


def repeats(runs: DataFrame, width: int, min_lines: int) -> DataFrame:
    """(doc_key, longest, gone array): of each document with repeated lines, the longest of its
    runs that stands elsewhere too, and the places of the lines that later copies cover.

    An interval of the suffix array in which neighbours share d lines or more holds all
    copies of a run of d lines; all but the first of them in document order go, and with
    them every line of longer runs, whose suffixes lie in such intervals too. Heads of
    intervals are found within ranges of the order and then for those that reach over an edge.
    """
    order, depths = Window.partitionBy("range").orderBy("index"), (1, min_lines)
    rows = runs.withColumn("range", F.floor(F.col("index") / width))
    for k, depth in enumerate(depths):
        rows = rows.withColumn(f"in{k}", F.sum((F.col("lcp") < depth).cast("long")).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    rows = rows.withColumn("after", F.lead("lcp").over(order)).withColumn("at", F.row_number().over(order))
    for k in range(2):
        rows = rows.withColumn(f"head{k}", F.min(F.struct("doc_key", "line")).over(Window.partitionBy("range", f"in{k}")))
    rows = written(rows.drop("n", "line_b"))
    ends = [f"{c}{k}" for k in range(2) for c in ("in", "head")]
    first = rows.filter("at = 1").select("range", *[F.col(c).alias("first_" + c) for c in ends])
    edges = rows.filter("after is null").select("range", *[F.col(c).alias("last_" + c) for c in ends]).join(first, "range")
    over = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)  # a row for each range
    edges = written(edges.select("*", *[F.coalesce(F.sum(f"last_in{k}").over(over), F.lit(0)).alias(f"base{k}") for k in range(2)]))
    for k in range(2):
        parts = None
        for side in ("first", "last"):
            part = edges.select((F.col(f"base{k}") + F.col(f"{side}_in{k}")).alias("interval"), F.col(f"{side}_head{k}").alias("head"))
            parts = part if parts is None else parts.union(part)
        heads = parts.groupBy("interval").agg(F.min("head").alias("head"))
        for side in ("first", "last"):
            named = heads.select(F.col("interval").alias("_i"), F.col("head").alias(f"{side}{k}"))
            edges = edges.join(named, F.col(f"base{k}") + F.col(f"{side}_in{k}") == F.col("_i")).drop("_i")
    rows = rows.join(edges.select("range", *[f"{side}_in{k}" for side in ("first", "last") for k in range(2)], "first0", "last0", "first1", "last1"), "range")
    later = []
    for k in range(2):
        head = F.when(F.col(f"in{k}") == F.col(f"first_in{k}"), F.col(f"first{k}")).when(F.col(f"in{k}") == F.col(f"last_in{k}"), F.col(f"last{k}")).otherwise(F.col(f"head{k}"))
        later.append(F.struct("doc_key", "line") > head)
    gone = F.when(later[1], F.sequence(F.col("line"), F.col("line") + min_lines - 1)).when(later[0] & F.col("long"), F.array("line"))
    rows = rows.select("doc_key", "doc_b", "at", "lcp", F.greatest("lcp", F.coalesce("after", F.lit(0))).alias("longest"), gone.alias("gone"))
    before = rows.filter("at = 1 and lcp > 0").select(F.col("doc_b").alias("doc_key"), F.col("lcp").alias("longest"), F.lit(None).cast("array<int>").alias("gone"))
    every = rows.select("doc_key", "longest", "gone").filter("longest > 0 or gone is not null").union(before)
    return every.groupBy("doc_key").agg(F.max("longest").alias("longest"), F.array_distinct(F.flatten(F.collect_list("gone"))).alias("gone"))


def _keep(text: str, gone: set[int]) -> str:
    if not gone:
        return text
    kept, place = [], 0
    for line in _lines(text):
        if line.strip(_BLANK):
            place += 1
            if place - 1 in gone:
                continue
        kept.append(line)
    return "\n".join(kept)


def _finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = [t.as_py() for t in batch["text"]]
        gone = [set(g or ()) for g in batch["gone"].to_pylist()]
        kept = [_keep(t, g) if t else t for t, g in zip(texts, gone, strict=True)]
        n = [sum(bool(x.strip(_BLANK)) for x in _lines(t or "")) for t in texts]
        yield pa.RecordBatch.from_pydict({"doc_key": batch["doc_key"], "n_lines": pa.array(n, pa.int64()), "n_removed": pa.array([len(g) for g in gone], pa.int64()), "longest_repeat": batch["longest"], "kept": pa.array(kept, pa.string())})


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in _finish(batches):
        sums = [hashlib.sha256((t.as_py() or "").encode("utf-8", "surrogatepass")).hexdigest() for t in batch["kept"]]
        yield batch.drop_columns(["kept"]).append_column("kept_sha256", pa.array(sums, pa.string()))


def removed_lines(docs: DataFrame, key: str, min_lines: int = MIN_LINES) -> DataFrame:
    """(doc_key, longest, gone array) of repeats(), places being those among a row's lines that
    aren't blank; key is a column of row_keyed()."""
    array = SuffixArray(docs, key)
    return repeats(array.common(), array.width, min_lines)


def without_repeated_lines(docs: DataFrame, min_lines: int = MIN_LINES, digest: bool = False) -> DataFrame:
    """(doc_id, n_lines, n_removed, longest_repeat, kept): each text without later copies of repeated line runs.

    A run counts if it has min_lines lines or more, or is a line of 100 characters or more;
    its first copy, by doc_id and then place, stays and the others' lines go. Lines are what
    newlines separate; blank ones (spaces, tabs, returns) break no run, count for none and
    stay. digest=True returns kept_sha256 in place of kept.

    A null text stays null and an empty one empty, both without lines; a null doc_id sorts
    first; rows that repeat a doc_id are documents of their own, in the order of a hash of
    their texts. An empty table gives no rows.
    """
    (key,) = spare(docs, "_key")
    docs = row_keyed(docs, key)
    found = removed_lines(docs, key, min_lines).withColumnRenamed("doc_key", key)
    texts = docs.select(key, doc_key().alias("doc_key"), "text").join(found, key, "left")
    texts = texts.select("doc_key", "text", "gone", F.coalesce("longest", F.lit(0)).alias("longest"))
    last = "kept_sha256" if digest else "kept"
    out = in_arrow(texts, _digest if digest else _finish, f"doc_key long, n_lines long, n_removed long, longest_repeat long, {last} string")
    return out.select(from_key().alias("doc_id"), "n_lines", "n_removed", "longest_repeat", last)


def deduplicated(docs: DataFrame, min_lines: int = MIN_LINES) -> DataFrame:
    """The documents with the texts that without_repeated_lines keeps, every row and column; n_chars, if there, follows."""
    key, gone = spare(docs, "_key", "_gone")
    columns, at, schema = docs.columns, docs.columns.index("text"), docs.schema
    docs = row_keyed(docs, key)
    found = removed_lines(docs, key, min_lines).select(F.col("doc_key").alias(key), F.col("gone").alias(gone))

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [_keep(t, set(g)) if t and g else t for t, g in zip(batch.column(at).to_pylist(), batch.column(len(columns)).to_pylist(), strict=True)]
            arrays = [pa.array(texts, batch.schema.field(at).type) if k == at else batch.column(k) for k in range(len(columns))]
            yield pa.RecordBatch.from_arrays(arrays, columns)

    joined = docs.join(found, key, "left").select(*columns, gone)
    out = in_arrow(joined, keep, schema)
    return out.withColumn("n_chars", F.length("text").cast(schema["n_chars"].dataType)) if "n_chars" in columns else out
