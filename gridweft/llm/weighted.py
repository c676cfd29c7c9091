"""Document fingerprints by consistent weighted sampling."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridweft.llm.common import doc_key, from_key, in_arrow, kept, partitions, row_keyed
from gridweft.llm.substring import word_hashes
from gridweft.ship import ship

SAMPLES = 128
#: Terms whose least keys are kept, as a power of two, and how many of each.
_KEPT_BITS = 19
_HEAD = 16
#: Terms whose keys are made at once.
_STEP = 512
#: Pairs of a text and a term whose keys are compared at once.
_PAIRS = 4096
#: Expected keys below a text's limit in each column; a column has none in exp(-10) of all cases.
_BELOW = 10
_EMPTY = np.uint64(2**64 - 1)
#: Bytes of short texts that are hashed at once, and which bytes belong to words.
_TOGETHER = 1 << 16
_BLACK = bytes(k not in b" \t\n\v\f\r" for k in range(256))
#: Characters of the texts that are compared at once.
_CHARS = 1 << 22
#: Ranges that documents are dealt to; their ends are numbers on the driver.
_MOST_RANGES = 20_000


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ x >> np.uint64(30)) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ x >> np.uint64(27)) * np.uint64(0x94D049BB133111EB)
    return x ^ x >> np.uint64(31)


@cache
def _tables() -> tuple[np.ndarray, np.ndarray]:
    """Quantiles of 65,536 equal steps: of the exponential and of the Gamma(2, 1) distribution, the latter by Newton's steps."""
    q = (np.arange(1 << 16) + 0.5) / (1 << 16)
    exponential = -np.log(q)
    gamma = np.sqrt(2 * q) + q * exponential[::-1]
    for _ in range(60):
        gamma = np.maximum(gamma / 2, gamma - (1 - (1 + gamma) * np.exp(-gamma) - q) / (gamma * np.exp(-gamma)))
    return exponential.astype(np.float32), gamma.astype(np.float32)


def _rising(x: np.ndarray) -> np.ndarray:
    """Unsigned numbers in the order of the floats."""
    bits = x.view(np.int32)
    return (bits ^ (bits >> 31 | np.int32(-(1 << 31)))).view(np.uint32)


def sample_keys(hashes: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """(terms, SAMPLES) 64-bit keys; the least key of a column over a text's terms is its sample.

    With r, c ~ Gamma(2, 1) and b ~ U(0, 1) fixed by term and column, a term of weight w has
    t = floor(ln w / r + b) and ln a = ln c - r (t - b) - r. The term of least a and its t are
    equal for two texts with a probability of their generalised Jaccard similarity. A term
    and column have 64 bits: 32 for c, a sum of two exponentials, as small ones decide, and
    16 each for r and b. A key holds ln a in its upper half, 16 bits of a hash of (term, t)
    below it and its column in the lowest 16.
    """
    exponential, gamma = _tables()
    columns = _mix(np.arange(1, SAMPLES + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    lanes = _mix(hashes[:, None] ^ columns).view(np.uint16).reshape(len(hashes), SAMPLES, 4)
    r = gamma.take(lanes[:, :, 0])
    b = (lanes[:, :, 1].astype(np.float32) + np.float32(0.5)) * np.float32(2**-16)
    c = exponential.take(lanes[:, :, 2])
    c += exponential.take(lanes[:, :, 3])
    a = np.log(c, out=c)
    mark = np.repeat((hashes >> np.uint64(13)).astype(np.uint32)[:, None], SAMPLES, axis=1)
    more = np.flatnonzero(weights > 1)
    if len(more):
        t = np.floor(np.log(weights[more].astype(np.float32))[:, None] / r[more] + b[more])
        b[more] -= t
        mark[more] += t.astype(np.int32).view(np.uint32) * np.uint32(0x9E3779B1)
    b -= np.float32(1)
    b *= r
    a += b
    mark *= np.uint32(0x85EBCA6B)
    mark ^= mark >> np.uint32(15)
    keys = np.empty((len(hashes), SAMPLES), np.uint64)
    halves = keys.view("<u4").reshape(len(hashes), SAMPLES, 2)
    halves[:, :, 0] = mark << np.uint32(16) | np.arange(SAMPLES, dtype=np.uint32)
    halves[:, :, 1] = _rising(a)
    return keys


class Sampler:
    """Signatures of texts; the least keys of the first terms seen are kept across a worker's tasks.

    In a text of n words the least a of a column is exponential with rate n, so few keys are
    below a limit of 10 / n, yet hardly a column is without one. Only keys below the limit are
    compared: the kept ones of a term, or all of them where the last kept one is below it too
    or none are kept. Short texts, and those with a column that has no key below the limit,
    have no limit, so each sample is the least of all keys.
    """

    def __init__(self):
        self.names = np.zeros(1 << _KEPT_BITS, np.uint64)
        self.heads = np.empty((1 << _KEPT_BITS, _HEAD), np.uint64)

    def signatures(self, texts: list[np.ndarray]) -> np.ndarray:
        """(texts, SAMPLES) of 16-bit values, from the hashes of each text's words."""
        words = np.array([len(x) for x in texts], np.int64)
        out = np.full((len(texts), SAMPLES), _EMPTY)
        limits = _rising(np.log(_BELOW / np.maximum(words, 1)).astype(np.float32)).astype(np.uint64) << np.uint64(32)
        limits[words * _HEAD < _BELOW * SAMPLES] = _EMPTY
        text, hashes, weights = _counted(texts, words)
        self._lower(out, limits, text, hashes, weights)
        again = (limits < _EMPTY) & (out == _EMPTY).any(1)
        limits[again] = _EMPTY
        rest = np.flatnonzero(again[text])
        self._lower(out, limits, text[rest], hashes[rest], weights[rest])
        return (out >> np.uint64(16) & np.uint64(0xFFFF)).astype(">u2")

    def _lower(self, out: np.ndarray, limits: np.ndarray, text: np.ndarray, hashes: np.ndarray, weights: np.ndarray) -> None:
        """Lowers out to the least keys below the texts' limits."""
        names = np.maximum(_mix(hashes + weights.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)), np.uint64(1))
        places = (names >> np.uint64(64 - _KEPT_BITS)).astype(np.int64)
        whole = self.names[places] != names
        whole |= limits[text] == _EMPTY
        old = np.flatnonzero(~whole)
        for low in range(0, len(old), _PAIRS):
            at = old[low : low + _PAIRS]
            whole[at] = _take(out, limits, text[at], self.heads[places[at]])[:, -1]
        rest = np.flatnonzero(whole)
        _, first, term = np.unique(names[rest], return_index=True, return_inverse=True)
        first, order = rest[first], np.argsort(term, kind="stable")
        rest, term = rest[order], term[order]
        for low in range(0, len(first), _STEP):
            at = first[low : low + _STEP]
            made = sample_keys(hashes[at], weights[at])
            one, end = np.searchsorted(term, [low, low + len(at)])
            for k in range(one, end, _PAIRS):
                pairs = slice(k, min(end, k + _PAIRS))
                _take(out, limits, text[rest[pairs]], made[term[pairs] - low])
            to, free = np.unique(places[at], return_index=True)
            to, free = to[empty := self.names[to] == 0], free[empty]
            self.heads[to] = np.sort(made[free], axis=1)[:, :_HEAD]
            self.names[to] = names[at[free]]


def _counted(texts: list[np.ndarray], words: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each text the distinct hashes and how often each stands there, with the text's number."""
    hashes = np.concatenate([np.empty(0, np.uint64), *map(np.sort, texts)])
    fresh = np.ones(len(hashes) + 1, bool)
    np.not_equal(hashes[1:], hashes[:-1], out=fresh[1 : len(hashes)])
    fresh[np.cumsum(words)] = True
    ends = np.flatnonzero(fresh)
    first = ends[:-1]
    return np.repeat(np.arange(len(texts)), words)[first], hashes[first], ends[1:] - first


def _take(out: np.ndarray, limits: np.ndarray, text: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Lowers out to the keys (pairs, any) that are below the limits of the pairs' texts; tells which are."""
    below = keys < limits[text][:, None]
    at = np.flatnonzero(below)
    less = keys.ravel()[at]
    cells = text[at // keys.shape[1]] * SAMPLES + (less & np.uint64(0xFFFF)).view(np.int64)
    np.minimum.at(out.reshape(-1), cells, less)
    return below


def sampler() -> Sampler:
    return kept("samples", Sampler)


def terms(texts: list[str]) -> list[np.ndarray]:
    """Hashes of each text's words, one for each time that one stands in it; short texts are hashed together."""
    out, low, bodies = [], 0, [t.encode("utf-8", "surrogatepass") for t in texts]
    while low < len(bodies):
        high, size = low + 1, len(bodies[low])
        while high < len(bodies) and size + len(bodies[high]) < _TOGETHER:
            size += len(bodies[high])
            high += 1
        some = bodies[low:high]
        hashes = word_hashes(b" ".join(some), 1)[0]
        if high - low == 1:
            out.append(hashes)
        else:
            black = np.frombuffer(b" ".join([b"", *some]).translate(_BLACK), bool)
            ends = np.searchsorted(np.flatnonzero(black[1:] > black[:-1]), np.cumsum([len(x) + 1 for x in some]))
            out += np.split(hashes, ends[:-1])
        low = high
    return out


def _likeness(a: np.ndarray, b: np.ndarray) -> float:
    return float(np.count_nonzero(a == b)) / SAMPLES


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, fingerprint) of every whole text: 128 samples of 16 bits in hex.

    The share of equal samples of two fingerprints estimates the generalised Jaccard
    similarity of the texts' word counts. Texts without words share one fingerprint; a null
    text is empty; a null doc_id and rows that repeat are kept as they are.
    """

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [t or "" for t in batch["text"].to_pylist()]
            out = [row.tobytes().hex() for low in range(0, len(texts), 64) for row in sampler().signatures(terms(texts[low : low + 64]))]
            yield pa.RecordBatch.from_pydict({"doc_id": batch["doc_id"], "fingerprint": pa.array(out, pa.string())})

    return in_arrow(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), sign, "doc_id long, fingerprint string")


_PAIR = "doc_key long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def against_next(docs: DataFrame, buckets_a_partition: int = 4) -> DataFrame:
    """Each document against its edited text and against the next one in descending doc_id.

    The last floor(n_chars / 3) characters are replaced by the first as many (or all) of the
    next document; after the last comes the first. Rows are dealt once to ranges of doc_id
    that end at ids of the table (approximate quantiles); a range also gets a copy of the row
    at the head of the range below, and the lowest range that of the highest, so each range
    holds the next of all its rows.

    Null texts are empty. A null doc_id sorts below all others. Rows that repeat a doc_id or
    have none follow each other in the order of row_keyed(), by a hash of their texts. A single
    row is its own next. An empty table gives no rows.
    """
    spark = docs.sparkSession
    ship(spark)
    keyed = row_keyed(docs.select("doc_id", "text"), "row_key").select("row_key", doc_key().alias("doc_key"), F.coalesce("text", F.lit("")).alias("text"))
    n = max(1, min(_MOST_RANGES, partitions(spark) * buckets_a_partition))
    heads = keyed.agg(F.percentile_approx("row_key", [(k + 1) / n for k in range(n)], 20 * n).alias("q"), F.max("row_key").alias("top")).first()
    bounds = sorted({*(heads["q"] or ()), *([heads["top"]] if heads["top"] is not None else ())})

    @F.pandas_udf("array<int>")
    def places(key: pd.Series) -> pd.Series:
        own = np.searchsorted(bounds, key.to_numpy(), side="left")
        guest = np.where(np.asarray(bounds)[own] == key.to_numpy(), (own + 1) % len(bounds), -1)
        return pd.Series([[o] if g < 0 else [o, -1 - g] for o, g in zip(own.tolist(), guest.tolist(), strict=True)])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[int, str, str]] = []
        last, chars = None, 0  # (bucket, guest, key, text)

        def flush() -> pa.RecordBatch:
            edited, texts, own, other, rows = [], [], [], [], []
            for _, text, after in held:
                if not texts or texts[-1] is not text:  # else the next text of the row before
                    texts.append(text)
                own.append(len(texts) - 1)
                texts.append(after)
                other.append(len(texts) - 1)
                k = len(text) // 3
                edited.append(text[: len(text) - k] + after[:k])
            signs = sampler().signatures(terms(texts + edited))
            for n, (key, text, _) in enumerate(held):
                a, b, c = signs[own[n]], signs[len(texts) + n], signs[other[n]]
                rows.append((key, len(text), hashlib.sha256(edited[n].encode("utf-8", "surrogatepass")).hexdigest(), a.tobytes().hex(), b.tobytes().hex(), _likeness(a, b), _likeness(a, c)))
            held.clear()
            names = [f.split()[0] for f in _PAIR.split(", ")]
            return pa.RecordBatch.from_pydict(dict(zip(names, map(list, zip(*rows, strict=True)), strict=True)))

        for batch in batches:
            for bucket, guest, key, text in zip(batch["bucket"].to_pylist(), batch["guest"].to_pylist(), batch["doc_key"].to_pylist(), batch["text"], strict=True):
                text = text.as_py()
                if last and last[0] == bucket and not last[1]:
                    held.append((*last[2:], text))
                    chars += len(last[3])
                    if len(held) >= 256 or chars >= _CHARS:
                        yield flush()
                        chars = 0
                last = (bucket, guest, key, text)
        if held:
            yield flush()

    dealt = keyed.withColumn("place", F.explode(places("row_key"))).select(F.when(F.col("place") < 0, -1 - F.col("place")).otherwise(F.col("place")).alias("bucket"), (F.col("place") < 0).alias("guest"), "row_key", "doc_key", "text")
    dealt = dealt.repartition(n, "bucket").sortWithinPartitions("bucket", "guest", F.desc("row_key"))
    return in_arrow(dealt, compare, _PAIR).withColumn("doc_id", from_key()).drop("doc_key")
