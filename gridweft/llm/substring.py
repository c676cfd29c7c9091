"""Substring dedup: repeated 20-word windows found by anchors at difference-cover positions."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridweft.llm.common import doc_key, from_key, in_arrow, partitions, row_keyed

WINDOW = 20
#: Any two residues modulo 13 reach this set by one common shift below 13.
PERIOD, COVER = 13, (0, 1, 3, 9)
ANCHOR = WINDOW - PERIOD + 1
_GROUP = 1 << 20
_DOCS_A_HASH_BUCKET, _DOCS_A_BUCKET = 2_000, 8_000
_SEGMENT = 1 << 20
_BASES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F | 1)
_TABLES = [np.random.Generator(np.random.PCG64(s)).integers(0, 1 << 63, 256, np.uint64) << np.uint64(1) | np.uint64(1) for s in (11, 12)]
_BLANK = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])
_POWERS: dict[tuple[int, int], tuple[np.ndarray, np.ndarray]] = {}


def _powers(lane: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """At least n powers modulo 2^64 of a lane's base and of its inverse."""
    size = max(1 << 12, 1 << max(0, n - 1).bit_length())
    if (lane, size) not in _POWERS:
        for old in [k for k in _POWERS if k[0] == lane and k[1] < size]:
            del _POWERS[old]
        pair = []
        for base in (_BASES[lane], pow(_BASES[lane], -1, 1 << 64)):
            powers = np.full(size, base, np.uint64)
            powers[0] = 1
            pair.append(np.cumprod(powers))
        _POWERS[lane, size] = tuple(pair)
    return next(v for (k, s), v in _POWERS.items() if k == lane and s >= size)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ x >> np.uint64(30)) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ x >> np.uint64(27)) * np.uint64(0x94D049BB133111EB)
    return x ^ x >> np.uint64(31)


def word_hashes(body: bytes, lanes: int) -> list[np.ndarray]:
    """A 64-bit hash of every word of a UTF-8 text in each lane, from prefix sums of a polynomial."""
    out: list[list[np.ndarray]] = [[] for _ in range(lanes)]
    low, n = 0, len(body)
    while low < n:
        high = min(n, low + _SEGMENT)
        while high < n and not _BLANK[body[high]]:
            high += 1
        part = np.frombuffer(body, np.uint8, high - low, low)
        edges = np.diff(np.concatenate([[True], _BLANK[part], [True]]).view(np.int8))
        starts, ends = np.flatnonzero(edges == -1), np.flatnonzero(edges == 1)
        for lane in range(lanes):
            up, down = _powers(lane, len(part) + 1)
            sums = np.zeros(len(part) + 1, np.uint64)
            np.cumsum(_TABLES[lane][part] * down[: len(part)], out=sums[1:])
            out[lane].append(_mix((sums[ends] - sums[starts]) * up[starts] + (ends - starts).astype(np.uint64)))
        low = high
    return [np.concatenate(x) if x else np.empty(0, np.uint64) for x in out]


def run_hashes(words: np.ndarray, lane: int, width: int, at: np.ndarray) -> np.ndarray:
    """Hashes of the runs of `width` words that start at the places `at`."""
    up, down = _powers(lane, len(words) + 1)
    sums = np.zeros(len(words) + 1, np.uint64)
    np.cumsum(words * down[: len(words)], out=sums[1:])
    return _mix((sums[at + width] - sums[at]) * up[at])


def anchor_places(n: int) -> np.ndarray:
    """Cover positions of a text of n words at which an anchor fits."""
    at = np.arange(max(0, n - ANCHOR + 1))
    return at[np.isin(at % PERIOD, COVER)]


def _pack(*columns: np.ndarray) -> bytes:
    """Columns of equal length by planes of equal bytes, compressed."""
    planes = [c.view(np.uint8).reshape(len(c), -1).T.tobytes() for c in columns]
    return zstandard.ZstdCompressor(level=1).compress(b"".join(planes))


def _unpack(body: bytes, kinds: list) -> list[np.ndarray]:
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(body), np.uint8)
    sizes = [np.dtype(k).itemsize for k in kinds]
    n, out, at = len(raw) // sum(sizes), [], 0
    for kind, size in zip(kinds, sizes, strict=True):
        out.append(np.ascontiguousarray(raw[at : at + n * size].reshape(size, n).T).view(kind).reshape(n))
        at += n * size
    return out


def _dealt(buckets: np.ndarray, known: bool, columns: list[np.ndarray]) -> pa.RecordBatch:
    """One packed row for each bucket."""
    order = np.argsort(buckets, kind="stable")
    found, first = np.unique(buckets[order], return_index=True)
    ends = [*first[1:].tolist(), len(order)]
    bodies = [_pack(*(c[order[s:e]] for c in columns)) for s, e in zip(first.tolist(), ends, strict=True)]
    return pa.RecordBatch.from_pydict({"bucket": pa.array(found.astype(np.int32)), "known": pa.array([known] * len(found), pa.bool_()), "body": pa.array(bodies, pa.binary())})


_DEALT = "bucket int, known boolean, body binary"
_OF_DOC = "doc_key long, items binary"


def _grouped(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list[bytes], list[bytes]]]:
    """(bucket, asked bodies, known bodies) of rows sorted by bucket."""
    now, asked, known = None, [], []
    for batch in batches:
        for bucket, sure, body in zip(batch["bucket"].to_pylist(), batch["known"].to_pylist(), batch["body"], strict=True):
            if now is not None and bucket != now:
                yield now, asked, known
                asked, known = [], []
            now = bucket
            (known if sure else asked).append(body.as_py())
    if now is not None:
        yield now, asked, known


def _doc_bucket(docs: np.ndarray, bits: int) -> np.ndarray:
    return (_mix(docs.view(np.uint64)) >> np.uint64(64 - bits)).astype(np.int64)


def _anchors(bits: int, doc_bits: int):
    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Anchors of documents. What repeats within a task is known and asks once for others."""
        hashes, docs, held = [], [], 0

        def flush() -> Iterator[pa.RecordBatch]:
            h, d = np.concatenate(hashes), np.concatenate(docs)
            order = np.argsort(h, kind="stable")
            h, d = h[order], d[order]
            fresh = np.concatenate([[True], h[1:] != h[:-1]])
            size = np.diff(np.concatenate([np.flatnonzero(fresh), [len(h)]]))
            many = np.repeat(size > 1, size)
            flag = many[fresh].astype(np.uint8)
            yield _dealt((h[fresh] >> np.uint64(64 - bits)).astype(np.int64), False, [h[fresh], d[fresh], flag])
            if many.any():
                yield _to_documents(d[many], h[many].view(np.int64), doc_bits)

        for batch in batches:
            for key, text in zip(batch["doc_key"].to_pylist(), batch["text"], strict=True):
                (words,) = word_hashes((text.as_py() or "").encode("utf-8", "surrogatepass"), 1)
                if len(words) < WINDOW:
                    continue
                found = np.unique(run_hashes(words, 0, ANCHOR, anchor_places(len(words))), return_counts=True)
                for twice in (False, True):  # an anchor that repeats in its own text is sent twice
                    part = found[0][found[1] > 1] if twice else found[0]
                    hashes.append(part)
                    docs.append(np.full(len(part), key, np.int64))
                    held += len(part)
                if held >= _GROUP:
                    yield from flush()
                    hashes, docs, held = [], [], 0
        if held:
            yield from flush()

    return emit


def _passed_on(known: list[bytes], bucket: int) -> Iterator[pa.RecordBatch]:
    """Known rows as they are; they were dealt by document from the start."""
    if known:
        yield pa.RecordBatch.from_pydict({"bucket": pa.array([bucket] * len(known), pa.int32()), "known": pa.array([True] * len(known), pa.bool_()), "body": pa.array(known, pa.binary())})


def _answers(found: Iterator, bits: int) -> Iterator[pa.RecordBatch]:
    """(docs, items) packed for the documents' buckets over all that a task finds, in steps of bounded size."""
    docs, items, held = [], [], 0
    for batch, pair in found:
        yield from batch
        if pair is not None and len(pair[0]):
            docs.append(pair[0])
            items.append(pair[1])
            held += len(pair[0])
        if held >= _GROUP:
            yield _to_documents(np.concatenate(docs), np.concatenate(items), bits)
            docs, items, held = [], [], 0
    if held:
        yield _to_documents(np.concatenate(docs), np.concatenate(items), bits)


def _to_documents(docs: np.ndarray, items: np.ndarray, bits: int) -> pa.RecordBatch:
    return _dealt(_doc_bucket(docs, bits), True, [docs, items])


def _repeated_anchors(bits: int):
    def found(batches: Iterator[pa.RecordBatch]) -> Iterator:
        for bucket, asked, known in _grouped(batches):
            pair = None
            if asked:
                h, d, flag = (np.concatenate(c) for c in zip(*[_unpack(b, [np.uint64, np.int64, np.uint8]) for b in asked], strict=True))
                order = np.argsort(h, kind="stable")
                h, d, flag = h[order], d[order], flag[order]
                same = h[1:] == h[:-1]
                shared = (np.concatenate([[False], same]) | np.concatenate([same, [False]])) & (flag == 0)
                pair = d[shared], h[shared].view(np.int64)
            yield _passed_on(known, bucket), pair

    def settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Anchors that stand at two places or more, dealt by the documents that hold them."""
        return _answers(found(batches), bits)

    return settle


def _windows(bits: int, doc_bits: int):
    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Hashes of the windows around repeated anchors. Later ones of a task are known."""
        parts, held = [], 0

        def flush() -> Iterator[pa.RecordBatch]:
            a, b, d, s = (np.concatenate(c) for c in zip(*parts, strict=True))
            order = np.lexsort((s, d, b, a))
            a, b, d, s = a[order], b[order], d[order], s[order]
            first = np.concatenate([[True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])])
            lead = np.maximum.accumulate(np.where(first, np.arange(len(a)), 0))
            asked = first | (d == d[lead]) & (s == s[lead])
            yield _dealt((a[first] >> np.uint64(64 - bits)).astype(np.int64), False, [a[first], b[first], d[first], s[first]])
            later = ~asked
            if later.any():
                yield _to_documents(d[later], s[later], doc_bits)

        for batch in batches:
            for key, text, lists in zip(batch["doc_key"].to_pylist(), batch["text"], batch["items"], strict=True):
                lanes = word_hashes((text.as_py() or "").encode("utf-8", "surrogatepass"), 2)
                n = len(lanes[0])
                if n < WINDOW:
                    continue
                places = anchor_places(n)
                repeated = np.frombuffer(lists.as_py(), np.uint64)
                hit = places[np.isin(run_hashes(lanes[0], 0, ANCHOR, places), repeated)]
                marks = np.zeros(n + 2, np.int32)
                np.add.at(marks, np.maximum(0, hit - PERIOD + 1), 1)
                np.add.at(marks, hit + 1, -1)
                at = np.flatnonzero(np.cumsum(marks)[: n - WINDOW + 1] > 0)
                if len(at):
                    parts.append((run_hashes(lanes[0], 0, WINDOW, at), run_hashes(lanes[1], 1, WINDOW, at).astype(np.uint32), np.full(len(at), key, np.int64), at.astype(np.int64)))
                    held += len(at)
                if held >= _GROUP:
                    yield from flush()
                    parts, held = [], 0
        if held:
            yield from flush()

    return emit


def _later_windows(bits: int):
    def found(batches: Iterator[pa.RecordBatch]) -> Iterator:
        for bucket, asked, known in _grouped(batches):
            pair = None
            if asked:
                a, b, d, s = (np.concatenate(c) for c in zip(*[_unpack(x, [np.uint64, np.uint32, np.int64, np.int64]) for x in asked], strict=True))
                order = np.lexsort((s, d, b, a))
                a, b, d, s = a[order], b[order], d[order], s[order]
                first = np.concatenate([[True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])])
                lead = np.maximum.accumulate(np.where(first, np.arange(len(a)), 0))
                later = (d != d[lead]) | (s != s[lead])
                pair = d[later], s[later]
            yield _passed_on(known, bucket), pair

    def settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Starts of the windows that also start earlier, dealt by the documents that hold them."""
        return _answers(found(batches), bits)

    return settle


def _gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row for each document with all its items, 64 bits each."""
    for _, _, known in _grouped(batches):
        docs, items = (np.concatenate(c) for c in zip(*[_unpack(b, [np.int64, np.int64]) for b in known], strict=True))
        order = np.argsort(docs, kind="stable")
        docs, items = docs[order], items[order]
        found, first = np.unique(docs, return_index=True)
        ends = [*first[1:].tolist(), len(docs)]
        yield pa.RecordBatch.from_pydict({"doc_key": pa.array(found), "items": pa.array([items[s:e].tobytes() for s, e in zip(first.tolist(), ends, strict=True)], pa.binary())})


def kept_words(text: str, starts: np.ndarray) -> tuple[list[bytes], int]:
    """Words outside the windows that start at these places; how many words there were."""
    words = text.encode("utf-8", "surrogatepass").split()
    if not len(starts):
        return words, len(words)
    marks = np.zeros(len(words) + WINDOW + 1, np.int32)
    np.add.at(marks, starts, 1)
    np.add.at(marks, starts.astype(np.int64) + WINDOW, -1)
    kept = np.flatnonzero(np.cumsum(marks)[: len(words)] == 0).tolist()
    return [words[k] for k in kept], len(words)


def _finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        n, removed, kept = [], [], []
        for text, items in zip(batch["text"], batch["items"], strict=True):
            starts = np.unique(np.frombuffer(items.as_py() or b"", np.int64))
            words, every = kept_words(text.as_py() or "", starts)
            n.append(every)
            removed.append(every - len(words))
            kept.append(b" ".join(words).decode("utf-8", "surrogatepass"))
        yield pa.RecordBatch.from_pydict({"doc_key": batch["doc_key"], "n_words": pa.array(n, pa.int64()), "n_removed": pa.array(removed, pa.int64()), "kept": pa.array(kept, pa.string())})


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in _finish(batches):
        sums = [hashlib.sha256(t.as_py().encode("utf-8", "surrogatepass")).hexdigest() for t in batch["kept"]]
        yield batch.drop_columns(["kept"]).append_column("kept_sha256", pa.array(sums, pa.string()))


def _bucket_bits(spark: SparkSession, documents: int) -> tuple[int, int]:
    """Bits of the buckets of hashes and of documents: some, or about one, for each partition, and
    enough that a bucket, which a task holds whole, keeps its size whatever the number of documents."""
    n = partitions(spark)
    return max(4, (4 * n - 1).bit_length(), (documents // _DOCS_A_HASH_BUCKET).bit_length()), max(2, (n - 1).bit_length(), (documents // _DOCS_A_BUCKET).bit_length())


def _exchanged(df: DataFrame, step, schema: str) -> DataFrame:
    """step over packed rows, all rows of a bucket in one task."""
    return in_arrow(df.repartition(partitions(df.sparkSession), "bucket").sortWithinPartitions("bucket"), step, schema)


def without_repeats(docs: DataFrame, digest: bool = False) -> DataFrame:
    """(doc_id, n_words, n_removed, kept): each whole text without the words of repeated windows.

    A word goes if a window of 20 words that covers it also starts earlier, in a document of
    smaller doc_id or before in the same one. Anchors of 8 words are hashed only at positions
    that modulo 13 lie in {0, 1, 3, 9}: two equal windows of any offsets hold a pair of equal
    anchors at equal places, so only windows about anchors that repeat can repeat. Those are
    hashed whole (96 bits) and all but the first of each hash are later copies. Hashes move
    in packed blocks; a task settles what repeats within itself and asks for each hash once,
    so that a passage shared by very many documents is no hot group, and no pairs are made.

    Both joins with the texts take the same columns, so that Spark deals the texts out once
    and reads that exchange twice.

    digest=True returns kept_sha256 in place of kept. Null and empty texts have no words; a
    null doc_id sorts first; rows that repeat a doc_id are documents of their own, in the
    order of a hash of their texts. An empty table gives no rows.
    """
    bits, doc_bits = _bucket_bits(docs.sparkSession, docs.count())
    keyed = row_keyed(docs.select("doc_id", "text"), "doc_key").withColumn("doc_key", doc_key("doc_key"))  # never null, or the inner join would filter its side
    anchors = _exchanged(in_arrow(keyed.select("doc_key", "text"), _anchors(bits, doc_bits), _DEALT), _repeated_anchors(doc_bits), _DEALT)
    wanted = _exchanged(anchors, _gathered, _OF_DOC)
    windows = in_arrow(keyed.join(wanted, "doc_key"), _windows(bits, doc_bits), _DEALT)
    starts = _exchanged(_exchanged(windows, _later_windows(doc_bits), _DEALT), _gathered, _OF_DOC)
    rows = keyed.join(starts, "doc_key", "left").select(doc_key().alias("doc_key"), "text", "items")
    if digest:
        return in_arrow(rows, _digest, "doc_key long, n_words long, n_removed long, kept_sha256 string").withColumn("doc_id", from_key()).drop("doc_key")
    return in_arrow(rows, _finish, "doc_key long, n_words long, n_removed long, kept string").withColumn("doc_id", from_key()).drop("doc_key")
