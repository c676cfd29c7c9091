"""BPE encoding and decoding with reuse of content-defined chunks."""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from gridweft.llm import tokens
from gridweft.llm.common import doc_key, from_key, in_arrow, kept, row_keyed, saved, spare, written

WINDOW, MIN_CHUNK, MAX_CHUNK, ONE_IN = 24, 1024, 8192, 64
_ARROW = {"doc_key": pa.int64(), "ids": pa.binary(), "n_tokens": pa.int64(), "ids_sha256": pa.string(), "decoded_sha256": pa.string(), "decoded": pa.string()}
_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}
_BASE = 0x9E3779B97F4A7C15 | 1
_SPACES = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])
_GEAR = np.random.Generator(np.random.PCG64(7)).integers(0, 1 << 63, 256, np.uint64) << np.uint64(1) | np.uint64(1)


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2^64."""
    size = max(1 << 12, 1 << (n - 1).bit_length())
    if size not in _POWERS:
        up, down = (np.full(size, x, np.uint64) for x in (_BASE, pow(_BASE, -1, 1 << 64)))
        up[0] = down[0] = 1
        _POWERS.clear()
        _POWERS[size] = np.cumprod(up), np.cumprod(down)
    return _POWERS[size]


def cut_points(body: bytes) -> list[int]:
    """Ends of the chunks of a UTF-8 text.

    A polynomial hash of the last 24 bytes rolls over the text; a chunk ends after white
    space where one in 64 hashes says so, at 1024 bytes or more. Without such a place it ends
    before the character that passes 8192 bytes, be that inside a word.
    """
    n = len(body)
    if n <= MIN_CHUNK:
        return [n] if n else []
    wanted = []
    step = 1 << 20
    for low in range(0, n, step):  # bounded arrays for very long texts
        start = max(0, low - WINDOW)
        part = np.frombuffer(body, np.uint8, min(n, low + step) - start, start)
        up, down = _powers(len(part))
        sums = np.cumsum(_GEAR[part] * down[: len(part)])
        at = np.flatnonzero(_SPACES[part])
        at = at[at >= WINDOW]
        rolled = (sums[at] - sums[at - WINDOW]) * up[at]
        wanted.append(at[(rolled >> np.uint64(40)) % np.uint64(ONE_IN) == 0] + start + 1)
    out, last = [], 0
    for cut in [*np.unique(np.concatenate(wanted)).tolist(), n]:
        while cut - last > MAX_CHUNK:
            hard = last + MAX_CHUNK
            while body[hard] & 0xC0 == 0x80:
                hard -= 1
            out.append(hard)
            last = hard
        if cut - last >= MIN_CHUNK or cut == n:
            if cut > last:
                out.append(cut)
            last = cut
    return out


def chunks_of(text: str) -> tuple[list[str], list[bytes]]:
    body = text.encode("utf-8", "surrogatepass")
    out, keys, last = [], [], 0
    for cut in cut_points(body):
        out.append(body[last:cut].decode("utf-8", "surrogatepass"))
        keys.append(xxhash.xxh3_128_digest(body[last:cut]))
        last = cut
    return out, keys


def vocabulary(path: str) -> list[str]:
    """The token of each id."""
    tokenizer = tokens.load(path)
    if tokenizer.decoder is not None:
        raise ValueError(f"{path}: only vocabularies without a decoder, whose tokens are joined by spaces")
    return [tokenizer.id_to_token(i) for i in range(tokenizer.get_vocab_size())]


def spelt(code: bytes, names: list[str]) -> str:
    """The text of a code as the tokenizers library decodes it, special tokens and all; its decimal ids, if these are the names."""
    return " ".join([names[i] for i in Codec.ids(code)])


class Codec:
    """Encodes chunks and mends their joins."""

    def __init__(self, path: str):
        self.tokenizer = tokens.load(path)
        self.memo = tokens.WordMemo(path, self.render, 400_000)

    @staticmethod
    def render(ids: list[int]) -> bytes:
        """A code: the ids as little-endian unsigned 32-bit integers."""
        return np.array(ids, "<u4").tobytes()

    @staticmethod
    def ids(code: bytes) -> list[int]:
        return np.frombuffer(code, "<u4").tolist()

    def encode(self, text: str) -> list[tuple]:
        """(text, code) of each word."""
        items = tokens.words(text)
        return list(zip(items, self.memo.lookup(items), strict=True))

    def _mended(self, left: list[tuple], glue: str, right: list[tuple]) -> list[tuple]:
        """(text, code) of left and right, which don't encode apart.

        The words around the join are encoded again, ever more of them, until the outermost
        ones keep the codes that they had, or nothing is left to take in.
        """
        n = 2
        while True:
            back, ahead = left[-n:], right[:n]
            text = " ".join([t for t, _ in back]) + glue + " ".join([t for t, _ in ahead])
            again = self.memo._whole([text])[0]
            first, last = self.ids(back[0][1]), self.ids(ahead[-1][1])
            if (n >= len(left) or again[: len(first)] == first) and (n >= len(right) or again[len(again) - len(last) :] == last):
                return [*left[:-n], (text, self.render(again)), *right[n:]]
            n *= 2

    def joined(self, texts: list[str], parts: list[list[tuple]]) -> list[tuple]:
        """Codes of the whole text from those of its chunks.

        The two words at each join are encoded together. Where that gives the sum of their
        codes the chunks stand as they are; other joins are mended.
        """
        done, ended, joins = [], True, []
        for text, part in zip(texts, parts, strict=True):
            glue = " " if ended or tokens.is_space(text[0]) else ""
            ended = tokens.is_space(text[-1]) or not part and glue == " "
            joins.append(glue)
        full = [(p, g) for p, g in zip(parts, joins, strict=True) if p]
        windows = [a[-1][0] + glue + b[0][0] for (a, _), (b, glue) in zip(full, full[1:], strict=False)]
        known = dict(zip(windows, self.memo._whole(windows), strict=True)) if windows else {}
        for part, glue in full:
            if done:
                (left, a), (right, b) = done[-1], part[0]
                again = known.get(left + glue + right) or self.memo._whole([left + glue + right])[0]
                if again != self.ids(a) + self.ids(b):
                    done = self._mended(done, glue, part)
                    continue
                if not glue:  # one word, which a later chunk may go on with
                    done[-1], part = (left + right, self.render(again)), part[1:]
            done += part
        return [code for _, code in done]


def codec(path: str) -> Codec:
    return kept(("codes", path), lambda: Codec(path))


def _find_chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each chunk of a document once, and whether it stands there again."""
    for batch in batches:
        keys, docs, again = [], [], []
        for key, text in zip(batch["doc_key"].to_pylist(), batch["text"], strict=True):
            found = Counter(chunks_of(text.as_py() or "")[1])
            keys += found
            docs += [key] * len(found)
            again += [n > 1 for n in found.values()]
        yield pa.RecordBatch.from_pydict({"chunk": pa.array(keys, pa.binary()), "doc_key": pa.array(docs, pa.int64()), "again": pa.array(again, pa.bool_())})


def _sha256(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def _small(batches: Iterator[pa.RecordBatch], rows: int = 500) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for low in range(0, batch.num_rows, rows):
            yield batch.slice(low, rows)


def encode_documents(docs: DataFrame, tokenizer: str, decoded: bool = False, digest: bool = True) -> DataFrame:
    """(doc_id, ids binary, n_tokens, ids_sha256, decoded_sha256) of every whole text.

    Chunks that occur more than once are encoded once, where they occur first, and their ids
    are joined to the documents that hold them; other chunks are encoded with their document.
    Only hashes of chunks are shuffled to tell which are shared. ids are little-endian
    unsigned 32-bit integers. decoded=True adds their text as decoded; digest=False leaves out
    the two hashes, which are those of the decimal ids, separated by spaces, and of that text.

    Null texts are empty and have no tokens. Rows that repeat a doc_id or have none are
    encoded each by itself. An empty table gives no rows.
    """
    schema = "doc_key long, ids binary, n_tokens long" + ", ids_sha256 string, decoded_sha256 string" * digest + ", decoded string" * decoded

    def encode_shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, packer = codec(tokenizer), zstandard.ZstdCompressor(level=3)
        for batch in batches:
            keys, bodies = [], []
            for text, wanted in zip(batch["text"], batch["owned"].to_pylist(), strict=True):
                wanted = set(wanted)
                for part, key in zip(*chunks_of(text.as_py() or ""), strict=True):
                    if key in wanted:
                        wanted.discard(key)
                        keys.append(key)
                        codes = [c for _, c in coder.encode(part)]
                        ids = [coder.ids(c) for c in codes]
                        ends = [len(ids[0]), len(ids[-1])] if ids else [0, 0]
                        bodies.append(packer.compress(np.array([*ends, *[i for c in ids for i in c]], "<u4").view(np.uint8).reshape(-1, 4).T.tobytes()))
            yield pa.RecordBatch.from_pydict({"chunk": pa.array(keys, pa.binary()), "codes": pa.array(bodies, pa.binary())})

    def unpack(coder: Codec, text: str, body: bytes) -> list[tuple]:
        """(text, code) of a chunk's first word, of what lies between and of its last word."""
        raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(body), np.uint8)
        first, last, *ids = np.ascontiguousarray(raw.reshape(4, -1).T).view("<u4").reshape(-1).tolist()
        items = tokens.words(text)
        if len(items) < 3:
            return list(zip(items, [coder.render(ids[:first]), coder.render(ids[first:])], strict=False))
        middle = (" ".join(items[1:-1]), coder.render(ids[first : len(ids) - last]))
        return [(items[0], coder.render(ids[:first])), middle, (items[-1], coder.render(ids[len(ids) - last :]))]

    def encode_rest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, digits = codec(tokenizer), [str(i) for i in range(len(spellings))]
        for batch in _small(batches):
            out = {"doc_key": batch["doc_key"].to_pylist()} | {name: [] for name in names}
            for text, given in zip(batch["text"], batch["given"].to_pylist(), strict=True):
                given = {x["chunk"]: x["codes"] for x in given or ()}
                texts, keys = chunks_of(text.as_py() or "")
                known: dict[bytes, list] = {}
                parts = []
                for part, k in zip(texts, keys, strict=True):
                    if k in given and k not in known:
                        known[k] = unpack(coder, part, given[k])
                    parts.append(known[k] if k in known else coder.encode(part))
                ids = b"".join(coder.joined(texts, parts))
                out["ids"].append(ids)
                out["n_tokens"].append(len(ids) // 4)
                body = spelt(ids, spellings) if decoded or digest else ""
                if digest:
                    out["ids_sha256"].append(_sha256(spelt(ids, digits)))
                    out["decoded_sha256"].append(_sha256(body))
                if decoded:
                    out["decoded"].append(body)
            yield pa.RecordBatch.from_pydict({name: pa.array(column, _ARROW[name]) for name, column in out.items()})

    spellings = vocabulary(tokenizer)
    names = [column.split()[0] for column in schema.split(", ")][1:]
    (key,) = spare(docs, "_key")
    docs = row_keyed(docs.select("doc_id", "text"), key, ordered=False)
    texts = docs.select(F.col(key).alias("doc_key"), "text")
    found = saved(in_arrow(texts, _find_chunks, "chunk binary, doc_key long, again boolean"))
    shared = found.groupBy("chunk").agg(F.count(F.lit(1)).alias("n"), F.bool_or("again").alias("again"), F.min("doc_key").alias("doc_key")).filter("n > 1 or again")
    owned = shared.groupBy("doc_key").agg(F.collect_list("chunk").alias("owned"))
    encoded = in_arrow(texts.join(owned, "doc_key").select("text", "owned"), encode_shared, "chunk binary, codes binary")
    encoded = written(encoded)  # a plain table, so that a chunk of very many documents is a skewed join, which is dealt anew
    given = found.select("chunk", "doc_key").join(encoded, "chunk").groupBy("doc_key").agg(F.collect_list(F.struct("chunk", "codes")).alias("given"))
    rows = docs.select(F.col(key).alias("row_key"), doc_key().alias("doc_key"), "text").join(given.withColumnRenamed("doc_key", "row_key"), "row_key", "left")
    done = in_arrow(rows.select("doc_key", "text", "given"), encode_rest, schema)
    return done.select(from_key().alias("doc_id"), *names)


def decode_documents(encoded: DataFrame, tokenizer: str, column: str = "ids") -> DataFrame:
    """The rows with the text of their ids, as encode_documents makes them, in a new column decoded.

    Null ids give null, ids of no bytes an empty text; an id beyond the vocabulary is an error.
    """
    columns, names = encoded.columns, vocabulary(tokenizer)
    at = columns.index(column)
    schema = StructType([*encoded.schema.fields, StructField("decoded", StringType())])

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _small(batches):
            texts = [None if ids is None else spelt(ids, names) for ids in batch.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], [*columns, "decoded"])

    return in_arrow(encoded, decode, schema)


def digests(encoded: DataFrame, tokenizer: str) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of rows (doc_id, ids), which are decoded for it."""
    names = vocabulary(tokenizer)

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        digits = [str(i) for i in range(len(names))]
        for batch in _small(batches):
            n, a, b = [], [], []
            for ids in batch["ids"]:
                ids = ids.as_py()
                n.append(len(ids) // 4)
                a.append(_sha256(spelt(ids, digits)))
                b.append(_sha256(spelt(ids, names)))
            yield pa.RecordBatch.from_pydict({"doc_key": batch["doc_key"], "n_tokens": pa.array(n, pa.int64()), "ids_sha256": pa.array(a, pa.string()), "decoded_sha256": pa.array(b, pa.string())})

    keyed = encoded.select(doc_key().alias("doc_key"), "ids")
    done = in_arrow(keyed, digest, "doc_key long, n_tokens long, ids_sha256 string, decoded_sha256 string")
    return done.select(from_key().alias("doc_id"), "n_tokens", "ids_sha256", "decoded_sha256")
