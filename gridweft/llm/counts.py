"""Token counts of sections by offsets of one encoding of the whole document."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridweft.llm import tokens
from gridweft.llm.common import in_arrow, kept

SECTION_CHARS = 1_000
_SPACES = np.array([9, 10, 11, 12, 13, 32], np.uint32)
_OTHER_SPACES = np.array([0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000], np.uint32)


class SpanMemo(tokens.WordMemo):
    """Of each word, the (start, end) of its tokens in characters of the word, one after the other."""

    def __init__(self, path: str, limit: int = 600_000):
        super().__init__(path, None, limit)

    def _fill(self, missing: set[str]) -> dict:
        items = list(missing)
        encoded = self.tokenizer.encode_batch(items, add_special_tokens=False)
        return {w: np.array(e.offsets, np.uint32).tobytes() for w, e in zip(items, encoded, strict=True)}


def token_spans(path: str, text: str) -> np.ndarray:
    """(tokens, 2) starts and ends in characters of the text, as its encoding's offsets have them."""
    items = tokens.words(text)
    if not items:
        return np.empty((0, 2), np.int64)
    spans = kept(("spans", path), lambda: SpanMemo(path)).lookup(items)
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    blank = np.isin(codes, _SPACES)
    if not tokens.has_control(text):
        blank |= np.isin(codes, _OTHER_SPACES)
    inside = np.concatenate([[False], ~blank, [False]])
    starts = np.flatnonzero(inside[1:] & ~inside[:-1])
    per_word = np.fromiter(map(len, spans), np.int64, len(spans)) // 8
    relative = np.frombuffer(b"".join(spans), np.uint32).reshape(-1, 2).astype(np.int64)
    return relative + np.repeat(starts, per_word)[:, None]


def allocate(spans: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(section of each token or -1, whether it crosses a boundary) for sorted sections that don't overlap.

    Interval join of tokens and sections: a token belongs to the section that holds most of
    its characters, on ties to the earlier one, and to none if it lies between sections.
    """
    first = np.searchsorted(ends, spans[:, 0], side="right")
    last = np.searchsorted(starts, np.maximum(spans[:, 1] - 1, spans[:, 0]), side="right") - 1
    own = np.where(first == last, first, -1)
    several = np.flatnonzero(last > first)
    for k in several.tolist():
        at = np.arange(first[k], last[k] + 1)
        held = np.minimum(ends[at], spans[k, 1]) - np.maximum(starts[at], spans[k, 0])
        own[k] = at[np.argmax(held)]
    some = own >= 0
    crossing = np.zeros(len(spans), bool)
    crossing[some] = (spans[some, 0] < starts[own[some]]) | (spans[some, 1] > ends[own[some]])
    return own, crossing


def even_sections(length: Column, chars: int = SECTION_CHARS) -> Column:
    """array<struct<start,end>> of consecutive sections of so many characters; one at least."""
    length = F.coalesce(length, F.lit(0))
    return F.transform(F.sequence(F.lit(0), F.greatest(F.lit(0), F.floor((length - 1) / chars)).cast("int")), lambda k: F.struct((k * chars).alias("start"), F.least((k + 1) * chars, length).alias("end")))


def lines_of(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of a text's lines that hold more than white space, without their line feeds; of all the text if there are none."""
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    breaks = np.flatnonzero(codes == 10)
    starts, ends = np.append(0, breaks + 1), np.append(breaks, len(codes))
    filled = np.append(0, np.cumsum(~np.isin(codes, _SPACES)))
    some = filled[ends] > filled[starts]
    return (starts[some], ends[some]) if some.any() else (np.zeros(1, np.int64), np.full(1, len(codes)))


def section_counts(docs: DataFrame, sections: Column | None, tokenizer: str) -> DataFrame:
    """(doc_id, section, start, end, n_tokens, n_crossing): tokens of each section of each whole text.

    `sections` is an array<struct<start,end>> of character spans over docs(doc_id, text),
    sorted, not overlapping; gaps are allowed and their tokens count for no section. None
    stands for the lines of each text, those without words left out (lines_of). Each
    document is encoded once; tokens are given out by their character offsets (see allocate),
    and n_crossing of those counted reach over a boundary of the section.

    A null text is empty: its sections have no tokens. A null section list gives no rows; a
    null doc_id and rows that repeat are kept as they are. An empty table gives no rows.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = [None] * batch.num_rows if by_line else batch["sections"]
            parts = [[] for _ in range(6)]
            for doc, text, spans in zip(batch["doc_id"].to_pylist(), batch["text"], lists, strict=True):
                if by_line:
                    starts, ends = lines_of(text.as_py() or "")
                elif not spans.is_valid or not len(spans.values):
                    continue
                else:
                    starts, ends = (spans.values.field(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in (0, 1))
                n = len(starts)
                own, crossing = allocate(token_spans(tokenizer, text.as_py() or ""), starts, ends)
                parts[0].append(pa.array([doc] * n, pa.int64()))
                parts[1].append(np.arange(n, dtype=np.int32))
                parts[2].append(starts.astype(np.int32))
                parts[3].append(ends.astype(np.int32))
                parts[4].append(np.bincount(own[own >= 0], minlength=n))
                parts[5].append(np.bincount(own[crossing], minlength=n))
            if parts[0]:
                docs_, *rest = parts
                yield pa.RecordBatch.from_arrays([pa.concat_arrays(docs_), *[pa.array(np.concatenate(p)) for p in rest]], ["doc_id", "section", "start", "end", "n_tokens", "n_crossing"])

    by_line = sections is None
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", *([] if by_line else [sections.alias("sections")]))
    return in_arrow(rows, count, "doc_id long, section int, start int, end int, n_tokens long, n_crossing long")
