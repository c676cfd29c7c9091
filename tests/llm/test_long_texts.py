"""Whole runs over texts of a million characters, sections by lines, and planes in frames."""

import hashlib
import random

import numpy as np
import pytest
from tokenizers import Tokenizer

from gridweft.llm import chunks, counts, lines, mixing, simhash, substring, token_files, toxicity, wavelet, weighted
from gridweft.llm.common import written

from .test_text import PATH, WORD

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def long_docs(spark):
    """A text of 1.2 million characters, one without any space, and short ones; the long one's first part stands in another too."""
    r = random.Random(11)
    words = ["".join(r.choice("abcdefghijklmnop") for _ in range(r.randint(2, 9))) for _ in range(4000)]
    text = "\n".join(" ".join(r.choice(words) for _ in range(40)) for _ in range(4500))
    assert len(text) > 1_000_000
    rows = [(1, text), (2, text[:60_000]), (3, "x" * 300_000), (4, "short one"), (5, None), (6, "")]
    return written(spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], SCHEMA)), dict(rows)


def test_lines_and_substrings(long_docs):
    docs, texts = long_docs
    found = {r["doc_id"]: r for r in lines.without_repeated_lines(docs, digest=True).collect()}
    assert found[1]["n_removed"] == 0 and found[2]["n_removed"] > 200 and len(found) == 6
    assert found[1]["kept_sha256"] == hashlib.sha256(texts[1].encode()).hexdigest()
    found = {r["doc_id"]: r for r in substring.without_repeats(docs, digest=True).collect()}
    n = len(WORD.findall(texts[2]))
    assert found[1]["n_removed"] == 0 and found[2]["n_words"] == n and found[2]["n_removed"] >= n - 1  # the last word is cut


def test_tokens(spark, long_docs, tmp_path):
    docs, texts = long_docs
    own = Tokenizer.from_file(PATH)
    own.no_padding(), own.no_truncation()
    ids = {i: own.encode(t or "", add_special_tokens=False).ids for i, t in texts.items()}
    found = {r["doc_id"]: r for r in chunks.digests(chunks.encode_documents(docs, PATH, digest=False), PATH).collect()}
    for i, want in ids.items():
        assert found[i]["n_tokens"] == len(want) and found[i]["ids_sha256"] == hashlib.sha256(" ".join(map(str, want)).encode()).hexdigest()
        assert found[i]["decoded_sha256"] == hashlib.sha256(own.decode(want, skip_special_tokens=False).encode()).hexdigest()
    token_files.write_shards(docs, str(tmp_path / "t"), PATH)
    shards = {r["doc_id"]: r for r in token_files.read_shards(spark, str(tmp_path / "t")).collect()}
    for i, want in ids.items():
        assert (shards[i]["n_tokens"], shards[i]["n_ends"], shards[i]["end_at"]) == (len(want) + 1, want.count(2) + 1, len(want))
    by_line = counts.section_counts(docs, None, PATH).collect()
    assert len([r for r in by_line if r["doc_id"] == 1]) == 4500
    assert sum(r["n_tokens"] for r in by_line if r["doc_id"] == 1) == len(ids[1])


def test_fingerprints_scores_and_mixes(spark, long_docs):
    docs, _ = long_docs
    near = {r["doc_id"]: r for r in weighted.against_next(docs).collect()}
    assert len(near) == 6 and near[1]["near_next"] < near[1]["near_edited"]
    assert len({r["fingerprint"] for r in simhash.near_groups(docs).collect()}) == 5
    labels = spark.createDataFrame([(1, 0), (4, 1)], "doc_id long, toxic int")
    assert toxicity.scored(docs, labels).count() == 6
    taken = {r["doc_id"]: r for r in mixing.mix(docs).collect()}
    assert all(r["taken"] <= 3 * r["size"] for r in taken.values()) and abs(sum(r["taken"] for r in taken.values()) - taken[1]["source_size"]) <= 1


def test_lines_of():
    starts, ends = counts.lines_of("a b\n\n \t\nc\x0b\nd")
    assert [(s, e) for s, e in zip(starts.tolist(), ends.tolist(), strict=True)] == [(0, 3), (8, 10), (11, 12)]
    for text, want in (("", [(0, 0)]), ("\n \n", [(0, 3)]), ("é😀", [(0, 2)]), ("\nx", [(1, 2)])):
        starts, ends = counts.lines_of(text)
        assert list(zip(starts.tolist(), ends.tolist(), strict=True)) == want


@pytest.mark.parametrize("frame", [64, 128, 1 << 14])
def test_planes_in_frames(monkeypatch, frame):
    """Accesses unpack the frames that they touch, one of each plane."""
    monkeypatch.setattr(wavelet, "_FRAME", frame)
    ids = np.random.default_rng(3).integers(0, 700, 5000).astype(np.uint16)
    data = wavelet.WaveletMatrix.build(ids, [7], [5000], 10).to_bytes()
    matrix = wavelet.WaveletMatrix.from_bytes(data)
    assert matrix.access(3) == ids[3]
    assert all(len(p.open) <= 2 and p.whole is None for p in matrix.planes)
    assert [matrix.access(i) for i in range(0, 5000, 37)] == ids[::37].tolist()
    assert [matrix.rank(int(t), i) for t, i in ((ids[0], 5000), (ids[9], 4000), (699, 512))] == [int((ids[:i] == t).sum()) for t, i in ((ids[0], 5000), (ids[9], 4000), (699, 512))]
    ends = np.array([0, 1, 511, 512, 513, 4999, 5000])
    for token in (int(ids[5]), 0, 699, 5000):
        assert matrix.rank_many(token, ends).tolist() == [int((ids[:i] == token).sum()) for i in ends]
    again = wavelet.WaveletMatrix.from_bytes(data)
    assert again.to_array().tolist() == ids.tolist()
    assert again.select_many(int(ids[0]), np.arange(2)).tolist() == np.flatnonzero(ids == ids[0])[:2].tolist()
