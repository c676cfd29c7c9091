"""Operators on texts against brute force, over texts and ids of every kind."""

import hashlib
import random
import re
import tracemalloc
import zlib
from collections import Counter

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from gridweft.llm import chunks, counts, lines, simhash, substring, token_files, tokens, weighted
from gridweft.llm.wavelet import WaveletMatrix

PATH = tokens.default_tokenizer()
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def by_id(df):
    return {r["doc_id"]: r for r in df.collect()}


def ordered(table):
    return sorted(table, key=lambda r: -(2**63) if r[0] is None else r[0])


def encoded(text):
    return tokens.load(PATH).encode(text or "", add_special_tokens=False).ids


# -- words --


def test_memo_agrees_with_the_library():
    memo, r = tokens.memo(PATH, "H"), random.Random(2)
    letters = [chr(c) for c in [*range(33, 127), *range(0xA1, 0x180), 0x301, 0x3B1, 0x130, 0x1F600]] + list("abcdeett''..,,") * 20
    items = ["".join(r.choice(letters) for _ in range(r.randint(1, 12))) for _ in range(5000)]
    assert [np.frombuffer(x, "<u2").tolist() for x in memo.lookup(items)] == [encoded(x) for x in items]
    small = tokens.WordMemo(PATH, tuple, limit=3)
    assert [list(x) for x in small.lookup(items[:50])] == [encoded(x) for x in items[:50]]


# -- 1: lines --


def brute_lines(table, m=lines.MIN_LINES):
    seen, gone = set(), {}
    every = [(i, [x for x in (t or "").split("\n") if x.strip(" \t\r\v\f")]) for i, t, *_ in ordered(table)]
    for i, found in every:
        gone[i] = set()
        for k, line in enumerate(found):
            if len(line) >= lines.LONG_LINE:
                if (line,) in seen:
                    gone[i].add(k)
                seen.add((line,))
            if k + m <= len(found):
                run = tuple(found[k : k + m])
                if run in seen:
                    gone[i].update(range(k, k + m))
                seen.add(run)
    return gone


def kept_lines(text, gone):
    out, k = [], 0
    for line in text.split("\n"):
        if line.strip(" \t\r\v\f"):
            k += 1
            if k - 1 in gone:
                continue
        out.append(line)
    return "\n".join(out)


@pytest.mark.parametrize("m", [2, 3])
def test_line_dedup(docs, table, m):
    gone, found = brute_lines(table, m), by_id(lines.without_repeated_lines(docs, m))
    assert len(found) == len(table)
    for i, text, *_ in table:
        assert found[i]["kept"] == (kept_lines(text, gone[i]) if text else text)
        assert found[i]["n_removed"] == len(gone[i])
    assert found[1008]["longest_repeat"] == 39


def test_line_dedup_of_whole_rows(wide, table):
    gone, found = brute_lines(table), by_id(lines.deduplicated(wide))
    assert set(found[0].asDict()) == set(wide.columns)
    for i, text, *_ in table:
        assert found[i]["text"] == (kept_lines(text, gone[i]) if text else text)
        assert found[i]["n_chars"] == (len(found[i]["text"]) if text is not None else None)


def test_suffix_array_order(spark, docs, table):
    array = lines.SuffixArray(docs)
    found = [(r["doc_key"], r["line"], r["lcp"]) for r in array.common().orderBy("index").collect()]
    texts = {(-(2**63) if i is None else i): [x for x in (t or "").split("\n") if x.strip(" \t\r\v\f")] for i, t, *_ in table}
    suffix = lambda d, k: texts[d][k:]
    for (d, k, _), (e, j, lcp) in zip(found, found[1:], strict=False):
        a, b, n = suffix(d, k), suffix(e, j), 0
        while n < min(len(a), len(b)) and a[n] == b[n]:
            n += 1
        assert n == lcp
    seen = Counter(x for t in texts.values() for x in t)
    assert len(found) == sum(n for n in seen.values() if n > 1)


# -- 3: SimHash --


def brute_fingerprint(text):
    text = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = WORD.findall(text)
    if not words:
        return 0
    shingles = [" ".join(words[k : k + 3]) for k in range(len(words) - 2)] or [" ".join(words)]
    ones = [0] * 64
    for s in shingles:
        h = xxhash.xxh64_intdigest(s.encode(), 42)
        for k in range(64):
            ones[k] += h >> k & 1
    return sum(1 << k for k in range(64) if 2 * ones[k] > len(shingles))


def brute_components(fps):
    root = {i: i for i in fps}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    items = list(fps.items())
    for a, (i, x) in enumerate(items):
        for j, y in items[:a]:
            if bin(x ^ y).count("1") <= 3:
                root[find(i)] = find(j)
    groups = {}
    for i in fps:
        groups.setdefault(find(i), []).append(i)
    return {i: min((x for x in g if x is not None), default=None) for g in groups.values() for i in g}


def test_simhash(docs, table):
    found = by_id(simhash.near_groups(docs))
    fps = {i: brute_fingerprint(t) for i, t, *_ in table}
    assert {i: int(r["fingerprint"], 16) for i, r in found.items()} == fps
    assert {i: r["component_id"] for i, r in found.items()} == brute_components(fps)


def test_golay_keys_miss_nothing():
    r = np.random.default_rng(3)
    a = r.integers(-(2**63), 2**63 - 1, 4000, dtype=np.int64)
    b = a.copy()
    for k in range(len(b)):
        for bit in r.choice(64, r.integers(0, 4), replace=False):
            b[k] ^= np.uint64(1 << int(bit)).view(np.int64)

    def sets(fps, probe):
        out = [set() for _ in fps]
        for row, key in zip(*(x.tolist() for x in simhash.keys(fps, probe)), strict=True):
            out[row].add(key)
        return out

    assert all(x & y for x, y in zip(sets(a, False), sets(b, True), strict=True))
    table, there = simhash._patterns()
    assert set(there.sum(1).tolist()) == {1, 6}


def test_chains_and_one_of_each(spark, wide, table):
    fps = [0, 0b111, 0b111111, 0b111111111, 1 << 60, -1]
    df = spark.createDataFrame([(x,) for x in fps], "fp long")
    found = {(r["a"], r["b"]) for r in simhash.links(df).collect()}
    assert found == {(0, 7), (7, 63), (63, 511), (0, 1 << 60)}
    kept = simhash.without_near_copies(wide.union(wide)).collect()
    fps = {i: brute_fingerprint(t) for i, t, *_ in table}
    assert sorted((r["doc_id"] for r in kept if r["doc_id"] is not None)) == sorted(x for x in set(brute_components(fps).values()) if x is not None)


def test_rows_without_ids_or_with_one_id_are_members_each_by_itself(spark):
    r = random.Random(8)
    texts = [" ".join("".join(r.choice("abcdefgh") for _ in range(5)) for _ in range(40)) for _ in range(9)]
    rows = [(None, t) for t in texts[:5]] + [(None, texts[0]), (7, texts[5]), (7, texts[6]), (7, texts[6]), (9, texts[6]), (None, texts[7]), (4, texts[7]), (3, texts[8]), (None, None), (None, "")]
    kept = simhash.without_near_copies(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((x["doc_id"] or 0, x["text"]) for x in kept if x["text"]) == sorted([*[(0, t) for t in texts[:5]], (7, texts[5]), (7, texts[6]), (4, texts[7]), (3, texts[8])])
    assert len(kept) == 10


# -- 4: BPE --


def test_bpe(docs, table):
    t = tokens.load(PATH)
    found = by_id(chunks.encode_documents(docs, PATH))
    for i, text, *_ in table:
        ids = encoded(text)
        assert (found[i]["n_tokens"], found[i]["ids_sha256"], found[i]["decoded_sha256"]) == (len(ids), sha(" ".join(map(str, ids))), sha(t.decode(ids, skip_special_tokens=False))), i


def test_bpe_of_repeated_rows(docs, table):
    found = chunks.encode_documents(docs.union(docs), PATH).groupBy("doc_id", "ids_sha256").count().collect()
    assert len(found) == len(table) and {r["count"] for r in found} == {2}


def test_bpe_returns_ids_and_their_text(docs, table):
    t = tokens.load(PATH)
    found = chunks.encode_documents(docs, PATH, decoded=True, digest=False)
    assert found.columns == ["doc_id", "ids", "n_tokens", "decoded"]
    found = by_id(found)
    decoded = by_id(chunks.decode_documents(chunks.encode_documents(docs, PATH), PATH))
    for i, text, *_ in table:
        ids = encoded(text)
        assert np.frombuffer(found[i]["ids"], "<u4").tolist() == np.frombuffer(decoded[i]["ids"], "<u4").tolist() == ids
        assert found[i]["decoded"] == decoded[i]["decoded"] == t.decode(ids, skip_special_tokens=False)


def test_joins_are_mended():
    coder, r = chunks.codec(PATH), random.Random(4)
    for text in ["hello world's fée 12ab, <|endoftext|>x y  z w été " * 3, "abcdefgh" * 40 + " tail", "\x1cab\x1d c"]:
        for _ in range(40):
            cuts = sorted(r.sample(range(1, len(text)), min(len(text) - 1, r.randint(1, 9))))
            parts = [text[a:b] for a, b in zip([0, *cuts], [*cuts, len(text)], strict=True)]
            assert [i for c in coder.joined(parts, [coder.encode(p) for p in parts]) for i in coder.ids(c)] == encoded(text)


def test_chunks_follow_content():
    r = random.Random(6)
    body = " ".join("".join(r.choice("abcdef") for _ in range(6)) for _ in range(20_000))
    cuts = chunks.cut_points(body.encode())
    assert cuts[-1] == len(body) and all(a < b for a, b in zip(cuts, cuts[1:], strict=False))
    shifted = set(chunks.chunks_of("prefix " + body)[1])
    assert len(shifted & set(chunks.chunks_of(body)[1])) > 0.9 * len(cuts)
    whole = chunks.chunks_of("é" * 30_000)[0]
    assert "".join(whole) == "é" * 30_000 and max(len(x.encode()) for x in whole) <= chunks.MAX_CHUNK


# -- 5: weighted sampling --


def jaccard(a, b):
    a, b = Counter(tokens.words(a)), Counter(tokens.words(b))
    total = sum(max(a[x], b[x]) for x in a | b)
    return sum(min(a[x], b[x]) for x in a | b) / total if total else 1.0


def test_weighted_fingerprints(docs, table):
    found = by_id(weighted.against_next(docs))
    prints = by_id(weighted.fingerprints(docs))
    down = list(reversed(ordered(table)))
    errors = []
    for k, (i, text, *_) in enumerate(down):
        text, after = text or "", down[(k + 1) % len(down)][1] or ""
        n = len(text) // 3
        edited = text[: len(text) - n] + after[:n]
        row = found[i]
        assert (row["n_chars"], row["edited_sha256"], row["fingerprint"]) == (len(text), sha(edited), prints[i]["fingerprint"])
        errors += [row["near_edited"] - jaccard(text, edited), row["near_next"] - jaccard(text, after)]
    assert abs(np.mean(errors)) < 0.02 and np.max(np.abs(errors)) < 0.25
    assert found[1003]["fingerprint"] == found[1004]["fingerprint"]


def test_one_row_is_its_own_next(spark):
    (row,) = weighted.against_next(spark.createDataFrame([(5, "a b c d e f")], "doc_id long, text string")).collect()
    assert row["near_next"] == 1.0


@pytest.mark.parametrize("bits", [4, 19])
def test_samples_are_the_least_of_all_keys(monkeypatch, bits):
    """Also where few keys are below a text's limit, none is kept, or a word is most of its text."""
    monkeypatch.setattr(weighted, "_KEPT_BITS", bits)
    sampler, r = weighted.Sampler(), random.Random(3)
    texts = [" ".join([f"w{int(r.paretovariate(0.4)) % 50_000}" for _ in range(n)] + ["the"] * m) for n in (0, 1, 9, 79, 80, 81, 160, 400, 3000, 9000) for m in (0, 1, 700)]
    hashes = weighted.terms(texts)
    for some in (hashes[:17], hashes, hashes[::-1]):
        for signature, words in zip(sampler.signatures(some), some, strict=True):
            terms, weights = np.unique(words, return_counts=True)
            keys = weighted.sample_keys(terms, weights)
            least = keys[np.argmin(keys, axis=0), np.arange(weighted.SAMPLES)] if len(keys) else np.full(weighted.SAMPLES, 2**64 - 1, np.uint64)
            assert signature.tolist() == (least >> np.uint64(16) & np.uint64(0xFFFF)).tolist()


def test_few_keys_are_looked_at():
    """A text of 50,000 known terms has 51 MB of keys, nearly all of them beyond its samples."""
    sampler, text = weighted.Sampler(), " ".join(map(str, range(50_000)))
    first = sampler.signatures(weighted.terms([text]))
    tracemalloc.start()
    assert (sampler.signatures(weighted.terms([text])) == first).all()
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 50_000 * weighted.SAMPLES * 8 / 2


def test_terms_of_texts_hashed_together():
    r = random.Random(8)
    texts = ["".join(r.choice("ab\xe9\xa0 \x1c\n\t\x0b") for _ in range(r.randint(0, 12))) for _ in range(400)] + ["a b " * 40_000, "", "c"]
    of = {w: substring.word_hashes(w.encode(), 1)[0][0] for text in texts for w in set(WORD.findall(text))}
    for text, found in zip(texts, weighted.terms(texts), strict=True):
        assert found.tolist() == [of[w] for w in WORD.findall(text)]


# -- 6: token files --


def test_token_files(spark, docs, table, tmp_path):
    token_files.write_shards(docs, str(tmp_path / "t"), PATH, shard_ids=500)
    found = by_id(token_files.read_shards(spark, str(tmp_path / "t")))
    at, places = 0, []
    for i, text, *_ in ordered(table):
        ids = [*encoded(text), token_files.END_ID]
        assert (found[i]["start"], found[i]["n_tokens"], found[i]["ids_crc32"]) == (at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        at += len(ids)
        places += [(i, k) for k, x in enumerate(ids) if x == encoded("header")[0]]
    hits = [(r["doc_id"], r["place"]) for r in token_files.find_token(spark, str(tmp_path / "t"), encoded("header")[0]).collect()]
    assert sorted(hits, key=str) == sorted(places, key=str)


@pytest.mark.parametrize(("n", "top"), [(0, 10), (1, 10), (511, 3), (5000, 49_408), (3000, 100_000)])
def test_wavelet_matrix(n, top):
    r = np.random.default_rng(n)
    ids = (r.zipf(1.3, n) % top).astype(np.uint16 if top < 65_536 else np.uint32)
    matrix = WaveletMatrix.from_bytes(WaveletMatrix.build(ids, [7], [n], max(1, (top - 1).bit_length())).to_bytes())
    assert (matrix.to_array() == ids).all() and matrix.docs.tolist() == [7]
    for k in r.integers(0, max(1, n), 20).tolist() if n else ():
        assert matrix.access(k) == ids[k]
        token = int(ids[k])
        assert matrix.rank(token, k) == (ids[:k] == token).sum()
        where = np.flatnonzero(ids == token)
        assert matrix.count(token) == len(where)
        assert matrix.select(token, len(where) - 1) == where[-1]
    assert matrix.count(1 << 30) == 0
    with pytest.raises(IndexError):
        matrix.select(0, n + 1)


# -- 7: substrings --


def test_substring_dedup(docs, table):
    seen, wanted = set(), {}
    for i, text, *_ in ordered(table):
        words = WORD.findall(text or "")
        gone = [False] * len(words)
        for k in range(len(words) - substring.WINDOW + 1):
            run = tuple(words[k : k + substring.WINDOW])
            if run in seen:
                gone[k : k + substring.WINDOW] = [True] * substring.WINDOW
            seen.add(run)
        wanted[i] = (len(words), sum(gone), " ".join(w for w, g in zip(words, gone, strict=True) if not g))
    found = by_id(substring.without_repeats(docs))
    assert {i: (r["n_words"], r["n_removed"], r["kept"]) for i, r in found.items()} == wanted
    digests = by_id(substring.without_repeats(docs, digest=True))
    assert {i: r["kept_sha256"] for i, r in digests.items()} == {i: sha(w[2]) for i, w in wanted.items()}
    assert wanted[1006][1] > 200


@pytest.mark.parametrize("copies", [1, 2])
def test_substring_dedup_deals_texts_once(spark, table, tmp_path, copies):
    spark.createDataFrame([r[:2] for r in table[:20]], "doc_id long, text string").write.parquet(str(tmp_path / "docs"))
    few = spark.read.parquet(str(tmp_path / "docs"))
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        found = substring.without_repeats(few if copies == 1 else few.union(few), digest=True)
        assert len(found.collect()) == 20 * copies
        assert "ReusedExchange" in found._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_every_pair_of_windows_shares_an_anchor():
    for i in range(substring.PERIOD):
        for j in range(substring.PERIOD):
            assert any((i + d) % substring.PERIOD in substring.COVER and (j + d) % substring.PERIOD in substring.COVER for d in range(substring.PERIOD))


# -- 8: token counts --


def test_token_counts(docs, table):
    sections = counts.even_sections(F.length(F.coalesce("text", F.lit(""))), 50)
    found = {}
    for r in counts.section_counts(docs, sections, PATH).collect():
        found[r["doc_id"], r["section"]] = (r["start"], r["end"], r["n_tokens"], r["n_crossing"])
    t, wanted = tokens.load(PATH), {}
    for i, text, *_ in table:
        text = text or ""
        bounds = [(k, min(k + 50, len(text))) for k in range(0, max(1, len(text)), 50)]
        n, crossing = [0] * len(bounds), [0] * len(bounds)
        for s, e in t.encode(text, add_special_tokens=False).offsets:
            held = [max(0, min(e, b) - max(s, a)) for a, b in bounds]
            own = held.index(max(held))
            n[own] += 1
            crossing[own] += s < bounds[own][0] or e > bounds[own][1]
        wanted |= {(i, k): (*b, n[k], crossing[k]) for k, b in enumerate(bounds)}
    assert found == wanted


def test_allocation_rule():
    spans = np.array([[0, 4], [4, 8], [8, 12], [13, 14], [15, 25]])
    own, crossing = counts.allocate(spans, np.array([0, 6, 15, 18]), np.array([6, 12, 18, 30]))
    assert own.tolist() == [0, 0, 1, -1, 3]
    assert crossing.tolist() == [False, True, False, False, True]


# -- rows of one doc_id --


def rows_of_one_id():
    """Rows without ids and rows of one id, with repeated and unique texts at the same places, in the order in which they count."""
    r = random.Random(9)
    line = lambda k: " ".join("".join(r.choice("abcdefgh") for _ in range(12)) for _ in range(k))
    shared, again = [line(22), line(22)], [line(30), line(3)]
    texts = ["\n".join(["x" + line(4), *shared, line(25)]), "\n".join(["y" + line(4), *shared, line(25)]), "\n".join([line(30), *[line(24) for _ in range(5)]]), "\n".join([*again, line(25)])]
    return [(i, t) for i in (None, 5) for t in texts] + [(1, "\n".join([line(4), *again, *shared])), (9, line(40))]


def test_rows_of_one_id_are_documents_of_their_own(spark):
    rows = rows_of_one_id()
    for df in (spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(rows, "doc_id long, text string").repartition(3)):
        for found in (lines.without_repeated_lines(df).collect(), substring.without_repeats(df).collect()):
            assert sorted(str(r["doc_id"]) for r in found) == sorted(str(i) for i, _ in rows)
            kept = [(r["doc_id"], w) for r in found for w in r["kept"].split()]
            # the first rows have no ids; what they share goes once from one of them, and all of it from later rows
            assert Counter(w for _, w in kept) == Counter({w: 1 for _, t in rows for w in t.split()})
            assert {w for i, w in kept if i is None} == {w for i, t in rows for w in t.split() if i is None}
    whole = lines.deduplicated(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert len(whole) == len(rows)
    assert Counter(w for r in whole for w in r["text"].split()) == Counter({w: 1 for _, t in rows for w in t.split()})


def test_rows_without_ids_are_encoded_each_by_itself(spark, tmp_path):
    rows = rows_of_one_id() + [(None, None), (None, ""), (None, "alone"), (5, "alone")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    ids = Counter((i, sha(" ".join(map(str, encoded(t or ""))))) for i, t in rows)
    assert Counter((r["doc_id"], r["ids_sha256"]) for r in chunks.encode_documents(df, PATH).collect()) == ids
    token_files.write_shards(df, str(tmp_path / "n"), PATH, shard_ids=300)
    shards = sorted(token_files.read_shards(spark, str(tmp_path / "n")).collect(), key=lambda r: r["start"])
    with_end = [(i, [*encoded(t or ""), token_files.END_ID]) for i, t in rows]
    assert Counter((r["doc_id"], r["n_tokens"], r["ids_crc32"]) for r in shards) == Counter((i, len(x), zlib.crc32(np.array(x, "<u4").tobytes())) for i, x in with_end)
    assert [r["start"] for r in shards] == np.cumsum([0, *[r["n_tokens"] for r in shards]])[:-1].tolist()
    assert [r["doc_id"] for r in shards] == sorted([i for i, _ in rows], key=lambda i: (i is not None, i or 0))
    pairs = weighted.against_next(df).collect()
    assert Counter((r["doc_id"], r["n_chars"]) for r in pairs) == Counter((i, len(t or "")) for i, t in rows)
    prints = Counter((r["doc_id"], r["fingerprint"]) for r in weighted.fingerprints(df).collect())
    assert Counter((r["doc_id"], r["fingerprint"]) for r in pairs) == prints


def test_very_long_texts():
    """Beyond the steps in which long texts are taken."""
    r = random.Random(12)
    words = ["".join(r.choice("abcdefgh") for _ in range(r.randint(2, 9))) for _ in range(230_000)]
    text = " ".join(words)
    assert len(text) > substring._SEGMENT and len(words) > simhash._CHUNK
    parts, _ = chunks.chunks_of(text)
    assert "".join(parts) == text and max(map(len, parts)) <= chunks.MAX_CHUNK
    (whole,) = substring.word_hashes(text.encode(), 1)
    for k in (0, 5, 120_000, 229_999):
        assert whole[k] == substring.word_hashes(words[k].encode(), 1)[0][0]
    assert len(whole) == len(words)
    digests = np.frombuffer(b"".join(xxhash.xxh64_digest(" ".join(words[k : k + 3]).encode(), 42) for k in range(len(words) - 2)), np.uint8).reshape(-1, 8)
    ones = np.unpackbits(digests, axis=1).sum(0, dtype=np.int64)
    assert simhash.fingerprint(text) % 2**64 == int("".join("1" if 2 * n > len(digests) else "0" for n in ones), 2)


# -- empty tables and clashing names --


def test_empty_tables(spark, empty, tmp_path):
    sections = counts.even_sections(F.length("text"))
    token_files.write_shards(empty, str(tmp_path / "e"), PATH)
    for df in (
        lines.without_repeated_lines(empty), lines.deduplicated(empty), simhash.near_groups(empty), simhash.without_near_copies(empty), chunks.encode_documents(empty, PATH),
        weighted.against_next(empty), weighted.fingerprints(empty), token_files.read_shards(spark, str(tmp_path / "e")), substring.without_repeats(empty), counts.section_counts(empty, sections, PATH),
    ):
        assert df.count() == 0


def test_clashing_names(spark, docs, wide, table, tmp_path):
    """Columns of a user's table that operators use inside change no value."""
    sections = counts.even_sections(F.length("text"))

    def same(make):
        narrow, broad = ({tuple(str(x) for x in r) for r in make(df).collect()} for df in (docs, wide))
        return len(narrow) > 1 and narrow == broad

    def shards(df):
        path = str(tmp_path / f"c{len(df.columns)}")
        token_files.write_shards(df, path, PATH)
        return token_files.read_shards(spark, path)

    for make in (lines.without_repeated_lines, simhash.near_groups, lambda df: chunks.encode_documents(df, PATH), weighted.against_next, substring.without_repeats, shards, lambda df: counts.section_counts(df, sections, PATH)):
        assert same(make)
