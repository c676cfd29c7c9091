"""Search, toxicity, mixing and the pipeline against brute force or held-out labels."""

import random
import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridweft.llm import mixing, topk, toxicity

from .test_text import WORD, brute_components, brute_fingerprint, brute_lines, by_id, encoded, kept_lines, sha

# -- 2: top k --


def vectors(seed=1, n=400, dim=8):
    r = random.Random(seed)
    out = [(k, [r.gauss(0, 1) for _ in range(dim)]) for k in range(n)]
    out += [(n + k, out[50][1]) for k in range(120)]
    out += [(5000, None), (5001, [1.0, None] + [0.0] * (dim - 2)), (5002, [float("nan")] * dim), (5003, [float("inf")] * dim), (5004, [1.0]), (5005, []), (None, [1.0] * dim)]
    return out


def brute_top(rows, k, every=50):
    """(query_id, rank, vec_id, score) of each query row against all other rows of its length."""
    good = [(i, np.floor(256 * np.array(v)).astype(int)) for i, v in rows if i is not None and v and all(x is not None and np.isfinite(x) for x in v)]
    out = []
    for n, (q, v) in enumerate(good):
        if q % every == 0:
            best = sorted((-int(v @ w), i) for m, (i, w) in enumerate(good) if m != n and len(w) == len(v))[:k]
            out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(best)]
    return sorted(out)


@pytest.mark.parametrize("k", [1, 5])
def test_exact_top_k(spark, monkeypatch, k):
    monkeypatch.setattr(topk, "BLOCK", 150)
    monkeypatch.setattr(topk, "QUERY_BLOCK", 4)
    rows = vectors()
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("home", F.lit("x")).withColumn("row", F.lit(1))
    found = topk.nearest(df, F.col("vec_id") % 50 == 0, k)
    assert sorted(tuple(r) for r in found.collect()) == brute_top(rows, k)


def test_repeated_ids_and_several_lengths(spark):
    r = random.Random(4)
    rows = [(i % 120, [r.gauss(0, 1) for _ in range(n)]) for i, n in enumerate([6] * 200 + [3] * 90 + [1])]
    rows += rows[:30]
    found = topk.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("vec_id") % 50 == 0)
    assert sorted(tuple(r) for r in found.collect()) == brute_top(rows, 5)


def test_vectors_in_clusters_are_eliminated(spark):
    """What the bound leaves out changes nothing, and it does leave out most of what is far."""
    r = np.random.default_rng(3)
    centres = r.normal(0, 40, (12, 16))
    x = (centres[r.integers(0, 12, 1500)] + r.normal(0, 0.5, (1500, 16))).astype(int)
    table = topk.spread_out(x, 12)
    norms, apart = (x * x).sum(1), topk._distances(x, table).astype(np.float32)
    numbers = np.arange(len(x))
    block, query = (numbers, numbers, x, norms, apart), tuple(a[:40] for a in (numbers, numbers, x, norms, apart))
    for at, places, scores in topk._best(query, block, np.full(40, np.iinfo(np.int64).min), 5):
        every = x @ x[at]
        every[at] = -(2**62)
        best = np.lexsort((numbers, -every))[:5]
        assert places.tolist() == best.tolist() and scores.tolist() == every[best].tolist()
    gap = np.abs(apart[:40, None, :] - apart[None]).max(2).astype(float)
    bounds = (norms[:40, None] + norms[None] - gap**2) / 2
    kth = np.sort(x[:40] @ x.T, axis=1)[:, -6]
    assert (bounds >= kth[:, None]).mean() < 0.5


def test_few_vectors(spark):
    schema = "vec_id long, embedding array<double>"
    assert topk.nearest(spark.createDataFrame([], schema), F.col("vec_id") % 50 == 0).count() == 0
    assert topk.nearest(spark.createDataFrame([(0, [1.0, 2.0])], schema), F.col("vec_id") % 50 == 0).count() == 0
    two = topk.nearest(spark.createDataFrame([(0, [1.0, 2.0]), (1, [0.5, 0.0])], schema), F.col("vec_id") % 50 == 0).collect()
    assert [tuple(r) for r in two] == [(0, 1, 1, 256 * 128)]


# -- 9: toxicity --


def talk(seed=2, n=1200):
    r = random.Random(seed)
    words = ["".join(r.choice("abcdefghijklm") for _ in range(r.randint(3, 8))) for _ in range(300)]
    docs, labels = [], []
    for k in range(n):
        text = [r.choice(words) for _ in range(r.randint(5, 60))]
        bad = r.random() < 0.15
        if bad:
            for _ in range(r.randint(1, 3)):
                text.insert(r.randrange(len(text)), r.choice(["vile", "rotten", "zzqqworm", "zzqqslug"]))
        docs.append((k, " ".join(text).capitalize() + "."))
        if r.random() < 0.6:
            labels.append((k, int(bad)))
    docs += [(5000, None), (5001, ""), (None, "vile rotten")]
    labels += [(5001, 0), (5000, None), (None, 1), (77_777, 1), (3, 9)]
    return docs, labels


def test_toxicity_on_held_out_rows(spark):
    docs, labels = talk()
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumn("term", F.lit("t"))
    found = by_id(toxicity.scored(df, spark.createDataFrame(labels, "doc_id long, toxic int")))
    assert len(found) == len(docs)
    held = [(found[i]["score"], y) for i, y in labels if i in found and y in (0, 1) and i is not None and zlib.crc32(str(i).encode()) % 4 == 2]
    assert len(held) > 100
    hit = [(s >= toxicity.THRESHOLD) == bool(y) for s, y in held]
    assert sum(hit) / len(hit) > 0.97
    assert all(0 <= r["score"] <= 1 for r in found.values())
    assert found[5000]["score"] == found[5001]["score"] < toxicity.THRESHOLD < found[None]["score"]
    taught = {i for i, y in labels if i is not None and zlib.crc32(str(i).encode()) % 4 != 2}
    assert all(set(r["evidence"]) <= taught for r in found.values())


def test_labels_that_may_not_be_learnt_change_nothing(spark):
    docs, labels = talk(n=300)
    flipped = [(i, 1 - y if i is not None and y in (0, 1) and zlib.crc32(str(i).encode()) % 4 == 2 else y) for i, y in labels]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    a, b = (by_id(toxicity.scored(df, spark.createDataFrame(x, "doc_id long, toxic int"))) for x in (labels, flipped))
    assert {i: r["score"] for i, r in a.items()} == {i: r["score"] for i, r in b.items()}


def test_toxicity_without_labels_or_rows(spark, empty):
    none = spark.createDataFrame([], "doc_id long, toxic int")
    docs = spark.createDataFrame(talk(n=20)[0], "doc_id long, text string")
    assert {r["score"] for r in toxicity.scored(docs, none).collect()} == {0.0}
    assert toxicity.without_toxic(docs, none).count() == docs.count()
    assert toxicity.scored(empty, none).count() == 0


@pytest.mark.parametrize("terms", [20, 3000])
def test_index_finds_the_nearest(terms):
    r = np.random.default_rng(1)
    often = np.minimum(1, 8 / np.arange(1, terms + 1) ** 0.8)  # some lists are arrays, others postings
    v = np.where(r.random((900, terms)) < often / 3, r.random((900, terms)).round(1), 0)
    v[700:] = v[:200]  # ties
    v /= np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-9)
    at = np.nonzero(v)
    index = toxicity.BlockMaxIndex(*at, v[at], terms, r.integers(0, 2, 900), np.arange(900), np.ones(900))
    assert (index.row >= 0).any() and (index.row < 0).any() == (terms > 20)
    queries = []
    for _ in range(200):
        mine = np.sort(r.choice(terms, min(terms // 4, 300), replace=False, p=often / often.sum()))
        q = r.random(len(mine)) ** 8
        queries.append((mine, q / np.linalg.norm(q)))
    queries.append((np.empty(0, np.int64), np.empty(0)))
    found = index.nearest(queries[:64], 7, list(range(64))) + index.nearest(queries[64:], 7, list(range(64, 201)))
    for n, ((mine, q), (places, cosines)) in enumerate(zip(queries[:200], found, strict=False)):
        scores = v[:, mine] @ q
        assert n not in index.ids[places]
        assert np.allclose(cosines, scores[index.ids[places]], atol=2e-6)
        rest = np.delete(scores, [n, *index.ids[places].tolist()])
        assert len(places) == 7 and rest.max() <= cosines[-1] + 2e-6
        assert all((-a, i) < (-b, j) for a, b, i, j in zip(cosines, cosines[1:], index.ids[places], index.ids[places][1:], strict=False))
    assert len(found) == 201 and len(found[200][0]) == 0
    assert all(len(places) == 0 for places, _ in index.nearest(queries[200:] * 2, 7))


def test_every_word_of_the_examples_counts(spark):
    docs, labels = talk()
    model = toxicity.fit(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int"))
    texts = dict(docs)
    taught = [texts[i] for i, y in labels if i in texts and y in (0, 1) and i is not None and zlib.crc32(str(i).encode()) % 4 != 2]
    words = {w for t in taught for w in toxicity.words_of(t or "")}
    assert len(model.terms.hashes) == len(words) and "zzqq*" in model.terms.stems
    for text in [t for _, t in docs if t][:300]:
        count = toxicity.words_of(text)
        terms, n = model.terms.of(count)
        stems = {s for w in count for s in toxicity.stems_of(w) if s in model.terms.stems}
        assert len(terms) == len(words & set(count)) + len(stems)
        assert n.sum() == sum(k for w, k in count.items() if w in words) + sum(k for w, k in count.items() for s in toxicity.stems_of(w) if s in stems)
        assert (model.weight[terms] > 0).all()


# -- 10: mixing --


def targets_by_rounds(sizes):
    """Shares by weight; what passes a cap is shared again until nothing does."""
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: mixing.SOURCE_WEIGHTS[k % 3] for k, s in enumerate(names)}
    total, full = sum(sizes.values()), {}
    while True:
        open_ = [s for s in names if s not in full]
        rest, w = total - sum(full.values()), sum(weight[s] for s in open_)
        share = {s: rest * weight[s] / w for s in open_}
        above = [s for s in open_ if share[s] > 3 * sizes[s]]
        if not above:
            return full | share
        full |= {s: 3.0 * sizes[s] for s in above}


def test_mix(docs, table):
    found = mixing.mix(docs).collect()
    assert len(found) == len(table)
    sizes = defaultdict(int)
    for _, text, _, source, _ in table:
        sizes[source] += len(WORD.findall(text or ""))
    wanted = targets_by_rounds(sizes)
    taken = defaultdict(int)
    for r in found:
        assert r["source_size"] == sizes[r["source"]]
        assert abs(r["target"] - wanted[r["source"]]) < 1e-6 * max(1, r["target"])
        assert 0 <= r["taken"] <= 3 * r["size"]
        taken[r["source"]] += r["taken"]
    for source, target in wanted.items():
        assert target - 3 - 0.01 * target <= taken[source] <= target
    again = mixing.mix(docs.repartition(2)).collect()
    assert sorted(map(str, again)) == sorted(map(str, found))


def test_schedule_is_even(spark):
    targets = spark.createDataFrame([("a", 0, 10, 50.0), ("b", 1, 10, 20.0), ("c", 2, 10, 0.0), ("d", 3, 10, 30.0)], "source string, s int, source_size long, target double")
    dealt = mixing.schedule(targets, 1000).toPandas().sort_values("slot")
    assert len(dealt) == 1000 and set(dealt.s) == {0, 1, 3}
    for low in range(0, 1000, 100):
        part = dealt[dealt.slot.between(low, low + 99)]
        assert abs((part.s == 0).sum() - 50) <= 3
    for _, part in dealt.groupby("s"):
        assert part["rank"].tolist() == list(range(len(part)))


def test_small_sources_beside_a_huge_one_take_their_targets(spark):
    rows = [(k, "w " * 100, "huge") for k in range(300)] + [(1000 + k, "w " * (k % 9 + 1), f"tiny{k // 2:02}") for k in range(80)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    sizes, taken = defaultdict(int), defaultdict(int)
    for _, text, source in rows:
        sizes[source] += len(text.split())
    for r in mixing.mix(df, slots=64).collect():
        taken[r["source"]] += r["taken"]
    for source, target in targets_by_rounds(sizes).items():
        assert abs(taken[source] - target) <= 1, source
    kept = {r["doc_id"] for r in mixing.mixed_documents(df, slots=64).collect()}
    assert kept >= {i for i, _, source in rows if source != "huge"}


def test_mix_of_nothing(spark, empty):
    assert mixing.mix(empty).count() == 0
    blank = spark.createDataFrame([(1, "", "a"), (2, None, None), (2, None, None)], "doc_id long, text string, source string")
    assert [(r["size"], r["taken"]) for r in mixing.mix(blank).collect()] == [(0, 0)] * 3
    assert mixing.mixed_documents(blank).count() == 3


def test_mixed_documents(wide, table):
    copies = defaultdict(int)
    rows = mixing.mixed_documents(wide)
    assert rows.columns == wide.columns
    for r in rows.collect():
        copies[r["doc_id"]] += 1
    taken = {r["doc_id"]: r for r in mixing.mix(wide).collect()}
    for i, r in taken.items():
        assert copies[i] == (1 if r["size"] == 0 else int(r["taken"] / r["size"] + 0.5))


def test_rows_of_one_id_are_mixed_each_by_itself(spark):
    rows = [(None, " ".join(["w"] * 10), "a") for _ in range(200)] + [(k % 3, " ".join(["v"] * (5 + k % 4)), "b") for k in range(300)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    sizes = {s: sum(len(t.split()) for _, t, x in rows if x == s) for s in "ab"}
    mixed = defaultdict(int)
    for r in mixing.mixed_documents(df).collect():
        mixed[r["source"]] += len(r["text"].split())
    for source, target in targets_by_rounds(sizes).items():
        assert abs(mixed[source] - target) <= 5 + 1


# -- the pipeline --


def test_pipeline(spark, table, tmp_path):
    import corpus_pipeline

    docs, labels = talk(n=400)
    rows = [(i, t, l, s, n) for i, t, l, s, n in table] + [(10_000 + i, t, "en", f"src{i % 3}", len(t or "")) for i, t in docs if i is not None]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(10_000 + i, y) for i, y in labels if i is not None], "doc_id long, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    now, got = spark.read.parquet(str(tmp_path / "documents.parquet")), {}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before = [tuple(r) for r in now.collect()]
        stage(spark, now, str(tmp_path)).write.parquet(str(tmp_path / f"s{k}"))
        now = spark.read.parquet(str(tmp_path / f"s{k}"))
        got[name] = (before, [r.asDict() for r in now.collect()], now.columns)
    for name, (_, _, columns) in list(got.items())[:-1]:
        assert columns == ["doc_id", "text", "lang", "source", "n_chars"], name

    before, after, _ = got["toxicity"]
    gone = {r[0] for r in before} - {r["doc_id"] for r in after}
    assert {i for i in gone if i is None or i < 10_000} == set()
    bad = {10_000 + i for i, t in docs if i is not None and any(w in (t or "").lower() for w in ("vile", "rotten", "zzqq"))}
    assert len(gone & bad) > 0.95 * len(bad) and len(gone - bad) < 0.02 * len(before)

    before, after, _ = got["line dedup"]
    lost = brute_lines(before)
    assert {r["doc_id"]: r["text"] for r in after} == {i: kept_lines(t, lost[i]) if t else t for i, t, *_ in before}

    before, after, _ = got["SimHash near-dedup"]
    one = brute_components({i: brute_fingerprint(t) for i, t, *_ in before})
    assert sorted(r["doc_id"] for r in after if r["doc_id"] is not None) == sorted({x for x in one.values() if x is not None})

    before, after, _ = got["mixing sources"]
    sizes, mixed = defaultdict(int), defaultdict(int)
    for _, t, _, s, _ in before:
        sizes[s] += len(WORD.findall(t or ""))
    for r in after:
        mixed[r["source"]] += len(WORD.findall(r["text"] or ""))
    longest = max(len(WORD.findall(t or "")) for _, t, *_ in before)
    for source, target in targets_by_rounds(sizes).items():
        assert abs(mixed[source] - target) <= longest / 2 + 0.01 * target + 3

    before, after, _ = got["BPE encoding"]
    assert sorted((r["doc_id"] is None, r["doc_id"], r["ids_sha256"]) for r in after) == sorted((i is None, i, sha(" ".join(map(str, encoded(t))))) for i, t, *_ in before)
    assert sorted((r["doc_id"] is None, r["doc_id"], r["ids_sha256"]) for r in corpus_pipeline.run(spark, str(tmp_path)).collect()) == sorted((r["doc_id"] is None, r["doc_id"], r["ids_sha256"]) for r in after)


def test_pipeline_of_odd_tables(spark, tmp_path):
    """Empty tables, no labels, further columns of clashing names and rows without ids."""
    import corpus_pipeline

    docs = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
    none = spark.createDataFrame([], "doc_id long, toxic int")
    docs.write.parquet(str(tmp_path / "e" / "documents.parquet"))
    none.write.parquet(str(tmp_path / "e" / "labels.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path / "e")).count() == 0
    rows = [(None, f"text {k} of its own " + " ".join(f"w{k}x{j}" for j in range(30)), "en", None, 0, "x", 1, "y") for k in range(5)]
    rows += [(7, f"more {k} " + " ".join(f"v{k}x{j}" for j in range(30)), "en", "s", 0, "x", 1, "y") for k in range(3)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, _key string, line int, fp string").write.parquet(str(tmp_path / "o" / "documents.parquet"))
    none.write.parquet(str(tmp_path / "o" / "labels.parquet"))
    now = spark.read.parquet(str(tmp_path / "o" / "documents.parquet"))
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES[:-1]):
        before, now = now, stage(spark, now, str(tmp_path / "o"))
        now.write.parquet(str(tmp_path / f"o{k}"))
        now = spark.read.parquet(str(tmp_path / f"o{k}"))
        assert now.columns == before.columns, name
        if name != "mixing sources":  # nothing is toxic, repeated or alike
            assert now.count() == len(rows), name
    assert corpus_pipeline.run(spark, str(tmp_path / "o")).count() == now.count()


def test_rounds_give_native_memory_back(spark, docs, monkeypatch):
    from gridweft.functions import rounds
    from gridweft.llm import common

    assert rounds.give_back(spark)
    asked = []
    monkeypatch.setattr(common, "give_back", asked.append)
    ids = docs.select("doc_id").limit(5)
    assert common.saved(ids).count() == common.written(ids).count() == 5
    assert len(asked) == 2
