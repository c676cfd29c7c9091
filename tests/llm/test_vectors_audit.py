"""Near vectors, ball k-means and the filter audit against brute force."""

import hashlib
import random
import re
from collections import Counter, defaultdict
from itertools import permutations

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridweft.llm import audit, balls, hyperplanes, mixing, toxicity

VECTORS = "vec_id long, embedding array<float>"

# -- 11: near vectors --


def clustered(seed=3, dim=32):
    """Loose and tight groups, copies, scaled copies, repeated and absent ids, vectors that link with nothing."""
    r = np.random.default_rng(seed)
    out = []
    for size, noise in ((150, 0.05), (60, 0.2), (40, 0.28), (1, 0.0), (90, 0.32)):
        centre = r.normal(0, 1, dim)
        out += [centre + r.normal(0, noise, dim) for _ in range(size)]
    out += list(r.normal(0, 1, (300, dim)))
    out += [out[5]] * 30 + [out[6] * 2.5] * 3 + [-out[7]]
    rows = [(int(i), [float(np.float32(c)) for c in x]) for i, x in zip(r.permutation(len(out)), out, strict=True)]
    rows += [(rows[0][0], rows[200][1]), (None, rows[1][1]), (None, [5.0, 5.0]), (None, [5.0, 5.0])]
    rows += [(9000, None), (9001, []), (9002, [0.0] * dim), (9003, [float("nan")] * dim), (9004, [1.0, None] * (dim // 2)), (9005, [float("inf")] * dim), (9006, [1.0]), (9007, [-2.0]), (9008, [3.0])]
    return rows


def brute_links(rows, threshold=0.9):
    """For each row the rows linked with it."""
    good = {}
    for k, (_, v) in enumerate(rows):
        if v and all(c is not None and np.isfinite(c) for c in v) and any(v):
            good[k] = np.array(v, np.float64) / np.linalg.norm(np.array(v, np.float64))
    near = defaultdict(set)
    for a in good:
        for b in good:
            if a != b and len(good[a]) == len(good[b]) and good[a] @ good[b] >= threshold:
                near[a].add(b)
    return near


def classes(rows, near):
    """Smallest id that each row reaches, null only among nulls."""
    out = {}
    for k in range(len(rows)):
        if k in out:
            continue
        seen, waiting = {k}, [k]
        while waiting:
            fresh = near[waiting.pop()] - seen
            seen |= fresh
            waiting += fresh
        ids = [rows[m][0] for m in seen if rows[m][0] is not None]
        out |= dict.fromkeys(seen, min(ids, default=None))
    return out


@pytest.mark.parametrize("block", [16, 1024])
def test_near_vectors(spark, monkeypatch, block):
    monkeypatch.setattr(hyperplanes, "BLOCK", block)
    rows = clustered()
    near = brute_links(rows)
    df = spark.createDataFrame(rows, VECTORS).withColumn("id", F.lit("x")).withColumn("v", F.lit(1)).withColumn("key", F.lit(2))
    found = hyperplanes.linked(df.repartition(3), recall=0.99999)
    assert found.columns == ["vec_id", "n_links", "component_id"]
    of = classes(rows, near)
    wanted = Counter((i, len(near[k]), of[k]) for k, (i, _) in enumerate(rows))
    assert Counter(tuple(r) for r in found.collect()) == wanted


def test_recall_of_near_vectors(spark):
    """With production parameters nearly all links are found, and none below the threshold."""
    rows = clustered(seed=8)
    near = brute_links(rows)
    got = sum(r["n_links"] for r in hyperplanes.linked(spark.createDataFrame(rows, VECTORS)).collect())
    every = sum(map(len, near.values()))
    assert 0.99 * every <= got <= every


def test_tables_follow_the_number_of_vectors():
    for n in (1, 500, 10**5, 10**9):
        bits, tables = hyperplanes.tables_for(n)
        p = 1 - np.arccos(0.9) / np.pi
        assert 1 - (1 - p**bits) ** tables >= 0.995 > 1 - (1 - p**bits) ** (tables - 1)
        assert n / 2**bits <= 512 * 1.001


def test_double_vectors_of_any_size(spark):
    rows = [(1, [1e200, 1e200]), (2, [1e-200, 1.1e-200]), (3, [1e200, -1e200]), (4, [-0.0, 1.0]), (5, [0.0, 2.0])]
    found = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in hyperplanes.linked(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), recall=0.99999).collect()}
    assert found == {1: (1, 1), 2: (1, 1), 3: (0, 3), 4: (1, 4), 5: (1, 4)}


def test_no_vectors(spark):
    assert hyperplanes.linked(spark.createDataFrame([], VECTORS)).count() == 0
    assert [tuple(r) for r in hyperplanes.linked(spark.createDataFrame([(1, None)], VECTORS)).collect()] == [(1, 0, 1)]


# -- 12: ball k-means --


def lloyd(rows, k=16, rounds=3, scale=64, dim=64):
    """Plain comparisons with all centroids, in Python's integers."""
    kept = [(i, [int(np.floor(scale * float(c))) for c in v]) for i, v in rows if v is not None and len(v) == dim and all(c is not None and np.isfinite(c) for c in v)]
    start = sorted(kept, key=lambda r: (hashlib.sha256(f"1:{'' if r[0] is None else r[0]}".encode()).hexdigest(), r[1]))[:k]
    x, centroids = np.array([v for _, v in kept], np.int64).reshape(len(kept), dim), np.array([v for _, v in start], np.int64)
    for n in range(rounds + 1):
        apart = ((x[:, None, :] - centroids[None]) ** 2).sum(2)
        best = apart.argmin(1)
        if n < rounds:
            for c in range(len(centroids)):
                if (best == c).any():
                    centroids[c] = x[best == c].sum(0) // (best == c).sum()
    d = apart[np.arange(len(x)), best]
    own = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids.tolist()]
    return Counter((i, int(c), int(e), int(d[best == c].sum()), int(d.sum()), own[c]) for (i, _), c, e in zip(kept, best, d, strict=True))


def balls_rows(seed=1, dim=64, n=700):
    r = np.random.default_rng(seed)
    centres = r.normal(0, 1, (9, dim))
    x = [centres[r.integers(9)] + r.normal(0, r.choice([0.1, 0.6]), dim) for _ in range(n)]
    rows = [(k, [float(np.float32(c)) for c in v]) for k, v in enumerate(x)]
    rows += rows[:40] + [(None, rows[3][1]), (n, [0.0] * dim), (n + 1, [0.0] * dim), (n + 2, [300_000.0] * dim)]
    return rows + [(8000, None), (8001, [1.0]), (8002, [float("nan")] * dim), (8003, [None] + [1.0] * (dim - 1))]


def test_balls(spark):
    rows = balls_rows()
    df = spark.createDataFrame(rows, VECTORS).withColumn("cluster", F.lit("x")).withColumn("distance", F.lit(1)).withColumn("v", F.lit(1))
    assert Counter(tuple(r) for r in balls.clusters(df.repartition(3)).collect()) == lloyd(rows)


def test_balls_of_small_whole_numbers_tie(spark):
    r = random.Random(2)
    rows = [(k, [float(r.randint(0, 2)) for _ in range(4)]) for k in range(400)]
    found = balls.clusters(spark.createDataFrame(rows, VECTORS), k=11, rounds=4, scale=1, length=4)
    assert Counter(tuple(r) for r in found.collect()) == lloyd(rows, 11, 4, 1, 4)


def test_few_vectors_or_none(spark):
    assert balls.clusters(spark.createDataFrame([], VECTORS)).count() == 0
    assert balls.clusters(spark.createDataFrame([(1, [1.0])], VECTORS)).count() == 0
    rows = [(k, [float(k)] * 64) for k in range(3)]
    assert Counter(tuple(r) for r in balls.clusters(spark.createDataFrame(rows, VECTORS)).collect()) == lloyd(rows)


def test_annuli_leave_most_comparisons_out():
    """A member is compared with the neighbours whose half way it has reached, and with no others."""
    r = np.random.default_rng(5)
    centres = r.integers(-400, 400, (12, 16))
    x = centres[r.integers(0, 12, 3000)] + r.integers(-30, 31, (3000, 16))
    old, d = balls._all_nearest(x, centres)
    moved = centres + r.integers(-3, 4, centres.shape)
    radii = np.array([d[old == i].max(initial=0) ** 0.5 for i in range(12)]) + np.sqrt(((moved - centres) ** 2).sum(1))
    near = balls.neighbours(moved, radii)
    assert sum(len(n) for n, _ in near) < 12 * 11 / 2
    cluster, distance = balls.reassigned(x, old, moved, near)
    best, least = balls._all_nearest(x, moved)
    assert (cluster == best).all() and (distance == least).all()


# -- 13: audit --

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def audited(docs, labels):
    """Every order run over every document."""
    good, toxic = {i for i, q, _ in labels if q == 1 and i is not None}, {i for i, _, t in labels if t == 1 and i is not None}
    least = {}
    for i, text, _ in docs:
        if i is not None:
            least[text or ""] = min(i, least.get(text or "", i))
    facts = []
    for i, text, lang in docs:
        text = text or ""
        w = WORD.findall(text)
        fails = {"A": len(w) < 200, "B": 100 * len(set(w)) < 50 * len(w), "C": 100 * len(re.findall("[A-Z]", text)) > 3 * len(text), "D": bool(re.search(r"[#$%&*|]", text)), "E": i is not None and i > least[text]}
        facts.append((lang or "", {f for f in fails if fails[f]}, i in good, i in toxic))
    rows, shapley = {}, Counter()
    for part in {f[0] for f in facts}:
        mine = [f[1:] for f in facts if f[0] == part]
        for order in permutations("ABCDE"):
            for k, f in enumerate(order):
                here = [m for m in mine if not m[0] & set(order[:k])]
                gone = [m for m in here if f in m[0]]
                redundant = sum(f in m[0] and bool(m[0] & set(order[:k])) for m in mine)
                rows[part, "".join(order), k + 1] = (len(here) - len(gone), len(gone), redundant, sum(m[0] == {f} for m in mine), sum(m[1] for m in gone), sum(m[2] for m in gone))
                shapley[part, f] += len(gone)
    return {key: (*v, shapley[key[0], key[1][key[2] - 1]]) for key, v in rows.items()}


def audit_rows(seed=4, n=160):
    r = random.Random(seed)
    docs = []
    for k in range(n):
        words = [r.choice(["ab", "Cd", "ef", "gh"]) if r.random() < 0.5 else f"w{r.randrange(400)}" for _ in range(r.choice([0, 20, 199, 200, 260]))]
        text = r.choice([" ", "\t\n", "\x0b"]).join(words) + r.choice(["", " ", "\n", " #", "|", " 😀 x"])
        if docs and r.random() < 0.4:
            text = r.choice(docs)[1]
        docs.append((k, text, r.choice(["en", "fr", None, ""])))
    docs += [(3, docs[3][1], "en"), (3, "other text", "fr"), (None, docs[5][1], "en"), (None, None, "de"), (900, None, "de"), (901, "", "de"), (901, "", "en"), (902, "x" * 50_000 + " Y" * 30_000, "en")]
    labels = [(k, r.choice([0, 1, None]), r.choice([0, 1, None])) for k in range(0, n, 2)] + [(4, 1, 1), (None, 1, 1), (7777, 1, 1)]
    return docs, labels


def test_audit(spark):
    docs, labels = audit_rows()
    df = spark.createDataFrame(docs, "doc_id long, text string, lang string").withColumn("part", F.lit(1)).withColumn("mask", F.lit("m")).withColumn("id", F.lit(2)).withColumn("found", F.lit(3))
    marks = spark.createDataFrame(labels, "doc_id long, quality int, toxic int").withColumn("salt", F.lit("s"))
    rows = audit.interactions(df.repartition(3), marks).collect()
    assert {tuple(r)[:3]: tuple(r)[3:] for r in rows} == audited(docs, labels) and len(rows) == 600 * 4


def test_audit_of_nothing(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, lang string")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert audit.interactions(docs, labels).count() == 0
    one = audit.interactions(spark.createDataFrame([(1, None, None)], docs.schema), labels).collect()
    assert {tuple(r)[:3]: tuple(r)[3:] for r in one} == audited([(1, None, None)], [])


def test_edges_of_one_s_own_filters(spark):
    """80 edges of five filters; a document's removals over an order are one at most."""
    df = spark.range(1000).withColumn("part", F.col("id") % 3)
    filters = {"P": F.col("id") % 2 == 0, "Q": F.col("id") % 5 == 0, "R": F.when(F.col("id") > 10, F.col("id") % 7 == 0)}
    failed = audit.first_failures(df, filters, F.col("part").cast("string"))
    assert audit.edges(failed, 5).groupBy("part").count().select("count").distinct().collect()[0][0] == 80
    rows = audit.orders(failed, "PQR").collect()
    assert len(rows) == 3 * 6 * 3
    for r in rows:
        if r["step"] == 3:
            mine = [i for i in range(1000) if str(i % 3) == r["part"]]
            assert r["kept"] == sum(not (i % 2 == 0 or i % 5 == 0 or (i > 10 and i % 7 == 0)) for i in mine)


# -- 10: what the schedule decides --


def _mixed_rows():
    return [(k, f"t{k} " * (20 + k % 7), f"src{k % 4}") for k in range(300)]


def test_a_changed_schedule_changes_the_mix(spark, monkeypatch):
    """Half the slots take half the words, but for a block each; without slots nothing is taken."""
    df = spark.createDataFrame(_mixed_rows(), "doc_id long, text string, source string")
    full, targets = defaultdict(int), {}
    for r in mixing.mix(df).collect():
        full[r["source"]] += r["taken"]
        targets[r["source"]] = r["target"]
    whole = mixing.schedule
    monkeypatch.setattr(mixing, "schedule", lambda *a: whole(*a).filter("rank % 2 = 0").withColumn("rank", F.floor(F.col("rank") / 2)))
    half = defaultdict(int)
    for r in mixing.mix(df).collect():
        half[r["source"]] += r["taken"]
    for source, target in targets.items():
        assert abs(full[source] - target) <= 1
        assert abs(half[source] - target / 2) <= target / 64 + 2
    monkeypatch.setattr(mixing, "schedule", lambda *a: whole(*a).filter("false"))
    assert {r["taken"] for r in mixing.mix(df).collect()} == {0}


def test_golden_points_are_all_multiples():
    for n in (1, 2, 3, 10, 97, 1000, 4096):
        g = mixing.golden_step(n)
        assert sorted(i * g % n for i in range(n)) == list(range(n))


def test_reading_order(spark):
    """Passages make up what mix() takes, and every stretch of slots has its share of each source."""
    df = spark.createDataFrame(_mixed_rows() + [(None, None, "src0"), (None, "a b c", None)], "doc_id long, text string, source string")
    taken = {r["doc_id"]: r for r in mixing.mix(df).collect() if r["doc_id"] is not None}
    order = [r.asDict() for r in mixing.reading_order(df).orderBy("slot", "part").collect()]
    words = Counter()
    for r in order:
        words[r["doc_id"]] += r["words"]
        assert r["first_word"] >= 0 and (r["doc_id"] is None or r["first_word"] + r["words"] <= taken[r["doc_id"]]["size"])
    assert {i: n for i, n in words.items() if i is not None} == {i: r["taken"] for i, r in taken.items() if r["taken"]}
    every, so_far, n = sum(words.values()), Counter(), 0
    share = Counter()
    for r in taken.values():
        share[r["source"]] += r["taken"] / every
    for r in order:
        so_far[r["source"]] += r["words"]
        n += r["words"]
        assert all(abs(so_far[s] - n * x) < 60 for s, x in share.items())


def test_thousands_of_equal_rows_are_no_hot_place(spark, monkeypatch):
    monkeypatch.setattr(mixing, "_ROWS_A_BUCKET", 50)
    rows = [(None, "same words here", "a")] * 300 + [(k, "others " * 3, "b") for k in range(300)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    sized = mixing._sized(df, 42, None)
    assert sized.groupBy("h").count().agg(F.max("count")).first()[0] == 1
    taken = Counter()
    for r in mixing.mix(df).collect():
        taken[r["source"]] += r["taken"]
    assert abs(taken["a"] - 1800 * 5 / 7) <= 1 and abs(taken["b"] - 1800 * 2 / 7) <= 1


# -- 9: the bound of the sample --


def test_the_sample_is_bounded_in_rows(spark, monkeypatch):
    """A labelled id that stands in many rows gives no more examples than the bound."""
    monkeypatch.setattr(toxicity, "PER_CLASS", 40)
    rows = [(1, f"vile words number{k} here") for k in range(500)] + [(k, f"calm words number{k} there") for k in range(2, 200)] + [(1, "vile words number3 here")] * 50
    labels = [(k, int(k == 1)) for k in range(1, 200)]
    model = toxicity.fit(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int"))
    assert (model.index.toxic == 1).sum() == 40 and (model.index.toxic == 0).sum() == 40


def test_plain_weights_are_idf(spark):
    rows = [(k, "red blue" if k % 2 else "blue green") for k in range(1, 60)]
    docs, labels = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([(k, k % 2) for k, _ in rows], "doc_id long, toxic int")
    model = toxicity.fit(docs, labels, plain=True)
    weight = {w: model.weight[model.terms.numbers(toxicity._hashes([w]))[0]] for w in ("red", "blue", "green")}
    assert np.allclose([weight["red"], weight["blue"], weight["green"]], [np.log(60 / 31), np.log(60 / 60), np.log(60 / 30)])
    assert len(toxicity.scored(docs, labels, plain=True).collect()) == len(rows)
