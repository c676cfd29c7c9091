"""Toxicity by the nearest labelled examples under exact TF-IDF cosine."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridweft.llm.common import in_arrow, kept, partitions, release, saved

#: Bounds of the labelled sample: so many examples of each class, of so many code points at most.
PER_CLASS, EXAMPLE_CHARS = 2_000, 200_000
NEIGHBOURS = 15
THRESHOLD = 0.3
SEED = 42
#: Weight of a text's terms that says nothing of its class, as a share of the weight of one that says all.
_LEAST = 1e-3
_SHRINK = 0.5
#: Examples of a block of the index; lists of at least one example in so many are arrays; blocks that are read first.
_BLOCK, _DENSE, _FIRST = 128, 16, 3
_WORD = re.compile(r"[^\W\d_]+")
_STEMS = (4, 5, 6)
_MEMO_BYTES = 24 << 20
_RANGE = 1 << 14


def words_of(text: str) -> Counter:
    """Words of letters in lower case and how often each stands in the text."""
    return Counter(_WORD.findall(text.lower()))


def stems_of(word: str) -> list[str]:
    """The first 4, 5 and 6 letters of longer words, marked by a star."""
    return [word[:k] + "*" for k in _STEMS if len(word) > k]


def _hashes(items) -> np.ndarray:
    return np.array([xxhash.xxh64_intdigest(w.encode("utf-8", "surrogatepass"), SEED) for w in items], np.uint64)


def _packed(values: np.ndarray) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(values.tobytes())


def _unpacked(body: bytes, kind) -> np.ndarray:
    return np.frombuffer(zstandard.ZstdDecompressor().decompress(body), kind)


class Terms:
    """Numbers of terms: words, known by 64-bit hashes in rising order, and then chosen stems."""

    def __init__(self, hashes: np.ndarray, stems: list[str]):
        self.hashes, self.stems = hashes, stems
        self._start()

    def _start(self) -> None:
        self.of_stem = {s[:-1]: len(self.hashes) + k for k, s in enumerate(self.stems)}
        self.memo: dict[str, int] = {}
        self.used, self.several, self.fixed = 0, [], 0  # several: terms of words that have chosen stems; the memo refers to the first `fixed`

    def __getstate__(self):
        return self.hashes, self.stems

    def __setstate__(self, state):
        self.hashes, self.stems = state
        self._start()

    def __len__(self) -> int:
        return len(self.hashes) + len(self.stems)

    def numbers(self, hashes: np.ndarray) -> np.ndarray:
        """The words' numbers, -1 where one is no term."""
        if not len(self.hashes):
            return np.full(len(hashes), -1)
        at = np.minimum(np.searchsorted(self.hashes, hashes), len(self.hashes) - 1)
        return np.where(self.hashes[at] == hashes, at, -1)

    def _learn(self, missing: list[str]) -> dict[str, int]:
        found = dict(zip(missing, self.numbers(_hashes(missing)).tolist(), strict=True))
        known = self.of_stem
        if known:
            for w, number in found.items():
                if w[:4] in known or w[:5] in known or w[:6] in known:
                    stems = [known[w[:k]] for k in _STEMS if len(w) > k and w[:k] in known]
                    if stems:
                        self.several.append([number] * (number >= 0) + stems)
                        found[w] = -1 - len(self.several)
        room = sum(map(len, missing)) + 180 * len(missing)
        if self.used + room <= _MEMO_BYTES:
            self.memo.update(found)
            self.used, self.fixed = self.used + room, len(self.several)
        return found

    def count_holding(self, texts: list[str], found: np.ndarray) -> None:
        """Adds to found, by term, how many of the texts hold it."""
        sets = [set(_WORD.findall(t.lower())) for t in texts]
        numbers = [list(map(self.memo.get, words)) for words in sets]
        missing = {w for words, k in zip(sets, numbers, strict=True) if None in k for w in words if w not in self.memo}
        learnt = self._learn(list(missing)) if missing else {}
        for words, k in zip(sets, numbers, strict=True):
            if None in k:
                k = [learnt[w] if x is None else x for w, x in zip(words, k, strict=True)]
            own = np.array(k, np.int64)
            found[own[own >= 0]] += 1
            stemmed = own[own < -1].tolist()
            if stemmed:
                found[list({x for y in stemmed for x in self.several[-2 - y]})] += 1
        del self.several[self.fixed :]

    def of(self, count: Counter) -> tuple[np.ndarray, np.ndarray]:
        """(numbers, counts) of the terms of a text, in rising order."""
        numbers = list(map(self.memo.get, count))
        if None in numbers:
            found = self._learn([w for w, k in zip(count, numbers, strict=True) if k is None])
            numbers = [found[w] if k is None else k for w, k in zip(count, numbers, strict=True)]
        numbers, n = np.array(numbers, np.int64), np.array(list(count.values()), np.int64)
        keep = numbers >= 0
        stemmed = np.flatnonzero(numbers < -1)
        if len(stemmed):
            lists = [self.several[-2 - k] for k in numbers[stemmed].tolist()]
            many = np.repeat(n[stemmed], [len(x) for x in lists])
            numbers, inverse = np.unique(np.concatenate([numbers[keep], [k for x in lists for k in x]]).astype(np.int64), return_inverse=True)
            n = np.bincount(inverse, np.concatenate([n[keep], many])).astype(np.int64)
        else:
            numbers, n = numbers[keep], n[keep]
            order = np.argsort(numbers)
            numbers, n = numbers[order], n[order]
        del self.several[self.fixed :]
        return numbers, n


def _slices(starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of all slices one after the other, and their lengths."""
    lengths = ends - starts
    return np.arange(lengths.sum()) + np.repeat(starts - np.cumsum(lengths) + lengths, lengths), lengths


def _alike(vectors: np.ndarray, among: np.ndarray) -> list[np.ndarray]:
    """The rows `among` in groups of a block or so, halved again and again along their main direction."""
    if len(among) <= _BLOCK:
        return [among]
    mine = vectors[among] - vectors[among].mean(0)
    way = mine.T @ (mine @ np.cos(np.arange(mine.shape[1], dtype=np.float32)))
    for _ in range(6):
        way = mine.T @ (mine @ (way / max(float(np.abs(way).max(initial=0)), 1e-30)))
    order = np.argsort(mine @ way, kind="stable")
    half = max(_BLOCK, len(among) // 2 // _BLOCK * _BLOCK)
    return [*_alike(vectors, among[order[:half]]), *_alike(vectors, among[order[half:]])]


class BlockMaxIndex:
    """Inverted lists of unit vectors in blocks of examples, with each term's greatest weight in each block.

    Vectors are given as triples (example, term, value). Examples stand in order of class and
    of likeness in their common terms, so that blocks differ; ties between equal cosines (to six decimals) go to
    the example of smaller rank. Lists that hold one example in 16 or more are arrays of all
    blocks, others are postings.
    """

    def __init__(self, example: np.ndarray, term: np.ndarray, value: np.ndarray, n_terms: int, toxic: np.ndarray, ids: np.ndarray, weights: np.ndarray):
        held = np.bincount(term, minlength=n_terms)
        full = held * _DENSE >= max(1, len(ids))
        self.row = np.where(full, np.cumsum(full) - 1, -1)
        common = np.zeros((len(ids), int(full.sum())), np.float32)
        mine = self.row[term] >= 0
        common[example[mine], self.row[term[mine]]] = value[mine]
        order = np.concatenate([np.empty(0, np.int64), *[g for y in (0, 1) for g in _alike(common, np.flatnonzero(toxic == y))]])
        self.rank, self.toxic, self.ids, self.weights = order, toxic[order], ids[order], weights[order]
        self.blocks = -(-len(ids) // _BLOCK)
        place = np.empty(len(ids), np.int64)
        place[order] = np.arange(len(ids))
        at = place[example]
        by = np.lexsort((at, term))
        at, term, value = at[by], term[by], value[by].astype(np.float32)
        self.places, self.values = at.astype(np.int32), value
        fresh = np.concatenate([[True], (term[1:] != term[:-1]) | (at[1:] // _BLOCK != at[:-1] // _BLOCK)]) if len(at) else np.zeros(0, bool)
        self.starts = np.append(np.flatnonzero(fresh), len(at))  # of each term and block that has any
        self.block = (at[fresh] // _BLOCK).astype(np.int32)
        self.most = np.maximum.reduceat(self.values, self.starts[:-1]) if len(at) else self.values
        self.lists = np.searchsorted(term[fresh], np.arange(n_terms + 1))
        self.arrays = np.zeros((common.shape[1], self.blocks * _BLOCK), np.float32)
        self.arrays[:, : len(ids)] = common[order].T
        self.arrays = np.ascontiguousarray(self.arrays.reshape(-1, self.blocks, _BLOCK).transpose(1, 0, 2))  # (block, list, place)

    def nearest(self, queries: list[tuple[np.ndarray, np.ndarray]], k: int, without: list | None = None) -> list[tuple[np.ndarray, np.ndarray]]:
        """(places, cosines) of the k examples of greatest positive cosine of each query (terms, values), exactly.

        Of each query the few blocks of greatest bounds are read first, and then those whose
        bounds reach its k-th best cosine so far; all other blocks are left out. The queries go
        together through each step. An example of the document `without` of a query is no answer.
        """
        n, width = len(queries), self.blocks * _BLOCK
        terms = np.concatenate([t for t, _ in queries])
        values = np.concatenate([v for _, v in queries]).astype(np.float32)
        owner = np.repeat(np.arange(n), [len(t) for t, _ in queries])
        row = self.row[terms]
        full = row >= 0
        common = np.zeros((n, self.arrays.shape[1]), np.float32)
        common[owner[full], row[full]] = values[full]
        entries, lengths = _slices(self.lists[terms], self.lists[terms + 1])
        weight, pair = np.repeat(values, lengths), np.repeat(owner * self.blocks, lengths) + self.block[entries]
        # bincount of nothing is whole numbers
        bounds = np.bincount(pair, weight * self.most[entries], n * self.blocks).astype(np.float64).reshape(n, self.blocks)
        bounds[bounds > 0] += 1e-5
        posted = np.repeat(~full, lengths)
        entries, weight, pair = entries[posted], weight[posted], pair[posted]
        scores, kth = np.zeros((n, width)), np.full(n, 1e-9)
        few = min(_FIRST, self.blocks)
        best = np.argpartition(bounds, self.blocks - few, axis=1)[:, self.blocks - few :]
        first = np.zeros((n, self.blocks), bool)
        np.put_along_axis(first, best, True, axis=1)
        for among in (first, ~first):
            wanted = (bounds >= kth[:, None]) & among
            mine = wanted.reshape(-1)[pair]
            postings, lengths = _slices(self.starts[entries[mine]], self.starts[entries[mine] + 1])
            at = np.repeat(pair[mine] // self.blocks * width, lengths) + self.places[postings]
            scores += np.bincount(at, np.repeat(weight[mine], lengths) * self.values[postings], n * width).astype(np.float64, copy=False).reshape(n, width)
            for b in np.flatnonzero(wanted.any(0)).tolist():
                these = np.flatnonzero(wanted[:, b])
                scores[these, b * _BLOCK : (b + 1) * _BLOCK] += common[these] @ self.arrays[b]
            if without is not None:
                for at, doc in enumerate(without):
                    scores[at, np.flatnonzero(self.ids == doc)] = 0.0
            if among is first and few * _BLOCK > k:
                reached = scores.reshape(n, self.blocks, _BLOCK)[np.arange(n)[:, None], best].reshape(n, -1)
                kth = np.maximum(kth, np.partition(reached, few * _BLOCK - k, axis=1)[:, few * _BLOCK - k] - 2e-6)
        asker, place = np.nonzero(scores >= kth[:, None])
        cosine = scores[asker, place].round(6)
        asker, place, cosine = (x[cosine > 0] for x in (asker, place, cosine))
        order = np.lexsort((self.rank[place], -cosine, asker))
        asker, place, cosine = asker[order], place[order], cosine[order]
        ends = np.searchsorted(asker, np.arange(n + 1))
        return [(place[s : min(e, s + k)], cosine[s : min(e, s + k)]) for s, e in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)]


class Model:
    def __init__(self, terms: Terms, weight: np.ndarray, index: BlockMaxIndex | None, base: float, curve: tuple[float, float] = (1.0, 0.0)):
        self.terms, self.weight, self.index, self.base, self.curve = terms, weight, index, base, curve

    def vector(self, count: Counter) -> tuple[np.ndarray, np.ndarray]:
        return self.unit(*self.terms.of(count))

    def unit(self, terms: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        values = (1 + np.log(n)) * self.weight[terms]
        terms, values = terms[values > 0], values[values > 0]
        return terms, values / np.sqrt(values @ values) if len(values) else values

    def votes(self, texts: list[str], without: list | None = None) -> tuple[np.ndarray, list[list[int]]]:
        """Of each text the nearest examples' votes for label 1, weighted by squared cosine and by their class's share, and the first three.

        Examples of a class that was sampled more thinly count for more, so votes follow the
        labels' frequencies. A text without any term gets what examples without any do.
        """
        out, evidence = np.full(len(texts), self.base), [[] for _ in texts]
        if self.index is None or not texts:
            return out, evidence
        found = self.index.nearest([self.vector(words_of(t)) for t in texts], NEIGHBOURS, without)
        for k, (at, cos) in enumerate(found):
            if len(at):
                votes = cos**2 * self.index.weights[at]
                out[k] = ((votes * self.index.toxic[at]).sum() + _SHRINK * self.base) / (votes.sum() + _SHRINK)
                evidence[k] = self.index.ids[at[:3]].tolist()
        return out, evidence

    def scores(self, texts: list[str]) -> tuple[np.ndarray, list[list[int]]]:
        """Likelihood of label 1 and evidence of each text."""
        votes, evidence = self.votes(texts)
        return calibrated(votes, *self.curve), evidence


def calibrated(votes: np.ndarray, slope: float, shift: float) -> np.ndarray:
    """Votes as likelihoods; votes of 0 stay 0 and of 1 stay 1."""
    inside = np.clip(votes, 1e-9, 1 - 1e-9)
    curve = 1 / (1 + np.exp(-np.clip(slope * np.log(inside / (1 - inside)) + shift, -30, 30)))
    return np.where((votes > 0) & (votes < 1), curve, np.clip(votes, 0.0, 1.0))


def _texts(column, rows: int = 64) -> Iterator[list[str]]:
    """Lists of so many texts, null ones empty, fewer where they are long."""
    held, chars = [], 0
    for text in column:
        held.append(text.as_py() or "")
        chars += len(held[-1])
        if len(held) == rows or chars > 1 << 20:
            yield held
            held, chars = [], 0
    if held:
        yield held


def fit_curve(votes: np.ndarray, toxic: np.ndarray, weights: np.ndarray) -> tuple[float, float]:
    """(slope, shift) of a logistic curve from votes to labels by Newton's steps, held near (1, 0) by one example's worth."""
    x = np.log(np.clip(votes, 1e-9, 1 - 1e-9) / (1 - np.clip(votes, 1e-9, 1 - 1e-9)))
    theta, features = np.array([1.0, 0.0]), np.stack([x, np.ones(len(x))], axis=1)
    weights = weights / max(weights.mean(), 1e-12) if len(x) else weights
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(features @ theta, -30, 30)))
        gradient = features.T @ (weights * (p - toxic)) + (theta - [1.0, 0.0])
        curvature = (features * (weights * p * (1 - p))[:, None]).T @ features + np.eye(2)
        step = np.linalg.solve(curvature, gradient)
        theta = theta - step * min(1.0, 2.0 / max(np.abs(step).max(), 1e-12))
    return (float(max(theta[0], 0.1)), float(theta[1]))


def learnable(column: str = "doc_id"):
    """Rows whose labels may be learnt: crc32 of doc_id as text, modulo 4, isn't 2."""
    return F.crc32(F.col(column).cast("string")) % 4 != 2


def chi_square(a: np.ndarray, b: np.ndarray, n1: int, n0: int) -> np.ndarray:
    """Of terms that a of n1 toxic and b of n0 other examples hold."""
    a, b = a.astype(np.float64), b.astype(np.float64)
    rest = n0 + n1 - a - b
    below = (a + b) * rest * max(1, n0 * n1)
    return np.where(below > 0, (a * (n0 - b) - b * (n1 - a)) ** 2 * (n0 + n1) / np.maximum(below, 1), 0.0)


def by_chance(kinds: int) -> float:
    """About the greatest chi-square that chance gives any of so many terms."""
    return 2 * np.log(max(2, kinds))


def informative(chi: np.ndarray, kinds: int) -> np.ndarray:
    """Weights of terms from _LEAST to 1: small up to what chance gives, near 1 far beyond it."""
    return _LEAST + (1 - _LEAST) * (chi / (chi + by_chance(kinds))) ** 3


def _chi(a: Column, n: Column, n1: int, n0: int) -> Column:
    """chi_square() as a column, of terms that n examples hold, a of them toxic."""
    below = n * (F.lit(n0 + n1) - n) * float(max(1, n0 * n1))
    return F.when(below > 0, F.pow((a * n0 - (n - a) * n1).cast("double"), F.lit(2.0)) * (n0 + n1) / below).otherwise(0.0)


def _held_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """How many examples of a batch, toxic ones and all, hold each word (by its hash) and each stem."""
    for batch in batches:
        every, toxic = Counter(), Counter()
        for label, text in zip(batch["_toxic"].to_pylist(), batch["text"].to_pylist(), strict=True):
            words = words_of(text or "")
            found = {s for w in words for s in stems_of(w)}
            found.update(words)
            every.update(found)
            if label:
                toxic.update(found)
        names = list(every)
        stems = [w if w[-1] == "*" else None for w in names]
        yield pa.RecordBatch.from_pydict({"stem": pa.array(stems, pa.string()), "hash": pa.array(_hashes(names).view(np.int64)), "a": pa.array([toxic[w] for w in names], pa.int64()), "n": pa.array(list(every.values()), pa.int64())})


def document_frequencies(docs: DataFrame, terms: Terms) -> tuple[int, np.ndarray]:
    """How many documents there are and how many hold each term, over all documents.

    Each task counts the terms in an array; ranges of the arrays meet, packed, by range.
    """
    n, shared = len(terms), docs.sparkSession.sparkContext.broadcast(terms)

    def hold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept("toxicity", dict)  # the model is a broadcast; what other operators kept goes
        found, rows = np.zeros(n + 1, np.int64), 0
        for batch in batches:
            for texts in _texts(batch["text"]):
                shared.value.count_holding(texts, found)
            rows += batch.num_rows
        found[n] = rows
        parts = [(low // _RANGE, found[low : low + _RANGE]) for low in range(0, n + 1, _RANGE)]
        parts = [(k, _packed(x)) for k, x in parts if x.any()]
        yield pa.RecordBatch.from_pydict({"range": pa.array([k for k, _ in parts], pa.int32()), "body": pa.array([x for _, x in parts], pa.binary())})

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for k, body in zip(batch["range"].to_pylist(), batch["body"], strict=True):
                part = _unpacked(body.as_py(), np.int64)
                sums[k] = sums[k] + part if k in sums else part
        yield pa.RecordBatch.from_pydict({"range": pa.array(list(sums), pa.int32()), "body": pa.array([_packed(x) for x in sums.values()], pa.binary())})

    counted = in_arrow(docs.select("text"), hold, "range int, body binary").repartition(partitions(docs.sparkSession), "range")
    out = np.zeros(n + 1, np.int64)
    for r in in_arrow(counted, add, "range int, body binary").collect():  # a number for each term of the bounded sample
        part = _unpacked(bytes(r["body"]), np.int64)
        out[r["range"] * _RANGE : r["range"] * _RANGE + len(part)] += part
    shared.destroy()
    return int(out[n]), out[:n]


def fit(docs: DataFrame, labels: DataFrame, plain: bool = False) -> Model:
    """A model from at most PER_CLASS labelled texts of each class, taken in the order of a seeded hash of their ids.

    A labelled doc_id that stands in several rows gives an example for each different text of
    up to EXAMPLE_CHARS code points; the bound is on examples, not on ids. All words of the examples are terms, and those of their stems whose chi-square between
    class and presence is beyond what chance gives any of so many. A term's weight is its IDF
    over all documents times informative() of its chi-square, or with plain=True its IDF alone. The curve from votes to
    likelihoods is fitted to the examples, each held against the others.
    """
    spark = docs.sparkSession
    given = labels.filter(F.col("toxic").isin(0, 1) & learnable()).groupBy(F.col("doc_id").alias("_id")).agg(F.max("toxic").cast("int").alias("_toxic"))
    given = given.join(docs.select(F.col("doc_id").alias("_id")).distinct(), "_id", "left_semi").withColumn("_order", F.xxhash64("_id", F.lit(SEED)))
    given = saved(given)
    share = {r["_toxic"]: r["count"] for r in given.groupBy("_toxic").count().collect()}
    sample = given.filter("_toxic = 0").orderBy("_order", "_id").limit(PER_CLASS).union(given.filter("_toxic = 1").orderBy("_order", "_id").limit(PER_CLASS))
    # The sample has at most 2 * PER_CLASS rows of three numbers; how many rows its ids stand in has no bound.
    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).filter(F.length("text") <= EXAMPLE_CHARS)
    rows = saved(texts.join(F.broadcast(sample), F.col("doc_id") == F.col("_id")).withColumn("_text", F.xxhash64("text")).dropDuplicates(["_id", "_text"]))
    by = ("_order", "_id", "_text")
    chosen = saved(rows.filter("_toxic = 0").orderBy(*by).limit(PER_CLASS).union(rows.filter("_toxic = 1").orderBy(*by).limit(PER_CLASS)))
    sizes = {r["_toxic"]: r["count"] for r in chosen.groupBy("_toxic").count().collect()}
    n0, n1 = sizes.get(0, 0), sizes.get(1, 0)
    if not sizes:
        return Model(Terms(np.empty(0, np.uint64), []), np.empty(0), None, 0.0)
    table = saved(in_arrow(chosen, _held_terms, "stem string, hash long, a long, n long").groupBy("stem", "hash").agg(F.sum("a").alias("a"), F.sum("n").alias("n")))
    chance = table.count()
    words = table.filter("stem is null").select("hash", "a", "n").toArrow()
    stems = table.filter("stem is not null").filter(_chi(F.col("a"), F.col("n"), n1, n0) > by_chance(chance)).orderBy("stem").toArrow()
    hashes = words["hash"].to_numpy().view(np.uint64)
    order = np.argsort(hashes)
    a, n = (np.concatenate([words[c].to_numpy()[order], stems[c].to_numpy()]) for c in ("a", "n"))
    terms = Terms(hashes[order], stems["stem"].to_pylist())
    total, holding = document_frequencies(docs, terms)
    weight = np.log((1 + total) / (1 + holding))
    if not plain:
        weight = weight * informative(chi_square(a, n - a, n1, n0), chance)

    shared = spark.sparkContext.broadcast(terms)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [shared.value.of(words_of(text or "")) for text in batch["text"].to_pylist()]
            columns = [pa.array([x[k].astype("<i4").tobytes() for x in found], pa.binary()) for k in (0, 1)]
            yield pa.RecordBatch.from_arrays([batch["_id"], batch["_toxic"], batch["_order"], *columns], ["doc", "toxic", "ord", "terms", "counts"])

    rows = in_arrow(chosen, count, "doc long, toxic int, ord long, terms binary, counts binary").orderBy("ord", "doc", "terms", "counts").toArrow()
    shared.destroy()
    ids, toxic = rows["doc"].to_numpy(), rows["toxic"].to_numpy().astype(np.int64)
    term, n = (np.concatenate([np.frombuffer(x.as_py(), "<i4") for x in rows[c]]) for c in ("terms", "counts"))
    example = np.repeat(np.arange(len(ids)), [len(x.as_buffer()) // 4 for x in rows["terms"]])
    value = (1 + np.log(n)) * weight[term]
    example, term, value = (x[value > 0] for x in (example, term, value))
    norms = np.sqrt(np.bincount(example, value * value, len(toxic)))
    value = value / norms[example]
    of_class = np.array([share.get(0, 0) / max(1, n0), share.get(1, 0) / max(1, n1)])
    weights, empty = of_class[toxic], norms == 0
    prior = share.get(1, 0) / max(1, sum(share.values()))
    base = float(((weights * toxic)[empty].sum() + prior) / (weights[empty].sum() + 1))
    index = BlockMaxIndex(example, term, value, len(terms), toxic, ids, weights)
    model = Model(terms, weight, index, base)

    # each example against those of other documents, on the executors
    made = spark.sparkContext.broadcast(model)

    def without(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found, docs_ = [], batch["_id"].to_pylist()
            for texts in _texts(batch["text"]):
                found += made.value.votes(texts, docs_[len(found) : len(found) + len(texts)])[0].tolist()
            yield pa.RecordBatch.from_arrays([batch["_toxic"], pa.array(found, pa.float64())], ["toxic", "votes"])

    held = in_arrow(chosen.repartition(partitions(spark)), without, "toxic int, votes double").orderBy("votes", "toxic").toArrow()
    made.destroy()
    toxic = held["toxic"].to_numpy().astype(np.int64)
    model.curve = fit_curve(held["votes"].to_numpy(), toxic, of_class[toxic])
    del example, term, value, n, norms, rows, held, words, stems
    release()
    return model


def scored(docs: DataFrame, labels: DataFrame, plain: bool = False) -> DataFrame:
    """(doc_id, score, evidence): likelihood of label 1 and the nearest three examples' doc_ids.

    Only whole texts are looked at. Null and empty texts score as examples without terms do.
    Labels that are null, neither 0 nor 1, or of no document aren't learnt; of several labels
    of a document the greatest counts. Without labels every score is 0. Rows that repeat and
    a null doc_id are scored as they are; an empty table gives no rows. plain is that of fit().
    """
    model = docs.sparkSession.sparkContext.broadcast(fit(docs, labels, plain))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found, evidence = [], []
            for texts in _texts(batch["text"]):
                made, near = model.value.scores(texts)
                found += made.tolist()
                evidence += near
            yield pa.RecordBatch.from_pydict({"doc_id": batch["doc_id"], "score": pa.array(found, pa.float64()), "evidence": pa.array(evidence, pa.list_(pa.int64()))})

    return in_arrow(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), score, "doc_id long, score double, evidence array<long>")


def without_toxic(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The rows whose text scores below the threshold, all columns as they were.

    What scored() says of null texts, odd labels and repeated rows holds; without labels every
    row stays, and an empty table gives no rows.
    """
    model = docs.sparkSession.sparkContext.broadcast(fit(docs, labels))
    columns = docs.columns
    at = columns.index("text")

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = [x < threshold for texts in _texts(batch.column(at)) for x in model.value.scores(texts)[0].tolist()]
            yield batch.filter(pa.array(good, pa.bool_()))

    return in_arrow(docs, keep, docs.schema)
