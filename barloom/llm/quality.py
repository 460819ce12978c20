"""Quality classifier: ordinal cumulative-link regression on graded ratings.

Ratings are grades 0, 1, 2, ... One linear score of hashed text features is shared by all of them, and ordered thresholds cut it into grades:
P(grade > k) = sigmoid(score - threshold_k). A document gets its expected grade and the tail probability of the grade that is asked for, and is
kept if that reaches the model's ``least``: of the values that keep ``STAY`` of the highest grade in a held-out fifth of the sample, the smallest
that keeps fewest of the others there (``LEAST`` if the fifth has too few of the highest grade); the model is then fitted on the whole sample. For ``labels`` the grade is 0 for poor quality, 1 for good but toxic, 2 for good and clean.

Features are 26-bit hashes of the whole text's words (presence), word shapes (log of the count, and the decile of their share), repeats of the
word before, share of distinct words and length. The fit takes all features whose rate differs between the two sides of a threshold, or between one
grade and the rest, in the sample.

The fit reads at most ``MAX_LABELS`` labelled documents, those of the smallest hash of the id, so that the driver holds a bounded sample.

Defined cases: text that is null or has no word gets grade 0 and tail probability 0; labels without rating or document teach nothing; repeated
labels or documents count as often as they occur; with one grade in the sample all get that grade, with none the highest; an empty table gives an empty
result; texts of any length are read whole; extra columns of any name pass through ``keep_good`` untouched.
"""
from __future__ import annotations

import math
import operator
import re
import string
from dataclasses import dataclass, field
from itertools import islice

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from barloom.llm.common import C

MAX_LABELS = 20000
GRADES = 3
LEAST = 0.5
STAY = 0.995
MIN_HELD = 100  # held-out documents of the highest grade that the choice of the bound needs
HASH_BITS = 26
MIN_DOCS = 2
MIN_Z = 4.0
CACHE_WORDS = 300_000
SLICE = 256

_SHAPE = str.maketrans(string.ascii_uppercase + string.ascii_lowercase + string.digits, "A" * 26 + "a" * 26 + "0" * 10)


def hashed(feature: str) -> int:
    return xxhash.xxh64_intdigest(feature) & ((1 << HASH_BITS) - 1)


def shape_of(word: str) -> str:
    """Kinds of characters with runs cut to one, runs of other characters to two."""
    s = word.translate(_SHAPE)
    if not s.isascii():
        s = "".join(("A" if c.isupper() else "a") if c.isalpha() else c for c in s)
    s = re.sub(r"(.)\1+", lambda m: m[1] if m[1] in "Aa0" else m[1] * 2, s)
    return s[:6]


@dataclass
class Words:
    """What each word stands for, in a bounded cache: word feature and shape number."""
    wanted: dict[int, int] | None = None  # hash -> number of the features that matter; all if None
    shapes: dict[str, int] = field(default_factory=dict)
    young: dict[str, tuple[int, int]] = field(default_factory=dict)

    def learn(self, words: set[str]) -> None:
        if len(self.young) > CACHE_WORDS:
            self.young.clear()
        for w in [w for w in words if w not in self.young]:
            h = hashed("w:" + w.strip(string.punctuation).lower())
            self.young[w] = (h if self.wanted is None or h in self.wanted else -1), self.shapes.setdefault(shape_of(w), len(self.shapes))


def features(words: list[str], known: Words) -> dict[int, float]:
    """Hash -> value of a text with at least one word; the words must be in ``known``."""
    n, distinct = len(words), set(words)
    out = {h: 1.0 for w in distinct if (h := known.young[w][0]) >= 0}
    counts: dict[int, int] = {}
    if n > 2 * len(distinct):
        for w in words:
            counts[s] = counts.get(s := known.young[w][1], 0) + 1
    else:
        numbers = np.fromiter((known.young[w][1] for w in words), np.int64, n)
        by = np.bincount(numbers)
        counts = {int(s): int(by[s]) for s in np.flatnonzero(by)}
    names = list(known.shapes)
    for s, k in counts.items():
        out[hashed("s:" + names[s])] = math.log1p(k)
        if k * 10 >= n:
            out[hashed(f"share:{names[s]}:{k * 10 // n}")] = 1.0
    repeats = sum(map(operator.eq, words, islice(words, 1, None)))
    out[hashed("repeats")] = math.log1p(repeats)
    out[hashed(f"repeated:{repeats * 10 // n}")] = 1.0
    out[hashed(f"distinct:{len(distinct) * 10 // n}:{min(12, n.bit_length())}")] = 1.0
    out[hashed(f"length:{n.bit_length()}")] = 1.0
    return out


@dataclass
class OrdinalModel:
    """Weights by feature hash, ordered thresholds; without thresholds every text has ``only``."""
    weights: dict[int, float]
    thresholds: list[float]
    only: int = GRADES - 1
    least: float = LEAST

    def grade(self, feats: dict[int, float]) -> tuple[float, list[float]]:
        """Expected grade and P(grade > k) for each k."""
        if not self.thresholds:
            return float(self.only), [1.0 if self.only > k else 0.0 for k in range(GRADES - 1)]
        get = self.weights.get
        score = sum(w * v for h, v in feats.items() if (w := get(h)) is not None)
        tails = [1 / (1 + math.exp(-max(-500.0, min(500.0, score - t)))) for t in self.thresholds]
        return sum(tails), tails


class Sparse:
    """Documents x features as (document, feature, value), with the two products that the fit needs."""
    __array_ufunc__ = None  # so that arrays leave the product to __rmatmul__

    def __init__(self, row: np.ndarray, col: np.ndarray, value: np.ndarray, shape: tuple[int, int]):
        self.row, self.col, self.value, self.shape = row, col, value, shape

    def __matmul__(self, w: np.ndarray) -> np.ndarray:
        return np.bincount(self.row, self.value * w[self.col], self.shape[0])

    def __rmatmul__(self, g: np.ndarray) -> np.ndarray:
        return np.bincount(self.col, self.value * g[self.row], self.shape[1])


def fit_ordinal(x: np.ndarray | Sparse, y: np.ndarray, grades: int, penalty: float = 0.5, steps: int = 600) -> tuple[np.ndarray, np.ndarray]:
    """Weights and thresholds of the cumulative-link model by full gradient steps with running scales; x is (documents x features)."""
    m, n = x.shape
    above = np.array([np.clip((y > k).mean(), 1e-3, 1 - 1e-3) for k in range(grades - 1)])
    cuts = np.maximum.accumulate(-np.log(above / (1 - above)) + 1e-3 * np.arange(grades - 1))
    # thresholds as a first one and positive gaps
    p = np.concatenate([np.zeros(n), [cuts[0]], np.log(np.maximum(np.diff(cuts), 1e-2))])
    mean, square, sig = np.zeros_like(p), np.zeros_like(p), lambda x: 1 / (1 + np.exp(-np.clip(x, -500, 500)))
    for step in range(1, steps + 1):
        w, t = p[:n], p[n] + np.concatenate([[0], np.cumsum(np.exp(p[n + 1:]))])
        score = (x @ w.astype(np.float32)).astype(float)
        edges = np.concatenate([[-np.inf], t, [np.inf]])
        up, lo = sig(edges[y + 1] - score), sig(edges[y] - score)
        du, dl = up * (1 - up), lo * (1 - lo)
        mass = np.maximum(up - lo, 1e-12)
        g_score = (du - dl) / mass
        g_t = np.zeros(grades + 1)
        np.add.at(g_t, y + 1, -du / mass)
        np.add.at(g_t, y, dl / mass)
        g_t = g_t[1:-1]
        grad = np.concatenate([g_score.astype(np.float32) @ x + penalty * w, [g_t.sum()], np.exp(p[n + 1:]) * np.cumsum(g_t[::-1])[::-1][1:]]) / m
        mean = 0.9 * mean + 0.1 * grad
        square = 0.99 * square + 0.01 * grad ** 2
        p -= 0.05 * (mean / (1 - 0.9 ** step)) / (np.sqrt(square / (1 - 0.99 ** step)) + 1e-8)
    return p[:n], p[n] + np.concatenate([[0], np.cumsum(np.exp(p[n + 1:]))])


def graded(labels: DataFrame) -> DataFrame:
    """(doc_id, grade) from quality and toxic flags."""
    clean = F.coalesce(C("toxic"), F.lit(0)) == 0
    return labels.filter("doc_id IS NOT NULL AND quality IS NOT NULL").select("doc_id", F.when(C("quality") == 0, 0).when(clean, 2).otherwise(1).alias("grade"))


def fit(docs: DataFrame, ratings: DataFrame, text_col: str = "text", id_col: str = "doc_id", max_labels: int = MAX_LABELS) -> OrdinalModel:
    """Fits on at most ``max_labels`` rows of ``ratings`` (doc_id, grade), joined to their documents."""
    sample = ratings.select(C("doc_id").alias("_of"), C("grade").cast("int").alias("grade")).orderBy(F.xxhash64("_of"), "_of", "grade").limit(max_labels)
    rows = docs.select(C(id_col).alias("_id"), C(text_col).cast("string").alias("text")).join(F.broadcast(sample), C("_id") == C("_of")).select(F.xxhash64("_id").alias("id"), "grade", "text")

    def extract(batches):
        known = Words()
        for batch in (b.slice(lo, SLICE) for b in batches for lo in range(0, b.num_rows, SLICE)):
            key, grade, feats = [], [], []
            for i, g, text in zip(*(c.to_pylist() for c in batch.columns)):
                words = (text or "").split()
                if words:
                    known.learn(set(words))
                    key.append(i)
                    grade.append(g)
                    feats.append(dict(sorted(features(words, known).items())))
            yield pa.RecordBatch.from_arrays([pa.array(key, pa.int64()), pa.array(grade, pa.int32()), pa.array([list(f) for f in feats], pa.list_(pa.int32())), pa.array([list(f.values()) for f in feats], pa.list_(pa.float32()))],
                                             names=["id", "grade", "h", "v"])

    got = rows.mapInArrow(extract, "id long, grade int, h array<int>, v array<float>").toArrow().combine_chunks()
    y = got["grade"].to_numpy().astype(int)
    if len(set(y)) < 2:
        return OrdinalModel({}, [], int(y[0]) if len(y) else GRADES - 1)
    # 32-bit columns, one at a time: the sample's features are the largest thing that the driver holds
    order = pa.array(np.argsort(got["id"].to_numpy(), kind="stable"))  # the same sums whatever order the rows came in
    y = y[order.to_numpy()]
    lists = _one_chunk(got["h"].take(order))
    row, h = np.repeat(np.arange(len(y), dtype=np.int32), np.diff(lists.offsets.to_numpy())), lists.flatten().to_numpy()
    got = got.drop_columns(["h"])
    v = _one_chunk(got["v"].take(order)).flatten().to_numpy()
    del got, lists
    pa.default_memory_pool().release_unused()
    held = np.arange(len(y)) % 5 == 4
    least = LEAST
    if (held & (y == GRADES - 1)).sum() >= MIN_HELD and len(set(y[~held])) > 1:
        ids, w, t = _fit_sparse(row, h, v, y, ~held)
        hit = np.flatnonzero(np.isin(h, ids))
        tail = 1 / (1 + np.exp(-np.clip(np.bincount(row[hit], v[hit] * w[np.searchsorted(ids, h[hit])], len(y)) - t[-1], -500, 500)))
        del hit
        least = _least(tail[held & (y == GRADES - 1)], tail[held & (y < GRADES - 1)])
    ids, w, t = _fit_sparse(row, h, v, y, np.ones(len(y), bool))
    return OrdinalModel({int(i): float(q) for i, q in zip(ids, w)}, [float(q) for q in t], least=least)


def _one_chunk(lists: pa.ChunkedArray | pa.Array) -> pa.Array:
    if isinstance(lists, pa.ChunkedArray):
        lists = lists.chunk(0) if lists.num_chunks == 1 else lists.combine_chunks()
    return lists.chunk(0) if isinstance(lists, pa.ChunkedArray) else lists


def _least(good: np.ndarray, others: np.ndarray) -> float:
    """The smallest bound that keeps fewest of the others while ``STAY`` of the good ones stay."""
    most = np.sort(good)[int((1 - STAY) * len(good))]
    gone = others[others < most]
    return float(np.nextafter(gone.max(), 1)) if len(gone) else float(min(most, LEAST))


def _fit_sparse(row: np.ndarray, h: np.ndarray, v: np.ndarray, y: np.ndarray, learn: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of the features that tell grades apart, their weights and the thresholds, from the rows of ``learn``."""
    among = learn[row]
    owner, h, v, y = (np.cumsum(learn) - 1).astype(np.int32)[row[among]], h[among], v[among], y[learn]
    del among
    ids = np.unique(h)
    cols = np.searchsorted(ids, h).astype(np.int32)
    del h
    n = np.bincount(cols, minlength=len(ids))
    total = len(y)
    sums = lambda x: np.bincount(cols, x, len(ids))
    tot = sums(v)
    var = np.maximum(sums(v.astype(float) ** 2) / total - (tot / total) ** 2, 1e-12)
    z = np.zeros(len(ids))
    for is_one in [*(y > k for k in range(GRADES - 1)), *(y == k for k in range(1, GRADES - 1))]:
        part = is_one.sum()
        if 0 < part < total:
            hit = sums(v * is_one[owner])
            z = np.maximum(z, np.abs(hit / part - (tot - hit) / (total - part)) / np.sqrt(var * (1 / part + 1 / (total - part))))
    z[n < MIN_DOCS] = 0
    use = np.flatnonzero(z >= MIN_Z)
    number = np.full(len(ids), -1, np.int32)
    number[use] = np.arange(len(use))
    cols = number[cols]
    keep = np.flatnonzero(cols >= 0)
    owner, cols, v = owner[keep], cols[keep], v[keep].astype(float)
    del keep
    w, t = fit_ordinal(Sparse(owner, cols, v, (total, len(use))), y, GRADES)
    return ids[use], w, t


def _said(model: OrdinalModel, known: Words, texts: list[str | None]) -> list[tuple[float, list[float]]]:
    out = []
    for text in texts:
        words = (text or "").split()
        if not words:
            out.append((0.0, [0.0] * (GRADES - 1)))
            continue
        known.learn(set(words))
        out.append(model.grade(features(words, known)))
    return out


def score(docs: DataFrame, model: OrdinalModel, id_col: str = "doc_id", text_col: str = "text", least: float | None = None) -> DataFrame:
    """(doc_id, expected_grade, p_usable, p_good, kept): P(grade >= 1), P(grade >= 2) and whether the latter reaches ``least`` (the model's if None)."""
    least = model.least if least is None else least
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches):
        known = Words(dict.fromkeys(model.weights, 1))
        for batch in (b.slice(lo, SLICE) for b in batches for lo in range(0, b.num_rows, SLICE)):
            said = _said(model, known, batch.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(x, pa.float64()) for x in ([s[0] for s in said], [s[1][0] for s in said], [s[1][-1] for s in said])),
                                              pa.array([s[1][-1] >= least for s in said], pa.bool_())], names=["doc_id", "expected_grade", "p_usable", "p_good", "kept"])

    return docs.select(C(id_col).alias("doc_id"), C(text_col).cast("string").alias("text")).mapInArrow(run, f"doc_id {kind}, expected_grade double, p_usable double, p_good double, kept boolean")


def keep_good(docs: DataFrame, model: OrdinalModel, text_col: str = "text", least: float | None = None) -> DataFrame:
    """The rows of ``docs`` that are kept, all columns."""
    least = model.least if least is None else least
    at = docs.columns.index(text_col)

    def run(batches):
        known = Words(dict.fromkeys(model.weights, 1))
        for batch in (b.slice(lo, SLICE) for b in batches for lo in range(0, b.num_rows, SLICE)):
            yield batch.filter(pa.array([s[1][-1] >= least for s in _said(model, known, batch.column(at).to_pylist())], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
