"""Language identification by error-correcting output codes.

Every language gets a codeword of bits. For each bit a binary classifier over hashed character n-grams (one to four, within words, lower case)
tells the languages with that bit from the others: its weights are smoothed log odds of the n-gram shares of the two sides, from counts over all
training texts. The margins of a text, averaged over its n-grams, meet the codewords in loss-weighted decoding: each bit adds the logistic loss
of its margin, weighted by how well the bit separates its two sides, and the codeword with the least loss wins. ``score`` is the softmax share of the
winner over all codewords; ``ambiguous`` flags texts whose runner-up comes close.

Defined cases: null text, or text without a letter, is ``und`` with score 0; rows with null or empty language teach nothing; one known language
gets score 1; with none, all are ``und``. Ties go to the smaller codeword loss and then to the language that sorts first. Repeated
rows count as often as they occur; texts are read whole; extra columns are not read.

The model is (languages x buckets) counts and never grows with the data; counts are summed in the tasks, then by bucket.
"""
from __future__ import annotations

import itertools
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from barloom.llm.common import C

BUCKETS = 1 << 15
ORDERS = 4
SLICE = 256
MARGIN_SCALE = 8.0  # margins are means of log odds; the logistic loss wants them in units of evidence
AMBIGUOUS = 0.2


def ngram_buckets(text: str) -> np.ndarray:
    """Hashed n-grams of the letters of a text; other characters are word borders."""
    points = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), "<u4")
    letter = _letters(points)
    if not letter.any():
        return np.zeros(0, np.int64)
    points = np.where(letter, points, 32).astype(np.uint64)
    keep = letter.copy()
    keep[1:] |= letter[:-1]
    keep[:-1] |= letter[1:]
    points, letter = points[keep], letter[keep]
    points = np.concatenate([[32], points, [32]]).astype(np.uint64)
    out, h = [], points * np.uint64(0x9E3779B97F4A7C15)
    gap = points == 32
    for n in range(1, ORDERS + 1):
        if n > 1:
            if len(points) < n:
                break
            h = (h[:-1] ^ (h[:-1] >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) + points[n - 1:] * np.uint64(0x94D049BB133111EB)
        inner = np.ones(len(h), bool)
        for j in range(1, n - 1):  # a border may stand at the ends only
            inner &= ~gap[j:j + len(h)]
        if n == 1:
            inner = ~gap
        out.append((h[inner] >> np.uint64(17)) % np.uint64(BUCKETS))
    return np.concatenate(out).astype(np.int64)


_TABLE = None


def _letters(points: np.ndarray) -> np.ndarray:
    global _TABLE
    if _TABLE is None:
        _TABLE = np.array([chr(i).isalpha() for i in range(0x110000)])
    return _TABLE[points]


def codewords(n: int) -> np.ndarray:
    """(languages x bits) of 0 and 1: all ways to split up to 7 languages in two; beyond that seeded random codes of 15 log2(n) distinct columns."""
    if n < 2:
        return np.zeros((n, 0), int)
    if n <= 7:
        return np.array([[0, *bits] for bits in itertools.product((0, 1), repeat=n - 1) if any(bits)]).T
    rng, columns = np.random.default_rng(7), {}
    while len(columns) < 15 * int(np.ceil(np.log2(n))):
        c = rng.integers(0, 2, n)
        c ^= c[0]
        if c.any():
            columns[c.tobytes()] = c
    return np.array(list(columns.values())).T


@dataclass
class LanguageModel:
    langs: list[str]
    codes: np.ndarray
    weights: np.ndarray  # buckets x bits
    trust: np.ndarray  # per bit

    @staticmethod
    def from_counts(langs: list[str], counts: np.ndarray) -> LanguageModel:
        """counts: languages x buckets."""
        codes = codewords(len(langs))
        share = (counts + 0.5) / (counts + 0.5).sum(1, keepdims=True)
        weights = np.zeros((counts.shape[1], codes.shape[1]))
        for b in range(codes.shape[1]):
            weights[:, b] = np.log(share[codes[:, b] == 1].mean(0)) - np.log(share[codes[:, b] == 0].mean(0))
        own = share @ weights * (2 * codes - 1)  # expected margin of each language in the direction of its bit
        trust = np.clip(own.min(0), 1e-3, None) if codes.size else np.zeros(0)
        return LanguageModel(langs, codes, weights.astype(np.float32), trust / trust.sum() if trust.size else trust)

    def predict(self, text: str | None) -> tuple[str, float, bool]:
        grams = ngram_buckets(text) if text and self.langs else ()
        if not len(grams):
            return "und", 0.0, False
        if len(self.langs) == 1:
            return self.langs[0], 1.0, False
        margin = np.bincount(grams, minlength=len(self.weights)).astype(np.float32) @ self.weights / len(grams)
        loss = np.logaddexp(0, -MARGIN_SCALE * (2 * self.codes - 1) * margin) @ self.trust
        share = np.exp(loss.min() - loss)
        share /= share.sum()
        first, second = np.argsort(loss, kind="stable")[:2]
        return self.langs[first], float(share[first]), bool(share[first] - share[second] < AMBIGUOUS)


def fit(docs: DataFrame, text_col: str = "text", lang_col: str = "lang") -> LanguageModel:
    """Learns from all rows of ``docs`` that have text and language."""
    def count(batches):
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            for lo in range(0, batch.num_rows, SLICE):
                for lang, text in zip(*(c.to_pylist() for c in batch.slice(lo, SLICE).columns)):
                    if lang not in sums:
                        sums[lang] = np.zeros(BUCKETS, np.int64)
                    sums[lang] += np.bincount(ngram_buckets(text), minlength=BUCKETS)
        for lang, s in sums.items():
            at = np.flatnonzero(s)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array(at, pa.int64()), pa.array(s[at], pa.int64())], names=["lang", "bucket", "n"])

    rows = docs.select(C(lang_col).cast("string").alias("lang"), C(text_col).cast("string").alias("text")).filter("lang <> '' AND text IS NOT NULL")
    got = rows.mapInArrow(count, "lang string, bucket long, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toArrow()
    langs = sorted(set(got["lang"].to_pylist()))
    at = {x: i for i, x in enumerate(langs)}
    counts = np.zeros((len(langs), BUCKETS))
    counts[[at[x] for x in got["lang"].to_pylist()], got["bucket"].to_numpy()] = got["n"].to_numpy()
    return LanguageModel.from_counts(langs, counts)


def predict(docs: DataFrame, model: LanguageModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, lang_pred, score, ambiguous) of every row."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches):
        for batch in (b.slice(lo, SLICE) for b in batches for lo in range(0, b.num_rows, SLICE)):
            said = [model.predict(t) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([x[0] for x in said], pa.string()), pa.array([x[1] for x in said], pa.float64()), pa.array([x[2] for x in said], pa.bool_())],
                                             names=["doc_id", "lang_pred", "score", "ambiguous"])

    return docs.select(C(id_col).alias("doc_id"), C(text_col).cast("string").alias("text")).mapInArrow(run, f"doc_id {kind}, lang_pred string, score double, ambiguous boolean")


def held_out(doc_id: Column) -> Column:
    """Whether a document is kept from learning; a null id is not."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 3 == 1, F.lit(False))


def identify(docs: DataFrame) -> DataFrame:
    """Learns from the documents that are not held out, predicts for all: doc_id, held_out, lang_pred, score, ambiguous."""
    model = fit(docs.filter(~held_out(C("doc_id"))))
    return predict(docs, model).select("doc_id", held_out(C("doc_id")).alias("held_out"), "lang_pred", "score", "ambiguous")
