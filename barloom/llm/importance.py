"""Target-distribution importance resampling over hashed n-grams, interned in an open-addressed NumPy table.

Features are all runs of 1 to ``grams`` consecutive words, hashed into buckets by CRC-32. Two passes read all texts. In both, each block of words
is interned in a table of its own: xxhash64 keys of the n-grams' bytes, computed for all occurrences together, are placed by linear probing;
an occurrence shares a slot only if its key, its length and all its bytes are those of the slot's owner. Slots store bucket and count, so a CRC
is taken once per distinct n-gram. The first pass adds slot counts to buckets (and does so for the target texts); the second gathers the bucket
gains, log ratios of target to corpus with one added to each bucket, by the occurrences' slot ids and sums them per document. Gumbel noise
from a hash of the document id turns the weights into scores whose highest are a draw without replacement.

The corpus has ``buckets`` counts on the driver and in each task, whatever its size. Ranks come from a range sort of thin rows and prefix sums.

Defined cases: null text has no words; a document without words weighs 0; a null id is hashed as empty text and comes first of equal scores;
repeated rows are drawn as rows of their own; texts of any length are read whole, in blocks of ``BLOCK_WORDS`` words, so n-grams of any length
and count stay bounded by one text and one block; documents with fewer words than ``least_words`` have scores but no rank; empty tables, of
documents or targets, give empty results or gains of the corpus alone; only the id and text columns are read.
"""
from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from barloom.llm.common import C
from barloom.operators.timeline import number_rows
from barloom.sources.stage import stage

BUCKETS = 10000
GRAMS = 3
LEAST_WORDS = 20
BLOCK_WORDS = 1 << 17
SLICE_BYTES = 4_000_000
PAD = 8
SPACE = 0x20
# words are ASCII digits, letters (upper-case ones become lower-case) and all bytes of other characters
FOLD = bytes(b + 32 if 0x41 <= b <= 0x5A else b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else SPACE for b in range(256))

# fixed values of xxhash64
P1, P2, P3, P4, P5 = (np.uint64(p) for p in (11400714785074694791, 14029467366897019727, 1609587929392839161, 9650029242287828579, 2870177450012600261))
SHORT = 32  # longer inputs are hashed in stripes, one by one


def _rotl(x: np.ndarray, r: int) -> np.ndarray:
    return (x << np.uint64(r)) | (x >> np.uint64(64 - r))


class Bytes:
    """Bytes with 8-byte and 4-byte loads at any position; ``PAD`` bytes follow the text."""

    def __init__(self, text: bytes):
        self.raw = text + bytes(PAD)
        n = len(self.raw)
        self.u1 = np.frombuffer(self.raw, np.uint8)
        self.u8 = np.ndarray((n - 7,), "<u8", self.raw, strides=(1,))
        self.u4 = np.ndarray((n - 3,), "<u4", self.raw, strides=(1,))


def xxhash64(text: Bytes, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """xxhash64 with seed 0 of each stretch."""
    out = P5 + size.astype(np.uint64)
    at, rest = start.copy(), size.copy()
    live = np.flatnonzero((size >= 8) & (size < SHORT))
    while len(live):
        lane = _rotl(text.u8[at[live]] * P2, 31) * P1
        out[live] = _rotl(out[live] ^ lane, 27) * P1 + P4
        at[live] += 8
        rest[live] -= 8
        live = live[rest[live] >= 8]
    live = np.flatnonzero((rest >= 4) & (size < SHORT))
    out[live] = _rotl(out[live] ^ (text.u4[at[live]].astype(np.uint64) * P1), 23) * P2 + P3
    at[live] += 4
    rest[live] -= 4
    live = np.flatnonzero((rest > 0) & (size < SHORT))
    while len(live):
        out[live] = _rotl(out[live] ^ (text.u1[at[live]].astype(np.uint64) * P5), 11) * P1
        at[live] += 1
        rest[live] -= 1
        live = live[rest[live] > 0]
    out ^= out >> np.uint64(33)
    out *= P2
    out ^= out >> np.uint64(29)
    out *= P3
    out ^= out >> np.uint64(32)
    view = memoryview(text.raw)
    for i in np.flatnonzero(size >= SHORT).tolist():
        out[i] = xxhash.xxh64_intdigest(view[start[i]:start[i] + size[i]])
    return out


def same_bytes(text: Bytes, a: np.ndarray, b: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Whether the stretches of equal size at a and b hold equal bytes."""
    short = np.minimum(size, 8).astype(np.uint64)
    cut = (np.uint64(8) - short) * np.uint64(8)
    same = (text.u8[a] << cut) == (text.u8[b] << cut)
    live, at = np.flatnonzero(same & (size > 8)), 8
    while len(live):
        # the last eight bytes overlap the eight before
        step = np.minimum(at, size[live] - 8)
        same[live] = text.u8[a[live] + step] == text.u8[b[live] + step]
        live = live[same[live] & (size[live] > at + 8)]
        at += 8
    return same


def intern(text: Bytes, start: np.ndarray, size: np.ndarray, keys: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Slot of each stretch in an open-addressed table, and the owner (a stretch number) of each slot, -1 where empty."""
    keys = xxhash64(text, start, size) if keys is None else keys
    room = 1 << max(4, int(2 * len(start)).bit_length())
    owner, slot = np.full(room, -1, np.int64), (keys & np.uint64(room - 1)).astype(np.int64)
    left = np.arange(len(start))
    while len(left):
        at = slot[left]
        free = owner[at] < 0
        owner[at[free]] = left[free]  # of several claims one stays
        has = owner[at]
        ours = (keys[has] == keys[left]) & (size[has] == size[left])
        check = np.flatnonzero(ours & (has != left))
        ours[check] = same_bytes(text, start[left[check]], start[has[check]], size[left[check]])
        left = left[~ours]
        slot[left] = (slot[left] + 1) & (room - 1)
    return slot, owner


def occurrences(texts: list[bytes], grams: int, block: int = BLOCK_WORDS) -> Iterator[tuple[Bytes, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(bytes, start, size, text number) of all n-gram occurrences, a block of words at a time, and the text number of each of its words.

    In the bytes single spaces part the words.
    """
    folded = np.frombuffer(b" ".join(texts).translate(FOLD) + b" ", np.uint8)
    word = folded != SPACE
    keep = word.copy()
    keep[1:] |= word[:-1]
    ends_of_text = np.cumsum([len(t) + 1 for t in texts])
    compact = folded[keep]
    text = Bytes(compact.tobytes())
    ends = np.flatnonzero(compact == SPACE)
    starts = np.concatenate([[0], ends[:-1] + 1]) if len(ends) else ends
    # words before the end of each text
    upto = np.searchsorted(ends, np.cumsum(keep)[ends_of_text - 1] - 1, side="right") if len(ends) else np.zeros(len(texts), np.int64)
    of = np.repeat(np.arange(len(texts)), np.diff(upto, prepend=0))
    for lo in range(0, len(starts), block):
        hi = min(lo + block, len(starts))
        start, size, doc = [], [], []
        for k in range(grams):
            first = np.arange(lo, min(hi, len(starts) - k))
            first = first[of[first] == of[first + k]] if k else first
            start.append(starts[first])
            size.append(ends[first + k] - starts[first])
            doc.append(of[first])
        yield text, np.concatenate(start), np.concatenate(size), np.concatenate(doc), of[lo:hi]


def slots(text: Bytes, start: np.ndarray, size: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Slot of each occurrence, and bucket and count of each slot."""
    slot, owner = intern(text, start, size)
    used = np.flatnonzero(owner >= 0)
    view, crc = memoryview(text.raw), zlib.crc32
    a = start[owner[used]]
    bucket = np.zeros(len(owner), np.int64)
    bucket[used] = np.fromiter((crc(view[i:j]) for i, j in zip(a.tolist(), (a + size[owner[used]]).tolist())), np.int64, len(used)) % buckets
    return slot, bucket, np.bincount(slot, minlength=len(owner))


def _slices(batches) -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    """Parts of the batches of about ``SLICE_BYTES`` of text, the last column, with the texts."""
    for batch in batches:
        sizes = np.array([len(x) for x in batch.columns[-1].cast(pa.binary()).fill_null(b"").to_pylist()], np.int64) if batch.num_rows else np.zeros(0, np.int64)
        part = np.cumsum(sizes) // SLICE_BYTES
        cuts = np.concatenate([[0], np.flatnonzero(np.diff(part)) + 1, [batch.num_rows]])
        for lo, hi in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
            if hi > lo:
                own = batch.slice(lo, hi - lo)
                yield own, own.columns[-1].cast(pa.binary()).fill_null(b"").to_pylist()


def bucket_counts(docs: DataFrame, text_col: str = "text", buckets: int = BUCKETS, grams: int = GRAMS) -> np.ndarray:
    """Feature occurrences of all texts per bucket."""
    def run(batches):
        total = np.zeros(buckets, np.int64)
        for _, texts in _slices(batches):
            for text, start, size, _, _ in occurrences(texts, grams):
                _, bucket, count = slots(text, start, size, buckets)
                total += np.bincount(bucket, count, buckets).astype(np.int64)
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int32()), pa.array(total[used])], names=["bucket", "n"])

    out = np.zeros(buckets, np.int64)
    for r in docs.select(C(text_col).cast("string").alias("text")).mapInArrow(run, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        out[r["bucket"]] = r["n"]
    return out


def gains(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 * ln) of each bucket's share in the target over that in the corpus, one occurrence added to each bucket."""
    n, all_s, all_t = len(corpus), float(corpus.sum()), float(target.sum())
    return np.array([math.floor(1000 * math.log((t + 1.0) * (all_s + n) / ((s + 1.0) * (all_t + n)))) for s, t in zip(corpus.tolist(), target.tolist())], np.int64)


def weighed(docs: DataFrame, gain: np.ndarray, id_col: str = "doc_id", text_col: str = "text", grams: int = GRAMS) -> DataFrame:
    """(doc_id, n_words, n_features, weight) of every row."""
    def run(batches):
        for batch, texts in _slices(batches):
            weight, features, words = (np.zeros(len(texts), np.int64) for _ in range(3))
            for text, start, size, doc, word in occurrences(texts, grams):
                slot, bucket, _ = slots(text, start, size, len(gain))
                # whole numbers below 2^53, so that sums in doubles are exact
                weight += np.bincount(doc, gain[bucket][slot], len(texts)).astype(np.int64)
                features += np.bincount(doc, minlength=len(texts))
                words += np.bincount(word, minlength=len(texts))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(words), pa.array(features), pa.array(weight)], names=["doc_id", "n_words", "n_features", "weight"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(C(id_col).alias("doc_id"), C(text_col).cast("string").alias("text")).mapInArrow(run, f"doc_id {kind}, n_words long, n_features long, weight long")


def resample(docs: DataFrame, target: DataFrame, percent: int = 5, seed: int = 42, buckets: int = BUCKETS, grams: int = GRAMS, least_words: int = LEAST_WORDS,
             id_col: str = "doc_id", text_col: str = "text", target_col: str = "text") -> DataFrame:
    """Every row with doc_id, n_features, weight, score and the rank of those drawn, all long."""
    gain = gains(bucket_counts(docs, text_col, buckets, grams), bucket_counts(target, target_col, buckets, grams))
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(C("doc_id").cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("double")
    noise = F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0)))
    rows = stage(weighed(docs, gain, id_col, text_col, grams).withColumn("score", C("weight") + noise))
    able = C("n_words") >= least_words
    numbered = number_rows(rows.filter(able).withColumn("_low", -C("score")), ["_low", "doc_id", "n_features", "weight"]).drop("_low")
    drawn = rows.filter(able).count() * percent // 100
    rank = F.when(C("idx") < drawn, C("idx") + 1)
    out = numbered.withColumn("rank", rank).unionByName(rows.filter(~able).withColumn("rank", F.lit(None).cast("long")), allowMissingColumns=True)
    return out.select("doc_id", "n_features", "weight", "score", "rank")
