"""Importance resampling against a plain count of words, and the interning table against the library."""
import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import xxhash

from barloom.llm import importance as I
from barloom.llm.queries import QUERIES

WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def features(text):
    low = (text or "").encode("utf-8", "surrogatepass")
    low = bytes(b + 32 if 65 <= b <= 90 else b for b in low)
    words = WORD.findall(low)
    return words, [b" ".join(words[i:i + k]) for k in (1, 2, 3) for i in range(len(words) - k + 1)]


def brute(docs, target, buckets=10000, percent=5, seed=42, least=20):
    S, T = Counter(), Counter()
    for _, t in docs:
        S.update(zlib.crc32(f) % buckets for f in features(t)[1])
    for t in target:
        T.update(zlib.crc32(f) % buckets for f in features(t)[1])
    ns, nt = float(sum(S.values())), float(sum(T.values()))
    gain = [math.floor(1000 * math.log((T[b] + 1.0) * (ns + buckets) / ((S[b] + 1.0) * (nt + buckets)))) for b in range(buckets)]
    out = []
    for i, t in docs:
        words, f = features(t)
        w = sum(gain[zlib.crc32(x) % buckets] for x in f)
        h = int(hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        out.append([i, len(f), w, w + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), len(words)])
    able = sorted((r for r in out if r[4] >= least), key=lambda r: (-r[3], r[0] is not None, r[0] or 0, r[1], r[2]))
    rank = {id(r): n + 1 for n, r in enumerate(able[: percent * len(able) // 100])}
    return Counter((r[0], r[1], r[2], r[3], rank.get(id(r))) for r in out)


def test_hash_is_the_library():
    rng = random.Random(1)
    raw = bytes(rng.randrange(256) for _ in range(5000))
    text = I.Bytes(raw)
    start = np.array([rng.randint(0, 4900) for _ in range(3000)])
    size = np.array([rng.randint(0, 60) for _ in range(3000)])
    assert I.xxhash64(text, start, size).tolist() == [xxhash.xxh64_intdigest(raw[a:a + n]) for a, n in zip(start, size)]


def test_interning_by_bytes():
    rng = random.Random(2)
    words = [bytes(rng.choice(b"ab") for _ in range(rng.randint(1, 24))) for _ in range(4000)]
    raw, start, size = b" ".join(words), [], []
    for w in words:
        start.append(sum(size) + len(size))
        size.append(len(w))
    text, start, size = I.Bytes(raw), np.array(start), np.array(size)
    # equal keys for all, few keys, and the real ones: bytes decide in each case
    for keys in (np.zeros(len(words), np.uint64), (size % 3).astype(np.uint64), None):
        slot, owner = I.intern(text, start, size, keys)
        names = {}
        for w, s in zip(words, slot.tolist()):
            assert names.setdefault(s, w) == w
            assert words[owner[s]] == w
        assert len(set(names.values())) == len(names) == len(set(words))


def test_blocks_do_not_matter():
    texts = [b"a b c d e f g", b"", b"--", "É日本 x A9 z".encode(), b"one", b"a b c " * 50]
    want = [Counter(features(t.decode())[1]) for t in texts]
    for block in (1, 2, 5, 1000):
        got, words = [Counter() for _ in texts], np.zeros(len(texts), int)
        for text, start, size, doc, word in I.occurrences(texts, 3, block):
            for a, n, d in zip(start, size, doc):
                got[d][text.raw[a:a + n]] += 1
            words += np.bincount(word, minlength=len(texts))
        assert got == want
        assert words.tolist() == [len(features(t.decode())[0]) for t in texts]
    assert list(I.occurrences([b"", b"."], 3)) == []


def test_resample(spark):
    rng = random.Random(3)
    vocab = ["Alpha", "beta", "gamma-ray", "日本", "x1", "Été", "the", "of", "9"]
    docs = [(i, " ".join(rng.choice(vocab) for _ in range(rng.choice([0, 3, 19, 20, 21, 80])))) for i in range(400)]
    docs += [(500, None), (501, ""), (502, "..."), (None, "alpha " * 30), (503, "beta " * 25), (503, "beta " * 25), (504, "gamma " * 60000)]
    target = ["Alpha beta gamma", None, "the of the", "日本 x1"]
    d = spark.createDataFrame([(*r, 1) for r in docs], "doc_id long, text string, score int").repartition(5)
    t = spark.createDataFrame([(x,) for x in target], "text string")
    got = Counter(tuple(r) for r in I.resample(d, t, percent=20).collect())
    assert got == brute(docs, target, percent=20)
    assert sorted(r[4] for r in got.elements() if r[4]) == list(range(1, sum(1 for _, x in docs if len(features(x)[0]) >= 20) * 20 // 100 + 1))
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert I.resample(empty, t).count() == 0
    assert I.resample(d, empty).count() == len(docs)


def test_query(spark):
    sf = "/root/testdata/sf0.001"
    docs = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    target = [r.text for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    assert Counter(tuple(r) for r in QUERIES["op13_importance_resampling"](spark, sf).collect()) == brute(docs, target)
