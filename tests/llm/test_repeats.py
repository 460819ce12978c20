"""Near duplicates and repeated spans against brute force."""
import random
from collections import defaultdict

import numpy as np

from barloom.llm import near_dedup, substring_dedup

SCHEMA = "doc_id long, text string, set string, rep int"


def corpus(seed, hot=60):
    rng = random.Random(seed)
    word = lambda: rng.choice("abcdefghij") + rng.choice("klmnop") + str(rng.randint(0, 60))
    passage = [word() for _ in range(40)]
    rows, base = [], [word() for _ in range(120)]
    for i in range(hot):  # near copies that drift apart
        t = list(base)
        for _ in range(rng.randint(0, 4)):
            t[rng.randrange(len(t))] = word()
        if i % 7 == 0:
            base = t
        rows.append(" ".join(t))
    for i in range(80):  # a common passage in unrelated texts
        own = [word() for _ in range(rng.randint(0, 60))]
        at = rng.randint(0, len(own))
        rows.append(" ".join(own[:at] + passage + own[at:]))
    rows += [rows[3].upper(), rows[3], None, "", " \n", "one two", "ONE two", "one two three four five six", "a b c d e", "x " * 30000, "x " * 29990 + "y"]
    rows += [" ".join(word() for _ in range(rng.randint(1, 30))) for _ in range(60)]
    ids = list(range(len(rows)))
    rng.shuffle(ids)
    return [(i, t, "s", 1) for i, t in zip(ids, rows)]


def shingles(t):
    w = (t or "").encode().lower().split()
    return {tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def linked(rows, percent):
    sets = {i: shingles(t) for i, t, *_ in rows}
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x
    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[k + 1:]:
            i = len(sets[a] & sets[b])
            if i and 100 * i >= percent * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i)) for i in ids}


def test_near_groups(spark):
    for seed, percent in ((1, 85), (2, 80)):
        rows = corpus(seed)
        got = near_dedup.near_groups(spark.createDataFrame(rows, SCHEMA).repartition(4), percent=percent).collect()
        assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == linked(rows, percent)
        assert all(r.kept == (r.doc_id == r.component_id) for r in got) and len(got) == len(rows)


def test_near_dedup_rows(spark):
    rows = corpus(3, 20) + [(None, "null id text", "s", 1), (None, "null id text", "s", 1)]
    out = near_dedup.near_dedup(spark.createDataFrame(rows, SCHEMA))
    assert out.columns == ["doc_id", "text", "set", "rep"]
    want = {i for i, (_, c) in linked([r for r in rows if r[0] is not None], 80).items() if i == c}
    got = [r.doc_id for r in out.collect()]
    assert {x for x in got if x is not None} == want and got.count(None) == 2


def test_near_empty(spark):
    assert near_dedup.near_groups(spark.createDataFrame([], SCHEMA)).count() == 0


def test_components_of_chains(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(60)] + [(100, 200), (300, 200)], "a long, b long")
    got = {r.node: r.root for r in near_dedup.components(links).collect()}
    assert got == {**{i: 0 for i in range(61)}, 100: 100, 200: 100, 300: 100}


def without_repeats(rows, window=13):
    words = {i: (t or "").encode().split() for i, t, *_ in rows if i is not None}
    low = {}
    for i, w in words.items():
        for p in range(len(w) - window + 1):
            g = tuple(w[p:p + window])
            low[g] = min(low.get(g, i), i)
    out = {}
    for i, w in words.items():
        gone = set()
        for p in range(len(w) - window + 1):
            if low[tuple(w[p:p + window])] < i:
                gone.update(range(p, p + window))
        out[i] = (len(w), len(gone), b" ".join(x for k, x in enumerate(w) if k not in gone).decode())
    return out


def test_repeats_removed(spark):
    for seed in (5, 6):
        rows = corpus(seed)
        got = substring_dedup.remove_repeats(spark.createDataFrame(rows, SCHEMA).repartition(3)).collect()
        assert {r.doc_id: (r.n_words, r.n_removed, r.text) for r in got} == without_repeats(rows)


def test_spans_are_equal_words(spark):
    rows = corpus(7)
    words = {i: (t or "").encode().split() for i, t, *_ in rows}
    spans = substring_dedup.repeated_spans(spark.createDataFrame(rows, SCHEMA)).collect()
    assert spans
    for s in spans:
        assert s.n_words >= 13 and s.src_doc < s.doc
        assert words[s.doc][s.start:s.start + s.n_words] == words[s.src_doc][s.src_start:s.src_start + s.n_words]


def test_repeats_null_and_equal_ids(spark):
    long = " ".join(f"w{i}" for i in range(20))
    rows = [(1, long, "s", 1), (1, long, "s", 1), (None, long, "s", 1), (2, "z " + long, "s", 1), (2, "other text that is its own and has more than thirteen words in it, certainly", "s", 1)]
    got = sorted((str(r.doc_id), r.n_words, r.n_removed) for r in substring_dedup.remove_repeats(spark.createDataFrame(rows, SCHEMA)).collect())
    assert got == [("1", 20, 0), ("1", 20, 0), ("2", 15, 0), ("2", 21, 20), ("None", 20, 0)]
    assert substring_dedup.remove_repeats(spark.createDataFrame([], SCHEMA)).count() == 0


def test_windows_of_a_hot_minimizer_need_more_than_32_bits(spark):
    rng = np.random.default_rng(5)
    vocabulary = [b"w%d" % i for i in range(4000)]
    known = near_dedup.WordHashes().of(vocabulary)
    common = rng.integers(0, 4000, 1_000_006)
    at = int(near_dedup.sequence_hashes(known[common], 6).argmin())  # six words that are nearly always the minimizer
    rows = np.concatenate([np.tile(common[at:at + 6], (400_000, 1)), rng.integers(0, 4000, (400_000, 7))], 1)
    half = near_dedup.sequence_hashes(known[rows].T, 13).ravel() >> np.uint64(32)
    order = np.argsort(half, kind="stable")
    pairs = [(order[i], order[i + 1]) for i in np.flatnonzero(half[order][1:] == half[order][:-1])]
    assert pairs
    texts = [" ".join(vocabulary[w].decode() for w in rows[i]) for pair in pairs for i in pair]
    got = substring_dedup.remove_repeats(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    assert len(set(texts)) == len(texts) == len(got) and all(r.n_removed == 0 for r in got)


def test_spans_are_held_against_their_source(spark):
    docs = spark.createDataFrame([(1, " ".join(f"a{i}" for i in range(40))), (2, " ".join(f"a{i}" if i != 20 else "other" for i in range(40))), (3, "b " * 40)], "doc_id long, text string")
    spans = spark.createDataFrame([(2, 0, 40, 1, 0), (2, 0, 20, 1, 0), (3, 0, 13, 1, 5), (3, 0, 30, 1, 5)], "doc long, start int, n_words int, src_doc long, src_start int")
    got = {(r.doc, r.start, r.n_words) for r in substring_dedup.verified_spans(docs, spans).collect()}
    assert got == {(2, 0, 20)} | {(2, i, 13) for i in [*range(8), *range(21, 28)]}
