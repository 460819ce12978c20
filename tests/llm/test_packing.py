"""Packing against a simulation that serves grain by grain, and against the tokenizer."""
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from barloom.llm import packing as P
from barloom.llm.queries import QUERIES, vocabulary

TOKENIZER = vocabulary("word_bpe_49k.json")


def simulated(sizes, weights, length, grain):
    """Source of every served token, by rounds that visit one queue after the other."""
    left, deficit, served = list(sizes), [0] * len(sizes), []
    while any(left):
        live = [i for i, n in enumerate(left) if n and weights[i]] or [i for i, n in enumerate(left) if n]
        total = sum(max(1, weights[i]) for i in live)
        quanta = {i: max(1, max(1, weights[i]) * length * P.UNIT // total) for i in live}
        dry = False
        while not dry:  # quanta change only between rounds
            for i in live:
                deficit[i] += quanta[i]
                grains, deficit[i] = divmod(deficit[i], grain * P.UNIT)
                n = min(left[i], grains * grain)
                served += [i] * n
                left[i] -= n
                dry |= left[i] == 0
    return served


@pytest.mark.parametrize("sizes,weights,grain", [([900, 31, 4000, 7, 1], None, 64), ([500, 3000, 2500], [5, 2, 1], 16), ([64, 0, 640], [0, 3, 1], 64), ([1], None, 1), ([10, 10, 10], [1, 1000000, 0], 1), ([50000, 3], None, 64)])
def test_portions_are_the_rounds(sizes, weights, grain):
    weights = weights or sizes
    plan = P.plan_rounds(sizes, weights, 256, grain)
    want = simulated(sizes, weights, 256, grain)
    got, rng = [None] * len(want), random.Random(1)
    for s, n in enumerate(sizes):
        cuts = sorted({0, n, *(rng.randint(0, n) for _ in range(5))})
        start, size = np.array(cuts[:-1], np.int64), np.diff(cuts)
        row, at, k, place = P.portions(plan, s, start, size)
        assert Counter({int(r): int(x) for r, x in zip(range(len(size)), np.bincount(row, k, len(size)))}) == Counter({r: int(x) for r, x in enumerate(size)})
        order = {}
        for a, c, p in zip(at.tolist(), k.tolist(), place.tolist()):
            for j in range(c):
                assert got[p + j] is None
                got[p + j] = s
                order[a + j] = p + j
        assert [order[q] for q in range(n)] == sorted(order.values())
    assert got == want


def test_tail_is_powers_of_two():
    for total in (0, 1, 255, 256, 1000, 1023):
        e = P.edges(total, 256)
        assert e[-1] == total and e[0] == total // 256 * 256
        d = np.diff(e).tolist()
        assert all(x & (x - 1) == 0 for x in d) and d == sorted(set(d), reverse=True)


def check(rows, pieces, length, with_ids=True):
    from tokenizers import Tokenizer
    lib = Tokenizer.from_file(TOKENIZER)
    ids = [[*lib.encode(t or "", add_special_tokens=False).ids, 1] for _, t, *_ in rows]
    of = defaultdict(list)
    for p in pieces:
        of[p.doc_id].append(p)
    assert sorted(of, key=str) == sorted({r[0] for r in rows}, key=str)
    for doc in of:
        own = [x for r, x in zip(rows, ids) if r[0] == doc]
        assert sum(p.length for p in of[doc]) == sum(map(len, own))
        if len(own) == 1:
            at = 0
            for p in sorted(of[doc], key=lambda p: p.start):
                assert p.start == at and p.doc_tokens == len(own[0]) and p.length > 0
                assert p.ids_crc32 == zlib.crc32(np.array(own[0][at:at + p.length], "<u4").tobytes())
                if with_ids:
                    assert p.ids == own[0][at:at + p.length]
                at += p.length
            assert at == len(own[0])
    seqs = defaultdict(list)
    for p in pieces:
        seqs[p.sequence_id].append((p.offset, p.length))
    assert sorted(seqs) == list(range(len(seqs)))
    for s, parts in seqs.items():
        at = 0
        for o, n in sorted(parts):
            assert o == at
            at += n
        assert at == length or (at < length and at & (at - 1) == 0)
    return seqs


def test_pack(spark):
    rng = random.Random(5)
    rows = [(i, " ".join(rng.choice(["alpha", "beta,", "Gamma", "x1", "日本", "don't"]) for _ in range(rng.choice([0, 1, 5, 60, 400]))), rng.choice(["b", "a", "a", "a", None]), "x") for i in range(300)]
    rows += [(1000, None, "a", "x"), (1001, "", None, "x"), (None, "no id", "b", "x"), (1002, "twice", "b", "x"), (1002, "twice", "b", "x"), (1003, "word " * 9000, "long", "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, ids string")
    got = P.pack(docs, TOKENIZER, 1, 256, grain=16, with_ids=True).collect()
    seqs = check(rows, got, 256)
    again = P.pack(docs.repartition(7), TOKENIZER, 1, 256, grain=16).collect()
    assert sorted(map(str, again)) == sorted(str(type(r)) and str(a) for a in again for r in [a])
    assert Counter((r.doc_id, r.start, r.length, r.sequence_id, r.offset) for r in again) == Counter((r.doc_id, r.start, r.length, r.sequence_id, r.offset) for r in got)
    # every full sequence holds each source's share, up to grains at its ends
    total = sum(r.length for r in got)
    share = Counter()
    for r in got:
        share[r.source] += r.length
    held = defaultdict(Counter)
    for r in got:
        held[r.sequence_id][r.source] += r.length
    full = [s for s in seqs if sum(n for _, n in seqs[s]) == 256]
    assert len(full) > 50
    for s in full[:-3]:
        for source, n in share.items():
            assert abs(held[s][source] - 256 * n / total) <= 3 * 16


def test_pack_weights_and_equal_rows(spark):
    rows = [(7, "same text", "a")] * 400 + [(8, "b " * 900, "b")]
    got = P.pack(spark.createDataFrame(rows, "doc_id long, text string, source string"), TOKENIZER, 1, 64, {"a": 1, "b": 3}, grain=8).collect()
    assert sum(r.length for r in got if r.doc_id == 7) == 400 * 3
    first = Counter()
    for r in got:
        if r.sequence_id < 5:
            first[r.source] += r.length
    assert 3 * first["a"] == first["b"]
    assert P.pack(spark.createDataFrame([], "doc_id long, text string, source string"), TOKENIZER, 1).count() == 0


def test_query(spark):
    rows = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()]
    check(rows, QUERIES["op12_packing"](spark, "/root/testdata/sf0.001").collect(), 2048, with_ids=False)
