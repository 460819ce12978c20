"""Centroid clustering against plain integer loops."""
import hashlib
import math
import random
from collections import Counter

import numpy as np
import pytest

from barloom.llm import centroids as K


def brute(rows, k=8, rounds=10, seed=3, scale=1024, dim=64):
    kept = [(i, [math.floor(float(np.float64(x)) * scale) for x in v]) for i, v in rows if v is not None and len(v) == dim and all(x is not None and math.isfinite(x) for x in v)]
    key = lambda r: (r[0] is None, "" if r[0] is None else hashlib.sha256(f"{seed}:{r[0]}".encode()).hexdigest())
    cen = [v for _, v in sorted(kept, key=key)[:k]]
    near = lambda v: min((sum((a - b) ** 2 for a, b in zip(v, c)), n) for n, c in enumerate(cen))
    for _ in range(rounds):
        own = [near(v)[1] for _, v in kept]
        for c in range(len(cen)):
            mine = [v for (_, v), o in zip(kept, own) if o == c]
            if mine:
                cen[c] = [sum(x) // len(mine) for x in zip(*mine)]
    said = [near(v) for _, v in kept]
    per = Counter()
    for d, c in said:
        per[c] += d
    fit = lambda x: x if x < 2 ** 63 else None
    # a sum over a distance that doesn't fit is null as well
    bad = {c for d, c in said if d >= 2 ** 63}
    return Counter((i, c, fit(d), None if c in bad else fit(per[c]), None if bad else fit(sum(per.values())), hashlib.sha256(",".join(map(str, cen[c])).encode()).hexdigest()) for (i, _), (d, c) in zip(kept, said))


def test_transform_is_exact():
    rng = np.random.default_rng(1)
    v = rng.integers(-1 << 24, 1 << 24, (50, 64))
    w = K.walsh(v)
    assert ((w - w[:1]) ** 2).sum(1).tolist() == [64 * int(d) for d in ((v - v[:1]) ** 2).sum(1)]
    rows = K.walsh(np.eye(64, dtype=np.int64))
    assert [int((np.diff(rows[:, j]) != 0).sum()) for j in range(64)] == list(range(64))
    assert [x // 64 for x in K.walsh_back(w[0].tolist())] == v[0].tolist()


@pytest.mark.parametrize("spread", [1, 3, 1000])
def test_search_is_exact(spread):
    rng = np.random.default_rng(spread)
    v, c = rng.integers(-spread, spread + 1, (500, 64)), rng.integers(-spread, spread + 1, (9, 64))
    c[4] = c[2]
    d = ((v[:, None] - c[None]) ** 2).sum(2)
    for kind in (np.int64, object):
        label, best = K.nearest(K.walsh(v.astype(kind)), K.walsh(c.astype(kind)))
        assert label.tolist() == d.argmin(1).tolist() and [int(x) // 64 for x in best] == d.min(1).tolist()


def table(spark, rows):
    return spark.createDataFrame([(i, v, 0) for i, v in rows], "vec_id long, embedding array<double>, cluster int").repartition(4)


def test_cluster(spark):
    rng = random.Random(1)
    rows = [(i, [rng.gauss(i % 5, 0.7) for _ in range(64)]) for i in range(400)]
    rows += [(500, None), (501, [1.0] * 63), (502, [None] * 64), (503, [float("nan")] + [0.0] * 63), (504, [float("inf")] + [0.0] * 63), (7, rows[7][1]), (7, [0.0] * 64), (None, [0.5] * 64)]
    got = Counter(tuple(r) for r in K.cluster(table(spark, rows)).collect())
    assert got == brute(rows)


@pytest.mark.parametrize("large", [1e6, 1e9, 1e30])
def test_large_components(spark, large):
    rng = random.Random(2)
    rows = [(i, [rng.gauss(0, 1) * (large if i % 3 == 0 else 1) for _ in range(64)]) for i in range(60)]
    assert Counter(tuple(r) for r in K.cluster(table(spark, rows), k=4, rounds=3).collect()) == brute(rows, 4, 3)


def test_few_and_equal_vectors(spark):
    assert K.cluster(table(spark, [(1, [0.0] * 64)]).limit(0)).count() == 0
    rows = [(1, [0.25] * 64), (2, [0.25] * 64), (3, [-1.5] * 64)]
    assert Counter(tuple(r) for r in K.cluster(table(spark, rows)).collect()) == brute(rows)
    with pytest.raises(ValueError):
        K.cluster(table(spark, rows), dim=63)
