"""Exact dedup, mixing and URL filters against plain Python."""
import hashlib
import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from barloom.llm import exact_dedup, mixing, url_filters

DOCS = "doc_id long, text string, source string, digest string, row int"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def docs(spark, rows):
    return spark.createDataFrame([(i, t, s, "x", 1) for i, t, s in rows], DOCS)


ROWS = [(1, "Same text", "a"), (2, "same TEXT", "b"), (3, None, "a"), (4, "", None), (5, "É", "a"), (6, "é", "a"), (7, "same text", "a"), (None, "same text", "b"),
        (None, "alone", None), (8, "x " * 60000, "b"), (9, "X " * 60000, "b"), (5, "É", "a"), (10, "İ", "c"), (11, "i̇", "c")] + [(i, "hot copy", "hot") for i in range(100, 400)]


def groups(rows):
    by = defaultdict(list)
    for i, t, _ in rows:
        by[(t or "").translate(LOWER)].append(i)
    out = set()
    for t, ids in by.items():
        keep = max((i for i in ids if i is not None), default=None)
        out |= {(i, keep, len(ids), i == keep, hashlib.sha256(t.encode()).hexdigest()) for i in ids}
    return out


@pytest.mark.parametrize("bits", [1 << 30, 32768])
def test_exact_groups(spark, bits):
    assert {tuple(r) for r in exact_dedup.exact_groups(docs(spark, ROWS), max_bits=bits).collect()} == groups(ROWS)


def test_exact_survivors_keep_clashing_columns(spark):
    got = exact_dedup.exact_dedup(docs(spark, ROWS))
    assert got.columns == ["doc_id", "text", "source", "digest", "row"]
    assert Counter(r.doc_id for r in got.collect()) == Counter(i for i, *_, kept, _ in groups(ROWS) if kept)


def test_exact_empty(spark):
    assert exact_dedup.exact_groups(docs(spark, [])).count() == 0 and exact_dedup.exact_dedup(docs(spark, [])).count() == 0


def test_filter_passes_unique_rows_without_shuffle(spark):
    keys = spark.range(5000).select(F.unhex(F.sha2(F.col("id").cast("string"), 256)).alias("digest"))
    flagged = exact_dedup.flag_repeated(keys, *exact_dedup.repeated_filter(keys, 5000))
    assert flagged.filter("maybe_repeated").count() < 250
    twice = keys.union(keys)
    assert exact_dedup.flag_repeated(twice, *exact_dedup.repeated_filter(twice, 10000)).filter("NOT maybe_repeated").count() == 0


def mixed(rows, weights=(5, 2, 1), share=1.5):
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    sums = Counter()
    for _, t, s in rows:
        sums[s] += size(t)
    names = sorted((s for s in sums if s is not None), key=lambda s: s.encode()) + [None] * (None in sums)
    w = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    target, free, budget = {}, set(names), share * sum(sums.values())
    while free:  # the excess is shared again until no source is above its cap
        level = (budget - sum(target.values())) / sum(w[s] for s in free)
        over = {s for s in free if level * w[s] > 2 * sums[s]}
        if not over:
            target |= {s: level * w[s] for s in free}
            break
        target |= {s: 2.0 * sums[s] for s in over}
        free -= over
    return sums, target


def test_mixing(spark):
    rows = ROWS + [(500 + i, "w " * (i % 7), f"s{i % 4}") for i in range(300)]
    sums, target = mixed(rows)
    got = mixing.plan_mix(docs(spark, rows)).collect()
    assert len(got) == len(rows)
    source = defaultdict(set)
    for i, t, s in rows:
        source[i].add(s)
    taken = Counter()
    for r in got:
        s = next(x for x in source[r.doc_id] if sums[x] == r.source_size)
        assert r.target == pytest.approx(target[s])
        assert 0 <= r.taken <= 2 * r.size and (r.position is None) == (r.taken == 0)
        taken[r.source_size] += r.taken
    for s in sums:
        assert taken[sums[s]] == pytest.approx(sum(target[x] for x in sums if sums[x] == sums[s]), abs=2)
    again = mixing.plan_mix(docs(spark, rows[::-1]).repartition(7)).collect()
    assert sorted(map(str, got)) == sorted(map(str, again))


def test_mixing_levels_of_many_sources(spark):
    rows = [(i, "w " * (1 + i % 5), f"src{i % 20:02d}" if i % 3 else "src00") for i in range(600)]
    sums, target = mixed(rows)
    got = {r.source_size: r.target for r in mixing.plan_mix(docs(spark, rows)).collect()}
    assert sum(target.values()) == pytest.approx(1.5 * sum(sums.values()))
    assert set(got) == set(sums.values())
    for s, t in target.items():
        if list(sums.values()).count(sums[s]) == 1:
            assert got[sums[s]] == pytest.approx(t)


def test_mix_rows_are_passes_in_order(spark):
    rows = [(i, "a b c d", f"s{i % 3}") for i in range(200)]
    out = mixing.mix(docs(spark, rows), with_position=True).collect()
    plan = {r.doc_id: r.taken for r in mixing.plan_mix(docs(spark, rows)).collect()}
    words = Counter()
    for r in out:
        words[r.doc_id] += len(r.text.split())
    assert {k: v for k, v in plan.items() if v} == dict(words)
    due = defaultdict(list)
    for r in out:
        due[r.doc_id].append(r.mix_position)
    assert {r.doc_id: r.positions for r in mixing.plan_mix(docs(spark, rows)).collect() if r.taken} == due and any(len(p) == 2 for p in due.values())
    at = [r.mix_position for r in out]
    assert at == sorted(at) and 0 <= at[0] and at[-1] <= 1
    early = Counter(r.source for r in out if r.mix_position < 0.3)
    late = Counter(r.source for r in out if r.mix_position > 0.7)
    assert early["s0"] > late["s0"] and early["s2"] < late["s2"]  # the first class fades out, the third comes in


def test_position_inverts_the_integral(spark):
    knots = ((0.0, 0.5), (0.5, 0.75), (1.0, 2.0))
    f = spark.range(0, 101).select((F.col("id") / 100).alias("f"))
    area = lambda t: 0.5 * t + 0.25 * t * t if t <= 0.5 else 0.3125 + 0.75 * (t - 0.5) + 1.25 * (t - 0.5) ** 2
    for r in f.select("f", mixing.position_at(F.col("f"), knots).alias("t")).collect():
        assert area(r.t) == pytest.approx(r.f * area(1.0), abs=1e-9)


def test_mixing_empty(spark):
    assert mixing.plan_mix(docs(spark, [])).count() == 0 and mixing.mix(docs(spark, [(1, None, None)])).count() == 0


def test_url_filters(spark):
    caps = spark.createDataFrame([(1, "http://a.bad.com/x", 10, "c"), (2, "https://user@BAD.com:80/", 20, "c"), (3, "http://good.com", 20, "c"), (4, None, 20, "c"), (5, "nonsense", 20, "c"),
                                  (6, "http://bad.com", None, "c"), (7, "http://x.a.bad.com./", 12, "c"), (1, "http://a.bad.com/x", 10, "c"), (8, "http://notbad.com", 12, "c"), (9, "http://bad.com", 15, "c")],
                                 "page_id long, url string, fetched_at long, category string")
    entries = spark.createDataFrame([("bad.com", 5, "add", "spam"), ("bad.com", 15, "drop", "spam"), ("a.bad.com", 11, "add", "adult"), (None, 1, "add", "x"), ("good.com", 20, "add", "x"), ("good.com", 20, "drop", "x")],
                                    "rule string, at long, action string, category string")
    got = sorted((r.page_id, r.blocked, r.rule, r.category, r.listed_at) for r in url_filters.filter_urls(caps, entries).collect())
    no = lambda i: (i, False, None, None, None)
    assert got == [(1, True, "bad.com", "spam", 5)] * 2 + [no(2), no(3), no(4), no(5), no(6), (7, True, "a.bad.com", "adult", 11), no(8), no(9)]
    assert url_filters.filter_urls(caps.limit(0), entries.limit(0)).count() == 0


def test_url_rules_in_any_case(spark):
    caps = spark.createDataFrame([(1, "http://example.com/", 15), (2, "http://www.EXAMPLE.com", 25), (3, "http://example.com", 35), (4, "http://other.org", 15)], "page_id long, url string, fetched_at long")
    entries = spark.createDataFrame([("Example.com", 10, "add", "x"), ("example.com.", 20, "drop", "x"), ("EXAMPLE.COM", 30, "add", "x"), ("...", 1, "add", "x")] + [(f"unseen{i}.net", i, "add", "x") for i in range(500)],
                                    "rule string, at long, action string, category string")
    got = {r.page_id: (r.blocked, r.rule, r.listed_at) for r in url_filters.filter_urls(caps, entries).collect()}
    assert got == {1: (True, "example.com", 10), 2: (False, None, None), 3: (True, "example.com", 30), 4: (False, None, None)}
