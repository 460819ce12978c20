"""Quality, language and vector search: held-out accuracy, brute force, edge cases."""
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from barloom.llm import language_id, quality, vector_search
from barloom.llm.queries import QUERIES

SF = "/root/testdata/sf0.01"


def test_ordinal_fit_orders_grades():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(3000, 4)).astype(np.float32)
    y = np.digitize(x @ np.array([2.0, -1.0, 0.5, 0.0]) + rng.logistic(size=3000), [-1.0, 2.0])
    w, t = quality.fit_ordinal(x, y, 3)
    assert t[0] < t[1] and np.allclose(w, [2.0, -1.0, 0.5, 0.0], atol=0.25) and np.allclose(t, [-1.0, 2.0], atol=0.25)


def test_quality_on_held_out_labels(spark):
    docs, rated = spark.read.parquet("/root/testdata/sf0.1/documents.parquet"), quality.graded(spark.read.parquet("/root/testdata/sf0.1/labels.parquet"))
    learn = rated.filter("doc_id % 2 = 0")
    model = quality.fit(docs, learn)
    said = quality.score(docs, model).join(rated.filter("doc_id % 2 = 1"), "doc_id").toPandas()
    assert said[said.grade == 2].kept.mean() > 0.99 and said[said.grade == 0].kept.mean() < 0.02 and said[said.grade == 1].kept.mean() < 0.5  # half of the labels are few for rare words
    means = said.groupby("grade").expected_grade.mean()
    assert means[0] < means[1] < means[2]


def test_quality_edges(spark):
    docs = spark.createDataFrame([(1, None, "k"), (2, "", "k"), (3, "fine words here", "k"), (3, "fine words here", "k"), (None, "word " * 50000, "k")], "doc_id long, text string, kept string")
    none = quality.fit(docs, spark.createDataFrame([], "doc_id long, grade int"))
    one = quality.fit(docs, spark.createDataFrame([(3, 1)], "doc_id long, grade int"))
    assert sorted((str(r.doc_id), r.expected_grade, r.kept) for r in quality.score(docs, none).collect()) == [("1", 0.0, False), ("2", 0.0, False), ("3", 2.0, True), ("3", 2.0, True), ("None", 2.0, True)]
    assert {r.expected_grade for r in quality.score(docs, one).filter("doc_id = 3").collect()} == {1.0}
    out = quality.keep_good(docs, none)
    assert out.columns == docs.columns and out.count() == 3 and quality.keep_good(docs.limit(0), none).count() == 0


def test_quality_sample_is_bounded(spark):
    docs = spark.range(300).select(F.col("id").alias("doc_id"), F.lit("some words").alias("text"))
    assert quality.fit(docs, docs.select("doc_id", (F.col("doc_id") % 2).cast("int").alias("grade")), max_labels=40).thresholds


def test_language_held_out_accuracy(spark):
    got = QUERIES["op3_language_id"](spark, SF).join(spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang"), "doc_id").toPandas()
    assert len(got) == 1000 and (got[got.held_out].lang == got[got.held_out].lang_pred).mean() > 0.98
    assert got.score.between(0, 1).all()


def test_language_edges(spark):
    rows = [(i, t, l, 1) for i, (t, l) in enumerate([("hello there my friend", "en"), ("bonjour mes amis", "fr"), (None, "en"), ("12 34", "fr"), ("some words", None), ("x" * 100000, "en"), ("", "")] * 8)]
    got = language_id.identify(spark.createDataFrame(rows, "doc_id long, text string, lang string, score int")).collect()
    assert len(got) == len(rows)
    by = {r.doc_id: r for r in got}
    assert all(by[i].lang_pred == "und" and by[i].score == 0 for i, t, *_ in rows if t in (None, "12 34", ""))
    assert all(by[i].lang_pred in ("en", "fr") for i, t, *_ in rows if t not in (None, "12 34", ""))
    none = language_id.identify(spark.createDataFrame([(1, "text", None)], "doc_id long, text string, lang string")).collect()
    assert none[0].lang_pred == "und"
    assert language_id.identify(spark.createDataFrame([], "doc_id long, text string, lang string")).count() == 0


@pytest.mark.parametrize("n", [2, 3, 4, 7, 12, 40])
def test_codewords_are_distinct(n):
    codes = language_id.codewords(n)
    assert len({tuple(c) for c in codes}) == n and all(0 < c.sum() < n for c in codes.T)
    if n > 2:
        assert min((codes[i] != codes[j]).sum() for i in range(n) for j in range(i)) >= 2


def brute(rows, k):
    good = [(i, [math.floor(256 * float(np.float32(x))) for x in v]) for i, v in rows if v and all(x is not None and math.isfinite(x) for x in v)]
    out = set()
    for q, v in good:
        if q % 50 == 0:
            scored = sorted((-sum(a * b for a, b in zip(v, w)), i) for i, w in good if i != q)[:k]
            out |= {(q, n + 1, i, -s) for n, (s, i) in enumerate(scored)}
    return out


def test_vector_search(spark):
    rng = random.Random(4)
    rows = [(i, [rng.gauss(0, 1 + i % 5) for _ in range(24)]) for i in range(600)]
    rows[7] = (7, None)
    rows[8] = (8, [None] + rows[9][1][1:])
    rows[50] = (50, [float("nan")] + rows[9][1][1:])
    rows[11] = (11, [float("inf")] + rows[9][1][1:])
    rows[100] = (100, [0.0] * 24)
    rows += [(700 + i, rows[20][1]) for i in range(30)]  # ties
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("norm", F.lit("x"))
    want = brute(rows, 5)
    for shard in (64, 1000):
        assert {tuple(r) for r in vector_search.top_k(df, F.col("vec_id") % 50 == 0, 5, shard_rows=shard).collect()} == want


@pytest.mark.parametrize("large", [1e7, 1e10, 1e30])
def test_vector_search_large(spark, large):
    """Whole numbers of any size: the ranks are those of exact products; only scores within 64 bits are given."""
    rng = random.Random(4)
    rows = [(i, [rng.gauss(0, 1) * (large if i % 2 else 1) for _ in range(8)]) for i in range(120)] + [(200, [large, 1.0] + [0.0] * 6), (250, [large, 2.0] + [0.0] * 6)]
    ints = [(i, [math.floor(x * 256) for x in v]) for i, v in rows]
    want = set()
    for qi, q in ints:
        if qi % 50 == 0:
            best = sorted((-sum(a * b for a, b in zip(q, v)), i) for i, v in ints if i != qi)[:5]
            want |= {(qi, n + 1, i, -s if -1 << 63 <= -s < 1 << 63 else None) for n, (s, i) in enumerate(best)}
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    for shard in (16, 1000):
        assert {tuple(r) for r in vector_search.top_k(df, F.col("vec_id") % 50 == 0, 5, shard_rows=shard).collect()} == want


def test_vector_search_few(spark):
    rows = [(0, [1.0, 2.0]), (1, [0.5, 0.5]), (2, [-1.0, 0.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    assert {tuple(r) for r in vector_search.top_k(df, F.col("vec_id") % 50 == 0, 5).collect()} == brute(rows, 5)
    assert vector_search.top_k(df.limit(0), F.col("vec_id") % 50 == 0, 5).count() == 0


def test_quality_bound_lets_few_toxic_documents_through(spark):
    docs, rated = spark.read.parquet("/root/testdata/sf0.1/documents.parquet"), quality.graded(spark.read.parquet("/root/testdata/sf0.1/labels.parquet"))
    said = quality.score(docs, quality.fit(docs, rated.filter("doc_id % 2 = 0"))).join(rated.filter("doc_id % 2 = 1"), "doc_id").toPandas()
    assert said[said.grade == 1].kept.mean() < 0.3 and said[said.grade == 2].kept.mean() > 0.99


def test_least_bound():
    assert 0.4 < quality._least(np.linspace(0.8, 1, 1000), np.array([0.1, 0.4, 0.9])) <= 0.8
    assert quality._least(np.linspace(0.3, 1, 1000), np.array([])) < 0.31
