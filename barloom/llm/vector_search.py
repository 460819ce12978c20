"""Exact top-k inner products over norm-sorted vectors with SVD-rotated partial sums.

Vectors are taken as integers, floor(scale * x). They are range-sorted by descending length into shards of bounded size. A query meets the
longest vectors first; from then on its k-th best score bounds what may follow: a shard, or a run of vectors in it, is skipped when the query's
length times the longest vector there can't reach that score (Cauchy-Schwarz). Inside a run, vectors and queries are rotated by the singular
vectors of the whole table, so that the first few components hold most of the length; their partial product plus the product of the two
residual lengths bounds the score, and only pairs whose bound reaches the k-th best are multiplied out, in integers.

Defined cases: vectors that are null or hold null or non-finite components take no part, nor do vectors of another dimension than most;
ties go to the smaller id; repeated ids are rows of their own, and a query never meets rows of its own id; fewer than k candidates give fewer
rows; an empty table gives an empty result. Scores are exact for components of any finite size: where the lengths' product could pass 2^53, they
are taken in Python integers; a score that 64 bits can't hold is null, its rank is right all the same.

Queries travel to shards, and only to those that their bound doesn't rule out. The queries of a shard are dealt into blocks of bounded size, and
each block gets a copy of the shard's bounded rows, so that no task takes all queries. The driver gets one matrix of dimension x dimension and
one length and query count per shard.
"""
from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from barloom.llm.common import C
from barloom.sources.stage import stage

SHARD_ROWS = 16384
BLOCK_QUERIES = 8192  # queries of a shard in one task, on average
FOUND = "query_row string, query_id long, vec_id long, score long, rough double, exact string"
RUN = 1024  # vectors bounded together
LEAD = 16  # rotated components of the partial sum
DIGITS = 700  # of the largest product of doubles
EXACT = 2.0 ** 53  # whole numbers below are exact in doubles


def _floor(x: Column) -> Column:
    """The floor as a double; from 2^52 on every double is whole."""
    return F.when(F.abs(x) < 2.0 ** 52, F.floor(x).cast("double")).otherwise(x)


def integer_vectors(rows: DataFrame, id_col: str, vector_col: str, scale: int = 256) -> DataFrame:
    """(vec_id, v, norm) of the vectors that take part; v holds whole numbers as doubles."""
    v = C(vector_col).cast("array<double>")
    good = v.isNotNull() & (F.size(v) > 0) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    ints = rows.filter(good).select(C(id_col).cast("long").alias("vec_id"), F.transform(v, lambda x: _floor(x * F.lit(float(scale)))).alias("v"))
    return ints.withColumn("norm", F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x)))


def rotation(vectors: DataFrame, dim: int) -> np.ndarray:
    """Right singular vectors of the whole table, largest first: eigenvectors of the sum of the outer products."""
    def run(batches):
        total = np.zeros((dim, dim))
        for b in batches:
            if len(b):
                m = np.stack(b["v"].to_numpy()).astype(np.float64)
                total += m.T @ m
        yield pd.DataFrame({"i": np.repeat(np.arange(dim), dim), "j": np.tile(np.arange(dim), dim), "x": total.ravel()})

    gram = np.zeros((dim, dim))
    for r in vectors.select("v").mapInPandas(run, "i int, j int, x double").groupBy("i", "j").agg(F.sum("x").alias("x")).collect():
        gram[r.i, r.j] = r.x
    return np.linalg.eigh(gram)[1][:, ::-1]


class Shard:
    """Candidates of one shard, longest first, and their rotated leading parts."""

    def __init__(self, ids: np.ndarray, v: np.ndarray, turn: np.ndarray, lead: int):
        norm = np.sqrt((v.astype(np.float64) ** 2).sum(1))
        order = np.lexsort((ids, -norm))
        self.ids, self.v, self.norm = ids[order], v[order].astype(np.float64), norm[order]
        turned = self.v @ turn
        self.lead = turned[:, :lead]
        self.rest = np.sqrt((turned[:, lead:] ** 2).sum(1))

    def top(self, q_ids: np.ndarray, q: np.ndarray, floor: np.ndarray, turn: np.ndarray, lead: int, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query row, candidate id, score) of the best k of each query that reach its floor."""
        q = q.astype(np.float64)
        length = np.sqrt((q ** 2).sum(1))
        turned = q @ turn
        q_lead, q_rest = turned[:, :lead], np.sqrt((turned[:, lead:] ** 2).sum(1))
        whole = length.max(initial=0.0) * self.norm.max(initial=0.0) < EXACT
        best_s = np.full((len(q), k), -np.inf, np.float64 if whole else object)
        best_i = np.full((len(q), k), np.iinfo(np.int64).max)
        if not whole:
            floor = np.nextafter(floor, -np.inf)  # it was rounded
        for lo in range(0, len(self.ids), RUN):
            hi = min(lo + RUN, len(self.ids))
            least = np.maximum(floor, best_s[:, -1].astype(np.float64))
            slack = 1e-9 * (1 + length * self.norm[lo])  # rounding of the bounds; the scores themselves are exact
            live = np.flatnonzero(length * self.norm[lo] + slack >= least)
            if not len(live):
                break  # the vectors that follow are shorter still
            bound = q_lead[live] @ self.lead[lo:hi].T + np.outer(q_rest[live], self.rest[lo:hi])
            a, b = np.nonzero((bound >= (least - slack)[live, None]) & (self.ids[None, lo:hi] != q_ids[live, None]))
            for s in range(0, len(a), 1 << 16):
                qa, cb = live[a[s:s + (1 << 16)]], lo + b[s:s + (1 << 16)]
                if whole:
                    score = np.einsum("ij,ij->i", q[qa], self.v[cb])
                else:
                    score = np.array([sum(int(x) * int(y) for x, y in zip(q[i], self.v[j])) for i, j in zip(qa, cb)], object)
                self._keep(best_s, best_i, qa, self.ids[cb], score, k)
        r, c = np.nonzero((best_s > -np.inf) & (best_s >= floor[:, None]))
        return r, best_i[r, c], best_s[r, c]

    @staticmethod
    def _keep(best_s, best_i, rows, ids, score, k) -> None:
        touched, at = np.unique(rows, return_inverse=True)
        r = np.concatenate([at, np.repeat(np.arange(len(touched)), k)])
        i, s = np.concatenate([ids, best_i[touched].ravel()]), np.concatenate([score, best_s[touched].ravel()])
        order = np.lexsort((i, -s, r)) if s.dtype != object else np.array(sorted(range(len(r)), key=lambda x: (r[x], -s[x], i[x])), int)
        r, i, s = r[order], i[order], s[order]
        rank = np.arange(len(r)) - np.searchsorted(r, r)
        use = rank < k
        best_s[touched[r[use]], rank[use]], best_i[touched[r[use]], rank[use]] = s[use], i[use]


def _said(score: np.ndarray) -> tuple[pd.Series, np.ndarray, list[str | None]]:
    """Scores as whole numbers (null beyond 64 bits), as doubles, and for those beyond 2^53 as texts in numeric order."""
    ints = [int(x) for x in score]
    return (pd.Series([x if -1 << 63 <= x < 1 << 63 else None for x in ints], dtype="Int64"), np.array([float(x) for x in ints], np.float64),
            [None if abs(x) < 1 << 53 else f"{x + 10 ** DIGITS:0{DIGITS + 1}d}" for x in ints])


def _search(candidates: DataFrame, queries: DataFrame, turn: np.ndarray, k: int, lead: int) -> DataFrame:
    """Best k of each query in each shard it was sent to: rows (query_id, vec_id, score). A shard's candidates come before its queries."""
    def run(batches):
        shard, own, got = None, None, []
        for b in batches:
            # a batch may close one block and open the next
            for (s, block, is_query), part in b.groupby(["shard", "block", "is_query"], sort=True):
                if (s, block) != own:
                    own, got, shard = (s, block), [], None
                if not is_query:
                    got.append((part["vec_id"].to_numpy(np.int64), np.stack(part["v"].to_numpy())))
                    continue
                if not got:
                    continue
                if shard is None:
                    shard = Shard(np.concatenate([x[0] for x in got]), np.concatenate([x[1] for x in got]), turn, lead)
                for lo in range(0, len(part), 512):
                    p = part.iloc[lo:lo + 512]
                    ids = p["vec_id"].to_numpy(np.int64)
                    r, i, found = shard.top(ids, np.stack(p["v"].to_numpy()), p["floor"].to_numpy(np.float64), turn, lead, k)
                    if not len(r):
                        continue  # a column without rows has no type
                    score, rough, exact = _said(found)
                    yield pd.DataFrame({"query_row": p["query_row"].to_numpy()[r], "query_id": ids[r], "vec_id": i, "score": score, "rough": rough, "exact": exact})

    blocks = {r["shard"]: -(-r["count"] // BLOCK_QUERIES) for r in queries.groupBy("shard").count().collect()}
    if not blocks:
        return queries.sparkSession.createDataFrame([], FOUND)
    if len(blocks) == 1:
        (only, n), = blocks.items()
        dealt = lambda d: d.filter(C("shard") == only).withColumn("blocks", F.lit(n).cast("long"))
    else:
        many = queries.sparkSession.createDataFrame(list(blocks.items()), "shard int, blocks long")
        dealt = lambda d: d.join(F.broadcast(many), "shard")
    cols = ["shard", "block", "is_query", "vec_id", "v", "floor", "query_row"]
    copies = dealt(candidates).withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), C("blocks") - 1)))
    asks = dealt(queries).withColumns({"block": F.pmod(F.xxhash64("query_row"), C("blocks")), "is_query": F.lit(True)})
    both = copies.withColumns({"is_query": F.lit(False), "floor": F.lit(0.0), "query_row": F.lit("")}).select(cols).unionByName(asks.select(cols))
    return both.repartition("shard", "block").sortWithinPartitions("shard", "block", "is_query").mapInPandas(run, FOUND)


def top_k(rows: DataFrame, is_query: Column, k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = 256, shard_rows: int = SHARD_ROWS, lead: int = LEAD) -> DataFrame:
    """The k best of each query: query_id, rank, vec_id, score."""
    spark = rows.sparkSession
    vectors = stage(integer_vectors(rows, id_col, vector_col, scale))
    sizes = vectors.groupBy(F.size("v").alias("dim")).count().orderBy(F.desc("count"), "dim").limit(1).collect()
    if not sizes:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    dim, n = sizes[0]["dim"], sizes[0]["count"]
    vectors = vectors.filter(F.size("v") == dim)
    turn = rotation(vectors, dim)
    ranged = vectors.repartitionByRange(-(-n // shard_rows), F.desc("norm"), "vec_id")
    shards = stage(ranged.withColumn("shard", F.spark_partition_id()))
    longest = {r["shard"]: r["norm"] for r in shards.groupBy("shard").agg(F.max("norm").alias("norm")).collect()}
    order = sorted(longest, key=lambda s: -longest[s])
    asks = shards.filter(is_query).withColumn("query_row", F.concat_ws("/", C("vec_id").cast("string"), F.xxhash64("v").cast("string"))).dropDuplicates(["query_row"]).drop("shard")
    first = stage(_search(shards.filter(C("shard") == order[0]), asks.withColumns({"shard": F.lit(order[0]), "floor": F.lit(float("-inf"))}), turn, k, lead))
    found = first
    if len(order) > 1:
        least = first.groupBy("query_row").agg(F.min("rough").alias("least"), F.count("*").alias("n"))
        floor = F.when(C("n") == k, C("least")).otherwise(F.lit(float("-inf")))
        known = asks.join(least, "query_row", "left").withColumn("floor", F.coalesce(floor, F.lit(float("-inf"))))
        # where the query's length times the longest vector of a shard stays below the floor, the query doesn't go there
        reach = F.array(*[F.struct(F.lit(s).alias("shard"), F.lit(float(longest[s])).alias("norm")) for s in order[1:]])
        sent = known.withColumn("to", F.explode(F.filter(reach, lambda s: C("norm") * s["norm"] * (1 + 1e-9) >= C("floor")))).select("query_row", "vec_id", "v", "floor", "to.shard")
        found = first.unionByName(_search(shards.filter(C("shard") != order[0]), sent, turn, k, lead))
    rank = F.row_number().over(W.partitionBy("query_row").orderBy(F.desc("rough"), F.desc("exact"), "vec_id"))
    return found.withColumn("rank", rank).filter(C("rank") <= k).select("query_id", C("rank").cast("int").alias("rank"), "vec_id", "score")


SQL = """WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(x::DOUBLE * 256)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS query_id, b.vec_id, list_dot_product(a.v, b.v)::BIGINT AS score FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE a.vec_id % 50 = 0)
SELECT query_id, rank, vec_id, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank FROM s) WHERE rank <= 5"""
