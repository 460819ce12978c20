"""Near-duplicate documents by bottom-k sketches of one hash function.

A document's set is its distinct five-word shingles (A-Z lower-cased; fewer words: the whole sequence as one). Its sketch is the ``K`` smallest
hashes of the set. Inverted lists of retained values generate the overlaps, the sketch of the union estimates the resemblance and filters, and
the exact Jaccard of the full sets verifies: linked is 100 * intersection >= percent * union.

Equal sets are one class from the start, so copies never meet each other. In the inverted lists a class stands only under its rarest values:
two sketches that overlap by ``need`` values share one of their (size - need + 1) rarest. ``need`` lies five standard deviations below the
overlap of a pair that just links, so common passages make no lists (sketches that hold their whole set: the least that the sizes allow). A list is first compared with one member, its pivot; what is in one
component by then needs no comparison. Two rounds follow in which each list still apart has a pivot of its own, drawn by hash, so that the many lists
of a large group join it from many sides; then come all pairs of different components that are left. Sizes and parity maps of the full sets rule
out most pairs in the join itself. No link is lost: each pair in a list was either
verified or had its ends in one component already.

Defined cases: null or word-less text has an empty set, links with nothing and is its own component; a null id has no component
(null) and stays; rows with equal id are one node; an empty table gives an empty result; texts are read whole and extra columns are not read.
"""
from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from barloom.llm.common import C
from barloom.sources.stage import stage

K = 128
BITS = 1024  # of the parity map of a set
WORDS = 5
PERCENT = 80
PIVOT_ROUNDS = 2
CACHE_WORDS = 500_000
SLICE = 256

_M1, _M2, _STEP = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB), np.uint64(0x9E3779B97F4A7C15)


class WordHashes:
    """64-bit hashes of words, kept in a bounded cache."""

    def __init__(self):
        self.known: dict[bytes, int] = {}

    def of(self, words: list[bytes]) -> np.ndarray:
        known = self.known
        if len(known) > CACHE_WORDS:
            known.clear()
        try:
            return np.array([known[w] for w in words], np.uint64)
        except KeyError:
            for w in words:
                if w not in known:
                    known[w] = xxhash.xxh3_64_intdigest(w)
            return np.array([known[w] for w in words], np.uint64)


def sequence_hashes(words: np.ndarray, n: int) -> np.ndarray:
    """Mixed hashes of all runs of n words."""
    m = len(words) - n + 1
    h = np.full(m, n, np.uint64)
    for i in range(n):
        h = h * _STEP + words[i:i + m]
        h ^= h >> np.uint64(29)
    h = (h ^ (h >> np.uint64(30))) * _M1
    h = (h ^ (h >> np.uint64(27))) * _M2
    return h ^ (h >> np.uint64(31))


def shingle_set(text: str | None, hashes: WordHashes, n: int = WORDS) -> np.ndarray:
    """Sorted distinct 63-bit shingle hashes of a text."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.zeros(0, np.int64)
    return np.unique(sequence_hashes(hashes.of(words), min(n, len(words))) >> np.uint64(1)).astype(np.int64)


def _parity_map(values: np.ndarray) -> np.ndarray:
    """Bit i says whether an odd number of values falls on i: equal values of two sets cancel in the exclusive or."""
    return np.packbits((np.bincount(values % BITS, minlength=BITS) & 1).astype(bool), bitorder="little").view("<i8")


def sketches(docs: DataFrame, id_col: str, text_col: str, k: int = K) -> DataFrame:
    """(doc_id, n, digest, sketch, bits): size and fingerprint of the set, its k smallest hashes and the parity map of the whole set."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches):
        hashes = WordHashes()
        for batch in (b.slice(lo, SLICE) for b in batches for lo in range(0, b.num_rows, SLICE)):
            sets = [shingle_set(t, hashes) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(s) for s in sets], pa.int64()), pa.array([xxhash.xxh3_128_digest(s.tobytes()) for s in sets], pa.binary()),
                                              pa.array([s[:k] for s in sets], pa.list_(pa.int64())), pa.array([_parity_map(s) for s in sets], pa.list_(pa.int64()))], names=["doc_id", "n", "digest", "sketch", "bits"])

    return docs.select(C(id_col).alias("doc_id"), C(text_col).cast("string").alias("text")).mapInArrow(run, f"doc_id {kind}, n long, digest binary, sketch array<long>, bits array<long>")


def full_sets(docs: DataFrame, ids: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(rep, set) of the documents in ``ids`` (column rep)."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches):
        hashes = WordHashes()
        for batch in (b.slice(lo, SLICE) for b in batches for lo in range(0, b.num_rows, SLICE)):
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([shingle_set(t, hashes) for t in batch.column(1).to_pylist()], pa.list_(pa.int64()))], names=["rep", "set"])

    own = docs.select(C(id_col).alias("rep"), C(text_col).cast("string").alias("text")).join(ids, "rep")
    return own.mapInArrow(run, f"rep {kind}, set array<long>")


def between(links: DataFrame, labels: DataFrame) -> DataFrame:
    """Links (a, b) between the labels of their ends, each once with a < b; those within one label go."""
    of = lambda name: labels.select(C("node").alias(name), C("root").alias(f"{name}_root"))
    ends = links.select("a", "b").join(of("a"), "a", "left").join(of("b"), "b", "left").select(F.coalesce("a_root", "a").alias("a"), F.coalesce("b_root", "b").alias("b"))
    return ends.filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def labels_of(links: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """(node, root) of the nodes that reach a smaller one by links (a, b): the smallest; ``known`` are such labels by earlier links.

    Each node hooks to its smallest neighbour if that is smaller, hooks are followed to their ends, and links go on between these ends only, so that
    a link of nodes that are one already is met no more. This ends when no link is left.
    """
    none = links.select(C("a").alias("node"), C("b").alias("root")).limit(0)
    labels = none if known is None else known
    edges = stage(between(links, labels))
    while not edges.isEmpty():
        hooks = stage(edges.groupBy(C("b").alias("node")).agg(F.min("a").alias("root")))
        moved = True
        while moved:
            further = hooks.select(C("node").alias("root"), C("root").alias("next"))
            new = stage(hooks.join(further, "root", "left").select("node", F.coalesce("next", "root").alias("root"), C("next").isNotNull().alias("moved")))
            hooks, moved = new.select("node", "root"), not new.filter("moved").isEmpty()
        further = hooks.select(C("node").alias("root"), C("root").alias("next"))
        labels = stage(labels.join(further, "root", "left").select("node", F.coalesce("next", "root").alias("root")).unionByName(hooks))
        edges = stage(between(edges, hooks))
    return labels


def components(links: DataFrame) -> DataFrame:
    """(node, root) of the undirected links (a, b): the smallest node that each node reaches."""
    labels = labels_of(links)
    return labels.unionByName(labels.select(C("root").alias("node"), "root").distinct())


def _may_link(x: str, y: str, percent: int) -> Column:
    """Whether two classes leave room for a link, by their set sizes ``n`` and parity maps ``bits`` (columns x.n, y.n, ...).

    Sets of a link differ in at most ``d`` values, and only these show in the exclusive or of the maps: never in more than ``d`` bits, and as
    several may fall on one bit, in fewer on average; five standard deviations above that mean is the limit where it is lower.
    """
    p = percent / 100
    nx, ny = C(f"{x}n").cast("double"), C(f"{y}n").cast("double")
    d = (nx + ny) * ((1 - p) / (1 + p))
    free = F.exp(d * (-2 / BITS))
    limit = F.least(d + 1e-6, (1 - free) * (BITS / 2) + 5 * F.sqrt((1 - free * free) * (BITS / 4)))
    apart = sum((F.bit_count(C(f"{x}bits")[i].bitwiseXOR(C(f"{y}bits")[i])) for i in range(BITS // 64)), F.lit(0))
    return (F.least(nx, ny) * 100 >= F.greatest(nx, ny) * percent) & (apart <= limit)


def verified(pairs: DataFrame, reps: DataFrame, sets: DataFrame, percent: int, k: int, floor: float) -> DataFrame:
    """The pairs (a, b) that link: the union's sketch filters, the full sets decide."""
    side = lambda t, x: t.select(*[C(c).alias(f"{x}_{c}" if c != "rep" else x) for c in t.columns])
    near = pairs.join(side(reps.select("rep", "n", "sketch"), "a"), "a").join(side(reps.select("rep", "n", "sketch"), "b"), "b")
    union = F.slice(F.array_sort(F.array_union("a_sketch", "b_sketch")), 1, k)
    near = near.withColumn("u", union).withColumn("hits", F.size(F.array_intersect(F.array_intersect("a_sketch", "b_sketch"), C("u"))))
    near = near.filter(F.when(F.size("u") < k, C("hits") * 100 >= F.size("u") * percent).otherwise(C("hits") >= F.size("u") * floor))
    near = near.select("a", "b", "a_n", "b_n").join(side(sets, "b"), "b").join(side(sets, "a"), "a")
    both = F.size(F.array_intersect("a_set", "b_set"))
    return near.select("a", "b", "a_n", "b_n", both.alias("i")).filter(C("i") * 100 >= (C("a_n") + C("b_n") - C("i")) * percent).select("a", "b")


def near_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = PERCENT, k: int = K) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id, kept."""
    floor = percent / 100 - 5 * math.sqrt(percent / 100 * (1 - percent / 100) / k)
    own = stage(sketches(docs, id_col, text_col, k))
    classes = stage(own.filter("n > 0 AND doc_id IS NOT NULL").groupBy("n", "digest").agg(F.min("doc_id").alias("rep"), F.min_by(F.struct("sketch", "bits"), "doc_id").alias("x")).select("n", "digest", "rep", "x.*"))
    reps = classes.select("rep", "n", "sketch")

    # inverted lists, only of values that several classes retain, and of each class only its rarest values
    post = reps.select("rep", "n", F.size("sketch").alias("s"), F.explode("sketch").alias("value"))
    several = post.groupBy("value").agg(F.count("*").alias("c")).filter("c > 1")
    need = F.when(C("s") < k, F.ceil(C("s") * max(0.0, 2 - 100 / percent) - 1e-9)).otherwise(F.ceil(C("s") * floor))
    shared = post.join(several, "value").groupBy("rep", "n", "s").agg(F.array_sort(F.collect_list(F.struct("c", "value"))).alias("by_c"))
    room = F.greatest(F.lit(0), C("s") - need + 1 - (C("s") - F.size("by_c"))).cast("int")  # values of one class only come first
    index = stage(shared.select("rep", "n", F.explode(F.slice("by_c", F.lit(1), room)).alias("x")).select("rep", "n", C("x.value").alias("value")))
    index = index.join(classes.select("rep", "bits"), "rep")
    live = index.join(index.groupBy("value").count().filter("count > 1").select("value"), "value")
    sets = stage(full_sets(docs, live.select("rep").distinct(), id_col, text_col))

    # first, each class meets one pivot: the smallest class that leads one of its lists
    pivot = index.groupBy("value").agg(F.min_by(F.struct("n", "bits"), "rep").alias("p"), F.min("rep").alias("a")).select("value", "a", C("p.n").alias("p_n"), C("p.bits").alias("p_bits"))
    met = index.join(pivot, "value").filter((C("rep") != C("a")) & _may_link("", "p_", percent))
    tested = stage(met.groupBy("rep").agg(F.min("a").alias("a")).select("a", C("rep").alias("b")))
    roots = labels_of(stage(verified(tested, reps, sets, percent, k, floor)))

    # then a pivot of its own for each list, drawn anew in each round, then all pairs of a list whose ends are still apart
    for draw in (*range(PIVOT_ROUNDS), None):
        at = index.join(roots.withColumnRenamed("node", "rep"), "rep", "left").select("value", "rep", "n", "bits", F.coalesce("root", "rep").alias("root"))
        apart = at.groupBy("value").agg(F.min("root").alias("lo"), F.max("root").alias("hi"), F.min_by("rep", F.xxhash64("rep", "value", F.lit(draw or 0))).alias("lead")).filter("lo <> hi")
        left = at.join(apart.select("value", "lead"), "value")
        if draw is None:
            # a size class is as wide as the sizes of a link may differ: the larger of two linked sets is in the smaller one's class or the next
            kind = F.floor(F.log(C("n").cast("double")) / math.log(100 / percent)).cast("int")
            left, key = left.withColumn("kind", kind), ["value", "kind"]
            larger = left.withColumn("kind", F.explode(F.array(C("kind"), C("kind") - 1)))
            first = (C("n") > C("b_n")) | ((C("n") == C("b_n")) & (C("rep") > C("b")))
        else:
            larger, left, key, first = left, left.filter("rep = lead"), ["value"], C("rep") != C("b")
        other = left.select(*key, C("rep").alias("b"), C("n").alias("b_n"), C("root").alias("b_root"), C("bits").alias("b_bits"))
        found = larger.join(other, key).filter(first & (C("root") != C("b_root")) & _may_link("", "b_", percent)).select(F.least("rep", "b").alias("a"), F.greatest("rep", "b").alias("b"))
        fresh = stage(found.distinct().join(tested, ["a", "b"], "left_anti"))
        roots = labels_of(stage(verified(fresh, reps, sets, percent, k, floor)), roots)
        tested = tested.unionByName(fresh)

    out = own.join(classes.select("n", "digest", "rep"), ["n", "digest"], "left").join(roots.withColumnRenamed("node", "rep"), "rep", "left")
    component = F.when(C("doc_id").isNotNull(), F.coalesce("root", "rep", "doc_id"))
    return out.select("doc_id", C("n").alias("n_shingles"), component.alias("component_id")).withColumn("kept", C("doc_id").eqNullSafe(C("component_id")))


def near_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = PERCENT, k: int = K) -> DataFrame:
    """The rows of ``docs`` that stay, all columns: of each component the document with the smallest id."""
    name = "_" * (1 + max(map(len, docs.columns)))  # longer than any column of the documents
    gone = stage(near_groups(docs, id_col, text_col, percent, k).filter("NOT kept").select(C("doc_id").alias(name)).distinct())
    return docs.join(gone, C(id_col) == C(name), "left_anti")


SQL = r"""WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS (SELECT DISTINCT doc_id, md5(unnest(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')] ELSE list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i+4], ' ')) END)) AS g FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS i FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
l AS (SELECT x, y FROM p JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * i >= 85 * (a.n + b.n - i)),
e AS (SELECT x, y FROM l UNION ALL SELECT y, x FROM l),
r AS (SELECT doc_id, doc_id AS root FROM documents UNION SELECT y, root FROM r JOIN e ON x = doc_id WHERE root < y),
c AS (SELECT doc_id, min(root) AS component_id FROM r GROUP BY doc_id)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, component_id, d.doc_id = component_id AS kept FROM documents d JOIN c USING (doc_id) LEFT JOIN n USING (doc_id)"""
