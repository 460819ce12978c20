"""Substring deduplication by De Bruijn compaction.

Windows of 13 words are the edges of a De Bruijn graph over words. An edge is named by the first place where it occurs, its source coordinate
(smallest document id, then position). Edges that occur in a document with a larger id are repeated; where such edges follow each other both
in the document and at the source, without a branch, they are one path. Paths compact through joins: an edge is a head if no edge ends where it starts,
at the same distance to the same source, and a tail if none starts where it ends; the n-th head and the n-th tail of a distance bound a span
(document, start, source document, source start). Words covered by repeated edges are removed, judged on the input. A span counts only if the
words at its place have the digest of the words at its source; where they differ, each of its windows is compared by itself.

Edges travel in runs: consecutive windows that share the smallest hash among their six-word sequences (their minimizer) form one row, and equal
windows always have equal minimizers. A first pass over the texts counts minimizers only and finds those of two documents or more; the second
makes runs of these alone, told by a Bloom bitmap of bounded size (what it lets through too much, the edges themselves sort out). An edge is
named by the minimizer and a 64-bit hash of the whole window, so windows that share a hot minimizer are told apart by 64 bits.

Defined cases: null text has no words; texts of fewer than 13 words lose nothing; rows with a null id neither lend nor lose; rows with equal id are
never each other's source, and their edges stay as short as their runs; repeats inside one document stay; an empty table gives an empty result; extra
columns are not read.
"""
from __future__ import annotations

import hashlib
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, Window as W, functions as F

from barloom.llm import exact_dedup
from barloom.llm.common import C
from barloom.llm.near_dedup import sequence_hashes
from barloom.sources.stage import stage

WINDOW = 13
ANCHOR = 6
FILTER_BITS = 29  # log2 of the bits of a bitmap at most, 64 MB; when crowded it lets more through and results stay the same
SLICE_ROWS = 256
SLICE_BYTES = 1 << 20  # texts are worked on in slices of about this size; a longer text is a slice of its own
CACHE_WORDS = 200_000


class Members:
    """Bloom bitmap with two probes over well-mixed 64-bit keys; ``in`` for arrays, never false for a member."""

    def __init__(self, keys: DataFrame, key: str):
        self.bits = min(FILTER_BITS, max(6, (16 * keys.count()).bit_length()))
        slot = F.explode(F.expr(f"array(`{key}` & {(1 << self.bits) - 1}L, shiftrightunsigned(`{key}`, {FILTER_BITS}) & {(1 << self.bits) - 1}L)"))
        words = keys.select(slot.alias("slot")).groupBy(F.expr("shiftright(slot, 6)").alias("at")).agg(F.expr("bit_or(shiftleft(1L, CAST(slot & 63 AS INT)))").alias("word")).toArrow()
        bitmap = np.zeros(1 << self.bits - 6, np.uint64)
        bitmap[words.column(0).to_numpy()] = words.column(1).to_numpy().view(np.uint64)
        self.bitmap = keys.sparkSession.sparkContext.broadcast(bitmap)

    def maybe(self, keys: np.ndarray) -> np.ndarray:
        bitmap, keys, found = self.bitmap.value, keys.astype(np.int64, copy=False).view(np.uint64), None
        for shift in (0, FILTER_BITS):
            slot = (keys >> np.uint64(shift)) & np.uint64((1 << self.bits) - 1)
            hit = (bitmap[slot >> np.uint64(6)] >> (slot & np.uint64(63))) & np.uint64(1)
            found = hit if found is None else found & hit
        return found.astype(bool)


def told(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """``docs`` with column ``_told``: false only where ``doc_id`` is none of ``ids`` (doc). A bitmap of bounded size is broadcast."""
    bits, n = exact_dedup.BLOCK_BITS, ids.count()
    while bits < min(1 << FILTER_BITS, 16 * n):
        bits *= 2
    blocks = bits // exact_dedup.BLOCK_BITS
    block, slots = exact_dedup._slots(C("digest"), blocks)
    held = ids.select(C("doc").alias("digest")).select(block.alias("block"), F.explode(slots).alias("slot")).groupBy("block").agg(F.expr("bitmap_construct_agg(slot)").alias("bits"))
    marked = exact_dedup.flag_repeated(docs.withColumn("digest", C("doc_id").cast("long")), held, blocks)
    return marked.withColumn("_told", C("doc_id").isNotNull() & C("maybe_repeated")).drop("digest", "maybe_repeated")


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").split()


def digest(words: list[bytes]) -> bytes:
    return hashlib.blake2b(b" ".join(words), digest_size=16).digest()


def slices(batches, text: int = 1):
    """The batches in slices of bounded rows and text, but for single long texts."""
    for batch in batches:
        size = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False)
        part = np.stack([np.cumsum(size.astype(np.int64)) // SLICE_BYTES, np.arange(len(size)) // SLICE_ROWS])
        cuts = [0, *(np.flatnonzero((part[:, 1:] != part[:, :-1]).any(0)) + 1).tolist(), len(size)]
        for lo, hi in zip(cuts, cuts[1:]):
            if lo < hi:
                yield batch.slice(lo, hi - lo)


class Hashes(dict):
    """64-bit hashes of words; emptied between slices when it holds too many."""

    def __missing__(self, word: bytes) -> int:
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h


def least_of(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each ``width`` successive values, in doubling steps."""
    out, step = values, 1
    while step < width:
        more = min(step, width - step)
        out = np.minimum(out[:-more], out[more:])
        step += more
    return out


def windows_of(texts: list[str | None], known: Hashes, window: int, anchor: int):
    """Word hashes of all texts in a row; of each window within a text, its place in that row, its text, its position there and its minimizer."""
    if len(known) > CACHE_WORDS:
        known.clear()
    words = [words_of(t) for t in texts]
    sizes = np.array([len(w) for w in words], np.int64)
    row = np.fromiter(map(known.__getitem__, chain.from_iterable(words)), np.uint64, sizes.sum())
    text = np.repeat(np.arange(len(sizes)), np.maximum(sizes - window + 1, 0))
    if not len(text):
        return row, text, text, text, text
    per = np.maximum(sizes - window + 1, 0)
    pos = np.arange(len(text)) - np.repeat(np.cumsum(per) - per, per)
    at = pos + np.repeat(np.cumsum(sizes) - sizes, per)
    return row, at, text, pos, least_of(sequence_hashes(row, anchor), window - anchor + 1)[at].view(np.int64)


def located(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.filter(C(id_col).isNotNull()).select(C(id_col).cast("long").alias("doc_id"), C(text_col).cast("string").alias("text"))


def minimizers(docs: DataFrame, id_col: str, text_col: str, window: int, anchor: int) -> DataFrame:
    """(v, lo, hi): minimizers with the smallest and largest document of a slice of the texts."""
    def run(batches):
        known = Hashes()
        for part in slices(batches):
            ids = part.column(0).to_numpy()
            _, _, text, _, v = windows_of(part.column(1).to_pylist(), known, window, anchor)
            if len(v):
                new = np.concatenate([[True], (v[1:] != v[:-1]) | (text[1:] != text[:-1])])
                v, doc = v[new], ids[text[new]]
                order = np.argsort(v, kind="stable")
                v, doc = v[order], doc[order]
                first = np.flatnonzero(np.concatenate([[True], v[1:] != v[:-1]]))
                yield pa.RecordBatch.from_arrays([pa.array(v[first]), pa.array(np.minimum.reduceat(doc, first)), pa.array(np.maximum.reduceat(doc, first))], names=["v", "lo", "hi"])

    return located(docs, id_col, text_col).mapInArrow(run, "v long, lo long, hi long")


def runs(docs: DataFrame, id_col: str, text_col: str, window: int, anchor: int, shared: Members) -> DataFrame:
    """(v, doc, pos, hs): minimizer, document, position of the first window and the hashes of the windows of the runs that may be shared.

    A run has at most ``window - anchor + 1`` windows.
    """
    def run(batches):
        known = Hashes()
        for part in slices(batches):
            ids = part.column(0).to_numpy()
            row, at, text, pos, v = windows_of(part.column(1).to_pylist(), known, window, anchor)
            if not len(v):
                continue
            new = np.flatnonzero(np.concatenate([[True], (v[1:] != v[:-1]) | (text[1:] != text[:-1])]))
            in_run = np.arange(len(v)) - np.repeat(new, np.diff(np.append(new, len(v))))
            first = np.flatnonzero(in_run % (window - anchor + 1) == 0)
            size, take = np.diff(np.append(first, len(v))), shared.maybe(v[first])
            if take.any():
                hs = sequence_hashes(row, window)[at[np.repeat(take, size)]].view(np.int64)
                first, size = first[take], size[take]
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(size)]).astype(np.int32)), pa.array(hs))
                yield pa.RecordBatch.from_arrays([pa.array(v[first]), pa.array(ids[text[first]]), pa.array(pos[first].astype(np.int32)), lists], names=["v", "doc", "pos", "hs"])

    return located(docs, id_col, text_col).mapInArrow(run, "v long, doc long, pos int, hs array<long>")


def repeated_edges(docs: DataFrame, id_col: str, text_col: str, window: int, anchor: int) -> DataFrame:
    """(doc, src_doc, apart, first, last): repeated edges that follow each other within one run; ``apart`` is the distance to the source.

    A run has at most ``window - anchor + 1`` windows, so its edges of one distance are a small set of bits.
    """
    count = minimizers(docs, id_col, text_col, window, anchor).groupBy("v").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"))
    shared = Members(stage(count.filter("lo < hi").select("v")), "v")
    edges = runs(docs, id_col, text_col, window, anchor, shared).repartition("v").select("v", "doc", "pos", F.posexplode("hs").alias("i", "h"))
    edges = edges.withColumn("src", F.min(F.struct("doc", (C("pos") + C("i")).alias("pos"))).over(W.partitionBy("v", "h"))).filter("src.doc < doc")
    edges = edges.select("v", "doc", "pos", "i", C("src.doc").alias("src_doc"), (C("pos") + C("i") - C("src.pos")).alias("apart"))
    g = edges.groupBy("v", "doc", "pos", "src_doc", "apart").agg(F.min("i").alias("lo"), F.max("i").alias("hi"), F.expr("bit_or(shiftleft(1L, i))").alias("bits"))
    whole = F.expr("bit_count(bits) = hi - lo + 1")
    parts = F.when(whole, F.array(F.struct("lo", "hi"))).otherwise(F.expr("transform(filter(sequence(lo, hi), k -> shiftright(bits, k) & 1L = 1L), k -> named_struct('lo', k, 'hi', k))"))
    return g.select("doc", "src_doc", "apart", "pos", F.explode(parts).alias("p")).select("doc", "src_doc", "apart", (C("pos") + C("p.lo")).alias("first"), (C("pos") + C("p.hi")).alias("last"))


def compacted(edges: DataFrame) -> DataFrame:
    """(doc, src_doc, apart, first, last) of the nonbranching paths: heads and tails by anti-joins, paired in order along each distance.

    Edges of one document and distance must not overlap.
    """
    line = ["doc", "src_doc", "apart"]
    starts, ends = edges.select(*line, C("first").alias("at")), edges.select(*line, (C("last") + 1).alias("at"))
    nth = F.row_number().over(W.partitionBy(*line).orderBy("at"))
    heads = starts.join(ends, [*line, "at"], "left_anti").select(*line, nth.alias("n"), C("at").alias("first"))
    tails = ends.join(starts, [*line, "at"], "left_anti").select(*line, nth.alias("n"), (C("at") - 1).alias("last"))
    return heads.join(tails, [*line, "n"]).drop("n")


def repeated_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, anchor: int = ANCHOR) -> DataFrame:
    """(doc, start, n_words, src_doc, src_start) of the compacted spans, by hashes only; they may overlap."""
    edges = stage(repeated_edges(docs, id_col, text_col, window, anchor))
    often = stage(docs.filter(C(id_col).isNotNull()).groupBy(C(id_col).cast("long").alias("doc")).count().filter("count > 1").select("doc"))
    spans = compacted(edges.join(often, "doc", "left_anti")).unionByName(edges.join(often, "doc", "left_semi"))
    return spans.select("doc", C("first").alias("start"), (C("last") - C("first") + window).alias("n_words"), "src_doc", (C("first") - C("apart")).alias("src_start"))


def slice_digests(docs: DataFrame, spans: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(doc, start, n_words, src_doc, src_start, digest) of the words at the spans, and with null source those at the distinct sources."""
    own = spans.select(C("doc").alias("of"), C("start").alias("at"), "n_words", "src_doc", "src_start")
    source = spans.select(C("src_doc").alias("of"), C("src_start").alias("at"), "n_words").distinct().withColumns({"src_doc": F.lit(None).cast("long"), "src_start": F.lit(None).cast("int")})
    wanted = own.unionByName(source).groupBy("of").agg(F.collect_list(F.struct("at", "n_words", "src_doc", "src_start")).alias("slices"))

    def run(batches):
        for part in slices(batches):
            found = part.column(2)
            size = found.value_lengths().to_numpy()
            found = found.flatten()
            at, n_words = found.field(0).to_numpy(), found.field(1).to_numpy()
            inside, digests, place = np.zeros(len(at), bool), [], 0
            for text, n in zip(part.column(1).to_pylist(), size.tolist()):
                words = words_of(text)
                for k in range(place, place + n):
                    start, end = int(at[k]), int(at[k]) + int(n_words[k])
                    if end <= len(words):
                        inside[k] = True
                        digests.append(digest(words[start:end]))
                place += n
            if digests:
                own = pa.RecordBatch.from_arrays([pa.array(np.repeat(part.column(0).to_numpy(), size)), *(found.field(i) for i in range(4))], names=["doc", "start", "n_words", "src_doc", "src_start"])
                own = own.filter(pa.array(inside))
                yield pa.RecordBatch.from_arrays([*own.columns, pa.array(digests, pa.binary())], names=[*own.schema.names, "digest"])

    ids = stage(spans.select("doc").union(spans.select("src_doc")).distinct())
    rows = told(located(docs, id_col, text_col), ids).filter("_told").join(wanted, C("doc_id") == C("of"))
    return rows.select("doc_id", "text", "slices").mapInArrow(run, "doc long, start int, n_words int, src_doc long, src_start int, digest binary")


def verified_spans(docs: DataFrame, spans: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """(doc, start, n_words, digest) of the spans whose words are those at their source; of the others, the single windows of which that holds."""
    def compared(spans):
        slices = stage(slice_digests(docs, spans, id_col, text_col))
        source = slices.filter("src_doc IS NULL").select(C("doc").alias("src_doc"), C("start").alias("src_start"), "n_words", "digest", F.lit(True).alias("same"))
        return stage(slices.filter("src_doc IS NOT NULL").join(source, ["src_doc", "src_start", "n_words", "digest"], "left"))

    found = compared(spans)
    same, apart = found.filter("same"), found.filter("same IS NULL").filter(C("n_words") > window)
    if not apart.isEmpty():
        singles = apart.withColumn("i", F.explode(F.sequence(F.lit(0), C("n_words") - window))).select("doc", (C("start") + C("i")).alias("start"), F.lit(window).alias("n_words"), "src_doc", (C("src_start") + C("i")).alias("src_start"))
        same = same.unionByName(compared(singles).filter("same"))
    return same.select("doc", "start", "n_words", "digest")


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, anchor: int = ANCHOR) -> DataFrame:
    """(doc_id, n_words, n_removed, text): each document without its repeated words, the others joined by one space."""
    spans = stage(repeated_spans(docs, id_col, text_col, window, anchor))
    per_doc = stage(verified_spans(docs, spans, id_col, text_col, window).groupBy(C("doc").alias("_doc")).agg(F.collect_list(F.struct("start", "n_words", "digest")).alias("spans")))

    def run(batches):
        for part in slices(batches):
            n, removed, kept = [], [], []
            size = pc.fill_null(part.column(2).value_lengths(), 0).to_pylist()
            found, place = part.column(2).flatten(), 0
            start, n_words, digests = found.field(0).to_numpy(), found.field(1).to_numpy(), found.field(2)
            for text, spans in zip(part.column(1).to_pylist(), size):
                words = words_of(text)
                n.append(len(words))
                if spans:
                    gone = np.zeros(len(words), bool)
                    for k in range(place, place + spans):
                        lo, hi = int(start[k]), int(start[k]) + int(n_words[k])
                        if hi <= len(words) and digest(words[lo:hi]) == digests[k].as_py():
                            gone[lo:hi] = True
                    place += spans
                    words = [w for w, g in zip(words, gone.tolist()) if not g]
                removed.append(n[-1] - len(words))
                kept.append(b" ".join(words).decode("utf-8", "surrogatepass"))
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(n, pa.int64()), pa.array(removed, pa.int64()), pa.array(kept, pa.string())], names=["doc_id", "n_words", "n_removed", "text"])

    kind = docs.schema[id_col].dataType.simpleString()
    own = told(docs.select(C(id_col).alias("doc_id"), C(text_col).cast("string").alias("text")), stage(per_doc.select(C("_doc").alias("doc"))))
    whole = own.filter("NOT _told").select("doc_id", "text", F.lit(None).cast(per_doc.schema["spans"].dataType).alias("spans"))
    cut = own.filter("_told").join(per_doc, C("doc_id").cast("long") == C("_doc"), "left").select("doc_id", "text", "spans")
    return whole.unionByName(cut).mapInArrow(run, f"doc_id {kind}, n_words long, n_removed long, text string")


SQL = r"""WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
g AS (SELECT doc_id, i, md5(array_to_string(ws[i:i+12], ' ')) AS h FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 11)) AS i FROM w WHERE len(ws) >= 13)),
m AS (SELECT h, min(doc_id) AS lo FROM g GROUP BY h),
c AS (SELECT DISTINCT doc_id, unnest(range(i, i + 13)) AS i FROM g JOIN m USING (h) WHERE lo < doc_id),
t AS (SELECT doc_id, unnest(ws) AS word, unnest(range(1, len(ws) + 1)) AS i FROM w),
k AS (SELECT doc_id, string_agg(word, ' ' ORDER BY i) AS kept, count(*) AS n FROM t ANTI JOIN c USING (doc_id, i) GROUP BY doc_id)
SELECT w.doc_id, len(ws)::BIGINT AS n_words, (len(ws) - coalesce(k.n, 0))::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM w LEFT JOIN k USING (doc_id)"""
