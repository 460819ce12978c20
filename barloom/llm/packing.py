"""Mixture-controlled packing: deficit round-robin over source queues fills sequences to target token proportions.

Each source is a queue of its documents' tokens. Rounds visit the sources in turn; a visit adds the source's quantum, its share of a sequence, to
the source's deficit and serves as many grains (``GRAIN`` tokens) as the deficit holds; what is left of the deficit stays for the next round. When
a queue runs dry, the quanta of the others grow by their weights. The served tokens, one after the other, are cut into sequences of ``length``
tokens, so that each holds about one round and no deficit is lost at its end. As every visit's service is the floor of a running total,
the queue position at any round has a closed form: the driver only computes one phase for each queue that runs dry, and each task places its own
documents, wherever their queue lies. The last tokens, fewer than ``length``, fill sequences whose lengths are powers of two, so nothing is padded.

By default the targets are the sources' own shares of all tokens, which all sequences can keep to the end; other weights hold until a queue is
dry. Documents are queued in the order of a hash of id and text.

Defined cases: null text is empty and has the end id only; a null source is a source of its own, visited last (the others by code point); a source
without weight, or with a weight of 0, is served when the others are dry; null ids come first of equal hashes; repeated rows are packed as often as
they occur; long documents are cut; an empty table gives an empty result; other columns take no part. Sources are counted on the driver, with
one row per source, and every task holds sources x phases numbers: sources are meant to be thousands at most.
"""
from __future__ import annotations

import zlib
from collections.abc import Mapping
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from barloom.llm.common import C
from barloom.llm.word_ids import encoder, spread
from barloom.sources.stage import stage

LENGTH = 2048
GRAIN = 64
UNIT = 1 << 16  # parts of a token in quanta and deficits
SLICE = 2048


@dataclass
class Rounds:
    """The rounds' plan: for each phase its first round, and per source the quantum, deficit and served tokens at its start."""
    sizes: np.ndarray
    first: np.ndarray
    quantum: np.ndarray
    deficit: np.ndarray
    served: np.ndarray
    grain: int

    def through(self, phase: np.ndarray, visits: np.ndarray, source) -> np.ndarray:
        """Tokens of the source served when it has had so many visits of the phase."""
        grains = (self.deficit[phase, source] + visits * self.quantum[phase, source]) // (self.grain * UNIT)
        return np.minimum(self.sizes[source], self.served[phase, source] + grains * self.grain)


def plan_rounds(sizes: list[int], weights: list[int], length: int = LENGTH, grain: int = GRAIN) -> Rounds:
    """Phases of deficit round-robin over queues of so many tokens."""
    served, deficit, at = [0] * len(sizes), [0] * len(sizes), 0
    rows = []
    while any(s < n for s, n in zip(served, sizes)):
        live = [i for i, (s, n) in enumerate(zip(served, sizes)) if s < n]
        live = [i for i in live if weights[i] > 0] or live
        total = sum(max(1, weights[i]) for i in live)
        quantum = [0] * len(sizes)
        for i in live:
            quantum[i] = max(1, max(1, weights[i]) * length * UNIT // total)
        rows.append((at, quantum, list(deficit), list(served)))
        # rounds until the first queue is dry
        step = min(-(-(-(-(sizes[i] - served[i]) // grain) * grain * UNIT - deficit[i]) // quantum[i]) for i in live)
        for i in live:
            grains, deficit[i] = divmod(deficit[i] + step * quantum[i], grain * UNIT)
            served[i] = min(sizes[i], served[i] + grains * grain)
        at += step
    table = lambda k: np.array([r[k] for r in rows], np.int64).reshape(len(rows), len(sizes))
    return Rounds(np.array(sizes, np.int64), np.array([r[0] for r in rows], np.int64), table(1), table(2), table(3), grain)


def portions(plan: Rounds, source: int, start: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(row, queue position, tokens, place among all served tokens) of the parts that rounds make of stretches of one queue."""
    # by grains, not by rounds: a small source sits out most rounds
    first = start // plan.grain
    count = (start + size - 1) // plan.grain - first + 1
    row, grain = np.repeat(np.arange(len(start)), count), spread(first, count)
    phase = np.searchsorted(plan.served[:, source], grain * plan.grain, side="right") - 1
    due = (grain * plan.grain - plan.served[phase, source] + plan.grain) * UNIT - plan.deficit[phase, source]
    visits = -(-due // plan.quantum[phase, source])
    use = np.append(True, (np.diff(row) != 0) | (np.diff(phase) != 0) | (np.diff(visits) != 0)) if len(row) else np.zeros(0, bool)
    row, phase, visits = row[use], phase[use], visits[use]
    lo, hi = np.maximum(start[row], plan.through(phase, visits - 1, source)), np.minimum((start + size)[row], plan.through(phase, visits, source))
    place = lo.copy()
    for other in range(len(plan.sizes)):
        if other != source:
            place += plan.through(phase, visits - (other > source), other)
    return row, lo, hi - lo, place


def edges(total: int, length: int) -> np.ndarray:
    """Where the sequences of the last tokens begin, and the end: powers of two, the largest first."""
    at, rest = total // length * length, total % length
    out = [at]
    while rest:
        at, rest = at + (1 << rest.bit_length() - 1), rest - (1 << rest.bit_length() - 1)
        out.append(at)
    return np.array(out, np.int64)


def sequences(place: np.ndarray, size: np.ndarray, total: int, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(part, tokens before it in its part, sequence, offset) of the pieces that sequence ends make of placed parts; the next piece or part ends each."""
    tail = edges(total, length)

    def number(x):
        return np.where(x < tail[0], x // length, tail[0] // length + np.searchsorted(tail, x, side="right") - 1)

    def begins(s):
        full = tail[0] // length
        return np.where(s < full, s * length, tail[np.clip(s - full, 0, len(tail) - 1)])

    first, last = number(place), number(place + size - 1)
    part = np.repeat(np.arange(len(place)), last - first + 1)
    seq = spread(first, last - first + 1)
    lo = np.maximum(place[part], begins(seq))
    return part, lo - place[part], seq, lo - begins(seq)


def token_rows(docs: DataFrame, tokenizer: str, end: int, id_col: str, text_col: str, source_col: str) -> DataFrame:
    """(source, h, doc_id, uid, n, ids): ids of each document as little-endian bytes, staged."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches):
        enc = encoder(tokenizer)
        for batch in (b.slice(lo, SLICE) for b in batches for lo in range(0, b.num_rows, SLICE)):
            ids, offsets = enc.encode(batch.column(4), end)
            raw = pa.Array.from_buffers(pa.large_binary(), batch.num_rows, [None, pa.py_buffer(offsets * ids.itemsize), pa.py_buffer(np.ascontiguousarray(ids))]).cast(pa.binary())
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array(np.diff(offsets)), raw], names=["source", "h", "doc_id", "uid", "n", "ids"])

    rows = docs.select(C(source_col).cast("string").alias("source"), F.xxhash64(C(id_col), C(text_col)).alias("h"), C(id_col).alias("doc_id"), F.monotonically_increasing_id().alias("uid"), C(text_col).cast("string").alias("text"))
    return stage(rows.mapInArrow(run, f"source string, h long, doc_id {kind}, uid long, n long, ids binary"))


def queued(rows: DataFrame) -> DataFrame:
    """Rows in queue order over balanced parts, with the part's number and the tokens before each row in its part and source; staged.

    The number of a row breaks ties of equal rows only, so that any group of copies can lie in several parts.
    """
    def run(batches):
        from pyspark import TaskContext

        part, sums = TaskContext.get().partitionId(), {}
        for batch in batches:
            n, before = batch.column(4).to_numpy(), np.empty(batch.num_rows, np.int64)
            runs = batch.column(0).dictionary_encode(null_encoding="encode")
            which, names = runs.indices.to_numpy(), runs.dictionary.to_pylist()
            for k, name in enumerate(names):
                at = np.flatnonzero(which == k)
                ends = sums.get(name, 0) + np.cumsum(n[at])
                before[at], sums[name] = ends - n[at], int(ends[-1])
            yield pa.RecordBatch.from_arrays([pa.array(np.full(batch.num_rows, part, np.int32)), *batch.columns, pa.array(before)], names=["part", *batch.schema.names, "before"])

    ordered = rows.repartitionByRange("source", "h", "doc_id", "uid").sortWithinPartitions("source", "h", "doc_id", "uid")
    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema.fields)
    return stage(ordered.mapInArrow(run, f"part int, {fields}, before long"))


def pack(docs: DataFrame, tokenizer: str, end: int, length: int = LENGTH, weights: Mapping[str | None, int] | None = None, grain: int = GRAIN,
         id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", with_ids: bool = False) -> DataFrame:
    """One row per piece of a document: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, source[, ids].

    ``weights`` are whole numbers per source; without them the sources' own token counts. ``ids`` are the piece's own, for writing sequences.
    """
    rows = queued(token_rows(docs, tokenizer, end, id_col, text_col, source_col))
    per_part = rows.groupBy("part", "source").agg(F.sum("n").alias("n"))
    counted = {r["source"]: int(r["n"]) for r in rows.groupBy("source").agg(F.sum("n").alias("n")).collect()}
    names = sorted(counted, key=lambda x: (x is None, x or ""))
    sizes = [counted[x] for x in names]
    total = sum(sizes)
    plan = plan_rounds(sizes, sizes if weights is None else [weights.get(x, 0) for x in names], length, grain)
    index = {x: i for i, x in enumerate(names)}
    # tokens of a source in the parts before: one row per part, and one more per source
    bases, before = [], dict.fromkeys(names, 0)
    for r in sorted(per_part.collect(), key=lambda r: r["part"]):
        bases.append((r["part"], index[r["source"]], before[r["source"]]))
        before[r["source"]] += int(r["n"])
    base = docs.sparkSession.createDataFrame(bases, "part int, source_no int, base long")
    numbers = docs.sparkSession.createDataFrame([(x, i) for x, i in index.items()], "_name string, source_no int")
    dtype = np.dtype(encoder(tokenizer).dtype)
    kind = dict(rows.dtypes)["doc_id"]

    def run(batches):
        for batch in (b.slice(lo, SLICE) for b in batches for lo in range(0, b.num_rows, SLICE)):
            source, start, n = (batch.column(i).to_numpy() for i in range(3))
            found = []
            for s in np.unique(source):
                own = np.flatnonzero(source == s)
                row, at, size, place = portions(plan, int(s), start[own], n[own])
                part, skip, seq, offset = sequences(place, size, total, length)
                ends = np.append(skip[1:], 0)
                last = np.append(part[1:] != part[:-1], True)
                found.append((own[row[part]], at[part] + skip - start[own[row[part]]], np.where(last, size[part], ends) - skip, seq, offset))
            if not found:
                continue
            row, begin, size, seq, offset = (np.concatenate(x) for x in zip(*found))
            raw = batch.column(4)
            ids = [np.frombuffer(x.as_buffer(), dtype) for x in raw]
            pieces = [ids[r][b:b + k] for r, b, k in zip(row.tolist(), begin.tolist(), size.tolist())]
            crc = [zlib.crc32(x.astype("<u4").tobytes()) for x in pieces]
            cols = [batch.column(3).take(pa.array(row)), pa.array(begin), pa.array(size), pa.array(crc, pa.int64()), pa.array(n[row]), pa.array(seq), pa.array(offset), batch.column(5).take(pa.array(row))]
            if with_ids:
                cols.append(pa.array([x.astype(np.int64) for x in pieces], pa.list_(pa.int64())))
            yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "source", "ids"][: len(cols)])

    placed = rows.join(F.broadcast(numbers), C("source").eqNullSafe(C("_name"))).join(F.broadcast(base), ["part", "source_no"])
    schema = f"doc_id {kind}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, source string" + ", ids array<long>" * with_ids
    return placed.select("source_no", (C("base") + C("before")).alias("start"), "n", "doc_id", "ids", "source").mapInArrow(run, schema)
