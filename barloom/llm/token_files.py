"""Token ids as flat binary files: unsigned integers, 64-bit document offsets, read memory-mapped.

``write_tokens`` range-sorts the documents by id and writes for each partition ``part-N.tokens`` (unsigned 16-bit ids if all ids fit, else 32-bit,
little-endian), ``part-N.offsets`` (unsigned 64-bit, the start of each document in its part and then the part's length) and ``part-N.docs``
(signed 64-bit document ids, then a byte for each that is 1 where the id is null). Prefix sums over the parts' lengths give each part's base.
A file is written under a name of its own attempt and renamed, so a repeated task leaves the same files.

Null text counts as empty; null ids come first; rows with equal ids follow each other in the order of a hash of the text; an empty table gives
an empty manifest. Ids must be integers. The folder may be local, shared, or any URI that pyarrow's file systems open.
"""
from __future__ import annotations

import os
import uuid
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession, functions as F

from barloom.llm.common import C
from barloom.llm.word_ids import encoder
from barloom.sources.stage import shared_dir

SLICE = 2048


def _fs(uri: str) -> tuple[pa.fs.FileSystem, str]:
    return pa.fs.FileSystem.from_uri(uri) if "://" in uri or uri.startswith("file:") else (pa.fs.LocalFileSystem(), uri)


def _put(fs, path: str, tag: str, data: list[bytes]) -> None:
    with fs.open_output_stream(f"{path}.{tag}") as f:
        for x in data:
            f.write(x)
    fs.move(f"{path}.{tag}", path)


def write_tokens(docs: DataFrame, folder: str, tokenizer: str, end: int, id_col: str = "doc_id", text_col: str = "text") -> list[dict]:
    """Writes the files; returns the manifest, one entry per part with its base (bounded by the number of parts)."""
    fs, root = _fs(folder)
    fs.create_dir(root, recursive=True)

    def run(batches):
        from pyspark import TaskContext

        ctx = TaskContext.get()
        enc = encoder(tokenizer)
        fs, root = _fs(folder)
        name, tag = f"part-{ctx.partitionId():06d}", f"{ctx.taskAttemptId()}.tmp"
        step, starts, ids, nulls, at = np.dtype(enc.dtype).itemsize, [], [], [], 0
        with fs.open_output_stream(f"{root}/{name}.tokens.{tag}") as f:
            for batch in batches:
                for part in (batch.slice(lo, SLICE) for lo in range(0, batch.num_rows, SLICE)):
                    tokens, offsets = enc.encode(part.column(1), end)
                    f.write(tokens.tobytes())
                    starts.append(at + offsets[:-1])
                    ids.append(pc.fill_null(part.column(0), 0).to_numpy())
                    nulls.append(part.column(0).is_null().to_numpy(zero_copy_only=False))
                    at += len(tokens)
        if starts:
            _put(fs, f"{root}/{name}.offsets", tag, [np.append(np.concatenate(starts), at).astype("<u8").tobytes()])
            _put(fs, f"{root}/{name}.docs", tag, [np.concatenate(ids).astype("<i8").tobytes(), np.concatenate(nulls).astype("u1").tobytes()])
            fs.move(f"{root}/{name}.tokens.{tag}", f"{root}/{name}.tokens")
            yield pa.RecordBatch.from_arrays([pa.array([ctx.partitionId()], pa.int32()), pa.array([name]), pa.array([sum(map(len, starts))], pa.int64()), pa.array([at], pa.int64()), pa.array([step], pa.int32())],
                                             names=["part", "name", "n_docs", "n_tokens", "width"])
        else:
            fs.delete_file(f"{root}/{name}.tokens.{tag}")

    key = [C("doc_id"), F.xxhash64("text")]
    rows = docs.select(C(id_col).cast("long").alias("doc_id"), C(text_col).cast("string").alias("text")).repartitionByRange(*key).sortWithinPartitions(*key)
    parts = sorted((r.asDict() for r in rows.mapInArrow(run, "part int, name string, n_docs long, n_tokens long, width int").collect()), key=lambda r: r["part"])
    base = 0
    for p in parts:
        p["base"], base = base, base + p["n_tokens"]
    return parts


def _mapped(fs, path: str) -> np.ndarray:
    """The file's bytes, mapped where the file system is local."""
    if isinstance(fs, pa.fs.LocalFileSystem):
        return np.memmap(path, "u1", "r") if os.path.getsize(path) else np.zeros(0, "u1")
    with fs.open_input_file(path) as f:
        return np.frombuffer(f.read_buffer(), "u1")


def read_tokens(spark: SparkSession, folder: str, parts: list[dict], with_ids: bool = False) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32[, ids]) of every document in the files; ``start`` counts the ids of all documents before it."""
    schema = "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids array<long>" * with_ids
    listed = spark.createDataFrame([(p["name"], p["base"], p["width"], p["n_docs"]) for p in parts], "name string, base long, width int, n_docs long")

    def run(batches):
        fs, root = _fs(folder)
        for batch in batches:
            for name, base, width, n in zip(*(c.to_pylist() for c in batch.columns)):
                tokens = _mapped(fs, f"{root}/{name}.tokens").view(f"<u{width}")
                offsets = _mapped(fs, f"{root}/{name}.offsets").view("<u8").astype(np.int64)
                raw = _mapped(fs, f"{root}/{name}.docs")
                docs, nulls = np.array(raw[: 8 * n]).view("<i8"), np.array(raw[8 * n:]).astype(bool)
                for lo in range(0, n, 4096):
                    at = range(lo, min(n, lo + 4096))
                    crc = [zlib.crc32(tokens[offsets[i]:offsets[i + 1]].astype("<u4").tobytes()) for i in at]
                    cols = [pa.array(docs[lo:at.stop], mask=nulls[lo:at.stop]), pa.array(base + offsets[lo:at.stop]), pa.array(np.diff(offsets[lo:at.stop + 1])), pa.array(crc, pa.int64())]
                    if with_ids:
                        cols.append(pa.array([tokens[offsets[i]:offsets[i + 1]].astype(np.int64) for i in at], pa.list_(pa.int64())))
                    yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "start", "n_tokens", "ids_crc32", "ids"][: len(cols)])

    return listed.repartition(max(1, len(parts))).mapInArrow(run, schema)


def token_folder(spark: SparkSession) -> str:
    """A new folder in the cluster's shared one."""
    return f"{shared_dir(spark).rstrip('/')}/tokens-{uuid.uuid4().hex}"
